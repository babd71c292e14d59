"""The engine's tables: directories of immutable Parquet parts under ``<out>/parquet``.

Appending commits whole jobs; a part is never changed. The events are replaced as a whole:
new parts are written aside, and only if there are any do they take the old ones' place. That
takes two renames. Between them the table's folder is missing; whoever finds it so, a reader
meanwhile or a session after a crash, reads the new parts, which were whole before the first
rename, and a writer finishes the swap.

Where a few URLs change, their rows are laid over the table instead (``overlay``): a layer holds
the URLs it speaks of and their rows, and the last layer that speaks of a URL counts. Layers lie
in the table's folder, so a swap ends them; ``MOST_LAYERS`` of them are folded into it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import schemas as S
from chronofold.sources import files

MOST_LAYERS = 16
#: Rows up to which a result is one file, written by one task.
ONE_FILE_ROWS = 5_000_000
_KNOWN = S.TABLES | {"checkpoints": S.CHECKPOINT_LOG}


class Store:
    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")

    def path(self, table: str) -> str:
        if table not in _KNOWN:
            raise ValueError(f"no table {table!r}; there are {', '.join(_KNOWN)}")
        return f"{self.out}/parquet/{table}"

    def _aside(self, table: str, what: str) -> str:
        return f"{self.out}/parquet/.{table}.{what}"

    def place(self, table: str) -> str:
        """The folder that holds the table now: its own, or in the midst of a swap the one about to take its place."""
        own, ready = self.path(table), self._aside(table, "ready")
        return ready if not files.exists(self.spark, own) and files.exists(self.spark, ready) else own

    def parts(self, table: str) -> list[str]:
        return files.names(self.spark, f"{self.place(table)}/*.parquet")

    def has_rows(self, table: str) -> bool:
        return bool(self.parts(table) or self.layers(table)) and not self.read(table).isEmpty()

    def read(self, table: str) -> DataFrame:
        """The table, typed and empty if it has no parts; files that are no parts are passed over."""
        schema = _KNOWN[table]
        place, layers = self.place(table), self.layers(table)
        own = self.spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(place) if self.parts(table) else self.spark.createDataFrame([], schema)
        if not layers:
            return own
        rows, spoken = own.withColumn("__layer", F.lit(0)), []
        for n, at in layers:
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(f"{at}/rows").withColumn("__layer", F.lit(n)))
            spoken.append(self.spark.read.schema("url_id string").parquet(f"{at}/touched").withColumn("__last", F.lit(n)))
        last = reduce(DataFrame.unionByName, spoken).groupBy("url_id").agg(F.max("__last").alias("__last"))
        return rows.join(last, "url_id", "left").where(F.col("__layer") == F.coalesce("__last", F.lit(0))).select(*schema.names)

    def layers(self, table: str) -> list[tuple[int, str]]:
        """Number and folder of each layer that was written to its end, in order."""
        done = files.names(self.spark, f"{self.place(table)}/_layers/*/touched/_SUCCESS")
        return [(int(at.rsplit("/", 1)[1]), at) for at in (d.removesuffix("/touched/_SUCCESS") for d in done)]

    def overlay(self, table: str, touched: DataFrame, df: DataFrame) -> None:
        """From now on ``df`` has all rows of the URLs in ``touched``; others stay as they are and aren't written again."""
        layers = self.layers(table)
        if len(layers) >= MOST_LAYERS:
            self.replace(table, self.read(table))
            layers = []
        at = f"{self.place(table)}/_layers/{layers[-1][0] + 1 if layers else 1:08d}"
        files.remove(self.spark, at)
        self._shaped(table, df).write.parquet(f"{at}/rows")
        touched.select("url_id").distinct().write.parquet(f"{at}/touched")

    def _shaped(self, table: str, df: DataFrame) -> DataFrame:
        """The table's columns and types, instants cut to seconds, missing columns null."""
        columns = []
        for f in _KNOWN[table]:
            c = F.col(f.name) if f.name in df.columns else F.lit(None)
            c = c.cast(f.dataType)
            columns.append((F.date_trunc("second", c) if f.dataType.typeName() == "timestamp" else c).alias(f.name))
        return df.select(*columns)

    def append(self, table: str, df: DataFrame) -> None:
        self._shaped(table, df).write.mode("append").parquet(self.path(table))

    def _swap(self, table: str) -> None:
        """What is ready takes the table's place; safe to begin again wherever it was cut off."""
        own, ready, old = self.path(table), self._aside(table, "ready"), self._aside(table, "old")
        if files.exists(self.spark, ready):
            if files.exists(self.spark, own):
                files.remove(self.spark, old)
                files.move(self.spark, own, old)
            files.move(self.spark, ready, own)
        files.remove(self.spark, old)

    def replace(self, table: str, df: DataFrame) -> int:
        """Stage, then swap; an empty result leaves what is there. Returns the rows written."""
        staged = self._aside(table, "staged")
        files.remove(self.spark, staged)
        self._shaped(table, df).write.mode("overwrite").parquet(staged)
        self._swap(table)  # one that was cut off; df may have read it
        written = self.spark.read.schema(_KNOWN[table]).parquet(staged).count()
        if written:
            files.move(self.spark, staged, self._aside(table, "ready"))
            self._swap(table)
        else:
            files.remove(self.spark, staged)
        return written

    def write_summary(self, df: DataFrame) -> int:
        """One file, as readers of the summary expect one, up to ONE_FILE_ROWS URLs; a folder of parts beyond."""
        staged = files.scratch(self.spark, "summary")
        df.write.mode("overwrite").parquet(staged)
        return _exported(self.spark, self.spark.read.parquet(staged), f"{self.out}/summary.parquet", ONE_FILE_ROWS)

    def load_urls(self, limit: int | None = None, shard: int = 0, shards: int = 1) -> tuple[DataFrame, int]:
        """(url_id, original_url) and how many rows were seen; the limit counts before the shard does."""
        from chronofold.functions.urls import shard as shard_of

        rows = self.read("urls").select("url_id", "original_url")
        if limit is not None:
            rows = rows.orderBy("url_id").limit(limit)
        total = rows.count()
        return (rows.where(shard_of(F.col("url_id"), shards) == shard) if shards > 1 else rows), total

    def export(self, target: str, files_of: int | None = ONE_FILE_ROWS) -> dict[str, int]:
        """Each table, and the summary, under its name; a table without parts gives none.

        Up to ``files_of`` rows (None: never) a table becomes one file; a larger one becomes a folder
        of parts, written by as many tasks as there are, as one task would have to pass it all.
        """
        target, found = target.rstrip("/"), {}
        for table in S.TABLES:
            found[table] = _exported(self.spark, self.read(table), f"{target}/{table}.parquet", files_of) if self.parts(table) or self.layers(table) else 0
        source = f"{self.out}/summary.parquet"
        if files.exists(self.spark, source):
            found["summary"] = _exported(self.spark, self.spark.read.parquet(source), f"{target}/summary.parquet", files_of)
        return found


def _exported(spark: SparkSession, df: DataFrame, path: str, files_of: int | None) -> int:
    rows = df.count()
    if files_of is not None and rows <= files_of:
        return _one_file(spark, df, path)
    files.remove(spark, path)
    df.write.mode("overwrite").parquet(path)
    return rows


def _one_file(spark: SparkSession, df: DataFrame, path: str) -> int:
    staged = f"{path}.staged"
    files.remove(spark, staged)
    df.coalesce(1).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged).count()
    files.remove(spark, path)
    files.move(spark, files.names(spark, f"{staged}/part-*.parquet")[0], path)
    files.remove(spark, staged)
    return rows
