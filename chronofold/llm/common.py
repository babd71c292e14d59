"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix of every column the operators add for themselves, so that no column of the input clashes.
OWN = "__cf_"

#: Bytes in an Arrow batch sent to a Python worker, where the session sets none.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="chronofold-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` into the shared folder and read it back.

    The table goes when the driver's JVM ends, or earlier through ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronofold/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._cf_path = path
    _MADE.append(out)
    return out


#: The tables that are written and not yet deleted, in order.
_MADE: list[DataFrame] = []


def made() -> int:
    """How many tables there are; what comes after them is what ``release_since`` deletes."""
    return len(_MADE)


def release_since(n: int, keep: DataFrame) -> None:
    """Delete the tables written after the first ``n`` but one, once nothing reads them."""
    for df in _MADE[n:]:
        if df is not keep:
            release(df)


def release(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and no later plan reads."""
    p, fs = _path(df.sparkSession, df._cf_path)
    fs.delete(p, True)
    _MADE[:] = [x for x in _MADE if x is not df]


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that a batch of long texts fits in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def map_texts(
    docs: DataFrame,
    fn: Callable[[list[str | None]], dict[str, list]],
    schema: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Add the columns ``schema`` that ``fn`` makes of a list of texts to the columns ``keep``.

    Runs over Arrow batches in place: no shuffle, and one batch in memory.
    """
    bounded_batches(docs.sparkSession)
    made = T.StructType.fromDDL(schema)
    source = docs.select(*keep, F.col(text).cast("string").alias(f"{OWN}text"))
    out = T.StructType([*(source.schema[k] for k in keep), *made])
    names = [f.name for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(out)
        for b in batches:
            if b.num_rows:
                got = fn(b.column(len(keep)).to_pylist())
                columns = [*(b.column(i) for i in range(len(keep))), *(pa.array(got[n], want.field(n).type) for n in names)]
                yield pa.RecordBatch.from_arrays(columns, names=want.names)

    return source.mapInArrow(run, out)


#: Keys with more rows than this share of all, or than HOT_ROWS, are joined by broadcast: fewer than HOT_KEYS can have so many.
HOT_KEYS, HOT_ROWS = 100_000, 100


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, outer: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once with the number ``n`` of its rows; ``total`` is their sum.

    Rows of hot keys stay where they are: there are fewer than HOT_KEYS keys with more than
    ``total / HOT_KEYS`` rows, so these go to every task. Only the others are shuffled.
    ``outer`` keeps rows whose key the table doesn't have; no such key may be hot.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(table.where(F.col(n) > most).drop(n))
    cold = table.where(F.col(n) <= most).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left" if outer else "inner"))


#: Bits of a filter for each key, and at most: 8 MB of a broadcast, however many keys; with very many it lets more rows through.
KEY_BITS, FILTER_BITS = 64, 1 << 26


def may_be_in(rows: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a flag that is true wherever the long ``key`` is in the one column of ``keys``, and seldom elsewhere.

    The keys become a bitmap, made of pieces by the executors; rows stay where they are.
    """
    bucket, bits, at = (f"{OWN}filter_{x}" for x in ("bucket", "bits", "at"))
    size = min(FILTER_BITS, max(1 << 15, 1 << (KEY_BITS * keys.count()).bit_length()))
    place = lambda x: F.pmod(x, F.lit(size)) + 1
    wanted = place(F.col(keys.columns[0]))
    table = keys.where(F.col(keys.columns[0]).isNotNull()).groupBy(F.bitmap_bucket_number(wanted).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(wanted)).alias(bits))
    own = rows.withColumn(bucket, F.bitmap_bucket_number(place(key))).withColumn(at, F.bitmap_bit_position(place(key)))
    byte = F.conv(F.hex(F.substring(bits, (F.col(at) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.expr(f"cast({at} % 8 as int)")
    found = own.join(F.broadcast(table), bucket, "left")
    return found.select(*rows.columns, F.coalesce(F.getbit(byte, hit) == 1, F.lit(False)).alias(flag))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda an expression is else computed for every element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def words(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sampled(text: Column, key: Column, most: int) -> Column:
    """At most ``most`` characters of a text, from a place that the key chooses."""
    spare = F.greatest(F.length(text) - F.lit(most), F.lit(0))
    return F.substring(text, F.pmod(key, spare + 1).cast("int") + 1, F.lit(most))
