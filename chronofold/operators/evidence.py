"""The evidence relation and its folds.

Observations and captures become one relation keyed by (url_id, kind, witness): kind ``o``
for observers, ``c`` for archives. It is dealt once, by all three, so that a URL that every
archive captured often is spread over its witnesses; the lag and the fold of a witness share
that exchange. What goes on to be dealt by URL is one row for each witness.

Ties are settled by content, as times are whole seconds: the latest row is that of the
smallest status, then digest, nulls last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold import schemas as S
from chronofold.functions import statuses
from chronofold.functions.times import micros

KEYS = ("url_id", "kind", "witness")


def established_table(spark: SparkSession, years: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(sorted(years.items()), S.ESTABLISHED)


def flag_independent(captures: DataFrame, established: DataFrame, null_time: bool) -> DataFrame:
    """Adds ``is_independent``: the archive has no established year, or the capture is not older.

    ``established`` has a row for each archive of the registry, so it goes to every task. The
    classification keeps captures without a time (``null_time=True``), the summary doesn't.
    """
    years = F.broadcast(established.select(F.col("archive").alias("__archive"), "established_year"))
    year = F.year("capture_time") >= F.col("established_year")
    kept = F.col("established_year").isNull() | (F.coalesce(year, F.lit(True)) if null_time else F.coalesce(year, F.lit(False)))
    return captures.join(years, F.col("archive") == F.col("__archive"), "left").withColumn("is_independent", kept).drop("__archive", "established_year")


def evidence(observations: DataFrame, captures: DataFrame, established: DataFrame) -> DataFrame:
    """(url_id, kind, witness, t, status, digest, len, indep, dg); dg is the digest where content counts."""
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    obs = observations.select(
        "url_id", F.lit("o").alias("kind"), F.col("observer").alias("witness"), F.col("observation_time").alias("t"), "status", F.col("content_digest").alias("digest"),
        F.col("content_length").alias("len"), F.lit(True).alias("indep"), F.when(F.col("observer") == S.LIVE, filled("content_digest")).alias("dg"),
    )
    cap = flag_independent(captures, established, null_time=True).select(
        "url_id", F.lit("c").alias("kind"), F.col("archive").alias("witness"), F.col("capture_time").alias("t"), "status", "digest", F.col("content_length").alias("len"),
        F.col("is_independent").alias("indep"), filled("digest").alias("dg"),
    )
    return obs.unionByName(cap)


def latest_key(time: str, status: str = "status", digest: str | None = "digest") -> Column:
    """Smallest for the latest row."""
    parts = [F.coalesce(-micros(F.col(time)), F.lit(2**63 - 1)).alias("a"), F.col(status).isNull().alias("b"), F.col(status).alias("c")]
    if digest:
        parts += [F.col(digest).isNull().alias("d"), F.col(digest).alias("e")]
    return F.struct(*parts)


def latest(df: DataFrame, keys: list[str], time: str, status: str = "status", digest: str = "digest") -> DataFrame:
    """One row for each key: the latest. Pre-aggregates, so no key is gathered."""
    rest = F.struct(*(c for c in df.columns if c not in keys))
    return df.groupBy(*keys).agg(F.min_by(rest, latest_key(time, status, digest)).alias("r")).select(*keys, "r.*").select(*df.columns)


def with_transitions(ev: DataFrame) -> DataFrame:
    """Adds the digest and time before, within a witness's series of digests, and whether the digest changed."""
    series = Window.partitionBy(*KEYS, F.col("dg").isNull()).orderBy("t", "dg")
    out = ev.withColumn("t0", F.lag("t").over(series)).withColumn("d0", F.lag("dg").over(series))
    return out.withColumn("tr", F.coalesce(F.col("dg") != F.col("d0"), F.lit(False)))


def per_witness(ev: DataFrame, with_changes: bool = True) -> DataFrame:
    """One row for each (url_id, kind, witness)."""
    rows = with_transitions(ev.repartition(*KEYS)) if with_changes else ev
    long = F.when(F.col("dg").isNotNull() & (F.col("len") > 0), F.col("len"))
    order = F.struct("t", "len")
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        F.min("t").alias("min_t"),
        F.max("t").alias("max_t"),
        F.min_by("status", latest_key("t", "status", None)).alias("status"),
        F.min_by("status", F.when(F.col("indep"), latest_key("t", "status", None))).alias("indep_status"),
        F.bool_or("indep").alias("any_indep"),
    ]
    if with_changes:
        aggregates += [
            F.count("dg").alias("n_dg"),
            (F.min("dg") != F.max("dg")).alias("differs"),
            F.count(long).alias("n_len"),
            F.min_by("len", F.when(long.isNotNull(), order)).alias("first_len"),
            F.max_by("len", F.when(long.isNotNull(), order)).alias("last_len"),
            F.count_if("tr").alias("n_tr"),
            F.min(F.when(F.col("tr"), F.col("t0"))).alias("first_old"),
            F.max(F.when(F.col("tr"), F.col("t"))).alias("last_new"),
        ]
    return rows.groupBy(*KEYS).agg(*aggregates)


def inaccessible(witnesses: DataFrame) -> DataFrame:
    """The rows of ``per_witness`` that speak for a disappearance."""
    return witnesses.where(is_inaccessible())


def is_inaccessible() -> Column:
    dead_archive = F.col("any_indep") & statuses.is_terminal_capture(F.col("indep_status"))
    return F.coalesce(F.when(F.col("kind") == "o", F.col("status") == S.GONE).otherwise(dead_archive), F.lit(False))
