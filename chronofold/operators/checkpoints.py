"""Checkpoints as an append-only log and the view over it.

A mark adds one row: its state, how many attempts it counts (1, or 0 for a skip), its error
class. The view takes for each (url, witness) the rows after the last RESET: attempts are
summed, the state is the last one, the error the last that is not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold import schemas as S

KEYS = ["url_id", "witness"]


def mark(rows: DataFrame) -> DataFrame:
    """(url_id, witness, state, error_class, seq, updated_at) to rows of the log."""
    return rows.withColumn("inc", F.when(F.col("state").isin(S.SUCCESS, S.RETRY, S.FAILED), 1).otherwise(0)).select(*S.CHECKPOINT_LOG.names)


def view(log: DataFrame) -> DataFrame:
    """(url_id, witness, state, attempts, last_error_class); one exchange for the log, which is reduced before it.

    A run of attempts between resets can't be told apart before all marks of a key have met,
    so the reset's place is found first, in a pre-aggregated pass over reset rows alone.
    """
    resets = log.where(F.col("state") == S.RESET).groupBy(*KEYS).agg(F.max("seq").alias("reset"))
    live = log.where(F.col("state") != S.RESET).join(resets, KEYS, "left").where(F.col("reset").isNull() | (F.col("seq") > F.col("reset")))
    return live.groupBy(*KEYS).agg(
        F.max_by("state", "seq").alias("state"),
        F.sum("inc").cast("int").alias("attempts"),
        F.max_by("error_class", F.when(F.col("error_class").isNotNull(), F.col("seq"))).alias("last_error_class"),
    )


def done(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.where(F.col("state") != S.RETRY).select(*KEYS)


def pending(urls: DataFrame, witnesses: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Pairs still to be queried. ``witnesses`` is a registry-sized table, so it goes to every task."""
    return urls.crossJoin(F.broadcast(witnesses)).join(done(checkpoints), KEYS, "left_anti")


def retry_failures(checkpoints: DataFrame, witnesses: list[str], seq: int) -> DataFrame:
    """RESET rows for the permanent failures of these witnesses."""
    failed = checkpoints.where((F.col("state") == S.FAILED) & F.col("witness").isin(*witnesses))
    return failed.select(*KEYS, F.lit(S.RESET).alias("state"), F.lit(0).alias("inc"), F.lit(None).cast("string").alias("error_class"), F.lit(seq).cast("bigint").alias("seq"), F.current_timestamp().alias("updated_at"))


def resolved(observations: DataFrame, threshold: int = S.THRESHOLD) -> DataFrame:
    """URLs that need no more witnesses: one saw them alive, or enough saw them gone."""
    gone = F.size(F.collect_set(F.when(F.col("status") == S.GONE, F.col("observer"))))
    return observations.groupBy("url_id").agg(F.bool_or(F.col("status") == S.ALIVE).alias("a"), gone.alias("g")).where(F.coalesce("a", F.lit(False)) | (F.col("g") >= threshold)).select("url_id")


def split_early(pairs: DataFrame, resolved_urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs to query, pairs to mark as skipped)."""
    return pairs.join(resolved_urls, "url_id", "left_anti"), pairs.join(resolved_urls, "url_id", "left_semi")
