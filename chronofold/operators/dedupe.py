"""Deduplication and trimming by declared order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPTURE_KEY = ("capture_time", "memento_url", "digest", "record_id")


def _pick(df: DataFrame, keys: list[str], order: list[Column], first: bool) -> DataFrame:
    """One row for each key. The struct aggregate keeps a row for each key and task before the shuffle."""
    rest = F.struct(*(c for c in df.columns if c not in keys))
    by = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    chosen = F.min_by(rest, by) if first else F.max_by(rest, by)
    return df.groupBy(*keys).agg(chosen.alias("r")).select(*keys, "r.*").select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _pick(df, keys, order, True)


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _pick(df, keys, order, False)


def trim_lifespan(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first two rows and the last, all if there are three or fewer.

    The group limit of the ranking keeps two rows a key before the shuffle, the aggregate one.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = df.withColumn("__n", rank).where("__n <= 2").drop("__n")
    everything = F.struct(*df.columns)
    by = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    last = df.groupBy(*keys).agg(F.max_by(everything, by).alias("r"), F.count(F.lit(1)).alias("__n")).where("__n >= 3").select("r.*").select(*df.columns)
    return first.unionByName(last)


def new_only(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(existing.select(*keys).distinct(), keys, "left_anti")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 1337) -> DataFrame:
    """A uniform sample of n rows, the same each time."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key), *df.columns).limit(n)
