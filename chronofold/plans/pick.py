"""Picking: from candidate rows, or a domain, to the table of URLs."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from datetime import datetime
from time import sleep

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import suffix, times
from chronofold.functions import urls as U
from chronofold.operators import dedupe, discovery
from chronofold.sources import candidates, clients, files
from chronofold.sources.registry import Archive
from chronofold.sources.store import Store
from chronofold.sources.transport import Transport

_log = logging.getLogger(__name__)


def shaped(rows: DataFrame, run_ts: datetime, scope: set[str] | None = None, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the urls table, rejected rows). Rejected are URLs that can't be read; the first of each id stays."""
    keyed = rows.withColumn("canonical_url", U.canonical(F.col("url")))
    valid = keyed.where(F.col("canonical_url").isNotNull())
    if scope is not None:
        valid = valid.where(U.scope_type(F.col("url_type"), F.col("canonical_url")).isin(*discovery.allowed_types(scope)))
    if sample is not None:
        valid = dedupe.sample_rows(valid, sample, "url")
    first = dedupe.first_wins(valid.withColumn("url_id", U.url_id(F.col("canonical_url"))), ["url_id"], [F.col("file_ord"), F.col("line_ord")])
    parts = suffix.with_suffix(first.withColumn("domain", U.domain(F.col("canonical_url"))), F.col("domain"))
    year = F.col("first_observed_year")
    table = parts.select("url_id", F.col("url").alias("original_url"), "canonical_url", "domain", "tld", "url_type", times.cohort(year).alias("entry_cohort"), times.first_observed(year, run_ts).alias("first_observed"))
    return table, keyed.where(F.col("canonical_url").isNull()).select("url")


def write_urls(store: Store, rows: DataFrame, run_ts: datetime, scope: set[str] | None = None) -> dict[str, int]:
    """Adds what is new; returns added, skipped and rejected."""
    total = rows.count()
    table, rejected = shaped(rows, run_ts, scope)
    before = store.read("urls").count()
    store.append("urls", dedupe.new_only(table, store.read("urls"), ["url_id"]))
    added, bad = store.read("urls").count() - before, rejected.count()
    return {"added": added, "skipped": total - added - bad, "rejected": bad}


def discover(spark: SparkSession, domain: str, archives: list[Archive], transport: Transport, scope: set[str], gaps: list[tuple[str, str]] | None = None, pause: Callable[[float], None] = sleep) -> DataFrame:
    """Candidate rows of a domain: each archive's listing is fetched once, by a task of its own, line by line.

    ``gaps`` gets (listing, why) of every listing that couldn't be asked, or broke off: what it
    would have added is missing.
    """
    bases = [(b,) for a in archives if a.usable_cdx for b in a.listing_bases()]
    if not bases:
        raise ValueError("no archive with an online index is known; import a registry first")
    name = domain.lower().replace("http://", "").replace("https://", "").strip("/")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(lines: list[str] = (), gap: tuple[str, str] | None = None) -> pd.DataFrame:
            return pd.DataFrame([(x, None, None) for x in lines] + ([(None, *gap)] if gap else []), columns=["line", "listing", "gap"])

        for batch in batches:
            for base in batch["base"]:
                covered = clients.domain_covered(transport, base, name, pause)
                if covered is None:
                    yield rows(gap=(base, "it didn't answer"))
                if not covered:
                    continue
                lines: list[str] = []
                gap = None
                try:
                    for line in clients.domain_lines(transport, base, name, pause=pause):
                        lines.append(line)
                        if len(lines) == 10_000:
                            yield rows(lines)
                            lines = []
                except clients.Incomplete:
                    gap = (base, "it broke off")
                yield rows(lines, gap)

    staged = files.scratch(spark, "listing")
    asked = spark.createDataFrame(bases, "base string").repartition(len(bases)).mapInPandas(fetch, "line string, listing string, gap string")
    asked.write.mode("overwrite").parquet(staged)
    listed = spark.read.parquet(staged)
    if gaps is not None:  # a row for each listing at most
        gaps += sorted((r.listing, r.gap) for r in listed.where("gap is not null").select("listing", "gap").collect())
    found = discovery.candidates(discovery.listed(listed.where("line is not null").select("line")), name, scope)
    return found.withColumn("file_ord", F.lit(0)).withColumn("line_ord", F.xxhash64("url"))


def incomplete(store: Store) -> DataFrame:
    """(domain, listing, gap) of what the picked URLs lack; empty if every listing was read to its end."""
    path = f"{store.out}/incomplete-listings"
    schema = "domain string, listing string, gap string"
    return store.spark.read.schema(schema).parquet(path) if files.exists(store.spark, path) else store.spark.createDataFrame([], schema)


def prepare(
    store: Store, inputs: list[str], run_ts: datetime, scope: set[str] | None = None, archives: list[Archive] | None = None, transport: Transport | None = None, default: str = "candidates",
    pause: Callable[[float], None] = sleep,
) -> dict[str, int]:
    """Fill the urls table once: a value that exists as a path is one, any other a domain."""
    if store.has_rows("urls"):
        return {"added": 0, "skipped": 0, "rejected": 0}
    spark = store.spark
    values = inputs or [default]
    paths = [v for v in values if files.exists(spark, v)]
    domains = [v for v in values if v not in paths]
    if not inputs and domains:
        raise ValueError(f"nothing to watch: give an input, or put lists into {default}")
    total = {"added": 0, "skipped": 0, "rejected": 0}
    tables = [candidates.read(spark, paths)] if paths else []
    for d in domains:
        gaps: list[tuple[str, str]] = []
        tables.append(discover(spark, d, archives or [], transport, scope or discovery.SCOPES["all"], gaps, pause))
        if gaps:
            for listing, gap in gaps:
                _log.warning("the listing of %s by %s is incomplete: %s", d, listing, gap)
            spark.createDataFrame([(d, *g) for g in gaps], "domain string, listing string, gap string").write.mode("append").parquet(f"{store.out}/incomplete-listings")
    for rows in tables:
        for k, n in write_urls(store, rows, run_ts, scope if paths else None).items():
            total[k] += n
    if domains and not store.has_rows("urls"):
        raise ValueError(f"nothing found for {', '.join(domains)}")
    return total
