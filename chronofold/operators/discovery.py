"""Discovery: from the lines of a domain listing to URLs to watch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions import urls as U


def listed(lines: DataFrame, col: str = "line") -> DataFrame:
    """Index lines to (ts, url, mime): fields 1 to 3; lines of fewer than three fields go."""
    f = F.split(F.trim(col), r"\s+")
    return lines.where(F.size(f) >= 3).select(F.get(f, F.lit(1)).alias("ts"), F.get(f, F.lit(2)).alias("url"), F.coalesce(F.get(f, F.lit(3)), F.lit("-")).alias("mime"))


def in_domain(rows: DataFrame, domain: str) -> DataFrame:
    """The rows of the domain and its subdomains, with ``host``."""
    return rows.withColumn("host", U.host(F.col("url"))).where(U.in_domain(F.col("host"), U.plain_domain(F.lit(domain))))


def earliest_hosts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(U.canonical_host(F.col("host")).alias("host")).agg(F.min("ts").alias("ts"))


def earliest_pages(rows: DataFrame) -> DataFrame:
    """URLs with a path that answered with a page."""
    return rows.where(U.has_path(F.col("url")) & U.is_page(F.col("mime"))).groupBy("url").agg(F.min("ts").alias("ts"))


def candidates(rows: DataFrame, domain: str, scope: set[str]) -> DataFrame:
    """(url, first_observed_year, url_type) for a scope of root, hosts, deep; hosts goes before root."""
    found = in_domain(rows, domain)
    hosts = earliest_hosts(found)
    spark, name = rows.sparkSession, U.plain_domain(F.lit(domain))
    out = spark.createDataFrame([], "url string, first_observed_year string, url_type string")
    year = F.substring("ts", 1, 4).alias("first_observed_year")
    if "hosts" in scope:
        out = hosts.select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), year, F.lit("root").alias("url_type"))
    elif "root" in scope:
        own = F.coalesce(F.min(F.when(F.col("host") == U.canonical_host(name), F.col("ts"))), F.min("ts"))
        out = hosts.agg(own.alias("ts")).where("ts is not null and ts <> ''").select(F.concat(F.lit("https://"), name, F.lit("/")).alias("url"), year, F.lit("root").alias("url_type"))
    if "deep" in scope:
        deep = earliest_pages(found).join(out.select("url"), "url", "left_anti")
        out = out.unionByName(deep.select("url", year, F.lit("deep").alias("url_type")))
    return out


SCOPES = {"root": {"root"}, "hosts": {"hosts"}, "deep": {"deep"}, "all": {"root", "hosts", "deep"}}


def parse_scope(text: str) -> set[str]:
    names = {t.strip().lower() for t in text.split(",") if t.strip()}
    if unknown := names - set(SCOPES):
        raise ValueError(f"scope: {', '.join(sorted(unknown))} is none of {', '.join(SCOPES)}")
    return set().union(*(SCOPES[n] for n in names))


def allowed_types(scope: set[str]) -> set[str]:
    return ({"root"} if scope & {"root", "hosts"} else set()) | (scope & {"deep"})
