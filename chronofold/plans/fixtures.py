"""Evidence made from the driver's tables: a projection that Spark and SQL agree on, and the queries' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.evidence import established_table

YEARS = {"archive:a1": 2021}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").agg(F.count(F.lit(1))).scalar()
    page = F.col("event_id") % pages
    # Every event counts; those that would be of every 13th page are the page before's, so some pages have no evidence.
    return table(spark, sf_dir, "events").withColumn("page_id", page - F.when(page % 13 == 5, 1).otherwise(0)).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def observations(spark: SparkSession, sf_dir: str, unit: str = "second") -> DataFrame:
    page, k = F.col("page_id"), F.col("k")
    ev = _events(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    status = (
        F.when((page % 7).isin(0, 1), F.when(k < 90, "terminal_inaccessible").otherwise("access_restricted"))
        .when(page % 7 == 2, "access_restricted")
        .otherwise(F.when(k < 70, "S0_observed_alive").otherwise("terminal_inaccessible"))
    )
    digest = F.when(page % 5 == 0, "d0").when(k < 10, "").otherwise(F.concat(F.lit("d"), F.floor(F.col("value") / 100).cast("string")))
    return ev.select(
        F.concat(F.lit("u"), page.cast("string")).alias("url_id"),
        F.when(F.col("event_type") == "error", "live_web").otherwise("probe_b").alias("observer"),
        F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("observation_time"),
        status.alias("status"),
        digest.alias("content_digest"),
        F.floor(F.col("value") * 100).cast("bigint").alias("content_length"),
    )


def captures(spark: SparkSession, sf_dir: str, unit: str = "second") -> DataFrame:
    page, k = F.col("page_id"), F.col("k")
    ev = _events(spark, sf_dir).where(F.col("event_type").isin("click", "purchase")).withColumn("page_id", page - F.when(page % 4 == 1, 1).otherwise(0))
    digest = F.when(page % 5 == 0, "d0").when(k % 10 == 0, "").otherwise(F.concat(F.lit("d"), F.floor(F.col("value") / 60).cast("string")))
    return ev.select(
        F.concat(F.lit("u"), page.cast("string")).alias("url_id"),
        F.concat(F.lit("archive:a"), (k % 4).cast("string")).alias("archive"),
        (F.date_trunc(unit, "ts").cast("timestamp_ntz") - F.make_ym_interval(k % 6, F.lit(0))).alias("capture_time"),
        F.when(k < 25, "404").when(k < 30, "-").otherwise("200").alias("status"),
        digest.alias("digest"),
        F.floor(F.col("value") * 100).cast("bigint").alias("content_length"),
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("memento_url"),
        F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("record_id"),
        "event_id",
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url_id"), F.col("url").alias("original_url"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("domain"),
        F.concat(F.lit("."), F.regexp_extract("url", r"^https?://[^/]*\.([a-z]+)", 1)).alias("tld"), F.lit("deep").alias("url_type"), none.alias("entry_cohort"), none.alias("first_observed"),
    )


def established(spark: SparkSession) -> DataFrame:
    return established_table(spark, YEARS)


def sql(unit: str = "second") -> str:
    """The same projection as common table expressions: ev, obs, cap, urls, est."""
    return f"""
ev0 AS (SELECT *, event_id % (SELECT count(*) FROM pages) AS p, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
ev AS (SELECT *, p - CASE WHEN p % 13 = 5 THEN 1 ELSE 0 END AS page_id FROM ev0),
evc AS (SELECT * EXCLUDE (page_id), page_id - CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END AS page_id FROM ev),
obs AS (
  SELECT 'u' || page_id AS url_id, CASE WHEN event_type = 'error' THEN 'live_web' ELSE 'probe_b' END AS observer, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS observation_time,
    CASE WHEN page_id % 7 IN (0, 1) THEN CASE WHEN k < 90 THEN 'terminal_inaccessible' ELSE 'access_restricted' END
         WHEN page_id % 7 = 2 THEN 'access_restricted' WHEN k < 70 THEN 'S0_observed_alive' ELSE 'terminal_inaccessible' END AS status,
    CASE WHEN page_id % 5 = 0 THEN 'd0' WHEN k < 10 THEN '' ELSE 'd' || CAST(floor(value / 100) AS BIGINT) END AS content_digest,
    CAST(floor(value * 100) AS BIGINT) AS content_length
  FROM ev WHERE event_type IN ('error', 'signup')
),
cap AS (
  SELECT 'u' || page_id AS url_id, 'archive:a' || (k % 4) AS archive, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) - to_years(CAST(k % 6 AS INTEGER)) AS capture_time,
    CASE WHEN k < 25 THEN '404' WHEN k < 30 THEN '-' ELSE '200' END AS status,
    CASE WHEN page_id % 5 = 0 THEN 'd0' WHEN k % 10 = 0 THEN '' ELSE 'd' || CAST(floor(value / 60) AS BIGINT) END AS digest,
    CAST(floor(value * 100) AS BIGINT) AS content_length, 'm' || (k % 3) AS memento_url, 'r' || (event_id % 3) AS record_id, event_id
  FROM evc WHERE event_type IN ('click', 'purchase')
),
urls AS (
  SELECT 'u' || page_id AS url_id, url AS original_url, regexp_extract(url, '^https?://([^/]*)', 1) AS domain, '.' || regexp_extract(url, '^https?://[^/]*\\.([a-z]+)', 1) AS tld,
    'deep' AS url_type, CAST(NULL AS VARCHAR) AS entry_cohort, CAST(NULL AS VARCHAR) AS first_observed
  FROM pages
),
est(archive, established_year) AS (VALUES ('archive:a1', 2021)),
capx AS (SELECT c.*, e.established_year IS NULL OR year(c.capture_time) >= e.established_year AS indep FROM cap c LEFT JOIN est e USING (archive))"""
