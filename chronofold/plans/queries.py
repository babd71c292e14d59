"""The catalogue: a query for each family of operators, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import schemas as S
from chronofold.functions import statuses, suffix, times
from chronofold.functions import urls as U
from chronofold.operators import checkpoints as C
from chronofold.operators import dedupe, discovery, parsers
from chronofold.operators import evidence as E
from chronofold.operators import lifecycle as L
from chronofold.plans import classify as classification
from chronofold.plans import collect as collection
from chronofold.plans import fixtures as X
from chronofold.plans import summary as Y
from chronofold.sources import files, raw
from chronofold.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- URLs -------------------------------------------------------------------

_KEYS = ", ".join(f"'{k}'" for k in U.TRACKING)
#: The pages' URLs have a scheme, a host, a path and simple queries, which is what this SQL covers.
_URL = rf"""
parts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS netloc,
    CASE WHEN rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') END AS path,
    list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '') AS qs
  FROM pages
),
canon AS (
  SELECT *, CASE WHEN scheme = 'http' THEN regexp_replace(netloc, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(netloc, ':443$', '') ELSE netloc END AS domain,
    array_to_string(list_sort(list_filter(qs, lambda p: NOT list_contains([{_KEYS}], string_split(p, '=')[1]))), '&') AS q, array_to_string(list_sort(qs), '&') AS q_all
  FROM parts
),
c AS (SELECT *, scheme || '://' || domain || path || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url FROM canon)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "pages").select("page_id", "url").withColumn("canonical_url", U.canonical(F.col("url")))


@query(f"WITH {_URL} SELECT page_id, canonical_url FROM c")
def q_url_canonical(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "canonical_url")


@query(f"WITH {_URL} SELECT page_id, substr(sha256(canonical_url), 1, 24) AS url_id FROM c")
def q_url_id(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.url_id(F.col("canonical_url")).alias("url_id"))


@query(f"WITH {_URL} SELECT page_id, domain, '.' || regexp_extract(domain, '([a-z]+)$', 1) AS tld FROM c")
def q_url_parts_tld(spark, sf_dir):
    df = _pages(spark, sf_dir).select("page_id", U.domain(F.col("canonical_url")).alias("domain"))
    return suffix.with_suffix(df, F.col("domain"))


@query(rf"WITH {_URL} SELECT page_id, regexp_replace(regexp_replace(netloc, ':\d*$', ''), '^www\d*\.', '') AS host_key FROM c")
def q_host_key(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.host_key(F.col("url")).alias("host_key"))


@query(rf"WITH {_URL} SELECT page_id, lower(regexp_replace(regexp_replace(netloc, ':(80|443)$', ''), '^www\d*\.', '') || path || CASE WHEN q_all = '' THEN '' ELSE '?' || q_all END) AS match_key FROM c")
def q_match_key(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.match_key(F.col("url")).alias("match_key"))


_TYPE = "CASE WHEN page_id % 5 = 0 THEN 'root' WHEN page_id % 5 = 1 THEN 'deep' ELSE 'unknown' END"
_SCOPE = f"CASE WHEN {_TYPE} <> 'unknown' THEN {_TYPE} WHEN path = '/' THEN 'root' ELSE 'deep' END"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("page_id") % 5 == 0, "root").when(F.col("page_id") % 5 == 1, "deep").otherwise("unknown")
    return _pages(spark, sf_dir).select("page_id", U.scope_type(given, F.col("canonical_url")).alias("scope_type"))


@query(f"WITH {_URL} SELECT page_id, {_SCOPE} AS scope_type FROM c")
def q_scope_type(spark, sf_dir):
    return _typed(spark, sf_dir)


@query(f"WITH {_URL} SELECT page_id FROM c WHERE {_SCOPE} IN ('root')")
def q_scope_filter(spark, sf_dir):
    allowed = discovery.allowed_types(discovery.parse_scope("hosts"))
    return _typed(spark, sf_dir).where(F.col("scope_type").isin(*allowed)).select("page_id")


@query(f"""WITH {_URL}, twice AS (SELECT 0 AS file_ord, page_id, canonical_url FROM c UNION ALL SELECT 1, page_id + 100000, canonical_url FROM c WHERE page_id % 2 = 0),
ids AS (SELECT *, substr(sha256(canonical_url), 1, 24) AS url_id FROM twice), existing AS (SELECT substr(sha256(canonical_url), 1, 24) AS url_id FROM c WHERE page_id % 10 = 3)
SELECT url_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY file_ord, page_id) AS n FROM ids) WHERE n = 1 AND url_id NOT IN (SELECT url_id FROM existing)""")
def q_url_dedupe_first(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("file_ord", F.lit(0))
    again = pages.where("page_id % 2 = 0").withColumn("file_ord", F.lit(1)).withColumn("page_id", F.col("page_id") + 100000)
    rows = pages.unionByName(again).withColumn("url_id", U.url_id(F.col("canonical_url")))
    existing = pages.where("page_id % 10 = 3").select(U.url_id(F.col("canonical_url")).alias("url_id"))
    first = dedupe.first_wins(rows, ["url_id"], [F.col("file_ord"), F.col("page_id")])
    return dedupe.new_only(first, existing, ["url_id"]).select("url_id", "page_id")


@query("""SELECT o_orderkey, (year(o_orderdate) // 5 * 5) || '-' || (year(o_orderdate) // 5 * 5 + 4) AS entry_cohort, year(o_orderdate) || '-01-01T00:00:00+00:00' AS first_observed FROM orders""")
def q_entry_cohort(spark, sf_dir):
    year = F.date_format("o_orderdate", "yyyy")
    stamp = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return X.table(spark, sf_dir, "orders").select("o_orderkey", times.cohort(year).alias("entry_cohort"), times.first_observed(year, stamp).alias("first_observed"))


@query(f"WITH {_URL} SELECT page_id, ('0x' || substr(sha256(canonical_url), 1, 8))::BIGINT % 7 AS shard FROM c")
def q_shard_assign(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.shard(U.url_id(F.col("canonical_url")), 7).alias("shard"))


_HOSTS = rf"WITH {_URL}, h AS (SELECT regexp_replace(regexp_replace(netloc, ':\d*$', ''), '^www\d*\.', '') AS host_key, count(*) AS n FROM c GROUP BY 1)"


def _host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "pages").groupBy(U.host_key(F.col("url")).alias("host_key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_HOSTS} SELECT host_key, n FROM h")
def q_host_counts(spark, sf_dir):
    return _host_counts(spark, sf_dir)


@query(f"{_HOSTS} SELECT host_key, n FROM h WHERE n >= 3 AND host_key <> ''")
def q_batchable_hosts(spark, sf_dir):
    return _host_counts(spark, sf_dir).where("n >= 3 and host_key <> ''")


# --- discovery --------------------------------------------------------------

_LISTED = rf"""WITH {_URL}, l AS (
  SELECT url, CAST(20100101000000 + page_id * 1000 AS VARCHAR) AS ts, CASE WHEN page_id % 7 = 0 THEN 'image/png' WHEN page_id % 7 = 1 THEN 'Text/HTML; charset=x' ELSE 'text/html' END AS mime,
    netloc AS host, path FROM c
), d AS (SELECT * FROM l WHERE host = 'example.com' OR host LIKE '%.example.com'),
hosts AS (SELECT regexp_replace(host, '^www\d*\.', '') AS host, min(ts) AS ts FROM d GROUP BY 1),
deep AS (SELECT url, min(ts) AS ts FROM d WHERE trim(path, '/') <> '' AND lower(trim(string_split(mime, ';')[1])) IN ('text/html', 'application/xhtml+xml') GROUP BY url)"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    mime = F.when(page % 7 == 0, "image/png").when(page % 7 == 1, "Text/HTML;charset=x").otherwise("text/html")
    line = F.concat_ws(" ", F.lit("key"), (F.lit(20100101000000) + page * 1000).cast("string"), "url", mime)
    return discovery.listed(X.table(spark, sf_dir, "pages").select(line.alias("line")))


@query(f"{_LISTED} SELECT 'https://' || host || '/' AS url, substr(ts, 1, 4) AS first_observed_year, 'root' AS url_type FROM hosts")
def q_discover_hosts(spark, sf_dir):
    return discovery.candidates(_listing(spark, sf_dir), "https://Example.com/", {"hosts"})


@query(f"{_LISTED} SELECT url, substr(ts, 1, 4) AS first_observed_year, 'deep' AS url_type FROM deep")
def q_discover_deep(spark, sf_dir):
    return discovery.candidates(_listing(spark, sf_dir), "example.com", {"deep"})


@query(f"""{_LISTED} SELECT 'https://example.com/' AS url, substr(coalesce(min(ts) FILTER (host = 'example.com'), min(ts)), 1, 4) AS first_observed_year, 'root' AS url_type FROM hosts
UNION ALL SELECT url, substr(ts, 1, 4), 'deep' FROM deep WHERE url <> 'https://example.com/'""")
def q_discover_root(spark, sf_dir):
    return discovery.candidates(_listing(spark, sf_dir), "example.com", {"root", "deep"})


# --- statuses ---------------------------------------------------------------

_CODES = (200, 204, 301, 400, 401, 403, 404, 410, 429, 451, 500, 501, 502, 503, 504, 505, 523, 599)
_CODE = f"list_extract([{', '.join(map(str, _CODES))}], CAST(json_extract(props, '$.k') AS INTEGER) % {len(_CODES)} + 1)"


@query(f"""SELECT event_id, {_CODE} AS code, CASE WHEN {_CODE} BETWEEN 200 AND 299 THEN 'S0_observed_alive' WHEN {_CODE} IN (403, 429) THEN 'access_restricted'
WHEN {_CODE} IN (204,400,404,410,500,501,502,503,523) THEN 'terminal_inaccessible' WHEN {_CODE} BETWEEN 500 AND 504 THEN 'server_error' ELSE 'other_response' END AS status FROM events""")
def q_http_status_class(spark, sf_dir):
    code = F.get(F.array(*map(F.lit, _CODES)), F.get_json_object("props", "$.k").cast("int") % len(_CODES))
    return X.table(spark, sf_dir, "events").select("event_id", code.alias("code"), statuses.live_status(code).alias("status"))


@query(f"WITH {X.sql()} SELECT event_id, coalesce(try_cast(status AS INTEGER) IN (204,400,404,410,500,501,502,503,523), false) AS terminal FROM cap")
def q_terminal_capture(spark, sf_dir):
    return X.captures(spark, sf_dir).select("event_id", statuses.is_terminal_capture(F.col("status")).alias("terminal"))


@query("""SELECT event_id, err, attempts, attempts < CASE err WHEN 'timeout' THEN 4 WHEN 'connection_error' THEN 4 WHEN 'rate_limited' THEN 5 WHEN 'server_error' THEN 5 WHEN 'dns_failure' THEN 3
WHEN 'client_error' THEN 1 WHEN 'not_found' THEN 1 WHEN 'malformed_response' THEN 1 ELSE 2 END AS retry,
CASE err WHEN 'timeout' THEN least(30, 2 * pow(2, attempts - 1)) WHEN 'connection_error' THEN least(30, 2 * pow(2, attempts - 1)) WHEN 'rate_limited' THEN least(300, 10 * pow(2, attempts - 1))
WHEN 'server_error' THEN least(120, 5 * pow(2, attempts - 1)) WHEN 'dns_failure' THEN least(600, 30 * pow(2, attempts - 1)) WHEN 'client_error' THEN 0 WHEN 'not_found' THEN 0
WHEN 'malformed_response' THEN 0 ELSE least(60, 5 * pow(2, attempts - 1)) END::DOUBLE AS longest FROM (SELECT event_id, CAST(event_id % 6 + 1 AS INTEGER) AS attempts,
list_extract(['timeout', 'rate_limited', 'server_error', 'connection_error', 'dns_failure', 'malformed_response', 'client_error', 'not_found', 'other'], CAST(event_id % 9 + 1 AS BIGINT)) AS err FROM events)""")
def q_retry_decision(spark, sf_dir):
    names = F.array(*map(F.lit, (*S.ERROR_CLASSES, "other")))
    df = X.table(spark, sf_dir, "events").select("event_id", F.get(names, (F.col("event_id") % 9).cast("int")).alias("err"), (F.col("event_id") % 6 + 1).cast("int").alias("attempts"))
    return df.withColumn("retry", statuses.should_retry(F.col("err"), F.col("attempts"))).withColumn("longest", statuses.longest_delay(F.col("err"), F.col("attempts")))


@query("""SELECT name, CAST(greatest(2, least(128, ceil(rps * 4 * greatest(1.0, timeout * 0.5)))) AS INTEGER) AS slots FROM (VALUES ('live_web', 100.0::DOUBLE, 10.0::DOUBLE), ('archive:a', 10.0, 20.0), ('archive:b', 0.5, 20.0),
('archive:c', 0.1, 1.0), ('archive:d', 1.0, 3.0)) t(name, rps, timeout)""")
def q_witness_caps(spark, sf_dir):
    rows = [("live_web", 100.0, 10.0), ("archive:a", 10.0, 20.0), ("archive:b", 0.5, 20.0), ("archive:c", 0.1, 1.0), ("archive:d", 1.0, 3.0)]
    return spark.createDataFrame(rows, "name string, rps double, timeout double").select("name", statuses.witness_slots(F.col("rps"), F.col("timeout")).alias("slots"))


@query("SELECT page_id, 'http://x/' || 'web' || '/cdx?url=' || url_encode(url) AS address FROM pages")
def q_fill_template(spark, sf_dir):
    address = U.fill(F.lit("http://x/{collection}/cdx?url={url}"), F.col("url"), F.lit("web"))
    return X.table(spark, sf_dir, "pages").select("page_id", address.alias("address"))


@query(f"SELECT event_id, {_CODE} AS code, CASE WHEN {_CODE} = 404 THEN NULL WHEN {_CODE} = 429 THEN 'rate_limited' WHEN {_CODE} BETWEEN 500 AND 504 THEN 'server_error' WHEN {_CODE} >= 400 THEN 'client_error' END AS error_class FROM events")
def q_archive_error_class(spark, sf_dir):
    code = F.get(F.array(*map(F.lit, _CODES)), F.get_json_object("props", "$.k").cast("int") % len(_CODES))
    return X.table(spark, sf_dir, "events").select("event_id", code.alias("code"), statuses.archive_error(code).alias("error_class"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND err IN ('dns_failure', 'connection_error', 'timeout') THEN 'terminal_inaccessible' ELSE 'unresolved' END AS status
FROM (SELECT event_id, list_extract(['timeout', 'rate_limited', 'server_error', 'connection_error', 'dns_failure', 'malformed_response', 'client_error', 'not_found'], CAST(event_id % 8 + 1 AS BIGINT)) AS err FROM events)""")
def q_failure_status(spark, sf_dir):
    error = F.get(F.array(*map(F.lit, S.ERROR_CLASSES)), (F.col("event_id") % 8).cast("int"))
    witness = F.when(F.col("event_id") % 2 == 0, S.LIVE).otherwise("archive:x")
    return X.table(spark, sf_dir, "events").select("event_id", statuses.failure_status(witness, error).alias("status"))


@query(f"""SELECT CAST(event_id AS VARCHAR) AS url_id, 'live_web' AS observer, CASE WHEN {_CODE} BETWEEN 200 AND 299 THEN 'S0_observed_alive' WHEN {_CODE} IN (403, 429) THEN 'access_restricted'
WHEN {_CODE} IN (204,400,404,410,500,501,502,503,523) THEN 'terminal_inaccessible' WHEN {_CODE} BETWEEN 500 AND 504 THEN 'server_error' ELSE 'other_response' END AS status, {_CODE} AS http_status,
CASE WHEN {_CODE} IN (403, 429) THEN 'client_error' WHEN {_CODE} = 504 THEN 'server_error' ELSE '' END AS error_class, 'sha256:' || sha256(props) AS content_digest, 'sha256:' || sha256(props) AS response_digest,
CAST(length(props) AS BIGINT) AS content_length, 1.0::DOUBLE AS confidence FROM events""")
def q_live_observations(spark, sf_dir):
    code = F.get(F.array(*map(F.lit, _CODES)), F.get_json_object("props", "$.k").cast("int") % len(_CODES))
    answers = X.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("url_id"), F.lit(S.LIVE).alias("witness"), code.alias("http_status"), F.lit("").alias("redirect_target"), F.lit("text/html").alias("mime_type"),
        F.length("props").cast("bigint").alias("content_length"), _digest(F.col("props")).alias("content_digest"), F.current_timestamp().alias("query_time"), F.current_timestamp().alias("done_time"),
    )
    return collection.live_observations(answers).select("url_id", "observer", "status", "http_status", "error_class", "content_digest", "response_digest", "content_length", "confidence")


@query("SELECT url_id, original_url, CAST(('0x' || substr(url_id, 1, 8))::BIGINT % 3 AS INTEGER) AS shard FROM (SELECT substr(sha256(url), 1, 24) AS url_id, min(url) AS original_url FROM pages GROUP BY 1)")
def q_load_urls_shard(spark, sf_dir):
    store = Store(spark, files.scratch(spark, "urls"))
    rows = X.table(spark, sf_dir, "pages").select(U.url_id(F.col("url")).alias("url_id"), F.col("url").alias("original_url"))
    store.append("urls", dedupe.first_wins(rows, ["url_id"], [F.col("original_url")]))
    shards = [store.load_urls(shard=i, shards=3)[0].withColumn("shard", F.lit(i)) for i in range(3)]
    return shards[0].unionByName(shards[1]).unionByName(shards[2])


_MATCH = r"lower(regexp_replace(regexp_replace(netloc, ':(80|443)$', ''), '^www\d*\.', '') || path || CASE WHEN q_all = '' THEN '' ELSE '?' || q_all END)"


@query(rf"""WITH {_URL}, k AS (SELECT page_id, url, {_MATCH} AS m FROM c),
caps AS (SELECT DISTINCT i, m, lower(regexp_replace(url, '^https?://(www\.)?', 'http://www.')) AS memento FROM k, range(3) r(i) WHERE page_id % 3 <> 0)
SELECT page_id, make_timestamp(2000 + i, 1, 1, 0, 0, 0) AS capture_time FROM k LEFT JOIN caps USING (m)""")
def q_host_listing_join(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url_id"), F.col("url").alias("original_url"), U.host_key(F.col("url")).alias("host"), F.lit("archive:x").alias("witness"))
    # The listing has the other scheme and a www label; the match key has neither.
    other = F.regexp_replace("original_url", "^https?://(www\\.)?", "HTTP://www.")
    row = F.struct(
        F.make_timestamp(F.col("y") + 2000, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("capture_time"), F.lower(other).alias("memento_url"), F.lit("m").alias("mime_type"), F.lit("200").alias("status"),
        F.lit("d").alias("digest"), F.lit("").alias("warc_file"), F.lit("r").alias("record_id"), F.lit("success").alias("query_status"), F.lit(1).cast("bigint").alias("content_length"),
    )
    years = pages.where(F.col("url_id").cast("bigint") % 3 != 0).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(2))))
    listings = pages.select("witness", "host").distinct().join(years.groupBy("witness", "host").agg(F.collect_list(row).alias("captures")), ["witness", "host"], "left")
    joined = collection.from_hosts(pages, listings, datetime(2024, 1, 1, tzinfo=timezone.utc), "full")
    return joined.select(F.col("url_id").cast("bigint").alias("page_id"), F.col("capture_time").cast("timestamp_ntz").alias("capture_time"))


# --- evidence ---------------------------------------------------------------


def _latest_sql(table: str, witness: str, time: str, digest: str, unit: str) -> str:
    rank = f"row_number() OVER (PARTITION BY url_id, {witness} ORDER BY {time} DESC NULLS LAST, status NULLS LAST, {digest} NULLS LAST)"
    return f"WITH {X.sql(unit)} SELECT url_id, {witness}, {time}, status, {digest} FROM (SELECT *, {rank} AS n FROM {table}) WHERE n = 1"


@query(_latest_sql("obs", "observer", "observation_time", "content_digest", "second"))
def q_latest_observer(spark, sf_dir):
    df = X.observations(spark, sf_dir).select("url_id", "observer", "observation_time", "status", "content_digest")
    return E.latest(df, ["url_id", "observer"], "observation_time", digest="content_digest")


@query(_latest_sql("cap", "archive", "capture_time", "digest", "second"))
def q_latest_archive(spark, sf_dir):
    return E.latest(X.captures(spark, sf_dir).select("url_id", "archive", "capture_time", "status", "digest"), ["url_id", "archive"], "capture_time")


@query(_latest_sql("obs", "observer", "observation_time", "content_digest", "day"))
def q_latest_ties(spark, sf_dir):
    df = X.observations(spark, sf_dir, "day").select("url_id", "observer", "observation_time", "status", "content_digest")
    return E.latest(df, ["url_id", "observer"], "observation_time", digest="content_digest")


@query(f"WITH {X.sql()} SELECT event_id, url_id, archive, capture_time FROM capx WHERE indep")
def q_independent_captures(spark, sf_dir):
    flagged = E.flag_independent(X.captures(spark, sf_dir), X.established(spark), null_time=True)
    return flagged.where("is_independent").select("event_id", "url_id", "archive", "capture_time")


def fold_sql(threshold: int = 2, with_changes: bool = True) -> str:
    """The whole fold in SQL: w by witness, tr transitions, wt by witness with changes, u by URL with state and risks."""
    changes = "true" if with_changes else "false"
    return f"""WITH {X.sql()},
e AS (
  SELECT url_id, 'o' AS kind, observer AS witness, observation_time AS t, status, content_length AS len, true AS indep, CASE WHEN observer = 'live_web' THEN nullif(content_digest, '') END AS dg FROM obs
  UNION ALL SELECT url_id, 'c', archive, capture_time, status, content_length, indep, nullif(digest, '') FROM capx
),
lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_id, kind, witness ORDER BY t DESC NULLS LAST, status) AS n FROM e WHERE indep) WHERE n = 1),
dead AS (SELECT DISTINCT url_id, witness FROM lo WHERE (kind = 'o' AND status = 'terminal_inaccessible') OR (kind = 'c' AND try_cast(status AS INTEGER) IN (204,400,404,410,500,501,502,503,523))),
series AS (
  SELECT url_id, kind, witness, count(*) AS n_dg, min(dg) <> max(dg) AS differs, count(*) FILTER (len > 0) AS n_len,
    arg_min(len, (t, len)) FILTER (len > 0) AS a, arg_max(len, (t, len)) FILTER (len > 0) AS b FROM e WHERE dg IS NOT NULL GROUP BY ALL
),
paths AS (SELECT *, CASE WHEN differs AND n_len >= 2 THEN CASE WHEN least(a, b)::DOUBLE / greatest(a, b) < 0.5 THEN 'replaced' ELSE 'edited' END END AS path FROM series),
tr AS (
  SELECT * FROM (SELECT url_id, kind, witness, t, dg, lag(t) OVER s AS t0, lag(dg) OVER s AS d0 FROM e WHERE dg IS NOT NULL WINDOW s AS (PARTITION BY url_id, kind, witness ORDER BY t, dg)) WHERE dg <> d0
),
base AS (
  SELECT url_id, count(*)::INTEGER AS evidence_count, count(DISTINCT witness)::INTEGER AS witness_count, bool_or(kind = 'c') AS preserved, min(t) AS event_start, max(t) AS event_end FROM e GROUP BY url_id
),
u0 AS (
  SELECT base.*, coalesce(al.alive, false) AS alive, coalesce(d.n, 0)::INTEGER AS n_inaccessible,
    CASE WHEN NOT {changes} THEN 'unknown' WHEN p.changed THEN 'changed' WHEN p.compared THEN 'stable' ELSE 'unknown' END AS survival, CASE WHEN {changes} THEN p.trajectory END AS trajectory
  FROM base LEFT JOIN (SELECT url_id, bool_or(status = 'S0_observed_alive') AS alive FROM lo WHERE kind = 'o' GROUP BY 1) al USING (url_id)
  LEFT JOIN (SELECT url_id, count(*) AS n FROM dead GROUP BY 1) d USING (url_id)
  LEFT JOIN (SELECT url_id, bool_or(n_dg >= 2 AND differs) AS changed, bool_or(n_dg >= 2) AS compared, arg_min(path, (kind = 'c', witness)) FILTER (path IS NOT NULL) AS trajectory FROM paths GROUP BY 1) p USING (url_id)
),
u1 AS (
  SELECT *, CASE WHEN alive AND survival = 'changed' AND trajectory = 'edited' THEN 'S1' WHEN alive AND survival = 'changed' AND trajectory = 'replaced' THEN 'S2' WHEN alive THEN 'S0'
    WHEN n_inaccessible >= {threshold} THEN 'S3' ELSE 'S4' END AS state FROM u0
),
u AS (SELECT *, state <> 'S4' AND NOT preserved AS capture_gap, state = 'S3' AND NOT preserved AS preservation_gap, alive AND n_inaccessible > 0 AS witness_disagreement, state = 'S4' AS evidential_uncertainty FROM u1),
evs AS (
  SELECT url_id, 'state_' || state AS event_type, event_start, event_end, CASE WHEN state = 'S4' THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, evidence_count, witness_count, CAST(NULL AS VARCHAR) AS archive FROM u
  UNION ALL SELECT url_id, 'risk_capture_gap', event_start, event_end, 1.0, evidence_count, witness_count, NULL FROM u WHERE capture_gap
  UNION ALL SELECT url_id, 'risk_preservation_gap', event_start, event_end, 1.0, evidence_count, witness_count, NULL FROM u WHERE preservation_gap
  UNION ALL SELECT url_id, 'risk_witness_disagreement', event_start, event_end, 1.0, evidence_count, witness_count, NULL FROM u WHERE witness_disagreement
  UNION ALL SELECT url_id, 'risk_evidential_uncertainty', event_start, event_end, 1.0, evidence_count, witness_count, NULL FROM u WHERE evidential_uncertainty
  UNION ALL SELECT url_id, 'content_stable', event_start, event_end, 1.0, evidence_count, witness_count, NULL FROM u WHERE survival = 'stable'
  UNION ALL SELECT url_id, 'content_changed', min(t0), max(t), 1.0, count(*)::INTEGER, 1, witness FROM tr WHERE {changes} GROUP BY url_id, kind, witness
)
"""


def _witnesses(spark: SparkSession, sf_dir: str, with_changes: bool = True) -> DataFrame:
    return E.per_witness(E.evidence(X.observations(spark, sf_dir), X.captures(spark, sf_dir), X.established(spark)), with_changes)


@query(fold_sql() + "SELECT url_id, witness FROM dead")
def q_inaccessible_witnesses(spark, sf_dir):
    return E.inaccessible(_witnesses(spark, sf_dir)).select("url_id", "witness").distinct()


@query(fold_sql() + "SELECT url_id, survival FROM u")
def q_content_survival(spark, sf_dir):
    return L.per_url(_witnesses(spark, sf_dir)).select("url_id", "survival")


@query(fold_sql() + "SELECT url_id, trajectory FROM u")
def q_trajectory(spark, sf_dir):
    return L.per_url(_witnesses(spark, sf_dir)).select("url_id", "trajectory")


@query(fold_sql() + "SELECT url_id, witness, t0 AS last_old_time, t AS first_new_time FROM tr")
def q_digest_transitions(spark, sf_dir):
    ev = E.evidence(X.observations(spark, sf_dir), X.captures(spark, sf_dir), X.established(spark))
    return E.with_transitions(ev).where("tr").select("url_id", "witness", F.col("t0").alias("last_old_time"), F.col("t").alias("first_new_time"))


@query(fold_sql() + "SELECT url_id, CASE WHEN alive THEN 'alive' WHEN n_inaccessible >= 2 THEN 'gone' ELSE 'unresolved' END AS verdict FROM u")
def q_state_basic(spark, sf_dir):
    urls = L.per_url(_witnesses(spark, sf_dir, False), with_changes=False)
    return urls.select("url_id", F.when(F.col("alive"), "alive").when(F.col("n_inaccessible") >= 2, "gone").otherwise("unresolved").alias("verdict"))


_STATE = "SELECT url_id, state, preserved, witness_count, n_inaccessible, evidence_count, survival FROM u"


def _state(urls: DataFrame) -> DataFrame:
    return urls.select("url_id", "state", "preserved", "witness_count", "n_inaccessible", "evidence_count", "survival")


@query(fold_sql() + _STATE)
def q_resource_state(spark, sf_dir):
    return _state(L.per_url(_witnesses(spark, sf_dir)))


@query(fold_sql(1) + _STATE)
def q_resource_state_thr1(spark, sf_dir):
    return _state(L.per_url(_witnesses(spark, sf_dir), threshold=1))


@query(fold_sql(with_changes=False) + _STATE)
def q_state_lifespan(spark, sf_dir):
    return _state(L.per_url(_witnesses(spark, sf_dir, False), with_changes=False))


@query(fold_sql() + "SELECT url_id, capture_gap, preservation_gap, witness_disagreement, evidential_uncertainty FROM u")
def q_risks(spark, sf_dir):
    return L.with_risks(L.per_url(_witnesses(spark, sf_dir))).select("url_id", *L.RISKS)


@query(fold_sql() + "SELECT * FROM evs")
def q_events(spark, sf_dir):
    return L.events(_witnesses(spark, sf_dir))


@query(fold_sql(with_changes=False) + "SELECT * FROM evs")
def q_events_lifespan(spark, sf_dir):
    return L.events(_witnesses(spark, sf_dir, False), with_changes=False)


#: Pairs of time and archive order by both, which is how the engine settles ties.
_CAP = """caps AS (
  SELECT url_id, count(*) AS n_captures, list_sort(list_distinct(list(archive))) AS names, min({'t': capture_time, 'a': archive}) AS lo, max({'t': capture_time, 'a': archive}) AS hi,
    list_sort(list_distinct(list(archive) FILTER (indep))) AS own_names, min({'t': capture_time, 'a': archive}) FILTER (indep) AS own FROM capx GROUP BY url_id
),
cap_agg AS (
  SELECT url_id, lo.t AS first_appearance, hi.t AS last_appearance, lo.a AS first_archive, hi.a AS last_archive, array_to_string(names, ',') AS archives, len(names) AS n_archives, n_captures,
    own.t AS first_independent_appearance, own.a AS first_independent_archive, array_to_string(own_names, ',') AS independent_archives, coalesce(len(own_names), 0) AS n_independent_archives FROM caps
)"""
_OBS = "obs_agg AS (SELECT url_id, count(*) AS n_observations, len(list_distinct(list(observer))) AS n_observers FROM obs GROUP BY url_id)"
_FLAGS = ", ".join(f"list_contains(kinds, '{k}') AS {k.removeprefix('risk_')}" for k in (*(f"risk_{r}" for r in L.RISKS), "content_changed", "content_stable"))
_EV = f"""changes AS (
  SELECT url_id, CAST(sum(evidence_count) AS BIGINT) AS n, min({{'t': event_start, 'a': archive}}) AS lo, max({{'t': event_end, 'a': archive}}) AS hi FROM evs WHERE archive IS NOT NULL GROUP BY url_id
),
ev_agg AS (
  SELECT k.url_id, list_filter(kinds, lambda x: x[1:6] = 'state_')[1] AS current_state, {_FLAGS}, n AS n_content_changes,
    lo.t AS first_content_change_at, lo.a AS first_content_change_archive, hi.t AS last_content_change_at, hi.a AS last_content_change_archive
  FROM (SELECT url_id, list(event_type) AS kinds FROM evs GROUP BY url_id) k LEFT JOIN changes USING (url_id)
)"""


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in ("archives", "independent_archives")})


@query(f"WITH {X.sql()}, {_CAP} SELECT * FROM cap_agg")
def q_capture_agg(spark, sf_dir):
    return _joined(Y.capture_aggregates(X.captures(spark, sf_dir), X.established(spark)))


@query(f"WITH {X.sql()}, {_OBS} SELECT * FROM obs_agg")
def q_obs_agg(spark, sf_dir):
    return Y.observation_aggregates(X.observations(spark, sf_dir))


@query(fold_sql() + f", {_EV} SELECT * FROM ev_agg")
def q_event_agg(spark, sf_dir):
    return Y.event_aggregates(L.events(_witnesses(spark, sf_dir)))


def _own(c: str) -> str:
    return {
        "temporal_span_days": "date_diff('day', first_appearance, last_appearance) AS temporal_span_days",
        "current_state": "current_state[7:] AS current_state",
        "content_survival": "CASE WHEN content_changed THEN 'changed' WHEN content_stable THEN 'stable' ELSE 'unknown' END AS content_survival",
        **{n: f"coalesce({n}, 0) AS {n}" for n in ("n_observations", "n_observers", "n_content_changes")},
        **{n: f"coalesce({n}, false) AS {n}" for n in L.RISKS},
    }.get(c, c)


@query(fold_sql() + f", {_CAP}, {_OBS}, {_EV} SELECT {', '.join(map(_own, Y.COLUMNS))} FROM urls LEFT JOIN cap_agg USING (url_id) LEFT JOIN obs_agg USING (url_id) LEFT JOIN ev_agg USING (url_id)")
def q_summary(spark, sf_dir):
    obs, cap, est = X.observations(spark, sf_dir), X.captures(spark, sf_dir), X.established(spark)
    events = L.events(E.per_witness(E.evidence(obs, cap, est)))
    return _joined(Y.summary(X.urls(spark, sf_dir), cap, obs, events, est))


_DOCS = """WITH d AS (SELECT source, text, CAST(TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 1000 AS INTEGER)) AS TIMESTAMP) AS t, doc_id, CAST(length(text) AS BIGINT) AS len FROM documents)
SELECT 'l' || (doc_id % 97) AS url_id, count(*) AS n_captures, count(DISTINCT source) AS n_archives, min(t) AS first_appearance, max(t) AS last_appearance,
arg_min(source, (t, source)) AS first_archive, count(DISTINCT 'sha256:' || sha256(text)) AS n_digests FROM d GROUP BY 1"""


@query(_DOCS)
def q_document_history(spark, sf_dir):
    t = (F.lit(datetime(2020, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 1000).cast("int"))).cast("timestamp_ntz")
    rows = X.table(spark, sf_dir, "documents").select(F.concat(F.lit("l"), (F.col("doc_id") % 97).cast("string")).alias("url_id"), F.col("source").alias("archive"), t.alias("t"), _digest(F.col("text")).alias("digest"))
    first = F.min_by("archive", F.struct("t", "archive"))
    return rows.groupBy("url_id").agg(
        F.count(F.lit(1)).alias("n_captures"), F.count_distinct("archive").alias("n_archives"), F.min("t").alias("first_appearance"), F.max("t").alias("last_appearance"),
        first.alias("first_archive"), F.count_distinct("digest").alias("n_digests"),
    )


def _digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_digest FROM documents")
def q_content_digest(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", _digest(F.col("text")).alias("content_digest"))


# --- captures: trim and dedupe ---------------------------------------------

_NTH = "row_number() OVER (PARTITION BY url_id, archive ORDER BY capture_time, event_id)"


@query(f"WITH {X.sql()} SELECT url_id, archive, capture_time, event_id FROM (SELECT *, {_NTH} AS n, count(*) OVER (PARTITION BY url_id, archive) AS m FROM cap) WHERE n <= 2 OR n = m")
def q_lifespan_trim(spark, sf_dir):
    df = X.captures(spark, sf_dir).select("url_id", "archive", "capture_time", "event_id")
    return dedupe.trim_lifespan(df, ["url_id", "archive"], [F.col("capture_time"), F.col("event_id")])


_SAME = "PARTITION BY url_id, archive, capture_time, memento_url, digest, record_id ORDER BY event_id"


def _capture_dedupe(spark: SparkSession, sf_dir: str, pick) -> DataFrame:
    df = X.captures(spark, sf_dir, "month").select("url_id", "archive", *dedupe.CAPTURE_KEY, "status", "event_id")
    return pick(df, ["url_id", "archive", *dedupe.CAPTURE_KEY], [F.col("event_id")])


@query(f"WITH {X.sql('month')} SELECT url_id, archive, capture_time, memento_url, digest, record_id, status, event_id FROM (SELECT *, row_number() OVER ({_SAME}) AS n FROM cap) WHERE n = 1")
def q_capture_dedupe_first(spark, sf_dir):
    return _capture_dedupe(spark, sf_dir, dedupe.first_wins)


@query(f"WITH {X.sql('month')} SELECT url_id, archive, capture_time, memento_url, digest, record_id, status, event_id FROM (SELECT *, row_number() OVER ({_SAME} DESC) AS n FROM cap) WHERE n = 1")
def q_capture_dedupe_last(spark, sf_dir):
    return _capture_dedupe(spark, sf_dir, dedupe.last_wins)


# --- checkpoints ------------------------------------------------------------

_LOG = """log AS (
  SELECT 'u' || (user_id % 40) AS url_id, 'w' || (event_id % 3) AS witness,
    CASE WHEN event_id % 11 = 0 THEN 'SKIPPED_EARLY_STOP' ELSE CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'PERMANENT_FAILURE' ELSE 'RETRY' END END AS state,
    CASE event_type WHEN 'error' THEN 'timeout' WHEN 'view' THEN 'dns_failure' END AS error_class, event_id AS seq FROM events
)"""


def _view_sql(log: str = "log") -> str:
    return f"""v AS (SELECT url_id, witness, arg_max(state, seq) AS state, CAST(sum(CASE WHEN state = 'SKIPPED_EARLY_STOP' THEN 0 ELSE 1 END) AS INTEGER) AS attempts,
  arg_max(error_class, seq) FILTER (error_class IS NOT NULL) AS last_error_class FROM {log} GROUP BY url_id, witness)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(F.col("event_id") % 11 == 0, S.SKIPPED).when(kind == "purchase", S.SUCCESS).when(kind == "error", S.FAILED).otherwise(S.RETRY)
    rows = X.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("url_id"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("witness"), state.alias("state"),
        F.when(kind == "error", "timeout").when(kind == "view", "dns_failure").alias("error_class"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("updated_at"),
    )
    return C.mark(rows)


@query(f"WITH {_LOG}, {_view_sql()} SELECT * FROM v")
def q_checkpoint_view(spark, sf_dir):
    return C.view(_log(spark, sf_dir))


@query(f"WITH {_LOG}, {_view_sql()}, p AS (SELECT 'u' || i AS url_id, 'w' || j AS witness FROM range(60) a(i), range(4) b(j)) SELECT url_id, witness FROM p WHERE (url_id, witness) NOT IN (SELECT (url_id, witness) FROM v WHERE state <> 'RETRY')")
def q_done_antijoin(spark, sf_dir):
    name = lambda n, p, c: spark.range(n).select(F.concat(F.lit(p), F.col("id").cast("string")).alias(c))
    return C.pending(name(60, "u", "url_id"), name(4, "w", "witness"), C.view(_log(spark, sf_dir)))


@query(f"""WITH {_LOG}, {_view_sql()}, early AS (SELECT * FROM log WHERE seq < (SELECT max(seq) // 2 FROM log)), {_view_sql('early').replace('v AS', 'mid AS', 1)},
late AS (SELECT l.* FROM log l LEFT JOIN mid ON l.url_id = mid.url_id AND l.witness = mid.witness AND mid.state = 'PERMANENT_FAILURE' AND mid.witness IN ('w0', 'w1')
WHERE mid.url_id IS NULL OR l.seq >= (SELECT max(seq) // 2 FROM log)), {_view_sql('late').replace('v AS', 'z AS', 1)} SELECT * FROM z""")
def q_checkpoint_retry_reset(spark, sf_dir):
    log = _log(spark, sf_dir)
    half = log.agg((F.max("seq") / 2).cast("bigint")).first()[0]
    resets = C.retry_failures(C.view(log.where(F.col("seq") < half)), ["w0", "w1"], half - 1).withColumn("seq", F.lit(half - 1).cast("bigint"))
    return C.view(log.unionByName(resets))


_RESOLVED = "r AS (SELECT url_id FROM obs GROUP BY url_id HAVING bool_or(status = 'S0_observed_alive') OR count(DISTINCT observer) FILTER (status = 'terminal_inaccessible') >= 2)"
_PAIRS = "pairs AS (SELECT url_id, w AS witness FROM urls, (VALUES ('live_web'), ('archive:a0'), ('archive:a1')) t(w))"


def _early(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = spark.createDataFrame([("live_web",), ("archive:a0",), ("archive:a1",)], "witness string")
    pairs = X.urls(spark, sf_dir).select("url_id").crossJoin(F.broadcast(names))
    return C.split_early(pairs, C.resolved(X.observations(spark, sf_dir)))


@query(f"WITH {X.sql()}, {_RESOLVED} SELECT url_id FROM r")
def q_early_stop_resolved(spark, sf_dir):
    return C.resolved(X.observations(spark, sf_dir))


@query(f"WITH {X.sql()}, {_RESOLVED}, {_PAIRS} SELECT url_id, witness FROM pairs WHERE url_id IN (SELECT url_id FROM r)")
def q_early_stop_skipped(spark, sf_dir):
    return _early(spark, sf_dir)[1]


@query(f"WITH {X.sql()}, {_RESOLVED}, {_PAIRS} SELECT url_id, witness FROM pairs WHERE url_id NOT IN (SELECT url_id FROM r)")
def q_early_stop_pending(spark, sf_dir):
    return _early(spark, sf_dir)[0]


# --- parsers ----------------------------------------------------------------


@query("SELECT o_orderkey, o_orderdate AS t, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderdate END AS u FROM orders")
def q_ts14_parse(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    other = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", times.timestamp14(text).cast("timestamp_ntz").alias("t"), times.timestamp14(other).cast("timestamp_ntz").alias("u"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderdate END AS t FROM orders")
def q_memento_parse(spark, sf_dir):
    full = F.concat(F.lit("Mon, "), F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss"), F.when(F.col("o_orderkey") % 3 == 1, " +0000").otherwise(" GMT"))
    text = F.when(F.col("o_orderkey") % 3 == 2, F.date_format("o_orderdate", "yyyyMMddHHmmss")).otherwise(full)
    return X.table(spark, sf_dir, "orders").select("o_orderkey", times.memento_time(text).cast("timestamp_ntz").alias("t"))


_FIELDS = "date_trunc('second', ts)::TIMESTAMP AS capture_time, 'http://h/' || event_id AS memento_url"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.date_format("ts", "yyyyMMddHHmmss")
    return X.table(spark, sf_dir, "events").select(
        "event_id", "user_id", ts.alias("ts14"), F.concat(F.lit("http://h/"), F.col("event_id").cast("string")).alias("url"), F.floor(F.col("value")).cast("int").alias("n"), "ts"
    )


def _flat(df: DataFrame, captures: Column, *columns: str) -> DataFrame:
    out = df.select(F.explode(captures).alias("c")).select(*(f"c.{c}" for c in columns))
    return out.withColumn("capture_time", F.col("capture_time").cast("timestamp_ntz"))


@query(f"SELECT {_FIELDS}, 'text/html' AS mime_type, '200' AS status, 'D' || event_id AS digest, strftime(ts, '%Y%m%d%H%M%S') AS record_id, CAST(floor(value) AS BIGINT) AS content_length FROM events")
def q_parse_cdx_json(spark, sf_dir):
    row = F.array("url", "ts14", F.lit("200"), F.lit("text/html"), F.col("n").cast("string"), F.concat(F.lit("D"), F.col("event_id").cast("string")))
    header = F.array(*map(F.lit, ("original", "timestamp", "statuscode", "mimetype", "length", "digest")))
    text = F.to_json(F.concat(F.array(header), F.collect_list(row), F.array(F.array(F.lit("short")))))
    pages = _lines(spark, sf_dir).groupBy("user_id").agg(text.alias("text"))
    return _flat(pages, parsers.index(F.col("text")), "capture_time", "memento_url", "mime_type", "status", "digest", "record_id", "content_length")


@query(f"SELECT {_FIELDS}, 'text/html' AS mime_type, '200' AS status, '7:' || CAST(floor(value) AS BIGINT) AS record_id, CAST(floor(value) AS BIGINT) AS content_length FROM events")
def q_parse_cdx_ndjson(spark, sf_dir):
    line = F.to_json(F.struct(F.col("ts14").alias("timestamp"), "url", F.lit("text/html").alias("mime"), F.lit("200").alias("status"), F.lit("7").alias("offset"), F.col("n").cast("string").alias("length")))
    pages = _lines(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return _flat(pages, parsers.index(F.col("text")), "capture_time", "memento_url", "mime_type", "status", "record_id", "content_length")


@query(f"""SELECT {_FIELDS}, CASE WHEN event_id % 4 = 3 THEN 'f' ELSE '' END AS warc_file, CASE WHEN event_id % 4 = 3 THEN '9:' || CAST(floor(value) AS BIGINT) ELSE strftime(ts, '%Y%m%d%H%M%S') END AS record_id,
CASE WHEN event_id % 4 IN (1, 3) THEN CAST(floor(value) AS BIGINT) END AS content_length FROM events WHERE event_id % 4 <> 0""")
def q_parse_cdx_text(spark, sf_dir):
    e, n = F.col("event_id") % 4, F.col("n").cast("string")
    head = F.concat_ws(" ", F.lit("k"), "ts14", "url", F.lit("m"), F.lit("200"), F.lit("D"))
    # Six fields (dropped), seven, eight, eleven.
    line = F.when(e == 0, head).when(e == 1, F.concat_ws(" ", head, n)).when(e == 2, F.concat_ws(" ", head, F.lit("x"), n)).otherwise(F.concat_ws(" ", head, F.lit("x"), F.lit("y"), n, F.lit("9"), F.lit("f")))
    pages = _lines(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return _flat(pages, parsers.index(F.col("text")), "capture_time", "memento_url", "warc_file", "record_id", "content_length")


def _memento(col: str = "ts") -> Column:
    return F.concat(F.lit("Mon, "), F.date_format(col, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


_MEMENTOS = f"SELECT {_FIELDS}, 'Mon, ' || strftime(ts, '%d %b %Y %H:%M:%S') || ' GMT' AS record_id FROM events"


@query(_MEMENTOS)
def q_parse_timemap_json(spark, sf_dir):
    items = F.collect_list(F.struct(_memento().alias("datetime"), F.col("url").alias("uri")))
    pages = _lines(spark, sf_dir).groupBy("user_id").agg(F.to_json(F.struct(F.struct(items.alias("list")).alias("mementos"))).alias("text"))
    return _flat(pages, parsers.timemap(F.col("text")), "capture_time", "memento_url", "record_id")


@query(f"{_MEMENTOS} WHERE event_id % 5 <> 0")
def q_parse_timemap_link(spark, sf_dir):
    rel = F.when(F.col("event_id") % 5 == 0, "first memento").otherwise("memento")
    link = F.concat(F.lit("<"), "url", F.lit('>; rel="'), rel, F.lit('"; datetime="'), _memento(), F.lit('"'))
    pages = _lines(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.collect_list(link), ",\n").alias("text"))
    return _flat(pages, parsers.timemap(F.col("text")), "capture_time", "memento_url", "record_id")


# --- stores ----------------------------------------------------------------


@query(f"WITH {X.sql()} SELECT url_id, observer AS witness, status || ':' || content_length AS payload FROM obs WHERE status <> 'access_restricted'")
def q_raw_roundtrip(spark, sf_dir):
    out = files.scratch(spark, "raw")
    text = F.when(F.col("status") == S.RESTRICTED, "").otherwise(F.concat_ws(":", "status", "content_length"))
    rows = X.observations(spark, sf_dir).select("url_id", F.col("observer").alias("witness"), F.col("observation_time").cast("timestamp").alias("stored_at"), text.alias("payload"))
    raw.append(rows, out)
    return raw.read(spark, out).select("url_id", "witness", "payload")


@query(f"WITH {X.sql()} SELECT url_id, archive, capture_time, status, digest, content_length FROM cap")
def q_export_roundtrip(spark, sf_dir):
    out = files.scratch(spark, "export")
    store = Store(spark, out)
    store.append("captures", X.captures(spark, sf_dir))
    store.export(f"{out}/export")
    back = spark.read.parquet(f"{out}/export/captures.parquet")
    return back.select("url_id", "archive", F.col("capture_time").cast("timestamp_ntz").alias("capture_time"), "status", "digest", "content_length")


@query(fold_sql() + "SELECT url_id, event_type, event_start, event_end, confidence, evidence_count, witness_count, archive FROM evs")
def q_classify_stored(spark, sf_dir):
    """The whole second half of a run: tables are appended, classified and read again."""
    store = Store(spark, files.scratch(spark, "classify"))
    store.append("observations", X.observations(spark, sf_dir))
    store.append("captures", X.captures(spark, sf_dir))
    classification.classify(store, X.YEARS)
    return store.read("events").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("event_start", "event_end")})
