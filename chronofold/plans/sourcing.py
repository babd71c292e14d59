"""Queries of what comes in: lists, registry, listings, answers of a network, rounds of collection, and their SQL.

The network is a rule: each address gives a status, a body or captures that follow from a hash of
it, which SQL computes as well.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
from datetime import datetime, timezone
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import schemas as S
from chronofold.functions import urls as U
from chronofold.operators import dedupe, limits, parsers
from chronofold.operators import checkpoints as C
from chronofold.plans import collect as collection
from chronofold.plans import fixtures as X
from chronofold.plans import pick
from chronofold.plans.queries import _URL, query
from chronofold.sources import candidates, files, registry
from chronofold.sources.store import Store
from chronofold.sources.transport import Response

NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)


# --- lists


def _write_csv(spark: SparkSession, sf_dir: str, folder: str) -> None:
    pages = X.table(spark, sf_dir, "pages")
    kind = F.get(F.array(F.lit("DEEP"), F.lit(""), F.lit(" Root ")), (F.col("page_id") % 3).cast("int"))
    rows = pages.select(F.concat(F.lit(" "), F.col("url"), F.lit("?a=1,2")).alias("url"), (2000 + F.col("page_id") % 20).alias("first_observed_year"), kind.alias("url_type"))
    rows.repartition(3).write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)


def _write_index(spark: SparkSession, sf_dir: str, folder: str) -> None:
    e = F.col("event_id")
    tail = F.get(F.array(F.lit(" text/html 200"), F.lit(" text/html 404"), F.lit(" text/html -"), F.lit(""), F.lit(" text/html 204 x y")), (e % 5).cast("int"))
    line = F.concat(F.lit("x key "), F.date_format("ts", "yyyyMMddHHmmss"), F.concat(F.lit(" http://h/"), e.cast("string")), tail)
    X.table(spark, sf_dir, "events").select(F.when(e % 50 == 49, "too short").otherwise(line)).repartition(2).write.mode("append").option("compression", "gzip").text(folder)


_CSV = "SELECT url || '?a=1,2' AS url, CAST(2000 + page_id % 20 AS VARCHAR) AS first_observed_year, CASE page_id % 3 WHEN 0 THEN 'deep' WHEN 1 THEN 'unknown' ELSE 'root' END AS url_type FROM pages"
_GZ = "SELECT 'http://h/' || event_id AS url, strftime(ts, '%Y') AS first_observed_year, 'unknown' AS url_type FROM events WHERE event_id % 5 <> 1 AND event_id % 50 <> 49"


@query(_CSV)
def q_candidates_csv(spark, sf_dir):
    folder = files.scratch(spark, "lists")
    _write_csv(spark, sf_dir, folder)
    return candidates.read(spark, files.names(spark, f"{folder}/*.csv")).select("url", "first_observed_year", "url_type")


@query(_GZ)
def q_candidates_index(spark, sf_dir):
    folder = files.scratch(spark, "lists")
    _write_index(spark, sf_dir, folder)
    return candidates.read(spark, files.names(spark, f"{folder}/*.gz")).select("url", "first_observed_year", "url_type")


@query(f"{_CSV} UNION ALL {_GZ}")
def q_candidates_folder(spark, sf_dir):
    folder = files.scratch(spark, "lists")
    _write_csv(spark, sf_dir, folder)
    _write_index(spark, sf_dir, folder)
    return candidates.read(spark, [folder]).select("url", "first_observed_year", "url_type")


@query(f"WITH {_URL} SELECT substr(sha256(canonical_url), 1, 24) AS url_id, canonical_url, min(domain) AS domain, '2010-2014' AS entry_cohort, '2012-01-01T00:00:00+00:00' AS first_observed FROM c GROUP BY 1, 2")
def q_picked_urls(spark, sf_dir):
    """Rows of a list become the table of URLs: canonical, each once, the invalid ones left out; a second list adds nothing."""
    store = Store(spark, files.scratch(spark, "urls"))
    pages = X.table(spark, sf_dir, "pages").select("url", F.lit("2012").alias("first_observed_year"), F.lit("unknown").alias("url_type"), F.lit(0).alias("file_ord"), F.col("page_id").alias("line_ord"))
    bad = spark.createDataFrame([("http://[bad/", "2012", "unknown", 1, 0)], pages.schema)
    for rows in (pages.unionByName(bad), pages):
        pick.write_urls(store, rows, NOW)
    return store.read("urls").select("url_id", "canonical_url", "domain", "entry_cohort", "first_observed")


@query("SELECT url, page_id FROM pages ORDER BY md5('1337:' || url), url, page_id LIMIT 25")
def q_reservoir_sample(spark, sf_dir):
    return dedupe.sample_rows(X.table(spark, sf_dir, "pages").select("page_id", "url"), 25, "url")


# --- hosts' and URLs' odd forms

_ODD = """WITH o AS (SELECT page_id, page_id % 8 AS k, CAST(page_id AS VARCHAR) AS i FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'http://ex' || i || '.com/' WHEN 1 THEN 'https://u:p@ex' || i || '.com:8443/a' WHEN 2 THEN 'http://ex' || i || '.com:8080/%7Ea%20b' WHEN 3 THEN 'http://[2001:db8::' || i || ']/x'
  WHEN 4 THEN 'https://ex' || i || '.com/p;v=1?b=2&a=1' WHEN 5 THEN 'http://bücher' || i || '.de/ä' WHEN 6 THEN NULL ELSE 'http://ex' || i || '.com./a//b' END AS canonical_url FROM o"""


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    forms = (("HTTP://Ex", ".COM:80"), ("https://u:p@EX", ".com:8443/a/"), ("http://ex", ".com:8080/%7Ea%20b#f"), ("http://[2001:DB8::", "]:80/x"), ("https://ex", ".com:443/p;v=1?utm_source=z&b=2&a=1"), ("http://Bücher", ".de/ä"), ("http://[bad", "/"), ("http://ex", ".com./a//b/"))
    made = F.get(F.array(*(F.concat(F.lit(a), i, F.lit(b)) for a, b in forms)), (F.col("page_id") % 8).cast("int"))
    return X.table(spark, sf_dir, "pages").select("page_id", made.alias("url"))


@query(_ODD)
def q_url_canonical_odd(spark, sf_dir):
    """Ports, user info, encodings, brackets, parameters, other scripts."""
    return _odd(spark, sf_dir).select("page_id", U.canonical(F.col("url")).alias("canonical_url"))


@query("""SELECT page_id, CASE page_id % 8 WHEN 1 THEN 'ex' || page_id || '.com' WHEN 3 THEN '2001:db8::' || page_id WHEN 5 THEN 'bücher' || page_id || '.de' WHEN 6 THEN '' ELSE 'ex' || page_id || '.com' END AS host_key FROM pages""")
def q_host_key_odd(spark, sf_dir):
    return _odd(spark, sf_dir).select("page_id", U.host_key(F.col("url")).alias("host_key"))


# --- the registry

_NAMED = "CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ' (Alt' || n_nationkey || ')' END"


def _descriptor(key: int, name: str) -> str:
    place = "{collection}/" if key % 3 == 0 else ""
    lines = ["[archive]", f'name = "{name}"' if key % 2 == 0 else f'name = ["{name}", {{alt = "Alt{key}"}}]']
    lines += [f'established = "{1990 + key}" # ' + (f"backfilled; capturing began in {1990 + key + key % 4}" if key % 4 else "backfill of older pages"), *([f'id = "id{key:02d}"'] if key % 6 else [])]
    lines += [f'[[archive.scope.collections]]\nid = "c{j}"' for j in range(key % 4)]
    lines += ["[api]", f"rate_limit = {'true' if key % 2 else 'false'}"] if key % 7 else []
    if key % 5:
        lines += ["[api.cdx.query]", f'endpoint = "http://a{key}/{place}cdx?url={{url}}"', f'access = "{"online" if key % 5 < 4 else "offline"}"']
    return "\n".join(lines) + "\n"


def _registry(spark: SparkSession, sf_dir: str) -> tempfile.TemporaryDirectory:
    """A folder of 25 descriptors, one for each nation; the driver alone reads a registry."""
    folder = tempfile.TemporaryDirectory()
    for key, name in X.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        place = Path(folder.name) / f"folder{key:02d}"
        place.mkdir()
        (place / registry.FILE).write_text(_descriptor(key, name), encoding="utf-8")
    return folder


_ID = "CASE WHEN n_nationkey % 6 = 0 THEN printf('folder%02d', n_nationkey) ELSE printf('id%02d', n_nationkey) END"
_BEGAN = "CASE WHEN n_nationkey % 4 <> 0 THEN 1990 + n_nationkey + n_nationkey % 4 END"


@query(f"""SELECT {_ID} AS id, {_NAMED} AS name, (n_nationkey % 2 = 1 OR n_nationkey % 7 = 0) AS rate_limited, 'http://a' || n_nationkey || CASE WHEN n_nationkey % 3 = 0 THEN '/{{collection}}' ELSE '' END || '/cdx?url={{url}}' AS cdx_endpoint,
CASE WHEN n_nationkey % 5 < 4 THEN 'online' ELSE 'offline' END AS cdx_access, CAST(1990 + n_nationkey AS INTEGER) AS established, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 4 > 0 THEN 'c0' END AS default_collection,
CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 4 ELSE 0 END AS INTEGER) AS n_collections FROM nation WHERE n_nationkey % 5 <> 0""")
def q_registry(spark, sf_dir):
    with _registry(spark, sf_dir) as folder:
        found = registry.table(spark, registry.compile_all(folder))
    return found.select("id", "name", "rate_limited", "cdx_endpoint", "cdx_access", "established", "default_collection", F.size("collections").alias("n_collections"))


@query(f"""SELECT printf('folder%02d', n_nationkey) AS id, 'established' AS field, CAST(1990 + n_nationkey AS BIGINT) AS established, CAST({_BEGAN} AS BIGINT) AS capturing_began, n_nationkey % 4 <> 0 AS mismatch FROM nation""")
def q_backfill_notes(spark, sf_dir):
    with _registry(spark, sf_dir) as folder:
        rows = [(n["id"], n["field"], n["established"], n["capturing_began"], n["mismatch"]) for n in registry.backfill_notes(folder)]
    return spark.createDataFrame(rows, "id string, field string, established bigint, capturing_began bigint, mismatch boolean")


@query(f"""WITH y AS (SELECT {_ID} AS id, 1990 + n_nationkey AS y FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT printf('folder%02d', n_nationkey), {_BEGAN} FROM nation)
SELECT 'archive:' || id AS archive, CAST(max(y) AS BIGINT) AS year FROM y WHERE y IS NOT NULL GROUP BY 1""")
def q_established_years(spark, sf_dir):
    with _registry(spark, sf_dir) as folder:
        return spark.createDataFrame(sorted(registry.established_years(folder).items()), "archive string, year bigint")


@query(f"""SELECT 'live_web' AS witness, 25.0::DOUBLE AS rate, 10.0::DOUBLE AS timeout UNION ALL
SELECT 'archive:' || id, CASE WHEN id = 'id07' THEN 0.5 ELSE 2.5 END, CASE WHEN id = 'id08' THEN 60.0 ELSE 20.0 END FROM (SELECT {_ID} AS id, n_nationkey % 5 AS k FROM nation) WHERE k BETWEEN 1 AND 3 AND id <> 'id11'""")
def q_witnesses(spark, sf_dir):
    """The witnesses of one of four shards, one left out, one with a rate and one with a timeout of its own."""
    with _registry(spark, sf_dir) as folder:
        found = registry.witnesses(folder, exclude={"id11"}, shards=4, rates={"id07": 2.0}, timeouts={"id08": 60.0})
    return spark.createDataFrame([(w.name, w.requests_per_second, w.timeout_seconds) for w in found], "witness string, rate double, timeout double")


# --- answers


def _capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an archive, one for each user, with the captures that events stand for, each twice."""
    row = F.struct(
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("capture_time"), F.concat(F.lit("http://h/"), F.col("event_id").cast("string")).alias("memento_url"), F.lit("m").alias("mime_type"), F.lit("200").alias("status"),
        F.lit("d").alias("digest"), F.lit("").alias("warc_file"), F.lit("r").alias("record_id"), F.lit("success").alias("query_status"), F.lit(1).cast("bigint").alias("content_length"),
    )
    rows = X.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url_id"), row.alias("c"))
    return rows.unionAll(rows).groupBy("url_id").agg(F.collect_list("c").alias("captures")).withColumn("witness", F.lit("archive:x"))


_PAST = "CAST(user_id AS VARCHAR) AS url_id, date_trunc('second', ts)::TIMESTAMP AS capture_time, 'http://h/' || event_id AS memento_url FROM events WHERE date_trunc('second', ts) <= TIMESTAMP '2024-01-20'"


def _past(spark: SparkSession, sf_dir: str, history: str) -> DataFrame:
    found = collection.captures_of(_capture_rows(spark, sf_dir), NOW, history)
    return found.select("url_id", F.col("capture_time").cast("timestamp_ntz").alias("capture_time"), "memento_url")


@query(f"SELECT {_PAST} UNION ALL SELECT {_PAST}")
def q_future_captures(spark, sf_dir):
    """Captures that lie ahead of the job's instant are no evidence."""
    return _past(spark, sf_dir, "full")


@query(f"SELECT {_PAST}")
def q_lifespan_captures_once(spark, sf_dir):
    return _past(spark, sf_dir, "lifespan")


@query("""SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN date_trunc('second', ts)::TIMESTAMP END AS capture_time, CASE event_id % 6 WHEN 2 THEN '' ELSE 'http://h/' || event_id END AS memento_url,
CASE event_id % 6 WHEN 0 THEN '200' WHEN 1 THEN 'None' ELSE '' END AS status FROM events WHERE event_id % 6 IN (0, 1, 2)""")
def q_parse_lines_mixed(spark, sf_dir):
    """Objects and plain fields in one answer: complete, with a null status, without names, and four kinds of lines that are dropped."""
    e, ts = F.col("event_id"), F.date_format("ts", "yyyyMMddHHmmss")
    url = F.concat(F.lit("http://h/"), e.cast("string"))
    forms = (
        F.concat_ws(" ", F.lit("  k"), ts, url, F.lit("m"), F.lit("200"), F.lit("D"), F.lit("7  ")),
        F.concat(F.lit('{"url": "'), url, F.lit('", "timestamp": "'), ts, F.lit('", "status": null}')),
        F.concat(F.lit('{"timestamp": "'), ts, F.lit('", "odd": [1]}')),
        F.lit("k 2024 too few"),
        F.concat_ws(" ", F.lit("k"), F.lit("notime"), url, F.lit("m"), F.lit("200"), F.lit("D"), F.lit("7")),
        F.lit("{broken"),
    )
    text = F.concat(F.lit("\n \r\n"), F.get(F.array(*forms), (e % 6).cast("int")), F.lit("\r"))
    found = X.table(spark, sf_dir, "events").select("event_id", F.explode(parsers.index(text)).alias("c"))
    return found.select("event_id", F.col("c.capture_time").cast("timestamp_ntz").alias("capture_time"), "c.memento_url", "c.status")


@query("""SELECT page_id, page_id % 6 IN (0, 1, 4) AS is_empty, page_id % 6 IN (1, 2, 5) AS malformed FROM pages""")
def q_parse_nothing(spark, sf_dir):
    """Answers without captures: lists that are empty, and texts that are no answer."""
    forms = (("[]", "cdx"), ('[["timestamp", "original"]]', "cdx"), ("<html>busy</html>", "timemap"), ("", "timemap"), ('[["a"], []]', "timemap"), ("k 1 too few", "cdx"))
    at = (F.col("page_id") % 6).cast("int")
    text, kind = (F.get(F.array(*(F.lit(f[i]) for f in forms)), at) for i in (0, 1))
    rows = X.table(spark, sf_dir, "pages").select("page_id", text.alias("text"), kind.alias("kind"))
    found = F.when(F.col("kind") == "cdx", parsers.index(F.col("text"))).otherwise(parsers.timemap(F.col("text")))
    return rows.select("page_id", F.coalesce(parsers.is_empty(F.col("text")), F.lit(False)).alias("is_empty"), (parsers.is_malformed(F.col("kind"), F.col("text"), found) & ~((F.col("kind") == "cdx") & (F.col("text") == "[]"))).alias("malformed"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '[["a","b"],["' || page_id || '","x"]]' WHEN 1 THEN '[["a","b"],["' || page_id || '","x"]]' WHEN 2 THEN 'l1 ' || page_id || chr(10) || 'l2' WHEN 3 THEN 'l1' ELSE '' END AS body,
CASE page_id % 5 WHEN 1 THEN 'key' || page_id WHEN 2 THEN 'key ' || page_id END AS key FROM pages""")
def q_resume_key(spark, sf_dir):
    """Pages of a listing and the keys that lead on."""
    i = F.col("page_id").cast("string")
    table = F.concat(F.lit('[["a","b"],["'), i, F.lit('","x"]'))
    forms = (F.concat(table, F.lit("]")), F.concat(table, F.lit(',["key'), i, F.lit('"]]')), F.concat(F.lit("l1 "), i, F.lit("\nl2\n\nkey "), i, F.lit("\n")), F.lit("l1\n"), F.lit(""))
    found = parsers.split_resume(F.get(F.array(*forms), (F.col("page_id") % 5).cast("int")))
    return X.table(spark, sf_dir, "pages").select("page_id", found.alias("r")).select("page_id", "r.body", "r.key")


# --- what holds a connector back


def _guarded(spark: SparkSession, sf_dir: str, schema: str, last) -> DataFrame:
    """Each user's events as answers and, where they are errors, failures; ``last`` reads the state they end in."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        terms, state = limits.Terms(10.0, failures=2, cooldown=120.0), limits.State()
        for n, kind in enumerate(rows.sort_values("event_id")["event_type"]):
            state = limits.failed(state, terms, float(n), True, limits.HARD) if kind == "error" else limits.answered(state)
        return pd.DataFrame([(rows["user_id"].iloc[0], *last(terms, state, len(rows)))], columns=[c.split()[0] for c in schema.split(", ")])

    return X.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandas(run, schema)


@query("""SELECT user_id, list_reduce(list_prepend(1.0::DOUBLE, list(CASE WHEN event_type = 'error' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY event_id)),
lambda s, f: CASE WHEN f > 0 THEN least(10.0::DOUBLE, s * f) ELSE greatest(0.25::DOUBLE, s / 1.02::DOUBLE) END) AS stretch FROM events GROUP BY user_id""")
def q_rate_limit(spark, sf_dir):
    return _guarded(spark, sf_dir, "user_id bigint, stretch double", lambda t, s, n: (s.stretch,))


@query("""WITH o AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events),
g AS (SELECT user_id, any_value(total) AS total, coalesce(max(n) FILTER (event_type <> 'error'), 0) AS fine FROM o GROUP BY user_id)
SELECT user_id, CAST(total - fine AS BIGINT) AS streak, total - fine >= 2 AS shut, total - fine >= 2 AND total + 100 - (fine + 1) >= 120 AS may_look FROM g""")
def q_circuit_breaker(spark, sf_dir):
    return _guarded(spark, sf_dir, "user_id bigint, streak bigint, shut boolean, may_look boolean", lambda t, s, n: (s.streak, limits.is_shut(s), limits.may_look(s, t, float(n + 100))))


# --- rounds over a network that is a rule


class Rule:
    """Addresses and what they give. ``n`` is the number that the first four digits of an address's MD5 make."""

    @staticmethod
    def n(url: str) -> int:
        return int(hashlib.md5(url.encode()).hexdigest()[:4], 16)  # noqa: S324

    def resolves(self, host: str) -> bool:
        return True

    def healthy(self, url: str, timeout: float = 5.0) -> bool:
        return True

    def get(self, url: str, timeout: float, limit: int | None = None) -> Response:
        parts = urlsplit(url)
        if not (parts.hostname or "").endswith(".rule"):
            return Response((200, 404, 410, 403)[self.n(url) % 4], url.encode(), url, "text/html; charset=utf-8")
        if parts.path.startswith("/timemap/"):
            asked = unquote(parts.path.removeprefix("/timemap/"))
            items = [f'<http://t.rule/{y}/{asked}>; rel="memento"; datetime="Mon, 01 Jan {y} 00:00:00 GMT"' for y in range(2001, 2001 + self.n(asked) % 4)]
            return Response(200, ",\n".join(items).encode())
        q = {k: v[0] for k, v in parse_qs(parts.query).items()}
        if "matchType" in q and q["matchType"] == "host":
            return Response(500)  # hosts aren't listed, so each URL is asked for
        if "matchType" in q:
            lines = [f"k 20{k % 24:02d}0101000000 http{'s' * (k % 2)}://{'www.' * (k % 3 == 0)}s{k % 5}.{unquote(q['url']).strip('/')}/{'p%d' % k if k % 4 else ''} text/html" for k in range(40)]
            return Response(200, "\n".join(lines).encode())
        rows = [[f"20{k:02d}0101000000", q["url"], "text/html", "200", f"D{k % 2}", str(100 + k)] for k in range(10, 10 + self.n(q["url"]) % 6)]
        rows = rows[::-1] if q.get("sort") == "reverse" else rows
        rows = rows[: int(q["limit"])] if "limit" in q else rows
        return Response(200, json.dumps([["timestamp", "original", "mimetype", "statuscode", "digest", "length"], *rows]).encode() if rows else b"")


def _collected(spark: SparkSession, sf_dir: str, witnesses: list[registry.Witness], **options) -> Store:
    store = Store(spark, files.scratch(spark, "rounds"))
    rows = X.table(spark, sf_dir, "pages").select(U.url_id(F.col("url")).alias("url_id"), F.col("url").alias("original_url"))
    store.append("urls", dedupe.first_wins(rows, ["url_id"], [F.col("original_url")]))
    collection.collect(store, witnesses, Rule(), collection.Options(pause=lambda seconds: None, **options))
    return store


_FAST = 1e6
_WEB = registry.Witness(S.LIVE, _FAST, 1.0)
_INDEX = registry.Witness("archive:i", _FAST, 1.0, registry.Archive("i", "i", cdx_endpoint="http://i.rule/cdx?url={url}", cdx_access="online"))
_MAPS = registry.Witness("archive:t", _FAST, 1.0, registry.Archive("t", "t", timemap_endpoint="http://t.rule/timemap/{url}", timemap_access="online"))
_N = "('0x' || substr(md5(original_url), 1, 4))::BIGINT"
_URLS = "u AS (SELECT substr(sha256(url), 1, 24) AS url_id, min(url) AS original_url FROM pages GROUP BY 1)"


@query(f"""WITH {_URLS}, a AS (SELECT *, list_extract([200, 404, 410, 403], {_N} % 4 + 1) AS code FROM u)
SELECT url_id, 'live_web' AS observer, CAST(code AS INTEGER) AS http_status, CASE code WHEN 200 THEN 'S0_observed_alive' WHEN 403 THEN 'access_restricted' ELSE 'terminal_inaccessible' END AS status,
CAST(octet_length(encode(original_url)) AS BIGINT) AS content_length, 'sha256:' || sha256(original_url) AS content_digest, 'text/html' AS mime_type FROM a""")
def q_collect_live(spark, sf_dir):
    """Every URL is asked for once; what the web says becomes observations."""
    found = _collected(spark, sf_dir, [_WEB], stop_early=False).read("observations")
    return found.select("url_id", "observer", "http_status", "status", "content_length", "content_digest", "mime_type")


_CAPTURED = f"""WITH {_URLS}, c AS (SELECT url_id, {_N} % 6 AS n, unnest(range(10, CAST(10 + {_N} % 6 AS BIGINT))) AS k FROM u)
SELECT url_id, 'archive:i' AS archive, make_timestamp(2000 + k, 1, 1, 0, 0, 0) AS capture_time, 'D' || (k % 2) AS digest, CAST(100 + k AS BIGINT) AS content_length FROM c"""


def _captures(store: Store) -> DataFrame:
    return store.read("captures").select("url_id", "archive", F.col("capture_time").cast("timestamp_ntz").alias("capture_time"), "digest", "content_length")


@query(_CAPTURED)
def q_collect_captures(spark, sf_dir):
    return _captures(_collected(spark, sf_dir, [_INDEX], stop_early=False))


@query(f"{_CAPTURED} WHERE k - 10 < 2 OR k - 10 = n - 1")
def q_collect_lifespan(spark, sf_dir):
    """Of each URL the first two captures and the last."""
    return _captures(_collected(spark, sf_dir, [_INDEX], stop_early=False, history="lifespan"))


@query(f"WITH {_URLS} SELECT url_id, make_timestamp(y, 1, 1, 0, 0, 0) AS capture_time, 'http://t.rule/' || y || '/' || original_url AS memento_url FROM (SELECT *, unnest(range(2001, CAST(2001 + {_N} % 4 AS BIGINT))) AS y FROM u)")
def q_collect_timemaps(spark, sf_dir):
    found = _collected(spark, sf_dir, [_MAPS], stop_early=False).read("captures")
    return found.select("url_id", F.col("capture_time").cast("timestamp_ntz").alias("capture_time"), "memento_url")


@query(f"""WITH {_URLS}, a AS (SELECT *, {_N} % 4 AS web FROM u)
SELECT url_id, 'live_web' AS witness, 'SUCCESS' AS state, CAST(1 AS INTEGER) AS attempts FROM a
UNION ALL SELECT url_id, 'archive:i', CASE WHEN web = 0 THEN 'SKIPPED_EARLY_STOP' ELSE 'SUCCESS' END, CASE WHEN web = 0 THEN 0 ELSE 1 END FROM a""")
def q_collect_marks(spark, sf_dir):
    """The live web goes first; of URLs that are alive no archive is asked. A second run finds nothing to do."""
    store = _collected(spark, sf_dir, [_WEB, _INDEX])
    again = collection.collect(store, [_WEB, _INDEX], Rule(), collection.Options(pause=lambda seconds: None))
    if any(again.values()):
        raise AssertionError(f"a finished collection went on: {again}")
    return C.view(store.read("checkpoints")).select("url_id", "witness", "state", F.col("attempts").cast("int").alias("attempts"))


@query("""SELECT 'http' || CASE WHEN k % 2 = 1 THEN 's' ELSE '' END || '://' || CASE WHEN k % 3 = 0 THEN 'www.' ELSE '' END || 's' || (k % 5) || '.ex.org/' || CASE WHEN k % 4 > 0 THEN 'p' || k ELSE '' END AS url,
CAST(2000 + k % 24 AS VARCHAR) AS year FROM range(40) t(k)""")
def q_domain_listing(spark, sf_dir):
    """The lines of a domain's listing as they are stored, before discovery chooses among them."""
    from chronofold.sources.clients import domain_covered, domain_lines

    def fetch(batches):
        for batch in batches:
            for base in batch["base"]:
                lines = list(domain_lines(Rule(), base, "ex.org")) if domain_covered(Rule(), base, "ex.org") else []
                yield pd.DataFrame({"line": lines})

    f = F.split("line", " ")
    found = spark.createDataFrame([("http://i.rule/cdx",)], "base string").mapInPandas(fetch, "line string")
    return found.select(F.get(f, F.lit(2)).alias("url"), F.substring(F.get(f, F.lit(1)), 1, 4).alias("year"))


# --- stores

_PARTS = "SELECT 'u' || page_id AS url_id, url AS original_url FROM pages"


@query(f"{_PARTS} UNION ALL {_PARTS}")
def q_store_parts(spark, sf_dir):
    """Appended parts are one table, files that are no parts are passed over, a table without parts is empty."""
    store = Store(spark, files.scratch(spark, "parts"))
    rows = X.table(spark, sf_dir, "pages").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url_id"), F.col("url").alias("original_url"))
    store.append("urls", rows)
    store.append("urls", rows)
    files.write_text(spark, f"{store.path('urls')}/notes.tmp", "no part")
    empty = store.read("captures").select("url_id", F.col("memento_url").alias("original_url"))
    return store.read("urls").select("url_id", "original_url").unionByName(empty)


@query("SELECT 'u' || page_id AS url_id, CAST(length(url) AS BIGINT) AS n FROM pages")
def q_summary_file(spark, sf_dir):
    """The summary is one file, replaced as a whole."""
    store = Store(spark, files.scratch(spark, "summary"))
    rows = X.table(spark, sf_dir, "pages").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url_id"), F.length("url").cast("bigint").alias("n"))
    for df in (rows.limit(3), rows):
        store.write_summary(df)
    return spark.read.parquet(f"{store.out}/summary.parquet")
