from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from chronofold import cli
from chronofold import schemas as S
from chronofold.functions import urls as U
from chronofold.operators import checkpoints as C
from chronofold.operators import limits
from chronofold.operators.limits import Guard, Terms, delay
from chronofold.plans import classify, collect, pick
from chronofold.sources import raw
from chronofold.sources.clients import ArchiveClient, LiveClient
from chronofold.sources.registry import Witness
from chronofold.sources.store import Store
from chronofold.sources.transport import FetchError, Response
from pyspark.sql import functions as F

from tests.fakes import Net, archive

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
LIVE = Witness(S.LIVE, 1e6, 1.0)


def witness(a):
    return Witness(f"archive:{a.id}", 1e6, 1.0, a)


class Clock:
    """Time that passes when someone waits."""

    def __init__(self):
        self.t = NOW

    def now(self):
        self.t += timedelta(seconds=1)
        return self.t

    def pause(self, s):
        self.t += timedelta(seconds=max(s, 700))


def options(**more):
    c = Clock()
    return collect.Options(now=c.now, pause=c.pause, tasks=2, **more)


def store_of(spark, tmp_path, urls):
    store = Store(spark, str(tmp_path / "out"))
    rows = spark.createDataFrame([(u, "2020", "unknown", 0, i) for i, u in enumerate(urls)], "url string, first_observed_year string, url_type string, file_ord int, line_ord int")
    pick.write_urls(store, rows, NOW)
    return store


def row(t, url, status="200", digest="D", n="10"):
    return [t, url, "text/html", status, digest, n]


def states(store):
    view = C.view(store.read("checkpoints")).join(store.read("urls").select("url_id", "original_url"), "url_id")
    return {(r.original_url, r.witness): (r.state, r.attempts, r.last_error_class) for r in view.collect()}


def test_success_failure_and_resume(spark, tmp_path):
    urls = ["http://a.com/1", "http://b.com/2", "http://dead.com/3"]
    store = store_of(spark, tmp_path, urls)
    net = Net(pages={urls[0]: (200, b"hello"), urls[1]: (500, b"")}, captures={"x": [row("20200101000000", urls[0]), row("20990101000000", urls[0])]}, dead_hosts=("dead.com",))
    counts = collect.collect(store, [LIVE, witness(archive())], net, options(stop_early=False))
    assert counts["permanent_failure"] == 1 and counts["retried"] == 2 and counts["success"] == 5
    obs = {(r.url_id, r.observer): r for r in store.read("observations").collect()}
    ids = {r.original_url: r.url_id for r in store.read("urls").collect()}
    a = obs[ids[urls[0]], "live_web"]
    assert (a.status, a.content_length, a.mime_type, a.content_digest[:7]) == (S.ALIVE, 5, "text/html", "sha256:")
    assert obs[ids[urls[1]], "live_web"].status == S.GONE
    d = obs[ids[urls[2]], "live_web"]
    assert (d.status, d.error_class, d.confidence) == (S.GONE, "dns_failure", 0.0)
    assert obs[ids[urls[1]], "archive:x"].status == S.NO_EVIDENCE
    assert [r.record_id for r in store.read("captures").collect()] == ["20200101000000"]  # the future one is gone
    assert states(store)["http://dead.com/3", "live_web"] == (S.FAILED, 3, "dns_failure")
    again = collect.collect(store, [LIVE, witness(archive())], net, options(stop_early=False))
    assert again["queried"] == 0
    kept = {r.witness: json.loads(r.payload) for r in raw.read(spark, store.out).where(F.col("url_id") == ids[urls[0]]).collect()}
    assert kept["live_web"]["content_length"] == 5 and "20990101000000" in kept["archive:x"][0]


def test_retry_starts_anew(spark, tmp_path):
    store = store_of(spark, tmp_path, ["http://a.com/1"])
    w = witness(archive())
    collect.collect(store, [w], Net(broken={"x": 403}), options())
    assert states(store)["http://a.com/1", "archive:x"] == (S.FAILED, 1, "client_error")
    assert store.read("observations").first().status == S.UNRESOLVED
    net = Net(captures={"x": [row("20200101000000", "http://a.com/1")]})
    assert collect.collect(store, [w], net, options())["queried"] == 0
    assert collect.collect(store, [w], net, options(retry_failed=True))["success"] == 1
    assert states(store)["http://a.com/1", "archive:x"] == (S.SUCCESS, 1, None)


def test_early_stop(spark, tmp_path):
    urls = ["http://a.com/1", "http://b.com/2"]
    store = store_of(spark, tmp_path, urls)
    counts = collect.collect(store, [LIVE, witness(archive())], Net(pages={urls[0]: (200, b"x"), urls[1]: (404, b"")}), options())
    assert counts["skipped_early_stop"] == 1
    assert states(store)[urls[0], "archive:x"] == (S.SKIPPED, 0, None) and states(store)[urls[1], "archive:x"][0] == S.SUCCESS


@pytest.mark.parametrize("lists", [True, False])
def test_host_listings(spark, tmp_path, lists):
    urls = [f"http://www.a.com/{i}" for i in range(4)]
    store = store_of(spark, tmp_path, urls)
    rows = [row(f"202{j}0101000000", u) for u in urls[:3] for j in range(4)]
    counts = collect.collect(store, [witness(archive())], Net(captures={"x": rows}, lists_hosts=lists), options(history="lifespan"))
    assert counts["batched"] == (4 if lists else 0) and counts["success"] == 4
    years = {}
    for r in store.read("captures").join(store.read("urls"), "url_id").collect():
        years.setdefault(r.original_url, set()).add(r.capture_time.year)
    assert years == {u: {2020, 2021, 2023} for u in urls[:3]}
    assert store.read("observations").count() == 1  # nothing known of the fourth


def test_failed_listing_falls_back_to_urls(spark, tmp_path):
    urls = [f"http://a.com/{i}" for i in range(3)]
    store = store_of(spark, tmp_path, urls)
    counts = collect.collect(store, [witness(archive())], Net(captures={"x": [row("20200101000000", u) for u in urls]}, fails_hosts=True), options())
    assert counts["batched"] == 0 and counts["success"] == 3 and store.read("captures").count() == 3
    assert [tuple(r) for r in spark.read.parquet(f"{store.out}/single-hosts").collect()] == [("archive:x", "a.com")]


def test_html_answer_is_malformed(spark, tmp_path):
    class Html(Net):
        def get(self, url, timeout, limit=None):
            return Response(200, b"<html>busy</html>", url)

    store = store_of(spark, tmp_path, ["http://a.com/1"])
    collect.collect(store, [witness(archive())], Html(), options())
    assert states(store)["http://a.com/1", "archive:x"][::2] == (S.FAILED, "malformed_response")


def test_unreachable_witness_is_left(spark, tmp_path):
    urls = [f"http://h{i}.com/" for i in range(6)]
    store = store_of(spark, tmp_path, urls)
    o = options(stop_early=False)
    o.tasks = 1
    counts = collect.collect(store, [witness(archive())], Net(broken={"x": "timeout"}), o)
    assert counts["skipped_circuit_open"] > 0 and counts["success"] == 0


def test_paged_answers(spark):
    pages = {None: [["timestamp", "original"], ["1", "a"], ["k1"]], "k1": [["timestamp", "original"], ["2", "a"], ["k2"]], "k2": [["3", "a"]]}

    class Paged(Net):
        def get(self, url, timeout, limit=None):
            key = url.partition("resumeKey=")[2] or None
            return Response(200, json.dumps(pages[key]).encode())

    ((kind, text),) = ArchiveClient(archive(), Paged(), 1.0).query("a")
    assert kind == "cdx" and json.loads(text) == [["timestamp", "original"], ["1", "a"], ["2", "a"], ["3", "a"]]


def test_cut_off_listing_is_not_trusted():
    class Cut(Net):
        def get(self, url, timeout, limit=None):
            if "showNumPages" in url:
                return Response(200, b"")
            n = 5000 if "limit=" in url else 10000
            return Response(200, json.dumps([["timestamp", "original"], *[["1", "a"]] * n]).encode())

    assert ArchiveClient(archive(), Cut(), 1.0).host_pages("a.com") is None


def test_remembered_dns_failure_is_not_penalised():
    c = LiveClient(Net(dead_hosts=("d.com",)), 1.0, clock=lambda: 0.0)
    found = []
    for _ in range(2):
        with pytest.raises(FetchError) as e:
            c.query("http://d.com/")
        found.append(e.value.penalise)
    assert found == [True, False]


def test_limits():
    now = [0.0]
    waits = []
    g = Guard(Terms(10), clock=lambda: now[0], pause=waits.append)
    g.wait()
    g.wait()
    assert waits == [pytest.approx(0.1)]
    spacing = lambda: g.terms.spacing * g.state.stretch
    for _ in range(500):
        g.learn()
    assert spacing() == pytest.approx(0.025)
    for _ in range(50):
        g.learn(counts=False, strain=limits.HARD)
    assert spacing() == pytest.approx(1.0) and not limits.is_shut(g.state)
    b = Guard(Terms(10, 2, 120), clock=lambda: now[0])
    b.learn(True, 1.0)
    b.learn()
    b.learn(True, 1.0)
    assert not limits.is_shut(b.state)
    b.learn(True, 1.0)
    assert limits.is_shut(b.state) and not limits.may_look(b.state, b.terms, 0.0) and not b.lets_through(lambda: True)
    now[0] = 121
    assert limits.may_look(b.state, b.terms, 121) and not b.lets_through(lambda: False)
    assert not limits.may_look(b.state, b.terms, 121) and b.state.looks == 1
    now[0] = 242
    assert b.lets_through(lambda: True) and b.state.streak == b.state.looks == 0
    assert delay("timeout", 3, lambda a, b: b) == 8 and delay("timeout", 9, lambda a, b: b) == 30 and delay("odd", 1, lambda a, b: b) == 5


def test_ways_to_turn_pages():
    """Numbered pages, keys, all at once; a history without end and a listing that is too big give nothing."""

    def client(answer):
        class Server(Net):
            def get(self, url, timeout, limit=None):
                asked.append(url.split("output=json")[1])
                return Response(200, answer(url).encode())

        return ArchiveClient(archive(), Server(), 1.0)

    table = lambda n, key=None: json.dumps([["timestamp", "original"], *[["1", "a"]] * n, *([[key]] if key else [])])
    asked = []
    assert client(lambda u: "3" if "NumPages" in u else table(2)).host_pages("h") == [json.dumps(json.loads(table(2)))] * 3
    assert asked == ["&showNumPages=true", "&page=0", "&page=1", "&page=2"]
    assert client(lambda u: "50000" if "NumPages" in u else table(2)).host_pages("h") is None
    asked = []
    c = client(lambda u: "no" if "NumPages" in u else table(7001) if "limit" not in u else table(5000))
    assert [len(json.loads(t)) for t in c.host_pages("h")] == [7002] and c.way == "at_once"
    assert len(c.host_pages("i")) == 1 and asked[-1] == "" and sum("NumPages" in a for a in asked) == 1
    asked = []
    c = client(lambda u: "" if "NumPages" in u else table(1) if "resumeKey=k" in u else table(5000, "k"))
    assert [len(json.loads(t)) for t in c.host_pages("h")] == [5001, 2] and c.way == "by_key"
    n = [0]

    def endless(url):
        n[0] += 1
        return table(1, f"k{n[0]}")

    with pytest.raises(FetchError):
        client(endless).query("a")
    assert client(lambda u: table(1, "same")).query("a") == [("cdx", table(2))]
    assert client(lambda u: "<html>").query("a") == [("cdx", "<html>")]


def test_checkpoints(spark):
    rows = [("u", "w", S.RETRY, "timeout"), ("u", "w", S.RETRY, None), ("u", "w", S.SUCCESS, None), ("v", "w", S.SKIPPED, None), ("z", "w", S.FAILED, "not_found")]
    log = C.mark(spark.createDataFrame([(*r, i, NOW) for i, r in enumerate(rows)], "url_id string, witness string, state string, error_class string, seq bigint, updated_at timestamp"))
    got = {r.url_id: (r.state, r.attempts, r.last_error_class) for r in C.view(log).collect()}
    assert got == {"u": (S.SUCCESS, 3, "timeout"), "v": (S.SKIPPED, 0, None), "z": (S.FAILED, 1, "not_found")}
    assert {r.url_id for r in C.view(log.unionByName(C.retry_failures(C.view(log), ["w"], 9))).collect()} == {"u", "v"}


def test_shards_and_modes(spark, tmp_path):
    assert collect.parse_shard("1/4", {}) == (1, 4) and collect.parse_shard(None, {}) == (0, 1)
    assert collect.parse_shard("auto", {"SLURM_ARRAY_TASK_ID": "7", "SLURM_ARRAY_TASK_COUNT": "4", "SLURM_ARRAY_TASK_MIN": "1", "SLURM_ARRAY_TASK_STEP": "2"}) == (3, 4)
    assert collect.parse_shard("auto", {"SGE_TASK_ID": "3", "SGE_TASK_FIRST": "1", "SGE_TASK_LAST": "5"}) == (2, 5)
    assert collect.parse_shard("auto/3", {"PBS_ARRAY_INDEX": "2"}) == (2, 3)
    assert collect.parse_shard("auto", {"LSB_JOBINDEX": "1", "LSB_JOBINDEX_END": "2"}) == (0, 2)
    for text, env in (("4/4", {}), ("x", {}), ("auto", {}), ("auto", {"PBS_ARRAYID": "1"})):
        with pytest.raises(ValueError):
            collect.parse_shard(text, env)
    store = Store(spark, str(tmp_path))
    collect.claim_history(store, "lifespan")
    collect.claim_history(store, "lifespan")
    with pytest.raises(ValueError):
        collect.claim_history(store, "full")
    built = []
    assert collect.build_once(store, lambda: built.append(1)) and not collect.build_once(store, lambda: built.append(1)) and built == [1]


DESCRIPTOR = """
[archive]
id = "x"
name = ["Example", {en = "Ex"}]
established = "2010"  # backfilled; capturing began in 2012
[api]
rate_limit = true
[api.cdx.query]
endpoint = "http://x.test/cdx?url={url}"
access = "online"
"""


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src/x").mkdir(parents=True)
    (tmp_path / "src/x/web-archive.txt").write_text(DESCRIPTOR)
    base = ["--output", str(tmp_path / "o"), "--registry", str(tmp_path / "r")]
    net = Net(captures={"x": [row("20110101000000", "http://www.a.com/p", "404"), row("20150101000000", "http://a.com/"), row("20160101000000", "http://b.org/")]})
    go = lambda *a: cli.main([*base, *a], spark, net)
    assert go("fetch-archives", "--source", str(tmp_path / "src")) == 0
    assert go("list-archives") == 0 and "Example (Ex)" in capsys.readouterr().out
    assert go("run", "--input", "a.com", "--changes", "--workers", "2") == 0
    urls = {r.original_url: r for r in spark.read.parquet(str(tmp_path / "o/parquet/urls")).collect()}
    assert set(urls) == {"https://a.com/", "http://www.a.com/p"}
    assert urls["http://www.a.com/p"].entry_cohort == "2010-2014" and urls["http://www.a.com/p"].tld == ".com"
    assert go("classify") == 0
    summary = {r.original_url: r for r in spark.read.parquet(str(tmp_path / "o/summary.parquet")).collect()}
    p = summary["http://www.a.com/p"]
    assert (p.n_captures, p.n_independent_archives, p.current_state) == (1, 0, "S4")
    assert go("export", "--out", str(tmp_path / "e")) == 0 and (tmp_path / "e/captures.parquet").is_file()
    assert go("run", "--input", "a.com") == 1  # the folder holds full histories
    assert go("run", "--changes", "--witnesses", "nobody") == 1
