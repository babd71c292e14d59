from __future__ import annotations

import gzip
from datetime import datetime, timezone

import pytest
from chronofold import schemas as S
from chronofold.operators import dedupe, discovery
from chronofold.plans import classify, pick
from chronofold.sources import candidates, raw, registry
from chronofold.sources.store import Store
from chronofold.sources.transport import Response
from chronofold.streaming import incremental
from pyspark.sql import functions as F

from tests.fakes import Net, archive

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def test_lists(spark, tmp_path):
    (tmp_path / "b.csv").write_text('url,first_observed_year,url_type\n http://a.com/x ,2011,DEEP\n,2012,\n"http://c.com/?q=a,b",,\n')
    (tmp_path / "a.csv").write_text("url\nhttp://A.com/x/\n")
    with gzip.open(tmp_path / "root-list.gz", "wt") as f:
        f.write("x k 20150101000000 http://r.com/ m 200\nx k 20150101000000 http://s.com/ m 404\nx k 20150101000000 http://t.com/ m -\nx k\n")
    rows = candidates.read(spark, [str(tmp_path)])
    got = [tuple(r)[:3] for r in rows.orderBy("file_ord", "line_ord").collect()]
    assert got == [("http://A.com/x/", "", "unknown"), ("http://a.com/x", "2011", "deep"), ("http://c.com/?q=a,b", "", "unknown"), ("http://r.com/", "2015", "root"), ("http://t.com/", "2015", "root")]
    store = Store(spark, str(tmp_path / "o"))
    assert pick.prepare(store, [str(tmp_path)], NOW) == {"added": 4, "skipped": 1, "rejected": 0}
    kept = {r.canonical_url: r for r in store.read("urls").collect()}
    assert kept["http://a.com/x"].original_url == "http://A.com/x/" and kept["http://a.com/x"].first_observed == NOW.isoformat()
    assert kept["http://r.com/"].first_observed == "2015-01-01T00:00:00+00:00"
    assert pick.prepare(store, [str(tmp_path)], NOW)["added"] == 0
    (tmp_path / "bad.csv").write_text("link\nx\n")
    with pytest.raises(ValueError):
        candidates.read(spark, [str(tmp_path / "bad.csv")])


def test_scope_and_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("url\nhttp://a.com/\nhttp://a.com/x\nhttp://[bad/\n")
    store = Store(spark, str(tmp_path / "o"))
    assert pick.write_urls(store, candidates.read(spark, [str(tmp_path / "a.csv")]), NOW, {"root"}) == {"added": 1, "skipped": 1, "rejected": 1}


def test_discovery(spark, tmp_path):
    rows = [["20120101000000", "http://www2.a.com/", "text/html"], ["20110101000000", "https://b.a.com/p", "text/html;x"], ["20100101000000", "https://b.a.com/p", "image/png"], ["20090101000000", "http://na.com/", "text/html"]]
    found = pick.discover(spark, "HTTP://A.com/", [archive()], Net(captures={"x": rows}), {"root", "hosts", "deep"})
    assert {(r.url, r.first_observed_year, r.url_type) for r in found.collect()} == {("https://a.com/", "2012", "root"), ("https://b.a.com/", "2010", "root"), ("https://b.a.com/p", "2011", "deep")}
    root = pick.discover(spark, "a.com", [archive()], Net(captures={"x": rows}), {"root"})
    assert [(r.url, r.first_observed_year) for r in root.collect()] == [("https://a.com/", "2012")]
    with pytest.raises(ValueError):
        pick.discover(spark, "a.com", [], Net(), {"root"})
    assert discovery.parse_scope("root, deep") == {"root", "deep"}
    with pytest.raises(ValueError):
        discovery.parse_scope("leaf")


def test_registry(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).mkdir()
        (tmp_path / name / registry.FILE).write_text(text)

    put("a", '[archive]\nname = "A"\nestablished = 2001 # x\n[api.cdx.query]\nendpoint = "http://a/{collection}/cdx?url={url}"\naccess = "online"\n[[archive.scope.collections]]\nid = "c1"\n[[archive.scope.collections]]\nid = "c2"\n')
    put("b", '[archive]\nid = "ia"\n[api]\nrate_limit = false\n[api.memento.timemap]\nendpoint = "http://b/{url}"\naccess = "offline"\n')
    put("c", "[archive]\nid = 'none'\n")
    put("d", '[archive]\nid = "d"\nestablished = "2003" # Backfill: began capturing in 2007\n[api.memento.timegate]\nendpoint = "http://d"\n')
    found = {a.id: a for a in registry.compile_all(tmp_path)}
    assert set(found) == {"a", "d", "ia"}
    assert found["a"].collections == ["c1", "c2"] and found["a"].listing_bases() == ["http://a/c1/cdx", "http://a/c2/cdx"]
    assert registry.established_years(tmp_path) == {"archive:a": 2001, "archive:d": 2007}
    assert registry.backfill_notes(tmp_path)[0]["mismatch"] is True
    assert [w.name for w in registry.witnesses(tmp_path, shards=2)] == ["live_web", "archive:a"]
    assert registry.witnesses(tmp_path, shards=2)[0].requests_per_second == 50
    assert registry.witnesses(tmp_path, rates={"a": 3.0})[1].requests_per_second == 3 and registry.witnesses(tmp_path, timeouts={"a": 7.0})[1].timeout_seconds == 7
    assert registry.table(spark, list(found.values())).count() == 3
    assert registry.display_name(["A", {"alt": "b"}]) == "A (b)" and registry.display_name(None) == "unknown"
    target = tmp_path / "t"
    (target / "old").mkdir(parents=True)
    assert registry.import_from(tmp_path, target) == 4 and not (target / "old").exists()


@pytest.mark.parametrize(
    ("line", "found"),
    [
        ('a.b = "x#y" # backfilled', ("a.b", "backfilled")),
        ("established = 2001#x ", ("established", "x")),
        ("# only a comment", None),
        ("a-b = 1 # no name", None),
        ("a = 1", None),
        ("a = 1 #  ", None),
    ],
)
def test_remarks(line, found):
    assert registry.remark(line) == found


@pytest.mark.parametrize(
    ("said", "found"),
    [("backfill; capturing began in 2012", 2012), ("began capture in 1999.", 1999), ("(Captures began in 2001)", 2001), ("began in 2001", None), ("captured pages began to age in 2001", None), ("began capturing in May", None)],
)
def test_years_in_remarks(said, found):
    assert registry.began(said) == found


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert not store.has_rows("captures") and store.read("events").schema == S.TABLES["events"]
    with pytest.raises(ValueError):
        store.path("nope")
    ev = spark.createDataFrame([("u", "state_S0", datetime(2024, 1, 1, 0, 0, 0, 900))], "url_id string, event_type string, event_end timestamp")
    assert store.replace("events", ev) == 1 and store.replace("events", ev.where("false")) == 0
    assert store.read("events").first().event_end == datetime(2024, 1, 1)
    (tmp_path / "parquet/events/x.tmp").write_text("junk")
    assert store.read("events").count() == 1
    store.append("urls", spark.createDataFrame([(f"{i:08x}", "u") for i in range(9)], "url_id string, original_url string"))
    rows, seen = store.load_urls(limit=5, shard=1, shards=2)
    assert seen == 5 and {r.url_id for r in rows.collect()} == {"00000001", "00000003"}
    assert store.export(str(tmp_path / "e")) == {"urls": 9, "observations": 0, "captures": 0, "events": 1}


def test_a_swap_that_was_cut_off(spark, tmp_path, monkeypatch):
    """A crash before or between the renames loses nothing: readers see whole events, the next writer goes on."""
    from chronofold.sources import files

    store = Store(spark, str(tmp_path))
    ev = lambda *ids: spark.createDataFrame([(i, "state_S0") for i in ids], "url_id string, event_type string")
    seen = lambda: sorted(r.url_id for r in Store(spark, str(tmp_path)).read("events").collect())
    store.replace("events", ev("a"))
    move, moves = files.move, []

    def crash(after):
        def moved(spark, source, target):
            if len(moves) == after:
                raise KeyboardInterrupt
            moves.append(target)
            move(spark, source, target)

        monkeypatch.setattr(files, "move", moved)
        moves.clear()
        with pytest.raises(KeyboardInterrupt):
            store.replace("events", ev("b", "c"))
        monkeypatch.setattr(files, "move", move)

    crash(1)
    assert seen() == ["a"]
    crash(2)
    assert seen() == ["b", "c"]
    assert store.replace("events", store.read("events").where("url_id = 'b'").unionByName(store.read("events").where("url_id = 'c'").withColumn("url_id", F.lit("d")))) == 2
    assert seen() == ["b", "d"] and store.replace("events", ev("e")) == 1 and seen() == ["e"]


def test_layers(spark, tmp_path, monkeypatch):
    """The last layer that speaks of a URL counts, also where it has no rows for it; layers are folded in, and end with a swap."""
    from chronofold.sources import store as module

    monkeypatch.setattr(module, "MOST_LAYERS", 2)
    store = Store(spark, str(tmp_path))
    ev = lambda **kinds: spark.createDataFrame([(u, k) for u, ks in kinds.items() for k in ks.split()], "url_id string, event_type string")
    ids = lambda *u: spark.createDataFrame([(x,) for x in u], "url_id string")
    seen = lambda: sorted((r.url_id, r.event_type) for r in store.read("events").collect())
    store.replace("events", ev(a="x y", b="x"))
    store.overlay("events", ids("a", "c"), ev(a="z", c="x"))
    assert seen() == [("a", "z"), ("b", "x"), ("c", "x")]
    store.overlay("events", ids("b", "c"), ev(c="w"))
    assert seen() == [("a", "z"), ("c", "w")] and len(store.layers("events")) == 2
    store.overlay("events", ids("d"), ev(d="x"))
    assert seen() == [("a", "z"), ("c", "w"), ("d", "x")] and len(store.layers("events")) == 1
    store.replace("events", ev(e="x"))
    assert seen() == [("e", "x")] and not store.layers("events")


def test_exports_of_many_rows_are_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path / "o"))
    store.append("urls", spark.createDataFrame([(f"{i:08x}", "u") for i in range(9)], "url_id string, original_url string"))
    assert store.export(str(tmp_path / "e"), files_of=5)["urls"] == 9
    assert (tmp_path / "e/urls.parquet").is_dir() and spark.read.parquet(str(tmp_path / "e/urls.parquet")).count() == 9


class Halting(Net):
    """Domain listings: one archive doesn't answer, one breaks off after its first page."""

    def get(self, url, timeout, limit=None):
        if "//gone.test" in url or "resumeKey" in url and "//torn.test" in url:
            return Response(503)
        answer = super().get(url, timeout, limit)
        return Response(200, answer.body + b"\n\nkey1") if "//torn.test" in url and "showResumeKey" in url else answer


def test_incomplete_discovery_is_told(spark, tmp_path):
    rows = [["20120101000000", "http://a.com/", "text/html"]]
    net = Halting(captures={"torn": rows, "whole": rows, "gone": rows})
    store = Store(spark, str(tmp_path))
    pick.prepare(store, ["a.com"], NOW, archives=[archive("torn"), archive("whole"), archive("gone")], transport=net, pause=lambda seconds: None)
    assert store.read("urls").count() == 1
    assert sorted((r.domain, r.listing, r.gap) for r in pick.incomplete(store).collect()) == [("a.com", "http://gone.test/cdx", "it didn't answer"), ("a.com", "http://torn.test/cdx", "it broke off")]
    other = Store(spark, str(tmp_path / "other"))
    pick.prepare(other, ["a.com"], NOW, archives=[archive("whole")], transport=net)
    assert pick.incomplete(other).count() == 0


def test_raw(spark, tmp_path):
    rows = spark.createDataFrame([("u", "w", NOW, '{"body":"abc","x":"1"}'), ("v", "w", NOW, ""), ("z", "y", NOW, '["t"]')], "url_id string, witness string, stored_at timestamp, payload string")
    raw.append(rows, str(tmp_path))
    assert {r.url_id: r.payload for r in raw.read(spark, str(tmp_path)).collect()} == {"u": '{"x":"1","body_length":"3"}', "z": '["t"]'}


def test_raw_segments_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "SEGMENT", 10 * (1000 + raw.FRAME))
    rows = spark.createDataFrame([(f"u{i}", "w", NOW, "x" * 1000) for i in range(35)], "url_id string, witness string, stored_at timestamp, payload string").coalesce(1)
    raw.append(rows, str(tmp_path))
    assert len(list((tmp_path / "raw/witness=w").glob("*.json.gz"))) == 4 and raw.read(spark, str(tmp_path)).count() == 35


def test_health_asks_for_no_body():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from chronofold.sources.transport import HttpTransport

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            asked.append(self.path)
            self.send_response(int(self.path[1:]))
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert [HttpTransport().healthy(f"{base}/{s}") for s in (200, 404, 503)] == [True, True, False] and len(asked) == 3
    server.shutdown()
    assert not HttpTransport().healthy("http://127.0.0.1:9/x", 0.5)


def test_trim_and_dedupe(spark):
    df = spark.createDataFrame([("k", i) for i in range(6)] + [("j", 1), ("j", 2), ("i", 1)], "k string, t int")
    got = sorted((r.k, r.t) for r in dedupe.trim_lifespan(df, ["k"], [F.col("t")]).collect())
    assert got == [("i", 1), ("j", 1), ("j", 2), ("k", 0), ("k", 1), ("k", 5)]
    assert {(r.k, r.t) for r in dedupe.last_wins(df, ["k"], [F.col("t")]).collect()} == {("i", 1), ("j", 2), ("k", 5)}
    assert dedupe.sample_rows(df, 3, "t").collect() == dedupe.sample_rows(df.orderBy(F.rand(3)), 3, "t").collect()


def test_stream_reclassifies_what_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "o"))
    cap = lambda u, d: spark.createDataFrame([(u, "a", NOW, "200", d)], "url_id string, archive string, capture_time timestamp, status string, digest string")
    store.append("captures", cap("u", "1").unionByName(cap("v", "1")))
    assert classify.classify(store, {}) == 2
    incremental.watch(store, {}, str(tmp_path / "c")).awaitTermination()
    store.append("captures", cap("u", "2"))
    incremental.watch(store, {}, str(tmp_path / "c")).awaitTermination()
    got = {(r.url_id, r.event_type) for r in store.read("events").collect()}
    assert ("u", "content_changed") in got and ("v", "state_S4") in got and ("v", "content_changed") not in got
