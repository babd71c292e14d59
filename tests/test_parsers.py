from __future__ import annotations

import json

from chronofold.operators import parsers as P
from pyspark.sql import functions as F

HEAD = ["urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length"]
ROW = ["k", "20240102030405", "http://h/a", "text/html", "200", "D", "12"]


def parse(spark, text, f=P.index):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_table_with_moved_header(spark):
    text = json.dumps([HEAD[::-1], ROW[::-1], ["short"], [], [*ROW[::-1][:-2], "2024", "k"]])
    (c,) = parse(spark, text)
    assert (c.memento_url, c.status, c.digest, c.record_id, c.content_length, str(c.capture_time)) == ("http://h/a", "200", "D", "20240102030405", 12, "2024-01-02 03:04:05")


def test_table_without_length_and_with_null_status(spark):
    (c,) = parse(spark, json.dumps([["timestamp", "original", "statuscode"], ["20240102030405", "u", None]]))
    assert (c.content_length, c.status, c.digest) == (None, "None", "")


def test_empties(spark):
    assert parse(spark, "[]") == [] and parse(spark, json.dumps([HEAD])) == []
    for text, want in (("[]", True), (json.dumps([HEAD]), True), (json.dumps([HEAD, []]), True), (json.dumps([HEAD, ROW]), False), ("k 2024", None)):
        assert bool(parse(spark, text, P.is_empty)) == bool(want)


def test_lines_mixed(spark):
    lines = [
        "k 20240102030405 u1 m 200 D",
        "k 20240102030405 u2 m 200 D 7",
        "k 20240102030405 u3 m 200 D x 7",
        "k 20240102030405 u4 m 200 D x y 7 9 f",
        json.dumps({"timestamp": "20240102030405", "url": "u5", "mime": "m", "status": 200, "offset": "3", "length": "4"}),
        "",
        "nonsense",
        json.dumps({"timestamp": "2024"}),
    ]
    got = parse(spark, "\n".join(lines))
    assert [(c.memento_url, c.record_id, c.content_length, c.warc_file) for c in got] == [("u2", "20240102030405", 7, ""), ("u3", "20240102030405", None, ""), ("u4", "9:7", 7, "f"), ("u5", "3:4", 4, "")]
    assert got[3].status == "200"


def test_html_is_malformed(spark):
    df = spark.createDataFrame([("cdx", "<html>no</html>"), ("timemap", '<u>; rel="first memento"; datetime="x"'), ("timemap", "plain")], "k string, t string")
    c = F.when(F.col("k") == "cdx", P.index(F.col("t"))).otherwise(P.timemap(F.col("t")))
    assert [r[0] for r in df.select(P.is_malformed(F.col("k"), F.col("t"), c)).collect()] == [True, True, False]


def test_timemaps(spark):
    when = "Mon, 05 Feb 2024 10:11:12 GMT"
    text = f'<http://o>; rel="original",\n<http://m/1>; rel="first memento"; datetime="{when}",\n<http://m/2>; rel="memento"; datetime="{when}"'
    assert [c.memento_url for c in parse(spark, text, P.timemap)] == ["http://m/2"]
    text = json.dumps({"mementos": {"list": [{"datetime": when, "uri": "a"}, {"datetime": when}, {"datetime": "x", "uri": "b"}]}})
    assert [(c.memento_url, c.record_id) for c in parse(spark, text, P.timemap)] == [("a", when), ("", when)]
    assert parse(spark, "{}", P.timemap) == [] and parse(spark, "{broken", P.timemap) == []


def test_captures_as_text_and_back(spark):
    text = json.dumps([HEAD, ROW])
    df = spark.createDataFrame([(text,)], "t string").select(P.index(F.col("t")).alias("a"))
    r = df.select("a", P.from_text(P.to_text(F.col("a"))).alias("b")).first()
    assert r.a == r.b


def test_resume_keys(spark):
    for text, want in (
        (json.dumps([HEAD, ROW, ["key"]]), "key"),
        (json.dumps([HEAD, ROW]), None),
        ("a b\nc d\n\nkey two", "key two"),
        ("a b\nc d", None),
    ):
        assert parse(spark, text, P.split_resume).key == want
