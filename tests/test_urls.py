from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from chronofold.functions import suffix, times
from chronofold.functions import urls as U
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(1)
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


GOLDEN = {
    "HTTP://Ex.com:80/a//?b=&a=1&utm_source=x&b=0&c": "http://ex.com/a?a=1&b=&b=0&c=",
    "https://u:P@Ex.com:443/%7Ea/?q=a+b%20c~*": "https://u:p@ex.com/%7Ea?q=a+b+c~%2A",
    "http://x.com/;p?a=%zz&é=1": "http://x.com/;p?a=%25zz&%C3%A9=1",
    "https://h/a#frag": "https://h/a",
    "http://h//": "http://h/",
    "example.com/x": "http:example.com/x",
    "http://[bad/": None,
    "http://h/?UTM_SOURCE=1": "http://h/?UTM_SOURCE=1",
    "": "http:///",
    " https://h/\ta\n ": "https://h/a",
    "http://h/?a=%FF": "http://h/?a=%EF%BF%BD",
    None: None,
}


def test_canonical_golden(spark):
    assert column(spark, list(GOLDEN), U.canonical) == list(GOLDEN.values())


def model(url):
    """The same rules over the standard library, as a double."""
    p = urlsplit(url.strip())
    scheme = (p.scheme or "http").lower()
    where = p.netloc.lower().removesuffix({"http": ":80", "https": ":443"}.get(scheme, "\0"))
    pairs = sorted(x for x in parse_qsl(p.query, keep_blank_values=True) if x[0] not in U.TRACKING)
    return urlunsplit((scheme, where, p.path.rstrip("/") or "/", urlencode(pairs), ""))


def model_match(url):
    try:
        p = urlsplit(url if "://" in url else "http://" + url)
        port = p.port
    except ValueError:
        return url.lower()
    host = (p.hostname or "").rstrip(".")
    head, _, rest = host.partition(".")
    if head.startswith("www") and (head[3:].isdigit() or head == "www") and rest != "" or (host.startswith("www.")):
        host = rest
    query = urlencode(sorted(parse_qsl(p.query, keep_blank_values=True)))
    return (host + (f":{port}" if port and port not in (80, 443) else "") + (p.path.rstrip("/") or "/") + ("?" + query if query else "")).lower()


piece = st.text("abzAZ09.-_~%/:=&?#+*é@ ", max_size=12)
urls = st.builds(lambda s, h, p, q: f"{s}{h}/{p}?{q}", st.sampled_from(["http://", "https://", "HTTP://", "ftp://"]), st.sampled_from(["h", "Ex.com:80", "Ex.com:443", "u@www2.Ex.com.:8080", "www.a.b"]), piece, piece)


@settings(max_examples=4, deadline=None)
@given(st.lists(urls, min_size=60, max_size=60))
def test_canonical_and_match_key_like_the_library(spark, values):
    assert column(spark, values, U.canonical) == [model(v) for v in values]
    assert column(spark, values, U.match_key) == [model_match(v) for v in values]


def test_canonical_is_idempotent(spark):
    once = [v for v in column(spark, list(GOLDEN), U.canonical) if v and "://" in v]
    assert column(spark, once, U.canonical) == once


def test_keys(spark):
    assert column(spark, ["www2.Ex.com.", "http://u:p@WWW.a.b:81/x", "http://[::1]:80/", "http://[bad/"], U.host_key) == ["ex.com", "a.b", "::1", ""]
    assert column(spark, ["http://h:x/", "http://h:99999/A"], U.match_key) == ["http://h:x/", "http://h:99999/a"]


def test_suffixes(spark):
    hosts = ["a.b.co.uk", "x.example.com", "www.ck", "a.b.ck", "city.kawasaki.jp", "a.b.kawasaki.jp", "nowhere.invalidtld", "u@h.de:81", ""]
    df = suffix.with_suffix(spark.createDataFrame([(h,) for h in hosts], "d string"), F.col("d"))
    assert {r.d: r.tld for r in df.collect()} == dict(zip(hosts, [".co.uk", ".com", ".ck", ".b.ck", ".kawasaki.jp", ".b.kawasaki.jp", "", ".de", ""], strict=True))


def test_a_missing_suffix_list_is_an_error(spark, monkeypatch):
    class NoJvm:
        @property
        def _jvm(self):
            raise AttributeError("no JVM")

    known = suffix.parse_rules(suffix.list_text(spark))
    # The jar that Spark's client comes in may have an older edition than the JVM finds first.
    assert len(known) > 5000 and len(set(suffix.parse_rules(suffix.list_text(NoJvm()))) & set(known)) > 5000
    monkeypatch.setattr(suffix, "_jars", lambda: iter(()))
    assert suffix.parse_rules(suffix.list_text(spark)) == known  # from the JVM, wherever its jars lie
    with pytest.raises(FileNotFoundError):
        suffix.list_text(NoJvm())
    with pytest.raises(ValueError):
        suffix.parse_rules("// nothing\n")


def test_times(spark):
    got = column(spark, ["20240229", "2024", "20240230000000", "2024-02-29T12:30:00", None, "x"], lambda c: times.timestamp14(c).cast("string"))
    assert got == ["2024-02-29 00:00:00", None, None, "2024-02-29 12:30:00", None, None]
    got = column(spark, ["Mon, 05 Feb 2024 10:11:12 GMT", "Sun, 05 Feb 2024 10:11:12 GMT", "Mon, 05 Feb 2024 10:11:12 +0000", " 20240229 ", "x"], lambda c: times.memento_time(c).cast("string"))
    assert got == ["2024-02-05 10:11:12", "2024-02-05 10:11:12", None, "2024-02-29 00:00:00", None]
    assert column(spark, ["2013", "2010x", "abc", "", None], times.cohort) == ["2010-2014", "2010-2014", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_shards_are_complete(spark, shards):
    ids = column(spark, [f"http://h/{i}" for i in range(200)], lambda c: U.url_id(U.canonical(c)))
    got = column(spark, ids, lambda c: U.shard(c, shards))
    assert set(got) == set(range(shards)) and got == [int(i[:8], 16) % shards for i in ids]
