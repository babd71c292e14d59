"""Operators that work text by text, against brute force, round trips or held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from chronofold.llm import langid, ogg, pii, quality, secrets
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang"), more.get("source", "s"), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=3000, deadline=None)
@given(st.one_of(st.text("a@.1+- 25(0é", max_size=60), st.text("0123456789 -.+", max_size=60)))
def test_base_spans_are_the_patterns(t):
    assert pii.detect(t) == brute_pii(t)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail joe [at] corp [dot] com now", "email", "joe [at] corp [dot] com"),
        ("joe dot doe at corp dot com", "email", "joe dot doe at corp dot com"),
        ("x joe(at)corp.com y", "email", "joe(at)corp.com"),
        ("jоe@cоrp.com", "email", "jоe@cоrp.com"),
        ("j​oe@corp.com", "email", "j​oe@corp.com"),
        ("plus four four two zero seven nine four six oh nine five eight", "phone", "plus four four two zero seven nine four six oh nine five eight"),
        ("+４４ 2079460958 11", "phone", "+４４ 2079460958 11"),
        ("at one nine two dot one six eight dot one dot seven end", "ip", "one nine two dot one six eight dot one dot seven"),
        ("vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    _, added = pii.spans(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in added] == [(kind, source)]


@pytest.mark.parametrize("text", ["look at me. dot the i", "one two three", "the cat at home", "see at example.com", "", None, "price 1.5 at 3 dots", "ein zwei Polizei"])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == ([], [])


def test_pii_rows(spark):
    df = docs_of(spark, ["a@b.co 1.2.3.4", None, "", "x" * 300_000 + " a@b.co"]).selectExpr("*", "1 as spans", "2 as n_email")
    df = df.unionByName(df.where("doc_id = 0"))
    rows = pii.find_pii(df).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["email:0:6,ip:7:14"] * 2 + ["", "", "email:300001:300007"]
    assert rows[0].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest() and rows[0].n_email == rows[0].n_ip == 1
    assert pii.find_pii(df.where("false")).count() == 0
    assert pii.redact("a@b.co and joe [at] x [dot] org!") == "<email> and <email>!"


# --- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["password", "Token", "api_key", "=", ": ", '"', "deadbeef" * 4, "AKIA", "ABCDEFGHIJKL12", "é", "x", "secret", " ", "abc12345", "é😀", "\n", "aB3" * 9, "ghp_" + "a1" * 12]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) if i % 50 else None for i in range(1200)]
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_secrets(t or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]


def test_ownership_separates_copied_from_live(spark):
    key, copied = "token=Zx81kq9vBn2", "token=Qw73hh1pLm5"
    generic = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9St0c4"
    rows = [(0, key, "a"), (1, key + " again", "a"), (2, copied, "a"), (3, copied, "b"), (4, generic, "a"), (5, generic[:-1] + "5", "a"), (6, generic[:-1] + "5", "b"), (7, "token=changeme1234", "c"), (8, None, None), (8, None, None)]
    got = {}
    for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as hash", "2 as spans")).collect():
        got.setdefault(r.doc_id, []).append((r.n_live, r.n_copied, r.spans))
    assert [got[i][0][:2] for i in range(8)] == [(1, 0), (1, 0), (0, 1), (0, 1), (1, 0), (0, 0), (0, 0), (0, 1)]
    assert got[4][0][2] == "generic:0:32" and got[8] == [(0, 0, "")] * 2
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert secrets.find_secrets(empty).count() == 0


# --- Ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    return crc


@given(st.binary(max_size=200))
def test_checksum(data):
    assert ogg.checksum(data) == slow_crc(data)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(max_size=1200), min_size=1, max_size=8), st.integers(0, 3))
def test_packets_over_pages(packets, grow):
    packets = [p * 300 ** (grow == 3) for p in packets] if sum(map(len, packets)) < 2000 else packets
    w = ogg.Writer()
    w.packets(7, [(p, 10 * i + 10) for i, p in enumerate(packets)], first=True)
    w.packets(9, [(b"other", 1)], first=True, last=True)
    w.packets(7, [(b"tail", 999)], last=True)
    streams, bad = ogg.read(w.bytes())
    assert bad == 0 and streams[7].packets == [*packets, b"tail"] and streams[9].packets == [b"other"]
    assert streams[7].began and streams[7].ended and streams[7].granules[-1] == 999 and streams[7].lost == 0


def test_damaged_page_is_passed_over():
    payload = bytes(range(256)) * 1000
    data = bytearray(ogg.encode(payload))
    assert ogg.decode(bytes(data)).samples == payload
    data[len(data) // 2] ^= 1
    back = ogg.decode(bytes(data))
    assert back.bad >= 1 and back.lost == 1 and 0 < len(back.samples) < len(payload) and back.samples[:1000] == payload[:1000]
    assert ogg.decode(b"junk" + bytes(ogg.encode(b"x" * 576))).samples == b"x" * 576
    assert ogg.decode(b"").samples == b""


@pytest.mark.parametrize("packet", [100, 576, 4608, 70_000])
def test_times_of_packets(packet):
    payload = bytes(range(256)) * 900
    m = ogg.decode(ogg.encode(payload, packet=packet))
    starts = [(i / 8000, min(len(payload), i + packet) / 8000) for i in range(0, len(payload), packet)]
    assert m.times == starts and m.first == 0 and m.missing == 0 and m.noted == m.seconds == len(payload) / 8000


def test_times_around_a_damaged_page():
    payload = bytes(range(256)) * 2000
    data = bytearray(ogg.encode(payload))
    data[len(data) // 2] ^= 1
    m = ogg.decode(bytes(data))
    assert m.lost == 1 and m.seconds == len(payload) / 8000 and m.missing * 8000 == len(payload) - len(m.samples)
    for (a, b), data in zip(m.times, [m.samples[i : i + ogg.PACKET] for i in range(0, len(m.samples), ogg.PACKET)], strict=True):
        assert payload[round(a * 8000) : round(b * 8000)] == data


def test_media_rows(spark):
    texts = ["", None, "a", "é" * 288, "x" * 577, "y" * 200_000, "a"]
    rows = ogg.media_digest(docs_of(spark, texts).selectExpr("*", "0 as feature")).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded)) and r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-32:])
        assert r.feature.startswith(f"s={len(padded) / 8000:.6f};")
    assert rows[0][1:] == rows[1][1:] and rows[2][1:] == rows[6][1:]
    stored = ogg.store_media(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [hashlib.sha256(r.media).hexdigest() for r in stored] == [r.media_sha256 for r in rows]


# --- language

WORDS = {"en": "the of and to in is that for it with as was", "de": "der die und das nicht von mit ein ist auch sich", "fr": "le la les des et une est pour dans que qui"}


def prose(lang, rng, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "er", "on"]) for _ in range(n))


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(1)
    rows = [(lang, prose(lang, rng, rng.randint(5, 60))) for lang in WORDS for _ in range(120)]
    return langid.train([t for _, t in rows], [lang for lang, _ in rows])


def test_language_of_held_out_texts(languages):
    rng = random.Random(2)
    rows = [(lang, prose(lang, rng, 30)) for lang in WORDS for _ in range(60)]
    got = [languages.predict(t) for _, t in rows]
    assert np.mean([g[0] == lang for g, (lang, _) in zip(got, rows)]) > 0.97 and all(0 <= g[1] <= 1 for g in got)
    assert np.mean([g[2] for g in got]) > 0.95


def test_language_edges(languages):
    for t in (None, "", "123 ... !", "\n\n"):
        assert languages.predict(t) == ("und", 0.0, False)
    long = prose("de", random.Random(3), 400_000)
    assert languages.predict(long)[0] == "de"
    assert langid.train([], []).predict("text") == ("und", 0.0, False)
    assert langid.train(["abc def"], ["xx"]).predict("anything")[0] == "xx"
    a = languages.scores(prose("fr", random.Random(4), 20))
    assert a.sum() == pytest.approx(1)


def test_language_rows(spark):
    rng = random.Random(5)
    rows = [(i, prose(lang, rng, 20), lang, "s", 1) for i, lang in enumerate(list(WORDS) * 100)] + [(None, "the of and", None, None, None), (900, None, "en", "s", 0), (901, "the and of to", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as score", "2 as accepted")
    got = {r.doc_id: r for r in langid.predict_all(df).collect()}
    assert len(got) == len(rows)
    for i, _, lang, *_ in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [r for r in rows[:300] if got[r[0]].held_out]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert got[900].lang_pred == "und" and got[None].lang_pred in WORDS and not got[None].held_out
    kept = langid.keep_accepted(df, langid.fit(df))
    assert kept.columns == df.columns and 900 not in {r.doc_id for r in kept.collect()} and kept.count() > 290
    assert langid.predict_all(df.where("false")).count() == 0


def test_labels_of_held_out_rows_are_never_learned(spark):
    rng = random.Random(6)
    rows = [(i, prose(lang, rng, 20), lang, "s", 1) for i, lang in enumerate(list(WORDS) * 60)]
    lied = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, "t", 2) for i, t, lang, *_ in rows]
    a, b = (sorted(langid.predict_all(spark.createDataFrame(x, DOCS)).collect()) for x in (rows, lied))
    assert a == b


# --- quality


def graded(rng, g):
    base = [rng.choice("the of and to in is that for it with".split()) for _ in range(40)]
    if g == 0:
        base[rng.randrange(40)] = rng.choice(["awful", "nasty"])
    if g == 1:
        base = [w.upper() + "!!" for w in base]
    return " ".join(base)


def test_grades_of_held_out_texts():
    rng = random.Random(1)
    rows = [(g, graded(rng, g)) for g in (0, 1, 2) for _ in range(200)]
    m = quality.train([t for _, t in rows], [g for g, _ in rows])
    assert (np.diff(m.thresholds) > 0).all()
    got = Counter((g, int((m.tails(graded(rng, g)) >= 0.5).sum())) for g in (0, 1, 2) for _ in range(60))
    assert sum(got[g, g] for g in range(3)) > 165
    assert m.tails(None).shape == (2,) and (np.diff(m.tails("x " * 100_000)) <= 0).all()


def test_gradients_are_those_of_the_likelihood():
    """One text, one step: the weights move against the numerical gradient of the cumulative-link loss."""
    for g in range(3):
        m = quality.train(["alpha beta gamma"], [g], epochs=1, decay=0.0, least_texts=0, least_z=0.0)
        x = quality.features("alpha beta gamma")

        def loss(score, g=g):
            up = [1.0, *quality.sigmoid(score - np.array([-1.0, 0.0])), 0.0]
            return -np.log(up[g] - up[g + 1])

        slope = (loss(1e-5) - loss(-1e-5)) / 2e-5
        assert (np.sign(m.weights[x]) == -np.sign(slope)).all()
        want = -slope / np.sqrt(1e-2 + slope**2) / np.sqrt(len(x))
        assert np.allclose(m.weights[x], want, rtol=1e-3)


def test_few_telling_words_are_learned_among_many():
    """Words that stand in a tenth of the texts decide, whatever hundreds of others a text has."""
    rng = random.Random(7)
    common = [f"w{i}" for i in range(3000)]

    def text(g):
        words = [rng.choice(common) for _ in range(200)]
        words[rng.randrange(200)] = rng.choice(["awful", "nasty", "rotten"]) if g == 0 else "plain"
        return " ".join(words)

    rows = [(g, text(g)) for g in [0] * 80 + [2] * 700]
    m = quality.train([t for _, t in rows], [g for g, _ in rows])
    assert np.mean([m.tails(text(0))[0] < 0.5 for _ in range(100)]) > 0.9 and np.mean([m.tails(text(2))[0] >= 0.5 for _ in range(100)]) > 0.95


def test_quality_rows(spark):
    rng = random.Random(2)
    texts = [graded(rng, i % 3) for i in range(300)] + [None, ""]
    df = docs_of(spark, texts).selectExpr("*", "1 as selected", "2 as quality")
    ratings = spark.createDataFrame([(i, int(i % 3 == 2), int(i % 3 == 0), "x") for i in range(250)] + [(None, 1, 0, "x"), (300, 1, 0, "x"), (7, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    m = quality.fit(df, ratings, quality.grade_of())
    rows = {r.doc_id: r for r in quality.rate(df, m).collect()}
    assert len(rows) == 302 and np.mean([rows[i].selected == (i % 3 == 2) for i in range(250, 300)]) > 0.9
    assert {i for i, r in rows.items() if r.held_out} == {i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    lied = ratings.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(1)).otherwise(F.col("toxic")))
    assert (quality.fit(df, lied, quality.grade_of()).weights == m.weights).all()
    assert all(0 <= r.p_ge2 <= r.p_ge1 <= 1 and r.expected_grade == pytest.approx(r.p_ge1 + r.p_ge2) for r in rows.values())
    empty = quality.fit(df, ratings.where("false"), quality.grade_of())
    assert quality.rate(df, empty).count() == 302 and quality.rate(df.where("false"), m).count() == 0
