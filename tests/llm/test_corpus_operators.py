"""Operators over the corpus, against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from chronofold.llm import codesearch, linededup, mixing, packing, simhash
from chronofold.llm.components import components
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


# --- mixing


def waterfill(sizes, budget, cap, weights):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        over = [n for n in free if share[n] > cap * sizes[n]]
        if not over:
            return out | share
        for n in over:
            out[n] = cap * sizes[n]
            left -= out[n]
            free.discard(n)
    return out


@pytest.mark.parametrize("parts", ["1", "7"])
def test_mixing(spark, parts):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        s = rng.choice(["a"] * 6 + ["b", "B", "é", "~", None])
        n = rng.choice([0, 1, 5, 5, 5, 30, rng.randint(1, 400)])
        rows.append((i, " ".join("w" * rng.randint(1, 3) for _ in range(n)) if n or i % 2 else None, s))
    rows += [(i, None, "empty") for i in range(2000, 2005)] + [(7777, "same row", "b")] * 40
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = mixing.mix_report(docs_of(spark, rows).selectExpr("*", "1 as size", "2 as target")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = waterfill(sizes, 1.5, 2, (5, 2, 1))
    by_id = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * max(size(t) for _, t, x in rows if x == s), s
    test_mixing.seen = getattr(test_mixing, "seen", None) or sorted(got)
    assert sorted(got) == test_mixing.seen  # reruns agree, whatever the partitions


def test_documents_enter_with_their_expected_number(spark):
    rows = [(i, " ".join("w" * (1 + i % 7)), "x" if i % 3 else None) for i in range(30)]
    df = docs_of(spark, rows).select("doc_id", "text", "source")
    runs = [mixing.sample(df, seed=f"seed {k}").select("doc_id", F.lit(k).alias("k"), "__cf_copies", (F.col("__cf_target") / F.col("__cf_source_size")).alias("step")) for k in range(3)]
    assert all(0 <= r["__cf_copies"] <= 2 and abs(r["__cf_copies"] - r.step) < 1 for df in runs for r in df.collect())
    # The offset alone decides; over all offsets the mean number of copies is the step.
    u = np.array([spark.range(1).select(mixing.offset(F.lit("x"), f"s{k}")).first()[0] for k in range(3)])
    assert ((u > 0) & (u < 1)).all() and len(set(u)) == 3
    step, rank, u = 1.37, np.arange(50), (np.arange(4096) + 0.5)[:, None] / 4096
    assert np.allclose((np.floor(step * (rank + 1) + u) - np.floor(step * rank + u)).mean(axis=0), step, atol=1e-3)


def test_sql_of_mixing_on_a_fixture(spark):
    rng = random.Random(14)
    rows = [(rng.randrange(200) if i % 9 else None, " ".join(["w"] * rng.choice([0, 1, 3, 3, 90])) if i % 11 else None, rng.choice(["a", "b", "b", "é", None])) for i in range(400)]
    got = [tuple(r) for r in mixing.mix_report(docs_of(spark, rows)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    plain = lambda t: sorted(repr((*r[:3], round(r[3], 6), r[4])) for r in t)
    assert plain(got) == plain(con.execute(mixing.SQL).fetchall())


def test_mixed_rows_repeat(spark):
    df = docs_of(spark, [(i, "a b c", "x" if i % 4 else "y") for i in range(80)])
    report = {r.doc_id: r.taken // r.size for r in mixing.mix_report(df).collect()}
    got = [r.doc_id for r in mixing.mix(df).collect()]
    assert {i: got.count(i) for i in range(80)} == report and mixing.mix(df).columns == df.columns
    assert mixing.mix(df.where("false")).count() == mixing.mix_report(df.where("false")).count() == 0


# --- lines


def brute_lines(rows, passage=None):
    import hashlib

    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    docs = sorted({(i is None, i if i is not None else 0, t) for i, t in rows if t is not None}, key=lambda d: (d[0], d[1], h(d[2])))
    places = []
    for d in docs:
        ls = d[2].split("\n")
        hs = [h(x) for x in ls]
        r = [hs[i] if i == 0 else ((hs[i - 1] & (1 << 59) - 1) << 1) ^ hs[i] for i in range(len(ls))]
        a = 0
        for i in range(len(ls)):
            if i == len(ls) - 1 or (i and r[i] < r[i - 1] and r[i] <= r[i + 1]):
                if i > a and sum(bool(x.strip(" ")) for x in ls[a : i + 1]) >= 2:
                    places.append((d, a, i, "\n".join(ls[a : i + 1])))
                a = i + 1
        places += [(d, i, i, x) for i, x in enumerate(ls) if passage and len(x.split(" ")) > passage]
    first, gone = {}, defaultdict(set)
    for p in places:
        if p[3] in first:
            gone[p[0]] |= set(range(p[1], p[2] + 1))
        else:
            first[p[3]] = p
    return {(d[1] if not d[0] else None): "\n".join(x for i, x in enumerate(d[2].split("\n")) if i not in gone[d]) for d in docs}


def lines_corpus():
    rng = random.Random(8)
    passage = [f"shared line {i} of the passage" for i in range(12)]
    long = " ".join(f"word{i}" for i in range(60))
    rows = []
    for i in range(150):
        own = [f"own {rng.random()}" for _ in range(rng.randint(0, 15))]
        at = rng.randint(0, len(own))
        if i % 3 == 0:
            own[at:at] = passage
        if i % 5 == 0:
            own.append(long)
        if i % 7 == 0:
            own += ["rep"] * 9
        rows.append((i, "\n".join(own)))
    return rows + [(500, rows[0][1]), (501, ""), (502, None), (503, "\n\n\n"), (504, "\n\n\n"), (None, rows[3][1])]


@pytest.mark.parametrize("passage", [None, 50])
def test_line_dedup_against_brute_force(spark, passage):
    rows = lines_corpus()
    df = docs_of(spark, [(i, t, "s") for i, t in rows]).selectExpr("*", "1 as hash", "2 as first")
    out = linededup.dedup(df, passage_words=passage)
    assert out.columns == df.columns
    got, want = {r.doc_id: r.text for r in out.collect()}, brute_lines(rows, passage)
    assert len(got) == len(rows) and got[502] is None
    assert {i: t for i, t in got.items() if i != 502} == want
    assert sum(f"shared line {i}" in t for t in want.values() for i in (5, 6)) <= 4 and (got[500] == "" or not passage)
    assert (sum("word59" in t for t in want.values()) == 1) == bool(passage)
    assert linededup.dedup(df.where("false")).count() == 0


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    rows = lines_corpus()
    df = docs_of(spark, [(i, t, "s") for i, t in rows])
    monkeypatch.setattr(linededup, "unit_hash", lambda unit: F.substring(F.md5(unit), 1, 1))
    got = {r.doc_id: r.text for r in linededup.dedup(df).collect()}
    assert {i: t for i, t in got.items() if i != 502} == brute_lines(rows)


def test_repeated_rows_of_lines_stay_alike(spark):
    df = docs_of(spark, [(1, "a\nb\nc\nd", "s"), (1, "a\nb\nc\nd", "s"), (2, "a\nb\nc\nd", "s")])
    got = sorted((r.doc_id, r.text) for r in linededup.dedup(df).collect())
    assert got[0] == got[1] == (1, "a\nb\nc\nd") and len(got[2][1]) < 7


# --- SimHash


def brute_fp(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    counts = [sum(xxhash.xxh64_intdigest(x, 42) >> j & 1 for x in sh) for j in range(64)]
    return sum(1 << j for j in range(64) if 2 * counts[j] > len(sh))


def brute_components(fps, ids, radius=4):
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    lab = np.array(ids)
    while True:
        new = np.array([lab[near[i]].min() for i in range(len(a))])
        if (new == lab).all():
            return lab
        lab = new


@pytest.mark.parametrize("chunk", [2048, 3])
def test_simhash_against_brute_force(spark, monkeypatch, chunk):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A b"), (4, "a  B"), (5, "é É")]
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 60, 400]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [rows[-1], (9000, "x " * 60_000)]
    link = simhash.link
    monkeypatch.setattr(simhash, "link", lambda c, r: link(c, r, chunk))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, component_id int")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(df).collect())
    fps, ids = [brute_fp(t) for _, t in rows], [i for i, _ in rows]
    assert all(simhash.fingerprint(t) == f.to_bytes(8, "little") for (_, t), f in zip(rows, fps, strict=True))
    assert got == sorted((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(fps, ids), strict=True))
    assert simhash.groups(df.where("false")).count() == 0


def test_bit_sliced_comparison():
    rng = np.random.default_rng(1)
    for radius in (0, 1, 4, 6):
        sizes = rng.integers(2, 150, 12)
        codes = []
        for s in sizes:
            c = rng.integers(0, 2**63, max(1, s // 4), dtype=np.uint64)[rng.integers(0, max(1, s // 4), s)]
            for i in range(s):
                for _ in range(rng.integers(0, radius + 2)):
                    c[i] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
            codes.append(c)
        roots, first = simhash.local_roots(np.concatenate(codes), sizes, radius, most=500), 0
        for c in codes:
            assert (roots[first : first + len(c)] - first == brute_components(c, range(len(c)), radius)).all()
            first += len(c)


def test_segments_leave_no_pair_out():
    rng = random.Random(3)
    for n, tables in ((0, 15), (1 << 20, 15), (1 << 22, 35), (1 << 30, 70), (1 << 34, 126), (1 << 60, 210)):
        masks = simhash.segments(4, n)
        assert len(masks) == tables
        for _ in range(1000):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)


def test_components(spark):
    rng = random.Random(6)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101)], [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
        near = {n: {n} for n in nodes}
        for a, b in edges:
            if a != b:
                near[a].add(b)
                near[b].add(a)
        lab = {n: n for n in nodes}
        while (new := {n: min(lab[m] for m in near[n]) for n in nodes}) != lab:
            lab = new
        assert got == lab


# --- packing


def cuts_cost(at, cost, chosen, length):
    total, last = 0, 0
    for j in chosen:
        n = int(at[j]) - last
        assert n <= length
        total += packing.padding(n, length) + int(cost[j]) + packing.PER_WINDOW
        last = int(at[j])
    return total


def test_windows_are_optimal():
    rng = random.Random(2)
    for _ in range(300):
        length = rng.choice([4, 7, 16])
        at = np.cumsum([0] + [rng.randint(1, length) for _ in range(rng.randint(1, 14))])
        cost = np.array([rng.choice([0, 1, 5]) for _ in at])
        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + packing.padding(int(at[j] - at[i]), length) + int(cost[j]) + packing.PER_WINDOW for i in range(j) if at[j] - at[i] <= length)
        chosen = packing.solve(at, cost, length)
        assert chosen[-1] == len(at) - 1 and cuts_cost(at, cost, chosen, length) == best[len(at) - 1]


def check_pieces(rows, pieces, tokens=packing.tokenize):
    """Every document in order and whole, every sequence gapless; returns the sequences' lengths."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p[0], p[4]].append(p)
        sequences[p[5]].append((p[6], p[2]))
    lengths = []
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
        lengths.append(at)
    left = defaultdict(int)
    for i, t in rows:
        ids = np.append(tokens(t), 1).astype("<u4")
        left[i, len(ids), ids.tobytes()] += 1
    for (i, n, raw), times in left.items():
        ids, spans = np.frombuffer(raw, "<u4"), sorted(p[1:4] for p in docs[i, n])
        assert sum(s[1] for s in spans) == n * times
        for a, m, crc in spans:
            assert zlib.crc32(ids[a : a + m].tobytes()) == crc
    return lengths


def test_packing_rows(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["cat", "house.", "ring", "Über.", "blue\n", "x1"]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 3, 200, 900]))) for i in range(250)] + [(300, None), (301, "word " * 30_000), (302, "a" * 9000), (303, text(50)), (303, text(60))]
    rows[7] = rows[6]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, length int").repartition(3)
    monkeypatch.setattr(packing, "STRETCH", 20_000)
    got = [tuple(r) for r in packing.pack(df).collect()]
    lengths = check_pieces(rows, got)
    assert sum(map(packing.padding, lengths)) < 0.03 * sum(lengths)
    assert packing.pack(df.where("false")).count() == 0


def test_stretches_settle_everything():
    rng = random.Random(1)
    rows = [(i, "Some words here. " * rng.randint(0, 300)) for i in range(120)]
    p, out = packing.Packer(stretch=5000), []
    for i, t in rows:
        p.add(i, np.append(packing.tokenize(t), 1).astype(np.uint32))
        if p.full():
            out += p.pieces()
    out += p.pieces(True)
    check_pieces(rows, out)
    assert p.held == 0 and list(p.pieces(True)) == []


def test_ids_are_those_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    for n in range(400):
        bits = ["ab", " ", "é", "\n", "12", "!", "'s", "漢字", "😀", "​", "  ", "<|endoftext|"] + ["<|endoftext|>"] * (n % 2)
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
        assert packing.tokenize(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert 50256 in packing.tokenize("a <|endoftext|> b")


def test_stretches_cost_hardly_more_than_one_solve():
    rng = random.Random(12)
    rows = [(i, "Some words here, and more of them. " * rng.randint(0, 200)) for i in range(200)]

    def cost(stretch):
        p, out = packing.Packer(stretch=stretch), []
        for i, t in rows:
            p.add(i, np.append(packing.tokenize(t), 1).astype(np.uint32))
            if p.full():
                out += p.pieces()
        out += p.pieces(True)
        last, price, at = {}, {}, 0
        for piece in out:
            last[piece[5]] = last.get(piece[5], 0) + piece[2]
        for _, t in rows:
            where, penalty = packing.nodes(np.append(packing.tokenize(t), 1), packing.sentence_ends())
            price |= dict(zip((where + at).tolist(), penalty.tolist(), strict=True))
            at += int(where[-1])
        return sum(packing.padding(n) + packing.PER_WINDOW for n in last.values()) + sum(price[int(e)] for e in np.cumsum([last[k] for k in sorted(last)]))

    whole = cost(1 << 40)
    assert whole <= cost(40_000) <= whole + 0.02 * sum(len(packing.tokenize(t)) for _, t in rows)


# --- code search


def brute_top(rows, k):
    out = []
    for q, c in rows:
        if q % 20 == 0 and c is not None:
            near = sorted(((c ^ d) & (1 << 64) - 1).bit_count() * 10**9 + i for i, d in rows if d is not None)[:k]
            out += [(q, n + 1, x % 10**9, x // 10**9) for n, x in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_top_k_against_brute_force(spark, block):
    rng = random.Random(11)
    rows = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(300)]
    rows += [(i, rows[5][1] ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))) for i in range(300, 420)]
    rows += [(i, rows[40][1]) for i in range(420, 500)] + [(520, None), (521, None)]
    df = spark.createDataFrame([(i, c, 1) for i, c in rows], "id long, code long, distance int")
    got = codesearch.top_k(df, df.where("id % 20 = 0"), 7, "id", block=block)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 7)
    few = df.where("id < 3")
    assert codesearch.top_k(few, few, 7, "id").count() == 9 and codesearch.top_k(df.where("false"), df, 7, "id").count() == 0


def test_queries_of_one_code(spark):
    """Hundreds of queries share a code, as zero vectors do."""
    rows = [(20 * i, 5) for i in range(300)] + [(i, 5 ^ (1 << i % 60)) for i in range(1, 100) if i % 20]
    df = spark.createDataFrame(rows, "id long, code long")
    assert sorted(map(tuple, codesearch.top_k(df, df.where("id % 20 = 0"), 3, "id").collect())) == brute_top(rows, 3)


def test_sign_codes(spark):
    rows = [(0, [1.0, -1.0, 0.0]), (20, [-1.0] * 63 + [1.0]), (1, None), (2, []), (3, [1.0, None]), (4, [1.0] * 65), (5, [float("nan"), -0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.c for r in df.select("vec_id", codesearch.sign_code("embedding").alias("c")).collect()}
    assert got == {0: 5, 20: -(1 << 63), 1: None, 2: None, 3: None, 4: None, 5: 1}
    assert {r.query_id for r in codesearch.search_embeddings(df, 2).collect()} == {0, 20}


# --- registered SQL on a small fixture


def test_sql_of_lines_on_a_fixture(spark):
    rows = lines_corpus()
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[12][1]), (None, None), (3, rows[3][1]), (3, "own line\n" + rows[3][1])]
    got = [tuple(r) for r in linededup.dedup_report(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, con.execute(linededup.SQL).fetchall()))
