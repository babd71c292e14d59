"""Near-duplicates by SimHash and exact check, against brute force over true similarities."""

from __future__ import annotations

import random
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
from chronofold.llm import similar

from tests.llm.test_corpus_operators import docs_of


def brute_sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_groups(rows):
    """The least number reachable over pairs with a similarity of 0.8 or more."""
    s = brute_sets(rows)
    near = [[i for i in range(len(s)) if s[i] == s[j] or (s[i] & s[j] and Fraction(len(s[i] & s[j]), len(s[i] | s[j])) >= Fraction(4, 5))] for j in range(len(s))]
    lab = np.array([i for i, _ in rows])
    while True:
        new = np.array([lab[n].min() for n in near])
        if (new == lab).all():
            return dict(zip((i for i, _ in rows), lab.tolist(), strict=True))
        lab = new


def corpus():
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(3000)], [(0, None), (1, ""), (2, " one"), (3, "ONE"), (4, "spam " * 300 + "a b c d e"), (5, "spam " * 300)]
    common = [rng.choice(words) for _ in range(40)]
    for g in range(70):
        base = [rng.choice(words) for _ in range(rng.choice([5, 12, 60, 200, 500]))]
        if g % 4 == 0:
            base[3:3] = common
        for n in range(rng.choice([1, 2, 3, 9])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 35)) if n else 0):  # similarities on both sides of 0.8
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy[: len(copy) - n * len(copy) // 60])))
    return rows


@pytest.mark.parametrize(("chunk", "shingles", "bucket"), [(512, 1 << 22, 2048), (9, 900, 4)])
def test_similar_against_brute_force(spark, monkeypatch, chunk, shingles, bucket):
    monkeypatch.setattr(similar, "BUCKET", bucket)
    rows = corpus()
    want = brute_groups(rows)
    assert len(set(want.values())) < len(rows) - 60
    df = docs_of(spark, [(i, t, "s") for i, t in rows]).selectExpr("*", "1 as node", "2 as root").repartition(3)
    got = similar.groups(df, chunk=chunk, chunk_shingles=shingles)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert similar.groups(df.where("false")).count() == similar.dedup(df.where("false")).count() == 0


def test_a_large_group_of_copies_of_copies(spark):
    """Every copy is alike to the first text, few are alike to one another, and some only over a third one."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(2000)}" for _ in range(200)]
    rows = []
    for i in range(260):
        copy = list(base)
        for k in rng.sample(range(20), rng.randint(0, 6)):
            copy[10 * k] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(copy)))
    for i in range(30):
        copy = rows[rng.randrange(len(rows))][1].split()
        copy[rng.randrange(200)] = "y"
        rows.append((i, " ".join(copy)))
    want = brute_groups(rows)
    got = similar.groups(docs_of(spark, [(i, t, "s") for i, t in rows]), chunk=20)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_candidates_miss_hardly_a_pair():
    """Over pairs of every band of similarity from 0.8: keys shared, and fingerprints within the radius."""
    rng = random.Random(31)
    tried = missed = 0
    while tried < 1500:
        n = rng.choice([4, 6, 9, 20, 60, 300])
        a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        b = np.concatenate((a[rng.randint(0, max(1, n // 8)) :], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, max(1, n // 8)))], np.uint64)))
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 5 * common < 4 * (len(a) + len(b) - common):
            continue
        tried += 1
        fa, fb = (np.frombuffer(similar.set_fingerprint(s, similar.BITS), np.uint64) for s in (a, b))
        near = int(np.bitwise_count(fa ^ fb).sum()) <= similar.RADIUS
        missed += not (near and any(x == y for x, y in zip(similar.bands(a), similar.bands(b), strict=True)))
    assert missed <= 2


def test_the_stage_keeps_one_of_each_group(spark):
    rows = corpus()
    kept = corpus_pipeline.near_duplicates(spark, docs_of(spark, [(i, t, "s") for i, t in rows]), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_groups(rows).values()))


def test_rows_that_repeat_an_id(spark):
    """No text is lost because its id repeats, and of rows that repeat id and text one stays."""
    one, two, long = "a b c d e f g h", "quite another text of some words", "w " * 300_000 + "end"
    rows = [(1, one), (2, one), (2, two), (2, two), (3, None), (None, ""), (None, one), (4, long), (5, long), (6, "alone here with six words only")]
    kept = similar.dedup(spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, node int, source string"))
    assert kept.columns == ["doc_id", "text", "node", "source"]
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id != 3) == [(1, one), (2, two), (4, long), (6, rows[-1][1])]
    assert [r.text for r in kept.collect() if r.doc_id == 3] == [None]


def test_plans_of_large_groups_stay_small(spark, monkeypatch):
    """Joins aren't planned over and over: a plan of very many exchanges costs the driver more than the data does."""
    dealt, joins = similar._dealt, []
    monkeypatch.setattr(similar, "_dealt", lambda tasks: joins.append(tasks._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or dealt(tasks))
    rng = random.Random(3)
    base = [f"w{rng.randrange(2000)}" for _ in range(60)]
    rows = [(i, " ".join(f"x{i}-{k}" if k in rng.sample(range(60), 3) else w for k, w in enumerate(base))) for i in range(90)]
    got = similar.groups(docs_of(spark, [(i, t, "s") for i, t in rows]), chunk=9)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_groups(rows)
    assert len(joins) == 2 and max(joins) <= 4


def test_links_of_a_task_are_stars():
    """Chains within a task would take the components more rounds."""
    sets = [np.arange(i, i + 30, dtype=np.uint64) for i in range(40)]
    links = similar.checked(sets, np.arange(139, 99, -1), *np.ones((2, 40), bool))
    assert sorted(links) == [(i, 100) for i in range(101, 140)]
