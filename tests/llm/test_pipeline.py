"""The pipeline, stage by stage, on a small corpus."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest
from chronofold.llm import common, langid, mixing, packing
from chronofold.llm.common import shared_dir

from tests.llm.test_corpus_operators import brute_lines, check_pieces
from tests.llm.test_similar import brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "hash", "node", "root"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(13)
    words = {"en": "the of and to in is that for it with as was".split(), "de": "der die und das nicht von mit ein ist auch sich".split()}
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        text = "\n".join(" ".join(rng.choice(words[lang]) + rng.choice(["", "er", str(i % 9)]) for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 12)))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(200, "1234 !!", "en", "s0", 7), (201, None, "en", "s1", None), (202, rows[3][1], "en", "s2", 1), (203, rows[4][1] + " end", "en", None, 1)]
    rows += [(204, " ".join(rng.choice(words["de"]) for _ in range(60_000)), "de", "s1", 1)]  # a very long text
    path = tmp_path_factory.mktemp("corpus")
    rows = [(*r, i, "x", None) for i, r in enumerate(rows)]  # columns that stages use themselves
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash int, node string, root long").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mix", "pack"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{corpus}/{name}")
        before, docs = docs, spark.read.parquet(f"{corpus}/{name}")
        kept[name] = docs
        if n < 4:
            assert docs.columns == COLUMNS
        rows = [(r.doc_id, r.text) for r in before.collect()] if n else []
        if name == "language":
            ids = {r.doc_id for r in docs.collect()}
            m = langid.fit(before)
            assert ids == {r.doc_id for r in before.collect() if m.predict(r.text)[2]} and not ids & {200, 201} and len(ids) > 155
        if name == "lines":
            assert {r.doc_id: r.text for r in docs.collect()} == brute_lines(rows, corpus_pipeline.PASSAGE_WORDS)
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(brute_groups(rows).values()))
        if name == "mix":
            want = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mix_report(before).collect() if r["size"]}
            assert Counter(r.doc_id for r in docs.where("text <> ''").collect()) == {i: n for i, n in want.items() if n}
        if name == "pack":
            check_pieces(rows, [tuple(r) for r in docs.collect()])
    before = common.made()
    again = corpus_pipeline.run(spark, corpus)
    assert common.made() == before + 1
    total = lambda df: df.groupBy("doc_id").sum("length").orderBy("doc_id").collect()
    assert total(again) == total(kept["pack"])


def test_empty_corpus(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        assert docs.count() == 0, name


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert packing.VOCABULARY == "byte_bpe_50k"
