"""The training corpus pipeline: five stages, each on all that its predecessor kept.

``run`` applies them to ``documents``; each stage's rows are written as Parquet into the
shared folder and read again as the next one's input, so a lost executor costs a stage at
most; what it was made from is then deleted. All but the last return the columns of ``documents``.

1. language: documents whose language the model rejects go, as do those without a letter.
2. lines: repeated chunks of lines and repeated long lines go, except where they occur first.
3. near_duplicates: of each group of texts alike, by 0.8 or more of their 5-word shingles, one row stays, that of the smallest id.
4. mix: documents are taken as often as their source's target asks for.
5. pack: documents become pieces of sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import langid, linededup, mixing, packing, similar
from chronofold.llm.common import documents, made, materialise, release_since


#: A line of more words counts as a passage of its own, so that one that repeats is kept once.
PASSAGE_WORDS = 50


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_accepted(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup(docs, passage_words=PASSAGE_WORDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: A trained model and a tokenizer decide here; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), made()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release_since(before, docs)  # what the stage made on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
