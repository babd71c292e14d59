from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from chronofold.llm import common
from pyspark.sql import functions as F


def test_counted_join_is_the_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(200)] + [("alone", 1)], "k string, v int")
    table = rows.where("k <> 'alone'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
    got = common.join_counted(rows, table, "k", "n", rows.count())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table.drop("n"), "k").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "broadcast" in plan


def test_the_filter_misses_no_key(spark, monkeypatch):
    df = spark.range(4000).select("id", F.xxhash64("id").alias("h"))
    keys = df.where("id % 7 = 0").select("h").union(spark.createDataFrame([(None,)], "h long"))
    flagged = lambda: common.may_be_in(df.unionByName(spark.createDataFrame([(-1, None)], "id long, h long")), F.col("h"), keys, "may").collect()
    got = flagged()
    assert len(got) == 4001 and all(r.may for r in got if r.id >= 0 and r.id % 7 == 0)
    assert sum(r.may for r in got if r.id % 7) < 200 and not next(r for r in got if r.id == -1).may
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 10)  # too few bits only let more through
    assert all(r.may for r in flagged() if r.id >= 0 and r.id % 7 == 0)
    assert not any(r.may for r in common.may_be_in(df, F.col("h"), keys.where("false"), "may").collect())


def test_materialised_tables_are_in_the_shared_folder_and_go(spark):
    df = spark.range(10).withColumn("a", F.array(F.col("id")))
    out = common.materialise(df, "test")
    assert out.dtypes == df.dtypes and sorted(out.collect()) == sorted(df.collect())
    path = Path(out._cf_path.removeprefix("file:"))
    assert str(path).startswith(common.shared_dir(spark).removeprefix("file:")) and path.exists()
    common.release(out)
    assert not path.exists()


def test_a_cluster_needs_a_shared_folder():
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d, set=lambda k, v: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(fake)


def test_words_and_let(spark):
    df = spark.createDataFrame([("a b\tc\n", 3), ("", 0), (None, 0), ("  ", 0), (" x", 2), ("é ü", 2)], "t string, n int")
    assert [r[0] for r in df.select(common.words(F.col("t"))).collect()] == [3, 0, 0, 0, 1, 2]
    assert df.select(common.let(F.col("n") + 1, lambda x: x * x)).first()[0] == 16
