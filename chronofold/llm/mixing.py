r"""Mixing sources to target weights by systematic sampling.

The size of a document is its number of words. Sources, ordered by code point with null
last, weigh 5, 2, 1 and so on again, and share ``budget`` times all words. A target stops
at ``cap`` times its source's size; what is over is shared again by weight among the
others, until none is above. That fixed point has a closed form: order sources by
size/weight; the first k are capped, where k is the least number for which the level that
the rest reaches stays below the next one's cap.

Each document of a source expects target / source size copies, at most ``cap``. The
expectations of a source's documents are summed along the order of their sizes (ties by a
hash of the id, the id, the whole row), one offset drawn from the seed and the source is
added, and a document is taken once for every integer its step crosses. Whatever the offset,
each document enters with its expected number of copies over all seeds. As neighbours are of
one size, the words taken miss the target by a few of the longest documents at most.

The prefix sum is distributed. One range partitioning puts rows in (source, size, ...)
order and splits a source of any size over many tasks; positions count within a
partition, and a table with one row for each partition and source carries the sums across.
Only that table and the table of sources are ever ordered in one place. All of this is done on
rows without texts; whole rows, numbered once, then meet their numbers of copies, in an order
of their own.

A null text has size 0. A source of size 0 has target 0 and gives nothing. Repeated rows
are separate rows. An empty table gives an empty table. Other columns travel along.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import OWN, materialise, words

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
SEED = "chronofold"
#: Most rows of a range partition.
PART_ROWS = 1_000_000


def targets(sizes: DataFrame, source_col: str = "source", size_col: str = "source_size", budget: float = BUDGET, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to a table of one row for each source."""
    everything = Window.partitionBy(F.lit(0))
    first_to = everything.rowsBetween
    by_name = everything.orderBy(F.col(source_col).asc_nulls_last())
    full = first_to(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn(f"{OWN}w", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn(f"{OWN}cap", (F.col(size_col) * cap).cast("double"))
    by_ratio = everything.orderBy(F.col(f"{OWN}cap") / F.col(f"{OWN}w"), F.col(source_col).asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # The level at which this source and all after it would stand, were all before it capped.
    level = (F.sum(size_col).over(full) * F.lit(float(budget)) - F.coalesce(F.sum(f"{OWN}cap").over(before), F.lit(0.0))) / (
        F.sum(f"{OWN}w").over(full) - F.coalesce(F.sum(f"{OWN}w").over(before), F.lit(0))
    )
    ranked = ranked.withColumn(f"{OWN}level", level)
    free = F.when(F.col(f"{OWN}level") * F.col(f"{OWN}w") < F.col(f"{OWN}cap"), F.struct(F.col(f"{OWN}cap") / F.col(f"{OWN}w"), F.col(source_col).isNull(), F.col(source_col), f"{OWN}level"))
    ranked = ranked.withColumn(f"{OWN}at", F.min(free).over(full)[f"{OWN}level"])
    target = F.coalesce(F.least(F.col(f"{OWN}cap"), F.col(f"{OWN}at") * F.col(f"{OWN}w")), F.col(f"{OWN}cap"))
    return ranked.withColumn("target", target).drop(f"{OWN}w", f"{OWN}cap", f"{OWN}level", f"{OWN}at")


def offset(source: Column, seed: str = SEED) -> Column:
    """A fraction drawn from the seed and the source; a multiple of 2^-13, so that sums with whole numbers are exact."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source.cast("string"), F.lit("")), F.when(source.isNull(), "(null)").otherwise("")))
    return (F.conv(F.substring(digest, 1, 3), 16, 10).cast("double") + 0.5) / 4096


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """``docs`` with ``__cf_size``, ``__cf_source_size``, ``__cf_target`` and ``__cf_copies`` (times that the mix takes the row)."""
    spark = docs.sparkSession
    size, source = F.col(f"{OWN}size"), F.col(source_col)
    rest = F.xxhash64(*(F.col(c) for c in docs.columns if c != f"{OWN}rid"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(docs.count() / PART_ROWS))
    order = [source.asc_nulls_last(), size, F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.col(id_col), rest]
    sized = docs if f"{OWN}size" in docs.columns else docs.withColumn(f"{OWN}size", words(F.col(text_col)))
    placed = sized.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(f"{OWN}at", F.monotonically_increasing_id())
    placed = materialise(placed, "mixing")

    # One row for each partition and source that meet.
    part = F.shiftright(f"{OWN}at", 33)
    pieces = placed.groupBy(part.alias(f"{OWN}part"), source.alias(f"{OWN}source")).agg(F.min(f"{OWN}at").alias(f"{OWN}first"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("words"))
    earlier = Window.partitionBy(f"{OWN}source").orderBy(f"{OWN}part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn(f"{OWN}before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    totals = targets(pieces.groupBy(f"{OWN}source").agg(F.sum("words").alias(f"{OWN}source_size")), f"{OWN}source", f"{OWN}source_size", budget, cap)
    totals = totals.withColumnRenamed("target", f"{OWN}target").withColumnRenamed(f"{OWN}source", f"{OWN}source2")
    pieces = pieces.join(totals, F.col(f"{OWN}source").eqNullSafe(F.col(f"{OWN}source2"))).select(
        f"{OWN}part", f"{OWN}source", F.col(f"{OWN}before") - F.col(f"{OWN}first"), f"{OWN}source_size", f"{OWN}target"
    ).toDF(f"{OWN}part", f"{OWN}source", f"{OWN}shift", f"{OWN}source_size", f"{OWN}target")

    rank, u = F.col(f"{OWN}at") + F.col(f"{OWN}shift"), offset(F.col(f"{OWN}source"), seed)
    step = F.when(F.col(f"{OWN}source_size") > 0, F.col(f"{OWN}target") / F.col(f"{OWN}source_size")).otherwise(F.lit(0.0))
    copies = F.least(F.floor(step * (rank + 1) + u) - F.floor(step * rank + u), F.lit(cap).cast("long"))
    joined = placed.withColumn(f"{OWN}part2", part).join(pieces, (F.col(f"{OWN}part2") == F.col(f"{OWN}part")) & source.eqNullSafe(F.col(f"{OWN}source")))
    return joined.withColumn(f"{OWN}copies", copies).select(*docs.columns, *(c for c in (f"{OWN}size", f"{OWN}source_size", f"{OWN}target", f"{OWN}copies") if c not in docs.columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken; same columns."""
    rows = docs.withColumn(f"{OWN}rest", F.xxhash64(*docs.columns)).withColumn(f"{OWN}size", words(F.col(text_col))).withColumn(f"{OWN}rid", F.monotonically_increasing_id())
    rows = materialise(rows, "mix-rows")
    narrow = rows.select(id_col, source_col, f"{OWN}size", f"{OWN}rest", f"{OWN}rid")
    taken = sample(narrow, id_col, text_col, source_col, **how).where(F.col(f"{OWN}copies") > 0).select(f"{OWN}rid", f"{OWN}copies")
    each = rows.join(taken, f"{OWN}rid").withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{OWN}copies"))))
    return each.select(*docs.columns)


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """What the mix takes of each row: id, size, source_size, target (of its source), taken (words)."""
    narrow = docs.select(F.col(id_col), F.col(source_col), words(F.col(text_col)).alias(f"{OWN}size"))
    narrow = materialise(narrow, "sizes")  # the range partitioning looks at its input twice
    return sample(narrow, id_col, text_col, source_col, **how).select(
        id_col,
        F.col(f"{OWN}size").alias("size"),
        F.col(f"{OWN}source_size").alias("source_size"),
        F.col(f"{OWN}target").alias("target"),
        (F.col(f"{OWN}copies") * F.col(f"{OWN}size")).alias("taken"),
    )


SQL = rf"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap FROM sized GROUP BY source),
ranked AS (SELECT *, list_extract([{', '.join(map(str, WEIGHTS))}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)) AS w FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * {BUDGET}::DOUBLE - coalesce(sum(cap) OVER earlier, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level
  FROM ranked WINDOW earlier AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (SELECT arg_min(level, (cap / w, source)) FILTER (level * w < cap) AS height FROM levels),
targets AS (SELECT source, source_size, coalesce(least(cap, height * w), cap) AS target FROM levels, settled),
placed AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS step,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id NULLS FIRST) AS rank,
    (('0x' || substr(md5('{SEED}:' || coalesce(s.source, '') || CASE WHEN s.source IS NULL THEN '(null)' ELSE '' END), 1, 3))::BIGINT + 0.5) / 4096.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(least(floor(step * rank + u) - floor(step * (rank - 1) + u), {CAP}) * size AS BIGINT) AS taken FROM placed
"""
