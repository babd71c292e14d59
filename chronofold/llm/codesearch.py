r"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

Equal codes are one entry that carries its ``k`` smallest ids (the window's group limit keeps
``k`` rows of a code in each map task, so a code that fills a third of the rows is never
gathered), and equal queries are one query. Entries and queries are dealt into blocks of
bounded size by hash, and each pair of an entry block and a query block is one task.

Within a task the codes are cut into about ``64 / log2(n)`` segments, each indexed by value.
A query grows its search radius one segment at a time: radius r in a segment looks up the
occupied values that differ in exactly r bits, and verifies the codes found there in full.
Once segments 0 to t have been searched up to r and the rest up to r - 1, a code not seen
differs in at least ``m r + t + 1`` bits; the search of a query ends when its k-th verified
distance is below that, so results are exact. Each pair of blocks returns k rows a query at
most, merged by one window a query; the rows of an answer are then at most ``k`` for each query.

Order is (distance, id), ids ascending. A row without a code is not found, a query without one
finds nothing. Ids that repeat are found as often as they repeat. Fewer than k rows give fewer
results. Columns other than id and code are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import OWN, join_counted, materialise

BITS = 64
#: Most entries, and most queries, of a block; a block has no fewer than LEAST entries to keep small inputs parallel.
BLOCK, LEAST = 1 << 20, 1 << 11


def sign_code(vector: str) -> Column:
    """Bit i is 1 where dimension i is not negative; null for a null or empty vector, or one of over 64 dimensions or with a null in it."""
    code = F.expr(f"aggregate({vector}, named_struct('c', 0L, 'i', 0), (a, x) -> named_struct('c', a.c | if(x >= 0, shiftleft(1L, a.i), 0L), 'i', a.i + 1), a -> a.c)")
    usable = F.size(vector).between(1, BITS) & ~F.exists(vector, F.isnull)
    return F.when(usable, code)


class Index:
    def __init__(self, codes: np.ndarray):
        self.codes, n = codes, len(codes)
        width = min(16, max(4, round(log2(max(n, 2)))))
        m = ceil(BITS / width)
        cuts = [round(i * BITS / m) for i in range(m + 1)]
        self.m = m
        self.parts = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            value = ((codes >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange((1 << (b - a)) + 1))
            self.parts.append((a, b - a, order, starts, np.unique(value)))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def flips(self, width: int, r: int) -> np.ndarray:
        if (width, r) not in self.masks:
            self.masks[width, r] = np.array([sum(1 << i for i in c) for c in combinations(range(width), r)], np.int64)
        return self.masks[width, r]

    def at(self, part: int, query: int, r: int) -> np.ndarray:
        """The codes whose segment differs from the query's in exactly r bits."""
        a, width, order, starts, occupied = self.parts[part]
        if r > width:
            return order[:0]
        q = query >> a & (1 << width) - 1
        if comb(width, r) <= len(occupied):
            values = self.flips(width, r) ^ q
            values = values[starts[values] < starts[values + 1]]
        else:
            values = occupied[np.bitwise_count(occupied ^ q) == r]
        first, n = starts[values], starts[values + 1] - starts[values]
        total = int(n.sum())
        if not total:
            return order[:0]
        return order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)]

    def search(self, query: int, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All codes that can be among the k nearest, and their distances; ``weight`` ids stand behind a code."""
        seen = np.zeros(len(self.codes), bool)
        within = np.zeros(BITS + 2, np.int64)  # ids verified at each distance
        found, distances = [], []
        q = np.uint64(query)
        widest = max(p[1] for p in self.parts)
        for r in range(widest + 1):
            for t in range(self.m):
                new = self.at(t, query, r)
                new = new[~seen[new]]
                if len(new):
                    seen[new] = True
                    d = np.bitwise_count(self.codes[new] ^ q).astype(np.int64)
                    found.append(new)
                    distances.append(d)
                    np.add.at(within, d, weight[new])
                if within[: self.m * r + t + 1].sum() >= k:
                    break
            else:
                continue
            break
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, d = np.concatenate(found), np.concatenate(distances)
        last = int(np.searchsorted(np.cumsum(within), k))  # distance of the k-th
        return at[d <= last], d[d <= last]


def _task(k: int):
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        codes = entries.column("code").to_numpy().view(np.uint64)
        ids = entries.column("ids").combine_chunks()
        flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
        weight = np.diff(offsets)
        index = Index(codes) if len(codes) else None
        rows: list[list[np.ndarray]] = [[], [], []]
        for q in queries.column("code").to_numpy().tolist() if index else ():
            at, d = index.search(q & (1 << BITS) - 1, k, weight)
            n = weight[at]
            who = np.repeat(offsets[:-1][at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            near, far = flat[who], np.repeat(d, n)
            best = np.lexsort((near, far))[:k]
            for out, x in zip(rows, (np.full(len(best), q), near[best], far[best]), strict=True):
                out.append(x)
        joined = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in rows]
        return pa.table({n: pa.array(x) for n, x in zip(("code", "id", "distance"), joined, strict=True)})

    return run


def top_k(base: DataFrame, queries: DataFrame, k: int, id_col: str, code_col: str = "code", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for each query the k nearest rows of ``base``, itself included if it is one."""
    spark = base.sparkSession
    code = F.col(code_col).alias("code")
    rows = base.where(F.col(code_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), code)
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    entries = rows.withColumn("n", first).where(F.col("n") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialise(entries, "codes")
    asked = materialise(queries.where(F.col(code_col).isNotNull()).select(F.col(id_col).alias("query_id"), code), "code-queries")
    distinct = asked.select("code").distinct()

    n, n_asked = entries.count(), distinct.count()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, ceil(n / block), min(parallel, ceil(n / LEAST)))
    ask_blocks = max(1, ceil(n_asked / block))
    dealt = entries.withColumn("i", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ask_blocks - 1))))
    posed = distinct.withColumn("j", F.pmod(F.xxhash64("code"), F.lit(ask_blocks)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # A task for each pair of blocks, however few bytes they have: the work is in the comparison.
    tasks = 2 * blocks * ask_blocks
    dealt, posed = dealt.repartition(tasks, "i", "j"), posed.repartition(tasks, "i", "j")
    found = dealt.groupBy("i", "j").cogroup(posed.groupBy("i", "j")).applyInArrow(_task(k), "code long, id long, distance long")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("distance", "id"))
    best = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).groupBy("code").agg(F.collect_list(F.struct("rank", "id", "distance")).alias("best"))
    # Of queries that share a code all would meet in one task; those of common codes stay where they are.
    times = asked.groupBy("code").agg(F.count(F.lit(1)).alias("times"))
    answered = join_counted(asked, materialise(best.join(times, "code"), "code-answers"), "code", "times", asked.count())
    return answered.select("query_id", F.explode("best").alias("x")).select("query_id", "x.rank", F.col("x.id").alias("neighbour_id"), "x.distance")


def search_embeddings(vectors: DataFrame, k: int = 10, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The rows whose id is divisible by ``every`` against all rows, by the signs of their vectors."""
    coded = vectors.select(id_col, sign_code(vector_col).alias(f"{OWN}code"))
    return top_k(coded, coded.where(F.col(id_col) % every == 0), k, id_col, f"{OWN}code")


SQL = """
WITH coded AS (
  SELECT vec_id, list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] >= 0 THEN CASE WHEN i = 64 THEN (-9223372036854775807::BIGINT - 1) ELSE (1::BIGINT << (i - 1)::BIGINT) END ELSE 0::BIGINT END), lambda a, b: a | b) AS c
  FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, CAST(bit_count(xor(q.c, b.c)) AS BIGINT) AS distance FROM coded q, coded b WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, neighbour_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs) WHERE rank <= 10
"""
