r"""Near-duplicates of a text similarity of 0.8: SimHash by bit-sliced comparison, then an exact check.

Words are those of ``simhash``, shingles have five, named by a hash of 64 bits. Two texts are linked when the
sets of their shingles have a similarity (common by all) of ``SHARE`` = 4/5 or more;
components of links are the groups.

1. One pass over the texts makes of each its set's SimHash of ``BITS`` bits and the keys of
   ``BANDS`` bands of ``ROWS`` minima each. Texts of the same set are one node.
2. Nodes that share a band's key stand in a bucket. A pair of similarity s shares one with
   ``1 - (1 - s**ROWS)**BANDS``, 0.9999 at 0.8, however many texts there are; texts without a
   common shingle never meet, so buckets don't fill up as the corpus grows. Within a bucket
   the fingerprints are compared in bit planes (``simhash.local_roots``); those that differ in
   at most ``RADIUS`` bits may be alike. At 0.8 some 39 bits differ, with a spread of 6, so
   the radius lies 5 spreads above. All of a bucket of more than ``BUCKET`` nodes may be alike,
   as comparing would grow with its square; step 3 tells.
3. Components of what may be alike are checked by the sets themselves: the texts of one go
   to a task, each once. Pairs are taken by the distance of parity sketches (which, as sizes
   do, leave out no pair of 4/5), only as long as they aren't of one group already.
   A component of more than ``CHUNK`` nodes or ``CHUNK_SHINGLES`` shingles is cut into
   chunks by hash. Each chunk is checked in itself and against ``PIVOTS`` nodes of the
   component; after that the nodes outside its largest group are checked against all chunks.
   No pair is left out, none within the largest group is looked at across chunks.

Texts without words are one group. A null text counts as empty. Rows without an id come last
in their group. Rows that repeat id and text are the same place. Columns other than the id and
the text are not read by the search and travel along in ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import OWN, bounded_batches, join_counted, map_texts, materialise, may_be_in
from chronofold.llm.components import components
from chronofold.llm.simhash import met, mixed, set_fingerprint

SHARE = (4, 5)
WORDS = 5
BITS, RADIUS = 256, 72
#: Nodes of a bucket that are compared; a larger one may be alike as a whole.
BUCKET = 2048
BANDS, ROWS = 24, 5
CHUNK, CHUNK_SHINGLES, PIVOTS = 512, 1 << 22, 16
SKETCH = 1024
_ODD = (np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))))


_BLOCK = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_LETTER = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)
_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word: a polynomial of its bytes, modulo 2**64, out of running sums over blocks of whole words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.concatenate(([False], (data != 32) & ((data < 9) | (data > 13)), [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    out, w = [np.zeros(0, np.uint64)], 0
    while w < len(starts):
        first = int(starts[w])
        last = max(w + 1, int(np.searchsorted(ends, first + _BLOCK, "right")))
        n = int(ends[last - 1]) - first
        up, down = (_UP, _DOWN) if n <= _BLOCK else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[data[first : first + n]] * up[:n])))
        a, b = starts[w:last] - first, ends[w:last] - first
        out.append(mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64), 3))
        w = last
    return np.concatenate(out)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending; of a shorter text its whole sequence."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(_BASE) + w[i : i + len(h)]
    return np.unique(mixed(h, 4))


def bands(s: np.ndarray) -> list[int]:
    """The key of each band: a hash of the minima of its permutations; the same for all texts without words."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    h = mixed(s, 5)
    for i in range(0, len(h), 256):
        least = np.minimum(least, (h[i : i + 256, None] * _ODD).min(axis=0))
    return [int.from_bytes(xxhash.xxh3_64_digest(b.tobytes()), "little", signed=True) for b in least.reshape(BANDS, ROWS)]


def sketch(s: np.ndarray) -> np.ndarray:
    """The parities of the numbers of shingles in SKETCH cells; two differ in no more cells than their sets do in shingles."""
    return np.packbits(np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).view(np.uint64)


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def place_key(id_col: str, th: Column) -> Column:
    """Of a row's id and text."""
    return F.xxhash64(F.col(id_col), th)


def prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ``__cf_th`` for the text, node for the set, n, fp, keys) of every row."""

    def made(texts: list[str | None]) -> dict[str, list]:
        sets = [shingle_set(t) for t in texts]
        return {
            "node": [int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True) for s in sets],
            "n": [len(s) for s in sets],
            f"{OWN}fp": [set_fingerprint(s, BITS) for s in sets],
            "keys": [bands(s) for s in sets],
        }

    rows = docs.select(F.col(id_col), text_key(text_col).alias(f"{OWN}th"), F.col(text_col).cast("string").alias(f"{OWN}t")).withColumnRenamed(id_col, f"{OWN}id")
    return map_texts(rows, made, f"node long, n long, {OWN}fp binary, keys array<long>", keep=(f"{OWN}id", f"{OWN}th"), text=f"{OWN}t")


def checked(sets: list[np.ndarray], group: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links of groups that connect whatever is alike between nodes marked ``left`` and ``right``: each to the least that it is connected with."""
    up, down = SHARE
    n = np.array([len(s) for s in sets])
    marks = np.stack([sketch(s) for s in sets])
    own = {g: k for k, g in enumerate(dict.fromkeys(group.tolist()))}
    root = np.array([own[g] for g in group.tolist()])
    first, second, far = [], [], []
    for i in np.flatnonzero(left):
        # Pairs of two nodes that are both left and right are taken once.
        j = np.flatnonzero(right & (root != root[i]) & ~(left & right[i] & (np.arange(len(n)) <= i)))
        j = j[np.minimum(n[i], n[j]) * down >= np.maximum(n[i], n[j]) * up]
        apart = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64)
        j, apart = (x[apart * (up + down) <= (n[i] + n[j]) * (down - up)] for x in (j, apart))
        first.append(np.full(len(j), i))
        second.append(j)
        far.append(apart / np.maximum(n[i] + n[j], 1))
    if not first:
        return []
    first, second, far = (np.concatenate(x) for x in (first, second, far))
    for at in np.argsort(far, kind="stable"):
        i, j = first[at], second[at]
        if root[i] != root[j]:
            # A merge of two sorted sets without repeats: neighbours that are equal are common.
            both = np.concatenate((sets[i], sets[j]))
            both.sort(kind="stable")
            common = np.count_nonzero(both[1:] == both[:-1])
            if common * (up + down) >= up * len(both):
                root[root == root[i]] = root[j]
    least: dict[int, int] = {}
    for r, g in zip(root.tolist(), group.tolist(), strict=True):
        least[r] = min(g, least.get(r, g))
    return sorted({(g, least[r]) for r, g in zip(root.tolist(), group.tolist(), strict=True) if g != least[r]})


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, group, left, right, text) sorted by task in; links (a, b) of groups out."""
    held: list[tuple] = []

    def work() -> pa.RecordBatch:
        group, left, right = (np.array([r[k] for r in held]) for k in range(1, 4))
        found = checked([r[4] for r in held], group, left.astype(bool), right.astype(bool))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
            if held and held[0][0] != row[0]:
                yield work()
                held = []
            held.append((*row[:4], shingle_set(row[4].as_py())))
    if held:
        yield work()


def _dealt(tasks: DataFrame) -> DataFrame:
    """Links of (task, group, left, right, text)."""
    bounded_batches(tasks.sparkSession)
    rows = tasks.select("task", "group", "left", "right", f"{OWN}t").repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(_checks, "a long, b long")


def verified(nodes: DataFrame, near: DataFrame, docs: DataFrame, text_col: str, chunk: int = CHUNK, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """Links (a, b) that connect what is alike within components ``near`` (node, root) of what may be alike."""
    known = materialise(nodes.select("node", "n", f"{OWN}th").join(near, "node"), "similar-known")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") / chunk_shingles)).cast("int")
    sizes = known.groupBy("root").agg(F.count(F.lit(1)).alias("c"), parts.alias("g"))
    # Of each node one text; only texts that may be wanted move.
    texts = may_be_in(docs.select(F.col(text_col).cast("string").alias(f"{OWN}t"), text_key(text_col).alias(f"{OWN}th")), F.col(f"{OWN}th"), known.select(f"{OWN}th"), f"{OWN}may")
    texts = texts.where(f"{OWN}may").select(f"{OWN}th", f"{OWN}t").dropDuplicates([f"{OWN}th"])
    wanted = join_counted(known, sizes, "root", "c", known.count()).withColumn("i", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    wanted = materialise(wanted.join(texts, f"{OWN}th").select("root", "node", "n", "g", "i", f"{OWN}t"), "similar-texts")
    task = lambda *c: F.xxhash64("root", *c).alias("task")
    yes, no = F.lit(True), F.lit(False)

    by_hash = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node"), "node"))
    pivots = wanted.where("g > 1").withColumn("r", by_hash).where(F.col("r") <= PIVOTS).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).where("j <> i")
    alone = wanted.select(task("i"), F.col("node").alias("group"), yes.alias("left"), yes.alias("right"), f"{OWN}t")
    beside = pivots.select(task("j"), F.col("node").alias("group"), no.alias("left"), yes.alias("right"), f"{OWN}t")
    links = materialise(_dealt(alone.unionByName(beside)), "similar-links")

    large = wanted.where("g > 1")
    if large.isEmpty():
        return links
    found = components(links)
    large = large.join(found.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    large = materialise(large, "similar-large")
    each = large.groupBy("root", "group").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    each = each.groupBy("root").agg(F.max_by(F.struct("group", "c", "n"), F.struct("c", "group")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    # Parts of what is outside the largest group; none if nothing is. Written, as a join reads the table thrice.
    parts = F.greatest(F.ceil((F.col("c") - F.col("top.c")) / chunk), F.ceil((F.col("n") - F.col("top.n")) / chunk_shingles)).cast("int")
    each = materialise(each.select("root", F.col("top.group").alias("largest"), "c", parts.alias("gr")), "similar-largest")
    large = join_counted(large, each, "root", "c", large.count()).where("gr > 0")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.pmod(F.xxhash64("node", F.lit("rest")), F.col("gr")).cast("int")
    rest = F.transform(upto(F.col("g")), lambda i: F.struct(own.alias("a"), i.alias("b"), yes.alias("left")))
    some = F.transform(upto(F.col("gr")), lambda a: F.struct(a.alias("a"), F.col("i").alias("b"), no.alias("left")))
    large = large.withColumn("at", F.explode(F.when(F.col("group") != F.col("largest"), F.concat(rest, some)).otherwise(some)))
    more = materialise(_dealt(large.select(task("at.a", "at.b"), "group", "at.left", (~F.col("at.left")).alias("right"), f"{OWN}t")), "similar-more")
    return found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(``__cf_id``, ``__cf_th``, node, root) of every row; equal roots are one group."""
    rows = materialise(prints(docs, id_col, text_col), "similar-prints")
    nodes = rows.groupBy("node", "n", f"{OWN}fp", "keys").agg(F.min(f"{OWN}th").alias(f"{OWN}th"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes, "similar-nodes")
    keyed = nodes.select("node", f"{OWN}fp", F.posexplode("keys").alias("c", "k")).select(F.col("c").cast("long").alias("c"), "k", "node", f"{OWN}fp")
    near = components(met(keyed, RADIUS, BUCKET, coarse=True))
    roots = components(verified(nodes, near, docs, text_col, chunk, chunk_shingles))
    # Nodes of many copies are named even where they have no link, so that their rows stay where they are.
    linked = nodes.select("node", "copies").join(roots, "node", "left").where("root is not null or copies > 1")
    return join_counted(rows.select(f"{OWN}id", f"{OWN}th", "node"), linked, "node", "copies", rows.count(), outer=True).withColumn("root", F.coalesce("root", "node"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, fingerprint, component_id) of every row; fingerprint names the set, component_id is the least id of the group."""
    rows = materialise(placed(docs, id_col, text_col, **how), "similar-rows")
    least = rows.groupBy("root").agg(F.min(f"{OWN}id").alias("component_id"), F.count(F.lit(1)).alias("c"))
    out = join_counted(rows, least, "root", "c", rows.count())
    return out.select(F.col(f"{OWN}id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group: that of the least id, then of the least hash of its text. Same columns.

    Of rows that repeat id and text one stays, whichever comes first where other columns differ.
    """
    rows = materialise(placed(docs, id_col, text_col, **how), "similar-rows")
    places = rows.groupBy("root", f"{OWN}id", f"{OWN}th").agg(F.count(F.lit(1)).alias("times"))
    place = F.struct(F.col(f"{OWN}id").isNull(), F.col(f"{OWN}id"), F.col(f"{OWN}th"))
    first = places.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"), F.max("times").alias("most")).where("c > 1 or most > 1")
    odd = join_counted(places, first.drop("most"), "root", "c", places.count()).where((F.col("times") > 1) | ~place.eqNullSafe(F.col("first")))
    odd = materialise(odd.select(F.col(f"{OWN}id").alias(f"{OWN}id2"), F.col(f"{OWN}th").alias(f"{OWN}th2"), place.eqNullSafe(F.col("first")).alias(f"{OWN}stays")), "similar-odd")
    keyed = docs.withColumn(f"{OWN}th", text_key(text_col))
    keyed = may_be_in(keyed, place_key(id_col, F.col(f"{OWN}th")), odd.select(place_key(f"{OWN}id2", F.col(f"{OWN}th2")).alias("key")), f"{OWN}may")
    same = F.col(id_col).eqNullSafe(F.col(f"{OWN}id2")) & (F.col(f"{OWN}th") == F.col(f"{OWN}th2"))
    maybe = keyed.where(f"{OWN}may").join(odd, same, "left")
    sole = maybe.where(F.col(f"{OWN}stays").isNull())
    repeated = maybe.where(F.col(f"{OWN}stays")).dropDuplicates([id_col, f"{OWN}th"])
    out = [df.select(*docs.columns) for df in (keyed.where(~F.col(f"{OWN}may")), sole, repeated)]
    return out[0].unionByName(out[1]).unionByName(out[2])
