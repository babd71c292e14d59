r"""SimHash near-duplicates with bit-sliced comparison.

A text is lower-cased (A-Z only), split into words at ASCII white space and shingled; a bit
of its fingerprint is 1 if it is set in over half of the shingles' XXH64. A text shorter
than a shingle is one shingle; one without words has fingerprint zero. Fingerprints link
when at most ``radius`` bits differ; components of links are the groups. ``similar`` uses
the same comparison for fingerprints of more bits, which take further words of bits from the
same hash, mixed anew.

Distinct fingerprints only are compared, so copies cost one row. They meet in buckets:
the 64 bits are cut into some ``m`` segments, and two fingerprints that link agree on
``m - radius`` segments at least, so buckets keyed by each choice of so many segments miss
none. ``m`` grows with the number of fingerprints, so that a key has as many bits as that
number: with radius 4, 15 tables of 21 bits up to 2 million, 35 of 27 up to 130 million, 70
of 32 up to 4 billion, 126 of 35, 210 of 38.

A bucket of more than ``chunk`` fingerprints is cut into chunks, and every pair of chunks is
a group of its own: no task gets more than two chunks, no pair is lost.

Within a group the fingerprints stand in bit planes, 64 to a word. One word operation
updates 64 distances: differing planes are added two at a time into vertical counters by a
carry-save adder, and a block of 64 is abandoned once all its distances exceed the radius.
A task emits for each fingerprint a link to the root of its local component, never pairs.

A null text counts as empty. Repeated rows get the same result. Null ids are kept with the
component of their fingerprint. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import OWN, map_texts, materialise
from chronofold.llm.components import components

WORDS = 4
RADIUS = 4
BITS = 64
SEED = 42
#: Most fingerprints of a bucket that are compared as one group, and rows gathered before a comparison.
CHUNK = 2048
GATHER = 1 << 17
#: Segments a code is cut into at most; with 10 and radius 4, 210 tables of 38 bits.
MOST_SEGMENTS = 10
#: Hot buckets that are sent to every task; with more, they are joined by a shuffle.
BROADCAST_ROWS = 100_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th further word of bits of a hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles, in order; none for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    line = memoryview(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    k = min(words, len(parts))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def set_fingerprint(hashes: np.ndarray, bits: int = BITS) -> bytes:
    """The fingerprint of shingles' hashes, lowest bits first."""
    if not len(hashes):
        return bytes(bits // 8)
    out = []
    for n in range(bits // 64):
        set_in = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 16):
            some = hashes[i : i + (1 << 16)] if n == 0 else mixed(hashes[i : i + (1 << 16)], n)
            ones = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            # Sums of 255 rows fit in a byte, so eight of them add as one word.
            sums = np.add.reduceat(ones.view(np.uint64), np.arange(0, len(ones), 255), axis=0)
            set_in += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(set_in * 2 > len(hashes), bitorder="little").tobytes())
    return b"".join(out)


def fingerprint(text: str | None, words: int = WORDS) -> bytes:
    return set_fingerprint(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, ``__cf_fp``) of every row, as a long."""
    return map_texts(docs, lambda texts: {f"{OWN}fp": [int.from_bytes(fingerprint(t, words), "little", signed=True) for t in texts]}, f"{OWN}fp long", keep=(id_col,), text=text_col)


def planes_of(codes: np.ndarray) -> np.ndarray:
    """Codes [code, word], a whole number of blocks of 64, as planes: [bit, block], lane i of a word being the block's i-th code."""
    width = codes.shape[1] * 8
    bits = np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(-1, 64, width), axis=2, bitorder="little")
    turned = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little")
    return np.ascontiguousarray(turned).view("<u8")[:, :, 0].copy()


def compare(queries: np.ndarray, blocks: np.ndarray, lanes: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query code [pair, word], block): which pairs have lanes within the radius, and those lanes.

    ``lanes`` has the lanes of each block that count. Returns the positions of pairs and a word for each.
    """
    width = (radius + 1).bit_length()
    at = np.arange(len(queries))
    counts = [np.zeros(len(queries), np.uint64) for _ in range(width)]
    over = np.zeros(len(queries), np.uint64)
    live = lanes.copy()
    for p in range(0, len(planes), 2):
        if p % 64 == 0:
            word = queries[:, p // 64]
        d = [planes[p + i][blocks] ^ (np.uint64(0) - ((word >> np.uint64(p % 64 + i)) & np.uint64(1))) for i in (0, 1)]
        half = d[0] ^ d[1]
        carry = (d[0] & d[1]) | (counts[0] & half)  # a full adder of both planes and the lowest counter
        counts[0] ^= half
        for b in range(1, width):
            counts[b], carry = counts[b] ^ carry, counts[b] & carry
        over |= carry
        if p % 8 == 6:
            more, same = over.copy(), np.full(len(queries), _ALL)
            for b in reversed(range(width)):
                if radius >> b & 1:
                    same &= counts[b]
                else:
                    more |= same & counts[b]
                    same &= ~counts[b]
            live &= ~more
            keep = live != 0
            if not keep.all():
                at, queries, blocks, live, over, word = at[keep], queries[keep], blocks[keep], live[keep], over[keep], word[keep]
                counts = [c[keep] for c in counts]
                if not len(at):
                    break
    return at, live


def _below(k: np.ndarray) -> np.ndarray:
    """Words whose lowest k lanes, 0 to 64, are set."""
    k = np.clip(k, 0, 64).astype(np.uint64)
    return np.where(k == 64, _ALL, (np.uint64(1) << (k & np.uint64(63))) - np.uint64(1))


def local_roots(codes: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, most: int = 1 << 14) -> np.ndarray:
    """Codes in consecutive groups of these sizes: for each, the position of the first of its component within its group.

    Codes stand in blocks of 64 as they come, so small groups share blocks; a query counts
    only the lanes after it that belong to its group.
    """
    codes = codes.reshape(len(codes), -1)
    n = len(codes)
    padded = np.zeros((-(-n // 64) * 64, codes.shape[1]), np.uint64)
    padded[:n] = codes
    planes = planes_of(padded)
    end = np.repeat(np.cumsum(sizes), sizes)
    own = np.arange(n) // 64
    ahead = (end - 1) // 64 - own + 1  # blocks from its own on
    roots = np.arange(n)
    start, done = 0, np.cumsum(ahead)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + most, "right")))
        k = ahead[start:stop]
        who = np.repeat(np.arange(start, stop), k)
        block = own[who] + np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k)
        lanes = _below(end[who] - 64 * block) & ~_below(who + 1 - 64 * block)
        some = lanes != 0
        who, block, lanes = who[some], block[some], lanes[some]
        pair, hit = compare(codes[who], block, lanes, planes, radius)
        if len(pair):
            row, lane = np.nonzero(np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = who[pair[row]], block[pair[row]] * 64 + lane
            while True:
                ra, rb = roots[a], roots[b]
                low = np.minimum(ra, rb)
                if (ra == rb).all():
                    break
                np.minimum.at(roots, ra, low)
                np.minimum.at(roots, rb, low)
                while not (roots == roots[roots]).all():
                    roots = roots[roots]
        start = stop
    return roots


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Sorted (group columns..., node, code) in; (a, b), nodes, out."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def work(rows: list[tuple[np.ndarray, np.ndarray]], last: bool):
        t, codes = (np.concatenate(x) for x in zip(*rows, strict=True))
        new = np.concatenate(([True], (t[1:, :-1] != t[:-1, :-1]).any(axis=1)))
        starts = np.flatnonzero(new)
        stop = len(t) if last else starts[-1]
        rest = (t[stop:], codes[stop:])
        sizes = np.diff(np.append(starts, len(t)) if last else starts)
        a = b = np.zeros(0, np.int64)
        if (sizes > 1).any():
            big = np.flatnonzero(np.repeat(sizes > 1, sizes))
            nodes = t[big, -1]
            roots = local_roots(codes[big], sizes[sizes > 1], radius)
            moved = np.flatnonzero(roots != np.arange(len(roots)))
            a, b = nodes[moved], nodes[roots[moved]]
        return rest, pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        *columns, code = batch.columns
        if pa.types.is_binary(code.type):
            words = np.frombuffer(b"".join(code.to_pylist()), "<u8").reshape(batch.num_rows, -1)
        else:
            words = code.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
        kept.append((np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(np.int64, copy=False), words))
        held += batch.num_rows
        if held >= GATHER:
            rest, out = work(kept, False)
            kept, held = [rest], len(rest[0])
            yield out
    if held:
        yield work(kept, True)[1]


def segments(radius: int, n: int = 0) -> list[int]:
    """Masks, as signed numbers, of which two codes within the radius agree on one; each of as many bits as ``n`` has, where that can be."""
    m = radius + 2
    while BITS * (m - radius) // m < n.bit_length() and m < MOST_SEGMENTS:
        m += 1
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(x ^ (1 << 63)) - (1 << 63) for x in (sum(some) for some in combinations(single, m - radius))]


def met(keyed: DataFrame, radius: int, chunk: int = CHUNK, coarse: bool = False) -> DataFrame:
    """(c, k, node, ``__cf_fp``) to links (a, b) of nodes that meet in a bucket (c, k) within the radius.

    With ``coarse`` a bucket of more than ``chunk`` fingerprints isn't compared but linked as a whole,
    which takes a row for each of its nodes, where somebody checks the links in any case.
    """
    first = F.min("node").alias("first")
    hot = keyed.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n"), first).where(F.col("n") > chunk).select("c", "k", F.ceil(F.col("n") / chunk).cast("int").alias("g"), "first")
    hot = materialise(hot, "hot-buckets")
    if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    dealt = keyed.join(hot, ["c", "k"], "left")
    whole = dealt.where(F.col("first").isNotNull()).select(F.col("node").alias("a"), F.col("first").alias("b"))
    dealt = dealt.where(F.col("first").isNull()) if coarse else dealt
    own = F.pmod(F.xxhash64(f"{OWN}fp"), F.col("g")).cast("int")
    dealt = dealt.withColumn("g", F.coalesce("g", F.lit(1))).withColumn("i", own)
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("c", "k", F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"), "node", f"{OWN}fp")
    dealt = dealt.repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j")
    links = dealt.mapInArrow(lambda batches: _links(batches, radius), "a long, b long")
    return links.unionByName(whole) if coarse else links


def link(codes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Distinct ``__cf_fp`` of 64 bits to links (a, b) that connect exactly what is connected within the radius."""
    fp = F.col(f"{OWN}fp")
    masks = F.array(*(F.struct(F.lit(i).cast("long").alias("c"), F.lit(m).alias("m")) for i, m in enumerate(segments(radius, codes.count()))))
    keyed = codes.select(fp, F.explode(masks).alias("x")).select("x.c", fp.bitwiseAND(F.col("x.m")).alias("k"), fp.alias("node"), fp)
    return met(keyed, radius, chunk)


def named(fps: DataFrame, codes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """Each row with the least id of its component; ``codes`` has (``__cf_fp``, node, rep, n)."""
    known = codes.join(roots.withColumnRenamed("node", f"{OWN}node"), F.col("node") == F.col(f"{OWN}node"), "left").select(f"{OWN}fp", "rep", "n", "root")
    # Only fingerprints of several rows, or with links, say anything that the row itself doesn't.
    linked = known.where(F.col("root").isNotNull())
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "root").select(f"{OWN}fp", F.col("least").alias("component_id"))
    copied = known.where(F.col("root").isNull() & (F.col("n") > 1)).select(f"{OWN}fp", F.col("rep").alias("component_id"))
    out = fps.join(linked.unionByName(copied), f"{OWN}fp", "left")
    return out.select(id_col, f"{OWN}fp", F.coalesce("component_id", F.col(id_col)).alias("component_id"))


def codes_of(fps: DataFrame, id_col: str) -> DataFrame:
    return fps.groupBy(f"{OWN}fp").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of every row, by 64 bits; component_id is the least id reachable over links."""
    fps = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    codes = materialise(codes_of(fps, id_col).withColumn("node", F.col(f"{OWN}fp")), "codes")
    out = named(fps, codes, components(link(codes.select(f"{OWN}fp"), radius)), id_col)
    return out.select(id_col, F.lower(F.lpad(F.hex(f"{OWN}fp"), 16, "0")).alias("fingerprint"), "component_id")
