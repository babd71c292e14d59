r"""Line dedup by content-defined chunks of lines.

Lines are hashed, and a rolling hash runs over them: that of a line is its own hash xor the
line before's, rotated by a bit. A chunk ends at a line whose rolling hash is a local minimum
(below the one before, not above the one after). So a boundary depends on four lines around
it and on nothing else: text that is inserted before a passage shifts no boundary within it,
chunks inside a document have two lines at least and three on average.

A chunk of two non-blank lines or more that occurs again anywhere in the corpus goes, except
where it occurs first, by order of id (nulls last), a hash of the text, and line. With
``passage_words`` a single line of more words than that goes as well, as a passage in itself;
that is an addition to the method and off by default.
Chunks are matched by md5 and then byte by byte: of each hash the least and the greatest text
are compared, and where they differ the hash is split by its texts.

DataFrame functions only. Counting moves (hash, place) pairs, aggregated before they are
shuffled. Marks of repeated chunks meet their texts by (id, hash of the text): texts that
surely have no mark are told by a bitmap (``may_be_in``) and stay where they are, the others
move once, to be compared and cut. No chunk, however common, is gathered anywhere: places of
very common ones are joined where they are.

A null text stays null and has no lines; an empty text has one empty line. Rows that repeat
both id and text count as one place, and keep the same lines. A document may be left with an
empty text; no row is dropped. Other columns travel along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import OWN, join_counted, materialise, may_be_in

_LINES, _HASHES, _ROLLING, _ENDS, _TEXT_HASH = (f"{OWN}{x}" for x in ("lines", "hashes", "rolling", "ends", "th"))


def text_hash(text_col: str) -> Column:
    return F.conv(F.substring(F.md5(F.col(text_col).cast("string")), 1, 15), 16, 10).cast("bigint")


def with_chunks(docs: DataFrame, id_col: str, text_col: str, passage_words: int | None) -> DataFrame:
    """(id, text hash, first, last, unit) for every removable chunk and passage."""
    df = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), text_hash(text_col).alias(_TEXT_HASH), F.split(F.col(text_col), "\n", -1).alias(_LINES))
    df = df.withColumn(_HASHES, F.expr(f"transform({_LINES}, l -> cast(conv(substr(md5(l), 1, 15), 16, 10) as bigint))"))
    df = df.withColumn(_ROLLING, F.expr(f"transform({_HASHES}, (h, i) -> if(i = 0, h, shiftleft(get({_HASHES}, i - 1) & 576460752303423487, 1) ^ h))"))
    df = df.withColumn(
        _ENDS,
        F.expr(
            f"filter(sequence(0, size({_LINES}) - 1), i -> i = size({_LINES}) - 1 or "
            f"(i > 0 and get({_ROLLING}, i) < get({_ROLLING}, i - 1) and get({_ROLLING}, i) <= get({_ROLLING}, i + 1)))"
        ),
    )
    units = F.expr(f"transform({_ENDS}, (e, j) -> struct(if(j = 0, 0, get({_ENDS}, j - 1) + 1) as first, e as last))")
    units = F.filter(units, lambda u: u["last"] > u["first"])
    if passage_words is not None:
        long_lines = F.expr(
            f"transform(filter(sequence(0, size({_LINES}) - 1), i -> size(split(get({_LINES}, i), ' ')) > {passage_words}), i -> struct(i as first, i as last))"
        )
        units = F.concat(units, long_lines)
    df = df.withColumn("u", F.explode(units)).select(id_col, _TEXT_HASH, "u.first", "u.last", F.expr(f"slice({_LINES}, u.first + 1, u.last - u.first + 1)").alias("part"))
    lines = F.size(F.filter("part", lambda x: F.trim(x) != ""))
    return df.where((lines >= 2) | (F.col("first") == F.col("last"))).select(id_col, _TEXT_HASH, "first", "last", F.array_join("part", "\n").alias("unit"))


def unit_hash(unit: Column) -> Column:
    return F.md5(unit)


def _place(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col(_TEXT_HASH).alias("t"), F.col("first").alias("f"))


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = None) -> DataFrame:
    """(``__cf_id``, ``__cf_th2``, ``__cf_marks``): for each document its chunks whose hash repeats; ``later`` if another place comes before."""
    units = with_chunks(docs, id_col, text_col, passage_words)
    narrow = materialise(units.select(id_col, _TEXT_HASH, "first", "last", unit_hash(F.col("unit")).alias("hash")), "line-chunks")
    place = _place(id_col)
    again = narrow.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("start")).where("n > 1")
    again = materialise(again, "line-hashes")
    found = join_counted(narrow, again, "hash", "n", narrow.count())
    mark = F.struct("first", "last", "hash", (place > F.col("start")).alias("later"))
    return found.groupBy(F.col(id_col).alias(f"{OWN}id"), F.col(_TEXT_HASH).alias(f"{OWN}th2")).agg(F.collect_set(mark).alias(f"{OWN}marks"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = None, report: bool = False) -> DataFrame:
    """``docs`` without the repeated lines; with ``report`` also ``__cf_gone``, the line numbers removed, null if none."""
    marked = materialise(marks(docs, id_col, text_col, passage_words), "line-marks")
    place_key = lambda i, t: F.xxhash64(F.col(i), F.col(t))
    keyed = may_be_in(docs.withColumn(_TEXT_HASH, text_hash(text_col)), place_key(id_col, _TEXT_HASH), marked.select(place_key(f"{OWN}id", f"{OWN}th2").alias("key")), f"{OWN}may")
    same_doc = F.col(id_col).eqNullSafe(F.col(f"{OWN}id")) & (F.col(_TEXT_HASH) == F.col(f"{OWN}th2"))
    rest = keyed.where(~F.col(f"{OWN}may"))
    joined = materialise(keyed.where(f"{OWN}may").join(marked, same_doc, "left").drop(f"{OWN}id", f"{OWN}th2", f"{OWN}may"), "line-texts")

    lines = joined.where(F.col(f"{OWN}marks").isNotNull()).select(id_col, _TEXT_HASH, F.split(text_col, "\n", -1).alias(_LINES), F.explode(f"{OWN}marks").alias("m"))
    units = lines.select(id_col, _TEXT_HASH, "m.first", "m.last", "m.hash", F.expr(f"array_join(slice({_LINES}, m.first + 1, m.last - m.first + 1), '\\n')").alias("unit"))
    mixed = units.groupBy("hash").agg(F.min("unit").alias("a"), F.max("unit").alias("b")).where("a <> b").select("hash")
    mixed = materialise(mixed, "line-collisions")
    later = F.filter(f"{OWN}marks", lambda m: m["later"])
    if not mixed.isEmpty():
        # Several texts share a hash: for these the first place is found for each text.
        place = _place(id_col)
        split = units.join(mixed, "hash")
        first = split.groupBy("hash", "unit").agg(F.min(place).alias("start"))
        again = split.join(first, ["hash", "unit"]).select(id_col, _TEXT_HASH, F.struct("first", "last", "hash", (place > F.col("start")).alias("later")).alias("m"))
        again = again.groupBy(F.col(id_col).alias(f"{OWN}id"), F.col(_TEXT_HASH).alias(f"{OWN}th2")).agg(F.collect_set("m").alias(f"{OWN}again"))
        joined = joined.join(again, same_doc, "left").drop(f"{OWN}id", f"{OWN}th2")
        retold = F.coalesce(f"{OWN}again", F.array().cast(joined.schema[f"{OWN}again"].dataType))
        own = F.filter(later, lambda m: ~F.exists(retold, lambda x: (x["first"] == m["first"]) & (x["last"] == m["last"])))
        later = F.concat(own, F.filter(retold, lambda m: m["later"]))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform(later, lambda m: F.sequence(m["first"], m["last"])))))
    cut = joined.withColumn(f"{OWN}gone", F.when(F.size(gone) > 0, gone)).withColumn(_LINES, F.split(text_col, "\n", -1))
    kept = F.expr(f"array_join(transform(array_except(sequence(0, size({_LINES}) - 1), {OWN}gone), i -> get({_LINES}, i)), '\\n')")
    text = F.when(F.col(f"{OWN}gone").isNull(), F.col(text_col)).otherwise(kept)
    out = cut.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), f"{OWN}gone")
    out = out.unionByName(rest.select(*docs.columns, F.lit(None).cast("array<int>").alias(f"{OWN}gone")))
    return out if report else out.select(*docs.columns)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = None) -> DataFrame:
    """(id, n_lines, n_removed, removed, kept_md5) of every row; removed lists line numbers from 0."""
    narrow = docs.select(id_col, text_col, F.coalesce(F.size(F.split(text_col, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    narrow = narrow.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
    out = dedup(narrow, id_col, text_col, passage_words, report=True)
    return out.select(
        id_col,
        "n_lines",
        F.when(F.col(f"{OWN}gone").isNull(), 0).otherwise(F.size(f"{OWN}gone")).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(f"{OWN}gone", ","), F.lit("")).alias("removed"),
        F.md5(text_col).alias("kept_md5"),
    )


SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS th, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT *, list_transform(ls, lambda l: ('0x' || substr(md5(l), 1, 15))::BIGINT) AS hs FROM docs),
rolled AS (SELECT *, list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN i = 1 THEN hs[1] ELSE xor((hs[i - 1] & 576460752303423487) << 1, hs[i]) END) AS rs FROM hashed),
ended AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR (i > 1 AND rs[i] < rs[i - 1] AND rs[i] <= rs[i + 1])) AS es FROM rolled),
units AS (
  SELECT doc_id, th, j, CASE WHEN j = 1 THEN 1 ELSE es[j - 1] + 1 END AS a, es[j] AS b, ls FROM (SELECT *, unnest(range(1, len(es) + 1)) AS j FROM ended)
), chunks AS (
  SELECT doc_id, th, a, b, array_to_string(ls[a:b], chr(10)) AS unit FROM units WHERE b > a AND len(list_filter(ls[a:b], lambda x: trim(x) <> '')) >= 2
), gone AS (
  SELECT DISTINCT doc_id, th, unnest(range(a, b + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id NULLS LAST, th, a) AS n FROM chunks) WHERE n > 1
), cut AS (SELECT doc_id, th, list(i ORDER BY i) AS g FROM gone GROUP BY doc_id, th),
texts AS (SELECT doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS th, string_split(text, chr(10)) AS ls FROM documents)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  coalesce(array_to_string(list_transform(g, lambda x: x - 1), ','), '') AS removed,
  CASE WHEN g IS NULL THEN md5(text) ELSE md5(array_to_string(list_transform(list_filter(range(1, len(d.ls) + 1), lambda i: NOT list_contains(g, i)), lambda i: d.ls[i]), chr(10))) END AS kept_md5
FROM texts d LEFT JOIN cut ON d.doc_id IS NOT DISTINCT FROM cut.doc_id AND d.th = cut.th
"""
