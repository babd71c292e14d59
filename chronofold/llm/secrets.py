r"""Secrets, judged by corpus-wide ownership frequency.

Every candidate value is hashed, and the hashes are counted over the whole corpus by
distinct owners and distinct repositories. A value that several owners hold is a widely
copied example; one that keeps to its owner looks live.

*Base* spans come from three patterns, leftmost and non-overlapping for each kind; a match
that is too short is dropped and its text is not searched again. *Added* spans are
``provider`` (tokens whose shape names their issuer, key blocks, signed web tokens) and
``generic`` (long mixed tokens with no name beside them): a generic token is far too weak a
sign alone, so it counts only if its value is owner-specific.

DataFrame functions only. One pass over the texts writes the candidates of each row, a
narrow table; distinct (hash, owner) and (hash, repository) pairs are aggregated before
they are shuffled, so a value that fills a third of the rows costs a row for each task, and
finds of such a value are judged where they are (``join_counted``). No group is ever gathered
except the candidates of one row, and work on these is in proportion to them.

An owner is a value of ``owner_col``. A repository is a value of ``repo_col``; without one,
each distinct text is a repository, so copies of a text count once.

A null text counts as empty, a null owner or repository as one owner or repository of its
own; rows that repeat are each given their result. Columns beyond those named are not read.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import OWN, join_counted, let, materialise

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "provider", "generic")

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: For each kind: the pattern, the group that holds the value, its least length.
PATTERNS = {
    "assign": (_ASSIGN, 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "provider": (r"(?<![A-Za-z0-9])(?:gh[opsur]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 16),
    "generic": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9][A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+_-][A-Za-z0-9+/_-]{23,}", 0, 24),
}
_NAMES = ("passw", "secret", "token", "apikey", "api_key")


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    low = F.lower(text)
    return {
        "assign": lambda: (text.contains("=") | text.contains(":")) & _any(low.contains(n) for n in _NAMES),
        "access": lambda: text.contains("AKIA"),
        "hex": lambda: text.rlike("[0-9a-f]{32}"),
        "provider": lambda: _any(text.contains(n) for n in ("gh", "xox", "k_", "AIza", "eyJ", "PRIVATE")),
        "generic": lambda: text.rlike("[A-Za-z0-9+/_-]{24}"),
    }[kind]()


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


#: Elements whose running sums are made at once; a sum that grows an array copies it, so arrays are kept as short as this.
RUN = 256


def _running(sizes: Column, first: Column) -> Column:
    """Where each of a few (gap, own) starts, from ``first`` on."""
    begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, s: F.struct((a["at"] + s["gap"] + s["own"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + s["gap"])).alias("starts"))
    return F.aggregate(sizes, begin, step, lambda a: a["starts"])


def _starts(sizes: Column) -> Column:
    """Where each of many (gap, own) starts: runs of runs, each summed by itself from the sum before it."""

    def cut(items: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / size), F.lit(0)).cast("int")), lambda i: F.slice(items, i * size + 1, F.lit(size)))

    def total(run: Column) -> Column:
        return F.struct(F.lit(0).alias("gap"), F.aggregate(run, F.lit(0), lambda a, s: a + s["gap"] + s["own"]).alias("own"))

    def level(items: Column, first: Column, depth: int) -> Column:
        if not depth:
            return _running(items, first)
        body = lambda runs: let(level(F.transform(runs, total), first, depth - 1), lambda begins: F.flatten(F.zip_with(runs, begins, _running)))
        return let(cut(items, RUN), body)

    return level(sizes, F.lit(0), 2)


def matches(text: Column, kind: str) -> Column:
    """The matches of a kind that are long enough: (start, kind, end, value)."""
    pattern, group, least = PATTERNS[kind]
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def located(whole: Column, rest: Column) -> Column:
        # A match starts after the gaps and matches before it and its own gap.
        sizes = F.zip_with(whole, rest["gaps"], lambda m, g: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("own")))
        return let(sizes, lambda sizes: let(_starts(sizes), lambda starts: F.transform(whole, lambda m, i: one(F.get(starts, i), m, F.get(rest["value"], i)))))

    def some(whole: Column) -> Column:
        rest = F.struct(value.alias("value"), F.split(text, pattern, -1).alias("gaps"))
        return F.when(F.size(whole) > 0, let(rest, lambda rest: located(whole, rest))).otherwise(none)

    def one(start: Column, m: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(m)).alias("end"), value.alias("value"))

    kept = F.filter(let(whole, some), lambda x: F.length(x["value"]) >= least)
    return F.when(_hint(kind, text), kept).otherwise(none)


def _is(kind: int, x: Column) -> Column:
    return x["kind"] == kind


def _placeholder(value: Column) -> Column:
    """Values nobody would guard: a few distinct characters, or a word that says so."""
    return (F.size(F.array_distinct(F.split(value, ""))) < 6) | F.lower(value).rlike("example|sample|changeme|placeholder|your_|xxxx")


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 1, max_repos: int = 20
) -> DataFrame:
    """One row for each row of ``docs``.

    n_assign, n_access, n_hex and base_sha256 describe the base spans, spans names all.
    n_live counts the spans whose value at most ``max_owners`` owners and ``max_repos``
    repositories hold and that is no placeholder; n_copied counts the others. verdicts has
    ``kind:start:end:owners:repositories:live|copied`` of each span. Without ``repo_col``
    each text stands for a repository, its copies for the same one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    repo = F.col(repo_col) if repo_col else F.xxhash64(text)
    found = F.concat(*(matches(F.col(f"{OWN}t"), k) for k in KINDS))
    rows = docs.select(
        F.col(id_col), F.struct(F.col(owner_col).cast("string")).alias(f"{OWN}owner"), F.struct(repo.cast("string")).alias(f"{OWN}repo"), text.alias(f"{OWN}t")
    ).select(id_col, f"{OWN}owner", f"{OWN}repo", found.alias(f"{OWN}found"))
    rows = materialise(rows.withColumn(f"{OWN}row", F.monotonically_increasing_id()), "secrets")

    some = rows.where(F.size(f"{OWN}found") > 0)
    each = some.select(f"{OWN}row", f"{OWN}owner", f"{OWN}repo", F.explode(f"{OWN}found").alias("x")).select(
        f"{OWN}row", f"{OWN}owner", f"{OWN}repo", "x.start", "x.kind", "x.end", F.sha2("x.value", 256).alias("hash"), _placeholder(F.col("x.value")).alias("dull")
    )
    count = lambda c, n: each.select("hash", c).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias(n))
    times = each.groupBy("hash").agg(F.count(F.lit(1)).alias("times"))
    owned = materialise(count(f"{OWN}owner", "owners").join(count(f"{OWN}repo", "repos"), "hash").join(times, "hash"), "secret-owners")
    total = owned.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    judged = join_counted(each.select(f"{OWN}row", "start", "kind", "end", "hash", "dull"), owned, "hash", "times", total).withColumn(
        "live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos) & ~F.col("dull")
    )
    # A generic token that lies within a named one is the same find: one that starts before and ends later, or starts within.
    generic = F.col("kind") == KINDS.index("generic")
    # Both windows look back, as one that looks ahead is summed anew for every row.
    before, after = (Window.partitionBy(f"{OWN}row").orderBy(*(way(c) for c in ("start", "kind", "end"))).rowsBetween(Window.unboundedPreceding, -1) for way in (F.asc, F.desc))
    inside = (F.max(F.when(~generic, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(~generic, F.col("start"))).over(after) < F.col("end"))
    judged = judged.withColumn("same", generic & F.coalesce(inside, F.lit(False)))
    spans = F.array_sort(F.collect_list(F.when(~generic | (F.col("live") & ~F.col("same")), F.struct("start", "kind", "end", "owners", "repos", "live"))))
    per_row = judged.groupBy(f"{OWN}row").agg(spans.alias("all"))
    name = lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"], x["end"])
    base = F.filter("all", lambda x: x["kind"] < len(BASE))
    number = lambda test: F.size(F.filter("all", test)).cast("long")
    finished = lambda df: df.select(
        id_col,
        *(number(partial(_is, i)).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("all", name), ",").alias("spans"),
        number(lambda x: x["live"]).alias("n_live"),
        number(lambda x: ~x["live"]).alias("n_copied"),
        F.array_join(F.transform("all", lambda x: F.concat_ws(":", name(x), x["owners"], x["repos"], F.when(x["live"], "live").otherwise("copied"))), ",").alias("verdicts"),
    )
    empty = F.array().cast(per_row.schema["all"].dataType)
    return finished(some.select(id_col, f"{OWN}row").join(per_row, f"{OWN}row")).unionByName(
        finished(rows.where(F.size(f"{OWN}found") == 0).select(id_col).withColumn("all", empty))
    )
