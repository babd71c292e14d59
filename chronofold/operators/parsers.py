r"""Parsers of archive answers: one text to an array of captures, as Column expressions.

Three shapes of an index are known: a JSON array of rows under a header, and lines that are
JSON objects or plain fields, which may mix. Timemaps come as JSON or as links.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold import schemas as S
from chronofold.functions.times import memento_time, timestamp14

CAPTURES = T.ArrayType(S.CAPTURE)
_ROWS = "array<array<string>>"
_OBJECT = "struct<timestamp:string,url:string,mime:string,status:string,digest:string,filename:string,offset:string,length:string>"
_TIMEMAP = "struct<mementos:struct<list:array<struct<datetime:string,uri:string>>>>"
# Fixed value: a link of exactly this relation, its target and its time.
_LINK = r'<([^>]+)>\s*;\s*rel="memento"[^,]*?datetime="([^"]+)"'


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _capture(t: Column, url, mime="", status="", digest="", file="", record="", length=None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        t.cast("timestamp").alias("capture_time"), as_col(url).alias("memento_url"), as_col(mime).alias("mime_type"), as_col(status).alias("status"), as_col(digest).alias("digest"),
        as_col(file).alias("warc_file"), as_col(record).alias("record_id"), F.lit("success").alias("query_status"), as_col(length).try_cast("bigint").alias("content_length"),
    )


def _timed(captures: Column) -> Column:
    return F.filter(captures, lambda c: c["capture_time"].isNotNull())


def table(text: Column) -> Column:
    """Rows under a header whose names say where each field is; rows too short for a named field, or without a time, go."""
    names = ("timestamp", "original", "mimetype", "statuscode", "digest", "filename", "length")

    def one(row: Column, at: Column) -> Column:
        value = lambda n: F.when(at[n] > 0, F.coalesce(F.get(row, at[n] - 1), F.lit("None" if n == "statuscode" else None))).otherwise(None if n == "length" else "")
        short = at["most"] > F.size(row)
        time = F.when((at["timestamp"] > 0) & ~short, timestamp14(value("timestamp")))
        return _capture(time, value("original"), value("mimetype"), value("statuscode"), value("digest"), value("filename"), value("timestamp"), value("length"))

    def places(header: Column) -> Column:
        each = [F.array_position(header, n) for n in names]
        return F.struct(*(e.alias(n) for e, n in zip(each, names, strict=True)), F.greatest(*each).alias("most"))

    def read(rows: Column) -> Column:
        some = F.filter(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: F.size(r) > 0)
        return _let(places(F.get(rows, F.lit(0))), lambda at: F.transform(some, lambda r: one(r, at)))

    return _timed(_let(F.from_json(text, _ROWS), read))


def _object_line(line: Column) -> Column:
    return _let(F.from_json(line, _OBJECT), lambda o: _object(line, o))


def _object(line: Column, o: Column) -> Column:
    # An object's missing names are empty texts; a status that is null is the word.
    present = lambda name: F.coalesce(o[name], F.lit(""))
    status = F.coalesce(o["status"], F.when(line.rlike(r'"status"\s*:\s*null'), "None").otherwise(""))
    return _capture(timestamp14(present("timestamp")), present("url"), present("mime"), status, present("digest"), present("filename"), F.concat_ws(":", present("offset"), present("length")), o["length"])


def _field_line(line: Column) -> Column:
    return _let(F.split(F.trim(line), r"\s+"), _fields)


def _fields(f: Column) -> Column:
    n, at = F.size(f), lambda i: F.get(f, F.lit(i))
    time = F.when((n >= 7) & at(1).rlike("^[0-9]{4,14}$"), timestamp14(at(1)))
    length = F.when(n == 7, at(6)).when(n >= 11, at(8))
    file = F.when(n >= 11, at(10)).otherwise("")
    record = F.when(n >= 11, F.concat_ws(":", at(9), at(8))).otherwise(at(1))
    return _capture(time, at(2), at(3), at(4), at(5), file, record, length)


def lines(text: Column) -> Column:
    """Each line an object or plain fields; others go."""
    some = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    return _timed(F.transform(some, lambda x: F.when(x.startswith("{"), _object_line(x)).otherwise(_field_line(x))))


def is_table(text: Column) -> Column:
    return F.trim(text).rlike(r"^\[\s*\[") & F.from_json(text, _ROWS).isNotNull()


def index(text: Column) -> Column:
    """An index answer in any of its shapes."""
    return F.when(is_table(text), table(F.trim(text))).when(F.trim(text).rlike(r"^\[\s*\]$"), F.array().cast(CAPTURES)).otherwise(lines(text))


def is_empty(text: Column) -> Column:
    """A JSON list without a row after the first."""
    generic = F.from_json(text, "array<string>")
    rows = F.filter(F.slice(generic, 2, F.greatest(F.size(generic), F.lit(1))), lambda r: ~F.coalesce(r, F.lit("")).isin("", "[]", "{}", "0", "false"))
    return F.trim(text).startswith("[") & generic.isNotNull() & (F.size(rows) == 0)


def timemap(text: Column) -> Column:
    """Mementos of a JSON or link timemap; only the relation "memento" alone counts in links."""
    listed = F.from_json(F.trim(text), _TIMEMAP)["mementos"]["list"]
    from_json = F.transform(listed, lambda m: _capture(memento_time(F.coalesce(m["datetime"], F.lit(""))), F.coalesce(m["uri"], F.lit("")), record=F.coalesce(m["datetime"], F.lit(""))))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(_LINK), F.lit(1)).alias("uri"), F.regexp_extract_all(text, F.lit(_LINK), F.lit(2)).alias("dt"))
    from_links = F.transform(pairs, lambda p: _capture(memento_time(p["dt"]), p["uri"], record=p["dt"]))
    return _timed(F.coalesce(F.when(F.trim(text).rlike(r"^[{\[]"), F.coalesce(from_json, F.array().cast(CAPTURES))), from_links))


def is_malformed(kind: Column, text: Column, captures: Column) -> Column:
    """A non-empty answer that gave no capture, and is an index or starts like a page."""
    return (F.size(captures) == 0) & ((kind == "cdx") | F.trim(text).startswith("<"))


def to_text(captures: Column) -> Column:
    """Captures as JSON rows, the form in which a host's answer is kept."""
    return F.to_json(F.transform(captures, lambda c: F.array(*(c[n].cast("string") for n in S.CAPTURE.names))))


def from_text(text: Column) -> Column:
    rows = F.from_json(text, _ROWS)
    return F.transform(rows, lambda r: F.struct(*(F.get(r, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(S.CAPTURE))))


def split_resume(text: Column) -> Column:
    """struct(body, key): a listing and the key of its next page. JSON has it as a last row of one field, text after a blank line."""
    rows = F.from_json(text, _ROWS)
    last = F.get(rows, F.size(rows) - 1)
    keyed = is_table(text) & (F.size(rows) > 1) & (F.size(last) == 1) & (last != F.get(rows, F.lit(0)))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    after = bare(F.get(F.split(bare(text), "\n\n"), F.lit(1)))
    key = F.when(is_table(text), F.when(keyed, F.get(last, F.lit(0)))).when(after != "", after)
    body = F.when(is_table(text), F.when(keyed, F.to_json(F.slice(rows, 1, F.size(rows) - 1))).otherwise(text)).otherwise(F.get(F.split(bare(text), "\n\n"), F.lit(0)))
    return F.struct(body.alias("body"), key.alias("key"))
