r"""URLs as Column expressions: canonical form, ids, host and match keys.

A URL is split into scheme, authority, path and query by the pattern of the RFC, after the characters that URL parsers ignore (leading controls and spaces; tabs and line
breaks anywhere) have gone. A URL whose authority has unbalanced brackets is invalid: its
parts, and all that is derived from them, are null, except the match key, which falls back on
the URL in lower case.

Query pairs are decoded and encoded like HTML forms: ``+`` is a space, a stray ``%`` stays as
it is, bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid")
#: Schemes after which an empty authority is still written.
_WITH_AUTHORITY = ("http", "https", "ftp", "file", "ws", "wss", "rtsp", "sftp", "svn", "nfs", "rsync", "telnet", "gopher", "imap", "mms", "shttp", "snews", "prospero", "wais", "nntp")
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_BRACKETED = r"^([^\[\]]*@)?\[[0-9A-Fa-f:.vV%]+\](:[0-9]*)?$"


_CONTROLS = "".join(map(chr, range(0x21)))


def clean(url: Column) -> Column:
    return F.ltrim(F.translate(url, "\t\r\n", ""), F.lit(_CONTROLS))


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _SPLIT, i)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Null if its brackets say that the URL is invalid; empty if there is none."""
    found = _part(url, 2)
    return F.when(~found.rlike(r"[\[\]]") | found.rlike(_BRACKETED), found)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def decode(text: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def form(query: Column, drop: tuple[str, ...] = ()) -> Column:
    """The query's pairs without those whose key is in ``drop``, sorted by key and value, encoded."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), decode(F.regexp_replace(p, "(?s)^[^=]*=", ""))).otherwise("").alias("v")),
    )
    if drop:
        pairs = F.filter(pairs, lambda p: ~p["k"].isin(*drop))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")


def canonical(url: Column) -> Column:
    """Lower-case scheme (http if absent) and authority without default port, path without trailing slashes, sorted query without tracking keys, no fragment."""
    url = clean(F.trim(url))
    kind = F.when(scheme(url) == "", "http").otherwise(scheme(url))
    # The default port goes with its scheme only.
    where = F.regexp_replace(F.regexp_replace(F.concat(kind, F.lit("://"), F.lower(authority(url))), "(?s)^(http://.*):80$", "$1"), "(?s)^(https://.*):443$", "$1")
    tail = F.regexp_replace(path(url), "/+$", "")
    tail = F.when(tail == "", "/").otherwise(tail)
    bare = where.endswith("://")
    rest = (
        F.when(~bare & tail.startswith("/"), F.concat(where, tail))
        .when(~bare, F.concat(where, F.lit("/"), tail))
        .when(bare & (tail.startswith("//") | (kind.isin(*_WITH_AUTHORITY) & tail.startswith("/"))), F.concat(kind, F.lit("://"), tail))
        .when(bare, F.concat(kind, F.lit(":"), tail))
    )
    return F.concat(rest, F.regexp_replace(F.concat(F.lit("?"), form(query(url), TRACKING)), r"^\?$", ""))


def url_id(canonical_url: Column) -> Column:
    return F.substring(F.sha2(canonical_url, 256), 1, 24)


def domain(canonical_url: Column) -> Column:
    """The authority of a canonical URL, with user and odd port if it has them."""
    return authority(canonical_url)


def hostname(where: Column) -> Column:
    """Lower-case host of an authority, without user and port."""
    return F.lower(F.regexp_extract(where, r"^(?:.*@)?\[?((?<=\[)[^\]]*|[^:\[]*)", 1))


def _schemed(url: Column) -> Column:
    return clean(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url)))


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\d*\.", "")


def host_key(url: Column) -> Column:
    """Host without trailing dots and a www label; empty for an invalid URL."""
    return F.coalesce(_bare(hostname(authority(_schemed(url)))), F.lit(""))


def match_key(url: Column) -> Column:
    """Host key, odd port, path and sorted query in lower case; tracking keys stay."""
    full = _schemed(url)
    where = authority(full)
    port = F.regexp_extract(where, r"^(?:.*@)?(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
    number = F.when(port.rlike("^[0-9]+$"), port.try_cast("int"))
    odd = F.when(~number.isin(0, 80, 443), F.concat(F.lit(":"), number.cast("string"))).otherwise("")
    tail = F.regexp_replace(F.regexp_replace(path(full), "/+$", ""), "^$", "/")
    key = F.concat(_bare(hostname(where)), odd, tail, F.regexp_replace(F.concat(F.lit("?"), form(query(full))), r"^\?$", ""))
    bad_port = (port != "") & (number.isNull() | (number > 65535))
    return F.lower(F.when(where.isNull() | bad_port, url).otherwise(key))


def plain_domain(text: Column) -> Column:
    """A domain as typed: lower case, no scheme, no slashes around."""
    return F.regexp_replace(F.replace(F.replace(F.lower(text), F.lit("http://"), F.lit("")), F.lit("https://"), F.lit("")), "^/+|/+$", "")


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty if it has none or is invalid."""
    return F.coalesce(hostname(authority(clean(url))), F.lit(""))


def canonical_host(host_name: Column) -> Column:
    """Without its first label if that is www and a number."""
    return F.regexp_replace(host_name, r"^www\d*\.", "")


def in_domain(host_name: Column, domain_name: Column) -> Column:
    return (host_name != "") & ((host_name == domain_name) | host_name.endswith(F.concat(F.lit("."), domain_name)))


def has_path(url: Column) -> Column:
    return F.regexp_replace(path(clean(url)), "^/+|/+$", "") != ""


def is_page(mime: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1))).isin("text/html", "application/xhtml+xml")


def fill(template: Column, url: Column, collection: Column | None = None) -> Column:
    """An endpoint with the URL, quoted in full, and the collection put in."""
    quoted = F.replace(encode(url), F.lit("+"), F.lit("%20"))
    filled = F.replace(template, F.lit("{url}"), quoted)
    return F.replace(filled, F.lit("{collection}"), F.coalesce(collection, F.lit("")) if collection is not None else F.lit(""))


def shard(uid: Column, shards: int) -> Column:
    return F.conv(F.substring(uid, 1, 8), 16, 10).cast("bigint") % shards


def scope_type(url_type: Column, canonical_url: Column) -> Column:
    """root or deep: as given, else by the canonical path."""
    return F.when(url_type.isin("root", "deep"), url_type).otherwise(F.when(path(canonical_url) == "/", "root").otherwise("deep"))
