"""The registry of archives: one descriptor a folder, tens of files, read by the driver.

What a descriptor says is looked up by dotted paths. Its comments are read too, as some admit
that an archive holds pages older than itself.
"""

from __future__ import annotations

import shutil
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from chronofold import schemas as S

FILE = "web-archive.txt"


@dataclass(frozen=True)
class Archive:
    id: str
    name: str
    rate_limited: bool = True
    cdx_endpoint: str | None = None
    cdx_access: str | None = None
    timemap_endpoint: str | None = None
    timemap_access: str | None = None
    established: int | None = None
    default_collection: str | None = None
    collections: list[str] = field(default_factory=list)

    @property
    def usable_cdx(self) -> bool:
        return bool(self.cdx_endpoint) and self.cdx_access == "online"

    @property
    def usable_timemap(self) -> bool:
        return bool(self.timemap_endpoint) and self.timemap_access == "online"

    def collection_ids(self) -> list[str | None]:
        return list(self.collections) or [self.default_collection]

    def listing_bases(self) -> list[str]:
        """Where a whole domain can be listed: the endpoint before its query, for each collection."""
        endpoint = self.cdx_endpoint or ""
        if "{collection}" not in endpoint:
            return [b for b in [endpoint.split("?", 1)[0]] if b]
        return [endpoint.replace("{collection}", c).split("?", 1)[0] for c in self.collection_ids() if c]


@dataclass(frozen=True)
class Witness:
    name: str
    requests_per_second: float
    timeout_seconds: float
    archive: Archive | None = None


# Requests a second, seconds, and one archive that answers slowly.
LIVE_RATE, LIVE_TIMEOUT = 100.0, 10.0
ARCHIVE_RATE, LIMITED_RATE, ARCHIVE_TIMEOUT = 10.0, 10.0, 20.0
TIMEOUTS = {"ia": 120.0}


def look(data: object, path: str) -> object:
    """What stands at a dotted path; None where there is nothing."""
    for key in path.split("."):
        if not isinstance(data, dict):
            return None
        data = data.get(key)
    return data


def display_name(value: object) -> str:
    """A name, or a list of one and of tables with other names, the English one before any alternative."""
    match value:
        case str():
            return value
        case [first, *others]:
            more = next((t[k] for k in ("en", "alt") for t in others if isinstance(t, dict) and t.get(k)), None)
            return str(first) if more is None else f"{first} ({more})"
    return "unknown"


def year(value: object) -> int | None:
    text = "" if value is None else str(value).strip()
    return int(text) if text.isdigit() else None


_ENDPOINTS = {"cdx": "api.cdx.query", "timemap": "api.memento.timemap", "timegate": "api.memento.timegate"}


def compile_one(text: str, folder: str) -> Archive | None:
    """A descriptor's archive; None without any endpoint. Collections count only if an endpoint asks for one."""
    data = tomllib.loads(text)
    endpoint = {kind: look(data, f"{path}.endpoint") for kind, path in _ENDPOINTS.items()}
    if not any(endpoint.values()):
        return None
    asked = any("{collection}" in (endpoint[kind] or "") for kind in ("cdx", "timemap"))
    named = [look(c, "id") for c in look(data, "archive.scope.collections") or []]
    collections = [c for c in named if c and asked]
    limited = look(data, "api.rate_limit")
    return Archive(
        id=look(data, "archive.id") or folder,
        name=display_name(look(data, "archive.name")),
        rate_limited=limited is None or bool(limited),
        established=year(look(data, "archive.established")),
        default_collection=next(iter(collections), None),
        collections=collections,
        **{f"{kind}_endpoint": endpoint[kind] for kind in ("cdx", "timemap")},
        **{f"{kind}_access": look(data, f"{_ENDPOINTS[kind]}.access") for kind in ("cdx", "timemap")},
    )


def _descriptors(folder: Path | str) -> list[tuple[str, str]]:
    return [(p.parent.name, p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob(f"*/{FILE}"))]


def compile_all(folder: Path | str) -> list[Archive]:
    found = (compile_one(text, name) for name, text in _descriptors(folder))
    return sorted((a for a in found if a), key=lambda a: a.id)


def remark(line: str) -> tuple[str, str] | None:
    """The name that a line assigns to, and the comment behind the value; a sign within quotes begins none."""
    name, equals, value = line.partition("=")
    name = name.strip()
    if not equals or not name.replace(".", "_").isidentifier():
        return None
    quote = None
    for at, c in enumerate(value):
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#":
            said = value[at + 1 :].strip()
            return (name, said) if said else None
    return None


def began(said: str) -> int | None:
    """The year of "capturing began in 2007" or "began capturing in 2007", whatever the form of the verb."""
    words = [w.lower().strip("()[],;:") for w in said.split()]
    for verb, other, link, when in zip(words, words[1:], words[2:], words[3:], strict=False):
        told = "began" in (verb, other) and any(w.startswith("captur") for w in (verb, other))
        if told and link == "in" and when[:4].isdigit() and len(when) >= 4:
            return int(when[:4])
    return None


def backfill_notes(folder: Path | str) -> list[dict]:
    """Comments that admit backfilling, with the year that capturing began if they tell it."""
    notes = []
    for name, text in _descriptors(folder):
        said = [r for r in map(remark, text.splitlines()) if r and "backfill" in r[1].lower()]
        try:
            established = year(look(tomllib.loads(text), "archive.established")) if said else None
        except tomllib.TOMLDecodeError:
            established = None
        for field_name, comment in said:
            since = began(comment)
            differs = since is not None and established is not None and since != established
            notes.append(dict(id=name, field=field_name, comment=comment, established=established, capturing_began=since, mismatch=differs))
    return notes


def established_years(folder: Path | str) -> dict[str, int]:
    """For each archive the latest year that is known: when it was founded, when it began to capture."""
    said = [(a.id, a.established) for a in compile_all(folder)] + [(n["id"], n["capturing_began"]) for n in backfill_notes(folder)]
    return {f"archive:{name}": y for name, y in sorted((x for x in said if x[1] is not None), key=lambda x: x[1])}


def witnesses(
    folder: Path | str, only: set[str] | None = None, exclude: set[str] = frozenset(), shards: int = 1, timeouts: dict[str, float] | None = None, rates: dict[str, float] | None = None
) -> list[Witness]:
    """The live web and every archive with something online; shards share the rates. ``timeouts`` and ``rates`` are by archive."""
    timeouts, rates = TIMEOUTS if timeouts is None else timeouts, rates or {}
    usable = [a for a in compile_all(folder) if "online" in (a.cdx_access, a.timemap_access) and (only is None or a.id in only) and a.id not in exclude]
    usual = {True: LIMITED_RATE, False: ARCHIVE_RATE}
    archives = [Witness(f"archive:{a.id}", rates.get(a.id, usual[a.rate_limited]) / shards, timeouts.get(a.id, ARCHIVE_TIMEOUT), a) for a in usable]
    return [Witness(S.LIVE, LIVE_RATE / shards, LIVE_TIMEOUT), *archives]


def table(spark: SparkSession, archives: list[Archive]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(a)[n] for n in S.REGISTRY.names) for a in archives], S.REGISTRY)


def import_from(source: Path | str, target: Path | str) -> int:
    """Replace the registry by the descriptors of another folder, which are read before anything goes."""
    found = _descriptors(source)
    if not found:
        raise ValueError(f"no {FILE} in the folders of {source}")
    target = Path(target)
    target.mkdir(parents=True, exist_ok=True)
    for old in target.iterdir():
        if old.is_dir():
            shutil.rmtree(old)
    for name, text in found:
        (target / name).mkdir()
        (target / name / FILE).write_text(text, encoding="utf-8")
    return len(found)
