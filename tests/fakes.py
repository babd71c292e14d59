"""A network of tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from urllib.parse import parse_qs, unquote, urlsplit

from chronofold.sources.registry import Archive
from chronofold.sources.transport import FetchError, Response

HEAD = ["timestamp", "original", "mimetype", "statuscode", "digest", "length"]


def archive(name="x", **more):
    return Archive(name, name, cdx_endpoint=f"http://{name}.test/cdx?url={{url}}", cdx_access="online", **more)


@dataclass
class Net:
    """pages: url to status and body, or an error class; captures: rows of each archive's index."""

    pages: dict = field(default_factory=dict)
    captures: dict = field(default_factory=dict)
    broken: dict = field(default_factory=dict)  # archive to error class or status
    lists_hosts: bool = True
    dead_hosts: tuple = ()
    fails_hosts: bool = False

    def resolves(self, host):
        return host not in self.dead_hosts

    def healthy(self, url, timeout=5.0):
        return True

    def get(self, url, timeout, limit=None):
        parts = urlsplit(url)
        if not parts.hostname.endswith(".test"):
            page = self.pages.get(url, (404, b""))
            if isinstance(page, str):
                raise FetchError(page)
            return Response(page[0], page[1], url, "text/html; charset=utf-8")
        name = parts.hostname.split(".")[0]
        trouble = self.broken.get(name)
        if isinstance(trouble, str):
            raise FetchError(trouble)
        if trouble:
            return Response(trouble)
        q = {k: v[0] for k, v in parse_qs(parts.query).items()}
        wanted = unquote(q["url"])
        rows = self.captures.get(name, [])
        if q.get("matchType") == "domain":
            d = wanted.strip("/")
            lines = [f"k {r[0]} {r[1]} {r[2]}" for r in rows if d in urlsplit(r[1]).hostname]
            return Response(200, "\n".join(lines).encode())
        if q.get("matchType") == "host" and self.fails_hosts:
            return Response(500)
        if "showNumPages" in q:
            return Response(200, b"no")
        if q.get("matchType") == "host":
            rows = [r for r in rows if urlsplit(r[1]).hostname.removeprefix("www.") == wanted] if self.lists_hosts else []
        else:
            rows = [r for r in rows if r[1] == wanted]
        rows = sorted(rows)
        if q.get("sort") == "reverse":
            rows = rows[::-1]
        rows = rows[: int(q["limit"])] if "limit" in q else rows
        return Response(200, json.dumps([HEAD, *rows]).encode() if rows else b"")
