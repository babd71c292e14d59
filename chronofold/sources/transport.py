"""How connectors reach the network. Tests and other networks bring their own transport."""

from __future__ import annotations

import http.client
import socket
import urllib.error
import urllib.request
from dataclasses import dataclass
from typing import Protocol

AGENT = "chronofold/1.0"
BODY_LIMIT = 1_000_000


class FetchError(Exception):
    """A failed request; ``penalise`` is false for a failure that was merely remembered."""

    def __init__(self, error_class: str, message: str = "", penalise: bool = True):
        super().__init__(message or error_class)
        self.error_class, self.penalise = error_class, penalise


@dataclass
class Response:
    status: int
    body: bytes = b""
    url: str = ""
    content_type: str = ""

    @property
    def text(self) -> str:
        return self.body.decode("utf-8", "replace")


class Transport(Protocol):
    """Must survive pickling, as it is sent to executors."""

    def get(self, url: str, timeout: float, limit: int | None = None) -> Response: ...

    def resolves(self, host: str) -> bool: ...

    def healthy(self, url: str, timeout: float = 5.0) -> bool: ...


class HttpTransport:
    def get(self, url: str, timeout: float, limit: int | None = None, method: str = "GET") -> Response:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT}, method=method)
        try:
            try:
                answer = urllib.request.urlopen(request, timeout=timeout)  # noqa: S310
            except urllib.error.HTTPError as e:
                answer = e
            with answer:
                body = answer.read() if limit is None else answer.read(limit)
                return Response(answer.status, body, answer.url, answer.headers.get("Content-Type", ""))
        except TimeoutError as e:
            raise FetchError("timeout", str(e)) from e
        except urllib.error.URLError as e:
            raise FetchError("timeout" if isinstance(e.reason, TimeoutError) else "connection_error", str(e)) from e
        except (http.client.HTTPException, ValueError) as e:
            raise FetchError("malformed_response", str(e)) from e
        except OSError as e:
            raise FetchError("connection_error", str(e)) from e

    def resolves(self, host: str) -> bool:
        try:
            socket.getaddrinfo(host, None)
        except socket.gaierror:
            return False
        return True

    def healthy(self, url: str, timeout: float = 5.0) -> bool:
        """Whether there is an answer at all; its body isn't asked for."""
        try:
            return self.get(url, timeout, 1, "HEAD").status < 500
        except FetchError:
            return False
