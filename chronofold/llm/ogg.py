r"""Ogg: a multiplexed container written and read page by page.

The reader takes nothing on trust. It finds pages by their capture pattern, verifies each
page's checksum, rebuilds packets from the lacing values (a segment of 255 goes on, a
shorter one ends the packet, a packet may go on over pages), keeps logical streams apart by
serial number, notices gaps in a stream's page numbers, and takes times from granule
positions. A page's granule is where the last packet that ends on it ends; the packets that
end before it on the page lie back from there by their durations, and one that isn't dated by
its page follows the one before it (``Stream.times``). Where a packet starts after the one before
it ended, something was lost: a gap of known length. A page that fails its checksum is passed over and counted; the packet that it
broke is dropped, all others are kept.

The media column stores a payload as 8-bit samples: a stream of PCM packets, multiplexed
with a second stream that describes it.

A null text is an empty text: its payload is 576 bytes of 255. Equal texts give equal bytes,
as serial numbers and granules come from the payload alone. Repeated rows are each given
their result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from chronofold.llm.common import map_texts

UNIT = 576
RATE = 8000
PACKET = 8 * UNIT
_HEADER = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_NONE = -1
PCM, NOTES = b"\x80pcm8", b"\x80notes"


def checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, neither mirrored nor inverted: the usual one over mirrored bytes, mirrored back."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Stream:
    """A logical stream as read."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of each packet: that of its page if it is the last to end there, else -1
    began: bool = False
    ended: bool = False
    lost: int = 0
    page: int | None = None
    part: bytes | None = None
    broken: set[int] = field(default_factory=set)  # packets before which pages are missing

    def times(self, duration: Callable[[bytes], int]) -> list[tuple[int, int]]:
        """Start and end of each packet, in granules; ``duration`` is a packet's length in these."""
        n = len(self.packets)
        span = [duration(p) for p in self.packets]
        end: list[int | None] = [g if g != _NONE else None for g in self.granules]
        for i in range(n - 2, -1, -1):  # back from the next packet, unless pages between are missing
            if end[i] is None and i + 1 not in self.broken and end[i + 1] is not None:
                end[i] = end[i + 1] - span[i + 1]
        for i in range(n):  # on from the one before
            if end[i] is None:
                end[i] = (end[i - 1] if i else 0) + span[i]
        return [(e - d, e) for e, d in zip(end, span, strict=True)]


class Writer:
    """Collects pages of several streams; a page ends when it is full or the caller says so."""

    def __init__(self):
        self.pages: list[bytes] = []
        self.count: dict[int, int] = {}

    def page(self, serial: int, lacing: bytes, body: bytes, granule: int, flags: int) -> None:
        n = self.count.get(serial, 0)
        self.count[serial] = n + 1
        head = _HEADER.pack(b"OggS", 0, flags, granule, serial, n, 0, len(lacing)) + lacing
        crc = struct.pack("<I", checksum(head + body))
        self.pages.append(head[:22] + crc + head[26:] + body)

    def packets(self, serial: int, packets: list[tuple[bytes, int]], first: bool = False, last: bool = False) -> None:
        """Packets with the granule that each ends at, over as many pages as they need."""
        lacing, body, granule, open_ = bytearray(), bytearray(), _NONE, False
        todo: list[tuple[bytes, bytes, int, int]] = []
        for data, at in packets:
            values = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
            done = 0
            while done < len(values):
                room = 255 - len(lacing)
                take = values[done : done + room]
                lacing += take
                body += data[255 * done : 255 * done + sum(take)]
                done += len(take)
                if done == len(values):
                    granule = at
                if len(lacing) == 255:
                    todo.append((bytes(lacing), bytes(body), granule, int(open_)))
                    open_ = done < len(values)
                    lacing, body, granule = bytearray(), bytearray(), _NONE
        if lacing or not todo:
            todo.append((bytes(lacing), bytes(body), granule, int(open_)))
        for i, (lace, data, at, cont) in enumerate(todo):
            self.page(serial, lace, data, at, cont | 2 * (first and i == 0) | 4 * (last and i == len(todo) - 1))

    def bytes(self) -> bytes:
        return b"".join(self.pages)


def read(data: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and the number of damaged or foreign stretches passed over."""
    streams: dict[int, Stream] = {}
    bad, at, end = 0, 0, len(data)
    while at < end:
        if data[at : at + 4] != b"OggS":
            bad += 1
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        if at + 27 > end:
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        page = data[at : at + size]
        if version or len(lacing) < n or len(page) < size or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        s = streams.setdefault(serial, Stream(serial))
        s.began |= bool(flags & 2)
        s.ended |= bool(flags & 4)
        if s.page is not None and number != s.page + 1:
            s.lost += 1
            s.part = None
            s.broken.add(len(s.packets))
        s.page = number
        body, ends = at + 27 + n, []
        if not flags & 1:
            s.part = b""  # what went on before, if anything, is broken off
        part, usable, first = s.part, s.part is not None, body
        for v in lacing:
            body += v
            if v < 255:
                if usable:
                    s.packets.append((part or b"") + data[first:body])
                    ends.append(len(s.packets) - 1)
                    s.granules.append(_NONE)
                part, usable, first = b"", True, body
        if lacing and lacing[-1] == 255:
            s.part = (part or b"") + data[first:body] if usable else None
        else:
            s.part = b""
        if ends:
            s.granules[ends[-1]] = granule
        at += size
    return streams, bad


def encode(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """Two multiplexed streams: the samples, and notes on them."""
    serial = zlib.crc32(payload)
    other = serial ^ 0xFFFFFFFF
    w = Writer()
    w.packets(serial, [(PCM + struct.pack("<II", rate, packet), 0)], first=True)
    w.packets(other, [(NOTES, 0)], first=True)
    parts = [(payload[i : i + packet], min(len(payload), i + packet)) for i in range(0, len(payload), packet)]
    half = (len(parts) + 1) // 2
    w.packets(serial, parts[:half], last=half == len(parts))
    w.packets(other, [(f"samples={len(payload)};rate={rate}".encode(), len(payload))], last=True)
    if parts[half:]:
        w.packets(serial, parts[half:], last=True)
    return w.bytes()


@dataclass
class Media:
    samples: bytes
    rate: int
    seconds: float
    packets: int
    streams: int
    lost: int
    bad: int
    notes: str
    first: float = 0.0  # seconds at which the first packet starts
    missing: float = 0.0  # seconds between packets that nothing covers
    times: list[tuple[float, float]] = field(default_factory=list)  # of each packet of samples
    noted: float = 0.0  # seconds at which the notes end


def decode(data: bytes) -> Media:
    streams, bad = read(data)
    pcm = next((s for s in streams.values() if s.packets and s.packets[0].startswith(PCM)), None)
    told = next((s for s in streams.values() if s.packets and s.packets[0] == NOTES), None)
    if pcm is None:
        return Media(b"", 0, 0.0, 0, len(streams), 0, bad, "")
    rate = struct.unpack_from("<I", pcm.packets[0], len(PCM))[0]
    # The header lasts nothing, a sample a granule.
    at = pcm.times(lambda p: 0 if p.startswith(PCM) else len(p))[1:]
    times = [(a / rate, b / rate) for a, b in at]
    missing = sum(max(0, b[0] - a[1]) for a, b in zip(at, at[1:], strict=False)) / rate
    noted = max(0, *told.granules) / rate if told and len(told.granules) > 1 else 0.0
    notes = (told.packets[1:] or [b""])[0].decode() if told else ""
    return Media(
        b"".join(pcm.packets[1:]), rate, times[-1][1] if times else 0.0, len(pcm.packets) - 1, len(streams), pcm.lost, bad, notes,
        first=times[0][0] if times else 0.0, missing=missing, times=times, noted=noted,
    )


def payload_of(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((max(unit, -(-len(raw) // unit) * unit)) - len(raw)), len(raw)


def feature(m: Media) -> str:
    """Times by granule positions (last end, first start, mean packet, uncovered, notes), packets, streams, mean, spread and sign changes of the samples."""
    x = np.frombuffer(m.samples, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    each = sum(b - a for a, b in m.times) / max(1, len(m.times))
    return f"s={m.seconds:.6f};first={m.first:.6f};each={each:.6f};missing={m.missing:.6f};notes={m.noted:.6f};packets={m.packets};streams={m.streams};mean={x.mean():.4f};sd={x.std():.4f};crossings={crossings}"


_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _columns(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in _SCHEMA.split(", ")}
    for t in texts:
        payload, n = payload_of(t)
        media = encode(payload)
        back = decode(media)
        row = (n, len(back.samples), hashlib.sha256(back.samples).hexdigest(), zlib.crc32(back.samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back))
        for c, v in zip(out, row, strict=True):
            out[c].append(v)
    return out


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as Ogg, reads it back, and returns the digests and the feature."""
    return map_texts(docs, _columns, _SCHEMA, keep=(id_col,), text=text_col)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media_col: str = "media") -> DataFrame:
    """The id and the Ogg bytes of each text."""
    return map_texts(docs, lambda texts: {media_col: [encode(payload_of(t)[0]) for t in texts]}, f"{media_col} binary", keep=(id_col,), text=text_col)
