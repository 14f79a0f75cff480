"""Media columns: Ogg containers.

A text is stored as 8-bit unsigned mono samples: logical stream 1 holds a header packet and packets of samples, logical stream 2 a
header packet and one packet with the sample count before padding; the two are multiplexed page by page. Reading verifies every
page's checksum, rebuilds packets from lacing values (across pages), tells the logical streams apart by serial number and
takes times from granule positions, which count samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept

RATE = 8000
FRAME = 192
#: Samples in a packet, a multiple of FRAME.
PACKET = 20 * FRAME
AUDIO, LENGTH = 1, 2
_AUDIO_HEAD = b"PCM     " + struct.pack(">HHIIBBB", 0, 0, 0x00000001, RATE, 8, 1, 0)
_LENGTH_HEAD = b"LENGTH  "
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_PAGE = struct.Struct("<4sBBqIIIB")


class OggError(ValueError):
    """A container that breaks the format's rules."""


def checksum(page: bytes) -> int:
    """Ogg's CRC-32: polynomial 0x04C11DB7, bits not mirrored, start 0. It is the mirrored CRC-32 of mirrored bytes, mirrored."""
    c = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


def _pages(serial: int, packets: list[tuple[bytes, int]]):
    """Pages of one logical stream. packets: with the granule position at the end of each; the first has a page to itself."""
    number = 0
    for part, more in ((packets[:1], len(packets) > 1), (packets[1:], False)):
        lacing, body, granule, continued = bytearray(), bytearray(), -1, False
        for k, (data, end) in enumerate(part):
            left = [255] * (len(data) // 255) + [len(data) % 255]
            at = 0
            while left:
                if len(lacing) == 255:
                    yield _page(serial, number, granule, continued, False, number == 0, lacing, body)
                    number, continued, granule = number + 1, at > 0, -1
                    lacing, body = bytearray(), bytearray()
                take = left[: 255 - len(lacing)]
                del left[: len(take)]
                size = sum(take)
                lacing += bytes(take)
                body += data[at : at + size]
                at += size
            granule = end
        if lacing:
            yield _page(serial, number, granule, continued, not more, number == 0, lacing, body)
            number += 1


def _page(serial, number, granule, continued, last, first, lacing, body) -> bytes:
    head = _PAGE.pack(b"OggS", 0, continued | first << 1 | last << 2, granule, serial, number, 0, len(lacing)) + lacing
    page = bytearray(head + body)
    page[22:26] = struct.pack("<I", checksum(bytes(page)))
    return bytes(page)


def pad(text: bytes) -> bytes:
    """text with spaces appended up to a positive multiple of FRAME."""
    return text + b" " * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def encode(text: bytes) -> bytes:
    """The container of a text's bytes: equal texts give equal containers."""
    payload = pad(text)
    audio = [(_AUDIO_HEAD, 0), *((payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET))]
    one, two = list(_pages(AUDIO, audio)), list(_pages(LENGTH, [(_LENGTH_HEAD, 0), (str(len(text)).encode(), len(payload))]))
    return b"".join([one[0], two[0], one[1], *two[1:], *one[2:]])


@dataclass
class LogicalStream:
    packets: list[bytes] = field(default_factory=list)
    #: For each packet the granule position at its end, where a page gives one (-1: none).
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _rest: bytearray | None = None


def demultiplex(media: bytes) -> dict[int, LogicalStream]:
    """Logical streams by serial number. Raises OggError at a bad capture pattern, checksum, page number, continuation or end."""
    streams: dict[int, LogicalStream] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < 27:
            raise OggError("a page is cut off")
        mark, version, flags, granule, serial, number, crc, count = _PAGE.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise OggError("no page starts here")
        lacing = media[at + 27 : at + 27 + count]
        size = 27 + count + sum(lacing)
        page = bytearray(view[at : at + size])
        if len(page) < size:
            raise OggError("a page is cut off")
        page[22:26] = b"\0\0\0\0"
        if checksum(bytes(page)) != crc:
            raise OggError("a page's checksum is wrong")
        s = streams.setdefault(serial, LogicalStream())
        if number != s.pages or bool(flags & 2) != (s.pages == 0) or bool(flags & 1) != (s._rest is not None) or s.ended:
            raise OggError("pages of a logical stream are missing or out of order")
        body, done = at + 27 + count, []
        start = body
        for n in lacing:
            body += n
            if n < 255:
                done.append(bytes(s._rest or b"") + media[start:body])
                s._rest, start = None, body
        if start < body or (lacing and lacing[-1] == 255):
            s._rest = (s._rest or bytearray()) + media[start:body]
        s.packets += done
        s.granules += [-1] * (len(done) - 1) + [granule] if done else []
        s.pages, s.ended = s.pages + 1, bool(flags & 4)
        at += size
    if any(not s.ended or s._rest is not None for s in streams.values()):
        raise OggError("a logical stream does not end")
    return streams


@dataclass
class Audio:
    payload: bytes
    n_bytes: int
    pages: int
    packets: int
    seconds: float
    #: End time of each packet of samples.
    times: list[float]

    def feature(self) -> str:
        """Duration, pages, packets, and of the samples: mean, root mean square about it, and rate of crossings of the mean."""
        x = np.frombuffer(self.payload, np.uint8)
        n, total, squares = len(x), int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.uint16).sum(dtype=np.int64))
        mean = total / n
        above = x > mean
        crossings = int((above[1:] != above[:-1]).sum())
        return f"seconds={self.seconds:.6f};pages={self.pages};packets={self.packets};mean={mean:.4f};rms={max(0.0, squares / n - mean * mean) ** 0.5:.4f};crossings={crossings / n:.6f}"


def decode(media: bytes) -> Audio:
    streams = demultiplex(media)
    by_head = {s.packets[0][:8]: s for s in streams.values() if s.packets}
    if _AUDIO_HEAD[:8] not in by_head or _LENGTH_HEAD not in by_head:
        raise OggError("a logical stream is missing")
    audio, length = by_head[_AUDIO_HEAD[:8]], by_head[_LENGTH_HEAD]
    rate = struct.unpack_from(">I", audio.packets[0], 16)[0]
    data = audio.packets[1:]
    # A page gives the position at the end of its last packet; those before it are reckoned back from there.
    ends, known = [0] * len(data), None
    for i in range(len(data) - 1, -1, -1):
        known = audio.granules[i + 1] if audio.granules[i + 1] >= 0 else known - len(data[i + 1])
        ends[i] = known
    payload = b"".join(data)
    if not ends or ends[-1] != len(payload):
        raise OggError("granule positions and samples disagree")
    return Audio(payload, int(length.packets[1]), audio.pages + length.pages, len(audio.packets) + len(length.packets), ends[-1] / rate, [e / rate for e in ends])


def with_media(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep with `media`, the container of each row's whole text.

    A null text counts as empty; equal texts, and so repeated rows, have equal containers; an empty table gives an empty table; other columns are not read. A kept column
    named `media` gives way to the result.
    """
    kept = Kept(docs, keep, ["media"])

    def run(batches):
        for batch in batches:
            made = [encode(t or b"") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(made, pa.binary())], names=["kept", "media"])

    return kept.out(docs.select(kept.column, F.col(text).cast("binary").alias("text")).mapInArrow(run, kept.schema("media binary")))


def read_media(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """The columns in keep, and of each row's container: payload, n_bytes, media_bytes, media_sha256, seconds, packet end times and feature.

    A null or damaged container gives nulls and the reason in `error`; a sound one has a null error. Repeated rows get equal results, an empty table gives an empty table. A kept
    column named like one of the results gives way to it.
    """
    kept = Kept(df, keep, [k for k, _ in _READ])

    def run(batches):
        for batch in batches:
            rows = []
            for m in batch.column("media").to_pylist():
                try:
                    if m is None:
                        raise OggError("no container")
                    a = decode(m)
                    rows.append({"payload": a.payload, "n_bytes": a.n_bytes, "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "seconds": a.seconds, "times": a.times, "feature": a.feature(), "error": None})
                except (OggError, ValueError, IndexError, struct.error) as e:
                    rows.append({"error": str(e) or type(e).__name__})
            cols = [pa.array([r.get(k) for r in rows], t) for k, t in _READ]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), *cols], names=["kept", *(k for k, _ in _READ)])

    return kept.out(df.select(kept.column, F.col(media).alias("media")).mapInArrow(run, kept.schema("payload binary, n_bytes long, media_bytes long, media_sha256 string, seconds double, times array<double>, feature string, error string")))


_READ = [("payload", pa.binary()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("seconds", pa.float64()), ("times", pa.list_(pa.float64())), ("feature", pa.string()), ("error", pa.string())]
