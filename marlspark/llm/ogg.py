"""Media columns in Ogg containers.

A payload is stored losslessly as 8-bit samples in packets of one logical
stream, beside a second logical stream that describes it; their pages are
interleaved. Reading verifies every page's checksum, reassembles packets from
the lacing values (across pages too), separates the logical streams by serial
number, and derives timestamps from the granule positions.

Defined results: a null text counts as empty; the empty payload is one block
of padding; equal payloads give equal bytes. A damaged container raises
ValueError. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import documents, map_texts

BLOCK = 576
FILL = 255
#: Samples of a packet; of a second, for timestamps.
PACKET = 8 * BLOCK
RATE = 8000
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSE = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04c11db7, most significant bit first, no inversions), by zlib over the bit-reversed bytes."""
    mirrored = zlib.crc32(page.translate(_REVERSE), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSE), "big")


def pages(serial: int, packets: list[tuple[bytes, int]], most: int = 255) -> Iterator[bytes]:
    """Pages of one logical stream from (packet, granule position at its end). The first packet has a page of its own."""
    sequence, lacing, body, granule, continued = 0, bytearray(), [], -1, False

    def page(last: bool) -> bytes:
        flags = CONTINUED * continued | FIRST * (sequence == 0) | LAST * last
        head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
        whole = head + b"".join(body)
        return whole[:22] + struct.pack("<I", checksum(whole)) + whole[26:]

    for i, (data, at) in enumerate(packets):
        values = [255] * (len(data) // 255) + [len(data) % 255]
        pos = 0
        for j, v in enumerate(values):
            if len(lacing) == most:
                yield page(False)
                sequence, lacing, body, granule, continued = sequence + 1, bytearray(), [], -1, j > 0
            lacing.append(v)
            body.append(data[pos : pos + v])
            pos += v
        granule = at
        if i == 0 and len(packets) > 1:
            yield page(False)
            sequence, lacing, body, granule, continued = sequence + 1, bytearray(), [], -1, False
    yield page(True)


def pad(raw: bytes) -> bytes:
    """Filled up to a positive multiple of the block."""
    return raw + bytes([FILL]) * (-len(raw) % BLOCK or BLOCK * (not raw))


def store(raw: bytes) -> bytes:
    """An Ogg file of the padded bytes and, in a second stream, their unpadded count and digest."""
    payload = pad(raw)
    serial = zlib.crc32(payload)
    sound = [(b"PCM8" + struct.pack("<IB", RATE, 1), 0)]
    sound += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    notes = [(b"NOTE" + struct.pack("<I", serial), 0), (struct.pack("<Q", len(raw)) + hashlib.sha256(payload).digest(), len(payload))]
    a, b = list(pages(serial, sound)), list(pages(serial ^ 0xFFFFFFFF, notes))
    # both first pages stand before all others; then the streams alternate
    rest = [p for pair in zip(a[1:], b[1:], strict=False) for p in pair] + a[min(len(a), len(b)) :] + b[min(len(a), len(b)) :]
    return b"".join([a[0], b[0], *rest])


@dataclass
class Stream:
    """A logical stream: its packets, and for each the granule position of the page where it ends (None but for a page's last)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    open: bytes | None = None
    ended: bool = False

    def seconds(self, rate: int = RATE) -> list[float | None]:
        return [None if g is None else g / rate for g in self.granules]


def demultiplex(media: bytes) -> dict[int, Stream]:
    """The logical streams by serial number, every page verified."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27 or media[at : at + 4] != b"OggS":
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(media):
            raise ValueError(f"cut or unknown page at byte {at}")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum at byte {at}")
        s = streams.setdefault(serial, Stream(serial))
        if sequence != s.pages or bool(flags & FIRST) != (s.pages == 0) or s.ended or bool(flags & CONTINUED) != (s.open is not None):
            raise ValueError(f"page out of order at byte {at}")
        s.pages += 1
        pos, size, done = at + 27 + n, 0, 0
        for v in lacing:
            size += v
            if v < 255:
                part = media[pos : pos + size]
                s.packets.append(part if s.open is None else s.open + part)
                s.granules.append(None)
                s.open, pos, size, done = None, pos + size, 0, done + 1
        if size or (n and lacing[-1] == 255):
            s.open = (s.open or b"") + media[pos : pos + size]
        if done and granule >= 0:
            s.granules[-1] = granule
        s.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if s.open is not None or not s.ended:
            raise ValueError(f"stream {s.serial} is cut")
    return streams


def read(media: bytes) -> tuple[bytes, int, list[Stream]]:
    """Payload, unpadded byte count, and the streams (sound, notes); the notes must agree."""
    streams = demultiplex(media).values()
    sound = next(s for s in streams if s.packets[0][:4] == b"PCM8")
    notes = next(s for s in streams if s.packets[0][:4] == b"NOTE")
    payload = b"".join(sound.packets[1:])
    if hashlib.sha256(payload).digest() != notes.packets[1][8:] or sound.granules[-1] != len(payload):
        raise ValueError("the payload isn't what the notes describe")
    return payload, struct.unpack_from("<Q", notes.packets[1])[0], [sound, notes]


def features(payload: bytes, sound: Stream) -> str:
    """Duration from the last granule position, pages and packets, and level, spread and zero crossings of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    up = x >= 0
    crossings = int((up[1:] != up[:-1]).sum())
    mean = float(x.mean())
    power = float(np.einsum("i,i->", x, x, dtype=np.int64)) / len(x)
    return f"seconds={sound.seconds()[-1]:.6f};pages={sound.pages};packets={len(sound.packets) - 1};mean={mean:.6f};rms={power**0.5:.6f};crossings={crossings}"


def store_table(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text in its Ogg file."""

    def make():
        return lambda texts: ([store((t or "").encode()) for t in texts],)

    return map_texts(documents(docs), "media binary", make)


def read_table(media: DataFrame) -> DataFrame:
    """doc_id and what reading the stored bytes back gives, from doc_id, media."""

    def make():
        def run(files):
            out = []
            for m in files:
                payload, n, (sound, _) = read(m)
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), features(payload, sound)))
            return list(zip(*out, strict=True))

        return run

    columns = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_texts(media, columns, make, "media")


def query(docs: DataFrame) -> DataFrame:
    return read_table(store_table(docs))
