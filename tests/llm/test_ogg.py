import hashlib
import os
import zlib

import pytest

from marlspark.llm import ogg as O


def slow_checksum(data):
    r = 0
    for x in data:
        r ^= x << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if r >> 31 else (r << 1) & 0xFFFFFFFF
    return r


def test_checksum():
    assert all(slow_checksum(d) == O.checksum(d) for d in (b"", b"a", os.urandom(99)))


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 4608, 65024, 65025, 65026, 200000])
def test_round_trip(n):
    raw = os.urandom(n)
    payload, size, (sound, notes) = O.read(O.store(raw))
    assert payload == O.pad(raw) and size == n and len(payload) % O.BLOCK == 0 and payload
    assert sound.seconds()[-1] == len(payload) / O.RATE and notes.serial != sound.serial


def test_packets_across_pages_and_streams():
    a = [(b"head", 0), (os.urandom(70000), 5), (b"", 6), (os.urandom(255), 7), (os.urandom(510), 9)]
    b = [(b"other", 0), (os.urandom(255 * 255), 3)]
    pa, pb = list(O.pages(1, a)), list(O.pages(2, b))
    mixed = [pa[0], pb[0], pa[1], pb[1], *pa[2:], *pb[2:]]
    got = O.demultiplex(b"".join(mixed))
    assert got[1].packets == [d for d, _ in a] and got[2].packets == [d for d, _ in b]
    assert got[1].granules[-1] == 9 and got[2].granules[-1] == 3


def test_damage_is_told():
    m = bytearray(O.store(os.urandom(5000)))
    for at in (0, 5, 30, len(m) // 2, len(m) - 1):
        bad = bytearray(m)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            O.read(bytes(bad))
    with pytest.raises(ValueError):
        O.read(bytes(m[:-1]))


def test_query(odd, empty):
    rows = O.query(odd).collect()
    texts = [r.text for r in odd.collect()]
    assert len(rows) == len(texts)
    want = sorted((len((t or "").encode()), hashlib.sha256(O.pad((t or "").encode())).hexdigest(), zlib.crc32(O.pad((t or "").encode())[-32:])) for t in texts)
    assert sorted((r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 0}) == 1
    assert O.query(empty).count() == 0
