"""Near copies: texts whose sets of word shingles have a Jaccard similarity of `similarity` or more.

A text's set holds the 48-bit hashes of its shingles: among 10,000 by 10,000 of
them one pair in three million is equal by chance. Sets lie in files of the
folder that all machines share, until the links are found; what is dealt out
are their places. Candidates
come from minima of the set under BANDS x ROWS hash functions: two texts meet
where all minima of a band are equal, with probability 1 - (1 - J^ROWS)^BANDS
(0.9996 at 0.8, 0.98 at 0.7). Candidates that meet are compared on their whole
sets, but for those that the same bucket has linked already; so that a large
group of near copies costs little more than its members.

A bucket of many texts is dealt into parts, and each two parts meet in a task
of their own. Only spanning links leave a task.

Defined results: a null text counts as empty; texts without words are copies
of each other, and a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Files, documents, materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
SEED = 42
#: Texts of a bucket beyond which it is dealt into parts, and most parts (more texts make parts larger).
BUCKET, PARTS = 1024, 16
#: Hashes of sets in a file, and in a task's memory; bytes of each in a file.
FILE, HELD, WIDE = 1 << 20, 1 << 21, 6
#: Hot buckets whose number of parts is broadcast, at most: 20 bytes each.
FEW = 500_000

_LOWER = bytes(range(256)).lower()
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) > shingle else [b" ".join(words)]  # noqa: B905
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(g, SEED) for g in grams]), ">u8").astype(np.uint64) >> np.uint64(64 - 8 * WIDE))


def _packed(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDE, 8), np.uint8)
    out[:, :WIDE] = np.frombuffer(raw, np.uint8).reshape(-1, WIDE)
    return out.view("<u8").ravel().astype(np.uint64)


def bands(h: np.ndarray) -> list[int]:
    """A key for each band of minima; none for an empty set."""
    if not len(h):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(h), 1 << 12):
        least = np.minimum(least, (h[i : i + (1 << 12), None] * _FACTORS).min(axis=0))
    raw, size = least.tobytes(), 8 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[i * size : (i + 1) * size], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b) - 1:
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both) >= similarity


def sketches(docs: DataFrame, folder: str, shingle: int = SHINGLE, fingerprint: Callable[[str | None], int] | None = None) -> DataFrame:
    """doc_id, digest of the set, its place (file, at, n) and its bands, for every row of docs; with fingerprint, also its 64 bits (print, signed). Writes the sets."""
    files = Files(folder)
    kind = documents(docs).schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "digest", "file", "at", "n", "bands", *["print"] * bool(fingerprint)]

    def run(batches):
        name, held, size = uuid.uuid4().int >> 65, [], 0
        for b in batches:
            texts = b.column(1).to_pylist()
            sets = [shingles(t, shingle) for t in texts]
            n = np.array([len(s) for s in sets], np.int64)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            at = size + np.r_[0, np.cumsum(n)[:-1]] if len(n) else n
            cols = [b.column(0), pa.array(digests, pa.binary()), pa.array([name] * len(n), pa.int64()), pa.array(at, pa.int64()), pa.array(n), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            if fingerprint:
                cols.append(pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)))
            held += sets
            size += int(n.sum())
            if size >= FILE:
                files.write(f"sets-{name}", _packed(np.concatenate(held)))
                name, held, size = uuid.uuid4().int >> 65, [], 0
            yield pa.RecordBatch.from_arrays(cols, names=names)
        if held:
            files.write(f"sets-{name}", _packed(np.concatenate(held)))

    return documents(docs).mapInArrow(run, f"doc_id {kind}, digest binary, file bigint, at bigint, n bigint, bands array<bigint>{', print bigint' if fingerprint else ''}")


class _Sets:
    """Sets by place, read when asked for; some are held."""

    def __init__(self, folder: str):
        self.files, self.opened, self.sets, self.held = Files(folder), {}, {}, 0

    def _read(self, file: int, at: int, n: int) -> bytes:
        if self.files.local:
            if file not in self.opened:
                if len(self.opened) > 64:
                    self.close()
                self.opened[file] = os.open(f"{self.files.root}/sets-{file}", os.O_RDONLY)
            return os.pread(self.opened[file], WIDE * n, WIDE * at)
        return self.files.read(f"sets-{file}", WIDE * at, WIDE * n)

    def get(self, place: tuple[int, int, int]) -> np.ndarray:
        if place not in self.sets:
            if self.held > HELD:
                self.sets, self.held = {}, 0
            self.sets[place] = _unpacked(self._read(*place))
            self.held += place[2]
        return self.sets[place]

    def close(self) -> None:
        for f in self.opened.values():
            os.close(f)
        self.opened = {}


def _bucket(sets: _Sets, nodes: list[int], places: list[tuple[int, int, int]], similarity: float) -> list[tuple[int, int]]:
    """Links that keep the components of a bucket's similar pairs."""
    clusters: list[list[int]] = []
    out = []
    for i, p in enumerate(places):
        x = sets.get(p)
        near, far = [], []
        for c in clusters:
            hit = next((j for j in c if similar(sets.get(places[j]), x, similarity)), None)
            if hit is None:
                far.append(c)
            else:
                near.append(c)
                out.append((nodes[hit], nodes[i]))
        clusters = [*far, [j for c in near for j in c] + [i]]
    return out


def links(points: DataFrame, folder: str, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """u, v: links between nodes of (node, file, at, n, bands), distinct sets, that keep all components of similar candidates."""
    rows = points.select(F.explode("bands").alias("key"), "node", "file", "at", "n").withColumn("part", F.lit(0))
    hot = rows.groupBy("key").count().filter(F.col("count") > bucket)
    hot = hot.select("key", F.least(F.ceil(F.col("count") / bucket), F.lit(PARTS)).cast("int").alias("parts"))
    hot = materialize(hot, "hot")
    n = hot.count()
    if n:
        # few of them: a broadcast; else Spark's own join, which splits keys that are skewed
        rows = rows.drop("part").join(F.broadcast(hot) if n <= FEW else hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own, other = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("other")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("part", F.least("own", other) * PARTS + F.greatest("own", other))

    def run(batches):
        sets, kept = _Sets(folder), None

        def linked(table, whole):
            """Links of all groups but the last, and the last one's rows, unless table is the whole rest."""
            new = np.flatnonzero((table[0][1:] != table[0][:-1]) | (table[1][1:] != table[1][:-1])) + 1
            start, end = np.r_[0, new], np.r_[new, len(table[0])]
            out = []
            for g in np.flatnonzero(end - start > 1).tolist():
                if whole or g < len(start) - 1:
                    node, *place = (c[start[g] : end[g]].tolist() for c in table[2:])
                    out += _bucket(sets, node, list(zip(*place, strict=True)), similarity)
            return out, None if whole else [c[start[-1] :] for c in table]

        def batch(pairs):
            u, v = np.array(pairs, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            if b.num_rows:
                table = [c.to_numpy() for c in b.columns]
                found, kept = linked([np.concatenate(c) for c in zip(kept, table, strict=True)] if kept else table, False)
                yield batch(found)
        if kept:
            yield batch(linked(kept, True)[0])
        sets.close()

    dealt = rows.select("key", "part", "node", "file", "at", "n").repartition(F.col("key"), F.col("part"))
    return dealt.sortWithinPartitions("key", "part", "node").mapInArrow(run, "u bigint, v bigint")
