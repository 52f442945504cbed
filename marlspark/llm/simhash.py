"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has a bit where more than half of its shingles' hashes
have it. Fingerprints that differ in at most `threshold` bits are linked, and
a document's component is the smallest doc_id that links reach.

Links are found without comparing all pairs. The 64 bits are cut into blocks;
of two linked fingerprints some block differs in at most t = threshold //
blocks bits. For a block, a covering code is the set of anchors: a perfect
Hamming code on its first bits, beside all values of the rest, so that each
value has one anchor within radius 1. A fingerprint is at home at that anchor
and is replicated to every anchor within radius 1 + t, where it meets
all homes that it could be linked to; those are compared on all 64 bits.

A fingerprint that many documents share stands once. Where an anchor has many
homes, they are dealt into parts, and its replicas go to each part, so that
no task gathers a whole anchor. Only spanning links leave a task: whatever a
group of near copies is like, they are fewer than the rows read. Components
are then contracted in rounds of joins, with written tables between.

Defined results: a null text counts as empty; a text without words has
fingerprint zero, linked like any other. A null doc_id is never a
representative; its row gets the component of its fingerprint, or null.
Repeated rows each get a row. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import documents, drop, fresh_path, map_texts, materialize

BITS = 64
SEED = 42
#: Homes of an anchor beyond which they are dealt into parts.
HOMES = 8192


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


_LOWER = bytes(range(256)).lower()


class Covering:
    """The anchors of one block of bits, and the shifts from a value to those within reach."""

    def __init__(self, low: int, width: int, near: int):
        self.low, self.width = low, width
        m = max(k for k in range(2, 7) if 2**k - 1 <= width)
        self.n = 2**m - 1
        # syndrome of a single bit i (of the first n) is i + 1; other bits have none
        parts = [i + 1 if i < self.n else 0 for i in range(width)]
        by: dict[int, list[int]] = {s: [] for s in range(2**m)}
        for size in range(near + 2):
            for bits in combinations(range(width), size):
                s = 0
                for b in bits:
                    s ^= parts[b]
                by[s].append(sum(1 << b for b in bits))
        most = max(map(len, by.values()))
        # the first shift of each row leads home: it has the fewest bits
        self.shifts = np.array([x + [0] * (most - len(x)) for x in (by[s] for s in range(2**m))], np.uint64)
        self.count = np.array([len(by[s]) for s in range(2**m)])
        self.table = np.array(parts[: self.n], np.uint8)

    def anchors(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, at home) of every replica."""
        v = (prints >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)
        s = np.zeros(len(v), np.int64)
        for i in range(self.n):
            s ^= ((v >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * (i + 1)
        row = np.repeat(np.arange(len(v)), self.count[s])
        first = np.r_[0, np.cumsum(self.count[s])[:-1]]
        k = np.arange(len(row)) - np.repeat(first, self.count[s])
        return row, v[row] ^ self.shifts[s[row], k], k == 0


def coverings(blocks: int, threshold: int) -> list[Covering]:
    """blocks: more of them make fewer replicas and more comparisons."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [Covering(a, z - a, threshold // blocks) for a, z in zip(edges, edges[1:], strict=False)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components, by links a - b."""
    root = np.arange(n)
    while True:
        lo = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], lo)
        np.minimum.at(new, root[b], lo)
        new = new[new]
        while (step := new[new]).tobytes() != new.tobytes():
            new = step
        if (new == root).all():
            return root
        root = new


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep components, one fewer than nodes in each."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    root = _roots(len(nodes), at[: len(u)], at[len(u) :])
    own = root != np.arange(len(nodes))
    return nodes[root[own]], nodes[own]


class _Linker:
    """Compares homes with replicas along rows that are sorted by key, homes first. Holds one key's homes at a time."""

    def __init__(self, threshold: int, most: int = 1 << 20):
        self.threshold, self.most = threshold, most
        self.key, self.homes, self.ids = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.u: list[np.ndarray] = []
        self.v: list[np.ndarray] = []
        self.held = 0

    def _keep(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            self.u.append(u)
            self.v.append(v)
            self.held += len(u)
            if self.held > self.most:
                u, v = _spanning(np.concatenate(self.u), np.concatenate(self.v))
                self.u, self.v, self.held = [u], [v], len(u)
                self.most = max(self.most, 4 * len(u))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.u:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = _spanning(np.concatenate(self.u), np.concatenate(self.v))
        self.u, self.v, self.held = [], [], 0
        return out

    def _block(self, homes, ids, prints, others) -> None:
        step = max(1, (1 << 20) // max(1, len(homes)))
        for i in range(0, len(prints), step):
            r, c = np.nonzero(np.bitwise_count(homes[:, None] ^ prints[None, i : i + step]) <= self.threshold)
            own = ids[r] != others[i + c]
            if own.any():
                self._keep(*_spanning(ids[r[own]], others[i + c[own]]))

    def add(self, key: np.ndarray, prints: np.ndarray, ids: np.ndarray, home: np.ndarray) -> None:
        n = len(key)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        end = np.r_[start[1:], n]
        group = np.repeat(np.arange(len(start)), end - start)
        # the first group may go on from the batch before
        if self.key is not None and key[0] == self.key:
            h = home[: end[0]]
            if h.any():
                self.homes, self.ids = np.r_[self.homes, prints[: end[0]][h]], np.r_[self.ids, ids[: end[0]][h]]
            self._block(self.homes, self.ids, prints[: end[0]], ids[: end[0]])
        # small groups: every row with the rows after it, at one distance after another
        long = end - start > 96
        left = np.flatnonzero(home & ~long[group])
        stop = end[group]
        o = 1
        while len(left := left[left + o < stop[left]]):
            near = left[np.bitwise_count(prints[left] ^ prints[left + o]) <= self.threshold]
            near = near[ids[near] != ids[near + o]]
            self._keep(ids[near], ids[near + o])
            o += 1
        for g in np.flatnonzero(long):
            a, z = start[g], end[g]
            h = home[a:z]
            self._block(prints[a:z][h], ids[a:z][h], prints[a:z], ids[a:z])
        # the last group's homes may meet rows of the next batch
        a = start[-1]
        if self.key is None or key[a] != self.key:
            h = home[a:]
            self.key, self.homes, self.ids = key[a], prints[a:][h], ids[a:][h]


def _replicate(points: DataFrame, blocks: int, threshold: int, homes_only: bool = False) -> DataFrame:
    """key (block and anchor), print, node, home."""
    codes = coverings(blocks, threshold)

    def run(batches):
        for b in batches:
            prints, nodes = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for j, code in enumerate(codes):
                row, anchor, home = code.anchors(prints)
                if homes_only:
                    row, anchor, home = row[home], anchor[home], home[home]
                key = (anchor | np.uint64(j << 56)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row].view(np.int64)), pa.array(nodes[row]), pa.array(home)], names=["key", "print", "node", "home"])

    return points.select("print", "node").mapInArrow(run, "key bigint, print bigint, node bigint, home boolean")


def links(points: DataFrame, threshold: int = 4, blocks: int = 3, homes: int = HOMES) -> DataFrame:
    """u, v: links between nodes of (print, node), distinct prints, that keep all components of `threshold` differing bits."""
    if not 0 <= threshold < BITS or not 1 <= blocks <= 21:
        raise ValueError("threshold must be 0 to 63, blocks 1 to 21")
    rows = _replicate(points, blocks, threshold).withColumn("part", F.lit(0))
    hot = _replicate(points, blocks, threshold, True).groupBy("key").count().filter(F.col("count") > homes)
    hot = hot.select("key", F.ceil(F.col("count") / homes).cast("int").alias("parts"))
    if not hot.isEmpty():
        # homes keep to one part; replicas visit all, and a home is a replica in the others
        rows = rows.drop("part").join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("home", F.col("home") & (F.pmod(F.xxhash64("print"), F.col("parts")) == F.col("part")))
    schema = "u bigint, v bigint"

    def run(batches):
        linker = _Linker(threshold)
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy() ^ (b.column(4).to_numpy().astype(np.int64) << 32)
            linker.add(key, b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False))
        u, v = linker.links()
        for i in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)]), pa.array(v[i : i + (1 << 16)])], names=["u", "v"])

    dealt = rows.select("key", "print", "node", "home", "part").repartition(F.col("key"), F.col("part"))
    return dealt.sortWithinPartitions("key", "part", F.col("home").desc()).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reached, for every node of a link (u, v).

    Every round points a node at its smallest neighbour, and links what they
    point at; the rest shrinks by half or more in each.
    """
    left = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    spark, spans = edges.sparkSession, []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # hooks: u -> its smallest neighbour if smaller than itself; chains of them end at local minima
        hook = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("to")), "hooks")
        moved = True
        while moved:
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("top"))
            jumped = materialize(hook.join(up, "to").select("node", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved")), "jumps")
            moved = not jumped.filter("moved").isEmpty()
            drop(spark, hook)
            hook = jumped
        spans.append(hook.select("node", "to"))
        a, b = spans[-1].toDF("u", "cu"), spans[-1].toDF("v", "cv")
        done, left = left, materialize(left.join(a, "u").join(b, "v").filter("cu <> cv").select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v")).distinct(), "links")
        drop(spark, done)
    if not spans:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = spans[0].toDF("node", "component")
    for s in spans[1:]:
        out = out.join(s.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, print: the 64 bits as a signed integer."""

    def make():
        return lambda texts: ([f - (1 << 64) if f >> 63 else f for f in (fingerprint(t, shingle) for t in texts)],)

    return map_texts(documents(docs), "print bigint", make)


def linked_prints(docs: DataFrame, threshold: int = 4, blocks: int = 3, shingle: int = 4, homes: int = HOMES) -> DataFrame:
    """doc_id, print, component_id for every row of docs."""
    prints = materialize(fingerprints(docs, shingle), "prints")
    points = materialize(prints.filter("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").cast("bigint").alias("node")), "points")
    joined = components(links(points, threshold, blocks, homes))
    classes = points.join(joined, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "print", "left").select("doc_id", "print", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY, threshold: int = 4, blocks: int = 3) -> DataFrame:
    """doc_id, component_id for every row of docs, by links of fingerprints and by the Jaccard similarity of whole sets of shingles.

    Fingerprints within `threshold` bits are linked as in linked_prints. Few bits miss most pairs below 0.95;
    these are found in near_copies. Links of both kinds are contracted together. Nodes are distinct sets; a row without a doc_id links nothing.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "sets")
    found = materialize(near_copies.sketches(docs, folder, shingle, fingerprint), "sketches")
    named = found.filter("doc_id IS NOT NULL")
    first = F.min_by(F.struct("file", "at", "n", "bands"), "doc_id").alias("first")
    points = named.groupBy("digest").agg(F.min("doc_id").cast("bigint").alias("node"), first)
    points = materialize(points.select("digest", "node", "first.*"), "points")
    alike = materialize(near_copies.links(points, folder, similarity), "alike")
    drop(spark, folder)  # links are stored by now, and sets no more asked for
    prints = materialize(named.select("digest", "print").distinct().join(points.select("digest", "node"), "digest").select("print", "node"), "prints")
    # a fingerprint stands at the smallest of the sets that have it
    homes = materialize(prints.groupBy("print").agg(F.min("node").alias("home")), "homes")
    shared = prints.join(homes, "print").filter("node <> home").select(F.col("home").alias("u"), F.col("node").alias("v"))
    edges = alike.unionByName(shared).unionByName(links(homes.withColumnRenamed("home", "node"), threshold, blocks))
    joined = components(edges)
    classes = materialize(points.join(joined, "node", "left").select("digest", "node", F.coalesce("component", "node").alias("component_id")), "classes")
    of_print = homes.join(classes, homes["home"] == classes["node"]).select("print", F.col("component_id").alias("by_print"))
    out = found.select("doc_id", "digest", "print").join(classes.select("digest", "component_id"), "digest", "left")
    # only a row without a doc_id may have a set of its own, and a fingerprint that others have
    return out.join(of_print, "print", "left").select("doc_id", F.coalesce("component_id", "by_print").alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    found = linked_prints(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
