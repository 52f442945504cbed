"""Language-model scoring with an Elias-Fano n-gram trie.

Counts come from all training texts. The trie's first level is the sorted
64-bit hashes of all words; a word's id is its rank. The second level holds,
for each context word that has any, its successors' ids: stored relative to
the context, made monotone by adding the context's base, and found by
successor search in the context's range, to which monotone pointers lead.
Every monotone sequence is Elias-Fano coded (low bits packed, high bits
unary with a directory for select); probabilities are quantised.

Levels are cut into shards by hash, written by the tasks that merge the counts
into the folder that all machines share, and memory-mapped where texts are
scored; nothing of the model passes through the driver but totals.

The model: P1(w) = (c(w) + 1) / (N + V + 1). A word pair seen `least` times or
more has P(w | u) = (c(u w) + (K + cut(u)) P1(w)) / (c(u) + K), all others
after u have (K + cut(u)) P1(w) / (c(u) + K), where cut(u) is the count of u's
pairs below `least`; so that the probabilities after any u sum to those of P1.
A text begins after a start mark and ends with an end token.

Defined results: a null text counts as empty (one token, the end). With no
training text every probability is 1. Words whose 64-bit hashes are equal
count as one. Repeated rows each count; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Files, documents, drop, fresh_path, remainder

K = 20.0
#: All pairs are stored.
LEAST = 1
#: Fixed marks beside the hashes of words.
END, START = 1, 0
#: Bits of a quantised probability, and the smallest power of ten that they reach.
LEVELS, FLOOR = (1 << 16) - 1, 16.0
#: Tokens that a task sorts at once.
CHUNK = 1 << 21

_LOWER = bytes(range(256)).lower()


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / FLOOR * LEVELS), 0, LEVELS).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) * (-FLOOR / LEVELS)


# --- Elias-Fano -----------------------------------------------------------------

#: Bits of the high part between entries of its directory.
BLOCK = 128

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th one in a byte.
_ONE_AT = np.array([[next((p for p in range(8) if i >> p & 1 and bin(i & ((1 << p) - 1)).count("1") == k), 8) for k in range(8)] for i in range(256)], np.uint8)


class EliasFano:
    """A monotone sequence below a bound: `low` bits of each value packed, the rest in unary. Arrays may be memory-mapped."""

    def __init__(self, n: int, bound: int, low: int, lows: np.ndarray, highs: np.ndarray, zeros: np.ndarray):
        self.n, self.bound, self.low, self.lows, self.highs, self.zeros = n, bound, low, lows, highs, zeros

    @classmethod
    def build(cls, x: np.ndarray, bound: int) -> EliasFano:
        """x: uint64, non-decreasing, each below bound."""
        n = len(x)
        low = max(0, (bound // max(1, n)).bit_length() - 1)
        high = (x >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(n, np.int64)
        bits = np.zeros(-(-n * low // 64) * 64 + 64, np.uint8)
        at = np.arange(n) * low
        for k in range(low):
            bits[at + k] = ((x >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)
        lows = np.packbits(bits, bitorder="little")
        size = n + int((bound - 1) >> low if bound else 0) + 2
        unary = np.zeros(-(-size // BLOCK) * BLOCK, np.uint8)
        unary[high + np.arange(n)] = 1
        highs = np.packbits(unary, bitorder="little")
        # zeros before each block
        ones = _ONES[highs].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        zeros = np.r_[0, np.cumsum(BLOCK - ones)]
        return cls(n, bound, low, lows, highs, zeros)

    def _place(self, block: np.ndarray, left: np.ndarray, zero: bool) -> np.ndarray:
        """Position of the left-th zero (or one) of each block."""
        words = self.highs.view(np.uint64).reshape(-1, BLOCK // 64)
        left, word, at = left.astype(np.int64), None, block * BLOCK
        for k in range(BLOCK // 64):
            here = words[block, k]
            here = ~here if zero else here
            if word is None:
                word = here
                continue
            # on to the next word where the one before has too few
            n = np.bitwise_count(word).astype(np.int64)
            on = left >= n
            word, left, at = np.where(on, here, word), left - n * on, at + 64 * on
        for shift in (32, 16, 8):
            n = np.bitwise_count(word & np.uint64((1 << shift) - 1)).astype(np.int64)
            on = left >= n
            word, left, at = np.where(on, word >> np.uint64(shift), word), left - n * on, at + shift * on
        return at + _ONE_AT[(word & np.uint64(255)).astype(np.int64), left]

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the high bits."""
        block = np.searchsorted(self.zeros, k, side="right") - 1
        return self._place(block, k - self.zeros[block], True)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        words = self.lows.view(np.uint64)
        # a shift by 64 gives nothing: the second word counts where the value reaches into it
        out = (words[word] >> shift) | np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return out & np.uint64((1 << self.low) - 1)

    def seek(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value of q the rank of the first value that isn't smaller, and whether it is equal."""
        q = q.astype(np.uint64)
        if not self.n or not len(q):
            return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        high = (q >> np.uint64(self.low)).astype(np.int64)
        most = int((self.bound - 1) >> self.low)
        beyond = high > most
        high = np.minimum(high, most)
        a = np.where(high > 0, self._select0(np.maximum(high - 1, 0)) - (high - 1), 0)
        z = self._select0(high) - high
        end = z.copy()
        want = q & np.uint64((1 << self.low) - 1) if self.low else np.zeros(len(q), np.uint64)
        # binary search among the values with these high bits
        live = np.flatnonzero(a < z)
        while len(live):
            mid = (a[live] + z[live]) >> 1
            less = self._lows(mid) < want[live]
            a[live[less]] = mid[less] + 1
            z[live[~less]] = mid[~less]
            live = live[a[live] < z[live]]
        equal = np.zeros(len(q), bool)
        some = np.flatnonzero((a < end) & ~beyond)
        equal[some] = self._lows(a[some]) == want[some]
        return np.where(beyond, self.n, a), equal

    def find(self, q: np.ndarray) -> np.ndarray:
        """Rank of the first value that isn't smaller."""
        return self.seek(q)[0]

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at ranks i."""
        i = np.asarray(i, np.int64)
        ones = np.arange(len(self.zeros)) * BLOCK - self.zeros
        block = np.searchsorted(ones, i, side="right") - 1
        pos = self._place(block, i - ones[block], False)
        return ((pos - i).astype(np.uint64) << np.uint64(self.low)) | self._lows(i)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        head = np.array([self.n, self.low, self.bound & 0xFFFFFFFF, self.bound >> 32], np.int64)
        return {f"{name}.head": head, f"{name}.lows": self.lows, f"{name}.highs": self.highs, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low, lo, hi = (int(v) for v in arrays[f"{name}.head"])
        return cls(n, (hi << 32) | lo, low, arrays[f"{name}.lows"], arrays[f"{name}.highs"], arrays[f"{name}.zeros"])


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one after another, each at a multiple of 64 bytes, after a table of them."""
    out, head, at = io.BytesIO(), [], 0
    for name, a in arrays.items():
        head.append(f"{name} {a.dtype.str} {at} {len(a)}")
        data = np.ascontiguousarray(a).tobytes()
        out.write(data + bytes(-len(data) % 64))
        at += len(data) + -len(data) % 64
    table = "\n".join(head).encode()
    table += b"\n" * (-(len(table) + 8) % 64)
    return len(table).to_bytes(8, "little") + table + out.getvalue()


def load(raw: np.ndarray) -> dict[str, np.ndarray]:
    size = int.from_bytes(raw[:8].tobytes(), "little")
    body = raw[8 + size :]
    out = {}
    for line in raw[8 : 8 + size].tobytes().decode().split("\n"):
        if line:
            name, kind, at, n = line.split(" ")
            kind, at, n = np.dtype(kind), int(at), int(n)
            out[name] = body[at : at + n * kind.itemsize].view(kind)
    return out


# --- tokens ------------------------------------------------------------------


def hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, then the end mark. Words' hashes never are a mark."""
    words = (text or "").encode().translate(_LOWER).split()
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(w) for w in words]) + END.to_bytes(8, "big"), ">u8").astype(np.uint64)
    h[:-1][h[:-1] <= END] += np.uint64(2)
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each is there."""
    x = np.sort(x)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.r_[first, len(x)])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


_PART = "shard int, keys binary, counts binary"


def _parts(keys: np.ndarray, n: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """A row for each shard with its sorted keys and counts."""
    order = np.argsort(shard, kind="stable")
    keys, n, shard = keys[order], n[order], shard[order]
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    n = n.astype(np.uint32 if not len(n) or n.max() < 2**32 else np.int64)
    rows = [(int(shard[a]), keys[a:z].tobytes(), n[a:z].tobytes()) for a, z in zip(first, np.r_[first[1:], len(shard)], strict=False)]
    cols = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "keys", "counts"])


def _chunks(batches, of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and counts of about CHUNK tokens each; of(texts) gives one array."""
    held, size = [], 0
    for b in batches:
        x = of(b.column(1).to_pylist())
        held.append(x)
        size += len(x)
        if size >= CHUNK:
            yield _counted(np.concatenate(held))
            held, size = [], 0
    if held:
        yield _counted(np.concatenate(held))


def _gather(parts: DataFrame, build, schema: str, shards: int) -> DataFrame:
    """build(shard, keys, counts) -> one row, for each shard of merged parts, in a task of its own. A shard is a fixed share of hashes, whatever words are frequent."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        # sorted by shard: one at a time is merged, in steps so that memory stays near the result's
        now, parts, held = None, [], 0

        def done():
            keys, n = _merged(parts)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(build(now, keys, n), kinds, strict=True)], names=names)

        for b in batches:
            for s, k, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if s != now and parts:
                    yield done()
                    parts, held = [], 0
                now = s
                parts.append((np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint32 if len(c) * 2 == len(k) else np.int64).astype(np.int64)))
                held += len(parts[-1][0])
                if held > 1 << 22:
                    parts = [_merged(parts)]
                    held = len(parts[0][0]) >> 1
        if parts:
            yield done()

    return parts.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(run, schema)


# --- the model ----------------------------------------------------------------


class Words:
    """Level one: ids and counts of words over all shards, from memory-mapped files."""

    def __init__(self, folder: str, firsts: list[int]):
        self.files, self.firsts = Files(folder), np.array(firsts, np.int64)
        self.shards: dict[int, tuple] = {}

    def shard(self, s: int):
        if s not in self.shards:
            a = load(self.files.open(f"words-{s}"))
            self.shards[s] = (EliasFano.of(a, "hash"), a["count"])
        return self.shards[s]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of hashes."""
        ids, n = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        of = shard_of(h, len(self.firsts))
        order = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[order], np.arange(len(self.firsts) + 1))
        for s in range(len(self.firsts)):
            at = order[edge[s] : edge[s + 1]]
            if len(at):
                seq, counts = self.shard(s)
                if not seq.n:
                    continue
                rank, hit = seq.seek(_within(h[at], len(self.firsts)))
                ids[at[hit]] = rank[hit] + self.firsts[s]
                n[at[hit]] = counts[rank[hit]]
        return ids, n


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are a power of two: the top bits."""
    bits = shards.bit_length() - 1
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _within(h: np.ndarray, shards: int) -> np.ndarray:
    bits = shards.bit_length() - 1
    return h & np.uint64((1 << (64 - bits)) - 1)


class Pairs:
    """Level two: contexts, pointers, successors and quantised probabilities over all shards."""

    def __init__(self, folder: str, shards: int, vocabulary: int):
        self.files, self.n, self.vocabulary, self.shards = Files(folder), shards, vocabulary, {}

    def shard(self, s: int):
        if s not in self.shards:
            a = load(self.files.open(f"pairs-{s}"))
            self.shards[s] = (EliasFano.of(a, "context"), EliasFano.of(a, "pointer"), EliasFano.of(a, "next"), a["prob"])
        return self.shards[s]

    def look_up(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | u) of pairs of ids that are kept, else NaN."""
        out = np.full(len(u), np.nan)
        of = pair_shard(u, w, self.n)
        order = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[order], np.arange(self.n + 1))
        for s in range(self.n):
            at = order[edge[s] : edge[s + 1]]
            if len(at):
                context, pointer, following, prob = self.shard(s)
                if not context.n:
                    continue
                rank, hit = context.seek(u[at])
                at, rank = at[hit], rank[hit]
                # successors relative to the context's rank
                place, hit = following.seek(rank.astype(np.uint64) * np.uint64(self.vocabulary) + w[at].astype(np.uint64))
                at, rank, place = at[hit], rank[hit], place[hit]
                # the pointers bound the context's range
                own = (pointer.get(rank).astype(np.int64) <= place) & (place < pointer.get(rank + 1).astype(np.int64))
                out[at[own]] = restore(prob[place[own]])
        return out


def pair_shard(u: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    """By a mix of both, so that frequent contexts are spread evenly."""
    return shard_of(_mix(_mix(u.astype(np.uint64)) + w.astype(np.uint64)), shards)


class Backoff:
    """log10 of what is left for pairs that aren't kept, by context id."""

    def __init__(self, folder: str, firsts: list[int]):
        self.files, self.firsts, self.shards = Files(folder), np.array(firsts, np.int64), {}

    def look_up(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids))
        of = np.searchsorted(self.firsts, ids, side="right") - 1
        order = np.argsort(of, kind="stable")
        order = order[ids[order] >= 0]
        edge = np.flatnonzero(np.r_[True, np.diff(of[order]) > 0, True]) if len(order) else [0]
        for x, z in zip(edge, edge[1:], strict=False):
            at = order[x:z]
            s = int(of[at[0]])
            if s not in self.shards:
                self.shards[s] = load(self.files.open(f"backoff-{s}"))["weight"]
            out[at] = restore(self.shards[s][ids[at] - self.firsts[s]])
        return out


_opened: dict = {}


def _open(kind, *args):
    """Mapped files, kept by a worker for one model at a time."""
    key = (kind, *[tuple(a) if isinstance(a, list) else a for a in args])
    if key not in _opened:
        for old in [k for k in _opened if k[0] is kind]:
            del _opened[old]
        _opened[key] = kind(*args)
    return _opened[key]


class Model:
    """Where a trained model lies, and its totals."""

    def __init__(self, folder: str, firsts: list[int], vocabulary: int, tokens: int, distinct: int, k: float):
        self.folder, self.firsts, self.vocabulary = folder, firsts, vocabulary
        self.tokens, self.distinct, self.k = tokens, distinct, k

    def words(self) -> Words:
        return _open(Words, self.folder, self.firsts)

    def known(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and counts of the distinct words of texts; of all tokens which of these each is and which stands before it; and where each text begins, and the end."""
        each = [hashes(t) for t in texts]
        edge = np.r_[0, np.cumsum([len(e) for e in each])]
        h = np.concatenate(each) if each else np.zeros(0, np.uint64)
        values, inverse = np.unique(np.r_[np.uint64(START), h], return_inverse=True)
        ids, n = self.words().look_up(values)
        before = inverse[:-1].copy()
        before[edge[:-1]] = inverse[0]
        return ids, n, inverse[1:], before, edge

    def scores(self, texts: list) -> tuple:
        """(tokens, known tokens, base score, score) of each text."""
        ids, n, own, before, edge = self.known(texts)
        base = np.log10((n + 1) / (self.tokens + self.distinct + 1))
        n, p1 = n[own], base[own]
        if self.vocabulary:
            weight = _open(Backoff, self.folder, self.firsts).look_up(ids)
            p = p1 + weight[before]
            # contexts that keep no pair have weight 1; each distinct pair is looked up once
            both = np.flatnonzero((ids[own] >= 0) & (weight[before] < 0))
            pairs, place = np.unique(before[both] * len(ids) + own[both], return_inverse=True)
            found = _open(Pairs, self.folder, len(self.firsts), self.vocabulary).look_up(ids[pairs // len(ids)], ids[pairs % len(ids)])[place]
            hit = ~np.isnan(found)
            p[both[hit]] = found[hit]
        else:
            p = p1
        add = lambda x: np.add.reduceat(x, edge[:-1]).tolist()  # noqa: E731  each text has a token at least
        return np.diff(edge).tolist(), add((n > 0).astype(np.int64)), add(p1), add(p)


def _shards(train: DataFrame) -> int:
    """A power of two that grows with the input's partitions, so that a shard stays a bounded share of memory."""
    n = max(8, 2 * train.rdd.getNumPartitions(), int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return 1 << (n - 1).bit_length()


def fit(docs: DataFrame, k: float = K, least: int = LEAST, shards: int | None = None) -> Model:
    """Count and build, shard by shard, from all texts of docs."""
    spark = docs.sparkSession
    train = documents(docs)
    shards = shards or _shards(train)
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    folder = fresh_path(spark, "ngrams")
    files = Files(folder)
    counts_folder = fresh_path(spark, "pairs")
    between = Files(counts_folder)

    def words(batches):
        # the start mark counts as each text's context
        for keys, n in _chunks(batches, lambda texts: np.concatenate([np.r_[np.uint64(START), hashes(t)] for t in texts])):
            yield _parts(keys, n, shard_of(keys, shards))

    def build_words(s, keys, n):
        seq = EliasFano.build(_within(keys, shards), 1 << (64 - (shards.bit_length() - 1)))
        files.write(f"words-{s}", dump(seq.arrays("hash") | {"count": n}))
        real = keys != START
        return s, len(keys), int(n[real].sum()), int(real.sum())

    sizes = {r[0]: r for r in _gather(train.mapInArrow(words, _PART), build_words, "shard int, size bigint, tokens bigint, distinct bigint", shards).collect()}
    for s in range(shards):
        if s not in sizes:
            empty = EliasFano.build(np.zeros(0, np.uint64), 1)
            files.write(f"words-{s}", dump(empty.arrays("hash") | {"count": np.zeros(0, np.int64)}))
    own = [sizes[s][1] if s in sizes else 0 for s in range(shards)]
    firsts = [int(x) for x in np.r_[0, np.cumsum(own)[:-1]]]
    vocabulary = sum(own)
    model = Model(folder, firsts, vocabulary, sum(r[2] for r in sizes.values()), sum(r[3] for r in sizes.values()), k)
    if not vocabulary:
        return model
    width = np.uint64(max(1, (vocabulary - 1).bit_length()))
    if 2 * int(width) > 64:
        raise ValueError("more than 2**32 distinct words")

    def pairs(batches):
        def of(texts):
            ids, _, own, before, _ = model.known(texts)
            return (ids[before].astype(np.uint64) << width) | ids[own].astype(np.uint64)

        for keys, n in _chunks(batches, of):
            yield _parts(keys, n, pair_shard(keys >> width, keys & np.uint64((1 << int(width)) - 1), shards))

    def build_pairs(s, keys, n):
        kept = n >= least
        keys, n = keys[kept], n[kept]
        u = (keys >> width).astype(np.int64)
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
        between.write(f"kept-{s}", dump({"keys": keys, "n": n}))
        total = np.add.reduceat(n, first) if len(first) else n
        return s, u[first].tobytes(), total.astype(np.int64).tobytes()

    # contexts' kept counts go to the shard of their id
    kept = _gather(train.mapInArrow(pairs, _PART), build_pairs, "shard int, ids binary, sums binary", shards)
    edges = np.array(firsts[1:], np.int64)

    def contexts(batches):
        for b in batches:
            for s, i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids, n = np.frombuffer(i, np.int64), np.frombuffer(c, np.int64)
                yield _parts(ids.astype(np.uint64), n, np.searchsorted(edges, ids, side="right"))
                # an id beyond the vocabulary tells that this shard has pairs
                yield _parts(np.array([vocabulary + s], np.uint64), np.ones(1, np.int64), np.array([s]))

    def build_backoff(s, ids, n):
        told = ids >= vocabulary
        held = (ids[told].astype(np.int64) - vocabulary).tobytes()
        ids, n = ids[~told], n[~told]
        _, counts = model.words().shard(s)
        left = np.asarray(counts, np.float64).copy()
        own = ids.astype(np.int64) - firsts[s]
        left[own] -= n
        # a text's last token has no successor: the end mark's count isn't a context's, and never asked for
        weight = quantise(np.log10((k + np.maximum(left, 0)) / (counts + k)))
        # a context that keeps pairs is told by a weight below 1
        weight[own] = np.maximum(weight[own], 1)
        files.write(f"backoff-{s}", dump({"weight": weight}))
        return s, held

    rows = _gather(kept.mapInArrow(contexts, _PART), build_backoff, "shard int, held binary", shards).collect()
    done, with_pairs = {r[0] for r in rows}, {int(x) for r in rows for x in np.frombuffer(r[1], np.int64)}
    for s in range(shards):
        if s not in done and own[s]:
            spare = model.words().shard(s)[1]
            files.write(f"backoff-{s}", dump({"weight": np.zeros(len(spare), np.uint16)}))

    def trie(batches):
        scale = model.tokens + model.distinct + 1
        for b in batches:
            for s in b.column(0).to_pylist():
                keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if s in with_pairs:  # a file that is missing fails the task
                    a = load(between.open(f"kept-{s}"))
                    keys, n = a["keys"], a["n"]
                u, w = (keys >> width).astype(np.int64), (keys & np.uint64((1 << int(width)) - 1)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
                rank = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(u)]))
                seqs = {
                    "context": EliasFano.build(u[first].astype(np.uint64), vocabulary),
                    "pointer": EliasFano.build(np.r_[first, len(u)].astype(np.uint64), len(u) + 1),
                    "next": EliasFano.build(rank.astype(np.uint64) * np.uint64(vocabulary) + w.astype(np.uint64), max(1, len(first)) * vocabulary),
                }
                cu, cw = _counts(model, u), _counts(model, w)
                bo = 10 ** _open(Backoff, folder, firsts).look_up(u)
                prob = quantise(np.log10(n / (cu + k) + bo * (cw + 1) / scale))
                arrays = {"prob": prob}
                for name, seq in seqs.items():
                    arrays |= seq.arrays(name)
                files.write(f"pairs-{s}", dump(arrays))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

    spark.range(0, shards, 1, shards).select(F.col("id").cast("int").alias("shard")).mapInArrow(trie, "shard int").count()
    drop(spark, counts_folder)
    return model


def _counts(model: Model, ids: np.ndarray) -> np.ndarray:
    """Counts of words by id."""
    out = np.zeros(len(ids), np.int64)
    of = np.searchsorted(np.array(model.firsts), ids, side="right") - 1
    for s in np.unique(of).tolist():
        at = of == s
        out[at] = model.words().shard(s)[1][ids[at] - model.firsts[s]]
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every text."""
    from .common import map_texts

    columns = "n_tokens bigint, n_known bigint, base_score double, score double"
    return map_texts(documents(docs), columns, lambda: lambda texts: model.scores(texts))


def query(docs: DataFrame) -> DataFrame:
    """Learn from rows whose remainder by 7 isn't 2, score all."""
    model = fit(docs.filter(remainder(7) != 2))
    out = score(docs, model)
    return out.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
