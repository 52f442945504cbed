"""Best-fit packing planned on a length histogram.

Documents are tokenised and cut where longer than a sequence. The plan is
made from the number of pieces of each length alone: lengths fall into bins
best-fit, longest first, and bins that are filled alike stand together as a
range of sequence numbers, so that the plan's size depends on the sequence
length and not on the number of documents. Pieces then take planned slots by
their rank among the pieces of their length.

Defined results: a null text counts as empty (one token, the end id). Rows are
told apart by where they are stored, so that null or repeated doc_ids are
packed like any other. An empty table gives an empty result. Ties in rank go
by stored order. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize

LENGTH = 4096
END = 1


#: The steps by which a word vocabulary of this kind splits texts, and its pattern.
_STEPS = ("NFC", "Replace", "Lowercase")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Of Latin-1 the pattern's white space, letters and numbers (in lower case); the rest are its other characters.
_WHITE = "\t\n\v\f\r \x85\xa0"
_LETTERS = "abcdefghijklmnopqrstuvwxyzªµºßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_NUMBERS = "0123456789²³¹¼½¾"
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")

_KIND = np.full(256, 3, np.uint8)
for _k, _chars in enumerate((_WHITE, _LETTERS, _NUMBERS)):
    _KIND[list(_chars.encode("latin-1"))] = _k
_LOWER = "".join(map(chr, range(256))).lower().encode("latin-1")
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \n")] = True
#: A byte's character in byte-level vocabularies: its own where that is printable and no blank, else the next one from 256 on.
_odd = [b for b in range(256) if not (chr(b).isprintable() and b not in (32, 173))]
_BYTES = {b: chr(256 + i) for i, b in enumerate(_odd)}
#: Bytes of a unit that its key holds, and masks of so many bytes.
_KEY = 15
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _edges(kind: np.ndarray, each: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one kind; of kind `each` every place is its own run; none of kind 0."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == each)])
    end = np.r_[start[1:], len(kind)]
    own = kind[start] != 0
    return start[own], end[own]


def _units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's matches in lower-case Latin-1."""
    a, z = _edges(_KIND[raw], 2)
    # a lone apostrophe before letters takes some of them
    at = np.flatnonzero((raw[a[:-1]] == 39) & (z[:-1] - a[:-1] == 1) & (a[1:] == z[:-1]) & (_KIND[raw[a[1:]]] == 1)) if len(a) else a
    if len(at):
        one, two = raw[z[at]], raw[np.minimum(z[at] + 1, len(raw) - 1)]
        long = z[at + 1] - a[at + 1] > 1
        take = np.isin(one, list(_ONE)).astype(np.int64)
        for x, y in _TWO:
            take += 2 * (long & (one == x) & (two == y))
        z[at] += take
        a[at + 1] += take
        own = a < z
        a, z = a[own], z[own]
    return a, z


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)


class _Table:
    """Ids of units by their bytes, in arrays: open addressing over keys that hold up to _KEY bytes and the length.

    It is emptied when it is full, so that its memory is bounded (some 30 MB).
    """

    def __init__(self, bits: int = 20):
        self.shift, self.mask, self.most = np.uint64(64 - bits), (1 << bits) - 1, int(0.6 * (1 << bits))
        self.first, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.at, self.size = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.pool, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0

    def clear(self) -> None:
        self.second[:] = 0
        self.n = self.used = 0

    def _slots(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        h = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (y * np.uint64(0xC2B2AE3D27D4EB4F))
        return (((h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)) >> self.shift).astype(np.int64)

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where there's none."""
        slot = self._slots(x, y)
        second = self.second[slot]
        hit = (self.first[slot] == x) & (second == y)
        out = np.where(hit, slot, -1)
        live = np.flatnonzero(~hit & (second != 0))
        while len(live):
            slot[live] = s = (slot[live] + 1) & self.mask
            second = self.second[s]
            hit = (self.first[s] == x[live]) & (second == y[live])
            out[live[hit]] = s[hit]
            live = live[~hit & (second != 0)]
        return out

    def add(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New keys, each once, with their ids one after another. There must be room."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        at = self.used + np.r_[0, np.cumsum(size)[:-1]]
        self.pool[self.used : self.used + len(ids)] = ids
        slot, live = self._slots(x, y), np.arange(len(x))
        while len(live):
            free = np.flatnonzero(self.second[slot[live]] == 0)
            _, i = np.unique(slot[live[free]], return_index=True)
            won = live[free[i]]
            s = slot[won]
            self.first[s], self.second[s], self.at[s], self.size[s] = x[won], y[won], at[won], size[won]
            rest = np.ones(len(live), bool)
            rest[free[i]] = False
            live = live[rest]
            slot[live] = (slot[live] + 1) & self.mask
        self.n += len(x)
        self.used += len(ids)


class Tokens:
    """Token ids of texts as little-endian bytes.

    Tokens don't reach across white space in this kind of vocabulary, so that
    each stretch between blanks is encoded once and kept in a table of bounded
    size. Texts in Latin-1, where lower-casing and composition concern single
    characters, are split into the pattern's own units, of which there are
    fewer. Splitting and looking up work on whole arrays of bytes.
    """

    #: Bytes of text that are split at once.
    AT_ONCE = 1 << 21

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word, self.by_unit = self._separable()
        self.tables = {"latin-1": _Table(), "utf-8": _Table(18)}

    def _separable(self) -> tuple[bool, bool]:
        import json

        spec = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        special = any(" " in t["content"] or "\n" in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        word = bool(spec["model"].get("end_of_word_suffix")) and "Replace" in steps and "Prepend" not in steps and split.get("behavior") == "Removed" and not special
        marked = all(t["content"].startswith("<|") for t in spec["added_tokens"])
        level = [(r.get("type"), r.get("add_prefix_space")) for r in rest] == [("ByteLevel", False)]
        return word, word and level and marked and tuple(steps) == _STEPS and split.get("pattern", {}).get("Regex") == _PATTERN

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has."""
        return _flat([e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)])

    def _learn(self, units: list[str], code: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of units. The pattern's own need the model's merges alone."""
        if code != "latin-1":
            return self._encode(units)
        merge = self.tokenizer.model.tokenize
        return _flat([[t.id for t in merge(u if u.isascii() and u.isprintable() else u.encode().decode("latin-1").translate(_BYTES))] for u in units])

    def _looked_up(self, texts: list[bytes], code: str) -> list[np.ndarray]:
        """Ids of texts in an encoding, by units (Latin-1, lower-case) or stretches between blanks."""
        table = self.tables[code]
        joined = b" ".join(texts) + bytes(17)
        raw = np.frombuffer(joined, np.uint8)[:-17]
        a, z = _units(raw) if code == "latin-1" else _edges((~_BLANK[raw]).astype(np.uint8))
        n = z - a
        words = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
        x = words[a] & _MASK[np.minimum(n, 8)]
        # what follows the eighth byte, and the length in the highest byte: no key is 0
        y = (words[np.minimum(a + 8, len(words) - 1)] & _MASK[np.clip(n - 8, 0, 7)]) | (np.minimum(n, 255).astype(np.uint64) << np.uint64(56))
        short = n <= _KEY
        slot = np.where(short, table.find(x, y), -1) if len(a) else np.zeros(0, np.int64)
        new = np.flatnonzero(short & (slot < 0))
        if len(new):
            units: dict[bytes, int] = {}
            for i, p, q in zip(new.tolist(), a[new].tolist(), z[new].tolist(), strict=True):
                units.setdefault(joined[p:q], i)
            first = np.array(list(units.values()))
            if table.n + len(first) > table.most:
                if table.n:  # once more, with all room
                    table.clear()
                    return self._looked_up(texts, code)
                return self._apart(texts, code)
            table.add(x[first], y[first], *self._learn([u.decode(code) for u in units], code))
            slot[new] = table.find(x[new], y[new])
        at, size = table.at[np.maximum(slot, 0)].astype(np.int64), np.where(short, table.size[np.maximum(slot, 0)], 0).astype(np.int64)
        pool = table.pool
        long = np.flatnonzero(~short)
        if len(long):
            spans = [joined[p:q] for p, q in zip(a[long].tolist(), z[long].tolist(), strict=True)]
            once = {u: i for i, u in enumerate(dict.fromkeys(spans))}
            ids, each = self._learn([u.decode(code) for u in once], code)
            own = np.array([once[u] for u in spans])
            size[long], at[long] = each[own], table.used + (np.cumsum(each) - each)[own]
            pool = np.r_[pool[: table.used], ids]
        to = np.r_[0, np.cumsum(size)]
        flat = pool[np.repeat(at - to[:-1], size) + np.arange(to[-1])] if to[-1] else np.zeros(0, np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.split(flat, to[np.searchsorted(a, ends[:-1])])

    def _apart(self, texts: list[bytes], code: str) -> list[np.ndarray]:
        """Where the table's room is too small for all units of texts at once: by halves, and a single text without it."""
        if len(texts) > 1:
            half = len(texts) // 2
            return self._looked_up(texts[:half], code) + self._looked_up(texts[half:], code)
        raw = np.frombuffer(texts[0], np.uint8)
        a, z = _units(raw) if code == "latin-1" else _edges((~_BLANK[raw]).astype(np.uint8))
        units = [texts[0][p:q].decode(code) for p, q in zip(a.tolist(), z.tolist(), strict=True)]
        return [np.concatenate([self._learn(units[k : k + (1 << 16)], code)[0] for k in range(0, len(units), 1 << 16)])]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """One for each text; a null text has no ids."""
        out = [b""] * len(texts)
        if not self.by_word:
            ids, size = self._encode([t or "" for t in texts])
            return [i.tobytes() for i in np.split(ids, np.cumsum(size)[:-1])]
        held: dict[str, list] = {"latin-1": [], "utf-8": []}
        size = dict.fromkeys(held, 0)

        def flush(code: str) -> None:
            for (i, _), ids in zip(held[code], self._looked_up([b for _, b in held[code]], code), strict=True):
                out[i] = ids.tobytes()
            held[code], size[code] = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            code, raw = "utf-8", None
            if self.by_unit and "<|" not in t:
                try:
                    code, raw = "latin-1", t.encode("latin-1").translate(_LOWER)
                except UnicodeEncodeError:
                    pass
            held[code].append((i, t.encode() if raw is None else raw))
            size[code] += len(held[code][-1][1])
            if size[code] > self.AT_ONCE:
                flush(code)
        for code in held:
            if held[code]:
                flush(code)
        return out


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One for each file and process; its tables serve all tasks of a worker."""
    if path not in _tokens:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokens[path] = Tokens(path)
    return _tokens[path]


def cut(ids: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    for k, i in enumerate(range(0, len(ids), 4 * length)):
        part = ids[i : i + 4 * length]
        yield k, i // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and where the row stands: task and rank among the task's pieces of that length."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    d = documents(docs)
    schema = StructType([d.schema["doc_id"], *StructType.fromDDL("piece int, start bigint, length bigint, ids_crc32 bigint, task int, local bigint")])
    arrow = to_arrow_schema(schema)
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        encode = tokens(path)
        for b in batches:
            rows, at = [], []
            for i, ids in enumerate(encode(b.column(1).to_pylist())):
                for k, start, n, crc in cut(ids + tail, length):
                    local = seen.get(n, 0)
                    seen[n] = local + 1
                    rows.append((k, start, n, crc, task, local))
                    at.append(i)
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            ids = b.column(0).take(pa.array(at, pa.int64())).cast(arrow.field(0).type)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, arrow.field(j + 1).type) for j, c in enumerate(columns)]], names=arrow.names)

    return d.mapInArrow(run, schema)


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, number, first sequence, offset) for so many pieces of each length.

    Bins that are filled alike are a range of sequence numbers. Best-fit
    decreasing: the pieces of a length go where the least room is left over,
    and into new bins, as many to each as fit.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    free: list[int] = []
    bins = 0

    def put(space: int, first: int, number: int) -> None:
        if space and number:
            if space not in room:
                room[space] = []
                bisect.insort(free, space)
            room[space].append((first, number))

    for size in sorted(counts, reverse=True):
        if not 0 < size <= length:
            raise ValueError(f"a piece of {size} tokens can't be in a sequence of {length}")
        rank, left = 0, counts[size]
        while left and (k := bisect.bisect_left(free, size)) < len(free):
            space = free[k]
            first, number = room[space].pop()
            if not room[space]:
                del room[space]
                free.pop(k)
            # as many to each bin as fit: what is left over after the first is less than before
            fit = space // size
            used = min(number, -(-left // fit))
            put(space, first + used, number - used)
            full = left // fit if used == -(-left // fit) else used
            for j in range(fit):
                n = used if used <= full else full + (j < left - full * fit)
                if n:
                    slots.append((size, rank, n, first, length - space + j * size))
                    rank += n
            placed = min(left, used * fit)
            put(space - fit * size, first, min(full, used))
            if used > full:
                put(space - (left - full * fit) * size, first + full, 1)
            left -= placed
        if left:
            fit = length // size
            full, rest = divmod(left, fit)
            for j in range(fit):
                n = full + (j < rest)
                if n:
                    slots.append((size, rank, n, bins, j * size))
                    rank += n
            put(length - fit * size, bins, full)
            if rest:
                put(length - rest * size, bins + full, 1)
            bins += full + (rest > 0)
    return slots


def place(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id and offset for stored rows with (length, task, local)."""
    counts = materialize(rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    # at most one row for each length: bounded by the sequence length
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = sorted(plan(total, length))
    keys = [np.array([s[i] for s in slots], np.int64) for i in range(5)]
    rank_bits = np.int64(48)
    table = (keys[0] << rank_bits) | keys[1] if slots else np.zeros(0, np.int64)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # counts grow with the tasks, and their file is far smaller than they are in memory: never broadcast
    ranked = rows.join(counts.select("task", "length", before.alias("first")).hint("merge"), ["task", "length"]).withColumn("rank", F.col("first") + F.col("local"))
    names = [c for c in rows.columns if c not in ("task", "local")]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id bigint, offset bigint"

    def run(batches):
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(table, (size << rank_bits) | rank, side="right") - 1
            own = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(keys[3][at] + rank - keys[1][at]), pa.array(keys[4][at])], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    rows = materialize(pieces(docs, path, length, end), "pieces")
    return place(rows, length)
