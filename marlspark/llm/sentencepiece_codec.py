"""Offset-preserving SentencePiece encoding and decoding.

The model file is parsed here: its compiled character map (a double-array trie
and replacement strings) drives longest-prefix normalisation, which records
for each normalised character the source bytes it came from; pieces are then
merged over the normalised text, and every piece is projected through that
alignment to a byte span of the original text.

Pieces never reach across a place where no piece of the vocabulary has those
two characters side by side, so that a text is cut there into segments whose
encodings are kept in a table of bounded size. New segments are merged many at
a time, one step of each after another, on arrays of symbols.

Defined results: a null text counts as empty and has no ids; empty tables give
empty results; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import documents, map_texts

SPACE = "▁"


def _fields(b: bytes):
    """Field numbers and values of a protocol buffer."""
    i, n = 0, len(b)

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            x = b[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, b[i : i + size]
            i += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, b[i : i + size]
            i += size


class CharacterMap:
    """The compiled character map: length of the trie, its units, then replacements that end with a zero byte."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        self.replacements = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.replacements = blob[4 + size :]

    def longest(self, b: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that b has at `at`."""
        units, best = self.units, None
        if not len(units):
            return None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        pos = offset(int(units[0]))
        for k in range(at, len(b)):
            pos ^= b[k]
            if pos >= len(units):
                break
            u = int(units[pos])
            if u & ((1 << 31) | 0xFF) != b[k]:
                break
            pos ^= offset(u)
            if (u >> 8) & 1:
                value = int(units[pos]) & 0x7FFFFFFF
                best = (k + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)])
        return best


@dataclass
class Encoding:
    """ids with spans[i] = (start, end): the original bytes, end exclusive, that piece i covers."""

    ids: list[int]
    spans: list[tuple[int, int]]


class _Merges:
    """Which two symbols become which, and how early: the model's merges of many segments at once.

    Symbols are the vocabulary's pieces and the characters that pieces consist of.
    """

    #: Characters of a segment that is merged beside others.
    WIDTH = 24

    def __init__(self, pieces: dict[str, tuple[float, int]]):
        names = dict.fromkeys([*pieces, *sorted(set("".join(pieces)))])
        self.symbol = {w: i for i, w in enumerate(names)}
        # earlier merges have lower ranks, equal scores equal ones
        scores = sorted({x for x, _ in pieces.values()})
        rank = dict(zip(scores, range(len(scores)), strict=True))
        rows = []
        for w, (score, _) in pieces.items():
            for k in range(1, len(w)):
                if (l := self.symbol.get(w[:k])) is not None and (r := self.symbol.get(w[k:])) is not None:
                    rows.append((l << 32 | r, rank[score], self.symbol[w]))
        key, self.rank, self.into = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else [np.zeros(0, np.int64)] * 3
        self.bits = max(4, (4 * len(key)).bit_length())
        self.slots, self.keys = np.full(1 << self.bits, -1, np.int32), key
        live, at = np.arange(len(key)), self._hash(key)
        while len(live):
            free = np.flatnonzero(self.slots[at[live]] < 0)
            _, first = np.unique(at[live[free]], return_index=True)
            won = live[free[first]]
            self.slots[at[won]] = won
            rest = np.ones(len(live), bool)
            rest[free[first]] = False
            live = live[rest]
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    NEVER = np.int64(1 << 40)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NEVER where there's no merge) and what the pairs become. Symbols below 0 never merge."""
        key = (left << 32) | np.maximum(right, 0)
        rank, into = np.full(len(key), self.NEVER), np.full(len(key), -1, np.int64)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._hash(key[live])
        while len(live):
            s = self.slots[at]
            hit = (s >= 0) & (self.keys[s] == key[live]) if len(self.keys) else s >= 0
            rank[live[hit]], into[live[hit]] = self.rank[s[hit]], self.into[s[hit]]
            go = ~hit & (s >= 0)
            live, at = live[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return rank, into

    def run(self, segments: list[str]) -> list[list[int]]:
        """Symbols of each segment of WIDTH characters or fewer when nothing merges any more: best-scored neighbours first, the left one of equals.

        A character that no piece has is -2.
        """
        width = self.WIDTH
        sym = np.full((len(segments), width), -1, np.int64)
        size = np.array([len(x) for x in segments])
        sym[np.arange(width) < size[:, None]] = [self.symbol.get(c, -2) for x in segments for c in x]
        rank, into = (x.reshape(-1, width - 1) for x in self.look_up(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
        left, place = np.arange(len(segments)), np.arange(width)
        done = np.full((len(segments), width), -1, np.int64)
        while True:
            best = rank.argmin(axis=1)
            rows = np.arange(len(left))
            more = rank[rows, best] < self.NEVER
            done[left[~more]] = sym[~more]
            if not more.any():
                return [x[:n] for x, n in zip(done.tolist(), (done != -1).sum(axis=1).tolist(), strict=True)]
            left, sym, rank, into, best = left[more], sym[more], rank[more], into[more], best[more]
            rows = np.arange(len(left))
            sym[rows, best] = into[rows, best]
            # what stands behind the pair moves up
            move = np.minimum(place + (place > best[:, None]), width - 1)
            sym = np.take_along_axis(sym, move, 1)
            sym[:, -1] = -1
            move = np.minimum(move[:, :-1] + 0, width - 2)
            rank, into = np.take_along_axis(rank, move, 1), np.take_along_axis(into, move, 1)
            rank[:, -1] = self.NEVER
            for at in (best - 1, best):
                own = np.flatnonzero((at >= 0) & (at < width - 1))
                k = at[own]
                rank[own, k], into[own, k] = self.look_up(sym[own, k], sym[own, k + 1])


class _Segments:
    """Ids of segments in arrays. Emptied when full, so that memory stays bounded."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.ids = np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.int32)
        self.used = 0

    def add(self, segments: list[str], ids: list[list[int]]) -> None:
        n, flat = len(self.index), [i for x in ids for i in x]
        while n + len(segments) + 1 > len(self.start):
            self.start = np.r_[self.start, np.zeros_like(self.start)]
        while self.used + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n + 1 : n + 1 + len(segments)] = self.used + np.cumsum([len(x) for x in ids])
        self.index.update(zip(segments, range(n, n + len(segments)), strict=True))
        self.used += len(flat)


class Codec:
    """A byte-pair model of the sentencepiece library, read from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: dict[str, tuple[float, int]] = {}
        self.text: list[str] = []
        self.bytes: dict[int, int] = {}
        self.byte_id = [0] * 256
        self.control: set[int] = set()
        self.unknown, kind_of = 0, 1
        normal: dict = {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}
        for field, value in _fields(raw):
            if field == 1:
                p = dict(_fields(value))
                word, score, kind = p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, 1)
                i = len(self.text)
                self.text.append(word)
                if kind == 1:
                    self.pieces[word] = (-score, i)
                elif kind == 6:
                    self.bytes[i] = int(word[3:5], 16)
                    self.byte_id[self.bytes[i]] = i
                elif kind == 2:
                    self.unknown = i
                elif kind == 3:
                    self.control.add(i)
                else:
                    raise ValueError(f"pieces of kind {kind} are not supported")
            elif field == 2:
                kind_of = dict(_fields(value)).get(3, 1)
            elif field == 3:
                normal |= dict(_fields(value))
        if kind_of != 2:
            raise ValueError("only byte-pair models are supported")
        self.map = CharacterMap(normal[2])
        self.prefix, self.trim, self.escape = bool(normal[3]), bool(normal[4]), bool(normal[5])
        self.cut = self._cuts()
        self.merges = _Merges(self.pieces)
        self.segments = _Segments(300_000)
        # of each symbol its piece, and of each piece its bytes in a text that isn't changed, where blanks stand for the mark
        self.piece_of = [self.pieces[w][1] if w in self.pieces else -1 for w in self.merges.symbol]
        self.width = np.array([1 if i in self.bytes else len(w.replace(SPACE, " ").encode()) for i, w in enumerate(self.text)], np.int64)
        # pieces whose text depends on their neighbours: bytes of longer characters; a byte of ASCII is a character
        self.joined = np.array([self.bytes.get(i, 0) > 127 for i in range(len(self.text))])
        self.shown = [chr(self.bytes[i]) if i in self.bytes else w.replace(SPACE, " ") for i, w in enumerate(self.text)]
        self.decimal = [str(i) for i in range(len(self.text))]

    def _cuts(self) -> re.Pattern:
        """Segments between which no piece reaches."""
        words = [w.lstrip(SPACE) for w in self.pieces if len(w) > 1]
        if any(SPACE in w for w in words):
            return re.compile(".+", re.S)
        joined = set("".join(words))
        kinds = [{c for c in joined if c.isalpha()}, {c for c in joined if not c.isalpha()}]
        if any(len({c.isalpha() for c in w}) > 1 for w in words):
            kinds = [joined]  # a piece has letters beside others
        some = ["".join(map(re.escape, sorted(k))) for k in kinds if k]
        return re.compile("|".join([f"{SPACE}*[{k}]+" for k in some] + [f"{SPACE}+", f"[^{''.join(some)}]"]), re.S)

    def _ids(self, text: str) -> list[int]:
        """Of a character that isn't a piece: its bytes, or the unknown piece."""
        return [self.byte_id[x] for x in text.encode()] if self.bytes else [self.unknown]

    def _learn(self, segments: list[str]) -> None:
        """Merge segments that aren't in the table."""
        short = [x for x in segments if len(x) <= _Merges.WIDTH]
        for i in range(0, len(short), 4096):
            part, found = short[i : i + 4096], []
            for x, symbols in zip(part, self.merges.run(short[i : i + 4096]), strict=True):
                own = [self.piece_of[k] if k >= 0 else -1 for k in symbols]
                if -1 in own:  # a character without a piece stands alone
                    own = [i for _, ids in self.merge(x) for i in ids]
                found.append(own)
            self.segments.add(part, found)

    def normalize(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normalised text, and for each of its characters and its end the source byte; None where bytes only move with the prefix."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not len(self.map.units) and not self.trim:
            s = text.replace(" ", SPACE) if self.escape else text
            return (SPACE if self.escape else " ") * self.prefix + s, None
        b = text.encode()
        out: list[tuple[str, int]] = []
        at = 0
        while at < len(b):
            found = self.map.longest(b, at)
            if found:
                size, new = found[0], found[1].decode()
            else:
                size = 1
                while at + size < len(b) and b[at + size] & 0xC0 == 0x80:
                    size += 1
                new = b[at : at + size].decode()
            out += [(c, at) for c in new]
            at += size
        end = len(b)
        if self.trim:
            kept: list[tuple[str, int]] = []
            for c, at in out:
                if c != " " or (kept and kept[-1][0] != " "):
                    kept.append((c, at))
            while kept and kept[-1][0] == " ":
                end = kept.pop()[1]
            out = kept
        if not out:
            return "", np.zeros(1, np.int64)
        if self.prefix:
            out.insert(0, (" ", out[0][1]))
        s = "".join(c for c, _ in out)
        return s.replace(" ", SPACE) if self.escape else s, np.array([a for _, a in out] + [end], np.int64)

    def merge(self, segment: str) -> list[tuple[int, list[int]]]:
        """Pieces as (characters, ids): best-scored neighbours first, the left one of equals."""
        pieces, symbols = self.pieces, list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (hit := pieces.get(symbols[i] + symbols[j])):
                heapq.heappush(heap, (hit[0], i, len(symbols[i]) + len(symbols[j])))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out = []
        for s in symbols:
            if s:
                hit = pieces.get(s)
                out.append((len(s), [hit[1]] if hit else [self.byte_id[x] for x in s.encode()] if self.bytes else [self.unknown]))
        return out

    def surface(self, ids: list[int]) -> str:
        """Decoded text, but for the prefix; byte pieces that aren't UTF-8 give U+FFFD each."""
        out, run = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + size]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                i += size
            run.clear()

        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            flush()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.text[i].replace(SPACE, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self._unprefixed(self.surface(ids))

    def _unprefixed(self, s: str) -> str:
        return s[1:] if self.prefix and s.startswith(" ") else s

    def encode(self, text: str | None) -> Encoding:
        """All ids, each with its span of the text's bytes in UTF-8."""
        ids, starts, ends = self.encode_all([text])[0]
        return Encoding(ids.tolist(), list(zip(starts.tolist(), ends.tolist(), strict=True)))

    def _aligned(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, starts and ends of one text by the recorded alignment of its normalised characters."""
        s, source = self.normalize(text)
        if source is None:
            width = np.frombuffer(text.encode("utf-32-le"), "<u4")
            width = 1 + (width > 0x7F) + (width > 0x7FF) + (width > 0xFFFF)
            source = np.r_[np.zeros(1 + self.prefix, np.int64), np.cumsum(width)]
        ids, spans, at = [], [], 0
        for segment in self.cut.findall(s):
            for size, own in self.merge(segment):
                a, z = int(source[at]), int(source[at + size])
                at += size
                # each byte piece has its own byte where the character's bytes are the text's own
                each = len(own) == z - a and len(own) > 1
                ids += own
                spans += [(a + k, a + k + 1) if each else (a, z) for k in range(len(own))]
        pairs = np.array(spans, np.int64).reshape(-1, 2)
        return np.array(ids, np.int64), pairs[:, 0], pairs[:, 1]

    def encode_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, starts and ends of every text.

        Where the character map is empty, normalised characters are the text's
        own behind the prefix: spans then follow from the pieces' widths. A text
        with a mark of its own, which is wider than a blank, goes by alignment,
        as all do with a map.
        """
        out = [(np.zeros(0, np.int64),) * 3] * len(texts)
        same = not len(self.map.units) and not self.trim and self.prefix and self.escape and bool(self.bytes)
        plain = []
        for i, t in enumerate(texts):
            if t and same and SPACE not in t:
                plain.append(i)
            elif t:
                out[i] = self._aligned(t)
        held, size = [], 0
        for n, i in enumerate(plain):
            held.append(i)
            size += len(texts[i])
            if size > 1 << 21 or n + 1 == len(plain):
                for j, found in zip(held, self._plain([texts[k] for k in held]), strict=True):
                    out[j] = found
                held, size = [], 0
        return out

    def _plain(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) for t in texts]
        every = [x for c in cut for x in c]
        table = self.segments
        if len(table.index) > table.most:
            table.clear()
        self._learn([x for x in set(every) if x not in table.index])
        at = np.array([table.index.get(x, -1) for x in every], np.int64)
        begin, count = table.start[np.maximum(at, 0)], np.where(at >= 0, table.start[np.maximum(at, 0) + 1] - table.start[np.maximum(at, 0)], 0)
        long = np.flatnonzero(at < 0)
        pool = table.ids
        if len(long):  # segments beyond the table's width
            once = {x: [i for _, ids in self.merge(x) for i in ids] for x in {every[k] for k in long.tolist()}}
            extra = [once[every[k]] for k in long.tolist()]
            count[long] = [len(e) for e in extra]
            begin[long] = table.used + np.cumsum(count[long]) - count[long]
            pool = np.r_[pool[: table.used], np.array([i for e in extra for i in e], pool.dtype)]
        to = np.r_[0, np.cumsum(count)]
        ids = pool[np.repeat(begin - to[:-1], count) + np.arange(to[-1])].astype(np.int64)
        edge = to[np.cumsum([0] + [len(c) for c in cut])].tolist()
        width = self.width[ids]
        width[edge[:-1]] -= 1  # the prefix has no byte
        end = np.cumsum(width)
        out = []
        for a, z in zip(edge, edge[1:], strict=False):
            ends = end[a:z] - (end[a - 1] if a else 0)
            out.append((ids[a:z], ends - width[a:z], ends))
        return out

    def decoded(self, ids: np.ndarray) -> str:
        """decode() of an array."""
        if self.joined[ids].any() or (ids == self.unknown).any():
            return self.decode(ids.tolist())
        shown = self.shown
        return self._unprefixed("".join([shown[i] for i in ids.tolist()]))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each model file and process; its table serves all tasks of a worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, starts, ends: every piece's id and byte span."""

    def make():
        c = codec(path)
        return lambda texts: zip(*c.encode_all(texts), strict=True)

    return map_texts(documents(docs), "ids array<int>, starts array<int>, ends array<int>", make)


def query(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, and spans_sha256 of its pieces' starts and ends (little-endian unsigned 32-bit, in turn)."""

    def make():
        c = codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def run(texts):
            out = []
            for ids, starts, ends in c.encode_all(texts):
                decimal = c.decimal
                line = ",".join([decimal[i] for i in ids.tolist()])
                out.append((len(ids), sha(line.encode()), sha(c.decoded(ids).encode()), sha(np.stack([starts, ends], 1).astype("<u4").tobytes())))
            return zip(*out, strict=True)

        return run

    return map_texts(documents(docs), "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string", make)
