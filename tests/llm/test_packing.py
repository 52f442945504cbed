import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from marlspark.llm import packing as K
from marlspark.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


def test_tokens_of_every_latin_character_and_of_any_text_equal_the_library():
    r, own, library = random.Random(1), K.Tokens(PATH), Tokenizer.from_file(PATH)
    small = K.Tokens(PATH)
    small.tables = {k: K._Table(6) for k in small.tables}  # they are emptied all the time
    texts = [None, "", " ", "<|endoftext|> a<|startoftext|>b", "x" * 300 + " " + "'" * 40 + "ll", "it's we're they'll i'd 'story ''s 'r 'l 're"]
    texts += [f"a{chr(i)}b {chr(i)} {chr(i)}{chr(i)} '{chr(i)} X{chr(i)}'s" for i in range(256)]
    latin = "abcstrevlmdSTM'\"'\"!?.,<|>  \n\t\x1c\x85\xa0²½0123éÉßµ "
    for pool in (latin, latin + "你好’“—éά 　﻿İ😀"):
        texts += ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(1500)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = own(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert own(texts) == got
    assert small(texts) == got


def _valid(rows, length):
    """Sequences without gaps, none too long."""
    bins = {}
    for seq, at, n in rows:
        bins.setdefault(seq, []).append((at, n))
    for b in bins.values():
        pos = 0
        for at, n in sorted(b):
            assert at == pos
            pos += n
        assert pos <= length
    return len(bins)


def test_plan_gives_every_rank_one_place():
    r = random.Random(2)
    for length in (1, 5, 10, 37, 100):
        for _ in range(150):
            counts = {r.randrange(1, length + 1): r.randrange(1, 60) for _ in range(r.randrange(12))}
            slots = K.plan(counts, length)
            ranks, rows = {}, []
            for size, rank, n, first, offset in slots:
                ranks.setdefault(size, []).extend(range(rank, rank + n))
                rows += [(first + i, offset, size) for i in range(n)]
            assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
            _valid(rows, length)


def test_plan_is_near_the_bound():
    r = random.Random(3)
    counts = {}
    for _ in range(50000):
        k = min(4096, max(1, int(r.lognormvariate(6.2, 1.2))))
        counts[k] = counts.get(k, 0) + 1
    used = max(f + n for _, _, n, f, _ in K.plan(counts))
    assert used <= 1.01 * sum(k * v for k, v in counts.items()) / 4096 + 1


def test_tokens_equal_the_library():
    r, lib, mine = random.Random(4), Tokenizer.from_file(PATH), K.Tokens(PATH)
    texts = ["", " ", "it's 's", "A'S don't 1234", "<|endoftext|> x <|ENDOFTEXT|>", "é é ́x", "ΑΣ ΣΑΣ.", "İI ß ſ K", "日本 🤗👍🏽", " a b\tc\r\nd\x85e", "x" * 500, "µ ª º ² ½ × ÷"]
    texts += ["".join(r.choice("aB '1\né日🤗<|>ś\t Σ.,") for _ in range(r.randrange(40))) for _ in range(2000)]
    texts += ["".join(r.choice("aB 'sTvE1½²É×.,!\n ") for _ in range(r.randrange(40))) for _ in range(2000)]
    for t, got in zip(texts, mine(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def _check(df, out, length=4096):
    lib = Tokenizer.from_file(PATH)
    want = {}
    for r in df.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, i in enumerate(range(0, len(ids), length)):
            part = ids[i : i + length]
            want.setdefault((r.doc_id, k, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), []).append(1)
    got = {}
    for r in out:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == want
    return _valid([(r.sequence_id, r.offset, r.length) for r in out], length)


def test_query(docs):
    out = K.pack(docs, PATH).collect()
    assert _check(docs, out) <= 1 + 1.02 * sum(r.length for r in out) / 4096


def test_odd_rows(odd, empty):
    _check(odd, K.pack(odd, PATH).collect())
    assert K.pack(empty, PATH).count() == 0
