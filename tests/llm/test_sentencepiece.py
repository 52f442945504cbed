import hashlib
import random
import struct

import sentencepiece

from marlspark.llm import sentencepiece_codec as S
from marlspark.llm.common import pick
from marlspark.llm.queries import tokenizer

PATH = tokenizer("piece_bpe_32k.model")
ODD = ["", " ", "  a  b   ", "▁x ▁▁y", "a\n\n b", "日本語🤗 é \x00 \t", "<s> </s> <unk> <0x0A>", "x" * 300, " " * 50 + "y", "\n", "a▁", "ab" * 2000]


def _texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab ▁\né日🤗<s>0x'.,") for _ in range(rng.randrange(60))) for _ in range(800)]


def test_equals_the_library():
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), S.Codec(PATH)
    texts = _texts()
    codec.segments.most = 50  # emptied again and again
    for i in range(0, len(texts), 100):
        for text, (ids, starts, ends) in zip(texts[i : i + 100], codec.encode_all(texts[i : i + 100]), strict=True):
            want = lib.encode(text)
            assert ids.tolist() == want
            assert codec.decoded(ids) == codec.decode(want) == lib.decode(want)
            if text:
                for own, aligned in zip((ids, starts, ends), codec._aligned(text), strict=True):
                    assert own.tolist() == aligned.tolist()
    docs = [t for t in texts if t] + ["".join(chr(random.Random(i).choice([97, 98, 101, 116, 32, 233, 228, 0x3042, 0x1F600, 10])) for _ in range(1)) * 40 for i in range(30)]
    assert [codec.encode(t).ids for t in docs] == lib.encode(docs)


def test_spans_cover_the_text():
    codec = S.Codec(PATH)
    for text in _texts():
        spans = codec.encode(text).spans
        if text:
            assert spans[0][0] == 0 and spans[-1][1] == len(text.encode())
            assert all(a[1] == b[0] or a == b for a, b in zip(spans, spans[1:], strict=False))


def test_longest_prefix_normalisation():
    # a trie for "a" -> "x" and "ab" -> "y", laid out by hand in the compiled form
    units = [0] * 1024

    def put(node, offset, label=0, leaf=False):
        units[node] = (offset << 10) | (int(leaf) << 8) | label

    root = 256
    units[0] = root << 10
    a = root ^ ord("a")
    put(a, a ^ 512, ord("a"), True)
    units[512] = 0 | (1 << 31)
    b = 512 ^ ord("b")
    put(b, b ^ 768, ord("b"), True)
    units[768] = 2 | (1 << 31)
    m = S.CharacterMap(struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"x\0y\0")
    assert m.longest(b"abc", 0) == (2, b"y") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"c", 0) is None
    codec = S.Codec(PATH)
    codec.map = m
    s, at = codec.normalize("cab a")
    assert s == "▁cy▁x" and at.tolist() == [0, 0, 1, 3, 4, 5]


def test_query(odd, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in S.query(odd, PATH).join(pick(odd, "doc_id", "text").distinct(), "doc_id").collect():
        ids = lib.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        e = S.codec(PATH).encode(r.text)
        assert r.spans_sha256 == hashlib.sha256(struct.pack(f"<{2 * len(e.spans)}I", *[x for span in e.spans for x in span])).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert S.query(empty, PATH).count() == 0
    assert S.encode(odd.filter("doc_id = 5"), PATH).first().starts[0] == 0
