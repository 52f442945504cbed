import numpy as np

from marlspark.llm import language_id as L


def test_held_out_accuracy(spark):
    rows = L.query(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_gradient():
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 100, (200, L.WINDOW)).astype(np.int16), rng.integers(0, 2, 200)
    x[y == 1, ::2] = 120
    net = L.ByteConvNet(["a", "b"]).fit(x, y, epochs=4)
    assert (net.probabilities(x).argmax(1) == y).mean() > 0.95


def test_windows_cover_whole_texts():
    w, n = L.windows([b"", b"a" * 256, b"b" * 257])
    assert n.tolist() == [1, 1, 2] and (w != L.PAD).sum() == 513


def test_odd_rows(odd, empty):
    rows = L.query(odd).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert L.query(empty).count() == 0
    assert {(r.lang_pred, r.score) for r in L.identify(odd, None).collect()} == {("und", 0.0)}


def test_letters():
    import sys
    import unicodedata

    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if not 0xD800 <= i < 0xE000:
            assert L.has_letter(c) == unicodedata.category(c).startswith("L"), hex(i)
    assert not L.has_letter("²½①Ⅷ 12_") and L.has_letter("²½a") and not L.has_letter(None)


def test_predictions_equal_plain_loops(spark, docs):
    """Every filter at every place, maxima, softmax, and the mean over windows, one number after another."""
    model = L.train(docs.filter("doc_id % 2 = 0"), per_language=60)
    some = docs.filter("length(text) < 900").orderBy("doc_id").limit(6)
    got = {r.doc_id: r for r in L.identify(some, model).collect()}
    for r in some.collect():
        raw, total, mean = r.text.encode(), 0, np.zeros(len(model.classes))
        for at in range(0, len(raw), L.WINDOW):
            part = raw[at : at + L.WINDOW]
            e = np.array([model.embed[b] for b in part] + [model.embed[L.PAD]] * (L.WINDOW - len(part)), np.float64)
            h = np.zeros(model.n)
            for f in range(model.n):
                best = max(sum(float(e[i + k] @ model.filters[k * model.dim : (k + 1) * model.dim, f]) for k in range(model.span)) for i in range(L.WINDOW - model.span + 1))
                h[f] = max(best + model.shift[f], 0)
            s = np.exp(h @ model.dense + model.bias)
            mean += len(part) * s / s.sum()
            total += len(part)
        mean /= total
        assert got[r.doc_id].lang_pred == model.classes[int(mean.argmax())] and abs(got[r.doc_id].score - mean.max()) < 1e-3
