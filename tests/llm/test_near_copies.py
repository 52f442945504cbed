import numpy as np

from marlspark.llm import near_copies as N
from marlspark.llm import simhash as S

SCHEMA = "doc_id bigint, text string"


def brute(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(texts, similarity=0.8):
    sets, root = [brute(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            whole = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / whole if whole else 1) >= similarity:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(sets))]


def edited(seed=4):
    """Texts of 60 to 600 words, each with copies in which some words are replaced."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(40):
        base = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(60, 600))]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(f"x{rng.integers(10**6)}" if rng.random() < share else w for w in base))
    return [texts[i] for i in rng.permutation(len(texts))]


def test_near_copies_equal_brute_force(spark):
    texts = [*edited(), None, "", " \n", "two words", "Two  WORDS"]
    want = components(texts)
    assert len(set(want)) < 150  # many texts have near copies
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()} == dict(enumerate(want))
    # what a few bits of fingerprints link is less than half of it
    assert S.linked_prints(df).filter("doc_id <> component_id").count() < sum(i != c for i, c in enumerate(want)) / 2


def test_dealt_buckets_keep_components(spark, tmp_path):
    texts = edited(5)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    found = N.sketches(df, f"file://{tmp_path}/sets").localCheckpoint()
    points = found.withColumnRenamed("doc_id", "node")
    for bucket in (1024, 2):
        joined = {r.node: r.component for r in S.components(N.links(points, f"file://{tmp_path}/sets", bucket=bucket)).collect()}
        assert [joined.get(i, i) for i in range(len(texts))] == components(texts)


def test_fingerprints_link_what_sets_do_not(spark):
    """One line many times over: few distinct shingles are shared, and nearly all of the fingerprint's bits."""
    line = " ".join(f"w{i}" for i in range(40)) + " "
    a, b = (line * 200 + " ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    assert 0 < (S.fingerprint(a) ^ S.fingerprint(b)).bit_count() <= 4 and components([a, b]) == [0, 1]
    near = " ".join(f"q{i}" for i in range(300))
    texts = [near, b, a, near + " more", "alone in here", near]
    df = spark.createDataFrame([*enumerate(texts), (None, b), (None, "nobody has this")], SCHEMA)
    got = S.near_duplicates(df).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 4, 5: 0}
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [1, None]
