import hashlib
import random
import zlib
from collections import defaultdict

from marlspark.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, mixed=True):
    """All nodes by their prefixes, one conversation after another."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((-1 if turn is None else turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if mixed else 0
        made[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in sorted(made.items()):
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if made[c] == k)
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows, mixed=True):
    df = spark.createDataFrame(rows, SCHEMA)
    got = (P.query if mixed else P.build)(df)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, mixed)


def test_equals_all_prefixes(spark, monkeypatch):
    monkeypatch.setattr(P, "FIRST", 2)
    monkeypatch.setattr(P, "MOST", 3)
    monkeypatch.setattr(P, "BLOCK", 3)
    monkeypatch.setattr(P, "RUN", 2)
    rng = random.Random(1)
    rows = []
    for c in rng.sample(range(500), 40):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice("ua"), rng.choice(["", "x", "yy"]) if t > 1 else "same"))
    long = [(t, "u", "word " * (t % 3)) for t in range(12)]
    for c in (700, 701, 702, 703, 799, 900):  # copies, and prefixes of one another
        rows += [(c, *x) for x in long[: 12 - c % 3]]
    rng.shuffle(rows)
    same(spark, rows)
    same(spark, rows, mixed=False)


def test_nulls_and_lone_conversations(spark):
    same(spark, [(5, None, None, None), (5, 0, "u", "a"), (None, 0, "u", "a"), (7, 3, "u", None), (7, 4, None, "b"), (-5, 0, "u", "a"), (-100, 0, "u", "é🤗"), (-100, 1, "a", "x" * 70000), (1, 0, "u", "a"), (201, 0, "u", "b")])
    same(spark, [(3, 0, "u", "a"), (3, 1, "a", "b")], mixed=False)
    assert P.query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "a"), (3, 0, "u", "a")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS `TEXT`", "3 AS `a.b`", "4 AS rep")
    assert sorted(map(tuple, P.build(df).collect()), key=str) == brute(rows, mixed=False)


def test_given_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert sorted(map(tuple, P.query(df).collect()), key=str) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
