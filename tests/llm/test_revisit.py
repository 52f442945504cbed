import random

from marlspark.llm import revisit as V

SCHEMA = "record_id bigint, url string, captured_at bigint, kind string, etag string, last_modified string, headers map<string,string>"


def brute(rows):
    out = {}
    canon = lambda u: None if u is None else u.replace("https://", "").replace("http://", "").replace("www.", "").rstrip("/")
    for r in rows:
        if r[3] != "revisit":
            continue
        full = [q for q in rows if q[3] == "response" and q[1] and r[1] and canon(q[1]) == canon(r[1]) and q[2] is not None and r[2] is not None and q[2] < r[2]]
        if not full:
            out[r[0]] = ("unresolved", None)
            continue
        q = max(full, key=lambda q: (q[2], q[0]))
        weak = lambda t: t.removeprefix("W/")
        same = weak(r[4]) == weak(q[4]) if r[4] and q[4] else r[5] == q[5] if r[5] and q[5] else None
        out[r[0]] = ("unverified", q[0]) if same is None else ("resolved", q[0]) if same else ("mismatch", None)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        hot = rng.random() < 0.5
        url = "http://a.example/x" if hot else rng.choice(["https://www.a.example/x/", f"http://b.example/{rng.randrange(20)}", None])
        rows.append((i, url, rng.choice([None, *range(200)]), rng.choice(["response", "revisit", "metadata"]), rng.choice(["t1", "W/t1", "t2", None]), rng.choice(["d1", None]), {"etag": "x", "server": str(i), "content-type": rng.choice("ab")}))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS status", "2 AS `URL`")
    got = {r.record_id: (r.status, r.response_id) for r in V.resolve(df).collect()}
    assert got == brute(rows)


def test_headers(spark):
    rows = [(1, "http://a/x", 1, "response", "t", None, {"content-type": "text/html", "etag": "t", "server": "a"}), (2, "http://a/x", 2, "revisit", "t", None, {"content-type": "text/plain", "server": "b", "date": "d"})]
    r = V.resolve(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.headers == {"content-type": "text/html", "etag": "t", "server": "b", "date": "d"} and r.response_at == 1


def test_odd_rows(spark):
    assert V.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, "revisit", None, None, None), (1, "", 3, "revisit", None, None, None), (1, "", 3, "revisit", None, None, None), (2, "", 1, "response", None, None, None)]
    got = sorted((str(r.record_id), r.status) for r in V.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", "unverified"), ("1", "unverified"), ("None", "unresolved")]
