"""Rules at their limits, against plain Python."""

import random
import unicodedata
from difflib import SequenceMatcher
from urllib.parse import parse_qs, urlencode, urlparse

import pytest
from pyspark.sql import functions as F

from marlspark.functions import dates as D
from marlspark.functions import html as H
from marlspark.functions import scoring as S
from marlspark.functions import text as T
from marlspark.functions import urls as U
from marlspark.operators import fuzzy, matching
from marlspark.session import TRACKING_PARAMS


def values(spark, kind, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_url(spark):
    def plain(url):
        p = urlparse(url.strip())
        host = (p.hostname or "").lower()
        host = "127.0.0.1" if host in ("localhost", "0.0.0.0") else host
        port = f":{p.port}" if p.port and (p.scheme.lower(), p.port) not in (("http", 80), ("https", 443)) else ""
        q = urlencode(sorted((k, v) for k, v in parse_qs(p.query, keep_blank_values=True).items() if k.lower() not in TRACKING_PARAMS), doseq=True)
        path = p.path.rstrip("/") if p.path != "/" else "/"
        return f"{p.scheme.lower()}://{host}{port}{path or '/'}{'?' + q if q else ''}"

    urls = [
        "HTTP://Example.com:80/Path/?utm_source=google&id=123", "https://user:pw@Example.com:443/a//b///?b=2&a=1&a=0#frag", "http://localhost:8080/x?UTM_Source=1&q=a+b%20c&e=", "http://a.b/?x=~*%7E",
        "http://0.0.0.0", "https://e.com/?", " http://e.com/p?z=1&ref=2 ", "http://e.com/%C3%A9?k=%C3%A9",
    ]
    got = values(spark, "string", urls, U.normalize_url)
    assert got == [plain(u) for u in urls]
    assert values(spark, "string", got, U.normalize_url) == got


def test_domains_and_lanes(spark):
    assert values(spark, "string", ["http://a.b.co.uk/x", "https://www.example.com", "http://10.0.0.1/", "http://host/"], U.registrable_domain) == ["b.co.uk", "example.com", "10.0.0.1", "host"]
    assert values(spark, "string", ["http://a/x.PDF", "http://a/pdf", "http://a/pdf/x", "http://a/pdfs"], U.url_lane) == ["pdf", "pdf", "html", "html"]


def test_normalize_query(spark):
    rows = ["  “Smart” ‘quotes’ – dash — ", "ＦＵＬＬ width", "a  b\tc", "", "naïve ﬁ"]
    got = values(spark, "string", rows, T.normalize_query)
    assert got == ["\"smart\" 'quotes' - dash -", "full width", "a b c", "", unicodedata.normalize("NFKC", "naïve ﬁ")]
    assert values(spark, "string", got, T.normalize_query) == got


def test_cleaning(spark):
    assert values(spark, "string", ["|k\n|v\n|odd\nx", "a\n-\nb", "a [edit] b", "a\n\n\n\nb"], T.clean_extracted_text) == ["k: v\nodd\nx", "a\nb", "a b", "a\n\nb"]
    assert values(spark, "string", ["a\nb.\nc\n\nd e"], T.join_broken_lines) == ["a b.\nc\nd e"]
    assert values(spark, "string", ["rganization of\nwork", "nothing"], T.clean_block) == ["Organization of work", "nothing"]
    assert values(spark, "string", ["a b c d e f", "a b"], lambda c: F.size(T.shingles(c))) == [2, 0]
    assert values(spark, "string", ["<a href='x'>&\n"], T.escape_html) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;<br>"]
    assert values(spark, "int", [12, 200, 7500], T.duration_text) == ["12s", "3m 20s", "2h 5m"]


@pytest.mark.parametrize(("n", "points"), [(249, -10), (250, 0), (599, 0), (600, 12), (4500, 12), (4501, 5), (20000, 5), (20001, -10)])
def test_length_points(spark, n, points):
    assert values(spark, "int", [n], S.length_points) == [points]


def test_pdf_points(spark):
    assert values(spark, "int", [299, 300, 599, 600], S.pdf_words_points) == [0, 8, 8, 19]
    assert values(spark, "int", [99, 100, 189, 190, 209, 210, 490, 491, 510, 511, 800, 801], lambda c: S.pdf_density_points(c, F.lit(1))) == [0, 4, 4, 6, 6, 10, 10, 6, 6, 4, 4, 0]
    assert values(spark, "string", ["x.gov", "arxiv.org", "some.org", "x.com"], S.pdf_domain_points) == [20, 15, 8, 0]
    assert values(spark, "int", [39, 40, 69, 70], S.class_of) == ["skip", "maybe", "maybe", "legit"]


def test_dates(spark):
    texts = ["Published: January 15, 2024 by", "Updated: 3 February 2024", "on 2024-01-15 it was modified", "nothing"]
    got = values(spark, "string", texts, lambda c: F.struct(*[F.size(a) for a in D.byline_dates(c)]))
    assert [tuple(g) for g in got] == [(1, 0), (0, 1), (0, 1), (0, 0)]
    page = '<script type="application/ld+json">[{"datePublished":"2024-01-01"},{"datePublished":"2024-02-02","dateModified":"2024-03-03T10:00:00Z"}]</script><meta name="author" content="Ann Lee">'
    none = F.lit(None).cast("timestamp")
    d = values(spark, "string", [page, "<meta property='og:updated_time' content='2024-05-05'>", "x"], lambda c: D.detect_dates(c, F.lit(""), none, none))
    assert [(r.published_source, r.updated_source) for r in d] == [("jsonld", "jsonld"), ("none", "og"), ("none", "none")]
    assert str(d[0].published) == "2024-02-02 00:00:00" and d[0].updated.hour == 10
    s = values(spark, "string", [page], H.structured_data)[0]
    assert s.has_jsonld and not s.has_opengraph and s.author is None
    many = '<script type="application/ld+json">{"@type":"Thing"}</script><script type="application/ld+json">[' + '{"@type":"Thing"},' * 12 + '{"@type":"NewsArticle","author":{"name":"Ed Poe"},"datePublished":"2023-12-24"}]</script>'
    graph = '<script type="application/ld+json">{"@graph":[' + '{"a":1},' * 14 + '{"dateModified":"2022-02-02"},{"dateModified":"2023-02-02"}]}</script>'
    s = values(spark, "string", [many], H.structured_data)[0]
    assert (s.article_type, s.author, s.date) == ("NewsArticle", "Ed Poe", "2023-12-24")
    d = values(spark, "string", [many, graph], lambda c: F.struct(*D.json_ld_dates(c)))
    assert str(d[0][0])[:10] == "2023-12-24" and str(d[1][1])[:10] == "2022-02-02"
    close = "2024-01-01 2024-01-02 2024-01-03 and later updated 2024-02-02, 2024-02-03"
    found = values(spark, "string", [close], lambda c: F.struct(*D.byline_dates(c)))[0]
    assert [len(x) for x in found] == [2, 3]


def test_marks_and_line_breaks(spark):
    assert values(spark, "string", ["«a» ‘b’ “c” d–e"], T.normalize_query) == ["\"a\" 'b' \"c\" d-e"]
    assert values(spark, "string", ["a\n\n\nb\n\n\n\n\nc"], lambda c: T.normalize_line_breaks(c, "pdf")) == ["a\n\n\nb\n\nc"]
    xml = "<rss><item><link>https://x.org/ab</link><pubDate>1 Jan 2024 00:00:00</pubDate></item><item><link>https://x.org/a</link><pubDate>2 Jan 2024 00:00:00</pubDate></item></rss>"
    assert str(values(spark, "string", [xml], lambda c: H.feed_date(c, F.lit("https://x.org/a")))[0])[:10] == "2024-01-02"


def test_rubric_places(spark):
    pages = ['<meta content="Jane Doe" name="author">', '<span class="byline">by <a>Ann Lee</a></span>', '<div rel="author">one</div>', "<p>Jane Doe</p>", '<a class="x-author-y" href="/z">jane doe</a>']
    assert values(spark, "string", pages, S.byline_points) == [10, 10, 0, 0, 0]
    dates = ['<time itemprop="datePublished" datetime="2023-05-05T10:00:00Z">x</time>', '<span class="date">2019/05/06</span>', '<span class="date">2023/05/06</span>', '<meta name="publishdate" content="2023">', '<meta property="article:published_time" content="Today">', "2024-01-01"]
    assert values(spark, "string", dates, lambda c: S.recent_points(c, F.lit("2024-02-01").cast("timestamp"))) == [10, 0, 10, 10, 0, 0]


def test_fuzzy_matches_equal_brute_force(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abcde ") for _ in range(r.randrange(1, 40))) for _ in range(40)] + ["lorem ipsum " * 420]
    def changed(s, k):
        x = list(s)
        for _ in range(k):
            i = r.randrange(len(x) + 1)
            x[i : i + r.randrange(2)] = r.choice(["", "z", "b"])
        return "".join(x)
    asked = [(f"a{i}", changed(s, r.randrange(6))) for i, s in enumerate(base)] + [("n", None), ("e", "")]
    cached = [(f"c{i:02}", s) for i, s in enumerate(base)] + [("c98", ""), ("c99", base[0]), ("cn", None)]
    a, c = (spark.createDataFrame(x, "id string, query string") for x in (asked, cached))
    for t in (98, 85, 70, 50):
        want = {}
        for i, q in asked:
            hits = sorted((-fuzzy.ratio(q, m), k) for k, m in cached if q is not None and m is not None and fuzzy.ratio(q, m) >= t)
            if hits:
                want[i] = (hits[0][1], int(-hits[0][0]))
        assert {x.id: (x.match_id, x.score) for x in fuzzy.best_matches(a, c, t).collect()} == want, t


def test_freshness_rules(spark):
    from marlspark.session import Settings

    rows = [(304, None, None, 1.0, "html"), (200, "a", "a", 1.0, "html"), (200, "a", "b", 1.0, "html"), (200, None, None, 6.9, "html"), (200, None, None, 7.0, "html"), (200, None, None, None, "pdf"), (200, None, None, 29.0, "pdf")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status int, old string, new string, age double, kind string")
    now, no = F.lit("2024-02-01").cast("timestamp"), F.lit(None)
    at = F.timestamp_micros(F.unix_micros(now) - (F.col("age") * 86400000000).cast("bigint"))
    f = D.freshness(F.col("status"), F.col("old"), F.col("new"), no.cast("string"), no.cast("string"), at, no.cast("timestamp"), no.cast("timestamp"), F.col("kind"), Settings().staleness_days, now)
    got = [r.f.reason for r in df.select("i", f.alias("f")).orderBy("i").collect()]
    assert got == ["not_modified", "etag_match", "etag_changed", "within_staleness", "stale", "never_fetched", "within_staleness"]


def test_indel_ratio():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fuzzy.common_subsequence(a, b) == table[-1][-1]
        assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a) and (fuzzy.ratio(a, b) == 100) == (a == b)
        assert fuzzy.ratio(a, b) >= SequenceMatcher(None, a, b, False).ratio() * 100 - 1e-9


def test_fuzzy_candidates_lose_nothing(spark):
    rng = random.Random(2)
    a = [(f"a{i}", "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    b = [(f"b{i}", "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    got = {r.id: (r.match_id, r.score) for r in fuzzy.best_matches(spark.createDataFrame(a, "id string, query string"), spark.createDataFrame(b, "id string, query string"), 80).collect()}
    want = {}
    for i, q in a:
        s, m = min((-fuzzy.ratio(q, p), j) for j, p in b)
        if -s >= 80:
            want[i] = (m, int(-s))
    assert got == want


def test_alignment():
    assert matching.align("x  hello\nworld  y", "hello world")[:3] == ("exact", 3, 14)
    assert matching.align("first one\n\nsecond part here", "say second part here now")[:3] == ("fuzzy", 11, 27)
    assert matching.align("abc", "zzz") is None and matching.align(None, "a") is None and matching.align("a", "  ") is None


def test_page_structure():
    p = H.parse("<html><title>A &amp; B</title><nav><p>skip me</p></nav><h1>Head</h1><p><b>one<p>two</p><script>var t='</p>';</script><a href='/x'>l</a><link rel='next'></html>")
    assert p["title"] == "A & B" and [b["text"] for b in p["blocks"]] == ["Head", "one", "two"] and p["rel_next"] and p["n_links"] == 1
    assert H.parse(None)["blocks"] == []


def test_result_lists(spark):
    rows = [("q", "scholar", [("T", "http://a", "s", [("R", "http://r")])]), ("q", "organic", [("U", "", "s", None), ("V", None, "s", None)])]
    df = spark.createDataFrame(rows, "query_id string, kind string, items array<struct<title:string,link:string,snippet:string,resources:array<struct<title:string,link:string>>>>")
    assert sorted((r.url, r.title) for r in matching.flatten_results(df).collect()) == [("", "U"), ("http://a", "T"), ("http://r", "R (PDF)")]
    ddg = spark.createDataFrame([("T", "http://h", None, "b"), ("E", "", "", "x")], "title string, href string, url string, body string")
    assert [tuple(r) for r in matching.rename_results(ddg).collect()] == [("T", "http://h", "b")]


def test_fuzzy_matches_of_all_lengths_equal_all_pairs(spark):
    """At every threshold, by segments or by blocks, in small blocks too: no pair is lost and none is repeated."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "no", "x", "query", "find", "é🤗", "the"]
    cached = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(80)] + ["".join(rng.choice("abcdefgh ij") for _ in range(rng.randrange(50, 300))) for _ in range(15)]

    def typo(t):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["q", "", "", " "]) + t[i + rng.randrange(2) :]
        return t

    asked = [typo(rng.choice(cached)) for _ in range(80)] + [typo(c) for c in cached[-15:]]
    a, b = (spark.createDataFrame([(x,) for x in rows] + [(None,)], "query string") for rows in (asked, cached))
    kept = fuzzy.BLOCK, fuzzy.ASKED
    try:
        for threshold, fuzzy.BLOCK, fuzzy.ASKED in ((60, 7, 5), (85, 16, 4), (97, 1024, 128)):
            want = sorted((x, y) for x in set(asked) for y in set(cached) if fuzzy.ratio(x, y) >= threshold)
            assert sorted((r.query, r.match) for r in fuzzy.matches(a, b, threshold).collect()) == want
    finally:
        fuzzy.BLOCK, fuzzy.ASKED = kept
    assert fuzzy.matches(a.limit(0), b, 85).count() == 0


def test_best_of_many_fuzzy_matches_reach_a_floor(spark):
    """What is below a ratio that enough strings reach isn't searched for, and nothing among the best is lost: against all pairs."""
    rng = random.Random(5)
    words = ["the", "and", "erti", "on", "han", "thing", "ou", "ñes", "was", "n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 12, 30, 45]))) for _ in range(60)]
    asked = [(str(i), t.rpartition(" ")[0]) for i, t in enumerate(texts)]
    cached = [(f"{i}/{k}", x) for i, t in enumerate(texts) for k, x in enumerate((t, "who knows " + t, t.replace("n", "m"), t))]
    a, c = (spark.createDataFrame(rows, "id string, query string") for rows in (asked, cached))
    want = set()
    for i, q in asked:
        ranked = sorted((-fuzzy.ratio(q, m), k) for k, m in cached if fuzzy.ratio(q, m) >= 80)
        want |= {(i, k, int(-r), n) for n, (r, k) in enumerate(ranked[:3], 1)}
    assert {tuple(r) for r in fuzzy.best_matches(a, c, 80, 3).collect()} == want
    distinct = {m for _, m in cached}
    third = {q: sorted((fuzzy.ratio(q, m) for m in distinct), reverse=True)[2] for _, q in asked}
    hashed = fuzzy._hashed(a)
    found = {r.text: r.floor for r in fuzzy.floors(hashed, fuzzy._hashed(c), 3).join(hashed.select(F.col("key").alias("query"), F.col("query").alias("text")), "query").collect()}
    long = {q for _, q in asked if len(q) > 80}
    assert all(f <= third[q] for q, f in found.items()) and len(long & {q for q, f in found.items() if f > 80}) > 0.6 * len(long)


def test_table_cells_are_paired_in_runs(spark):
    """Against a loop over lines that keeps the key of a pair."""

    def loop(t):
        out, key = [], None
        for x in t.split("\n"):
            bar = x.strip(" ").startswith("|")
            cell = x.strip(" ")[1:].strip(" ")
            if bar and key is None:
                key = cell
            elif bar:
                out.append(f"{key}: {cell}")
                key = None
            else:
                out += ([] if key is None else [key]) + [x]
                key = None
        return "\n".join(out + ([] if key is None else [key]))

    rng = random.Random(8)
    texts = ["".join(rng.choice(["|", " ", "a", "b c", "\n", "\n|", "$1", "\r", "é"]) for _ in range(rng.randrange(30))) for _ in range(400)] + ["|k\n" * 200_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(T.clean_wikipedia_tables(F.col("t"))).collect()] == [loop(t) for t in texts]


def titled_pages(spark, folder):
    """Pages whose titles hold references that are cut, others than &amp;, lines, or nothing."""
    titles = ["A &amp; B", "cut &amp", "token = &quot;0b96", " &copy; &lt;b&gt; &#65; ", "two\nlines  of it", "", "&amp;amp;"]
    rows = [(i, f"http://a.b/{i}", f"<html>\n<head><title>{t}</title></head><body><article><a href='/x'>l</a></article><svg><title>other</title></svg></body></html>") for i, t in enumerate(titles)]
    rows.append((len(rows), "http://a.b/none", "<html><body><article>no title</article></body></html>"))
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return [*(t.strip(" ").replace("&amp;", "&") for t in titles), ""]


def titles_by_sql(name, folder):
    import duckdb

    from marlspark import catalog

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    return dict(con.execute(f"SELECT page_id, title FROM ({catalog.ORACLE_SQL[name]})").fetchall())


def test_titles_are_as_written(spark, tmp_path):
    from marlspark import catalog

    titles = titled_pages(spark, tmp_path)
    got = {r.page_id: r.title for r in catalog.QUERIES["html_features"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(titles)) == titles_by_sql("html_features", tmp_path)


def test_titles_of_marked_pages_are_as_written(spark, tmp_path):
    from marlspark import catalog

    titled_pages(spark, tmp_path)
    got = {r.page_id: r.title for r in catalog.QUERIES["html_features_marked"](spark, str(tmp_path)).collect()}
    assert got == titles_by_sql("html_features_marked", tmp_path)


def test_features_of_broken_marked_pages(spark, tmp_path):
    """Comments and tags that never end, wide spaces around a title, no page, and ids below 0."""
    import duckdb

    from marlspark import catalog

    title = "<title>T &amp; t</title>"
    pages = [
        "<p>a</p>\n\n<p>b</p>\n<!-- not closed >\n<p>c</p>\n" + title, "<html>\n<a href='x>\n\n<p>\n" + title, "<title>\u00a0 wide\u3000</title>", None, "", "<TITLE\n>up</TITLE>", "<title>never ends",
        title + "\n<b\n<article/><article\u000b><article\n><a\u000bhref=x><A title=t HREF=''>", "<!-- <article> <a href=1> --><script>'<a href=2>'</script><svg><title>in</title></svg>" + title,
    ]
    rows = [(i, f"http://a.b/{i}", h) for i, h in enumerate(pages, 2)] + [(-1, "http://a.b/below", title), (-13, "http://a.b/below", title), (None, "http://a.b/none", title)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, catalog.QUERIES["html_features_marked"](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT page_id, n_articles, n_links, title, rel_next FROM ({catalog.ORACLE_SQL['html_features_marked']})").fetchall(), key=str)
    assert got == want
    well = title + "<article><a class=b href='/x'>x</a></article><article></article><link rel='next' href='/2'>"
    parsed, written = values(spark, "string", [well], lambda c: F.struct(H.features(c), F.struct(*H.written_features(c))))[0]
    assert (parsed.n_articles, parsed.n_links, parsed.rel_next) == (written.n_articles, written.n_links, written.rel_next) == (2, 1, True)


def test_bylines_of_long_texts_take_no_long_time(spark):
    """What stands before a match is looked at where one is, not at every character."""
    from time import time

    text = "Some words of no date at all, and 12 numbers. " * 1500
    rows = [text + "Updated: January 15, 2024 by us"] * 60
    start = time()
    got = values(spark, "string", rows, lambda c: F.struct(*D.byline_dates(c)))
    assert {(len(p), len(u)) for p, u in got} == {(0, 1)} and time() - start < 15


def test_every_form_of_a_date_is_read(spark):
    dates = ["2024-01-15", "2024-01-15T00:00:00", "January 15, 2024", "JANUARY 15 2024", "15 january  2024", "Jan 15, 2024", "Jan 15 2024", "15 Jan 2024"]
    assert {str(x) for x in values(spark, "string", dates, D.parse_date)} == {"2024-01-15 00:00:00"}
    assert values(spark, "string", ["15", "Mon 15", "2024-13-01", "", None], D.parse_date) == [None] * 5
