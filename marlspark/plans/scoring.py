"""Scores of pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls as U
from ..registry import query
from ..sources.tables import as_of, pages, table
from .web import _SENTENCES, _VOWELS, _WORDS, SQL_HOST, SQL_PAGES

_N = f"len({_WORDS.format(t='text')})"


def _length_sql(n: str) -> str:
    return f"CASE WHEN {n} BETWEEN 600 AND 4500 THEN 12 WHEN {n} BETWEEN 4501 AND 20000 THEN 5 WHEN {n} < 250 OR {n} > 20000 THEN -10 ELSE 0 END"


_QUOTES = f"""CASE WHEN len({_SENTENCES.format(t='text')}) > 0 AND len(list_filter({_SENTENCES.format(t='text')}, lambda s: contains(s, '"') OR contains(s, ''''))) / len({_SENTENCES.format(t='text')}) BETWEEN 0.03 AND 0.3 THEN 5 ELSE 0 END"""
_ENTITIES = f"""CASE WHEN len(list_filter({_WORDS.format(t="string_split(substr(text, 1, 200), chr(10) || chr(10))[1]")}[2:], lambda w: length(w) > 2 AND regexp_matches(w, '^\\p{{Lu}}'))) >= 2 THEN 5 ELSE 0 END"""
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 20)"
_ELLIPSIS = f"""CASE WHEN len({_LINES}) < 3 THEN 0 WHEN len(list_filter({_LINES}, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) / len({_LINES}) > 0.3 THEN -15 WHEN len(list_filter({_LINES}, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) / len({_LINES}) > 0.15 THEN -8 ELSE 0 END"""
_WIRE = "CASE WHEN regexp_matches(lower(substr(text, 1, 500)), 'reuters|ap news|associated press|bloomberg|afp|agence france-presse') THEN 0 ELSE 8 END"


@query(f"SELECT doc_id, {_N} AS n_words, {_length_sql(_N)} AS points FROM documents")
def score_length(spark, sf_dir):
    n = T.word_count(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words")).withColumn("points", S.length_points(F.col("n_words")))


@query(f"SELECT doc_id, {_QUOTES} AS points FROM documents")
def score_quotes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.quote_points(F.col("text")).alias("points"))


@query(f"SELECT doc_id, {_ENTITIES} AS points FROM documents")
def score_entities(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.entity_points(F.col("text")).alias("points"))


@query(f"SELECT doc_id, {_ELLIPSIS} AS points FROM documents")
def score_ellipsis(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.ellipsis_points(F.col("text")).alias("points"))


_HREF = """len(regexp_extract_all({h}, '(?i)<a\\s[^>]*href='))"""
_ARTICLE = """regexp_extract(html, '(?is)<article[\\s>].*?</article>')"""
_PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|aside)[^>]*>.*?</(script|style|nav|footer|aside)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""


def page_text(html):
    """Visible text by patterns: without scripts, styles, navigation, footers, asides, comments and tags."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|aside)[^>]*>.*?</(script|style|nav|footer|aside)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, T.SPACES, " "))


@query(f"SELECT page_id, {_HREF.format(h='html')} AS n_links, {_HREF.format(h=_ARTICLE)} AS n_article_links, CASE WHEN {_HREF.format(h=_ARTICLE)} > 50 THEN -6 ELSE 0 END AS points FROM pages")
def score_links(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", "html", S.main_region(F.col("html")).alias("region"), T.word_count(page_text(F.col("html"))).alias("n"))
    return p.select("page_id", S.link_count(F.col("html")).alias("n_links"), S.link_count(F.col("region")).alias("n_article_links"), S.link_points(F.col("region"), F.col("n")).alias("points"))


_DOMAIN = r"""CASE WHEN regexp_matches(netloc, '\.edu|stanford\.edu|mit\.edu|harvard\.edu|berkeley\.edu|reuters\.com|bloomberg\.com|bbc\.com|theguardian\.com|nature\.com|science\.org|arxiv\.org') THEN 5
    WHEN regexp_matches(netloc, '\d{4,}|cheap|deals|buy|discount|-ads|promo') THEN -4 ELSE 0 END"""
_PAGED = "CASE WHEN (contains(url, 'page=') OR contains(url, '/page/')) AND NOT regexp_matches(html, '(?i)<link[^>]*rel=[\"'']next[\"'']') THEN -5 ELSE 0 END"


@query(f"WITH {SQL_PAGES} SELECT page_id, {_PAGED} AS pagination, {_DOMAIN} AS domain, CASE WHEN path IN ('', '/') THEN -20 ELSE 0 END AS homepage FROM p")
def score_url_signals(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select(
        "page_id", S.pagination_points(u, F.col("html")).alias("pagination"), S.domain_points(F.lower(U.authority(u))).alias("domain"),
        F.when(U.path(u).isin("", "/"), -20).otherwise(0).alias("homepage"),
    )


_TITLE_SQL = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
_BLOCK_END = r"(?i)</(?:p|div|li|h[1-6]|article|section|tr|td|blockquote|title)>|<br\s*/?>"


def page_lines(html):
    """Visible text with a line for each block."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|nav|footer|aside)[^>]*>.*?</(script|style|nav|footer|aside)>", " "), r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, T.SPACES, " "), _BLOCK_END, "\n"), "<[^>]*>", " ")
    return F.regexp_replace(t, " +", " ")


#: What pages of the driver's tables don't have: authors, dates, structured data, canonical URLs, teasers and loud titles, by page_id.
_EXTRA = (
    "", '<meta name="author" content="Jane Doe">', '<span class="byline">by <a href="/x">Ann Lee</a></span>', '<meta property="article:published_time" content="2023-11-05T10:00:00Z">',
    '<time itemprop="datePublished" datetime="2019-01-01">long ago</time><span class="date">2023/05/06</span>',
    '<script type="application/ld+json">{"@type":"Person"}</script><script type="application/ld+json">[{"@type":"WebPage"},{"@type":"NewsArticle","author":{"name":"Ed Poe"},"datePublished":"2023-12-24"}]</script>',
    '<meta property="og:type" content="article"><meta property="og:article:author" content="Og Author">', "<p>A teaser of some length that is cut off...</p>" * 12,
    '<article><a href="/go/1">x</a></article><article></article><script type="application/ld+json">{"@type":"Thing"</script>', '<article></article><article></article><div rel="author">one</div>',
)
_LOUD = ("<title>WHAT HAPPENED NEXT!!! ", "<title>SHOCKING NEWS OF THE DAY</title>")


def marked_pages(spark, sf_dir):
    """Pages with every signal of the rubrics on some."""
    html, i = F.col("html"), F.col("page_id")
    canonical = F.when(i % 7 == 0, F.concat(F.lit('<link rel="canonical" href="'), F.col("url"), F.lit('">'))).otherwise("")
    loud = F.when(i % 9 == 0, F.regexp_replace(html, "<title>", _LOUD[0])).when(i % 9 == 1, F.regexp_replace(html, "<title>[^<]*</title>", _LOUD[1])).otherwise(html)
    place = (i % len(_EXTRA) + 1).cast("int")
    extra = F.when(place != 0, F.element_at(F.array(*map(F.lit, _EXTRA)), place))  # place 0 has nothing, as in SQL
    return pages(spark, sf_dir).select("page_id", "url", F.concat(loud, canonical, extra).alias("html"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_MARKED = f"""marked AS (SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN replace(html, '<title>', {_quoted(_LOUD[0])}) WHEN page_id % 9 = 1 THEN regexp_replace(html, '<title>[^<]*</title>', {_quoted(_LOUD[1])}) ELSE html END
  || CASE WHEN page_id % 7 = 0 THEN '<link rel="canonical" href="' || url || '">' ELSE '' END || [{", ".join(map(_quoted, _EXTRA))}][page_id % {len(_EXTRA)} + 1] AS html FROM pages)"""


def html_signals(p):
    """Of pages (page_id, url, html) the text and every signal of the rubric."""
    html, u, low = F.col("html"), F.col("url"), F.col("low")
    p = p.withColumn("low", F.lower(html)).select(
        "page_id", "url", "html", page_text(html).alias("text"), page_lines(html).alias("lines"), F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        S.main_region(html).alias("region"), D.json_ld_items(html).alias("ld"),
        *[c.alias(f"author{i}") for i, c in enumerate(S.byline_elements(html, low))], *[c.alias(f"date{i}") for i, c in enumerate(S.date_elements(html, low))],
    )
    # projected one after another: an expression that stands in several places is not evaluated in each
    authors, dates = [f"author{i}" for i in range(len(S.AUTHORS))], [f"date{i}" for i in range(len(S.DATES))]
    p = p.withColumns({"n_words": T.word_count(F.col("text")), "article": S.is_article(F.col("ld"))} | {a: S.element_value(F.col(a)) for a in authors} | {d: S.element_value(F.col(d), "datetime") for d in dates})
    own = lambda names: [F.col(n) for n in names]
    canonical = F.regexp_extract(html, r"""(?is)<link[^>]*rel=["']canonical["'][^>]*href=["']([^"']*)["']""", 1)
    t, title, article = F.col("text"), F.col("title"), F.col("article")
    return p.select(
        "page_id", U.normalize_url(u).alias("url"), "title", "n_words", T.normalize_text(t).alias("text"), "html", "article", F.size("ld").alias("n_items"),
        S.schema_points(html, article).alias("schema"), S.named_points(own(authors)).alias("byline"), S.dated_points(own(dates), as_of()).alias("date"), S.canonical_points(U.host(canonical), U.host(u)).alias("canonical"),
        S.length_points(F.col("n_words")).alias("length"), S.quote_points(t).alias("quotes"), S.wire_points(t).alias("wire"), S.entity_points(t).alias("entities"),
        S.roundup_points(title).alias("roundup"), S.link_points(F.col("region"), F.col("n_words")).alias("links"), S.pagination_points(u, html).alias("pagination"),
        S.clickbait_points(title).alias("clickbait"), S.domain_points(F.lower(U.authority(u))).alias("domain"),
        S.page_type_points(U.path(u), F.regexp_count(html, F.lit("(?i)<article[ >]")), article, F.col("n_words"), S.link_count(html)).alias("page_type"),
        S.ellipsis_points(F.col("lines")).alias("snippets"),
    )


SIGNALS = ("schema", "byline", "date", "canonical", "length", "quotes", "wire", "entities", "roundup", "links", "pagination", "clickbait", "domain", "page_type", "snippets")


def _element_sql(tags: tuple[str, ...], attribute: str, value: str, *first: str) -> str:
    mark = r"(?:\s|\s[^>]*\s)" + attribute + "=[\"''](?:" + value + ")[\"''][^>]*>"
    found = "regexp_extract(html, '(?is)" + "|".join(f"<{t}{mark}" + ("" if t == "meta" else f".*?</{t}>") for t in tags) + "')"
    of = [f"nullif(trim(regexp_extract({found}, '(?is)^<[^>]*\\s{a}=[\"'']([^\"'']*)[\"'']', 1)), '')" for a in (*first, "content")]
    return f"coalesce({', '.join(of)}, trim(regexp_replace(regexp_replace({found}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))"


_AUTHORED = " OR ".join(
    f"(len({_WORDS.format(t=x)}) >= 2 AND len(list_filter({_WORDS.format(t=x)}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) > 0)"
    for x in (_element_sql(("span", "div", "p", "a", "meta"), a, v.replace("'", "''")) for a, v in (("class", "[^\"']*(?:author|byline|writer)[^\"']*"), ("rel", "author"), ("itemprop", "author"), ("name", "author")))
)
_DATED = " OR ".join(
    f"coalesce(CASE WHEN contains({x}, 'T') THEN try_strptime(split_part({x}, 'T', 1), '%Y-%m-%d') ELSE coalesce({', '.join("try_strptime(substr(" + x + ", 1, 10), '" + f + "')" for f in ("%Y-%m-%d", "%Y/%m/%d", "%B %d, %Y", "%d %B %Y", "%Y"))}) END >= TIMESTAMP '2022-02-01', false)"
    for x in (
        _element_sql(("time", "span", "div", "meta"), a, v.replace("'", "''"), "datetime")
        for a, v in (("itemprop", "datePublished"), ("property", "article:published_time"), ("name", "article:published_time"), ("name", "publishdate"), ("class", "[^\"']*(?:date|time|publish)[^\"']*"))
    )
)
_BODIES = """list_filter(regexp_extract_all(html, '(?is)<script[^>]*type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1), lambda b: json_valid(b))"""
_IS_ARTICLE = f"""len(list_filter({_BODIES}, lambda b: contains(coalesce(json_extract_string(b, '$."@type"'), ''), 'Article') OR len(list_filter(json_extract_string(b, '$[*]."@type"'), lambda k: contains(k, 'Article'))) > 0)) > 0"""
_CANONICAL = """regexp_extract(html, '(?is)<link[^>]*rel=["'']canonical["''][^>]*href=["'']([^"'']*)["'']', 1)"""
_AFFILIATE = f"""len(list_filter(regexp_extract_all({_ARTICLE}, '(?i)<a\\s[^>]*href=["'']([^"'']*)["'']', 1), lambda u: regexp_matches(u, '/go/|ref=|utm_|aff_|affiliate|track=')))"""
_OG_TYPE = """coalesce(nullif(regexp_extract(html, '(?is)<meta[^>]*(?:property|name|itemprop)=["'']og:type["''][^>]*content=["'']([^"'']*)["'']', 1), ''), '')"""
_LINES_OF = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|aside)[^>]*>.*?</(script|style|nav|footer|aside)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '\s+', ' ', 'g'),
  '(?i)</(?:p|div|li|h[1-6]|article|section|tr|td|blockquote|title)>|<br\s*/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), ' +', ' ', 'g')"""


def _signals_sql(source: str) -> str:
    """CTEs up to h: every signal, and the clamped total, of a table of pages."""
    return rf"""{SQL_PAGES.replace("FROM pages", f"FROM {source}")}, t AS (SELECT page_id, url, norm, netloc, path, html, {_TITLE_SQL} AS title, {_PLAIN} AS text, {_LINES_OF} AS lines, {_IS_ARTICLE} AS article FROM p),
s AS (SELECT page_id, norm, title, html, article, netloc, {_N} AS n_words, CASE WHEN article THEN 20 WHEN contains(lower({_OG_TYPE}), 'article') THEN 15 ELSE 0 END AS schema,
  CASE WHEN {_AUTHORED} THEN 10 ELSE 0 END AS byline, CASE WHEN {_DATED} THEN 10 ELSE 0 END AS date, CASE WHEN {_CANONICAL} <> '' AND {SQL_HOST.format(u=_CANONICAL)} = {SQL_HOST.format(u="url")} THEN 8 ELSE 0 END AS canonical,
  {_length_sql(_N)} AS length, {_QUOTES} AS quotes, {_WIRE} AS wire, {_ENTITIES} AS entities,
  CASE WHEN regexp_matches(lower(title), 'top \d+|\d+ things|\d+ ways|\d+ reasons|roundup|best of \d{{4}}|what you need to know') OR length(title) - length(translate(title, '•|', '')) > 2 THEN -5 ELSE 0 END AS roundup,
  CASE WHEN {_HREF.format(h=_ARTICLE)} > 50 OR {_AFFILIATE} / greatest(1, {_N} // 300) > 2 THEN -6 ELSE 0 END AS links, {_PAGED} AS pagination,
  CASE WHEN regexp_matches(lower(title), 'you won''t believe|shocking|what happened next|this is why|number \d+ will shock you|doctors hate') THEN -3 ELSE 0 END AS clickbait, {_DOMAIN} AS domain,
  CASE WHEN path IN ('', '/') THEN -20 WHEN len(regexp_extract_all(html, '(?i)<article[ >]')) >= 3 AND NOT article THEN -15 WHEN {_N} < 400 AND {_HREF.format(h='html')} > 10 THEN -10 ELSE 0 END AS page_type,
  {_ELLIPSIS.replace("(text,", "(lines,")} AS snippets, text FROM t),
h AS (SELECT *, greatest(0, least(100, 50 + {" + ".join(SIGNALS)})) AS heuristic FROM s)"""


_SIGNALS_SQL = _signals_sql("pages")


def html_scores(p):
    s = html_signals(p)
    return s.withColumn("heuristic", S.clamp(F.lit(50) + sum((F.col(c) for c in SIGNALS[1:]), F.col(SIGNALS[0]))))


@query(f"WITH {_SIGNALS_SQL} SELECT page_id, n_words, {', '.join(SIGNALS)}, heuristic FROM h")
def score_html_total(spark, sf_dir):
    return html_scores(pages(spark, sf_dir)).select("page_id", "n_words", *SIGNALS, "heuristic")


@query(f"WITH {_MARKED}, {_signals_sql('marked')} SELECT page_id, n_words, {', '.join(SIGNALS)}, heuristic FROM h")
def score_html_marked(spark, sf_dir):
    """The rubric over pages that have every signal."""
    return html_scores(marked_pages(spark, sf_dir)).select("page_id", "n_words", *SIGNALS, "heuristic")


_READ = rf"""r AS (SELECT *, CASE WHEN length(text) >= 100 THEN 206.835::DOUBLE - 1.015::DOUBLE * ({_N} / greatest(len({_SENTENCES.format(t='text')}), 1)) - 84.6::DOUBLE * (list_sum(list_transform({_WORDS.format(t='lower(text)')}, lambda x: greatest(1, len(regexp_extract_all(x, '{_VOWELS}'))))) / {_N}) END AS flesch,
  CASE WHEN length(text) >= 100 THEN n_words ELSE 0 END AS lexicon, string_split({SQL_HOST.format(u="'http://' || netloc")}, '.')[-2] AS label FROM h)"""
_HEADLINE = ("you won''t believe", "shocking", "what happened next", r"number \d+ will", "doctors hate", r"\d+ tricks", "this one weird")
_NLP = rf"""greatest(0, least(100, 50 + CASE WHEN len({_BODIES}) > 0 THEN 15 ELSE 0 END + CASE WHEN regexp_matches(html, '(?i)property=["'']og:') THEN 5 ELSE 0 END + CASE WHEN article THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(label, 'news|post|times|journal|tribune|herald|gazette|daily') THEN 10 ELSE 0 END - CASE WHEN regexp_matches(label, 'promo|deals|buy|shop|discount|cheap') THEN 15 ELSE 0 END
  - CASE WHEN upper(title) = title AND regexp_matches(title, '\p{{Lu}}') AND length(title) > 10 THEN 10 ELSE 0 END - 5 * ({" + ".join(f"regexp_matches(lower(title), '{x}')::INT" for x in _HEADLINE)}) - CASE WHEN length(title) - length(translate(title, '!?', '')) > 2 THEN 5 ELSE 0 END
  + CASE WHEN flesch BETWEEN 30 AND 80 THEN 10 WHEN flesch < 30 AND lexicon > 3000 THEN 5 WHEN flesch < 30 THEN -5 ELSE 0 END
  - CASE WHEN regexp_matches(lower(substr(text, 1, 500)), 'reuters|associated press|bloomberg|agence france-presse') THEN 10 ELSE 0 END
  + CASE WHEN lexicon > 5000 THEN 20 WHEN lexicon > 2000 THEN 15 WHEN lexicon > 1000 THEN 10 WHEN lexicon > 300 THEN 5 ELSE 0 END))"""


def nlp_scores(p):
    """The second rubric beside the first."""
    s = html_scores(p)
    html, title, text = F.col("html"), F.col("title"), F.col("text")
    label = F.substring_index(U.registrable_domain(F.col("url")), ".", 1)
    caps = (F.upper(title) == title) & title.rlike(r"\p{Lu}") & (F.length(title) > 10)
    long = F.length(text) >= 100
    flesch, lexicon = F.when(long, S.readability(text)["flesch"]), F.when(long, F.col("n_words")).otherwise(0)
    marks = F.length(title) - F.length(F.translate(title, "!?", ""))
    nlp = S.nlp_score(
        F.col("n_items") > 0, html.rlike(r"""(?i)property=["']og:"""), F.col("article"), S.any_of(label, S.NEWS_WORDS), S.any_of(label, S.SPAM_WORDS), caps, S.headline_hits(title), marks, flesch, T.wire_hits(text) > 0, lexicon,
    )
    return s.withColumn("nlp", nlp)


@query(f"WITH {_SIGNALS_SQL}, {_READ} SELECT page_id, {_NLP} AS nlp FROM r")
def score_nlp(spark, sf_dir):
    return nlp_scores(pages(spark, sf_dir)).select("page_id", "nlp")


@query(f"WITH {_MARKED}, {_signals_sql('marked')}, {_READ} SELECT page_id, {_NLP} AS nlp FROM r")
def score_nlp_marked(spark, sf_dir):
    """The second rubric over pages that have every signal."""
    return nlp_scores(marked_pages(spark, sf_dir)).select("page_id", "nlp")


_FINAL = f"WITH {_SIGNALS_SQL}, {_READ}, n AS (SELECT *, {_NLP} AS nlp FROM r), f AS (SELECT *, CAST(trunc(heuristic * 0.7::DOUBLE + nlp * 0.3::DOUBLE) AS INT) AS score FROM n)"
_CLASS = "CASE WHEN score >= 70 THEN 'legit' WHEN score >= 40 THEN 'maybe' ELSE 'skip' END"


def final_scores(spark, sf_dir):
    s = nlp_scores(pages(spark, sf_dir))
    s = s.withColumn("score", S.blend(F.col("heuristic"), F.col("nlp")))
    return s.withColumn("class", S.class_of(F.col("score"))).withColumn("status", F.when(F.col("score") >= 40, "success").otherwise("filtered"))


@query(f"{_FINAL} SELECT page_id, score, {_CLASS} AS class, CASE WHEN score >= 40 THEN 'success' ELSE 'filtered' END AS status FROM f")
def score_final_class(spark, sf_dir):
    return final_scores(spark, sf_dir).select("page_id", "score", "class", "status")


@query(f"{_FINAL} SELECT count(*) FILTER (WHERE score >= 40) AS successful, count(*) FILTER (WHERE score < 40) AS filtered, 0 AS errors, count(*) - count(DISTINCT norm) AS duplicates, round(avg(score), 6) AS mean_score FROM f")
def score_summary(spark, sf_dir):
    """Outcome totals of a batch."""
    f = final_scores(spark, sf_dir)
    return f.agg(
        F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "filtered").alias("filtered"), F.count_if(F.lit(False)).cast("int").alias("errors"),
        (F.count(F.lit(1)) - F.count_distinct("url")).alias("duplicates"), F.round(F.avg("score"), 6).alias("mean_score"),
    )


@query(
    f"""{_FINAL}, k AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY page_id) AS r FROM f)
    SELECT page_id, norm AS url, title, n_words, score, {_CLASS} AS class, rank() OVER (ORDER BY score DESC, norm, page_id) AS rank FROM k WHERE r = 1"""
)
def pages_ranked(spark, sf_dir):
    """Crawled pages worth reading: copies dropped, scored, ranked.

    Ranks come from stored ranges: no task has more than its own.
    """
    f = final_scores(spark, sf_dir)
    first = f.groupBy(F.md5("text").alias("hash")).agg(F.min(F.struct("page_id", "url", "title", "n_words", "score", "class")).alias("r")).select("r.*")
    from ..operators.ranking import global_rank

    return global_rank(first, [F.col("score").desc(), F.col("url"), F.col("page_id")])


@query(
    r"""WITH d AS (SELECT p_partkey AS pdf_id, p_name AS title, p_brand AS author, p_type AS subject, p_size * 100 AS n_words, p_size // 10 + 1 AS pages, p_size % 5 AS headings,
      CASE WHEN p_size % 3 = 0 THEN 'example.gov' WHEN p_size % 3 = 1 THEN 'nature.com' ELSE 'example.org' END AS domain FROM part)
    SELECT pdf_id, CASE WHEN length(title) >= 4 THEN 5 ELSE 0 END + CASE WHEN length(author) >= 3 THEN 5 ELSE 0 END + CASE WHEN length(subject) >= 1 THEN 3 ELSE 0 END AS metadata,
      CASE WHEN domain = 'example.gov' THEN 20 WHEN domain = 'nature.com' THEN 15 ELSE 8 END AS domain_points,
      CASE WHEN n_words >= 600 THEN 19 WHEN n_words >= 300 THEN 8 ELSE 0 END AS length_points, CASE WHEN headings >= 3 THEN 18 WHEN headings >= 1 THEN 9 ELSE 0 END AS structure,
      CASE WHEN n_words / pages BETWEEN 210 AND 490 THEN 10 WHEN (n_words / pages >= 190 AND n_words / pages < 210) OR (n_words / pages > 490 AND n_words / pages <= 510) THEN 6
        WHEN (n_words / pages >= 100 AND n_words / pages < 190) OR (n_words / pages > 510 AND n_words / pages <= 800) THEN 4 ELSE 0 END AS density,
      greatest(0, least(100, metadata + domain_points + length_points + structure + density)) AS score FROM d"""
)
def score_pdf_total(spark, sf_dir):
    """The rubric for PDF documents over documents made from parts."""
    size = F.col("p_size")
    domain = F.when(size % 3 == 0, "example.gov").when(size % 3 == 1, "nature.com").otherwise("example.org")
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pdf_id"), "p_name", "p_brand", "p_type", (size * 100).alias("n"), (F.floor(size / 10) + 1).alias("pages"), (size % 5).alias("headings"), domain.alias("domain"))
    d = d.select(
        "pdf_id", S.pdf_metadata_points(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(None).cast("string")).alias("metadata"), S.pdf_domain_points(F.col("domain")).alias("domain_points"),
        S.pdf_words_points(F.col("n")).alias("length_points"), S.pdf_structure_points(F.col("headings")).alias("structure"), S.pdf_density_points(F.col("n"), F.col("pages")).alias("density"),
    )
    return d.withColumn("score", S.clamp(F.expr("metadata + domain_points + length_points + structure + density")))


@query(
    """WITH d AS (SELECT p_partkey AS pdf_id, p_size * p_size * 7 AS n_words, CASE p_size % 4 WHEN 0 THEN 'example.gov' WHEN 1 THEN 'www.NATURE.com' WHEN 2 THEN 'example.org' ELSE 'example.net' END AS domain FROM part)
    SELECT pdf_id, CASE WHEN ends_with(domain, '.gov') THEN 15 WHEN contains(lower(domain), 'nature.com') THEN 10 WHEN ends_with(domain, '.org') THEN 5 ELSE 0 END AS domain_points,
    CASE WHEN n_words BETWEEN 600 AND 10000 THEN 12 WHEN n_words >= 300 AND n_words < 600 THEN 8 WHEN n_words > 10000 THEN 4 WHEN n_words < 100 THEN -10 ELSE 2 END AS length_points FROM d"""
)
def score_pdf_legacy(spark, sf_dir):
    """The older rubric's points for domains and lengths."""
    size = F.col("p_size")
    domain = F.when(size % 4 == 0, "example.gov").when(size % 4 == 1, "www.NATURE.com").when(size % 4 == 2, "example.org").otherwise("example.net")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pdf_id"), S.pdf_domain_points_v1(domain).alias("domain_points"), S.pdf_length_points_v1(size * size * 7).alias("length_points"))
