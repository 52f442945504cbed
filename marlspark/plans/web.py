"""URLs, queries and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import domains, fuzzy, similarity
from ..registry import query
from ..sources.shared import bounded
from ..sources.tables import pages, table

#: DuckDB macros' bodies, written apart from the functions above.
SQL_HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
SQL_PAGES = r"""
p0 AS (
  SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS netloc,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT list_contains(
      ['utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','msclkid','mc_cid','mc_eid','_ga','ref','source'], lower(string_split(q, '=')[1])))) AS params
  FROM pages
), p AS (
  SELECT page_id, url, html, path, netloc, scheme || '://' || netloc || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS norm
  FROM p0
)"""


@query(f"WITH {SQL_PAGES} SELECT page_id, norm AS url_normalized FROM p")
def url_normalized(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.normalize_url(F.col("url")).alias("url_normalized"))


@query(f"SELECT page_id, array_to_string(string_split({SQL_HOST.format(u='url')}, '.')[-2:], '.') AS domain FROM pages")
def url_domains(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.registrable_domain(F.col("url")).alias("domain"))


_RULES = ", ".join(f"('{r}')" for r in (*U.TWO_LABEL_SUFFIXES, *domains.WILDCARDS))


@query(
    f"""WITH r(rule) AS (SELECT DISTINCT rule FROM (VALUES {_RULES}) v(rule)), p AS (SELECT page_id, {SQL_HOST.format(u='url')} AS h FROM pages),
    q AS (SELECT page_id, CASE page_id % 8 WHEN 1 THEN h || '.co.uk' WHEN 2 THEN h || '.x.ck' WHEN 3 THEN 'a.www.ck' WHEN 4 THEN h || '.b.kawasaki.jp' WHEN 5 THEN 'c.city.kawasaki.jp' WHEN 6 THEN 'd.kawasaki.jp' WHEN 7 THEN '10.0.0.' || page_id % 200 ELSE h END AS host FROM p),
    l AS (SELECT page_id, host, string_split(host, '.') AS l FROM q), i AS (SELECT page_id, host, l, unnest(range(1, len(l) + 1)) AS i FROM l),
    k AS (SELECT page_id, host, l, len(l) - i + 1 AS long, array_to_string(l[i:], '.') AS own, CASE WHEN i < len(l) THEN '*.' || array_to_string(l[i+1:], '.') END AS wild FROM i),
    m AS (SELECT page_id, max(long) FILTER (WHERE own IN (SELECT rule FROM r) OR wild IN (SELECT rule FROM r)) AS size, max(long) FILTER (WHERE '!' || own IN (SELECT rule FROM r)) - 1 AS but FROM k GROUP BY page_id),
    s AS (SELECT l.page_id, host, l, coalesce(but, size, 1) AS size, regexp_matches(host, '^[0-9.]+$') AS number FROM l JOIN m ON m.page_id = l.page_id)
    SELECT page_id, host, CASE WHEN NOT number THEN array_to_string(l[greatest(len(l) - size + 1, 1):], '.') END AS public_suffix, CASE WHEN number THEN host ELSE array_to_string(l[greatest(len(l) - size, 1):], '.') END AS domain FROM s"""
)
def host_domains(spark, sf_dir):
    """Registrable domains of pages' hosts, under suffixes of every kind of rule."""
    h, i = U.host(F.col("url")), F.col("page_id")
    under = lambda x: F.concat(h, F.lit(x))
    host = F.when(i % 8 == 1, under(".co.uk")).when(i % 8 == 2, under(".x.ck")).when(i % 8 == 3, "a.www.ck").when(i % 8 == 4, under(".b.kawasaki.jp")).when(i % 8 == 5, "c.city.kawasaki.jp").when(i % 8 == 6, "d.kawasaki.jp")
    p = pages(spark, sf_dir).select("page_id", host.when(i % 8 == 7, F.concat(F.lit("10.0.0."), i % 200)).otherwise(h).alias("host"))
    return p.join(domains.registrable(p, domains.rules(spark)), "host").select("page_id", "host", "public_suffix", "domain")


@query("SELECT page_id, CASE WHEN ends_with(lower(url), '.pdf') OR string_split(lower(url), '/')[-1] = 'pdf' THEN 'pdf' ELSE 'html' END AS lane FROM pages")
def url_lane(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.url_lane(F.col("url")).alias("lane"))


@query(f"WITH {SQL_PAGES} SELECT norm AS url, min(page_id) AS page_id FROM p GROUP BY norm")
def url_dedup_first(spark, sf_dir):
    """The first page of each canonical URL."""
    return pages(spark, sf_dir).groupBy(U.normalize_url(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"))


_QUERY_SQL = r"trim(regexp_replace(lower(trim(text, E' \n\t')), '\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {_QUERY_SQL} AS query_normalized FROM conversations WHERE role = 'user'")
def query_normalized(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", T.normalize_query(F.col("text")).alias("query_normalized"))


@query(
    rf"""SELECT conv_id, turn, length(text) AS original_length, length({_QUERY_SQL}) AS normalized_length, text <> {_QUERY_SQL} AS changed,
    regexp_matches(text, '[‘’“”]') AS smart_quotes, regexp_matches(text, '[–—]') AS dashes, regexp_matches(text, '\s\s') AS double_spaces
    FROM conversations WHERE role = 'user'"""
)
def query_variants(spark, sf_dir):
    """What normalisation changes."""
    c, t = table(spark, sf_dir, "conversations").filter("role = 'user'"), F.col("text")
    n = T.normalize_query(t)
    return c.select("conv_id", "turn", n.alias("n"), "text").select(
        "conv_id", "turn", F.length(t).alias("original_length"), F.length("n").alias("normalized_length"), (t != F.col("n")).alias("changed"),
        t.rlike("[‘’“”]").alias("smart_quotes"), t.rlike("[–—]").alias("dashes"), t.rlike(r"(?U)\s\s").alias("double_spaces"),
    )


def sql_alike(threshold: int) -> str:
    """CTEs to `alike`: query, match, ratio of distinct strings of asked (query) and cached (query) at or above the threshold.

    The longest common subsequence comes from one word of bits for each 120 characters of the cached
    string (four at most), a step for each character of the asked one; counts of letters rule most pairs out before.
    """
    letters = "string_split('abcdefghijklmnopqrstuvwxyz ', '')"
    words = range(4)
    ones = f"((1::HUGEINT << {120}) - 1)"
    masks = ", ".join(f"coalesce(bit_or(1::HUGEINT << ((k - 1) % 120)) FILTER ((k - 1) // 120 = {w}), 0) AS m{w}" for w in words)
    start = ", ".join(f"{ones} AS v{w}" for w in words)
    sums = "SELECT *, v0 + (v0 & c0) AS s0 FROM u"
    for w in words[1:]:
        sums = f"SELECT *, v{w} + (v{w} & c{w}) + (s{w - 1} >> 120) AS s{w} FROM ({sums})"
    after = ", ".join(f"(s{w} & {ones}) | (v{w} - (v{w} & c{w})) AS v{w}" for w in words)
    step = f"SELECT query, match, n, m, i + 1 AS i, v0, v1, v2, v3, {', '.join(f'coalesce(m{w}, 0) AS c{w}' for w in words)} FROM steps LEFT JOIN mask ON mask.of = match AND mask.c = substr(query, i + 1, 1) WHERE i < n"
    zeros = " + ".join(f"bit_count(v{w} & ((1::HUGEINT << greatest(least(m - {120 * w}, 120), 0)) - 1))::INT" for w in words)
    return f"""qa AS (SELECT DISTINCT query, length(query) AS n, list_transform({letters}, lambda c: length(query) - length(replace(query, c, ''))) AS bag FROM asked WHERE query IS NOT NULL),
    qb AS (SELECT DISTINCT query AS match, length(query) AS m, list_transform({letters}, lambda c: length(query) - length(replace(query, c, ''))) AS other FROM cached WHERE query IS NOT NULL),
    mask AS MATERIALIZED (SELECT match AS of, c, {masks} FROM (SELECT match, unnest(string_split(match, '')) AS c, generate_subscripts(string_split(match, ''), 1) AS k FROM qb) GROUP BY ALL),
    fit AS (SELECT query, match, n, m FROM qa JOIN qb ON 200 * least(n, m) >= {threshold} * (n + m) WHERE list_sum(list_transform(list_zip(bag, other), lambda z: abs(z[1] - z[2]))) <= (n + m) - {threshold / 100} * (n + m) + 1e-6),
    steps AS (SELECT query, match, n, m, 0 AS i, {start} FROM fit UNION ALL SELECT query, match, n, m, i, {after} FROM ({sums.replace('FROM u', f'FROM ({step})')})),
    alike AS (SELECT * FROM (SELECT query, match, CASE WHEN n + m = 0 THEN 100.0 ELSE 200.0::DOUBLE * (m - ({zeros})) / (n + m) END AS ratio FROM steps WHERE i = n) WHERE ratio >= {threshold})"""


#: A typo for each first turn: another word, a word fewer, a letter that never comes, words more.
_TYPO = r"""CASE conv_id % 4 WHEN 0 THEN regexp_replace(query, '^\S+', 'find') WHEN 1 THEN regexp_replace(query, '\s\S+$', '') WHEN 2 THEN replace(query, 'e', '') ELSE query || ' please tell me' END"""


@query(
    f"""WITH RECURSIVE c AS (SELECT conv_id, turn, {_QUERY_SQL} AS query FROM conversations WHERE role = 'user'),
    asked AS (SELECT conv_id || '/' || turn AS id, CASE WHEN turn = 0 THEN {_TYPO} ELSE query END AS query FROM c), cached AS (SELECT conv_id::VARCHAR AS id, query FROM c WHERE turn = 0),
    {sql_alike(85)}, owner AS (SELECT query AS match, min(id) AS match_id FROM cached GROUP BY 1),
    best AS (SELECT query, match_id, ratio, row_number() OVER (PARTITION BY query ORDER BY ratio DESC, match_id) AS r FROM alike JOIN owner USING (match))
    SELECT id, match_id, floor(ratio)::INT AS score, 1 AS rank FROM asked JOIN best USING (query) WHERE r = 1"""
)
def query_fuzzy_best(spark, sf_dir):
    """The most similar first turn of every user turn, by the similarity of insertions and deletions; first turns are asked with a typo."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.normalize_query(F.col("text")).alias("query"))
    q, kind = F.col("query"), F.col("conv_id") % 4
    typo = F.when(kind == 0, F.regexp_replace(q, r"^\S+", "find")).when(kind == 1, F.regexp_replace(q, r"\s\S+$", "")).when(kind == 2, F.replace(q, F.lit("e"), F.lit(""))).otherwise(F.concat(q, F.lit(" please tell me")))
    asked = c.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.when(F.col("turn") == 0, typo).otherwise(q).alias("query"))
    cached = c.filter("turn = 0").select(F.col("conv_id").cast("string").alias("id"), "query")
    return fuzzy.best_matches(asked, cached)


@query(
    f"""WITH RECURSIVE c AS (SELECT conv_id, turn, {_QUERY_SQL} AS query FROM conversations WHERE role = 'user'),
    asked AS (SELECT conv_id::VARCHAR AS id, regexp_replace(query, '\\s\\S+$', '') AS query FROM c WHERE turn = 0), cached AS (SELECT conv_id || '/' || turn || '/' || k AS id, CASE k WHEN 0 THEN query WHEN 1 THEN 'who knows ' || query ELSE replace(query, 'n', 'm') END AS query FROM c, range(3) r(k)),
    {sql_alike(80)}, r AS (SELECT a.id, k.id AS match_id, floor(ratio)::INT AS score, row_number() OVER (PARTITION BY a.id ORDER BY ratio DESC, k.id) AS rank FROM asked a JOIN alike USING (query) JOIN cached k ON k.query = alike.match)
    SELECT id, match_id, score, rank FROM r WHERE rank <= 3"""
)
def query_fuzzy_top(spark, sf_dir):
    """The three most similar of all turns, two of them worded otherwise, for first turns that are a word shorter."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.normalize_query(F.col("text")).alias("query"))
    q, k = F.col("query"), F.col("k")
    asked = c.filter("turn = 0").select(F.col("conv_id").cast("string").alias("id"), F.regexp_replace(q, r"\s\S+$", "").alias("query"))
    cached = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(F.concat_ws("/", "conv_id", "turn", "k").alias("id"), F.when(k == 0, q).when(k == 1, F.concat(F.lit("who knows "), q)).otherwise(F.replace(q, F.lit("n"), F.lit("m"))).alias("query"))
    return fuzzy.best_matches(asked, cached, 80, 3)


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), E' \n\t') AS text_normalized FROM documents")
def text_normalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text_normalized"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(list_filter(string_split(regexp_replace(text, '(?i)\[(edit|citation needed|source)\]', '', 'g'), E'\n'),
    lambda x: trim(x) <> '-'), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), E'\n'), '\n{3,}', E'\n\n', 'g')) AS text_cleaned FROM documents"""
)
def text_cleaned(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_extracted_text(F.col("text")).alias("text_cleaned"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS i FROM documents),
    b AS (SELECT doc_id, i, trim(line) AS s, trim(line) = '' AS empty, regexp_matches(trim(line), '[.!?;:]$') AS ends FROM l),
    g AS (SELECT *, coalesce(sum(CASE WHEN ends OR empty THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM b),
    j AS (SELECT doc_id, grp, string_agg(s, ' ' ORDER BY i) AS para FROM g WHERE NOT empty GROUP BY doc_id, grp)
    SELECT d.doc_id, coalesce(string_agg(para, E'\n' ORDER BY grp), '') AS joined FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id"""
)
def text_lines_joined(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.join_broken_lines(F.col("text")).alias("joined"))


@query(
    r"""SELECT doc_id, CASE WHEN length(text) <= 10000 THEN text ELSE E'[START]\n' || substr(text, 1, 5000) || E'\n[MIDDLE]\n' || substr(text, length(text) // 2 - 1500 + 1, 3000)
    || E'\n[END]\n' || substr(text, length(text) - 1999, 2000) END AS sampled FROM documents"""
)
def text_sampled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sample_text(F.col("text")).alias("sampled"))


_WORDS = r"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"
_SENTENCES = r"list_filter(string_split_regex({t}, '[.!?]+'), lambda s: trim(s) <> '')"


@query(f"SELECT doc_id, len({_WORDS.format(t='text')}) AS n_words, length(text) AS n_chars, len({_SENTENCES.format(t='text')}) AS n_sentences FROM documents")
def word_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(t).alias("n_words"), F.length(t).alias("n_chars"), F.size(T.sentences(t)).alias("n_sentences"))


@query(
    r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'),
    '(?s)<!--.*?-->', '', 'g'), '(?is)<div[^>]*class=["''][^"'']*\b(?:ad|advertisement|advert|sponsored)\b[^"'']*["''][^>]*>.*?</div>', '', 'g'), '\s+', ' ', 'g'))) AS content_hash FROM pages"""
)
def page_content_hash(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.html_content_hash(F.col("html")).alias("content_hash"))


@query("SELECT doc_id, substr(md5(coalesce(source, '') || substr(text, 1, 1000)), 1, 16) AS short_hash FROM documents")
def doc_short_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", U.short_hash(F.concat(F.coalesce("source", F.lit("")), F.substring("text", 1, 1000))).alias("short_hash"))


@query(
    """SELECT doc_id, substr(text, 1, 10) || '<highlight>' || substr(text, 11, 30) || '</highlight>' || substr(text, 41) AS marked,
    replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10), '<br>') AS escaped FROM documents"""
)
def highlighted(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.highlight(F.col("text"), F.lit(10), F.lit(40)).alias("marked"), T.escape_html(F.col("text")).alias("escaped"))


@query(
    f"""WITH w AS (SELECT doc_id, md5(lower(text)) AS content_md5, {_WORDS.format(t='lower(text)')} AS w FROM documents)
    SELECT doc_id, content_md5, len(w) AS n_words, CASE WHEN len(w) < 5 THEN 0 ELSE
    len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS n_shingles FROM w"""
)
def doc_fingerprint(spark, sf_dir):
    """MD5, words, distinct shingles; the sketch of the ten smallest shingle hashes is in similarity.fingerprint."""
    return similarity.fingerprint(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "content_md5", "n_words", "n_shingles")


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS.format(t='lower(text)')} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    b AS (SELECT item_id, {_WORDS.format(t='lower(text)')} AS w FROM benchmark),
    bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM b)
    SELECT item_id, bs.g IS NOT NULL AS has, s.doc_id, count(*) AS shared FROM bs JOIN s ON s.g = bs.g GROUP BY ALL"""
)
def shingle_overlap(spark, sf_dir):
    """Shingles that each benchmark passage shares with each document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return similarity.shingle_overlap(items, "item_id", docs, "doc_id").withColumn("has", F.lit(True)).select("item_id", "has", "doc_id", "shared")


_TITLE = "string_split(text, chr(10))[1]"


@query(
    rf"""SELECT doc_id, length({_TITLE}) AS n_chars, len({_WORDS.format(t=_TITLE)}) AS n_words, upper({_TITLE}) = {_TITLE} AND regexp_matches({_TITLE}, '\p{{Lu}}') AS all_caps,
    length({_TITLE}) - length(translate({_TITLE}, '!?', '')) AS marks, CASE WHEN regexp_matches(lower({_TITLE}), 'top \d+|\d+ things|\d+ ways|\d+ reasons|roundup|best of \d{{4}}|what you need to know') OR length({_TITLE}) - length(translate({_TITLE}, '•|', '')) > 2 THEN -5 ELSE 0 END AS roundup,
    CASE WHEN regexp_matches(lower({_TITLE}), 'you won''t believe|shocking|what happened next|this is why|number \d+ will shock you|doctors hate') THEN -3 ELSE 0 END AS clickbait FROM documents"""
)
def title_quality(spark, sf_dir):
    t = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select(
        "doc_id", F.length("t").alias("n_chars"), T.word_count(F.col("t")).alias("n_words"), ((F.upper("t") == F.col("t")) & F.col("t").rlike(r"\p{Lu}")).alias("all_caps"),
        (F.length("t") - F.length(F.translate("t", "!?", ""))).alias("marks"), S.roundup_points(F.col("t")).alias("roundup"), S.clickbait_points(F.col("t")).alias("clickbait"),
    )


@query(
    """WITH h AS (SELECT doc_id, lower(substr(text, 1, 500)) AS h FROM documents)
    SELECT doc_id, contains(h, 'reuters')::INT + contains(h, 'associated press')::INT + contains(h, 'bloomberg')::INT + contains(h, 'agence france-presse')::INT AS hits,
    (contains(h, 'reuters')::INT + contains(h, 'associated press')::INT + contains(h, 'bloomberg')::INT + contains(h, 'agence france-presse')::INT) / 4 AS confidence FROM h"""
)
def wire_detection(spark, sf_dir):
    hits = T.wire_hits(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits"), (hits / 4).alias("confidence"))


_VOWELS = "[aeiouyàâäéèêëíìîïóòôöúùûüá]+"


@query(
    rf"""WITH w AS (SELECT doc_id, {_WORDS.format(t='lower(text)')} AS w, greatest(len({_SENTENCES.format(t='text')}), 1) AS s, length(regexp_replace(text, '\s', '', 'g')) AS c FROM documents WHERE length(text) >= 100),
    y AS (SELECT doc_id, len(w) AS n, s, c, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '{_VOWELS}'))))) AS y, len(list_filter(w, lambda x: len(regexp_extract_all(x, '{_VOWELS}')) >= 3)) AS d FROM w),
    f AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * (n / s) - 84.6::DOUBLE * (y / n) AS flesch FROM y)
    SELECT doc_id, y::BIGINT AS syllables, d::BIGINT AS difficult, round(flesch, 6) AS flesch, round(0.39::DOUBLE * (n / s) + 11.8::DOUBLE * (y / n) - 15.59::DOUBLE, 6) AS grade, round(4.71::DOUBLE * (c / n) + 0.5::DOUBLE * (n / s) - 21.43::DOUBLE, 6) AS ari,
    round(0.4::DOUBLE * ((n / s) + 100::DOUBLE * (d / n)), 6) AS fog, CASE WHEN flesch >= 90 THEN 'very_easy' WHEN flesch >= 80 THEN 'easy' WHEN flesch >= 70 THEN 'fairly_easy' WHEN flesch >= 60 THEN 'standard' WHEN flesch >= 50 THEN 'fairly_difficult' WHEN flesch >= 30 THEN 'difficult' ELSE 'very_difficult' END AS band, flesch BETWEEN 30 AND 80 AS readable FROM f"""
)
def readability(spark, sf_dir):
    r = S.readability(F.col("text"))
    d = table(spark, sf_dir, "documents").filter("length(text) >= 100").select("doc_id", *[c.alias(n) for n, c in r.items()])
    return d.select(
        "doc_id", F.col("syllables").cast("bigint").alias("syllables"), F.col("difficult").cast("bigint").alias("difficult"), *[F.round(n, 6).alias(n) for n in ("flesch", "grade", "ari", "fog")],
        S.flesch_band(F.col("flesch")).alias("band"), F.col("flesch").between(30, 80).alias("readable"),
    )


@query()
def tfidf_similarity(spark, sf_dir):
    """TF-IDF cosine of each document with the next one."""
    bounded(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = d.alias("a").join(d.alias("b"), F.expr("b.doc_id = a.doc_id + 1")).select(F.col("a.doc_id").alias("doc_id"), F.col("a.text").alias("left"), F.col("b.text").alias("right"))
    return pairs.select("doc_id", F.round(similarity.tfidf_cosine(F.col("left"), F.col("right")), 6).alias("similarity"))


@query(
    r"""WITH x AS (SELECT event_id, 'On ' || strftime(ts, '%Y-%m-%d') || CASE WHEN event_type = 'view' THEN ' it was updated.' ELSE ' it was read.' END AS t FROM events),
    m AS (SELECT event_id, unnest(regexp_extract_all(t, '\d{4}-\d{2}-\d{2}')) AS d, contains(t, 'updated') AS up FROM x)
    SELECT event_id, min(CASE WHEN NOT up THEN CAST(d AS TIMESTAMP) END) AS published, max(CASE WHEN up THEN CAST(d AS TIMESTAMP) END) AS updated FROM m GROUP BY event_id"""
)
def byline_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.concat(F.lit("On "), F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("event_type") == "view", " it was updated.").otherwise(" it was read."))
    published, updated = D.byline_dates(t)
    return e.select("event_id", F.array_min(published).alias("published"), F.array_max(updated).alias("updated"))


@query(r"SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day FROM orders")
def pdf_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", D.pdf_date(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("Z"))).alias("d")).select("o_orderkey", "d.*")


@query(f"WITH {SQL_PAGES}, r AS (SELECT norm, page_id, row_number() OVER (PARTITION BY netloc ORDER BY page_id) AS position, netloc FROM p) SELECT netloc AS host, page_id, norm AS url, position FROM r WHERE position <= 3")
def host_first_pages(spark, sf_dir):
    """The first three pages of each host, by a ranked window."""
    p = pages(spark, sf_dir).select("page_id", U.normalize_url(F.col("url")).alias("url"), F.lower(U.authority(F.col("url"))).alias("host"))
    w = Window.partitionBy("host").orderBy("page_id")
    return p.withColumn("position", F.row_number().over(w)).filter("position <= 3").select("host", "page_id", "url", "position")
