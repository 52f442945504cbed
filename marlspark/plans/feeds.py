"""Dates of pages from sitemaps and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import feeds
from ..sources.shared import fresh_path
from ..sources.tables import pages


def _documents(rows, name: str, entry, head: str, foot: str):
    """XML documents of two hundred pages' entries, a file each."""
    whole = rows.select((F.floor(F.col("page_id") / 200)).alias("doc"), entry.alias("x")).groupBy("doc").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("x")), "\n"), F.lit(foot)).alias("value"))
    path = fresh_path(rows.sparkSession, name)
    whole.write.partitionBy("doc").text(path)
    return path


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query(
    """WITH e AS (SELECT url, TIMESTAMP '2024-01-01' + INTERVAL (page_id * 37) MINUTE AS t, page_id % 4 AS kind, page_id FROM pages),
    d AS (SELECT rtrim(url, '/') AS k, max(CASE WHEN kind = 3 AND page_id % 8 = 3 THEN date_trunc('day', t) ELSE date_trunc('second', t) END) AS modified_at FROM e GROUP BY 1)
    SELECT page_id, url, modified_at FROM pages LEFT JOIN d ON rtrim(url, '/') = k"""
)
def feed_dates(spark, sf_dir):
    """Pages with what a sitemap, an RSS or an Atom feed says of their last change; some feeds give addresses a slash more."""
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("page_id") * F.lit(37 * 60 * 1000000))
    p = pages(spark, sf_dir).select("page_id", "url", at.alias("t"))
    kind, link = F.col("page_id") % 4, _escaped(F.concat("url", F.when((F.col("page_id") % 3 == 0) & ~F.col("url").contains("?"), "/").otherwise("")))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    rss = _documents(p.filter(kind == 0), "rss", text("<item><title>A &amp; b</title><link>", link, "</link><pubDate>", F.date_format("t", "EEE, d MMM yyyy HH:mm:ss"), " GMT</pubDate></item>"), '<rss version="2.0"><channel><title>news</title>\n', "\n</channel></rss>")
    early = F.col("t") - F.expr("INTERVAL 5 DAYS")
    both = F.when(kind == 1, text("<published>", iso(early), "</published><updated>", iso(F.col("t")), "</updated>")).otherwise(text("<published>", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), "+00:00</published>"))
    other = '<link rel="enclosure" href="https://elsewhere.example/a.mp3"/>'
    atom = _documents(p.filter(kind.isin(1, 2)), "atom", text("<entry>", other, '<link href="', link, '"/>', both, "</entry>"), '<feed xmlns="http://www.w3.org/2005/Atom">\n', "\n</feed>")
    last = F.when(F.col("page_id") % 8 == 3, F.date_format("t", "yyyy-MM-dd")).otherwise(iso(F.col("t")))
    sitemap = _documents(p.filter(kind == 3), "sitemap", text("<s:url><s:loc>", link, "</s:loc><s:lastmod>", last, "</s:lastmod></s:url>"), '<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9">\n', "\n</s:urlset>")
    entries = feeds.rss_entries(spark, rss).unionByName(feeds.atom_entries(spark, atom)).unionByName(feeds.sitemap_entries(spark, sitemap))
    return feeds.page_dates(p.select("page_id", "url"), entries)
