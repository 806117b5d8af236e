"""Queries over captured pages: selection and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.text import strip
from pageloom.functions.urls import absolutise, favicon_url, netloc
from pageloom.model import CSS, REGEX, UNIQUE_TEXT, WORDLIST, XPATH, ContentSelector, FieldSelector
from pageloom.operators import links as L
from pageloom.operators import select as S
from pageloom.operators.frontier import expand
from pageloom.operators.shred import elements, shred
from pageloom.plans.session import materialise
from pageloom.sources.pages import page_by_url, read_pages, url_list
from pageloom.workload.registry import (
    captured,
    customer_pages,
    order_pages,
    page_dom,
    query,
    sql_absolute,
    sql_strip,
    sql_unescape,
    table,
    turn_pages,
)

NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"
HREFS = f"regexp_extract_all({NAV}, '<a href=\"([^\"]*)\">', 1)"
ALL_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)"
HOST = "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"


@query("page_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def page_scan(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.char_length("html").cast("long").alias("n_chars"))


@query(
    "listed_urls_with_pages",
    "WITH listed AS (SELECT url FROM pages UNION ALL SELECT url || '&again=1' FROM pages) "
    "SELECT l.url, p.page_id, p.page_id IS NOT NULL AS captured FROM listed l LEFT JOIN pages p ON l.url = p.url",
)
def listed_urls_with_pages(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url")
    listed = pages.select(F.explode(F.array("url", F.concat("url", F.lit("&again=1")))).alias("url"))
    return url_list(listed, pages).select("url", "page_id", F.col("page_id").isNotNull().alias("captured"))


@query("page_at_url", "SELECT page_id, url, length(html) AS n_chars FROM pages WHERE url = (SELECT min(url) FROM pages)")
def page_at_url(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet")
    url = pages.agg(F.min("url")).first()[0]
    return page_by_url(pages, url).select("page_id", "url", F.char_length("html").cast("long").alias("n_chars"))


@query(
    "element_tag_counts",
    "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag",
)
def element_tag_counts(spark, sf):
    return elements(page_dom(spark, sf), ["tag"]).groupBy("tag").agg(F.count("*").alias("n"))


@query(
    "css_tag_and_class",
    f"SELECT page_id, {sql_unescape('''unnest(regexp_extract_all(html, '<div class=\"ad\">([^<]+)', 1))''')} AS value FROM pages",
)
def css_tag_and_class(spark, sf):
    return S.values(page_dom(spark, sf), "div.ad::text").select("page_id", "value")


@query(
    "css_descendant_and_child",
    f"SELECT page_id, {sql_unescape('t')} AS value FROM (SELECT page_id, "
    "unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]+)', 1)) AS t FROM pages)",
)
def css_descendant_and_child(spark, sf):
    return S.values(page_dom(spark, sf), "nav ul > li > a::text").select("page_id", "value")


@query(
    "css_nth_child",
    f"SELECT page_id, {sql_unescape('h')} AS value FROM (SELECT page_id, {HREFS}[3] AS h FROM pages) WHERE h IS NOT NULL",
)
def css_nth_child(spark, sf):
    return S.values(page_dom(spark, sf), "nav li:nth-child(3) a::attr(href)").select("page_id", "value")


@query(
    "xpath_ordinal",
    f"SELECT page_id, {sql_unescape('h')} AS value FROM (SELECT page_id, {HREFS}[2] AS h FROM pages) WHERE h IS NOT NULL",
)
def xpath_ordinal(spark, sf):
    return S.values(page_dom(spark, sf), FieldSelector("//nav//li[2]/a/@href", XPATH)).select("page_id", "value")


@query(
    "css_nth_of_type",
    f"SELECT page_id, {sql_unescape('''regexp_extract(html, '<div class=\"ad\">([^<]+)', 1)''')} AS value FROM pages",
)
def css_nth_of_type(spark, sf):
    return S.values(page_dom(spark, sf), "body > div:nth-of-type(1)::text").select("page_id", "value")


@query(
    "selector_union",
    f"SELECT page_id, {sql_unescape('t')} AS value FROM ("
    "SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS t FROM pages UNION ALL "
    "SELECT page_id, regexp_extract(html, '<h1>([^<]*)', 1) FROM pages) WHERE t <> ''",
)
def selector_union(spark, sf):
    return S.values(page_dom(spark, sf), "title::text, h1::text").select("page_id", "value")


@query(
    "attribute_predicates",
    f"SELECT page_id, href AS value FROM (SELECT page_id, {sql_unescape(f'unnest({HREFS})')} AS href FROM pages) "
    "WHERE starts_with(href, '/th') OR contains(href, 'en') OR href = '/de'",
)
def attribute_predicates(spark, sf):
    selector = "//a[starts-with(@href,'/th')]/@href | //a[contains(@href,'en')]/@href | //nav//a[@href='/de']/@href"
    return S.values(page_dom(spark, sf), FieldSelector(selector, XPATH)).select("page_id", "value")


@query(
    "count_predicate",
    f"SELECT page_id, {sql_unescape('h')} AS value FROM (SELECT page_id, unnest({HREFS}) AS h FROM pages WHERE len({HREFS}) > 5)",
)
def count_predicate(spark, sf):
    return S.values(page_dom(spark, sf), FieldSelector("//nav[count(.//li) > 5]//a/@href", XPATH)).select("page_id", "value")


@query(
    "subtree_texts",
    f"SELECT page_id, count(*) AS n_texts, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM (SELECT page_id, {sql_unescape('t')} AS t FROM "
    "(SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '>?([^<>]+)', 1)) AS t FROM pages) "
    "WHERE NOT regexp_matches(t, '^/?(h1|p|b|br)$')) GROUP BY page_id",
)
def subtree_texts(spark, sf):
    rows = S.values(page_dom(spark, sf), FieldSelector("//article//text()", XPATH))
    return rows.groupBy("page_id").agg(
        F.count("*").alias("n_texts"), F.sum(F.char_length("value")).cast("long").alias("n_chars")
    )


@query("attribute_values", "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS value FROM pages WHERE html LIKE '%<html lang=%'")
def attribute_values(spark, sf):
    return S.values(page_dom(spark, sf), "html::attr(lang)").select("page_id", "value")


@query(
    "attribute_shorthand",
    f"SELECT page_id, {sql_unescape('h')} AS value FROM (SELECT page_id, unnest({HREFS}) AS h FROM pages)",
)
def attribute_shorthand(spark, sf):
    return S.values(page_dom(spark, sf), "nav a::href").select("page_id", "value")


@query(
    "region_restriction",
    f"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all('<nav>' || {NAV}, '<([a-z]+)', 1)) AS tag FROM pages) GROUP BY page_id, tag",
)
def region_restriction(spark, sf):
    return S.restrict(page_dom(spark, sf), "nav").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "first_own_text",
    f"SELECT page_id, {sql_strip(sql_unescape('''regexp_extract(html, '<footer>([^<]*)', 1)'''))} AS text FROM pages",
)
def first_own_text(spark, sf):
    return S.own_text(page_dom(spark, sf), "footer").select("page_id", "text")


@query(
    "element_full_text",
    f"SELECT page_id, {sql_strip(sql_unescape('t'))} AS text FROM (SELECT page_id, "
    "unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)', 1)) AS t FROM pages)",
)
def element_full_text(spark, sf):
    return S.full_text(page_dom(spark, sf), "nav li").select("page_id", "text")


OWN_TEXTS = (
    "SELECT page_id, list_transform(list_filter("
    "regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<(?:h1|p|b)>([^<]+)', 1), "
    "lambda x: x <> ''), lambda x: {unescaped}) AS own FROM pages"
).format(unescaped=sql_unescape("x"))


@query(
    "content_by_regex",
    f"SELECT page_id, coalesce(list_filter(own, lambda x: regexp_matches(x, '(?i)^(?:th[a-z]+ |d[ei]e? )'))[1], '') AS value FROM ({OWN_TEXTS})",
)
def content_by_regex(spark, sf):
    spec = ContentSelector(FieldSelector("th[a-z]+ |d[ei]e? ", REGEX), FieldSelector("article", CSS))
    return S.content_search(page_dom(spark, sf), spec).select("page_id", "value")


@query(
    "content_by_words",
    f"SELECT page_id, coalesce(list_filter(own, lambda x: regexp_matches(x, '(?i)^(?:de|en|the|le)'))[1], '') AS value FROM ({OWN_TEXTS})",
)
def content_by_words(spark, sf):
    spec = ContentSelector(FieldSelector("de, en, the, le", WORDLIST), FieldSelector("article", CSS))
    return S.content_search(page_dom(spark, sf), spec).select("page_id", "value")


@query("documents_by_words", "SELECT doc_id, text FROM documents WHERE regexp_matches(text, '(?i)^(?:the|de|en|[(]c[)])')")
def documents_by_words(spark, sf):
    return S.texts_starting_with(table(spark, sf, "documents").select("doc_id", "text"), "text", "the, de, en, (c)")


@query(
    "nav_links_per_host",
    f"SELECT {HOST} AS host, {sql_absolute('href', 'url')} AS link, count(*) AS n FROM "
    f"(SELECT url, {sql_unescape(f'unnest({ALL_HREFS})')} AS href FROM pages) GROUP BY 1, 2",
)
def nav_links_per_host(spark, sf):
    found = L.links(page_dom(spark, sf), "a")
    return found.groupBy(netloc(F.col("url")).alias("host"), "link").agg(F.count("*").alias("n"))


@query(
    "links_by_selector",
    f"SELECT page_id, {sql_absolute('href', 'url')} AS link FROM (SELECT page_id, url, {sql_unescape(f'unnest({HREFS})')} AS href FROM pages)",
)
def links_by_selector(spark, sf):
    return L.links(page_dom(spark, sf), "nav a").select("page_id", "link")


@query(
    "links_by_regex",
    f"SELECT DISTINCT page_id, link FROM (SELECT page_id, {sql_absolute('href', 'url')} AS link FROM "
    f"(SELECT page_id, url, {sql_unescape(f'unnest({HREFS})')} AS href FROM pages)) "
    "WHERE regexp_matches(link, 'example[.]com/(de|the|in)')",
)
def links_by_regex(spark, sf):
    return L.links_regex(page_dom(spark, sf), r"example[.]com/(de|the|in)", "nav").select("page_id", "link")


VARIANTS = ["/a/b", "c", "//cdn.example.com/x", "?q=1", "#top", "", "mailto:me@example.com", "javascript:go()", "tel:5551234", "sms:123", "javascript:", "http://other.example.com/z"]
DOTTED = {"../x": "/x", "a/../b": "/b", "./c/./d": "/c/d", "/a/b/..": "/a/", "a/./": "/a/", "a.b/..c": "/a.b/..c"}


@query(
    "absolute_urls",
    f"SELECT page_id, href, {sql_absolute('href', 'url')} AS link FROM "
    f"(SELECT page_id, url, unnest([{', '.join(repr(v) for v in VARIANTS)}]) AS href FROM pages) UNION ALL "
    "SELECT page_id, href, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || path AS link FROM (SELECT page_id, url, "
    f"unnest([{', '.join(repr(v) for v in DOTTED)}]) AS href, unnest([{', '.join(repr(v) for v in DOTTED.values())}]) AS path FROM pages)",
)
def absolute_urls(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url")
    hrefs = F.array(*[F.lit(v) for v in [*VARIANTS, *DOTTED]])
    rows = pages.select("page_id", "url", F.explode(hrefs).alias("href"))
    return rows.select("page_id", "href", absolutise(F.col("href"), F.col("url")).alias("link"))


ANCHORS = (
    f"SELECT page_id, {HOST} AS host, href, text FROM (SELECT page_id, url, "
    f"{sql_unescape('''unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1))''')} AS href, "
    f"{sql_strip(sql_unescape('''unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)', 1))'''))} AS text FROM pages)"
)


def _anchor_records(spark, sf):
    return L.link_records(page_dom(spark, sf)).withColumn("host", netloc(F.col("url")))


@query("distinct_links_by_href", f"SELECT host, href AS key, min(page_id) AS seq, count(*) AS uses FROM ({ANCHORS}) GROUP BY 1, 2")
def distinct_links_by_href(spark, sf):
    return L.distinct_links(_anchor_records(spark, sf), ["host"], order="page_id")


@query("distinct_links_by_text", f"SELECT host, text AS key, min(page_id) AS seq, count(*) AS uses FROM ({ANCHORS}) GROUP BY 1, 2")
def distinct_links_by_text(spark, sf):
    return L.distinct_links(_anchor_records(spark, sf), ["host"], UNIQUE_TEXT, "page_id")


RAW_LINKS = f"SELECT page_id, url, {HOST} AS host, {sql_unescape(f'unnest({ALL_HREFS})')} AS href FROM pages"


def _host_links(spark, sf):
    found = L.links(page_dom(spark, sf), "a").withColumnRenamed("pre", "pos")
    return found.select("page_id", "url", netloc(F.col("url")).alias("host"), "href", "link", "pos")


@query(
    "new_links_of_listings",
    f"SELECT DISTINCT href FROM ({RAW_LINKS}) f WHERE url LIKE 'https%' AND NOT EXISTS "
    f"(SELECT 1 FROM ({RAW_LINKS}) s WHERE s.url NOT LIKE 'https%' AND s.href = f.href)",
)
def new_links_of_listings(spark, sf):
    found = _host_links(spark, sf)
    secure = F.col("url").startswith("https")
    return L.new_links(found.filter(secure), found.filter(~secure), ["href"])


@query(
    "frontier_over_turns",
    "WITH RECURSIVE walk AS (SELECT conv_id, 0 AS turn, 0 AS depth FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0) "
    "UNION SELECT w.conv_id, w.turn + 1, w.depth + 1 FROM walk w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn) "
    "SELECT DISTINCT 'http://chat.example.com/' || conv_id || '/' || turn AS url, depth FROM walk",
)
def frontier_over_turns(spark, sf):
    dom = shred(turn_pages(spark, sf))
    edges = L.links(dom, "a.next").select(F.col("url").alias("src"), F.col("link").alias("dst"))
    start = table(spark, sf, "conversations").filter("turn = 0").select(
        F.concat(F.lit("http://chat.example.com/"), "conv_id", F.lit("/0")).alias("url")
    )
    return expand(start, edges)


@query("item_links_per_listing", "SELECT o_orderkey AS page_id, c_custkey AS item_page_id FROM orders JOIN customer ON o_custkey = c_custkey")
def item_links_per_listing(spark, sf):
    listings = shred(order_pages(spark, sf), L.link_fields("a.who"))
    return L.item_links(listings, "a.who", customer_pages(spark, sf)).select("page_id", "item_page_id")


@query(
    "next_links_per_host",
    "SELECT host, link, position FROM (SELECT host, link, row_number() OVER (PARTITION BY host ORDER BY seq) AS position FROM "
    f"(SELECT {HOST} AS host, page_id * 1000 + (i - 1) AS seq, {sql_absolute('h[i]', 'url')} AS link FROM "
    "(SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, "
    "regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1) AS h FROM pages)))) WHERE position > 2 AND position <= 7",
)
def next_links_per_host(spark, sf):
    found = _host_links(spark, sf).withColumn("seq", F.col("page_id") * 1000 + F.col("pos"))
    # discovered links are a table of their own: ranking reads it twice, the pages only once
    found = materialise(found.select("host", "link", "seq"))
    return L.take_next(found, ["host"], "seq", cursor=2, n=5).select("host", "link", "position")


@query(
    "links_left_after_resume",
    f"SELECT host, href, page_id FROM ({RAW_LINKS}) l WHERE NOT EXISTS (SELECT 1 FROM ({RAW_LINKS}) v "
    "WHERE v.url LIKE '%/en/%' AND v.host = l.host AND v.href = l.href)",
)
def links_left_after_resume(spark, sf):
    found = _host_links(spark, sf)
    visited = found.filter(F.col("url").contains("/en/"))
    return L.remaining(found, visited, ["host", "href"]).select("host", "href", "page_id")


@query(
    "favicons_per_host",
    f"SELECT {HOST} AS job_id, regexp_extract(min(url), '^([^:/?#]+://[^/?#]*)', 1) || '/favicon.ico' AS favicon FROM pages GROUP BY 1",
)
def favicons_per_host(spark, sf):
    jobs = read_pages(spark, f"{sf}/pages.parquet").select(netloc(F.col("url")).alias("job_id"), "url")
    return L.favicons(jobs).select("job_id", F.col("image_urls")[0].alias("favicon"))


@query("favicon_of_pages", "SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || '/favicon.ico' AS favicon FROM pages")
def favicon_of_pages(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet").select("page_id", favicon_url(F.col("url")).alias("favicon"))


@query("pages_per_netloc", f"SELECT {HOST} AS netloc, count(*) AS n FROM pages GROUP BY 1")
def pages_per_netloc(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet")
    return pages.groupBy(netloc(F.col("url")).alias("netloc")).agg(F.count("*").alias("n"))


@query(
    "stripped_documents",
    f"SELECT doc_id, {sql_strip('chr(9) || chr(160) || text || chr(8195) || chr(10)')} AS text FROM documents",
)
def stripped_documents(spark, sf):
    padded = F.concat(F.lit("\t "), "text", F.lit(" \n"))
    return table(spark, sf, "documents").select("doc_id", strip(padded).alias("text"))
