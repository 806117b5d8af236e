"""Queries from pages to selectors, and over ordered histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.model import CSS, FieldSelector
from pageloom.operators import elements as E
from pageloom.operators import history as H
from pageloom.operators import infer as I
from pageloom.operators import select as S
from pageloom.operators.selectors import node_fields
from pageloom.operators.shred import shred
from pageloom.plans.session import materialise, spread
from pageloom.workload.registry import TASK_PAGES, order_pages, page_dom, part_pages, query, sql_unescape, table

CLASSED = "regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)"


@query(
    "element_signatures",
    f"SELECT signature, count(*) AS n FROM (SELECT CASE WHEN t = 'div' THEN 'div.ad' ELSE t END AS signature FROM (SELECT unnest({CLASSED}) AS t FROM pages)) GROUP BY 1",
)
def element_signatures(spark, sf):
    return E.signatures(page_dom(spark, sf)).groupBy("signature").agg(F.count("*").alias("n"))


PART_SIGNATURES = (
    "SELECT p_partkey AS page_id, unnest(['html','head','title','body','h1#title','div.gallery','a.zoom','img.photo','a.full','table#specs','tr','td','b','i','span.val','form','input','select','option']) AS signature, "
    "unnest([1,1,1,1,1,1,1,1,1,1,4,10,1,1,1,2,4,1,2]) AS matched FROM part UNION ALL SELECT p_partkey, 'span.key', 1 FROM part WHERE p_size % 7 <> 0"
)


@query(
    "signature_uniqueness",
    f"SELECT page_id, signature, CAST(matched AS BIGINT) AS matched, matched = 1 AS is_selector FROM ({PART_SIGNATURES})",
)
def signature_uniqueness(spark, sf):
    dom = shred(part_pages(spark, sf), ("tag", "id", "classes", "parent", "last", "nth"))
    return I.signature_uniqueness(dom).select("page_id", "signature", "matched", "is_selector")


@query(
    "similar_elements",
    f"SELECT page_id, t AS tag, '' AS elem_id, CASE WHEN t = 'div' THEN 'ad' ELSE '' END AS classes, count(*) AS n FROM (SELECT page_id, unnest({CLASSED}) AS t FROM pages) GROUP BY 1, 2, 4",
)
def similar_elements(spark, sf):
    groups = I.similar(page_dom(spark, sf))
    return groups.select("page_id", "tag", "elem_id", F.array_join("classes", ".").alias("classes"), "n")


@query("all_similar_matches", "SELECT p_partkey AS page_id, false AS all_similar FROM part UNION ALL SELECT o_orderkey + 10000000000, true FROM orders")
def all_similar_matches(spark, sf):
    shape = {"id", "classes"}
    mixed = E.all_similar(shred(part_pages(spark, sf), node_fields("a, img") | shape), "a, img")
    same = E.all_similar(shred(order_pages(spark, sf), node_fields("table.lines th") | shape), "table.lines th")
    shifted = same.withColumn("page_id", F.col("page_id") + 10000000000)
    return mixed.unionByName(shifted).select("page_id", "all_similar")


@query(
    "unique_selectors_of_pages",
    "SELECT page_id, CASE WHEN n = 1 THEN CASE WHEN t = 'div' THEN 'div.ad' ELSE t END END AS selector FROM "
    f"(SELECT page_id, t, count(*) OVER (PARTITION BY page_id, t) AS n FROM (SELECT page_id, unnest({CLASSED}) AS t FROM pages))",
)
def unique_selectors_of_pages(spark, sf):
    # elements of one tag share their whole chain on these pages, so a tag is unique or nothing is
    return I.unique_selectors(page_dom(spark, sf)).select("page_id", "selector")


LINES_OF_FLAGS = (
    "SELECT o, s, f, j, n, m, count(*) OVER (PARTITION BY o, j) AS at_j FROM (SELECT l_orderkey AS o, l_returnflag AS f, "
    "dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS s, count(*) OVER (PARTITION BY l_orderkey) AS n, "
    "count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS m, "
    "row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS j FROM lineitem)"
)


def _line_selector(one: str, own: str, ordinal: str) -> str:
    """SQL for an element of a line: alone on its page, alone in its section, or told apart by ordinals."""
    at = f"'div.line:nth-child(' || j || '){ordinal}'"
    return (
        f"CASE WHEN n = 1 THEN '{one}' WHEN m = 1 THEN '#f' || f || ' {own}' WHEN at_j = 1 THEN {at} "
        f"ELSE 'section#f' || f || ':nth-child(' || s || ') > ' || {at} END"
    )


@query(
    "shortest_selectors_of_orders",
    f"WITH l AS ({LINES_OF_FLAGS}) SELECT o AS page_id, {_line_selector('div.line', 'div.line', '')} AS selector FROM l UNION ALL "
    f"SELECT o, {_line_selector('b', 'div.line b', ' > b:nth-child(1)')} FROM l UNION ALL SELECT DISTINCT o, 'section#f' || f FROM l",
)
def shortest_selectors_of_orders(spark, sf):
    """Pages with a section per return flag and a line per item: selectors of one to three steps, and ordinals."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity")
    # dealt out by page once, which serves both aggregates; about four lines a page
    lines = spread(items, "l_orderkey", 4 * TASK_PAGES).groupBy("l_orderkey", "l_returnflag").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("lines")  # seven at most
    )
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<div class=line><b>"), x["l_quantity"].cast("string"), F.lit("</b></div>"))), "")
    section = F.concat(F.lit("<section id=f"), F.col("l_returnflag"), F.lit(">"), body, F.lit("</section>"))
    made = lines.select("l_orderkey", F.struct("l_returnflag", section.alias("html")).alias("s")).groupBy("l_orderkey")
    pages = made.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["html"]), "").alias("html"))
    dom = shred(pages.withColumnRenamed("l_orderkey", "page_id"), ("tag", "id", "classes", "parent", "last", "nth"))
    return I.shortest_selectors(dom).select("page_id", "selector")


SINGLES = (
    "html:nth-child(1) head:nth-child(1) meta:nth-child(1) title:nth-child(2) style:nth-child(3) script:nth-child(4) "
    "body:nth-child(2) nav:nth-child(1) ul:nth-child(1) div.ad:nth-child(2) article:nth-child(3) h1:nth-child(1) footer:nth-child(4)"
).split()
ORDINALS = (
    "WITH a AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items, "
    "string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>')[2:] AS ps FROM pages), "
    "li AS (SELECT page_id, items, unnest(range(1, items + 1)) AS i FROM a), "
    "p AS (SELECT page_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM a), "
    "b AS (SELECT page_id, i, count(*) OVER (PARTITION BY page_id) AS n FROM p WHERE starts_with(p, '<b>')) "
    f"SELECT page_id, unnest([{', '.join(repr(x) for x in SINGLES)}]) AS selector FROM a UNION ALL "
    "SELECT page_id, 'li:nth-child(' || i || ')' FROM li UNION ALL "
    "SELECT page_id, CASE WHEN items > 1 THEN 'li:nth-child(' || i || ') > ' ELSE '' END || 'a:nth-child(1)' FROM li UNION ALL "
    "SELECT page_id, 'p:nth-child(' || (i + 1) || ')' FROM p UNION ALL "
    "SELECT page_id, CASE WHEN n > 1 THEN 'p:nth-child(' || (i + 1) || ') > ' ELSE '' END || 'b:nth-child(1)' FROM b UNION ALL "
    "SELECT page_id, CASE WHEN n > 1 THEN 'p:nth-child(' || (i + 1) || ') > b:nth-child(1) > ' ELSE '' END || 'br:nth-child(1)' FROM b"
)


@query("ordinal_selectors_of_pages", ORDINALS)
def ordinal_selectors_of_pages(spark, sf):
    return I.ordinal_selectors(page_dom(spark, sf)).select("page_id", "selector")


@query(
    "first_children_with_text",
    "SELECT p_partkey AS page_id, CAST(2 AS INTEGER) AS n_found, 'h1' AS first_tag FROM part",
)
def first_children_with_text(spark, sf):
    found = E.first_child_with_text(shred(part_pages(spark, sf)), "body, div.gallery")
    return found.groupBy("page_id").agg(
        F.count("*").cast("int").alias("n_found"), F.min_by("child_tag", "pre").alias("first_tag")
    )


@query(
    "match_set_edits",
    "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(?:li|a|h1)[ >]')) AS t FROM pages) WHERE NOT starts_with(t, '<li') GROUP BY page_id",
)
def match_set_edits(spark, sf):
    edited = E.edited_matches(page_dom(spark, sf), ["nav li, nav a", "h1, nav a"], ["nav ul > li"])
    return edited.groupBy("page_id").agg(F.count("*").alias("n"))


@query(
    "stored_match_set_edits",
    "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(?:li|h1)[ >]')) AS t FROM pages) GROUP BY page_id",
)
def stored_match_set_edits(spark, sf):
    dom = materialise(page_dom(spark, sf))
    union = E.add_matches(S.select(dom, "nav li, nav a"), S.select(dom, "h1, nav a"))
    edited = E.remove_matches(union, S.select(dom, "li > a"))
    return edited.groupBy("page_id").agg(F.count("*").alias("n"))


@query(
    "captures_that_grew",
    "SELECT event_id, user_id, value, previous FROM (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE value - previous > 50",
)
def captures_that_grew(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value", "ts")
    return H.grew(events, "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "value", "previous")


@query(
    "captures_that_changed",
    "SELECT event_id, event_type, previous FROM (SELECT event_id, event_type, length(props) AS size, lag(length(props)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous FROM events) WHERE size <> previous",
)
def captures_that_changed(spark, sf):
    sized = table(spark, sf, "events").withColumn("size", F.char_length("props").cast("long"))
    done = H.changed(sized, "event_type", ["ts", "event_id"], "size")
    return done.select("event_id", "event_type", "previous")


@query("attribute_inventory", f"SELECT page_id, 'a' AS tag, 'href' AS name, {sql_unescape('h')} AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS h FROM pages) UNION ALL SELECT page_id, 'div', 'class', 'ad' FROM pages")
def attribute_inventory(spark, sf):
    return E.attributes(page_dom(spark, sf), FieldSelector("a, div", CSS)).select("page_id", "tag", "name", "value")


@query(
    "form_inventory",
    "SELECT p_partkey AS page_id, 'q' AS name, p_name AS value, 'text' AS type FROM part UNION ALL SELECT p_partkey, 'brand', p_brand, 'select' FROM part",
)
def form_inventory(spark, sf):
    return E.form_fields(shred(part_pages(spark, sf))).select("page_id", "name", "value", "type")


def _actions(spark, sf):
    """Errors remove and all other events add; the user is the field, the payload the selector."""
    events = table(spark, sf, "events")
    return events.select(
        F.col("user_id").alias("user"),
        F.concat(F.lit("f"), F.col("user_id")).alias("field"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("is_add"),
        F.col("props").alias("selector"),
        F.when(F.col("event_type") == "view", "image").otherwise("text").alias("kind"),
        F.when(F.col("event_type") == "view", 6).otherwise(3).alias("action"),
    )


ACTIONS = (
    "SELECT user_id AS user, 'f' || user_id AS field, event_id AS seq, event_type <> 'error' AS is_add, props AS selector, "
    "CASE WHEN event_type = 'view' THEN 'image' ELSE 'text' END AS kind FROM events"
)


@query(
    "last_actions",
    f"SELECT field, selector, seq FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY seq DESC) AS rn FROM ({ACTIONS})) WHERE rn = 1 AND is_add",
)
def last_actions(spark, sf):
    return H.last_action(_actions(spark, sf))


@query(
    "current_selectors",
    f"WITH a AS (SELECT CASE WHEN kind = 'image' THEN 'Images' ELSE field END AS field, selector, seq, is_add FROM ({ACTIONS})) "
    "SELECT field, selector, max(seq) AS seq FROM a WHERE is_add AND NOT EXISTS (SELECT 1 FROM a r WHERE r.field = a.field AND NOT r.is_add AND r.seq > a.seq) GROUP BY 1, 2",
)
def current_selectors(spark, sf):
    return H.current_selectors(_actions(spark, sf))


@query(
    "rendered_action_log",
    "WITH b AS (SELECT *, sum(CASE WHEN is_add THEN 1 ELSE -1 END) OVER (PARTITION BY user, selector ORDER BY seq) AS bal FROM "
    f"({ACTIONS})), t AS (SELECT user, selector, count(*) FILTER (is_add) - (count(*) FILTER (is_add) - count(*) FILTER (NOT is_add) - least(min(bal), 0)) AS gone FROM b GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY user, selector ORDER BY seq) AS no FROM b WHERE is_add) "
    "SELECT r.user, r.seq, CASE WHEN r.kind = 'image' THEN 'Download image' ELSE 'Select' END AS label, "
    "rpad(r.field, greatest(20, length(r.field))::INT, ' ') || ' <> ' || lpad(r.selector, greatest(35, length(r.selector))::INT, ' ') AS value "
    "FROM r JOIN t ON r.user = t.user AND r.selector = t.selector WHERE r.no > t.gone",
)
def rendered_action_log(spark, sf):
    return H.render_log(_actions(spark, sf), ["user", "selector"])


@query(
    "navigation_trail",
    "WITH v AS (SELECT conv_id, turn AS seq, CASE WHEN length(text) > 1500 THEN 'item' WHEN length(text) < 200 THEN 'form' ELSE 'url' END AS kind, role || turn AS url FROM conversations), "
    "w AS (SELECT *, lead(kind) OVER (PARTITION BY conv_id ORDER BY seq) AS next_kind, lag(url) OVER (PARTITION BY conv_id ORDER BY seq) AS last_url FROM "
    "(SELECT v.* FROM v LEFT JOIN (SELECT conv_id, min(seq) AS stop FROM v WHERE kind = 'item' GROUP BY 1) s ON v.conv_id = s.conv_id WHERE s.stop IS NULL OR v.seq < s.stop)) "
    "SELECT conv_id, seq, kind, CASE WHEN kind = 'form' THEN coalesce(last_url, url) ELSE url END AS url FROM w WHERE next_kind IS DISTINCT FROM 'form'",
)
def navigation_trail(spark, sf):
    size = F.char_length("text")
    visits = table(spark, sf, "conversations").select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.when(size > 1500, "item").when(size < 200, "form").otherwise("url").alias("kind"),
        F.concat("role", "turn").alias("url"),
    )
    return H.trail(visits, ["conv_id"])
