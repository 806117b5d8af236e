"""Queries from pages to items: fields, tables, post-processing."""

from __future__ import annotations

from functools import partial, reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pageloom.functions.text import call_arg, clean_key
from pageloom.functions.urls import netloc
from pageloom.model import (
    CSS,
    MainPage,
    TABLE_HHEADERS,
    TABLE_VHEADERS,
    WORDLIST,
    XPATH,
    ContentSelector,
    FieldSelector,
    ImageSelector,
    ItemSelector,
    KeyValueSelector,
    Merge,
    TableSelector,
    UrlSelector,
)
from pageloom.operators import fields as Fd
from pageloom.operators import post as P
from pageloom.operators import tables as T
from pageloom.operators.jobs import with_defaults, with_params
from pageloom.operators.selectors import node_fields
from pageloom.operators.shred import shred
from pageloom.plans.crawl import crawl, crawl_list, run_job_table
from pageloom.sources.pages import read_pages
from pageloom.sources.records import site_params, site_params_from
from pageloom.workload.pages import HOST, HREFS
from pageloom.workload.registry import (
    captured,
    customer_pages,
    order_pages,
    page_dom,
    part_pages,
    query,
    sql_strip,
    sql_unescape,
    table,
    turn_pages,
)


def css(text):
    return FieldSelector(text, CSS)


TITLE = sql_strip(sql_unescape("regexp_extract(html, '<title>([^<]*)', 1)"))
HEADING = sql_strip(sql_unescape("regexp_extract(html, '<h1>([^<]*)', 1)"))


@query(
    "static_fields",
    f"SELECT page_id, 'Title' AS key, {TITLE} AS value FROM pages UNION ALL "
    f"SELECT page_id, 'Link' AS key, {sql_strip(sql_unescape(f'unnest({HREFS})'))} AS value FROM pages",
)
def static_fields(spark, sf):
    spec = ItemSelector(
        (KeyValueSelector("Title", css("title::text")), KeyValueSelector("Link", css("nav a::attr(href)")))
    )
    rows = Fd.field_rows(Fd.process_fields(Fd.extract_fields(page_dom(spark, sf), spec)))
    return rows.select("page_id", "key", "value")


@query(
    "dynamic_fields",
    "SELECT p_partkey AS page_id, CASE WHEN p_size % 7 = 0 THEN 'Invalid_Key_Selector' ELSE 'Key ' || (p_size % 5) END AS key, p_type AS value FROM part",
)
def dynamic_fields(spark, sf):
    spec = ItemSelector((KeyValueSelector(css("span.key::text"), css("span.val::text")),))
    return Fd.field_rows(Fd.extract_fields(shred(part_pages(spark, sf)), spec)).select("page_id", "key", "value")


@query(
    "accumulated_values",
    f"SELECT page_id, key, n_values, joined FROM (SELECT page_id, 'Heading' AS key, len(v) AS n_values, array_to_string(v, '|') AS joined FROM "
    f"(SELECT page_id, list_concat([{TITLE}], [{HEADING}]) AS v FROM pages) UNION ALL "
    f"SELECT page_id, 'Link', len(v), array_to_string(v, '|') FROM (SELECT page_id, list_transform({HREFS}, lambda x: {sql_strip(sql_unescape('x'))}) AS v FROM pages))",
)
def accumulated_values(spark, sf):
    spec = ItemSelector(
        (
            KeyValueSelector("Heading", css("title::text")),
            KeyValueSelector("Link", css("nav a::attr(href)")),
            KeyValueSelector("Heading", css("article > h1::text")),
        )
    )
    lists = Fd.collect_fields(Fd.process_fields(Fd.extract_fields(page_dom(spark, sf), spec)))
    rows = lists.select("page_id", F.explode("values").alias("key", "v"))
    return rows.select("page_id", "key", F.size("v").cast("long").alias("n_values"), F.array_join("v", "|").alias("joined"))


@query(
    "image_fields",
    "SELECT p_partkey AS page_id, 'image_urls' AS key, 'http://shop.example.com/img/' || p_partkey || '.png' AS value FROM part",
)
def image_fields(spark, sf):
    spec = ItemSelector((KeyValueSelector("Screenshot", ImageSelector("//a[@class='zoom']/img/@src", XPATH)),))
    return Fd.field_rows(Fd.process_fields(Fd.extract_fields(shred(part_pages(spark, sf)), spec))).select("page_id", "key", "value")


@query(
    "call_arguments",
    "SELECT p_partkey AS page_id, 'http://img.example.com/' || p_partkey || '.jpg' AS full_size, p_name AS other FROM part",
)
def call_arguments(spark, sf):
    spec = ItemSelector(
        (KeyValueSelector("Images", css("a.full::attr(onclick)")), KeyValueSelector("Name", css("#title::text")))
    )
    done = Fd.process_fields(Fd.extract_fields(shred(part_pages(spark, sf)), spec), {"Images": [call_arg], "Name": [call_arg]})
    wide = Fd.to_wide(Fd.expand_items(Fd.collect_fields(done)), ["Images", "Name"])
    return wide.select("page_id", F.col("Images").alias("full_size"), F.col("Name").alias("other"))


@query(
    "attributes_matching",
    f"SELECT page_id, 'a' AS tag, 'href' AS attr, href AS value FROM (SELECT page_id, {sql_unescape(f'unnest({HREFS})')} AS href FROM pages) WHERE regexp_matches(href, '^/[a-d]') "
    "UNION ALL SELECT page_id, 'html', 'lang', l FROM (SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS l FROM pages) WHERE regexp_matches(l, '^[a-d]')",
)
def attributes_matching(spark, sf):
    return Fd.attrs_matching(page_dom(spark, sf), ["a", "html"], ["href", "lang"], "^/?[a-d]").select("page_id", "tag", "attr", "value")


@query("pages_passing_predicate", f"SELECT page_id, {TITLE} AS title FROM pages WHERE contains(html, 'lang=\"en\"') AND regexp_matches(html, '(?i)<nav>')")
def pages_passing_predicate(spark, sf):
    html = F.col("html")
    kept = Fd.filter_pages(captured(spark, sf), html.contains('lang="en"') & html.rlike("(?i)<nav>"))
    spec = ItemSelector((KeyValueSelector("title", css("title::text")),))
    items = Fd.expand_items(Fd.collect_fields(Fd.process_fields(Fd.extract_fields(shred(kept), spec))))
    return Fd.to_wide(items, ["title"]).select("page_id", "title")


@query("pages_passing_python_predicate", "SELECT page_id, url FROM pages WHERE NOT contains(html, 'lang=\"de\"')")
def pages_passing_python_predicate(spark, sf):
    return Fd.filter_pages(captured(spark, sf), lambda body: 'lang="de"' not in body).select("page_id", "url")


@query("documents_of_quality", "SELECT d.doc_id, d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1")
def documents_of_quality(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")


@query(
    "fields_by_site_processor",
    f"SELECT page_id, CASE WHEN starts_with({HOST}, 'm.') THEN v ELSE 'FillFullSize(0, ' || v || ' , 2)' END AS value FROM "
    f"(SELECT page_id, url, regexp_extract(url, '[^/]*$') AS v FROM pages)",
)
def fields_by_site_processor(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url")
    car = F.when(netloc(F.col("url")).startswith("m."), "car")
    params = site_params_from(pages, F.col("url"), processor=car)
    raw = F.concat(F.lit("FillFullSize(0, "), F.substring_index("url", "/", -1), F.lit(" , 2)"))
    field = F.struct(F.lit(0).alias("selector_no"), F.lit("Images").alias("key"), F.lit(0).alias("pos"), raw.alias("value"))
    extracted = with_defaults(with_params(pages.withColumn("fields", F.array(field)), params))
    return Fd.field_rows(Fd.process_by_site(extracted)).select("page_id", "value")


LINES = f"list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: {sql_strip('x')})"
TURN_ITEMS = (
    "SELECT conv_id * 100000 + turn AS page_id, conv_id, turn, unnest(range(0, greatest(len(l), 1))) AS pos, l, role "
    f"FROM (SELECT conv_id, turn, role, {LINES} AS l FROM conversations)"
)
TURN_SPEC = ItemSelector(
    (
        KeyValueSelector("line", css("li.line::text")),
        KeyValueSelector("role", css("p.who::text")),
        KeyValueSelector("Face", ImageSelector("img::src", CSS)),
    )
)


def _turn_items(spark, sf):
    dom = shred(turn_pages(spark, sf))
    return Fd.expand_items(Fd.collect_fields(Fd.process_fields(Fd.extract_fields(dom, TURN_SPEC))))


@query(
    "expanded_parallel_lists",
    f"SELECT page_id, CAST(pos AS INTEGER) AS pos, l[pos + 1] AS line, CASE WHEN pos = 0 THEN role END AS role FROM ({TURN_ITEMS})",
)
def expanded_parallel_lists(spark, sf):
    return Fd.to_wide(_turn_items(spark, sf), ["line", "role"]).select("page_id", "pos", "line", "role")


@query(
    "images_on_first_item",
    f"SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos = 0 THEN 'http://chat.example.com/face.png' END AS image FROM ({TURN_ITEMS})",
)
def images_on_first_item(spark, sf):
    return _turn_items(spark, sf).select("page_id", "pos", F.col("image_urls")[0].alias("image"))


@query(
    "items_with_provenance",
    "SELECT CAST(7 AS INTEGER) AS job_id, 'chat' AS job_name, 'scrapy' AS job_type, "
    f"'http://chat.example.com/' || conv_id || '/' || turn AS scraped_url, count(*) AS items FROM ({TURN_ITEMS}) GROUP BY ALL",
)
def items_with_provenance(spark, sf):
    items = Fd.with_provenance(_turn_items(spark, sf), 7, "chat", "scrapy")
    return items.groupBy("job_id", "job_name", "job_type", "scraped_url").agg(F.count("*").alias("items"))


@query("wide_items", "SELECT p_partkey AS page_id, p_name AS \"Name\", p_type AS \"Kind\", CAST(NULL AS VARCHAR) AS \"Colour\" FROM part")
def wide_items(spark, sf):
    spec = ItemSelector((KeyValueSelector("Name", css("#title::text")), KeyValueSelector("Kind", css("span.val::text"))))
    items = Fd.expand_items(Fd.collect_fields(Fd.process_fields(Fd.extract_fields(shred(part_pages(spark, sf)), spec))))
    return Fd.to_wide(items, ["Name", "Kind", "Colour"]).select("page_id", "Name", "Kind", "Colour")


@query(
    "item_records",
    "SELECT p_name AS \"Name\", CAST(3 AS INTEGER) AS _id, 'http://shop.example.com/img/' || p_partkey || '.png' AS image, "
    "'scrapy' AS _spidertype, 'http://shop.example.com/part/' || p_partkey AS _scrapedurl, 'parts' AS _spidername FROM part",
)
def item_records(spark, sf):
    spec = ItemSelector((KeyValueSelector("Name", css("#title::text")), KeyValueSelector("x", ImageSelector("img::src", CSS))))
    items = Fd.expand_items(Fd.collect_fields(Fd.process_fields(Fd.extract_fields(shred(part_pages(spark, sf)), spec))))
    records = Fd.to_records(Fd.with_provenance(items, 3, "parts", "scrapy"), ["Name"])
    return records.withColumn("image", F.col("image_urls")[0]).drop("image_urls", "images", "_postinfo")


@query(
    "items_of_mixed_selectors",
    "SELECT p_partkey AS page_id, p_name AS name, p_brand || ' ok' AS brand, p_type AS kind, CAST(p_size AS VARCHAR) AS size, "
    "CASE WHEN regexp_matches(p_type, '(?i)^(?:eco|med|small)') THEN p_type ELSE '' END AS cheap FROM part",
)
def items_of_mixed_selectors(spark, sf):
    spec = ItemSelector(
        (
            KeyValueSelector("name", FieldSelector("//h1[@id='title']/text()", XPATH)),
            KeyValueSelector("specs", TableSelector("table.props", CSS, TABLE_HHEADERS)),
            KeyValueSelector("cheap", ContentSelector(FieldSelector("eco, med, small", WORDLIST), css("#specs"))),
        )
    )
    items = Fd.expand_items(Fd.collect_fields(Fd.process_fields(Fd.extract_fields(shred(part_pages(spark, sf)), spec))))
    wide = Fd.to_wide(items, ["name", "Brand", "Type", "Size", "cheap"])
    return wide.select("page_id", "name", F.col("Brand").alias("brand"), F.col("Type").alias("kind"), F.col("Size").alias("size"), "cheap")


@query(
    "tables_and_kinds",
    "SELECT p_partkey AS page_id, 'part' AS source, CAST(0 AS INTEGER) AS table_no, CAST(2 AS INTEGER) AS kind FROM part UNION ALL "
    "SELECT o_orderkey, 'order', 0, 1 FROM orders",
)
def tables_and_kinds(spark, sf):
    parts = part_pages(spark, sf).withColumn("source", F.lit("part"))
    orders = order_pages(spark, sf).withColumn("source", F.lit("order"))
    return T.tables(shred(parts.unionByName(orders), ("pre", "last", "tag"))).select("page_id", "source", "table_no", "kind")


@query(
    "keys_left_tables",
    "SELECT p_partkey AS page_id, key, value FROM (SELECT p_partkey, 'Brand' AS key, p_brand || ' ok' AS value FROM part UNION ALL "
    "SELECT p_partkey, 'Type', p_type FROM part UNION ALL SELECT p_partkey, 'Size', CAST(p_size AS VARCHAR) FROM part UNION ALL "
    "SELECT p_partkey, 'Note', '' FROM part)",
)
def keys_left_tables(spark, sf):
    # the brand cell starts with blank text, so its value is all its texts joined
    dom = shred(part_pages(spark, sf))
    rows = T.table_rows(dom, TableSelector("#specs", CSS, TABLE_HHEADERS))
    return rows.select("page_id", "key", "value")


@query("cleaned_keys", r"SELECT p_partkey, regexp_replace(p_brand || ':' , '[^\p{L}\p{N}_]$', '') AS one, regexp_replace(p_name || '::', '[^\p{L}\p{N}_]$', '') AS two, p_type AS none FROM part")
def cleaned_keys(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        "p_partkey",
        clean_key(F.concat("p_brand", F.lit(":"))).alias("one"),
        clean_key(F.concat("p_name", F.lit("::"))).alias("two"),
        clean_key(F.col("p_type")).alias("none"),
    )


ORDER_CELLS = (
    "SELECT o_orderkey, CAST(0 AS INTEGER) AS row, 'status' AS field, o_orderstatus AS value FROM orders UNION ALL "
    "SELECT o_orderkey, 1, 'priority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 2, 'urgency', o_orderpriority FROM orders"
)


@query(
    "keys_top_tables",
    f"SELECT o_orderkey AS page_id, 'Order' AS key, row, CAST(o_orderkey AS VARCHAR) AS value FROM ({ORDER_CELLS}) UNION ALL "
    f"SELECT o_orderkey, 'Field', row, field FROM ({ORDER_CELLS}) UNION ALL SELECT o_orderkey, 'Value', row, value FROM ({ORDER_CELLS})",
)
def keys_top_tables(spark, sf):
    dom = shred(order_pages(spark, sf), node_fields("table.lines") | {"attrs"})
    return T.table_rows(dom, TableSelector("table.lines", CSS, TABLE_VHEADERS)).select("page_id", "key", "row", "value")


@query(
    "row_spans_filled",
    f"SELECT o_orderkey AS page_id, row + 1 AS row, CAST(o_orderkey AS VARCHAR) || '|' || field || '|' || value AS cells FROM ({ORDER_CELLS}) "
    "UNION ALL SELECT o_orderkey, 0, 'Order sheet' FROM orders",
)
def row_spans_filled(spark, sf):
    rows = T.expanded_rows(shred(order_pages(spark, sf), node_fields("table.lines") | {"attrs"}), "table.lines")
    return rows.select("page_id", "row", F.array_join("cells", "|").alias("cells"))


@query("merged_fields", "SELECT c_custkey, c_name || '-' || c_mktsegment AS label, c_nationkey FROM customer")
def merged_fields(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return P.post_process(customer, (Merge(("c_name", "c_mktsegment"), "label", "-"),))


@query("merged_into_source_field", "SELECT p_partkey, concat_ws(' ', CASE WHEN p_size % 4 <> 0 THEN p_brand END, p_name) AS p_name FROM part")
def merged_into_source_field(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("p_brand"), "p_name"
    )
    return P.merge(part, ["p_brand", "p_name"], "p_name", " ")


def _part_items(spark, sf):
    """Items with images as a pipeline receives them."""
    c = F.col
    path = F.concat(F.lit("full/./"), c("p_brand"), F.lit("//x/../"), c("p_partkey"), F.lit(".jpg"))
    stored = F.when(c("p_size") % 3 == 0, F.concat(F.lit("/store/img/"), path)).otherwise(path)
    favicon = F.concat(F.lit("http://h.example.com/"), F.when(c("p_size") % 10 == 0, "favicon.ico").otherwise("a.jpg"))
    return table(spark, sf, "part").select(
        c("p_partkey").alias("_id"),
        "p_name",
        "p_type",
        F.array(F.struct(favicon.alias("url"), stored.alias("path"))).alias("images"),
        F.array(favicon).alias("image_urls"),
        F.lit("merge").alias("_postinfo"),
    )


@query("helper_fields_dropped", "SELECT p_name, p_type, p_partkey AS images_of FROM part")
def helper_fields_dropped(spark, sf):
    items = _part_items(spark, sf).withColumn("images_of", F.col("_id")).drop("images")
    return P.drop_helpers(items, viewer=True)


CANONICAL = "'/store/img/full/' || replace(p_brand, '/', '') || '/' || p_partkey || '.jpg'"


@query("canonical_image_paths", f"SELECT p_partkey AS _id, {CANONICAL} AS path FROM part")
def canonical_image_paths(spark, sf):
    items = P.canonical_paths(_part_items(spark, sf), "/store/./img/")
    return items.select("_id", F.col("images")[0]["path"].alias("path"))


@query(
    "record_chain",
    f"SELECT p_partkey AS _id, p_type || ' ' || p_name AS label, {CANONICAL} AS path FROM part WHERE p_size % 10 <> 0 AND p_size >= 5",
)
def record_chain(spark, sf):
    stages = P.standard_chain((Merge(("p_type", "p_name"), "label", " "),), "/store/img")
    stages[P.without_favicons] = 3
    stages[partial(P.reject, condition=F.col("p_size") < 5)] = 0
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("_id"), "p_size")
    done = P.run_chain(_part_items(spark, sf).join(sizes, "_id"), stages)
    return done.select("_id", "label", F.col("images")[0]["path"].alias("path"))


@query("rejected_records", "SELECT p_partkey AS _id, p_name FROM part WHERE NOT (p_type = 'ECONOMY' OR p_name LIKE '%ring%')")
def rejected_records(spark, sf):
    bad = (F.col("p_type") == "ECONOMY") | F.col("p_name").contains("ring")
    return P.reject(_part_items(spark, sf), bad).select("_id", "p_name")


@query("favicon_records_removed", "SELECT p_partkey AS _id FROM part WHERE p_size % 10 <> 0")
def favicon_records_removed(spark, sf):
    return P.without_favicons(_part_items(spark, sf)).select("_id")


@query("items_per_job", "SELECT o_custkey AS job_id, count(*) AS items FROM orders GROUP BY o_custkey")
def items_per_job(spark, sf):
    return P.count_per_job(table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id")))


@query(
    "fields_through_pandas",
    f"SELECT page_id, array_to_string(list_transform({HREFS}, lambda x: replace({sql_unescape('x')}, 'e', 'E')), '|') AS links FROM pages",
)
def fields_through_pandas(spark, sf):
    @F.pandas_udf("string")
    def marked(values: pd.Series) -> pd.Series:
        return values.str.replace("e", "E", regex=False)

    spec = ItemSelector((KeyValueSelector("link", css("nav a::attr(href)")),))
    rows = Fd.field_rows(Fd.extract_fields(page_dom(spark, sf), spec), empty_pages=True).withColumn("value", marked("value"))
    joined = Fd.collect_fields(Fd.regroup_fields(rows), {"link": lambda v: F.array(F.array_join(v, "|"))})
    return joined.select("page_id", F.col("values")["link"][0].alias("links"))


@query(
    "crawled_customers",
    "SELECT DISTINCT c_custkey AS page_id, c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey",
)
def crawled_customers(spark, sf):
    pages = order_pages(spark, sf).unionByName(customer_pages(spark, sf))
    starts = order_pages(spark, sf).select("url")
    main = MainPage(UrlSelector("a.who", CSS), ItemSelector((KeyValueSelector("name", css("h1::text")),)))
    return Fd.to_wide(crawl(starts, main, pages), ["name"]).select("page_id", "name")


@query(
    "crawled_turns",
    f"SELECT page_id, CAST(pos AS INTEGER) AS pos, l[pos + 1] AS line, CASE WHEN pos = 0 THEN role END AS role FROM ({TURN_ITEMS})",
)
def crawled_turns(spark, sf):
    pages = turn_pages(spark, sf)
    starts = pages.filter(F.col("url").endswith("/0")).select("url")
    main = MainPage(None, TURN_SPEC, UrlSelector("a.next", CSS))
    return Fd.to_wide(crawl(starts, main, pages), ["line", "role"]).select("page_id", "pos", "line", "role")


@query("listed_pages_to_items", f"SELECT page_id, {TITLE} AS title FROM pages WHERE NOT contains(html, 'lang=\"de\"')")
def listed_pages_to_items(spark, sf):
    pages = captured(spark, sf)
    urls = pages.select(F.explode(F.array("url", F.concat("url", F.lit("&again=1")))).alias("url"))
    spec = ItemSelector((KeyValueSelector("title", css("title::text")),))
    items = crawl_list(urls, spec, pages, ~F.col("html").contains('lang="de"'))
    return Fd.to_wide(items, ["title"]).select("page_id", "title")


JOB_ITEMS = (
    "SELECT 'customer ' || o_orderkey AS job_name, 'http://shop.example.com/customer/' || c_custkey AS scraped_url, 0 AS pos, "
    "'name=' || c_name AS record FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL "
    "SELECT 'sheet ' || o_orderkey, 'http://shop.example.com/order/' || o_orderkey, row, "
    f"'Order=' || o_orderkey || '|line=' || field || ': ' || value FROM ({ORDER_CELLS}) UNION ALL "
    "SELECT 'chat ' || conv_id, 'http://chat.example.com/' || conv_id || '/' || turn, pos, "
    f"concat_ws('|', 'line=' || l[pos + 1], CASE WHEN pos = 0 THEN 'role=' || role END) FROM ({TURN_ITEMS}) UNION ALL "
    "SELECT 'customer ' || o_orderkey, 'http://shop.example.com/order/' || o_orderkey, 0, '' FROM orders UNION ALL "
    "SELECT 'sheet ' || o_orderkey, 'http://shop.example.com/order/' || o_orderkey, 0, '' FROM orders UNION ALL "
    "SELECT 'chat ' || conv_id, 'http://chat.example.com/' || conv_id || '/0', 0, '' FROM conversations WHERE turn = 0 UNION ALL "
    "SELECT 'gone', 'http://gone.example.com/', 0, ''"
)


@query(
    "jobs_of_several_specs",
    "SELECT job_name, CASE WHEN starts_with(job_name, 'c') AND NOT starts_with(job_name, 'ch') OR starts_with(job_name, 's') "
    "THEN 'selenium' ELSE 'scrapy' END AS job_type, scraped_url, CAST(pos AS INTEGER) AS pos, record "
    f"FROM ({JOB_ITEMS})",
)
def jobs_of_several_specs(spark, sf):
    """Jobs of three specs, one per order and conversation, and one whose site was never captured."""
    specs = [
        MainPage(UrlSelector("a.who", CSS), ItemSelector((KeyValueSelector("name", css("h1::text")),))),
        MainPage(
            None,
            ItemSelector(
                (KeyValueSelector("", TableSelector("table.lines", CSS, TABLE_VHEADERS)),),
                (Merge(("Field", "Value"), "line", ": "),),
            ),
        ),
        MainPage(None, TURN_SPEC, UrlSelector("a.next", CSS)),
    ]
    orders = order_pages(spark, sf).select("page_id", "url")
    firsts = turn_pages(spark, sf).filter(F.col("url").endswith("/0")).select((F.col("page_id") / 100000).cast("long").alias("page_id"), "url")

    def jobs(df, kind: str, spec: int, at: int):
        name = F.concat(F.lit(f"{kind} "), F.col("page_id"))
        return df.select((F.col("page_id") * 4 + at).alias("seq"), name.alias("job_name"), "url", F.lit(spec).alias("spec"))

    gone = spark.range(1).select(F.lit(3).cast("long").alias("seq"), F.lit("gone").alias("job_name"), F.lit("http://gone.example.com/").alias("url"), F.lit(0).alias("spec"))
    parts = [jobs(orders, "customer", 0, 0), jobs(orders, "sheet", 1, 1), jobs(firsts, "chat", 2, 2), gone]
    table_of_jobs = reduce(DataFrame.unionByName, parts)
    pages = reduce(DataFrame.unionByName, [order_pages(spark, sf), customer_pages(spark, sf), turn_pages(spark, sf)])
    params = site_params(spark, {"http://shop.example.com/": {"PREFERRED_SCRAPER": "selenium"}})
    items = run_job_table(table_of_jobs, specs, pages, params)
    parts_of = F.transform(F.map_entries("record"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return items.select("job_name", "job_type", "scraped_url", "pos", F.array_join(F.array_sort(parts_of), "|").alias("record"))
