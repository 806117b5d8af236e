"""Queries a viewer runs, and quality measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.text import header
from pageloom.operators import quality as Q
from pageloom.operators import views as V
from pageloom.workload.registry import query, table


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


@query("searched_rows", "SELECT doc_id, text, lang, source FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ha')")
def searched_rows(spark, sf):
    return V.search(_documents(spark, sf), "Text: THE ha")


@query("search_of_unknown_column", "SELECT doc_id, text, lang, source FROM documents")
def search_of_unknown_column(spark, sf):
    return V.search(_documents(spark, sf), "Body: the")


@query("visible_rows", "SELECT doc_id, lang FROM documents WHERE contains(lower(lang), 'e') AND contains(lower(source), 'src1')")
def visible_rows(spark, sf):
    return V.visible(V.visible(_documents(spark, sf), "Lang: E"), "Source: src1").select("doc_id", "lang")


@query(
    "highlighted_cells",
    "SELECT doc_id, replace(text, 'the', '<font color=''red''><bold>the</bold></font>') AS text, "
    "replace(source, 'the', '<font color=''red''><bold>the</bold></font>') AS source FROM documents",
)
def highlighted_cells(spark, sf):
    return V.highlighted(_documents(spark, sf).drop("lang"), " the ")


@query("replaced_cells", "SELECT doc_id, replace(text, 'de', 'DE') AS text, replace(lang, 'de', 'DE') AS lang, replace(source, 'de', 'DE') AS source FROM documents")
def replaced_cells(spark, sf):
    return V.replace_all(_documents(spark, sf), "de", "DE")


@query("header_texts", "SELECT p_partkey, upper(substring(p_type, 1, 1)) || lower(substring(p_type, 2)) AS kind, upper(substring(p_name, 1, 1)) || lower(substring(p_name, 2)) AS name FROM part")
def header_texts(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", header(F.col("p_type")).alias("kind"), header(F.col("p_name")).alias("name"))


@query("viewed_table", "SELECT CAST(c_custkey AS VARCHAR) AS \"C_custkey\", coalesce(CASE WHEN c_nationkey < 20 THEN c_name END, '') AS \"C_name\" FROM customer")
def viewed_table(spark, sf):
    customer = table(spark, sf, "customer")
    name = F.when(F.col("c_nationkey") < 20, F.col("c_name")).alias("c_name")
    return V.with_headers(V.view(customer.select(name, "c_custkey")))


@query("ordered_columns", "SELECT p_brand, p_name, p_partkey, p_size, p_type FROM part")
def ordered_columns(spark, sf):
    return V.order_columns(table(spark, sf, "part").drop("p_retailprice"))


@query("filled_cells", "SELECT p_partkey, coalesce(CASE WHEN p_size > 20 THEN p_brand END, '') AS p_brand FROM part")
def filled_cells(spark, sf):
    part = table(spark, sf, "part")
    return V.fill_missing(part.select("p_partkey", F.when(F.col("p_size") > 20, F.col("p_brand")).alias("p_brand")))


@query("stringified_cells", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM orders")
def stringified_cells(spark, sf):
    return V.stringify(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


@query(
    "image_paths_and_display",
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN '' WHEN p_size < 30 THEN p_brand ELSE p_brand || '|' || p_type END AS paths, "
    "CASE WHEN p_size < 10 THEN 'none' WHEN p_size < 30 THEN 'single' ELSE 'slideshow' END AS display FROM part",
)
def image_paths_and_display(spark, sf):
    image = lambda path: F.struct(F.lit("u").alias("url"), F.col(path).alias("path"))
    size = F.col("p_size")
    none = F.array().cast("array<struct<url:string,path:string>>")
    images = F.when(size < 10, none).when(size < 30, F.array(image("p_brand"))).otherwise(F.array(image("p_brand"), image("p_type")))
    part = table(spark, sf, "part").select("p_partkey", images.alias("images"))
    return part.select(
        "p_partkey",
        F.array_join(V.image_paths(F.col("images")), "|").alias("paths"),
        V.image_display(F.col("images")).alias("display"),
    )


def _gappy(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(size < 10, "").when(size > 40, F.lit(None)).otherwise(F.col("p_name")).alias("name"),
        F.when(size < 20, "").otherwise(F.col("p_brand")).alias("brand"),
        F.when(size < 5, 0).otherwise(size).alias("size"),
        F.col("p_type").alias("kind"),
    )


RATIO = "((p_size < 10)::INT + (p_size < 20)::INT + (p_size < 5 OR p_size = 0)::INT) / 4.0"


@query("missing_ratios", f"SELECT p_partkey, CAST({RATIO} AS DOUBLE) AS ratio FROM part")
def missing_ratios(spark, sf):
    items = _gappy(spark, sf)
    return items.select("p_partkey", Q.missing_ratio(items, ["name", "brand", "size", "kind"]).alias("ratio"))


@query("first_items", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20")
def first_items(spark, sf):
    return Q.first_items(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query(
    "first_items_per_job",
    "SELECT o_orderstatus, o_orderkey, item_no FROM (SELECT o_orderstatus, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS INTEGER) AS item_no FROM orders) WHERE item_no <= 20",
)
def first_items_per_job(spark, sf):
    return Q.first_items_per_job(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey")


@query(
    "extraction_verdicts",
    f"SELECT p_type AS kind, count(*) AS items, round(avg({RATIO}), 9) AS missing_ratio, avg({RATIO}) * 100 < 40 AS good_enough FROM part GROUP BY p_type",
)
def extraction_verdicts(spark, sf):
    done = Q.verdict(_gappy(spark, sf), ["name", "brand", "size", "kind"], by=["kind"])
    return done.withColumn("missing_ratio", F.round("missing_ratio", 9))
