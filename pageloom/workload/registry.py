"""The query registry and the inputs queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.functions.html import markup
from pageloom.operators.shred import shred
from pageloom.plans.session import configure, spread
from pageloom.sources.pages import pages_for_shredding

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# A row of a table is a few bytes on disk and a page of many nodes here: pages made by one task.
TASK_PAGES = 50_000


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the equivalent SQL."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_for_shredding(spark, f"{sf_dir}/pages.parquet")


def page_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(captured(spark, sf_dir))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product page per part: title, image, keys-left table, dynamic key, two forms."""
    part = spread(table(spark, sf_dir, "part"), "p_partkey", TASK_PAGES)
    c = F.col
    key = F.when(c("p_size") % 7 == 0, F.lit("")).otherwise(
        markup('<span class="key">Key ', c("p_size") % 5, "</span>")
    )
    html = F.concat(
        markup('<html><head><title>', c("p_name"), '</title></head><body><h1 id="title">', c("p_name"), "</h1>"),
        markup('<div class="gallery"><a class="zoom" href="/part/', c("p_partkey")),
        markup('"><img class="photo" src="/img/', c("p_partkey"), '.png"></a>'),
        markup('<a class="full" onclick="FillFullSize(1, http://img.example.com/', c("p_partkey"), '.jpg , 3)">big</a></div>'),
        markup('<table id="specs" class="wide props"><tr><td colspan="2">Specs</td></tr><tr><td>Brand:</td><td> <b>'),
        markup(c("p_brand"), "</b> <i>ok</i></td><td>Type:</td><td>", c("p_type"), "</td></tr>"),
        markup("<tr><td>Size:</td><td>", c("p_size"), "</td><td>Note:</td></tr><tr><td></td><td>none</td></tr></table>"),
        key,
        markup('<span class="val">', c("p_type"), '</span><form action="/find"><input name="q" value="', c("p_name")),
        markup('"><input type="hidden" name="h" value="1"><select name="brand"><option value="any">any'),
        markup('<option selected value="', c("p_brand"), '">one</select><input type="submit" name="go"></form>'),
        markup('<form><input name="other"></form></body></html>'),
    )
    url = F.concat(F.lit("http://shop.example.com/part/"), c("p_partkey"))
    return part.select(c("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order holding a keys-top table with two overlapping row spans, and a link."""
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey", TASK_PAGES)
    c = F.col
    html = F.concat(
        markup('<div class="order"><a class="who" href="/customer/', c("o_custkey"), '">customer</a>'),
        markup('<table class="lines"><tr><td>Order sheet</td></tr><tr><th>Order</th><th>Field</th><th>Value</th></tr>'),
        markup('<tr><td rowspan="3">', c("o_orderkey"), "</td><td>status</td><td>", c("o_orderstatus"), "</td></tr>"),
        markup('<tr><td>priority</td><td rowspan="2">', c("o_orderpriority"), "</td></tr><tr><td>urgency</td></tr>"),
        markup("</table></div>"),
    )
    url = F.concat(F.lit("http://shop.example.com/order/"), c("o_orderkey"))
    return orders.select(c("o_orderkey").alias("page_id"), url.alias("url"), html.alias("html"))


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured customer pages, as link targets."""
    c = F.col
    url = F.concat(F.lit("http://shop.example.com/customer/"), c("c_custkey"))
    html = markup("<h1>", c("c_name"), "</h1>")
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("page_id"), url.alias("url"), html.alias("html"))


def turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per conversation turn: its text lines as a list, its role, a link to the next turn."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id")
    c = F.col
    lines = F.transform(F.split("text", "\n"), lambda line: markup('<li class="line">', line, "</li>"))
    html = F.concat(
        F.lit("<ul>"),
        F.array_join(lines, ""),
        markup('</ul><p class="who">', c("role"), '</p><img src="face.png"><a class="next" href="/'),
        markup(c("conv_id"), "/", c("turn") + 1, '">next</a>'),
    )
    url = F.concat_ws("/", F.lit("http://chat.example.com"), c("conv_id"), c("turn"))
    page_id = c("conv_id") * 100000 + c("turn")
    return turns.select(page_id.alias("page_id"), url.alias("url"), html.alias("html"))


def sql_unescape(expr: str) -> str:
    """Entity decoding in oracle SQL; as in HTML, these references also count without a semicolon."""
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        expr = f"regexp_replace({expr}, '&{name};?', '{char}', 'g')"
    return expr


def sql_strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def sql_absolute(href: str, url: str) -> str:
    """Link resolution in oracle SQL for hrefs without dot segments."""
    root = f"regexp_extract({url}, '^([^:/?#]+://[^/?#]*)', 1)"
    return (
        f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} "
        f"WHEN starts_with({href}, '//') THEN regexp_extract({url}, '^([^:/?#]+:)', 1) || {href} "
        f"WHEN {href} = '' OR starts_with({href}, '/') OR starts_with({href}, '?') OR starts_with({href}, '#') "
        f"THEN {root} || {href} ELSE {root} || '/' || {href} END"
    )
