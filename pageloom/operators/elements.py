"""From pages to selectors: signatures, groups, uniqueness, forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.binding import bind
from pageloom.functions.text import strip
from pageloom.model import TEXT_TAG, FieldSelector
from pageloom.operators.selectors import Path, first_node, is_element, paths, picked, select_nodes, subtree

FORM_TAGS = ("input", "select", "textarea", "button")
# Control types a form inventory leaves out.
UNWANTED_INPUTS = ("submit", "hidden")


def _keep(dom: DataFrame) -> list[str]:
    return [c for c in dom.columns if c != "nodes"]


def signature(tag: Column, elem_id: Column, classes: Column) -> Column:
    """``tag#id`` if there is an id, else ``tag.class1.class2``."""
    with_id = F.concat(tag, F.lit("#"), elem_id)
    return F.when(F.coalesce(elem_id, F.lit("")) != "", with_id).otherwise(
        F.concat_ws(".", F.array(tag), classes)
    )


def node_signature(node: Column) -> Column:
    return signature(node["tag"], node["id"], node["classes"])


def signatures(dom: DataFrame) -> DataFrame:
    """Every element's signature: ``pre, tag, signature``."""
    found = F.transform(
        F.filter("nodes", is_element),
        lambda n: F.struct(n["pre"].alias("pre"), n["tag"].alias("tag"), node_signature(n).alias("signature")),
    )
    return dom.select(*_keep(dom), F.inline(found))


def all_similar(dom: DataFrame, selector: FieldSelector | str) -> DataFrame:
    """Per page with matches: whether they all have the same tag, id and classes."""
    shapes = F.transform(
        select_nodes(F.col("nodes"), selector),
        lambda n: F.struct(n["tag"], F.coalesce(n["id"], F.lit("")), F.array_sort(n["classes"])),
    )
    kinds = dom.select(*_keep(dom), F.size(F.array_distinct(shapes)).alias("_kinds"))
    return kinds.filter("_kinds > 0").select(*_keep(dom), (F.col("_kinds") == 1).alias("all_similar"))


def first_child_with_text(dom: DataFrame, selector: FieldSelector | str) -> DataFrame:
    """For each selected element, its first child whose text, subtree included, is not blank."""
    nodes = F.col("nodes")

    def child(node: Column) -> Column:
        deep = F.filter(
            subtree(node, nodes),
            lambda t: (t["tag"] == TEXT_TAG) & (t["parent"] != node["pre"]) & (strip(t["text"]) != ""),
        )
        children = F.filter(subtree(node, nodes), lambda c: c["parent"] == node["pre"])
        # the first child that does not end before the text holds it
        holds = lambda t: F.get(F.filter(children, lambda c: c["last"] >= t["pre"]), 0)["pre"]
        return bind(F.get(deep, 0), lambda t: F.when(t.isNotNull(), holds(t)))

    def row(node: Column) -> Column:
        return bind(
            child(node),
            lambda at: F.struct(node["pre"].alias("pre"), at.alias("child_pre"), F.get(nodes, at)["tag"].alias("child_tag")),
        )

    rows = dom.select(*_keep(dom), F.inline(F.transform(select_nodes(nodes, selector), row)))
    return rows.filter(F.col("child_pre").isNotNull())


def edited_matches(dom: DataFrame, added: list[FieldSelector | str], removed: list[FieldSelector | str]) -> DataFrame:
    """Elements any of ``added`` selects and none of ``removed`` does, in one pass: ``pre, tag``."""
    nodes = F.col("nodes")

    def elements_of(selectors: list) -> Column:
        return picked(nodes, [Path(path.steps) for s in selectors for path in paths(s)])

    wanted = elements_of(added) if added else F.array().cast("array<int>")
    wanted = F.array_except(wanted, elements_of(removed)) if removed else wanted
    narrow = F.transform(wanted, lambda i: F.struct(i.alias("pre"), F.get(nodes, i)["tag"].alias("tag")))
    return dom.select(*_keep(dom), F.inline(narrow))


def add_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two stored match sets, each element once."""
    keys = ["page_id", "pre"]
    return left.select(*keys).unionByName(right.select(*keys)).distinct()


def remove_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """A stored match set without the elements of another."""
    keys = ["page_id", "pre"]
    return left.select(*keys).join(right.select(*keys), keys, "left_anti")


def add_selector(union: str, selector: str) -> str:
    """A selector added to a CSS union, once."""
    members = [m.strip() for m in union.split(",") if m.strip()]
    return ", ".join(members if selector.strip() in members else [*members, selector.strip()])


def remove_selector(union: str, selector: str) -> str:
    """A selector removed from a CSS union."""
    return ", ".join(m for m in (p.strip() for p in union.split(",")) if m and m != selector.strip())


def attributes(dom: DataFrame, selector: FieldSelector | str | None = None) -> DataFrame:
    """Name/value pairs of the selected elements' attributes."""
    picked = F.filter("nodes", is_element) if selector is None else select_nodes(F.col("nodes"), selector)
    rows = dom.select(*_keep(dom), F.inline(picked))
    return rows.select(*_keep(dom), "pre", "tag", F.explode("attrs").alias("name", "value"))


def form_fields(dom: DataFrame) -> DataFrame:
    """Controls of the first form of each page: ``name, value, type``.

    No submit buttons and no hidden inputs; the last control of a name counts.
    """
    nodes = F.col("nodes")
    form = first_node(nodes, "form")
    prepared = dom.withColumn("_form", form)
    body = F.slice(nodes, F.col("_form.pre") + 2, F.col("_form.last") - F.col("_form.pre"))

    def kind(n: Column) -> Column:
        declared = F.lower(n["attrs"]["type"])
        return (
            F.when(n["tag"] == "input", F.coalesce(declared, F.lit("text")))
            .when(n["tag"] == "button", F.coalesce(declared, F.lit("submit")))
            .otherwise(n["tag"])
        )

    def option_value(option: Column) -> Column:
        label = F.get(F.filter(subtree(option, nodes), lambda t: t["tag"] == TEXT_TAG), 0)["text"]
        return F.coalesce(option["attrs"]["value"], strip(label))

    def value(n: Column) -> Column:
        options = F.filter(subtree(n, nodes), lambda o: o["tag"] == "option")
        chosen = F.get(F.filter(options, lambda o: o["attrs"]["selected"].isNotNull()), 0)
        picked = F.coalesce(option_value(chosen), option_value(F.get(options, 0)))
        typed = F.get(F.filter(subtree(n, nodes), lambda t: t["tag"] == TEXT_TAG), 0)["text"]
        raw = F.when(n["tag"] == "select", picked).when(n["tag"] == "textarea", typed).otherwise(n["attrs"]["value"])
        return F.coalesce(raw, F.lit(""))

    controls = F.transform(
        F.filter(body, lambda n: n["tag"].isin(*FORM_TAGS) & ~kind(n).isin(*UNWANTED_INPUTS)),
        lambda n: F.struct(
            F.coalesce(n["attrs"]["name"], F.lit("")).alias("name"), value(n).alias("value"), kind(n).alias("type")
        ),
    )
    listed = prepared.filter(F.col("_form").isNotNull()).select(*_keep(dom), controls.alias("_c"))
    later = lambda i: F.slice(F.col("_c"), i + 2, F.size("_c"))
    last = F.filter("_c", lambda c, i: ~F.exists(later(i), lambda o: o["name"] == c["name"]))
    return listed.select(*_keep(dom), F.inline(last))
