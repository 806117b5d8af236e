"""Selection over shredded pages (columns ``page_id``, ``url``, ``nodes``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.text import content_pattern, words_pattern
from pageloom.model import REGEX, TEXT_TAG, WORDLIST, ContentSelector, FieldSelector
from pageloom.operators.selectors import (
    element_text,
    first_node,
    first_text,
    inside,
    is_element,
    select_nodes,
    select_values,
)


def _nodes() -> Column:
    return F.col("nodes")


def _keys(dom: DataFrame) -> list[str]:
    return [c for c in dom.columns if c != "nodes"]


def select(dom: DataFrame, selector: FieldSelector | str, region: FieldSelector | str | None = None) -> DataFrame:
    """One row per matching element (or text node), in document order by ``pre``."""
    picked, limit = with_region(dom, region)
    return picked.select(*_keys(dom), F.inline(select_nodes(_nodes(), selector, limit)))


def values(dom: DataFrame, selector: FieldSelector | str, region: FieldSelector | str | None = None) -> DataFrame:
    """One row per value of a projecting selector: ``pre``, ``value``."""
    picked, limit = with_region(dom, region)
    return picked.select(*_keys(dom), F.inline(select_values(_nodes(), selector, limit)))


def with_region(dom: DataFrame, region: FieldSelector | str | None) -> tuple[DataFrame, Column | None]:
    """The dom with the first match of ``region`` per page beside it."""
    if region is None:
        return dom, None
    return dom.withColumn("_region", first_node(_nodes(), region)), F.col("_region")


def restrict(dom: DataFrame, region: FieldSelector | str) -> DataFrame:
    """Elements within the first match of a region; a page without the region gives none."""
    picked, limit = with_region(dom, region)
    kept = F.filter(_nodes(), lambda n: is_element(n) & inside(n, limit))
    return picked.select(*_keys(dom), F.inline(kept)).drop("text")


def own_text(dom: DataFrame, selector: FieldSelector | str) -> DataFrame:
    """First stripped text of every selected element, ``''`` without text."""
    return _per_element(dom, selector, first_text, "text")


def full_text(dom: DataFrame, selector: FieldSelector | str) -> DataFrame:
    """Full text of every selected element."""
    return _per_element(dom, selector, element_text, "text")


def _per_element(dom: DataFrame, selector, make, name: str) -> DataFrame:
    found = F.transform(
        select_nodes(_nodes(), selector),
        lambda n: F.struct(n["pre"].alias("pre"), make(n, _nodes()).alias(name)),
    )
    return dom.select(*_keys(dom), F.inline(found))


def content_value(nodes: Column, region: Column, spec: ContentSelector) -> Column:
    """Text of the first element whose own first text matches from its start; ``''`` if none."""
    kinds = {REGEX: lambda s: s, WORDLIST: words_pattern}
    pattern = content_pattern(kinds[spec.selector.kind](spec.selector.selector))
    within = inside if spec.scope == "region" else (lambda n, r: r["pre"].isNotNull())

    def hit(node: Column) -> Column:
        # nth of a text node counts the texts of its parent: 1 is the parent's own first text
        first_own = (node["tag"] == TEXT_TAG) & (node["nth"] == 1) & (node["parent"] >= 0)
        return first_own & within(F.get(nodes, node["parent"]), region) & node["text"].rlike(pattern)

    hits = F.transform(F.filter(nodes, hit), lambda n: F.struct(n["parent"].alias("parent"), n["text"].alias("text")))
    return F.coalesce(F.array_min(hits)["text"], F.lit(""))


def content_search(dom: DataFrame, spec: ContentSelector) -> DataFrame:
    """One value per page holding the region; pages without it give no row."""
    picked, region = with_region(dom, spec.restrict)
    return picked.filter(region.isNotNull()).select(
        *_keys(dom), content_value(_nodes(), region, spec).alias("value")
    )


def texts_starting_with(df: DataFrame, column: str, words: str) -> DataFrame:
    """The word-list search over a plain text column."""
    return df.filter(F.col(column).rlike(content_pattern(words_pattern(words))))
