"""Queries a viewer runs over item tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.text import contains_all_words, highlight

# Fixed value: what separates the column name from the words in a search.
QUERY_SEPARATOR = ": "


def header_text(name: str) -> str:
    return name[:1].upper() + name[1:].lower()


def _text_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string"]


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows whose named column holds all words, ignoring case.

    ``"Column: w1 w2"``; no separator or an unknown column leaves the table as it is, no words
    give every row. Columns are named by their header text; the image column is not searchable.
    """
    name, found, words = query.partition(QUERY_SEPARATOR)
    by_header = {header_text(c): c for c in df.columns if c != "images"}
    if not found or name not in by_header or not words:
        return df
    wanted = [w for w in re.split(r"\s+", words) if w]
    return df.filter(contains_all_words(F.col(f"`{by_header[name]}`").cast("string"), wanted))


def visible(df: DataFrame, query: str | None = None) -> DataFrame:
    """What an export sees: the rows the last search left, all if there was none."""
    return df if query is None else search(df, query)


def highlighted(df: DataFrame, text: str, colour: str = "red") -> DataFrame:
    """Mark every occurrence of ``text`` in every text cell."""
    columns = _text_columns(df)
    return df.withColumns({c: highlight(F.col(f"`{c}`"), text, colour) for c in columns})


def replace_all(df: DataFrame, before: str, after: str) -> DataFrame:
    """Literal, case-sensitive replacement in every text cell."""
    if not before or not after:
        raise ValueError("both texts must be non-empty")
    columns = _text_columns(df)
    return df.withColumns({c: F.replace(F.col(f"`{c}`"), F.lit(before), F.lit(after)) for c in columns})


def with_headers(df: DataFrame) -> DataFrame:
    """Columns under their header texts."""
    return df.select(*[F.col(f"`{c}`").alias(header_text(c)) for c in df.columns])


def order_columns(df: DataFrame) -> DataFrame:
    """Columns alphabetically, ignoring case, ``images`` first."""
    names = sorted(df.columns, key=lambda c: (c != "images", c.lower()))
    return df.select(*[F.col(f"`{c}`") for c in names])


def fill_missing(df: DataFrame) -> DataFrame:
    """Absent text cells as empty text."""
    return df.na.fill("", _text_columns(df))


def stringify(df: DataFrame) -> DataFrame:
    """Every scalar cell as text; image lists stay lists."""
    kept = {c for c, kind in df.dtypes if kind.startswith("array")}
    return df.select(*[F.col(f"`{c}`") if c in kept else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def image_paths(images: Column) -> Column:
    return F.transform(images, lambda i: i["path"])


def image_display(images: Column) -> Column:
    """How many images there are to show: ``none``, ``single`` or ``slideshow``."""
    n = F.coalesce(F.size(images), F.lit(0))
    return F.when(n <= 0, "none").when(n == 1, "single").otherwise("slideshow")


def view(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Item rows as the viewer lays them out: chosen keys, ordered, filled, as text."""
    chosen = df.select(*keys) if keys else df
    return fill_missing(stringify(order_columns(chosen)))
