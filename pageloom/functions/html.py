"""Writing values into HTML text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def escape(col: Column) -> Column:
    """Text as HTML content or attribute value."""
    out = col.cast("string")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def markup(*parts: str | Column) -> Column:
    """Concatenate literal markup and columns; columns are escaped."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else escape(p) for p in parts])
