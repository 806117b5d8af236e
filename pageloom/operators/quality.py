"""How complete extracted items are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.model import MISSING_PERCENT_LIMIT, SAMPLE_ITEMS


def missing_ratio(df: DataFrame, fields: list[str], count_absent: bool = False) -> Column:
    """Share of the declared fields whose value is present but empty.

    Empty means ``''``, an empty list or zero. An absent field (NULL) only enlarges the divisor,
    unless ``count_absent``.
    """
    kinds = dict(df.dtypes)

    def empty(name: str) -> Column:
        col, kind = F.col(f"`{name}`"), kinds[name]
        cond = col == "" if kind == "string" else F.size(col) == 0 if kind.startswith(("array", "map")) else col == 0
        return F.coalesce(cond & col.isNotNull(), F.lit(False)) | (col.isNull() if count_absent else F.lit(False))

    return reduce(lambda a, b: a + b, [empty(f).cast("int") for f in fields]) / F.lit(len(fields))


def first_items(df: DataFrame, order: str, n: int = SAMPLE_ITEMS) -> DataFrame:
    """The first items of a trial: every partition keeps its own first ``n`` before they meet."""
    return df.orderBy(order).limit(n)


def first_items_per_job(df: DataFrame, job: str, order: str, n: int = SAMPLE_ITEMS) -> DataFrame:
    """The first items of every job; Spark trims each group map-side before the shuffle."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(job).orderBy(order))
    return df.withColumn("item_no", number).filter(F.col("item_no") <= n)


def verdict(items: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean missing ratio and whether cheap extraction is good enough; NULL without items."""
    scored = items.withColumn("_ratio", missing_ratio(items, fields))
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("items"),
        F.avg("_ratio").alias("missing_ratio"),
        (F.avg("_ratio") * 100 < MISSING_PERCENT_LIMIT).alias("good_enough"),
    )
