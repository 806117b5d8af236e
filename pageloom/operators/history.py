"""Ordered histories: captures over time, recorded actions, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.model import GROWTH_THRESHOLD, LOG_LABELS
from pageloom.plans.joins import lookup_join
from pageloom.plans.session import materialise
from pageloom.plans.slices import queue_survivors, with_context

# Fixed value: column widths of a rendered selection.
FIELD_WIDTH, SELECTOR_WIDTH = 20, 35


def with_previous_size(
    captures: DataFrame, key: str, order: list[str], size: str, slice_: Column | None = None
) -> DataFrame:
    """Size of the capture before, per page."""
    return with_context(captures, [key], order, slice_, before={size: "previous"})


def grew(
    captures: DataFrame,
    key: str,
    order: list[str],
    size: str,
    threshold: float = GROWTH_THRESHOLD,
    slice_: Column | None = None,
) -> DataFrame:
    """Captures more than ``threshold`` larger than the one before: new content."""
    paired = with_previous_size(captures, key, order, size, slice_)
    return paired.filter(F.col(size) - F.col("previous") > threshold)


def changed(captures: DataFrame, key: str, order: list[str], size: str, slice_: Column | None = None) -> DataFrame:
    """Captures whose size differs at all from the one before."""
    return with_previous_size(captures, key, order, size, slice_).filter(F.col(size) != F.col("previous"))


def last_action(actions: DataFrame, field: str = "field", order: str = "seq") -> DataFrame:
    """Fields whose last action is an addition, with its selector; an aggregate, no ordered window."""
    last = actions.groupBy(field).agg(F.max_by(F.struct("is_add", "selector", order), order).alias("_last"))
    return last.filter("_last.is_add").select(field, "_last.selector", f"_last.{order}")


def current_selectors(actions: DataFrame) -> DataFrame:
    """Active selectors per field: ``field, selector, seq``.

    Removing a text field clears it, so what counts are additions after its last removal; image
    selectors share the field ``Images`` and are removed one by one.
    """
    image = F.col("kind") == "image"
    keyed = actions.withColumn("field", F.when(image, "Images").otherwise(F.col("field")))
    seq_if = lambda cond: F.max(F.when(cond, F.col("seq")))
    # three readers follow; stored, the actions are scanned and folded once
    folded = materialise(
        keyed.groupBy("field", "selector", image.alias("is_image")).agg(
            seq_if(F.col("is_add")).alias("added"), seq_if(~F.col("is_add")).alias("removed")
        )
    )
    images = folded.filter("is_image").withColumn("gone", F.col("removed"))
    fields = folded.filter(~F.col("is_image"))
    cleared = fields.groupBy("field").agg(F.max("removed").alias("gone"))
    both = images.unionByName(lookup_join(fields, cleared, "field").select(*images.columns))
    active = F.col("added").isNotNull() & (F.col("gone").isNull() | (F.col("added") > F.col("gone")))
    return both.filter(active).select("field", "selector", F.col("added").alias("seq"))


def label(action: Column) -> Column:
    """Text of an action code."""
    text = F.lit(None).cast("string")
    for code, name in LOG_LABELS.items():
        text = F.when(action == code, name).otherwise(text)
    return text


def _padded(col: Column, width: int, left: bool) -> Column:
    pad = F.lpad if left else F.rpad
    return F.when(F.char_length(col) < width, pad(col, width, " ")).otherwise(col)


def selection_text(field: Column, selector: Column) -> Column:
    """``field <> selector`` in fixed widths."""
    return F.concat(
        _padded(field, FIELD_WIDTH, False), F.lit(" <> "), _padded(selector, SELECTOR_WIDTH, True)
    )


def surviving(actions: DataFrame, keys: list[str], order: str = "seq", slice_: Column | None = None) -> DataFrame:
    """Additions left after all removals, where a removal takes the oldest row of its selector.

    A removal of a selector that has no row does nothing.
    """
    return queue_survivors(actions, keys, [order], slice_, F.col("is_add"))


def render_log(actions: DataFrame, keys: list[str], order: str = "seq", slice_: Column | None = None) -> DataFrame:
    """The action log as shown: surviving rows with their label and value."""
    rows = surviving(actions, keys, order, slice_)
    value = F.when(F.col("field").isNotNull(), selection_text(F.col("field"), F.col("selector"))).otherwise(F.col("selector"))
    return rows.select(*[k for k in keys if k != "selector"], order, label(F.col("action")).alias("label"), value.alias("value"))


def trail(visits: DataFrame, session: list[str], order: str = "seq", slice_: Column | None = None) -> DataFrame:
    """Steps to the first item page; a form takes the place and the URL of the step before it.

    ``visits`` has ``kind`` (``url``, ``form`` or ``item``) and ``url``.
    """
    known = with_context(
        visits,
        session,
        [order],
        slice_,
        before={"url": "_last_url"},
        after={"kind": "_next_kind"},
        lowest={"_stop": F.when(F.col("kind") == "item", F.col(order))},
    )
    # the step after the last one walked is the item page, which is no form
    walked = F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))
    kept = known.filter(walked & F.coalesce(F.col("_next_kind") != "form", F.lit(True)))
    url = F.when(F.col("kind") == "form", F.coalesce("_last_url", "url")).otherwise(F.col("url"))
    return kept.withColumn("url", url).select(*visits.columns)
