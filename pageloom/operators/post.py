"""The ordered chain of record transforms after extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.urls import join_path, norm_path
from pageloom.model import Merge

Stage = Callable[[DataFrame], DataFrame]

# The order in which the stock stages run.
STAGE_ORDER = {"merge": 1, "images": 2, "drop_fields": 100, "image_paths": 101, "push": 1000}


def merge(df: DataFrame, names: Iterable[str], out: str, sep: str = "") -> DataFrame:
    """Join columns in order into ``out`` and remove them; missing values are skipped."""
    names = list(names)
    merged = F.concat_ws(sep, *[F.col(f"`{n}`").cast("string") for n in names])
    return df.withColumn("_merged", merged).drop(*names).withColumnRenamed("_merged", out)


def post_process(df: DataFrame, actions: Iterable[Merge]) -> DataFrame:
    """Apply the merges of an item spec in order."""
    return reduce(lambda acc, a: merge(acc, a.names, a.output, a.sep), actions, df)


def drop_helpers(df: DataFrame, viewer: bool = False) -> DataFrame:
    """Remove helper columns; the viewer also has no use for the job id."""
    return df.drop("image_urls", "_postinfo", *(("_id", "job_id") if viewer else ()))


def canonical_path(path: Column, root: str) -> Column:
    """Normalised image path, put below the store root unless it already names it."""
    normal = norm_path(path)
    store = _norm_root(root)
    return F.when(F.contains(normal, F.lit(store)), normal).otherwise(join_path(store, normal))


def _norm_root(root: str) -> str:
    parts = [p for p in root.split("/") if p not in ("", ".")]
    return ("/" if root.startswith("/") else "") + "/".join(parts)


def canonical_paths(df: DataFrame, root: str, images: str = "images") -> DataFrame:
    """Canonical paths in an ``array<struct<url, path>>`` column."""
    return df.withColumn(
        images, F.transform(images, lambda i: F.struct(i["url"].alias("url"), canonical_path(i["path"], root).alias("path")))
    )


def reject(df: DataFrame, condition: Column) -> DataFrame:
    """A stage that drops records; later stages never see them. NULL does not reject."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def run_chain(df: DataFrame, stages: dict[Stage, int] | dict[str, tuple[int, Stage]]) -> DataFrame:
    """Fold records through the stages in ascending order of their number."""
    if all(callable(k) for k in stages):
        ordered = sorted(stages, key=stages.get)
    else:
        ordered = [stage for _, stage in sorted(stages.values(), key=lambda s: s[0])]
    return reduce(DataFrame.transform, ordered, df)


def standard_chain(actions: Iterable[Merge] = (), images_root: str | None = None) -> dict[Stage, int]:
    """The stock stages with their fixed numbers."""
    stages: dict[Stage, int] = {
        partial(post_process, actions=tuple(actions)): STAGE_ORDER["merge"],
        drop_helpers: STAGE_ORDER["drop_fields"],
    }
    if images_root:
        stages[partial(canonical_paths, root=images_root)] = STAGE_ORDER["image_paths"]
    return stages


def without_favicons(df: DataFrame, images: str = "images") -> DataFrame:
    """Drop records whose only image is a favicon."""
    only = (F.size(images) == 1) & F.contains(F.get(images, 0)["url"], F.lit("favicon.ico"))
    return df.filter(~F.coalesce(only, F.lit(False)))


def count_per_job(df: DataFrame, job: str = "job_id") -> DataFrame:
    """Items received per job, folded map-side."""
    return df.groupBy(job).agg(F.count("*").alias("items"))
