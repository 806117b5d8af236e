"""A training corpus from raw documents: five stages, each written and read again by the next.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and works on all rows of
``docs``, with the columns of ``documents`` (others are carried along). All but the last return those columns.
Null and empty texts are clean and pass every filter; rows sharing an id are one document and stay or go
together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm.decontaminate import contaminated
from pageloom.llm.near import near_duplicates
from pageloom.llm.packing import pack_documents
from pageloom.llm.substrings import dedup_substrings, small
from pageloom.llm.toxicity import fit_tagger, without_toxic
from pageloom.plans.session import configure, fresh_path, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` ``(gone)``; null is an id too."""
    gone = small(materialise(ids.select("gone").distinct()))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, fitted on the labelled ones among them, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, fit_tagger(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates."""
    classes = near_duplicates(docs)
    later = classes.filter("doc_id IS NOT NULL AND NOT doc_id <=> class_id")
    return _without(docs, later.select(F.col("doc_id").alias("gone")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of later repeats; a document of which no word is left goes."""
    rest = dedup_substrings(docs, joined=False, carry=tuple(c for c in docs.columns if c != "text"))
    left = rest.filter("n_words = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    columns = {
        "text": F.col("kept_text"),
        "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars")),
    }
    return left.select(*(columns.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, contaminated(docs, benchmark).select(F.col("doc_id").alias("gone")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _configured(stage: Stage) -> Stage:
    """``stage`` under the session settings it relies on (Arrow batches bounded by bytes), whoever calls it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _configured(toxicity)),
    ("near_dedup", _configured(near_dedup)),
    ("substring_dedup", _configured(substring_dedup)),
    ("decontamination", _configured(decontamination)),
    ("packing", _configured(packing)),
]

#: SQL can express neither the tagger nor the sketches nor the packing; tests/llm/test_pipeline.py compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
