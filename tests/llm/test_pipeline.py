"""Every stage against brute force on its own input; odd rows through all stages."""

import re

import pytest

import corpus_pipeline
from pageloom.llm.toxicity import fit_tagger, score_toxicity

from .test_near import brute as brute_classes
from .test_packing import check as check_packing
from .test_substrings import brute as brute_substrings

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage_keeps_most_of_a_corpus(outputs):
    """Nothing below compares empty with empty."""
    counts = {name: len({r.doc_id for r in df.select("doc_id").collect()}) for name, df in outputs.items()}
    assert 0.95 * counts["documents"] <= counts["toxicity"] < counts["documents"]
    assert 0.9 * counts["toxicity"] <= counts["near_dedup"] < counts["toxicity"]
    assert 0.95 * counts["near_dedup"] <= counts["substring_dedup"] <= counts["near_dedup"]
    assert 0.95 * counts["substring_dedup"] <= counts["decontamination"] < counts["substring_dedup"]
    assert counts["packing"] == counts["decontamination"]


def test_columns(outputs):
    names = list(outputs)
    for name in names[:-1]:
        assert outputs[name].dtypes == outputs["documents"].dtypes


def test_toxicity(spark, outputs):
    docs = outputs["documents"]
    scores = score_toxicity(docs, fit_tagger(docs, spark.read.parquet(f"{SMALL}/labels.parquet")))
    assert set(texts(outputs["toxicity"])) == {r.doc_id for r in scores.filter("score < 0.3").collect()}


def test_near_dedup(outputs):
    before = texts(outputs["toxicity"])
    assert texts(outputs["near_dedup"]) == {
        i: before[i] for i, c in brute_classes(list(before.items())).items() if i == c
    }


def test_substring_dedup(outputs):
    before = texts(outputs["near_dedup"])
    want = {i: kept for i, n, gone, kept in brute_substrings(list(before.items()), 20) if not n or gone < n}
    got = {i: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts(outputs["substring_dedup"]).items()}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in outputs["substring_dedup"].collect() if r.text != before[r.doc_id])


def test_decontamination(spark, outputs):
    def plain(text):
        return " " + " ".join(w for w in (re.sub(r"\W+", "", x).lower() for x in (text or "").split()) if w) + " "

    items = [plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = texts(outputs["substring_dedup"]), texts(outputs["decontamination"])
    leaky = {i for i, t in before.items() if any(x in plain(t) for x in items)}
    assert not leaky & set(after) and set(after) <= set(before)
    assert len(before) - len(after) <= len(leaky) + 2  # partly covered items


def test_packing(outputs):
    docs = [(r.doc_id, r.text) for r in outputs["decontamination"].collect()]
    check_packing(outputs["packing"].collect(), docs, 2048)


def test_odd_rows(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None), (2, ""), (2, ""), (3, "short"), (4, passage), (5, passage), (None, "no id " + passage), (6, "x " * 30_000)]
    docs = spark.createDataFrame(
        [(i, t, None, "s", len(t or ""), 1, "k") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, id int, key string",
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {None, 1, 2, 3, 6} <= kept
    assert not {4, 5} & kept  # the row without an id comes first and holds the passage


def test_stages_bound_arrow_batches(spark):
    """A stage called on a session nobody configured still bounds the bytes of a batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    own = spark.conf.get(name)
    try:
        for stage in (dict(corpus_pipeline.STAGES)[k] for k in ("decontamination", "packing")):
            spark.conf.unset(name)
            stage(spark, docs, SMALL)
            assert spark.conf.get(name) == own
    finally:
        spark.conf.set(name, own)
