"""Registered queries of the numbered operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm.chat import format_chat, read_loss, read_turns, text_parts
from pageloom.llm.clusters import cluster
from pageloom.llm.decontaminate import contaminated
from pageloom.llm.disclosure import KINDS, base_spans, listed, personal_spans, spans_of_kind
from pageloom.llm.importance import resample
from pageloom.llm.lm_score import score
from pageloom.llm.near import near_duplicates
from pageloom.llm.packing import pack_documents
from pageloom.llm.quality import judge
from pageloom.llm.shards import shard_documents
from pageloom.llm.substrings import dedup_substrings
from pageloom.llm.toxicity import THRESHOLD, fit_tagger, score_toxicity
from pageloom.llm.warc import capture_history
from pageloom.plans.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(
    "op8_substring_dedup",
    rf"""
    WITH docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    wins AS (
        SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs)
    ),
    later AS (
        SELECT doc_id, s FROM (
            SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM wins
        ) WHERE n > 1
    ),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
    lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
    kept AS (
        SELECT d.doc_id, len(w) AS n, len(coalesce(g, [])) AS r, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k
        FROM docs d LEFT JOIN lists l USING (doc_id)
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed,
        sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
    FROM kept
    """,
)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of later repeats of 20-word windows removed from every document."""
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_probminhash")
def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_crf_toxicity")
def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and offending spans of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_tagger(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 4 = 2"), F.lit(True))
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "spans",
    )


@query("op3_templates")
def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, verbatim or with other numbers, names and units."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_sum_of_squares")
def op6_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_risk_controlled_rules")
def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with cutoffs per language from the labels."""
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op10_stratified_interleaving")
def op10_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of the same mixture of sources."""
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    "op1_index_merge",
    """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
    ),
    f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
    SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
        CASE WHEN p.page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN p.page_id > first THEN first END AS refers_to
    FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
    """,
)
def op1_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back from the merged capture history."""
    history = capture_history(table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_cross_entropy_difference")
def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every document under models of the documents labelled good and of all others."""
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return score(table(spark, sf_dir, "documents"), good)


def _marks(text: str) -> str:
    """How many characters escaping adds to a text, as SQL."""
    strings = ("\\", "<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
    return " + ".join(f"(length({text}) - length(replace({text}, '{s}', ''))) // {len(s)}" for s in strings)


@query(
    "op4_typed_parts",
    f"""
    WITH t AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn, role, x)) AS turns_sha256,
        CAST(coalesce(sum(length(x)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(x, '' ORDER BY turn, role, x) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length(role) + length(x) + 17 + {_marks('x')}) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
    """,
)
def op4_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what reading the output gives back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    turns = turns.unionByName(more)
    out = format_chat(turns.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    read = out.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op11_importance_resampling")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, noisy score and rank of every document in a draw that resembles the benchmark."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_disclosure")
def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and terms that give it away."""
    found = personal_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(spans_of_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(base_spans(F.col("spans"))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain rounds over all distances; a distance and a number in one integer, so ties go to the smaller number."""
    distance = "list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v "
        "FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM "
        f"(SELECT v, sha256('2:' || vec_id) AS h FROM v) ORDER BY h, v LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({distance} * {k} + c) AS m FROM v, c{r} GROUP BY vec_id)"
        )
        if r < rounds:
            steps.append(
                f"n{r} AS MATERIALIZED (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS w FROM (SELECT m % {k} AS c, i, "
                f"CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT m, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY c)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.w, o.w) AS w FROM c{r} o LEFT JOIN n{r} n USING (c))")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(m // {k} AS BIGINT) AS distance, "
        f"CAST(sum(m // {k}) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = m % {k}"
    )


@query("op13_pca_filtered_clusters", _clusters_sql())
def op13_pca_filtered_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact clusters of all embeddings."""
    return cluster(table(spark, sf_dir, "embeddings"))
