"""Quality rules with cutoffs that provably reject few good documents.

Every document is measured (whole text), and each *rule* rejects documents whose measure lies above a
cutoff of its stratum. Cutoffs come from labelled good documents that pass the base rules, in two halves by
``crc32`` of the id:

1. The first half proposes a path: at step ``j`` every rule's cutoff is the least level that leaves at most a
   share ``PATH[j]`` of it above.
2. The second half tests the path, from lenient to strict: a step passes if the exact (Clopper-Pearson) upper
   bound of the share that any rule rejects, at confidence ``1 - DELTA / strata``, is at most ``ALPHA``. Testing
   stops at the first step that fails (fixed sequence), and strata share the error probability (Bonferroni), so
   with probability ``1 - DELTA`` no stratum rejects more than ``ALPHA`` of its good documents.

A stratum without a passing step has too few labels for any promise, and rejects nothing. Counts, paths and chosen
cutoffs are tables with a row per stratum (and rule and level), which documents meet by a join, so a dirty stratum
column makes longer tables, not longer plans; the driver sees the number of strata only.
An id is one trial however many rows share it, and so are equal texts: copies are no
independent trials. The promise is about good documents that pass the base rules.

Defined results: a null text has no words; a null stratum is one of its own; rows sharing an id are measured
each by itself, and the one with the largest counts stands for the id as a trial.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.llm.substrings import small
from pageloom.llm.words import Words, hash_ranges, pieces, windows
from pageloom.plans.session import materialise, materialise_counted

ALPHA, DELTA = 0.02, 0.05
PATH = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.008)
LEVELS = 1000
SYMBOLS = b"#*$%&|<>"

_KIND = {name: np.zeros(256, bool) for name in ("symbol", "upper", "mark", "lead")}
_KIND["symbol"][list(SYMBOLS)] = True
_KIND["upper"][65:91] = True
_KIND["mark"][list(b"!?")] = True
_KIND["lead"][:] = (np.arange(256) & 0xC0) != 0x80
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether its text has it more than once; whether an earlier place of the text has it."""
    order = np.lexsort((np.arange(len(value)), value, owner))
    same = (np.diff(owner[order]) == 0) & (value[order][1:] == value[order][:-1])
    later = np.append(False, same) if len(value) else np.zeros(0, bool)
    some = later.copy()
    some[:-1] |= same
    out = np.empty((2, len(value)), bool)
    out[0, order], out[1, order] = some, later
    return out[0], out[1]


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word and repeated lines of each text."""
    n = len(w.data)
    breaks = np.flatnonzero(w.data == 10)
    starts = np.unique(np.concatenate([w.offsets[:-1][np.diff(w.offsets) > 0], breaks + 1]))
    starts = starts[starts < n]
    text = np.searchsorted(w.offsets, starts, "right") - 1
    nearest = np.append(breaks, n)[np.searchsorted(breaks, starts)]
    ends = np.minimum(nearest, w.offsets[text + 1])
    filled = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    text, hashes = text[filled], hash_ranges(w.data, starts[filled], ends[filled])
    _, later = _repeats(text, hashes)
    size = len(w.offsets) - 1
    return np.bincount(text, minlength=size), np.bincount(text[later], minlength=size)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, w in pieces(batches):
        n = len(w.hashes)
        within = np.zeros(len(w.data) + 1, np.int8)
        within[w.starts] += 1
        within[w.ends] -= 1
        inside = np.cumsum(within[:-1], dtype=np.int8) > 0 if n else np.zeros(len(w.data), bool)
        inside[w.starts] = True  # words that touch at the border of two texts
        whole = np.flatnonzero(w.room() >= 3)
        some, _ = _repeats(w.owner()[whole], windows(w.hashes, 3)[whole]) if len(whole) else (np.zeros(0, bool),) * 2
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[whole[some] + i] = True
        lines, dup_lines = _lines(w)
        counts = (
            w.counts,
            _per_text(_KIND["lead"][w.data] & inside, w.offsets),
            _per_text(_KIND["symbol"][w.data], w.offsets),
            dup_lines,
            _per_text(covered, w.first),
            lines,
            _per_text(_KIND["upper"][w.data], w.offsets),
            _per_text(_KIND["mark"][w.data], w.offsets),
        )
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "stratum", "digest")), *(pa.array(c, pa.int64()) for c in counts)],
            ["id", "stratum", "digest", *_COUNTS],
        )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """``(id, stratum, digest)`` and the counts of every row of ``docs``, and ``base_failed``; the digest is of the text."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(stratum).cast("string").alias("stratum"),
        F.xxhash64(F.col(text_col).cast("string")).alias("digest"),
        F.col(text_col).cast("string").alias("text"),
    )
    counts = rows.mapInArrow(_measured, "id long, stratum string, digest long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return counts.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def levels() -> dict[str, Column]:
    """The rules' measures as whole numbers from 0 to ``LEVELS``."""
    shares = {
        "symbols": F.col("n_symbols") / F.col("word_chars"),
        "repeats": F.col("n_repeat_words") / F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") / F.col("n_lines"),
        "word_length": F.col("word_chars") / F.col("n_words") / 50,
        "capitals": F.col("n_upper") / F.col("word_chars"),
        "marks": F.col("n_marks") / F.col("n_words"),
    }
    return {k: F.least(F.ceil(F.coalesce(v, F.lit(0.0)) * LEVELS), F.lit(LEVELS)).cast("int") for k, v in shares.items()}


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate under which ``k`` or fewer of ``n`` still has probability ``delta``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _at_most(k, n, mid) > delta else (low, mid)
    return high


def _at_most(k: int, n: int, rate: float) -> float:
    if rate <= 0 or rate >= 1:
        return float(rate <= 0)
    term = n * math.log1p(-rate)
    total = peak = term
    logs = [term]
    for i in range(1, k + 1):
        term += math.log(n - i + 1) - math.log(i) + math.log(rate) - math.log1p(-rate)
        logs.append(term)
        peak = max(peak, term)
    total = peak + math.log(sum(math.exp(x - peak) for x in logs))
    return math.exp(min(total, 0.0))


def _first_half() -> Column:
    return F.expr("crc32(cast(id AS string)) % 2 = 0")


def proposed_paths(good: DataFrame) -> DataFrame:
    """``(stratum, path)``: per rule, the cutoff of every step, from the first half of ``good``."""
    pairs = F.create_map(*(x for rule, level in levels().items() for x in (F.lit(rule), level)))
    counts = good.filter(_first_half()).select("stratum", F.explode(pairs).alias("rule", "level"))
    counts = counts.groupBy("stratum", "rule", "level").agg(F.count(F.lit(1)).alias("n"))
    of_rule = Window.partitionBy("stratum", "rule")  # at most LEVELS + 1 rows
    above = F.sum("n").over(of_rule.orderBy(F.desc("level")))
    counts = counts.withColumn("above", above).withColumn("total", F.sum("n").over(of_rule))
    # the least level that leaves at most the share above it is the largest that more than the share reach
    steps = [F.max(F.when(F.col("above") > F.lit(q) * F.col("total"), F.col("level"))) for q in PATH]
    rules = counts.groupBy("stratum", "rule").agg(F.array(*steps).alias("cutoffs"))
    return rules.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoffs"))).alias("path"))


def _met(df: DataFrame, strata: DataFrame, how: str) -> DataFrame:
    """``df`` with the columns of its stratum; null is a stratum."""
    side = small(strata.withColumnRenamed("stratum", "of_stratum"))
    return df.join(side, F.col("stratum").eqNullSafe(F.col("of_stratum")), how).drop("of_stratum")


def _exceeds(cutoff) -> Column:
    """Whether any rule's measure lies above ``cutoff(rule)``."""
    out = F.lit(False)
    for rule, level in levels().items():
        out = out | (level > cutoff(rule))
    return out


def _passed(strata: int):
    """The last step of the fixed sequence whose bound holds; none without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = []
            for n, rejected in zip(batch.column("n").to_pylist(), batch.column("rejected").to_pylist()):
                fails = [upper_bound(k, n, DELTA / strata) > ALPHA for k in rejected]
                steps.append(fails.index(True) if True in fails else len(fails))
            yield batch.select(["stratum"]).append_column("steps", pa.array(steps, pa.int32()))

    return run


def select_cutoffs(good: DataFrame) -> DataFrame:
    """``(stratum, cutoffs)``: cutoff of each rule, from measured good documents; strata without a promise are left out."""
    paths, strata = materialise_counted(proposed_paths(good))
    step = F.lit(len(PATH))
    for j in reversed(range(len(PATH))):
        step = F.when(_exceeds(lambda rule, j=j: F.col("path")[rule][j]), j).otherwise(step)
    tested = _met(good.filter(~_first_half()), paths, "inner").select("stratum", step.alias("step"))
    rejected = F.array(*(F.sum((F.col("step") <= j).cast("long")) for j in range(len(PATH))))
    tested = tested.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), rejected.alias("rejected"))
    passed = tested.mapInArrow(_passed(strata), "stratum string, steps int").filter("steps > 0")
    chosen = _met(materialise(passed), paths, "inner")
    return chosen.select("stratum", F.expr("transform_values(path, (rule, c) -> c[steps - 1])").alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """Counts of every document, ``base_failed`` and ``kept``; ``labels`` has ``(<id_col>, quality)``."""
    stats = materialise(measure(docs, id_col, **columns))
    fine = labels.filter("quality = 1").select(F.col(id_col).cast("long").alias("id")).dropna().distinct()
    good = stats.filter("NOT base_failed").join(fine, "id", "left_semi")
    one = good.groupBy("id").agg(F.max(F.struct(*_COUNTS, "stratum", "digest")).alias("r")).select("id", "r.*")
    good = one.groupBy("stratum", "digest", *_COUNTS).agg(F.min("id").alias("id"))
    marked = _met(stats, materialise(select_cutoffs(materialise(good))), "left")
    rejected = F.coalesce(_exceeds(lambda rule: F.col("cutoffs")[rule]), F.lit(False))
    out = marked.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("cutoffs")
    return out.withColumnRenamed("id", id_col)
