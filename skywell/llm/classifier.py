"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics (operator 2).

Shallow trees are boosted on a bounded sample of labelled rows; every path from a root to a node is a rule
(up to ``DEPTH`` comparisons of statistics). A lasso logistic fit weighs the rules, with a penalty raised
until at most ``most_rules`` remain, and the result is compiled into one Spark column: no Python runs on the
documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skywell.llm.common import broadcast_within, documents
from skywell.llm.registry import query
from skywell.llm.statistics import text_counts

TREES, DEPTH, BINS, LEAF, SAMPLE, MOST_RULES = 40, 3, 24, 5, 20_000, 32
Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold) each


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0)).cast("double")


def features() -> dict[str, Column]:
    return {
        "words": F.log1p(F.col("n_words")), "word_length": _share("word_chars", "n_words"),
        "symbols": _share("n_symbols", "word_chars"), "bangs": _share("n_bangs", "n_words"),
        "pipes": _share("n_pipes", "n_words"), "upper": _share("n_upper", "word_chars"),
        "digits": _share("n_digits", "word_chars"), "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"), "distinct": _share("n_distinct_words", "n_words"),
        "line_words": _share("n_words", "n_lines"),
    }


def grow(codes: np.ndarray, residual: np.ndarray, rows: np.ndarray, path: tuple, paths: set, out: np.ndarray) -> None:
    """One regression tree on binned statistics; adds each node's path to ``paths``, leaf means to ``out``."""
    n, best = len(rows), None
    if len(path) < DEPTH and n >= 2 * LEAF:
        r = residual[rows]
        for f in range(codes.shape[1]):
            c = codes[rows, f]
            count, total = np.bincount(c, minlength=BINS + 1), np.bincount(c, r, BINS + 1)
            left, sums = np.cumsum(count)[:-1], np.cumsum(total)[:-1]
            right = n - left
            gain = np.where((left >= LEAF) & (right >= LEAF), sums ** 2 / np.maximum(left, 1)
                            + (r.sum() - sums) ** 2 / np.maximum(right, 1), -np.inf)
            k = int(gain.argmax())
            if gain[k] > r.sum() ** 2 / n + 1e-9 and (best is None or gain[k] > best[0]):
                best = gain[k], f, k
    if best is None:
        out[rows] = residual[rows].mean() if n else 0
        return
    _, f, k = best
    above = codes[rows, f] > k
    for side in (False, True):
        step = (*path, (f, side, k))
        paths.add(tuple(sorted(step)))
        grow(codes, residual, rows[above == side], step, paths, out)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], most_rules: int = MOST_RULES, seed: int = 3) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, [(rule, weight)]) from statistics and 0/1 labels. One class only: its log odds, no rules."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(set(y.tolist())) < 2:
        return base, []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])  # code > k: x > cuts[k]
    rng, margin, paths = np.random.default_rng(seed), np.full(len(y), base), set()
    for _ in range(TREES):
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        leaf = np.zeros(len(y))
        grow(codes, y - 1 / (1 + np.exp(-margin)), rows, (), paths, leaf)
        margin += 2.0 * leaf
    paths = sorted(p for p in paths if all(k < len(cuts[f]) for f, _, k in p))
    if not paths:
        return base, []
    hold = np.column_stack([np.all([(codes[:, f] > k) == side for f, side, k in p], axis=0) for p in paths]).astype(np.float32)
    some = (hold.mean(0) > 0) & (hold.mean(0) < 1)
    hold, paths = hold[:, some], [p for p, s in zip(paths, some) if s]
    step, penalty = 4.0 / max(1e-9, np.linalg.norm(hold, 2) ** 2 / len(y) + 1), 1e-3
    while True:
        w, b, v, t = np.zeros(len(paths)), base, np.zeros(len(paths)), 1.0
        for _ in range(250):  # accelerated proximal steps
            g = 1 / (1 + np.exp(-(hold @ v + b))) - y
            new = v - step * (hold.T @ g) / len(y)
            new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
            b -= step * g.mean()
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
        if (w != 0).sum() <= most_rules:
            break
        penalty *= 1.5
    return float(b), [(tuple((names[f], side, float(cuts[f][k])) for f, side, k in p), float(a)) for p, a in zip(paths, w) if a]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """Probability of label 1 as a column over the columns of ``features()``."""
    margin = F.lit(intercept)
    for rule, weight in rules:
        met = F.lit(True)
        for name, above, cut in rule:
            met = met & ((F.col(name) > cut) if above else (F.col(name) <= cut))
        margin = margin + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-margin))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    return text_counts(docs, keep).select(*keep, *[c.alias(n) for n, c in features().items()])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_rules: int = MOST_RULES) -> Column:
    """Score column, fitted on about ``sample`` labelled rows chosen by a hash of the id.

    Null labels and ids are left out; an id labelled twice counts once, with its worse label.
    """
    truth = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    share = min(1.0, sample / max(1, truth.count()))
    chosen = truth.where(F.pmod(F.xxhash64("doc_id", F.lit("labels")), F.lit(1_000_003)) < int(share * 1_000_003))
    names = list(features())
    taught = docs.select("doc_id", "text").join(broadcast_within(chosen, 16), "doc_id").dropDuplicates(["doc_id"])
    rows = statistics(taught, ["doc_id", "quality"]).orderBy("doc_id").collect()
    if not rows:
        return compiled(0.0, [])
    x = np.array([[r[n] for n in names] for r in rows], dtype=np.float64)
    y = np.array([float(r["quality"] > 0) for r in rows])
    return compiled(*fit(x, y, names, most_rules))


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str], sample: int = SAMPLE) -> DataFrame:
    """``keep`` columns, score and predicted (1 from 0.3 on) for every row.

    Null and empty texts have statistics of zero and are scored like any other. Without labels all score 0.5.
    Repeated rows score alike; an empty table gives no rows.
    """
    return statistics(docs, keep).select(*keep, learn(docs, labels, sample).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_quality(documents(spark, sf_dir, "doc_id", "text"), labels, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted")
