"""Quality rules whose cutoffs are certified on labelled rows (operator 10, DataFrame operations only).

Each rule rejects a text whose ratio reaches a cutoff. Cutoffs are tested from lenient to strict against
"this rule wrongly rejects a share of at least ``alpha`` of the good texts of the stratum" with the exact
binomial tail; testing stops at the first cutoff that is not refused, so a sequence costs no correction,
and the level is divided by the number of (rule, stratum) sequences (Bonferroni). ``alpha`` is divided by
the number of rules, so the union of all rules stays within it. Among certified cutoffs the one that
rejects most more bad than good labelled rows is used, the more lenient in a tie; where nothing is
certified the rule stays silent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skywell.llm.common import documents, stored
from skywell.llm.registry import query
from skywell.llm.statistics import text_counts


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


RULES = ("symbols", "bangs", "upper", "dup_lines", "repeats", "sameness")
# Cutoffs from lenient to strict; the same for every rule, as each is a share of 0 to 1.
CUTOFFS = tuple(round(1 - 0.02 * i, 2) for i in range(1, 50))
LENGTHS = (200, 1000)


def ratios() -> dict[str, Column]:
    """Six shares between 0 and 1; higher is worse."""
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "bangs": _share("n_bangs", "n_words") / 2,
        "upper": _share("n_upper", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "sameness": F.when(F.col("n_words") > 0, 1 - F.col("n_distinct_words") / F.col("n_words")).otherwise(0.0),
    }


def stratum() -> Column:
    """Length class: 0, 1 or 2. A bounded number of strata by construction."""
    return sum(((F.col("n_words") >= n).cast("int") for n in LENGTHS), F.lit(0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial (n, p): terms from k downwards until they no longer count."""
    if k >= n:
        return 1.0
    log = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p)
           + (n - k) * math.log1p(-p))
    if k >= n * p:  # beyond the mean: never small
        return 1.0
    total, term, j = 0.0, 1.0, k
    while term > total * 1e-17:
        total += term
        if j == 0:
            break
        term *= j * (1 - p) / ((n - j + 1) * p)
        j -= 1
    return min(1.0, math.exp(log) * total)


def certify(good: list[int], bad: list[int], alpha: float, level: float) -> int | None:
    """Index of the chosen cutoff. ``good[i]``, ``bad[i]``: labelled rows that cutoff i is the first to reject;
    the last entry counts rows that no cutoff rejects."""
    n, k, b, best = sum(good), 0, 0, None
    for i in range(len(good) - 1):
        k, b = k + good[i], b + bad[i]
        if n == 0 or binomial_tail(k, n, alpha) > level:
            break
        if b > k and (best is None or b - k > best[0]):
            best = (b - k, i)
    return None if best is None else best[1]


def first_cutoff(ratio: Column) -> Column:
    """Index of the most lenient cutoff that rejects the ratio; ``len(CUTOFFS)`` if none does."""
    cuts = F.array(*[F.lit(c) for c in CUTOFFS])
    return F.lit(len(CUTOFFS)) - F.size(F.filter(cuts, lambda c: ratio >= c))


def calibrate(counts: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05) -> dict:
    """{(stratum, rule): cutoff}. Reads (doc_id, quality) of every label; repeated doc_ids count once (worst
    label), null labels not at all. Only a table of strata x rules x cutoffs reaches the driver."""
    truth = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    named = counts.dropDuplicates(["doc_id"]).join(truth, "doc_id").select(
        stratum().alias("s"), "quality", *[first_cutoff(r).alias(n) for n, r in ratios().items()])
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("at")) for n in RULES]))
    table = named.select("s", "quality", arms.alias("a")).groupBy("s", "quality", "a.rule", "a.at").count().collect()
    hist: dict = {}
    for r in table:
        key = (r["s"], r["rule"])
        hist.setdefault(key, {0: [0] * (len(CUTOFFS) + 1), 1: [0] * (len(CUTOFFS) + 1)})[int(r["quality"] > 0)][
            r["at"]] += r["count"]
    level = delta / (len(RULES) * (len(LENGTHS) + 1))
    chosen = {k: certify(h[1], h[0], alpha / len(RULES), level) for k, h in hist.items()}
    return {k: CUTOFFS[i] for k, i in chosen.items() if i is not None}


def rejected(cutoffs: dict) -> Column:
    """The compiled rules as one condition."""
    r, out = ratios(), F.lit(False)
    for (s, rule), cut in sorted(cutoffs.items()):
        out = out | ((stratum() == s) & (r[rule] >= cut))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike. Without
    usable labels no cutoff is certified and only the base rule rejects. Other columns are ignored.
    """
    counts = stored(text_counts(docs, ["doc_id"]), "counts")
    cutoffs = calibrate(counts, labels, alpha, delta)
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~(base_failed() | rejected(cutoffs))).alias("kept"),
        stratum().alias("stratum"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_rules(documents(spark, sf_dir, "doc_id", "text"), labels)
