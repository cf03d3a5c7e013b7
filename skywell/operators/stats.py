"""Paired significance tests; Spark reduces the data, the tail of one row is computed at the end."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skywell.operators.ordering import average_rank, null_safe_join, prefix_counts, with_row
from skywell.schema import col


def paired_errors(df: DataFrame, y="y_true", a="pred_a", b="pred_b") -> DataFrame:
    """``d`` = |error of a| - |error of b| over rows where all three values are present."""
    ok = lambda c: col(c).isNotNull() & ~F.isnan(col(c).cast("double"))
    return df.filter(ok(y) & ok(a) & ok(b)).select(
        (F.abs(col(a) - col(y)) - F.abs(col(b) - col(y))).alias("d"))


# --- tails of one-row results --------------------------------------------------------------------

# From here on the p-values of Student's t and the normal law differ by less than 1e-6, and the continued fraction would need ever more steps.
NORMAL_FROM = 1e6


def _continued_fraction(step, limit: int = 300, tiny: float = 1e-300) -> float:
    """Value of b0 + a1/(b1 + a2/(b2 + ...)); ``step(i)`` gives (a_i, b_i), step(0) gives (_, b0)."""
    f = step(0)[1] or tiny
    c, d = f, 0.0
    for i in range(1, limit):
        a, b = step(i)
        d = 1.0 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return f


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(1 - x, b, a)

    def step(i):
        if i == 0:
            return 0.0, 0.0
        if i == 1:
            return 1.0, 1.0
        m, odd = divmod(i - 1, 2)
        if odd:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return num, 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _continued_fraction(step)


def gamma_tail(x: float, a: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total

    def step(i):
        if i == 0:
            return 0.0, 0.0
        return (1.0 if i == 1 else -(i - 1) * (i - 1 - a)), x + 2 * i - 1 - a

    return front * _continued_fraction(step)


def t_two_sided(t: float, df: float) -> float:
    """Both tails of Student's t; from a million degrees of freedom on the normal tail, which it then equals to
    about one part in a million where the fraction no longer converges."""
    if df >= NORMAL_FROM:
        return normal_two_sided(t)
    return beta_tail(df / (df + t * t), df / 2.0, 0.5)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _tail(name: str, fn, *columns: Column) -> Column:
    def apply(*series: pd.Series) -> pd.Series:
        rows = zip(*series)
        return pd.Series([None if any(pd.isna(v) for v in r) else fn(*map(float, r)) for r in rows],
                         dtype="float64")
    apply.__name__ = name
    return F.pandas_udf(apply, "double")(*columns)


# --- tests -----------------------------------------------------------------------------------------

def t_test(d: DataFrame) -> DataFrame:
    """Paired t-test of the differences ``d``."""
    out = d.agg(F.count("d").alias("n"), F.avg("d").alias("_m"), F.stddev_samp("d").alias("_s"))
    t = F.try_divide(F.col("_m"), F.col("_s") / F.sqrt(F.col("n").cast("double")))
    out = out.select("n", t.alias("t_statistic"))
    return out.withColumn("t_p_value", _tail(
        "t_tail", t_two_sided, F.col("t_statistic"), (F.col("n") - 1).cast("double")))


# Up to so many pairs the rank sum's own distribution is used: its counts reach 2^50 and stay exact in 64 bits.
EXACT_PAIRS = 50


def rank_sum_share(n: Column, w: Column) -> Column:
    """Share of the 2^n sign patterns over ranks 1..n whose positive ranks sum to ``w`` or less.

    One fold over the ranks: the number of subsets per sum, each rank adding the same counts shifted by itself.
    Null without a rank or beyond ``EXACT_PAIRS``.
    """
    few = F.when((n >= 1) & (n <= EXACT_PAIRS), n.cast("int"))
    most = (few * (few + 1) / 2).cast("int")
    empty = F.transform(F.sequence(F.lit(0), most), lambda s: (s == 0).cast("long"))
    counts = F.aggregate(F.sequence(F.lit(1), few), empty, lambda acc, rank: F.transform(
        acc, lambda x, s: x + F.coalesce(F.get(acc, s - rank), F.lit(0).cast("long"))))
    below = F.aggregate(F.slice(counts, 1, w.cast("int") + 1), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return below / F.pow(F.lit(2.0), few)


def wilcoxon(d: DataFrame, by=()) -> DataFrame:
    """Signed-rank test of the differences ``d``, per group of ``by``: average ranks, zero differences left out.

    The p-value is exact for at most ``EXACT_PAIRS`` differences without ties (``w_exact``), else that of the normal
    law with tie correction. A group whose differences are all zero or missing has no row; without ``by`` there
    is always one row.
    """
    by = list(by)
    keys = [col(k) for k in by]
    signed = d.filter("d <> 0 AND NOT isnan(d)").groupBy(*keys, F.abs("d").alias("_abs")).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(F.col("d") > 0).alias("_pos"))
    ranks = prefix_counts(signed, "_abs", by, "_c").select(*keys, "_abs", "_n", average_rank().alias("_r"))
    n3 = F.pow(F.col("_n").cast("double"), F.lit(3.0)) - F.col("_n")
    sums = null_safe_join(signed, ranks, [*by, "_abs"]).groupBy(*keys).agg(
        F.sum("_c").alias("n_nonzero"), F.sum(F.col("_r") * F.col("_pos")).alias("_plus"),
        F.sum(F.col("_r") * (F.col("_c") - F.col("_pos"))).alias("_minus"), F.sum(n3).alias("_ties"))
    n = F.col("n_nonzero").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    w = F.least("_plus", "_minus")
    out = sums.select(*keys, "n_nonzero", w.alias("w_statistic"),
                      F.try_divide(w - n * (n + 1) / 4.0, F.sqrt(var)).alias("w_z"),
                      F.coalesce((F.col("_ties") == 0) & (F.col("n_nonzero") <= EXACT_PAIRS), F.lit(False)).alias("w_exact"))
    out = out.withColumn("_normal", _tail("normal_tail", normal_two_sided, F.col("w_z")))
    exact = F.least(F.lit(1.0), 2 * rank_sum_share(F.col("n_nonzero"), F.col("w_statistic")))
    return out.withColumn("w_p_value", F.when(F.col("w_exact"), exact).otherwise(F.col("_normal"))).drop("_normal")


def cohens_d(d: DataFrame) -> DataFrame:
    return d.agg((F.avg("d") / (F.stddev_pop("d") + 1e-8)).alias("cohens_d"))


def friedman(long: DataFrame, idx="idx", model="model", value="abs_error") -> DataFrame:
    """Chi-square over models from average ranks inside each sample; samples missing a model are left out."""
    per = Window.partitionBy(col(idx))
    ties = Window.partitionBy(col(idx), col(value))
    models = long.filter(col(value).isNotNull()).agg(F.countDistinct(col(model)).alias("_k"))
    ranked = with_row(long.filter(col(value).isNotNull()), models).withColumns({
        "_have": F.count(F.lit(1)).over(per),
        "_tie": F.count(F.lit(1)).over(ties),
        "_rank": F.rank().over(per.orderBy(col(value))),
    }).filter("_have = _k")
    t = F.col("_tie").cast("double")
    per_model = ranked.groupBy(col(model)).agg(
        F.sum(F.col("_rank") + (F.col("_tie") - 1) / 2.0).alias("_sum"), F.count(F.lit(1)).alias("_n"),
        # Each tied set of size t shows up t times, so dividing by t counts it once.
        F.sum((t * t * t - t) / t).alias("_ties"))
    sums = per_model.agg(
        F.count(F.lit(1)).alias("n_models"), F.max("_n").alias("n_samples"),
        F.sum(F.col("_sum") * F.col("_sum")).alias("_ss"), F.sum("_ties").alias("_t"))
    k, n = F.col("n_models").cast("double"), F.col("n_samples").cast("double")
    chi = (12.0 / (n * k * (k + 1)) * F.col("_ss") - 3.0 * n * (k + 1))
    out = sums.select("n_models", "n_samples", F.try_divide(
        chi, 1.0 - F.col("_t") / (n * k * (k * k - 1.0))).alias("chi_square"))
    return out.withColumn("p_value", _tail(
        "chi_tail", lambda x, f: gamma_tail(x / 2.0, f / 2.0), F.col("chi_square"),
        (F.col("n_models") - 1).cast("double")))


def all_tests(df: DataFrame, y="y_true", a="pred_a", b="pred_b", level: float = 0.05) -> DataFrame:
    """t-test, Wilcoxon and Cohen's d in one row, significant when the Wilcoxon test is."""
    d = paired_errors(df, y, a, b)
    out = with_row(with_row(t_test(d), wilcoxon(d)), cohens_d(d))
    return out.withColumn("is_significant", F.coalesce(F.col("w_p_value") < level, F.lit(False)))
