"""Regression metrics of prediction tables, whole and by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skywell.operators.layout import lay_out
from skywell.operators.ordering import (
    average_rank, null_safe_join, prefix_counts, quantiles, with_row,
)
from skywell.schema import col
from skywell.session import written

EPS = 1e-8
METRIC_NAMES = ["n", "rmse", "mae", "mape", "r2", "pearson", "spearman", "median_ae", "p95_ae"]


def valid_pairs(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Rows where both values are present and finite-comparable (NaN counts as missing)."""
    ok = lambda c: col(c).isNotNull() & ~F.isnan(col(c).cast("double"))
    return df.filter(ok(y) & ok(p))


def moment_columns(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    """Metrics that one aggregation pass gives."""
    e = col(p) - col(y)
    n = F.count(F.lit(1))
    sse = F.sum(e * e)
    return [
        n.alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / (F.abs(col(y)) + EPS)) * 100.0).alias("mape"),
        (1.0 - sse / (F.var_pop(col(y)) * n + EPS)).alias("r2"),
        F.corr(col(y).cast("double"), col(p).cast("double")).alias("pearson"),
    ]


def spearman(df: DataFrame, y: str = "y_true", p: str = "y_pred", by=()) -> DataFrame:
    """Correlation of average-tie ranks per group.

    Equal pairs are counted first; ranks are centred on their known mean before they are
    multiplied, so large counts lose no precision.
    """
    by = list(by)
    keys = [col(k) for k in by]
    pairs = df.groupBy(*keys, col(y).alias("_y"), col(p).alias("_p")).agg(
        F.count(F.lit(1)).alias("_w"))
    centred = average_rank() - (F.col("_total") + 1) / 2.0
    for name, out in (("_y", "_a"), ("_p", "_b")):
        ranks = prefix_counts(pairs, name, by, "_w").select(*keys, name, centred.alias(out))
        pairs = null_safe_join(pairs, ranks, [*by, name])
    w = F.col("_w")
    s = lambda a, b: F.sum(w * F.col(a) * F.col(b))
    return pairs.groupBy(*keys).agg(
        F.try_divide(s("_a", "_b"), F.sqrt(s("_a", "_a") * s("_b", "_b"))).alias("spearman"))


def metrics(df: DataFrame, by=(), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """One row per group with every metric; a group without a valid pair has no row.

    Moments, ranks and quantiles read the pairs several times, so the narrow pair columns are written
    once instead of computing the input again for each.
    """
    by = list(by)
    keys = [col(k) for k in by]
    pairs = valid_pairs(df, y, p).select(*keys, col(y), col(p))
    names = [*keys, *METRIC_NAMES]
    pairs = written(pairs, "pairs")
    base = pairs.groupBy(*keys).agg(*moment_columns(y, p)).filter("n > 0")
    ae = quantiles(pairs, {"ae": F.abs(col(p) - col(y))}, [0.5, 0.95], by)
    ae = ae.withColumnsRenamed({"ae__0": "median_ae", "ae__1": "p95_ae"})
    out = null_safe_join(base, spearman(pairs, y, p, by), by, "left")
    return null_safe_join(out, ae, by, "left").select(*names)


def basic_metrics(df: DataFrame, by=(), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """RMSE, MAE, R2 and mean squared error in one pass."""
    return valid_pairs(df, y, p).groupBy(*[col(k) for k in by]).agg(
        *moment_columns(y, p)).select(
        *[col(k) for k in by], "n", "rmse", "mae", "r2", (F.col("rmse") * F.col("rmse")).alias("mse"))


# --- strata ------------------------------------------------------------------------------------

def storm_classes(kp: Column, dst: Column) -> Column:
    """All classes a row belongs to; the rules overlap, so the result is an array."""
    quiet = (kp <= 2.0) | (dst > -30)
    moderate = ((kp >= 3.0) & (kp < 6.0)) | ((dst <= -30) & (dst > -80))
    strong = (kp >= 6.0) | (dst <= -80)
    return F.array_compact(F.array(
        F.when(quiet, "Quiet"), F.when(moderate, "Moderate_Storm"), F.when(strong, "Strong_Storm")))


def latitude_band(lat: Column, edges, labels, closed_top: bool) -> Column:
    """Band of the absolute latitude; lower edges belong to the band."""
    a = F.abs(lat)
    out = None
    for i, label in enumerate(labels):
        top = (a <= edges[i + 1]) if closed_top and i + 1 == len(labels) else (a < edges[i + 1])
        cond = (a >= edges[i]) & top
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def season_by_hemisphere(doy: Column, north: Column) -> Column:
    warm = (doy >= 172) & (doy < 266)
    cold = (doy >= 355) | (doy < 80)
    return (F.when(doy.isNull() | north.isNull(), None)
            .when((north & warm) | (~north & cold), "Summer")
            .when((north & cold) | (~north & warm), "Winter").otherwise("Equinox"))


STRATA = {
    "storm": lambda c: storm_classes(c["kp"], c["dst"]),
    "latitude_thirds": lambda c: F.array(latitude_band(
        c["latitude"], [0, 30, 60, 90], ["Low_Latitude", "Mid_Latitude", "High_Latitude"], True)),
    "latitude_zones": lambda c: F.array(latitude_band(
        c["latitude"], [0, 20, 60, 90], ["Equatorial", "Mid_Latitude", "High_Latitude"], False)),
    "season_hemisphere": lambda c: F.array(season_by_hemisphere(c["doy"], c["latitude"] >= 0)),
    "season_north": lambda c: F.array(season_by_hemisphere(c["doy"], F.lit(True))),
    "activity": lambda c: F.array(F.when(c["kp"] <= 3, "Quiet_Time").when(c["kp"] > 5, "Storm_Time")),
    "solar_cycle": lambda c: F.array(
        F.when(c["f107"] < 100, "Solar_Minimum").when(c["f107"] >= 150, "Solar_Maximum")),
}


def with_stratum(df: DataFrame, kind: str, columns: dict[str, str] | None = None) -> DataFrame:
    """One row per (row, stratum it belongs to); rows outside every stratum are left out."""
    names = {"kp": "kp", "dst": "dst", "latitude": "latitude", "doy": "doy", "f107": "f107",
             **(columns or {})}
    labels = STRATA[kind]({k: col(v) for k, v in names.items()})
    return df.withColumn("stratum", F.explode(F.array_compact(labels)))


def metrics_by(df: DataFrame, kind: str, by=(), columns=None, **options) -> DataFrame:
    return metrics(with_stratum(df, kind, columns), [*by, "stratum"], **options)


def storm_degradation(by_storm: DataFrame, by=()) -> DataFrame:
    """Strong-storm RMSE over quiet RMSE; no row where one of them is missing."""
    pick = lambda s: F.max(F.when(F.col("stratum") == s, F.col("rmse")))
    return by_storm.groupBy(*[col(k) for k in by]).agg(
        (pick("Strong_Storm") / (pick("Quiet") + EPS)).alias("storm_degradation_factor")
    ).filter(F.col("storm_degradation_factor").isNotNull())


def station_spread(df: DataFrame, key: str = "station", by=(), y="y_true", p="y_pred") -> DataFrame:
    """Mean, deviation (population), maximum and minimum of the per-station RMSE."""
    per = basic_metrics(df, [*by, key], y, p)
    return per.groupBy(*[col(k) for k in by]).agg(
        F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"),
        F.max("rmse").alias("max_rmse"), F.min("rmse").alias("min_rmse"),
        F.count(F.lit(1)).alias("n_stations"))


def generalisation_gap(df: DataFrame, by=(), split="split", y="y_true", p="y_pred") -> DataFrame:
    """Train and test RMSE and their gap in percent of the train RMSE."""
    e2 = (col(p) - col(y)) * (col(p) - col(y))
    of = lambda s: F.sqrt(F.avg(F.when(col(split) == s, e2)))
    return valid_pairs(df, y, p).groupBy(*[col(k) for k in by]).agg(
        of("train").alias("train_rmse"), of("test").alias("test_rmse")
    ).withColumn("gap_pct", (F.col("test_rmse") - F.col("train_rmse"))
                 / (F.col("train_rmse") + EPS) * 100.0)


def compare(per_model: DataFrame, ours: str) -> DataFrame:
    """RMSE improvement of model ``ours`` over each model, and a mark on the best other model.

    ``per_model`` holds one row per model, so its size is the number of models.
    """
    mine = per_model.filter(F.col("model") == ours).agg(F.max("rmse").alias("_ours"))
    best = per_model.filter(F.col("model") != ours).agg(
        F.min_by("model", F.struct("rmse", "model")).alias("_best"))
    return with_row(with_row(per_model, mine), best).withColumns({
        "improvement_pct": (F.col("rmse") - F.col("_ours")) / (F.col("rmse") + EPS) * 100.0,
        "is_best_baseline": F.col("model") == F.col("_best"),
    }).drop("_ours", "_best")


# --- physics -----------------------------------------------------------------------------------

def physics_score(df: DataFrame, keys=("station",), order=("ts",), by=(), topside="topside",
                  bottomside="bottomside", net="net", density="density",
                  chunk_rows: int | None = None) -> DataFrame:
    """Share of rows that are positive, conserve mass and move smoothly, and the weighted score."""
    layout = lay_out(df, list(keys), list(order), before=1, chunk_rows=chunk_rows)
    rows = layout.finish(layout.rows.withColumn("_prev", F.lag(col(topside)).over(layout.window)))
    pct = lambda cond: F.avg(cond.cast("double")) * 100.0
    total = col(topside) + col(bottomside)
    kept = F.abs(col(net) - total) / (F.abs(total) + EPS) <= 0.15
    smooth = F.abs(col(topside) - F.col("_prev")) <= F.abs("_prev") * 0.5 + 5.0
    out = rows.groupBy(*[col(k) for k in by]).agg(
        pct(col(topside) >= 0).alias("topside_positive_pct"),
        pct(col(density) >= 0).alias("density_positive_pct"),
        pct(kept).alias("mass_conservation_pct"),
        F.coalesce(pct(F.when(F.col("_prev").isNotNull(), smooth)), F.lit(100.0)).alias("smoothness_pct"),
    )
    return out.withColumn(
        "physics_score",
        0.30 * F.col("topside_positive_pct") + 0.30 * F.col("density_positive_pct")
        + 0.25 * F.col("mass_conservation_pct") + 0.15 * F.col("smoothness_pct"))


def physics_penalty(df: DataFrame, keys=("station",), order=("ts",), topside="topside", net="net",
                    density="density", base="base_net", chunk_rows: int | None = None) -> DataFrame:
    """Mean negativity, 0.1 x squared net deviation and 0.05 x mean step inside each key."""
    layout = lay_out(df, list(keys), list(order), before=1, chunk_rows=chunk_rows)
    step = F.abs(col(topside) - F.lag(col(topside)).over(layout.window))
    rows = layout.finish(layout.rows.withColumn("_step", step))
    out = rows.agg(
        F.avg(F.greatest(-col(topside), F.lit(0.0))).alias("topside_negative"),
        F.avg(F.greatest(-col(density), F.lit(0.0))).alias("density_negative"),
        (F.avg((col(net) - col(base)) * (col(net) - col(base))) * 0.1).alias("consistency"),
        (F.coalesce(F.avg("_step"), F.lit(0.0)) * 0.05).alias("smoothness"),
    )
    return out.withColumn("total", F.col("topside_negative") + F.col("density_negative")
                          + F.col("consistency") + F.col("smoothness"))


def task_loss(df: DataFrame, tasks=("topside", "net", "density", "delay"), weights=None,
              prefix=("pred_", "true_")) -> DataFrame:
    """Mean squared error per task and their (weighted) sum."""
    mse = lambda t: F.avg(F.pow(col(prefix[0] + t) - col(prefix[1] + t), F.lit(2.0)))
    out = df.agg(*[mse(t).alias(f"loss_{t}") for t in tasks])
    weights = weights or {}
    return out.withColumn("total_loss", sum(
        (F.col(f"loss_{t}") * float(weights.get(t, 1.0)) for t in tasks[1:]),
        F.col(f"loss_{tasks[0]}") * float(weights.get(tasks[0], 1.0))))


def scientific_score(r2: Column, physics_pct: Column, gap_pct: Column, degradation: Column) -> Column:
    """0-100: accuracy 40, physics 30, generalisation 15, storm robustness 10, calibration 5."""
    zero = F.lit(0.0)
    score = (
        F.greatest(zero, F.coalesce(r2, zero) * 40.0)
        + F.coalesce(physics_pct, zero) / 100.0 * 30.0
        + F.greatest(zero, 15.0 - F.coalesce(gap_pct, F.lit(100.0)) / 20.0 * 15.0)
        + F.when(degradation.isNull(), zero).otherwise(
            F.greatest(zero, 10.0 - (degradation - 1.0) / 2.0 * 10.0))
        + 5.0
    )
    return F.greatest(zero, F.least(F.lit(100.0), score))


# --- operational window measures -----------------------------------------------------------------

def anomaly_aggregates(topside="topside", net="net", density="density", step="step",
                       cap: float = 200.0, max_step: float = 20.0) -> list[Column]:
    """Window-level flags; ``step`` is the change against the previous row of the same series."""
    anything = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return [
        anything(col(topside) < 0).alias("negative_topside"),
        anything(col(density) < 0).alias("negative_density"),
        anything(col(net) > cap).alias("extreme_tec"),
        anything(F.abs(col(step)) > max_step).alias("massive_jump"),
    ]


def is_anomalous() -> Column:
    return (F.col("negative_topside") | F.col("negative_density") | F.col("extreme_tec")
            | F.col("massive_jump"))


def anomalies(df: DataFrame, window: str, keys=("station",), order=("ts",), topside="topside",
              chunk_rows=None, **options) -> DataFrame:
    """Anomaly flags per (key, window); steps are taken inside the window only."""
    layout = lay_out(df, [*keys, window], list(order), before=1, chunk_rows=chunk_rows)
    step = col(topside) - F.lag(col(topside)).over(layout.window)
    rows = layout.finish(layout.rows.withColumn("step", step))
    return rows.groupBy(*[col(k) for k in keys], col(window)).agg(
        *anomaly_aggregates(topside, **options)).withColumn("is_anomalous", is_anomalous())


def readiness(mean_confidence: Column, level: Column) -> Column:
    """0-100 trust in a window, from its anomaly flags, mean confidence and storm warning level."""
    score = (
        F.lit(100.0) - (1.0 - F.coalesce(mean_confidence, F.lit(1.0))) * 50.0
        - F.when(F.col("negative_topside"), 40.0).otherwise(0.0)
        - F.when(F.col("extreme_tec"), 20.0).otherwise(0.0)
        - F.when(F.col("massive_jump"), 15.0).otherwise(0.0)
        - F.when(level == "CRITICAL", 10.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


# --- figure data ---------------------------------------------------------------------------------

def taylor(df: DataFrame, by=("model",), y="y_true", p="y_pred") -> DataFrame:
    """Deviation, reference deviation, correlation and its angle per model."""
    r = F.corr(col(y), col(p))
    return valid_pairs(df, y, p).groupBy(*[col(k) for k in by]).agg(
        F.stddev_pop(col(p)).alias("std_pred"), F.stddev_pop(col(y)).alias("std_ref"),
        r.alias("correlation")).withColumn("angle", F.acos("correlation"))


def box_stats(df: DataFrame, by=("model",), y="y_true", p="y_pred") -> DataFrame:
    """Five-number summary of absolute errors, whiskers at 1.5 IQR and the count beyond them."""
    by = list(by)
    e = valid_pairs(df, y, p).select(*[col(k) for k in by], F.abs(col(p) - col(y)).alias("_e"))
    q = quantiles(e, {"q": F.col("_e")}, [0.0, 0.25, 0.5, 0.75, 1.0], by).withColumnsRenamed(
        {"q__0": "minimum", "q__1": "q1", "q__2": "median", "q__3": "q3", "q__4": "maximum"})
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("_e").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    joined = null_safe_join(e, q, by)
    ends = joined.groupBy(*[col(k) for k in by]).agg(
        F.min(F.when(inside, F.col("_e"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_e"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"))
    return null_safe_join(q, ends, by)


def residual_histogram(df: DataFrame, bins: int = 50, y="y_true", p="y_pred") -> DataFrame:
    """Equal-width counts of the residual; the last bin is closed, empty bins are present."""
    e = valid_pairs(df, y, p).select((col(p) - col(y)).alias("_e"))
    ends = e.agg(F.min("_e").alias("_lo"), F.max("_e").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(F.col("_hi") > F.col("_lo"), F.least(
        F.floor((F.col("_e") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = with_row(e, ends).groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = ends.filter("_lo is not null").select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        F.col("_lo"), width.alias("_w"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"))


def extent(df: DataFrame, y="y_true", p="y_pred") -> DataFrame:
    return df.agg(F.least(F.min(col(y)), F.min(col(p))).alias("low"),
                  F.greatest(F.max(col(y)), F.max(col(p))).alias("high"))


def run_summary(log: DataFrame, measures: list[str]) -> DataFrame:
    """mean, std (sample, 0 for one record), min, max of each measure of a run log."""
    wide = log.agg(*[f(col(m).cast("double")).alias(f"{n}:{m}") for m in measures for n, f in (
        ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.round(col(f"mean:{m}"), 4).alias("mean"),
                 F.round(F.coalesce(col(f"std:{m}"), F.lit(0.0)), 4).alias("std"),
                 F.round(col(f"min:{m}"), 4).alias("min"), F.round(col(f"max:{m}"), 4).alias("max"))
        for m in measures])).alias("r")).select("r.*")


def keep_lowest(log: DataFrame, k: int, score: str, by=(), tie=()) -> DataFrame:
    """The k lowest-score records of a log, per group when ``by`` is given."""
    order = [col(score), *[col(t) for t in tie]]
    if not by:
        return log.orderBy(*order).limit(k)
    w = Window.partitionBy(*[col(b) for b in by]).orderBy(*order)
    return log.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
