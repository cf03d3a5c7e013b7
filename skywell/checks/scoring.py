"""Metrics, strata, comparisons, tests and figure data of the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywell.checks.base import PRED, observations, predictions, predictions_wide, query, r, table, with_obs
from skywell.operators import metrics, stats

E2 = "(y_pred - y_true) * (y_pred - y_true)"


def _metric_sql(by: str, source: str) -> str:
    """All metrics of ``source`` (columns: by, y_true, y_pred) per group."""
    part = f"PARTITION BY {by}"
    return f"""
  SELECT {by}, count(*) AS n, round(sqrt(avg({E2})), 6) AS rmse, round(avg(abs(y_pred - y_true)) + 1e-9, 6) AS mae,
    round(avg(abs(y_pred - y_true) / (abs(y_true) + 1e-8)) * 100, 3) AS mape,
    round(1 - sum({E2}) / (var_pop(y_true) * count(*) + 1e-8), 6) AS r2,
    round(corr(y_true, y_pred), 6) + 0.0 AS pearson, round(corr(ry, rp), 6) + 0.0 AS spearman,
    round(quantile_cont(abs(y_pred - y_true), 0.5) + 1e-9, 6) AS median_ae,
    round(quantile_cont(abs(y_pred - y_true), 0.95) + 1e-9, 6) AS p95_ae
  FROM (SELECT *, rank() OVER ({part} ORDER BY y_true) + (count(*) OVER ({part}, y_true) - 1) / 2.0 AS ry,
          rank() OVER ({part} ORDER BY y_pred) + (count(*) OVER ({part}, y_pred) - 1) / 2.0 AS rp
        FROM ({source}) WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)
  GROUP BY {by}"""


def _rounded(df, by):
    # Means and quantiles of values with few decimals can end in a half; the shift decides them.
    digits, shift = {"mape": 3}, {"mae", "median_ae", "p95_ae"}
    return df.select(*by, "n", *[r(F.col(m) + (1e-9 if m in shift else 0.0), digits.get(m, 6)).alias(m)
                                 for m in metrics.METRIC_NAMES if m != "n"])


@query("metrics_by_model", with_obs(_metric_sql("model", "SELECT * FROM pred"), PRED))
def _(spark, sf):
    return _rounded(metrics.metrics(predictions(spark, sf), ["model"]), ["model"])


@query("metrics_basic", with_obs(f"""
  SELECT model, count(*) AS n, round(sqrt(avg({E2})), 6) AS rmse, round(avg(abs(y_pred - y_true)) + 1e-9, 6) AS mae,
    round(1 - sum({E2}) / (var_pop(y_true) * count(*) + 1e-8), 6) AS r2, round(avg({E2}), 4) AS mse
  FROM pred WHERE y_pred IS NOT NULL GROUP BY model""", PRED))
def _(spark, sf):
    out = metrics.basic_metrics(predictions(spark, sf), ["model"])
    return out.select("model", "n", r(F.col("rmse")).alias("rmse"), r(F.col("mae") + 1e-9).alias("mae"),
                      r(F.col("r2")).alias("r2"), r(F.col("mse"), 4).alias("mse"))


STRATUM_SQL = {
    "storm": """SELECT 'Quiet' AS stratum, * FROM pred WHERE kp <= 2 OR dst > -30
      UNION ALL SELECT 'Moderate_Storm', * FROM pred WHERE (kp >= 3 AND kp < 6) OR (dst <= -30 AND dst > -80)
      UNION ALL SELECT 'Strong_Storm', * FROM pred WHERE kp >= 6 OR dst <= -80""",
    "latitude_thirds": """SELECT CASE WHEN abs(latitude) < 30 THEN 'Low_Latitude'
      WHEN abs(latitude) < 60 THEN 'Mid_Latitude' ELSE 'High_Latitude' END AS stratum, * FROM pred""",
    "latitude_zones": """SELECT CASE WHEN abs(latitude) < 20 THEN 'Equatorial'
      WHEN abs(latitude) < 60 THEN 'Mid_Latitude' ELSE 'High_Latitude' END AS stratum, * FROM pred
      WHERE abs(latitude) < 90""",
    "season_hemisphere": """SELECT CASE WHEN d >= 172 AND d < 266 THEN CASE WHEN latitude >= 0 THEN 'Summer' ELSE 'Winter' END
      WHEN d >= 355 OR d < 80 THEN CASE WHEN latitude >= 0 THEN 'Winter' ELSE 'Summer' END
      ELSE 'Equinox' END AS stratum, * FROM (SELECT *, (doy * 13) % 365 + 1 AS d FROM pred)""",
    "season_north": """SELECT CASE WHEN d >= 172 AND d < 266 THEN 'Summer' WHEN d >= 355 OR d < 80 THEN 'Winter'
      ELSE 'Equinox' END AS stratum, * FROM (SELECT *, (doy * 13) % 365 + 1 AS d FROM pred)""",
    "activity": """SELECT CASE WHEN kp <= 3 THEN 'Quiet_Time' ELSE 'Storm_Time' END AS stratum, * FROM pred
      WHERE kp <= 3 OR kp > 5""",
    "solar_cycle": """SELECT CASE WHEN f107 < 100 THEN 'Solar_Minimum' ELSE 'Solar_Maximum' END AS stratum, * FROM pred
      WHERE f107 < 100 OR f107 >= 150""",
}


def _stratified(kind):
    @query(f"metrics_by_{kind}", with_obs(_metric_sql("model, stratum", STRATUM_SQL[kind]), PRED))
    def _(spark, sf):
        p = predictions(spark, sf)
        if kind.startswith("season"):
            # The observations cover one month; the day is spread over the year.
            p = p.withColumn("doy", (F.col("doy") * 13) % 365 + 1)
        return _rounded(metrics.metrics_by(p, kind, ["model"]), ["model", "stratum"])


for _kind in STRATUM_SQL:
    _stratified(_kind)


@query("persistence_by_storm", with_obs(_metric_sql("stratum", """
  SELECT * FROM (SELECT *, lag(tec) OVER (PARTITION BY station ORDER BY ts, event_id) AS y_pred FROM (
      SELECT event_id, station, ts, tec, tec AS y_true, idx_kp / 10 AS kp, idx_dst AS dst FROM filled))
    , LATERAL (SELECT unnest(list_filter([
        CASE WHEN kp <= 2 OR dst > -30 THEN 'Quiet' END,
        CASE WHEN (kp >= 3 AND kp < 6) OR (dst <= -30 AND dst > -80) THEN 'Moderate_Storm' END,
        CASE WHEN kp >= 6 OR dst <= -80 THEN 'Strong_Storm' END], lambda x: x IS NOT NULL)) AS stratum)"""),
    """
num AS (SELECT event_id, station, ts, tec, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) AS i FROM obs)""",
    """
gap AS (
  SELECT *, last_value(CASE WHEN tec IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
         last_value(tec IGNORE NULLS) OVER b AS pv,
         first_value(CASE WHEN tec IS NOT NULL THEN i END IGNORE NULLS) OVER a AS qi,
         first_value(tec IGNORE NULLS) OVER a AS qv
  FROM num WINDOW
    b AS (PARTITION BY station ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY station ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    """
hourly AS (
  SELECT date_trunc('hour', ts) AS hts, round(avg(kp_raw), 3) AS idx_kp, min(dst) AS idx_dst FROM obs GROUP BY 1)""",
    """
filled AS (
  SELECT event_id, station, ts, idx_kp, idx_dst, round(coalesce(tec, CASE WHEN i - pi <= 6 OR qi - i <= 6 THEN
    coalesce(pv + (qv - pv) * (i - pi) / (qi - pi), pv, qv) END), 6) AS tec
  FROM gap LEFT JOIN hourly ON date_trunc('hour', ts) = hts)"""))
def _(spark, sf):
    """Flagship: join hourly indices, interpolate, forecast by persistence, score by storm class."""
    from skywell.checks.base import hourly
    from skywell.operators import features, fills, joins

    keys, order = ["Station"], ["Timestamp", "event_id"]
    o = joins.join_hourly(observations(spark, sf).select("Station", "Timestamp", "event_id", "TEC"),
                          hourly(spark, sf))
    o = fills.fill_gaps(o, ["TEC"], "linear_both", 6, keys, order).withColumn("TEC", F.round("TEC", 6))
    o = features.persistence(o, "TEC", 1, "y_pred", keys, order)
    p = o.select(F.col("TEC").alias("y_true"), "y_pred", (F.col("idx_kp") / 10).alias("kp"),
                 F.col("idx_dst").alias("dst"))
    return _rounded(metrics.metrics_by(p, "storm"), ["stratum"])


@query("storm_degradation", with_obs(f"""
  SELECT model, round(sqrt(avg({E2}) FILTER (WHERE kp >= 6 OR dst <= -80))
    / (sqrt(avg({E2}) FILTER (WHERE kp <= 2 OR dst > -30)) + 1e-8), 6) AS storm_degradation_factor
  FROM pred WHERE y_pred IS NOT NULL GROUP BY model""", PRED))
def _(spark, sf):
    strata = metrics.with_stratum(predictions(spark, sf), "storm")
    out = metrics.storm_degradation(metrics.basic_metrics(strata, ["model", "stratum"]), ["model"])
    return out.withColumn("storm_degradation_factor", r(F.col("storm_degradation_factor")))


@query("station_spread", with_obs(f"""
  SELECT model, round(avg(rmse), 6) AS mean_rmse, round(stddev_pop(rmse), 6) AS std_rmse,
    round(max(rmse), 6) AS max_rmse, round(min(rmse), 6) AS min_rmse, count(*) AS n_stations
  FROM (SELECT model, station, sqrt(avg({E2})) AS rmse FROM pred WHERE y_pred IS NOT NULL GROUP BY ALL)
  GROUP BY model""", PRED))
def _(spark, sf):
    out = metrics.station_spread(predictions(spark, sf), "station", ["model"])
    return out.select("model", *[r(F.col(c)).alias(c) for c in out.columns if c.endswith("rmse")], "n_stations")


@query("generalisation_gap", with_obs(f"""
  SELECT model, round(tr, 6) AS train_rmse, round(te, 6) AS test_rmse, round((te - tr) / (tr + 1e-8) * 100, 4) AS gap_pct
  FROM (SELECT model, sqrt(avg({E2}) FILTER (WHERE split = 'train')) AS tr,
               sqrt(avg({E2}) FILTER (WHERE split = 'test')) AS te
        FROM pred WHERE y_pred IS NOT NULL GROUP BY model)""", PRED))
def _(spark, sf):
    out = metrics.generalisation_gap(predictions(spark, sf), ["model"])
    return out.select("model", r(F.col("train_rmse")).alias("train_rmse"),
                      r(F.col("test_rmse")).alias("test_rmse"), r(F.col("gap_pct"), 4).alias("gap_pct"))


@query("model_comparison", with_obs(f"""
  WITH m AS (SELECT model, sqrt(avg({E2})) AS rmse FROM pred WHERE y_pred IS NOT NULL GROUP BY model)
  SELECT model, round(rmse, 6) AS rmse,
    round((rmse - (SELECT rmse FROM m WHERE model = 'rolling')) / (rmse + 1e-8) * 100, 4) + 0.0 AS improvement_pct,
    model = (SELECT arg_min(model, rmse) FROM m WHERE model <> 'rolling') AS is_best_baseline FROM m""", PRED))
def _(spark, sf):
    out = metrics.compare(metrics.basic_metrics(predictions(spark, sf), ["model"]), "rolling")
    return out.select("model", r(F.col("rmse")).alias("rmse"),
                      r(F.col("improvement_pct"), 4).alias("improvement_pct"), "is_best_baseline")


PHYS = """
phys AS (SELECT event_id, station, ts, topsidetec - 20 AS topside, value AS bottomside,
  (topsidetec - 20 + value) * (1 + (kp_raw - 50) / 200.0) AS net, (value - 2) * 0.1 AS density,
  topsidetec - 20 + value AS base_net,
  lag(topsidetec - 20) OVER (PARTITION BY station ORDER BY ts, event_id) AS prev FROM obs)
"""


def _phys(spark, sf):
    o = observations(spark, sf)
    top = F.col("TopsideTEC") - 20
    return o.select("event_id", F.col("Station").alias("station"), F.col("Timestamp").alias("ts"),
                    top.alias("topside"), F.col("value").alias("bottomside"),
                    ((top + F.col("value")) * (1 + (F.col("kp_raw") - 50) / 200.0)).alias("net"),
                    ((F.col("value") - 2) * 0.1).alias("density"), (top + F.col("value")).alias("base_net"))


@query("physics_score", with_obs("""
  SELECT *, round(0.3 * topside_positive_pct + 0.3 * density_positive_pct + 0.25 * mass_conservation_pct
                  + 0.15 * smoothness_pct, 4) AS physics_score FROM (
    SELECT round(avg((topside >= 0)::INT) * 100, 6) AS topside_positive_pct,
      round(avg((density >= 0)::INT) * 100, 6) AS density_positive_pct,
      round(avg((abs(net - (topside + bottomside)) / (abs(topside + bottomside) + 1e-8) <= 0.15)::INT) * 100, 6) AS mass_conservation_pct,
      round(avg(CASE WHEN prev IS NOT NULL THEN (abs(topside - prev) <= abs(prev) * 0.5 + 5)::INT END) * 100, 6) AS smoothness_pct
    FROM phys)""", PHYS))
def _(spark, sf):
    out = metrics.physics_score(_phys(spark, sf), order=["ts", "event_id"])
    return out.select(*[r(F.col(c), 4 if c == "physics_score" else 6).alias(c) for c in out.columns])


@query("physics_penalty", with_obs("""
  SELECT round(avg(greatest(-topside, 0)), 6) AS topside_negative, round(avg(greatest(-density, 0)), 6) AS density_negative,
    round(avg((net - base_net) * (net - base_net)) * 0.1, 3) AS consistency,
    round(avg(abs(topside - prev)) * 0.05, 6) AS smoothness FROM phys""", PHYS))
def _(spark, sf):
    out = metrics.physics_penalty(_phys(spark, sf), order=["ts", "event_id"])
    return out.select(*[r(F.col(c), 3 if c == "consistency" else 6).alias(c) for c in out.columns if c != "total"])


@query("task_loss", with_obs("""
  SELECT round(avg(pow(1.1 * value - value, 2)), 4) AS loss_topside, round(avg(pow(hmf2 - value * 2, 2)), 4) AS loss_net,
    round(avg(pow(0.2 * value, 2)), 4) AS loss_density, round(avg(pow(fof2 - value, 2)), 4) AS loss_delay,
    round(avg(pow(1.1 * value - value, 2)) + 2 * avg(pow(hmf2 - value * 2, 2)) + avg(pow(0.2 * value, 2))
          + avg(pow(fof2 - value, 2)), 3) AS total_loss FROM obs"""))
def _(spark, sf):
    v = F.col("value")
    o = observations(spark, sf).select(
        (v * 1.1).alias("pred_topside"), v.alias("true_topside"), F.col("hmF2").alias("pred_net"),
        (v * 2).alias("true_net"), (v * 1.2).alias("pred_density"), v.alias("true_density"),
        F.col("foF2").alias("pred_delay"), v.alias("true_delay"))
    out = metrics.task_loss(o, weights={"net": 2.0})
    return out.select(*[r(F.col(c), 3 if c == "total_loss" else 4).alias(c) for c in out.columns])


@query("scientific_score", with_obs(f"""
  SELECT model, round(greatest(0, least(100, greatest(0, r2 * 40) + 0.3 * 80 + greatest(0, 15 - gap / 20 * 15)
    + greatest(0, 10 - (deg - 1) / 2 * 10) + 5)), 4) AS score FROM (
    SELECT model, 1 - sum({E2}) / (var_pop(y_true) * count(*) + 1e-8) AS r2,
      (sqrt(avg({E2}) FILTER (WHERE split = 'test')) - sqrt(avg({E2}) FILTER (WHERE split = 'train')))
        / (sqrt(avg({E2}) FILTER (WHERE split = 'train')) + 1e-8) * 100 AS gap,
      sqrt(avg({E2}) FILTER (WHERE kp >= 6 OR dst <= -80)) / (sqrt(avg({E2}) FILTER (WHERE kp <= 2 OR dst > -30)) + 1e-8) AS deg
    FROM pred WHERE y_pred IS NOT NULL GROUP BY model)""", PRED))
def _(spark, sf):
    p = predictions(spark, sf)
    parts = metrics.basic_metrics(p, ["model"]).join(metrics.generalisation_gap(p, ["model"]), "model").join(
        metrics.storm_degradation(metrics.basic_metrics(metrics.with_stratum(p, "storm"), ["model", "stratum"]),
                                  ["model"]), "model", "left")
    score = metrics.scientific_score(F.col("r2"), F.lit(80.0), F.col("gap_pct"), F.col("storm_degradation_factor"))
    return parts.select("model", r(score, 4).alias("score"))


READY = """
flags AS (SELECT station, day, bool_or(topside < 0) AS negative_topside, bool_or(density < 0) AS negative_density,
    bool_or(net > 900) AS extreme_tec, coalesce(bool_or(abs(topside - p) > 600), false) AS massive_jump,
    max(kp) AS kp, min(dst) AS dst, avg(conf) AS conf
  FROM (SELECT station, CAST(date_trunc('day', ts) AS DATE) AS day, topsidetec - 1 AS topside, (value - 2) * 0.1 AS density,
          topsidetec + value AS net, kp, dst, exp(-value / 100) AS conf,
          lag(topsidetec - 1) OVER (PARTITION BY station, date_trunc('day', ts) ORDER BY ts, event_id) AS p FROM obs)
  GROUP BY ALL)
"""


def _daily(spark, sf):
    o = observations(spark, sf)
    return o.select("event_id", F.col("Station").alias("station"), F.col("Timestamp").alias("ts"),
                    F.to_date("Timestamp").alias("day"), (F.col("TopsideTEC") - 1).alias("topside"),
                    ((F.col("value") - 2) * 0.1).alias("density"), (F.col("TopsideTEC") + F.col("value")).alias("net"),
                    F.col("Kp").alias("kp"), F.col("Dst").alias("dst"), F.exp(-F.col("value") / 100).alias("conf"))


@query("window_anomalies", with_obs("""
  SELECT station, strftime(day, '%Y-%m-%d') AS day, negative_topside, negative_density, extreme_tec, massive_jump,
    negative_topside OR negative_density OR extreme_tec OR massive_jump AS is_anomalous FROM flags""", READY))
def _(spark, sf):
    out = metrics.anomalies(_daily(spark, sf), "day", order=["ts", "event_id"], cap=900.0, max_step=600.0)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("operational_readiness", with_obs("""
  SELECT station, strftime(day, '%Y-%m-%d') AS day, round(greatest(0, least(100, 100 - (1 - conf) * 50
    - CASE WHEN negative_topside THEN 40 ELSE 0 END - CASE WHEN extreme_tec THEN 20 ELSE 0 END
    - CASE WHEN massive_jump THEN 15 ELSE 0 END - CASE WHEN kp >= 8 OR dst <= -150 THEN 10 ELSE 0 END)), 6) AS readiness
  FROM flags""", READY))
def _(spark, sf):
    from skywell.functions.rules import storm_state
    daily = _daily(spark, sf)
    flags = metrics.anomalies(daily, "day", order=["ts", "event_id"], cap=900.0, max_step=600.0)
    means = daily.groupBy("station", "day").agg(F.avg("conf").alias("conf"), F.max("kp").alias("kp"), F.min("dst").alias("dst"))
    joined = flags.join(means, ["station", "day"])
    _, level = storm_state(F.col("kp"), F.col("dst"))
    return joined.select("station", F.date_format("day", "yyyy-MM-dd").alias("day"),
                         r(metrics.readiness(F.col("conf"), level)).alias("readiness"))


PAIR = """
d AS (SELECT abs(persistence - y_true) - abs(rolling - y_true) AS d FROM wide
      WHERE persistence IS NOT NULL AND rolling IS NOT NULL)
"""


@query("paired_t_test", with_obs("""
  SELECT count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t_statistic FROM d""", PRED, PAIR))
def _(spark, sf):
    d = stats.paired_errors(predictions_wide(spark, sf), a="persistence", b="rolling")
    return stats.t_test(d).select("n", r(F.col("t_statistic")).alias("t_statistic"))


def _pair(spark, sf):
    return stats.paired_errors(predictions_wide(spark, sf), a="persistence", b="rolling").select(
        F.round("d", 6).alias("d"))


@query("wilcoxon_test", with_obs("""
  WITH x AS (SELECT round(d, 6) AS d FROM d WHERE round(d, 6) <> 0),
  k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk,
               count(*) OVER (PARTITION BY abs(d)) AS t FROM x),
  s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS rp,
               sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS rm, sum((t::DOUBLE * t * t - t) / t) AS ties FROM k)
  SELECT CAST(n AS BIGINT) AS n_nonzero, least(rp, rm) AS w_statistic,
    round((least(rp, rm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS w_z FROM s""",
    PRED, PAIR))
def _(spark, sf):
    return stats.wilcoxon(_pair(spark, sf)).select(
        "n_nonzero", "w_statistic", r(F.col("w_z")).alias("w_z"))


# (n, s, c): c subsets of the ranks 1..n have the sum s.
SUBSETS = """
subsets AS (
  WITH RECURSIVE grown AS (
    SELECT 0 AS n, 0 AS s, CAST(1 AS BIGINT) AS c
    UNION ALL
    SELECT n + 1, s + t.up * (n + 1), CAST(sum(c) AS BIGINT) FROM grown, (VALUES (0), (1)) t(up) WHERE n < 50 GROUP BY ALL)
  SELECT * FROM grown)
"""


@query("wilcoxon_by_day", with_obs("""
  WITH e AS (SELECT station, day(ts) AS day, round(abs(persistence - y_true) - abs(rolling - y_true), 6) AS d FROM wide),
  x AS (SELECT * FROM e WHERE d <> 0),
  k AS (SELECT *, rank() OVER (PARTITION BY station, day ORDER BY abs(d)) + (count(*) OVER (PARTITION BY station, day, abs(d)) - 1) / 2.0 AS rk,
               count(*) OVER (PARTITION BY station, day, abs(d)) AS t FROM x),
  s AS (SELECT station, day, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w,
               max(t) = 1 AND count(*) <= 50 AS w_exact FROM k GROUP BY station, day)
  SELECT station, day, n AS n_nonzero, CAST(w AS DOUBLE) AS w_statistic, w_exact, round(CASE WHEN w_exact THEN least(1.0, 2 * (
    SELECT sum(c) FROM subsets WHERE subsets.n = s.n AND subsets.s <= s.w) / pow(2.0, n)) END, 9) AS exact_p FROM s""", PRED, SUBSETS))
def _(spark, sf):
    """The test within each station and day of month: few pairs each, so most p-values are exact."""
    wide = predictions_wide(spark, sf).withColumn("day", F.dayofmonth("ts").cast("long"))
    d = wide.select("station", "day", F.round(F.abs(F.col("persistence") - F.col("y_true")) - F.abs(
        F.col("rolling") - F.col("y_true")), 6).alias("d"))
    return stats.wilcoxon(d, ["station", "day"]).select("station", "day", "n_nonzero", "w_statistic", "w_exact", r(F.when(
        F.col("w_exact"), F.col("w_p_value")), 9).alias("exact_p"))


@query("cohens_d", with_obs("SELECT round(avg(d) / (stddev_pop(d) + 1e-8), 6) AS cohens_d FROM d", PRED, PAIR))
def _(spark, sf):
    d = stats.paired_errors(predictions_wide(spark, sf), a="persistence", b="rolling")
    return stats.cohens_d(d).select(r(F.col("cohens_d")).alias("cohens_d"))


@query("friedman_test", with_obs("""
  WITH e AS (SELECT event_id, model, round(abs(y_pred - y_true), 6) AS e FROM pred WHERE y_pred IS NOT NULL),
  f AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS c FROM e) WHERE c = 3),
  k AS (SELECT model, rank() OVER (PARTITION BY event_id ORDER BY e) + (count(*) OVER (PARTITION BY event_id, e) - 1) / 2.0 AS rk,
               count(*) OVER (PARTITION BY event_id, e) AS t FROM f),
  s AS (SELECT model, sum(rk) AS rs, CAST(count(*) AS DOUBLE) AS n, sum((t::DOUBLE * t * t - t) / t) AS ties FROM k GROUP BY model)
  SELECT count(*) AS n_models, CAST(max(n) AS BIGINT) AS n_samples,
    round((12 / (max(n) * 3 * 4) * sum(rs * rs) - 3 * max(n) * 4) / (1 - sum(ties) / (max(n) * 3 * 8)), 6) AS chi_square FROM s""",
    PRED))
def _(spark, sf):
    long = predictions(spark, sf).select(F.col("event_id").alias("idx"), "model",
                                         F.round(F.abs(F.col("y_pred") - F.col("y_true")), 6).alias("abs_error"))
    return stats.friedman(long).select("n_models", "n_samples", r(F.col("chi_square")).alias("chi_square"))


@query("test_bundle", with_obs("""
  SELECT count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t_statistic,
         round(avg(d) / (stddev_pop(d) + 1e-8), 6) AS cohens_d FROM d""", PRED, PAIR))
def _(spark, sf):
    out = stats.all_tests(predictions_wide(spark, sf), a="persistence", b="rolling")
    return out.select("n", r(F.col("t_statistic")).alias("t_statistic"), r(F.col("cohens_d")).alias("cohens_d"))


@query("taylor_statistics", with_obs("""
  SELECT model, round(stddev_pop(y_pred), 6) AS std_pred, round(stddev_pop(y_true), 6) AS std_ref,
    round(corr(y_true, y_pred), 6) + 0.0 AS correlation, round(acos(corr(y_true, y_pred)), 6) AS angle
  FROM pred WHERE y_pred IS NOT NULL GROUP BY model""", PRED))
def _(spark, sf):
    out = metrics.taylor(predictions(spark, sf))
    return out.select("model", *[r(F.col(c)).alias(c) for c in out.columns if c != "model"])


@query("error_boxes", with_obs("""
  WITH e AS (SELECT model, abs(y_pred - y_true) AS e FROM pred WHERE y_pred IS NOT NULL),
  q AS (SELECT model, min(e) AS minimum, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS median,
               quantile_cont(e, 0.75) AS q3, max(e) AS maximum FROM e GROUP BY model)
  SELECT q.model, round(any_value(minimum), 6) AS minimum, round(any_value(q1), 6) AS q1,
    round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(any_value(maximum), 6) AS maximum,
    round(min(e) FILTER (WHERE e BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
    round(max(e) FILTER (WHERE e BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
    count(*) FILTER (WHERE NOT e BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_fliers
  FROM e JOIN q USING (model) GROUP BY q.model""", PRED))
def _(spark, sf):
    out = metrics.box_stats(predictions(spark, sf))
    return out.select("model", *[r(F.col(c)).alias(c) for c in out.columns if c not in ("model", "n_fliers")],
                      "n_fliers")


@query("residual_histogram", with_obs("""
  WITH e AS (SELECT round(rolling - y_true, 4) AS e FROM wide WHERE rolling IS NOT NULL),
  x AS (SELECT min(e) AS lo, max(e) AS hi FROM e),
  b AS (SELECT CAST(least(floor((e - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n FROM e, x GROUP BY 1)
  SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS low,
         round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS high, coalesce(b.n, 0) AS n
  FROM range(50) g(bin) CROSS JOIN x LEFT JOIN b ON b.bin = g.bin""", PRED))
def _(spark, sf):
    p = predictions_wide(spark, sf).filter("rolling is not null").select(
        F.lit(0.0).alias("y_true"), F.round(F.col("rolling") - F.col("y_true"), 4).alias("y_pred"))
    out = metrics.residual_histogram(p)
    return out.select("bin", r(F.col("low")).alias("low"), r(F.col("high")).alias("high"), "n")


@query("value_extent", with_obs("""
  SELECT least(min(y_true), min(rolling)) AS low, greatest(max(y_true), max(rolling)) AS high FROM wide""", PRED))
def _(spark, sf):
    return metrics.extent(predictions_wide(spark, sf), "y_true", "rolling")


@query("run_log_summary", """
  SELECT 'l_quantity' AS measure, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std,
         min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
  UNION ALL SELECT 'l_tax', round(avg(l_tax), 4), round(stddev_samp(l_tax), 4), min(l_tax), max(l_tax) FROM lineitem""")
def _(spark, sf):
    return metrics.run_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])


@query("lowest_loss_entries", """
  SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (
    PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def _(spark, sf):
    return metrics.keep_lowest(table(spark, sf, "orders"), 3, "o_totalprice", ["o_orderpriority"],
                               ["o_orderkey"]).select("o_orderpriority", "o_orderkey")
