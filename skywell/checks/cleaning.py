"""Filling, outlier treatment, scaling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywell.checks.base import observations, query, r, table, with_obs
from skywell.operators import fills, outliers, scaling, splitting
from skywell.schema import Settings, col

KEYS, ORDER = ["Station"], ["Timestamp", "event_id"]

# Position, and previous / next valid value with its position and time, per station.
GAPS = """
num AS (SELECT event_id, station, ts, tec, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) AS i
        FROM obs),
gap AS (
  SELECT *, last_value(CASE WHEN tec IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
         last_value(tec IGNORE NULLS) OVER b AS pv,
         last_value(CASE WHEN tec IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER b AS pt,
         first_value(CASE WHEN tec IS NOT NULL THEN i END IGNORE NULLS) OVER a AS qi,
         first_value(tec IGNORE NULLS) OVER a AS qv,
         first_value(CASE WHEN tec IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER a AS qt
  FROM num WINDOW
    b AS (PARTITION BY station ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY station ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""
LINE = "coalesce(pv + (qv - pv) * (i - pi) / (qi - pi), pv, qv)"
TIME_LINE = "coalesce(pv + (qv - pv) * (epoch_us(ts) - pt) / (qt - pt), pv)"


def _fill(name, method, limit, expr, cond):
    @query(name, with_obs(
        f"SELECT event_id, round(coalesce(tec, CASE WHEN {cond} THEN {expr} END), 6) AS tec FROM gap", GAPS))
    def _(spark, sf):
        out = fills.fill_gaps(observations(spark, sf), ["TEC"], method, limit, KEYS, ORDER)
        return out.select("event_id", r(F.col("TEC")).alias("tec"))


_fill("forward_fill", "ffill", 1, "pv", "i - pi <= 1")
_fill("backward_fill", "bfill", 1, "qv", "qi - i <= 1")
_fill("interpolate_both_ways", "linear_both", 2, LINE, "i - pi <= 2 OR qi - i <= 2")
_fill("interpolate_forward", "linear", 2, f"CASE WHEN pv IS NOT NULL THEN {LINE} END", "i - pi <= 2")
_fill("interpolate_in_time", "time", 3, TIME_LINE, "i - pi <= 3")


@query("statistic_fill", with_obs("""
  SELECT event_id, coalesce(tec, quantile_cont(tec, 0.5) OVER (PARTITION BY station)) AS by_station,
         round(coalesce(kp, avg(kp) OVER ()), 6) AS overall_mean FROM obs"""))
def _(spark, sf):
    o = fills.fill_statistic(observations(spark, sf), ["TEC"], "median", ["Station"])
    o = fills.fill_statistic(o, ["Kp"], "mean")
    return o.select("event_id", F.col("TEC").alias("by_station"), r(F.col("Kp")).alias("overall_mean"))


@query("drop_null_rows", with_obs(
    "SELECT event_id FROM obs WHERE tec IS NOT NULL AND kp IS NOT NULL AND qf IS NOT NULL"))
def _(spark, sf):
    return fills.drop_null(observations(spark, sf), ["TEC", "Kp", "QF"]).select("event_id")


@query("fill_with_fallback", with_obs(f"""
  SELECT event_id, round(coalesce(f, quantile_cont(f, 0.5) OVER ()), 6) AS tec FROM (
    SELECT event_id, coalesce(tec, CASE WHEN i - pi <= 1 OR qi - i <= 1 THEN {LINE} END) AS f FROM gap)""",
    GAPS))
def _(spark, sf):
    out = fills.handle_missing(observations(spark, sf), "interpolate", 1, "median", ["TEC"], KEYS, ORDER)
    return out.select("event_id", r(F.col("TEC")).alias("tec"))


@query("first_per_timestamp", """
  SELECT o_custkey, CAST(epoch(o_orderdate) AS BIGINT) AS day, o_orderkey, o_totalprice FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS rn FROM orders)
  WHERE rn = 1""")
def _(spark, sf):
    o = fills.keep_first(table(spark, sf, "orders"), ["o_custkey", "o_orderdate"], ["o_orderkey"])
    return o.select("o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("day"),
                    "o_orderkey", "o_totalprice")


Q = "quantile_cont({c}, {p}) OVER ()"
IQR = """
iqr AS (SELECT event_id, value, b0, tec, kp,
  value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS value_iqr,
  coalesce(tec < t1 - 1.5 * (t3 - t1) OR tec > t3 + 1.5 * (t3 - t1), false) AS tec_iqr,
  coalesce(abs(tec - mu) / sd > 2.5, false) AS tec_z
  FROM obs, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
    quantile_cont(tec, 0.25) AS t1, quantile_cont(tec, 0.75) AS t3, avg(tec) AS mu,
    stddev_samp(tec) AS sd FROM obs))
"""


def _masked(spark, sf):
    o = outliers.iqr_mask(observations(spark, sf), ["value", "TEC"], 1.5)
    return outliers.z_mask(o, ["TEC"], 2.5)


@query("outlier_masks", with_obs("SELECT event_id, value_iqr, tec_iqr, tec_z, tec_iqr OR tec_z AS tec_any FROM iqr", IQR))
def _(spark, sf):
    o, _ = outliers.union_mask(_masked(spark, sf))
    return o.select("event_id", F.col("_mask_iqr_value").alias("value_iqr"),
                    F.col("_mask_iqr_TEC").alias("tec_iqr"), F.col("_mask_zscore_TEC").alias("tec_z"),
                    F.col("_out_TEC").alias("tec_any"))


@query("outlier_counts", with_obs("""
  SELECT 'iqr' AS method, 'value' AS "column", count_if(value_iqr) AS flagged,
         round(count_if(value_iqr) / count(*), 6) AS fraction FROM iqr
  UNION ALL SELECT 'iqr', 'TEC', count_if(tec_iqr), round(count_if(tec_iqr) / count(*), 6) FROM iqr
  UNION ALL SELECT 'zscore', 'TEC', count_if(tec_z), round(count_if(tec_z) / count(*), 6) FROM iqr
  UNION ALL SELECT 'any', '*', count_if(value_iqr OR tec_iqr OR tec_z),
         round(count_if(value_iqr OR tec_iqr OR tec_z) / count(*), 6) FROM iqr""", IQR))
def _(spark, sf):
    return outliers.outlier_counts(_masked(spark, sf)).select(
        "method", "column", "flagged", r(F.col("fraction")).alias("fraction"))


@query("outlier_clip", with_obs("""
  SELECT event_id, round(CASE WHEN any_v THEN greatest(least(value, hi), lo) ELSE value END, 6) AS value,
    round(CASE WHEN tec IS NULL THEN NULL WHEN any_t THEN greatest(least(tec, thi), tlo) ELSE tec END, 6) AS tec
  FROM iqr, (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi,
    quantile_cont(tec, 0.01) AS tlo, quantile_cont(tec, 0.99) AS thi, bool_or(value_iqr) AS any_v,
    bool_or(tec_iqr OR tec_z) AS any_t FROM iqr)""", IQR))
def _(spark, sf):
    o, cols = outliers.union_mask(_masked(spark, sf))
    return outliers.act_clip(o, cols).select("event_id", r(F.col("value")).alias("value"),
                                             r(F.col("TEC")).alias("tec"))


@query("outlier_null", with_obs("""
  SELECT event_id, CASE WHEN NOT value_iqr THEN value END AS value,
         CASE WHEN NOT (tec_iqr OR tec_z) THEN tec END AS tec FROM iqr""", IQR))
def _(spark, sf):
    o, cols = outliers.union_mask(_masked(spark, sf))
    return outliers.act_null(o, cols).select("event_id", "value", F.col("TEC").alias("tec"))


@query("outlier_drop", with_obs(
    "SELECT event_id FROM iqr WHERE NOT (value_iqr OR tec_iqr OR tec_z)", IQR))
def _(spark, sf):
    o, cols = outliers.union_mask(_masked(spark, sf))
    return outliers.act_drop(o, cols).select("event_id")


@query("outlier_flag", with_obs("""
  SELECT event_id, CAST(value_iqr AS INT) AS value_outlier_flag,
         CAST(tec_iqr OR tec_z AS INT) AS tec_outlier_flag FROM iqr""", IQR))
def _(spark, sf):
    o, cols = outliers.union_mask(_masked(spark, sf))
    return outliers.act_flag(o, cols).select(
        "event_id", "value_outlier_flag", F.col("TEC_outlier_flag").alias("tec_outlier_flag"))


@query("isolation_forest_mask")
def _(spark, sf):
    o = outliers.forest_mask(observations(spark, sf), ["TEC", "foF2", "hmF2", "F10.7", "Kp", "Dst"],
                             identity=("event_id",))
    return o.select("event_id", F.col("_mask_isolation_forest_TEC").alias("flagged"))


@query("outlier_treatment", with_obs("""
  SELECT count(*) AS n, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean FROM (
    SELECT CASE WHEN tec IS NULL THEN NULL WHEN a THEN greatest(least(tec, hi), lo) ELSE tec END AS v
    FROM iqr0, (SELECT quantile_cont(tec, 0.01) AS lo, quantile_cont(tec, 0.99) AS hi,
                       bool_or(bad) AS a FROM iqr0))""",
    """
iqr0 AS (SELECT tec, coalesce(tec < t1 - 2.5 * (t3 - t1) OR tec > t3 + 2.5 * (t3 - t1)
           OR abs(tec - mu) / sd > 3.5, false) AS bad
  FROM obs, (SELECT quantile_cont(tec, 0.25) AS t1, quantile_cont(tec, 0.75) AS t3, avg(tec) AS mu,
    stddev_samp(tec) AS sd FROM obs))
"""))
def _(spark, sf):
    # The SQL has one column; `outlier_treatment_rows` has all that are treated, row by row.
    o = outliers.treat_outliers(observations(spark, sf), Settings(), ("event_id",))
    return o.agg(F.count(F.lit(1)).alias("n"), r(F.min("TEC")).alias("lo"), r(F.max("TEC")).alias("hi"),
                 r(F.avg("TEC")).alias("mean"))


@query("outlier_treatment_rows")
def _(spark, sf):
    o = outliers.treat_outliers(observations(spark, sf), Settings(), ("event_id",))
    return o.select("event_id", *[r(col(c)).alias(c.lower().replace(".", "")) for c in Settings().forest_columns])


LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _params_sql(center, scale):
    return "\n  UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round({center.format(c=c)}, 4) AS center, "
        f"round(CASE WHEN {scale.format(c=c)} = 0 THEN 1 ELSE {scale.format(c=c)} END, 4) AS scale "
        f"FROM lineitem" for c in LINE_COLS)


def _scaler(name, kind, center, scale):
    @query(name, _params_sql(center, scale))
    def _(spark, sf):
        p = scaling.fit_scaler(table(spark, sf, "lineitem"), LINE_COLS, kind)
        return p.select("column", r(F.col("center"), 4).alias("center"), r(F.col("scale"), 4).alias("scale"))


_scaler("scaler_robust", "robust", "quantile_cont({c}, 0.5)",
        "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))")
_scaler("scaler_standard", "standard", "avg({c})", "stddev_pop({c})")
_scaler("scaler_minmax", "minmax", "min({c})", "(max({c}) - min({c}))")


@query("scale_on_train", with_obs("""
  SELECT event_id, round((value - m) / s, 6) + 0.0 AS value, round((kp - km) / ks, 6) + 0.0 AS kp
  FROM obs, (SELECT avg(value) AS m, stddev_pop(value) AS s, avg(kp) AS km, stddev_pop(kp) AS ks
             FROM obs WHERE day(ts) <= 20)"""))
def _(spark, sf):
    o = observations(spark, sf).withColumn(
        "split", F.when(F.dayofmonth("Timestamp") <= 20, "train").otherwise("test"))
    out, _, _ = scaling.fit_on_train(o, ["value", "Kp"], ["value"], "standard")
    return out.select("event_id", r(F.col("value")).alias("value"), r(F.col("Kp")).alias("kp"))


@query("scale_inverse", with_obs("SELECT event_id, round(value, 6) AS value, round(kp, 6) AS kp FROM obs"))
def _(spark, sf):
    o = observations(spark, sf)
    p = scaling.fit_scaler(o, ["value", "Kp"], "robust")
    out = scaling.inverse(scaling.transform(o, p, ["value", "Kp"]), p, ["value", "Kp"])
    return out.select("event_id", r(F.col("value")).alias("value"), r(F.col("Kp")).alias("kp"))


@query("split_temporal", """
  SELECT o_orderkey, CASE WHEN i < floor(n * 0.7) THEN 'train'
         WHEN i < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i,
               CAST(count(*) OVER () AS DOUBLE) AS n FROM orders)""")
def _(spark, sf):
    return splitting.split_ordered(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "split")


@query("split_random")
def _(spark, sf):
    return splitting.split_random(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "split")


@query("split_by_station")
def _(spark, sf):
    return splitting.split_station(observations(spark, sf)).select("event_id", "Station", "split")


@query("split_random_sizes", """
  SELECT 'train' AS split, CAST(floor(count(*) * 0.7::DOUBLE) AS BIGINT) AS n FROM orders
  UNION ALL SELECT 'val', CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) FROM orders
  UNION ALL SELECT 'test', CAST(count(*) - floor(count(*) * 0.7::DOUBLE) - floor(count(*) * 0.15::DOUBLE) AS BIGINT) FROM orders""")
def _(spark, sf):
    return splitting.split_random(table(spark, sf, "orders"), ["o_orderkey"]).groupBy("split").agg(F.count("*").alias("n"))


@query("split_by_station_whole", with_obs("""
  SELECT station, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_splits FROM obs GROUP BY station"""))
def _(spark, sf):
    return splitting.split_station(observations(spark, sf)).groupBy(F.col("Station").alias("station")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("split").alias("n_splits"))


@query("isolation_forest_share", with_obs("""
  SELECT count(*) AS n, true AS within_one_rank FROM obs"""))
def _(spark, sf):
    o = outliers.forest_mask(observations(spark, sf), ["TEC", "foF2", "hmF2", "F10.7", "Kp", "Dst"], identity=("event_id",))
    usable = F.count_if(F.col("_mask_isolation_forest_TEC").isNotNull())
    flagged = F.count_if(F.col("_mask_isolation_forest_TEC"))
    return o.agg(F.count("*").alias("n"), (flagged <= F.ceil(0.05 * usable) + 1).alias("within_one_rank"))


@query("leave_one_station_out", with_obs("""
  SELECT station AS fold, count(*) AS n_test, (SELECT count(*) FROM obs) - count(*) AS n_train
  FROM obs GROUP BY station"""))
def _(spark, sf):
    return splitting.fold_sizes(observations(spark, sf))
