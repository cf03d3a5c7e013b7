"""Order-dependent operators: lags, rolling statistics, gaps, sequences, ranks."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from skywell.checks.base import observations, query, r, table, us, with_obs
from skywell.operators import features, fills, groups, sequences
from skywell.operators.ordering import with_average_rank
from skywell.schema import Settings

KEYS, ORDER = ["Station"], ["Timestamp", "event_id"]

W = "WINDOW s AS (PARTITION BY station ORDER BY ts, event_id)"


@query("series_features", with_obs(f"""
  SELECT event_id, round(tec - lag(tec, 1) OVER s, 6) + 0.0 AS diff1,
    lag(tec, 1) OVER s AS lag1, lag(tec, 2) OVER s AS lag2, lag(tec, 3) OVER s AS lag3,
    round(CASE WHEN tec IS NULL THEN 0 ELSE coalesce(
      (lead(tec IGNORE NULLS) OVER s - lag(tec IGNORE NULLS) OVER s) / 2,
      lead(tec IGNORE NULLS) OVER s - tec, tec - lag(tec IGNORE NULLS) OVER s, 0) END, 6) + 0.0 AS gradient,
    CASE WHEN count(tec) OVER w3 >= 1 THEN round(avg(tec) OVER w3, 6) END AS mean3,
    CASE WHEN count(tec) OVER w6 >= 3 THEN round(avg(tec) OVER w6, 6) END AS mean6,
    CASE WHEN count(tec) OVER w12 >= 6 THEN round(avg(tec) OVER w12, 6) END AS mean12,
    CASE WHEN count(tec) OVER w3 >= 2 THEN round(stddev_samp(tec) OVER w3, 5) END AS std3,
    CASE WHEN count(tec) OVER w6 >= 3 THEN round(stddev_samp(tec) OVER w6, 5) END AS std6,
    CASE WHEN count(tec) OVER w12 >= 6 THEN round(stddev_samp(tec) OVER w12, 5) END AS std12
  FROM obs {W},
    w3 AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
    w6 AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
    w12 AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""))
def _(spark, sf):
    out = features.series_features(observations(spark, sf), "TEC", KEYS, ORDER)
    return out.select(
        "event_id", r(F.col("TEC_diff1")).alias("diff1"),
        *[F.col(f"TEC_lag{k}").alias(f"lag{k}") for k in (1, 2, 3)],
        r(F.col("TEC_gradient")).alias("gradient"),
        *[r(F.col(f"TEC_roll_mean_{w}")).alias(f"mean{w}") for w in (3, 6, 12)],
        *[r(F.col(f"TEC_roll_std_{w}"), 5).alias(f"std{w}") for w in (3, 6, 12)])


@query("station_mean_centred", with_obs("""
  SELECT event_id, round(value - avg(value) OVER (PARTITION BY station) + 1e-9, 6) + 0.0 AS centred FROM obs"""))
def _(spark, sf):
    o = observations(spark, sf).select("Station", "event_id", "value")
    means = o.groupBy("Station").agg(F.avg("value").alias("mean"))
    return o.join(means, "Station").withColumn("centred", F.col("value") - F.col("mean")).select(
        "event_id", r(F.col("centred") + 1e-9).alias("centred"))


def _sum_and_count(rows):
    return {"s": float(rows["value"].sum()), "c": len(rows)}


def _added(a, b):
    return {"s": a["s"] + b["s"], "c": a["c"] + b["c"]}


@query("per_group_centring", with_obs("""
  SELECT event_id, round(value - avg(value) OVER (PARTITION BY station) + 1e-9, 6) + 0.0 AS centred FROM obs"""))
def _(spark, sf):
    """User code per station: a fold for the mean, then a pass over the station's rows."""
    o = observations(spark, sf).select("Station", "Timestamp", "event_id", "value")
    means = groups.fold_groups(o, ["Station"], _sum_and_count, _added, "s double, c long", ["value"])

    def centred(batches):
        for b in batches:
            mean = pc.divide(b.column("s"), pc.cast(b.column("c"), pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("event_id"), pc.subtract(b.column("value"), mean), b.column("own")], ["event_id", "centred", "own"])

    out = groups.map_groups(o.join(means, "Station"), KEYS, ORDER, centred, "event_id long, centred double")
    return out.select("event_id", r(F.col("centred") + 1e-9).alias("centred"))


@query("per_group_filling", with_obs(f"""
  SELECT event_id, coalesce(tec, lag(tec, 1) OVER s, lag(tec, 2) OVER s, lag(tec, 3) OVER s) AS filled FROM obs {W}"""))
def _(spark, sf):
    """User code per station: the last value, at most three rows old."""
    def filled(batches):
        held, age = None, 0
        for b in batches:
            out = []
            for v in b.column("TEC").to_pylist():
                held, age = (v, 0) if v is not None else (held, age + 1)
                out.append(held if age <= 3 else None)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(out, pa.float64()), b.column("own")],
                                             ["event_id", "filled", "own"])

    o = observations(spark, sf).select("Station", "Timestamp", "event_id", "TEC")
    return groups.map_groups(o, KEYS, ORDER, filled, "event_id long, filled double", before=3)


@query("time_gaps", with_obs(f"""
  SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER s) / 1e6, 6) AS delta_s,
    coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER s) / 1e6 > 86400, false) AS is_gap,
    coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER s) < 0, false) AS is_reversal
  FROM obs {W}"""))
def _(spark, sf):
    return features.time_deltas(observations(spark, sf), KEYS, ORDER).select(
        "event_id", r(F.col("delta_s")).alias("delta_s"), "is_gap", "is_reversal")


@query("modal_step", """
  WITH d AS (SELECT o_custkey AS station, date_diff('second', lag(o_orderdate) OVER (
      PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS step FROM orders),
  c AS (SELECT station, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY n DESC, step) AS rn FROM c)
  SELECT station, CAST(step AS DOUBLE) AS step_seconds,
         CAST(CASE WHEN step > 0 THEN floor(10800.0 / step) ELSE 12 END AS BIGINT) AS row_limit
  FROM k WHERE rn = 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("station"), "o_orderdate", "o_orderkey")
    out = fills.modal_step(o, ["station"], ["o_orderdate", "o_orderkey"])
    return out.withColumn("row_limit", fills.step_limit(F.col("step_seconds")))


@query("average_rank_global", """
  SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rank
  FROM events""")
def _(spark, sf):
    return with_average_rank(table(spark, sf, "events"), "value", "rank").select("event_id", "rank")


@query("average_rank_grouped", """
  SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value)
         + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events""")
def _(spark, sf):
    return with_average_rank(table(spark, sf, "events"), "value", "rank", ["event_type"]).select(
        "event_id", "rank")


@query("step_jumps", with_obs(f"""
  SELECT event_id, round(abs(value - lag(value) OVER s), 6) AS step,
    coalesce(abs(value - lag(value) OVER s) > 20, false) AS jump_abs,
    coalesce(abs(value - lag(value) OVER s) > abs(lag(value) OVER s) * 0.5 + 5, false) AS jump_rel
  FROM obs {W}"""))
def _(spark, sf):
    return features.jumps(observations(spark, sf), "value", KEYS, ORDER).select(
        "event_id", r(F.col("step")).alias("step"), "jump_abs", "jump_rel")


@query("persistence_forecast", with_obs(f"""
  SELECT event_id, lag(value, 2) OVER s AS prediction FROM obs {W}"""))
def _(spark, sf):
    return features.persistence(observations(spark, sf), "value", 2, keys=KEYS, order=ORDER).select(
        "event_id", "prediction")


def _seq_sql(width, extra, keep, label):
    return with_obs(f"""
  SELECT station, start, start_us, end_us, completeness, y, x_sum, y_x_last FROM (
    SELECT station, row_number() OVER s - 1 AS start, epoch_us(ts) AS start_us,
      lead(epoch_us(ts), {width - 1}) OVER s AS end_us,
      round((count(tec) OVER w + count(kp) OVER w) / (2.0 * {width}), 6) AS completeness,
      lead({label}, {width - 1 + extra}) OVER s AS y,
      round(coalesce(sum(tec) OVER w, 0) + coalesce(sum(kp) OVER w, 0), 4) AS x_sum,
      coalesce(lead(tec, {width - 1}) OVER s, 0) AS y_x_last,
      count(*) OVER (PARTITION BY station) AS n
    FROM rowset {W}, w AS (PARTITION BY station ORDER BY ts, event_id
      ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)) WHERE {keep}""",
    "rowset AS (SELECT * FROM obs" + (" WHERE tec IS NOT NULL AND kp IS NOT NULL" if extra else "") + ")")


def _shape(seq, y=True):
    total = F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, b: a + b)
    return seq.select(
        F.col("Station").alias("station"), F.col("start"), us(F.col("start_ts")).alias("start_us"),
        us(F.col("end_ts")).alias("end_us"), r(F.col("completeness")).alias("completeness"),
        *([F.col("y")] if y else []), r(total, 4).alias("x_sum"),
        F.element_at("x", -1)[0].alias("y_x_last"))


@query("sequences_reference", _seq_sql(
    24, 0, "start < n - 24 AND start % 2 = 0 AND completeness >= 0.8 AND y IS NOT NULL", "tec"))
def _(spark, sf):
    return _shape(sequences.sequences(observations(spark, sf), ["TEC", "Kp"], "TEC", 24, 2,
                                      keys=KEYS, order=ORDER))


@query("sequences_with_horizon", _seq_sql(24, 3, "start < n - 24 - 3 + 1", "tec"))
def _(spark, sf):
    return _shape(sequences.sequences_ahead(observations(spark, sf), ["TEC", "Kp"], "TEC", 24, 3,
                                            keys=KEYS, order=ORDER))


@query("windows_without_label", _seq_sql(24, 0, "start < n - 24 + 1", "tec").replace(
    "completeness, y, x_sum", "completeness, x_sum"))
def _(spark, sf):
    return _shape(sequences.windows_only(observations(spark, sf), ["TEC", "Kp"], 24,
                                         keys=KEYS, order=ORDER), y=False)


@query("stations_too_short", with_obs(
    "SELECT station, count(*) AS n_rows FROM obs GROUP BY 1 HAVING count(*) < 60"))
def _(spark, sf):
    return sequences.too_short(observations(spark, sf), 60).select(F.col("Station").alias("station"), "n_rows")


@query("window_sizes", with_obs("\n  UNION ALL ".join(f"""
  SELECT station, start, {h} AS window_h, start_us, end_us, completeness, y FROM (
    SELECT station, row_number() OVER s - 1 AS start, epoch_us(ts) AS start_us,
      lead(epoch_us(ts), {h * 4 - 1}) OVER s AS end_us,
      round(count(value) OVER w / {h * 4}.0 * 0.5 + count(kp) OVER w / {h * 4}.0 * 0.5, 6) AS completeness,
      lead(value, {h * 4 - 1}) OVER s AS y, count(*) OVER (PARTITION BY station) AS n
    FROM obs {W}, w AS (PARTITION BY station ORDER BY ts, event_id
      ROWS BETWEEN CURRENT ROW AND {h * 4 - 1} FOLLOWING))
  WHERE start < n - {h * 4} AND completeness >= 0.8""" for h in (2, 6, 12, 24, 48))))
def _(spark, sf):
    out = sequences.window_plan(observations(spark, sf), ["value", "Kp"], "value",
                                settings=Settings(), keys=KEYS, order=ORDER)
    return out.select(F.col("Station").alias("station"), "start", "window_h",
                      us(F.col("start_ts")).alias("start_us"), us(F.col("end_ts")).alias("end_us"),
                      r(F.col("completeness")).alias("completeness"), "y")


@query("grouped_sequence_record", with_obs(f"""
  SELECT station, start, steps, tec_sum, kp_last, dst_last FROM (
    SELECT station, row_number() OVER s - 1 AS start, 8 AS steps,
      round(sum(value) OVER w, 4) AS tec_sum, coalesce(lead(kp, 7) OVER s, 0) AS kp_last,
      lead(dst, 7) OVER s AS dst_last, count(*) OVER (PARTITION BY station) AS n,
      count(kp) OVER w AS n_kp
    FROM obs {W}, w AS (PARTITION BY station ORDER BY ts, event_id
      ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
  WHERE start < n - 8 AND (16 + n_kp) / 24.0 >= 0.8"""))
def _(spark, sf):
    cols = ["value", "Kp", "Dst"]
    seq = sequences.sequences(observations(spark, sf), cols, "value", 8, keys=KEYS, order=ORDER)
    rec = sequences.batch_record(seq, cols, {"temporal_seq": ["value"], "storm_feats": ["Kp", "Dst"]})
    total = F.aggregate(F.flatten("temporal_seq"), F.lit(0.0), lambda a, b: a + b)
    return rec.select(F.col("Station").alias("station"), "start", F.size("temporal_seq").alias("steps"),
                      r(total, 4).alias("tec_sum"), F.col("storm_feats")[0].alias("kp_last"),
                      F.col("storm_feats")[1].alias("dst_last"))
