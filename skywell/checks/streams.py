"""Structured Streaming monitors, run over everything available in the events file.

Append mode emits a window once the watermark (latest time less 30 minutes) has passed its end; the
SQL states the same rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skywell.checks.base import HOURLY, hourly, observations, query, r, table, us, with_obs
from skywell.operators import discovery
from skywell.streaming import monitors as m, ordered


def events_stream(spark, sf):
    """The events table as a stream, with the columns the monitors read."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    v = F.col("value")
    return m.event_time(raw.select(
        "event_id", F.col("user_id").alias("station"), "ts", "event_type", v.alias("value"),
        F.when(k != 99, k / 10).alias("kp"), (30 - v).alias("dst"), (v * k / 5 - 1).alias("topside"),
        ((v - 2) * 0.1).alias("density"), (v * k / 5 + v).alias("net"), F.exp(-v / 100).alias("confidence"),
        (v - k).alias("step")))


CLOSED = "(SELECT max(ts) - INTERVAL 30 MINUTE FROM obs)"


@query("stream_storm_monitor", with_obs(f"""
  SELECT epoch_us(s) AS start_us, max(kp) AS max_kp, min(dst) AS min_dst,
    CASE WHEN max(kp) >= 8 OR min(dst) <= -150 THEN 'CRITICAL' WHEN max(kp) >= 6 OR min(dst) <= -80 THEN 'HIGH'
         WHEN max(kp) >= 3 OR min(dst) <= -30 THEN 'WARNING' ELSE 'NORMAL' END AS level
  FROM (SELECT kp, dst, time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR AS s FROM obs, range(4) t(i))
  WHERE s + INTERVAL 1 DAY <= {CLOSED} GROUP BY s"""))
def _(spark, sf):
    out = m.run_available(m.storm_monitor(events_stream(spark, sf)), spark)
    return out.select(us(F.col("start")).alias("start_us"), "max_kp", "min_dst", "level")


@query("stream_anomaly_monitor", with_obs("""
  SELECT event_id, round(abs(topside - lag(topside) OVER s), 6) AS step, topside < 0 AS negative_topside,
    net > 900 AS extreme_tec, coalesce(abs(topside - lag(topside) OVER s) > 600, false) AS massive_jump
  FROM (SELECT event_id, station, ts, topsidetec - 1 AS topside, topsidetec + value AS net FROM obs)
  WINDOW s AS (PARTITION BY station ORDER BY ts, event_id)"""))
def _(spark, sf):
    def make(root, sink):
        return m.anomaly_batch(m.CarriedRows(root, 1, ["station"], ["ts", "event_id"]), sink, cap=900.0, max_step=600.0)
    out = m.run_batches(events_stream(spark, sf), spark, make)
    return out.select("event_id", r(F.col("step")).alias("step"), "negative_topside", "extreme_tec", "massive_jump")


# Rows behind the last watermark, with the number of their run: a pause beyond 12 hours starts a new one.
IN_RUNS = """
behind AS (SELECT * FROM obs WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM obs) - 1800000),
opened AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY station ORDER BY ts, event_id)
    > 43200000000 THEN 1 ELSE 0 END AS o FROM behind),
in_runs AS (SELECT *, sum(o) OVER (PARTITION BY station ORDER BY ts, event_id) AS run FROM opened)
"""


@query("stream_steps_in_order", with_obs("""
  SELECT event_id, round(abs(topside - lag(topside) OVER s), 6) AS step, topside < 0 AS negative_topside,
    net > 900 AS extreme_tec, coalesce(abs(topside - lag(topside) OVER s) > 600, false) AS massive_jump
  FROM (SELECT event_id, station, ts, run, topsidetec - 1 AS topside, topsidetec + value AS net FROM in_runs)
  WINDOW s AS (PARTITION BY station, run ORDER BY ts, event_id)""", IN_RUNS))
def _(spark, sf):
    s = events_stream(spark, sf).drop("event_type", "step")
    out = m.run_available(ordered.steps_in_order(s, cap=900.0, max_step=600.0, idle="12 hours"), spark)
    return out.select("event_id", r(F.col("step")).alias("step"), "negative_topside", "extreme_tec", "massive_jump")


@query("stream_sequences_in_order", with_obs("""
  SELECT station, start_us, end_us, x_sum FROM (
    SELECT station, lag(epoch_us(ts), 3) OVER s AS start_us, epoch_us(ts) AS end_us,
      round(sum(value) OVER (PARTITION BY station, run ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS x_sum
    FROM in_runs WINDOW s AS (PARTITION BY station, run ORDER BY ts, event_id)) WHERE start_us IS NOT NULL""", IN_RUNS))
def _(spark, sf):
    s = events_stream(spark, sf).select("event_id", "station", "ts", "value")
    out = m.run_available(ordered.sequences_in_order(s, ["value"], 4, idle="12 hours"), spark)
    total = F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, b: a + b)
    return out.select("station", "start_us", "end_us", r(total, 4).alias("x_sum"))


@query("stream_readiness", with_obs(f"""
  SELECT epoch_us(s) AS start_us, round(greatest(0, least(100, 100 - (1 - avg(exp(-value / 100))) * 50
      - CASE WHEN bool_or(topsidetec - 1 < 0) THEN 40 ELSE 0 END - CASE WHEN bool_or(topsidetec + value > 900) THEN 20 ELSE 0 END
      - CASE WHEN bool_or(abs(value - kp_raw) > 100) THEN 15 ELSE 0 END
      - CASE WHEN max(kp) >= 8 OR min(dst) <= -150 THEN 10 ELSE 0 END)), 6) AS readiness
  FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS s FROM obs)
  WHERE s + INTERVAL 1 HOUR <= {CLOSED} GROUP BY s"""))
def _(spark, sf):
    out = m.run_available(m.readiness_stream(events_stream(spark, sf), "1 hour", cap=900.0, max_step=100.0), spark)
    return out.select(us(F.col("start")).alias("start_us"), r(F.col("readiness")).alias("readiness"))


@query("stream_drift", with_obs(f"""
  SELECT epoch_us(s) AS start_us, round(avg(value) + 1e-9, 6) AS current_mean,
    round(abs((avg(value) - any_value(hm)) / (any_value(hs) + 1e-8)), 6) AS drift_z
  FROM (SELECT value, date_trunc('day', ts) AS s FROM obs), (SELECT avg(value) AS hm, stddev_pop(value) AS hs FROM obs)
  WHERE s + INTERVAL 1 DAY <= {CLOSED} GROUP BY s"""))
def _(spark, sf):
    history = discovery.history_of(observations(spark, sf), "value")
    out = m.run_available(m.drift_stream(events_stream(spark, sf), history, "value"), spark)
    return out.select(us(F.col("start")).alias("start_us"), r(F.col("current_mean") + 1e-9).alias("current_mean"),
                      r(F.col("drift_z")).alias("drift_z"))


@query("stream_enrichment", with_obs("""
  SELECT event_id, idx_kp, idx_dst FROM obs LEFT JOIN hourly ON date_trunc('hour', obs.ts) = hourly.ts""", HOURLY))
def _(spark, sf):
    idx = hourly(spark, sf).withColumnRenamed("Timestamp", "ts")
    out = m.run_available(m.enrich_stream(events_stream(spark, sf), idx), spark)
    return out.select("event_id", "idx_kp", "idx_dst")


@query("stream_deduplication", """
  SELECT count(*) AS n_rows FROM (SELECT DISTINCT user_id, date_trunc('minute', ts) FROM events)""")
def _(spark, sf):
    s = events_stream(spark, sf)
    s = s.withColumn("minute", F.date_trunc("minute", "ts"))
    out = m.run_available(m.dedup_stream(s, ["station", "minute"]), spark)
    return out.agg(F.count("*").alias("n_rows"))


@query("stream_runs", with_obs(f"""
  SELECT station, epoch_us(min(ts)) AS start_us, count(*) AS n_rows FROM (
    SELECT station, ts, sum(o) OVER (PARTITION BY station ORDER BY ts, event_id) AS run FROM (
      SELECT station, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY station ORDER BY ts, event_id)
        < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS o FROM obs))
  GROUP BY station, run HAVING max(ts) + INTERVAL 24 HOUR <= {CLOSED}"""))
def _(spark, sf):
    out = m.run_available(m.runs(events_stream(spark, sf)), spark)
    return out.select("station", us(F.col("start")).alias("start_us"), "n_rows")


@query("stream_sequences", with_obs("""
  SELECT station, start_us, end_us, x_sum FROM (
    SELECT station, lag(epoch_us(ts), 7) OVER s AS start_us, epoch_us(ts) AS end_us,
      round(sum(value) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 4) AS x_sum
    FROM obs WINDOW s AS (PARTITION BY station ORDER BY ts, event_id)) WHERE start_us IS NOT NULL"""))
def _(spark, sf):
    def make(root, sink):
        return m.sequence_batch(m.CarriedRows(root, 7, ["station"], ["ts", "event_id"]), sink, ["value"])
    out = m.run_batches(events_stream(spark, sf), spark, make)
    total = F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, b: a + b)
    return out.select("station", us(F.col("start_ts")).alias("start_us"), us(F.col("end_ts")).alias("end_us"),
                      r(total, 4).alias("x_sum"))


@query("stream_discovery")
def _(spark, sf):
    def scores(batch):
        return discovery.mutual_information(batch.dropna(subset=["kp"]), ["kp", "dst", "net"], "value")
    out = m.run_batches(events_stream(spark, sf), spark, lambda root, sink: m.discovery_batch(scores, sink))
    return out.select("feature", r(F.col("score")).alias("score"))


@query("stream_validation", with_obs("""
  SELECT count(*) AS "rows", count_if(kp IS NULL) AS null_kp, count_if(dst < -100) AS low_dst FROM obs"""))
def _(spark, sf):
    checks = {"null_kp": F.col("kp").isNull(), "low_dst": F.col("dst") < -100}
    seen = m.observe_stream(events_stream(spark, sf), "quality", checks)
    out = m.run_batches(seen, spark, lambda root, sink: m.validation_batch(checks, sink))
    return out.agg(*[F.sum(c).alias(c) for c in ("rows", "null_kp", "low_dst")])


@query("stream_event_class", with_obs("""
  SELECT event_id, CASE WHEN value > 200 THEN 'Novel Event' WHEN kp >= 7 THEN 'Extreme Storm'
    WHEN kp >= 5 THEN 'Strong Storm' WHEN kp >= 4 THEN 'Moderate Storm' ELSE 'Quiet' END AS event_class FROM obs"""))
def _(spark, sf):
    s = events_stream(spark, sf).withColumn("is_novel", F.col("value") > 200)
    return m.run_available(m.classify_stream(s), spark).select("event_id", "event_class")
