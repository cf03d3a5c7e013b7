"""Registry of runnable queries with the SQL that must give the same rows, and the shared views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skywell.functions.rules import finite, kp_scale, mask_fill
from skywell.schema import col

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` runs on the raw tables."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def r(c: Column, digits: int = 6) -> Column:
    """Rounded value without a negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- observations: the events table seen as a station series ---------------------------------------

def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Station series with missing and infinite values, raw and cleaned drivers."""
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    v = F.col("value")
    tec_raw = (F.when(F.col("event_id") % 97 == 0, F.lit(float("inf")))
               .when(F.col("event_id") % 7 == 0, None).otherwise(v))
    return e.select(
        "event_id", F.col("user_id").alias("Station"), F.col("ts").cast("timestamp").alias("Timestamp"),
        "event_type", v.alias("value"),
        tec_raw.alias("tec_raw"), finite(tec_raw).alias("TEC"),
        k.alias("kp_raw"), kp_scale(mask_fill(k, "Kp")).alias("Kp"),
        F.when(k == 98, 999.0).otherwise(k * 4).alias("ap_raw"),
        (30 - v).alias("Dst"), (60 + 1.5 * k).alias("F10.7"), (k * 3).alias("SSN"),
        (v / 4).alias("foF2"), (150 + v * 2).alias("hmF2"), (v * 5).alias("B0"),
        (v * k / 5).alias("TopsideTEC"),
        F.when(F.col("event_id") % 11 == 0, None).otherwise(
            (F.col("event_id") % 6).cast("double")).alias("QF"),
        (k % 10).alias("FF"),
        ((F.col("user_id") * 37) % 181 - 90).cast("double").alias("Latitude"),
        ((F.col("user_id") * 53) % 361 - 180).cast("double").alias("Longitude"),
    )


OBS = """
raw_events AS (
  SELECT event_id, user_id, ts, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k
  FROM events),
obs AS (
  SELECT event_id, user_id AS station, ts, event_type, value, k AS kp_raw,
         CASE WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE)
              WHEN event_id % 7 = 0 THEN NULL ELSE value END AS tec_raw,
         CASE WHEN event_id % 97 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS tec,
         CASE WHEN k = 99 THEN NULL ELSE k / 10.0 END AS kp,
         CASE WHEN k = 98 THEN 999.0 ELSE k * 4 END AS ap_raw,
         30 - value AS dst, CAST(60 + 1.5 * k AS DOUBLE) AS f107, k * 3 AS ssn,
         value / 4 AS fof2, 150 + value * 2 AS hmf2, value * 5 AS b0, value * k / 5 AS topsidetec,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 6 AS DOUBLE) END AS qf,
         k % 10 AS ff,
         CAST((user_id * 37) % 181 - 90 AS DOUBLE) AS latitude,
         CAST((user_id * 53) % 361 - 180 AS DOUBLE) AS longitude
  FROM raw_events)
"""


def with_obs(body: str, *ctes: str) -> str:
    head = "WITH " + ",\n".join([OBS, *ctes])
    text = body.strip()
    return f"{head},\n{text[5:]}" if text.startswith("WITH ") else f"{head}\n{text}"


# --- hourly indices ----------------------------------------------------------------------------------

def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Index table: one row per hour that has any observation."""
    o = observations(spark, sf)
    return o.groupBy(F.date_trunc("hour", "Timestamp").alias("Timestamp")).agg(
        F.round(F.avg("kp_raw"), 3).alias("idx_kp"), F.max("kp_raw").alias("idx_ap"),
        F.min("Dst").alias("idx_dst"))


HOURLY = """
hourly AS (
  SELECT date_trunc('hour', ts) AS ts, round(avg(kp_raw), 3) AS idx_kp, max(kp_raw) AS idx_ap,
         min(dst) AS idx_dst
  FROM obs GROUP BY 1)
"""


# --- prediction table ----------------------------------------------------------------------------------

MODELS = ("persistence", "rolling", "by_type")


def predictions_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One row per observation with three forecasts of ``y_true``."""
    from skywell.operators.layout import lay_out

    o = observations(spark, sf)
    layout = lay_out(o, ["Station"], ["Timestamp", "event_id"], before=3)
    by_type = o.groupBy("event_type").agg(F.round(F.avg("value") + 1e-9, 4).alias("by_type"))
    rows = layout.finish(layout.rows.withColumns({
        "persistence": F.lag("value").over(layout.window),
        "rolling": F.round(F.avg("value").over(layout.frame(-3, -1)), 4),
    }))
    return rows.join(F.broadcast(by_type), "event_type").select(
        "event_id", F.col("Station").alias("station"), F.col("Timestamp").alias("ts"),
        F.col("value").alias("y_true"), *MODELS, F.col("Kp").alias("kp"), F.col("Dst").alias("dst"),
        F.col("Latitude").alias("latitude"), F.dayofyear("Timestamp").alias("doy"),
        col("F10.7").alias("f107"), F.when(F.dayofmonth("Timestamp") <= 20, "train").otherwise(
            "test").alias("split"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The same in long form: ``model``, ``y_pred``."""
    wide = predictions_wide(spark, sf)
    arms = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in MODELS])
    keep = [c for c in wide.columns if c not in MODELS]
    return wide.withColumn("_a", F.explode(arms)).select(*keep, "_a.model", "_a.y_pred")


PRED = """
wide AS (
  SELECT event_id, station, ts, value AS y_true,
         lag(value) OVER s AS persistence,
         round(avg(value) OVER (PARTITION BY station ORDER BY ts, event_id
               ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS rolling,
         round(avg(value) OVER (PARTITION BY event_type) + 1e-9, 4) AS by_type,
         kp, dst, latitude, dayofyear(ts) AS doy, f107,
         CASE WHEN day(ts) <= 20 THEN 'train' ELSE 'test' END AS split
  FROM obs WINDOW s AS (PARTITION BY station ORDER BY ts, event_id)),
pred AS (
  SELECT event_id, station, ts, y_true, kp, dst, latitude, doy, f107, split,
         'persistence' AS model, persistence AS y_pred FROM wide
  UNION ALL SELECT event_id, station, ts, y_true, kp, dst, latitude, doy, f107, split,
         'rolling', rolling FROM wide
  UNION ALL SELECT event_id, station, ts, y_true, kp, dst, latitude, doy, f107, split,
         'by_type', by_type FROM wide)
"""
