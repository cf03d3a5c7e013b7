"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywell.checks.base import observations, query, r, table, us, with_obs
from skywell.operators import quality
from skywell.schema import col

SEEN = ["TEC", "Kp", "Dst", "F10.7", "SSN", "foF2", "hmF2", "B0", "TopsideTEC", "QF", "FF"]
SEEN_SQL = ["tec", "kp", "dst", "f107", "ssn", "fof2", "hmf2", "b0", "topsidetec", "qf", "ff"]


def _seen(spark, sf):
    o = observations(spark, sf)
    return o.select("Station", "Timestamp", "Latitude", "Longitude", *[col(c) for c in SEEN])


@query("frame_summary", with_obs("""
  SELECT count(*) AS n_rows, CAST(15 AS BIGINT) AS n_columns,
    CAST(sum((tec IS NULL)::INT + (kp IS NULL)::INT + (qf IS NULL)::INT) AS BIGINT) AS n_null,
    round(sum((tec IS NULL)::INT + (kp IS NULL)::INT + (qf IS NULL)::INT) * 100.0 / (count(*) * 15), 6) AS null_pct
  FROM obs"""))
def _(spark, sf):
    return quality.frame_summary(_seen(spark, sf)).withColumn("null_pct", r(F.col("null_pct")))


def _status(c):
    return (f"CASE WHEN count({c}) = count(*) THEN 'CLEAN' WHEN 1 - count({c}) / count(*) <= 0.05 THEN 'OK' "
            f"WHEN 1 - count({c}) / count(*) <= 0.3 THEN 'WARN' ELSE 'HIGH' END")


@query("missing_report", with_obs("\n UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", count(*) - count({c}) AS n_missing, "
    f"round((count(*) - count({c})) / count(*), 6) AS fraction, {_status(c)} AS status FROM obs"
    for n, c in zip(SEEN, SEEN_SQL))))
def _(spark, sf):
    return quality.missing_report(_seen(spark, sf), SEEN).withColumn("fraction", r(F.col("fraction")))


@query("describe_columns", "\n UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, "
    + ", ".join(f"round(quantile_cont({c}, {p}), 4) AS p{n}" for n, p in
                ((1, 0.01), (25, 0.25), (50, 0.5), (75, 0.75), (99, 0.99)))
    + f", round(max({c}), 4) AS max FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _(spark, sf):
    out = quality.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("column", "count", *[r(F.col(c), 4).alias(c) for c in out.columns
                                           if c not in ("column", "count")])


@query("station_top_counts", """
  SELECT user_id AS station, count(*) AS n_rows FROM events GROUP BY 1 ORDER BY n_rows DESC, station LIMIT 10""")
def _(spark, sf):
    return quality.station_counts(observations(spark, sf)).select(F.col("Station").alias("station"), "n_rows")


@query("coverage", """
  SELECT count(DISTINCT user_id) AS n_stations, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
         date_diff('day', min(ts)::DATE, max(ts)::DATE) AS span_days FROM events""")
def _(spark, sf):
    return quality.coverage(observations(spark, sf)).select(
        "n_stations", us(F.col("first_ts")).alias("first_us"), us(F.col("last_ts")).alias("last_us"), "span_days")


@query("required_columns", """
  SELECT 'ERROR' AS severity, 'RequiredColumns' AS "check", CAST(7 AS BIGINT) AS n_missing""")
def _(spark, sf):
    rep = quality.required_report(_seen(spark, sf))
    return rep.select("severity", "check", F.size("affected_cols").cast("bigint").alias("n_missing"))


@query("text_columns", """
  SELECT 'WARNING' AS severity, 'Kp' AS "column" UNION ALL SELECT 'WARNING', 'QF'""")
def _(spark, sf):
    o = _seen(spark, sf).withColumns({"Kp": F.col("Kp").cast("string"), "QF": F.col("QF").cast("string")})
    return quality.type_report(o).select("severity", F.explode("affected_cols").alias("column"))


@query("timestamp_checks", with_obs("""
  SELECT count(*) FILTER (WHERE ts IS NULL) AS n_null, count(*) FILTER (WHERE d < 0) AS n_reversals,
         count(*) FILTER (WHERE d > 86400000000) AS n_gaps
  FROM (SELECT ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY station ORDER BY value, event_id) AS d
        FROM obs)"""))
def _(spark, sf):
    o = observations(spark, sf)
    # Arrival order is the value order here, so that reversals occur.
    from skywell.operators.layout import lay_out
    lay = lay_out(o, ["Station"], ["value", "event_id"])
    o = lay.finish(lay.rows, "arrival")
    return quality.timestamp_report(o, "arrival")


BOUNDS_SQL = {"tec": ("TEC", 0, 100), "fof2": ("foF2", 1, 25), "hmf2": ("hmF2", 180, 700), "b0": ("B0", 10, 500),
              "f107": ("F10.7", 60, 200), "dst": ("Dst", -100, 29)}


@query("value_checks", with_obs(
    "SELECT * FROM (\n" + "\n UNION ALL ".join(
        f"SELECT CASE WHEN count_if({c} < {lo} OR {c} > {hi}) / count(*) > 0.1 THEN 'ERROR' ELSE 'WARNING' END AS severity, "
        f"'PhysicalBounds' AS \"check\", count_if({c} < {lo} OR {c} > {hi}) AS affected_rows, '{n}' AS cols FROM obs"
        for c, (n, lo, hi) in BOUNDS_SQL.items()) + """
   UNION ALL SELECT 'WARNING', 'FoF2Range', count_if(fof2 < 1 OR fof2 > 25), 'foF2' FROM obs
   UNION ALL SELECT 'WARNING', 'CrossColumnConsistency', count_if(b0 > hmf2), 'B0,hmF2' FROM obs
   UNION ALL SELECT 'WARNING', 'CrossColumnConsistency', count_if(topsidetec / nullif(tec, 0) > 10), 'TopsideTEC,TEC' FROM obs
   UNION ALL SELECT 'WARNING', 'NaNValues', count(*) - count(tec), 'TEC' FROM obs HAVING (count(*) - count(tec)) / count(*) > 0.1
   UNION ALL SELECT 'WARNING', 'NaNValues', count(*) - count(kp), 'Kp' FROM obs HAVING (count(*) - count(kp)) / count(*) > 0.1
   UNION ALL SELECT 'WARNING', 'NaNValues', count(*) - count(qf), 'QF' FROM obs HAVING (count(*) - count(qf)) / count(*) > 0.1
   UNION ALL SELECT 'WARNING', 'NaNValues', count(*) - count(tec_raw), 'tec_raw' FROM obs HAVING (count(*) - count(tec_raw)) / count(*) > 0.1
   UNION ALL SELECT 'ERROR', 'InfiniteValues', count_if(isinf(tec_raw)), 'tec_raw' FROM obs
   UNION ALL SELECT 'WARNING', 'QualityFlags', count(*) - count(qf), 'QF' FROM obs
   UNION ALL SELECT 'WARNING', 'QualityFlags', count_if(qf >= 3), 'QF' FROM obs HAVING count_if(qf >= 3) / count(*) > 0.2
  ) WHERE affected_rows > 0"""))
def _(spark, sf):
    o = observations(spark, sf).select("Latitude", "Longitude", *[col(c) for c in SEEN], "tec_raw")
    bounds = {n: (float(lo), float(hi)) for n, lo, hi in BOUNDS_SQL.values()}
    return quality.value_report(o, bounds).select(
        "severity", "check", "affected_rows", F.array_join("affected_cols", ",").alias("cols"))


@query("duplicate_rows", """
  SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates,
         round(sum(c - 1) / sum(c), 6) AS fraction
  FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL)""")
def _(spark, sf):
    return quality.duplicate_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")).withColumn(
        "fraction", r(F.col("fraction")))


@query("duplicate_keys", """
  SELECT CAST(sum(c - 1) AS BIGINT) AS n_duplicates, count(*) FILTER (WHERE c > 1) AS n_repeated_keys
  FROM (SELECT o_custkey, o_orderdate, count(*) AS c FROM orders GROUP BY ALL)""")
def _(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "orders"), ["o_custkey", "o_orderdate"])


@query("validation_roll_up", with_obs("""
  SELECT false AS passed, CAST(1 + (count_if(fof2 < 1 OR fof2 > 25) / count(*) > 0.1)::INT
      + (count_if(b0 < 10 OR b0 > 500) / count(*) > 0.1)::INT
      + (count_if(topsidetec > 1000) / count(*) > 0.1)::INT
      + (count_if(kp < 0 OR kp > 9) / count(*) > 0.1)::INT AS BIGINT) AS n_errors
  FROM obs"""))
def _(spark, sf):
    o = _seen(spark, sf)
    return quality.roll_up(quality.validate(o)).select("passed", "n_errors")


@query("feed_report", with_obs("""
  SELECT count(*) AS initial_rows,
    count_if(NOT ((qf IS NULL OR qf >= 1) AND (ff IS NULL OR ff >= 2))) AS dropped_quality,
    CAST(sum(CASE WHEN (qf IS NULL OR qf >= 1) AND (ff IS NULL OR ff >= 2) THEN
      (CASE WHEN fof2 BETWEEN 1 AND 25 THEN 0 ELSE 1 END) + (CASE WHEN b0 >= 10 THEN 0 ELSE 1 END)
      + (CASE WHEN tec BETWEEN 0 AND 1000 THEN 0 ELSE 1 END) END) AS BIGINT) AS null_after_ranges
  FROM obs"""))
def _(spark, sf):
    return quality.feed_report(observations(spark, sf), 1, 2.0,
                               {"foF2": (1.0, 25.0), "B0": (10.0, None), "TEC": (0.0, 1000.0)})


@query("empty_columns", "SELECT 'nothing' AS \"column\"")
def _(spark, sf):
    o = _seen(spark, sf).withColumn("nothing", F.lit(None).cast("double"))
    return quality.empty_columns(o)


@query("storm_population", with_obs("""
  SELECT count_if(dst > -30) AS quiet, count_if(dst <= -30 AND dst > -50) AS moderate,
         count_if(dst <= -50 AND dst > -100) AS strong, count_if(dst <= -100) AS extreme FROM obs"""))
def _(spark, sf):
    return quality.storm_population(observations(spark, sf))


@query("quality_score", with_obs("""
  SELECT count(*) AS n_rows, count(*) * 3 - count(tec) - count(kp) - count(qf) AS n_null,
    round(1 - (count(*) * 3 - count(tec) - count(kp) - count(qf)) / (count(*) * 3), 6) AS completeness,
    round(100 - 30 * (count(*) * 3 - count(tec) - count(kp) - count(qf)) / (count(*) * 3) - 10 * 0.05, 2) AS score
  FROM obs"""))
def _(spark, sf):
    o = observations(spark, sf).select("TEC", "Kp", "QF")
    return quality.quality_score(o, 50, 1000).withColumn("completeness", r(F.col("completeness")))
