"""Scalar rules, filters and column contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywell.checks.base import observations, query, r, table, us, with_obs
from skywell.functions import rules
from skywell.functions.registry import register
from skywell.schema import PHYSICAL_BOUNDS, col


@query("station_whitelist", with_obs(
    "SELECT event_id, station FROM obs WHERE station IN (SELECT n_nationkey FROM nation)"))
def _(spark, sf):
    wanted = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint"))
    return rules.only_stations(observations(spark, sf), wanted).select(
        "event_id", F.col("Station").alias("station"))


@query("date_range", with_obs("""
  SELECT event_id, epoch_us(ts) AS ts_us FROM obs
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12 23:59:59'"""))
def _(spark, sf):
    out = rules.between_days(observations(spark, sf), "2024-01-05", "2024-01-12")
    return out.select("event_id", us(F.col("Timestamp")).alias("ts_us"))


@query("lenient_timestamp", """
  SELECT event_id, epoch_us(try_strptime(CASE WHEN event_id % 5 = 0 THEN 'not a time'
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d %H:%M:%S')) AS ts_us FROM events""")
def _(spark, sf):
    o = observations(spark, sf)
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(
        F.date_format("Timestamp", rules.TIME_FORMAT))
    return o.select("event_id", us(rules.parse_timestamp(text)).alias("ts_us"))


@query("year_day_hour", """
  SELECT event_id, epoch_us(date_trunc('hour', ts)) AS ts_us FROM events""")
def _(spark, sf):
    t = F.col("Timestamp")
    return observations(spark, sf).select(
        "event_id", us(rules.year_day_hour(F.year(t), F.dayofyear(t), F.hour(t))).alias("ts_us"))


@query("numeric_survival", """
  SELECT 'event_type' AS "column", count(event_type) AS n,
         count(try_cast(event_type AS DOUBLE)) AS n_numeric FROM events
  UNION ALL SELECT 'value_text', count(*), count(*) FROM events
  UNION ALL SELECT 'props', count(props), count(try_cast(props AS DOUBLE)) FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("value_text", F.col("value").cast("string"))
    return rules.coercion_stats(e, ["event_type", "value_text", "props"])


@query("numeric_coercion", """
  SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level,
         try_cast(o_orderpriority AS DOUBLE) AS whole FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", rules.to_number(F.split("o_orderpriority", "-")[0]).alias("level"),
        rules.to_number(F.col("o_orderpriority")).alias("whole"))


@query("fill_codes", with_obs("""
  SELECT event_id, CASE WHEN kp_raw = 99 THEN NULL ELSE round(kp_raw / 10.0, 6) END AS kp,
         CASE WHEN ap_raw IN (999, 9999) THEN NULL ELSE ap_raw END AS ap,
         CASE WHEN ap_raw >= 999 THEN NULL ELSE ap_raw END AS ap_threshold FROM obs"""))
def _(spark, sf):
    o = observations(spark, sf)
    return o.select("event_id", r(rules.kp_scale(rules.mask_fill(F.col("kp_raw"), "Kp"))).alias("kp"),
                    rules.mask_fill(F.col("ap_raw"), "Ap").alias("ap"),
                    rules.mask_fill(F.col("ap_raw"), "Ap", "threshold").alias("ap_threshold"))


@query("infinity_to_null", with_obs("""
  SELECT event_id, tec, CAST(coalesce(isinf(tec_raw), false) AS INT) AS was_infinite FROM obs"""))
def _(spark, sf):
    return observations(spark, sf).select(
        "event_id", rules.finite(F.col("tec_raw")).alias("tec"),
        rules.is_infinite(F.col("tec_raw")).cast("int").alias("was_infinite"))


@query("quality_gate", with_obs("""
  SELECT event_id, qf, ff FROM obs WHERE (qf IS NULL OR qf >= 2) AND (ff IS NULL OR ff >= 3)"""))
def _(spark, sf):
    return rules.quality_gate(observations(spark, sf), 2, 3.0).select(
        "event_id", F.col("QF").alias("qf"), F.col("FF").alias("ff"))


@query("range_nulling", with_obs("""
  SELECT event_id, CASE WHEN fof2 BETWEEN 1 AND 25 THEN fof2 END AS fof2,
         CASE WHEN hmf2 BETWEEN 80 AND 700 THEN hmf2 END AS hmf2,
         CASE WHEN b0 >= 10 THEN round(b0, 6) END AS b0,
         CASE WHEN f107 >= 60 THEN f107 END AS f107 FROM obs"""))
def _(spark, sf):
    bounds = {"foF2": (1.0, 25.0), "hmF2": (80.0, 700.0), "B0": (10.0, None), "F10.7": (60.0, None)}
    return rules.range_to_null(observations(spark, sf), bounds).select(
        "event_id", F.col("foF2").alias("fof2"), F.col("hmF2").alias("hmf2"),
        r(F.col("B0")).alias("b0"), col("F10.7").alias("f107"))


@query("calendar_parts", """
  SELECT o_orderkey, CAST(hour(o_orderdate) AS INT) AS hour, CAST(minute(o_orderdate) AS INT) AS minute,
         CAST(month(o_orderdate) AS INT) AS month, CAST(dayofyear(o_orderdate) AS INT) AS doy,
         CAST(week(o_orderdate) AS INT) AS week,
         CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS weekend,
         CAST((month(o_orderdate) % 12) // 3 AS INT) AS season0,
         CAST((month(o_orderdate) % 12 + 3) // 3 AS INT) AS season1,
         CASE (month(o_orderdate) % 12) // 3 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring'
              WHEN 2 THEN 'summer' ELSE 'autumn' END AS season FROM orders""")
def _(spark, sf):
    t = F.col("o_orderdate").cast("timestamp")
    parts = rules.calendar(t)
    return table(spark, sf, "orders").select(
        "o_orderkey", parts["Hour"].alias("hour"), parts["Minute"].alias("minute"),
        parts["Month"].alias("month"), parts["DayOfYear"].alias("doy"), parts["Week"].alias("week"),
        rules.weekend(t).alias("weekend"), rules.season_from_zero(F.month(t)).alias("season0"),
        rules.season_from_one(F.month(t)).alias("season1"),
        rules.season_name(F.month(t)).alias("season"))


@query("local_times", with_obs("""
  SELECT event_id,
    round(((hour(ts) + minute(ts) / 60.0 + longitude / 15.0) % 24.0 + 24.0) % 24.0, 6) AS local_time,
    CAST(((hour(ts) + CAST(trunc(longitude / 15.0) AS INT)) % 24 + 24) % 24 AS INT) AS local_hour
  FROM obs"""))
def _(spark, sf):
    t, lon = F.col("Timestamp"), F.col("Longitude")
    return observations(spark, sf).select(
        "event_id", r(rules.local_time(t, lon)).alias("local_time"),
        rules.local_hour(t, lon).alias("local_hour"))


@query("cyclic_encoding", with_obs("""
  SELECT event_id, round(sin(hour(ts) * 2.0 * pi() / 24.0), 6) + 0.0 AS hour_sin,
         round(cos(hour(ts) * 2.0 * pi() / 24.0), 6) + 0.0 AS hour_cos,
         round(sin(dayofyear(ts) * 2.0 * pi() / 365.25), 6) + 0.0 AS doy_sin,
         round(cos(dayofyear(ts) * 2.0 * pi() / 365.25), 6) + 0.0 AS doy_cos,
         round(sin(longitude * 2.0 * pi() / 360.0), 6) + 0.0 AS lon_sin FROM obs"""))
def _(spark, sf):
    t = F.col("Timestamp")
    hs, hc = rules.cyclic(F.hour(t), 24.0)
    ds, dc = rules.cyclic(F.dayofyear(t), 365.25)
    ls, _ = rules.cyclic(F.col("Longitude"), 360.0)
    return observations(spark, sf).select(
        "event_id", r(hs).alias("hour_sin"), r(hc).alias("hour_cos"), r(ds).alias("doy_sin"),
        r(dc).alias("doy_cos"), r(ls).alias("lon_sin"))


@query("latitude_zone", with_obs("""
  SELECT event_id, CASE WHEN latitude BETWEEN 60 AND 90 THEN 'high_north'
    WHEN latitude BETWEEN 30 AND 60 THEN 'mid_north' WHEN latitude BETWEEN 15 AND 30 THEN 'low_north'
    WHEN latitude BETWEEN 0 AND 15 THEN 'equatorial_north'
    WHEN latitude BETWEEN -15 AND 0 THEN 'equatorial_south'
    WHEN latitude BETWEEN -30 AND -15 THEN 'low_south'
    WHEN latitude BETWEEN -60 AND -30 THEN 'mid_south'
    WHEN latitude BETWEEN -90 AND -60 THEN 'high_south' ELSE 'unknown' END AS zone FROM obs"""))
def _(spark, sf):
    return observations(spark, sf).select(
        "event_id", rules.latitude_zone(F.col("Latitude")).alias("zone"))


@query("storm_rules", with_obs("""
  SELECT event_id,
    CASE WHEN kp >= 8 OR dst <= -150 THEN 'Extreme Storm' WHEN kp >= 6 OR dst <= -80 THEN 'Strong Storm'
         WHEN kp >= 3 OR dst <= -30 THEN 'Moderate Storm' ELSE 'Quiet' END AS category,
    CASE WHEN kp >= 8 OR dst <= -150 THEN 'CRITICAL' WHEN kp >= 6 OR dst <= -80 THEN 'HIGH'
         WHEN kp >= 3 OR dst <= -30 THEN 'WARNING' ELSE 'NORMAL' END AS level,
    CASE WHEN value > 200 THEN 'Novel Event' WHEN kp >= 7 THEN 'Extreme Storm'
         WHEN kp >= 5 THEN 'Strong Storm' WHEN kp >= 4 THEN 'Moderate Storm' ELSE 'Quiet' END AS event_class,
    CASE WHEN dst < -50 OR kp >= 50 THEN 1 ELSE 0 END AS storm_flag,
    CASE WHEN kp <= 30 THEN 1 ELSE 0 END AS quiet_flag,
    CASE WHEN kp <= 2 AND dst > -30 THEN 'quiet' WHEN kp >= 6 AND dst < -80 THEN 'storm'
         ELSE 'moderate' END AS stage FROM obs"""))
def _(spark, sf):
    kp, dst = F.col("Kp"), F.col("Dst")
    category, level = rules.storm_state(kp, dst)
    storm, quiet = rules.storm_flags(kp, dst)
    return observations(spark, sf).select(
        "event_id", category.alias("category"), level.alias("level"),
        rules.event_class(kp, F.col("value") > 200).alias("event_class"),
        storm.alias("storm_flag"), quiet.alias("quiet_flag"),
        rules.difficulty_stage(kp, dst).alias("stage"))


@query("rules_as_sql_functions", with_obs("""
  SELECT event_id, CAST((month(ts) % 12) // 3 AS INT) AS season,
    CASE WHEN kp >= 8 OR dst <= -150 THEN 'CRITICAL' WHEN kp >= 6 OR dst <= -80 THEN 'HIGH'
         WHEN kp >= 3 OR dst <= -30 THEN 'WARNING' ELSE 'NORMAL' END AS level FROM obs"""))
def _(spark, sf):
    register(spark)
    return observations(spark, sf).select(
        "event_id", F.expr("sky_season(month(Timestamp))").alias("season"),
        F.expr("sky_storm_level(Kp, Dst)").alias("level"))


@query("physics_targets", with_obs("""
  SELECT event_id, round(value + topsidetec, 6) AS net, round((value + topsidetec) * 0.1, 6) AS density,
         round((value + topsidetec) * 0.162, 6) AS delay,
         CASE WHEN tec IS NULL THEN NULL ELSE greatest(tec - 50, 0) END AS clamped,
         CASE WHEN tec IS NULL THEN NULL ELSE greatest(value, tec - 1) END AS floored FROM obs"""))
def _(spark, sf):
    t = rules.physics_targets(F.col("TopsideTEC"), F.col("value"))
    return observations(spark, sf).select(
        "event_id", *[r(c).alias(n) for n, c in t.items()],
        rules.non_negative(F.col("TEC") - 50).alias("clamped"),
        rules.at_least(F.col("value"), F.col("TEC") - 1).alias("floored"))


@query("confidence_columns", with_obs("""
  SELECT event_id, round(exp(-(kp_raw / 50.0)), 6) AS confidence,
         round(value - 1.96 * sqrt(kp_raw / 50.0 + 1e-6), 6) AS lower,
         round(value + 1.96 * sqrt(kp_raw / 50.0 + 1e-6), 6) AS upper,
         round(2 * 1.96 * sqrt(kp_raw / 50.0 + 1e-6), 6) AS width,
         exp(-(kp_raw / 50.0)) < 0.3 AS review FROM obs"""))
def _(spark, sf):
    c = rules.confidence(F.col("value"), F.col("kp_raw") / 50.0)
    return observations(spark, sf).select(
        "event_id", *[(c[n] if n == "review" else r(c[n])).alias(n) for n in c])


@query("delay_record", with_obs("""
  SELECT event_id, coalesce(tec, 0.0) AS "Vertical_Delay_m", 0.0::DOUBLE AS "Slant_Delay_m",
         0.0::DOUBLE AS "Time_Delay_ns", coalesce(kp, 0.0) AS "GPS_L1_Delay_m",
         0.0::DOUBLE AS "NavIC_L5_Delay_m", 0.0::DOUBLE AS "Galileo_E1_Delay_m",
         0.0::DOUBLE AS "BeiDou_B1_Delay_m" FROM obs"""))
def _(spark, sf):
    o = observations(spark, sf).select("event_id", F.col("TEC").alias("vertical_delay"),
                                       F.col("Kp").alias("gps_delay"))
    return rules.delay_record(o, ["event_id"])


@query("error_columns", with_obs("""
  SELECT event_id, round(foF2 - value, 6) AS error, round(abs(foF2 - value), 6) AS abs_error,
         round((foF2 - value) * (foF2 - value), 6) AS sq_error FROM obs"""))
def _(spark, sf):
    e = rules.errors(F.col("value"), F.col("foF2"))
    return observations(spark, sf).select("event_id", *[r(c).alias(n) for n, c in e.items()])


SCORE = lambda c: 2.0 * c["Kp"] - 0.1 * c["Dst"] + 0.05 * c["F10.7"]
CASES = [
    {"name": "storm", "set": {"Kp": 8.0, "Dst": -150.0}},
    {"name": "kp_up", "add": {"Kp": 2.0}},
    {"name": "flare", "add": {"F10.7": 50.0}},
]


@query("scenario_override", with_obs("""
  SELECT event_id, 'storm' AS scenario, round(2.0 * 8.0 + 15.0 + 0.05 * f107, 6) AS score,
         round(2.0 * 8.0 + 15.0 + 0.05 * f107 - (2.0 * kp - 0.1 * dst + 0.05 * f107), 6) AS delta FROM obs
  UNION ALL SELECT event_id, 'kp_up', round(2.0 * (kp + 2) - 0.1 * dst + 0.05 * f107, 6),
         round(2.0 * (kp + 2) - 0.1 * dst + 0.05 * f107 - (2.0 * kp - 0.1 * dst + 0.05 * f107), 6) FROM obs
  UNION ALL SELECT event_id, 'flare', round(2.0 * kp - 0.1 * dst + 0.05 * (f107 + 50), 6),
         round(2.0 * kp - 0.1 * dst + 0.05 * (f107 + 50) - (2.0 * kp - 0.1 * dst + 0.05 * f107), 6) FROM obs"""))
def _(spark, sf):
    o = observations(spark, sf).select("event_id", "Kp", "Dst", col("F10.7"))
    return rules.scenarios(o, CASES, SCORE).select(
        "event_id", "scenario", r(F.col("score")).alias("score"), r(F.col("delta")).alias("delta"))


@query("group_ablation", with_obs("""
  SELECT 'drivers' AS scenario, round(avg(0.05 * f107), 4) AS mean_score,
         round(avg(0.05 * f107 - (2.0 * kp - 0.1 * dst + 0.05 * f107)), 4) AS mean_delta FROM obs
  UNION ALL SELECT 'solar', round(avg(2.0 * kp - 0.1 * dst), 4),
         round(avg(2.0 * kp - 0.1 * dst - (2.0 * kp - 0.1 * dst + 0.05 * f107)), 4) FROM obs"""))
def _(spark, sf):
    o = observations(spark, sf).select("event_id", "Kp", "Dst", col("F10.7"))
    out = rules.ablate(o, {"drivers": ["Kp", "Dst"], "solar": ["F10.7"]}, SCORE)
    return out.groupBy("scenario").agg(r(F.avg("score"), 4).alias("mean_score"),
                                       r(F.avg("delta"), 4).alias("mean_delta"))


@query("batch_contract", """
  SELECT 'missing:delay' AS "check", CAST(1 AS BIGINT) AS failures
  UNION ALL SELECT 'null:embedding', count(*) FILTER (WHERE embedding IS NULL) FROM embeddings
  UNION ALL SELECT 'size:embedding',
    count(*) FILTER (WHERE len(embedding) <> len(embedding) + CASE WHEN label = 3 THEN 1 ELSE 0 END)
    FROM embeddings""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("target", F.when(
        F.col("label") == 3, F.concat("embedding", F.array(F.lit(0.0).cast("float"))),
    ).otherwise(F.col("embedding")))
    return rules.batch_report(e, {"embedding": "target"}, ["embedding", "delay"])


@query("target_layouts", with_obs("""
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE value + 1 END AS targets_topside,
         value * 2 AS targets_net FROM obs"""))
def _(spark, sf):
    o = observations(spark, sf)
    both = o.select(
        "event_id",
        F.struct(F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("topside"),
                 (F.col("value") * 2).alias("net")).alias("targets"),
        (F.col("value") + 1).alias("targets_topside"))
    return rules.normalise_layout(both)


@query("label_over_window", """
  SELECT vec_id, len(embedding) AS steps, CAST(label * len(embedding) AS DOUBLE) AS label_sum,
         round(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) + label) * 0.1)), 4) AS density_sum
  FROM embeddings""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    from skywell.operators.joins import spread_label
    seq = F.transform("embedding", lambda v: v.cast("double"))
    t = rules.physics_target_sequences(F.col("label").cast("double"), seq)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    out = spread_label(e, "label", "embedding").withColumn("density", t["density"])
    return out.select("vec_id", F.size("label_seq").cast("long").alias("steps"),
                      r(total(F.transform("label_seq", lambda v: v.cast("double")))).alias("label_sum"),
                      r(total(F.col("density")), 4).alias("density_sum"))
