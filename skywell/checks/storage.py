"""Scans, parsers and sinks: each writes what Spark derives from the tables and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from skywell.checks.base import HOURLY, hourly, observations, predictions, query, r, table, us, with_obs, PRED
from skywell.operators import discovery, metrics, scaling, sequences
from skywell.operators.ordering import with_row
from skywell.schema import col
from skywell.session import scratch_path, written
from skywell.sources import stores, text


def _csv_obs(spark, sf):
    o = observations(spark, sf)
    return text.conform(o.withColumn("Station", F.col("Station").cast("string")).drop("LocalTime"))


@query("csv_round_trip", with_obs("""
  SELECT CAST(station AS VARCHAR) AS station, epoch_us(date_trunc('second', ts)) AS ts_us, round(tec, 6) AS tec,
         round(dst, 6) AS dst, f107 FROM obs"""))
def _(spark, sf):
    path = scratch_path(spark, "csv")
    stores.write_csv(_csv_obs(spark, sf), path, ["Station", "Timestamp"])
    back = text.read_observations(spark, path)
    return back.select(F.col("Station").alias("station"), us(F.col("Timestamp")).alias("ts_us"),
                       F.col("TEC").alias("tec"), r(F.col("Dst")).alias("dst"), col("F10.7").alias("f107"))


@query("csv_directory", with_obs("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM obs GROUP BY 1"))
def _(spark, sf):
    path = scratch_path(spark, "csvdir")
    o = observations(spark, sf)
    shaped = text.conform(o.withColumns({"Station": F.col("event_type"), "TEC": F.col("value")}))
    stores.write_csv(shaped, path)
    return text.read_observations(spark, path).groupBy(F.col("Station").alias("event_type")).agg(
        F.count("*").alias("n"), r(F.sum("TEC"), 3).alias("total"))


def _scaled_lines(spark, sf):
    """Scaled text of each station: odd stations list their columns in another order."""
    o = observations(spark, sf)
    odd = F.col("Station") % 2 == 1
    at = F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    cell = lambda c: F.coalesce(F.round(F.col(c), 4).cast("string"), F.lit("---"))
    body = o.select(F.col("Station").cast("string").alias("station"), F.when(
        odd, F.concat_ws("  ", at, cell("TEC"), F.lit("//"), cell("foF2"), F.lit("//"))
    ).otherwise(F.concat_ws(" ", at, cell("foF2"), F.lit("//"), cell("hmF2"), F.lit("//"), cell("TEC"))).alias("line"))
    ids = o.select("Station").distinct()
    head = ids.select(F.col("Station").cast("string").alias("station"), F.explode(F.array(
        F.lit("# Global listing"), F.lit(""), F.when(odd, "# Time TEC QD foF2 QD").otherwise("# Time foF2 QD hmF2 QD TEC"),
    )).alias("line"))
    return body.unionByName(head).withColumn("source", F.col("station"))


@query("scaled_text_scan", with_obs("""
  SELECT CAST(station AS VARCHAR) AS station, epoch_us(date_trunc('second', ts)) AS ts_us, round(tec, 4) AS tec,
         round(fof2, 4) AS fof2, CASE WHEN station % 2 = 0 THEN round(hmf2, 4) END AS hmf2 FROM obs"""))
def _(spark, sf):
    out = text.parse_scaled(_scaled_lines(spark, sf), ["TEC", "foF2", "hmF2", "B0"])
    return out.select(F.col("Station").alias("station"), us(F.col("Timestamp")).alias("ts_us"),
                      F.col("TEC").alias("tec"), F.col("foF2").alias("fof2"), F.col("hmF2").alias("hmf2"))


@query("index_listing_scan", with_obs("""
  SELECT epoch_us(ts) AS ts_us, CASE WHEN idx_ap = 99 THEN NULL ELSE round(idx_ap / 10.0, 6) END AS kp,
         round(idx_dst, 3) AS dst, CAST(NULL AS DOUBLE) AS f107 FROM hourly""", HOURLY))
def _(spark, sf):
    h, t = hourly(spark, sf), F.col("Timestamp")
    path = scratch_path(spark, "listing")
    h.select(F.concat_ws("  ", F.year(t), F.dayofyear(t), F.hour(t), F.col("idx_ap").cast("int"),
                         F.round("idx_dst", 3).cast("string"), F.lit("999.9")).alias("line")).write.text(path)
    fmt = scratch_path(spark, "format")
    lines = ["ITEMS FORMAT", "1 YEAR I4", "2 DOY I4", "3 Hour I3", "4 Kp index I3", "5 Dst-index, nT I6", "6 f10.7_index F6.1"]
    spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in lines])).alias("line")).write.text(fmt)
    out = text.read_listing(spark, path, fmt)
    return out.select(us(F.col("Timestamp")).alias("ts_us"), r(F.col("Kp")).alias("kp"), F.col("Dst").alias("dst"),
                      col("F10.7").alias("f107"))


@query("station_catalogue", "SELECT count(*) AS n_nations, CAST(23 AS BIGINT) AS n_stations FROM nation")
def _(spark, sf):
    n = table(spark, sf, "nation").agg(F.count("*").alias("n_nations"))
    return with_row(n, text.stations(spark).agg(F.count("*").alias("n_stations")))


@query("landing_months", """
  SELECT o_custkey AS station, o_orderkey FROM orders
  WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-06-01'""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 1000).alias("Station"), "o_custkey", "o_orderkey",
                                          F.col("o_orderdate").cast("timestamp").alias("Timestamp"))
    root = scratch_path(spark, "landing")
    stores.land(o, root)
    stores.land(o.filter(F.year("Timestamp") == 1997), root)  # replaces those months only
    wanted = text.months(spark, "1997-03-10", "1997-05-20")
    return stores.landed(spark, root, wanted=wanted).select(F.col("o_custkey").alias("station"), "o_orderkey")


@query("month_enumeration", """
  SELECT CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month_of_year
  FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m FROM orders)""")
def _(spark, sf):
    ends = table(spark, sf, "orders").agg(F.min("o_orderdate").cast("date").cast("string").alias("a"),
                                          F.max("o_orderdate").cast("date").cast("string").alias("b")).first()
    return text.months(spark, ends["a"], ends["b"]).select("year", "month_of_year")


@query("baseline_files", with_obs("""
  SELECT 'Persistence' AS model, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, persistence AS y_pred FROM wide
  UNION ALL SELECT 'IRI-Plas', row_number() OVER (ORDER BY ts, event_id) - 1, rolling FROM wide""", PRED))
def _(spark, sf):
    root = scratch_path(spark, "baselines")
    p = written(predictions(spark, sf).select("model", "ts", "event_id", "y_pred"), "predictions")
    for name, file in (("persistence", "persistence_preds.csv"), ("rolling", "iri_plas_preds.csv")):
        one = p.filter(F.col("model") == name).orderBy("ts", "event_id").select(
            F.coalesce(F.col("y_pred").cast("string"), F.lit("nan")).alias("predicted_tec"))
        # The row order of a prediction file is its key; Spark's folder has it in the order of its parts.
        one.write.csv(f"{root}/{file}", header=True, emptyValue="", nullValue="")
    return text.read_baselines(spark, root, ["Persistence", "IRI-Plas"])


@query("split_sink", with_obs("""
  SELECT CASE WHEN day(ts) <= 20 THEN 'train' ELSE 'test' END AS split, count(*) AS n, round(sum(value), 3) AS total
  FROM obs GROUP BY 1"""))
def _(spark, sf):
    path = scratch_path(spark, "splits")
    o = observations(spark, sf).withColumn("split", F.when(F.dayofmonth("Timestamp") <= 20, "train").otherwise("test"))
    stores.write_splits(o, path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


@query("sequence_sink", with_obs("""
  SELECT station, start, y FROM (SELECT station, row_number() OVER s - 1 AS start, lead(value, 11) OVER s AS y,
    count(*) OVER (PARTITION BY station) AS n FROM obs WINDOW s AS (PARTITION BY station ORDER BY ts, event_id))
  WHERE start < n - 12"""))
def _(spark, sf):
    path = scratch_path(spark, "sequences")
    seq = sequences.sequences(observations(spark, sf), ["value", "Dst"], "value", 12, order=["Timestamp", "event_id"])
    stores.write_sequences(seq, path)
    back = spark.read.parquet(path)
    return back.filter(F.size("x") == 12).select(F.col("Station").alias("station"), "start", "y")


@query("json_round_trip", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "json")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    stores.save_json(o, path)
    return stores.load_json(spark, path, o.schema)


@query("export_formats", """
  SELECT f AS format, count(*) AS n, round(sum(s_acctbal), 2) AS total
  FROM supplier, (VALUES ('csv'), ('json'), ('parquet')) t(f) GROUP BY f""")
def _(spark, sf):
    base = scratch_path(spark, "export")
    s = table(spark, sf, "supplier")
    paths = stores.export(s, base, ("csv", "json", "parquet"))
    back = {"csv": spark.read.csv(paths["csv"], header=True, schema=s.schema),
            "json": spark.read.json(paths["json"], schema=s.schema), "parquet": spark.read.parquet(paths["parquet"])}
    out = None
    for f, df in back.items():
        one = df.agg(F.lit(f).alias("format"), F.count("*").alias("n"), r(F.sum("s_acctbal"), 2).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("dataset_versions", "SELECT 'dataset_v2' AS version, count(*) AS n FROM customer")
def _(spark, sf):
    root = scratch_path(spark, "versions")
    c = table(spark, sf, "customer")
    stores.write_version(c.withColumn("c_acctbal", F.lit(0.0)), root, None)
    version = stores.write_version(c, root, None)
    return stores.read_latest(spark, root).agg(F.lit(version).alias("version"), F.count("*").alias("n"))


@query("dataset_hash", "SELECT count(*) AS n_rows, true AS same_in_any_order, false AS same_without_copies FROM lineitem")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    a = stores.dataset_hash(l)
    b = stores.dataset_hash(l.orderBy(F.col("l_linenumber").desc(), "l_orderkey")).select(F.col("hash").alias("h2"))
    c = stores.dataset_hash(l.distinct()).select(F.col("hash").alias("h3"))
    return with_row(with_row(a, b), c).select(
        "n_rows", (F.col("hash") == F.col("h2")).alias("same_in_any_order"),
        (F.col("hash") == F.col("h3")).alias("same_without_copies"))


@query("dataset_metadata", with_obs("""
  SELECT count(*) AS n_rows, count(*) * 2 - count(tec) - count(kp) AS n_missing, count_if(day(ts) <= 20) AS n_train,
         CAST(2 AS INT) AS n_features FROM obs"""))
def _(spark, sf):
    o = observations(spark, sf).select("Station", "TEC", "Kp", F.when(
        F.dayofmonth("Timestamp") <= 20, "train").otherwise("test").alias("split"))
    path = scratch_path(spark, "metadata")
    stores.save_json(stores.metadata(o, ["TEC", "Kp"], ["TEC"], 96, 1), path)
    back = stores.load_json(spark, path)
    return back.select("n_rows", "n_missing", "n_train", F.size("features").alias("n_features"))


@query("scaler_store", """
  SELECT 'l_tax' AS "column", round(avg(l_tax), 6) AS center, round(stddev_pop(l_tax), 6) AS scale FROM lineitem""")
def _(spark, sf):
    path = scratch_path(spark, "scaler")
    stores.save_scaler(scaling.fit_scaler(table(spark, sf, "lineitem"), ["l_tax"], "standard"), path)
    return stores.load_scaler(spark, path).select("column", r(F.col("center")).alias("center"), r(F.col("scale")).alias("scale"))


@query("discovery_store", with_obs("""
  SELECT station, count(*) AS n FROM obs GROUP BY station"""))
def _(spark, sf):
    root = scratch_path(spark, "store")
    counts = observations(spark, sf).groupBy(F.col("Station").alias("station")).agg(F.count("*").alias("n"))
    for _ in range(2):  # the same run again adds nothing
        stores.save_discovery({"counts": counts, "busy": counts.filter("n > 60")}, root, "2024-01")
    return stores.read_discovery(spark, root, "counts", "station long, n long").select("station", "n")


@query("discovery_history", with_obs("""
  WITH w AS (SELECT CAST((day(ts) - 1) // 7 AS BIGINT) AS week, value AS x FROM obs),
  m AS (SELECT week, count(*) AS n, avg(x) AS mean FROM w GROUP BY week),
  h AS (SELECT m.week, avg(p.x) AS hist_mean, stddev_pop(p.x) AS hist_std FROM m LEFT JOIN w p ON p.week < m.week GROUP BY m.week)
  SELECT week, n, round(hist_mean, 6) AS hist_mean, round(hist_std, 6) AS hist_std,
         round(abs((mean - hist_mean) / (hist_std + 1e-8)), 6) AS drift_z FROM m JOIN h USING (week)"""))
def _(spark, sf):
    """Weeks as runs of one store: each run's drift is against the values that earlier runs recorded, never its own."""
    root = scratch_path(spark, "runs")
    weeks = observations(spark, sf).withColumn("week", F.floor((F.dayofmonth("Timestamp") - 1) / 7).cast("long"))
    for week in range(5):  # a month has five
        now = weeks.filter(F.col("week") == week)
        moved = discovery.drift(now, stores.history_before(spark, root, str(week)), "value", ["week"])
        found = {"drift": moved, "history": discovery.moments(now, "value")}
        stores.save_discovery(found, root, str(week))
    past = [stores.history_before(spark, root, str(week)).withColumn("week", F.lit(week).cast("long")) for week in range(5)]
    n = stores.read_discovery(spark, root, "history", "n long").select(F.col("run").cast("long").alias("week"), "n")
    z = stores.read_discovery(spark, root, "drift", "week long, drift_z double").select("week", "drift_z")
    return z.join(n, "week").join(reduce(DataFrame.unionByName, past), "week").select("week", "n", *[
        r(F.col(c)).alias(c) for c in ("hist_mean", "hist_std", "drift_z")])


@query("metric_log", with_obs("""
  SELECT s AS step, model, round(rmse * s, 5) AS rmse FROM (
    SELECT model, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse FROM pred WHERE y_pred IS NOT NULL GROUP BY model), range(1, 3) t(s)""",
    PRED))
def _(spark, sf):
    root = scratch_path(spark, "metrics")
    base = metrics.basic_metrics(predictions(spark, sf), ["model"]).select("model", "rmse")
    for step in (1, 2):
        stores.log_metrics(base.withColumn("rmse", F.col("rmse") * step), root, step)
    return spark.read.parquet(root).select(F.col("step").cast("long").alias("step"), "model", r(F.col("rmse"), 5).alias("rmse"))


@query("schema_completion", with_obs("""
  SELECT CAST(22 AS INT) AS n_columns, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_b1, count(tec) AS n_tec FROM obs"""))
def _(spark, sf):
    out = text.conform(observations(spark, sf))
    return out.agg(F.lit(len(out.columns)).alias("n_columns"), F.count("*").alias("n_rows"),
                   F.count("B1").alias("n_b1"), F.count("TEC").alias("n_tec"))


@query("station_union", with_obs("""
  SELECT event_id, tec, CASE WHEN event_type = 'click' THEN kp END AS kp FROM obs"""))
def _(spark, sf):
    o = observations(spark, sf)
    frames = [o.filter("event_type = 'click'").select("event_id", "TEC", "Kp"),
              o.filter("event_type = 'view'").select("event_id", "TEC"),
              o.filter("event_type NOT IN ('click', 'view')").select("TEC", "event_id")]
    return text.union_stations(frames).select("event_id", F.col("TEC").alias("tec"), F.col("Kp").alias("kp"))
