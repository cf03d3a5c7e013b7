"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywell.checks.base import HOURLY, PRED, hourly, observations, predictions, query, r, table, us, with_obs
from skywell.operators import joins, retrieval


@query("hourly_join", with_obs("""
  SELECT event_id, idx_kp, idx_ap, idx_dst FROM obs LEFT JOIN hourly ON date_trunc('hour', obs.ts) = hourly.ts""",
    HOURLY))
def _(spark, sf):
    out = joins.join_hourly(observations(spark, sf), hourly(spark, sf))
    return out.select("event_id", "idx_kp", "idx_ap", "idx_dst")


NEAREST = """
  SELECT event_id, arg_min(idx_kp, {pick}) AS idx_kp FROM (
    SELECT o.event_id, h.idx_kp, abs(epoch_us(o.ts) - epoch_us(h.ts)) AS d, epoch_us(h.ts) AS hts
    FROM obs o LEFT JOIN hourly h ON {cond}) GROUP BY event_id"""
PICK = "d::HUGEINT * 10000000000000000 + hts"


def _nearest(name, tolerance, cond):
    @query(name, with_obs(NEAREST.format(pick=PICK, cond=cond), HOURLY))
    def _(spark, sf):
        out = joins.asof_nearest(observations(spark, sf), hourly(spark, sf), "Timestamp", tolerance)
        return out.select("event_id", "idx_kp")


_nearest("asof_nearest", 900.0, "abs(epoch_us(o.ts) - epoch_us(h.ts)) <= 900000000")
_nearest("asof_nearest_merged", 1500.0, "abs(epoch_us(o.ts) - epoch_us(h.ts)) <= 1500000000")


@query("asof_nearest_keyed", """
  WITH p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
  v AS (SELECT event_id AS vid, user_id, ts, value AS v_value FROM events WHERE event_type <> 'purchase'),
  c AS (SELECT p.event_id, v.v_value, abs(epoch_us(p.ts) - epoch_us(v.ts)) AS d, epoch_us(v.ts) AS hts
        FROM p LEFT JOIN v ON p.user_id = v.user_id)
  SELECT event_id, arg_min(v_value, d::HUGEINT * 10000000000000000 + hts) AS v_value FROM c GROUP BY event_id""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                                          "event_type", "value")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type <> 'purchase'").select("user_id", "ts", F.col("value").alias("v_value"))
    return joins.asof_nearest(left, right, "ts", None, ["user_id"]).select("event_id", "v_value")


@query("asof_nearest_ties", """
  WITH l AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 40 END AS k,
                    date_trunc('hour', ts) AS ts FROM events),
  r AS (SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 40 END AS k,
               date_trunc('day', ts) AS ts, min(event_id) AS first_id FROM events GROUP BY ALL),
  c AS (SELECT l.event_id, r.first_id, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS d, epoch_us(r.ts) AS rts
        FROM l LEFT JOIN r ON l.k = r.k)
  SELECT event_id, arg_min(first_id, d::HUGEINT * 10000000000000000 + rts) AS first_id FROM c GROUP BY event_id""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    left = e.select("event_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 40).alias("k"),
                    F.date_trunc("hour", "ts").alias("ts"))
    right = e.select(F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 40).alias("k"),
                     F.date_trunc("day", "ts").alias("ts"), F.col("event_id").alias("first_id"))
    return joins.asof_nearest(left, right, "ts", None, ["k"]).select("event_id", "first_id")


@query("merge_statistics", with_obs("""
  SELECT count(*) AS total, count(k) AS matched, count(*) - count(k) AS unmatched,
         round(count(k) * 100.0 / count(*), 6) AS match_pct
  FROM (SELECT o.event_id, max(h.idx_kp) AS k FROM obs o LEFT JOIN hourly h
        ON abs(epoch_us(o.ts) - epoch_us(h.ts)) <= 900000000 GROUP BY 1)""", HOURLY))
def _(spark, sf):
    out = joins.asof_nearest(observations(spark, sf), hourly(spark, sf), "Timestamp", 900.0)
    return joins.merge_stats(out, "idx_kp").withColumn("match_pct", r(F.col("match_pct")))


@query("outer_time_join", """
  WITH a AS (SELECT o_orderdate AS d, count(*) AS n_orders FROM orders GROUP BY 1),
       b AS (SELECT l_shipdate AS d, count(*) AS n_lines FROM lineitem GROUP BY 1)
  SELECT CAST(epoch(coalesce(a.d, b.d)) AS BIGINT) AS day, n_orders, n_lines
  FROM a FULL JOIN b ON a.d = b.d""")
def _(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("d")).agg(F.count("*").alias("n_orders"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("d")).agg(F.count("*").alias("n_lines"))
    return joins.outer_in_time(a, b, "d").select(
        F.unix_seconds(F.col("d").cast("timestamp")).alias("day"), "n_orders", "n_lines")


@query("station_attributes", """
  SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return joins.attach_dimension(table(spark, sf, "orders"), c, "o_custkey").select(
        "o_orderkey", "c_mktsegment", "c_acctbal")


@query("stations_without_attributes", """
  SELECT l_orderkey AS station, count(*) AS n_rows FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1""")
def _(spark, sf):
    dim = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("station"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("station"))
    return joins.unmatched_keys(rows, dim, "station")


@query("prediction_alignment", with_obs("""
  SELECT t.event_id AS idx, m.model, p.y_pred FROM obs t CROSS JOIN (SELECT DISTINCT model FROM pred) m
  LEFT JOIN (SELECT * FROM pred WHERE y_pred > 40) p ON p.event_id = t.event_id AND p.model = m.model""", PRED))
def _(spark, sf):
    p = predictions(spark, sf).select("model", F.col("event_id").alias("idx"), "y_pred")
    targets = observations(spark, sf).select(F.col("event_id").alias("idx"), F.col("value").alias("y_true"))
    models = p.filter("y_pred > 40")
    return joins.align(targets, models).select("idx", "model", "y_pred")


@query("prediction_lengths", with_obs("""
  SELECT model, count(*) AS n_pred, (SELECT count(*) FROM obs) AS n_target,
         count(*) = (SELECT count(*) FROM obs) AS same_length
  FROM pred WHERE y_pred IS NOT NULL GROUP BY model""", PRED))
def _(spark, sf):
    p = predictions(spark, sf).filter("y_pred is not null").select("model", "y_pred")
    return joins.length_guard(observations(spark, sf).select("event_id"), p)


@query("memory_retrieval", """
  WITH bank AS (
    SELECT label AS mid, list(c ORDER BY i) AS v FROM (
      SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS c FROM embeddings, range(1, 65) t(i)
      GROUP BY label, i) GROUP BY label),
  s AS (
    SELECT q.vec_id AS qid, m.mid,
      list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * m.v[i])) / 8.0 AS score
    FROM embeddings q, bank m),
  t AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY score DESC) AS rk FROM s),
  e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY qid)) AS ex FROM t WHERE rk <= 8),
  w AS (SELECT *, ex / sum(ex) OVER (PARTITION BY qid) AS weight FROM e)
  SELECT qid, count(*) AS n_kept, round(max(weight), 5) AS top_weight,
         round(sum(weight * m.v[1]), 5) + 0.0 AS first_value
  FROM w JOIN bank m ON m.mid = w.mid GROUP BY qid""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    # The memory bank is one mean vector per label: its size does not grow with the table.
    cells = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    bank = means.groupBy(F.col("label").cast("long").alias("mid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("v"))
    vec = F.transform("embedding", lambda x: x.cast("double"))
    out = joins.topk_retrieve(e.select(F.col("vec_id").alias("qid"), vec.alias("q")), bank, 8)
    return out.select("qid", "n_kept", r(F.col("top_weight"), 5).alias("top_weight"),
                      r(F.col("value")[0], 5).alias("first_value"))


@query("retrieval_between_tables", """
  WITH s AS (
    SELECT q.vec_id AS qid, m.vec_id AS mid, CAST(m.embedding[1] AS DOUBLE) AS v1,
      list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(m.embedding[i] AS DOUBLE))) / 8.0 AS score
    FROM embeddings q, embeddings m),
  t AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY score DESC) AS rk FROM s),
  e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY qid)) AS ex FROM t WHERE rk <= 8),
  w AS (SELECT *, ex / sum(ex) OVER (PARTITION BY qid) AS weight FROM e)
  SELECT qid, count(*) AS n_kept, round(max(weight), 5) AS top_weight, round(sum(weight * v1), 5) + 0.0 AS first_value
  FROM w GROUP BY qid""")
def _(spark, sf):
    """Every vector against every vector, over shells of falling length."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), vec.alias("q"))
    out = retrieval.retrieve(e, e.toDF("mid", "v"), 8)
    return out.select("qid", "n_kept", r(F.col("top_weight"), 5).alias("top_weight"),
                      r(F.col("value")[0], 5).alias("first_value"))


@query("memory_pool", """
  SELECT CASE WHEN label < 2 THEN 'quiet' WHEN label < 4 THEN 'moderate' WHEN label < 6 THEN 'strong'
              WHEN label < 8 THEN 'seasonal' ELSE 'solar' END AS bank, vec_id, label FROM embeddings""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    banks = ["quiet", "moderate", "strong", "seasonal", "solar"]
    return joins.memory_pool({b: e.filter(F.floor(F.col("label") / 2) == i) for i, b in enumerate(banks)})


# --- sorts, limits and sets ------------------------------------------------------------------------

@query("sorted_series", with_obs("SELECT event_id, station, epoch_us(ts) AS ts_us FROM obs"))
def _(spark, sf):
    return observations(spark, sf).orderBy("Station", "Timestamp", "event_id").select(
        "event_id", F.col("Station").alias("station"), us(F.col("Timestamp")).alias("ts_us"))


@query("head_rows", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 20")
def _(spark, sf):
    return observations(spark, sf).orderBy("Timestamp", "event_id").limit(20).select("event_id", "value")


@query("union_by_name", """
  SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS name FROM customer
  UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"),
                                            F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"),
                                            F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("key_difference", """
  SELECT 'missing' AS side, o_custkey AS key FROM (SELECT DISTINCT c_custkey AS o_custkey FROM customer
         EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  UNION ALL SELECT 'unexpected', k FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem
         EXCEPT SELECT o_orderkey FROM orders)""")
def _(spark, sf):
    c, o, l = (table(spark, sf, n) for n in ("customer", "orders", "lineitem"))
    missing = c.select(F.col("c_custkey").alias("key")).distinct().join(
        o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")), "key", "left_anti")
    extra = l.select(F.col("l_orderkey").alias("key")).distinct().join(
        o.select(F.col("o_orderkey").alias("key")), "key", "left_anti")
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("unexpected")))


@query("distinct_stations", "SELECT DISTINCT user_id AS station FROM events")
def _(spark, sf):
    return observations(spark, sf).select(F.col("Station").alias("station")).distinct()
