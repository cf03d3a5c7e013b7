"""Discovery operators on the prediction table and the latent vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywell.checks.base import PRED, observations, predictions_wide, query, r, table, with_obs
from skywell.operators import discovery, metrics
from skywell.operators.ordering import with_row
from skywell.schema import col
from skywell.session import durable, scratch_path
from skywell.sources import stores

FEATURES = {"Kp": "kp", "Dst": "dst", "F10.7": "f107", "hmF2": "hmf2", "SSN": "ssn"}


def _mining(spark, sf):
    o = observations(spark, sf)
    return o.select("event_id", "Station", "Timestamp", "Kp", "Dst", col("F10.7"), "hmF2", "SSN",
                    (F.col("value") * 2 + F.coalesce("Kp", F.lit(0.0))).alias("prediction"))


def _bin_sql(c):
    return " + ".join(f"({c} > quantile_cont({c}, {j / 10}) OVER ())::INT" for j in range(1, 10))


MI = f"""
base AS (SELECT event_id, kp, dst, f107, hmf2, ssn, value * 2 + coalesce(kp, 0) AS prediction FROM obs WHERE kp IS NOT NULL),
binned AS (SELECT {", ".join(f"{_bin_sql(c)} AS {c}_b" for c in [*FEATURES.values(), "prediction"])} FROM base),
cells AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, {c}_b AS a, prediction_b AS b FROM binned" for n, c in FEATURES.items())}),
joint AS (SELECT feature, a, b, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY ALL),
mi AS (SELECT feature, sum(n / t * ln(n * t / (na * nb))) AS mi FROM (
    SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, a) AS na,
           sum(n) OVER (PARTITION BY feature, b) AS nb FROM joint) GROUP BY feature),
scores AS (SELECT feature, mi, CASE WHEN max(mi) OVER () > 0 THEN mi / max(mi) OVER () ELSE mi END AS score FROM mi)
"""


@query("mutual_information", with_obs(
    "SELECT feature, round(mi, 6) AS mi, round(score, 6) AS score FROM scores", MI))
def _(spark, sf):
    out = discovery.ranked(discovery.mutual_information(_mining(spark, sf), list(FEATURES), "prediction"))
    return out.select("feature", r(F.col("mi")).alias("mi"), r(F.col("score")).alias("score"))


@query("relation_edges", with_obs(
    "SELECT feature, 'Topside TEC' AS target, round(score * 5, 6) AS weight FROM scores WHERE score > 0.1", MI))
def _(spark, sf):
    scores = discovery.mutual_information(_mining(spark, sf), list(FEATURES), "prediction")
    return discovery.relation_edges(scores).withColumn("weight", r(F.col("weight")))


DRIFT = """
hist AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM obs WHERE day(ts) <= 15),
z AS (SELECT station, avg(value) AS current_mean, abs((avg(value) - any_value(m)) / (any_value(s) + 1e-8)) AS drift_z
      FROM obs, hist WHERE day(ts) > 15 GROUP BY station)
"""


def _drift(spark, sf, by):
    o = observations(spark, sf)
    history = discovery.history_of(o.filter(F.dayofmonth("Timestamp") <= 15), "value")
    return discovery.drift(o.filter(F.dayofmonth("Timestamp") > 15), history, "value", by, 0.5)


@query("concept_drift", with_obs("""
  SELECT station, round(current_mean + 1e-9, 6) AS current_mean, round(drift_z, 6) AS drift_z, drift_z > 0.5 AS is_drifting FROM z""",
    DRIFT))
def _(spark, sf):
    return _drift(spark, sf, ["Station"]).select(
        F.col("Station").alias("station"), r(F.col("current_mean") + 1e-9).alias("current_mean"),
        r(F.col("drift_z")).alias("drift_z"), "is_drifting")


@query("hypotheses", with_obs("""
  SELECT 'binned mutual information' AS evidence, 100.0::DOUBLE AS confidence
  UNION ALL SELECT 'isolation depth', 85.0::DOUBLE FROM obs HAVING count(*) FILTER (value * 2 + coalesce(kp, 0) > 300) > 0""", MI))
def _(spark, sf):
    m = _mining(spark, sf)
    scores = discovery.mutual_information(m, list(FEATURES), "prediction")
    n_novel = m.agg(F.count_if(F.col("prediction") > 300).alias("n_novel"))
    out = discovery.hypotheses(scores, n_novel, _drift(spark, sf, []))
    return out.select("evidence", r(F.col("confidence"), 4).alias("confidence"))


DB1 = """
v AS (SELECT event_id, round(value * 3, 2) AS x FROM obs),
c AS (SELECT event_id, x, count(*) OVER (ORDER BY x RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS n FROM v),
u AS (SELECT DISTINCT x FROM c WHERE n >= 5),
g AS (SELECT x, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 0.5 THEN 0 ELSE 1 END AS opens FROM u),
core AS (SELECT x, sum(opens) OVER (ORDER BY x) - 1 AS id FROM g),
near AS (SELECT c.x, core.id, core.x AS cx FROM (SELECT DISTINCT x FROM c) c JOIN core ON core.x BETWEEN c.x - 0.5 AND c.x + 0.5
         AND abs(core.x - c.x) <= 0.5),
lab AS (SELECT x, arg_min(id, struct_pack(d := abs(cx - x), cx := cx)) AS id FROM near GROUP BY x)
"""


@query("density_clusters", with_obs("""
  SELECT event_id, CAST(coalesce(lab.id, -1) AS BIGINT) AS cluster FROM c LEFT JOIN lab ON lab.x = c.x""", DB1))
def _(spark, sf):
    o = observations(spark, sf).select("event_id", F.round(F.col("value") * 3, 2).alias("x"))
    return discovery.dbscan_line(o, "x").select("event_id", "cluster")


@query("density_cluster_summary", with_obs("""
  SELECT count(DISTINCT lab.id) AS n_clusters, count(*) FILTER (WHERE lab.id IS NULL) AS n_noise
  FROM c LEFT JOIN lab ON lab.x = c.x""", DB1))
def _(spark, sf):
    o = observations(spark, sf).select("event_id", F.round(F.col("value") * 3, 2).alias("x"))
    return discovery.cluster_summary(discovery.dbscan_line(o, "x"))


def _near_sql(source, extra):
    """The k nearest rows in value order by (distance, position)."""
    return f"""SELECT * FROM (SELECT a.i, b.i AS j, abs(a.x - b.x) AS d{extra},
      row_number() OVER (PARTITION BY a.i ORDER BY abs(a.x - b.x), b.i) AS rk
      FROM {source} a JOIN {source} b ON b.i BETWEEN a.i - 20 AND a.i + 20 AND b.i <> a.i) WHERE rk <= 20"""


@query("local_outlier_factor", with_obs("""
  SELECT event_id, round(s / lrd, 5) AS lof FROM (
    SELECT n3.i, avg(lrd.lrd) AS s FROM n2 n3 JOIN lrd ON lrd.i = n3.j GROUP BY n3.i) q
  JOIN lrd USING (i) JOIN num USING (i)""", f"""
num AS (SELECT event_id, value AS x, row_number() OVER (ORDER BY value, ts, event_id) AS i FROM obs)""", f"""
n1 AS ({_near_sql("num", "")})""", """
kd AS (SELECT num.i, num.x, m.kd FROM num JOIN (SELECT i, max(d) AS kd FROM n1 GROUP BY i) m USING (i))""", f"""
n2 AS ({_near_sql("kd", ", b.kd")})""", """
lrd AS (SELECT i, 1 / (avg(greatest(kd, d)) + 1e-10) AS lrd FROM n2 GROUP BY i)"""))
def _(spark, sf):
    out = discovery.lof_line(observations(spark, sf).select("event_id", "Timestamp", "value"), "value")
    return out.select("event_id", r(F.col("lof"), 5).alias("lof"))


@query("behaviour_states")
def _(spark, sf):
    return discovery.behaviour_states(_mining(spark, sf), "prediction").select("event_id", "state")


@query("storm_archetypes")
def _(spark, sf):
    m = _mining(spark, sf).dropna(subset=["Kp"])
    return discovery.storm_archetypes(m, ["Kp", "Dst", "prediction"]).select(
        "event_id", "storm_cluster", "archetype")


def _misplaced(labelled, label, features):
    """(n, n_clusters, settled): at most one row in a hundred lies nearer to the mean of another cluster than to its own's.

    The iteration stops before the means stand still, so a few rows between two clusters may.
    """
    means = labelled.groupBy(label).agg(F.struct(*[F.avg(col(f)).alias(f"m{i}") for i, f in enumerate(features)]).alias("m"))
    centres = means.agg(F.collect_list(F.struct(F.col(label).alias("c"), "m")).alias("centres"))  # one per cluster
    d2 = lambda m: sum(((col(f) - m[f"m{i}"]) * (col(f) - m[f"m{i}"]) for i, f in enumerate(features)), F.lit(0.0))
    best = F.array_min(F.transform("centres", lambda e: F.struct(d2(e["m"]).alias("d"), e["c"].alias("c"))))["c"]
    return with_row(labelled, centres).agg(
        F.count("*").alias("n"), F.countDistinct(label).alias("n_clusters"),
        (F.count_if(best != F.col(label)) <= F.count("*") * 0.01).alias("settled"))


@query("behaviour_states_settled", with_obs("SELECT count(*) AS n, 5 AS n_clusters, true AS settled, true AS ascending FROM obs"))
def _(spark, sf):
    """Every row in the state of its nearest mean; states are intervals in rising order."""
    out = discovery.behaviour_states(_mining(spark, sf), "prediction").select("state", "prediction")
    spans = out.groupBy("state").agg(F.min("prediction").alias("lo"), F.max("prediction").alias("hi"))
    row = spans.agg(F.sort_array(F.collect_list(F.struct("state", "lo", "hi"))).alias("s"))
    rising = F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i)["lo"] > F.get("s", i - 1)["hi"])
    return with_row(_misplaced(out, "state", ["prediction"]), row.select(rising.alias("ascending")))


@query("storm_archetypes_settled", with_obs("""
  SELECT count(*) AS n, 3 AS n_clusters, true AS settled, 3 AS n_archetypes FROM obs WHERE kp IS NOT NULL"""))
def _(spark, sf):
    m = _mining(spark, sf).dropna(subset=["Kp"])
    out = durable(discovery.storm_archetypes(m, ["Kp", "Dst", "prediction"]).select(
        "storm_cluster", "archetype", "Kp", "Dst", "prediction"))
    return with_row(_misplaced(out, "storm_cluster", ["Kp", "Dst", "prediction"]),
                    out.agg(F.countDistinct("archetype").alias("n_archetypes")))


@query("plane_clusters", """
  WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
  near AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, b.x AS px, b.y AS py
           FROM p a JOIN p b ON b.x BETWEEN a.x - 0.021 AND a.x + 0.021 AND b.y BETWEEN a.y - 0.021 AND a.y + 0.021),
  link AS (SELECT * FROM near WHERE d2 <= 0.02::DOUBLE * 0.02::DOUBLE),
  core AS (SELECT a AS id FROM link GROUP BY a HAVING count(*) >= 5),
  joined AS (SELECT a, b FROM link WHERE a IN (FROM core) AND b IN (FROM core)),
  reach AS (SELECT a AS root, a AS id FROM joined UNION SELECT r.root, j.b FROM reach r JOIN joined j ON j.a = r.id),
  label AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
  border AS (SELECT a AS id, arg_min(label.root, {'d2': d2, 'x': px, 'y': py}) AS root FROM link JOIN label ON label.id = link.b
             WHERE a NOT IN (FROM core) GROUP BY a),
  named AS (SELECT * FROM label UNION ALL SELECT * FROM border),
  first AS (SELECT root, row_number() OVER (ORDER BY min(id)) - 1 AS cluster FROM named GROUP BY root)
  SELECT p.id AS vec_id, coalesce(first.cluster, -1) AS cluster FROM p LEFT JOIN named USING (id) LEFT JOIN first USING (root)""")
def _(spark, sf):
    """Density clusters over two coordinates that SQL has too (`latent_clusters` has those of the principal plane)."""
    p = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return discovery.dbscan_plane(p, "vec_id", "x", "y", 0.02, 5)


@query("baseline_normal_equations", with_obs("""
  SELECT count(*) AS n, count(*) FILTER (WHERE split = 'train') AS n_train, true AS centred, true AS orthogonal
  FROM wide WHERE persistence IS NOT NULL AND rolling IS NOT NULL AND kp IS NOT NULL""", PRED))
def _(spark, sf):
    """The linear baseline leaves residuals on the train rows with mean zero, uncorrelated with every feature."""
    names = ["persistence", "rolling", "kp", "f107"]
    out = discovery.fit_baseline(predictions_wide(spark, sf), "Linear_Regression", names, "y_true", F.col("split") == "train")
    rest = F.when(F.col("split") == "train", F.col("y_true") - F.col("y_pred"))
    return out.agg(
        F.count("*").alias("n"), F.count(rest).alias("n_train"), (F.abs(F.avg(rest)) < 1e-4 * F.stddev_pop("y_true")).alias("centred"),
        (F.greatest(*[F.abs(F.corr(rest, F.when(F.col("split") == "train", F.col(f)))) for f in names]) < 1e-4).alias("orthogonal"))


@query("novel_events")
def _(spark, sf):
    out = discovery.novelty(_mining(spark, sf), ["Kp", "Dst", "hmF2", "prediction"], ["event_id"])
    return out.select("event_id", "novelty_score", "is_novel")


@query("latent_plane")
def _(spark, sf):
    return discovery.pca_plane(table(spark, sf, "embeddings"), "embedding").select(
        "vec_id", r(F.col("pc1")).alias("pc1"), r(F.col("pc2")).alias("pc2"))


@query("latent_plane_axes", "SELECT count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered FROM embeddings")
def _(spark, sf):
    """Invariants of the two axes: no mean, no correlation, the first carries more variance."""
    p = discovery.pca_plane(table(spark, sf, "embeddings"), "embedding")
    return p.agg(
        F.count("*").alias("n"), (F.abs(F.avg("pc1")) + F.abs(F.avg("pc2")) < 1e-9).alias("centred"),
        (F.abs(F.corr("pc1", "pc2")) < 1e-6).alias("uncorrelated"), (F.var_pop("pc1") >= F.var_pop("pc2")).alias("ordered"))


@query("latent_clusters")
def _(spark, sf):
    plane = discovery.pca_plane(table(spark, sf, "embeddings"), "embedding").select("vec_id", "pc1", "pc2")
    return discovery.dbscan_plane(plane, "vec_id", "pc1", "pc2", 0.03, 5)


def _baseline(kind):
    @query(f"baseline_{kind.lower()}")
    def _(spark, sf):
        w = predictions_wide(spark, sf).dropna(subset=["persistence", "rolling", "kp"])
        out = discovery.fit_baseline(w, kind, ["persistence", "rolling", "kp", "f107"], "y_true",
                                     F.col("split") == "train")
        return metrics.basic_metrics(out, ["model", "split"])


for _kind in discovery.REGRESSORS:
    _baseline(_kind)


@query("discovery_bundle")
def _(spark, sf):
    m = _mining(spark, sf).dropna(subset=["Kp"])
    history = discovery.history_of(m.filter(F.dayofmonth("Timestamp") <= 15), "prediction")
    out = discovery.discover(m, list(FEATURES), "prediction", "Kp", ["event_id"], history)
    return out["events"].groupBy("event_class").agg(F.count("*").alias("n"))


@query("discovery_records")
def _(spark, sf):
    """What two runs of the whole bundle, the second saved twice, leave in the store: (run, category, payload)."""
    m = _mining(spark, sf).dropna(subset=["Kp"])
    root = scratch_path(spark, "discovery")
    halves = {"2024-01a": F.dayofmonth("Timestamp") <= 15, "2024-01b": F.dayofmonth("Timestamp") > 15}
    for run in ("2024-01a", "2024-01b", "2024-01b"):
        found = discovery.discover(m.filter(halves[run]), list(FEATURES), "prediction", "Kp", ["event_id"],
                                   stores.history_before(spark, root, run), table(spark, sf, "embeddings"))
        stores.save_discovery(discovery.records(found), root, run)
    return spark.read.parquet(root).select(F.col("run").cast("string").alias("run"), "category", "payload")
