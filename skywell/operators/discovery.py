"""Mining of prediction tables: relations, drift, novelty, local outliers and clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from skywell.functions.rules import event_class
from skywell.operators.forest import isolation_forest
from skywell.operators.layout import last_valid, lay_out, next_valid
from skywell.operators.ordering import prefix_counts, quantiles, value_bin, with_row
from skywell.schema import col, complete
from skywell.session import durable, side_by_side, written

LOF_CHUNK_ROWS = 50_000
PAIRS_A_TASK = 10_000


# --- relations -----------------------------------------------------------------------------------

def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, mi, score): information in nats between quantile bins, and its share of the largest."""
    names = [*features, target]
    rows = complete(df, names)
    edges = quantiles(rows, {f"e{i}": col(c) for i, c in enumerate(names)},
                      [j / bins for j in range(1, bins)])
    edges = edges.first()

    def slot(i: int, c: str) -> Column:
        """How many edges lie below, by comparing with the highest first; NaN counts as the highest."""
        x, found = col(c).cast("double"), None
        at = sorted((edges[f"e{i}__{j}"] for j in range(bins - 1) if edges[f"e{i}__{j}"] is not None), key=lambda e: (e != e, e))
        for n in range(len(at), 0, -1):
            above = x > F.lit(at[n - 1])
            found = F.when(above, n) if found is None else found.when(above, n)
        return F.lit(0) if found is None else found.otherwise(0)

    binned = rows.select(*[slot(i, c).alias(f"_s{i}") for i, c in enumerate(names)])
    cells = binned.select(F.col(f"_s{len(features)}").alias("b"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"_s{i}").alias("a")) for i in range(len(features))])).alias("r"))
    joint = cells.groupBy("r.i", "r.a", "b").agg(F.count(F.lit(1)).alias("n")).select(
        F.get(F.array(*[F.lit(f) for f in features]), F.col("i")).alias("feature"), "a", "b", "n")
    # At most bins^2 cells per feature from here on.
    whole, left, right = (Window.partitionBy("feature"), Window.partitionBy("feature", "a"),
                          Window.partitionBy("feature", "b"))
    n = F.col("n").cast("double")
    part = n / F.sum("n").over(whole) * F.log(
        n * F.sum("n").over(whole) / (F.sum("n").over(left).cast("double") * F.sum("n").over(right)))
    scores = joint.withColumn("_p", part).groupBy("feature").agg(F.sum("_p").alias("mi"))
    top = F.max("mi").over(Window.partitionBy(F.lit(1)))
    return scores.withColumn("score", F.when(top > 0, F.col("mi") / top).otherwise(F.col("mi")))


def ranked(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), "feature")


def relation_edges(scores: DataFrame, minimum: float = 0.1, target: str = "Topside TEC") -> DataFrame:
    return scores.filter(F.col("score") > minimum).select(
        "feature", F.lit(target).alias("target"), (F.col("score") * 5).alias("weight"))


# --- drift ---------------------------------------------------------------------------------------

def drift(current: DataFrame, history: DataFrame, value: str, by=(), threshold: float = 3.0) -> DataFrame:
    """Distance of each group's mean from the mean of the stored history, in its deviations.

    ``history`` is a one-row frame (hist_mean, hist_std), see :func:`history_of`.
    """
    now = current.groupBy(*[col(k) for k in by]).agg(F.avg(col(value)).alias("current_mean"))
    z = F.abs((F.col("current_mean") - F.col("hist_mean")) / (F.col("hist_std") + 1e-8))
    return with_row(now, history).withColumn("drift_z", z).withColumn(
        "is_drifting", F.col("drift_z") > threshold).drop("hist_mean", "hist_std")


def history_of(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(col(value)).alias("hist_mean"), F.stddev_pop(col(value)).alias("hist_std"))


# --- density on one axis -------------------------------------------------------------------------

def _count_within(values: DataFrame, x: str, eps: float) -> DataFrame:
    """Rows within ``eps`` of each distinct value, by prefix counts at both ends of the interval.

    No value meets its neighbours pairwise: interval ends are merged into the value order and read
    the running count there.
    """
    v = values.select(col(x).cast("double").alias("_x"), "_n")
    marks = F.array(
        F.struct((F.col("_x") - eps).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")),
        F.struct(F.col("_x").alias("at"), F.lit(1).alias("kind"), F.col("_n").alias("n")),
        F.struct((F.col("_x") + eps).alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("n")),
    )
    line = v.withColumn("_m", F.explode(marks)).select("_x", "_m.at", "_m.kind", "_m.n")
    line = line.withColumn("_bin", value_bin(F.col("at"), line.schema["at"].dataType))
    bins = line.groupBy("_bin").agg(F.sum("n").alias("_in"))
    # A few hundred thousand bins at most, whatever the number of rows.
    before = Window.partitionBy(F.lit(1)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_base", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    inside = Window.partitionBy("_bin").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = line.join(bins, "_bin").withColumn("_seen", F.col("_base") + F.sum("n").over(inside))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("_seen")))
    return seen.groupBy("_x").agg((of(2) - of(0)).alias("_near")).withColumnRenamed("_x", x)


def dbscan_line(df: DataFrame, value: str, eps: float = 0.5, min_points: int = 5,
                out: str = "cluster", chunk_rows: int | None = None) -> DataFrame:
    """Density clusters of one column: numbered by rising value, -1 for noise.

    Works on distinct values.  A border value joins its nearest core value, the lower on a tie.
    """
    values = df.select(col(value).cast("double").alias("_v")).filter("_v is not null").groupBy("_v").agg(
        F.count(F.lit(1)).alias("_n"))
    near = _count_within(values, "_v", eps)
    cores = durable(near.withColumn("_core", F.when(F.col("_near") >= min_points, F.col("_v"))))
    first = lay_out(cores, [], ["_v"], valid=["_core"], chunk_rows=chunk_rows)
    prev = F.last("_core", True).over(first.frame(Window.unboundedPreceding, -1))
    opens = F.col("_core").isNotNull() & (F.col("_prev").isNull() | (F.col("_v") - F.col("_prev") > eps))
    starts = first.finish(first.rows.withColumn("_prev", prev)).withColumn(
        "_start", F.when(opens, F.col("_v"))).select("_v", "_core", "_start")
    second = lay_out(starts, [], ["_v"], valid=["_core", "_start"], chunk_rows=chunk_rows)
    is_core = F.col("_core").isNotNull()
    rows = second.rows.withColumns({
        "_p": last_valid(second, F.col("_core"), is_core),
        "_ps": last_valid(second, F.col("_start"), F.col("_start").isNotNull()),
        "_q": next_valid(second, F.struct(F.col("_core").alias("v"), F.col("_start").alias("s")), is_core),
    })
    back, ahead = F.col("_v") - F.col("_p"), F.col("_q")["v"] - F.col("_v")
    from_p = back.isNotNull() & (back <= eps) & (ahead.isNull() | (ahead > eps) | (back <= ahead))
    label = F.when(from_p, F.col("_ps")).when(
        ahead <= eps, F.coalesce(F.col("_q")["s"], F.col("_ps")))
    labelled = durable(second.finish(rows.withColumn("_label", label)).select("_v", "_label"))
    ids = prefix_counts(labelled.filter("_label is not null").select("_label").distinct(), "_label")
    named = labelled.join(ids.select("_label", F.col("_before").alias("_id")), "_label", "left").select(
        "_v", F.coalesce(F.col("_id"), F.lit(-1)).cast("long").alias(out))
    return df.join(named, col(value).cast("double") == F.col("_v"), "left").drop("_v")


def cluster_summary(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.agg(
        F.countDistinct(F.when(col(label) >= 0, col(label))).alias("n_clusters"),
        F.count_if(col(label) == -1).alias("n_noise"))


def _lof_of_values(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Factor of each distinct value of one sorted stretch; ``_n`` holds multiplicities."""
    pdf = pdf.sort_values("_v")
    copies = np.minimum(pdf["_n"].to_numpy(), k + 1)
    x = np.repeat(pdf["_v"].to_numpy(dtype=float), copies)
    offsets = np.concatenate([np.arange(-k, 0), np.arange(1, k + 1)])
    near = np.empty((len(x), k), dtype=np.int64)
    dist = np.empty((len(x), k))
    for at in range(0, len(x), 20_000):
        i = np.arange(at, min(at + 20_000, len(x)))
        j = i[:, None] + offsets
        outside = (j < 0) | (j >= len(x))
        j = np.clip(j, 0, len(x) - 1)
        d = np.where(outside, np.inf, np.abs(x[j] - x[i][:, None]))
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        near[i], dist[i] = np.take_along_axis(j, best, 1), np.take_along_axis(d, best, 1)
    lrd = 1.0 / (np.maximum(dist[:, -1][near], dist).mean(axis=1) + 1e-10)
    lof = lrd[near].mean(axis=1) / lrd
    first = np.cumsum(copies) - copies
    out = pd.DataFrame({"_v": pdf["_v"].to_numpy(), "_own": pdf["_own"].to_numpy(), "_lof": lof[first]})
    return out[out["_own"]][["_v", "_lof"]]


def lof_line(df: DataFrame, value: str, k: int = 20, threshold: float = 1.5, score: str = "lof",
             flag: str = "is_outlier", chunk_rows: int = LOF_CHUNK_ROWS) -> DataFrame:
    """Local outlier factor of one column.

    Equal values have equal factors and never use more than k + 1 of each other, so the work is done
    on distinct values with capped multiplicity and joined back.  In value order the k neighbours lie
    within k places on either side; a stretch of values with 3k borrowed ones at each end is complete
    for distance, density and factor.
    """
    values = df.filter(col(value).isNotNull()).groupBy(col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    values = durable(values)
    total = values.agg(F.sum("_n")).first()[0] or 0
    k = min(k, total - 1)
    if k < 1:
        return df.withColumns({score: F.lit(None).cast("double"), flag: F.lit(False)})
    layout = lay_out(values, [], ["_v"], before=3 * k, after=3 * k, chunk_rows=chunk_rows)
    rows = layout.rows
    if not layout.chunked:
        rows = rows.withColumns({"_chunk": F.lit(0), "_own": F.lit(True)})
    scored = rows.select("_v", "_n", "_chunk", "_own").groupBy("_chunk").applyInPandas(
        lambda pdf: _lof_of_values(pdf, k), "_v double, _lof double").withColumnRenamed("_lof", score)
    out = df.join(scored, col(value).cast("double") == F.col("_v"), "left").drop("_v")
    return out.withColumn(flag, F.coalesce(F.col(score) > threshold, F.lit(False)))


# --- novelty -------------------------------------------------------------------------------------

def novelty(df: DataFrame, features: list[str], identity: list[str], contamination: float = 0.01,
            trees: int = 100, seed: int = 42) -> DataFrame:
    """Isolation-forest score and ``is_novel`` on features plus prediction."""
    return isolation_forest(df, features, identity, contamination, trees, seed,
                            score="novelty_score", flag="is_novel")


# --- clusters through Spark ML -------------------------------------------------------------------

def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    names = [f"_f{i}" for i in range(len(features))]
    plain = df.withColumns({n: col(f).cast("double") for n, f in zip(names, features)})
    return VectorAssembler(inputCols=names, outputCol="_vec", handleInvalid="skip").transform(plain).drop(*names)


def _kmeans(df: DataFrame, features: list[str], k: int, seed: int, out: str) -> DataFrame:
    """Cluster ids renumbered by ascending centre, so that they do not depend on the start points."""
    model = KMeans(k=k, seed=seed, featuresCol="_vec", predictionCol="_k").fit(_assembled(df, features))
    centres = sorted((tuple(c), i) for i, c in enumerate(model.clusterCenters()))
    place = {old: new for new, (_, old) in enumerate(centres)}
    names = F.create_map(*[F.lit(v) for pair in place.items() for v in pair])
    return model.transform(_assembled(df, features)).withColumn(out, names[F.col("_k")]).drop("_vec", "_k")


def behaviour_states(df: DataFrame, value: str, k: int = 5, seed: int = 42) -> DataFrame:
    return _kmeans(df, [value], k, seed, "state")


# Archetype names by cluster id modulo 3.
ARCHETYPES = ["Positive Phase Dominant", "Negative Phase Dominant", "Delayed Recovery"]


def storm_archetypes(df: DataFrame, features: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    names = F.array(*[F.lit(a) for a in ARCHETYPES])
    return _kmeans(df, features, k, seed, "storm_cluster").withColumn(
        "archetype", F.element_at(names, F.col("storm_cluster") % 3 + 1))


def pca_plane(df: DataFrame, vector: str) -> DataFrame:
    """Two principal components of centred array vectors; the largest loading of each is positive."""
    vec = df.withColumn("_raw", array_to_vector(F.transform(col(vector), lambda v: v.cast("double"))))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_cent").fit(vec)
    vec = centre.transform(vec)
    model = PCA(k=2, inputCol="_cent", outputCol="_pc").fit(vec)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(vec).withColumn("_pc", vector_to_array("_pc"))
    return out.withColumns({
        f"pc{j + 1}": F.col("_pc")[j] * signs[j] for j in range(2)
    }).drop("_raw", "_cent", "_pc")


REGRESSORS = {
    "Linear_Regression": lambda: LinearRegression(featuresCol="_vec"),
    "Random_Forest": lambda: RandomForestRegressor(featuresCol="_vec", seed=42),
    "Boosted_Trees": lambda: GBTRegressor(featuresCol="_vec", seed=42, maxIter=20),
}


def fit_baseline(df: DataFrame, kind: str, features: list[str], target: str,
                 train: Column | None = None) -> DataFrame:
    """Predictions (``model``, ``y_pred``) of one fitted regression baseline for every complete row."""
    rows = _assembled(complete(df, [*features, target]), features)
    fit_on = rows.filter(train) if train is not None else rows
    model = REGRESSORS[kind]().setLabelCol(target).setPredictionCol("y_pred").fit(fit_on)
    return model.transform(rows).withColumn("model", F.lit(kind)).drop("_vec")


# --- hypotheses and the bundle -------------------------------------------------------------------

def hypotheses(scores: DataFrame, n_novel: DataFrame, drifting: DataFrame) -> DataFrame:
    """Statements whose evidence passes its rule: (statement, confidence, evidence).

    ``scores`` (feature, score), ``n_novel`` one row (n_novel), ``drifting`` one row
    (drift_z, is_drifting).
    """
    top = scores.agg(F.max_by("feature", F.struct("score", "feature")).alias("f"),
                     F.max("score").alias("s")).filter("s > 0.8").select(
        F.format_string("Topside TEC shares most information with %s.", F.col("f")).alias("statement"),
        (F.col("s") * 100).alias("confidence"), F.lit("binned mutual information").alias("evidence"))
    novel = n_novel.filter("n_novel > 0").select(
        F.format_string("%d rows are isolated from all others.", F.col("n_novel")).alias("statement"),
        F.lit(85.0).alias("confidence"), F.lit("isolation depth").alias("evidence"))
    moved = drifting.filter("is_drifting").select(
        F.lit("The mean state drifts against the stored history.").alias("statement"),
        F.least(F.lit(99.0), F.col("drift_z") * 20.0).alias("confidence"),
        F.format_string("%.2f deviations away", F.col("drift_z")).alias("evidence"))
    return top.unionByName(novel).unionByName(moved)


def discover(df: DataFrame, features: list[str], prediction: str, kp: str, identity: list[str],
             history: DataFrame, latent: DataFrame | None = None, latent_key: str = "vec_id",
             vector: str = "embedding", eps: float = 0.03) -> dict[str, DataFrame]:
    """All discovery results of one window of predictions, as named frames.

    ``latent`` (key, array of numbers) adds the clusters of its principal plane. Archetypes need at least
    three complete rows; k-means has no result for an empty window.
    """
    # Every step reads the window, most of them several times; three results read the scores.
    df = written(df, "window", in_order=True)
    points = lambda: pca_plane(latent, vector).select(col(latent_key), "pc1", "pc2")
    # The plane comes first, as its steps take longest.
    plane, scores, novel, outliers, states, archetypes, patterns = side_by_side(
        df.sparkSession,
        lambda: None if latent is None else dbscan_plane(points(), latent_key, "pc1", "pc2", eps, 5),
        lambda: durable(mutual_information(df, features, prediction)),
        lambda: novelty(df, [*features, prediction], identity),
        lambda: lof_line(df, prediction),
        lambda: behaviour_states(df, prediction),
        lambda: storm_archetypes(df, [kp, prediction]),
        lambda: dbscan_line(df, prediction))
    shift = drift(df, history, prediction)
    out = {
        "relationships": scores,
        "edges": relation_edges(scores),
        "novelty": novel,
        "outliers": outliers,
        "drift": shift,
        "states": states,
        "archetypes": archetypes,
        "patterns": patterns,
        "events": novel.withColumn("event_class", event_class(col(kp), F.col("is_novel"))),
        "hypotheses": hypotheses(scores, novel.agg(F.count_if("is_novel").alias("n_novel")), shift),
        "history": moments(df, prediction),
    }
    if plane is not None:
        out["latent_clusters"] = plane
    return out


def moments(df: DataFrame, value: str) -> DataFrame:
    """One row (n, mean, m2): what a run leaves for the drift of later ones."""
    v = col(value).cast("double")
    return df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def records(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The results of :func:`discover` as they go to a store: findings as they are, labels of rows as counts."""
    sizes = lambda name, label: found[name].groupBy(col(label)).agg(F.count(F.lit(1)).alias("n"))
    out = {name: found[name] for name in ("relationships", "edges", "drift", "hypotheses", "history")}
    out |= {"states": sizes("states", "state"), "archetypes": sizes("archetypes", "archetype"),
            "patterns": cluster_summary(found["patterns"]), "events": sizes("events", "event_class")}
    if "latent_clusters" in found:
        out["latent_clusters"] = sizes("latent_clusters", "cluster")
    return out


# --- density in the plane ------------------------------------------------------------------------

def dbscan_plane(df: DataFrame, key: str, x: str, y: str, eps: float, min_points: int = 5,
                 out: str = "cluster") -> DataFrame:
    """Density clusters of points in the plane: (key, cluster), -1 for noise.

    Points are put into square cells whose diagonal is ``eps``, so all points of a cell are
    neighbours: a cell with ``min_points`` rows is core as a whole, and only the few points of
    thinner cells need their neighbours counted.  Linked cells are found from their occupied
    sub-cells (:func:`_linked_cells`), so no two rich cells are compared point by point.
    """
    side = eps / 2 ** 0.5
    pts = durable(df.filter(col(x).isNotNull() & col(y).isNotNull()).select(
        col(key).alias("_id"), col(x).cast("double").alias("_x"), col(y).cast("double").alias("_y"),
        F.floor(col(x) / side).alias("_cx"), F.floor(col(y) / side).alias("_cy")))
    # Equal points count as one weighted site.
    sites = pts.groupBy("_cx", "_cy", "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    cells = sites.groupBy("_cx", "_cy").agg(F.sum("_w").alias("_n"))
    thin = sites.join(cells.filter(F.col("_n") < min_points), ["_cx", "_cy"])
    around = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)
        if abs(i) + abs(j) < 4]))
    ask = thin.select("_x", "_y", around.alias("_o")).select(
        F.col("_x").alias("_ax"), F.col("_y").alias("_ay"),
        (F.floor(F.col("_x") / side) + F.col("_o.i")).alias("_cx"),
        (F.floor(F.col("_y") / side) + F.col("_o.j")).alias("_cy"))
    # A thin cell holds fewer than min_points rows, so a site is met by at most 21 x min_points askers.
    close = lambda: ((F.col("_ax") - F.col("_x")) * (F.col("_ax") - F.col("_x"))
                     + (F.col("_ay") - F.col("_y")) * (F.col("_ay") - F.col("_y"))) <= eps * eps
    met = sites.join(ask, ["_cx", "_cy"]).filter(close())
    thin_core = met.groupBy("_ax", "_ay").agg(F.sum("_w").alias("_near")).filter(
        F.col("_near") >= min_points).select(F.col("_ax").alias("_x"), F.col("_ay").alias("_y"))
    rich = sites.join(cells.filter(F.col("_n") >= min_points).select("_cx", "_cy"), ["_cx", "_cy"], "left_semi")
    core = durable(rich.select("_x", "_y", "_cx", "_cy").unionByName(
        sites.join(thin_core, ["_x", "_y"], "left_semi").select("_x", "_y", "_cx", "_cy")))
    labels = _components(core.select("_cx", "_cy").distinct(), _linked_cells(core, eps, side))
    core = core.join(labels, ["_cx", "_cy"])
    # Border: a point that is not core takes the label of its nearest core point within eps.
    loose = sites.join(core.select("_x", "_y"), ["_x", "_y"], "left_anti").select(
        "_x", "_y", around.alias("_o")).select(
        F.col("_x").alias("_ax"), F.col("_y").alias("_ay"),
        (F.floor(F.col("_x") / side) + F.col("_o.i")).alias("_cx"),
        (F.floor(F.col("_y") / side) + F.col("_o.j")).alias("_cy"))
    d2 = ((F.col("_ax") - F.col("_x")) * (F.col("_ax") - F.col("_x"))
          + (F.col("_ay") - F.col("_y")) * (F.col("_ay") - F.col("_y")))
    border = core.join(loose, ["_cx", "_cy"]).filter(close()).groupBy("_ax", "_ay").agg(
        F.min_by("_label", F.struct(d2, F.col("_x"), F.col("_y"))).alias("_label")).select(
        F.col("_ax").alias("_x"), F.col("_ay").alias("_y"), "_label")
    named = core.select("_x", "_y", "_label").unionByName(border)
    joined = pts.join(named, ["_x", "_y"], "left")
    # Number clusters by their smallest key.
    order = joined.filter("_label is not null").groupBy("_label").agg(F.min("_id").alias("_first"))
    ids = prefix_counts(order, "_first").select("_first", F.col("_before").alias("_num"))
    order = order.join(ids, "_first").select("_label", "_num")
    return joined.join(order, "_label", "left").select(
        F.col("_id").alias(key), F.coalesce("_num", F.lit(-1)).cast("long").alias(out))


_NEAR_CELLS = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4 and (i, j) > (0, 0)]


def _linked_cells(core: DataFrame, eps: float, side: float, split: int = 8) -> DataFrame:
    """Pairs of cells (ax, ay, bx, by) with core points at most ``eps`` apart, exactly.

    Each round looks at the occupied squares of a finer grid.  Two squares whose farthest corners
    are within ``eps`` settle the pair of cells; two whose nearest corners are not are dropped;
    the rest is refined until no pair is open.  A square holding one distinct point has no extent,
    so that ends once the squares part all distinct points.
    """
    boxes = core.groupBy("_cx", "_cy").agg(*_extent())
    a = boxes.select(*[F.col(c).alias(f"a{c}") for c in boxes.columns],
                     F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                                         for i, j in _NEAR_CELLS])).alias("_o"))
    b = boxes.select(*[F.col(c).alias(f"b{c}") for c in boxes.columns])
    pairs = a.join(b, (F.col("a_cx") + F.col("_o.i") == F.col("b_cx"))
                   & (F.col("a_cy") + F.col("_o.j") == F.col("b_cy"))).drop("_o")
    found, size = None, side
    while True:
        near, far = _gap2(pairs, min_gap=True), _gap2(pairs, min_gap=False)
        pairs = durable(pairs.withColumns({"_near2": near, "_far2": far}).filter(
            F.col("_near2") <= eps * eps))
        sure = pairs.filter(F.col("_far2") <= eps * eps).select("a_cx", "a_cy", "b_cx", "b_cy").distinct()
        found = sure if found is None else found.unionByName(sure)
        open_pairs = pairs.join(sure, ["a_cx", "a_cy", "b_cx", "b_cy"], "left_anti").drop("_near2", "_far2")
        n = open_pairs.count()
        if n == 0:
            return found
        # Few rows make many: sized by bytes, all pairs of the round would be compared in one task.
        tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-n // PAIRS_A_TASK))
        size = size / split
        still = open_pairs.select(F.col("a_cx").alias("_cx"), F.col("a_cy").alias("_cy")).unionByName(
            open_pairs.select(F.col("b_cx").alias("_cx"), F.col("b_cy").alias("_cy"))).distinct()
        fine = durable(core.join(still, ["_cx", "_cy"], "left_semi").groupBy("_cx", "_cy", F.floor(F.col("_x") / size).alias("_sx"),
                                    F.floor(F.col("_y") / size).alias("_sy")).agg(*_extent()))
        # The boxes of one side that are too far from the whole other side need not meet its boxes.
        half = _refine(open_pairs, fine, "a", tasks)
        pairs = _refine(half.filter(_gap2(half, min_gap=True) <= eps * eps), fine, "b", tasks)


def _extent() -> list[Column]:
    return [F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1")]


def _gap2(pairs: DataFrame, min_gap: bool) -> Column:
    """Squared least (or greatest) distance between the bounding boxes of both sides."""
    total = None
    for lo, hi in (("_x0", "_x1"), ("_y0", "_y1")):
        u, v = F.col(f"a{lo}") - F.col(f"b{hi}"), F.col(f"b{lo}") - F.col(f"a{hi}")
        d = F.greatest(u, v, F.lit(0.0)) if min_gap else F.greatest(F.abs(u), F.abs(v))
        total = d * d if total is None else total + d * d
    return total


def _refine(pairs: DataFrame, fine: DataFrame, tag: str, tasks: int) -> DataFrame:
    """Replace one side's boxes by the boxes of the finer grid inside them."""
    ren = fine.select(*[F.col(c).alias(f"n{c}") for c in fine.columns])
    inside = ((F.col(f"{tag}_cx") == F.col("n_cx")) & (F.col(f"{tag}_cy") == F.col("n_cy"))
              & (F.col("n_x0") >= F.col(f"{tag}_x0")) & (F.col("n_x1") <= F.col(f"{tag}_x1"))
              & (F.col("n_y0") >= F.col(f"{tag}_y0")) & (F.col("n_y1") <= F.col(f"{tag}_y1")))
    swap = ("_x0", "_x1", "_y0", "_y1")
    return pairs.repartition(tasks, f"{tag}_cx", f"{tag}_cy").join(ren, inside).select(
        *[c for c in pairs.columns if c not in {f"{tag}{s}" for s in swap}],
        *[F.col(f"n{s}").alias(f"{tag}{s}") for s in swap])


def _components(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Connected components of cells: (_cx, _cy, _label), by repeated minimum over links.

    Each round also follows the label's own label, so chains shrink by halves; every round is
    checkpointed because the plan would double otherwise.
    """
    name = lambda cx, cy: F.struct(F.col(cx).alias("x"), F.col(cy).alias("y"))
    edges = links.select(name("a_cx", "a_cy").alias("u"), name("b_cx", "b_cy").alias("v"))
    edges = durable(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = durable(cells.select(name("_cx", "_cy").alias("u")).withColumn("l", F.col("u")))
    while True:
        seen = edges.join(labels.withColumnsRenamed({"u": "v"}), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = labels.join(seen, "u", "left").select("u", "l", F.least("l", F.coalesce("m", "l")).alias("n"))
        jump = step.select(F.col("u").alias("n"), F.col("n").alias("nn"))
        new = durable(step.join(jump, "n", "left").select("u", "l", F.coalesce("nn", "n").alias("n")))
        if new.filter("n <> l").isEmpty():
            return new.select(F.col("u.x").alias("_cx"), F.col("u.y").alias("_cy"), F.col("n").alias("_label"))
        labels = new.select("u", F.col("n").alias("l"))
