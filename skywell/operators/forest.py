"""Isolation forest: samples and trees by Spark tasks, scoring in Arrow batches."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from skywell.operators.ordering import quantiles, with_row
from skywell.schema import col
from skywell.session import written

SAMPLE = 256
BLOCK = 2048
EULER = 0.5772156649015329


def average_path(m):
    """Mean unsuccessful-search depth of a binary tree over ``m`` points."""
    m = np.asarray(m, dtype=float)
    big = np.maximum(m, 3)
    return np.where(m > 2, 2 * (np.log(big - 1) + EULER) - 2 * (big - 1) / big,
                    np.where(m == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (id, feature, threshold, left, right, path) of one tree; leaves have feature -1."""
    nodes, pending = [], [(0, np.arange(len(x)), 0)]
    free = 1
    while pending:
        node, rows, depth = pending.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or usable.size == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = part[:, f] < cut
        if not goes_left.any() or goes_left.all():
            goes_left = part[:, f] <= low[f]
            cut = float(np.nextafter(low[f], np.inf))
        left, right = free, free + 1
        free += 2
        nodes.append((node, f, cut, left, right, 0.0))
        pending += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


def _samples(df: DataFrame, columns, identity, total: int, trees: int, seed: int, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows per tree by one rule for every size: a hash of (row, tree) against a share.

    A row is copied only for the trees that take it; generated code meets all trees of a row one after the other.
    """
    share = sample * 1.3 / max(total, 1)
    picked = df.select(*[col(c) for c in columns], *[col(c).alias(f"_id{i}") for i, c in enumerate(identity)])
    ids = [F.col(f"_id{i}") for i in range(len(identity))]
    h = lambda salt: F.pmod(F.xxhash64(*ids, salt), F.lit(1 << 30)) / float(1 << 30)
    picked = picked.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).filter(h(F.col("_tree") + seed) < share)
    # A few hundred rows a tree; without the number AQE would grow all trees in one task.
    picked = picked.repartition(max(1, min(trees, df.sparkSession.sparkContext.defaultParallelism)), "_tree")
    order = F.xxhash64(*ids, F.col("_tree"), F.lit(seed + 2))
    first = Window.partitionBy("_tree").orderBy(order, *ids)
    return picked.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= sample)


def grow_forest(df: DataFrame, columns, identity, total: int, trees=100, seed=42, sample=SAMPLE) -> pd.DataFrame:
    """All nodes of all trees; at most ``trees * (2 * sample - 1)`` rows reach the driver.

    ``sample``, the rows per tree, is part of the published algorithm (256 there).
    """
    names = [f"x{i}" for i in range(len(columns))]
    limit = max(1, math.ceil(math.log2(max(2, min(sample, total)))))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        x = pdf.sort_values("_rn")[names].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        out = pd.DataFrame(_grow(x, rng, limit),
                           columns=["node", "feature", "cut", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    rows = _samples(df, columns, identity, total, trees, seed, sample).select(
        "_tree", "_rn", *[col(c).cast("double").alias(n) for c, n in zip(columns, names)]
    )
    return rows.groupBy("_tree").applyInPandas(
        plant, "tree int, node int, feature int, cut double, left int, right int, path double"
    ).toPandas()


def _pack(nodes: pd.DataFrame):
    """Arrays (feature, cut, next, path) of each tree: from node n a row goes to next[2 n] or, not below the cut, to next[2 n + 1].

    A leaf leads to itself, so that all rows take the same number of steps.
    """
    out = []
    for _, t in nodes.groupby("tree"):
        t = t.sort_values("node")
        feature, left, right, own = (t[c].to_numpy(dtype=np.intp) for c in ("feature", "left", "right", "node"))
        leaf = feature < 0
        ahead = np.column_stack([np.where(leaf, own, left), np.where(leaf, own, right)]).ravel()
        depth, level = 0, np.array([0])
        while (level := level[~leaf[level]]).size:
            depth, level = depth + 1, np.concatenate([left[level], right[level]])
        out.append((np.maximum(feature, 0), t["cut"].to_numpy(dtype=float), ahead, t["path"].to_numpy(dtype=float), depth))
    return out


def _path_sums(x: np.ndarray, trees) -> np.ndarray:
    """Summed path lengths of the rows of ``x``, in blocks of rows that stay in a core's cache."""
    n, width = x.shape
    total = np.zeros(n)
    for start in range(0, n, BLOCK):
        block = np.ascontiguousarray(x[start:start + BLOCK])
        flat, base, part = block.ravel(), np.arange(len(block)) * width, total[start:start + BLOCK]
        for feature, cut, ahead, path, depth in trees:
            at = np.zeros(len(block), dtype=np.intp)
            for _ in range(depth):
                at = ahead[2 * at + ~(flat[base + feature[at]] < cut[at])]
            part += path[at]
    return total


def forest_score(nodes: pd.DataFrame, sample: int):
    """Pandas UDF over the feature columns: anomaly score in (0, 1)."""
    trees, norm = _pack(nodes), float(average_path(sample)) or 1.0

    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in series])
        return pd.Series(np.power(2.0, -_path_sums(x, trees) / max(len(trees), 1) / norm))

    return F.pandas_udf(score, "double")


def isolation_forest(
    df: DataFrame, columns: list[str], identity: list[str], contamination: float, trees: int = 100,
    seed: int = 42, score: str = "score", flag: str = "is_outlier", min_rows: int = 2,
) -> DataFrame:
    """Add ``score`` and ``flag``; the flagged share is the top ``contamination`` of the scores.

    ``identity`` names columns that tell rows apart; the samples depend on them and on ``seed``.
    Rows with a null among ``columns`` get a null score and no flag.
    """
    whole = reduce(lambda a, b: a & b, [col(c).isNotNull() for c in columns])
    complete = df.filter(whole)
    total = complete.count()
    if total < min_rows:
        return df.withColumns({score: F.lit(None).cast("double"), flag: F.lit(False)})
    nodes = grow_forest(complete, columns, identity, total, trees, seed)
    scorer = forest_score(nodes, min(SAMPLE, total))
    # The UDF sees 0 in place of null; such rows are blanked again below.
    args = [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in columns]
    # Scored once: the cut and every reader of the result would score the rows again.
    scored = written(df.withColumn(score, F.when(whole, scorer(*args))), "scored", in_order=True)
    cut = quantiles(scored, {"_cut": col(score)}, [1.0 - contamination])
    return with_row(scored, cut).withColumn(
        flag, F.coalesce(col(score) > F.col("_cut__0"), F.lit(False))
    ).drop("_cut__0")
