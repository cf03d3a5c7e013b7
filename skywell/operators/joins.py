"""Joins of observations with index tables, dimensions, predictions and memory banks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from skywell.operators.layout import last_valid, lay_out, next_valid
from skywell.operators.ordering import micros, with_row
from skywell.schema import SPACE_WEATHER, col

SMALL_ROWS = 2_000_000
ASOF_CHUNK_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint after counting; a larger side is left to Spark's shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hourly(obs: DataFrame, indices: DataFrame | None, ts: str = "Timestamp",
                columns=SPACE_WEATHER) -> DataFrame:
    """Attach the row of the index table for the observation's hour; nulls where there is none."""
    if indices is None:
        return obs.withColumns({c: F.lit(None).cast("double") for c in columns})
    right = indices.withColumnRenamed(ts, "_hour")
    keyed = obs.withColumn("_hour", F.date_trunc("hour", col(ts).cast("timestamp")))
    right = right.withColumn("_hour", F.col("_hour").cast("timestamp"))
    return keyed.join(broadcast_if_small(right), "_hour", "left").drop("_hour")


def asof_nearest(
    left: DataFrame, right: DataFrame, on: str = "Timestamp", tolerance_s: float | None = 900.0,
    keys=(), suffix: str = "", chunk_rows: int | None = None,
) -> DataFrame:
    """Nearest right row in time for each left row; the earlier one wins a tie.

    Right rows of one key and time are first reduced to the least of them by their columns in order,
    with a map-side combine. All left rows of one key and time have the same answer, so only the distinct ones,
    without other columns, are merged with the right side in time order, where each looks at its two neighbours;
    the answers then go back to the left rows by an equi-join. Null keys match nothing.
    """
    keys = list(keys)
    extra = [c for c in right.columns if c != on and c not in keys]
    payload = F.struct(micros(col(on)).alias("_at"), *[col(c).alias(f"{c}{suffix}") for c in extra])
    for c in (on, *keys):
        right = right.filter(col(c).isNotNull())
    l = left.select(*[col(k) for k in keys], col(on))
    for c in (on, *keys):
        l = l.filter(col(c).isNotNull())
    l = l.distinct().withColumn("_side", F.lit(1))
    r = right.groupBy(*[col(k) for k in keys], col(on)).agg(F.min(payload).alias("_r")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    # Right rows sort first among equal times, so an exact match is always the earlier neighbour.
    layout = lay_out(both, keys, [on, "_side"], valid=["_r"], chunk_rows=chunk_rows or ASOF_CHUNK_ROWS)
    is_right = F.col("_side") == 0
    rows = layout.rows.withColumns({
        "_p": last_valid(layout, F.col("_r"), is_right), "_q": next_valid(layout, F.col("_r"), is_right),
    })
    rows = layout.finish(rows).filter("_side = 1")
    at = micros(col(on))
    back, ahead = at - F.col("_p")["_at"], F.col("_q")["_at"] - at
    hit = F.when(back.isNull() | (ahead < back), F.col("_q")).otherwise(F.col("_p"))
    rows = rows.withColumn("_hit", hit)
    if tolerance_s is not None:
        tol = int(tolerance_s * 1_000_000)
        rows = rows.filter(F.abs(F.col("_hit")["_at"] - at) <= tol)
    hits = rows.select(*[col(k) for k in keys], col(on), "_hit")
    return left.join(hits, [*keys, on], "left").select(
        *[col(c) for c in left.columns], *[F.col("_hit")[f"{c}{suffix}"].alias(f"{c}{suffix}") for c in extra],
    )


def merge_stats(joined: DataFrame, marker: str) -> DataFrame:
    """Matched / unmatched rows and match percentage, by a column that is null when unmatched."""
    return joined.agg(
        F.count(F.lit(1)).alias("total"), F.count(col(marker)).alias("matched"),
    ).select(
        "total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"),
        F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("total")), F.lit(0.0)).alias("match_pct"),
    )


def outer_in_time(a: DataFrame, b: DataFrame, on: str = "Timestamp", keys=()) -> DataFrame:
    return a.join(b, [*keys, on], "full")


def attach_dimension(df: DataFrame, dimension: DataFrame, key: str = "Station") -> DataFrame:
    """Left join of static attributes; the dimension is broadcast when its counted size allows."""
    return df.join(broadcast_if_small(dimension), key, "left")


def unmatched_keys(df: DataFrame, dimension: DataFrame, key: str = "Station") -> DataFrame:
    """Keys with no dimension row, with their row counts."""
    per = df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("n_rows"))
    return per.join(dimension.select(key), key, "left_anti")


def align(targets: DataFrame, predictions: DataFrame, index: str = "idx") -> DataFrame:
    """Every target row with each model's prediction; shorter models are padded with null.

    ``targets`` (idx, y_true), ``predictions`` (model, idx, y_pred).  Extra predictions are cut off.
    The list of models is attached as an array, so no per-pair join is needed.
    """
    models = predictions.agg(F.array_sort(F.collect_set("model")).alias("_models"))
    grid = with_row(targets, models).withColumn("model", F.explode("_models")).drop("_models")
    return grid.join(predictions, ["model", index], "left")


def length_guard(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """(model, n_pred, n_target, same_length)."""
    n = targets.agg(F.count(F.lit(1)).alias("n_target"))
    per_model = predictions.groupBy("model").agg(F.count(F.lit(1)).alias("n_pred"))
    return with_row(per_model, n).withColumn("same_length", F.col("n_pred") == F.col("n_target"))


def spread_label(windows: DataFrame, label: str, steps: str, out: str = "label_seq") -> DataFrame:
    """The window's one value repeated over all its steps."""
    return windows.withColumn(out, F.array_repeat(col(label), F.size(col(steps))))


def memory_pool(banks: dict[str, DataFrame]) -> DataFrame:
    """Union of named banks with a ``bank`` tag."""
    frames = [df.withColumn("bank", F.lit(name)) for name, df in banks.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


BLOCK_ROWS = 4096


def topk_candidates(queries: DataFrame, memory: DataFrame, k: int = 8,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best memory rows per query by q.k / sqrt(d), ties at the k-th score kept.

    ``queries`` (qid, q), ``memory`` (mid, v), both bigint ids with array vectors.  Both sides are
    cut into blocks of bounded size; one task multiplies one pair of blocks and returns only the
    best k of it, and the per-block winners are ranked again per query.
    """
    n_q, n_m = queries.count(), memory.count()
    q_blocks, m_blocks = max(1, math.ceil(n_q / block_rows)), max(1, math.ceil(n_m / block_rows))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.withColumn("_qb", block("qid", q_blocks)).withColumn(
        "_mb", F.explode(F.sequence(F.lit(0), F.lit(m_blocks - 1))))
    m = memory.withColumn("_mb", block("mid", m_blocks)).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def best(qs: pd.DataFrame, ms: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": pd.Series(dtype="int64"), "mid": pd.Series(dtype="int64"),
                              "score": pd.Series(dtype="float64")})
        if qs.empty or ms.empty:
            return empty
        a = np.stack(qs["q"].to_numpy()).astype(float)
        b = np.stack(ms["v"].to_numpy()).astype(float)
        s = a @ b.T / math.sqrt(a.shape[1])
        keep = min(k, s.shape[1])
        cut = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
        i, j = np.nonzero(s >= cut[:, None])
        return pd.DataFrame({"qid": qs["qid"].to_numpy()[i], "mid": ms["mid"].to_numpy()[j],
                             "score": s[i, j]})

    found = q.groupBy("_qb", "_mb").cogroup(m.groupBy("_qb", "_mb")).applyInPandas(
        best, "qid long, mid long, score double"
    )
    top = Window.partitionBy("qid").orderBy(F.col("score").desc())
    return found.withColumn("rank", F.rank().over(top)).filter(F.col("rank") <= k)


def topk_retrieve(queries: DataFrame, memory: DataFrame, k: int = 8, **options) -> DataFrame:
    """Softmax weights over the kept scores and the weighted sum of the memory vectors per query."""
    hits = topk_candidates(queries, memory, k, **options)
    per = Window.partitionBy("qid")
    e = F.exp(F.col("score") - F.max("score").over(per))
    weighted = hits.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(per))
    parts = weighted.join(memory, "mid").select(
        "qid", "weight", F.transform("v", lambda x: x * F.col("weight")).alias("_wv"))
    return parts.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_kept"), F.max("weight").alias("top_weight"),
        F.collect_list("_wv").alias("_all"),
    ).withColumn("value", F.aggregate(
        F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), F.element_at("_all", 1),
        lambda a, b: F.zip_with(a, b, lambda x, y: x + y),
    )).drop("_all")
