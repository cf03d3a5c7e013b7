"""Gap filling inside each station, ordered by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skywell.operators.layout import Layout, last_valid, lay_out, next_valid
from skywell.operators.ordering import micros, null_safe_join, quantiles
from skywell.schema import col, complete, numeric_columns


def _neighbours(layout: Layout, name: str, ts: str) -> tuple[Column, Column]:
    here = F.struct(F.col("_pos").alias("pos"), col(name).alias("value"),
                    micros(col(ts)).alias("at"))
    ok = col(name).isNotNull()
    return last_valid(layout, here, ok), next_valid(layout, here, ok)


def fill_gaps(
    df: DataFrame,
    columns: list[str],
    method: str,
    limit: int | Column | None,
    keys=("Station",),
    order=("Timestamp",),
    chunk_rows: int | None = None,
) -> DataFrame:
    """Fill nulls of ``columns``.

    ``ffill`` / ``bfill``: nearest earlier / later value at most ``limit`` rows away.
    ``linear_both``: by row position, filled within ``limit`` rows of either neighbour, ends extended.
    ``linear``: by row position, forward only; trailing rows take the last value.
    ``time``: as ``linear`` with elapsed time as the weight.
    """
    keys, order = list(keys), list(order)
    # Look-ups reach the nearest valid row at any distance, so no fixed halo is needed.
    layout = lay_out(df, keys, order, valid=columns, chunk_rows=chunk_rows)
    prev, nxt = {}, {}
    for i, name in enumerate(columns):
        prev[f"_p{i}"], nxt[f"_q{i}"] = _neighbours(layout, name, order[0])
    rows = layout.rows.withColumns({**prev, **nxt})
    out = {}
    for i, name in enumerate(columns):
        p, q = F.col(f"_p{i}"), F.col(f"_q{i}")
        back, ahead = F.col("_pos") - p["pos"], q["pos"] - F.col("_pos")
        near = (lambda d: F.lit(True)) if limit is None else (lambda d: d <= limit)
        if method == "ffill":
            guess = F.when(near(back), p["value"])
        elif method == "bfill":
            guess = F.when(near(ahead), q["value"])
        else:
            if method == "time":
                share = (micros(col(order[0])) - p["at"]) / (q["at"] - p["at"])
            else:
                share = back / (q["pos"] - p["pos"])
            inner = p["value"] + (q["value"] - p["value"]) * share
            guess = F.when(p.isNotNull() & q.isNotNull(), inner).otherwise(
                F.coalesce(p["value"], q["value"])
            )
            reach = F.coalesce(near(back), F.lit(False))
            if method == "linear_both":
                reach = reach | F.coalesce(near(ahead), F.lit(False))
            guess = F.when(reach & (p.isNotNull() | (F.lit(method == "linear_both"))), guess)
        out[name] = F.coalesce(col(name), guess)
    return layout.finish(rows.withColumns(out).drop(*prev, *nxt))


def fill_statistic(df: DataFrame, columns: list[str], statistic: str = "median", by=()) -> DataFrame:
    """Replace nulls by the median or mean of the column, per group or overall."""
    by = list(by)
    if statistic == "median":
        stats = quantiles(df, {f"_m{i}": col(c) for i, c in enumerate(columns)}, [0.5], by)
        stats = stats.select(*[col(k) for k in by],
                             *[F.col(f"_m{i}__0").alias(f"_m{i}") for i in range(len(columns))])
    elif statistic == "mean":
        stats = df.groupBy(*[col(k) for k in by]).agg(
            *[F.avg(col(c)).alias(f"_m{i}") for i, c in enumerate(columns)]
        )
    else:
        raise ValueError(f"unknown statistic {statistic!r}")
    joined = null_safe_join(df, stats, by, "left")
    return joined.withColumns(
        {c: F.coalesce(col(c), F.col(f"_m{i}")) for i, c in enumerate(columns)}
    ).drop(*[f"_m{i}" for i in range(len(columns))])


def drop_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return complete(df, columns or df.columns)


# Strategy name -> function (df, columns, limit, keys, order); open for further strategies.
FILL_STRATEGIES = {
    "forward_fill": lambda df, c, n, k, o: fill_gaps(df, c, "ffill", n, k, o),
    "backward_fill": lambda df, c, n, k, o: fill_gaps(df, c, "bfill", n, k, o),
    "interpolate": lambda df, c, n, k, o: fill_gaps(df, c, "linear_both", n, k, o),
    "median": lambda df, c, n, k, o: fill_statistic(df, c, "median", k),
    "mean": lambda df, c, n, k, o: fill_statistic(df, c, "mean", k),
    "drop": lambda df, c, n, k, o: drop_null(df, c),
}


def handle_missing(
    df: DataFrame, strategy: str = "interpolate", limit: int = 6, fallback: str | None = "median",
    columns: list[str] | None = None, keys=("Station",), order=("Timestamp",),
) -> DataFrame:
    """Primary strategy per station, then the fallback statistic over the whole column."""
    columns = columns or numeric_columns(df)
    out = FILL_STRATEGIES[strategy](df, columns, limit, list(keys), list(order))
    if fallback in ("median", "mean") and strategy != "drop":
        out = fill_statistic(out, columns, fallback)
    elif fallback == "drop":
        out = drop_null(out, columns)
    return out


def keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; a map-side combining aggregate, safe for hot keys."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*[col(k) for k in by]).agg(
        F.min_by(F.struct(*[col(c) for c in rest]), F.struct(*[col(o) for o in order])).alias("_row")
    )
    return picked.select(*[col(c) if c in by else F.col("_row")[c].alias(c) for c in df.columns])


def modal_step(df: DataFrame, keys=("Station",), order=("Timestamp",), chunk_rows=None) -> DataFrame:
    """Most frequent spacing in seconds per key (smallest on ties)."""
    keys, order = list(keys), list(order)
    layout = lay_out(df, keys, order, before=1, chunk_rows=chunk_rows)
    at = micros(col(order[0]))
    steps = layout.finish(layout.rows.withColumn(
        "_step", (at - F.lag(at).over(layout.window)) / 1e6
    )).filter(F.col("_step").isNotNull())
    counts = steps.groupBy(*[col(k) for k in keys], "_step").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*[col(k) for k in keys]).agg(
        F.min_by("_step", F.struct(-F.col("_n"), F.col("_step"))).alias("step_seconds")
    )


def step_limit(step_seconds: Column, hours: float = 3.0) -> Column:
    """Rows that cover ``hours`` at the modal step; 12 when the step is unknown or not positive."""
    return F.coalesce(F.when(step_seconds > 0, F.floor(F.lit(hours * 3600) / step_seconds)),
                      F.lit(12)).cast("long")
