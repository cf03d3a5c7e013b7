"""Sliding windows of consecutive rows per station."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from skywell.functions.rules import finite
from skywell.operators.layout import lay_out
from skywell.schema import Settings, col, complete


def _cells(features) -> list:
    return [finite(col(f)) for f in features]


def _checked(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the frame: {missing}")


def sequences(
    df: DataFrame, features: list[str], target: str | None, width: int, stride: int = 1,
    min_completeness: float = 0.80, keys=("Station",), order=("Timestamp",), mode: str = "reference",
    horizon: int = 0, arrays: bool = True, chunk_rows: int | None = None,
) -> DataFrame:
    """One row per window: keys, ``start``, ``start_ts``, ``end_ts``, ``completeness``, ``x``, ``y``.

    ``mode`` "reference" needs one row after the window (the final full window is left out);
    "full" keeps every full window.  The label is the target ``horizon`` rows after the last step.
    With ``arrays=False`` only the descriptors are computed.
    """
    keys, order = list(keys), list(order)
    _checked(df, [*features, *([target] if target else [])])
    need = width + horizon if mode == "full" else max(width + 1, width + horizon)
    layout = lay_out(df, keys, order, after=need, chunk_rows=chunk_rows)
    w, span = layout.window, layout.frame(0, width - 1)
    good = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in _cells(features)])
    out = {
        "start": F.col("_pos"),
        "start_ts": col(order[0]),
        "end_ts": F.lead(col(order[0]), width - 1).over(w),
        "completeness": F.sum(good).over(span) / F.lit(width * len(features)),
        "_exists": F.lead(F.lit(True), need - 1).over(w),
    }
    if target:
        out["y"] = F.lead(finite(col(target)), width - 1 + horizon).over(w)
    if arrays:
        step = F.array(*[F.coalesce(c, F.lit(0.0)) for c in _cells(features)])
        out["x"] = F.collect_list(step).over(span)
    rows = layout.finish(layout.rows.withColumns(out))
    keep = F.col("_exists").isNotNull() & (F.col("start") % stride == 0)
    keep = keep & (F.col("completeness") >= min_completeness)
    if target:
        keep = keep & F.col("y").isNotNull()
    return rows.filter(keep).select(
        *[col(k) for k in keys], "start", "start_ts", "end_ts", "completeness",
        *(["x"] if arrays else []), *(["y"] if target else []),
    )


def windows_only(df: DataFrame, features, width: int, **options) -> DataFrame:
    """Every full window, no label and no completeness rule."""
    return sequences(df, features, None, width, min_completeness=0.0, mode="full", **options)


def too_short(df: DataFrame, width: int, keys=("Station",)) -> DataFrame:
    """Stations with fewer rows than one window."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows")).filter(
        F.col("n_rows") < width
    )


def sequences_ahead(df: DataFrame, features, target: str, width: int = 96, horizon: int = 1,
                    **options) -> DataFrame:
    """Rows with a null feature or target are dropped first; the label lies ``horizon`` rows ahead."""
    clean = complete(df, list(dict.fromkeys([*features, target])))
    return sequences(clean, features, target, width, min_completeness=0.0, mode="full",
                     horizon=horizon, **options)


def window_plan(df: DataFrame, features, target: str, hours=Settings().window_hours,
                settings: Settings = Settings(), keys=("Station",), order=("Timestamp",),
                chunk_rows: int | None = None) -> DataFrame:
    """Descriptors of several window sizes from one shuffle and one sort.

    A row of every size that is valid at a start position: keys, start, window_h, start_ts, end_ts,
    completeness, y.  Arrays are built per size by :func:`sequences` at the sink.
    """
    keys, order = list(keys), list(order)
    steps = {h: settings.steps(h) for h in hours}
    layout = lay_out(df, keys, order, after=max(steps.values()) + 1, chunk_rows=chunk_rows)
    w = layout.window
    good = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in _cells(features)])
    # A prefix sum makes each size's completeness a difference of two values.
    rows = layout.rows.withColumn("_good", good).withColumn(
        "_cum", F.sum("_good").over(layout.frame(Window.unboundedPreceding, 0))
    )
    cells = [
        F.struct(
            F.lit(h).alias("window_h"),
            F.lead(col(order[0]), n - 1).over(w).alias("end_ts"),
            ((F.lead("_cum", n - 1).over(w) - F.col("_cum") + F.col("_good"))
             / F.lit(n * len(features))).alias("completeness"),
            F.lead(finite(col(target)), n - 1).over(w).alias("y"),
            F.lead(F.lit(True), n).over(w).alias("more"),
        ) for h, n in steps.items()
    ]
    rows = rows.withColumn("_sizes", F.array(*cells)).withColumn("start", F.col("_pos"))
    out = layout.finish(rows, None).select(
        *[col(k) for k in keys], "start", col(order[0]).alias("start_ts"),
        F.explode("_sizes").alias("_s"),
    ).select(*[col(k) for k in keys], "start", "start_ts", "_s.*")
    return out.filter(
        F.col("more").isNotNull() & (F.col("completeness") >= settings.min_completeness)
        & F.col("y").isNotNull() & (F.col("start") % settings.stride == 0)
    ).drop("more")


def batch_record(seq: DataFrame, features: list[str], groups: dict[str, list[str]],
                 temporal: str = "temporal_seq") -> DataFrame:
    """Split ``x`` into column groups: the whole sequence for ``temporal``, the last step for others."""
    place = {f: i for i, f in enumerate(features)}
    out = {}
    for name, members in groups.items():
        idx = [place[m] for m in members]
        if name == temporal:
            out[name] = F.transform("x", lambda step: F.array(*[step[i] for i in idx]))
        else:
            last = F.element_at("x", -1)
            out[name] = F.array(*[last[i] for i in idx])
    return seq.withColumns(out).drop("x")
