"""Calendar, cyclic, lag and rolling features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skywell.functions import rules
from skywell.operators.layout import Layout, lay_out
from skywell.operators.ordering import micros
from skywell.schema import col

ROLL_WINDOWS = (3, 6, 12)
LAGS = (1, 2, 3)


def add_calendar(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    t = col(ts)
    month = F.month(t)
    return df.withColumns({
        "Hour": F.hour(t), "Month": month, "Season": rules.season_from_zero(month),
    })


# Column and period of each default cyclic feature.
CYCLES = {"LocalTime": 24.0, "DayOfYear": 365.25, "Month": 12.0}


def add_cyclic(df: DataFrame, cycles: dict[str, float] | None = None) -> DataFrame:
    out = {}
    for name, period in (cycles or CYCLES).items():
        if name in df.columns:
            out[f"{name}_sin"], out[f"{name}_cos"] = rules.cyclic(col(name), period)
    return df.withColumns(out)


def rolling(layout: Layout, c: Column, width: int, statistic: str) -> Column:
    """Trailing mean or sample deviation; null below the minimum number of valid rows."""
    frame = layout.frame(-(width - 1), 0)
    need = max(1 if statistic == "mean" else 2, width // 2)
    value = (F.avg if statistic == "mean" else F.stddev_samp)(c).over(frame)
    return F.when(F.count(c).over(frame) >= need, value)


def gradient(layout: Layout, name: str) -> Column:
    """Central difference over the non-null values only; 0 at nulls and for a lone value."""
    c = col(name)
    prev = F.last(c, True).over(layout.frame(Window.unboundedPreceding, -1))
    nxt = F.last(c, True).over(layout.seen_from_end(last=-1))
    both = (nxt - prev) / 2.0
    return F.when(c.isNull(), 0.0).otherwise(F.coalesce(both, nxt - c, c - prev, F.lit(0.0)))


def series_features(
    df: DataFrame, name: str = "TEC", keys=("Station",), order=("Timestamp",),
    lags=LAGS, windows=ROLL_WINDOWS, chunk_rows: int | None = None,
) -> DataFrame:
    """Difference, gradient, lags and rolling statistics of one column: a single shuffle and sort."""
    reach = max([1, *lags, *[w - 1 for w in windows]])
    layout = lay_out(df, list(keys), list(order), before=reach, valid=[name], chunk_rows=chunk_rows)
    c, w = col(name), layout.window
    out = {
        f"{name}_diff1": c - F.lag(c, 1).over(w),
        f"{name}_gradient": gradient(layout, name),
    }
    out.update({f"{name}_lag{k}": F.lag(c, k).over(w) for k in lags})
    out.update({f"{name}_roll_mean_{n}": rolling(layout, c, n, "mean") for n in windows})
    out.update({f"{name}_roll_std_{n}": rolling(layout, c, n, "std") for n in windows})
    return layout.finish(layout.rows.withColumns(out))


def time_deltas(df: DataFrame, keys=("Station",), order=("Timestamp",), arrival: str | None = None,
                gap_hours: float = 24.0, chunk_rows: int | None = None) -> DataFrame:
    """Seconds since the previous row, a gap flag, and (by ``arrival`` order) a reversal flag."""
    keys, order = list(keys), list(order)
    layout = lay_out(df, keys, [arrival] if arrival else order, before=1, chunk_rows=chunk_rows)
    at = micros(col(order[0]))
    rows = layout.rows.withColumn("delta_s", (at - F.lag(at).over(layout.window)) / 1e6)
    return layout.finish(rows).withColumns({
        "is_gap": F.coalesce(F.col("delta_s") > gap_hours * 3600, F.lit(False)),
        "is_reversal": F.coalesce(F.col("delta_s") < 0, F.lit(False)),
    })


def jumps(df: DataFrame, name: str, keys=("Station",), order=("Timestamp",), absolute: float = 20.0,
          share: float = 0.5, slack: float = 5.0, chunk_rows: int | None = None) -> DataFrame:
    """Step size against a fixed cap (``jump_abs``) and against half the previous value plus slack."""
    layout = lay_out(df, list(keys), list(order), before=1, chunk_rows=chunk_rows)
    prev = F.lag(col(name)).over(layout.window)
    rows = layout.rows.withColumn("_prev", prev).withColumn("step", F.abs(col(name) - F.col("_prev")))
    return layout.finish(rows.withColumns({
        "jump_abs": F.coalesce(F.col("step") > absolute, F.lit(False)),
        "jump_rel": F.coalesce(F.col("step") > F.abs("_prev") * share + slack, F.lit(False)),
    }).drop("_prev"))


def persistence(df: DataFrame, name: str, k: int = 1, out: str = "prediction",
                keys=("Station",), order=("Timestamp",), chunk_rows: int | None = None) -> DataFrame:
    """The value ``k`` rows earlier as a forecast."""
    layout = lay_out(df, list(keys), list(order), before=k, chunk_rows=chunk_rows)
    return layout.finish(layout.rows.withColumn(out, F.lag(col(name), k).over(layout.window)))


def feature_pipeline(df: DataFrame, **options) -> DataFrame:
    """Calendar, cyclic and series features of the observation table."""
    return series_features(add_cyclic(add_calendar(df)), **options)
