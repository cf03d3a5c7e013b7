"""Column scalers: fitted parameters are a small table, applying them is a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skywell.operators.ordering import quantiles, with_row
from skywell.schema import col, numeric_columns


def fit_scaler(df: DataFrame, columns: list[str], kind: str = "robust",
               where: Column | None = None) -> DataFrame:
    """(column, center, scale) rows; a zero scale becomes 1.  ``where`` restricts the fitting rows."""
    base = df.filter(where) if where is not None else df
    if kind == "robust":
        q = quantiles(base, {f"c{i}": col(c) for i, c in enumerate(columns)}, [0.25, 0.5, 0.75])
        pairs = [(F.col(f"c{i}__1"), F.col(f"c{i}__2") - F.col(f"c{i}__0"))
                 for i in range(len(columns))]
    elif kind in ("standard", "minmax"):
        one, two = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, F.max)
        q = base.agg(*[f(col(c).cast("double")).alias(f"c{i}__{j}") for i, c in enumerate(columns)
                       for j, f in enumerate((one, two))])
        pairs = [(F.col(f"c{i}__0"),
                  F.col(f"c{i}__1") - (F.col(f"c{i}__0") if kind == "minmax" else 0.0))
                 for i in range(len(columns))]
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    return q.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), center.alias("center"),
                 F.when(scale == 0, 1.0).otherwise(scale).alias("scale"))
        for c, (center, scale) in zip(columns, pairs)
    ])).alias("r")).select("r.*")


def _wide(params: DataFrame, columns: list[str]) -> DataFrame:
    """Parameters as one row: one entry per column, so its size is the number of columns."""
    return params.agg(*[
        F.max(F.when(F.col("column") == c, F.col(part))).alias(f"_{part}{i}")
        for i, c in enumerate(columns) for part in ("center", "scale")
    ])


def _apply(df: DataFrame, params: DataFrame, columns: list[str], formula) -> DataFrame:
    wide = _wide(params, columns)
    out = {c: formula(col(c), F.col(f"_center{i}"), F.col(f"_scale{i}"))
           for i, c in enumerate(columns)}
    return with_row(df, wide).withColumns(out).drop(*wide.columns)


def transform(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    return _apply(df, params, columns, lambda x, c, s: (x - c) / s)


def inverse(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    return _apply(df, params, columns, lambda x, c, s: x * s + c)


def eligible(df: DataFrame, exclude=("Station", "Timestamp", "Season", "QF")) -> list[str]:
    return numeric_columns(df, exclude)


def fit_on_train(df: DataFrame, features: list[str], targets: list[str], kind: str = "robust",
                 split: str = "split") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scale all splits by parameters of the train rows; targets get their own table."""
    train = col(split) == "train"
    f_params = fit_scaler(df, features, kind, train)
    t_params = fit_scaler(df, targets, kind, train)
    return transform(df, f_params, features), f_params, t_params
