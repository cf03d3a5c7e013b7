"""Outlier masks and the actions taken on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skywell.operators.forest import isolation_forest
from skywell.operators.ordering import quantiles, with_row
from skywell.schema import Settings, col, numeric_columns
from skywell.session import durable

MASK = "_mask_{method}_{column}"


def _present(df, columns) -> list[str]:
    have = {c.lower() for c in df.columns}
    return [c for c in columns if c.lower() in have] if columns else numeric_columns(df)


def iqr_mask(df: DataFrame, columns=None, k: float = 2.5, method: str = "iqr") -> DataFrame:
    columns = _present(df, columns)
    stats = quantiles(df, {f"_q{i}": col(c) for i, c in enumerate(columns)}, [0.25, 0.75])
    masks = {}
    for i, c in enumerate(columns):
        q1, q3 = F.col(f"_q{i}__0"), F.col(f"_q{i}__1")
        out = (col(c) < q1 - k * (q3 - q1)) | (col(c) > q3 + k * (q3 - q1))
        masks[MASK.format(method=method, column=c)] = F.coalesce(out, F.lit(False))
    return with_row(df, stats).withColumns(masks).drop(*stats.columns)


def z_mask(df: DataFrame, columns=None, threshold: float = 3.5, method: str = "zscore") -> DataFrame:
    columns = _present(df, columns)
    stats = df.agg(*[f(col(c)).alias(f"_{n}{i}") for i, c in enumerate(columns)
                     for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    masks = {}
    for i, c in enumerate(columns):
        mu, sigma = F.col(f"_m{i}"), F.col(f"_s{i}")
        out = (sigma >= 1e-10) & (F.abs(col(c) - mu) / sigma > threshold)
        masks[MASK.format(method=method, column=c)] = F.coalesce(out, F.lit(False))
    return with_row(df, stats).withColumns(masks).drop(*stats.columns)


def forest_mask(df: DataFrame, columns=None, contamination: float = 0.05, trees: int = 100,
                seed: int = 42, identity=("Station", "Timestamp"),
                method: str = "isolation_forest") -> DataFrame:
    """One joint flag for all columns; rows with a null among them are never flagged."""
    columns = _present(df, columns)
    scored = isolation_forest(df, columns, list(identity), contamination, trees, seed,
                              score="_if_score", flag="_if_flag", min_rows=10)
    return scored.withColumns({
        MASK.format(method=method, column=c): F.col("_if_flag") for c in columns
    }).drop("_if_score", "_if_flag")


# Method name -> function (df, settings, identity); open for further methods.
OUTLIER_METHODS = {
    "iqr": lambda df, s, ident: iqr_mask(df, s.iqr_columns, s.iqr_multiplier),
    "zscore": lambda df, s, ident: z_mask(df, s.z_columns, s.z_threshold),
    "isolation_forest": lambda df, s, ident: forest_mask(
        df, s.forest_columns, s.forest_contamination, s.forest_trees, s.seed, ident),
}


def _mask_columns(df: DataFrame) -> dict[str, list[str]]:
    """column -> names of its per-method masks."""
    out: dict[str, list[str]] = {}
    for method in OUTLIER_METHODS:
        prefix = MASK.format(method=method, column="")
        for name in df.columns:
            if name.startswith(prefix):
                out.setdefault(name[len(prefix):], []).append(name)
    return out


def union_mask(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """OR the methods into one ``_out_<column>`` mask each."""
    masks = _mask_columns(df)
    out = df.withColumns({
        f"_out_{c}": reduce(lambda a, b: a | b, [col(n) for n in names])
        for c, names in masks.items()
    })
    return out, list(masks)


def outlier_counts(df: DataFrame) -> DataFrame:
    """(method, column, flagged, fraction) plus a row for rows flagged by anything."""
    cells, aggs = [], [F.count(F.lit(1)).alias("_rows")]
    any_flag = F.lit(False)
    for column, names in _mask_columns(df).items():
        for name in names:
            method = name[len("_mask_"):-(len(column) + 1)]
            aggs.append(F.count_if(col(name)).alias(name))
            cells.append((method, column, name))
            any_flag = any_flag | col(name)
    aggs.append(F.count_if(any_flag).alias("_any"))
    cells.append(("any", "*", "_any"))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(c).alias("column"), col(n).alias("flagged"),
                 (col(n) / F.greatest(F.col("_rows"), F.lit(1))).alias("fraction"))
        for m, c, n in cells
    ])).alias("r")).select("r.*")


def act_clip(df: DataFrame, columns: list[str]) -> DataFrame:
    """Clip the whole column to [P1, P99] once anything in it is flagged."""
    stats = quantiles(df, {f"_c{i}": col(c) for i, c in enumerate(columns)}, [0.01, 0.99])
    hit = df.agg(*[F.coalesce(F.bool_or(col(f"_out_{c}")), F.lit(False)).alias(f"_h{i}")
                   for i, c in enumerate(columns)])
    out = {}
    for i, c in enumerate(columns):
        lo, hi = F.col(f"_c{i}__0"), F.col(f"_c{i}__1")
        clipped = F.when(col(c).isNotNull(), F.greatest(F.least(col(c), hi), lo))
        out[c] = F.when(F.col(f"_h{i}"), clipped).otherwise(col(c))
    return with_row(with_row(df, stats), hit).withColumns(out).drop(*stats.columns, *hit.columns)


def act_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~col(f"_out_{c}"), col(c)) for c in columns})


def act_drop(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(~reduce(lambda a, b: a | b, [col(f"_out_{c}") for c in columns]))


def act_flag(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_outlier_flag": col(f"_out_{c}").cast("int") for c in columns})


OUTLIER_ACTIONS = {"clip": act_clip, "nan": act_null, "drop": act_drop, "flag": act_flag}


def treat_outliers(df: DataFrame, settings: Settings = Settings(),
                   identity=("Station", "Timestamp")) -> DataFrame:
    """Every configured method, their union, then the configured action."""
    for method in settings.outlier_methods:
        df = OUTLIER_METHODS[method](df, settings, identity)
    df, columns = union_mask(df)
    if "isolation_forest" in settings.outlier_methods:
        # Scoring runs in Python; the action's statistics must not run it again.
        df = durable(df)
    if columns:
        df = OUTLIER_ACTIONS[settings.outlier_action](df, columns)
    return df.drop(*[c for c in df.columns if c.startswith(("_mask_", "_out_"))])
