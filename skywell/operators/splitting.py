"""Train / validation / test assignment without numbering every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from skywell.operators.ordering import comes_before, micros, present, rows_at_rank, with_row
from skywell.schema import col


def _nulls_last(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    """Helper columns that order like ``order`` and hold the greatest value of their type where it is missing."""
    made: dict[str, Column] = {}
    for i, name in enumerate(order):
        dtype = df.schema[name].dataType
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c, most = micros(col(name)), F.lit(2 ** 63 - 1)
        elif isinstance(dtype, T.IntegralType):
            c, most = col(name).cast("long"), F.lit(2 ** 63 - 1)
        elif isinstance(dtype, T.StringType):
            c, most = col(name), F.lit(chr(0x10FFFF) * 4)
        else:
            c, most = present(col(name).cast("double"), T.DoubleType()), F.lit(float("inf"))
        made[f"_key{i}"] = F.coalesce(c, most)
    return df.withColumns(made), list(made)


def split_ordered(df: DataFrame, order: list[str], train: float = 0.70, val: float = 0.15,
                  truncate_sum: bool = False, out: str = "split") -> DataFrame:
    """First ``int(n * train)`` rows by ``order`` are train, the next ``int(n * val)`` val.

    Only the two boundary rows are located; each row is then compared with them.  ``order`` must
    end in a column that makes it unique; rows with a missing key come last and are counted.
    ``truncate_sum`` ends val at ``int(n * (train + val))``.
    """
    n = F.col("_total")
    end_train = F.floor(n * F.lit(train))
    end_val = F.floor(n * F.lit(train + val)) if truncate_sum else end_train + F.floor(n * F.lit(val))
    keyed, keys = _nulls_last(df, order)
    cuts = rows_at_rank(keyed, keys, {"_a": end_train, "_b": end_val})
    bound = lambda p: [F.col(f"{p}_{i}") for i in range(len(keys))]
    return with_row(keyed, cuts).withColumn(
        out,
        F.when(comes_before(keys, bound("_a")), "train")
        .when(comes_before(keys, bound("_b")), "val").otherwise("test"),
    ).drop(*cuts.columns, *keys)


def split_random(df: DataFrame, identity: list[str], seed: int = 42, train=0.70, val=0.15,
                 faithful: bool = False, ts: str = "Timestamp", out="split") -> DataFrame:
    """Exact fractions in hash order; ``faithful`` keeps time order, as the original splitter does."""
    if faithful:
        return split_ordered(df, [ts, *identity], train, val, out=out)
    hashed = df.withColumn("_h", F.xxhash64(*[col(c) for c in identity], F.lit(seed)))
    return split_ordered(hashed, ["_h", *identity], train, val, out=out).drop("_h")


def split_station(df: DataFrame, key: str = "Station", seed: int = 42, train=70, val=15,
                  out="split") -> DataFrame:
    """Whole stations per split, by hash bucket."""
    bucket = F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(100))
    return df.withColumn(
        out, F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("test")
    )


# Strategy name -> function (df, order, key, seed, fractions); open for further strategies.
SPLIT_STRATEGIES = {
    "temporal": lambda df, order, key, seed, f: split_ordered(df, order, *f),
    "random": lambda df, order, key, seed, f: split_random(df, order, seed, *f),
    "station": lambda df, order, key, seed, f: split_station(
        df, key, seed, round(f[0] * 100), round(f[1] * 100)),
}


def leave_one_out(df: DataFrame, fold: str, key: str = "Station") -> DataFrame:
    """Role of each row when station ``fold`` is held out.

    A fold is a filter on the table, so folds are enumerated lazily instead of copying all rows
    once per station.
    """
    return df.withColumn("fold", F.lit(fold)).withColumn(
        "role", F.when(col(key) == F.lit(fold), "test").otherwise("train")
    )


def fold_sizes(df: DataFrame, key: str = "Station") -> DataFrame:
    """(fold, test rows, train rows) of every leave-one-out fold from one count per station."""
    per = df.groupBy(col(key).alias("fold")).agg(F.count(F.lit(1)).alias("n_test"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return with_row(per, total).select(
        "fold", "n_test", (F.col("_n") - F.col("n_test")).alias("n_train")
    )
