"""Order statistics over whole columns, by one plan for every size. NaN counts as missing everywhere.

Ranks: equal values are counted once and stored. The counted values of a group fall into bins between
approximate quantiles of themselves, so a narrow range is spread as evenly as a wide one; bins are accumulated
in a small table, and only the values inside one bin are ordered together. Any edges give exact results.

Quantiles: each wanted rank has a bracket of values, at first the whole group. One aggregate counts the rows
below and inside all brackets and proposes edges within; brackets with more than ``BRACKET_ROWS`` shrink around
their rank and are counted again. What is left inside is ordered. Only bracketed values are ever shuffled.
"""

from __future__ import annotations

from functools import reduce
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from skywell.schema import col
from skywell.session import written

BINS = 256
BRACKET_ROWS, EDGES = 1_000_000, 64
BINS_PER_OCTAVE = 4096
TIME_BIN_MICROS = 3_600_000_000
LAST_BIN = 1 << 40


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery (null when empty)."""
    row = one_row.select(F.struct(*[col(c) for c in one_row.columns]).alias("_row")).scalar()
    return df.withColumn("_row", row).withColumns(
        {c: F.col("_row")[c] for c in one_row.columns}).drop("_row")


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; the right keys are dropped.

    Without keys the right side is a one-row aggregate."""
    if not keys:
        return with_row(left, right)
    renamed = right.select(
        *[col(k).alias(f"__r{i}") for i, k in enumerate(keys)],
        *[col(c) for c in right.columns if c not in keys],
    )
    cond = reduce(
        lambda a, b: a & b,
        [left[f"`{k}`"].eqNullSafe(renamed[f"__r{i}"]) for i, k in enumerate(keys)],
    )
    return left.join(renamed, cond, how).drop(*[f"__r{i}" for i in range(len(keys))])


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def present(c: Column, dtype: T.DataType) -> Column:
    """The value, with NaN as null."""
    return F.when(~F.isnan(c), c) if isinstance(dtype, (T.DoubleType, T.FloatType)) else c


def value_bin(c: Column, dtype: T.DataType) -> Column:
    """Monotone bin number: hours for times, 1/4096 octaves of the magnitude for numbers; NaN comes last."""
    if _is_time(dtype):
        return F.floor(micros(c) / F.lit(TIME_BIN_MICROS)).cast("long")
    x = c.cast("double")
    size = F.floor(F.log2(F.lit(1.0) + F.abs(x) * 1024.0) * BINS_PER_OCTAVE)
    return F.when(F.isnan(x), F.lit(LAST_BIN)).when(x < 0, -size).otherwise(size).cast("long")


def _counted(df: DataFrame, by: list[str], value: str, weight: str | None) -> DataFrame:
    """One row per (group, value) with its count ``_n`` and its bin ``_bin`` within the group."""
    n = F.sum(col(weight)) if weight else F.count(F.lit(1))
    dtype = df.schema[value].dataType
    keys = [col(k) for k in by]
    values = written(df.withColumn(value, present(col(value), dtype)).filter(col(value).isNotNull()).groupBy(
        *keys, col(value)).agg(n.cast("long").alias("_n")), "counted")
    at = micros(col(value)) if _is_time(dtype) else F.expr(f"try_cast(`{value}` AS double)")
    values = values.withColumn("_at", at)
    fractions = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    edges = values.groupBy(*keys).agg(F.percentile_approx("_at", fractions, F.lit(16 * BINS)).alias("_e")).select(
        *keys, F.array_distinct("_e").alias("_edges"))
    # Bisection: how many edges lie below the value.
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(BINS.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(
        F.get("_edges", at + step - 1) < F.col("_at"), step).otherwise(F.lit(0)))
    return null_safe_join(values, edges, by).withColumn("_bin", F.coalesce(below, F.lit(0))).drop("_edges", "_at")


def _bins(values: DataFrame, by: list[str]) -> DataFrame:
    """Rows per bin with the count below the bin and the group total."""
    group = Window.partitionBy(*[col(k) for k in by])
    running = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return (
        values.groupBy(*[col(k) for k in by], "_bin")
        .agg(F.sum("_n").alias("_in_bin"))
        .withColumn("_base", F.coalesce(F.sum("_in_bin").over(running), F.lit(0)))
        .withColumn("_total", F.sum("_in_bin").over(group))
    )


def _within_bins(values: DataFrame, bins: DataFrame, by: list[str], value: str) -> DataFrame:
    inside = (
        Window.partitionBy(*[col(k) for k in by], "_bin")
        .orderBy(col(value)).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = null_safe_join(values, bins, [*by, "_bin"])
    return joined.withColumn(
        "_before", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )


def prefix_counts(df: DataFrame, value: str, by=(), weight: str | None = None) -> DataFrame:
    """One row per (group, value): ``_n`` ties, ``_before`` smaller rows, ``_total`` group rows."""
    by = list(by)
    values = _counted(df, by, value, weight)
    out = _within_bins(values, _bins(values, by), by, value)
    return out.select(*[col(k) for k in by], col(value), "_n", "_before", "_total")


def average_rank() -> Column:
    """Rank (from 1) shared by ties, for the output of :func:`prefix_counts`."""
    return F.col("_before") + (F.col("_n") + F.lit(1)) / F.lit(2.0)


def with_average_rank(df: DataFrame, value: str, out: str, by=()) -> DataFrame:
    """Add the average-tie rank of ``value`` inside each group; null and NaN have none."""
    by = list(by)
    ranks = prefix_counts(df, value, by).select(
        *[col(k) for k in by], col(value), average_rank().alias(out)
    )
    return null_safe_join(df, ranks, [*by, value], "left")


def _pick(k: Column) -> Column:
    return (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))


def _rank(p: Column, total: Column, up: bool) -> Column:
    k = p * (total - 1)
    return (F.ceil(k) if up else F.floor(k)).cast("long")


def _met(cells: DataFrame, brackets: DataFrame, n_columns: int, by: list[str]) -> DataFrame:
    """Each row with each bracket ``_k`` of its group, and the value ``_x`` of the bracket's column.

    Generated code goes through the brackets of a row; a filter over their array, or an expression for each, is slower.
    """
    keys = [col(k) for k in by]
    values = F.array(*[F.col(f"_v{i}") for i in range(n_columns)])
    met = null_safe_join(cells, brackets, by).select(*keys, values.alias("_v"), F.explode("_b").alias("_k"))
    return met.withColumn("_x", F.get("_v", F.col("_k.c")))


def _brackets(cells: DataFrame, n_columns: int, probs: list[float], by: list[str]) -> DataFrame:
    """One row per group with an array ``_b`` of distinct brackets (c, lo, hi, below, total), every wanted rank in one."""
    keys, slot = [col(k) for k in by], ["c", "j"]
    grid = F.array(*[F.lit(i / EDGES) for i in range(EDGES + 1)])
    edges_of = lambda v: F.percentile_approx(v, grid, F.lit(20 * EDGES))
    first = written(cells.groupBy(*keys).agg(*[F.struct(
        F.lit(i).alias("c"), F.count(f"_v{i}").alias("total"), edges_of(F.col(f"_v{i}")).alias("edges")).alias(f"_c{i}")
        for i in range(n_columns)]), "brackets")
    # One row per bracket. The first bracket is the whole group for all ranks of a column.
    ranks = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(probs)])
    state = first.select(*keys, F.explode(F.array(*[F.col(f"_c{i}") for i in range(n_columns)])).alias("_c")).select(
        *keys, "_c.*", F.explode(ranks).alias("_r")).select(
        *keys, "c", "_r.j", "_r.p", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
        F.lit(0).cast("long").alias("below"), F.col("total").alias("inside"), F.lit(2 ** 62).alias("was"), "total", "edges")
    # A bracket that no longer shrinks lies between a few heavy values, which count as one row each below.
    open_ = (F.col("inside") > BRACKET_ROWS) & (F.col("inside") < F.col("was"))
    bracket = lambda *more: F.struct("c", *more, "lo", "hi")
    held = F.col("_x").between(F.col("_k.lo"), F.col("_k.hi"))
    while not (going := state.filter(open_)).isEmpty():
        meet = lambda b: _met(cells, b.groupBy(*keys).agg(F.collect_list(bracket("j")).alias("_b")), n_columns, by).groupBy(
            *keys, F.col("_k.c").alias("c"), F.col("_k.j").alias("j"))
        if "edges" not in state.columns:
            going = null_safe_join(going, meet(going).agg(edges_of(F.when(held, F.col("_x"))).alias("edges")), [*by, *slot])
        at = lambda up: (_rank(F.col("p"), F.col("total"), up) - F.col("below")) * F.lit(float(EDGES)) / F.col("inside")
        edge = lambda k: F.get("edges", F.greatest(F.lit(0), F.least(F.lit(EDGES), k)).cast("int"))
        narrowed = written(going.select(
            *keys, *slot, "p", F.greatest("lo", edge(F.floor(at(False)) - 1)).alias("lo"),
            F.least("hi", edge(F.ceil(at(True)) + 1)).alias("hi"), F.col("inside").alias("was"), "total"), "brackets")
        counts = meet(narrowed).agg(F.count_if(F.col("_x") < F.col("_k.lo")).alias("below"), F.count_if(held).alias("inside"))
        settled = state.filter(~open_).drop("edges")
        state = written(settled.unionByName(null_safe_join(narrowed, counts, [*by, *slot])), "brackets")
    return state.groupBy(*keys).agg(F.collect_set(bracket("below", "total")).alias("_b"))


def quantiles(df: DataFrame, columns: dict[str, Column], probs, by=()) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group; nulls for a group without values.

    Output columns are ``<name>__<i>`` for the i-th probability.
    """
    by, names, probs = list(by), list(columns), list(probs)
    keys = [col(k) for k in by]
    double = T.DoubleType()
    cells = written(df.select(*keys, *[present(columns[n].cast("double"), double).alias(f"_v{i}") for i, n in enumerate(names)]), "cells")
    held = _met(cells, _brackets(cells, len(names), probs, by), len(names), by).filter(
        F.col("_x").between(F.col("_k.lo"), F.col("_k.hi")))
    counted = held.groupBy(*keys, "_k", "_x").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*keys, "_k").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.col("_k.below") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    wanted = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(probs)]))
    lo, hi = (_pick(_rank(F.col("_w.p"), F.col("_k.total"), up)) for up in (False, True))
    ends = placed.withColumn("_w", wanted).filter(lo | hi).groupBy(*keys, "_k.c", "_w", "_k.total").agg(
        F.max(F.when(lo, F.col("_x"))).alias("_lo"), F.max(F.when(hi, F.col("_x"))).alias("_hi"))
    k = F.col("_w.p") * (F.col("total") - 1)
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (k - F.floor(k))
    found = ends.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("c") * len(probs) + F.col("_w.j"), value))).alias("_at"))
    found = found.select(*keys, *[F.try_element_at("_at", F.lit(i * len(probs) + j)).alias(f"{name}__{j}")
                                  for i, name in enumerate(names) for j in range(len(probs))])
    return null_safe_join(cells.select(*keys).distinct(), found, by, "left") if by else found


def rows_at_rank(df: DataFrame, order: list[str], ranks: dict[str, Column]) -> DataFrame:
    """One row of ordering keys for each wanted zero-based position of the whole frame.

    ``ranks`` maps a prefix to a position given as a Column over ``_total`` (the row count).
    Output: ``<prefix>_<i>`` for the i-th ordering column, all null when the position is outside.
    The first column is located by prefix counts, then only its ties go on to the next column.
    """
    prefixes = list(ranks)
    level = df.select(*[col(c) for c in order])
    cells = None
    for depth, name in enumerate(order):
        counts = prefix_counts(level, name, [] if depth == 0 else ["_slot"])
        if depth == 0:
            slots = F.array(*[
                F.struct(F.lit(i).alias("s"), ranks[p].cast("long").alias("k"))
                for i, p in enumerate(prefixes)
            ])
            hit = counts.withColumn("_t", F.explode(slots)).filter(_pick(F.col("_t.k"))).select(
                F.col("_t.s").alias("_slot"), (F.col("_t.k") - F.col("_before")).alias("_k"),
                col(name).alias(f"_o{depth}"),
            )
        else:
            hit = counts.join(F.broadcast(cells), "_slot").filter(_pick(F.col("_k"))).select(
                "_slot", *[f"_o{i}" for i in range(depth)],
                (F.col("_k") - F.col("_before")).alias("_k"), col(name).alias(f"_o{depth}"),
            )
        cells = hit
        if depth + 1 < len(order):
            level = level.join(
                F.broadcast(cells.select("_slot", F.col(f"_o{depth}").alias("_at"))),
                col(name) == F.col("_at"),
            ).drop("_at") if depth == 0 else level.join(
                F.broadcast(cells.select(F.col("_slot").alias("_s2"), F.col(f"_o{depth}").alias("_at"))),
                (col(name) == F.col("_at")) & (F.col("_slot") == F.col("_s2")),
            ).drop("_at", "_s2")
    return cells.agg(*[
        F.max(F.when(F.col("_slot") == i, F.col(f"_o{d}"))).alias(f"{p}_{d}")
        for i, p in enumerate(prefixes) for d in range(len(order))
    ])


def comes_before(order: list[str], boundary: list[Column]) -> Column:
    """Lexicographic ``order < boundary``; a null boundary lies after every row."""
    less = F.lit(False)
    for name, bound in reversed(list(zip(order, boundary))):
        less = (col(name) < bound) | ((col(name) == bound) & less)
    return boundary[0].isNull() | less
