"""Windows over long keyed series whose keys may be very uneven.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  That is the plan used while a
counting pass shows every key to be of bounded size; its keys are dealt over as many tasks as the
counted rows need, so that a task does not grow with the table.  Keys above the bound are cut into chunks of
consecutive rows: rows are counted per narrow bucket of the ordering column, buckets are packed
into chunks, and each chunk also receives the neighbour rows its windows look at (a fixed number
before and after, plus the nearest bucket that holds a valid value of the named columns).  Window
expressions are the same in both plans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from skywell.operators.ordering import micros, value_bin, with_row
from skywell.schema import col
from skywell.session import durable

CHUNK_ROWS = 500_000
ROWS_A_TASK = 250_000
BUCKETS_PER_CHUNK = 32
BUCKET_SPLIT = 256
BROADCAST_ROWS = 1_000_000
NO_TICK = 1 << 62
_HELPERS = ("_chunk", "_run", "_base", "_own", "_pos")


@dataclass
class Layout:
    """Rows ready for windowing: ``rows`` carries ``_pos`` (position in the key, from 0)."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    chunked: bool
    helpers: list[str] = field(default_factory=list)

    @property
    def window(self) -> WindowSpec:
        return _spec(self.keys, self.order, self.chunked)

    def seen_from_end(self, last: int = 0) -> WindowSpec:
        """From the last row of the key down to the current one (-1: the one after it).

        A frame from the current row to the end would be aggregated anew for every row.
        """
        return _spec(self.keys, self.order, self.chunked, falling=True).rowsBetween(
            Window.unboundedPreceding, last
        )

    def frame(self, first: int, last: int) -> WindowSpec:
        return self.window.rowsBetween(first, last)

    def finish(self, df: DataFrame, keep_position: str | None = None) -> DataFrame:
        """Drop borrowed rows and helper columns."""
        if self.chunked:
            df = df.filter("_own")
        if keep_position:
            df = df.withColumn(keep_position, F.col("_pos"))
        return df.drop(*_HELPERS, *self.helpers)


def _spec(keys, order, chunked, falling=False) -> WindowSpec:
    part = [col(k) for k in keys] + ([F.col("_chunk")] if chunked else [])
    sort = ([F.col("_run")] if chunked else []) + [col(o) for o in order]
    sort = [c.desc_nulls_first() if falling else c.asc_nulls_last() for c in sort]
    return Window.partitionBy(*part).orderBy(*sort)


def _is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def lay_out(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    before: int = 0,
    after: int = 0,
    valid: list[str] | None = None,
    chunk_rows: int | None = None,
) -> Layout:
    """Prepare ``df`` for windows that look at most ``before``/``after`` rows away, or at the
    nearest non-null value of a column in ``valid`` at any distance."""
    size = chunk_rows or CHUNK_ROWS
    by_time = _is_time(df, order[0])
    tick = micros(col(order[0])) if by_time else value_bin(col(order[0]), df.schema[order[0]].dataType)
    counts = df.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("_lay_rows"), F.min(tick).alias("_lay_lo"), F.max(tick).alias("_lay_hi")
    )
    total, largest = counts.agg(F.sum("_lay_rows"), F.max("_lay_rows")).first()
    if (largest or 0) <= size:
        if keys and (total or 0) > ROWS_A_TASK:
            tasks = max(math.ceil(total / ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism)
            df = df.repartition(tasks, *[col(k) for k in keys])
        rows = df.withColumn("_pos", (F.row_number().over(_spec(keys, order, False)) - 1).cast("long"))
        return Layout(rows, list(keys), list(order), False)
    hot = durable(counts.filter(F.col("_lay_rows") > size))
    return _chunked(df, list(keys), list(order), tick, hot, before, after, list(valid or []), size)


def _chunked(df, keys, order, tick, hot, before, after, valid, size) -> Layout:
    parts = F.ceil(F.col("_lay_rows") / F.lit(size)) * BUCKETS_PER_CHUNK
    width = F.greatest(F.lit(1), F.ceil((F.col("_lay_hi") - F.col("_lay_lo") + 1) / parts)).cast("long")
    hot = hot.select(*[col(k) for k in keys], "_lay_lo", width.alias("_lay_width"))
    hot = _small(hot) if keys else hot
    keyed = [col(k) for k in keys]
    # A bucket is named by its first tick; rows without one go last.
    step = lambda at, w: (at + F.floor((tick - at) / w) * w).cast("long")
    levels: list[DataFrame] = []

    def tagged(how):
        joined = df.join(hot, keys, how) if keys else with_row(df, hot)
        named = F.when(tick.isNull(), F.lit(NO_TICK)).otherwise(step(F.col("_lay_lo"), F.col("_lay_width")))
        joined = joined.withColumn("_lay_bucket", F.when(F.col("_lay_width").isNotNull(), named)).drop("_lay_lo")
        for finer in levels:
            joined = joined.join(_small(finer), [*keys, "_lay_bucket"], "left").withColumns({
                "_lay_bucket": F.when(F.col("_lay_fine").isNull(), F.col("_lay_bucket")).otherwise(
                    step(F.col("_lay_bucket"), F.col("_lay_fine"))),
                "_lay_width": F.coalesce("_lay_fine", "_lay_width"),
            }).drop("_lay_fine")
        return joined

    while True:
        stats = durable(tagged("inner").groupBy(*keyed, "_lay_bucket").agg(
            F.count(F.lit(1)).alias("_lay_n"), F.max("_lay_width").alias("_lay_width"),
            *[F.count(col(v)).alias(f"_valid{i}") for i, v in enumerate(valid)],
        ))
        # A burst can fill one bucket: split such buckets further, down to single ticks.
        heavy = stats.filter((F.col("_lay_n") > size) & (F.col("_lay_width") > 1)
                             & (F.col("_lay_bucket") < NO_TICK))
        if heavy.isEmpty():
            break
        levels.append(durable(heavy.select(
            *keyed, "_lay_bucket", F.ceil(F.col("_lay_width") / F.lit(BUCKET_SPLIT)).cast("long").alias("_lay_fine"))))
    plan = durable(_placement(stats.drop("_lay_width"), keys, before, after, len(valid), size))
    rows = tagged("left").join(_small(plan), [*keys, "_lay_bucket"], "left").select(
        *[col(c) for c in df.columns],
        F.coalesce("_lay_target", F.lit(0)).alias("_chunk"),
        F.coalesce("_lay_bucket", F.lit(0)).alias("_run"),
        F.coalesce("_lay_start", F.lit(0)).alias("_base"),
        F.coalesce("_lay_mine", F.lit(True)).alias("_own"),
    ).repartition(*keyed, F.col("_chunk"))
    in_run = Window.partitionBy(*keyed, "_chunk", "_run").orderBy(
        *[col(o).asc_nulls_last() for o in order]
    )
    rows = rows.withColumn("_pos", F.col("_base") + F.row_number().over(in_run) - 1)
    return Layout(rows, keys, order, True)


def _small(table: DataFrame) -> DataFrame:
    """Broadcast hint for a checkpointed helper table after counting it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _placement(stats, keys, before, after, n_valid, size) -> DataFrame:
    """(key, bucket) -> chunk it is computed in, and chunks that borrow it."""
    keyed = [col(k) for k in keys]
    w = Window.partitionBy(*keyed).orderBy("_lay_bucket")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    falling = Window.partitionBy(*keyed).orderBy(F.col("_lay_bucket").desc())
    future = falling.rowsBetween(Window.unboundedPreceding, -1)
    b = (
        stats.withColumn("_lay_start", F.coalesce(F.sum("_lay_n").over(past), F.lit(0)))
        .withColumn("_lay_end", F.col("_lay_start") + F.col("_lay_n"))
        .withColumn("_lay_home", F.floor(F.col("_lay_start") / F.lit(size)).cast("long"))
        .withColumn("_lay_next", F.lead("_lay_home").over(w))
        .withColumn("_lay_prev", F.lag("_lay_home").over(w))
    )
    for i in range(n_valid):
        held = F.when(F.col(f"_valid{i}") > 0, F.col("_lay_bucket"))
        b = b.withColumn(f"_last{i}", F.last(held, True).over(past)).withColumn(
            f"_first{i}", F.last(held, True).over(future)
        )
    targets = [F.array(F.col("_lay_home"))]
    if before:
        ahead = Window.partitionBy(*keyed).orderBy("_lay_end").rangeBetween(0, before - 1)
        b = b.withColumn("_lay_upto", F.max("_lay_next").over(ahead))
        targets.append(F.when(F.col("_lay_upto") > F.col("_lay_home"),
                              F.sequence(F.col("_lay_home") + 1, F.col("_lay_upto"))))
    if after:
        behind = Window.partitionBy(*keyed).orderBy("_lay_start").rangeBetween(-(after - 1), 0)
        b = b.withColumn("_lay_from", F.min("_lay_prev").over(behind))
        targets.append(F.when(F.col("_lay_from") < F.col("_lay_home"),
                              F.sequence(F.col("_lay_from"), F.col("_lay_home") - 1)))
    empty = F.array().cast("array<bigint>")
    lent = F.concat(*[F.coalesce(t, empty) for t in targets])
    pairs = b.select(*keyed, "_lay_bucket", F.explode(lent).alias("_lay_target"))
    opens = F.col("_lay_prev").isNull() | (F.col("_lay_prev") != F.col("_lay_home"))
    closes = F.col("_lay_next").isNull() | (F.col("_lay_next") != F.col("_lay_home"))
    for i in range(n_valid):
        for edge, name in ((opens, f"_last{i}"), (closes, f"_first{i}")):
            pairs = pairs.unionByName(b.filter(edge & F.col(name).isNotNull()).select(
                *keyed, F.col(name).alias("_lay_bucket"), F.col("_lay_home").alias("_lay_target")
            ))
    where = b.select(*keyed, "_lay_bucket", "_lay_start", "_lay_home")
    return (
        pairs.distinct().join(where, [*keys, "_lay_bucket"])
        .withColumn("_lay_mine", F.col("_lay_target") == F.col("_lay_home")).drop("_lay_home")
    )


def last_valid(layout: Layout, value: Column, is_valid: Column) -> Column:
    """Nearest valid ``value`` at or before the row."""
    return F.last(F.when(is_valid, value), ignorenulls=True).over(
        layout.frame(Window.unboundedPreceding, 0)
    )


def next_valid(layout: Layout, value: Column, is_valid: Column) -> Column:
    """Nearest valid ``value`` at or after the row."""
    return F.last(F.when(is_valid, value), ignorenulls=True).over(layout.seen_from_end())
