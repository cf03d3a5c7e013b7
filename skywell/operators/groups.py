"""User functions per group, as Arrow batches that stream: no group has to fit in memory.

``fold_groups`` reduces every group to one row by user code. It folds the rows where they are and merges the
few states of a key afterwards, so a key with half of all rows is shared by all tasks. ``map_groups`` hands
consecutive rows of a key to user code in order; a key above the chunk bound is cut, and each chunk also gets
the neighbour rows the function says it looks at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skywell.operators.layout import lay_out
from skywell.schema import col

HELD_STATES = 50_000
OWN = "own"


def fold_groups(df: DataFrame, keys: list[str], fold: Callable[[pd.DataFrame], dict], merge: Callable[[dict, dict], dict],
                state: str, columns: list[str] | None = None) -> DataFrame:
    """One row per group: its keys and the columns of ``state`` (DDL).

    ``fold`` turns some rows of one group into a state, ``merge`` joins two states of a group; both must not
    depend on how the rows are cut. Null keys form a group of their own. Only ``columns`` (default: all that
    are no keys) reach Python.
    """
    columns = [c for c in df.columns if c not in keys] if columns is None else columns
    inner = [f"k{i}" for i in range(len(keys))]  # columns travel under plain names
    rows = df.select(*[col(k).alias(i) for k, i in zip(keys, inner)], *[col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    fields = T._parse_datatype_string(state).fields
    schema = T.StructType([T.StructField(i, df.schema[k].dataType) for k, i in zip(keys, inner)]
                          + [T.StructField(f"s{i}", f.dataType) for i, f in enumerate(fields)])
    names, arrow = [f.name for f in fields], to_arrow_schema(schema)

    def out(states: dict[tuple, dict]) -> pa.RecordBatch:
        lists = [list(c) for c in zip(*((*k, *(s[n] for n in names)) for k, s in states.items()))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(lists or [[]] * len(arrow), arrow)], schema=arrow)

    def joined(states: dict[tuple, dict], key: tuple, new: dict) -> None:
        states[key] = merge(states[key], new) if key in states else new

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, dict] = {}
        for batch in batches:
            table = batch.select(range(len(keys), batch.num_columns)).to_pandas().set_axis(columns, axis=1)
            held = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))))) if keys else [()] * batch.num_rows
            codes, distinct = pd.factorize(pd.Series(held, dtype=object), use_na_sentinel=False)
            for code, rows_of in table.groupby(codes, sort=False):
                joined(states, distinct[code], fold(rows_of))
            if len(states) > HELD_STATES:
                yield out(states)
                states = {}
        yield out(states)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, dict] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                joined(states, row[:len(keys)], dict(zip(names, row[len(keys):])))
        if states:
            yield out(states)

    states = rows.mapInArrow(partial, schema)
    # Without keys there is one state a task.
    merged = states.groupBy(*inner).applyInArrow(_iterating(last), schema) if keys else states.repartition(1).mapInArrow(last, schema)
    return merged.toDF(*keys, *names)


def _iterating(fn: Callable) -> Callable:
    """Spark tells the streaming form of a grouped function by its type hints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
               schema: str | T.StructType, before: int = 0, after: int = 0, chunk_rows: int | None = None) -> DataFrame:
    """Rows that ``fn`` makes of each group, given as batches of consecutive rows in ``order``.

    ``fn`` gets all columns and ``own``, and yields the columns of ``schema`` with ``own`` kept beside each row.
    A key above the bound comes in several calls; rows that another call owns (``own`` false) come along
    ``before`` and ``after`` a call's own rows, and what is made of them is dropped.
    """
    layout = lay_out(df, keys, order, before=before, after=after, chunk_rows=chunk_rows)
    chunk, run = (["_chunk"], ["_run"]) if layout.chunked else ([], [])
    rows = layout.rows if layout.chunked else layout.rows.selectExpr("*", "true AS _own")
    # Columns travel under plain names: Spark cannot hand names with dots to a grouped function.
    given = list(df.columns)
    plain = {c: f"c{i}" for i, c in enumerate(given)}
    rows = rows.select(*[col(c).alias(plain[c]) for c in given], *chunk, *run, "_own")
    by = [F.col(plain[k]) for k in keys] + [F.col(c) for c in chunk]
    if not by:
        rows, by = rows.withColumn("_all", F.lit(0)), [F.col("_all")]
    sort = [c.asc_nulls_first() for c in by] + [F.col(r) for r in run] + [F.col(plain[o]).asc_nulls_last() for o in order]
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = target.names

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shown() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*(b.column(plain[c]) for c in given), b.column("_own")], [*given, OWN])
        for made in fn(shown()):
            yield made.filter(made.column(OWN)).select(names)

    return rows.repartition(*by).sortWithinPartitions(*sort).groupBy(*by).applyInArrow(_iterating(call), target)
