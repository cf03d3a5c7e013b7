"""Monitors that need a station's earlier rows, on Spark's keyed state.

Rows wait in the state of their station until the watermark has passed them and then go on in time order, so a
row that comes out of order within the watermark still meets its true predecessor. A row at or behind the
watermark when it arrives is late and is left out. After the rows a station keeps only the last few that later
ones look back at. A pause longer than ``idle`` ends a run: nothing after it looks back across it, and a timer
drops the state of a station that stays silent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from skywell.schema import col
from skywell.session import keyed_state

AT = "at_us"


def _packed(df: pd.DataFrame) -> bytes | None:
    if df.empty:
        return None
    table = pa.RecordBatch.from_pandas(df, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> list[pd.DataFrame]:
    return [] if data is None else [pa.ipc.open_stream(bytes(data)).read_all().to_pandas()]


class InOrder(StatefulProcessor):
    """``step(rows, fresh)`` gets rows of one station in order, each with its run number ``_run``, of which those from
    position ``fresh`` on are new, and returns the output rows of the new ones."""

    def __init__(self, step: Callable[[pd.DataFrame, int], pd.DataFrame], keys: list[str], order: list[str],
                 carry: int, idle_ms: int, given: list[str], names: list[str]):
        self.step, self.keys, self.order = step, keys, order
        self.carry, self.idle_ms, self.given, self.names = carry, idle_ms, given, names

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "carried binary, waiting binary, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, list(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key, arrived: list[pd.DataFrame], mark: int, fired: int | None = None) -> Iterator[pd.DataFrame]:
        carried, waiting, timer = self.kept.get() if self.kept.exists() else (None, None, None)
        # Names that Python tuples cannot carry arrive changed, so columns are named by place.
        arrived = [a.set_axis(self.given, axis=1) for a in arrived if len(a)]
        arrived = [a[a[AT] // 1000 >= mark].drop(columns=[c for c in a.columns if c in self.keys or c == "event_time"])
                   for a in arrived]
        parts = _unpacked(waiting) + [a for a in arrived if len(a)]
        rest = pd.concat(parts, ignore_index=True) if parts else None
        earlier = _unpacked(carried)
        last = int(earlier[0][AT].iloc[-1]) if earlier else None
        if rest is not None:
            ready = rest[rest[AT] // 1000 < mark].sort_values([AT, *self.order], kind="stable")
            rest = rest[rest[AT] // 1000 >= mark]
            if len(ready):
                rows = pd.concat([*earlier, ready], ignore_index=True)
                fresh = len(rows) - len(ready)
                rows["_run"] = (rows[AT].diff() > self.idle_ms * 1000).cumsum()
                made = self.step(rows, fresh)
                if len(made):
                    yield made.assign(**dict(zip(self.keys, key)))[self.names]
                own_run = rows[rows["_run"] == rows["_run"].iloc[-1]].drop(columns="_run")
                earlier = [own_run.tail(self.carry)]
                last = int(rows[AT].iloc[-1])
        if timer is not None and timer != fired:
            self.handle.deleteTimer(timer)
        if rest is not None and len(rest):
            timer = int(rest[AT].min() // 1000) + 1
        elif last is not None and last // 1000 + self.idle_ms + 1 > mark:
            timer = last // 1000 + self.idle_ms + 1
        else:
            self.kept.clear()
            return
        self.handle.registerTimer(timer)  # always ahead of the watermark: one that fires is dropped afterwards
        waiting = _packed(rest) if rest is not None and len(rest) else None
        self.kept.update((_packed(earlier[0]) if earlier else None, waiting, timer))


def in_order(stream: DataFrame, step: Callable, output: str, keys: list[str], order: list[str], carry: int,
             idle: str = "1 day", ts: str = "ts") -> DataFrame:
    """``step`` over the rows of every key in time order; ``stream`` is watermarked on ``ts``.

    ``output`` is the DDL of what ``step`` returns; the keys come before it. Columns of time type do not reach
    ``step``, which finds the time in microseconds in ``at_us``.
    """
    keyed_state(stream.sparkSession)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    plain = [c for c in stream.columns if c != ts and c not in keys
             and not isinstance(stream.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    rows = stream.where(col(ts).isNotNull()).select(
        *[col(k) for k in keys], *[col(c) for c in plain], F.unix_micros(col(ts)).alias(AT), col(ts).alias("event_time"))
    fields = [stream.schema[k] for k in keys] + list(T._parse_datatype_string(output).fields)
    schema = T.StructType(fields)
    return rows.groupBy(*[col(k) for k in keys]).transformWithStateInPandas(
        statefulProcessor=InOrder(step, list(keys), list(order), carry, idle_ms, rows.columns, schema.names),
        outputStructType=schema, outputMode="Append", timeMode="EventTime")


def steps_in_order(stream: DataFrame, keys=("station",), row="event_id", topside="topside", net="net", density="density",
                   cap: float = 200.0, max_step: float = 20.0, idle: str = "1 day", ts: str = "ts") -> DataFrame:
    """Anomaly flags of every row, with the step against the row before it in time (none after a pause)."""
    def step(rows: pd.DataFrame, fresh: int) -> pd.DataFrame:
        jump = rows.groupby("_run")[topside].diff().abs()
        out = pd.DataFrame({row: rows[row], AT: rows[AT], "step": jump, "negative_topside": rows[topside] < 0,
                            "negative_density": rows[density] < 0, "extreme_tec": rows[net] > cap, "massive_jump": jump > max_step})
        flags = ["negative_topside", "negative_density", "extreme_tec", "massive_jump"]
        out["is_anomalous"] = out[flags].any(axis=1)
        return out.iloc[fresh:]

    kind = stream.schema[row].dataType.simpleString()
    output = f"`{row}` {kind}, {AT} long, step double, negative_topside boolean, negative_density boolean, extreme_tec boolean, massive_jump boolean, is_anomalous boolean"
    return in_order(stream, step, output, list(keys), [row], 1, idle, ts)


def sequences_in_order(stream: DataFrame, features: list[str], width: int, keys=("station",), row="event_id",
                       idle: str = "1 day", ts: str = "ts") -> DataFrame:
    """For every row the last ``width`` rows of its run, itself included; none while the run is shorter."""
    def step(rows: pd.DataFrame, fresh: int) -> pd.DataFrame:
        cells, at, run = rows[features].to_numpy(float), rows[AT].tolist(), rows["_run"].tolist()
        ends = [i for i in range(max(fresh, width - 1), len(rows)) if run[i - width + 1] == run[i]]
        return pd.DataFrame({"start_us": [at[i - width + 1] for i in ends], "end_us": [at[i] for i in ends],
                             "x": [cells[i - width + 1:i + 1].tolist() for i in ends]})

    return in_order(stream, step, "start_us long, end_us long, x array<array<double>>", list(keys), [row], width - 1, idle, ts)
