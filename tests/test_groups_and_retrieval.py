"""User functions per group, retrieval between large sides, and monitors on keyed state."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skywell.operators import fills, groups, retrieval
from skywell.streaming import monitors, ordered

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "Station string, Timestamp timestamp, event_id long, `F10.7` double, own_note string"


def uneven(n=4000):
    """One station with half of all rows, many small ones, one without a name."""
    rng = np.random.default_rng(4)
    names = ["big"] * (n // 2) + [f"s{i % 40}" for i in range(n // 2 - 30)] + [None] * 30
    return [(s, T0 + dt.timedelta(minutes=int(rng.integers(0, 20_000))), i, None if rng.random() < 0.5 else float(rng.normal()), "x")
            for i, s in enumerate(names)]


def carried(limit):
    def fn(batches):
        held, age = None, 0
        for b in batches:
            out = []
            for v in b.column("F10.7").to_pylist():
                held, age = (v, 0) if v is not None else (held, age + 1)
                out.append(held if age <= limit else None)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(out, pa.float64()), b.column("own")], ["event_id", "filled", "own"])
    return fn


@pytest.mark.parametrize("chunk_rows", [None, 150])
def test_filling_by_user_code_equals_the_native_one(spark, chunk_rows):
    df = spark.createDataFrame(uneven(), SCHEMA)
    got = groups.map_groups(df, ["Station"], ["Timestamp", "event_id"], carried(2), "event_id long, filled double", before=2, chunk_rows=chunk_rows)
    want = fills.fill_gaps(df, ["F10.7"], "ffill", 2, ["Station"], ["Timestamp", "event_id"]).select("event_id", F.col("`F10.7`").alias("filled"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_no_call_of_a_cut_group_sees_all_its_rows(spark):
    def sized(batches):
        n = 0
        for b in batches:
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([True])], ["n", "own"])

    df = spark.createDataFrame(uneven(), SCHEMA)
    calls = [r["n"] for r in groups.map_groups(df, ["Station"], ["Timestamp", "event_id"], sized, "n long", before=2, chunk_rows=300).collect()]
    assert max(calls) < 1000 and sum(calls) >= 4000


def state_of(rows):
    return {"c": len(rows), "s": float(rows["F10.7"].sum()), "hi": float(rows["F10.7"].max()) if rows["F10.7"].notna().any() else None}


def joined(a, b):
    return {"c": a["c"] + b["c"], "s": a["s"] + b["s"], "hi": max((x for x in (a["hi"], b["hi"]) if x is not None), default=None)}


@pytest.mark.parametrize("keys", [["Station"], ["Station", "own_note"], []])
def test_folds_by_user_code(spark, monkeypatch, keys):
    monkeypatch.setattr(groups, "HELD_STATES", 7)
    df = spark.createDataFrame(uneven(), SCHEMA).repartition(9)
    got = groups.fold_groups(df, keys, state_of, joined, "c long, s double, hi double", ["F10.7"])
    want = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("`F10.7`"), F.lit(0.0)).alias("s"), F.max("`F10.7`").alias("hi"))
    show = lambda d: sorted((tuple(r)[:-2] + (round(r["s"], 6), r["hi"]) for r in d.collect()), key=str)
    assert show(got) == show(want)


def test_folds_of_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert groups.fold_groups(df, ["Station"], state_of, joined, "c long, s double, hi double", ["F10.7"]).collect() == []
    assert groups.map_groups(df, ["Station"], ["Timestamp"], carried(1), "event_id long, filled double").collect() == []


# --- retrieval ---------------------------------------------------------------------------------------

def vectors(n, seed, spread=True):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6))
    return v * np.exp(rng.normal(size=(n, 1)) * 1.5) if spread else v


def brute(q, v, k):
    out = {}
    for i, x in enumerate(q):
        s = np.round(v @ x / np.sqrt(6), 9)
        kth = np.sort(s)[::-1][min(k, len(s)) - 1]
        out[i] = {j for j in range(len(v)) if s[j] >= kth}
    return out


@pytest.mark.parametrize("copies", [0, 300])
def test_retrieval_is_exact_and_skips_blocks(spark, copies):
    q, v = vectors(150, 1), vectors(1200, 2)
    v[1000:1000 + copies // 2] = v[5]  # ties beyond k
    v[0] = 0
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(999, None)], "qid long, q array<double>")
    ms = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "mid long, v array<double>").repartition(5)
    hits, counts = retrieval.nearest_classes(qs, ms, 4, block_rows=40, first_shell=50)
    first = {}
    for j, x in enumerate(map(tuple, v)):
        first.setdefault(x, j)
    got = {}
    for r in hits.collect():
        got.setdefault(r["qid"], set()).add(r["cid"])
    want = {i: {first[tuple(v[j])] for j in found} for i, found in brute(q, v, 4).items()}
    assert got == want
    assert counts["skipped"] > counts["products"]  # lengths differ, so most shells are never met


def test_retrieved_value_is_the_weighted_sum(spark):
    q, v = vectors(30, 3, False), vectors(200, 4, False)
    v[10] = v[20]
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, q array<double>")
    ms = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "mid long, v array<double>")
    rows = {r["qid"]: r for r in retrieval.retrieve(qs, ms, 5, first_shell=64).collect()}
    for i, x in enumerate(q):
        s = v @ x / np.sqrt(6)
        keep = np.flatnonzero(s >= np.sort(s)[-5] - 1e-12)
        w = np.exp(s[keep] - s.max())
        assert rows[i]["n_kept"] == len(keep)
        np.testing.assert_allclose(rows[i]["value"], (w[:, None] * v[keep]).sum(0) / w.sum(), rtol=1e-9)
        np.testing.assert_allclose(rows[i]["top_weight"], w.max() / w.sum(), rtol=1e-9)


def test_retrieval_from_or_for_nothing(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0])], "qid long, q array<double>")
    none = some.limit(0)
    assert retrieval.retrieve(some, none.toDF("mid", "v")).collect() == []
    assert retrieval.retrieve(none, some.toDF("mid", "v")).collect() == []


# --- monitors on keyed state -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def untidy(spark, tmp_path_factory):
    """Four files: rows out of order within the watermark, late rows, a pause, a station that falls silent."""
    root = str(tmp_path_factory.mktemp("untidy"))
    rng = np.random.default_rng(9)
    rows = []
    for i in range(160):
        at = T0 + dt.timedelta(minutes=10 * i + (1200 if i >= 90 else 0))
        rows.append((i, "C" if i < 15 else "AB"[i % 2], at, float(rng.integers(0, 50))))
    parts = [rows[k:k + 40] for k in (0, 40, 80, 120)]
    parts[1][0], parts[0][39] = parts[0][39], parts[1][0]  # swapped over a batch border, within the watermark
    late = [(900 + k, "A", T0 + dt.timedelta(minutes=5 + k), 7.0) for k in range(3)]
    schema = "event_id long, station string, ts timestamp, topside double"
    for k, part in enumerate(parts):
        order = rng.permutation(len(part))
        frame = [part[j] for j in order] + (late if k == 2 else [])
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(root)
    stream = monitors.event_time(stream.withColumns({"net": F.col("topside") * 2, "density": F.col("topside") - 3, "_odd name": F.lit(1)}))
    pdf = pd.DataFrame(rows, columns=["event_id", "station", "ts", "topside"])
    done = pdf[pdf["ts"] < pdf["ts"].max() - pd.Timedelta(minutes=30)].sort_values(["ts", "event_id"])
    done["run"] = done.groupby("station")["ts"].transform(lambda t: (t.diff() > pd.Timedelta(hours=12)).cumsum())
    return stream, done


def test_steps_meet_their_true_predecessor(spark, untidy):
    stream, want = untidy
    out = monitors.run_available(ordered.steps_in_order(stream, max_step=20.0, idle="12 hours"), spark)
    got = out.toPandas().set_index("event_id").sort_index()
    want = want.set_index("event_id")
    step = want.groupby(["station", "run"])["topside"].diff().abs().sort_index()
    assert got.index.tolist() == step.index.tolist()  # late rows are left out, open ones wait
    np.testing.assert_allclose(got["step"].to_numpy(float), step.to_numpy(float))
    assert (got["massive_jump"].to_numpy() == (step > 20).to_numpy()).all()


def test_sequences_do_not_cross_a_pause(spark, untidy):
    stream, want = untidy
    got = monitors.run_available(ordered.sequences_in_order(stream, ["topside"], 5, idle="12 hours"), spark).collect()
    expected = set()
    for (station, _), part in want.groupby(["station", "run"]):
        for i in range(4, len(part)):
            expected.add((station, int(part["ts"].iloc[i].value // 1000), tuple(part["topside"].iloc[i - 4:i + 1])))
    assert {(r["station"], r["end_us"], tuple(c[0] for c in r["x"])) for r in got} == expected


def test_keyed_state_in_a_session_with_sparks_own_store(spark, untidy):
    """A session may come without the settings of `build_session`; Spark's default store cannot hold timers."""
    stream, want = untidy
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        out = monitors.run_available(ordered.steps_in_order(stream, max_step=20.0, idle="12 hours"), spark)
        assert out.count() == len(want)
    finally:
        spark.conf.set(key, before)


def test_silent_stations_leave_no_state():
    class Handle:
        def __init__(self):
            self.value, self.timers = None, set()

        def getValueState(self, *_):
            return self

        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)
        clear = lambda self: setattr(self, "value", None)
        registerTimer = lambda self, t: self.timers.add(t)
        deleteTimer = lambda self, t: self.timers.discard(t)

    class Times:
        def __init__(self, t):
            self.getCurrentWatermarkInMs = lambda: t
            self.getExpiryTimeInMs = lambda: self.timer

    step = lambda rows, fresh: rows.iloc[fresh:][["id", "at_us"]]
    handle, op = Handle(), ordered.InOrder(step, ["station"], ["id"], 1, 1000, ["station", "id", "at_us"], ["station", "id"])
    op.init(handle)
    arrive = pd.DataFrame({"station": ["A"] * 3, "id": [2, 1, 3], "at_us": [2_000_000, 1_000_000, 9_000_000]})
    assert list(op.handleInputRows(("A",), iter([arrive]), Times(0))) == [] and handle.timers == {1001}
    def fire(mark):
        times = Times(mark)
        times.timer = min(handle.timers)
        handle.timers.discard(times.timer)
        return [x for f in op.handleExpiredTimer(("A",), times, times) for x in f["id"]]
    assert fire(5000) == [1, 2] and handle.timers == {9001}
    assert fire(9500) == [3] and handle.timers == {10_001}
    assert fire(10_500) == [] and handle.value is None and not handle.timers


def test_forest_scores_are_read_not_computed_again(spark):
    from skywell.operators.forest import isolation_forest

    df = spark.range(200).select("id", (F.col("id") * 7 % 31).cast("double").alias("x"))
    out = isolation_forest(df, ["x"], ["id"], 0.05, trees=5)
    assert "EvalPython" not in out._jdf.queryExecution().toString() and out.where("score is null").isEmpty()


def test_vectors_of_different_lengths_are_refused():
    import pyarrow as pa

    from skywell.operators.retrieval import _matrix

    column = lambda rows: pa.chunked_array([pa.array(r, pa.list_(pa.float64())) for r in rows])
    assert _matrix(column([[[1.0, None]], [[3.0, 4.0], [5.0, 6.0]]])).tolist()[1:] == [[3.0, 4.0], [5.0, 6.0]]
    with pytest.raises(ValueError):
        _matrix(column([[[1.0, 2.0], [3.0]], [[4.0]]]))
