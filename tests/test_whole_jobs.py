"""Queries of whole jobs with default settings, against brute-force versions."""

from __future__ import annotations

import collections
import datetime

import numpy as np
import pytest

from skywell.checks import QUERIES
from skywell.checks.base import observations
from skywell.schema import Settings

SF = "/root/testdata/sf0.001"


def test_outlier_treatment_clips_what_the_forest_flags(spark):
    before = observations(spark, SF).toPandas().set_index("event_id")
    after = QUERIES["outlier_treatment_rows"](spark, SF).toPandas().set_index("event_id")
    assert QUERIES["isolation_forest_mask"](spark, SF).where("flagged").count() > 0
    assert len(after) == len(before)
    for c in Settings().forest_columns:  # one flag of the forest holds for each of its columns
        x = before[c].astype(float)
        want = x.clip(*np.nanquantile(x, [0.01, 0.99]))
        got = after[c.lower().replace(".", "")].astype(float).reindex(want.index)
        np.testing.assert_allclose(got, want, atol=2e-6)
        assert (want != x)[x.notna()].any()


def test_preparation_has_every_window_of_every_size(spark):
    rows = QUERIES["preprocessing"](spark, SF).select("event_id", "split", "tec").join(
        observations(spark, SF).selectExpr("event_id", "Station AS station", "Timestamp AS ts"), "event_id").collect()
    parts = collections.defaultdict(list)
    for x in sorted(rows, key=lambda x: (x["ts"], x["event_id"])):
        parts[x["split"], x["station"]].append(x["tec"])
    want = {(*key, h, i): v[i + 4 * h - 1] for key, v in parts.items() for h in (2, 6, 12, 24, 48) for i in range(len(v) - 4 * h)}
    got = QUERIES["preparation_windows"](spark, SF).collect()
    tec = {(x["split"], x["station"], x["window_h"], x["start"]): x["y"] for x in got if x["target"] == "TEC"}
    assert {k[2] for k in want} > {2}
    assert tec == pytest.approx(want, abs=1e-4) and len(got) == 2 * len(want)
    assert {k for k in want} == {(x["split"], x["station"], x["window_h"], x["start"]) for x in got if x["target"] == "Dst"}


def test_versioned_build_writes_default_windows_of_every_target(spark, tmp_path):
    start, hours = datetime.datetime(2024, 1, 1), 24 * 28
    ids = [i for i in range(1, 4 * hours) if i % 7 and i % 97]  # rows that the view leaves whole
    events = [(ids[2 * h + u], start + datetime.timedelta(hours=h), u + 1, "view", 20.0 + (h * 7 + u * 3) % 11, f'{{"k": {(h * 5) % 80}}}')
              for h in range(hours) for u in range(2)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    got = collections.defaultdict(dict)
    for x in QUERIES["versioned_build_sequences"](spark, str(tmp_path)).collect():
        got[x["target"], x["split"], x["station"]][x["start"]] = x
    first, second = int(2 * hours * 0.7), int(2 * hours * 0.85)
    cuts = {"train": range(first), "val": range(first, second), "test": range(second, 2 * hours)}
    for target, place in (("foF2", 1), ("TEC", 0)):
        for split, span in cuts.items():
            for u in range(2):
                hs = [n // 2 for n in span if n % 2 == u]
                mine = got.pop((target, split, u + 1), {})
                assert sorted(mine) == list(range(max(0, len(hs) - 96)))
                train = np.array([20.0 + (n // 2 * 7 + n % 2 * 3) % 11 for n in cuts["train"]])
                raw = (np.array([20.0 + (h * 7 + u * 3) % 11 for h in hs]) - train.mean()) / train.std()
                for i, x in mine.items():
                    assert [s[place] for s in x["x"]] == pytest.approx(raw[i:i + 96]) and x["y"] == pytest.approx(raw[i + 96])
    assert not got
