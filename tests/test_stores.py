"""Versions that become visible with their manifest, and runs of the discovery store."""

from __future__ import annotations

import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywell.checks import QUERIES
from skywell.checks.mining import FEATURES, _mining
from skywell.operators import discovery
from skywell.plans import jobs
from skywell.schema import Settings
from skywell.sources import stores

SF = "/root/testdata/sf0.001"


def test_a_version_counts_from_its_manifest_on(spark, tmp_path):
    root = str(tmp_path / "data")
    assert stores.latest_version(spark, root) is None
    first = stores.write_version(spark.range(10), root, None)
    lost = stores.write_version(spark.range(3), root, None, commit=False)
    assert (first, lost, stores.latest_version(spark, root)) == ("dataset_v1", "dataset_v2", "dataset_v1")
    assert stores.read_latest(spark, root).count() == 10
    third = stores.write_version(spark.range(4), root, None)  # the number of the lost one is not used again
    assert third == "dataset_v3" == stores.latest_version(spark, root)
    stores.commit_version(spark, root, lost, ["data"])
    assert stores.committed_versions(spark, root) == [1, 2, 3]
    with pytest.raises(Exception):  # a version is committed once
        stores.commit_version(spark, root, lost, ["data"])


def test_check_finds_changed_parts(spark, tmp_path):
    root = str(tmp_path / "data")
    version = stores.write_version(spark.range(10), root, None)
    assert [tuple(r) for r in stores.check_version(spark, root, version).collect()] == [("data", 10, True)]
    spark.range(1, 11).write.mode("overwrite").parquet(f"{root}/{version}/data")
    assert [tuple(r) for r in stores.check_version(spark, root, version).collect()] == [("data", 10, False)]


@pytest.mark.parametrize("step", ["save_scaler", "write", "save_json", "commit_version"])
def test_a_build_that_ends_early_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "data")
    rows = [(1, f"2024-01-{1 + i // 8:02d} {3 * (i % 8):02d}:00:00", float(i % 13), 5.0) for i in range(80)]
    giro = spark.createDataFrame(rows, "Station long, t string, TEC double, Longitude double").select(
        "Station", F.to_timestamp("t").alias("Timestamp"), "TEC", "Longitude")
    omni = giro.select("Timestamp", F.lit(2.0).alias("Kp"), F.lit(-20.0).alias("Dst"))
    build = lambda: jobs.build_dataset(giro, omni, "2024-01-01", "2024-01-31", ["TEC"], ["TEC"], root, Settings(build_window=4))
    if step == "write":
        def broken(*args, **kwargs):
            raise RuntimeError("lost")
        monkeypatch.setattr(jobs.sequences, "sequences_ahead", broken)
    elif step != "commit_version":
        monkeypatch.setattr(stores, step, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    else:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(stores, step, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                build()
        assert stores.latest_version(spark, root) is None
        done = build()
        assert stores.latest_version(spark, root) == done["version"] == "dataset_v2"
        assert stores.check_version(spark, root, "dataset_v2").filter("not intact").isEmpty()
        assert {r["source"] for r in spark.read.parquet(f"{root}/dataset_v2/feeds").collect()} == {"ionosonde", "indices"}
        return
    with pytest.raises(RuntimeError):
        build()
    assert stores.latest_version(spark, root) is None


def test_history_pools_earlier_runs(spark, tmp_path):
    root, rng = str(tmp_path / "store"), np.random.default_rng(3)
    parts = {"a": rng.normal(5, 1, 40), "b": rng.normal(9, 3, 7), "c": np.zeros(0), "d": rng.normal(-4, 2, 11)}
    assert tuple(stores.history_before(spark, root).first()) == (None, None)
    for run, x in parts.items():
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        for _ in range(2):
            stores.save_discovery({"history": discovery.moments(df, "x"), "rows": df}, root, run)
    for run, before in {"b": "a", "d": "abc", "e": "abcd"}.items():
        got, x = stores.history_before(spark, root, run).first(), np.concatenate([parts[p] for p in before])
        assert (got["hist_mean"], got["hist_std"]) == pytest.approx((x.mean(), x.std()))
    assert stores.history_before(spark, root, "a").first()["hist_mean"] is None
    assert stores.read_discovery(spark, root, "rows", "x double").groupBy("run").count().count() == 3
    with pytest.raises(ValueError):
        stores.save_discovery({"rows": spark.range(1)}, root, "../x")


def test_whole_bundle_in_the_store(spark):
    got = collections.defaultdict(list)
    for r in QUERIES["discovery_records"](spark, SF).collect():
        got[r["run"], r["category"]].append(json.loads(r["payload"]))
    rows = _mining(spark, SF).dropna(subset=["Kp"]).select("Timestamp", "prediction").toPandas()
    first = rows[rows["Timestamp"].dt.day <= 15]["prediction"]
    n = {"2024-01a": len(first), "2024-01b": len(rows) - len(first)}
    for run in n:
        assert len(got[run, "relationships"]) == len(FEATURES) and len(got[run, "history"]) == 1  # saved twice, there once
        assert got[run, "history"][0]["n"] == n[run]
        for category in ("states", "archetypes", "events"):
            assert sum(x["n"] for x in got[run, category]) == n[run]
        assert sum(x["n"] for x in got[run, "latent_clusters"]) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
        assert got[run, "hypotheses"]
    later = rows[rows["Timestamp"].dt.day > 15]["prediction"].mean()
    assert "drift_z" not in got["2024-01a", "drift"][0]  # no run before it
    assert got["2024-01b", "drift"][0]["drift_z"] == pytest.approx(abs(later - first.mean()) / (first.std(ddof=0) + 1e-8))
