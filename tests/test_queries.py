"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import pytest

from skywell.checks import QUERIES, SQL
from tests.compare import connect, differences, run_spark, run_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert differences(run_spark(QUERIES[name](spark, SF)), run_sql(duck, SQL[name])) is None


def test_entry_has_rows(spark):
    from __spark_entry__ import entry

    out = entry(spark)
    assert out.columns[0] == "stratum" and out.count() > 0


def test_random_split_has_exact_sizes(spark):
    rows = QUERIES["split_random"](spark, SF).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"train": 1050, "val": 225, "test": 225}


def test_stations_stay_whole(spark):
    out = QUERIES["split_by_station"](spark, SF)
    assert out.groupBy("Station").agg({"split": "approx_count_distinct"}).filter(
        "`approx_count_distinct(split)` > 1").count() == 0


def test_preparation_has_windows_per_split(spark):
    rows = QUERIES["preparation"](spark, SF).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test"} and all(r["n_windows"] > 0 for r in rows)


def test_versioned_build_splits(spark):
    rows = {r["split"]: r["n_rows"] for r in QUERIES["versioned_build"](spark, SF).collect()}
    assert rows["train"] == 700 and rows["val"] == 150 and rows["test"] == 150
