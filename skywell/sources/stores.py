"""Sinks, landing areas, versions, hashes and small record stores."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skywell.functions.rules import TIME_FORMAT
from skywell.operators.ordering import with_row
from skywell.schema import CYCLIC_ENGINEERED, GEOPHYSICAL, IONOSONDE, SPACE_WEATHER, TEC_ENGINEERED, TEMPORAL_ENGINEERED, col
from skywell.session import durable, written


def _as_text(df: DataFrame) -> DataFrame:
    """Doubles with six decimals, times in the fixed format."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(col(f.name).isNotNull(), F.format_string("%.6f", col(f.name)))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = F.date_format(col(f.name), TIME_FORMAT)
    return df.select(*[out[c].alias(c) if c in out else col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, sort=()) -> None:
    """CSV with header; ``sort`` orders the files by range, not through one task."""
    out = df.sort(*[col(s) for s in sort]) if sort else df
    _as_text(out).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """All splits in one pass over the data, one folder each."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_sequences(seq: DataFrame, path: str) -> None:
    seq.write.mode("overwrite").parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.json(path, schema=schema)


EXPORTS = {
    "csv": lambda df, p: write_csv(df, p),
    "json": lambda df, p: save_json(df, p),
    "parquet": lambda df, p: df.write.mode("overwrite").parquet(p),
}


def export(df: DataFrame, base: str, formats=("csv", "json")) -> dict[str, str]:
    """The same frame in several formats: format -> path.  Computed once when there are several."""
    unknown = set(formats) - set(EXPORTS)
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    source = durable(df) if len(formats) > 1 else df
    paths = {f: f"{base}.{f}" for f in formats}
    for f, path in paths.items():
        EXPORTS[f](source, path)
    return paths


# --- landing area ------------------------------------------------------------------------------------

MONTH = ("year", "month")


def land(df: DataFrame, root: str, station: str = "Station", ts: str = "Timestamp") -> None:
    """Write months of stations, replacing only the (station, year, month) sets of rows present in ``df``.

    A folder is a month of all stations, so that their number does not grow with the stations; rows that other
    stations have in a month are written again with it. One call at a time may write a month.
    """
    spark = df.sparkSession
    dated = df.withColumns({"year": F.year(col(ts)), "month": F.month(col(ts))})
    if _names(spark, root):
        dated = written(dated, "landing")
        sets = dated.select(col(station), *MONTH).distinct()
        touched = sets.select(*MONTH).distinct()
        before = spark.read.parquet(root)
        for keys, how in ((MONTH, "left_semi"), ((station, *MONTH), "left_anti")):
            other = (touched if how == "left_semi" else sets).toDF(*[f"_{i}" for i in range(len(keys))])
            same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
            before = before.join(other, same, how)
        dated = dated.unionByName(written(before, "landed"), allowMissingColumns=True)
    # Rebalancing gathers the rows of a folder and lets Spark split a folder that is too large.
    dated.hint("rebalance", *MONTH).sortWithinPartitions(*MONTH, col(station)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*MONTH).parquet(root)


def landed(spark: SparkSession, root: str, stations=None, wanted: DataFrame | None = None) -> DataFrame:
    """Landed rows, of some stations and of the (year, month_of_year) rows of ``wanted``, whose folders alone are read."""
    df = spark.read.parquet(root)
    if stations:
        df = df.filter(F.col("Station").isin(list(stations)))
    if wanted is not None:
        keys = wanted.select("year", F.col("month_of_year").alias("month"))
        df = df.join(F.broadcast(keys), [*MONTH], "left_semi")
    return df


def months_to_fetch(spark: SparkSession, root: str, wanted: DataFrame, station: str, force: bool = False):
    """Months of ``wanted`` that are not landed for the station (all of them when ``force``)."""
    if force:
        return wanted
    have = spark.read.parquet(root).filter(F.col("Station") == station).select(
        "year", F.col("month").alias("month_of_year")).distinct()
    return wanted.join(have, ["year", "month_of_year"], "left_anti")


# --- versions and identity ---------------------------------------------------------------------------

def _names(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def next_version(spark: SparkSession, root: str) -> str:
    """``dataset_v<n+1>`` after the highest version folder under ``root``."""
    found = [int(m.group(1)) for m in (re.fullmatch(r"dataset_v(\d+)", n) for n in _names(spark, root)) if m]
    return f"dataset_v{max(found, default=0) + 1}"


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions whose manifest is complete; a version that lost its writer half-way has none."""
    found = [m for m in (re.fullmatch(r"dataset_v(\d+)", n) for n in _names(spark, root)) if m]
    return sorted(int(m.group(1)) for m in found if "_SUCCESS" in _names(spark, f"{root}/{m.group(0)}/manifest"))


def latest_version(spark: SparkSession, root: str) -> str | None:
    """The highest committed version: writing the manifest, as the last step, is what moves it on."""
    found = committed_versions(spark, root)
    return f"dataset_v{found[-1]}" if found else None


def _state_of(spark: SparkSession, root: str, version: str, parts: list[str]) -> DataFrame:
    """(part, n_rows, hash) of the parts as they lie in the folder."""
    rows = [dataset_hash(spark.read.parquet(f"{root}/{version}/{p}")).select(F.lit(p).alias("part"), "n_rows", "hash") for p in parts]
    return reduce(DataFrame.unionByName, rows)


def commit_version(spark: SparkSession, root: str, version: str, parts: list[str]) -> None:
    """Make a fully written version the latest one: its manifest holds count and hash of every part."""
    _state_of(spark, root, version, parts).withColumn("version", F.lit(version)).coalesce(1).write.mode("error").json(
        f"{root}/{version}/manifest")


def check_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    """(part, n_rows, intact): the manifest of a version against what its folder holds now."""
    manifest = load_json(spark, f"{root}/{version}/manifest", "version string, part string, n_rows long, hash string")
    parts = [r["part"] for r in manifest.select("part").collect()]
    now = _state_of(spark, root, version, parts).select("part", F.col("n_rows").alias("_n"), F.col("hash").alias("_h"))
    return manifest.join(now, "part").select("part", "n_rows", ((F.col("n_rows") == F.col("_n")) & (F.col("hash") == F.col("_h"))).alias("intact"))


def write_version(df: DataFrame, root: str, split: str | None = "split", commit: bool = True) -> str:
    """Write ``df`` as the data of the next version; nothing is copied.

    With ``commit=False`` the version stays invisible to readers until :func:`commit_version`.
    """
    version = next_version(df.sparkSession, root)
    writer = df.write.mode("error")
    (writer.partitionBy(split) if split else writer).parquet(f"{root}/{version}/data")
    if commit:
        commit_version(df.sparkSession, root, version, ["data"])
    return version


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{latest_version(spark, root)}/data")


def dataset_hash(df: DataFrame) -> DataFrame:
    """One row (n_rows, hash); the same for any row order, different when a row repeats."""
    text = F.to_json(F.struct(*[col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    row = F.sha2(text, 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(20,0)"))
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), *[part(1 + 12 * i).alias(f"_s{i}") for i in range(5)])
    return sums.select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[
        F.col(f"_s{i}").cast("string") for i in range(5)]), 256).alias("hash"))


def metadata(df: DataFrame, features: list[str], targets: list[str], window: int, horizon: int,
             split: str = "split") -> DataFrame:
    """One-row record of a dataset: columns by group, counts by split, nulls and hash."""
    groups = {"ionosonde": IONOSONDE, "space_weather": SPACE_WEATHER, "geophysical": GEOPHYSICAL,
              "temporal": TEMPORAL_ENGINEERED, "cyclic": CYCLIC_ENGINEERED, "tec": TEC_ENGINEERED}
    nulls = sum((col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(nulls).alias("n_missing"),
        *[F.count_if(col(split) == s).alias(f"n_{s}") for s in ("train", "val", "test")])
    return with_row(counts, dataset_hash(df).select("hash")).withColumns({
        "features": names(features), "targets": names(targets),
        **{f"features_{g}": names([f for f in features if f in members]) for g, members in groups.items()},
        "window": F.lit(window), "horizon": F.lit(horizon)})


# --- record stores -----------------------------------------------------------------------------------

def save_discovery(found: dict[str, DataFrame], root: str, run: str) -> None:
    """Store the records of one run, of any shape, by category.

    A run is one write of one folder: all its categories become visible together, and the same run saved again
    replaces itself. Other runs are not touched, so runs may be saved at the same time. A run's name is letters,
    digits, dots and dashes.
    """
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"not a name of a run: {run!r}")
    rows = [df.select(F.lit(name).alias("category"), F.current_timestamp().alias("saved_at"),
                      F.to_json(F.struct(*[col(c) for c in df.columns])).alias("payload")) for name, df in found.items()]
    reduce(DataFrame.unionByName, rows).write.mode("overwrite").partitionBy("category").parquet(f"{root}/run={run}")


def read_discovery(spark: SparkSession, root: str, category: str, schema: str, before: str | None = None) -> DataFrame:
    """Records of a category with their run; ``before`` leaves the runs named lower (as text) than it."""
    rows = spark.read.option("basePath", root).schema("saved_at timestamp, payload string, run string, category string").parquet(
        f"{root}/run=*").filter(F.col("category") == category)
    if before is not None:
        rows = rows.filter(F.col("run") < before)
    return rows.select("run", "saved_at", F.from_json("payload", schema).alias("r")).select("run", "saved_at", "r.*")


def history_before(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    """One row (hist_mean, hist_std) over all values that the runs before ``run`` recorded as ``history``.

    The moments of the runs are pooled about the common mean; null without an earlier run.
    """
    if not _names(spark, root):
        return spark.createDataFrame([(None, None)], "hist_mean double, hist_std double")
    past = read_discovery(spark, root, "history", "n long, mean double, m2 double", run).filter("n > 0")
    whole = past.agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("hist_mean"))
    off = F.col("mean") - F.col("hist_mean")
    return with_row(past, whole).agg(F.max("hist_mean").alias("hist_mean"), F.sqrt(
        F.sum(F.col("m2") + F.col("n") * off * off) / F.max("_n")).alias("hist_std"))


def log_metrics(record: DataFrame, root: str, step: int) -> None:
    record.withColumn("step", F.lit(step)).write.mode("append").parquet(root)


def save_scaler(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
