"""Operational monitors as Structured Streaming queries.

Windowed monitors are plain streaming aggregates (partial aggregation keeps a hot station off one
task).  Monitors that need the previous rows of a station work on micro-batches with a small table
of carried rows, so that the same skew-safe windows as in batch apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skywell.functions.rules import event_class, storm_state
from skywell.operators.layout import lay_out
from skywell.operators.metrics import anomaly_aggregates, is_anomalous, readiness
from skywell.operators.ordering import with_row
from skywell.schema import col
from skywell.session import scratch_path

WATERMARK = "30 minutes"


def event_time(stream: DataFrame, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Cast the time column to TIMESTAMP (a zone-less one cannot carry a watermark) and mark it."""
    return stream.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, watermark)


def _bounds(df: DataFrame, *keep) -> DataFrame:
    return df.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keep)


def storm_monitor(stream: DataFrame, length="1 day", slide="6 hours", ts="ts", kp="kp", dst="dst") -> DataFrame:
    """Highest Kp, lowest Dst and the storm state of each sliding window.  ``stream`` is watermarked."""
    agg = stream.groupBy(F.window(ts, length, slide)).agg(
        F.max(col(kp)).alias("max_kp"), F.min(col(dst)).alias("min_dst"))
    category, level = storm_state(F.col("max_kp"), F.col("min_dst"))
    return _bounds(agg, "max_kp", "min_dst", category.alias("category"), level.alias("level"))


def readiness_stream(stream: DataFrame, length="1 day", by=(), ts="ts", confidence="confidence", kp="kp",
                     dst="dst", **columns) -> DataFrame:
    """Readiness score per window (and key); ``step`` is the output of the anomaly monitor."""
    agg = stream.groupBy(F.window(ts, length), *[col(b) for b in by]).agg(
        *anomaly_aggregates(**columns), F.avg(col(confidence)).alias("conf"),
        F.max(col(kp)).alias("kp"), F.min(col(dst)).alias("dst"))
    _, level = storm_state(F.col("kp"), F.col("dst"))
    return _bounds(agg.withColumn("readiness", readiness(F.col("conf"), level)).withColumn(
        "is_anomalous", is_anomalous()), *[col(b) for b in by], "is_anomalous", "readiness")


def drift_stream(stream: DataFrame, history: DataFrame, value: str, length="1 day", ts="ts",
                 threshold: float = 3.0) -> DataFrame:
    """Mean of each tumbling window against a static one-row history (hist_mean, hist_std)."""
    agg = stream.groupBy(F.window(ts, length)).agg(F.avg(col(value)).alias("current_mean"))
    z = F.abs((F.col("current_mean") - F.col("hist_mean")) / (F.col("hist_std") + 1e-8))
    return _bounds(with_row(agg, history).withColumn("drift_z", z), "current_mean", "drift_z",
                   (z > threshold).alias("is_drifting"))


def enrich_stream(stream: DataFrame, indices: DataFrame, ts: str = "ts") -> DataFrame:
    """Left join with a static hourly table whose time column has the same name."""
    hours = indices.withColumnRenamed(ts, "_hour")
    return stream.withColumn("_hour", F.date_trunc("hour", col(ts))).join(hours, "_hour", "left").drop("_hour")


def dedup_stream(stream: DataFrame, keys=("station", "ts")) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(list(keys))


def runs(stream: DataFrame, gap="24 hours", by=("station",), ts="ts") -> DataFrame:
    """Uninterrupted runs of each key: a longer gap starts a new one."""
    agg = stream.groupBy(F.session_window(ts, gap), *[col(b) for b in by]).agg(F.count(F.lit(1)).alias("n_rows"))
    return agg.select(*[col(b) for b in by], F.col("session_window.start").alias("start"),
                      F.col("session_window.end").alias("end"), "n_rows")


def classify_stream(stream: DataFrame, kp="kp", novel="is_novel") -> DataFrame:
    return stream.withColumn("event_class", event_class(col(kp), col(novel)))


def observe_stream(stream: DataFrame, name: str = "quality", checks: dict | None = None) -> DataFrame:
    """Attach per-batch validation counts; read them from the query progress (observedMetrics)."""
    checks = checks or {}
    return stream.observe(name, F.count(F.lit(1)).alias("rows"),
                          *[F.count_if(cond).alias(k) for k, cond in checks.items()])


# --- micro-batch monitors ----------------------------------------------------------------------------

class CarriedRows:
    """Last ``k`` rows per key between micro-batches, one table per batch under a shared folder.

    The table of a batch is written from the previous table and the batch only, so a batch that is
    run again after a failure writes the same rows.
    """

    def __init__(self, root: str, k: int, keys, order):
        self.root, self.k, self.keys, self.order = root.rstrip("/"), k, list(keys), list(order)

    def _path(self, batch_id: int) -> str:
        return f"{self.root}/batch={batch_id}"

    def merge(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Batch rows (``_new``) together with the rows carried from the batch before."""
        fresh = batch.withColumn("_new", F.lit(True))
        if batch_id == 0:
            return fresh
        carried = batch.sparkSession.read.schema(batch.schema).parquet(self._path(batch_id - 1))
        return carried.withColumn("_new", F.lit(False)).unionByName(fresh)

    def store(self, merged: DataFrame, batch_id: int) -> None:
        layout = lay_out(merged, self.keys, self.order, after=self.k)
        later = F.lead(F.lit(True), self.k).over(layout.window)
        last = layout.finish(layout.rows.withColumn("_later", later)).filter("_later is null")
        last.drop("_later", "_new").write.mode("overwrite").parquet(self._path(batch_id))


def anomaly_batch(carried: CarriedRows, sink, topside="topside", net="net", density="density",
                  cap: float = 200.0, max_step: float = 20.0):
    """``foreachBatch`` function: per-row flags with the step against the previous row of the station."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        merged = carried.merge(batch, batch_id)
        layout = lay_out(merged, carried.keys, carried.order, before=1)
        step = F.abs(col(topside) - F.lag(col(topside)).over(layout.window))
        rows = layout.finish(layout.rows.withColumn("step", step)).filter("_new").drop("_new")
        flags = {
            "negative_topside": col(topside) < 0, "negative_density": col(density) < 0,
            "extreme_tec": col(net) > cap, "massive_jump": F.col("step") > max_step,
        }
        rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
        sink(rows.withColumn("is_anomalous", is_anomalous()), batch_id)
        carried.store(merged, batch_id)
    return handle


def sequence_batch(carried: CarriedRows, sink, features: list[str]):
    """``foreachBatch`` function: a sequence of the last rows of the station for each new row.

    ``carried`` keeps one row less than the sequence length.
    """
    width = carried.k + 1

    def handle(batch: DataFrame, batch_id: int) -> None:
        merged = carried.merge(batch, batch_id)
        layout = lay_out(merged, carried.keys, carried.order, before=width - 1)
        span = layout.frame(-(width - 1), 0)
        cells = F.array(*[col(f).cast("double") for f in features])
        rows = layout.finish(layout.rows.withColumns({
            "x": F.collect_list(cells).over(span), "start_ts": F.first(col(carried.order[0])).over(span)}))
        full = rows.filter(F.col("_new") & (F.size("x") == width))
        sink(full.select(*[col(k) for k in carried.keys], "start_ts",
                         col(carried.order[0]).alias("end_ts"), "x"), batch_id)
        carried.store(merged, batch_id)
    return handle


def discovery_batch(discover, sink):
    """``foreachBatch`` function: run ``discover`` (frame -> frame) on each non-empty micro-batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            sink(discover(batch), batch_id)
    return handle


def validation_batch(checks: dict, sink):
    """``foreachBatch`` function: row count and failures of each check, one row per micro-batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        sink(batch.agg(F.count(F.lit(1)).alias("rows"),
                       *[F.count_if(cond).alias(k) for k, cond in checks.items()]), batch_id)
    return handle


def parquet_sink(path: str):
    """Write a batch's result to its own folder, so that a repeated batch replaces itself."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


# --- running -----------------------------------------------------------------------------------------

def run_available(stream: DataFrame, spark: SparkSession, name: str = "stream") -> DataFrame:
    """Process everything available now in append mode and return the written rows."""
    path = scratch_path(spark, name)
    stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/data").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(stream: DataFrame, spark: SparkSession, make_handler, name: str = "batches") -> DataFrame:
    """Run a ``foreachBatch`` monitor over everything available now and return the written rows.

    ``make_handler(state_root, sink)`` builds the batch function.
    """
    path = scratch_path(spark, name)
    handler = make_handler(f"{path}/state", parquet_sink(f"{path}/data"))
    stream.writeStream.foreachBatch(handler).option("checkpointLocation", f"{path}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/data")
