"""Composed jobs: preparation, versioned datasets, evaluation, benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skywell.functions import rules
from skywell.operators import features, fills, joins, metrics, outliers, quality, scaling, sequences, splitting, stats
from skywell.operators.ordering import with_row
from skywell.schema import (
    FEED_BOUNDS, SPACE_WEATHER, Settings, col, complete, numeric_columns,
)
from skywell.session import durable, written
from skywell.sources import stores
from skywell.sources.text import conform


def merge_stations(obs: DataFrame, indices: DataFrame | None, catalogue: DataFrame) -> DataFrame:
    """All stations at once into the canonical table: hourly indices, coordinates, day and local time."""
    out = obs.filter(F.col("Timestamp").isNotNull())
    out = joins.join_hourly(out, indices)
    out = joins.attach_dimension(out, catalogue.select("Station", "Latitude", "Longitude"))
    ts = F.col("Timestamp")
    return conform(out.withColumns({
        "DayOfYear": F.dayofyear(ts).cast("double"),
        "LocalTime": rules.local_time(ts, F.col("Longitude")),
    }))


def synchronise(a: DataFrame, b: DataFrame, columns: list[str], on: str = "Timestamp", keys=(),
                limit: int = 3, hold: int = 2, chunk_rows: int | None = None) -> DataFrame:
    """Outer join in time, time-weighted interpolation, forward fill, then complete rows only."""
    joined = joins.outer_in_time(a, b, on, keys)
    out = fills.fill_gaps(joined, columns, "time", limit, keys, [on], chunk_rows)
    out = fills.fill_gaps(out, columns, "ffill", hold, keys, [on], chunk_rows)
    return complete(out, out.columns)


def preprocess(df: DataFrame, settings: Settings = Settings(), identity=("Station", "Timestamp"),
               order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Infinities, gaps, outliers, split, scaling: (rows with ``split``, scaler parameters).

    The filled, the treated and the split table are written once each, because quantiles, masks, boundaries
    and scaler each read them several times, and their plans would multiply.
    """
    order = order or list(dict.fromkeys(["Timestamp", "Station", *identity]))
    numeric = numeric_columns(df, identity)
    df = df.withColumns({c: rules.finite(col(c)) for c in numeric})
    df = fills.handle_missing(df, settings.fill_strategy, settings.fill_limit, settings.fill_fallback, numeric,
                              ["Station"], [*dict.fromkeys(["Timestamp", *[c for c in identity if c != "Station"]])])
    df = written(df, "filled")
    df = written(outliers.treat_outliers(df, settings, identity), "treated")
    df = written(splitting.SPLIT_STRATEGIES[settings.split_strategy](
        df, order, "Station", settings.seed, settings.split), "split")
    scaled = scaling.eligible(df, [*settings.scale_exclude, *identity])
    params = durable(scaling.fit_scaler(df, scaled, settings.scaler, F.col("split") == "train"))
    return scaling.transform(df, params, scaled), params


def prepare(df: DataFrame, target: str, feature_columns: list[str], settings: Settings = Settings(),
            identity=("Station", "Timestamp"), features_first: bool = False) -> dict[str, DataFrame]:
    """End-to-end preparation: report, splits with features, window descriptors, scaler.

    By default features are derived after scaling and inside each split, as the original order has
    it; ``features_first`` derives them on the unscaled series.
    """
    report = quality.validate(df, settings.bounds, settings.max_null_fraction, settings.max_duplicate_fraction)
    order = list(dict.fromkeys(["Timestamp", *[c for c in identity if c != "Station"]]))
    if features_first:
        df = features.feature_pipeline(df, name=target, order=order)
    rows, params = preprocess(df, settings, identity)
    if not features_first:
        rows = features.feature_pipeline(rows, name=target, keys=["split", "Station"], order=order)
    plan = sequences.window_plan(rows, feature_columns, target, settings.window_hours, settings,
                                 ["split", "Station"], order)
    return {"report": report, "roll_up": quality.roll_up(report), "rows": rows, "scaler": params, "windows": plan}


def export_preparation(result: dict[str, DataFrame], root: str, feature_columns, target,
                       settings: Settings = Settings()) -> None:
    """Write splits, scaler, sequences of the default window and the metadata record."""
    stores.write_splits(result["rows"], f"{root}/splits")
    stores.save_scaler(result["scaler"], f"{root}/scaler")
    seq = sequences.sequences(result["rows"], feature_columns, target,
                              settings.steps(settings.default_window_hours), settings.stride,
                              settings.min_completeness, keys=["split", "Station"])
    stores.write_sequences(seq, f"{root}/sequences")
    stores.save_json(stores.metadata(result["rows"], feature_columns, [target],
                                     settings.steps(settings.default_window_hours), 0), f"{root}/metadata")


def clean_feeds(giro: DataFrame, omni: DataFrame, station: DataFrame | None = None, min_qf: float = 0,
                min_ff: float = 0.0, settings: Settings = Settings(), keys=()) -> DataFrame:
    """Gate and range-null both feeds, then attach the nearest index row within the tolerance."""
    giro = rules.range_to_null(rules.quality_gate(giro, min_qf, min_ff), FEED_BOUNDS)
    omni = rules.range_to_null(rules.clean_indices(omni, "threshold"), FEED_BOUNDS)
    out = joins.asof_nearest(giro, omni, "Timestamp", settings.asof_tolerance_minutes * 60.0, keys)
    return joins.attach_dimension(out, station) if station is not None else out


def flag_features(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Calendar, integer local time, cyclic and flag columns of the versioned build."""
    t = col(ts)
    out = df.withColumns(rules.calendar(t)).withColumns({
        "LocalTime": rules.local_hour(t, F.col("Longitude")), "WeekendFlag": rules.weekend(t),
        "Season": rules.season_from_one(F.month(t)),
    })
    storm, quiet = rules.storm_flags(F.col("Kp"), F.col("Dst"))
    s1, c1 = rules.cyclic(F.col("DayOfYear"), 365.25)
    s2, c2 = rules.cyclic(F.col("LocalTime"), 24.0)
    return out.withColumns({"Sin(DayOfYear)": s1, "Cos(DayOfYear)": c1, "Sin(LocalTime)": s2,
                            "Cos(LocalTime)": c2, "StormFlag": storm, "QuietFlag": quiet})


def fill_build(df: DataFrame, columns: list[str], start: str, end: str, settings: Settings = Settings(),
               key: str = "Station", tie: tuple[str, ...] = ()) -> DataFrame:
    """Date range, first row per time, forward interpolation up to the modal-step limit, driver hold."""
    df = rules.between_days(df, start, end)
    # The merged rows feed the modal step and both fills: keep them instead of merging three times.
    df = durable(fills.keep_first(df, [key, "Timestamp"], list(tie) or ["Timestamp"]))
    step = fills.modal_step(df, [key], ["Timestamp"])
    limits = step.select(col(key), fills.step_limit(F.col("step_seconds"), settings.interpolation_hours).alias("_limit"))
    df = df.join(joins.broadcast_if_small(limits), key, "left")
    limit = F.coalesce(F.col("_limit"), F.lit(12))
    df = fills.fill_gaps(df, columns, "linear", limit, [key], ["Timestamp"]).drop("_limit")
    held = [c for c in SPACE_WEATHER if c in columns]
    return fills.fill_gaps(df, held, "ffill", settings.driver_fill_limit, [key], ["Timestamp"]) if held else df


def build_dataset(giro: DataFrame, omni: DataFrame, start: str, end: str, features_in: list[str],
                  targets: list[str], root: str, settings: Settings = Settings(), scaler: str = "standard",
                  key: str = "Station", tie: tuple[str, ...] = ()) -> dict[str, DataFrame | str]:
    """Versioned dataset: merge, features, fill, split, scale on train, windows, write, reports, commit.

    The manifest is written last; a build that ends before it leaves the older version the latest one. Reports
    cover both sources and the windows written of each target.
    """
    merged = flag_features(clean_feeds(giro, omni, settings=settings))
    rows = durable(fill_build(merged, features_in, start, end, settings, key, tie))
    spark = rows.sparkSession
    empty = [r["column"] for r in quality.empty_columns(rows, features_in).collect()]
    use = [f for f in features_in if f not in empty]
    targets = [t for t in targets if t not in empty]
    split = splitting.split_ordered(rows, ["Timestamp", key], *settings.split, truncate_sum=True)
    scaled, f_params, t_params = scaling.fit_on_train(split, use, targets, scaler)
    version = stores.write_version(scaled, root, commit=False)
    part = lambda name: f"{root}/{version}/{name}"
    done = spark.read.parquet(part("data"))
    stores.save_scaler(f_params, part("feature_scaler"))
    stores.save_scaler(t_params, part("target_scaler"))
    parts = ["data", "feature_scaler", "target_scaler", "feeds"]
    for at, t in enumerate(targets):
        ahead = sequences.sequences_ahead(done, use, t, settings.build_window, settings.horizon, keys=["split", key])
        ahead.withColumn("target", F.lit(t)).write.mode("append" if at else "overwrite").parquet(part("sequences"))
    seq = spark.read.parquet(part("sequences")) if targets else None
    parts += ["sequences"] if targets else []
    feeds = durable(quality.feed_report(giro, 0, 0.0, FEED_BOUNDS).withColumn("source", F.lit("ionosonde")).unionByName(
        quality.feed_report(omni, 0, 0.0, FEED_BOUNDS).withColumn("source", F.lit("indices"))))
    feeds.write.parquet(part("feeds"))
    lost = feeds.filter("source = 'ionosonde'").first()
    score = quality.quality_score(rows, lost["dropped_quality"], lost["initial_rows"])
    stores.save_json(stores.metadata(done, use, targets, settings.build_window, settings.horizon), part("metadata"))
    stores.save_json(with_row(score, quality.storm_population(rows)), part("quality"))
    stores.commit_version(spark, root, version, parts)
    return {"version": version, "rows": done, "sequences": seq, "feeds": feeds, "score": score}


def evaluate(predictions: DataFrame, physics: DataFrame | None = None, ours: str | None = None,
             keys=("station",), order=("ts",)) -> dict[str, DataFrame]:
    """Metrics whole and by stratum, station spread, gap, storm factor and the composite score."""
    p = predictions.filter(F.col("model") == ours) if ours else predictions
    p = written(p, "predictions")
    whole = metrics.metrics(p, ["model"])
    storm = metrics.metrics_by(p, "storm", ["model"])
    gap = metrics.generalisation_gap(p, ["model"])
    factor = metrics.storm_degradation(storm, ["model"])
    out = {
        "metrics": whole, "storm": storm, "gap": gap, "degradation": factor,
        "latitude": metrics.metrics_by(p, "latitude_thirds", ["model"]),
        "season": metrics.metrics_by(p, "season_hemisphere", ["model"]),
        "spread": metrics.station_spread(p, keys[0], ["model"]),
    }
    adherence = F.lit(None).cast("double")
    parts = whole.select("model", "r2").join(gap.select("model", "gap_pct"), "model", "left").join(factor, "model", "left")
    if physics is not None:
        out["physics"] = metrics.physics_score(physics, keys, order)
        parts = with_row(parts, out["physics"].select("physics_score"))
        adherence = F.col("physics_score")
    out["score"] = parts.select("model", metrics.scientific_score(
        F.col("r2"), adherence, F.col("gap_pct"), F.col("storm_degradation_factor")).alias("scientific_score"))
    return out


def benchmark(predictions: DataFrame, ours: str, key: str = "event_id") -> dict[str, DataFrame]:
    """All models against ``ours``: comparison, tests against the best other model, figure data.

    ``key`` names the observation that several models predict.
    """
    p = written(predictions, "predictions")
    per_model = metrics.metrics(p, ["model"])
    comparison = durable(metrics.compare(per_model, ours))
    best = comparison.filter("is_best_baseline").select("model").first()["model"]
    pair = p.filter(F.col("model").isin(ours, best)).groupBy(col(key)).agg(
        F.max("y_true").alias("y_true"),
        F.max(F.when(F.col("model") == ours, F.col("y_pred"))).alias("pred_a"),
        F.max(F.when(F.col("model") == best, F.col("y_pred"))).alias("pred_b"))
    two = p.filter(F.col("model").isin(ours, best))
    return {"comparison": comparison, "tests": stats.all_tests(pair), "taylor": metrics.taylor(p),
            "boxes": metrics.box_stats(two),
            "strata": metrics.metrics_by(p, "activity", ["model"]).unionByName(
                metrics.metrics_by(p, "solar_cycle", ["model"]))}
