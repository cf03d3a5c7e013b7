"""Data-quality checks: every check of a table comes out of one wide aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skywell.functions.rules import is_infinite, to_number
from skywell.operators.features import time_deltas
from skywell.operators.ordering import quantiles, with_row
from skywell.schema import OBSERVATION_COLUMNS, PHYSICAL_BOUNDS, col, numeric_columns

def _long(wide: DataFrame, cells: list[dict[str, Column]]) -> DataFrame:
    return wide.select(F.explode(F.array(*[
        F.struct(*[v.alias(k) for k, v in cell.items()]) for cell in cells
    ])).alias("r")).select("r.*")


def frame_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, null cells and their percentage."""
    nulls = sum((col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("n_null"),
    ).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_null",
        (F.col("n_null") * 100.0
         / F.greatest(F.col("n_rows") * len(df.columns), F.lit(1))).alias("null_pct"),
    )


def _null_counts(df: DataFrame, columns) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(col(c).isNull()).alias(f"n:{c}") for c in columns])


def missing_report(df: DataFrame, columns=None, ok: float = 0.05, warn: float = 0.30) -> DataFrame:
    """(column, n_missing, fraction, status) of each column."""
    columns = columns or df.columns
    share = lambda c: col(f"n:{c}") / F.greatest(F.col("_rows"), F.lit(1))
    return _long(_null_counts(df, columns), [{
        "column": F.lit(c), "n_missing": col(f"n:{c}"), "fraction": share(c),
        "status": F.when(share(c) == 0, "CLEAN").when(share(c) <= ok, "OK")
                   .when(share(c) <= warn, "WARN").otherwise("HIGH"),
    } for c in columns])


def empty_columns(df: DataFrame, columns=None) -> DataFrame:
    """Names of columns with no value at all."""
    columns = columns or df.columns
    return _long(_null_counts(df, columns), [
        {"column": F.lit(c), "empty": col(f"n:{c}") == F.col("_rows")} for c in columns
    ]).filter("empty").select("column")


def describe(df: DataFrame, columns=None) -> DataFrame:
    """count, mean, std, min, P1, P25, P50, P75, P99, max of each numeric column."""
    columns = columns or numeric_columns(df)
    probs = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    base = df.agg(*[
        f(col(c)).alias(f"{n}:{i}") for i, c in enumerate(columns) for n, f in (
            ("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ])
    q = quantiles(df, {f"q{i}": col(c) for i, c in enumerate(columns)}, list(probs.values()))
    wide = with_row(base, q)
    return _long(wide, [{
        "column": F.lit(c),
        **{n: col(f"{n}:{i}").cast("long" if n == "count" else "double")
           for n in ("count", "mean", "std", "min")},
        **{n: F.col(f"q{i}__{j}") for j, n in enumerate(probs)},
        "max": col(f"max:{i}").cast("double"),
    } for i, c in enumerate(columns)])


def station_counts(df: DataFrame, key: str = "Station", top: int | None = 10) -> DataFrame:
    """Rows per station, largest first (ties by station)."""
    counts = df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("n_rows"))
    if top is None:
        return counts
    return counts.orderBy(F.col("n_rows").desc(), col(key)).limit(top)


def coverage(df: DataFrame, key: str = "Station", ts: str = "Timestamp") -> DataFrame:
    """Distinct stations, first and last time, span in days."""
    return df.agg(
        F.countDistinct(col(key)).alias("n_stations"), F.min(col(ts)).alias("first_ts"),
        F.max(col(ts)).alias("last_ts"),
    ).withColumn("span_days", F.datediff("last_ts", "first_ts").cast("long"))


# --- checks ------------------------------------------------------------------------------------

def missing_required(df: DataFrame, required=OBSERVATION_COLUMNS) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def _stated(df: DataFrame, check: str, severity: str, message: str, cols: list[str]) -> DataFrame:
    """A report row that follows from the schema alone."""
    return df.sparkSession.range(1).select(
        _issue(F.lit(True), severity, check, F.lit(message), F.lit(0), cols).alias("r")).select("r.*")


def required_report(df: DataFrame, required=OBSERVATION_COLUMNS) -> DataFrame:
    gone = missing_required(df, required)
    if gone:
        issue = ("ERROR", f"Required but absent: {', '.join(gone)}", gone)
    else:
        issue = ("INFO", f"Found each of the {len(required)} columns.", [])
    return _stated(df, "RequiredColumns", *issue)


def type_report(df: DataFrame, required=OBSERVATION_COLUMNS) -> DataFrame:
    """Measured columns that are still text."""
    numeric = {c.lower() for c in numeric_columns(df)}
    text = [c for c in required if c not in ("Timestamp", "Station") and c in df.columns
            and c.lower() not in numeric]
    return _stated(df, "DataTypes", "WARNING", f"Columns not numeric: {text}", text).filter(
        F.lit(bool(text)))


def _issue(when: Column, severity, check: str, message: Column, rows: Column, cols: list[str]):
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(when, F.struct(
        severity.alias("severity"), F.lit(check).alias("check"), message.alias("message"),
        rows.cast("long").alias("affected_rows"),
        F.array(*[F.lit(c) for c in cols]).cast("array<string>").alias("affected_cols"),
    ))


def _measures(df: DataFrame, bounds: dict) -> dict[str, Column]:
    """Every count the value checks need, keyed by name."""
    have = {c.lower() for c in df.columns}
    num = lambda c: to_number(col(c)) if dict(df.dtypes).get(c) == "string" else col(c).cast("double")
    out = {"rows": F.count(F.lit(1))}
    for c in df.columns:
        out[f"null:{c}"] = F.count_if(col(c).isNull())
    for c in numeric_columns(df):
        out[f"inf:{c}"] = F.count_if(is_infinite(col(c)))
    for c, (lo, hi) in bounds.items():
        if c.lower() in have:
            out[f"low:{c}"] = F.count_if(num(c) < lo)
            out[f"high:{c}"] = F.count_if(num(c) > hi)
    for c in ("TEC", "TopsideTEC"):
        if c.lower() in have:
            out[f"neg:{c}"] = F.count_if(num(c) < 0)
    if {"b0", "hmf2"} <= have:
        out["b0_hmf2"] = F.count_if(num("B0") > num("hmF2"))
    if {"topsidetec", "tec"} <= have:
        out["ratio"] = F.count_if(F.try_divide(num("TopsideTEC"), F.nullif(num("TEC"), F.lit(0.0))) > 10)
    if "qf" in have:
        out["qf_null"] = F.count_if(num("QF").isNull())
        out["qf_poor"] = F.count_if(num("QF") >= 3)
    return out


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows, and their share."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_duplicates"),
    ).withColumn("fraction", F.col("n_duplicates") / F.greatest(F.col("n_rows"), F.lit(1)))


def duplicate_keys(df: DataFrame, keys=("Station", "Timestamp")) -> DataFrame:
    """Number of rows beyond the first of each key and of keys that repeat."""
    groups = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_duplicates"),
        F.count_if(F.col("_copies") > 1).alias("n_repeated_keys"),
    )


def timestamp_report(df: DataFrame, arrival: str | None = None, keys=("Station",),
                     ts: str = "Timestamp", **options) -> DataFrame:
    """Null times, reversals in arrival order and gaps over 24 h: one row of counts."""
    marked = time_deltas(df, keys, [ts], arrival, **options)
    return marked.agg(
        F.count_if(col(ts).isNull()).alias("n_null"),
        F.count_if("is_reversal").alias("n_reversals"),
        F.count_if("is_gap").alias("n_gaps"),
    )


def value_report(df: DataFrame, bounds=PHYSICAL_BOUNDS, max_null: float = 0.30,
                 column_null: float = 0.10) -> DataFrame:
    """Issues of the coordinate, null, infinity, bounds, sign, foF2, cross-column and quality checks."""
    measures = _measures(df, bounds)
    names = {k: f"m{i}" for i, k in enumerate(measures)}
    wide = df.agg(*[v.alias(names[k]) for k, v in measures.items()])
    m = {k: F.col(v) for k, v in names.items()}
    rows = F.greatest(m["rows"], F.lit(1))
    say = lambda text, *args: F.format_string(text, *args)
    issues = []
    for c, (lo, hi) in (("Latitude", (-90.0, 90.0)), ("Longitude", (-180.0, 180.0))):
        if f"low:{c}" in m:
            bad = m[f"low:{c}"] + m[f"high:{c}"]
            issues.append(_issue(bad > 0, "ERROR", "Coordinates",
                                 say(f"{c}: %d values outside [{lo}, {hi}].", bad), bad, [c]))
    nulls = sum((m[f"null:{c}"] for c in df.columns), F.lit(0))
    share = nulls / (rows * len(df.columns))
    issues.append(_issue(share > max_null, "ERROR", "NaNValues",
                         say("Null fraction %.4f exceeds the limit.", share), nulls, []))
    for c in df.columns:
        frac = m[f"null:{c}"] / rows
        issues.append(_issue(frac > column_null, "WARNING", "NaNValues",
                             say(f"Column '{c}' has %d nulls.", m[f"null:{c}"]), m[f"null:{c}"], [c]))
    inf_cols = [c for c in numeric_columns(df)]
    for c in inf_cols:
        issues.append(_issue(m[f"inf:{c}"] > 0, "ERROR", "InfiniteValues",
                             say(f"%d infinite values in '{c}'.", m[f"inf:{c}"]), m[f"inf:{c}"], [c]))
    for c, (lo, hi) in bounds.items():
        if f"low:{c}" in m:
            bad = m[f"low:{c}"] + m[f"high:{c}"]
            level = F.when(bad / rows > 0.10, "ERROR").otherwise("WARNING")
            issues.append(_issue(bad > 0, level, "PhysicalBounds",
                                 say(f"'{c}': %d values outside [{lo}, {hi}].", bad), bad, [c]))
    for c in ("TEC", "TopsideTEC"):
        if f"neg:{c}" in m:
            issues.append(_issue(m[f"neg:{c}"] > 0, "ERROR", "NegativeTEC",
                                 say(f"'{c}': %d negative values.", m[f"neg:{c}"]), m[f"neg:{c}"], [c]))
    if "low:foF2" in m:
        low, high = m["low:foF2"], m["high:foF2"]
        issues.append(_issue(low + high > 0, "WARNING", "FoF2Range",
                             say("foF2 out of range: %d below, %d above.", low, high),
                             low + high, ["foF2"]))
    if "b0_hmf2" in m:
        issues.append(_issue(m["b0_hmf2"] > 0, "WARNING", "CrossColumnConsistency",
                             say("%d rows have a B0 beyond their hmF2.", m["b0_hmf2"]), m["b0_hmf2"], ["B0", "hmF2"]))
    if "ratio" in m:
        issues.append(_issue(m["ratio"] > 0, "WARNING", "CrossColumnConsistency",
                             say("%d rows have more than ten times TEC in TopsideTEC.", m["ratio"]),
                             m["ratio"], ["TopsideTEC", "TEC"]))
    if "qf_null" in m:
        issues.append(_issue(m["qf_null"] > 0, "WARNING", "QualityFlags",
                             say("%d rows carry no QF.", m["qf_null"]), m["qf_null"], ["QF"]))
        issues.append(_issue(m["qf_poor"] / rows > 0.20, "WARNING", "QualityFlags",
                             say("%d records have QF of 3 or more.", m["qf_poor"]), m["qf_poor"], ["QF"]))
    return wide.select(F.explode(F.array_compact(F.array(*issues))).alias("r")).select("r.*")


def validate(df: DataFrame, bounds=PHYSICAL_BOUNDS, max_null=0.30, max_duplicates=0.05,
             arrival: str | None = None) -> DataFrame:
    """The whole report: schema checks, value checks, time checks and duplicate rows."""
    report = required_report(df).unionByName(type_report(df)).unionByName(
        value_report(df, bounds, max_null))
    if {"Station", "Timestamp"} <= set(df.columns):
        t = timestamp_report(df, arrival)
        cells = [("ERROR", "n_null", "%d null timestamps."),
                 ("WARNING", "n_reversals", "%d timestamp reversals."),
                 ("WARNING", "n_gaps", "%d time gaps over 24 hours.")]
        report = report.unionByName(t.select(F.explode(F.array_compact(F.array(*[
            _issue(F.col(n) > 0, sev, "Timestamp", F.format_string(text, F.col(n)), F.col(n), ["Timestamp"])
            for sev, n, text in cells
        ]))).alias("r")).select("r.*"))
    d = duplicate_rows(df)
    level = F.when(F.col("fraction") > max_duplicates, "ERROR").otherwise("WARNING")
    report = report.unionByName(d.select(_issue(
        F.col("n_duplicates") > 0, level, "DuplicateRows",
        F.format_string("%d duplicate rows.", F.col("n_duplicates")), F.col("n_duplicates"), [],
    ).alias("r")).filter("r is not null").select("r.*"))
    return report


def roll_up(report: DataFrame) -> DataFrame:
    """passed (no ERROR), number of errors and warnings."""
    return report.agg(
        F.count_if(F.col("severity") == "ERROR").alias("n_errors"),
        F.count_if(F.col("severity") == "WARNING").alias("n_warnings"),
    ).select((F.col("n_errors") == 0).alias("passed"), "n_errors", "n_warnings")


# --- dataset-build reports ---------------------------------------------------------------------

def feed_report(df: DataFrame, min_qf: float, min_ff: float, bounds: dict) -> DataFrame:
    """Rows the quality gate drops, and null cells left in the ranged columns after nulling."""
    have = {c.lower() for c in df.columns}
    keep = F.lit(True)
    for name, low in (("QF", min_qf), ("FF", min_ff)):
        if name.lower() in have:
            keep = keep & (to_number(col(name)).isNull() | (to_number(col(name)) >= low))
    lost = F.lit(0)
    for name, (lo, hi) in bounds.items():
        if name.lower() in have:
            v = to_number(col(name))
            inside = F.lit(True)
            if lo is not None:
                inside = inside & (v >= lo)
            if hi is not None:
                inside = inside & (v <= hi)
            lost = lost + F.when(v.isNotNull() & inside, 0).otherwise(1)
    return df.agg(
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(~keep).alias("dropped_quality"),
        F.coalesce(F.sum(F.when(keep, lost)), F.lit(0)).alias("null_after_ranges"),
    )


def storm_population(df: DataFrame, dst: str = "Dst") -> DataFrame:
    c = col(dst)
    return df.agg(
        F.count_if(c > -30).alias("quiet"),
        F.count_if((c <= -30) & (c > -50)).alias("moderate"),
        F.count_if((c <= -50) & (c > -100)).alias("strong"),
        F.count_if(c <= -100).alias("extreme"),
    )


def quality_score(df: DataFrame, dropped_quality: Column | int = 0, initial_rows: Column | int = 1,
                  columns=None) -> DataFrame:
    """100 less 30 x null share, 20 below 100 rows and 10 x dropped share, never under 0."""
    columns = columns or df.columns
    nulls = sum((col(c).isNull().cast("long") for c in columns), F.lit(0))
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("n_null"))
    cells = F.col("n_rows") * len(columns)
    ratio = F.when(cells > 0, F.col("n_null") / cells).otherwise(1.0)
    lost = F.lit(dropped_quality) / F.greatest(F.lit(initial_rows), F.lit(1))
    score = 100 - ratio * 30 - F.when(F.col("n_rows") < 100, 20).otherwise(0) - lost * 10
    return base.select("n_rows", "n_null", (1.0 - ratio).alias("completeness"),
                       F.greatest(F.lit(0.0), F.round(score, 2)).alias("score"))
