"""Scalar rules as Column expressions (no Python runs per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skywell.schema import LATITUDE_ZONES, SPACE_WEATHER, col

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


# --- parsing -----------------------------------------------------------------------------------

def parse_timestamp(c: Column, fmt: str | None = TIME_FORMAT) -> Column:
    """Timestamp or null when the text does not parse."""
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def year_day_hour(year: Column, day: Column, hour: Column) -> Column:
    """Timestamp of a (year, day-of-year, hour) triple; null when the day is not in the year."""
    first = F.make_date(year.cast("int"), F.lit(1), F.lit(1))
    date = F.date_add(first, (day - 1).cast("int"))
    ok = (day >= 1) & (F.year(date) == year)
    return F.when(ok, F.timestamp_seconds(
        F.unix_seconds(date.cast("timestamp")) + (hour * 3600).cast("long")
    ))


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def finite(c: Column) -> Column:
    """NaN and both infinities become null."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def is_infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c.cast("double")) == float("inf"), F.lit(False))


# --- fill values and units ---------------------------------------------------------------------

# Codes that mean "missing" in the hourly index feed.
KP_FILL = [99.0]
AP_FILL = [999.0, 9999.0]
INDEX_FILL = [999.0, 9999.0, 99999.0, 999.9, 99.9]


def mask_fill(c: Column, name: str, mode: str = "codes") -> Column:
    """Null the feed's fill codes: by code list of the column, or every value from 999 up."""
    if mode == "threshold":
        return F.when(c < 999, c)
    codes = KP_FILL if name == "Kp" else AP_FILL if name == "Ap" else INDEX_FILL
    return F.when(~c.isin(codes), c)


def kp_scale(c: Column) -> Column:
    return c / F.lit(10.0)


def clean_indices(df: DataFrame, mode: str = "codes", names=SPACE_WEATHER) -> DataFrame:
    """Numeric coercion, fill masking and Kp rescale of the index columns present."""
    present = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        if name.lower() in present:
            value = mask_fill(to_number(col(name)), name, mode)
            out[name] = kp_scale(value) if name == "Kp" else value
    return df.withColumns(out)


def in_range(c: Column, low: float | None, high: float | None) -> Column:
    """The value, or null when it lies outside the closed range (None = open end)."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return F.when(~bad, c)


def range_to_null(df: DataFrame, bounds: dict) -> DataFrame:
    present = {c.lower() for c in df.columns}
    return df.withColumns({
        name: in_range(to_number(col(name)), low, high)
        for name, (low, high) in bounds.items() if name.lower() in present
    })


def quality_gate(df: DataFrame, min_qf: float = 0, min_ff: float = 0.0) -> DataFrame:
    """Keep rows whose quality columns are null or reach the minimum."""
    keep = F.lit(True)
    for name, low in (("QF", min_qf), ("FF", min_ff)):
        if name.lower() in {c.lower() for c in df.columns}:
            v = to_number(col(name))
            keep = keep & (v.isNull() | (v >= low))
    return df.filter(keep)


# --- filters -----------------------------------------------------------------------------------

def only_stations(df: DataFrame, stations, key: str = "Station") -> DataFrame:
    """Whitelist by literal list or by a one-column frame; an empty list keeps everything."""
    if isinstance(stations, DataFrame):
        return df.join(stations.select(F.col(stations.columns[0]).alias(key)), key, "left_semi")
    return df.filter(col(key).isin(list(stations))) if stations else df


def between_days(df: DataFrame, start: str, end: str, ts: str = "Timestamp") -> DataFrame:
    """Start of the first day up to 23:59:59 of the last day, both included."""
    last = F.to_timestamp(F.lit(end)) + F.expr("interval 1 day") - F.expr("interval 1 second")
    t = col(ts).cast("timestamp")
    return df.filter((t >= F.to_timestamp(F.lit(start))) & (t <= last))


# --- calendar ----------------------------------------------------------------------------------

def season_from_zero(month: Column) -> Column:
    """December-February 0 up to September-November 3."""
    return F.floor((month % 12) / 3).cast("int")


def season_from_one(month: Column) -> Column:
    return F.floor((month % 12 + 3) / 3).cast("int")


def season_name(month: Column) -> Column:
    return F.when(month.between(1, 12), F.element_at(
        F.array(*[F.lit(s) for s in ("winter", "spring", "summer", "autumn")]),
        season_from_zero(month) + 1,
    )).otherwise("unknown")


def calendar(ts: Column) -> dict[str, Column]:
    return {
        "Hour": F.hour(ts),
        "Minute": F.minute(ts),
        "Month": F.month(ts),
        "DayOfYear": F.dayofyear(ts),
        "Week": F.weekofyear(ts),
    }


def weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def local_time(ts: Column, longitude: Column) -> Column:
    """Decimal solar hour in [0, 24), also for negative longitudes."""
    return F.pmod(F.hour(ts) + F.minute(ts) / 60.0 + longitude / 15.0, F.lit(24.0))


def local_hour(ts: Column, longitude: Column) -> Column:
    """Whole-hour offset truncated toward zero; the UTC hour when the longitude is unknown."""
    shift = (longitude / 15.0).cast("int")
    return F.coalesce(F.pmod(F.hour(ts) + shift, F.lit(24)), F.hour(ts)).cast("int")


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    angle = c * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


# --- classification ----------------------------------------------------------------------------

def first_match(cases, default) -> Column:
    """Value of the first case whose condition holds."""
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def latitude_zone(lat: Column) -> Column:
    return first_match([(lat.between(lo, hi), name) for name, lo, hi in LATITUDE_ZONES], "unknown")


# Fixed values: (name, warning level, Kp from, Dst down to).
STORM_LEVELS = [
    ("Extreme Storm", "CRITICAL", 8.0, -150.0),
    ("Strong Storm", "HIGH", 6.0, -80.0),
    ("Moderate Storm", "WARNING", 3.0, -30.0),
]


def storm_state(kp: Column, dst: Column) -> tuple[Column, Column]:
    """(category, warning level) of a window's highest Kp and lowest Dst."""
    cond = [(kp >= k) | (dst <= d) for _, _, k, d in STORM_LEVELS]
    names = first_match([(c, s[0]) for c, s in zip(cond, STORM_LEVELS)], "Quiet")
    levels = first_match([(c, s[1]) for c, s in zip(cond, STORM_LEVELS)], "NORMAL")
    return names, levels


def event_class(kp: Column, novel: Column) -> Column:
    return first_match([
        (novel, "Novel Event"), (kp >= 7.0, "Extreme Storm"),
        (kp >= 5.0, "Strong Storm"), (kp >= 4.0, "Moderate Storm"),
    ], "Quiet")


def storm_flags(kp: Column, dst: Column, storm_kp=50.0, quiet_kp=30.0, storm_dst=-50.0):
    """0/1 flags; the Kp limits default to the unscaled numbers the rule was written with."""
    storm = F.when((dst < storm_dst) | (kp >= storm_kp), 1).otherwise(0)
    quiet = F.when(kp <= quiet_kp, 1).otherwise(0)
    return storm, quiet


def difficulty_stage(kp: Column, dst: Column) -> Column:
    return first_match([
        ((kp <= 2) & (dst > -30), "quiet"), ((kp >= 6) & (dst < -80), "storm"),
    ], "moderate")


# --- physics -----------------------------------------------------------------------------------

DENSITY_PER_TEC = 0.1
DELAY_PER_TEC = 0.162


def physics_targets(top: Column, bottom: Column) -> dict[str, Column]:
    net = bottom + top
    return {"net": net, "density": net * DENSITY_PER_TEC, "delay": net * DELAY_PER_TEC}


def physics_target_sequences(label: Column, bottom_seq: Column) -> dict[str, Column]:
    """The window's single label spread over all its steps."""
    net = F.transform(bottom_seq, lambda b: b + label)
    return {
        "topside": F.transform(bottom_seq, lambda b: label),
        "net": net,
        "density": F.transform(net, lambda v: v * DENSITY_PER_TEC),
        "delay": F.transform(net, lambda v: v * DELAY_PER_TEC),
    }


def non_negative(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def at_least(floor: Column, c: Column) -> Column:
    return F.when(c.isNotNull() & floor.isNotNull(), F.greatest(floor, c))


def confidence(pred: Column, variance: Column) -> dict[str, Column]:
    half = F.lit(1.96) * F.sqrt(variance + 1e-6)
    score = F.exp(-variance)
    return {
        "confidence": score,
        "lower": pred - half,
        "upper": pred + half,
        "width": F.abs((pred + half) - (pred - half)),
        "review": score < 0.3,
    }


# Output name of each predicted delay column.
DELAY_NAMES = {
    "vertical_delay": "Vertical_Delay_m",
    "slant_delay": "Slant_Delay_m",
    "time_delay": "Time_Delay_ns",
    "gps_delay": "GPS_L1_Delay_m",
    "navic_delay": "NavIC_L5_Delay_m",
    "galileo_delay": "Galileo_E1_Delay_m",
    "beidou_delay": "BeiDou_B1_Delay_m",
}


def delay_record(df: DataFrame, keys: list[str]) -> DataFrame:
    """Named delay columns; an absent column or null value becomes 0."""
    have = set(df.columns)
    return df.select(*[col(k) for k in keys], *[
        (F.coalesce(col(src), F.lit(0.0)) if src in have else F.lit(0.0)).alias(out)
        for src, out in DELAY_NAMES.items()
    ])


def errors(y: Column, p: Column) -> dict[str, Column]:
    return {"error": p - y, "abs_error": F.abs(p - y), "sq_error": (p - y) * (p - y)}


# --- scenarios ---------------------------------------------------------------------------------

def scenarios(df: DataFrame, cases: list[dict], score, base_name: str = "base") -> DataFrame:
    """Rescore every row under each what-if case.

    A case is ``{"name": .., "set": {col: value}, "add": {col: delta}}``; ``score`` maps a dict of
    Columns to a Column.  Cases are literals, so they become an array per row, never a join.
    """
    inputs = {c: col(c) for c in df.columns}

    def changed(case):
        over = {k: F.lit(float(v)) for k, v in case.get("set", {}).items()}
        over.update({k: inputs[k] + float(v) for k, v in case.get("add", {}).items()})
        return {**inputs, **over}

    arms = F.array(*[
        F.struct(F.lit(c["name"]).alias("scenario"), score(changed(c)).alias("score")) for c in cases
    ])
    return (
        df.withColumn(base_name, score(inputs)).withColumn("_arm", F.explode(arms))
        .withColumn("scenario", F.col("_arm.scenario")).withColumn("score", F.col("_arm.score"))
        .withColumn("delta", F.col("score") - F.col(base_name)).drop("_arm")
    )


def ablate(df: DataFrame, groups: dict[str, list[str]], score) -> DataFrame:
    """Rescore with one named column group set to zero at a time."""
    cases = [{"name": g, "set": dict.fromkeys(cols, 0.0)} for g, cols in groups.items()]
    return scenarios(df, cases, score)


# --- column contracts --------------------------------------------------------------------------

def coerce_numeric(df: DataFrame, exclude=(), share: float = 0.80) -> DataFrame:
    """Turn text columns numeric where at least ``share`` of their non-null values survive.

    One aggregate pass decides; the rest is a projection.
    """
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"
            and f.name not in set(exclude)]
    if not text:
        return df
    stats = coercion_stats(df, text).collect()
    passing = [r["column"] for r in stats if r["n"] > 0 and r["n_numeric"] >= share * r["n"]]
    return df.withColumns({c: to_number(col(c)) for c in passing})


def coercion_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n non-null, n that parse as a number): one row per column."""
    wide = df.agg(*[
        F.struct(F.count(col(c)).alias("n"), F.count(to_number(col(c))).alias("n_numeric")).alias(c)
        for c in columns
    ])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c)["n"].alias("n"),
                 col(c)["n_numeric"].alias("n_numeric")) for c in columns
    ])).alias("r")).select("r.*")


TARGETS = ("topside", "net", "density", "delay")


def normalise_layout(df: DataFrame) -> DataFrame:
    """Bring nested ``targets`` structs and flat ``targets_*`` columns to flat columns."""
    have = set(df.columns)
    nested = set()
    if "targets" in have:
        nested = {f.name for f in df.schema["targets"].dataType.fields}
    out, used = {}, {"targets"} & have
    for t in TARGETS:
        forms = ([F.col(f"targets.{t}")] if t in nested else []) + (
            [F.col(f"targets_{t}")] if f"targets_{t}" in have else [])
        if forms:
            out[f"targets_{t}"] = reduce(lambda a, b: F.coalesce(a, b), forms)
    return df.withColumns(out).drop(*used)


def batch_report(df: DataFrame, sized: dict[str, str], required: list[str]) -> DataFrame:
    """Contract check of nested records: missing keys, and rows whose arrays differ in length.

    ``sized`` maps an array column to the array column whose length it must share.
    """
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(col(a).isNull()).alias(f"null:{a}") for a in required if a in df.columns],
        *[F.count_if(F.size(a) != F.size(b)).alias(f"size:{a}") for a, b in sized.items()],
    )
    cells = [F.struct(F.lit(c).alias("check"), col(c).alias("failures"))
             for c in counts.columns if c != "rows"]
    report = counts.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    if missing:
        gone = spark.range(1).select(F.explode(F.array(*[
            F.struct(F.lit(f"missing:{m}").alias("check"), F.lit(1).cast("long").alias("failures"))
            for m in missing])).alias("r")).select("r.*")
        report = report.unionByName(gone)
    return report
