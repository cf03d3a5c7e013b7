"""Text feeds: scaled ionosonde listings, hourly index listings, CSV tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skywell.functions.rules import TIME_FORMAT, clean_indices, finite, parse_timestamp, to_number, year_day_hour
from skywell.operators.joins import broadcast_if_small
from skywell.schema import (
    BASELINE_FILES, IONOSONDE, OBSERVATION_COLUMNS, SPACE_WEATHER, STATIONS, col,
)
from skywell.session import written


# --- CSV observations ------------------------------------------------------------------------------

def read_observations(spark: SparkSession, path, fmt: str | None = TIME_FORMAT, typed: bool = True) -> DataFrame:
    """One CSV file, a list of them, or every ``*.csv`` of a directory; columns go by header name.

    Files read together share one header.  Absent columns are null; times that do not parse and
    cells that are no number become null when ``typed``.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, pathGlobFilter="*.csv")
    raw = raw.select(*[col(c) if c in raw.columns else F.lit(None).cast("string").alias(c)
                       for c in OBSERVATION_COLUMNS])
    if not typed:
        return raw
    out = {"Timestamp": parse_timestamp(F.col("Timestamp"), fmt)}
    out.update({c: to_number(col(c)) for c in OBSERVATION_COLUMNS[2:]})
    return raw.withColumns(out)


def stations(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Built-in station catalogue, or a CSV keyed by its ``URSI`` column."""
    if path:
        cat = spark.read.csv(path, header=True).withColumnRenamed("URSI", "Station")
        return cat.withColumns({c: to_number(F.col(c)) for c in ("Latitude", "Longitude")})
    rows = F.array(*[F.struct(F.lit(a).alias("Station"), F.lit(b).alias("Latitude"),
                              F.lit(c).alias("Longitude"), F.lit(d).alias("Name")) for a, b, c, d in STATIONS])
    return spark.range(1).select(F.explode(rows).alias("s")).select("s.*")


# --- scaled ionosonde text -------------------------------------------------------------------------

def read_scaled(spark: SparkSession, path) -> DataFrame:
    """Lines of scaled-text files: ``source`` (file), ``station`` (file name up to the first _ or .), ``line``."""
    name = F.element_at(F.split(F.col("source"), "/"), -1)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("line")
    ).withColumn("station", F.split(name, "[_.]")[0])


def parse_scaled(lines: DataFrame, wanted=IONOSONDE) -> DataFrame:
    """Scaled-text lines to observations.

    Each source's ``# Time`` line names its columns; a ``QD`` column is named after the one before
    it.  Other ``#`` lines and blank lines are dropped.  Columns a source lacks are null.
    """
    text = F.trim(F.col("line"))
    is_head = F.col("line").startswith("# Time")
    head = F.filter(F.split(F.regexp_replace("line", "^#+", ""), "\\s+"), lambda t: t != "")
    names = F.transform(F.col("_h"), lambda t, i: F.when(
        (t == "QD") & (i > 0), F.concat(F.col("_h")[F.greatest(i - 1, F.lit(0))], F.lit("_QD"))).otherwise(t))
    heads = lines.filter(is_head).groupBy("source").agg(F.max("line").alias("line")).withColumn(
        "_h", head).select("source", names.alias("_names"))
    data = lines.filter(~F.col("line").startswith("#") & (text != "")).withColumn(
        "_cells", F.split(text, "\\s+"))
    rows = data.join(broadcast_if_small(heads), "source")

    def cell(name: str) -> Column:
        at = F.array_position("_names", name).cast("int")
        return F.when(at > 0, F.get(F.col("_cells"), at - 1))

    return rows.select(
        F.col("station").alias("Station"), F.try_to_timestamp(cell("Time")).alias("Timestamp"),
        *[to_number(cell(w)).alias(w) for w in wanted],
    )


# --- hourly index listing --------------------------------------------------------------------------

# Default column names of the index listing.
LISTING_COLUMNS = ["YEAR", "DOY", "Hour", "Kp", "SSN", "Dst", "Ap", "F10.7"]
# Canonical name by the first text found in a lower-cased header name.
LISTING_RULES = [
    ("Kp", ["kp"]), ("SSN", ["sunspot", "r (", "r sunspot"]), ("Dst", ["dst"]), ("Ap", ["ap"]),
    ("F10.7", ["f10.7", "solar index"]), ("YEAR", ["year"]), ("DOY", ["doy", "day"]), ("Hour", ["hour", "hr"]),
]
# Names used by the second feed.
FIXED_NAMES = {"Kp index": "Kp", "ap_index, nT": "Ap", "Dst-index, nT": "Dst", "R (Sunspot No.)": "SSN",
               "f10.7_index": "F10.7"}


def canonical_name(name: str) -> str:
    """Canonical column of a listing header name; unknown names stay."""
    if name in FIXED_NAMES:
        return FIXED_NAMES[name]
    low = name.lower()
    return next((out for out, parts in LISTING_RULES if any(p in low for p in parts)), name)


def format_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of a format file with lines ``<n> <name> <format>``; the default when none match."""
    # A number, a name that may hold blanks, and a last word such as I4, F6.1 or A10.
    shape = r"^[ \t]*([0-9]+)[ \t]+(\S.*?)[ \t]+[A-Z][0-9]+(?:\.[0-9]+)?[ \t]*$"
    found = spark.read.text(path).filter(F.col("value").rlike(shape)).select(
        F.regexp_extract("value", shape, 1).cast("int").alias("n"),
        F.trim(F.regexp_extract("value", shape, 2)).alias("name")).orderBy("n").collect()  # one row per column
    return [row["name"] for row in found] or LISTING_COLUMNS


def parse_listing(lines: DataFrame, columns=LISTING_COLUMNS, mode: str = "codes") -> DataFrame:
    """Whitespace columns to (Timestamp, indices): names normalised, fill codes nulled, Kp / 10."""
    names = [canonical_name(c) for c in columns]
    cells = F.split(F.trim(F.col("line")), "\\s+")
    rows = lines.filter(F.trim(F.col("line")) != "").select(cells.alias("_cells")).select(
        *[to_number(F.get("_cells", F.lit(i))).alias(n) for i, n in enumerate(names)])
    at = year_day_hour(F.col("YEAR"), F.col("DOY"), F.col("Hour"))
    keep = [c for c in SPACE_WEATHER if c in names]
    return clean_indices(rows.select(at.alias("Timestamp"), *[col(c) for c in keep]), mode, keep)


def read_listing(spark: SparkSession, path, fmt_path: str | None = None, mode: str = "codes") -> DataFrame:
    columns = format_columns(spark, fmt_path) if fmt_path else LISTING_COLUMNS
    return parse_listing(spark.read.text(path).select(F.col("value").alias("line")), columns, mode)


# --- baseline predictions --------------------------------------------------------------------------

def read_baselines(spark: SparkSession, directory: str, names=None) -> DataFrame:
    """(model, idx, y_pred) of the registered prediction files present; the row order is the key.

    A prediction file may also be a folder of that name, as Spark writes it.
    """
    files = {f: m for m, f in BASELINE_FILES.items() if names is None or m in names}
    unknown = set(names or []) - set(BASELINE_FILES)
    if unknown:
        raise ValueError(f"unknown baselines: {sorted(unknown)}")
    raw = spark.read.csv(directory, header=True, schema="predicted_tec string", recursiveFileLookup=True).select(
        "predicted_tec", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"))
    to_model = F.create_map(*[F.lit(v) for pair in files.items() for v in pair])
    known = F.array(*[F.lit(f) for f in files])
    part = F.array_intersect(F.split("_file", "/"), known)
    rows = raw.withColumn("model", F.try_element_at(to_model, F.try_element_at(part, F.lit(-1))))
    # Rows of one block keep their order and are numbered without a gap; blocks follow each other by file name and offset.
    rows = written(rows.filter("model is not null").select(
        "model", F.concat_ws(" ", "_file", F.lpad(F.col("_block").cast("string"), 20, "0")).alias("_place"),
        F.monotonically_increasing_id().alias("_line"), finite(to_number(F.col("predicted_tec"))).alias("y_pred")), "baselines")
    places = rows.groupBy("model", "_place").agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
    earlier = Window.partitionBy("model").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    places = places.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(places), ["model", "_place"]).select(
        "model", (F.col("_base") + F.col("_line") - F.col("_first")).alias("idx"), "y_pred")


# --- shaping -----------------------------------------------------------------------------------------

def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """First days of the months from ``start`` to ``end``: (month, year, month_of_year)."""
    step = F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"),
                      F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(step).alias("month")).select(
        "month", F.year("month").alias("year"), F.month("month").alias("month_of_year"))


def conform(df: DataFrame, columns=OBSERVATION_COLUMNS) -> DataFrame:
    """Canonical columns in canonical order; absent ones are null doubles."""
    have = set(df.columns)
    return df.select(*[col(c) if c in have else F.lit(None).cast("double").alias(c) for c in columns])


def union_stations(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
