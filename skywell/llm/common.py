"""Helpers shared by the text operators: tables, stored intermediates, word rules, gapless numbers, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from skywell.session import scratch_path

# Fixed values of the word rule: characters that part words, and the letters that are lowered.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5
# Bytes of an Arrow batch on its way to Python or back (Spark's default: 64 MB).
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``BATCH_BYTES``, as an executor holds several copies of a batch
    for each running task, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: later jobs re-read the same rows, whoever is lost."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(StructType.fromJson(df.schema.jsonValue())).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(text: Column | str = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c, F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def broadcast_within(df: DataFrame, row_bytes: int, most: int = 64 << 20) -> DataFrame:
    """Hint a broadcast if the counted rows fit ``most`` bytes; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def numbered(df: DataFrame, key: str, order: list[str], out: str, rows_per_group: int = 20_000,
             rows: int | None = None) -> DataFrame:
    """Gapless numbers from 0 within ``key``, whatever share of the rows one key holds.

    Rows fall into hash groups of about ``rows_per_group``; groups are counted with a map-side combine, the
    counts accumulated per key, and rows are only ordered within (key, group). ``df`` must be stored: it is
    read twice.
    """
    rows = df.count() if rows is None else rows
    groups = max(1, -(-rows // rows_per_group))
    cut = df.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    before = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(key, "_group").count().select(
        key, "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_group").orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(starts, [key, "_group"]).withColumn(out, F.col("_start") + F.col("_rank")).drop(
        "_group", "_start", "_rank")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of an undirected edge list; the component is its smallest node.

    Alternating large and small stars: every step replaces edges by edges to the smallest neighbour, until
    nothing changes. A hub is never gathered: minima come from a combining aggregate and are joined back.
    """
    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:  # every node with its smaller neighbours
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                low.select("u", F.col("m").alias("v")))
        return out.where("u <> v")

    e = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    last = digest(e)
    while True:
        e = stored(star(star(e, True), False).distinct(), "edges")
        now = digest(e)
        if now == last:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        last = now
