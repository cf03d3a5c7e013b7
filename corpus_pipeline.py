"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of its documents, whatever they
are called. Stages keep nulls, repeated rows and extra columns as stated with each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skywell.llm import classifier, jaccard, languages, packing, suffixes
from skywell.llm.common import small_batches, stored

# A document stays if one language holds at least this share of its pooled probability.
LEAST_LANGUAGE = 0.4


def _boxed(docs: DataFrame, *without: str) -> DataFrame:
    """All columns in one struct, so that no name can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("_doc"), "doc_id", "text")


def _renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns but the text under numbered names: nothing can clash, and no text travels twice."""
    names = [c if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Texts that are null or without a letter go, as do undecided ones."""
    teachers = docs.select("doc_id", "text", "lang").where(~languages.held_out())
    given, names = _renamed(docs)
    named = languages.identify(given, languages.fit(teachers), names)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(*names).toDF(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is predicted as 1.

    The scored rows are stored before they are chosen: Spark would move the choice below the statistics and compute
    them anew for every rule.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = classifier.score_quality(_boxed(docs), labels, ["_doc"]).select("_doc", "predicted")
    return stored(scored, "scored").where("predicted = 1").select("_doc.*")


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the smallest doc_id, null last, then the smallest hash.

    A document is a doc_id with a text, known by a 64-bit hash of both: rows that share a doc_id but not the text are
    documents of their own, and so are texts without a doc_id. Of rows equal in both one stays.
    """
    key = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())
    rows = stored(docs.select(key.alias("_key"), "doc_id"), "keys").groupBy("_key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    found = jaccard.near_components(docs.select(key.alias("doc_id"), "text")).groupBy("doc_id").agg(
        F.min("component_id").alias("component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    first = rows.join(found.withColumnRenamed("doc_id", "_key"), "_key").groupBy("component_id").agg(
        F.min_by(F.struct("_key", "n"), order).alias("f"))
    first = stored(first.select("f._key", "f.n"), "kept")
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), key.alias("_key")).join(first, "_key")
    again = kept.where("n > 1").dropDuplicates(["_key"])
    return kept.where("n = 1").union(again).select("_doc.*")


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of any 200-byte string that occurs twice; n_chars follows. Every row stays.

    Characters of which a cut leaves a part go too.
    """
    left = suffixes.without_repeats(_boxed(docs, "text", "n_chars"), ["_doc"], as_text=True)
    own = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[own[c].alias(c) if c in own else F.col(f"_doc.`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"), added=packing.ADDED)


def lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with small Arrow batches: executors are shared by all stages, and a worker keeps what its largest took."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", lean(identified)),
    ("quality_classifier", lean(good)),
    ("ngram_jaccard_join", lean(single)),
    ("suffix_array_dedup", lean(unrepeated)),
    ("best_fit_packing", lean(packed)),
]
# Trained models and byte strings are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
