"""Bottom-k fingerprints of word shingles (operator 1, DataFrame operations only).

A fingerprint keeps the k smallest 64-bit hashes of a text's distinct shingles, ascending, as 16 hex digits
each. Fingerprints merge: the fingerprint of a union of texts is the k smallest of all their hashes. With
fewer than k shingles it is the whole set and every estimate is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skywell.llm.common import LOWER, SHINGLE, UPPER, broadcast_within, clean_text, documents, let, stored, words_of
from skywell.llm.registry import query

K = 128


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles of ``size`` words; a text with fewer words is one shingle, without words none."""
    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - size),
                           lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        return F.when(F.size(w) >= size, each).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(
            F.array().cast("array<bigint>"))

    return let(words_of(F.translate(text, UPPER, LOWER)), hashes)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return bottom_k(shingle_hashes(text), k)


def as_text(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merge(a: Column, b: Column, k: int = K) -> Column:
    return bottom_k(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest hashes of the union that lie in both; two empty sketches are alike (1)."""
    def share(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))

    return let(merge(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else (k - 1) over the k-th hash as a share of the range."""
    kth = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has too, from the resemblance and the two sizes; an empty a is contained."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def merged_sketches(docs: DataFrame, by: list[str], text: str = "text", k: int = K) -> DataFrame:
    """One sketch per group of documents: the k smallest distinct hashes of all members.

    Hashes are made distinct with a map-side combine and only ranks up to k within (group, part) survive to
    the last step, so a group with a third of all rows is spread over many tasks.
    """
    each = docs.select(*by, F.explode(sketch(clean_text(text), k)).alias("h")).distinct()
    part = each.withColumn("_p", F.pmod(F.xxhash64("h"), F.lit(256)))
    low = part.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy("h"))).where(
        F.col("_r") <= k)
    return low.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias("sketch"))


def with_next(docs: DataFrame, rows_per_block: int = 512) -> DataFrame:
    """Every row with ``next_text``, the text of the row after it by ascending doc_id (the last: the first row's).

    Ids fall into blocks of about ``rows_per_block``: 64 quantile ranges, each cut evenly. A block also gets the
    first row of the next block, so texts are shuffled once and ordered within one block only. Equal ids are
    ordered by text; null ids come first.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(-2 ** 63)).alias("_id"), F.col("doc_id"),
                       clean_text().alias("text"))
    n, marks = base.agg(F.count(F.lit(1)), F.percentile_approx("_id", [i / 64 for i in range(65)], 10_000)).first()
    marks = sorted(set(marks or [0]))
    cuts = max(1, -(-n // (64 * rows_per_block)))
    edges = F.array(*[F.lit(m).cast("long") for m in marks])
    span = [max(1, b - a) for a, b in zip(marks, [*marks[1:], marks[-1] + 1])]
    spans = F.array(*[F.lit(float(s)) for s in span])

    def block(i: Column) -> Column:
        coarse = F.greatest(F.lit(0), F.size(F.filter(edges, lambda m: m <= i)) - 1)
        return let(coarse, lambda c: F.struct(c.alias("c"), F.greatest(F.lit(0), F.least(F.lit(cuts - 1), F.floor(
            (i.cast("double") - F.get(edges, c).cast("double")) * cuts / F.get(spans, c)).cast("int"))).alias("f")))

    cut = base.withColumn("_b", block(F.col("_id"))).withColumns({"_c": F.col("_b.c"), "_f": F.col("_b.f")}).drop("_b")
    firsts = cut.groupBy("_c", "_f").agg(F.min("_id").alias("_id"))
    # Each block's first id goes to the block before it: within a range by the cuts, between ranges by range.
    inner = Window.partitionBy("_c").orderBy("_f")
    seen = firsts.withColumns({"_pf": F.lag("_f").over(inner)})
    ends = firsts.groupBy("_c").agg(F.max("_f").alias("_lf"))  # at most 65 rows
    outer = Window.orderBy("_c")
    whole = outer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = ends.select(
        "_c", F.coalesce(F.lag("_c").over(outer), F.last("_c").over(whole)).alias("_pc"),
        F.coalesce(F.lag("_lf").over(outer), F.last("_lf").over(whole)).alias("_pl"))
    sent = seen.join(F.broadcast(back), "_c").select(
        "_id", F.coalesce(F.when(F.col("_pf").isNotNull(), F.col("_c")), F.col("_pc")).alias("_c"),
        F.coalesce("_pf", "_pl").alias("_f"), F.lit(1).alias("_extra"))
    sent = broadcast_within(stored(sent, "edges"), 32)  # one narrow row per block
    extra = cut.drop("_c", "_f").join(sent, "_id").select("_id", "doc_id", "text", "_c", "_f", "_extra")
    order = Window.partitionBy("_c", "_f").orderBy("_extra", "_id", "text")
    rows = cut.select("_id", "doc_id", "text", "_c", "_f", F.lit(0).alias("_extra")).union(extra)
    return rows.withColumn("next_text", F.lead("text").over(order)).where("_extra = 0").select(
        "doc_id", "text", "next_text")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    A null text is empty; an empty text has an empty fingerprint, alike only to another empty one. Repeated
    rows are rows of their own. Extra columns are ignored; an empty table gives no rows.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    near = with_next(docs).select("doc_id", "text", "next_text", edited.alias("edited"))

    def row(s: Column) -> Column:
        return F.struct(
            as_text(s["own"]).alias("fingerprint"), as_text(s["edit"]).alias("edited_fingerprint"),
            resemblance(s["own"], s["edit"], k).alias("near_edited"),
            resemblance(s["own"], s["next"], k).alias("near_next"),
            distinct_shingles(s["own"], k).alias("est_shingles"),
            containment(s["edit"], s["own"], k).alias("edited_contained"))

    sketches = F.struct(sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("edit"),
                        sketch(F.coalesce("next_text", F.lit("")), k).alias("next"))
    return near.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), let(sketches, row).alias("_s"),
    ).select("doc_id", "n_chars", "edited_sha256", "_s.*")


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir, "doc_id", "text"))
