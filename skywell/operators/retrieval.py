"""Exact top-k retrieval between two large sides.

Memory vectors are indexed by length: shells of falling length, each twice as large as the one before. A query's
score with any vector of a shell is at most the query's length times the shell's greatest length, so a query
whose k-th score is above that bound is done and meets no further shell. Equal vectors are one class with a
count, so any number of copies is one candidate; ranks count all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skywell.session import written

BLOCK_ROWS, FIRST_SHELL = 4096, 65_536
SLACK = 1e-9  # of the bound, for rounding


def _length(v: str) -> Column:
    return F.sqrt(F.aggregate(F.col(v), F.lit(0.0), lambda a, x: a + x * x))


def norm_index(memory: DataFrame, first_shell: int = FIRST_SHELL) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """(classes, shells): classes (cid, n, v, shell) of equal vectors named by their least mid, and per shell
    (number, rows, greatest length). Rows with a null vector are left out."""
    classes = written(memory.where("v IS NOT NULL").groupBy("v").agg(
        F.min("mid").alias("cid"), F.count(F.lit(1)).alias("n")).withColumn("length", _length("v")), "classes")
    total = classes.count()
    ends, size = [], first_shell
    while size < total:
        ends.append(1 - size / total)
        size = 2 * size + first_shell
    shell: Column = F.lit(0)
    if ends:
        cuts = classes.agg(F.percentile_approx("length", ends, 100_000)).first()[0]
        for cut in cuts:  # at most the binary logarithm of the rows
            shell = shell + (F.col("length") < F.lit(float(cut))).cast("int")
    indexed = written(classes.withColumn("shell", shell), "index")
    found = indexed.groupBy("shell").agg(F.count(F.lit(1)).alias("rows"), F.max("length").alias("most")).orderBy("shell").collect()
    return indexed.drop("length"), [(r["shell"], r["rows"], r["most"]) for r in found]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, without a Python object per number."""
    cells = pa.concat_arrays(column.chunks)
    lengths = np.diff(cells.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return cells.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(cells), -1)


def _products(k: int):
    """Pairs of one block of queries and one of classes that can be among a query's k best."""
    def run(qs: pa.Table, ms: pa.Table) -> pa.Table:
        qid, cid, score, n = [], [], [], []
        if qs.num_rows and ms.num_rows:
            a, b = _matrix(qs["q"]), _matrix(ms["v"])
            kth, counts = qs["kth"].to_numpy(), ms["n"].to_numpy()
            s = a @ b.T / math.sqrt(a.shape[1])
            keep = min(k, s.shape[1])
            floor = np.maximum(np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep], kth)
            i, j = np.nonzero(s >= floor[:, None])
            qid, cid, score, n = qs["qid"].to_numpy()[i], ms["cid"].to_numpy()[j], s[i, j], counts[j]
        return pa.table({"qid": pa.array(qid, pa.int64()), "cid": pa.array(cid, pa.int64()),
                         "n": pa.array(n, pa.int64()), "score": pa.array(score, pa.float64())})
    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    """Classes with fewer than k vectors of a better score."""
    falling = Window.partitionBy("qid").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("qid", "score")
    better = F.sum("n").over(falling) - F.sum("n").over(same)
    return hits.withColumn("rank", better + 1).where(F.col("rank") <= k)


def nearest_classes(queries: DataFrame, memory: DataFrame, k: int = 8, block_rows: int = BLOCK_ROWS,
                    first_shell: int = FIRST_SHELL) -> tuple[DataFrame, dict[str, int]]:
    """(hits, counts): per query (qid, q) the classes of memory (mid, v) with rank k or better by q.v / sqrt(d), all
    ties kept, with the number ``n`` of equal vectors; and how many (query, block) products were met and skipped.

    Queries with a null vector have no hits.
    """
    asked = written(queries.where("q IS NOT NULL").select("qid", "q", _length("q").alias("length")), "queries")
    index, shells = norm_index(memory, first_shell)
    all_queries, met, possible = asked.count(), 0, 0
    hits, floors = None, None
    for number, rows, most in shells:
        blocks = -(-rows // block_rows)
        possible += all_queries * blocks
        live = asked.withColumn("kth", F.lit(float("-inf")))
        if floors is not None:
            bound = F.col("length") * F.lit(most) * (1 + SLACK) / F.sqrt(F.size("q"))
            live = asked.join(floors, "qid", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))).where(bound >= F.col("kth"))
        live = written(live.select("qid", "q", "kth"), "open")
        n = live.count()
        met += n * blocks
        if not n:
            continue
        q_blocks = -(-n // block_rows)
        q = live.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks))).withColumn(
            "mb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        m = index.where(F.col("shell") == number).withColumn("mb", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int")).withColumn(
            "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
        new = q.groupBy("qb", "mb").cogroup(m.groupBy("qb", "mb")).applyInArrow(_products(k), "qid long, cid long, n long, score double")
        hits = written(_best((new if hits is None else hits.drop("rank").unionByName(new)), k), "hits")
        floors = hits.groupBy("qid").agg(F.sum("n").alias("s"), F.min("score").alias("kth")).where(F.col("s") >= k).drop("s")
    if hits is None:
        hits = asked.sparkSession.createDataFrame([], "qid long, cid long, n long, score double, rank long")
    return hits, {"products": met, "skipped": possible - met}


def retrieve(queries: DataFrame, memory: DataFrame, k: int = 8, **options) -> DataFrame:
    """Softmax weights over the kept scores and the weighted sum of memory vectors per query.

    (qid, n_kept, top_weight, value); ``top_weight`` is that of one vector. Sums run in order of the classes, so
    they repeat digit by digit. A query keeps at most k classes and those of exactly equal score at the end.
    """
    hits, _ = nearest_classes(queries, memory, k, **options)
    vectors = memory.where("v IS NOT NULL").groupBy("v").agg(F.min("mid").alias("cid"))
    top = F.max("score").over(Window.partitionBy("qid"))
    parts = hits.withColumn("e", F.exp(F.col("score") - top)).join(vectors, "cid")
    listed = parts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("cid", "n", "e", "v"))).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["n"] * x["e"])
    weighed = listed.select("qid", "all", total.alias("total"))
    zero = F.array_repeat(F.lit(0.0), F.size(F.col("all")[0]["v"]))
    return weighed.select(
        "qid", F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_kept"),
        (F.array_max(F.transform("all", lambda x: x["e"])) / F.col("total")).alias("top_weight"),
        F.aggregate("all", zero, lambda a, x: F.zip_with(a, x["v"], lambda s, y: s + y * x["n"] * x["e"] / F.col("total"))).alias("value"))
