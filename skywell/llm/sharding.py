"""Balanced label propagation over equal texts (operator 6, DataFrame operations only).

Documents with equal texts are linked; a document's neighbours are the others of its group, so what it sees
of them is a count per (group, shard). Labels start from a hash of the id. Each round every group that is
not settled names the shard with room for it that holds most of its members, and all of them propose to move
there; a shard takes proposals, large groups first, up to its free quota. A group too large for any shard's
room fills what there is and goes on with the rest. Rounds end when nothing moves. Documents without a link
then fill every shard to its exact count (law ``rows``: counts at most one apart).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skywell.llm.common import clean_text, documents, numbered, stored
from skywell.llm.registry import query

SHARDS = 24


def _accumulated(groups: DataFrame, key: str, size: str, name: str) -> DataFrame:
    """Sum of ``size`` over the groups before each group of ``key``, larger ones first.

    Groups are ordered by (power of two of the size, hash) cells and only within one cell by their key, so no
    shard's proposals are ordered in one task; the table of cells has a fixed number of rows.
    """
    cells = groups.withColumns({
        "_p": 64 - F.floor(F.log2(F.col(size))).cast("int"), "_h": F.pmod(F.xxhash64("g1", "g2"), F.lit(512))})
    before = Window.partitionBy(key).orderBy("_p", "_h").rowsBetween(Window.unboundedPreceding, -1)
    start = cells.groupBy(key, "_p", "_h").agg(F.sum(size).alias("_s")).select(
        key, "_p", "_h", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_p", "_h").orderBy("g1", "g2").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_in", F.coalesce(F.sum(size).over(within), F.lit(0))).join(
        start, [key, "_p", "_h"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_p", "_h", "_in", "_start")


def _by_shard(values: dict, shard: str) -> Column:
    return F.get(F.array(*[F.lit(int(values.get(s, 0))) for s in range(SHARDS)]), F.col(shard))


def propagate(cells: DataFrame, quota: dict[int, int]) -> DataFrame:
    """Settled (g1, g2, shard, n) after rounds over (g1, g2, shard, n), until nothing moves; no shard beyond its quota.

    Only 24 loads reach the driver in a round. Each round with a move settles a member, so the rounds end.
    """
    spark, room = cells.sparkSession, dict(quota)
    settled = spark.createDataFrame([], "g1 long, g2 long, shard int, n long")
    open_cells = stored(cells.select("g1", "g2", "shard", "n"), "cells")
    while True:
        largest = max(room.values())
        rooms = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(int(v)).alias("room")) for s, v in room.items()])
        held = open_cells.groupBy("g1", "g2").agg(F.sum("n").alias("r"), F.collect_list(F.struct("shard", "n")).alias("at"))
        # The shard that holds most members among those with room; another one with room if there is none.
        choice = F.array_max(F.transform(rooms, lambda x: F.struct(
            F.when(x["room"] >= F.col("r"), F.lit(2)).when(x["room"] > 0, F.lit(1)).otherwise(F.lit(0)).alias("fits"),
            F.coalesce(F.get(F.filter("at", lambda y: y["shard"] == x["s"]), F.lit(0))["n"], F.lit(0)).alias("n"),
            F.hash("g1", x["s"]).alias("tie"), x["s"].alias("to"), x["room"].alias("room"))))
        asked = held.withColumn("_c", choice).where("_c.fits > 0").select("g1", "g2", "r", "_c.to", "_c.room")
        left = F.greatest(F.lit(0), F.col("room") - F.col("before"))
        taken = F.when(left >= F.col("r"), F.col("r")).when(F.col("r") > largest, left).otherwise(F.lit(0))
        took = stored(_accumulated(asked, "to", "r", "before").select(
            "g1", "g2", F.col("to").alias("shard"), taken.cast("long").alias("n")).where("n > 0"), "moves")
        gained = {x["shard"]: x["n"] for x in took.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        if not gained:
            break
        room = {s: v - gained.get(s, 0) for s, v in room.items()}
        settled = stored(settled.unionByName(took).groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n")), "settled")
        gone = took.select("g1", "g2", F.col("n").alias("gone"))
        rest = open_cells.groupBy("g1", "g2").agg(F.sum("n").alias("r"), F.min("shard").alias("shard")).join(gone, ["g1", "g2"])
        open_cells = stored(open_cells.join(gone, ["g1", "g2"], "left_anti").unionByName(
            rest.where("r > gone").select("g1", "g2", "shard", (F.col("r") - F.col("gone")).alias("n"))), "cells")
    return settled


def shard_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    A null text counts as empty and is linked like one. A group larger than a shard fills several; a null or
    repeated doc_id is a row like any other. Extra columns are ignored; an empty table gives no rows.
    """
    body = F.encode(clean_text(), "UTF-8")
    rows = stored(docs.select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.xxhash64(clean_text()).alias("g1"), F.hash(F.reverse(clean_text())).cast("long").alias("g2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard"),
        F.monotonically_increasing_id().alias("_row")), "rows")
    total = rows.count()
    quota = {s: total // SHARDS + int(s < total % SHARDS) for s in range(SHARDS)}
    by_shard = rows.groupBy("g1", "g2", "shard").agg(F.count(F.lit(1)).alias("n"))
    members = by_shard.groupBy("g1", "g2").agg(F.sum("n").alias("members")).where("members > 1")
    cells = by_shard.join(members.select("g1", "g2"), ["g1", "g2"])
    kept = propagate(cells, quota).join(members, ["g1", "g2"])
    kept = stored(kept.select("g1", "g2", "members", "shard", "n"), "kept")
    sums = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    need = [quota[s] - sums.get(s, 0) for s in range(SHARDS)]

    # Groups in one piece take their shard by a join; the members of a split or cut group are numbered.
    ways = kept.groupBy("g1", "g2", "members").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("held"),
                                                   F.min("shard").alias("one"))
    whole = ways.where("parts = 1 AND held = members").select("g1", "g2", "one")
    cut = ways.where("NOT (parts = 1 AND held = members)").select("g1", "g2").withColumn("_cut", F.lit(True))
    lone = rows.drop("shard").join(whole, ["g1", "g2"], "left").join(cut, ["g1", "g2"], "left")
    lone = stored(lone, "placed")
    split = lone.where("_cut").withColumn("_g", F.struct("g1", "g2"))
    up_to = Window.partitionBy("g1", "g2").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = kept.join(cut, ["g1", "g2"], "left_semi").withColumn(
        "_from", F.coalesce(F.sum("n").over(up_to), F.lit(0))).groupBy("g1", "g2").agg(
            F.collect_list(F.struct("_from", "n", "shard")).alias("_spans"))  # at most one per shard
    ranked = numbered(split, "_g", ["_row"], "_at").join(spans, ["g1", "g2"], "left")
    hit = F.get(F.filter("_spans", lambda x: (F.col("_at") >= x["_from"]) & (F.col("_at") < x["_from"] + x["n"])), F.lit(0))
    columns = ["doc_id", "size", "text_crc32", "_row"]
    linked = lone.where("one IS NOT NULL").select(*columns, F.col("one").alias("shard")).union(
        ranked.select(*columns, hit["shard"].alias("shard")))
    settled = stored(linked, "linked")
    loose = stored(lone.where("one IS NULL AND _cut IS NULL").select(*columns).union(
        settled.where("shard IS NULL").select(*columns)).withColumn("_k", F.lit(0)), "loose")
    ends, at = [], 0
    for s in range(SHARDS):
        at += need[s]
        ends.append(at)
    place = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("_at")))
    filled = numbered(loose, "_k", ["_row"], "_at").select(*columns, place.alias("shard"))
    done = stored(settled.where("shard IS NOT NULL").union(filled), "sharded")
    return numbered(done, "shard", ["_row"], "slot", rows=total).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir, "doc_id", "text"))
