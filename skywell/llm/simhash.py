"""SimHash near-duplicates by segment popcounts (operator 12).

A 64-bit fingerprint is embedded as the counts of set bits in its segments. One flipped bit moves one count by one, so
the Manhattan distance of two embeddings is never more than the Hamming distance of the fingerprints. Embeddings within
two steps of each other meet in a grid cell at most one step from either, so each fingerprint enters its own cell and
those one step away, and cells with one fingerprint are dropped. What shares a cell is then verified on all 64 bits.

A crowded cell is embedded anew with segments of one bit: there a cell is a 64-bit value, its members are the at most 65
fingerprints within one bit of it, all within two bits of each other, and one star links them. So no group is ever
compared all with all, however many near copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skywell.llm.bytetexts import LOWERED, keyed_bytes, slices
from skywell.llm.common import broadcast_within, components, documents, stored
from skywell.llm.registry import query

# Fixed values of the fingerprint: shingle words and the seed of XXH64; links reach over this many bits.
WORDS, SEED, REACH = 3, 42, 2
SEGMENTS, BITS = 16, 4  # of the grid
CROWDED = 24
BLOCK = 1 << 16


def fingerprint(body: bytes) -> int:
    """Fingerprint of a whole text as a signed 64-bit number: per bit, whether over half the shingles have it set."""
    from xxhash import xxh64_intdigest

    counts, total, kept, first = np.zeros(64, np.int64), 0, [], True
    for part in slices(body):
        words = kept + part.translate(LOWERED).split()
        kept = words[-(WORDS - 1):]
        if len(words) < WORDS:
            kept = words
            continue
        for at in range(0, len(words) - WORDS + 1, BLOCK):
            block = words[at:at + BLOCK + WORDS - 1]
            joined = b" ".join(block)
            ends = np.cumsum([len(w) + 1 for w in block]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[:len(block) - WORDS + 1]
            hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in
                                  zip(starts.tolist(), ends[WORDS - 1:].tolist())), np.uint64, len(starts))
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(hashes)
        first = False
    if first:
        if not kept:
            return 0
        return int(np.uint64(xxh64_intdigest(b" ".join(kept), SEED)).astype(np.int64))
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(body.as_py()) for body in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; a text without words, empty or null, has fingerprint zero."""
    return keyed_bytes(docs, F.col(doc_id).cast("long"), text).mapInArrow(_fingerprints, "doc_id long, fp long")


def grid_cells(fp: Column) -> Column:
    """The cell of the embedding and all cells one step away; a cell is all counts packed, three bits each."""
    def count(i: int) -> Column:
        return F.bit_count(F.shiftrightunsigned(fp, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")))

    own = reduce(lambda a, b: a + b, (F.shiftleft(count(i).cast("long"), 3 * i) for i in range(SEGMENTS)))
    steps = [F.when(count(i) < BITS, F.lit(1 << 3 * i).cast("long")) for i in range(SEGMENTS)]
    steps += [F.when(count(i) > 0, F.lit(-(1 << 3 * i)).cast("long")) for i in range(SEGMENTS)]
    moved = F.filter(F.array(F.lit(0).cast("long"), *steps), lambda s: s.isNotNull())
    return F.transform(moved, lambda s: own + s)


def bit_cells(fp: Column) -> Column:
    """The same with segments of one bit: the fingerprint and all values one bit away."""
    flips = [F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)]
    return F.array(fp, *[fp.bitwiseXOR(f) for f in flips])


def links(fps: DataFrame) -> DataFrame:
    """(u, v) edges between distinct fingerprints ``fp``: all its components, each edge within the reach.

    ``fps`` must be stored: it is read several times.
    """
    cells = fps.select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell"))
    shared = stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "cells")
    met = cells.join(broadcast_within(shared, 24, 32 << 20), "cell")
    few = met.where(F.col("c") <= CROWDED).groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("g"))
    near = few.select(F.posexplode("g").alias("i", "u"), "g").select("u", F.explode(F.filter(
        "g", lambda v: (v > F.col("u")) & (F.bit_count(v.bitwiseXOR(F.col("u"))) <= REACH))).alias("v"))
    crowd = met.where(F.col("c") > CROWDED).select("fp").distinct()
    stars = crowd.select("fp", F.explode(bit_cells(F.col("fp"))).alias("cell")).groupBy("cell").agg(
        F.sort_array(F.collect_list("fp")).alias("g")).where(F.size("g") > 1)  # at most 65 members
    return near.union(stars.select(F.col("g")[0].alias("u"), F.explode(F.slice("g", 2, 64)).alias("v")))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id reachable over links, its own included.

    Repeated rows are rows of their own. A null doc_id keeps its row and is never a smallest id, except where a
    component has no other: there component_id is null. Extra columns are ignored; an empty table gives no rows.
    """
    own = stored(fingerprints(docs, doc_id, text), "fingerprints")
    rows = own.count()
    classes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")), "classes")
    joined = components(links(classes.select("fp")), "u", "v").withColumnsRenamed({"node": "fp"})
    named = classes.join(joined, "fp", "left").select("fp", "least", "c", F.coalesce("component", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stored(named.join(lowest, "root").select("fp", "c", "component_id"), "found")
    # Fingerprints with more than 1/10,000 of all rows are at most 10,000 and are broadcast; no other is a hot key.
    hot = F.broadcast(found.where(F.col("c") * 10_000 > rows).select("fp", "component_id"))
    rest = found.where(F.col("c") * 10_000 <= rows).select("fp", "component_id")
    out = own.join(hot, "fp").unionByName(own.join(hot, "fp", "left_anti").join(rest, "fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op12_simhash_dedup")
def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir, "doc_id", "text"))
