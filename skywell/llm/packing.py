"""Best-fit packing of token sequences by large-item matching (operator 3).

Tokens are counted where the documents lie; what moves on is one narrow row per piece. The plan needs only
the number of pieces of each length (at most ``capacity`` rows): pieces above a third of the capacity pair
at most twice per bin, the largest with the largest that fits; smaller pieces, longest first, go to the
bin with the smallest sufficient gap. Bins of one make-up are kept as one entry with a count, so the plan
does not grow with the input. A piece then finds its place from its length and its number within that
length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skywell.llm.common import clean_text, documents, numbered, stored
from skywell.llm.registry import query
from skywell.llm.tokenizing import ADDED, encoding, rank_file

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None,
           added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: a document's ids plus ``end_id``, cut from the back into full pieces."""
    packed, special = docs.sparkSession.sparkContext.broadcast(rank_file(vocabulary)), tuple((added or {}).items())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(packed.value, special)
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column("text")):
                ids = np.append(coder.encode_to_numpy(text.as_py(), allowed_special="all"), np.uint32(end_id)).astype("<u4")
                edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                at += [k] * (len(edges) - 1)
                out += [(i, a, b - a, zlib.crc32(ids[a:b])) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            piece, start, length, crc = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, numbers, first bin, per bin, offset) for pieces shorter than the capacity.

    Piece number r of a length lies in the entry with first <= r < first + numbers, in bin
    ``first bin + (r - first) // per bin`` at ``offset + (r - first) % per bin * length``.
    """
    left = {s: c for s, c in counts.items() if c and s < capacity}
    gaps: list[list] = [[] for _ in range(capacity + 1)]  # by gap: [count, ((length, times), ...)]

    def put(gap: int, count: int, slots: tuple) -> None:
        if count:
            gaps[gap].append([count, slots])

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= capacity - a and left[x] and (x != a or left[a] > 1)), None)
            if b is None:
                put(capacity - a, left[a], ((a, 1),))
                left[a] = 0
            elif b == a:
                put(capacity - 2 * a, left[a] // 2, ((a, 2),))
                left[a] %= 2
            else:
                k = min(left[a], left[b])
                put(capacity - a - b, k, ((a, 1), (b, 1)))
                left[a], left[b] = left[a] - k, left[b] - k
    for s in sorted((s for s in left if left[s]), reverse=True):
        gap = s
        while left[s]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:  # open new bins
                many = capacity // s
                put(capacity - many * s, left[s] // many, ((s, many),))
                rest = left[s] % many
                put(capacity - rest * s, int(rest > 0), ((s, rest),))
                break
            count, slots = gaps[gap].pop()
            many = gap // s
            full = min(count, left[s] // many)
            put(gap - many * s, full, (*slots, (s, many)))
            left[s] -= full * many
            if full < count and left[s]:  # fewer than a bin takes
                put(gap - left[s] * s, 1, (*slots, (s, left[s])))
                left[s], full = 0, full + 1
            put(gap, count - full, slots)
    out, used, bins = [], dict.fromkeys(counts, 0), 0
    for group in gaps:
        for count, slots in group:
            offset = 0
            for s, times in slots:
                out.append((s, used[s], count * times, bins, times, offset))
                used[s], offset = used[s] + count * times, offset + s * times
            bins += count
    return sorted(out)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None,
         added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece with its sequence and offset; sequences are gapless from offset 0.

    A null or empty text is the end id alone. Null and repeated doc_ids are rows of their own. Pieces that fill a
    sequence take negative sequence numbers, all others numbers from 0. Extra columns are ignored; an empty
    table gives no rows. ``added`` texts become their one id, as the library's plain call has it (``ADDED``);
    without it they are ordinary text, as with the library's ``encode_special_tokens``.
    """
    cut = stored(pieces(docs, capacity, end_id, vocabulary, added), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    layout = np.array(plan(counts, capacity), dtype=np.int64).reshape(-1, 6)
    keys = (layout[:, 0] << 44) + layout[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("_n").to_numpy()
            row = layout[np.searchsorted(keys, (length << 44) + number, side="right") - 1]
            step = number - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(row[:, 3] + step // row[:, 4]),
                 pa.array(row[:, 5] + step % row[:, 4] * length)], names=[*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    short = cut.where(F.col("length") < capacity)
    named = numbered(short, "length", ["doc_id", "piece", "ids_crc32"], "_n").select(
        *columns, F.col("_n").cast("long").alias("_n"))
    placed = named.mapInArrow(place, PIECES + ", sequence_id long, offset long")
    full = cut.where(F.col("length") == capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text"), added=ADDED)
