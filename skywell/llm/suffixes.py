"""Repeated byte strings by bucket-pointer refinement (operator 9).

A byte position is removed if some string of ``length`` bytes that covers it also starts elsewhere in the
corpus. Suffixes are sorted only as deep as that takes. Buckets are named by identifiers that depend on
content alone, so any task can name them: an identifier of 2q bytes is made of the identifiers of the two
q-byte buckets at an offset and q later, again and again, and one of ``length`` bytes of two overlapping ones.

1. Each start of a ``length``-byte string points to its least q-gram (q = 64 of 200), the same for equal
   strings. Neighbouring starts with one least q-gram occurrence form a *run*; a run is known by the
   identifiers of its first and last string, which together cover it.
2. Runs are put in buckets by their q-gram. A bucket with one run is finished: nothing in it repeats.
3. A bucket is refined by whole runs: equal runs repeat at all their starts. In the middle of a repeated
   passage all runs are equal, so copies cost one row each and are counted with a map-side combine.
4. Only buckets with different runs (the ends of passages, short common lines) go on, once per different run. The
   starts of a run fall into ``CLASSES`` classes by their distance to the q-gram. The strings of one class
   share a core and together make a hull, both at fixed offsets from the q-gram: a class whose core has one
   owner is finished, one whose hull has two repeats at all its starts.
5. The classes in between are refined by single starts; starts whose identifier has two owners repeat.

Identifiers are 64 bits at each of two levels (q-gram, then run or start), 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skywell.llm.common import broadcast_within, clean_text, documents, stored
from skywell.llm.registry import query

LENGTH, BLOCK, CLASSES = 200, 1 << 18, 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)


def pointed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Identifiers of longer buckets from those at an offset and at a later one."""
    z = x * _A
    z += y
    z ^= z >> np.uint64(32)
    z *= _B
    z ^= z >> np.uint64(29)
    return z


def gram_length(length: int) -> int:
    return 1 << max(0, (length // 2).bit_length() - 1)


def identifiers(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the q-grams and of the ``length``-byte strings at every start of at least ``length`` bytes."""
    size, h, q, gram = 1, _BYTES[data], gram_length(length), None
    while 2 * size <= length:
        if size == q:
            gram = h
        h = pointed(h[:-size], h[size:])
        size *= 2
    if size == q:
        gram = h
    rest = length - size
    return gram, (pointed(h[:len(h) - rest], h[rest:]) if rest else h)


def least(gram: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` neighbouring q-grams at every start."""
    size, m = 1, gram
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first start, last start - first, q-gram, run identifier) of all runs."""
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    gram, string = identifiers(data, length)
    low = least(gram, length - gram_length(length) + 1)
    n = len(data) - length + 1
    begin = np.zeros(n, dtype=bool)
    begin[0] = True
    begin[1:] = (low[1:] != low[:-1]) | (gram[:n - 1] == low[:-1])
    inside = np.ones(n, dtype=bool)  # strings do not cross texts
    for e in ends[:-1].tolist():
        inside[max(0, e - length + 1):e] = False
        if e < n:
            begin[e] = True
    first = np.flatnonzero(begin & inside)
    stop = begin | ~inside
    nexts = np.flatnonzero(stop)
    at = np.searchsorted(nexts, first, side="right")
    last = np.append(nexts, n)[at] - 1
    k = np.searchsorted(ends, first, side="right")
    span = last - first
    run = pointed(pointed(string[first], string[last]), span.astype(np.uint64))
    starts = first - (ends - [len(t) for t in texts])[k]
    return k, starts, span, low[first].view(np.int64), run.view(np.int64)


def blocks(texts: Iterable[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text numbers, offsets, pieces) of about ``BLOCK`` bytes; a long text is cut with an overlap that keeps every string."""
    numbers, offsets, parts, size = [], [], [], 0
    for k, t in enumerate(texts):
        for lo in range(0, max(0, len(t) - length) + 1, BLOCK) if len(t) >= length else ():
            part = t[lo:lo + BLOCK + length - 1]
            numbers.append(k), offsets.append(lo), parts.append(part)
            size += len(part)
            if size >= BLOCK:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
    if parts:
        yield numbers, offsets, parts


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, th, spans): the byte spans (from, to) of each document to remove, unmerged; documents without any are left out.

    ``docs`` has doc_id, th (hash of the text) and text without nulls; rows with equal doc_id and text share a key,
    but each counts as an occurrence.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            texts = (t.as_py().encode() for t in batch.column("text"))  # one block's texts are held at a time
            for numbers, offsets, parts in blocks(texts, length):
                k, start, span, gram, run = runs_of(parts, length)
                own = np.array(numbers)[k]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids[own], pa.int64()), "th": pa.array(ths[own], pa.int64()),
                    "start": pa.array(start + np.array(offsets)[k], pa.int64()), "span": pa.array(span, pa.int32()),
                    "gram": pa.array(gram, pa.int64()), "run": pa.array(run, pa.int64())})

    runs = stored(docs.mapInArrow(cut, "doc_id long, th long, start long, span int, gram long, run long"), "runs")
    buckets = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("run").alias("lo"), F.max("run").alias("hi")).where(
        "k > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed"))
    buckets = stored(buckets, "buckets")
    shared = stored(runs.join(broadcast_within(buckets, 24), "gram"), "shared")
    kinds = stored(shared.groupBy("gram", "run").agg(
        F.count(F.lit(1)).alias("copies"), F.first("mixed").alias("mixed"),
        F.min(F.struct("doc_id", "th", "start", "span")).alias("at")), "kinds")

    # One occurrence of each different run in a mixed bucket, refined by classes of starts, then by starts.
    runs = kinds.where("mixed").select("gram", "run", "copies", "at.*")
    cores = stored(_looked_up(docs, runs.withColumn("classes", F.lit(0)), length, True), "cores")
    one = cores.groupBy("gram", "at", "id").agg(F.sum("copies").alias("k")).where("k > 1").select("gram", "at", "id")
    two = cores.where("hull IS NOT NULL").groupBy("gram", "at", "hull").agg(F.sum("copies").alias("k")).where(
        "k > 1").select("gram", "at", "hull", F.lit(True).alias("all"))
    near = stored(cores.join(one, ["gram", "at", "id"]).join(two, ["gram", "at", "hull"], "left"), "near")
    # A start of an open class may repeat one of a finished class, so one owner of such a hull comes along.
    unsure = near.where("all IS NULL").select("gram", "at", "id", "run")
    owners = near.where("all").join(unsure.drop("run"), ["gram", "at", "id"], "left_semi").groupBy("gram", "at", "hull").agg(
        F.min("run").alias("run"))
    open_runs = unsure.select("gram", "at", "run").union(owners.select("gram", "at", "run")).groupBy("gram", "run").agg(
        F.bit_or(F.expr("shiftleft(1, at)")).alias("classes"))
    each = stored(_looked_up(docs, runs.join(open_runs, ["gram", "run"]), length, False), "starts")
    twice = each.groupBy("gram", "id").agg(F.sum("copies").alias("k")).where("k > 1").select("gram", "id")
    found = each.join(twice, ["gram", "id"]).select("gram", "run", "lo", "hi").union(
        near.where("all").select("gram", "run", "lo", "hi"))
    hits = found.groupBy("gram", "run").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("offs"))  # within one run

    # All starts of equal runs repeat; of the other runs those that were hit.
    marked = kinds.join(hits, ["gram", "run"], "left").where("copies > 1 OR offs IS NOT NULL").select(
        "gram", "run", F.when(F.col("copies") == 1, F.col("offs")).alias("offs"))
    at = F.transform(F.coalesce("offs", F.array().cast("array<struct<lo:int,hi:int>>")), lambda o: F.struct(
        (F.col("start") + o["lo"]).alias("a"), (F.col("start") + o["hi"] + length).alias("b")))
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("span") + length).alias("b")))
    pieces = shared.select("doc_id", "th", "gram", "run", "start", "span").join(marked, ["gram", "run"]).select(
        "doc_id", "th", F.when(F.col("offs").isNull(), whole).otherwise(joined(at)).alias("s"))
    return pieces.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("s")).alias("spans"))


def _listed(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``docs`` with _listed true for those that have a row in ``lists``, so that only their texts are shuffled to it."""
    keys = lists.select("doc_id", "th", F.lit(True).alias("_listed"))
    return docs.join(broadcast_within(keys, 24), ["doc_id", "th"], "left")


def _looked_up(docs: DataFrame, runs: DataFrame, length: int, cores: bool) -> DataFrame:
    """(gram, run, copies, at, lo, hi, id, hull) of the runs' classes ``at`` with their first and last start in the run
    and the identifiers of core and hull (null for a class that the run holds in part); or of the single starts in
    the classes named by the bit set ``classes``."""
    asked = stored(runs.groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("gram", "run", "copies", "start", "span", "classes")).alias("asked")), "asked")
    width = length - gram_length(length) + 1
    step = -(-width // CLASSES)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, want in zip(batch.column("text"), batch.column("asked")):
                data, want = text.as_py().encode(), want.values
                gram, run, copies, start, span, classes = (want.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                span = span.astype(np.int64)
                part = np.frombuffer(b"".join(data[a:a + n + length] for a, n in zip(start.tolist(), span.tolist())), dtype=np.uint8)
                base = np.cumsum(span + length) - (span + length)
                grams, strings = identifiers(part, length)
                # Where in its run each run's least q-gram starts, at the last string's first such place.
                at = span + np.concatenate([grams[(base + span)[i:i + 4096, None] + np.arange(width)].argmin(1) for i in range(0, len(span), 4096)])
                low, high = (at - span) // step, at // step
                k = np.repeat(np.arange(len(span)), high - low + 1)
                kind = np.arange(len(k)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[k]
                first = at[k] - np.minimum(step * kind + step - 1, at[k])
                last = at[k] - np.maximum(step * kind, at[k] - span[k])
                hull, full = np.zeros(len(k), dtype=np.uint64), last - first + 1 == step
                if cores:
                    ids = identifiers(part, length - step + 1)[1][base[k] + at[k] - step * kind]
                    if full.any():
                        hull[full] = identifiers(part, length + step - 1)[1][(base[k] + first)[full]]
                else:
                    wanted = (classes[k] >> kind) & 1 == 1
                    k, kind, first, last = k[wanted], kind[wanted], first[wanted], last[wanted]
                    n = last - first + 1
                    own = np.repeat(np.arange(len(k)), n)
                    first = last = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[own]
                    k, kind = k[own], kind[own]
                    ids, hull, full = strings[base[k] + first], np.zeros(len(k), dtype=np.uint64), np.zeros(len(k), dtype=bool)
                yield pa.RecordBatch.from_pydict({
                    "gram": pa.array(gram[k], pa.int64()), "run": pa.array(run[k], pa.int64()), "copies": pa.array(copies[k], pa.int64()),
                    "at": pa.array(kind, pa.int32()), "lo": pa.array(first, pa.int32()), "hi": pa.array(last, pa.int32()),
                    "id": pa.array(ids.view(np.int64), pa.int64()), "hull": pa.array(hull.view(np.int64), pa.int64(), mask=~full)})

    texts = _listed(docs, asked).where("_listed").drop("_listed").join(asked, ["doc_id", "th"])
    return texts.dropDuplicates(["doc_id", "th"]).select("text", "asked").mapInArrow(
        look, "gram long, run long, copies long, at int, lo int, hi int, id long, hull long")


def joined(spans):
    """Ascending spans with overlapping ones joined."""
    def step(acc, x):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["a"] <= F.try_element_at(acc, F.lit(-1))["b"], longer).otherwise(
            F.concat(acc, F.array(x)))

    return F.aggregate(spans, F.array().cast("array<struct<a:bigint,b:bigint>>"), step)


def without_repeats(docs: DataFrame, keep: list[str], length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """``keep`` columns plus n_bytes, n_removed, n_spans, kept for every row.

    ``kept`` is binary, as a cut may part a character; ``as_text`` gives a string without such remainders.

    A null text is empty; texts shorter than ``length`` keep everything; both occurrences of a repeated string go,
    in equal rows too. Null doc_ids are rows like others. An empty table gives no rows.
    """
    mark = F.lit(-2 ** 63)
    keyed = docs.select(*[F.col(c).alias("k_" + c) for c in keep], F.coalesce("doc_id", mark).alias("doc_id"), clean_text().alias("text")).withColumn(
        "th", F.xxhash64("text"))
    spans = stored(repeated(keyed.select("doc_id", "th", "text"), length), "spans")
    known = _listed(keyed, spans)
    both = known.where("_listed IS NULL").drop("_listed").withColumn(
        "spans", F.lit(None).cast(spans.schema["spans"].dataType)).unionByName(
            known.where("_listed").drop("_listed").join(spans, ["doc_id", "th"]))
    names = ["k_" + c for c in keep]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data, removed, parts, at, n = text.as_py().encode(), 0, [], 0, 0
                for a, b in sorted((x["a"], x["b"]) for x in spans.as_py() or ()):
                    if a > at or n == 0:
                        parts.append(data[at:a])
                        n += 1
                        at = a
                    if b > at:
                        removed += b - at
                        at = b
                parts.append(data[at:])
                left = b"".join(parts)
                out.append((len(data), removed, n, left.decode("utf-8", "ignore") if as_text else left))
            done = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(v, t) for v, t in zip(done, (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())))],
                names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = docs.select(*keep).schema
    for c, t in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "string" if as_text else "binary")):
        schema = schema.add(c, t)
    return both.select(*names, "text", "spans").mapInArrow(cut, schema)


@query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"])
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
