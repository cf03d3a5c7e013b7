"""Near-duplicate components by an n-gram Jaccard join with adaptive multi-match prefixes (operator 4).

A text is the set of its distinct 5-word shingles, as 64-bit hashes; equal sets are one *class*. Shingles
are ordered by hash. Two sets alike to 0.75 share at least ``l`` shingles among the first
``n - ceil(0.75 n) + l`` of each, for any l up to that many, and sets that use different l share at least
the smaller. So every class emits a prefix lengthened by ``extension(n)``:

* shingles in more than ``HOT`` classes are *hot* and get no candidates of their own;
* a class without hot shingles in the plain prefix stays at l = 1;
* another is lengthened to its full extension and asks for correspondingly more shared shingles, which
  leaves at least one that is not hot as long as it has fewer hot shingles than the least l of any partner;
* a class where even that fails is *dense* and is lengthened to its whole set: partners share at least
  three quarters of it, so unless three quarters are hot among the dense classes one shared shingle is not;
* what is left, large groups of near copies, is *packed*. Packed classes order their whole sets by frequency (that of
  the shingle's cell in a table of fixed size; what is not hot comes first, but for shared cells) and post the hot
  rest of a lengthened prefix, which is short as their own edits come first. Rounds compare each
  class with one pivot of its shingle's list, the most central class at first, which joins a group of m copies with
  about m comparisons; they go on while they join components. A last pass takes the pairs in different components
  that share enough posted shingles.

Packed classes carry ``BITS`` parity bits of their sets. Each shingle of just one of two sets changes one bit, so at
least as many shingles as bits differ, and alike sets differ in at most (n + n2) / 7: pairs beyond that end within
the join.

No link between components is lost, so the components are exact; pairs inside a component need not all be
compared. Candidates are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skywell.llm.common import LOWER, SHINGLE, UPPER, broadcast_within, components, documents, small_batches, stored
from skywell.llm.registry import query

HOT, ROUNDS, PACKED_MORE, BITS = 32, 8, 4, 1024
CHUNK_BYTES, LONG_WORD, CELL_BITS = 1 << 18, 64, 20
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = np.uint64(0x9E3779B97F4A7C15)
MARK = -2 ** 63
PARTS = "plain array<bigint>, longer array<bigint>, hot_plain int, hot_all int, burning array<bigint>, times array<bigint>"
SETS = f"doc_id long, n int, c long, {PARTS}"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of a lowered text that begins and ends with a space."""
    gap = _GAP[np.frombuffer(body, np.uint8)]
    turns = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    size = ends - starts
    eights = np.ndarray(len(body), "<u8", body + bytes(8), strides=(1,))  # the eight bytes from every place on
    h = size.astype(np.uint64)
    for at in range(0, LONG_WORD, 8):
        on = np.flatnonzero(size > at) if at else slice(None)
        left = np.minimum(size[on] - at, 8).astype(np.uint64)
        if not len(left):
            break
        part = eights[starts[on] + at] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left))
        h[on] = mixed(h[on] * _MIX + part)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(body[starts[i]:ends[i]])
    return starts, h


def shingled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size`` words in a row."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        out = mixed(out * _MIX + h[j:j + n])
    return out.view(np.int64)


def shingle_sets(texts: Iterable[bytes | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct shingle hashes of the lowered words; one shingle for a shorter text, none for no
    words. Texts of about ``CHUNK_BYTES`` are hashed together."""
    def sets(held: list[bytes]) -> Iterator[np.ndarray]:
        starts, h = word_hashes((b" " + b" ".join(held) + b" ").translate(_LOWER))
        ends = np.searchsorted(starts, 1 + np.cumsum([len(x) + 1 for x in held])).tolist()
        whole, a = shingled(h, size), 0
        for b in ends:
            s = np.sort(whole[a:b - size + 1]) if b - a >= size else shingled(h[a:b], b - a) if b > a else whole[:0]
            new = s[1:] != s[:-1]
            yield s if new.all() else s[np.concatenate(([True], new))]
            a = b

    held, length = [], 0
    for text in texts:
        held.append(text or b"")
        length += len(held[-1])
        if length > CHUNK_BYTES:
            yield from sets(held)
            held, length = [], 0
    if held:
        yield from sets(held)


def shortfall(n: int) -> int:
    """Shingles of n that an alike set may lack: n - ceil(0.75 n)."""
    return n - (3 * n + 3) // 4


def extension(n: int) -> int:
    return min(n // 2, 8 + n // 32)


def matches(n: Column) -> Column:
    """l of a lengthened class of n shingles."""
    return 1 + F.least(F.floor(n / 2), 8 + F.floor(n / 32))


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), seed=len(s)) - 2 ** 63 if len(s) else 0


def hot_apart(parts: list[np.ndarray]) -> dict[str, pa.Array]:
    """The columns ``PARTS`` of classes from their plain and longer parts.

    Shingles in more than ``HOT`` of these classes are hot: a class only counts them, and the first row names each of
    them (``burning``) with its number of classes (``times``).
    """
    ends = np.cumsum([len(x) for x in parts])
    token, at, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    split = [(x[~y], int(y.sum())) for x, y in zip(parts, np.split(count[at] > HOT, ends[:-1]))]
    burning = count > HOT
    kinds = pa.list_(pa.int64())
    none = [np.zeros(0, np.int64)] * (len(parts) // 2 - 1)
    return {"plain": pa.array([x for x, _ in split[::2]], kinds), "longer": pa.array([x for x, _ in split[1::2]], kinds),
            "hot_plain": pa.array([k for _, k in split[::2]], pa.int32()),
            "hot_all": pa.array([k + k2 for (_, k), (_, k2) in zip(split[::2], split[1::2])], pa.int32()),
            "burning": pa.array([token[burning], *none], kinds), "times": pa.array([count[burning].astype(np.int64), *none], kinds)}


def whole_prefixes(items: DataFrame) -> DataFrame:
    """Classes that are lengthened to their whole sets, in the shape of :func:`prefixes`."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [x for s in batch.column("items") for x in (np.asarray(s.values, dtype=np.int64), np.zeros(0, dtype=np.int64))]
                yield pa.RecordBatch.from_pydict({"c": batch.column("c"), **hot_apart(parts)})

    return items.select("c", "items").mapInArrow(cut, f"c long, {PARTS}")


def prefixes(docs: DataFrame) -> DataFrame:
    """One row per document: set size, class, and the class's prefix the first time a task meets it.

    Shingles that are hot within one Arrow batch stay behind: their number is all that is asked of a class, and a
    hot shingle's rows do not meet in one task.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, classes, parts = [], [], []
            if len(seen) > 500_000:
                seen = set()
            for s in shingle_sets(x.as_py() for x in batch.column("body")):
                c, p = class_of(s), shortfall(len(s)) + 1
                new = len(s) > 0 and c not in seen
                seen.add(c)
                sizes.append(len(s)), classes.append(c)
                parts += [s[:p], s[p:p + extension(len(s))]] if new else [s[:0], s[:0]]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int32()), "c": pa.array(classes, pa.int64()),
                **hot_apart(parts)})

    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(cut, SETS)


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(token, c, plain, hot) of shingles that at least two classes share.

    Rows stream in token order; a token is held back until it is known to be shared and whether it is hot, that is
    for at most ``HOT`` + 1 classes.
    """
    tokens = sets.select("c", F.explode("plain").alias("token"), F.lit(True).alias("plain")).union(
        sets.select("c", F.explode("longer").alias("token"), F.lit(False).alias("plain")))
    marks = sets.where(F.size("burning") > 0).select(F.explode("burning").alias("token")).distinct().select(
        F.lit(MARK).alias("c"), "token", F.lit(True).alias("plain"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # classes of the current token so far, while it may still be unshared or calm
        token, last, hot = None, None, False

        def released(rows: list[tuple], hot: bool) -> pa.RecordBatch:
            t, c, p = zip(*rows)
            return pa.RecordBatch.from_pydict({"token": pa.array(t, pa.int64()), "c": pa.array(c, pa.int64()),
                                               "plain": pa.array(p, pa.bool_()), "hot": pa.array([hot] * len(t), pa.bool_())})

        for batch in batches:
            t, c = batch.column("token").to_numpy(), batch.column("c").to_numpy()
            p = batch.column("plain").to_numpy(zero_copy_only=False)
            if not len(t):
                continue
            near = np.zeros(len(t), dtype=bool)  # a token without an equal neighbour is unshared
            near[1:] = t[1:] == t[:-1]
            near[:-1] |= near[1:]
            near |= (t == t[0]) | (t == t[-1])  # these may go on in other batches
            calm: list[tuple] = []
            burning: list[tuple] = []
            for x, y, z in zip(t[near].tolist(), c[near].tolist(), p[near].tolist()):
                if x != token:
                    calm += held if len(held) > 1 else []
                    token, last, held, hot = x, None, [], False
                if y == MARK:  # the least class, so it comes first
                    hot = True
                elif y != last:
                    last = y
                    (burning if hot else held).append((x, y, z))
                    if len(held) > HOT:
                        burning += held
                        held, hot = [], True
            if calm:
                yield released(calm, False)
            if burning:
                yield released(burning, True)
        if len(held) > 1:
            yield released(held, False)

    return tokens.unionByName(marks).repartition("token").sortWithinPartitions("token", "c").mapInArrow(
        keep, "token long, c long, plain boolean, hot boolean")


def hot_counts(sets: DataFrame, tokens: DataFrame) -> DataFrame:
    """(c, hot_plain, hot_all): at least as many hot shingles as the class has, and the exact numbers if its shingles
    left one task only; of all classes with shared shingles."""
    here = sets.where("hot_all > 0").groupBy("c").agg(F.max("hot_plain").alias("hot_plain"), F.max("hot_all").alias("hot_all"))
    there = tokens.groupBy("c").agg(F.count_if(F.col("hot") & F.col("plain")).alias("hot_plain"), F.count_if("hot").alias("hot_all"))
    return here.unionByName(there).groupBy("c").agg(F.sum("hot_plain").alias("hot_plain"), F.sum("hot_all").alias("hot_all"))


def cell_of(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens.view(np.uint64) ^ _MIX) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def hot_cells(sets: DataFrame, tokens: DataFrame) -> np.ndarray:
    """How many classes hold the hot shingles of a cell; 2 ** CELL_BITS cells, whatever the size of the input."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"cell": cell_of(batch.column("token").to_numpy()), "k": batch.column("k")})

    here = sets.where(F.size("burning") > 0).select(F.explode(F.arrays_zip("burning", "times")).alias("x")).select(
        F.col("x.burning").alias("token"), F.col("x.times").alias("k"))
    there = tokens.where("hot").groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    found = here.unionByName(there).mapInArrow(cut, "cell long, k long").groupBy("cell").agg(F.sum("k").alias("k")).toArrow()
    cells = np.zeros(1 << CELL_BITS, np.int64)
    cells[found["cell"].to_numpy()] = found["k"].to_numpy()
    return cells


def posted_shingles(packed: DataFrame, cells: np.ndarray) -> DataFrame:
    """(token, c, n, hots, l, sig) of packed classes (c, n, hots, items): the shingles with a cell that is not empty among the
    first n - ceil(0.75 n) + l, in the order of their cells' counts."""
    known = packed.sparkSession.sparkContext.broadcast(cells)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        for batch in batches:
            least, tokens, sigs = [], [], []
            for s in batch.column("items"):
                s = np.asarray(s.values, dtype=np.int64)
                k, l = counts[cell_of(s)], 1 + min(len(s) // 2, PACKED_MORE)
                first = np.lexsort((s, k))[:shortfall(len(s)) + l]
                least.append(l), tokens.append(s[first][k[first] > 0]), sigs.append(parities(s))
            yield pa.RecordBatch.from_pydict({
                "c": batch.column("c"), "n": batch.column("n"), "hots": batch.column("hots"), "l": pa.array(least, pa.int64()),
                "tokens": pa.array(tokens, pa.list_(pa.int64())), "sig": pa.array(sigs, pa.list_(pa.int64()))})

    rows = packed.select("c", "n", F.col("hots").cast("long").alias("hots"), "items").mapInArrow(
        cut, "c long, n int, hots long, l long, tokens array<bigint>, sig array<bigint>")
    # Plain fields, as the join condition must stay short enough to be compiled.
    sig = F.struct(*[F.get("sig", F.lit(i)).alias(f"s{i}") for i in range(BITS // 64)]).alias("sig")
    return rows.select(F.explode("tokens").alias("token"), "c", "n", "hots", "l", sig)


def whole_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(c, items) of the chosen (c, doc_id)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(x.as_py() for x in batch.column("body"))
            found = [(c, s) for c, s in zip(batch.column("c").to_pylist(), sets) if c == class_of(s)]
            yield pa.RecordBatch.from_pydict({"c": pa.array([x[0] for x in found], pa.int64()),
                                              "items": pa.array([x[1] for x in found], pa.list_(pa.int64()))})

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("body")).join(broadcast_within(chosen, 24), "doc_id")
    return rows.select("c", "body").mapInArrow(cut, "c long, items array<bigint>").dropDuplicates(["c"])


def parities(s: np.ndarray) -> np.ndarray:
    """``BITS`` parity bits of a set, as 64-bit numbers."""
    at = (mixed(s.view(np.uint64)) >> np.uint64(20)) % np.uint64(BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def within_bound(n: str, sig: str, n2: str, sig2: str) -> Column:
    """Whether two sets can be alike by size and parities."""
    apart = " + ".join(f"bit_count({sig}.s{i} ^ {sig2}.s{i})" for i in range(BITS // 64))
    return F.expr(f"4 * least({n}, {n2}) >= 3 * greatest({n}, {n2}) AND 7 * ({apart}) <= {n} + {n2}")


def packed_moves(dense: DataFrame, items: DataFrame, label: DataFrame) -> DataFrame | None:
    """(component, to): the components that links of packed classes join; None if there are none.

    ``dense``: (token, c, n, hots, l, sig), the posted shingles; ``label``: (node, component) of the links known before.
    """
    state = stored(dense.select("c").distinct().join(label.withColumnRenamed("node", "c"), "c", "left").select(
        "c", F.coalesce("component", "c").alias("component")), "state")
    first, joined, turn, last = state, False, 0, ROUNDS == 0
    while True:
        rest = dense.join(state, "c")
        central = -F.floor(1000 * F.col("hots") / F.col("n")) if turn == 0 else F.xxhash64("c", F.lit(turn))
        pivot = F.min(F.struct(central.alias("o"), F.col("c").alias("p"), F.col("n").alias("pn"),
                               F.col("component").alias("pc"), F.col("sig").alias("psig"))).alias("m")
        lists = rest.groupBy("token").agg(pivot, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        if not last:
            met = rest.join(lists.select("token", "m.p", "m.pn", "m.pc", "m.psig"), "token").where(
                (F.col("component") != F.col("pc")) & within_bound("n", "sig", "pn", "psig"))
            pairs = met.select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct()
        else:
            # Pairs that share a shingle that is not posted were compared before.
            left = rest.join(lists.select("token"), "token").drop("hots")
            other = left.select("token", F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("l").alias("l2"),
                                F.col("component").alias("k2"), F.col("sig").alias("sig2"))
            met = left.join(other, "token").where((F.col("component") < F.col("k2")) & within_bound("n", "sig", "n2", "sig2"))
            pairs = met.groupBy(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b")).agg(
                F.count(F.lit(1)).alias("k"), F.first(F.least("l", "l2")).alias("need")).where("k >= need").select("a", "b")
        found = stored(verified(pairs, items), "links")
        empty = found.isEmpty()
        if not empty:
            ends = found.join(state.toDF("a", "ca"), "a").join(state.toDF("b", "cb"), "b")
            moved = components(ends, "ca", "cb").toDF("component", "_to")
            state = stored(state.join(moved, "component", "left").select(
                "c", F.coalesce("_to", "component").alias("component")), "state")
            joined = True
        if last:
            return first.join(state.withColumnRenamed("component", "to"), "c").where("component <> to").select(
                "component", "to").distinct() if joined else None
        turn += 1
        last = empty or turn == ROUNDS


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose sets are alike: 100 * intersection >= 75 * union."""
    one = pairs.join(sets.select(F.col("c").alias("b"), F.col("items").alias("ib")), "b")
    two = one.join(sets.select(F.col("c").alias("a"), F.col("items").alias("ia")), "a")
    both = F.size(F.array_intersect("ia", "ib"))
    return two.where(100 * both >= 75 * (F.size("ia") + F.size("ib") - both)).select("a", "b")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing: their
    component is their own doc_id. Repeated rows share a component; a null doc_id has null as component
    unless linked to others. Extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce("doc_id", F.lit(MARK)).alias("doc_id"), "text")
    sets = stored(prefixes(docs), "sets")
    classes = stored(sets.where("n > 0").groupBy("c").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "classes")
    tokens = stored(shared_tokens(sets), "tokens")
    least = matches(F.ceil(0.75 * F.col("n")))
    heat = hot_counts(sets, tokens).join(classes.select("c", "n"), "c")
    level = (F.when(F.col("hot_plain") == 0, 0).when(F.col("hot_all") < least, 1).otherwise(2))
    heat = stored(heat.select("c", "n", "hot_all", level.alias("level")), "heat")

    posted = tokens.where("NOT hot").join(heat, "c").where("plain OR level > 0").select(
        "token", "c", "n", "hot_all", F.when(F.col("level") == 0, F.lit(1)).otherwise(matches(F.col("n"))).alias("l"), "level")
    right = posted.select("token", *[F.col(x).alias(x + "2") for x in ("c", "n", "hot_all", "l", "level")])
    need = F.greatest(F.lit(1), F.least("l", "l2") - F.when(F.least("level", "level2") == 0, F.lit(0)).otherwise(F.least("hot_all", "hot_all2")))
    close = (4 * F.least("n", "n2") >= 3 * F.greatest("n", "n2"))
    calm = posted.join(right, "token").where((F.col("c") < F.col("c2")) & close).groupBy(
        F.col("c").alias("a"), F.col("c2").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.first(need).alias("need")).where(
            "k >= need").select("a", "b")
    calm = stored(calm, "pairs")
    dense = heat.where("level = 2").select("c", "n")
    wanted = calm.select(F.col("a").alias("c")).union(calm.select(F.col("b").alias("c"))).union(dense.select("c")).distinct()
    items = stored(whole_sets(docs, classes.join(wanted, "c").select("c", "doc_id")), "items")

    # Dense classes by their whole sets; those with too few shingles that are not hot even so are packed.
    whole = items.join(heat.where("level = 2").select("c"), "c")
    sorts = stored(whole_prefixes(whole), "whole")
    tokens = stored(shared_tokens(sorts), "tokens")
    heat = stored(hot_counts(sorts, tokens).select("c", "hot_all").join(classes.select("c", "n"), "c"), "heat")
    posted = tokens.where("NOT hot").join(heat, "c").select("token", "c", "n", "hot_all")
    right = posted.select("token", *[F.col(x).alias(x + "2") for x in ("c", "n", "hot_all")])
    need = F.greatest(F.lit(1), F.ceil(0.75 * F.greatest("n", "n2")) - F.least("hot_all", "hot_all2"))
    more = posted.join(right, "token").where((F.col("c") < F.col("c2")) & close).groupBy(
        F.col("c").alias("a"), F.col("c2").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.first(need).alias("need")).where(
            "k >= need").select("a", "b")
    # Of the lengthened prefix of a packed class only the hot rest is posted: pairs that share another shingle were met.
    packed = heat.where("4 * hot_all >= 3 * n").select("c", "n", F.col("hot_all").alias("hots"))
    dense = stored(posted_shingles(packed.join(items, "c"), hot_cells(sorts, tokens)), "packed")
    edges = stored(verified(calm.union(more).distinct(), items), "links")
    label = components(edges, "a", "b")
    moved = None if dense.isEmpty() else packed_moves(dense, items, label)
    label = label.withColumnRenamed("node", "c")
    named = classes.join(label, "c", "left").withColumn("component", F.coalesce("component", "c"))
    if moved is not None:
        named = named.join(moved, "component", "left").withColumn("component", F.coalesce("to", "component"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = named.join(lowest, "component").select("c", "component_id")
    members = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("c")).alias("c"))
    return members.join(by_class, "c", "left").select(
        F.nullif("doc_id", F.lit(MARK)).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.nullif(F.coalesce("component_id", "doc_id"), F.lit(MARK)).alias("component_id"))


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir, "doc_id", "text"))
