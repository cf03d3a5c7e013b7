"""Phrase collocations by multikey quicksort of suffix pointers (operator 13).

Every word position is a pointer to the suffix of its piece that starts there, at most five words long. Pointers are
routed over the cluster by their two leading words. The sizes of all routes are counted first and routes below the
least count are abandoned before any pointer moves; a counting sketch of fixed size does the same for three leading
words, so that a pointer is cut where its phrase cannot be frequent any more. Equal pointers of one task travel as one
with a weight. Within a task a three-way quicksort splits the pointers by one word at a time: smaller, equal, larger; an equal part is one
phrase and its weight is the phrase's count, and parts below the least count are abandoned at once.

A word is known by a 64-bit hash of language and word. All words of the corpus are counted beforehand, and the hash is
salted anew until no two of them share one, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skywell.llm.bytetexts import slices
from skywell.llm.common import broadcast_within, documents, small_batches, stored
from skywell.llm.registry import query

# Fixed values of the contract: longest phrase, least count, rows a language, and the language of null.
DEPTH, LEAST, TOP, NO_LANG = 5, 100, 2000, "und"
WORD_BITS, ROUTE_BITS = 24, 26
SKETCH_BITS, SKETCH_BLOCK = 22, 256
BREAK = b"\n"
# A-Z to a-z, tab to space, every separator of pieces to the break.
MAPPED = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
HELD = 200_000
HELD_ROUTES, HELD_POINTERS, BATCH_ROWS = 1_000_000, 800_000, 50_000
BLOCK_WORDS, POINTERS_A_TASK, MOST_POINTERS = 500_000, 500_000, 3_000_000


def tokens(body: bytes) -> Iterator[list[bytes]]:
    """Words of a text, with a break between pieces and empty strings between two spaces; in parts, if it is long."""
    for part in slices(body.translate(MAPPED)):
        yield part.replace(BREAK, b" \n ").split(b" ")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(b"", None), counts.pop(BREAK, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                 pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = held.setdefault(lang, Counter())
            for part in tokens(body.as_py()):
                counts.update(part)
            if sum(map(len, held.values())) > HELD:
                yield from flush()
    yield from flush()


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit mix of several columns of numbers (routes only; equality is never taken from it)."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def has_bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class _Ids(dict):
    """Word to hash within one language; the break is 0 and the empty string -1."""

    def __init__(self, lead: bytes):
        self.lead = lead
        self.start()

    def start(self) -> None:
        self.clear()
        self.update({BREAK: 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(self.lead + word, 42)
        h = self[word] = h - (1 << 64) if h >> 63 else h
        return h


def _suffixes(batches: Iterator[pa.RecordBatch], salt: str, word_bits: np.ndarray) -> Iterator[tuple]:
    """Per block of texts: hashes of all words in order (0 between pieces and for words that are too rare)."""
    ids: dict[str, _Ids] = {}
    held, size = [], 0

    def block() -> np.ndarray:
        flat = np.concatenate([*held, np.zeros(1, np.int64)])
        flat = flat[flat != -1]
        flat[~has_bit(word_bits, flat.view(np.uint64) >> np.uint64(64 - WORD_BITS))] = 0
        return flat

    for batch in batches:
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            known = ids.get(lang)
            if known is None:
                known = ids[lang] = _Ids(f"{salt}{lang}\n".encode())
            held.append(np.zeros(1, np.int64))
            for part in tokens(body.as_py()):
                held.append(np.fromiter(map(known.__getitem__, part), np.int64, len(part)))
                size += len(part)
                if sum(map(len, ids.values())) > HELD:  # of all languages together
                    for x in ids.values():
                        x.start()
            if size > BLOCK_WORDS:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _routes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pairs of words, and their routes."""
    at = np.flatnonzero((flat[:-1] != 0) & (flat[1:] != 0))
    return at, mixed(flat[at], flat[at + 1]) >> np.uint64(64 - ROUTE_BITS)


def _count_routes(salt: str, word_bits: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            r, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(r)
            r, n = r[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            return r[first], np.add.reduceat(n, first)

        def rows() -> Iterator[pa.RecordBatch]:
            r, n = merged()
            for at in range(0, len(r), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(r[at:at + BATCH_ROWS].astype(np.int32)), pa.array(n[at:at + BATCH_ROWS])], ["route", "n"])

        for flat in _suffixes(batches, salt, word_bits):
            r, n = np.unique(_routes(flat)[1], return_counts=True)
            if len(r):
                held.append((r, n))
                size += len(r)
            if size > HELD_ROUTES:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD_ROUTES // 2:
                    yield from rows()
                    held, size = [], 0
        if held:
            yield from rows()
    return run


def _triples(flat: np.ndarray, route_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of alive pairs; which of them an alive pair follows; and the sketch cells of the three words there."""
    at, route = _routes(flat)
    at = at[has_bit(route_bits, route)]
    alive = np.zeros(len(flat) + 1, bool)
    alive[at] = True
    on = alive[at + 1]
    three = at[on]
    return at, on, mixed(flat[three], flat[three + 1], flat[three + 2]) >> np.uint64(64 - SKETCH_BITS)


def _count_triples(salt: str, word_bits: np.ndarray, route_bits: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for flat in _suffixes(batches, salt, word_bits):
            cells, n = np.unique(_triples(flat, route_bits)[2].astype(np.int64), return_counts=True)
            sketch[cells] += n
        rows = sketch.reshape(-1, SKETCH_BLOCK)
        some = np.flatnonzero(rows.any(1))
        for i in range(0, len(some), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(some[i:i + 1024].astype(np.int32)), pa.array(
                [rows[b].tobytes() for b in some[i:i + 1024]], pa.binary())], ["block", "counts"])
    return run


def _summed_triples(least: int) -> Callable:
    """Sketches of all tasks added up, as one bit per cell; all blocks together are of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(counts.as_py(), np.int64)
                sums[block] = sums[block] + found if block in sums else found
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(
                [np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()], pa.binary())], ["block", "bits"])
    return run


def sketch_bits(blocks: DataFrame, least: int) -> np.ndarray:
    found = blocks.repartition("block").mapInArrow(_summed_triples(least), "block int, bits binary").toArrow()
    out = np.zeros(((1 << SKETCH_BITS) // SKETCH_BLOCK, SKETCH_BLOCK // 8), np.uint8)
    for block, bits in zip(found["block"].to_pylist(), found["bits"].to_pylist()):
        out[block] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1).view(np.uint64)


def combined(words: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal pointers as one with the sum of their weights. A mix brings them together, the words decide equality."""
    order = np.argsort(mixed(*words))
    words = [w[order] for w in words]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
    first = np.flatnonzero(new)
    return [w[first] for w in words], np.add.reduceat(n[order], first)


def _point(salt: str, word_bits: np.ndarray, route_bits: np.ndarray, triple_bits: np.ndarray, heavy: np.ndarray) -> Callable:
    """Pointers (part, whole, w0..w4, n): ``whole`` is false where a route is dealt by its third word, too."""
    def pointers(flat: np.ndarray) -> list[np.ndarray] | None:
        at, on, cells = _triples(flat, route_bits)
        if not len(at):
            return None
        goes_on = np.zeros(len(flat) + DEPTH, bool)  # the three words that start here are alive
        goes_on[at[on][has_bit(triple_bits, cells)]] = True
        padded = np.concatenate([flat, np.zeros(DEPTH, np.int64)])
        words, on = [padded[at], padded[at + 1]], np.ones(len(at), bool)
        for d in range(2, DEPTH):
            on &= goes_on[at + d - 2]
            words.append(np.where(on, padded[at + d], 0))
        return words

    def rows(words: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        tidy = np.lexsort(words[::-1])  # neighbours alike, which compresses well
        words, n = [w[tidy] for w in words], n[tidy]
        pair = mixed(words[0], words[1])
        whole = ~np.isin(pair >> np.uint64(64 - ROUTE_BITS), heavy)
        part = np.where(whole, pair, mixed(words[0], words[1], words[2])).view(np.int64)
        for i in range(0, len(n), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[i:i + BATCH_ROWS]) for c in (part, whole, *words, n)], POINTER_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[list[np.ndarray], np.ndarray]:
            return combined([np.concatenate(c) for c in zip(*(w for w, _ in held))], np.concatenate([n for _, n in held]))

        for flat in _suffixes(batches, salt, word_bits):
            found = pointers(flat)
            if found is None:
                continue
            held.append(combined(found, np.ones(len(found[0]), np.int64)))
            size += len(held[-1][1])
            if size > HELD_POINTERS:
                held = [merged()]
                size = len(held[0][1])
                if size > HELD_POINTERS // 2:
                    yield from rows(*held[0])
                    held, size = [], 0
        if held:
            yield from rows(*merged())
    return run


POINTER_NAMES = ["part", "whole", *[f"w{d}" for d in range(DEPTH)], "n"]
POINTER_SCHEMA = "part long, whole boolean, " + ", ".join(f"w{d} long" for d in range(DEPTH)) + ", n long"


def quicksort(words: list[np.ndarray], n: np.ndarray, whole: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(a pointer, words, weight) of every phrase of two words or more with at least ``least`` occurrences.

    Phrases of two words among pointers that are not ``whole`` are told whatever their weight: other tasks hold more.
    """
    found, stack = [], [(np.arange(len(n)), 0)]
    while stack:
        rows, depth = stack.pop()
        key = words[depth][rows]
        pivot = key[len(key) // 2]
        for part, equal in ((rows[key < pivot], False), (rows[key == pivot], True), (rows[key > pivot], False)):
            if not len(part):
                continue
            weight = int(n[part].sum())
            open_ = depth < 2 and not whole[part].all()
            if weight < least and not open_:
                continue
            if not equal:
                stack.append((part, depth))
            elif pivot != 0:
                if depth:
                    found.append((int(part[0]), depth + 1, weight))
                if depth + 1 < DEPTH:
                    stack.append((part, depth + 1))
    return found


def _sorted_phrases(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def phrases(least_here: int) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            columns = {c: table[c].to_numpy() for c in POINTER_NAMES}
            words = [columns[f"w{d}"] for d in range(DEPTH)]
            found = quicksort(words, columns["n"], columns["whole"].astype(bool), least_here)
            if found:
                row, length, weight = (np.array(x, np.int64) for x in zip(*found))
                cut = [np.where(length > d, words[d][row], 0) for d in range(DEPTH)]
                yield from pa.Table.from_arrays([pa.array(x) for x in (*cut, weight)], [*POINTER_NAMES[2:7], "a"]).to_batches(BATCH_ROWS)

        over = False
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > MOST_POINTERS:  # more than fits: counts of parts, none abandoned, summed afterwards
                over = True
                yield from phrases(1)
                held, size = [], 0
        if held:
            yield from phrases(1 if over else least)
    return run


def _bits(df: DataFrame, at: str, bits: int) -> np.ndarray:
    """Bit set of the values of ``at`` in [0, 2^bits): at most 2^bits / 64 numbers come to the driver."""
    words = df.groupBy(F.shiftright(at, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST({at} & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros(1 << max(0, bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def hashed_words(counts: DataFrame) -> tuple[str, DataFrame]:
    """(salt, words with ``id``): the first salt under which all counted words have hashes of their own."""
    for attempt in range(1000):
        salt = "" if not attempt else f"{attempt}\n"
        named = stored(counts.withColumn("id", F.xxhash64(F.concat(F.lit(salt), "lang", F.lit("\n"), "word"))), "words")
        twice = named.groupBy("id").count().where("count > 1 OR id IN (0, -1)")
        if twice.isEmpty():
            return salt, named
    raise RuntimeError("no salt without equal hashes")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): every word (lang, word, n, id), and every phrase (ids, a) with at least ``least`` occurrences.

    ``docs`` has lang (not null) and body (bytes).
    """
    small_batches(docs.sparkSession)
    docs = docs.select("lang", "body")
    counts = docs.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))
    salt, words = hashed_words(counts)
    word_bits = _bits(words.where(F.col("n") >= least).withColumn(
        "at", F.shiftrightunsigned("id", 64 - WORD_BITS)), "at", WORD_BITS)
    routes = stored(docs.mapInArrow(_count_routes(salt, word_bits), "route int, n long").groupBy("route").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least), "routes")
    pointers = routes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    route_bits = _bits(routes.withColumn("at", F.col("route").cast("long")), "at", ROUTE_BITS)
    triple_bits = sketch_bits(docs.mapInArrow(_count_triples(salt, word_bits, route_bits), "block int, counts binary"), least)
    # Routes too large for one task are dealt by a third word; at most 100,000 of them.
    bound = max(POINTERS_A_TASK // 2, pointers // 100_000)
    heavy = routes.where(F.col("n") > bound).select("route").toArrow()["route"].to_numpy().astype(np.uint64)
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pointers // POINTERS_A_TASK))
    dealt = docs.mapInArrow(_point(salt, word_bits, route_bits, triple_bits, heavy), POINTER_SCHEMA).repartition(tasks, "part")
    lists = dealt.mapInArrow(_sorted_phrases(least), ", ".join(f"w{d} long" for d in range(DEPTH)) + ", a long")
    ids = F.filter(F.array(*[f"w{d}" for d in range(DEPTH)]), lambda w: w != 0)
    return words, stored(lists.groupBy(ids.alias("ids")).agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")


def scored(words: DataFrame, phrases: DataFrame, least: int = LEAST) -> DataFrame:
    """(ids, a, l, r): every phrase that no longer one explains, with its lowest-scoring cut and that score's n."""
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = stored(words.where(F.col("n") >= least).join(totals, "lang").select("id", "lang", "word", "n", "total"), "frequent")
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> "
                   "transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m))))")
    inside = phrases.where(F.size("ids") > 2).select(F.explode(inner).alias("ids"), F.col("a").alias("longer"))
    explained = inside.groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = phrases.join(explained, "ids", "left").where("longer IS NULL OR 100 * longer < 100 * a").select("ids", "a")
    total = frequent.select(F.col("id").alias("_first"), "total", "lang")
    kept = kept.join(broadcast_within(total, 64), F.col("ids")[0] == F.col("_first")).drop("_first")
    sizes = broadcast_within(stored(phrases.union(frequent.select(F.array("id"), "n")), "sizes"), 80)
    cuts = kept.select("ids", "a", "total", "lang", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    first, rest = F.expr("slice(ids, 1, k)"), F.expr("slice(ids, k + 1, size(ids) - k)")
    left, right = sizes.toDF("_ids", "l"), sizes.toDF("_ids2", "r")
    joined = cuts.withColumns({"_l": first, "_r": rest}).join(left, F.col("_l") == F.col("_ids")).join(
        right, F.col("_r") == F.col("_ids2"))
    wide = "DECIMAL(19, 0)"
    score = F.expr(f"(CAST(1000 * a AS {wide}) * CAST(total AS {wide})) div (CAST(l AS {wide}) * CAST(r AS {wide}))")
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    best = joined.groupBy("lang", "ids", "a", "total").agg(least_cut.alias("cut")).select(
        "lang", "ids", "a", F.col("total").alias("n"), "cut.score", "cut.l", "cut.r")
    spelled = best.select("ids", F.posexplode("ids").alias("at", "id")).join(
        broadcast_within(frequent.select("id", "word"), 64), "id").groupBy("ids").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return best.join(spelled, "ids")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of every language by score, then count, then phrase.

    A null text is empty, a null language is ``und``; repeated rows count every time; extra columns are ignored; an
    empty table gives no rows.
    """
    bodies = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"),
                         F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    words, phrases = phrase_counts(bodies, least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored(words, phrases, least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SEPARATORS = "[.,;:!?\\x0A-\\x0D]"
COLLOCATIONS_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '{SEPARATORS}')) AS piece
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, len(p) AS m, p, count(*) AS f
  FROM (SELECT lang, unnest(flatten(list_transform(range(1, {DEPTH + 1}),
               lambda m: list_transform(range(1, greatest(len(w) - m + 2, 1)), lambda s: w[s:s + m - 1])))) AS p FROM listed)
  GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
candidates AS (SELECT * FROM grams WHERE m > 1 AND f >= {LEAST}),
inside AS (
  SELECT lang, p, max(f) AS longer
  FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, m),
               lambda k: list_transform(range(1, m - k + 2), lambda s: p[s:s + k - 1])))) AS p
        FROM candidates WHERE m > 2)
  GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.p = i.p
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.f),
cuts AS (SELECT lang, p, f, m, unnest(range(1, m)) AS k FROM kept),
valued AS (
  SELECT c.lang, c.p, c.f, c.k, x.f AS l, y.f AS r, t.n,
         ((1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN grams x ON x.lang = c.lang AND x.p = c.p[1:c.k]
  JOIN grams y ON y.lang = c.lang AND y.p = c.p[c.k + 1:c.m]),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
named AS (SELECT lang, array_to_string(p, ' ') AS phrase, f AS a, l, r, n, score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= {TOP}
"""


@query("op13_phrase_collocations", COLLOCATIONS_SQL)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir, "lang", "text"))
