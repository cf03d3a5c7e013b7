"""Spelling variants by permuterm rotations (operator 11).

A word gets a terminator and every rotation of it is listed. Rotated so that a chosen character comes last, a word
is a prefix plus that character: words that differ by one replaced character share the prefix, and the word without
the character is the prefix itself. One group of the sorted rotations therefore holds all words that fit one pattern
with one open place, and at most one word that lacks the place. A group has at most one word per character, so it is
bounded by the alphabet, and all its members are near each other: it is scanned once and tells every member its best
neighbour and its number of neighbours; no pair is formed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skywell.llm.bytetexts import LOWERED, keyed_bytes, slices
from skywell.llm.common import broadcast_within, documents, stored
from skywell.llm.registry import query

# Fixed values of the word rule: letters a-z and U+00C0 to U+00FF as UTF-8, one run in 97 is damaged, least
# length and count of a word, and how much more often a form must occur.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
DAMAGED, LEAST_LENGTH, LEAST_COUNT, TIMES = 97, 5, 3, 2
TERMINATOR = "$"  # no letter
HELD = 200_000


def _damaged(run: bytes, h: int) -> bytes:
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    crc, get = zlib.crc32, held.get
    for batch in batches:
        for key, body in zip(batch.column(0), batch.column(1)):
            seed = crc(key.as_py().encode() + b":")
            for part in slices(body.as_py()):
                for run, times in Counter(RUN.findall(part.translate(LOWERED))).items():
                    h = crc(run, seed)
                    if not h % DAMAGED:
                        run = _damaged(run, h)
                    if len(run) >= LEAST_LENGTH:
                        held[run] = get(run, 0) + times
                if len(held) > HELD:
                    yield flush()
    yield flush()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words with enough letters and occurrences. Counts are combined per task before the shuffle.

    A null text has no words; a null doc_id counts as the empty text in the damage rule.
    """
    rows = keyed_bytes(docs, F.coalesce(F.col(doc_id).cast("string"), F.lit("")), text)
    found = rows.mapInArrow(_count_runs, "word string, n long").where(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """(range, edited, run_start, n): every rotation as itself (``edited`` empty) and as its prefix range.

    ``run_start`` is false where the character before the edited one is the same: taking out either gives one word.
    """
    marked = F.concat("word", F.lit(TERMINATOR))
    turned = words.select("n", marked.alias("marked"), F.explode(F.sequence(F.lit(1), F.length(marked))).alias("at"))
    tail, head = F.expr("substring(marked, at + 1)"), F.expr("substring(marked, 1, at - 1)")
    last = F.expr("substring(marked, at, 1)")
    whole = F.struct(F.concat(tail, head, last).alias("range"), F.lit("").alias("edited"), F.lit(True).alias("run_start"))
    prefix = F.struct(F.concat(tail, head).alias("range"), last.alias("edited"),
                      (F.expr("at = 1 OR substring(marked, at - 1, 1) <> substring(marked, at, 1)")).alias("run_start"))
    roles = F.when(last == TERMINATOR, F.array(whole)).otherwise(F.array(whole, prefix))
    return turned.select("n", F.explode(roles).alias("r")).select("r.*", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of all words with a near word; ``best`` is its (-n, word) of largest n, then first in order."""
    groups = rotations(words).groupBy("range").agg(
        F.collect_list(F.struct((-F.col("n")).alias("neg"), "edited", "run_start")).alias("g")).where(F.size("g") > 1)
    parts = F.split("range", r"\$")
    named = groups.select(F.sort_array(F.transform("g", lambda m: F.struct(
        m["neg"].alias("neg"), F.concat(F.get(parts, F.lit(1)), m["edited"], F.get(parts, F.lit(0))).alias("word"),
        (m["edited"] == "").alias("short"), m["run_start"].alias("run_start")))).alias("g"))
    sizes = named.select(
        "g", F.size(F.filter("g", lambda m: ~m["short"])).alias("long"),
        F.exists("g", lambda m: m["short"]).alias("has_short"),
        F.size(F.filter("g", lambda m: ~m["short"] & m["run_start"])).alias("starts"))
    each = sizes.select("long", "has_short", "starts", "g", F.explode("g").alias("m"))
    best = F.when(F.col("m.word") == F.col("g")[0]["word"], F.col("g")[1]).otherwise(F.col("g")[0])
    near = F.when(F.col("m.short"), F.col("starts")).otherwise(
        F.col("long") - 1 + (F.col("has_short") & F.col("m.run_start")).cast("int"))
    told = each.select(F.col("m.word").alias("word"), near.cast("long").alias("near"),
                       F.struct(best["neg"].alias("neg"), best["word"].alias("word")).alias("best"))
    return told.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, each round twice as far. A form at least doubles n, so chains are short."""
    now = stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = broadcast_within(now.select(F.col("word").alias("_w"), F.col("root").alias("_r")), 96)
        now = stored(now.select("word", "root").join(ahead, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "forms")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """Every word of (word, n) with its form, root and number of near words. ``word`` must be distinct.

    A word without near words has n_near 0; without a form that occurs at least twice as often, form and form_n are
    null and root is the word itself. An empty table gives no rows.
    """
    words = stored(words.select("word", "n"), "words")
    best_n = -F.col("best.neg")
    near = stored(words.join(neighbours(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(best_n >= TIMES * F.col("n"), F.col("best.word")).alias("form"),
        F.when(best_n >= TIMES * F.col("n"), best_n).alias("form_n")), "variants")
    last = roots(near.where("form IS NOT NULL"))
    return near.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(documents(spark, sf_dir, "doc_id", "text")))
