"""Counts over one text as Spark columns (no Python), shared by the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skywell.llm.common import SPACE, clean_text, let, words_of

# The symbols that are counted.
SYMBOLS = "#*$%&|<>"


def without(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def repeated_words(words: Column) -> Column:
    """Words lying in windows of three words that occur twice or more in the text (windows by 64-bit hash)."""
    def covered(at: Column) -> Column:  # ascending starts of such windows
        steps = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def starts(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, j: F.coalesce(
            (x["k"] == F.get(ordered, j + 1)["k"]) | (F.when(j > 0, x["k"] == F.get(ordered, j - 1)["k"])),
            F.lit(False)))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def count(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        some = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(some, let(let(pairs, starts), covered)).otherwise(F.lit(0))

    def windows(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(keys, count))

    return let(words, windows)


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus counts of the whole text; a null text counts as empty.

    n_words, word_chars (code points in words), n_chars_all, n_symbols, n_bangs, n_pipes, n_upper, n_digits,
    n_lines (lines with a word), n_dup_lines (equal to an earlier line), n_repeat_words, n_distinct_words.
    """
    keep = [F.col(c) for c in keep]
    t = docs.select(*keep, clean_text(text).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = words_of(F.col("_text"))
    body = F.regexp_replace("_text", SPACE, "")
    return t.select(
        *keep,
        let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"))).alias("_w"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"),
        F.length(body).cast("long").alias("word_chars"),
        F.length("_text").cast("long").alias("n_chars_all"),
        without(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        without(F.col("_text"), "!").cast("long").alias("n_bangs"),
        without(F.col("_text"), "|").cast("long").alias("n_pipes"),
        without(F.col("_text"), "0123456789").cast("long").alias("n_digits"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    ).select(*keep, "_w.*", "_l.*", "word_chars", "n_chars_all", "n_symbols", "n_bangs", "n_pipes", "n_digits",
             "n_upper")
