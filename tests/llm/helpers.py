"""Small fixtures and plain versions that the operators are held against."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, words: int, marks: bool = True) -> str:
    syllables = ["an", "the", "or", "ti", "on", "er", "ing", "st", "é", "ou", "ß"]
    out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return " ".join(out) + ("." if marks else "")


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    """Null, empty, white space, one word, long, repeated, near copies, shared passages, odd characters."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    base = sentence(rng, 120).split(" ")
    out: list[str | None] = [None, "", " \n\t ", "word", "a b c", "x" * 3000, "Hent " * 400, "12 34 !!", "é" * 150 + "ß" * 150]
    for i in range(n):
        out.append(sentence(rng, rng.randint(1, 200)))
        if i % 4 == 0:
            out.append(out[-1])
        if i % 5 == 0:
            out.append(sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 20))
        if i % 2 == 0:
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = sentence(rng, 1, False)
            out.append(" ".join(copy))
    return out


def documents(spark, rows: list[str | None] | None = None, extra: bool = False):
    """Documents with ids that are not dense, and with columns whose names clash with the operators' own."""
    rows = texts() if rows is None else rows
    df = spark.createDataFrame([(3 * i + 1, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], SCHEMA)
    if extra:
        from pyspark.sql import functions as F
        for name in ("n", "c", "token", "score", "th", "start", "gram", "shard", "_keep", "block", "size"):
            df = df.withColumn(name, F.lit("clash"))
    return df.repartition(4)


def shingles(text: str | None) -> frozenset:
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
