"""Spelling variants, SimHash components and collocations against plain versions."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from skywell.llm import bytetexts, collocations, simhash, variants
from tests.llm.helpers import LOWER, SCHEMA, WORD, documents, texts

RUN = re.compile("[A-Za-zÀ-ÿ]+")


# --- spelling variants -------------------------------------------------------------------------------

def plain_words(rows):
    n = collections.Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def mutated(rng, word):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    letter = rng.choice("aabé×ÿ")
    return word[:at] + ("" if kind == 0 else letter) + word[at + (kind < 2):]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_match_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["aaaaa", "aabaab", "letter", "hello", "élanées", "abcdefghij" * 3]
    for _ in range(120):
        base.append(mutated(rng, rng.choice(base)))
    n = {w: rng.choice([3, 4, 6, 9, 12, 30, 60, 200]) for w in base if len(w) >= 5}
    words = spark.createDataFrame(list(n.items()), "word string, n long").withColumn("range", F.lit("clash"))
    got = [tuple(r) for r in variants.variants(words).collect()]
    assert len(got) == len(n) and set(got) == plain_variants(n)


def test_long_chain_of_forms(spark):
    n = {"b" * i + "a" * (40 - i): 3 * 2 ** i for i in range(25)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {tuple(r) for r in variants.variants(words).collect()} == plain_variants(n)


def test_word_counts_match_plain(spark):
    rng = random.Random(3)
    vocabulary = [mutated(rng, "Straße") + rng.choice(["n", "Ö", ""]) for _ in range(60)]
    rows = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 40, 400]))) + rng.choice(["", "Āx", "!"]) for _ in range(80)]
    rows += [None, "", "Ab-" * 20] + [rows[5]] * 3 + ["hello world " * 200_000]
    docs = documents(spark, rows, extra=True)
    docs = docs.unionByName(docs.limit(0).unionByName(spark.createDataFrame(
        [(None, "hello HELLO hellÖ hello " * 3, None, None, None)], SCHEMA), allowMissingColumns=True))
    want = plain_words([(3 * i + 1, t) for i, t in enumerate(rows)] + [(None, "hello HELLO hellÖ hello " * 3)])
    got = {r["word"]: r["n"] for r in variants.word_counts(docs).collect()}
    assert got == want
    assert {tuple(r) for r in variants.variants(variants.word_counts(docs)).collect()} == plain_variants(want)


def test_empty_table_has_no_variants(spark):
    assert variants.variants(variants.word_counts(documents(spark, []))).collect() == []


# --- SimHash -----------------------------------------------------------------------------------------

def plain_fingerprint(text):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    """fps: (doc_id, fingerprint) -> component per row by comparing all pairs of distinct fingerprints."""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for d, f in fps:
        if d is not None:
            low[find(f)] = min(d, low.get(find(f), d))
    return sorted(((d if d is not None else -1), f"{f:016x}", low.get(find(f))) for d, f in fps)


def test_fingerprints_match_plain(spark):
    rows = texts(4, 60) + ["long words here and there " * 90_000]
    docs = documents(spark, rows, extra=True)
    got = {r["doc_id"]: r["fp"] & (2 ** 64 - 1) for r in simhash.fingerprints(docs).collect()}
    assert got == {3 * i + 1: plain_fingerprint(t) for i, t in enumerate(rows)}


def test_slices_keep_words_whole():
    rng = random.Random(6)
    body = " ".join("w" * rng.randint(1, 30) for _ in range(500)).encode()
    for size in (1, 7, 100, 10 ** 6):
        parts = list(bytetexts.slices(body, size=size))
        assert b"".join(parts) == body
        assert [w for p in parts for w in p.split()] == body.split()


def test_simhash_components_match_all_pairs(spark):
    rows = texts(5, 80) + [None, "", "ab", "A B", "a b"]
    rows += [rows[20]] * 40
    docs = documents(spark, rows, extra=True)
    nobody = spark.createDataFrame([(None, t, "en", "s", 1) for t in (rows[20], None, "alone here with no id at all")], SCHEMA)
    docs = docs.unionByName(nobody, allowMissingColumns=True)
    want = plain_groups([(3 * i + 1, plain_fingerprint(t)) for i, t in enumerate(rows)] + [
        (None, plain_fingerprint(t)) for t in (rows[20], None, "alone here with no id at all")])
    got = sorted(((r[0] if r[0] is not None else -1), r[1], r[2]) for r in simhash.near_components(docs).collect())
    assert got == want


def flipped(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def test_links_reach_two_bits_also_in_crowds(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, 2 ** 64 - 1, centre, 1, 3, 7}
    fps |= {flipped(rng, centre, rng.randint(1, 4)) for _ in range(500)}  # more than a cell holds
    fps |= {flipped(rng, f, rng.randint(1, 3)) for f in list(fps)[:200]}
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = [(r[0] & (2 ** 64 - 1), r[1] & (2 ** 64 - 1)) for r in simhash.links(table).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    want = plain_groups([(i, f) for i, f in enumerate(sorted(fps))])
    root_of = {}
    for i, f, c in want:
        root_of.setdefault(c, set()).add(find(int(f, 16)))
    assert all(len(r) == 1 for r in root_of.values()) and len(root_of) == len({find(f) for f in fps})
    assert len(edges) < 40 * len(fps)  # not all pairs of the crowd


def test_cells_bound_the_distance(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        a = rng.choice([rng.getrandbits(64), 0, 2 ** 64 - 1, rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)])
        pairs.append(tuple(int(np.uint64(x).astype(np.int64)) for x in (a, flipped(rng, a, rng.randint(0, 2)))))
    met = spark.createDataFrame(pairs, "a long, b long").select(
        F.arrays_overlap(simhash.grid_cells(F.col("a")), simhash.grid_cells(F.col("b"))).alias("m"))
    assert all(r["m"] for r in met.collect())


def test_no_documents_no_components(spark):
    assert simhash.near_components(documents(spark, [])).collect() == []


# --- collocations ------------------------------------------------------------------------------------

def plain_collocations(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        explained = {p[i:i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                     if 100 * a >= 100 * found[p[i:i + m]]}
        rated = []
        for p, a in found.items():
            if p not in explained:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rated)[:top])]
    return sorted(out)


def phrase_rows(seed, long):
    rng = random.Random(seed)
    common, rare = ["of", "the", "a", "Und", "é", "new york", "x"], [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = [rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.choice([0, 1, 3, 30, 150]))]
        rows.append((rng.choice(["en", "de", None]), "".join(x + rng.choice([" ", "  ", "\t", ". ", "\n", "\x0b", "\xa0"] if rng.random() < 0.3 else [" "]) for x in w)))
    rows += [("en", None), (None, ""), ("en", "one hot line of words that all have") ] * 70
    return rows + [("de", "ab ab ab cd " * long), ("fr", "a b c d e f g " * 30)]


@pytest.mark.parametrize("tight", [False, True])
def test_collocations_match_brute_force(spark, monkeypatch, tight):
    if tight:  # every table of a task overflows, and most routes are heavy
        monkeypatch.setattr(collocations, "POINTERS_A_TASK", 40)
        monkeypatch.setattr(collocations, "MOST_POINTERS", 400)
        monkeypatch.setattr(collocations, "HELD_ROUTES", 10)
        monkeypatch.setattr(collocations, "HELD_POINTERS", 50)
        monkeypatch.setattr(collocations, "BLOCK_WORDS", 300)
        monkeypatch.setattr(collocations, "HELD", 5)
    rows = phrase_rows(1, 300 if tight else 100_000)
    docs = spark.createDataFrame([(t, l, "clash", 1) for l, t in rows], "text string, lang string, word string, n int")
    got = sorted(tuple(r) for r in collocations.collocations(docs.repartition(6), least=12, top=90).collect())
    assert got == plain_collocations(rows, 12, 90)


def test_a_batch_of_sketches_and_the_known_words_are_small(monkeypatch):
    rng = random.Random(4)
    bodies = [" ".join(rng.choices("abcdefgh", k=2000)).encode() for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 20), pa.array(bodies, pa.binary())], ["lang", "body"])
    every = np.full(1 << 20, ~np.uint64(0), np.uint64)
    found = [len(x.as_py()) for b in collocations._count_triples("", every, every)(iter([batch])) for x in b.column("counts")]
    assert found and 10_000 * max(found) <= 32 << 20  # Spark's largest Arrow batch has 10,000 rows

    made = []
    monkeypatch.setattr(collocations, "HELD", 100)
    monkeypatch.setattr(collocations, "_Ids", lambda lead, kind=collocations._Ids: made.append(kind(lead)) or made[-1])
    rows = [(f"l{k % 10}", " ".join(f"w{k}x{i}" for i in range(20)).encode()) for k in range(40)]
    words = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows], pa.binary())], ["lang", "body"])
    flat = np.concatenate(list(collocations._suffixes(iter([words]), "", every)))
    assert len(np.unique(flat)) == 801 and sum(map(len, made)) <= 140


def test_quicksort_counts_all_phrases():
    rng = np.random.default_rng(2)
    words = [rng.integers(1, 5, 3000) for _ in range(5)]
    for d in range(2, 5):
        words[d][(words[d - 1] == 0) | (rng.random(3000) < 0.2)] = 0
    n = rng.integers(1, 4, 3000)
    want = collections.Counter()
    for i in range(3000):
        for m in range(2, 6):
            if words[m - 1][i] == 0:
                break
            want[tuple(int(words[d][i]) for d in range(m))] += int(n[i])
    found = collocations.quicksort(words, n, np.ones(3000, bool), 9)
    got = {tuple(int(words[d][i]) for d in range(m)): a for i, m, a in found}
    assert len(got) == len(found) and got == {p: a for p, a in want.items() if a >= 9}


def test_equal_hashes_are_salted_apart(spark):
    words = spark.createDataFrame([("en", f"w{i}", i) for i in range(50)], "lang string, word string, n long")
    salt, named = collocations.hashed_words(words)
    assert salt == "" and named.select("id").distinct().count() == 50
    ids = collocations._Ids(b"en\n")
    assert {r["word"]: r["id"] for r in named.collect()} == {f"w{i}": ids[f"w{i}".encode()] for i in range(50)}


def test_exact_score_beyond_64_bits(spark):
    big = 3 * 10 ** 12
    words = spark.createDataFrame([("en", "a", big, 1), ("en", "b", big, 2), ("en", "c", 10 ** 12 + 7, 3)],
                                  "lang string, word string, n long, id long")
    phrases = spark.createDataFrame([([1, 2], big - 1)], "ids array<long>, a long")
    row = collocations.scored(words, phrases).first()
    assert row["score"] == 1000 * (big - 1) * (2 * big + 10 ** 12 + 7) // (big * big)


def test_no_documents_no_phrases(spark):
    assert collocations.collocations(documents(spark, [])).collect() == []
