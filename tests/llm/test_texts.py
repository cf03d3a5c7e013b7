from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywell.llm import classifier, edits, jaccard, languages, packing, sentences, suffixes, tokenizing
from tests.llm.helpers import SCHEMA, documents, sentence, shingles, texts


# --- near duplicates ---------------------------------------------------------------------------------

def plain_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(n, words, changes, seed=5):
    rng = random.Random(seed)
    base = sentence(rng, words).split(" ")
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(len(copy))] = sentence(rng, 2, False).replace(" ", "")
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("rows", [
    texts(2, 80),
    near_copies(150, 120, 6),              # a group beyond the hot limit, around the threshold
    near_copies(60, 40, 3) + near_copies(60, 40, 3, 9) + texts(3, 20),
    [f"{sentence(random.Random(i), 12)} {' '.join('boilerplate line of words that many share'.split() * 2)}" for i in range(90)],
    ["same words in every one of these"] * 80 + [None, "", " "],
])
def test_components_match_all_pairs(spark, rows):
    docs = documents(spark, rows, extra=True)
    want = plain_components([(3 * i + 1, t) for i, t in enumerate(rows)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(docs).collect()}
    assert got == want


@pytest.mark.parametrize("rounds", [0, 1])
def test_packed_classes_lose_no_link_without_pivots(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rows = near_copies(170, 110, 7, 3) + near_copies(50, 30, 3, 11) + near_copies(90, 200, 14, 12)
    want = plain_components([(3 * i + 1, t) for i, t in enumerate(rows)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(documents(spark, rows)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) > 3


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 20, 150, 3000):
        a = np.unique(rng.integers(-2 ** 63, 2 ** 63 - 1, n))
        b = np.unique(np.concatenate([a[: n - n // 5], rng.integers(-2 ** 63, 2 ** 63 - 1, n // 4)]))
        x = jaccard.parities(a) ^ jaccard.parities(b)
        bits = sum(bin(int(v) & (2 ** 64 - 1)).count("1") for v in x)
        assert len(x) == jaccard.BITS // 64 and bits <= len(np.setxor1d(a, b))
        assert not (jaccard.parities(a) ^ jaccard.parities(a)).any()


def test_words_hash_by_their_bytes_alone():
    words = ["a", "aaaaaaaa", "aaaaaaaaa", "\0", "\0\0", "é" * 40, "x" * 64, "x" * 65, "x" * 70_000, "Abc", "abc", "\xa0", "b\x00"]
    known = {w: next(iter(jaccard.shingle_sets([w.encode()]))).tolist() for w in words}
    assert known["Abc"] == known["abc"] and len({tuple(x) for x in known.values()}) == len(words) - 1
    rows = [t.encode() if t is not None else None for t in texts(8, 80)] + [b" \x0b".join(w.encode() for w in words)] * 2
    together, alone = list(jaccard.shingle_sets(rows)), [next(iter(jaccard.shingle_sets([r]))) for r in rows]
    assert all(a.tolist() == b.tolist() for a, b in zip(together, alone, strict=True))
    assert [len(s) for s in together] == [len(shingles(None if r is None else r.decode())) for r in rows]


def test_hot_shingles_leave_a_batch_once(spark):
    for n in (200, 400):
        docs = documents(spark, near_copies(n, 110, 3)).coalesce(1)
        sets = jaccard.prefixes(docs).cache()
        named = [t for r in sets.where("size(burning) > 0").collect() for t in r["burning"]]
        assert len(named) == len(set(named)) < 110 and sets.where("hot_all > 5").count() > 0.5 * n
        assert sets.where("hot_all < hot_plain OR size(plain) + hot_plain > n").isEmpty()


def test_prefix_law_holds():
    for n in range(1, 400):
        ext = jaccard.extension(n)
        assert jaccard.shortfall(n) == n - -(-3 * n // 4)
        assert 1 + ext <= -(-3 * n // 4)  # l never exceeds the least overlap
        assert jaccard.extension(n + 1) >= ext


# --- repeated strings --------------------------------------------------------------------------------

def plain_removal(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                mask[i:i + length] = True
        kept = bytes(x for x, m in zip(b, mask) if not m)
        out[d] = (len(b), int(mask.sum()), int((mask[1:] & ~mask[:-1]).sum() + mask[0]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [200, 64])
def test_removal_matches_plain_version(spark, length, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)  # long texts are cut into many blocks
    rows = [*texts(4, 40), "ab" * 500, "z" * 900, ("q" * 199) + "r"]
    want = plain_removal([(3 * i + 1, t) for i, t in enumerate(rows)], length)
    out = suffixes.without_repeats(documents(spark, rows, extra=True), ["doc_id"], length)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect()}
    assert got == want


def test_a_block_of_suffixes_is_small():
    """A task holds one block of texts and its identifiers, not those of a batch."""
    import tracemalloc

    rows = (random.Random(i).randbytes(2000) for i in range(1000))
    tracemalloc.start()
    runs = sum(len(suffixes.runs_of(parts, 200)[0]) for _, _, parts in suffixes.blocks(rows, 200))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert runs > 1000 and peak < 20 << 20


def test_removal_with_repeated_and_null_ids(spark):
    long = sentence(random.Random(1), 60)
    df = spark.createDataFrame([(1, long), (1, long), (1, "short"), (None, long + "x"), (None, None)], "doc_id long, text string")
    out = suffixes.without_repeats(df, ["doc_id"]).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in out) == sorted(
        [(len(long.encode()),) * 2] * 2 + [(5, 0), (len(long.encode()) + 1, len(long.encode())), (0, 0)])


# --- packing -----------------------------------------------------------------------------------------

def test_packing_is_gapless_and_matches_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import zlib
    rows = [*texts(6, 60), "<|endoftext|> inside", "   \n\n  x  ", " ".join(["long words here"] * 1500)]
    got = packing.pack(documents(spark, rows, extra=True)).toPandas()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    for i, t in enumerate(rows):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = got[got["doc_id"] == 3 * i + 1].sort_values("piece")
        assert list(mine["piece"]) == list(range(len(mine))) and mine["length"].sum() == len(ids)
        assert (mine["length"].iloc[1:] == 1024).all()
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum().iloc[:-1]] and g["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) + 2


def test_packing_query_takes_the_added_token_as_the_library(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    import zlib
    rng, end = random.Random(7), "<|endoftext|>"
    parts = [end, end[:-1], " ", "  ", "\n", "a", "def ", "é", "12", "'s", "<|", "|>"]
    rows = [None, "abc <|endoftext|> def", end, end * 3, (" longer" + end) * 900,
            *["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)]]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for out in (packing.op3_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        by_doc = {k: g.sort_values("piece") for k, g in out.toPandas().groupby("doc_id")}
        for i, t in enumerate(rows):
            ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
            mine = by_doc[3 * i + 1]
            assert mine["length"].sum() == len(ids), t
            assert [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in mine.itertuples()] == list(mine["ids_crc32"]), t


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    for _ in range(30):
        counts = {s: rng.choice([1, 2, 7, 1000]) for s in rng.sample(range(1, 101), rng.randint(1, 40))}
        rows, bins = packing.plan(counts, 100), collections.defaultdict(list)
        for s, first, n, bin0, per, offset in rows:
            for k in range(n):
                bins[bin0 + k // per].append((offset + k % per * s, s))
        numbers = collections.Counter()
        for s, first, n, *_ in rows:
            assert first == numbers[s]
            numbers[s] += n
        assert dict(numbers) == {s: c for s, c in counts.items() if s < 100}
        for b in bins.values():
            at = 0
            for offset, s in sorted(b):
                assert offset == at
                at += s
            assert at <= 100 and sum(3 * s > 100 for _, s in b) <= 2


def test_large_pieces_match_greedily():
    # 60+40, 55+45 and 50+50 leave no better matching
    assert len({r[3] for r in packing.plan({60: 1, 40: 1, 55: 1, 45: 1, 50: 2}, 100)}) == 3


# --- pieces ------------------------------------------------------------------------------------------

def test_pieces_match_library_and_decode(spark):
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [*texts(8, 12), " lead", "trail ", "a   b", "tab\tand\nline", "①② 中文 字", "▁mark"]
    docs = documents(spark, rows, extra=True)
    coded = sentences.encode(docs, ["doc_id"], block_bytes=4000)
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    for i, t in enumerate(rows):
        assert got[3 * i + 1] == m.encode(t or ""), repr(t)[:50]
    back = {r["doc_id"]: r["text"] for r in sentences.decode(coded, ["doc_id"]).collect()}
    assert all(back[3 * i + 1] == (t or "").replace("▁", " ") for i, t in enumerate(rows))


def test_pieces_of_odd_tables(spark):
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    long = " ".join(["several", "words", "x" * 300] * 2000)
    rows = [(1, long), (1, "one text"), (1, "one text"), (None, "no id"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("word", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in sentences.encode(df, ["doc_id"], block_bytes=2000).collect()))
    assert got == sorted(((i or 0, m.encode(t or "")) for i, t in rows))
    assert sentences.encode(df.limit(0), ["doc_id"]).collect() == []


def test_texts_and_words_are_shuffled_once(spark):
    coded = sentences.encode(documents(spark, texts(9, 12)), ["doc_id"], block_bytes=4000)
    coded.collect()
    plan = coded._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "Reused" not in x]
    # Texts, words asked for and answers move once each.
    assert [sum(f"hashpartitioning({c}" in x for x in shuffles) for c in ("block", "bucket", "word")] == [2, 1, 0], plan
    assert plan.count("ReusedExchange") == 2 and "parquet" not in plan.lower()


def test_viterbi_takes_the_cheapest_path(spark):
    table = [("a", -1.0), ("b", -1.0), ("ab", -1.5), ("abc", -4.0), ("bc", -1.2), ("c", -3.0)]
    words = spark.createDataFrame([("abc",), ("ab",), ("cab",), ("abxbc",)], "word string")
    got = {r["word"]: r["lens"] for r in sentences.segmented(words, spark.createDataFrame(table, "piece string, score double"), "viterbi").collect()}
    assert got == {"abc": "12", "ab": "2", "cab": "12", "abxbc": "212"}


# --- edits -------------------------------------------------------------------------------------------

def test_edits_equal_counting_afresh():
    coder, rng = tokenizing.encoding(tokenizing.rank_file()), random.Random(3)
    count = edits.Counter(coder)
    letters = " \n\t'sa1é,.  \r!l l"
    for i in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) if i % 2 else sentence(rng, 300)
        tree = edits.CountTree(text, count)
        for _ in range(4):
            a = rng.randint(0, len(text) + 3)
            b = a + rng.choice([0, 3, 300])
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 9, 3000 if i % 40 == 0 else 2])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[max(a, b):]
            assert tree.text() == text and tree.n_tokens == len(coder.encode_ordinary(text))
            assert [p for x in tree.blocks for p in x] == edits.SPLIT.findall(text)
    tree = edits.CountTree(sentence(random.Random(1), 5000), count)
    tree.edit(9000, 9003, "new")
    assert tree.reencoded < 20


def test_edited_counts_query_shape(spark):
    docs = documents(spark, ["some text", None, ""]).withColumn(
        "edits", F.expr("array(struct(2L AS start, 99L AS stop, ' tail' AS text))"))
    got = {r["doc_id"]: r for r in edits.edited_counts(docs).collect()}
    assert got[1]["n_chars_edited"] == 7 and got[4]["n_tokens"] == 0 and got[7]["n_tokens_edited"] == 1


# --- trained models ----------------------------------------------------------------------------------

def test_gradient_is_right():
    rng = np.random.default_rng(0)
    p = {"w": rng.normal(size=(2, 256, 9)), "u": rng.normal(size=(2, 3, 9)), "b": rng.normal(size=(2, 3)),
         "v": rng.normal(size=(6, 2)), "c": np.zeros(2)}
    x, mask = languages.framed([b"ab", b"abcd", b"z"])
    y = np.array([0, 1, 1])
    _, g = languages.gradients(p, x, mask, y)
    for k, at in (("w", (0, 97, 4)), ("w", (1, 98, 7)), ("u", (0, 1, 5)), ("u", (1, 2, 8)), ("b", (1, 0)), ("v", (4, 1)), ("c", (0,))):
        side = []
        for step in (1e-3, -1e-3):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += step
            side.append(languages.gradients(q, x, mask, y)[0])
        assert g[k][at] == pytest.approx((side[0] - side[1]) / 2e-3, rel=0.05, abs=1e-4)


def test_languages_and_edge_cases(spark):
    rng = random.Random(4)
    words = {"xx": ["kra", "zok", "tuk", "vri"], "yy": ["lao", "mei", "oua", "ane"]}
    rows = [(i, " ".join("".join(rng.choice(words[k]) for _ in range(2)) for _ in range(30)), k) for i in range(80) for k in ("xx", "yy")]
    rows = [(j, t, k) for j, (_, t, k) in enumerate(rows)] + [(900, None, "xx"), (901, "", None), (902, "123 !!", "yy"), (903, "w" * 5000, None), (None, "kra zok", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = languages.language_id(df, steps=120).join(df.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 900:
            assert r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1
        elif r["doc_id"] in (900, 901, 902):
            assert r["lang_pred"] == "und"
    assert languages.language_id(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in languages.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_classifier_learns_and_handles_edges(spark):
    rng = random.Random(5)
    rows = [sentence(rng, 80) if i % 3 else (" ".join(["same"] * 80) if i % 2 else sentence(rng, 80).replace(" ", "## ")) for i in range(400)]
    docs = documents(spark, [*rows, None, ""], extra=True)
    labels = spark.createDataFrame([(3 * i + 1, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (1, None), (4, 1)], "doc_id long, quality int")
    got = classifier.score_quality(docs, labels, ["doc_id"]).toPandas()
    assert len(got) == 402 and got["score"].between(0, 1).all()
    truth = got["doc_id"].map(lambda d: (d - 1) // 3 % 3 > 0)
    known = got["doc_id"] < 1200
    assert ((got["predicted"] == 1) == truth)[known].mean() > 0.98
    none = classifier.score_quality(docs, labels.limit(0), ["doc_id"]).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
