from __future__ import annotations

import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from skywell.llm import fingerprints, rules, sharding
from tests.llm.helpers import SCHEMA, WORD, documents, shingles, texts


def plain_fingerprints(rows):
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        a, b, c = shingles(text), shingles(edited), shingles(nxt)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), like(a, b), like(a, c), len(a))
    return out


def test_fingerprints_match_plain_version(spark):
    docs = documents(spark, extra=True)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = plain_fingerprints(rows)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert set(got) == set(want)
    for k, (n, sha, edited, nxt, size) in want.items():
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert abs(r["near_edited"] - edited) < 0.2 and abs(r["near_next"] - nxt) < 0.2
        if size < fingerprints.K:
            assert r["est_shingles"] == size
        else:
            assert abs(r["est_shingles"] - size) < 0.4 * size
    by_text = collections.defaultdict(set)
    for k, t in rows:
        by_text[t or ""].add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_small_sets_are_exact_and_sketches_merge(spark):
    rows = ["a b c d e f g h", "c d e f g h i j", "", None]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    want = plain_fingerprints([(3 * i + 1, t) for i, t in enumerate(rows)])
    for k in want:
        assert got[k]["near_next"] == pytest.approx(want[k][3]) and got[k]["near_edited"] == pytest.approx(want[k][2])
    merged = fingerprints.merged_sketches(docs.withColumn("g", F.lit(1)), ["g"]).first()["sketch"]
    assert merged == sorted(merged) and len(merged) == len(shingles(rows[0]) | shingles(rows[1]))


def test_next_text_with_uneven_repeated_and_null_ids(spark):
    ids = [None, 5, 5, 7, 8, 9, 10 ** 15, 10 ** 15 + 1, -4]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = sorted((r["text"], r["next_text"]) for r in fingerprints.with_next(df, rows_per_block=1).collect())
    order = sorted((i if i is not None else -2 ** 63, f"t{k}") for k, i in enumerate(ids))
    assert got == sorted((t, order[(i + 1) % len(order)][1]) for i, (_, t) in enumerate(order))


@pytest.mark.parametrize("op", [fingerprints.fingerprint_edits, sharding.shard_documents])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_rule_counts_match_plain_version(spark):
    docs = documents(spark, [*texts(), "a b a b a b", "l\nl\n \n \nl | # <x>", "a b c a b c x a b c"], extra=True)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = rules.quality_rules(docs, labels).collect()
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(want)
    for r in got:
        n = plain_counts(want[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r["kept"] == (not r["base_failed"])  # nothing is certified without labels


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.3), (200, 0.02), (3000, 0.01)):
        for k in range(0, int(n * p), 3):
            exact = sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))
            assert rules.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_certified_cutoffs_bound_false_rejections(spark):
    good = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(1500)]
    bad = [" ".join(f"w{i}x{j}!!" for j in range(60)) for i in range(200)]
    docs = documents(spark, good + bad)
    labels = docs.select("doc_id", (~F.col("text").contains("!")).cast("int").alias("quality"))
    out = rules.quality_rules(docs, labels).join(labels, "doc_id")
    assert out.where("quality = 1 AND NOT kept").count() == 0
    assert out.where("quality = 0 AND kept").count() == 0
    few = rules.quality_rules(docs, labels.limit(30))
    assert few.where("NOT kept").count() == 0


@pytest.mark.parametrize("rows", [texts(), ["same"] * 500, [f"t{i // 2}" for i in range(300)], ["a", None, ""]])
def test_shards_are_even_and_keep_groups(spark, rows):
    docs = documents(spark, rows, extra=True)
    got = sharding.shard_documents(docs).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard").size().reindex(range(24), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    text = {3 * i + 1: (t or "") for i, t in enumerate(rows)}
    got["text"] = got["doc_id"].map(text)
    assert (got["size"] == got["text"].map(lambda t: len(t.encode()) + 8)).all()
    cap = len(rows) // 24
    for _, g in got.groupby("text"):
        if len(g) <= max(1, cap // 8):
            assert g["shard"].nunique() <= 1
        elif cap:
            assert g["shard"].nunique() <= -(-len(g) // cap) + 2


def test_groups_stay_whole_where_shards_have_room(spark):
    got = sharding.shard_documents(documents(spark, [f"t{i // 3}" for i in range(1200)])).toPandas()
    got["g"] = (got["doc_id"] - 1) // 9
    assert (got.groupby("g")["shard"].nunique() > 1).mean() < 0.1


def test_rounds_go_on_until_every_member_has_a_shard(spark):
    groups = [2000, *[2 + i % 49 for i in range(150)]]
    cells, total = [], sum(groups)
    for g, n in enumerate(groups):
        cells += [(g, g, s, n // 24 + int((s + g) % 24 < n % 24)) for s in range(24)]
    quota = {s: total // 24 + int(s < total % 24) for s in range(24)}
    df = spark.createDataFrame([c for c in cells if c[3]], "g1 long, g2 long, shard int, n long")
    got = sharding.propagate(df, quota).collect()
    held, loads = [0] * len(groups), dict.fromkeys(quota, 0)
    for r in got:
        held[r["g1"]] += r["n"]
        loads[r["shard"]] += r["n"]
    assert held == groups and loads == quota
