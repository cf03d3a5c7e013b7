"""Language identification with a bidirectional gated recurrent network over bytes (operator 7).

The network reads the bytes of each word between two spaces, forwards and backwards, and labels every
position. It is trained in numpy by backpropagation through time on words of a bounded sample of documents
(about ``per_language`` of each language, chosen by a hash of the id, whole texts). A document pools the
log probabilities of all its positions; since the state starts afresh at each word, a word met again in a
task reuses its labels. Words beyond ``PIECE`` bytes are read in pieces of that size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skywell.llm.common import documents
from skywell.llm.registry import query

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECE, HIDDEN, STEPS, BATCH, REMEMBERED = 24, 16, 400, 256, 200_000


def framed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ' word ' per row, padded with zeros, and the mask of real positions."""
    size = max(map(len, words)) + 2
    x = np.frombuffer(b"".join((b" " + w + b" ").ljust(size, b"\0") for w in words), dtype=np.uint8).reshape(-1, size)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    return x, (np.arange(size) < lengths[:, None]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def scan(w, u, b, x, mask, backwards, kept=None):
    """States (rows, positions, hidden) of one direction; ``kept`` collects what the backward pass needs."""
    rows, size, h = len(x), x.shape[1], np.zeros((len(x), u.shape[0]), dtype=np.float32)
    n_hidden, out = u.shape[0], np.empty((rows, size, u.shape[0]), dtype=np.float32)
    for t in reversed(range(size)) if backwards else range(size):
        own, rec, m = w[x[:, t]], h @ u, mask[:, t:t + 1]
        gates = _sigmoid(own[:, :2 * n_hidden] + rec[:, :2 * n_hidden])
        z, r = gates[:, :n_hidden], gates[:, n_hidden:]
        q = rec[:, 2 * n_hidden:] + b
        n = np.tanh(own[:, 2 * n_hidden:] + r * q)
        new = h + m * (n + z * (h - n) - h)
        if kept is not None:
            kept.append((t, h, z, r, q, n, m))
        h = out[:, t] = new
    return out


def scan_back(w, u, x, d_out, kept):
    """Gradients of one direction's parameters, through time."""
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(u.shape[0], dtype=np.float32)
    dh = np.zeros_like(d_out[:, 0])
    for t, h, z, r, q, n, m in reversed(kept):
        dh = dh + d_out[:, t]
        dnew, dprev = m * dh, (1 - m) * dh
        dan = dnew * (1 - z) * (1 - n * n)
        daz, dar = dnew * (h - n) * z * (1 - z), dan * q * r * (1 - r)
        dq = dan * r
        rec = np.concatenate([daz, dar, dq], axis=1)
        du += h.T @ rec
        db += dq.sum(0)
        np.add.at(dw, x[:, t], np.concatenate([daz, dar, dan], axis=1))
        dh = dprev + dnew * z + rec @ u.T
    return dw, du, db


def log_probabilities(p: dict, x: np.ndarray, mask: np.ndarray, kept: list | None = None):
    both = [scan(p["w"][d], p["u"][d], p["b"][d], x, mask, bool(d), None if kept is None else kept[d]) for d in (0, 1)]
    states = np.concatenate(both, axis=2)
    logits = states @ p["v"] + p["c"]
    logits -= logits.max(axis=2, keepdims=True)
    return states, logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over all positions and its gradient."""
    kept: list = [[], []]
    states, logp = log_probabilities(p, x, mask, kept)
    total = mask.sum()
    loss = -float((logp[np.arange(len(y)), :, y] * mask).sum() / total)
    d = np.exp(logp)
    d[np.arange(len(y)), :, y] -= 1
    d *= mask[:, :, None] / total
    ds, h = d @ p["v"].T, p["u"].shape[1]
    one, two = (scan_back(p["w"][k], p["u"][k], x, ds[:, :, k * h:(k + 1) * h], kept[k]) for k in (0, 1))
    return loss, {"w": np.stack([one[0], two[0]]), "u": np.stack([one[1], two[1]]), "b": np.stack([one[2], two[2]]),
                  "v": np.einsum("bth,btl->hl", states, d), "c": d.sum((0, 1))}


def train(words: list[list[bytes]], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 7) -> dict:
    """Parameters after ``steps`` of Adam; every batch holds equally many words of each language."""
    rng, n = np.random.default_rng(seed), len(words)
    p = {"w": rng.normal(0, 0.3, (2, 256, 3 * hidden)), "u": rng.normal(0, 0.25, (2, hidden, 3 * hidden)),
         "b": np.zeros((2, hidden)), "v": rng.normal(0, 0.2, (2 * hidden, n)), "c": np.zeros(n)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    y = np.arange(BATCH) % n
    for step in range(1, steps + 1):
        rate = 0.02 * min(1.0, 2 * (1 - (step - 1) / steps))
        x, mask = framed([words[k][rng.integers(len(words[k]))] for k in y])
        _, g = gradients(p, x, mask, y)
        norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in g.values()))))
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k] / norm
            second[k] = 0.99 * second[k] + 0.01 * (g[k] / norm) ** 2
            p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)
    return p


def cut(word: str) -> list[bytes]:
    b = word.encode()
    return [b[i:i + PIECE] for i in range(0, len(b), PIECE)]


def label_words(p: dict, words: list[str]) -> np.ndarray:
    """Per word: summed log probability of each language over its positions, and the number of positions."""
    parts = [(len(b), k, b) for k, w in enumerate(words) for b in cut(w)]
    parts.sort(key=lambda x: x[0])
    out = np.zeros((len(words), len(p["c"]) + 1), dtype=np.float64)
    for i in range(0, len(parts), 2048):
        some = parts[i:i + 2048]
        x, mask = framed([b for _, _, b in some])
        logp = (log_probabilities(p, x, mask)[1] * mask[:, :, None]).sum(1)
        np.add.at(out, np.array([k for _, k, _ in some]), np.column_stack([logp, mask.sum(1)]))
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(docs: DataFrame, per_language: int = 300, steps: int = STEPS) -> tuple[dict, list[str]] | None:
    """Network and its languages from (doc_id, text, lang) of training rows; None if no row can teach."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
    wanted = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, per_language / n)]), F.col("lang"))
    found: dict[str, list[bytes]] = {}
    for r in rows.where(share < wanted).select("lang", "text", "doc_id").orderBy("doc_id").toLocalIterator():
        found.setdefault(r["lang"], []).extend(b for w in WORD.findall(r["text"]) if has_letter(w) for b in cut(w))
    names = sorted(k for k, v in found.items() if v)
    return (train([found[k] for k in names], steps), names) if names else None


def identify(docs: DataFrame, model: tuple[dict, list[str]] | None, keep: list[str]) -> DataFrame:
    """``keep`` columns plus lang_pred and score (the pooled probability).

    ``und`` with score 0 for a null text, a text without a letter, or without a model. Whole texts are read;
    memory is bounded by one Arrow batch and ``REMEMBERED`` words.
    """
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[str, int] = {}
        table = None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            preds, scores = ["und"] * len(texts), [0.0] * len(texts)
            for lo in range(0, len(texts) if model else 0, 500):
                at = [i for i in range(lo, min(lo + 500, len(texts))) if has_letter(texts[i])]
                if not at:
                    continue
                lists = [WORD.findall(texts[i]) for i in at]
                codes, words = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
                if table is None or len(known) > REMEMBERED:
                    known, table = {}, np.zeros((0, len(model[1]) + 1))
                new = [w for w in words if w not in known]
                if new:
                    sums = label_words(model[0], new)
                    sums[[not has_letter(w) for w in new]] = 0
                    known.update(zip(new, range(len(table), len(table) + len(new))))
                    table = np.concatenate([table, sums])
                rows = table[np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))][codes]
                ends = np.cumsum([len(x) for x in lists])
                pooled = np.add.reduceat(rows, np.concatenate([[0], ends[:-1]]), axis=0)
                mean = pooled[:, :-1] / np.maximum(pooled[:, -1:], 1)
                prob = np.exp(mean - mean.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                for i, k, s in zip(at, prob.argmax(1), prob.max(1)):
                    preds[i], scores[i] = model[1][k], float(s)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                names=[*keep, "lang_pred", "score"])

    extra = [] if "text" in keep else ["text"]
    return docs.select(*keep, *extra).mapInArrow(label, schema)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def language_id(docs: DataFrame, per_language: int = 300, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns only from rows whose crc32(doc_id) mod 3 is not 1.

    A null doc_id hashes like an empty one. Repeated rows get equal labels, extra columns are ignored, an empty
    table gives no rows.
    """
    teachers = docs.select("doc_id", "text", "lang").where(~held_out())
    named = identify(docs.select("doc_id", "text"), fit(teachers, per_language, steps), ["doc_id"])
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir, "doc_id", "text", "lang"))
