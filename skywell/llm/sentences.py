"""SentencePiece encoding and decoding over a relational lattice (operator 5).

Texts are cut into words that start at a space mark; only different words are encoded. Their substrings of at
most the longest piece's length are exploded and equi-joined to the piece table, the edges found are grouped by
word, and a fold over them (Spark's ``aggregate``) picks the segmentation. Two laws fold the same lattice:

* ``viterbi`` (unigram models): the best sum of scores over paths, kept per position;
* ``merges`` (BPE models, as the given one is): the best edge that joins two neighbouring symbols is taken,
  leftmost among equals, until none is left. A BPE model's scores are ranks, and the path with the best
  sum of ranks is not its segmentation, so its texts are folded by ``merges``.

Documents are grouped into blocks of bounded size by a hash; their texts are shuffled once, compressed. A block asks
for its different words, one row per bucket of words, and each bucket looks up every word once. The answer has the
words' segmentations in the order asked, without the words, as the block lists them anew when its documents are
written out as ids. Characters that no piece covers become the ids of their bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from skywell.llm.common import clean_text, documents, let
from skywell.llm.registry import query

MARK, BLOCK_BYTES, BUCKETS = "▁", 8 << 20, 4
# The code of a length of 0, so that a segmentation is a short string.
ZERO = ord("0")
WORD = re.compile(MARK + "+[^" + MARK + "]*|^[^" + MARK + "]+")


def piece_table(path: str | None = None) -> list[tuple[str, int, float]]:
    """(piece, id, score) of the model's ordinary pieces and (<0xHH>, id, score) of its bytes; read on the driver."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), i, m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i))]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def listed(texts: Iterable[str], buckets: int) -> dict[int, list[str]]:
    """Different words of the texts, ascending, by a hash of the word. No word has a space."""
    out: dict[int, list[str]] = {}
    for word in sorted({w for t in texts for w in WORD.findall(marked(t))}):
        out.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
    return out


def lattice(words: DataFrame, pieces: DataFrame, longest: int, least: int = 1) -> DataFrame:
    """The different ``words`` (word and, if given, columns that depend on it) with edges: the substrings of each that are
    pieces of at least ``least`` characters, as (a, b, score), best first and then leftmost."""
    n, keys = F.length("word"), words.columns
    starts = words.select(*keys, F.explode(F.sequence(F.lit(0), n - 1)).alias("a"))
    spans = starts.select(*keys, "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("a")))).alias("k"))
    found = spans.withColumn("piece", F.substring(F.col("word"), F.col("a") + 1, F.col("k"))).join(F.broadcast(pieces), "piece", "left")
    edge = F.struct((-F.col("score")).alias("cost"), F.col("a"), (F.col("a") + F.col("k")).alias("b"))
    # The first character stays without a piece too, so that every word comes out and none is looked up again.
    taken = F.col("score").isNotNull() & (F.col("k") >= least)
    return found.where(taken | F.expr("a = 0 AND k = 1")).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(taken, edge))).alias("edges"))


def merge_fold(word: Column, edges: Column) -> Column:
    """Starts and ends of the symbols left when no neighbouring pair joins to a piece: ``next[start] = end``."""
    kind = "struct<next:array<int>,edges:array<struct<cost:double,a:int,b:int>>>"
    start = F.struct(F.concat(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: i), F.array(F.lit(0))).alias("next"),
                     F.filter(edges, lambda e: e["b"] - e["a"] > 1).alias("edges")).cast(kind)

    def step(acc: Column, _: Column) -> Column:
        hit = F.get(F.filter(acc["edges"], lambda e: F.get(acc["next"], F.get(acc["next"], e["a"])) == e["b"]), F.lit(0))

        def taken(h: Column) -> Column:
            mid = F.get(acc["next"], h["a"])
            joined = F.struct(
                F.transform(acc["next"], lambda x, i: F.when(i == h["a"], h["b"]).when(i == mid, F.lit(0)).otherwise(x)).alias("next"),
                F.filter(acc["edges"], lambda e: (e["a"] != mid) & (e["b"] != mid) & ~((e["a"] == h["a"]) & (e["b"] == h["b"]))).alias("edges")).cast(kind)
            ended = F.struct(acc["next"].alias("next"), F.slice(acc["edges"], 1, 0).alias("edges")).cast(kind)
            return F.when(h.isNull(), ended).otherwise(joined)

        return F.when(F.size(acc["edges"]) == 0, acc).otherwise(let(hit, taken))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)["next"]


def viterbi_fold(word: Column, edges: Column, unknown: float = 1e6) -> Column:
    """``next`` of the cheapest path. A character no piece covers costs ``unknown``.

    The state holds, per position reached, the best cost and where its last piece began; the path is then read
    from the end.
    """
    kind = "array<struct<cost:double,from:int>>"

    def reach(acc: Column, j: Column) -> Column:  # best way to position j
        last = F.struct((F.element_at(acc, -1)["cost"] + F.lit(unknown)).alias("cost"), (j - 1).alias("from"))
        ways = F.transform(F.filter(edges, lambda e: e["b"] == j),
                           lambda e: F.struct((F.get(acc, e["a"])["cost"] + e["cost"]).alias("cost"), e["a"].alias("from")))
        return F.concat(acc, F.array(F.array_min(F.concat(ways, F.array(last))))).cast(kind)

    best = F.aggregate(F.sequence(F.lit(1), F.length(word)), F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(-1).alias("from"))).cast(kind), reach)

    def back(b: Column) -> Column:
        ends = F.aggregate(F.sequence(F.lit(1), F.length(word)), F.array(F.length(word)), lambda acc, _: F.when(
            F.get(acc, F.lit(0)) > 0, F.concat(F.array(F.get(b, F.get(acc, F.lit(0)))["from"]), acc)).otherwise(acc))
        return let(ends, lambda x: F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: F.coalesce(
            F.get(x, F.array_position(x, i).cast("int")), F.lit(0)) * (F.array_contains(x, i)).cast("int")))

    return let(best, back)


def segmented(words: DataFrame, pieces: DataFrame, law: str = "merges", longest: int = 16) -> DataFrame:
    """The ``words`` with lens: the lengths of the word's pieces, one character each (``ZERO`` and as many codes on).

    ``longest`` is the length of the longest piece.
    """
    fold, least = {"merges": (merge_fold, 2), "viterbi": (viterbi_fold, 1)}[law]  # single characters need no merge
    lens = F.array_join(F.transform(
        F.filter(F.transform("next", lambda x, i: x - i), lambda d: d > 0), lambda d: F.char(d + ZERO)), "")
    return lattice(words, pieces, longest, least).select(*words.columns, fold(F.col("word"), F.col("edges")).alias("next")).select(
        *words.columns, lens.alias("lens"))


def encode(docs: DataFrame, keep: list[str], model: str | None = None, law: str = "merges", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns plus ids (array of int) for every row of ``docs`` (with ``text``).

    A null or empty text has no ids; an empty table gives none. Words are never cut, whatever their length; equal
    rows, null or repeated keys among them, each give their own row of ids.
    """
    spark, table = docs.sparkSession, piece_table(model)
    pieces = spark.createDataFrame([(p, float(s)) for p, _, s in table if not re.fullmatch(r"<0x[0-9A-F]{2}>", p)], "piece string, score double")
    longest = max((len(p) for p, _, _ in table), default=1)
    if longest + ZERO > 255:
        raise ValueError("a piece is too long for a length of one character")
    size = docs.select(F.sum(F.octet_length(clean_text()))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    cut = docs.select(F.struct(*keep).alias("_keep"), clean_text().alias("text")).withColumn(
        "block", F.pmod(F.xxhash64("_keep", "text"), F.lit(count)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count)
    buckets = BUCKETS * parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            block = batch.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else ():
                sink, own = pa.BufferOutputStream(), rows.select(["_keep", "text"]).take(at)
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(own)
                yield pa.RecordBatch.from_pydict({"block": block[at[:1]], "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def unpacked(rows: pa.Table) -> pa.Table:
        return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows.column("body")])

    def ask(rows: pa.Table) -> pa.Table:
        asked = listed((t.as_py() for t in unpacked(rows).column("text")), buckets)
        own = str(rows["block"][0].as_py())
        return pa.table({"bucket": pa.array(list(asked), pa.int32()), "words": pa.array([" ".join([own, *x]) for x in asked.values()], pa.string())})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        lens = dict(zip(right.column("word").to_pylist(), right.column("lens").to_pylist()))
        blocks, found = [], []
        for x in left.column("words"):
            block, *words = x.as_py().split(" ")
            blocks.append(int(block)), found.append(" ".join([lens[w] for w in words]))
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": left["bucket"], "lens": pa.array(found, pa.string())})

    # Both readers of the texts, and both of the words, share one shuffle, as both take all of its columns: so the number
    # of the block leads its words. Lattice and answer need no shuffle of their own.
    texts = cut.mapInArrow(pack, "block long, body binary").repartition(parts, "block")
    asked = texts.groupBy("block").applyInArrow(ask, "bucket int, words string").repartition(parts, "bucket")
    words = asked.select(F.col("bucket").alias("own"), F.explode(F.slice(F.split("words", " "), 2, 1 << 30)).alias("word")).distinct()
    back = asked.groupBy("bucket").cogroup(segmented(words, pieces, law, longest).groupBy("own")).applyInArrow(
        answer, "block long, bucket int, lens string")
    ids = spark.sparkContext.broadcast({p: i for p, i, _ in table})

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        number, rows = ids.value, unpacked(left)
        asked = listed((t.as_py() for t in rows.column("text")), buckets)
        spell: dict[str, bytes] = {}
        for bucket, lists in zip(right.column("bucket").to_pylist(), right.column("lens")):
            for word, lens in zip(asked.pop(bucket), lists.as_py().split(" ")):
                out, at = [], 0
                for c in lens:
                    part = word[at:at + ord(c) - ZERO]
                    at += len(part)
                    if part in number:
                        out.append(number[part])
                    else:
                        out += [number[f"<0x{b:02X}>"] for b in part.encode()]
                spell[word] = np.array(out, dtype=np.int32).tobytes()
        made = [np.frombuffer(b"".join([spell[w] for w in WORD.findall(marked(t.as_py()))]), dtype=np.int32) for t in rows.column("text")]
        return pa.table({"_keep": rows.column("_keep"), "ids": pa.array(made, pa.list_(pa.int32()))})

    kept = docs.select(F.struct(*keep).alias("_keep")).schema
    out = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(write, kept.add("ids", ArrayType(IntegerType())))
    return out.select("_keep.*", "ids")


def decoder(model: str | None = None):
    """A function from ids to the text they spell."""
    pieces = {i: p for p, i, _ in piece_table(model)}

    def decode(ids) -> str:
        out = bytearray()
        for i in ids:
            p = pieces[i]
            out += bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.encode()
        return out.decode("utf-8", "replace").replace(MARK, " ")[1:]

    return decode


def decode(encoded: DataFrame, keep: list[str], model: str | None = None) -> DataFrame:
    """``keep`` columns plus text from ids; no ids or null ids give an empty text."""
    schema = encoded.select(*keep).schema.add("text", "string")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = decoder(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(
                [read(x.as_py() or ()) for x in batch.column("ids")], pa.string())], names=[*keep, "text"])

    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(spell, schema)


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32 (little-endian 32-bit), decoded_crc32 (of the decoded text's bytes)."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    coded = encode(docs, ["doc_id"])
    read = piece_table()  # on the driver, so that tasks need no file
    pieces = {i: p for p, i, _ in read}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = {i: (bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace(MARK, " ").encode()) for i, p in pieces.items()}
        for batch in batches:
            rows = [np.asarray(x.values, dtype="<i4") if x.is_valid else np.zeros(0, "<i4") for x in batch.column("ids")]
            texts = [b"".join(map(spelled.__getitem__, r.tolist()))[1:] for r in rows]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_pieces": pa.array([len(r) for r in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()),
                "decoded_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "decoded_crc32": pa.array([zlib.crc32(t) for t in texts], pa.int64())})

    return coded.mapInArrow(digest, "doc_id long, n_pieces long, ids_crc32 long, decoded_bytes long, decoded_crc32 long")
