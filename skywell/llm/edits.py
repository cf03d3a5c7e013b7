"""Edit-aware token counts (operator 8).

A document's pre-tokens (the units the tokenizer's pattern splits a text into; tokens never cross them) are
kept in order in blocks, under a segment tree of character and token sums. An edit finds its place from the
sums, re-splits only the text it touches with a little context, until the new boundaries fall on old ones
again, re-encodes only pre-tokens that are new, and updates the sums on the way to the root.

Context: a split that starts at a boundary depends on the text to its right only, and a pre-token's end on
at most the two characters behind it, so two pre-tokens before the edit are split again, and a boundary
counts as found if two characters follow it or the text ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from skywell.llm.common import clean_text, documents
from skywell.llm.registry import query
from skywell.llm.tokenizing import PATTERN, encoding, rank_file

BLOCK, REMEMBERED = 64, 400_000
SPLIT = regex.compile(PATTERN)


class Counter:
    """Token count of one pre-token, remembered up to ``REMEMBERED`` of them."""

    def __init__(self, coder):
        self.coder, self.known, self.encoded = coder, {}, 0

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.coder._encode_single_piece(piece))
        return n


class CountTree:
    """Pre-tokens of one text in blocks, with a segment tree over (characters, tokens) of the blocks."""

    def __init__(self, text: str, count: Counter):
        self.count, self.reencoded = count, 0
        pieces = SPLIT.findall(text)
        self.blocks = [pieces[i:i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.tokens = [list(map(count, b)) for b in self.blocks]
        self._build()

    def _build(self) -> None:
        size = 1
        while size < len(self.blocks):
            size *= 2
        self.size, self.sums = size, [(0, 0)] * (2 * size)
        for i in range(len(self.blocks)):
            self.sums[size + i] = self._leaf(i)
        for i in range(size - 1, 0, -1):
            self.sums[i] = self._sum(i)

    def _leaf(self, i: int) -> tuple[int, int]:
        return sum(map(len, self.blocks[i])), sum(self.tokens[i])

    def _sum(self, i: int) -> tuple[int, int]:
        (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
        return a + c, b + d

    @property
    def n_chars(self) -> int:
        return self.sums[1][0]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.blocks))

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)

    def tokens_before(self, char: int) -> int:
        """Tokens of the pre-tokens that end at or before a character position."""
        block, k, _ = self._find(char)
        node, total = self.size + block, sum(self.tokens[block][:k])
        while node > 1:
            total += self.sums[node - 1][1] if node % 2 else 0
            node //= 2
        return total

    def _find(self, char: int) -> tuple[int, int, int]:
        """(block, place in it, first character) of the pre-token that holds a position; the end after the last."""
        if char >= self.n_chars:
            last = len(self.blocks) - 1
            return last, len(self.blocks[last]), self.n_chars
        node, at = 1, 0
        while node < self.size:
            node *= 2
            if char >= at + self.sums[node][0]:
                at += self.sums[node][0]
                node += 1
        block = node - self.size
        for k, p in enumerate(self.blocks[block]):
            if char < at + len(p):
                return block, k, at
            at += len(p)
        raise AssertionError("sums do not match the blocks")

    def _back(self, block: int, k: int, steps: int) -> tuple[int, int]:
        while steps and (block or k):
            if k:
                k, steps = k - 1, steps - 1
            else:
                block -= 1
                k = len(self.blocks[block])
        return block, k

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start..stop by ``new``; positions beyond the text mean its end."""
        start = min(max(0, start), self.n_chars)
        stop = min(max(start, stop), self.n_chars)
        block, k, _ = self._find(max(0, start - 1))
        block, k = self._back(block, k, 2)
        first = sum(map(len, self.blocks[block][:k])) + self._chars_before(block)
        end_block, end_k, end_at = self._find(stop)
        ends, tail, b, j = [], [], end_block, end_k  # old boundaries behind the edit
        head = self._between(block, k, first, start)
        at, wanted = end_at, 8
        while True:
            while len(tail) < wanted and b < len(self.blocks):
                if j < len(self.blocks[b]):
                    tail.append(self.blocks[b][j])
                    at += len(tail[-1])
                    j += 1
                    ends.append((at, b, j))
                else:
                    b, j = b + 1, 0
            at_end = at == self.n_chars
            region = head + new + "".join(tail)[stop - end_at:]
            shift = len(head) + len(new) - stop  # old position -> place in the region
            old = {x + shift: (y, z) for x, y, z in [(end_at, end_block, end_k), *ends] if x >= stop}
            pieces, place = [], 0
            for m in SPLIT.finditer(region):
                if place in old and place >= len(head) + len(new) and (place + 2 <= len(region) or at_end):
                    break
                pieces.append(m.group())
                place = m.end()
            if place in old and place >= len(head) + len(new) and (place + 2 <= len(region) or at_end):
                return self._replace(block, k, *old[place], pieces)
            wanted *= 4

    def _chars_before(self, block: int) -> int:
        node, total = self.size + block, 0
        while node > 1:
            total += self.sums[node - 1][0] if node % 2 else 0
            node //= 2
        return total

    def _between(self, block: int, k: int, first: int, start: int) -> str:
        parts, size = [], 0
        while size < start - first:
            if k == len(self.blocks[block]):
                block, k = block + 1, 0
                continue
            parts.append(self.blocks[block][k])
            size += len(parts[-1])
            k += 1
        return "".join(parts)[:start - first]

    def _replace(self, block: int, k: int, end_block: int, end_k: int, pieces: list[str]) -> None:
        """Put ``pieces`` in place of the pre-tokens from (block, k) to (end_block, end_k)."""
        self.reencoded += len(pieces)
        counts = list(map(self.count, pieces))
        if block == end_block:
            self.blocks[block][k:end_k], self.tokens[block][k:end_k] = pieces, counts
        else:
            self.blocks[block][k:], self.tokens[block][k:] = pieces, counts
            self.blocks[end_block][:end_k], self.tokens[end_block][:end_k] = [], []
            for i in range(block + 1, end_block):
                self.blocks[i], self.tokens[i] = [], []
        if len(self.blocks[block]) > 4 * BLOCK:  # a large insertion: cut its block and rebuild the sums only
            big, many = self.blocks[block], self.tokens[block]
            self.blocks[block:block + 1] = [big[i:i + BLOCK] for i in range(0, len(big), BLOCK)]
            self.tokens[block:block + 1] = [many[i:i + BLOCK] for i in range(0, len(many), BLOCK)]
            self._build()
            return
        for i in range(block, end_block + 1):
            node = self.size + i
            self.sums[node] = self._leaf(i)
            while node > 1:
                node //= 2
                self.sums[node] = self._sum(node)


def edited_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_pieces, n_tokens_edited, n_chars_edited, n_reencoded for every row.

    ``docs`` has doc_id, text and edits, an array of (start, stop, text) in characters, each applied to what the
    ones before it left. A null text is empty, null edits are none, positions are clamped to the text.
    Repeated rows count alike; an empty table gives no rows.
    """
    packed = docs.sparkSession.sparkContext.broadcast(rank_file(vocabulary))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(encoding(packed.value))
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column("text"), batch.column("edits")):
                tree = CountTree(text.as_py() or "", count)
                before = tree.n_tokens, tree.n_pieces
                for e in edits.as_py() or ():
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                rows.append((*before, tree.n_tokens, tree.n_chars, tree.reencoded))
            names = ["n_tokens", "n_pieces", "n_tokens_edited", "n_chars_edited", "n_reencoded"]
            cols = np.array(rows, dtype=np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols)], names=["doc_id", *names])

    return docs.select("doc_id", "text", "edits").mapInArrow(
        apply, "doc_id long, n_tokens long, n_pieces long, n_tokens_edited long, n_chars_edited long, n_reencoded long")


@query("op8_edited_token_counts")
def op8_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: a deletion at a quarter, an insertion of its start in the middle, and a
    replacement at three quarters."""
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("text", clean_text())
    n = F.length("text")

    def edit(start, stop, text):
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), text.alias("text"))

    quarter, half, late = F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4)
    edits = F.array(edit(quarter, quarter + 23, F.lit("")), edit(half, half, F.substring("text", 1, 150)),
                    edit(late, late + 40, F.substring("text", 11, 30)))
    return edited_counts(docs.withColumn("edits", edits))
