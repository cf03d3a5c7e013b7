"""Texts as UTF-8 bytes inside a task: byte maps, and cuts of long texts at spaces."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: only A-Z are lowered.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SLICE = 1 << 20


def keyed_bytes(docs: DataFrame, key: Column, text: str) -> DataFrame:
    """``key`` and the UTF-8 bytes of the text (null: empty), the only columns that go to Python."""
    return docs.select(key.alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))


def slices(body: bytes, space: bytes = b" ", size: int = SLICE) -> Iterator[bytes]:
    """The whole text in parts of about ``size``, cut at ``space`` only, so that no word is parted."""
    start = 0
    while len(body) - start > size:
        cut = body.find(space, start + size)
        if cut < 0:
            break
        yield body[start:cut]
        start = cut
    yield body[start:] if start else body
