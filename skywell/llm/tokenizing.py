"""Byte-level BPE ids in tasks: the vocabulary travels with the task, texts stay where Spark put them."""

from __future__ import annotations

import base64
import zlib

# Fixed value: the published splitting pattern of the vocabulary, written without needless backtracking.
PATTERN = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s")

# Fixed value: the added token of byte_bpe_50k.json, one id wherever its text occurs.
ADDED = {"<|endoftext|>": 50256}


def rank_file(path: str | None = None) -> bytes:
    """The rank file that holds byte_bpe_50k.json's vocabulary, packed; read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return zlib.compress(f.read())


def encoding(packed: bytes, added: tuple[tuple[str, int], ...] = ()):
    """``added`` texts are found before the pattern splits what lies between them; without any, all text is ordinary.

    Built once a worker: this function travels with the task, so what it keeps hangs on the library's own module.
    """
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_built_encodings", {})
    key = (zlib.crc32(packed), len(packed), added)
    if key not in kept:
        lines = zlib.decompress(packed).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        kept[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(added))
    return kept[key]
