"""A public byte-level tokenizer, read from a file whose path is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Where the tokenizer's ranks are, on every executor (ship the file with the job, or keep it on a shared mount).
VOCABULARY = os.environ.get("LODESTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public pattern by which that tokenizer cuts a text first.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("lodestone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = VOCABULARY) -> list[int]:
    """Token ids of a text; none for null or empty text."""
    return encoder(path).encode_ordinary(text) if text else []


def round_trip(text: str, path: str = VOCABULARY) -> tuple[bool, bool]:
    """Whether decoding gives the text back, and whether encoding that gives the same ids."""
    ids = encode(text, path)
    again = encoder(path).decode(ids)
    return again == text, encode(again, path) == ids
