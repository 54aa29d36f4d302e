"""Words as the queries define them, and 64-bit hashes of runs of words or tokens."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_CACHE: dict[str, int] = {}
_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def fold(text: str) -> str:
    """Text without letter case, accents, compatibility forms and format characters."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    if t.isascii():
        return t
    drop = {ord(c): None for c in set(t) if ord(c) > 127 and unicodedata.category(c) in ("Mn", "Me", "Cf")}
    return t.translate(drop) if drop else t


def words(text: str | None) -> list[str]:
    """The maximal runs of letters and digits of the folded text; none for null."""
    return _WORD.findall(fold(text)) if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return h ^ (h >> np.uint64(31))


def word_codes(ws: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(_CACHE) > 300_000:
        _CACHE.clear()
    out = np.empty(len(ws), np.uint64)
    for i, w in enumerate(ws):
        c = _CACHE.get(w)
        if c is None:
            c = _CACHE[w] = xxhash.xxh64_intdigest(w)
        out[i] = c
    return out


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive codes, in order; none if there are fewer."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = mix(h * _MULT + codes[j : j + n] + np.uint64(j + 1))
    return h


def text_windows(text: str | None, k: int) -> np.ndarray:
    """Hashes of the runs of k words of a text, in order."""
    return windows(word_codes(words(text)), k)


def token_codes(tokens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token id."""
    with np.errstate(over="ignore"):
        return mix(tokens.astype(np.int64).astype(np.uint64) + _MULT)


def token_windows(tokens, k: int) -> np.ndarray:
    """Hashes of the runs of k token ids, in order; none for null. A null id counts as -1."""
    if tokens is None:
        return np.empty(0, np.uint64)
    return windows(token_codes(np.array([-1 if t is None else t for t in tokens], np.int64)), k)
