"""Splitting oversized texts at natural boundaries (problem 3).

Lexical cohesion: at each gap between sentence-like units, the words of the
block before and of the block after are compared; where their similarity dips
(a valley), the topic changes. Within each window of allowed sizes the deepest
valley is cut, where ends of paragraphs and of lines count as deeper by a
weight; the next piece starts ``overlap`` characters before the cut.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import words

LIMIT, OVERLAP = 1500, 100
#: Units of one block of the cohesion curve.
BLOCK = 4
#: By how much the valley at an end of a paragraph, of a line and of a sentence counts as deeper (depths lie between 0 and 2).
WEIGHT = (0.5, 0.1, 0.0)

# Kinds of boundaries, the strongest first; the names are those of the tables.
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"""[.!?…。！？؟।][.!?…"'”’»“)\]]*(?:\s+|(?<=[。！？]))|;\s+""")
_WORD = re.compile(r"\s+")
KINDS = ("paragraph", "line", "sentence", "word_fallback", "token_fallback")
# Abbreviations after which a full stop ends no sentence.
_SHORT = {"dr", "mr", "mrs", "ms", "st", "e.g", "i.e", "z.b", "p.ex", "etc", "vs", "no", "nr", "bzw", "ca", "cf", "prof", "fig", "vol"}
_GLUE = {"‍", "️", "︎"}


def boundaries(text: str) -> dict[int, int]:
    """Places where the text breaks (index of the first character after), and the kind of each."""
    out: dict[int, int] = {}
    for kind, pattern in enumerate((_PARAGRAPH, _LINE, _SENTENCE, _WORD)):
        for m in pattern.finditer(text):
            if kind == 2:
                before = text[max(0, m.start() - 8) : m.start()].rsplit(None, 1)[-1:] or [""]
                if before[0].lower().lstrip("(“\"") in _SHORT or (m.group()[0] == "." and len(before[0]) == 1 and before[0].isupper()):
                    continue
            if 0 < m.end() < len(text):
                out.setdefault(m.end(), kind)
    return out


def valleys(text: str, cuts: list[int]) -> dict[int, float]:
    """Depth of the cohesion valley at each cut: how far the similarity of the blocks around it dips."""
    edges = [0, *cuts, len(text)]
    bags = [Counter(words(text[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
    curve = []
    for g in range(1, len(bags)):
        left, right = Counter(), Counter()
        for x in bags[max(0, g - BLOCK) : g]:
            left.update(x)
        for x in bags[g : g + BLOCK]:
            right.update(x)
        dot = sum(n * right[w] for w, n in left.items() if w in right)
        size = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        curve.append(dot / size if size else 0.0)
    # Peaks to the left and right of each gap, as long as the curve rises.
    n, depth = len(curve), {}
    rise_l, rise_r = curve[:], curve[:]
    for i in range(1, n):
        rise_l[i] = rise_l[i - 1] if curve[i - 1] >= curve[i] else curve[i]
    for i in range(n - 2, -1, -1):
        rise_r[i] = rise_r[i + 1] if curve[i + 1] >= curve[i] else curve[i]
    for i, at in enumerate(cuts):
        depth[at] = rise_l[i] + rise_r[i] - 2 * curve[i]
    return depth


def _whole(text: str, at: int, least: int) -> int:
    """The last place up to ``at`` that doesn't part a character from its marks; at if there is none above least."""
    i = at
    while i > least:
        c, before = text[i], text[i - 1]
        if not (unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me") or c in _GLUE or before == "‍" or (before == "\r" and c == "\n") or "\U0001f3fb" <= c <= "\U0001f3ff"):
            return i
        i -= 1
    return at


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str | None]]:
    """(start, end, kind of the cut at end) of consecutive pieces; the last has kind None.

    Each piece has at most ``limit`` characters, the first ``overlap`` of which
    (but in the first piece) repeat the end of the piece before. A cut lies in
    the upper half of the window if a paragraph, line or sentence ends there,
    else as late as the window goes.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, len(text), None)]
    kinds = boundaries(text)
    strong = sorted(p for p, k in kinds.items() if k < 3)
    depth = valleys(text, strong)
    weak = sorted(p for p, k in kinds.items() if k == 3)
    out, start = [], 0
    from bisect import bisect_left, bisect_right

    while len(text) - start > limit:
        top = start + limit
        low = start + overlap + max(1, (limit - overlap) // 2)
        window = strong[bisect_left(strong, low) : bisect_right(strong, top)]
        if not window:  # a natural break early in the window is better than none
            window = strong[bisect_left(strong, start + overlap + 1) : bisect_right(strong, top)][-1:]
        if window:
            cut = max(window, key=lambda p: (round(depth[p] + WEIGHT[kinds[p]], 9), p))
            kind = KINDS[kinds[cut]]
        else:
            i = bisect_right(weak, top)
            cut = weak[i - 1] if i and weak[i - 1] > start + overlap else 0
            kind = KINDS[3]
            if not cut:
                cut, kind = _whole(text, top, start + overlap + 1), KINDS[4]
        out.append((start, cut, kind))
        start = cut - overlap
    out.append((start, len(text), None))
    return out


def oversized_pieces(df: DataFrame, key: str, text: str, title: str, end_type: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, n_pieces, start, text, section_title, boundary_end_type): pieces of texts of more than limit characters.

    Characters are Unicode code points. Pieces keep their text's title; the
    last piece keeps the text's own boundary type, which may be null, others
    have that of their cut: paragraph, line, sentence, word_fallback (at white
    space) or token_fallback (no break in reach). Rows without key or text give
    none, repeated rows of a key count once, other columns are ignored.
    """
    big = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(title).alias("s"), F.col(end_type).alias("e")).filter(F.col("k").isNotNull() & (F.length("t") > limit))
    big = big.groupBy("k").agg(F.min(F.struct("t", "s", "e")).alias("r")).select("k", "r.*")
    kind = dict(df.dtypes)[key]

    def run(batches):
        names = ["k", "piece", "n_pieces", "start", "text", "section_title", "boundary_end_type"]
        for b in batches:
            out = [[] for _ in names]
            for k, t, s, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cuts = split_text(t, limit, overlap)
                for i, (a, z, why) in enumerate(cuts):
                    for o, v in zip(out, (k, i, len(cuts), a, t[a:z], s, e if why is None else why), strict=True):
                        o.append(v)
            types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names)

    out = big.mapInArrow(run, f"k {kind}, piece int, n_pieces int, start int, text string, section_title string, boundary_end_type string")
    return out.withColumnRenamed("k", key)
