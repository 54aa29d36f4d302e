"""Same or near-same records across splits (problem 4).

An evaluation record of n windows may lack e = n - ceil(t * n) of them, so one
of any e + 1 of its segments of k members stands in a training record of
similarity t or more. The segments are its e + 1 rarest windows (they overlap:
there are only n / k that don't, fewer than e + 1), met in training records at
places that leave room for the overlap needed. Pairs found so are aligned by
banded dynamic programming over words or token ids; the windows within the
stretches that the alignment matches are shared, and where they make up the
similarity the pair is proven ("near"). Windows ignore their order in the text,
so the few pairs with moved parts that no alignment proves are decided by the
windows themselves ("moved").
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, staged
from . import setjoin
from .words import text_windows, token_windows, words

EVALUATION, TRAINING = ("validation", "test"), "train"


#: The widest band of an alignment; texts that need more edits are decided by their windows.
WIDEST = 500


def alignment(a: list, b: list, most: int) -> tuple[int, list[tuple[int, int, int]]] | None:
    """Edit distance of two sequences and the stretches (place in a, place in b, length) that stay, or None if it is above ``most``.

    Dynamic programming over the diagonals -most..most: for each number of
    edits, the furthest row that each diagonal reaches, and where it came from.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    reach: dict[int, int] = {}
    steps: list[dict[int, tuple[int, int]]] = []  # by diagonal: (row where the stretch begins, diagonal before)
    for e in range(most + 1):
        after, step = {}, {}
        for d in range(-e, e + 1):
            if e == 0:
                i, back = 0, 0
            else:
                i, back = max((reach.get(d, -2) + 1, d), (reach.get(d + 1, -2) + 1, d + 1), (reach.get(d - 1, -2), d - 1))
                if i < 0:
                    continue
            i = min(i, n)
            start, i = i, _end(i, d, a, b)
            if i + d <= m:
                after[d], step[d] = i, (start, back)
        steps.append(step)
        if after.get(m - n, -1) >= n:
            out, d, i = [], m - n, n
            for k in range(e, -1, -1):
                start, back = steps[k][d]
                if i > start:
                    out.append((start, start + d, i - start))
                if k:
                    d = back
                    i = _end(steps[k - 1][d][0], d, a, b)
            return e, out[::-1]
        reach = after
    return None


def _end(i: int, d: int, a: list, b: list) -> int:
    """The row where the stretch of diagonal d that begins at row i ends."""
    while 0 <= i + d < len(b) and i < len(a) and a[i] == b[i + d]:
        i += 1
    return i


def banded_edits(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None."""
    got = alignment(a, b, most)
    return None if got is None else got[0]


def _members(kind: str):
    return words if kind == "text" else (lambda x: list(x) if x is not None else [])


def similar(x, y, kind: str, k: int, t: float) -> tuple[str | None, int | None]:
    """How two values are proven to have k-window similarity t ("near" by alignment, "moved" by windows only, or None), and their edit distance if aligned."""
    a, b = _members(kind)(x), _members(kind)(y)
    wa, wb = (text_windows(x, k), text_windows(y, k)) if kind == "text" else (token_windows(x, k), token_windows(y, k))
    ua, ub = np.unique(wa), np.unique(wb)
    if not len(ua) or not len(ub):
        return None, None
    need = int(np.ceil(t / (1 + t) * (len(ua) + len(ub)) - 1e-9))
    got = alignment(a, b, min(WIDEST, max(len(a), len(b)) - need + k))
    if got:
        kept = [wa[i : i + size - k + 1] for i, _, size in got[1] if size >= k]
        if kept and len(np.unique(np.concatenate(kept))) >= need:
            return "near", got[0]
    return ("moved" if len(np.intersect1d(ua, ub, assume_unique=True)) >= need else None), (got[0] if got else None)


def cross_split_pairs(df: DataFrame, key: str, split: str, value: str, kind: str, k: int, t: float, exact: str | None = None, source: str | None = None) -> DataFrame:
    """(train_key, eval_key, eval_split, match, edits [, sources]): overlaps of training and evaluation rows.

    kind is "text" or "tokens". Rows match by equal ``exact`` values (any letter
    case) or by k-window similarity of ``value`` of at least t. Split labels are
    compared without case and outer spaces; other labels and null take no part.
    Null keys take no part, null or too short values match by ``exact`` only,
    and repeated deliveries of a key count once. match is "exact", "same" (equal
    window sets), "near" (proven by alignment) or "moved" (by windows only). Equal
    sets are joined once for all their rows.
    """
    label = F.lower(F.trim(F.regexp_replace(F.col(split), r"^\s+|\s+$", "")))
    digest = F.lower(F.col(exact)) if exact else F.lit(None).cast("string")
    where = F.col(source) if source else F.lit(None).cast("string")
    base = df.select(F.col(key).alias("key"), label.alias("split"), digest.alias("digest"), where.alias("source"), F.col(value).alias("value")).filter(F.col("key").isNotNull() & F.col("split").isin(TRAINING, *EVALUATION))
    cut = staged(setjoin.windowed(base, "value", kind, k), "windows")
    every = setjoin.ordered(cut, t, setjoin.rarity(cut)).drop("rest")
    rows = staged(every.groupBy("key").agg(F.min(F.struct("split", "digest", "source", "set_key", "n", "near", "odd0", "odd1")).alias("r")).select("key", "r.*"), "rows")
    drop_stage(cut)
    train, held = rows.filter(F.col("split") == TRAINING), rows.filter(F.col("split") != TRAINING)

    def sets(x: DataFrame) -> DataFrame:
        return x.filter("set_key is not null").groupBy("set_key").agg(*[F.first(c).alias(c) for c in ("n", "near", "odd0", "odd1")], F.min("key").alias("any_key"))

    tsets, hsets = sets(train), sets(held)
    pairs = staged(setjoin.candidates(hsets.drop("any_key"), tsets.drop("any_key"), t), "pairs")
    of = hsets.select("set_key", "any_key").union(tsets.select("set_key", "any_key")).groupBy("set_key").agg(F.min("any_key").alias("key"))
    need = pairs.select(F.col("key_l").alias("set_key")).union(pairs.select("key_r")).distinct().join(of, "set_key")
    own = base.select("key", "value").filter("value is not null").join(need, "key").groupBy("set_key").agg(F.min("value").alias("value"))
    both = pairs.join(own.select(F.col("set_key").alias("key_l"), F.col("value").alias("a")), "key_l").join(own.select(F.col("set_key").alias("key_r"), F.col("value").alias("b")), "key_r")

    def verify(batches):
        for b in batches:
            got = [similar(x, y, kind, k, t) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([b.column("key_l"), b.column("key_r"), pa.array([e for _, e in got], pa.int32()), pa.array([how for how, _ in got], pa.string())], ["key_l", "key_r", "edits", "match"])
            yield out.filter(pa.array([how is not None for how, _ in got], pa.bool_()))

    near = both.select("key_l", "key_r", "a", "b").mapInArrow(verify, "key_l binary, key_r binary, edits int, match string")
    h = held.select(F.col("key").alias("eval_key"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"), "digest", "set_key")
    r = train.select(F.col("key").alias("train_key"), F.col("source").alias("train_source"), "digest", "set_key")
    out = ["train_key", "eval_key", "eval_split", "train_source", "eval_source"]
    by_near = h.join(near, h.set_key == near.key_l).drop("set_key", "digest").join(r, F.col("key_r") == r.set_key).select(*out, "match", "edits")
    by_set = h.drop("digest").join(r.drop("digest"), "set_key").select(*out, F.lit("same").alias("match"), F.lit(0).alias("edits"))
    every = by_near.unionByName(by_set)
    if exact:
        every = every.unionByName(h.drop("set_key").join(r.drop("set_key"), "digest").select(*out, F.lit("exact").alias("match"), F.lit(None).cast("int").alias("edits")))
    return every.groupBy(*out).agg(F.min("match").alias("match"), F.min("edits").alias("edits"))


def keyed_pairs(pairs: DataFrame) -> DataFrame:
    """(key_a, key_b): the pairs with the smaller key first."""
    return pairs.select(F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b")).distinct()


def overlap_report(pairs: DataFrame, table: str) -> DataFrame:
    """(table_name, eval_split, eval_source, train_source, match, pairs, eval_rows): counts per split and source."""
    g = pairs.groupBy(F.lit(table).alias("table_name"), "eval_split", "eval_source", "train_source", "match")
    return g.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_key").alias("eval_rows"))
