"""Joins of sets of k-windows: window sets, a rarity sketch, prefixes, candidates and exact checks.

A set's windows are put in one global order, rare ones first. Two sets of
Jaccard similarity t or more must share a window among the first
n - ceil(t * n) + 1 of each, so only these "prefix" windows are joined.

Rarity comes from counts of documents over hash buckets, taken over all rows.
The number of buckets is a parameter (SKETCH_BITS), so what is collected and
broadcast has a fixed size at any input; any order is valid, rarity only makes
the join small.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import token_codes, windows, word_codes, words

SKETCH_BITS = 18


def _codes(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the members of all values of a column, one after another, and how many each value has."""
    if kind == "tokens":
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
        return token_codes(flat), sizes.astype(np.int64)
    found = [words(t) for t in column.to_pylist()]
    return word_codes([w for ws in found for w in ws]), np.array([len(ws) for ws in found], np.int64)


def _distinct(column: pa.Array, kind: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the different k-windows of each value, by row, then hash."""
    codes, sizes = _codes(column, kind)
    h = windows(codes, k)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    whole = np.arange(len(h)) + k <= ends[: len(h)]
    h, row = h[whole], row[: len(h)][whole]
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def lists(flat: np.ndarray, sizes: np.ndarray, none: np.ndarray | None = None) -> pa.ListArray:
    """Rows of 64-bit numbers of the given sizes; null where none says so."""
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=None if none is None else np.append(none, False))
    return pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64), pa.int64()))


def windowed(df: DataFrame, column: str, kind: str, k: int) -> DataFrame:
    """df without the column; with set_key, n and w, the different windows of its value.

    kind is "text" (windows of words) or "tokens" (of the members of an array).
    set_key is a 128-bit hash of the set, equal for equal sets. All three are
    null where the value is null or has fewer than k members.
    """
    keep = [c for c in df.columns if c != column]
    at = df.columns.index(column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column)

    def run(batches):
        for b in batches:
            h, row = _distinct(b.column(at), kind, k)
            n = np.bincount(row, minlength=b.num_rows)
            start = np.concatenate([[0], np.cumsum(n)])
            raw = memoryview(h.tobytes())
            keys = [xxhash.xxh3_128_digest(raw[8 * a : 8 * z]) if z > a else None for a, z in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            made = [pa.array(keys, pa.binary()), pa.array(n, pa.int32(), mask=n == 0), lists(h, n, n == 0)]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), *made], [*keep, "set_key", "n", "w"])

    return df.mapInArrow(run, f"{schema}, set_key binary, n int, w array<bigint>")


def rarity(df: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many rows have a window in each of 2**bits hash buckets, from the column w of windowed()."""
    shift = np.uint64(64 - bits)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            total += np.bincount((b.column(0).flatten().to_numpy().view(np.uint64) >> shift).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    got = df.filter("w is not null").select("w").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return as_sketch(got, bits)


def as_sketch(counts: DataFrame, bits: int) -> np.ndarray:
    """The counters of a table (bucket, n), 2**bits rows at most, as an array."""
    out, got = np.zeros(1 << bits, np.int64), counts.toPandas()
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def prefix_length(n, t: float):
    """How many windows of a set of n must be joined to find all sets of similarity t or more."""
    return np.where(np.asarray(n) > 0, n - np.ceil(t * np.asarray(n) - 1e-9).astype(np.int64) + 1, 0)


def ordered(df: DataFrame, t: float, sketch: np.ndarray) -> DataFrame:
    """windowed() with w parted into near (the prefix, rarest first) and rest, and odd0, odd1.

    odd0 and odd1 hold, for 128 hash cells of the window space, whether the
    set has an odd number of windows there. As each window that only one of two
    sets has changes one of these, they differ in at most |x ^ y| places.
    """
    spark: SparkSession = df.sparkSession
    order = spark.sparkContext.broadcast(sketch)
    shift = np.uint64(64 - (len(sketch) - 1).bit_length())
    keep = [c for c in df.columns if c != "w"]
    at = df.columns.index("w")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "w")

    def run(batches):
        for b in batches:
            col = b.column(at)
            n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            h = col.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            start = np.concatenate([[0], np.cumsum(n)])
            h = h[np.lexsort((h, order.value[(h >> shift).astype(np.int64)], row))]
            size = prefix_length(n, t)
            first = np.arange(len(h)) - start[row] < size[row]
            cell = row * 128 + (h & np.uint64(127)).astype(np.int64)
            odd = np.packbits((np.bincount(cell, minlength=128 * len(n)) & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, 2)
            none = n == 0
            made = [lists(h[first], size, none), lists(h[~first], n - size, none), pa.array(odd[:, 0], pa.int64()), pa.array(odd[:, 1], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), *made], [*keep, "near", "rest", "odd0", "odd1"])

    return df.mapInArrow(run, f"{schema}, near array<bigint>, rest array<bigint>, odd0 bigint, odd1 bigint")


def candidates(left: DataFrame, right: DataFrame, t: float, also: Column | None = None, band: int = 8) -> DataFrame:
    """Pairs (key_l, key_r) of different sets that share a prefix window and may reach t.

    left and right have set_key, n, near, odd0 and odd1, a row for each set. The
    join's key is the window and a band of sizes (each band spans a factor of
    t**-band), so that hot windows are split by size. Within it fall pairs whose
    sizes differ too much, whose first shared window leaves too little room for
    the overlap that t needs, or whose odd cells prove too many differences.
    ``also`` is a further condition on the columns l.* and r.*.
    """
    width = -math.log(t) * band if t < 1 else 1.0
    zone = lambda n: F.floor(F.log(n) / width).cast("int")

    a = left.select("*", F.posexplode("near").alias("pos", "token")).drop("near", "rest")
    a = a.withColumn("zone", F.explode(F.sequence(zone(F.greatest(F.lit(1.0), F.lit(t) * F.col("n") - 1e-6)), zone(F.col("n") / t + 1e-6)))).alias("l")
    b = right.select("*", F.posexplode("near").alias("pos", "token")).drop("near", "rest").withColumn("zone", zone(F.col("n").cast("double"))).alias("r")
    l_n, r_n = F.col("l.n"), F.col("r.n")
    sum_ = l_n + r_n
    on = (F.col("l.token") == F.col("r.token")) & (F.col("l.zone") == F.col("r.zone")) & (F.col("l.set_key") != F.col("r.set_key"))
    on = on & (l_n >= t * r_n - 1e-6) & (r_n >= t * l_n - 1e-6)
    # At the first window that both have, none before it is shared.
    on = on & (F.least(l_n - F.col("l.pos"), r_n - F.col("r.pos")) >= F.lit(t / (1 + t)) * sum_ - 1e-6)
    apart = sum((F.bit_count(F.col(f"l.{c}").bitwiseXOR(F.col(f"r.{c}"))) for c in ("odd0", "odd1")), F.lit(0))
    on = on & (apart <= F.lit((1 - t) / (1 + t)) * sum_ + 1e-6)
    if also is not None:
        on = on & also
    return a.join(b, on).select(F.col("l.set_key").alias("key_l"), F.col("r.set_key").alias("key_r")).distinct()


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """The pairs (key_l, key_r) whose sets, near and rest of left and right, have similarity t or more."""
    of = lambda df, key, name: df.select(F.col("set_key").alias(key), F.concat("near", "rest").alias(name))
    both = pairs.join(of(left, "key_l", "a"), "key_l").join(of(right, "key_r", "b"), "key_r")
    met = F.size(F.array_intersect("a", "b"))
    return both.filter(met >= F.lit(t) * (F.size("a") + F.size("b") - met) - 1e-9).select("key_l", "key_r")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two arrays of windows as sets; 0 if either is empty."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
