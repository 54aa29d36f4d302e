"""Word shingles, MinHash signatures, exact similarity joins and greedy deduplication, all in built-in functions."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_stage, staged

# Start of the second checksum, and step of the padding.
SECOND, PAD = 0x9E3779B9, 0x9E3779B97F4A7C15
#: Up to so many bytes the second checksum's difference is looked up; beyond, it is computed from the length.
LONGEST = 8192
_WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >= 1 << 63 else x


def match_text(c: Column) -> Column:
    """Text as it is matched: white space collapsed, then case folded (sharp s as ss, one kind of sigma)."""
    x = F.lower(F.trim(F.regexp_replace(c, _WS, " ")))
    return F.replace(F.replace(x, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def let(c: Column, f) -> Column:
    """f of a value that is computed once, also where f uses it within a lambda."""
    return F.element_at(F.transform(F.array(c), f), 1)


def runs(w: Column, k: int, sep: str) -> Column:
    """All runs of k members of an array of at least k."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), sep))


def shingles(c: Column, k: int = 5) -> Column:
    """The different runs of k words of a text, joined; a shorter text is one shingle, one without words none."""
    found = F.regexp_extract_all(match_text(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return let(found, lambda w: F.when(F.size(w) > 0, F.array_distinct(runs(w, k, "␟"))).otherwise(F.array().cast("array<string>")))


def shingle_hashes(c: Column, k: int = 5) -> Column:
    """64-bit hashes of the runs of k words of a text, as shingles() has them, with repeats."""
    # White space is no part of a word, so it needn't be collapsed first.
    folded = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    found = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))
    return let(found, lambda w: F.when(F.size(w) > 0, F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>")))


def only_hashes_of(df: DataFrame, wanted: DataFrame, bits: int = 26) -> DataFrame:
    """df without those hashes of its last column s, an array, that no array s of wanted has, and without rows that have none left.

    A bitmap of fixed size is broadcast: a few other hashes stay, none that
    wanted has is lost.
    """
    low = F.col("s").bitwiseAND((1 << bits) - 1)
    words_ = wanted.select(F.explode("s").alias("s")).select(F.call_function("shiftright", low, F.lit(6)).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(63).cast("int")).alias("bit"))
    got = words_.groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    there = np.zeros(1 << (bits - 6), np.uint64)
    there[got["at"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64).view(np.uint64)
    there = df.sparkSession.sparkContext.broadcast(there)
    mask = np.uint64((1 << bits) - 1)

    def run(batches):
        for b in batches:
            h = b.column(b.num_columns - 1)
            n = pc.list_value_length(h).to_numpy(zero_copy_only=False)
            flat = h.flatten().to_numpy()
            p = flat.view(np.uint64) & mask
            on = (there.value[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            left = np.bincount(np.repeat(np.arange(len(n)), n)[on], minlength=len(n))
            ends = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
            kept = pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(flat[on], pa.int64()))], b.schema.names)
            yield kept.filter(pa.array(left > 0))

    return df.mapInArrow(run, df.schema)


def _lengths() -> Column:
    """By byte length: what the second checksum differs from the first by (both are affine, so content doesn't matter)."""
    zero = bytes(LONGEST)
    return F.lit(np.array([zlib.crc32(zero[:n], SECOND) ^ zlib.crc32(zero[:n]) for n in range(LONGEST)], np.int64))


def _advanced(n: Column) -> Column:
    """What the checksums differ by after n bytes: the start's bits carried through n zero bytes, by powers of two of the step's matrix."""
    # The difference is linear in the starting value: 32 columns for each power of two of bytes.
    columns = []
    one = [zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0", 0) for i in range(32)]
    for _ in range(31):
        columns.append(one)
        apply = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
        one = [apply(one, one[i]) for i in range(32)]
    powers = F.lit(np.array(columns, np.int64).reshape(-1))

    def step(v: Column, k: Column) -> Column:
        bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(F.call_function("shiftright", v, i).bitwiseAND(F.lit(1).cast("long")) == 1, F.get(powers, k * 32 + i)).otherwise(F.lit(0).cast("long")))
        moved = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.call_function("shiftright", n, k).bitwiseAND(F.lit(1)) == 1, moved).otherwise(v)

    return F.when(n >= LONGEST, F.aggregate(F.sequence(F.lit(0), F.lit(30)), F.lit(SECOND).cast("long"), step)).otherwise(F.lit(0).cast("long"))


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def signature(c: Column, k: int = 5, size: int = 64) -> Column:
    """Bottom-``size`` MinHash signature of a text's shingles, as signed 64-bit numbers in unsigned order.

    At most 4 * size shingles at even steps of their order are hashed. A short
    signature is padded by a rule. A text without words has all bits set.
    """
    most, table = 4 * size, _lengths()
    pads = F.lit(np.array([_signed(i * PAD) for i in range(1, size + 1)], np.int64))
    flip = F.lit(-(1 << 63))

    def value(s: Column) -> Column:
        crc = F.crc32(F.encode(s, "UTF-8"))
        # A longer run of zeros is checked as such: the difference depends on the length alone.
        zeros = F.octet_length(s)
        far = _advanced(zeros)
        other = F.coalesce(F.get(table, zeros), far).cast("long")
        return F.shiftleft(crc, 32).bitwiseOR(crc.bitwiseXOR(other)).bitwiseXOR(flip)

    def even(o: Column) -> Column:
        last = F.size(o).cast("long") - 1
        return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(o, F.floor(i.cast("long") * last / (most - 1)).cast("int") + 1))

    def padded(low: Column) -> Column:
        seed = F.aggregate(low, F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v))
        rest = let(seed, lambda x: F.transform(F.slice(pads, F.size(low) + 1, F.lit(size)), lambda p: p.bitwiseXOR(x)))
        return F.slice(F.concat(low, rest), 1, size)

    picked = let(F.array_sort(shingles(c, k)), lambda o: F.when(F.size(o) > most, even(o)).otherwise(o))
    low = F.slice(F.array_sort(F.array_distinct(F.transform(picked, value))), 1, size)
    low = F.transform(low, lambda v: v.bitwiseXOR(flip))
    return let(low, lambda x: F.when(F.size(x) > 0, padded(x)).otherwise(F.array_repeat(F.lit(-1).cast("long"), size)))


def band_keys(sig: Column, bands: int = 8) -> Column:
    """A key for each band: the values of that remainder, hashed."""
    def key(b: int) -> Column:
        own = F.filter(sig, lambda v: F.pmod(v.bitwiseAND(F.lit(bands - 1)), F.lit(bands)) == b)
        raw = F.unhex(F.array_join(F.transform(own, lambda v: F.lpad(F.hex(v), 16, "0")), ""))
        return F.concat(F.lit(f"{b}:"), F.sha2(F.coalesce(raw, F.lit(b"")), 256))

    if bands & (bands - 1):
        raise ValueError("bands must be a power of two")
    return F.array(*[key(b) for b in range(bands)])


def signature_similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(a)


def similar_pairs(df: DataFrame, key: str, items: str, t: float) -> DataFrame:
    """(a, b, similarity): pairs of rows, a < b, whose item sets have Jaccard similarity t or more.

    Items are ordered by their number of rows, rare first; only each set's
    prefix is joined, under bounds on sizes and places, and the pairs left are
    compared whole. Equal sets are joined once and their rows paired after.
    Null keys and null or empty sets take no part; repeated keys count once.
    """
    rows = df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(items)).alias("s")).filter("id is not null and size(s) > 0")
    rows = rows.groupBy("id").agg(F.min("s").alias("s"))
    rows = staged(rows.withColumn("set", F.sha2(F.array_join("s", "\x00"), 256)), "sets")
    sets = rows.groupBy("set").agg(F.first("s").alias("s"))
    # Only hashes of items are moved; the sets themselves are compared at the end.
    tokens = sets.select("set", F.size("s").alias("n"), F.explode(F.transform("s", lambda x: F.xxhash64(x))).alias("token"))
    df_ = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(df_, "token").withColumn("pos", F.row_number().over(Window.partitionBy("set").orderBy("df", "token")))
    prefix = ranked.filter(F.col("pos") <= F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1).select("set", "n", "token", "pos")
    a, b = prefix.alias("a"), prefix.alias("b")
    need = F.lit(t / (1 + t)) * (F.col("a.n") + F.col("b.n")) - 1e-6
    # At the first item that both have, none before it is shared.
    room = F.lit(1) + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.set") < F.col("b.set")) & (F.col("a.n") >= t * F.col("b.n") - 1e-6) & (F.col("b.n") >= t * F.col("a.n") - 1e-6) & (room >= need)
    cand = a.join(b, on).select(F.col("a.set").alias("x"), F.col("b.set").alias("y")).distinct()
    both = cand.join(sets.select(F.col("set").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("set").alias("y"), F.col("s").alias("sy")), "y")
    met = F.size(F.array_intersect("sx", "sy"))
    near = both.select("x", "y", (met / (F.size("sx") + F.size("sy") - met)).alias("similarity")).filter(F.col("similarity") >= t - 1e-12)
    ids = rows.select("id", "set")
    p, q = ids.select(F.col("id").alias("p"), F.col("set").alias("x")), ids.select(F.col("id").alias("q"), F.col("set").alias("y"))
    far = near.join(p, "x").join(q, "y").select("p", "q", "similarity")
    same = p.join(q, (F.col("x") == F.col("y")) & (F.col("p") < F.col("q"))).select("p", "q", F.lit(1.0).alias("similarity"))
    return far.union(same).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def greedy_kept(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, kept): rows taken in id order; one is dropped iff it is linked to an earlier kept one.

    nodes: (id); links: (a, b) with a < b. Each round settles all rows whose
    earlier neighbours are settled; rows without links are kept at once.
    """
    links = staged(links.select("a", "b").distinct(), "links")
    open_ = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    state = staged(open_.withColumn("kept", F.lit(None).cast("boolean")), "state")
    while not state.filter("kept is null").isEmpty():
        before = links.join(state.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(
            F.coalesce(F.bool_or("kept"), F.lit(False)).alias("hit"), F.bool_or(F.col("kept").isNull()).alias("waits"))
        x = state.join(before, "id", "left")
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), F.lit(False)).when(F.coalesce("waits", F.lit(False)), F.lit(None)).otherwise(F.lit(True))
        after = staged(x.select("id", new.alias("kept")), "state")
        drop_stage(state)
        state = after
    return nodes.select("id").distinct().join(state, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def document_index(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(document_id, normalized_sha256, signature, bucket_keys): the first row of each key and of each matched text, in order."""
    h = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("document_id"), F.col(order).alias("o"), F.sha2(match_text(F.col(text)), 256).alias("normalized_sha256"), F.col(text).alias("t"))
    first = h.groupBy("document_id").agg(F.min(F.struct("o", "normalized_sha256", "t")).alias("r")).select("document_id", "r.*")
    first = first.groupBy("normalized_sha256").agg(F.min(F.struct("o", "document_id", "t")).alias("r")).select("normalized_sha256", "r.document_id", "r.t")
    sig = signature(F.col("t"))
    return first.select("document_id", "normalized_sha256", sig.alias("signature"), F.expr("length(t) > 0").alias("has_text")).withColumn("bucket_keys", band_keys(F.col("signature")))


def matches(index: DataFrame, texts: DataFrame, key: str, text: str, reject: float = 0.9, review: float = 0.75) -> DataFrame:
    """(id, match_type, decision, document_id, similarity): each text's best match in the index.

    An equal matched text is exact and rejected; the best signature similarity
    of at least reject is near and rejected, of at least review ambiguous and
    to be reviewed; others are kept. Ties go to the smallest document_id. Keys
    of empty bands join nothing, as they can't reach the thresholds.
    """
    x = texts.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(text).alias("t"))
    x = staged(x.select("id", F.sha2(match_text(F.col("t")), 256).alias("h"), signature(F.col("t")).alias("sig")), "texts")
    idx = staged(index, "index")
    exact = x.join(idx.select("normalized_sha256", "document_id"), x.h == F.col("normalized_sha256")).groupBy("id").agg(F.min("document_id").alias("exact_id"))
    empty = F.sha2(F.lit(b""), 256)
    keys = lambda df, i, s: df.select(i, s, F.explode("keys").alias("k")).filter(~F.col("k").endswith(F.concat(F.lit(":"), empty)))
    left = keys(x.join(exact, "id", "left_anti").withColumn("keys", band_keys(F.col("sig"))), "id", "sig")
    right = keys(idx.select("document_id", F.col("signature").alias("dsig"), F.col("bucket_keys").alias("keys")), "document_id", "dsig")
    cand = left.join(right, "k").dropDuplicates(["id", "document_id"]).select("id", "document_id", signature_similarity(F.col("sig"), F.col("dsig")).alias("similarity"))
    best = cand.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("document_id")).alias("neg"))).alias("b")).select("id", F.col("b.similarity").alias("similarity"), (-F.col("b.neg")).alias("document_id"))
    best = best.filter(F.col("similarity") >= review)
    near = best.select("id", F.when(F.col("similarity") >= reject, "near").otherwise("ambiguous").alias("match_type"), F.when(F.col("similarity") >= reject, "reject").otherwise("review").alias("decision"), "document_id", "similarity")
    hit = exact.select("id", F.lit("exact").alias("match_type"), F.lit("reject").alias("decision"), F.col("exact_id").alias("document_id"), F.lit(1.0).alias("similarity"))
    found = hit.unionByName(near)
    rest = x.select("id").join(found.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("match_type"), F.lit("keep").alias("decision"), F.lit(None).cast("long").alias("document_id"), F.lit(None).cast("double").alias("similarity"))
    return found.unionByName(rest)


def ceil_share(n: int, t: float) -> int:
    return math.ceil(n * t - 1e-9)
