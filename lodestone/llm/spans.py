"""Long exact spans shared between records (problem 9).

Anchors: of each text, the smallest hash among any ``span - GRAM + 1``
neighbouring GRAM-character runs is chosen, so that two texts that share span
characters share an anchor within them. Only anchors that occur in two
different texts go on, with the characters around that a shared span through
the anchor can reach. Segments of the same anchor meet in one shard. There one
part of them is put into a compressed FM-index and the segments of other
documents are streamed through it by backward search; where the matching
statistics reach the span, the suffixes' bounds give the pairs, and the places
on both sides give the intervals.

Equal texts are searched once and equal segments are indexed once. An anchor
with very many different segments is cut into blocks; each block is indexed and
those after it are streamed through it, so no task grows with the data and no
pair is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, staged
from .fmindex import FMIndex
from .words import mix

SPAN, GRAM = 160, 64
#: Different segments of one shard, and of one block of a hot anchor.
SHARD, BLOCK = 2000, 1500
#: Partitions of the search at most; further shards share them.
MOST_TASKS = 20_000

_B = np.uint64(0x5851F42D4C957F2D)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _inverse(b: int) -> np.uint64:
    return np.uint64(pow(b, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_B, _inverse(int(_B)))):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[i] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(cp: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k code points."""
    n = len(cp) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(cp))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        return mix((total[k:] - total[:-k]) * down[:n])


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """Minimum or maximum of each w neighbours."""
    size = 1
    while size * 2 <= w:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(cp: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the chosen runs: every span characters hold one."""
    w = span - gram + 1
    h = gram_hashes(cp, gram)
    if len(h) < w:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _sliding(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    cover = _sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    at = np.flatnonzero(h == cover)
    return at, h[at]


def _around(text_len: int, place: int, span: int, gram: int) -> tuple[int, int]:
    return max(0, place - (span - gram)), min(text_len, place + span)


def segments(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(anchor, doc, start, size, seg_key, seg): the surroundings of anchors that two different texts have."""

    def find(batches):
        for b in batches:
            docs_, hs, ps = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, h = anchors(points(t), span, gram)
                docs_.append(np.full(len(at), d, np.int64)), hs.append(h.view(np.int64)), ps.append(at)
            if docs_:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs_), pa.int64()), pa.array(np.concatenate(hs), pa.int64()), pa.array(np.concatenate(ps).astype(np.int32), pa.int32())], ["doc", "anchor", "place"])

    every = staged(docs.mapInArrow(find, "doc long, anchor long, place int"), "anchors")
    shared = every.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a < z").select("anchor")
    hits = every.join(shared, "anchor").groupBy("doc").agg(F.collect_list(F.struct("anchor", "place")).alias("hits"))  # bounded by the text

    def cut(batches):
        names = ["anchor", "doc", "start", "size", "seg_key", "seg"]
        for b in batches:
            out = [[] for _ in names]
            for d, t, hs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen = set()
                for h in hs:
                    a, z = _around(len(t), h["place"], span, gram)
                    s = t[a:z]
                    key = xxhash.xxh3_128_hexdigest(s.encode("utf-8", "surrogatepass"))
                    # Equal surroundings are stated once for a text, their places each time.
                    for o, v in zip(out, (h["anchor"], d, a, z - a, key, None if key in seen else s), strict=True):
                        o.append(v)
                    seen.add(key)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names)

    out = staged(docs.join(hits, "doc").select("doc", "text", "hits").mapInArrow(cut, "anchor long, doc long, start int, size int, seg_key string, seg string"), "segs")
    drop_stage(every)
    return out


_OUT = "seg_key string, a int, z int, other string"


def _islands(text: np.ndarray, place: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the runs of neighbouring places, each of which stands for span characters."""
    by = np.lexsort((place, text))
    text, place = text[by], place[by]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (place[1:] > place[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(text)) - 1
    return text[first], place[first], place[last] + span


def _streamed(index: FMIndex, held: np.ndarray, texts: list[np.ndarray], who: np.ndarray, lo_doc: np.ndarray, hi_doc: np.ndarray) -> tuple[list, list]:
    """Segments streamed through an index: intervals (text, start, end) of either side, and pairs of texts, that two documents share.

    held and who are the numbers of the indexed and of the streamed segments,
    lo_doc and hi_doc the smallest and largest document of each segment.
    """
    t, place, lo, hi = index.matches(texts)
    t = who[t]
    own = np.isin(t, held) & (hi - lo == 1)  # only itself
    t, place, lo, hi = t[~own], place[~own], lo[~own], hi[~own]
    if not len(t):
        return [], []
    runs, first, run = np.unique(lo, return_index=True, return_inverse=True)
    size = hi[first] - runs
    of = np.repeat(np.arange(len(runs)), size)
    text, spot = index.locate(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(runs, size))
    text = held[text]
    r_lo, r_hi = np.full(len(runs), np.iinfo(np.int64).max), np.full(len(runs), np.iinfo(np.int64).min)
    np.minimum.at(r_lo, of, lo_doc[text]), np.maximum.at(r_hi, of, hi_doc[text])
    np.minimum.at(r_lo, run, lo_doc[t]), np.maximum.at(r_hi, run, hi_doc[t])
    two = r_lo < r_hi  # runs that stand in two documents
    spans = [_islands(t[two[run]], place[two[run]], index.span), _islands(text[two[of]], spot[two[of]], index.span)]
    # Runs of the same segments are looked at once.
    kinds: dict[bytes, int] = {}
    by = np.lexsort((text, of))
    x, y = of[by], text[by]
    once = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    x, y = x[once], y[once]
    members = np.split(y, np.flatnonzero(x[1:] != x[:-1]) + 1)
    kind = np.array([kinds.setdefault(x.tobytes(), i) for i, x in enumerate(members)], np.int64)
    pairs = []
    for x, k in {(int(x), int(k)) for x, k in zip(t[two[run]], kind[run[two[run]]], strict=True)}:
        y = members[k]
        y = y[(y != x) & ~((lo_doc[y] == hi_doc[y]) & (lo_doc[y] == lo_doc[x]) & (lo_doc[x] == hi_doc[x]))]
        pairs.append((np.full(len(y), x), y))
    return spans, pairs


def _search(pdf: pd.DataFrame, span: int) -> pd.DataFrame:
    """Within a shard: intervals (seg_key, a, z) of segments that stand in another document too, and pairs (seg_key, other).

    Rows of part 0 are indexed, all of part 1 are streamed through that index.
    mode says what else: "same" and "all" stream part 0 itself, "all" also
    indexes part 1 for itself.
    """
    pdf = pdf.drop_duplicates("seg_key").reset_index(drop=True)
    mode, part, keys = pdf["mode"].iloc[0], pdf["part"].to_numpy(), pdf["seg_key"].to_numpy()
    texts = [points(x) for x in pdf["seg"]]
    docs = pdf["lo_doc"].to_numpy(), pdf["hi_doc"].to_numpy()
    one, two = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    jobs = [(one, two if mode == "cross" else np.concatenate([one, two]))] + ([(two, two)] if mode == "all" else [])
    out = []
    for held, who in jobs:
        if not len(held) or not len(who):
            continue
        spans, pairs = _streamed(FMIndex([texts[i] for i in held], span), held, [texts[i] for i in who], who, *docs)
        out += [pd.DataFrame({"seg_key": keys[t], "a": a.astype("int32"), "z": z.astype("int32"), "other": None}) for t, a, z in spans]
        if pairs:
            x, y = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
            out.append(pd.DataFrame({"seg_key": keys[x], "a": -1, "z": -1, "other": keys[y]}))
    empty = pd.DataFrame({"seg_key": pd.Series([], dtype=object), "a": pd.Series([], dtype="int32"), "z": pd.Series([], dtype="int32"), "other": pd.Series([], dtype=object)})
    return pd.concat(out, ignore_index=True) if out else empty


def shared_passages(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, links, copies) of the documents that share at least span characters with another one.

    passages: (doc, start, size), the stretches of a document that stand in
    another text too. links: (a, b), different texts that share a passage.
    copies: (doc, copy), the documents of each text and the one that stands for
    it in passages and links. Documents without key or text take no part; of
    repeated keys the smallest text counts.
    """
    if not 0 < gram <= span:
        raise ValueError("gram must be between 1 and span")
    digest = F.sha2(F.col("text"), 256)
    own = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= span))
    ids = staged(own.select("doc", digest.alias("digest")).groupBy("doc").agg(F.min("digest").alias("digest")), "ids")
    first = ids.groupBy("digest").agg(F.min("doc").alias("first"))
    copies = staged(ids.join(first, "digest").select(F.col("first").alias("doc"), F.col("doc").alias("copy"), "digest"), "copies")
    unique = own.join(copies.filter("doc = copy").select("doc", "digest"), "doc").filter(digest == F.col("digest")).select("doc", "text")
    segs = segments(unique.dropDuplicates(["doc"]), span, gram)
    at = segs.select("seg_key", "doc", "start", "size")
    # How many different segments an anchor has; no texts are moved for it.
    per = staged(segs.select("anchor", "seg_key").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "kinds")
    total = per.agg(F.sum("kinds").alias("n"), F.count(F.lit(1)).alias("m")).first()
    shards = max(1, -(-(total["n"] or 0) // SHARD))
    docs_of = at.groupBy("seg_key").agg(F.min("doc").alias("lo_doc"), F.max("doc").alias("hi_doc"))
    several = segs.filter("seg is not null").join(per, "anchor").join(docs_of, "seg_key").select("anchor", "seg_key", "seg", "kinds", "lo_doc", "hi_doc")
    blocks = F.ceil(F.col("kinds") / BLOCK)
    spot = F.xxhash64("seg_key")
    mine = F.pmod(spot, blocks)
    place = lambda shard, mode, part: F.struct(shard.alias("shard"), F.lit(mode).alias("mode"), part.cast("int").alias("part"))
    # A cold anchor goes to a shard by its hash; each block of a hot one is indexed, and streamed through those before it.
    cold = F.array(place(F.concat(F.lit("s"), F.pmod(F.xxhash64("anchor"), F.lit(shards))), "all", F.pmod(F.shiftrightunsigned(spot, 32), F.lit(2))))
    hot = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: place(F.concat_ws(":", "anchor", F.least(mine, o), F.greatest(mine, o)), "cross", (mine > o)))
    hot = F.transform(hot, lambda p: F.struct(p["shard"].alias("shard"), F.when(p["shard"].endswith(F.concat(F.lit(":"), mine, F.lit(":"), mine)), "same").otherwise(p["mode"]).alias("mode"), p["part"].alias("part")))
    placed = several.select("seg_key", "seg", "lo_doc", "hi_doc", F.explode(F.when(F.col("kinds") <= SHARD, cold).otherwise(hot)).alias("p")).select("seg_key", "seg", "lo_doc", "hi_doc", "p.*")
    # Searching a shard costs far more than its bytes tell, so they are spread over more partitions than bytes ask for.
    runs = staged(placed.repartition(min(4 * shards, MOST_TASKS), "shard").groupBy("shard").applyInPandas(lambda pdf: _search(pdf, span), _OUT), "runs")
    found = runs.filter("other is null").join(at, "seg_key").select("doc", (F.col("start") + F.col("a")).alias("start"), (F.col("z") - F.col("a")).alias("size"))
    # Equal segments share all of their characters.
    same = docs_of.filter("lo_doc < hi_doc").select("seg_key")
    equal = at.filter(F.col("size") >= span).join(same, "seg_key")
    passages = found.unionByName(equal.select("doc", "start", "size")).distinct()
    docs_at = at.select("seg_key", "doc").distinct()
    a, b = docs_at.select("seg_key", F.col("doc").alias("a")), docs_at.select(F.col("seg_key").alias("other"), F.col("doc").alias("b"))
    far = runs.filter("other is not null").select("seg_key", "other").distinct().join(a, "seg_key").join(b, "other").select("a", "b")
    alike = equal.select("seg_key", "doc").distinct()
    near = alike.select("seg_key", F.col("doc").alias("a")).join(alike.select("seg_key", F.col("doc").alias("b")), "seg_key").select("a", "b")
    links = far.union(near).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return passages, links, copies.select("doc", "copy")


def sharing_pairs(links: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_a, doc_b): all pairs of documents that share a passage, smaller first."""
    x = copies.select(F.col("doc").alias("a"), F.col("copy").alias("x"))
    y = copies.select(F.col("doc").alias("b"), F.col("copy").alias("y"))
    far = links.join(x, "a").join(y, "b").select("x", "y")
    near = x.join(y, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    every = far.union(near)
    return every.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def sharing_classes(links: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, class_doc_id, n_copies, n_linked_texts): the document that stands for each sharing document's text, and how many copies and other texts it shares with."""
    ends = links.select(F.col("a").alias("doc"), "b").union(links.select("b", "a")).groupBy("doc").agg(F.count(F.lit(1)).alias("n_linked_texts"))
    times = copies.groupBy("doc").agg(F.count(F.lit(1)).alias("n_copies"))
    x = copies.join(times, "doc").join(ends, "doc", "left").filter("n_copies > 1 or n_linked_texts is not null")
    return x.select(F.col("copy").alias("doc_id"), F.col("doc").alias("class_doc_id"), "n_copies", F.coalesce("n_linked_texts", F.lit(0).cast("long")).alias("n_linked_texts"))


def sharing_report(documents: DataFrame, passages: DataFrame, copies: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, spans, shared_chars, shared_part): of each sharing document, how much stands elsewhere too."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = total = 0
        end = -1
        for a, n in sorted(zip(pdf["start"], pdf["size"], strict=True)):
            if a > end:
                spans += 1
            total += max(0, a + n - max(a, end))
            end = max(end, a + n)
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]], "spans": [spans], "shared_chars": [total]})

    # The groups of one document are bounded by its length.
    per = passages.select("doc", "start", "size").distinct().groupBy("doc").applyInPandas(merged, "doc long, spans int, shared_chars long")
    sizes = documents.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("copy")).agg(F.min(F.length(text)).alias("n_chars"))
    times = copies.groupBy("doc").agg(F.count(F.lit(1)).alias("times"))
    x = copies.join(times, "doc").join(per, "doc", "left").join(sizes, "copy").filter("times > 1 or spans is not null")
    chars = F.when(F.col("times") > 1, F.col("n_chars")).otherwise(F.col("shared_chars")).cast("long")
    return x.select(F.col("copy").alias(key), "n_chars", F.when(F.col("times") > 1, 1).otherwise(F.col("spans")).alias("spans"), chars.alias("shared_chars"), (chars / F.col("n_chars")).alias("shared_part"))
