"""Evaluation texts leaking into training text (problem 1).

Items are the runs of ``span`` words of the evaluation texts (a shorter text is
one item). As an item must be contained whole, the prefix of its tokens (runs
of up to ``width`` words, ordered by rarity in the corpus) is one token long:
the rarest. Corpus tokens are joined with these, positions and lengths that
leave no room for the item are dropped, and each remaining window of the
item's size is compared word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import rows_within, staged
from .words import windows, word_codes, words

#: Up to so many item tokens the evaluation side is broadcast (16 bytes each), and texts are cut to its tokens as they are read; beyond it, it is shuffled.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if rows_within(df, BROADCAST_ROWS) else df


def items(prompts: DataFrame, id_col: str, text_col: str, span: int = 8, width: int = 3) -> DataFrame:
    """(item, prompt_id, words, tokens): a row for each different run of span words of a prompt.

    Texts that are null or have no words give no item. tokens are the hashes of
    the item's runs of min(width, its length) words, in order.
    """

    def run(batches):
        for b in batches:
            out = {"prompt_id": [], "words": [], "width": [], "tokens": []}
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(t)
                size = min(span, len(ws))
                if i is None or not size:
                    continue
                k = min(width, size)
                for one in dict.fromkeys(tuple(ws[j : j + size]) for j in range(len(ws) - size + 1)):
                    out["prompt_id"].append(i), out["words"].append(list(one)), out["width"].append(k)
                    out["tokens"].append(windows(word_codes(list(one)), k).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out["prompt_id"], b.schema.field(0).type), pa.array(out["words"], pa.list_(pa.string())), pa.array(out["width"], pa.int32()), pa.array(out["tokens"], pa.list_(pa.int64()))], list(out))

    kind = dict(prompts.dtypes)[id_col]
    rows = prompts.select(id_col, text_col).mapInArrow(run, f"prompt_id {kind}, words array<string>, width int, tokens array<bigint>")
    return rows.distinct().withColumn("item", F.unhex(F.substring(F.sha2(F.to_json(F.struct("prompt_id", "words")), 256), 1, 32)))


def leaked_prompts(
    corpus: DataFrame, prompts: DataFrame, corpus_id: str, corpus_text: str, prompt_id: str = "id", prompt_text: str = "prompt", span: int = 8, width: int = 3
) -> DataFrame:
    """(corpus_id, prompt_id, first_word): where corpus texts contain span consecutive words of a prompt.

    first_word is the index of the first such word run in the corpus text. A
    prompt of fewer words must be contained whole. Repeated rows of either
    side (same id) give one result row; rows without id, with null or with
    empty text give none. Other columns of the inputs are ignored.
    """
    its = staged(items(prompts, prompt_id, prompt_text, span, width), "items")
    widths = [r[0] for r in its.select("width").distinct().collect()]  # at most `width` values
    tokens = its.select("item", "width", F.posexplode("tokens").alias("offset", "token"))
    cid, kind = "c_id", dict(corpus.dtypes)[corpus_id]
    texts = corpus.select(F.col(corpus_id).alias(cid), F.col(corpus_text).alias("c_text")).filter("c_id is not null and c_text is not null")

    asked = tokens.select("token").distinct()
    few = rows_within(asked, BROADCAST_ROWS)
    spark = corpus.sparkSession
    wanted = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in asked.collect()] if few else [], np.int64)))

    def tokenized(batches):
        own = wanted.value
        for b in batches:
            ids, sizes, places, toks = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = word_codes(words(t))
                w = [windows(codes, k) for k in widths]
                tok = np.concatenate(w).view(np.int64) if w else np.empty(0, np.int64)
                at = np.concatenate([np.arange(len(x)) for x in w]) if w else np.empty(0, np.int64)
                if few:
                    held = own[np.minimum(np.searchsorted(own, tok), len(own) - 1)] == tok if len(own) else np.zeros(len(tok), bool)
                    if not held.any():
                        continue
                    tok, at = tok[held], at[held]
                toks.append(tok), places.append(at)
                ids.append(i), sizes.append(len(codes))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(sizes, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(toks, pa.list_(pa.int64()))], ["c_id", "n_words", "at", "token"])

    own = (
        texts.mapInArrow(tokenized, f"c_id {kind}, n_words int, at array<int>, token array<bigint>")
        .select("c_id", "n_words", F.explode(F.arrays_zip("at", "token")).alias("t"))
        .select("c_id", "n_words", F.col("t.at").alias("at"), F.col("t.token").alias("token"))
    )
    # Only tokens that some item has can be a prefix: the corpus is cut to them first, and read once.
    met = staged(own if few else own.join(asked, "token"), "met")
    df = met.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(df, "token", "left").fillna(0, ["df"])
    # An item with a token that the corpus lacks has df 0 there, and so drops out of the join.
    prefix = ranked.groupBy("item").agg(F.min(F.struct("df", "token", "offset")).alias("p")).select("item", "p.token", "p.offset")
    prefix = prefix.join(its.select("item", F.size("words").alias("size")), "item")
    place = F.col("at") - F.col("offset")
    found = met.join(_small(prefix), "token").filter((place >= 0) & (place + F.col("size") <= F.col("n_words"))).select("c_id", "item", place.alias("place")).distinct()
    found = staged(found, "found")
    # Verification reads the candidates' texts only.
    claims = found.join(its.select("item", "prompt_id", "words"), "item").groupBy("c_id").agg(F.collect_list(F.struct("prompt_id", "place", "words")).alias("claims"))
    pid = dict(its.dtypes)["prompt_id"]

    def verify(batches):
        for b in batches:
            out = [], [], []
            for i, t, cs in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                ws, first = words(t), {}
                for c in cs:
                    if ws[c["place"] : c["place"] + len(c["words"])] == c["words"]:
                        first[c["prompt_id"]] = min(first.get(c["prompt_id"], c["place"]), c["place"])
                for p, at in first.items():
                    out[0].append(i), out[1].append(p), out[2].append(at)
            kinds = b.schema.field(0).type, pa.string() if pid == "string" else None, pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["c_id", "p_id", "first_word"])

    checked = texts.join(claims, "c_id").select("c_id", "c_text", "claims").mapInArrow(verify, f"c_id {kind}, p_id {pid}, first_word int")
    return checked.groupBy(F.col("c_id").alias(corpus_id), F.col("p_id").alias("prompt_id")).agg(F.min("first_word").alias("first_word"))
