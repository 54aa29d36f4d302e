"""Queries that prepare documents: repair, markup, chunks and tokens. They run Python in Arrow batches."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunker, markup, tokenizer
from ..functions.rows import per_row
from .dialect import relational, words
from .registry import query


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@query("c2_mojibake_repair")
def c2(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose text shows signs of wrong decoding: repairs, what is left of the signs, and why it is rejected."""
    def run(i, t):
        now, repairs, warnings, reason = markup.repair(t)
        if repairs or reason:
            yield i, repairs, markup.suspicion(t), markup.suspicion(now), ",".join(warnings), reason, _sha(now)

    x = _table(spark, sf, "retrieved_source_records").filter("text is not null").select("record_id", "text").distinct()
    return per_row(x, run, "record_id long, repairs int, signs int, signs_left int, warnings string, reason string, sha256 string")


@query("c6_templates")
def c6(spark: SparkSession, sf: str) -> DataFrame:
    """Templates in documents' texts: removed and rendered ones."""
    def run(i, t):
        now, removed, preserved = markup.replace_templates(t)
        yield i, removed, preserved, _sha(now)

    return per_row(_table(spark, sf, "documents").filter("text like '%{{%'").select("doc_id", "text"), run, "doc_id long, removed int, preserved int, sha256 string")


@query("c7_clean_training_text")
def c7(spark: SparkSession, sf: str) -> DataFrame:
    """Text for training of each document, whole (with repair, templates and NFC), with counts of what was removed."""
    def run(i, t):
        now, n, warnings, reason = markup.clean(t)
        yield i, _sha(now), len(now), n["encoding_repairs"], n["comments"], n["references"], n["templates_removed"], n["templates_preserved"], n["citations"], ",".join(warnings), reason

    return per_row(_table(spark, sf, "documents").select("doc_id", "text"), run, "doc_id long, sha256 string, n_chars int, repairs int, comments int, refs int, templates_removed int, templates_preserved int, citations int, warnings string, reason string")


@lru_cache(maxsize=200_000)
def _count(text: str) -> int:
    return len(tokenizer.encode(text))


def document_chunks(docs: DataFrame, key: str, text: str, limits: chunker.Limits = chunker.Limits(), references: str = "exclude") -> DataFrame:
    """(key, chunk_index, chunk_count, section_title, boundary_start_type, boundary_end_type, overlap_characters, token_count, text) of each document."""
    kind = dict(docs.dtypes)[key]

    def run(i, t):
        found, _, _ = chunker.chunks(t, _count, limits, references)
        for n, c in enumerate(found):
            yield i, n, len(found), c.section, c.start, c.end, c.overlap, c.tokens, c.text

    return per_row(docs.select(key, text), run, f"{key} {kind}, chunk_index int, chunk_count int, section_title string, boundary_start_type string, boundary_end_type string, overlap_characters int, token_count int, text string")


@query("e5_document_chunks")
def e5(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each document, as hashes: packed to the target, with overlap of whole sentences, small ones merged or dropped."""
    x = document_chunks(_table(spark, sf, "documents"), "doc_id", "text")
    return x.withColumn("sha256", F.sha2("text", 256)).drop("text")


@query("e6_small_chunks")
def e6(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which small chunks were dropped, or which a reference section ended."""
    def run(i, t):
        found, dropped, ended = chunker.chunks(t, _count, references="exclude")
        if dropped or ended:
            yield i, len(found), dropped, ended

    return per_row(_table(spark, sf, "documents").select("doc_id", "text"), run, "doc_id long, chunks int, below_minimum int, reference_sections int")


@query("e4_sentence_pieces")
def e4(spark: SparkSession, sf: str, most: int = 24) -> DataFrame:
    """Sentences of more than ``most`` tokens, in pieces: sizes and kinds of cut."""
    def run(i, t):
        parts, _ = chunker.units(t or "", _count, most)
        for n, c in enumerate(parts):
            if c.start.endswith("fallback") or c.end.endswith("fallback"):
                yield i, n, _count(c.text), c.start, c.end, _sha(c.text)

    return per_row(_table(spark, sf, "documents").select("doc_id", "text"), run, "doc_id long, unit int, tokens int, start_type string, end_type string, sha256 string")


@query("e7_token_counts")
def e7(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each document by the public tokenizer, and the smallest and largest id."""
    def run(i, t):
        ids = tokenizer.encode(t)
        yield i, len(ids), min(ids, default=None), max(ids, default=None)

    return per_row(_table(spark, sf, "documents").select("doc_id", "text"), run, "doc_id long, tokens int, lowest int, highest int")


@relational("e7_word_counts")
def e7_words(d):
    """Tokens of each document by the word tokenizer that both engines have."""
    return f"select doc_id, {d.size(words(d, 'text'))} as tokens from @documents"


@query("e9_token_windows")
def e9(spark: SparkSession, sf: str, context: int = 256, most: int = 513, seed: str = "42") -> DataFrame:
    """A window of each document's tokens, at a place chosen by hash: start, length of context and of target, hash of the window's text."""
    def run(i, t):
        ids = tokenizer.encode(t)
        if len(ids) < 2:
            return
        rank = _sha(f"{seed}:{i}")
        room = max(0, len(ids) - most)
        start = int(_sha(f"window:{rank}"), 16) % (room + 1)
        own = ids[start : start + most]
        n = min(context, len(own) - 1)
        yield i, start, n, len(own) - n, hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()

    return per_row(_table(spark, sf, "documents").select("doc_id", "text"), run, "doc_id long, start int, context_tokens int, target_tokens int, sha256 string")


@query("e10_round_trips")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source, documents whose text comes back from its tokens, and whose tokens come back from that."""
    def run(s, t):
        yield s, *tokenizer.round_trip(t)

    x = per_row(_table(spark, sf, "documents").filter("text is not null").select("source", "text"), run, "source string, same_text boolean, same_ids boolean")
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("same_text").alias("same_text"), F.count_if("same_ids").alias("same_ids"))





@relational("e3_sentence_units")
def e3_sentences(d):
    """Sentences of each paragraph of each document, in order: after a full stop, question or exclamation mark and white space."""
    cut = r"([.!?])\s+"
    sep = r"\n\s*\n"
    parts = f"split(text, {d.q(sep)})" if d.spark else f"regexp_split_to_array(text, {d.q(sep)})"
    sent = d.keep(d.map(d.split(d.sub("trim(t)", cut, "$1\x1f"), "\x1f"), "z", "trim(z)"), "z", "z <> ''")
    ps = f"select doc_id, posexplode({parts}) as (p, t) from @documents where text is not null" if d.spark else f"select doc_id, unnest(range(len({parts}))) as p, unnest({parts}) as t from documents where text is not null"
    return f"with x as ({ps}), y as (select doc_id, p, {sent} as s from x where trim(t) <> '') select doc_id, {d.int('p')} as paragraph, {d.size('s')} as sentences, {d.sha(d.join('s', '|'))} as sha256 from y"
