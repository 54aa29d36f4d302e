"""Queries of the training-data operators, by name; none has an SQL counterpart (see the README)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import plain_unions
from . import answers, batches, encoding, leaks, mixing, packing, pieces, spans, splits


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    hits = leaks.leaked_prompts(_t(spark, d, "retrieved_source_records"), _t(spark, d, "prompts"), "record_id", "text")
    return hits.select("record_id", "prompt_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return batches.rejected_items(_t(spark, d, "fingerprints")).select("item_id", "dup_item_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized_pieces(_t(spark, d, "text_chunks"), "chunk_id", "text", "section_title", "boundary_end_type")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).filter("piece = 0").select("chunk_id")


def p4_chunk_pairs(spark: SparkSession, d: str) -> DataFrame:
    return splits.cross_split_pairs(_t(spark, d, "base_text_chunks"), "chunk_id", "split", "token_ids", "tokens", 5, 0.7, "text_sha256", "source_id")


def p4_example_pairs(spark: SparkSession, d: str) -> DataFrame:
    return splits.cross_split_pairs(_t(spark, d, "instruction_examples"), "example_id", "split", "instruction", "text", 3, 0.5, None, "source_type")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.keyed_pairs(p4_chunk_pairs(spark, d)).union(splits.keyed_pairs(p4_example_pairs(spark, d)))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.overlap_report(p4_chunk_pairs(spark, d), "base_text_chunks").unionByName(splits.overlap_report(p4_example_pairs(spark, d), "instruction_examples"))


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    a = encoding.repaired(_t(spark, d, "retrieved_source_records"), "record_id", "text")
    b = encoding.repaired(_t(spark, d, "text_chunks"), "chunk_id", "text")
    a = a.select(F.lit("retrieved_source_records").alias("table_name"), F.col("record_id").cast("string").alias("row_key"), "restored", "whole")
    return a.unionByName(b.select(F.lit("text_chunks").alias("table_name"), F.col("chunk_id").alias("row_key"), "restored", "whole"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_restored(spark, d).select("table_name", "row_key")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defective_pairs(_t(spark, d, "instruction_examples"), "example_id", "instruction", "response")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_t(spark, d, "documents"), _t(spark, d, "packing_profiles"))


def p7_fills(spark: SparkSession, d: str) -> DataFrame:
    return packing.fills(p7_containers(spark, d))


def p8_chosen(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(_t(spark, d, "documents"), _t(spark, d, "mixture_sources"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.mixed(_t(spark, d, "documents"), _t(spark, d, "mixture_sources")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    _, links, copies = spans.shared_passages(_t(spark, d, "documents"))
    return spans.sharing_pairs(links, copies)


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    _, links, copies = spans.shared_passages(_t(spark, d, "documents"))
    return spans.sharing_classes(links, copies)


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_passages(_t(spark, d, "documents"))[0]


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    passages, _, copies = spans.shared_passages(docs)
    return spans.sharing_report(docs, passages, copies)


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_pieces, p4_found, p4_report, p5_found, p5_restored, p6_found, p7_containers, p7_fills, p8_chosen, p8_shares, p9_found, p9_classes, p9_passages, p9_shared)}
SQL: dict[str, str] = {}
