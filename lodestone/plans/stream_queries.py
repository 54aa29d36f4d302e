"""Queries that take tables as streams of files; beyond the operators of a batch they show resuming and windows of time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import ingest
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


@query("s1_stream_first_wins", "select count(distinct fingerprint) as kept from fingerprints")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose fingerprint came first, ingested as a stream of files in four deliveries."""
    at = _folder(spark, "stream")
    x = spark.read.parquet(f"{sf}/fingerprints.parquet").select("fingerprint", "item_id", "origin")
    for i in range(4):  # deliveries arrive one after another; each run resumes where the last one stopped
        x.filter(F.pmod("item_id", F.lit(4)) == i).coalesce(1).write.mode("append").parquet(f"{at}/in")
        ingest.ingest_first(spark, f"{at}/in", "fingerprint string, item_id bigint, origin string", f"{at}/out", "fingerprint")
    return spark.read.parquet(f"{at}/out/rows").agg(F.count(F.lit(1)).alias("kept"))


@query("s2_stream_windows", "select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n from events group by 1, 2")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each day and type, counted over a stream."""
    at = _folder(spark, "stream")
    x = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    x.write.parquet(f"{at}/in")
    out = ingest.windowed_counts(spark, f"{at}/in", "ts timestamp, event_type string", at, "ts", "event_type")
    return out.select(F.col("start").cast("date").alias("day"), "event_type", "n")
