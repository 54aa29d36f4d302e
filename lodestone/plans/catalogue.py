"""All queries of the core, imported for their registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import check_queries, dedup_queries, prepare_queries, record_queries, schedule_queries, score_queries, select_queries, source_queries, stat_queries, stream_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["flagship_commitment_report"](spark, sf)
