"""Token counts of texts by a public byte-level tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenizer import VOCABULARY, encoder


def counted(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the column text replaced by n_tokens (int): 0 for null and empty text."""
    at = df.columns.index(text)
    names = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            ns = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(ns, pa.int32())], [*names, "n_tokens"])

    return df.mapInArrow(run, f"{schema}, n_tokens int")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each key that isn't null: the smallest."""
    rest = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
