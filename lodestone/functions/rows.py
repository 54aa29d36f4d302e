"""Running a Python function of one row over a table, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def per_row(df: DataFrame, f: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that f gives for each row of df; f gets the row's values and yields tuples of the schema."""
    target: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def run(batches):
        for b in batches:
            out = [row for values in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in f(*values)]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, arrow, strict=True)], schema=pa.schema([pa.field(t.name, t.type) for t in arrow]))

    return df.mapInArrow(run, target)
