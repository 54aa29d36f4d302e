"""Ordered operators that need no global sort: places in an order, and packing of examples into records of fixed width."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df with r, each row's place (from 0) in the order of the keys: ranges are sorted each by itself, and offset by the rows before."""
    x = staged(df.repartitionByRange(*keys).withColumn("range_", F.spark_partition_id()), "order")
    counts = x.groupBy("range_").agg(F.count(F.lit(1)).alias("c"))  # a row for each range
    before = counts.select("range_", (F.sum("c").over(Window.orderBy("range_")) - F.col("c")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*keys))
    return x.withColumn("own_", own).join(F.broadcast(before), "range_").withColumn("r", (F.col("own_") - 1 + F.col("before")).cast("long")).drop("range_", "own_", "before")


#: Blocks of a hash order that are packed by themselves: its first so many hex digits.
DIGITS = 1


def next_fit(df: DataFrame, keys: list[str], width: int, keep_over: bool = True) -> DataFrame:
    """Examples put into records of ``width`` tokens, in order: (keys, block, id, record, start, kept, state).

    df has the keys, block, hk (the order within a block), id, prompt and n (tokens
    of the prompt and of all). An example that doesn't fit into the open record
    opens the next one. One longer than a record gets one of its own and is cut
    ("truncated", without end marker), or left out ("dropped") if its prompt
    alone fills it; with keep_over false it is left out as "over_width". Only ids
    and sizes are moved, and each block of a key is packed by a task of its own.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hk", "id"], kind="stable")
        record = used = 0
        out = []
        for n, prompt in zip(pdf["n"], pdf["prompt"], strict=True):
            if n > width and not keep_over:
                out.append((-1, 0, 0, "over_width"))
                continue
            if n > width:
                record, used = record + (used > 0), 0
                if prompt >= width:
                    out.append((-1, 0, 0, "dropped"))
                    continue
                out.append((record, 0, width, "truncated"))
                used = width
                continue
            if used + n > width:
                record, used = record + 1, 0
            out.append((record, used, n, "complete"))
            used += n
        got = pd.DataFrame(out, columns=["record", "start", "kept", "state"], index=pdf.index)
        return pd.concat([pdf[[*keys, "block", "id"]], got], axis=1)

    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "block", "id"]) + ", record long, start long, kept long, state string"
    return df.select(*keys, "block", "hk", "id", "prompt", "n").groupBy(*keys, "block").applyInPandas(run, schema)


def next_fit_sql(rows: str, keys: list[str], width: int, keep_over: bool = True) -> str:
    """CTEs (o, walk) of the same rule as one recursion over all blocks side by side; rows is a relation of next_fit's columns."""
    k = ", ".join([*keys, "block"])
    on = " and ".join(f"o.{x} is not distinct from w.{x}" for x in [*keys, "block"])
    over = f"o.n > {width}"
    drop = f"o.prompt >= {width}" if keep_over else "true"
    def step(record, used):
        full = f"{record} + case when {used} > 0 then 1 else 0 end"
        fits = f"{used} + o.n <= {width}"
        lost = full if keep_over else record
        at = f"case when {over} then case when {drop} then {lost} else {full} end when {fits} then {record} else {record} + 1 end"
        start = f"case when {over} then 0 when {fits} then {used} else 0 end"
        kept = f"case when {over} then case when {drop} then 0 else {width} end else o.n end"
        after = f"case when {over} then case when {drop} then {'0' if keep_over else used} else {width} end when {fits} then {used} + o.n else o.n end"
        state = f"case when {over} then case when {drop} then '{'dropped' if keep_over else 'over_width'}' else 'truncated' end else 'complete' end"
        return f"cast({at} as bigint) as record, cast({start} as bigint) as start, cast({kept} as bigint) as kept, cast({after} as bigint) as used, {state} as state"
    cols = ", ".join(f"o.{x}" for x in [*keys, "block", "id", "i"])
    return f"""o as (select *, row_number() over (partition by {k} order by hk, id) as i from {rows}),
      walk as (select {cols}, {step('0', '0')} from o where i = 1 union all select {cols}, {step('w.record', 'w.used')} from walk w join o on {on} and o.i = w.i + 1)"""
