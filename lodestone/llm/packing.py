"""Filling fixed-capacity containers with items (problem 7).

Deficit round-robin over the sources' queues: each window of the output is to
hold the sources' target proportions of tokens, and what a source could not
give because its next item was too large is carried into the next window. As
every item must be packed, a source whose queue ends leaves its share to the
others in their proportions. The carried deficits are the fractional parts of
running totals, so the places of items are computed by two levels of prefix
sums instead of a sequential loop: with v, the tokens before an item in its
queue divided by its source's proportion, the output before it is the sum over
all sources of proportion times min(v, v at the end of that source). That
carries deficits across windows and partitions exactly. Within a window (of
bounded size) items are put into containers by best fit, the largest first.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from .tokens import VOCABULARY, counted, once

#: Containers of one window; a window is packed by one task.
WINDOW = 2000
#: Items of one step of the prefix sums.
STEP = 20_000


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Container of each item, by best fit in decreasing order, and the number of containers.

    Items must not exceed the capacity. Ties go in the given order.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    open_: list[tuple[int, int]] = []  # (room, container), sorted
    out, n = [0] * len(sizes), 0
    for i in order:
        at = bisect_left(open_, (sizes[i], -1))
        if at == len(open_):
            room, box = capacity, n
            n += 1
        else:
            room, box = open_.pop(at)
        out[i] = box
        if room > sizes[i]:
            insort(open_, (room - sizes[i], box))
    return out, n


def pieces(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile_id, capacity, doc_id, source, piece, n_tokens, start): items as they can be packed, for each profile.

    Only items above the capacity are divided, into pieces of the whole
    capacity that overlap by the profile's overlap_tokens, and a rest.
    """
    few = profiles.filter("profile_id is not null and capacity_tokens > 0").groupBy("profile_id").agg(F.min("capacity_tokens").alias("capacity"), F.min(F.coalesce("overlap_tokens", F.lit(0))).alias("overlap")).limit(1001).collect()
    if len(few) > 1000:
        raise ValueError("more than 1000 packing profiles")
    if not few:
        few_col = F.expr("cast(array() as array<struct<profile_id:string,capacity:int,step:int>>)")
    else:
        few_col = F.array(*[F.struct(F.lit(r["profile_id"]).alias("profile_id"), F.lit(r["capacity"]).alias("capacity"), F.lit(r["capacity"] - max(0, min(r["overlap"], r["capacity"] - 1))).alias("step")) for r in few])
    x = items.withColumn("p", F.explode(few_col)).select("doc_id", "source", "n_tokens", "p.*")
    last = F.when(F.col("n_tokens") > F.col("capacity"), F.ceil((F.col("n_tokens") - F.col("capacity")) / F.col("step"))).otherwise(F.lit(0)).cast("int")
    x = x.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece") * F.col("step")
    return x.select("profile_id", "capacity", "doc_id", "source", "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.col("capacity")).alias("n_tokens"))


def packed(docs: DataFrame, profiles: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, proportions: DataFrame | None = None) -> DataFrame:
    """(profile_id, container_id, capacity, doc_id, source, piece, start, n_tokens): the container of each document's piece.

    Documents without id take no part; repeated ids count once. Null or empty
    texts have no tokens and so need no container. A null source is a queue of
    its own. Containers are numbered within a profile as "window-number".
    proportions: (source, weight), the share of tokens that each source is to
    have in every window while its queue lasts; sources that aren't listed, or
    with a null or no positive weight, come after all others, in proportion to
    their own tokens. Without proportions each source is spread over all windows.
    """
    base = docs.select("doc_id", "source", "text").filter("doc_id is not null and text is not null and text != ''")
    items = staged(once(counted(base, "text", vocabulary), "doc_id").filter("n_tokens > 0"), "items")
    x = pieces(items, profiles).withColumn("source", F.coalesce("source", F.lit("")))
    # Queues: within a source, a fixed shuffled order, cut into steps of bounded size.
    n = items.count()
    steps = max(1, -(-n // STEP))
    spot = F.xxhash64(F.lit("queue"), "doc_id")
    x = x.withColumn("step", F.pmod(F.shiftrightunsigned(spot, 20), F.lit(steps)))
    sums = x.groupBy("profile_id", "capacity", "source", "step").agg(F.sum("n_tokens").alias("t"))
    queue = Window.partitionBy("profile_id", "source").orderBy("step")  # a row for each step: few
    before = F.sum("t").over(queue.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("t").over(Window.partitionBy("profile_id", "source"))
    sums = sums.select("profile_id", "source", "step", F.coalesce(before, F.lit(0)).alias("before"), total.alias("source_total"), "t")
    queues = sums.groupBy("profile_id", "source").agg(F.max("source_total").alias("tokens"))
    if proportions is not None:
        asked = proportions.filter("weight > 0").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("weight").alias("weight"))
        queues = queues.join(asked, "source", "left")
    else:
        queues = queues.withColumn("weight", F.lit(None).cast("double"))
    # Sources without a weight wait until the others' queues have ended, at v = late.
    late = F.max(F.when(F.col("weight").isNotNull(), F.col("tokens") / F.col("weight"))).over(Window.partitionBy("profile_id"))
    queues = queues.withColumn("from_v", F.when(F.col("weight").isNull(), F.coalesce(late, F.lit(0.0))).otherwise(F.lit(0.0))).withColumn("q", F.coalesce("weight", F.col("tokens").cast("double")))
    # A row for each profile, with an entry for each source.
    of = queues.groupBy("profile_id").agg(F.sum("tokens").alias("all_tokens"), F.collect_list(F.struct("q", "from_v", (F.col("tokens") / F.col("q")).alias("long"))).alias("queues"))
    sums = sums.drop("t", "source_total").join(queues.select("profile_id", "source", "q", "from_v"), ["profile_id", "source"])
    inner = Window.partitionBy("profile_id", "source", "step").orderBy(spot, "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("own", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(sums, ["profile_id", "source", "step"]).join(F.broadcast(of), "profile_id")
    windows = F.ceil(F.col("all_tokens") / (F.lit(window) * F.col("capacity")))
    # The middle of the item decides its window.
    x = x.withColumn("v", F.col("from_v") + (F.col("before") + F.col("own") + F.col("n_tokens") / 2) / F.col("q"))
    out = F.aggregate("queues", F.lit(0.0), lambda s, e: s + e["q"] * F.greatest(F.lit(0.0), F.least(F.col("v") - e["from_v"], e["long"])))
    x = x.withColumn("window", F.least(F.floor(out / F.col("all_tokens") * windows), windows - 1).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        box, _ = best_fit(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]))
        pdf["container_id"] = [f"{w:08d}-{b:06d}" for w, b in zip(pdf["window"], box, strict=True)]
        return pdf[["profile_id", "container_id", "capacity", "doc_id", "source", "piece", "start", "n_tokens"]]

    rows = x.select("profile_id", "capacity", "window", "doc_id", "source", "piece", "start", "n_tokens")
    return rows.groupBy("profile_id", "window").applyInPandas(pack, "profile_id string, container_id string, capacity int, doc_id long, source string, piece int, start int, n_tokens int")


def fills(assignments: DataFrame) -> DataFrame:
    """(profile_id, container_id, items, used_tokens, capacity, fill): how full each container is."""
    g = assignments.groupBy("profile_id", "container_id", "capacity").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("used_tokens"))
    return g.select("profile_id", "container_id", "items", "used_tokens", "capacity", (F.col("used_tokens") / F.col("capacity")).alias("fill"))
