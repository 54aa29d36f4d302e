"""Deduplicating new batches against all history (problem 2).

A table of pivot distances is kept in a folder and grows with each batch; a
batch is compared with the table only, never with history's texts.

The metric is the symmetric difference |x ^ y| of two texts' sets of word
windows; similarity t or more is the same as a distance of at most
(1 - t) / (1 + t) * (|x| + |y|). The fixed pivots are

* the sets of one window. The distance is |x| - 1 to a window's set that x
  holds, |x| + 1 to all others, so only the former are kept, and of these the
  |x| - ceil(t |x|) + 1 nearest in a fixed order (rarest in history first):
  similar sets have one of these pivots in common;
* the empty set, at distance |x|;
* the unions of 128 hash cells, of whose distances the parity is kept.

A batch is joined with the table on pivots, in ranges of distance: by the
triangle inequality sets whose distances to the empty set, or whose summed
differences over the cells, exceed the bound can't be similar. Pivots that are
history texts would not do: texts that aren't near-duplicates are at nearly the
largest distance from each other, so no range of such distances parts them
(figures in the README). The true distance of the pairs left is computed from
the windows in the table, and the rows of accepted items are appended.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, drop_stage, shared_dir, staged
from . import setjoin

K, SIMILARITY = 5, 0.6
#: Undecided items that one task settles in order; while there are more, whole rounds settle them.
LAST = 100_000


def _order():
    return F.struct("batch_no", "item_id")


def _fingerprint(c: str):
    low = F.lower(F.trim(F.col(c)))
    return F.when(low.rlike("^[0-9a-f]{64}$"), low)


def _rows(items: DataFrame, k: int) -> DataFrame:
    """(item_id, batch_no, fp, set_key, n, w) of each row; rows without item_id are left out, a null batch_no counts as the last batch."""
    base = items.filter("item_id is not null").select("item_id", F.coalesce("batch_no", F.lit(2**31 - 1)).alias("batch_no"), _fingerprint("fingerprint").alias("fp"), F.col("item_text").alias("text"))
    return setjoin.windowed(base, "text", "text", k)


class PivotTable:
    """The table of history at a path, which all executors can reach.

    Its parts: order (the counters that fix the order of pivots, from the first
    batch), prints (the fingerprints of accepted items) and sets (a row for each
    different window set of accepted items, with its distances). Each batch is
    a folder of its own in the latter two, so a batch that failed half-way can
    be removed and appended again.
    """

    def __init__(self, spark: SparkSession, path: str, k: int = K, t: float = SIMILARITY, bits: int = setjoin.SKETCH_BITS):
        self.spark, self.path, self.k, self.t, self.bits = spark, path.rstrip("/"), k, t, bits

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def _write(self, part: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{part}/batch={name}")

    def create(self, history: DataFrame, name: str = "0") -> PivotTable:
        """Make the table of the accepted history; its items aren't compared with each other."""
        rows = staged(_rows(history, self.k), "rows")
        sketch = setjoin.rarity(rows, self.bits)
        at = np.flatnonzero(sketch)
        order = self.spark.createDataFrame(pd.DataFrame({"bucket": at.astype("int32"), "n": sketch[at]}), "bucket int, n long")
        order.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/order")
        self._add(rows.select("item_id", "batch_no", "fp", "set_key"), setjoin.ordered(rows.drop("fp"), self.t, sketch), name)
        drop_stage(rows)
        return self

    def _add(self, accepted: DataFrame, sets: DataFrame, name: str) -> None:
        """Append the accepted items; sets has the distances of (at least) their window sets."""
        prints = accepted.filter("fp is not null").groupBy("fp").agg(F.min(_order()).alias("o")).select("fp", "o.*")
        self._write("prints", name, prints)
        own = sets.filter("set_key is not null").groupBy("set_key").agg(*[F.first(c).alias(c) for c in ("n", "near", "rest", "odd0", "odd1")], F.min(_order()).alias("o")).select("set_key", "n", "near", "rest", "odd0", "odd1", "o.*")
        self._write("sets", name, own)

    def append(self, batch: DataFrame, name: str) -> DataFrame:
        """(item_id, dup_item_id, batch_no): the rejected items of a batch, and the accepted items they repeat; the others are appended.

        The batch may hold several batch numbers; its items are taken by
        batch_no, then item_id, after all that the table holds. An item is
        rejected if an item accepted before it has the same valid fingerprint
        (64 hex digits, any case, outer spaces ignored) or a text of window
        similarity t or more; the first such item is reported. Texts that are
        null or have fewer than k words are similar to none, repeated
        deliveries of an item count once.
        """
        sketch = setjoin.as_sketch(self._read("order"), self.bits)
        rows = staged(setjoin.ordered(_rows(batch, self.k), self.t, sketch), "rows")
        nodes = rows.groupBy("item_id").agg(F.min(F.struct("batch_no", "fp", "set_key")).alias("r")).select("item_id", "r.*")
        old_sets, old_prints = self._read("sets").drop("batch"), self._read("prints").drop("batch")
        # Items that repeat an accepted one exactly need no further search.
        by_fp = old_prints.groupBy("fp").agg(F.min(_order()).alias("o_fp"))
        by_set = old_sets.groupBy("set_key").agg(F.min(_order()).alias("o_set"))
        nodes = staged(nodes.join(by_fp, "fp", "left").join(by_set, "set_key", "left").select("item_id", "batch_no", "fp", "set_key", F.least("o_fp", "o_set").alias("by")), "nodes")
        # Only sets of items that are still open are searched.
        still = nodes.filter("by is null and set_key is not null").groupBy("set_key").agg(F.min(_order()).alias("o"))
        arrays = rows.select("set_key", "n", "near", "rest", "odd0", "odd1").filter("set_key is not null").join(still, "set_key").groupBy("set_key").agg(*[F.first(c).alias(c) for c in ("n", "near", "rest", "odd0", "odd1", "o")])
        new = staged(arrays.select("set_key", "n", "near", "rest", "odd0", "odd1", "o.batch_no", "o.item_id"), "new")
        every = old_sets.withColumn("own", F.lit(False)).unionByName(new.withColumn("own", F.lit(True)))
        before = ~F.col("r.own") | (F.struct("r.batch_no", "r.item_id") < F.struct("l.batch_no", "l.item_id"))
        pairs = staged(setjoin.candidates(new, every, self.t, before), "pairs")
        some = every.join(pairs.select(F.col("key_r").alias("set_key")).distinct(), "set_key", "left_semi")
        near = staged(setjoin.verified(pairs, new, some, self.t), "near")
        seen = near.join(by_set.withColumnRenamed("set_key", "key_r"), "key_r").groupBy(F.col("key_l").alias("set_key")).agg(F.min("o_set").alias("o_near"))
        known = nodes.join(seen, "set_key", "left").select("item_id", "batch_no", "fp", "set_key", F.least("by", "o_near").alias("by"))
        known = staged(known, "known")
        hist = known.filter("by is not null")
        inner = self._within(known.filter("by is null").drop("by"), near)
        out = hist.select(F.col("by.item_id").alias("item_id"), F.col("item_id").alias("dup_item_id"), "batch_no").unionByName(inner)
        out = staged(out, "rejected")
        kept = known.join(out.select(F.col("dup_item_id").alias("item_id")), "item_id", "left_anti").select("item_id", "batch_no", "fp", "set_key")
        mine = kept.filter("set_key is not null").join(new.drop("batch_no", "item_id"), "set_key")
        self._add(kept, mine, name)
        for x in (rows, nodes, new, pairs, near, known):
            drop_stage(x)
        return out

    def _within(self, nodes: DataFrame, near: DataFrame) -> DataFrame:
        """The rejected among items that repeat nothing of the table, by their relations to each other."""
        several = lambda c: nodes.filter(f"{c} is not null").groupBy(c).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(c, F.lit(True).alias(f"by_{c}"))
        open_sets = nodes.select("set_key").distinct()
        links = near.join(open_sets.withColumnRenamed("set_key", "key_l"), "key_l", "left_semi").join(open_sets.withColumnRenamed("set_key", "key_r"), "key_r", "left_semi")
        links = staged(links.select("key_l", "key_r").union(links.select("key_r", "key_l")).distinct(), "links")
        linked = links.select(F.col("key_l").alias("set_key"), F.lit(True).alias("by_near")).distinct()
        x = nodes.join(several("fp"), "fp", "left").join(several("set_key"), "set_key", "left").join(linked, "set_key", "left").filter("by_fp or by_set_key or by_near")
        state = staged(x.select("item_id", _order().alias("ord"), "fp", "set_key", F.lit(None).cast("boolean").alias("kept")), "state")
        while state.filter("kept is null").limit(LAST + 1).count() > LAST:
            # Items that repeat one accepted in the round are rejected with it: what is open then waits for nothing but other open items.
            for accept in (True, False):
                after = staged(_settle(state, links, accept), "state")
                drop_stage(state)
                state = after
        last = _in_order(state.filter("kept is null").drop("kept"), links)
        state = state.filter("kept is not null").select("item_id", "ord", "fp", "set_key", "kept").unionByName(state.drop("kept").join(last, "item_id"))
        state = staged(state, "settled")
        good = state.filter("kept")
        by_fp = good.filter("fp is not null").groupBy("fp").agg(F.min("ord").alias("a"))
        by_set = good.filter("set_key is not null").groupBy("set_key").agg(F.min("ord").alias("b"))
        by_near = links.join(by_set.withColumnRenamed("set_key", "key_r"), "key_r").groupBy(F.col("key_l").alias("set_key")).agg(F.min("b").alias("c"))
        bad = state.filter("not kept").join(by_fp, "fp", "left").join(by_set, "set_key", "left").join(by_near, "set_key", "left")
        return bad.select(F.least("a", "b", "c")["item_id"].alias("item_id"), F.col("item_id").alias("dup_item_id"), F.col("ord.batch_no").alias("batch_no"))


def _settle(state: DataFrame, links: DataFrame, accept: bool = True) -> DataFrame:
    """One round: accept items that no open item precedes in their groups (unless accept is false), reject those that an accepted one precedes.

    Of each group of equal fingerprints or equal sets only the first item that
    isn't rejected matters, as no other one of it can be accepted.
    """
    alive = state.filter("kept is null or kept")
    head = F.min(F.struct("ord", F.coalesce("kept", F.lit(False)).alias("kept"))).alias("h")
    good, open_ = F.when(F.col("h.kept"), F.col("h.ord")), F.when(~F.col("h.kept"), F.col("h.ord"))
    by_fp = alive.filter("fp is not null").groupBy("fp").agg(head).select("fp", good.alias("g1"), open_.alias("o1"))
    by_set = alive.filter("set_key is not null").groupBy("set_key").agg(head)
    around = links.join(by_set.withColumnRenamed("set_key", "key_r"), "key_r").groupBy(F.col("key_l").alias("set_key")).agg(F.min(good).alias("g3"), F.min(open_).alias("o3"))
    x = state.join(by_fp, "fp", "left").join(by_set.select("set_key", good.alias("g2"), open_.alias("o2")), "set_key", "left").join(around, "set_key", "left")
    hit, waits = F.coalesce(F.least("g1", "g2", "g3") < F.col("ord"), F.lit(False)), F.coalesce(F.least("o1", "o2", "o3") < F.col("ord"), F.lit(False))
    return x.select("item_id", "ord", "fp", "set_key", F.when(F.col("kept").isNotNull(), F.col("kept")).when(hit, False).when(~waits & F.lit(accept), True).alias("kept"))


def _in_order(open_: DataFrame, links: DataFrame) -> DataFrame:
    """(item_id, kept) of at most LAST open items, taken one after another in one task."""
    few = links.join(open_.select(F.col("set_key").alias("key_l")).distinct(), "key_l", "left_semi").join(open_.select(F.col("set_key").alias("key_r")).distinct(), "key_r", "left_semi")
    around = few.groupBy(F.col("key_l").alias("set_key")).agg(F.collect_list("key_r").alias("around"))
    rows = open_.join(around, "set_key", "left").select("item_id", "ord.batch_no", "fp", "set_key", "around")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["batch_no", "item_id"])
        prints, sets, kept = set(), set(), []
        for fp, w, near in zip(pdf["fp"], pdf["set_key"], pdf["around"], strict=True):
            ok = (fp is None or fp not in prints) and (w is None or (w not in sets and (near is None or not any(x in sets for x in near))))
            kept.append(ok)
            if ok:
                prints.add(fp), sets.add(w)
        return pd.DataFrame({"item_id": pdf["item_id"], "kept": kept})

    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "item_id long, kept boolean")


def rejected_items(items: DataFrame, t: float = SIMILARITY, k: int = K) -> DataFrame:
    """PivotTable.append() of all items of batches 1 and up to a table of batch 0, the accepted history, in a folder that is removed after."""
    spark = items.sparkSession
    table = PivotTable(spark, f"{shared_dir(spark)}/lodestone/pivots-{uuid.uuid4().hex}", k, t)
    table.create(items.filter("batch_no <= 0"))
    out = table.append(items.filter("batch_no > 0 or batch_no is null"), "new")
    drop_path(spark, table.path)
    return out
