"""Mixing sources to target weights (problem 8).

Each source of a mixture is to give its share of the mixture's tokens. The
mixture is as large as asked, at most as the scarcest source allows at its most repeats. A
source that must give r times its tokens takes each document floor(r) times,
and once more with probability r - floor(r); which ones is decided by the cube
method: the probabilities are moved along vectors that leave the expected
tokens and documents unchanged until each is 0 or 1. Blocks of bounded size
are balanced in parallel; the few probabilities that a block leaves open are
balanced again in blocks of these, and so on, until one small landing problem
for each source is left, where the token total is kept as near as possible.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import rows_within, staged
from .tokens import VOCABULARY, counted, once

#: Units of one block of the flight, and units that the last flight leaves to the landing.
BLOCK = 4000
LANDING = 12
_EPS = 1e-9


def _null_vector(a: list[tuple[float, float]]) -> list[float]:
    """A vector u of three numbers, not all 0, with the sums of u and of u times the tokens both 0."""
    (t0, c0), (t1, c1), (t2, c2) = a
    u = [t1 * c2 - t2 * c1, t2 * c0 - t0 * c2, t0 * c1 - t1 * c0]
    if max(map(abs, u)) < _EPS:  # equal rows: two of the units trade places
        u = [1.0, -1.0, 0.0]
    return u


def flight(tokens: list[float], p: list[float], rng: random.Random, leave: int = 2) -> list[float]:
    """Probabilities after the flight phase: all but at most ``leave`` (2 or more) are 0 or 1.

    The sum of the probabilities and the sum of tokens times probability stay
    as they were (tokens and document totals are the balancing constraints).
    """
    p = list(p)
    open_: list[int] = []
    todo = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    for i in range(len(p)):
        if p[i] <= _EPS:
            p[i] = 0.0
        elif p[i] >= 1 - _EPS:
            p[i] = 1.0
    at = 0
    while True:
        while len(open_) < 3 and at < len(todo):
            open_.append(todo[at])
            at += 1
        if len(open_) + len(todo) - at <= max(2, leave):
            return p
        u = _null_vector([(tokens[i], 1.0) for i in open_])
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(open_, u, strict=True) if abs(x) > 0)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(open_, u, strict=True) if abs(x) > 0)
        step = up if rng.random() * (up + down) < down else -down
        still = []
        for i, x in zip(open_, u, strict=True):
            p[i] += step * x
            if p[i] <= _EPS:
                p[i] = 0.0
            elif p[i] >= 1 - _EPS:
                p[i] = 1.0
            else:
                still.append(i)
        if len(still) == 3:  # rounding: settle the one nearest to an end
            i = min(still, key=lambda j: min(p[j], 1 - p[j]))
            p[i] = float(round(p[i]))
            still.remove(i)
        open_ = still


def landing(tokens: list[float], p: list[float]) -> list[float]:
    """The open probabilities (at most LANDING) settled so that the token total is as near as possible."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    if not open_:
        return list(p)
    aim = sum(tokens[i] * p[i] for i in open_)
    sums = np.zeros(1)  # of all subsets, in the order of their bit masks
    for i in open_:
        sums = np.concatenate([sums, sums + tokens[i]])
    best = int(np.argmin(np.abs(sums - aim)))
    out = list(p)
    for k, i in enumerate(open_):
        out[i] = float(best >> k & 1)
    return out


def targets(documents: DataFrame, mixtures: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mixture_id, source_id, weight_share, target_share, max_repeats, own_tokens, own_docs, ratio): a row for each listed source.

    weight_share is the weight relative to the mixture's sum; target_share the
    same among the sources that have documents. ratio is how often the source's
    tokens are to be taken; null for a source without tokens, 0 for one whose
    weight or max_repeats is null or not positive. A source that a mixture
    lists twice counts with the sum of the weights and the smaller max_repeats.
    total_tokens is the size asked of each mixture; if its scarcest source
    can't give its share of that, or if it is None, the mixture is as large as that source allows.
    """
    own = documents.filter("n_tokens > 0").groupBy(F.col("source").alias("source_id")).agg(F.sum("n_tokens").alias("own_tokens"), F.count(F.lit(1)).alias("own_docs"))
    m = mixtures.filter("mixture_id is not null and source_id is not null").groupBy("mixture_id", "source_id").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    m = m.join(own, "source_id", "left")
    usable = F.col("own_tokens").isNotNull() & (F.col("weight") > 0) & (F.col("max_repeats") > 0)
    sums = m.groupBy("mixture_id").agg(F.sum("weight").alias("w_all"), F.sum(F.when(usable, F.col("weight"))).alias("w_own"))
    m = m.join(sums, "mixture_id").withColumn("usable", usable)
    m = m.withColumn("target_share", F.when(F.col("usable"), F.col("weight") / F.col("w_own")))
    size = m.groupBy("mixture_id").agg(F.min(F.when(F.col("usable"), F.col("max_repeats") * F.col("own_tokens") / F.col("target_share"))).alias("size"))
    m = m.join(size, "mixture_id")
    if total_tokens is not None:
        m = m.withColumn("size", F.least("size", F.lit(float(total_tokens))))
    ratio = F.when(F.col("usable"), F.least(F.col("target_share") * F.col("size") / F.col("own_tokens"), F.col("max_repeats").cast("double"))).otherwise(F.when(F.col("own_tokens").isNotNull(), F.lit(0.0)))
    share = F.when(F.col("w_all") > 0, F.col("weight") / F.col("w_all")).otherwise(F.lit(0.0))
    return m.select("mixture_id", "source_id", share.alias("weight_share"), "target_share", "max_repeats", "own_tokens", "own_docs", ratio.alias("ratio"))


def _level(open_: DataFrame, last: bool, seed: int) -> DataFrame:
    """One level of flight over the blocks of open units; the last level lands."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        first = pdf.iloc[0]
        rng = random.Random(f"{seed}:{first['mixture_id']}:{first['source']}:{first['block']}")
        order = list(range(len(pdf)))
        rng.shuffle(order)
        tokens, p = pdf["n_tokens"].astype(float).tolist(), pdf["p"].tolist()
        got = flight([tokens[i] for i in order], [p[i] for i in order], rng, LANDING)
        if last:
            got = landing([tokens[i] for i in order], got)
        back = [0.0] * len(order)
        for i, x in zip(order, got, strict=True):
            back[i] = x
        pdf["p"] = back
        return pdf

    return open_.groupBy("mixture_id", "source", "block").applyInPandas(run, open_.schema)


def mixed(documents: DataFrame, mixtures: DataFrame, vocabulary: str = VOCABULARY, seed: int = 0, block: int = BLOCK, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (mixture_id, source_id, doc_id, repeats, n_tokens), and targets().

    Documents without id, source or tokens can't be chosen; repeated ids count
    once. repeats is at least 1 and at most the source's max_repeats.
    total_tokens: see targets().
    """
    base = documents.select("doc_id", "source", "text").filter("doc_id is not null and source is not null and text is not null")
    docs = staged(once(counted(base, "text", vocabulary), "doc_id").filter("n_tokens > 0"), "tokens")
    goals = staged(targets(docs, mixtures, total_tokens), "targets")
    few = goals.filter("ratio > 0").select("mixture_id", F.col("source_id").alias("source"), "max_repeats", "ratio")
    if rows_within(few, 100_000):
        few = F.broadcast(few)
    whole = F.least(F.floor("ratio"), F.col("max_repeats")).cast("int")
    x = docs.join(few, "source").withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
    x = x.withColumn("p", F.when(F.col("whole") >= F.col("max_repeats"), 0.0).otherwise(F.col("p")))
    blocks = max(1, -(-docs.count() // block))
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 8)
    x = x.select("mixture_id", "source", "doc_id", "n_tokens", "whole", "p", F.pmod(spot, F.lit(blocks)).alias("block"))
    done = None
    while True:
        last = blocks <= 1
        x = staged(_level(x, last, seed), "flight")
        settled = x.filter("p <= 0 or p >= 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        # Each block leaves at most LANDING units: so many blocks make one of the next level.
        blocks = -(-blocks // max(2, block // LANDING))
        x = x.filter("p > 0 and p < 1").withColumn("block", F.pmod(F.col("block"), F.lit(blocks)))
    repeats = (F.col("whole") + F.col("p").cast("int")).alias("repeats")
    return done.select("mixture_id", F.col("source").alias("source_id"), "doc_id", repeats, "n_tokens").filter("repeats > 0"), goals


def shares(chosen: DataFrame, goals: DataFrame) -> DataFrame:
    """(mixture_id, source_id, weight_share, target_share, max_repeats, docs, doc_uses, tokens, actual_share): a row for each listed source."""
    got = chosen.groupBy("mixture_id", "source_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("repeats").alias("doc_uses"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"))
    x = goals.join(got, ["mixture_id", "source_id"], "left").fillna(0, ["docs", "doc_uses", "tokens"])
    total = x.groupBy("mixture_id").agg(F.sum("tokens").alias("all_tokens"))
    x = x.join(total, "mixture_id")
    share = F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(F.lit(0.0))
    return x.select("mixture_id", "source_id", "weight_share", "target_share", "max_repeats", "docs", "doc_uses", "tokens", share.alias("actual_share"))
