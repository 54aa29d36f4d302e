"""Operators of the core on small inputs with values worked out by hand."""

import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import similarity as sim
from lodestone.plans import catalogue
from lodestone.plans.dialect import Dialect, Duck
from lodestone.plans.text_queries import FAMILIES, MALFORMED, MISSING, any_of, cleaned, quality_reason


def value(spark, expr, text):
    df = spark.createDataFrame([(text,)], "text string")
    return df.selectExpr(f"{expr} as v").first()[0]


@pytest.mark.parametrize(("text", "reason"), [
    ("plain text", None), ("lost � sign", "replacement_character"), ("bell \x07", "control_character"),
    ("a\tb\nc", None), ("Ã© and Ã¨ twice", "implausible_non_ascii_corruption"), ("", None), ("naïve café", None)])
def test_quality_gate(spark, text, reason):
    assert value(spark, quality_reason(Dialect(), "text"), text) == reason
    assert duckdb.execute(f"select {quality_reason(Duck(), 'text')} from (select ? as text)", [text]).fetchone()[0] == reason


@pytest.mark.parametrize(("text", "want"), [
    ("a<!-- x --> b", "a b"), ("fact.<ref>book</ref> more", "fact. more"), ("'''bold''' word", "bold word"), ("cited [12] here", "cited here"),
    ("one\r\ntwo", "one\ntwo"), ("x\n\n\n\ny", "x\n\ny"), ("space , here", "space, here")])
def test_cleaned(spark, text, want):
    assert value(spark, cleaned(Dialect(), "text"), text) == want


@pytest.mark.parametrize(("text", "bank"), [
    ("known as ( , )", MISSING), ("the area of , and", MISSING), ("He said:", MISSING), ("( )", MISSING), ("one,, two", MALFORMED), ("born March5 there", MALFORMED), ("a; , b", MALFORMED)])
def test_pattern_banks(spark, text, bank):
    assert value(spark, any_of(Dialect(), "text", bank), text) is True


def test_pattern_banks_leave_prose(spark):
    for bank in (MISSING, MALFORMED, [p for *_, p in FAMILIES]):
        assert value(spark, any_of(Dialect(), "text", bank), "The kiln stood near the river. It burned in 1802.") is False


def brute_signature(text):
    w = re.findall(r"\w+", re.sub(r"\s+", " ", text).strip().casefold())
    if not w:
        return [(1 << 64) - 1] * 64
    sh = {"␟".join(w)} if len(w) < 5 else {"␟".join(w[i : i + 5]) for i in range(len(w) - 4)}
    o = sorted(sh)
    if len(o) > 256:
        o = [o[i * (len(o) - 1) // 255] for i in range(256)]
    h = sorted({zlib.crc32(x.encode()) << 32 | zlib.crc32(x.encode(), 0x9E3779B9) for x in o})[:64]
    seed = 0
    for v in h:
        seed ^= v
    while len(h) < 64:
        h.append((seed ^ ((len(h) + 1) * 0x9E3779B97F4A7C15)) & ((1 << 64) - 1))
    return h


def test_signatures(spark):
    texts = ["", "one", "one two three four", "Straße und Maß im Haus am See", " ".join(f"w{i}" for i in range(700)), "é́ " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sim.signature(F.col("t")).alias("s"), F.col("t"))
    for r in df.collect():
        assert [v % (1 << 64) for v in r.s] == brute_signature(r.t), r.t


def test_similar_pairs_and_greedy(spark):
    rows = [(1, list("abcdefghij")), (2, list("abcdefghij")), (3, list("abcdefghiX")), (4, list("abcdefghXY")), (5, []), (6, None), (None, ["a"]), (7, ["z"]), (1, list("abcdefghij"))]
    df = spark.createDataFrame(rows, "id long, s array<string>")
    got = {(r.a, r.b) for r in sim.similar_pairs(df, "id", "s", 0.8).collect()}
    sets = {i: set(s) for i, s in rows if i is not None and s}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    # a~b, b~c, not a~c: the chain keeps 1 and 3.
    nodes = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long")
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r.id for r in sim.greedy_kept(nodes, links).filter("kept").collect()} == {1, 3, 9}
    assert sim.similar_pairs(df.limit(0), "id", "s", 0.8).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 60), st.floats(0.05, 1.0))
def test_prefix_bound(n, t):
    assert 0 < sim.ceil_share(n, t) <= n


def test_registry_is_complete():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def test_core_stands_alone():
    import pathlib

    for p in pathlib.Path(catalogue.__file__).parent.parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
