"""Each query with an SQL counterpart gives the same rows in both engines, on a sample of each group at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ("c3_quality_gate", "c9_document_filter", "d2_list_metrics", "e11_length_audit", "f3_jaccard_pairs", "f4_greedy_dedup", "g2_prompt_substrings", "g4_span_scan", "h3_held_out_quotas", "i1_largest_remainder", "i5_schedule", "j16_supervised_spans", "k10_repetition_metrics", "l5_grouping_sets", "m1_mixture_checks")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canon(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
