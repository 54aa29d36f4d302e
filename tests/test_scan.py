"""Scans for prompts of every length, on small tables with hand-made values."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

PROMPTS = [("p1", "Name  the RIVER"), ("p2", "one two three four five six seven eight nine"), ("p3", ""), ("p4", "lake"), ("p5", None), ("p6", "name the river")]
RECORDS = [(1, "a", "Please name the river here"), (2, "a", "x two three four five six seven eight nine y"), (3, "a", "name the riverbed"), (4, "b", ""), (5, "b", "Lake"), (6, "b", None), (7, "b", "one two three four five six seven"), (1, "a", "other row")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("scan"))
    spark.createDataFrame(PROMPTS, "id string, prompt string").write.parquet(f"{sf}/prompts.parquet")
    spark.createDataFrame(RECORDS, "record_id long, endpoint string, text string").write.parquet(f"{sf}/retrieved_source_records.parquet")
    return sf


def both(spark, sf, name):
    """Rows in Spark, which must be those of the other engine."""
    got = sorted(map(tuple, entry.queries()[name](spark, sf).collect()))
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t[:-8]} as select * from '{sf}/{t}/*.parquet'")
    assert got == sorted(c.execute(entry.oracle_sql()[name]).fetchall())
    return got


def test_commitment_scan(spark, tables):
    assert both(spark, tables, "g4_commitment_scan") == [(1, 1, 2), (2, 1, 1), (5, 1, 1)]


def test_commitment_summary(spark, tables):
    assert both(spark, tables, "g5_commitment_summary") == [("a", 3, 2), ("b", 3, 1)]


PROSE = "The kiln stood near the quiet river for years. Workers carried clay along the northern bank each morning, and the {} was opened again when spring arrived. Nobody had kept a ledger of the bricks that were sold. "


def test_commitment_report(spark, tmp_path):
    spark.createDataFrame([("p1", "opened again when"), ("p2", "a prompt that is found nowhere in the documents")], "id string, prompt string").write.parquet(f"{tmp_path}/prompts.parquet")
    docs = [(1, "s", "en", "T", PROSE.format("gate") * 3), (2, "s", "en", "T", PROSE.format("gate").replace("again", "up") * 3)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    old, new = ({r.source: r for r in entry.queries()[n](spark, str(tmp_path)).collect()}["s"] for n in ("flagship_corpus_report", "flagship_commitment_report"))
    assert new.n_docs == 2 and new.accepted == new.first_of_text == old.clean == 2 and new.clean == 1
