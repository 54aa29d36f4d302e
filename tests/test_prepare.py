"""Markup, chunks, records, files and intervals, on inputs with values worked out by hand."""

import gzip
import json
import random
import sqlite3
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import chunker, markup, statistics
from lodestone.operators import records
from lodestone.operators import similarity as sim
from lodestone.sources import files


@pytest.mark.parametrize(("template", "want"), [
    ("{{chem|H|2|O}}", "H2O"), ("{{math|x + y}}", "x + y"), ("{{sfrac|3|4}}", "3/4"), ("{{convert|12|km|mi}}", "12 km"), ("{{lang|fr|bonjour}}", "bonjour"), ("{{lang-de|Haus}}", "Haus"), ("{{transl|ar|kitab}}", "kitab"),
    ("{{quote|text=Well said}}", "Well said"), ("{{ubl|one|two}}", "one\ntwo"), ("{{nowrap|a b}}", "a b"), ("{{Cite book|title=Rivers|year=1901}}", "Rivers"), ("{{citation needed}}", None), ("{{Infobox|x=1}}", None), ("{{math}}", None)])
def test_templates(template, want):
    assert markup.render_template(template) == want


def test_nested_templates():
    assert markup.replace_templates("a {{nowrap|{{chem|C|O}}}} b {{x|{{y}}}}") == ("a  CO  b  ", 2, 2)


@pytest.mark.parametrize(("text", "want"), [("cafÃ© and cafÃ©", "café and café"), ("plain", "plain"), ("itâ€™s", "it’s")])
def test_repair(text, want):
    assert markup.repair(text)[0] == want


def test_repair_refuses():
    assert markup.repair("lost �")[3] == "replacement_character"
    assert markup.repair("Ã¢ only, ж")[2:] == (["suspicious_mojibake_markers"], "low_confidence_encoding_corruption")


def test_clean():
    text, n, warnings, reason = markup.clean("'''Kiln'''<!-- x --> of clay<ref>book</ref> , made [12] by {{nowrap|old hands}}.\r\n\r\n\r\nNext  line\n")
    assert text == "Kiln of clay, made by old hands.\n\nNext line" and reason is None and warnings == []
    assert (n["comments"], n["references"], n["citations"], n["templates_preserved"]) == (1, 1, 1, 1)
    assert markup.clean(None)[0] == markup.clean("")[0] == ""


count = lambda t: len(t.split())
LIMITS = chunker.Limits(target=12, most=16, least=5, overlap=4)


def test_chunks_by_section():
    text = "History\n\n" + "The kiln was built. It stood for years here.\n\n" * 3 + "Uses\n\nShort end.\n\nReferences\n\nA book of rivers, 1901."
    got, dropped, ended = chunker.chunks(text, count, LIMITS, "exclude")
    assert [c.section for c in got] == ["History"] * 3 and (dropped, ended) == (1, 1)
    assert all(c.tokens == count(c.text) <= 16 for c in got)


def test_overlap_begins_at_a_sentence():
    text = "One two three four five. Six seven eight.\n\nNine ten eleven twelve thirteen. Red blue.\n\nGrey green black white brown pink. End now."
    got, _, _ = chunker.chunks(text, count, chunker.Limits(10, 14, 5, 4))
    assert got[1].text.startswith("Red blue.") or got[1].text.startswith("Six seven eight.")
    assert got[1].overlap > 0 and got[1].start == "sentence"


@pytest.mark.parametrize(("text", "kinds"), [("a b c d e f g h", ["word_fallback", "paragraph"]), ("a" * 3, ["paragraph"])])
def test_long_sentences(text, kinds):
    assert [z for _, _, z in chunker.words_within(text, count, 5, "paragraph", "paragraph")] == kinds


def test_token_fallback():
    chars = len
    assert list(chunker.words_within("abcdef", chars, 4, "sentence", "sentence")) == [("abcd", "sentence", "token_fallback"), ("ef", "word_fallback", "sentence")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["One two. ", "word ", "Three four five six? ", "\n\n", "Title\n\n", "x" * 9 + " "]), max_size=60))
def test_chunks_stay_within_limits(parts):
    got, dropped, _ = chunker.chunks("".join(parts), count, LIMITS)
    assert all(c.tokens <= LIMITS.most and c.tokens >= LIMITS.least and c.text.strip() == c.text for c in got)


def test_next_fit(spark):
    rows = [("s", "0", f"{i:02d}", f"e{i}", p, n) for i, (p, n) in enumerate([(2, 6), (1, 4), (2, 5), (3, 14), (11, 12), (1, 2), (1, 10)])]
    df = spark.createDataFrame(rows, "split string, block string, hk string, id string, prompt long, n long")
    got = {r.id: (r.record, r.start, r.kept, r.state) for r in records.next_fit(df, ["split"], 10).collect()}
    assert got == {"e0": (0, 0, 6, "complete"), "e1": (0, 6, 4, "complete"), "e2": (1, 0, 5, "complete"), "e3": (2, 0, 10, "truncated"), "e4": (-1, 0, 0, "dropped"), "e5": (3, 0, 2, "complete"), "e6": (4, 0, 10, "complete")}
    assert {r.id for r in records.next_fit(df, ["split"], 10, keep_over=False).filter("state = 'over_width'").collect()} == {"e3", "e4"}


def test_in_order(spark):
    ids = random.Random(1).sample(range(10**6), 500)
    df = spark.createDataFrame([(i, i % 3) for i in ids], "id long, r0 int")
    assert [r.id for r in records.in_order(df, "id").orderBy("r").collect()] == sorted(ids)
    assert records.in_order(df.limit(0), "id").count() == 0


def test_long_shingles(spark):
    """Shingles beyond the looked-up lengths have both checksums."""
    text = " ".join("abc"[i] * 3000 for i in range(3))
    sig = spark.createDataFrame([(text,)], "t string").select(sim.signature(F.col("t")).alias("s")).first().s
    b = "␟".join(text.split()).encode()
    v = zlib.crc32(b) << 32 | zlib.crc32(b, 0x9E3779B9)
    assert len(b) > sim.LONGEST and sig[0] % (1 << 64) == v


def test_lines_and_json(spark, tmp_path):
    rows = ['{"a": 1}', "", "broken", '{"a": 2}', "[1]"]
    with open(tmp_path / "x.jsonl", "w") as f:
        f.write("\n".join(rows))
    with open(tmp_path / "y.jsonl.gz", "wb") as f:
        f.write(gzip.compress(b'{"a": 3}\n') + gzip.compress(b'{"a": 4}\n'))
    got = sorted((r.file.rsplit("/", 1)[1][:1], r.line, r.record and r.record.a) for r in files.read_jsonl(spark, str(tmp_path), "a int").collect())
    assert got == [("x", 1, 1), ("x", 3, None), ("x", 4, 2), ("x", 5, None), ("y", 1, 3), ("y", 2, 4)]
    assert files.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int", start_line=4).count() == 2
    with pytest.raises(Exception, match="line 3"):
        files.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int", strict=True).collect()


def test_hash_list(spark, tmp_path):
    h = ["ab" * 32, "CD" * 32, "ef" * 32]
    (tmp_path / "a.txt").write_text(h[0] + "\nno hash\n")
    (tmp_path / "b.jsonl").write_text(json.dumps({"sha256": h[1]}) + "\n{}\n")
    c = sqlite3.connect(tmp_path / "c.sqlite")
    c.execute("create table t (n integer, fp text)")
    c.execute("insert into t values (1, ?)", (h[2],))
    c.commit(), c.close()
    got = {r.sha256 for r in files.hash_list(spark, [f"{tmp_path}/a.txt"], [f"{tmp_path}/b.jsonl"], [f"{tmp_path}/c.sqlite"]).collect()}
    assert got == {x.lower() for x in h}


def test_token_files(spark, tmp_path):
    df = spark.createDataFrame([([1, 2, 65535],), ([],), ([7],)], "t array<int>").coalesce(1)
    made = files.write_tokens(df, "t", f"{tmp_path}/bin").collect()
    assert sum(r.n for r in made) == 4
    assert [t for r in files.read_tokens(spark, f"{tmp_path}/bin", step=3).orderBy("at").collect() for t in r.tokens] == [1, 2, 65535, 7]
    with pytest.raises(Exception, match="does not fit"):
        files.write_tokens(spark.createDataFrame([([65536],)], "t array<int>"), "t", f"{tmp_path}/bad").collect()


def test_identities(tmp_path):
    body = {"b": "é", "a": 1}
    assert files.canonical_json(body) == '{"a":1,"b":"é"}'
    assert files.self_hash({**body, "h": "x"}, "h") == files.self_hash(body, "h")
    files.write_json(f"{tmp_path}/d/r.json", body)
    files.write_json(f"{tmp_path}/d/r.json", {"a": 2})
    assert (tmp_path / "d" / "r.json").read_text() == '{"a":2}\n' and len(list((tmp_path / "d").iterdir())) == 1


def test_interval_rules():
    d = list(range(1000))
    assert statistics.ends_by_count(d) == (25, 975) and statistics.ends_by_last(d) == (24, 974) and statistics.ends_paired(d) == (25, 974)
    mean, low, high = statistics.mean_interval([1.0] * 5 + [0.0] * 5, samples=400)
    assert mean == 0.5 and 0 <= low < 0.5 < high <= 1
    assert statistics.mean_interval([2.0], samples=100) == (2.0, 2.0, 2.0)
