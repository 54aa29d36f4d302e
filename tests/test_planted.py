"""Queries whose results are empty on the driver's tables, on small tables with planted rows, nulls, empty texts and repeats; both engines must agree."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans.dedup_queries import _shared_halves

LONG = " ".join(f"alpha{i} beta{i}" for i in range(40))
OTHER = " ".join(f"gamma{i} delta{i}" for i in range(40))
CHUNKS = [
    ("c1", "p1", "The town has a total area of , and it lies north. " + LONG), ("c2", "p1", "Its classes are shown.\n\nThe following are the types:\n\nIn May 1901 the work began."),
    ("c3", "p2", "known as ( , ) in the north, derived from, meaning stone"), ("c4", "p2", "He was born 149020 March 1568 and worked;, then left.. , Wood., and stone"), ("c5", "p2", "Ibid., and others"), ("c6", "p3", None), ("c7", "p3", ""),
    ("c8", "p3", "a distance of kilometres away, with x = , and y"), ("c9", "p4", "version abc12 of km2"), ("c9", "p4", "version abc12 of km2"), ("c10", "p4", LONG), ("c11", "p5", "Novel: A\nFilm: B\nSeries: C\nAlbum: D"), ("c12", None, "or or and ( ; x"),
    ("c13", "p5", LONG + " end one"), ("c14", "p5", LONG + " end one"), ("c15", "p6", "the quotation was this:\n\nThis is a famous passage of the town. " + OTHER)]
BASE = [("a", "d1", 0, "train", "AA", list(range(60)), [0] * 30 + [1] * 30), ("b", "d1", 1, " Test", "bb", list(range(20)), [0, 1, 2] + [0] * 16), ("b", "d1", 1, " Test", "bb", list(range(20)), [0, 1, 2] + [0] * 16), ("c", "d2", 0, None, None, None, None), ("d", "d2", 1, "validation", "aa", [], []), ("e", "d1", 0, "validation", "cc", list(range(70)), [1] * 70)]
PROMPTS = [("pr_0001", "alpha1 beta1 alpha2 beta2 alpha3 beta3 alpha4 beta4 alpha5 beta5"), ("pr_0002", "gamma1 delta1"), ("pr_0003", None), ("pr_0004", ""), ("pr_0005", "alpha1 beta1 alpha2 beta2 alpha3 beta3 alpha4 beta4 alpha5 beta5")]
EXAMPLES = [("e1", "reasoning", "train", "say alpha1 beta1 alpha2 beta2 alpha3 beta3 alpha4 beta4 alpha5 beta5 now", "", "yes"), ("e2", "advice", "test", "one alpha1 beta1 alpha2 beta2 alpha3 beta3 alpha4 beta4 end", None, "no"), ("e3", "advice", "train", None, None, None), ("e4", None, None, "", "", ""), ("e1", "reasoning", "train", "say alpha1 beta1 alpha2 beta2 alpha3 beta3 alpha4 beta4 alpha5 beta5 now", "", "yes"), ("e5", "advice", "Train", "same words", "", "a"), ("e6", "reasoning", "train", "Same  WORDS", "", "b")]
DOCS = [(20, LONG, "s"), (21, LONG + " more", "s"), (22, OTHER, "t"), (23, "", "t"), (24, None, None), (40, OTHER + " and", "t"), (41, LONG.upper(), "s"), (42, "x " * 5000, "u")]
ITEMS = [(20, "AB" * 32, "original", "S1", LONG), (40, "ab" * 32, "extension", "s1", OTHER + " tail"), (41, None, "extension", None, LONG), (60, "zz", "extension", "s2", ""), (60, "zz", "extension", "s2", ""), (80, None, None, None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("planted"))

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/{name}.parquet")

    save("text_chunks", [(c, p, i, "s", t, len(t or ""), "T", "paragraph", "section", 0) for i, (c, p, t) in enumerate(CHUNKS)], "chunk_id string, parent_document_id string, chunk_index int, source_id string, text string, token_count int, section_title string, boundary_start_type string, boundary_end_type string, overlap_characters int")
    save("base_text_chunks", [(c, "s", "r", d, "h", "t", i, s, h, t, m) for c, d, i, s, h, t, m in BASE], "chunk_id string, source_id string, source_revision string, document_id string, document_sha256 string, transformation_id string, chunk_index int, split string, text_sha256 string, token_ids array<int>, stored_mask array<tinyint>")
    save("prompts", [(i, p, None, None, None) for i, p in PROMPTS], "id string, prompt string, category string, expected_behavior string, checks struct<non_empty:boolean,max_repetition_ratio:double,required_keywords:array<string>>")
    save("instruction_examples", [("v", i, s, c, a, b, r, "k", None, "en", "easy", "x", None, None, None, None) for i, c, s, a, b, r in EXAMPLES], "schema_version string, example_id string, split string, capability string, instruction string, input string, response string, source_type string, source_reference string, language string, difficulty string, answer_style string, format_constraints struct<type:string,count:int,strict:boolean>, facts array<struct<claim:string,verification_status:string,time_sensitive:boolean>>, quality struct<author_status:string,review_status:string,reviewer_id:string>, metadata struct<created_at:string,created_by:string,license:string,provenance:string>")
    save("documents", [(i, t, "en", s, len(t or ""), "T") for i, t, s in DOCS], "doc_id bigint, text string, lang string, source string, n_chars bigint, title string")
    save("fingerprints", [(i, f, o, s, 1, t) for i, f, o, s, t in ITEMS], "item_id bigint, fingerprint string, origin string, source_id string, batch_no int, item_text string")
    save("retrieved_source_records", [(i, t) for i, t, _ in DOCS], "record_id bigint, text string")
    return sf


def both(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    canon = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t[:-8]} as select * from '{sf}/{t}/*.parquet'")
    cur = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(canon(r[names.index(x)]) for x in cols) for r in cur.fetchall())
    return [dict(zip(cols, r)) for r in got]


@pytest.mark.parametrize(("name", "key", "want"), [
    ("d4_missing_values", "chunk_id", {"c1", "c2", "c3", "c4", "c5", "c8", "c12", "c15"}), ("d5_malformed_source", "chunk_id", {"c4"}), ("d8_promised_material", "chunk_id", {"c2", "c15"}), ("d9_catalogue_dominance", "chunk_id", {"c11"}),
    ("d7_defect_families", "family", {"empty_pronunciation_or_alternate_name", "missing_etymological_source_term", "missing_measurement_unit_or_quantity", "malformed_or_joined_lifespan_date", "missing_formula_or_mathematical_operand", "heading_or_commentary_after_omitted_material", "repeated_punctuation_from_removed_markup", "possible_joined_alphanumeric_formatting", "publication_adaptation_or_catalogue_dominated"}),
    ("d10_quality_audit", None, None), ("a17_slice_isolation", "document_id", {"d1"}), ("j10_record_invariants", "chunk_id", {"b"}), ("f21_duplicate_previews", "chunk_id", {"c13", "c14"}), ("f10_exact_lookup", "chunk_id", {"c10", "c7"}), ("f12_federated_lookup", "item_id", {"20", "41", "60"}), ("f12_candidate_union", "item_id", {"20", "40"}),
    ("f11_bucket_candidates", "a", {"20", "40"}), ("f8_signature_similarity", "a", {"20", "40"}), ("f13_match_decisions", None, None), ("f17_cross_set_duplicates", None, None), ("g6_example_contamination", "example_id", {"e1", "e2"}), ("g2_prompt_substrings", None, None), ("g5_merged_scan", None, None),
    ("k1_record_validation", None, None), ("k4_quality_score", None, None), ("d11_review_prechecks", None, None), ("e11_length_audit", None, None), ("j7_complete_records", None, None), ("f6_signatures", None, None), ("g12_commitment_check", None, None), ("f5_ingest_counters", None, None), ("f3_jaccard_pairs", None, None)])
def test_planted(spark, tables, name, key, want):
    rows = both(spark, tables, name)
    assert rows and (key is None or {r[key] for r in rows} == want)


def test_exact_and_fragments(spark, tables):
    got = {(r["example_id"], r["prompt_id"], r["exact"]) for r in both(spark, tables, "g6_example_contamination")}
    assert ("e1", "pr_0001", "True") in got and ("e2", "pr_0001", "False") in got


def test_common_shingle_makes_no_pairs(spark, tmp_path):
    """f12_candidate_union: a run of words that all texts have pairs none of them; halves, repeats of a key, short and null texts count as in SQL."""
    common, tail = "students often ask why a", lambda i, n=8: " ".join(f"w{i}x{j}" for j in range(n))
    docs = [(i, f"{common} {tail(i)}") for i in range(60)] + [(60, "two words"), (61, None), (62, ""), (63, tail(900, 9)), (63, tail(900, 20)), (64, "Straße ΟΔΟΣ one two three")]
    items = [(20 * i, f"{common} {tail(i + 40)}") for i in range(40)] + [(800, "Two\u00a0words"), (820, None), (840, ""), (860, tail(900, 12)), (860, tail(900, 6)), (880, "strasse οδος ONE two three"), (901, common), (920, tail(900, 10) + " " + tail(7, 6)), (0, f"{common} {tail(40)}")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i + 5, t) for i, t in docs] * 2, "record_id bigint, text string").write.parquet(f"{tmp_path}/retrieved_source_records.parquet")
    spark.createDataFrame(items, "item_id bigint, item_text string").write.parquet(f"{tmp_path}/fingerprints.parquet")
    rows = both(spark, str(tmp_path), "f12_candidate_union")
    assert {int(r["item_id"]) for r in rows} >= {0, 380, 800, 860, 880}
    pairs = _shared_halves(spark, str(tmp_path))[0]
    assert pairs.count() <= 60
