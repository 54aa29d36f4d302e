"""Queries on readers, writers, identities and releases. Those that write use a folder of their own in the shared folder and read back what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import in_order
from ..session import shared_dir
from ..sources import files
from .dialect import relational, spark_sql, words
from .record_queries import packed
from .registry import query
from .select_queries import CH, rank_key


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


# What the operators need of each table.
REQUIRED = {"documents": ("doc_id", "text", "source", "title", "lang"), "fingerprints": ("item_id", "fingerprint", "batch_no", "item_text"), "prompts": ("id", "prompt", "category"), "text_chunks": ("chunk_id", "text", "section_title")}
_PAIRS = ", ".join(f"('{t}', '{c}')" for t, cs in REQUIRED.items() for c in cs)


@query("a1_schema_check", f"select r.t as table_name, r.c as column_name, i.column_name is not null as present from (values {_PAIRS}) r(t, c) left join information_schema.columns i on i.table_name = r.t and i.column_name = r.c")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each table has the columns that are required of it."""
    return spark.createDataFrame([(t, c, c in set(_table(spark, sf, t).columns)) for t, cs in REQUIRED.items() for c in cs], "table_name string, column_name string, present boolean")


@query("a2_row_scan", "select doc_id, source from (select doc_id, source, row_number() over (order by doc_id) - 1 as r from documents) x where r >= 100")
def a2(spark: SparkSession, sf: str, start_row: int = 100) -> DataFrame:
    """Two columns of the documents from a row on, in the order of ids."""
    return in_order(_table(spark, sf, "documents").select("doc_id", "source"), "doc_id").filter(F.col("r") >= start_row).select("doc_id", "source")


_JSONL = "select doc_id, cast(length(text) as bigint) as n_chars from documents where text is not null"


@query("a4_jsonl_scan", _JSONL)
def a4(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as gzip JSON lines and read back leniently."""
    at = _folder(spark, "jsonl")
    files.write_run(_table(spark, sf, "documents").filter("text is not null").select("doc_id", "text"), at, "1")
    x = files.read_jsonl(spark, f"{at}/run=1", "doc_id bigint, text string")
    return x.select("record.doc_id", F.length("record.text").cast("long").alias("n_chars"))


@query("a5_jsonl_strict", _JSONL)
def a5(spark: SparkSession, sf: str) -> DataFrame:
    """The same read strictly: a malformed line would be an error."""
    at = _folder(spark, "jsonl")
    files.write_run(_table(spark, sf, "documents").filter("text is not null").select("doc_id", "text"), at, "1")
    x = files.read_jsonl(spark, f"{at}/run=1", "doc_id bigint, text string", strict=True)
    return x.select("record.doc_id", F.length("record.text").cast("long").alias("n_chars"))


@query("a6_gzip_members", "select count(*) as lines, cast(sum(doc_id) as bigint) as id_sum from documents")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    """Ids written as gzip files of several members and read as text lines."""
    at = _folder(spark, "gzip")
    files.write_gzip_members(_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("v")), "v", at).write.format("noop").mode("overwrite").save()
    return files.lines(spark, at).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("value").cast("long")).alias("id_sum"))


@query("a7_index_files", "select distinct lower(h) as sha256 from (select fingerprint as h from fingerprints union all select text_sha256 from base_text_chunks union all select source_sha256 from source_progress) x where regexp_matches(h, '^[0-9a-fA-F]{64}$')")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    """Valid hashes of a text list, JSON lines and an SQLite file, as one list."""
    import sqlite3

    at = _folder(spark, "hashes")
    _table(spark, sf, "fingerprints").select(F.coalesce("fingerprint", F.lit("")).alias("value")).write.text(f"{at}/text")
    _table(spark, sf, "base_text_chunks").select(F.col("text_sha256").alias("sha256")).write.json(f"{at}/json")
    few = [(r[0],) for r in _table(spark, sf, "source_progress").select("source_sha256").collect()]  # a table of fixed size
    c = sqlite3.connect(":memory:")
    c.execute("create table progress (line integer, source_sha256 text)")
    c.executemany("insert into progress values (1, ?)", few)
    c.commit()
    files.write_bytes(f"{at}/index.sqlite", c.serialize())
    c.close()
    return files.hash_list(spark, [f"{at}/text"], [f"{at}/json"], [f"{at}/index.sqlite"])


@relational("a16_eligible_documents")
def a16(d):
    """Documents of 128 words or more, and of each parent its chunk of 128 tokens or more with the lowest hash."""
    return f"""select 'document' as kind, cast(doc_id as varchar(30)) as id from @documents where {d.size(words(d, "coalesce(text, '')"))} >= 128
      union all select 'chunk', chunk_id from (select chunk_id, row_number() over (partition by document_id order by {rank_key(d, 'chunk_id')}, chunk_id) as r from {CH} x where {d.size('token_ids')} >= 128) y where r = 1"""


@relational("a17_slice_isolation")
def a17(d):
    """Token ranges of a document's chunks that overlap although they are of different splits; ranges meet by blocks of 64."""
    n = d.size("token_ids")
    return f"""with x as (select distinct document_id, split, chunk_index * 48 as lo, chunk_index * 48 + {n} as hi from {CH} c where token_ids is not null and split is not null and {n} > 0),
      b as (select document_id, split, lo, hi, {d.explode(d.seq(d.int('floor(lo / 64.0)'), d.int('floor((hi - 1) / 64.0)')))} as blk from x)
      select distinct p.document_id, p.split as left_split, q.split as right_split, cast(p.lo as bigint) as left_lo, cast(q.lo as bigint) as right_lo, cast(least(p.hi, q.hi) - greatest(p.lo, q.lo) as bigint) as overlap
      from b p join b q on p.document_id = q.document_id and p.blk = q.blk where p.split < q.split and greatest(p.lo, q.lo) < least(p.hi, q.hi)"""


@relational("b5_canonical_hash")
def b5(d):
    """Hash of each document's canonical JSON: sorted keys, no spaces, values escaped."""
    j = "to_json(named_struct('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars, 'source', source, 'title', title), map('ignoreNullFields', 'false'))" if d.spark else "cast(json_object('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars, 'source', source, 'title', title) as varchar)"
    return f"select doc_id, {d.sha(j)} as sha256 from @documents"


@query("b1_json_files", "select source, count(*) as n from documents group by source")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the documents written whole or not at all, and read back."""
    at = _folder(spark, "report")
    rows = _table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each source
    files.write_json(f"{at}/report.json", [r.asDict() for r in rows])
    return spark.read.schema("source string, n bigint").json(f"{at}/report.json")


@query("b2_repeated_run", "select doc_id, source from documents")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    """A run that is written twice leaves its rows once."""
    at, x = _folder(spark, "runs"), _table(spark, sf, "documents").select("doc_id", "source")
    files.write_run(x.filter("doc_id % 2 = 0"), at, "1")
    files.write_run(x.filter("doc_id % 2 = 1"), at, "2")
    files.write_run(x.filter("doc_id % 2 = 1"), at, "2")
    return spark.read.schema("doc_id bigint, source string").json(at).select("doc_id", "source")


@query("b3_token_files", "select count(*) as tokens, cast(sum(t) as bigint) as id_sum, max(t) as highest from (select unnest(token_ids) as t from base_text_chunks where token_ids is not null) x")
def b3(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids written as flat binary files and read back."""
    at = _folder(spark, "tokens")
    files.write_tokens(_table(spark, sf, "base_text_chunks").filter("token_ids is not null"), "token_ids", at, "<u4").write.format("noop").mode("overwrite").save()
    return files.read_tokens(spark, at, "<u4").select(F.explode("tokens").alias("t")).agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.col("t").cast("long")).alias("id_sum"), F.max("t").alias("highest"))


@query("b4_same_bytes", "select cast(1 as bigint) as passes_equal")
def b4(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two writes of the same rows give the same compressed bytes."""
    x = _table(spark, sf, "documents").repartition(4, "doc_id").sortWithinPartitions("doc_id").select(F.concat_ws(",", "doc_id", "source").alias("v"))
    a, b = (files.write_gzip_members(x, "v", _folder(spark, "gzip")).select("part", "sha256").distinct() for _ in range(2))
    j = a.join(b.withColumnRenamed("sha256", "other"), "part", "full")
    return j.agg(F.when(F.count_if(~F.col("sha256").eqNullSafe(F.col("other"))) == 0, 1).otherwise(0).cast("long").alias("passes_equal"))


@query("b6_file_hashes")
def b6(spark: SparkSession, sf: str) -> DataFrame:
    """Size and hash of each file of the tables."""
    return files.file_hashes(spark, sf).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))


@relational("b7_self_hashes")
def b7(d):
    """Records' own hash: that of their canonical body without the hash field, recomputed from the parts and from the whole."""
    body = lambda extra: f"'{{' || {extra} || '\"record_id\":' || cast(record_id as varchar(20)) || ',\"revision\":\"' || coalesce(revision, '') || '\"}}'"
    own = d.sha(body("''"))
    kept = body(f"'\"record_sha256\":\"' || {own} || '\",'")
    return f"with x as (select distinct record_id, revision from @retrieved_source_records), y as (select record_id, {own} as own, {kept} as kept from x) select record_id, own as record_sha256, {d.sha(d.sub('kept', chr(34) + 'record_sha256' + chr(34) + ':' + chr(34) + '[0-9a-f]+' + chr(34) + ',', ''))} = own as holds from y"


@relational("b8_quarantined_release")
def b8(d):
    """Documents less a quarantine list (the shortest hundred, one unknown id, one wrong title): counts that must close, list entries that are missing or have another title, and a sum over the kept rows' places and bytes."""
    return f"""with s as (select doc_id, title from @documents where text is not null order by length(text), doc_id limit 100), q as (select doc_id, case when doc_id = (select min(doc_id) from s) then 'another title' else title end as title from s union all select cast(-1 as bigint), 'unknown'),
      j as (select d.source, d.doc_id, d.text, d.title, q.doc_id as qid, q.title as qt from @documents d left join q on q.doc_id = d.doc_id)
      select source, count(*) as documents, {d.int('sum(case when qid is not null then 1 else 0 end)')} as quarantined, {d.int('sum(case when qid is null then 1 else 0 end)')} as kept, count(*) = sum(case when qid is not null then 1 else 0 end) + sum(case when qid is null then 1 else 0 end) as closes,
        {d.int("sum(case when qid is not null and coalesce(qt, '') <> coalesce(title, '') then 1 else 0 end)")} as title_mismatches, (select count(*) from q where doc_id not in (select doc_id from @documents)) as missing_ids, {d.int("sum(case when qid is null then length(coalesce(text, '')) else 0 end)")} as kept_chars from j group by 1"""


packed("b9_release_build", lambda d: f"(select coalesce(source_id, '') as source_id, coalesce(split, '') as split, substr(hk, 1, 1) as block, hk, chunk_id as id, cast(0 as bigint) as prompt, {d.size('token_ids')} + 1 as n from (select x.*, {rank_key(d, 'chunk_id')} as hk from {CH} x where token_ids is not null) y)", ["source_id", "split"], 257, False,
       "select source_id, split, count(distinct block || ':' || cast(record as varchar(20))) as records, count(*) as examples, count(distinct id) as ids, cast(sum(kept) as bigint) as tokens, cast(sum(case when state = 'complete' then 0 else 1 end) as bigint) as over_width from walk group by 1, 2", "The records of each source and split, with their lineage closed: examples, ids and tokens.")


@relational("b10_record_diff")
def b10(d):
    """Chunks against a repaired version of them (titles trimmed and lower-cased): unchanged, changed, only old or only new, and decisions that become stale."""
    h = lambda t: d.sha(f"text || chr(31) || coalesce({t}, '')")
    src = "(select chunk_id, min(text) as text, min(section_title) as section_title, min(boundary_end_type) as decision from @text_chunks where text is not null group by 1)"
    return f"""with o as (select chunk_id, {h('section_title')} as h, decision from {src} a), n as (select chunk_id, {h('lower(trim(section_title))')} as h from {src} b where length(text) > 40)
      select case when n.h is null then 'only_old' when o.h is null then 'only_new' when o.h = n.h then 'unchanged' else 'changed' end as state, count(*) as n, {d.int("sum(case when o.h is not null and o.h <> coalesce(n.h, '') and decision is not null then 1 else 0 end)")} as stale_decisions from o full outer join n on o.chunk_id = n.chunk_id group by 1"""


@query("l16_lineage_index")
def l16(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the tables by category: path, size, hash, format."""
    x = files.file_hashes(spark, sf)
    return x.select(F.regexp_extract("file", r"/([^/]+)\.parquet", 1).alias("category"), F.regexp_extract("file", "[^/]+$", 0).alias("path"), "bytes", "sha256", F.regexp_extract("file", r"\.([A-Za-z]+)$", 1).alias("format"))
