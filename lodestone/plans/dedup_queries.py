"""Queries on duplicates and on evaluation passages in texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import similarity as sim
from ..session import plain_unions, staged
from .dialect import Duck, grams, norm, relational, words, ws
from .registry import query
from .text_queries import gate

SEP = "␟"
_D = Duck()


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def shingle_list(d, x, k=5):
    """The different runs of k words; a shorter text is one."""
    n = d.size("sw")
    short = d.map(d.seq("1", "1"), "si", d.join("sw", SEP))
    return d.let(words(d, norm(d, x)), "sw", f"case when {n} = 0 then {d.empty()} when {n} < {k} then {short} else {d.distinct(grams(d, 'sw', k, SEP))} end")


@relational("f1_exact_groups")
def f1(d):
    """Groups of documents of the same matched text."""
    return f"select {d.sha(norm(d, 'text'))} as sha256, count(*) as n, min(doc_id) as first_id from @documents where text is not null group by 1 having count(*) > 1"


@relational("f2_shingles")
def f2(d):
    """How many different 5-word shingles each document has."""
    return f"select doc_id, {d.size(shingle_list(d, 'text'))} as n from @documents where text is not null"


def _pairs_sql(table, key, items, t, extra=""):
    return f"""with s as (select {key} as id, {items} as s from (select distinct {key}, text from {table}) x), e as (select id, len(s) as n, unnest(s) as g from s),
      p as (select a.id as a, b.id as b, count(*) as c, max(a.n) as na, max(b.n) as nb from e a join e b on a.g = b.g and a.id < b.id group by 1, 2),
      near as materialized (select a, b, c / cast(na + nb - c as double) as similarity from p where c / cast(na + nb - c as double) >= {t} - 1e-12)"""


_NEAR = _pairs_sql("documents", "doc_id", shingle_list(_D, "text"), 0.75)


def _near_docs(spark, sf, t):
    df = _docs(spark, sf).filter("text is not null").select("doc_id", sim.shingles(F.col("text")).alias("s"))
    return sim.similar_pairs(df, "doc_id", "s", t)


@query("f3_jaccard_pairs", _NEAR + " select a, b, round(similarity, 6) as similarity from near")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents of 5-word shingle similarity 0.75 or more."""
    return _near_docs(spark, sf, 0.75).withColumn("similarity", F.round("similarity", 6))


@query("f4_greedy_dedup", f"""with recursive {_pairs_sql("documents", "doc_id", shingle_list(_D, "text"), 0.9)[5:]},
  ids as (select doc_id as id, row_number() over (order by doc_id) as r from documents where text is not null),
  g as (select 0 as r, cast([] as bigint[]) as kept union all
    select g.r + 1, case when exists (select 1 from near where near.b = ids.id and list_contains(g.kept, near.a)) then g.kept else list_append(g.kept, ids.id) end from g join ids on ids.r = g.r + 1)
  select unnest(kept) as doc_id from (select kept from g order by r desc limit 1) x""")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    """Documents kept when each is dropped that is similar (0.9) to an earlier kept one."""
    nodes = _docs(spark, sf).filter("text is not null").select(F.col("doc_id").alias("id"))
    return sim.greedy_kept(nodes, _near_docs(spark, sf, 0.9)).filter("kept").select(F.col("id").alias("doc_id"))


@relational("f5_first_wins")
def f5(d):
    """Items by origin: first of their fingerprint, or repeating one of the same or another origin; originals go first."""
    return """with x as (select distinct item_id, lower(fingerprint) as fp, origin from @fingerprints where fingerprint is not null),
      y as (select *, row_number() over (partition by fp order by case origin when 'original' then 0 else 1 end, item_id) as r,
        first_value(origin) over (partition by fp order by case origin when 'original' then 0 else 1 end, item_id) as first_origin from x)
      select origin, case when r = 1 then 'first' when first_origin = origin then 'repeats_own' else 'repeats_other' end as state, count(*) as n from y group by 1, 2"""


def signature_sql(table="documents", key="doc_id", text="text", size=64):
    """CTEs (sg: id, signature, sha256, has_text) of the signature in plain SQL: both checksums byte by byte, sampling, padding."""
    most = 4 * size
    crc = lambda start: f"xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[cast(xor(c, b) & 255 as int) + 1]), cast({start} as ubigint)), cast(4294967295 as ubigint))"
    signed = lambda v: f"cast(case when {v} >= 9223372036854775808 then cast({v} as hugeint) - 18446744073709551616 else cast({v} as hugeint) end as bigint)"
    return f"""tb as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as ubigint)) else c >> 1 end, cast(n as ubigint))) as tab),
      tx as (select {key} as id, max({text}) as t from {table} where {text} is not null group by 1), so as (select id, t, list_sort({shingle_list(_D, 't')}) as o from tx),
      sp as (select id, t, case when len(o) > {most} then list_transform(range({most}), lambda i: o[cast(i * (len(o) - 1) // {most - 1} as int) + 1]) else o end as p from so),
      ex as (select distinct unnest(p) as s from sp), hx as (select s, hex(encode(s)) as h from ex), by_ as (select s, list_transform(range(0, len(h) // 2), lambda i: cast('0x' || h[cast(2 * i + 1 as int):cast(2 * i + 2 as int)] as ubigint)) as bytes from hx),
      v as (select s, ({crc(4294967295)} << 32) | {crc(0x9E3779B9 ^ 0xFFFFFFFF)} as v from by_ cross join tb),
      e as (select distinct id, v from (select id, unnest(p) as s from sp) q join v on q.s = v.s), r as (select id, v, row_number() over (partition by id order by v) as r from e), l as (select id, list(v order by v) as low from r where r <= {size} group by 1),
      pd as (select sp.id, sp.t, l.low, list_reduce(l.low, lambda a, b: xor(a, b)) as seed from sp left join l on sp.id = l.id),
      un as (select id, t, case when low is null then list_transform(range({size}), lambda i: cast(18446744073709551615 as ubigint)) when len(low) >= {size} then low else list_concat(low, list_transform(range(len(low) + 1, {size} + 1), lambda i: xor(seed, cast(cast(i as hugeint) * 11400714819323198485 % 18446744073709551616 as ubigint)))) end as u from pd),
      sg as (select id, u, list_transform(u, lambda x: {signed('x')}) as signature, sha256({norm(_D, 't')}) as sha256 from un)"""


def keys_sql(bands=8):
    """The band keys of u: the values of each remainder, hashed."""
    own = lambda b: f"list_filter(u, lambda x: x & {bands - 1} = {b})"
    return "[" + ", ".join(f"'{b}:' || sha256(unhex(array_to_string(list_transform({own(b)}, lambda x: lpad(hex(x), 16, '0')), '')))" for b in range(bands)) + "]"


_EMPTY = "right(k, 64) <> sha256(unhex(''))"
# One row for each text: the smallest id of it.
_INDEX = f"{signature_sql()}, ix as (select min(id) as document_id, sha256 as normalized_sha256, arg_min(signature, id) as signature, arg_min(u, id) as u from sg group by sha256)"


@query("f6_signatures", f"with {signature_sql()} select id as doc_id, signature, {keys_sql()} as bucket_keys from sg")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    """MinHash signature and band keys of each document."""
    x = _docs(spark, sf).filter("text is not null").select("doc_id", sim.signature(F.col("text")).alias("signature"))
    return x.withColumn("bucket_keys", sim.band_keys(F.col("signature")))


@query("f7_band_keys", f"with {signature_sql()}, k as (select id, unnest({keys_sql()}) as k from sg) select left(k, 1) as band, count(*) as n, count(distinct k) as different, cast(sum(case when {_EMPTY} then 0 else 1 end) as bigint) as empty from k group by 1")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of each band: how many, how many different, how many of no values."""
    x = f6(spark, sf).select(F.explode("bucket_keys").alias("k"))
    return x.groupBy(F.substring("k", 1, 1).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("different"), F.count_if(F.col("k").endswith(F.sha2(F.lit(b""), 256))).alias("empty"))


@query("f9_document_index", f"with {_INDEX} select document_id, normalized_sha256, signature, {keys_sql()} as bucket_keys from ix")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    """The index of the documents: one row for each matched text."""
    return sim.document_index(_docs(spark, sf), "doc_id", "text", "doc_id").select("document_id", "normalized_sha256", "signature", "bucket_keys")


@relational("f10_exact_lookup")
def f10(d):
    """Chunks whose matched text is a whole document."""
    a, b = d.sha(norm(d, "c.text")), d.sha(norm(d, "t.text"))
    return f"""with i as (select {b} as h, min(t.doc_id) as doc_id from @documents t where t.text is not null group by 1),
      c as (select distinct c.chunk_id, {a} as h from @text_chunks c where c.text is not null) select c.chunk_id, i.doc_id from c join i on c.h = i.h"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, sa, sb): index documents whose id is divisible by 20, and all others that share a key with them."""
    x = staged(f9(spark, sf), "index").select("document_id", "signature", F.explode("bucket_keys").alias("k")).filter(~F.col("k").endswith(F.sha2(F.lit(b""), 256)))
    a = x.filter("document_id % 20 = 0").select(F.col("document_id").alias("a"), F.col("signature").alias("sa"), "k")
    b = x.select(F.col("document_id").alias("b"), F.col("signature").alias("sb"), "k")
    return a.join(b, "k").filter("a != b").dropDuplicates(["a", "b"])


_CAND = f"{_INDEX}, k as (select document_id, signature, unnest({keys_sql()}) as k from ix), cd as (select distinct p.document_id as a, q.document_id as b, p.signature as sa, q.signature as sb from k p join k q on p.k = q.k where {_EMPTY.replace('right(k', 'right(p.k')} and p.document_id % 20 = 0 and p.document_id <> q.document_id)"


@query("f11_bucket_candidates", f"with {_CAND} select a, b from cd")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of every twentieth document of the index: those that share a band key."""
    return _candidates(spark, sf).select("a", "b")


@query("f8_signature_similarity", f"with {_CAND} select a, b, round(len(list_intersect(list_distinct(sa), list_distinct(sb))) / 64.0, 6) as similarity from cd")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates' signature similarity."""
    return _candidates(spark, sf).select("a", "b", F.round(sim.signature_similarity(F.col("sa"), F.col("sb")), 6).alias("similarity"))


def _matched(spark, sf):
    idx = sim.document_index(_docs(spark, sf), "doc_id", "text", "doc_id")
    return sim.matches(idx, spark.read.parquet(f"{sf}/retrieved_source_records.parquet"), "record_id", "text")


_RECS = signature_sql("retrieved_source_records", "record_id", "text").replace("tb as", "tb2 as").replace("cross join tb)", "cross join tb2)")
for _n in ("tx", "so", "sp", "ex", "hx", "by_", "v", "e", "r", "l", "pd", "un", "sg"):
    _RECS = re.sub(rf"\b{_n} as \(", f"r_{_n} as (", _RECS)
    _RECS = re.sub(rf"\b(from|join) {_n}\b", rf"\1 r_{_n} {_n}", _RECS)
_MATCH = f"""with {_INDEX}, ik as (select document_id, signature, unnest({keys_sql()}) as k from ix), {_RECS},
  ex_ as (select r.id, min(ix.document_id) as document_id from r_sg r join ix on r.sha256 = ix.normalized_sha256 group by 1), rk as (select id, signature, unnest({keys_sql()}) as k from r_sg where id not in (select id from ex_)),
  cd as (select distinct rk.id, ik.document_id, rk.signature as sa, ik.signature as sb from rk join ik on rk.k = ik.k where {_EMPTY.replace('right(k', 'right(rk.k')}), sm as (select id, document_id, len(list_intersect(list_distinct(sa), list_distinct(sb))) / 64.0e0 as similarity from cd),
  bs as (select id, document_id, similarity, row_number() over (partition by id order by similarity desc, document_id) as r from sm where similarity >= 0.75),
  res as (select id, 'exact' as match_type, 'reject' as decision, document_id, 1.0e0 as similarity from ex_ union all select id, case when similarity >= 0.9 then 'near' else 'ambiguous' end, case when similarity >= 0.9 then 'reject' else 'review' end, document_id, similarity from bs where r = 1
    union all select id, null, 'keep', null, null from r_sg where id not in (select id from ex_) and id not in (select id from bs))"""


@query("f13_match_decisions", _MATCH + " select id as record_id, match_type, decision, document_id, similarity from res")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each record is kept, rejected or reviewed against the documents' index."""
    return _matched(spark, sf).withColumnRenamed("id", "record_id")


@query("f14_overlap_report", _MATCH + " select coalesce(match_type, 'none') as match_type, decision, count(*) as n from res group by 1, 2")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    """Records by kind of match and decision."""
    return _matched(spark, sf).groupBy(F.coalesce("match_type", F.lit("none")).alias("match_type"), "decision").agg(F.count(F.lit(1)).alias("n"))


@relational("f12_federated_lookup")
def f12(d):
    """Exact lookups in two indexes: documents first, then records; the first index that has the text counts."""
    h = lambda x: d.sha(norm(d, x))
    return f"""with i as (select 1 as pri, 'documents' as index_name, {h('text')} as h, min(cast(doc_id as varchar(30))) as id from @documents where text is not null group by 3
        union all select 2, 'records', {h('text')}, min(cast(record_id as varchar(30))) from @retrieved_source_records where text is not null group by 3),
      c as (select distinct item_id, {h('item_text')} as h from @fingerprints where item_text is not null),
      j as (select c.item_id, i.index_name, i.id, row_number() over (partition by c.item_id order by i.pri) as r from c join i on c.h = i.h)
      select item_id, index_name, id from j where r = 1"""


def _composites(d):
    n = lambda x: f"lower({ws(d, x)})"
    e = f"(select distinct example_id, coalesce(instruction, '') as i, coalesce(input, '') as n, coalesce(response, '') as r from @instruction_examples)"
    kinds = {"instruction": "i", "input": "n", "response": "r", "instruction_input": "i || chr(10) || n", "instruction_input_response": "i || chr(10) || n || chr(10) || r"}
    return " union all ".join(f"select '{k}' as kind, example_id, {n(x)} as v from {e} x" for k, x in kinds.items())


@relational("f15_duplicate_groups")
def f15(d):
    """Groups of examples that agree in a part or in several."""
    return f"with x as ({_composites(d)}) select kind, {d.sha('v')} as sha256, count(*) as n, min(example_id) as first_id from x where v <> '' group by 1, 2 having count(*) > 1"


def _plain_shingles(d, x):
    w = d.split(f"lower({ws(d, x)})", " ")
    return d.let(w, "pw", f"case when {d.size('pw')} >= 3 then {d.distinct(grams(d, 'pw', 3, ' '))} else {d.distinct('pw')} end")


@query("f16_near_examples", _pairs_sql("(select example_id, instruction as text from instruction_examples where instruction is not null and trim(instruction) <> '')", "example_id", _plain_shingles(_D, "text"), 0.75) + " select a, b, round(similarity, 6) as similarity from near")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of examples whose instructions have 3-word similarity 0.75 or more."""
    x = spark.read.parquet(f"{sf}/instruction_examples.parquet").filter("instruction is not null and trim(instruction) <> ''")
    words_ = F.split(F.lower(F.trim(F.regexp_replace("instruction", sim._WS, " "))), " ")
    s = sim.let(words_, lambda w: F.when(F.size(w) >= 3, sim.runs(w, 3, " ")).otherwise(w))
    return sim.similar_pairs(x.select("example_id", s.alias("s")), "example_id", "s", 0.75).withColumn("similarity", F.round("similarity", 6))


@relational("f17_cross_set_duplicates")
def f17(d):
    """Groups of equal instructions of which, for some capability, a part is of that capability and a part of others."""
    return f"""with x as (select distinct example_id, coalesce(capability, '') as capability, {d.sha(f"lower({ws(d, 'instruction')})")} as h from @instruction_examples where instruction is not null), g as (select h, count(*) as n from x group by 1),
      c as (select h, capability, count(*) as own from x group by 1, 2) select c.h as sha256, c.capability, c.own, g.n - c.own as others from c join g on c.h = g.h where g.n > c.own"""


@relational("f5_ingest_counters")
def f5_counters(d):
    """Counters of an ingest by origin and source: rows, items, invalid and missing fingerprints, retained, repeats within the origin and of another origin."""
    ok = d.like("coalesce(fp, '')", "^[0-9a-f]{64}$")
    return f"""with x as (select item_id, min(lower(trim(fingerprint))) as fp, min(origin) as origin, min(coalesce(source_id, '')) as source_id, count(*) as deliveries from @fingerprints group by 1),
      y as (select *, {ok} as ok, row_number() over (partition by fp order by case origin when 'original' then 0 else 1 end, item_id) as r, first_value(origin) over (partition by fp order by case origin when 'original' then 0 else 1 end, item_id) as o1 from x)
      select origin, source_id, cast(sum(deliveries) as bigint) as n_rows, count(*) as items, {d.int('sum(case when not ok then 1 else 0 end)')} as invalid, {d.int('sum(case when ok and r = 1 then 1 else 0 end)')} as retained, {d.int('sum(case when ok and r > 1 and o1 = origin then 1 else 0 end)')} as repeats_own, {d.int('sum(case when ok and r > 1 and o1 <> origin then 1 else 0 end)')} as repeats_other from y group by 1, 2"""


@relational("f19_index_coverage")
def f19(d):
    """Coverage of the indexes that a federation needs: sources with their checkpoints' state and hash, items that the index has, and whether each may be used."""
    return f"""with p as (select source_id, max(complete) as complete, max(processed) as processed, count(distinct source_sha256) as hashes from @source_progress where source_id is not null group by 1),
      f as (select lower(trim(source_id)) as source_id, count(distinct item_id) as items from @fingerprints where source_id is not null group by 1)
      select coalesce(p.source_id, f.source_id) as source_id, coalesce(complete, 0) = 1 as complete, coalesce(hashes, 0) = 1 as one_hash, coalesce(items, 0) as items, p.source_id is not null and f.source_id is not null and complete = 1 and hashes = 1 as usable from p full outer join f on p.source_id = f.source_id"""


def _union_sql(d):
    sh = lambda x: shingle_list(d, x)
    own = "(select distinct item_id, item_text as t from fingerprints where item_text is not null and item_id % 20 = 0)"
    side = lambda name, key, rel: f"select '{name}' as index_name, cast({key} as varchar(30)) as id, {d.explode(sh('text'))} as s from {rel} where text is not null"
    return f"""with q as (select item_id, {d.explode(sh('t'))} as s from {own} a), n as (select item_id, count(*) as n from q group by 1), i as ({side('documents', 'doc_id', 'documents')} union all {side('records', 'record_id', '(select distinct record_id, text from retrieved_source_records) rr')}),
      h as (select q.item_id, i.index_name, i.id, count(distinct q.s) as c from q join i on q.s = i.s group by 1, 2, 3), k as (select h.*, row_number() over (partition by h.item_id, index_name order by c desc, id) as r, count(*) over (partition by h.item_id) as candidates from h join n on h.item_id = n.item_id where 2 * c >= n)
      select item_id, index_name, id, c as shared, candidates from k where r = 1"""


def _shared_halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(pairs that may share half of the item's shingles, all pairs that do: item_id, index_name, id, c).

    c shingles, half of the item's n or more, can only be shared if one of them
    is among any |item| - ceil(n / 2) + 1 of the item, so the rarest ones in the
    indexes are joined, and what very many texts have is not.
    """
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    items = read("fingerprints").filter("item_text is not null and item_id % 20 = 0").select("item_id", "item_text").distinct()
    items = staged(items.select("item_id", F.array_distinct(sim.shingle_hashes(F.col("item_text"))).alias("s")), "items")
    side = lambda name, key, t: read(t).filter("text is not null").select(F.lit(name).alias("index_name"), F.col(key).cast("string").alias("id"), sim.shingle_hashes(F.col("text")).alias("s"))
    both = side("documents", "doc_id", "documents").unionAll(side("records", "record_id", "retrieved_source_records"))
    met = staged(sim.only_hashes_of(both, items), "met").select("index_name", "id", F.explode("s").alias("s")).distinct()
    found = met.groupBy("s").agg(F.count(F.lit(1)).alias("m"))
    own = items.groupBy("item_id").agg(F.sum(F.size("s")).alias("n"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    one = own.select("item_id", "n", F.size("s").alias("u"), F.explode("s").alias("s")).join(found, "s", "left")
    one = one.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("m", F.lit(0)), "s")))
    first = one.filter("m is not null and r <= u - ceil(n / 2) + 1").select("item_id", "s")
    pairs = staged(first.join(met, "s").select("item_id", "index_name", "id").distinct(), "pairs")
    texts = met.groupBy("index_name", "id").agg(F.collect_list("s").alias("b")).withColumnsRenamed({"index_name": "index_", "id": "id_"})
    x = pairs.join(texts, (F.col("index_name") == F.col("index_")) & F.col("id").eqNullSafe(F.col("id_"))).join(own, "item_id")
    return pairs, x.withColumn("c", F.size(F.array_intersect("s", "b")).cast("long")).filter("2 * c >= n").select("item_id", "index_name", "id", "c")


@query("f12_candidate_union", _union_sql(_D))
def f12_near(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of every twentieth item from both indexes together, by shared five-word shingles (half of the item's or more): the best of each index, and how many both gave."""
    plain_unions(spark)
    h = _shared_halves(spark, sf)[1]
    best = F.row_number().over(Window.partitionBy("item_id", "index_name").orderBy(F.desc("c"), F.asc_nulls_last("id")))
    k = h.withColumn("r", best).withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    return k.filter("r = 1").select("item_id", "index_name", "id", F.col("c").alias("shared"), "candidates")


@relational("f18_duplicate_outputs")
def f18(d):
    """How many responses of each capability repeat another one."""
    return "with x as (select capability, response, count(distinct example_id) as n from @instruction_examples where response is not null group by 1, 2) select capability, cast(sum(n - 1) as bigint) as duplicates from x group by 1"


@relational("f20_fingerprint_audit")
def f20(d):
    """Counts of fingerprints by source: rows, items, different values, invalid and missing ones."""
    return f"""select coalesce(source_id, '') as source_id, count(*) as n_rows, count(distinct item_id) as items, count(distinct lower(fingerprint)) as different,
      {d.int("sum(case when fingerprint is not null and not " + d.like('fingerprint', '^[0-9a-fA-F]{64}$') + " then 1 else 0 end)")} as invalid, {d.int('sum(case when fingerprint is null then 1 else 0 end)')} as missing from @fingerprints group by 1"""


@relational("f21_duplicate_previews")
def f21(d):
    """Chunks whose first and last 120 characters are those of another chunk."""
    return """with x as (select distinct chunk_id, substr(text, 1, 120) as a, right(text, 120) as b from @text_chunks where text is not null),
      y as (select chunk_id, count(*) over (partition by a, b) as n from x) select chunk_id, n from y where n > 1"""


# Evaluation passages.


def _evidence(d, k):
    n = norm(d, "prompt")
    return f"(select id, {n} as p, {grams(d, words(d, n), k, ' ')} as f from (select distinct id, prompt from @prompts where prompt is not null) q)"


@relational("g1_prompt_evidence")
def g1(d):
    """How many 5-word fragments each prompt gives, and its hash."""
    return f"select id, {d.sha('p')} as sha256, {d.size('f')} as fragments from {_evidence(d, 5)} e"


def span_hits(d):
    """Hashes of 8-word spans of records that prompts have, and the prompts."""
    g = lambda x: grams(d, d.split(ws(d, x), " "), 8, " ")
    return f"""pg as (select distinct id, {d.sha('g')} as h from (select id, {d.explode(g(fold_('prompt')))} as g from @prompts where prompt is not null) q),
      rg as (select distinct record_id, {d.sha('g')} as h from (select record_id, {d.explode(g(fold_('text')))} as g from @retrieved_source_records where text is not null) q),
      hit as (select distinct rg.record_id, pg.id, rg.h from rg join pg on rg.h = pg.h)"""


def fold_(x):
    from .dialect import fold

    return fold(x)


@relational("g3_commitments")
def g3(d):
    """Hash commitments of the prompts: whole short ones, and all 8-word spans of longer ones."""
    w = d.split(ws(d, fold_("prompt")), " ")
    return f"""with p as (select distinct id, {w} as w from @prompts where prompt is not null),
      e as (select id, 'exact' as kind, {d.size('w')} as width, {d.sha(d.join('w', ' '))} as h from p where {d.size('w')} < 8
        union all select id, 'span', 8, {d.sha('g')} from (select id, {d.explode(grams(d, 'w', 8, ' '))} as g from p) q)
      select kind, width, h as sha256, count(distinct id) as prompts from e group by 1, 2, 3"""


def commitment_hits(d, texts, key, found=", cm.id, cm.g"):
    """Runs of texts, a relation of key and text, that are commitments of prompts (hit: key, id, g), of every width that prompts have.

    As in g3 a prompt of under 8 words commits itself whole, a longer one its 8-word spans.
    """
    w = lambda x: d.split(ws(d, fold_(x)), " ")
    n, cut = d.size("w"), d.part("w", *(("cast(si as int)", "cast(width as int)") if d.spark else ("si", "width")))
    runs = f"case when {n} >= width then {d.distinct(d.map(d.seq('1', d.int(f'{n} - width + 1')), 'si', d.join(cut, ' ')))} else {d.empty()} end"
    return f"""pw as (select distinct id, {w('prompt')} as w from @prompts where prompt is not null),
      cm as (select id, {n} as width, {d.join('w', ' ')} as g from pw where {n} < 8 and {d.join('w', ' ')} <> ''
        union all select distinct id, {d.int('8')}, g from (select id, {d.explode(grams(d, 'w', 8, ' '))} as g from pw) q),
      wd as (select distinct width from cm), tw as (select {key}, {w('text')} as w from {texts} x),
      tg as (select /*+ broadcast(wd) */ {key}, {d.explode(runs)} as g from tw cross join wd),
      hit as (select distinct tg.{key}{found} from tg join cm on tg.g = cm.g)"""


_RECORDS = "(select record_id, text from @retrieved_source_records where text is not null)"


@relational("g4_commitment_scan")
def g4_whole(d):
    """Records that hold a commitment of a prompt (a whole short one, or an 8-word span), with the number of commitments and prompts."""
    return f"with {commitment_hits(d, _RECORDS, 'record_id')} select record_id, count(distinct g) as spans, count(distinct id) as prompts from hit group by 1"


@relational("g5_commitment_summary")
def g5_whole(d):
    """Records scanned and matched for commitments of every width, by source; any match rejects the record."""
    return f"""with {commitment_hits(d, _RECORDS, 'record_id')}, m as (select distinct record_id from hit), r as (select record_id, max(endpoint) as endpoint from @retrieved_source_records where text is not null group by 1)
      select endpoint, count(*) as scanned, {d.int('sum(case when m.record_id is null then 0 else 1 end)')} as rejected from r left join m on r.record_id = m.record_id group by 1"""


@relational("g4_span_scan")
def g4(d):
    """Records that hold an 8-word span of a prompt, with the number of spans and prompts. Shorter prompts: g4_commitment_scan."""
    return f"with {span_hits(d)} select record_id, count(distinct h) as spans, count(distinct id) as prompts from hit group by 1"


@relational("g5_scan_summary")
def g5(d):
    """Records scanned and matched for 8-word spans, by source; any match rejects the record. Shorter prompts: g5_commitment_summary."""
    return f"""with {span_hits(d)}, m as (select distinct record_id from hit), r as (select record_id, max(endpoint) as endpoint from @retrieved_source_records where text is not null group by 1)
      select endpoint, count(*) as scanned, {d.int('sum(case when m.record_id is null then 0 else 1 end)')} as rejected from r left join m on r.record_id = m.record_id group by 1"""


@query("g2_prompt_substrings", f"""with e as {_evidence(_D, 5).replace('@', '')}, r as (select distinct record_id, {norm(_D, 'text')} as t from retrieved_source_records where text is not null),
  full_ as (select r.record_id, e.id from r join e on e.p <> '' and contains(r.t, e.p)), f as (select id, unnest(f) as g from e),
  frag as (select distinct r.record_id, f.id from r join f on contains(r.t, f.g))
  select record_id, id as prompt_id, 'full_prompt' as method from full_ union all select record_id, id, 'distinctive_ngram' from frag where not exists (select 1 from full_ where full_.record_id = frag.record_id and full_.id = frag.id)""")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    """Records that contain a prompt as matched text, or a 5-word fragment of it.

    A fragment is words joined by single spaces, so a record that contains it
    has these words as the run of its space-separated pieces' inner parts: the
    records' five-piece runs are joined with fragments on the three inner
    words, which must be equal, and outer ones must end and begin with them.
    """
    from .dialect import Dialect, spark_sql

    d = Dialect()
    e = spark_sql(spark, sf, f"select * from {_evidence(d, 5)} e")
    r = spark_sql(spark, sf, f"select distinct record_id, {norm(d, 'text')} as t from @retrieved_source_records where text is not null").withColumn("w", F.split("t", " "))
    runs = r.select("record_id", F.explode(F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.slice("w", i, 5)))).alias("x"))
    runs = runs.withColumn("mid", F.array_join(F.slice("x", 2, 3), " "))
    f = e.select("id", F.explode("f").alias("g")).withColumn("y", F.split("g", " ")).withColumn("mid", F.array_join(F.slice("y", 2, 3), " "))
    ends = F.col("x")[0].endswith(F.col("y")[0]) & F.col("x")[4].startswith(F.col("y")[4])
    frag = runs.join(f, "mid").filter(ends).select("record_id", "id").distinct()
    # A whole prompt holds its first three pieces' inner one: candidates are met by it, then compared whole.
    p = e.filter("p <> ''").withColumn("y", F.split("p", " "))
    long = p.filter(F.size("y") >= 3).withColumn("mid", F.col("y")[1])
    piece = r.select("record_id", "t", F.explode(F.array_distinct("w")).alias("mid"))
    full = piece.join(long, "mid").filter(F.contains("t", "p")).select("record_id", "id").distinct()
    # Prompts of one or two pieces: their first four characters stand in one of the record's pieces.
    tiny = p.filter(F.size("y") < 3).withColumn("gram", F.substring(F.col("y")[0], 1, 4)).withColumn("width", F.length("gram"))
    widths = tiny.select("width").distinct()  # at most four rows
    grams_ = piece.crossJoin(F.broadcast(widths)).filter(F.length("mid") >= F.col("width"))
    grams_ = grams_.select("record_id", "t", F.explode(F.expr("array_distinct(transform(sequence(1, length(mid) - width + 1), i -> substr(mid, i, width)))")).alias("gram"))
    near = grams_.join(tiny.select("id", "p", "gram"), "gram").filter(F.contains("t", "p")).select("record_id", "id").distinct()
    full = full.union(near).distinct()
    a = full.select("record_id", F.col("id").alias("prompt_id"), F.lit("full_prompt").alias("method"))
    b = frag.join(full, ["record_id", "id"], "left_anti").select("record_id", F.col("id").alias("prompt_id"), F.lit("distinctive_ngram").alias("method"))
    return a.union(b)


_EXAMPLE_TEXTS = "(select distinct example_id, coalesce(instruction, '') || ' ' || coalesce(input, '') || ' ' || coalesce(response, '') as text from @instruction_examples)"


@relational("g6_example_contamination")
def g6(d):
    """Examples whose instruction, input and response together hold commitments of a prompt: exact where all of the prompt's are there, else fragments only."""
    return f"with {commitment_hits(d, _EXAMPLE_TEXTS, 'example_id')}, t as (select id, count(distinct g) as total from cm group by 1) select hit.example_id, hit.id as prompt_id, count(distinct g) as commitments, count(distinct g) = max(t.total) as exact from hit join t on hit.id = t.id group by 1, 2"


@relational("g5_merged_scan")
def g5_merged(d):
    """Records rejected by any finding: a prompt whole, an expected answer whole, an eight-word fragment, or a decision made elsewhere (records that prompts' hashed ordinals name); by method, and how many have several."""
    ans = f"(select distinct id, {d.sha(norm(d, 'expected_behavior'))} as h from @prompts where expected_behavior is not null)"
    ordinal = d.int("cast(substr(id, 4) as int)")
    return f"""with {commitment_hits(d, _RECORDS, 'record_id')}, t as (select id, count(distinct g) as total from cm group by 1), p as (select hit.record_id, hit.id, count(distinct g) as c, max(t.total) as total from hit join t on hit.id = t.id group by 1, 2),
      f as (select distinct record_id, case when c = total then 'prompt_exact' else 'eight_word_fragment' end as method from p union select distinct r.record_id, 'answer_exact' from {_RECORDS} r join {ans} a on {d.sha(norm(d, 'r.text'))} = a.h
        union select distinct r.record_id, 'decision' from {_RECORDS} r join (select distinct {d.sha(f'cast({ordinal} as varchar(20))')} as h from @prompts where {d.like('id', '^pr_[0-9]+$')}) o on {d.sha('cast(r.record_id as varchar(20))')} = o.h),
      n as (select record_id, count(*) as methods from f group by 1) select f.method, count(*) as records, {d.int('sum(case when n.methods > 1 then 1 else 0 end)')} as with_others from f join n on f.record_id = n.record_id group by 1"""


@relational("g10_commitments")
def g10(d):
    """Commitments of the prompts and of their expected answers, as hashes only: the whole text with its number of words, and all eight-word spans."""
    w = lambda x: d.split(ws(d, fold_(x)), " ")
    src = "(select distinct id, prompt as text, 'prompt' as part from @prompts where prompt is not null union select distinct id, expected_behavior, 'answer' from @prompts where expected_behavior is not null)"
    return f"""with x as (select id, part, {w('text')} as w from {src} s) select id, part, 'exact' as kind, {d.size('w')} as words, {d.sha(d.join('w', ' '))} as sha256 from x
      union all select distinct id, part, 'ngram', cast(8 as bigint), {d.sha('g')} from (select id, part, {d.explode(grams(d, 'w', 8, ' '))} as g from x) y"""


@relational("g11_forbidden_fragments")
def g11(d):
    """Documents that contain a forbidden fragment (the prompts' required keywords, a list of fixed size), with the number of different ones."""
    frag = f"(select {d.collect('k')} as ks from (select distinct {d.explode('checks.required_keywords')} as k from @prompts where checks.required_keywords is not null) a)"
    return f"with f as {frag}, x as (select doc_id, lower(text) as t, ks from @documents cross join f where text is not null) select doc_id, {d.size(d.keep('ks', 'k', d.contains('t', 'lower(k)')))} as fragments from x where {d.size(d.keep('ks', 'k', d.contains('t', 'lower(k)')))} > 0"


@relational("g7_exclusions")
def g7(d):
    """Chunks of parents that aren't reserved; reserved is a parent with a chunk in an evaluation split."""
    return """select distinct chunk_id from @base_text_chunks b where document_id is not null and not exists
      (select 1 from @base_text_chunks r where r.document_id = b.document_id and lower(trim(r.split)) in ('validation', 'test'))"""


@relational("g8_quarantine")
def g8(d):
    """Documents named by hashed ordinals (every prompt's number), and the prompts that name them."""
    n = d.int("cast(substr(id, 4) as int)")
    return f"""with o as (select distinct id, {d.sha(f'cast({n} as varchar(20))')} as h from @prompts where {d.like('id', '^pr_[0-9]+$')}),
      t as (select doc_id, {d.sha('cast(doc_id as varchar(20))')} as h from @documents) select t.doc_id, count(*) as prompts, min(o.id) as first_prompt from t join o on t.h = o.h group by 1"""


@relational("g9_held_out_intake")
def g9(d):
    """Checks of the held-out prompts: repeated ids, repeated texts, texts that are training instructions."""
    h = lambda x: d.sha(norm(d, x))
    return f"""select 'repeated_ids' as check_name, count(*) as n from (select id from (select distinct id, prompt from @prompts) q group by id having count(*) > 1) a
      union all select 'repeated_prompts', count(*) from (select {h('prompt')} as p from @prompts group by 1 having count(distinct id) > 1) b
      union all select 'development_overlap', count(*) from (select distinct {h('prompt')} as p from @prompts) c where p in (select {h('instruction')} from @instruction_examples where instruction is not null)"""


@relational("g12_commitment_check")
def g12(d):
    """Stored commitments (the items' fingerprints) against their payload: ids that only one side has, and recomputed hashes that differ."""
    return f"""with c as (select item_id, min(lower(trim(fingerprint))) as h from @fingerprints where fingerprint is not null group by 1), p as (select item_id, {d.sha("min(" + d.sub('item_text', r'^\s+|\s+$', '') + ")")} as h from @fingerprints where item_text is not null group by 1)
      select case when c.h is null then 'no_commitment' when p.h is null then 'no_payload' when c.h = p.h then 'consistent' when not {d.like('c.h', '^[0-9a-f]{64}$')} then 'malformed' else 'different' end as state, count(*) as n from c full outer join p on c.item_id = p.item_id group by 1"""


def _report(d, hits):
    # Only ids and hashes are ranked; texts stay in the two scans.
    first = "row_number() over (partition by case when reason is null then sha else cast(doc_id as varchar(20)) end order by doc_id)"
    return f"""{gate(d)}, n as (select doc_id, source, reason, {d.sha(norm(d, 'text'))} as sha from gated), b as (select doc_id, source, reason, {first} as r from n), a as (select doc_id, source, r from b where reason is null),
      {hits}
      select x.source, count(*) as n_docs, count(a.doc_id) as accepted, {d.int('sum(case when a.r = 1 then 1 else 0 end)')} as first_of_text, {d.int('sum(case when a.r = 1 and hit.doc_id is null then 1 else 0 end)')} as clean
      from b x left join a on x.doc_id = a.doc_id left join hit on x.doc_id = hit.doc_id group by 1"""


def flagship(d):
    """Per source: documents, accepted, first of their text, and free of 8-word prompt spans. Shorter prompts: flagship_commitment_report."""
    g = lambda x: grams(d, d.split(ws(d, fold_(x)), " "), 8, " ")
    return _report(d, f"""p as (select distinct {d.explode(g('prompt'))} as g from @prompts where prompt is not null),
      e as (select doc_id, {d.explode(g('text'))} as g from @documents where text is not null), hit as (select distinct e.doc_id from e join p on e.g = p.g)""")


relational("flagship_corpus_report")(flagship)


@relational("flagship_commitment_report")
def flagship_whole(d):
    """Per source: documents, accepted, first of their text, and free of prompts' commitments of every width."""
    return _report(d, commitment_hits(d, "(select doc_id, text from @documents where text is not null)", "doc_id", ""))
