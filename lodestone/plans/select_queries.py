"""Queries on splits, samples, budgets, mixtures and schedules."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import in_order
from .dialect import norm, ranked_by_hash, relational, words
from .registry import query

SEED = "42"


def rank_key(d, *parts):
    """Hash by which rows are ranked: the seed and the parts, joined by colons."""
    return d.sha(" || ':' || ".join([f"'{SEED}'", *(f"cast({p} as varchar(60))" for p in parts)]))


EX = "(select distinct example_id, coalesce(capability, '') as capability, coalesce(source_type, '') as source_type, lower(trim(split)) as split, instruction, input, response, language, difficulty from @instruction_examples where example_id is not null)"
CH = "(select distinct chunk_id, document_id, chunk_index, source_id, lower(trim(split)) as split, lower(text_sha256) as text_sha256, token_ids, stored_mask from @base_text_chunks where chunk_id is not null)"


@relational("h1_parent_split")
def h1(d):
    """Parents in training or validation: a twentieth of them, by hash rank, validates."""
    return f"""with p as (select distinct document_id from @base_text_chunks where document_id is not null), {ranked_by_hash(d, 'p', rank_key(d, 'document_id'), 'document_id')}
      select document_id, case when r <= greatest(1, least(n - 1, {d.half_even('n * 0.05')})) then 'validation' else 'train' end as split from ranked"""


@relational("h2_stratified_split")
def h2(d):
    """Examples held out of each capability by hash rank: a tenth, at least one of two or more."""
    return f"""with r as (select example_id, capability, row_number() over (partition by capability order by {rank_key(d, 'example_id')}, example_id) as r, count(*) over (partition by capability) as n from {EX} x)
      select example_id, capability, case when n >= 2 and r <= greatest(1, {d.half_even('n * 0.1')}) then 'validation' else 'train' end as split from r"""


def _quotas(total):
    return f"""s as (select source_type, capability, count(*) as n from {EX} x where split = 'train' group by 1, 2), t as (select *, sum(n) over () as pop from s),
      e as (select *, n * {total} / cast(pop as double) as exact from t), f as (select *, floor(exact) as base, row_number() over (order by exact - floor(exact) desc, source_type, capability) as r from e),
      q as (select source_type, capability, n, cast(base as bigint) + case when r <= {total} - sum(cast(base as bigint)) over () then 1 else 0 end as quota from f)"""


@relational("h3_held_out_quotas")
def h3(d):
    """Sixty training examples held out over strata by largest remainder, in each by hash rank."""
    return f"""with {_quotas(60)}, r as (select example_id, source_type, capability, row_number() over (partition by source_type, capability order by {rank_key(d, 'source_type', 'capability', 'example_id')}) as r from {EX} x where split = 'train')
      select r.example_id, r.source_type, r.capability from r join q on r.source_type = q.source_type and r.capability = q.capability where r.r <= q.quota"""


def _at_places(spark: SparkSession, df: DataFrame, key: str, k: int, place, name: str) -> DataFrame:
    """The rows of df that stand at places place(i, n) of the order of key, i below k; no task sorts all rows."""
    x = in_order(df, key)
    n = F.lit(x.count())
    want = spark.range(k).select(F.col("id").alias(name), place(F.col("id"), n).cast("long").alias("r"))
    return x.join(F.broadcast(want), "r").select(name, key)  # k rows


@query("h5_spread_sample", """with r as (select doc_id, row_number() over (order by doc_id) - 1 as r from documents), c as (select count(*) as n from documents)
  select cast(p as bigint) as p, doc_id from range(0, 50) t(p), c join r on r.r = cast(floor(p * (n - 1) / 49.0) as bigint)""")
def h5(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty documents spread evenly over the order of ids, with both ends."""
    return _at_places(spark, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), "doc_id", 50, lambda i, n: F.floor(i * (n - 1) / 49), "p")


@query("h6_proxy_sample", """with d as (select distinct example_id from instruction_examples where example_id is not null), r as (select example_id, row_number() over (order by example_id) - 1 as r from d), c as (select count(*) as n from d)
  select cast(i as bigint) as i, example_id from range(0, 20) t(i), c join r on r.r = cast(floor(i * n / 20.0) as bigint)""")
def h6(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty examples at even steps of the order of ids."""
    x = spark.read.parquet(f"{sf}/instruction_examples.parquet").select("example_id").filter("example_id is not null").distinct()
    return _at_places(spark, x, "example_id", 20, lambda i, n: F.floor(i * n / 20), "i")


@query("h4_seeded_rows", None)
def h4(spark: SparkSession, sf: str, k: int = 40, seed: int = 42) -> DataFrame:
    """Forty documents at even steps of the order of ids, from an offset that the seed gives (drawn by a Mersenne twister, once)."""
    offset = random.Random(seed).random()
    return _at_places(spark, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), "doc_id", k, lambda i, n: F.least(n - 1, F.floor((i + F.lit(offset)) * n / k)), "p")


@relational("h7_hash_reservation")
def h7(d):
    """The hundred documents of the lowest hashes."""
    k = rank_key(d, "doc_id")
    return f"select doc_id, {k} as rank_hash from @documents order by {k}, doc_id limit 100"


@relational("h8_review_selection")
def h8(d, k=20, near=1400):
    """Chunks for manual review, with all reasons: hash-ranked, shortest, longest, nearest to the size limit, evenly spread, of different parents, and by hash those with warnings, of reference sections and with suspicious characters."""
    from .text_queries import REFERENCE_TITLES, suspicion
    c = f"(select distinct chunk_id, text, section_title, parent_document_id, boundary_end_type, {rank_key(d, 'chunk_id')} as hk from @text_chunks where text is not null)"
    refs = "(" + ", ".join(f"'{x}'" for x in REFERENCE_TITLES) + ")"
    first = f"(select chunk_id, parent_document_id, row_number() over (partition by parent_document_id order by chunk_id) as r from {c} x)"
    kinds = {
        "random": (c, "true", "hk"), "shortest": (c, "true", "length(text)"), "longest": (c, "true", "-length(text)"), "near_maximum": (c, f"length(text) <= {near}", "-length(text)"),
        "distinct_parent": (first, "r = 1", "parent_document_id"), "warning": (c, "boundary_end_type like '%fallback'", "hk"), "reference": (c, f"lower(trim(section_title)) in {refs}", "hk"), "suspicious": (c, f"{suspicion(d, 'text')} > 0", "hk"),
    }
    g = [f"select * from (select chunk_id, '{n}' as g from {rel} x where {cond} order by {by}, chunk_id limit {k}) s_{n}" for n, (rel, cond, by) in kinds.items()]
    even = f"select chunk_id, 'even' as g from (select chunk_id, row_number() over (partition by substr(hk, 1, 1) order by chunk_id) as r, count(*) over (partition by substr(hk, 1, 1)) as n from {c} x) e where r = 1 or r = n"
    return f"select chunk_id, {d.join(d.collect('g'), ',')} as reasons from ({' union all '.join([*g, even])}) u group by chunk_id"


@relational("h9_category_cover")
def h9(d):
    """A packet of 30 prompts: the first of each category by hash, then others by hash."""
    p = "(select distinct id, coalesce(category, 'none') as category from @prompts)"
    return f"""with r as (select id, category, {rank_key(d, 'id')} as k, row_number() over (partition by category order by {rank_key(d, 'id')}, id) as r from {p} x)
      select id, category from r order by case when r = 1 then 0 else 1 end, k, id limit 30"""


@relational("h10_longest_shortest")
def h10(d):
    x = f"(select example_id, {d.size(words(d, 'response'))} as n from {EX} x where response is not null)"
    return f"select 'longest' as side, example_id, n from (select * from {x} y order by n desc, example_id limit 10) a union all select 'shortest', example_id, n from (select * from {x} y order by n, example_id limit 10) b"


@relational("h11_parent_cap")
def h11(d):
    """At most two chunks of each parent, the first ones."""
    return "with c as (select distinct parent_document_id, chunk_id, chunk_index from @text_chunks), r as (select *, row_number() over (partition by parent_document_id order by chunk_index, chunk_id) as r from c) select chunk_id from r where r <= 2"


@relational("h12_token_budget")
def h12(d, parents=10, chunks=40, tokens=1500):
    """Chunks of each source, parent by parent, until one would pass the budget of parents, chunks or tokens; it ends the source. Sums are taken per parent first, so only a row for each parent is put in order."""
    n = d.size("token_ids")
    return f"""with c as (select source_id, document_id, chunk_id, chunk_index, {n} as n from {CH} x where token_ids is not null and source_id is not null and document_id is not null), p as (select source_id, document_id, sum(n) as t, count(*) as c from c group by 1, 2),
      q as (select *, row_number() over (partition by source_id order by document_id) as pr, sum(t) over (partition by source_id order by document_id rows between unbounded preceding and current row) - t as t0, sum(c) over (partition by source_id order by document_id rows between unbounded preceding and current row) - c as c0 from p),
      y as (select c.source_id, c.document_id, c.chunk_id, q.pr, q.t0 + sum(c.n) over (partition by c.source_id, c.document_id order by c.chunk_index, c.chunk_id rows between unbounded preceding and current row) as total, q.c0 + row_number() over (partition by c.source_id, c.document_id order by c.chunk_index, c.chunk_id) as k from c join q on c.source_id = q.source_id and c.document_id = q.document_id),
      stop as (select source_id, min(k) as first_over from y where pr > {parents} or k > {chunks} or total > {tokens} group by 1)
      select y.source_id, y.chunk_id, {d.int('y.total')} as running_tokens from y left join stop on y.source_id = stop.source_id where stop.first_over is null or y.k < stop.first_over"""


@relational("h13_gate_selection")
def h13(d, k=12):
    """The examples of each capability with the lowest hashes of seed and id."""
    return f"select capability, example_id from (select capability, example_id, row_number() over (partition by capability order by {rank_key(d, 'example_id')}, example_id) as r from {EX} x) y where r <= {k}"


@relational("h14_epoch_order")
def h14(d, epoch=1, batch=32, resume=0):
    """An order of all documents for an epoch, by hash of seed, epoch and id, in batches; a run that resumes leaves out the batches it has done."""
    one = f"'{epoch}'"
    return f"with {ranked_by_hash(d, '@documents', rank_key(d, one, 'doc_id'), 'doc_id')} select doc_id, r as seq, {d.int(f'floor((r - 1) / {batch}.0)')} as batch from ranked where r > {resume * batch}"


M = "(select mixture_id, source_id, sum(weight) as weight, max(domain) as domain, min(max_repeats) as max_repeats from @mixture_sources group by 1, 2)"


def allocation(d, target):
    return f"""e as (select mixture_id, source_id, weight, {target} * weight / sum(weight) over (partition by mixture_id) as raw from {M} x),
      f as (select *, cast(floor(raw) as bigint) as base, row_number() over (partition by mixture_id order by round(raw - floor(raw), 9) desc, source_id) as r from e),
      alloc as (select mixture_id, source_id, weight, base + case when r <= {target} - sum(base) over (partition by mixture_id) then 1 else 0 end as n from f)"""


@relational("i1_largest_remainder")
def i1(d):
    """A hundred thousand tokens over each mixture's sources by largest remainder."""
    return f"with {allocation(d, 100000)} select mixture_id, source_id, {d.int('n')} as tokens from alloc"


@relational("i2_sampling_plan")
def i2(d):
    """Documents asked of each source of a mixture of 5,000, and whether some must repeat."""
    return f"""with {allocation(d, 5000)}, a as (select source, count(*) as have from @documents group by 1)
      select mixture_id, source_id, {d.int('n')} as asked, coalesce(have, 0) as available, n > coalesce(have, 0) as with_replacement from alloc left join a on alloc.source_id = a.source"""


def schedule(d):
    """Records of each mixture: whole passes of a source in hash order, then one global hash order."""
    return f"""{allocation(d, 2000)}, pool as (select source, doc_id, count(*) over (partition by source) as have from @documents),
      need as (select mixture_id, source_id, n, have from alloc join (select source, count(*) as have from @documents group by 1) h on alloc.source_id = h.source where n > 0),
      ep as (select mixture_id, source_id, n, have, {d.explode(d.seq('0', d.int('ceil(n / cast(have as double))') + ' - 1'))} as epoch from need),
      pick as (select ep.mixture_id, ep.source_id, epoch, doc_id, n, row_number() over (partition by ep.mixture_id, ep.source_id order by epoch, {rank_key(d, 'ep.source_id', 'epoch', 'doc_id')}) as local from ep join pool on ep.source_id = pool.source),
      sched as (select mixture_id, source_id, doc_id, epoch, local, cast(row_number() over (partition by mixture_id, substr(hk, 1, 2) order by hk, source_id, local) + before as bigint) as seq from
        (select p.*, o.before from (select *, substr(hk, 1, 2) as hb from (select *, {rank_key(d, 'mixture_id', 'source_id', 'local')} as hk from pick where local <= n) k) p
          join (select mixture_id, hb, sum(c) over (partition by mixture_id order by hb) - c as before from (select mixture_id, substr({rank_key(d, 'mixture_id', 'source_id', 'local')}, 1, 2) as hb, count(*) as c from pick where local <= n group by 1, 2) g) o on p.mixture_id = o.mixture_id and p.hb = o.hb) z)"""


@relational("i5_schedule")
def i5(d):
    return f"with {schedule(d)} select mixture_id, seq, source_id, doc_id, {d.int('epoch')} as epoch from sched"


@relational("i6_replay_metrics")
def i6(d):
    """Reuse of each source's documents in the schedules; documents never used count."""
    return f"""with {schedule(d)}, u as (select mixture_id, source_id, doc_id, count(*) as c from sched group by 1, 2, 3),
      full_ as (select need.mixture_id, need.source_id, pool.doc_id, coalesce(u.c, 0) as c from need join pool on need.source_id = pool.source left join u on u.mixture_id = need.mixture_id and u.source_id = need.source_id and u.doc_id = pool.doc_id)
      select mixture_id, source_id, round(avg(cast(c as double)), 6) as mean_reuse, min(c) as minimum_reuse, max(c) as maximum_reuse, round(sum(case when c > 0 then cast(1 as double) else cast(0 as double) end) / count(*), 6) as coverage,
        case when avg(cast(c as double)) > 4 then 'hard_limit' when avg(cast(c as double)) > 2 then 'warning' else 'pass' end as status from full_ group by 1, 2"""


@relational("i7_source_cursor")
def i7(d):
    """The record that each place of a schedule takes: its source's places so far."""
    return f"with {schedule(d)} select mixture_id, seq, source_id, cast(row_number() over (partition by mixture_id, source_id order by seq) - 1 as bigint) as record_index from sched"


@relational("m2_progress_checks")
def m2(d):
    """Violations in the sources' checkpoints."""
    return """with x as (select distinct source_id, source_sha256, next_line, processed, rejected, duplicate_hashes, complete, updated_at from @source_progress)
      select 'stale_checkpoint' as check_name, source_id as item from x group by source_id having count(*) > 1
      union all select distinct 'counts_do_not_close', source_id from x where processed + rejected <> next_line
      union all select distinct 'complete_without_hash', source_id from x where complete = 1 and source_sha256 is null
      union all select distinct 'no_items', source_id from x where not exists (select 1 from @fingerprints f where f.source_id = x.source_id)"""


# Token records.


@relational("a3_point_read")
def a3(d):
    """Documents that stand in records' row references."""
    return f"with r as (select distinct {d.int('cast(' + d.one('stable_row_reference', '[0-9]+$') + ' as int)')} as id from @retrieved_source_records where stable_row_reference is not null) select doc_id, n_chars from @documents where doc_id in (select id from r)"


@relational("a7_hash_union")
def a7(d):
    """All valid hashes of three tables, lower case, with the tables that have them."""
    ok = lambda c: d.like(c, "^[0-9a-fA-F]{64}$")
    return f"""with h as (select lower(fingerprint) as h, 'fingerprints' as t from @fingerprints where {ok('fingerprint')} union select lower(text_sha256), 'base_text_chunks' from @base_text_chunks where {ok('text_sha256')}
      union select lower(source_sha256), 'source_progress' from @source_progress where {ok('source_sha256')}) select h as sha256, count(*) as tables from h group by 1"""


@relational("a8_stride_records")
def a8(d):
    """Token records of 16 at stride 16, as input and target sums."""
    last = d.int(f"floor(({d.size('token_ids')} - 17) / 16.0)")
    idx = "cast(i * 16 + 1 as int)" if d.spark else "i * 16 + 1"
    idy = "cast(i * 16 + 2 as int)" if d.spark else "i * 16 + 2"
    return f"""with r as (select chunk_id, token_ids, {d.explode(d.seq('0', last))} as i from {CH} x where {d.size('token_ids')} >= 17)
      select chunk_id, {d.int('i')} as i, {d.sum_of(d.part('token_ids', idx, 16))} as x_sum, {d.sum_of(d.part('token_ids', idy, 16))} as y_sum from r"""


def ranges(d):
    return f"r as (select source_id, chunk_id, {d.size('token_ids')} as n, sum({d.size('token_ids')}) over (partition by source_id order by chunk_id rows between unbounded preceding and current row) as hi from {CH} x where token_ids is not null), rg as (select source_id, chunk_id, hi - n as lo, hi from r)"


@relational("a9_logical_reader")
def a9(d):
    """The chunk and place of every 512th logical token of each source; offsets meet their range by a block of 512."""
    return f"""with {ranges(d)}, o as (select source_id, chunk_id, lo, hi, {d.explode(d.seq(d.int('ceil(lo / 512.0)'), d.int('ceil(hi / 512.0)') + ' - 1'))} as b from rg where ceil(lo / 512.0) < ceil(hi / 512.0))
      select source_id, {d.int('b * 512')} as logical, chunk_id, {d.int('b * 512 - lo')} as place from o"""


@relational("a10_masked_targets")
def a10(d):
    """Supervised targets of each chunk: the mask without its first place."""
    n = d.size("stored_mask")
    part = d.part("stored_mask", "2", f"greatest(cast({n} as int) - 1, 0)" if d.spark else f"greatest({n} - 1, 0)")
    return f"select chunk_id, {d.sum_of(d.map(part, 'm', d.int('m')))} as targets from {CH} x where stored_mask is not null"


@relational("e12_shard_check")
def e12(d):
    """Token counts and id range of each source, and whether ids fit the vocabulary of 32,000."""
    return f"with t as (select source_id, {d.explode('token_ids')} as t from {CH} x where token_ids is not null) select source_id, count(*) as tokens, {d.int('min(t)')} as lowest, {d.int('max(t)')} as highest, max(t) < 32000 as fits from t group by 1"


@relational("j10_record_invariants")
def j10(d):
    """Chunks that break a rule: mask and tokens of different length, or a mask that isn't binary."""
    return f"""select chunk_id, {d.size('token_ids')} <> {d.size('stored_mask')} as length_differs, {d.size(d.keep('stored_mask', 'm', 'm not in (0, 1)'))} as not_binary from {CH} x
      where token_ids is not null and stored_mask is not null and ({d.size('token_ids')} <> {d.size('stored_mask')} or {d.size(d.keep('stored_mask', 'm', 'm not in (0, 1)'))} > 0)"""


@relational("j12_lineage_checks")
def j12(d):
    """Counts of broken lineage: repeated texts, parents in several splits, revisions that drift."""
    return f"""select 'repeated_text' as check_name, count(*) as n from (select text_sha256 from {CH} x where text_sha256 is not null group by 1 having count(*) > 1) a
      union all select 'parent_across_splits', count(*) from (select document_id from {CH} x where split is not null group by 1 having count(distinct split) > 1) b
      union all select 'revision_drift', count(*) from (select source_id from @base_text_chunks group by 1 having count(distinct source_revision) > 1) c"""


@relational("j13_split_isolation")
def j13(d):
    """Instructions (as matched) that stand in training and in another split."""
    h = d.sha(norm(d, "instruction"))
    return f"""with x as (select distinct split, {h} as h from {EX} e where instruction is not null and split is not null)
      select o.split, count(*) as shared from x t join x o on t.h = o.h and t.split = 'train' and o.split <> 'train' group by 1"""


@relational("j16_supervised_spans")
def j16(d):
    """Runs of supervised places of each chunk: how many, and the longest."""
    pos = f"select chunk_id, posexplode(stored_mask) as (p, m) from {CH} x where stored_mask is not null" if d.spark else f"select chunk_id, unnest(range(len(stored_mask))) as p, unnest(stored_mask) as m from {CH.replace('@', '')} x where stored_mask is not null"
    return f"""with x as ({pos}), y as (select chunk_id, p, m, p - row_number() over (partition by chunk_id, m order by p) as g from x where p > 0), z as (select chunk_id, g, count(*) as n from y where m = 1 group by 1, 2)
      select chunk_id, count(*) as spans, max(n) as longest from z group by 1"""


@relational("j1_prompt_templates")
def j1(d):
    """Hash of each example's prompt in the conversation form."""
    t = "'User: ' || instruction || case when input is null or trim(input) = '' then '' else chr(10) || input end || chr(10) || 'Assistant:'"
    return f"select example_id, {d.sha(t)} as sha256 from {EX} x where instruction is not null"


@relational("j3_encode_reasons")
def j3(d):
    """Why examples can't be encoded: missing fields, or reserved markers in them."""
    bad = d.like("coalesce(instruction, '') || coalesce(response, '')", r"\[(?:EOS|BOS|PAD)\]|(?:User|Assistant):")
    return f"select case when instruction is null or trim(instruction) = '' then 'missing_instruction' when response is null or trim(response) = '' then 'missing_response' when {bad} then 'reserved_marker' else 'ok' end as reason, count(*) as n from {EX} x group by 1"


@relational("j4_dialogue_turns")
def j4(d):
    """Dialogues of the documents: their turns, and whether roles alternate from user to assistant."""
    src = "select doc_id, text from @documents where text like '%User:%' or text like '%Assistant:%'"
    pos = f"select doc_id, posexplode(split(text, '\\n')) as (p, l) from ({src})" if d.spark else f"select doc_id, unnest(range(len(string_split(text, chr(10))))) as p, unnest(string_split(text, chr(10))) as l from ({src.replace('@', '')})"
    return f"""with x as ({pos}), t as (select doc_id, p, case when l like 'User:%' then 'user' when l like 'Assistant:%' then 'assistant' end as role from x),
      y as (select doc_id, role, row_number() over (partition by doc_id order by p) as r, count(*) over (partition by doc_id) as n from t where role is not null)
      select doc_id, max(n) as turns, max(n) % 2 = 0 and min(case when role = case when r % 2 = 1 then 'user' else 'assistant' end then 1 else 0 end) = 1 as alternates from y group by 1"""
