"""Queries on draws, schedules and manifests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from .dialect import ranked_by_hash, relational
from .registry import query
from .select_queries import EX, M, allocation, rank_key, schedule

DRAWS, SEED = 1000, 7


@query("i3_twister_draws")
def i3_twister(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand weighted draws of each mixture's sources by a seeded Mersenne twister; as many rows as draws, made at once."""
    rows = spark.read.parquet(f"{sf}/mixture_sources.parquet").groupBy("mixture_id", "source_id").sum("weight").orderBy("mixture_id", "source_id").collect()  # a configuration table of a few dozen rows
    out = []
    for m in sorted({r[0] for r in rows if r[0] is not None}):
        own = [(r[1], r[2] or 0.0) for r in rows if r[0] == m]
        if any(w > 0 for _, w in own):
            out += [(m, i, s) for i, s in enumerate(random.Random(SEED).choices([s for s, _ in own], [w for _, w in own], k=DRAWS))]
    return spark.createDataFrame(out, "mixture_id string, draw long, source_id string")


def draws(d):
    return f"""w as (select mixture_id, source_id, sum(weight) over (partition by mixture_id order by source_id rows between unbounded preceding and current row) as hi, weight, sum(weight) over (partition by mixture_id) as total from {M} x where weight > 0),
      n as (select m.mixture_id, i from (select distinct mixture_id from w) m cross join (select {d.explode(d.seq('0', str(DRAWS - 1)))} as i) t),
      u as (select mixture_id, i, cast({d.hex_int('substr(' + rank_key(d, 'mixture_id', 'i') + ', 1, 8)')} as double) / 4294967296.0 as u from n)"""


@relational("i3_weighted_draws")
def i3(d):
    """A thousand weighted draws of each mixture's sources: a uniform number by hash falls into a source's range of cumulative weight."""
    return f"with {draws(d)} select u.mixture_id, {d.int('i')} as draw, w.source_id from u join w on u.mixture_id = w.mixture_id and u.u * w.total >= w.hi - w.weight and u.u * w.total < w.hi"


@relational("i4_counted_schedule")
def i4(d):
    """A schedule of two thousand places that holds each source exactly as often as it is due, in hash order; the place is counted within the hash's first digits and offset."""
    k = rank_key(d, "mixture_id", "source_id", "k")
    return f"""with {allocation(d, 2000)}, each as (select mixture_id, source_id, {d.explode(d.seq("1", d.int("n")))} as k from alloc where n > 0), h as (select mixture_id, source_id, k, {k} as hk from each),
      c as (select mixture_id, substr(hk, 1, 2) as hb, count(*) as c from h group by 1, 2), o as (select mixture_id, hb, sum(c) over (partition by mixture_id order by hb) - c as before from c)
      select h.mixture_id, {d.int('row_number() over (partition by h.mixture_id, o.hb order by hk) + before')} as seq, source_id from h join o on h.mixture_id = o.mixture_id and substr(h.hk, 1, 2) = o.hb"""


# Shares of the difficulties in each stage of the curriculum.
STAGES = ((1, "easy", 0.6), (1, "medium", 0.3), (1, "hard", 0.1), (2, "easy", 0.3), (2, "medium", 0.4), (2, "hard", 0.3), (3, "easy", 0.1), (3, "medium", 0.3), (3, "hard", 0.6))
PER_STAGE = 210


@relational("i8_curriculum_schedule")
def i8(d):
    """Examples of each stage, capability and difficulty by quota: first over capabilities, then over difficulties by largest remainder; each pool in an order of its own for the stage, from the start again where it is short. What no pool can give is left to the last stage."""
    values = d.values(", ".join(f"({a}, '{b}', {c}e0)" for a, b, c in STAGES), "stage, difficulty, share")
    return f"""with st as {values}, ex as (select example_id, capability, difficulty from {EX} x where difficulty is not null and split = 'train'), caps as (select capability, row_number() over (order by capability) as cr, count(*) over () as cn from (select distinct capability from ex) a),
      q1 as (select stage, capability, {d.int(f'floor({PER_STAGE} / cast(cn as double))')} + case when cr <= {PER_STAGE} - cn * {d.int(f'floor({PER_STAGE} / cast(cn as double))')} then 1 else 0 end as n from caps cross join (select distinct stage from st) s),
      e as (select q1.stage, q1.capability, st.difficulty, q1.n, q1.n * share as exact from q1 join st on q1.stage = st.stage),
      f as (select *, {d.int('floor(exact)')} as base, row_number() over (partition by stage, capability order by round(exact - floor(exact), 9) desc, difficulty) as r from e),
      q as (select stage, capability, difficulty, base + case when r <= n - sum(base) over (partition by stage, capability) then 1 else 0 end as quota from f),
      pool as (select s.stage, x.capability, x.difficulty, example_id, row_number() over (partition by s.stage, x.capability, x.difficulty order by {rank_key(d, 's.stage', 'example_id')}, example_id) as r, count(*) over (partition by s.stage, x.capability, x.difficulty) as have from ex x cross join (select distinct stage from st) s),
      k as (select stage, capability, difficulty, {d.explode(d.seq('1', d.int('quota')))} as k from q where quota > 0)
      select k.stage, k.capability, k.difficulty, {d.int('k.k')} as k, p.example_id, {d.int('floor((k.k - 1) / cast(p.have as double))')} as epoch from k join pool p on k.stage = p.stage and k.capability = p.capability and k.difficulty = p.difficulty and p.r = (k.k - 1) % p.have + 1"""


@relational("i10_paired_arms")
def i10(d):
    """Every two mixtures compared: sources whose share differs or that only one has, and whether their budgets agree."""
    return f"""with m as (select mixture_id, source_id, weight, sum(weight) over (partition by mixture_id) as total from {M} x), p as (select distinct a.mixture_id as l, b.mixture_id as r from {M} a join {M} b on a.mixture_id < b.mixture_id),
      s as (select p.l, p.r, m.source_id, m.weight / m.total as lw, cast(null as double) as rw, m.total as lt, cast(null as double) as rt from p join m on m.mixture_id = p.l union all select p.l, p.r, m.source_id, null, m.weight / m.total, null, m.total from p join m on m.mixture_id = p.r)
      select l as left_id, r as right_id, source_id, max(lw) is null as only_right, max(rw) is null as only_left, round(coalesce(max(rw), 0.0) - coalesce(max(lw), 0.0), 6) as difference, coalesce(round(max(lt), 6) = round(max(rt), 6), false) as same_budget from s group by 1, 2, 3
      having max(lw) is null or max(rw) is null or abs(max(rw) - max(lw)) > 0.0000005"""


@relational("i12_resolved_records")
def i12(d):
    """Where each place of a schedule lies in its source's tokens: offset plus record times stride; sources without a mask have all of a record supervised."""
    return f"""with {schedule(d)}, o as (select source_id, sum(n) as tokens, max(masked) as masked from (select distinct chunk_id, source_id, {d.size('token_ids')} as n, case when stored_mask is null then 0 else 1 end as masked from @base_text_chunks where token_ids is not null) x group by 1)
      select s.mixture_id, s.seq, s.source_id, {d.int('1000 + (s.local - 1) * 256')} as start_token, {d.int('257')} as length, coalesce(o.masked, 0) = 0 as all_supervised from sched s left join o on s.source_id = o.source_id"""


@relational("i11_schedule_checks")
def i11(d):
    """Checks of each schedule: known sources, counts as allotted, record numbers within what is there, places 1..n."""
    return f"""with {schedule(d)}, a as (select mixture_id, source_id, count(*) as got, max(local) as last, count(distinct doc_id) as docs from sched group by 1, 2), t as (select mixture_id, max(seq) = count(*) and count(distinct seq) = count(*) and min(seq) = 1 as dense, count(*) as total from sched group by 1)
      select need.mixture_id, need.source_id, need.n = coalesce(a.got, 0) as count_matches, coalesce(a.last, 0) <= need.n as index_within, coalesce(a.docs, 0) <= need.have as docs_within, t.dense, t.total from need left join a on need.mixture_id = a.mixture_id and need.source_id = a.source_id join t on t.mixture_id = need.mixture_id"""


def checks(*parts):
    """One table of violations: (check_name, item)."""
    return " union all ".join(f"select '{n}' as check_name, cast({i} as varchar(200)) as item from {r}" for n, i, r in parts)


@relational("m1_mixture_checks")
def m1(d):
    """Violations in the mixtures: identity, weights, repeats, domains, licences, sources that are listed twice or have no documents, weight sums."""
    key = "coalesce(mixture_id, '?') || '/' || coalesce(source_id, '?')"
    return checks(
        ("identity_missing", key, "@mixture_sources where mixture_id is null or source_id is null or trim(source_id) = ''"), ("weight_not_positive", key, "@mixture_sources where weight is null or weight <= 0"), ("repeats_not_positive", key, "@mixture_sources where max_repeats is null or max_repeats < 1"),
        ("domain_missing", key, "@mixture_sources where domain is null"), ("licence_missing", key, "@mixture_sources where license is null"), ("source_id_malformed", key, f"@mixture_sources where not {d.like('source_id', '^[a-z0-9_]+$')}"),
        ("listed_twice", key, "(select mixture_id, source_id from @mixture_sources group by 1, 2 having count(*) > 1) x"), ("source_without_documents", key, "@mixture_sources m where not exists (select 1 from @documents d where d.source = m.source_id)"),
        ("weights_not_one", "mixture_id", "(select mixture_id from @mixture_sources group by mixture_id having abs(sum(weight) - 1.0) > 0.000001) x"), ("single_source", "mixture_id", "(select mixture_id from @mixture_sources group by mixture_id having count(distinct source_id) < 2) x"))


@relational("m3_source_registry")
def m3(d):
    """The registry of sources against what refers to them: unknown ones, several licences or domains, checkpoints and documents without an entry."""
    reg = "(select distinct source_id from @mixture_sources where source_id is not null)"
    return checks(
        ("several_licences", "source_id", "(select source_id from @mixture_sources group by 1 having count(distinct license) > 1) x"), ("several_domains", "source_id", "(select source_id from @mixture_sources group by 1 having count(distinct domain) > 1) x"),
        ("documents_without_entry", "source", f"(select distinct source from @documents where source is not null and source not in (select source_id from {reg} r)) x"),
        ("entry_without_documents", "source_id", f"{reg} x where source_id not in (select source from @documents where source is not null)"),
        ("checkpoint_hash_malformed", "source_id", f"(select distinct source_id from @source_progress where source_sha256 is not null and not {d.like('source_sha256', '^[0-9a-f]{64}$')}) x"),
        ("item_of_unknown_source", "source_id", "(select distinct source_id from @fingerprints where source_id is not null and lower(trim(source_id)) not in (select source_id from @source_progress)) x"))


@relational("m4_scheduled_sources")
def m4(d):
    """Sources of a schedule: none allotted, fewer documents than repeats allow, more places than documents at four repeats."""
    return f"with {allocation(d, 2000)}, h as (select source, count(*) as have from @documents group by 1), x as (select a.mixture_id, a.source_id, a.n, coalesce(h.have, 0) as have, m.max_repeats from alloc a join {M} m on a.mixture_id = m.mixture_id and a.source_id = m.source_id left join h on a.source_id = h.source) " + checks(
        ("zero_allocation", "mixture_id || '/' || source_id", "x where n = 0"), ("beyond_repeats", "mixture_id || '/' || source_id", "x where n > have * max_repeats"), ("no_records", "mixture_id || '/' || source_id", "x where have = 0"))


@relational("m5_prepared_output")
def m5(d):
    """Prepared chunks validated again: numbers dense, counts, boundaries, overlaps, empty or repeated texts of a parent."""
    c = "(select distinct chunk_id, parent_document_id, chunk_index, text, token_count, boundary_start_type, boundary_end_type, overlap_characters from @text_chunks where chunk_id is not null)"
    kinds = "('section', 'paragraph', 'sentence', 'word_fallback', 'token_fallback')"
    return checks(
        ("empty_text", "chunk_id", f"{c} x where text is null or trim(text) = ''"), ("token_count_missing", "chunk_id", f"{c} x where token_count is null"), ("token_count_not_positive", "chunk_id", f"{c} x where token_count <= 0"),
        ("unknown_boundary", "chunk_id", f"{c} x where boundary_start_type not in {kinds} or boundary_end_type not in {kinds}"), ("overlap_beyond_text", "chunk_id", f"{c} x where overlap_characters > length(text) or overlap_characters < 0"),
        ("first_chunk_overlaps", "chunk_id", f"{c} x where chunk_index = 0 and overlap_characters > 0"), ("numbers_not_dense", "parent_document_id", f"(select parent_document_id from {c} x group by 1 having max(chunk_index) <> count(distinct chunk_index) - 1 or min(chunk_index) <> 0) y"),
        ("number_repeats", "parent_document_id", f"(select parent_document_id from {c} x group by parent_document_id, chunk_index having count(distinct chunk_id) > 1) y"))


@relational("m6_logical_manifest")
def m6(d):
    """The logical token ranges of each source: gaps, overlaps, empty shards, and the total."""
    return f"""with s as (select source_id, chunk_id, max({d.size('token_ids')}) as n from @base_text_chunks where token_ids is not null and source_id is not null group by 1, 2),
      b as (select source_id, substr({rank_key(d, 'chunk_id')}, 1, 2) as shard, sum(n) as n, count(*) as chunks from s group by 1, 2), r as (select source_id, shard, n, chunks, sum(n) over (partition by source_id order by shard) - n as lo, sum(n) over (partition by source_id order by shard) as hi from b),
      g as (select *, lag(hi) over (partition by source_id order by shard) as before from r)
      select source_id, count(*) as shards, cast(sum(n) as bigint) as tokens, cast(max(hi) as bigint) as logical_end, {d.int('sum(case when before is not null and lo > before then 1 else 0 end)')} as gaps, {d.int('sum(case when before is not null and lo < before then 1 else 0 end)')} as overlaps, {d.int('sum(case when n = 0 then 1 else 0 end)')} as empty_shards from g group by 1"""


@relational("m7_admission")
def m7(d):
    """Sources for admission: structure, bindings to checkpoint and registry, review of their items, exclusions; each with the reasons against it."""
    r = d.struct_list("case when p.source_id is null then 'no_checkpoint' end", "case when p.complete = 0 then 'incomplete' end", "case when p.hash is null then 'no_hash' end", "case when m.license is null then 'no_licence' end", "case when f.invalid > 0 then 'invalid_fingerprints' end", "case when f.missing * 10 > f.n then 'texts_not_kept' end")
    return f"""with s as (select distinct lower(trim(source_id)) as source_id from @fingerprints where source_id is not null union select source_id from @source_progress where source_id is not null),
      p as (select source_id, max(complete) as complete, max(source_sha256) as hash from @source_progress group by 1), m as (select source_id, max(license) as license from @mixture_sources group by 1),
      f as (select lower(trim(source_id)) as source_id, count(distinct item_id) as n, {d.int("sum(case when fingerprint is not null and not " + d.like('fingerprint', '^[0-9a-fA-F]{64}$') + " then 1 else 0 end)")} as invalid, {d.int('sum(case when item_text is null then 1 else 0 end)')} as missing from @fingerprints group by 1)
      select s.source_id, coalesce(f.n, 0) as items, {d.join(d.keep(r, 'z', 'z is not null'), ',')} as reasons, {d.size(d.keep(r, 'z', 'z is not null'))} = 0 as admitted from s left join p on s.source_id = p.source_id left join m on s.source_id = m.source_id left join f on s.source_id = f.source_id"""


@relational("m8_release_chain")
def m8(d):
    """The chain of a release over the examples: valid in form, reviewed, not repeated, not held by a prompt, kept; what each step leaves."""
    from .check_queries import validated
    from .dialect import norm
    h = lambda x: d.sha(norm(d, x))
    return f"""with {validated(d)}, bad as (select distinct example_id from f where code in ('empty_instruction', 'empty_response', 'control_character', 'placeholder_text', 'duplicate_example_id')),
      e as (select example_id, min(instruction) as instruction, min(quality.review_status) as status from @instruction_examples where example_id is not null group by 1),
      s1 as (select e.* from e where not exists (select 1 from bad where bad.example_id = e.example_id)), s2 as (select * from s1 where status is not null and status <> 'unreviewed'),
      s3 as (select example_id, instruction, {h('instruction')} as h, row_number() over (partition by {h('instruction')} order by example_id) as r from s2), s4 as (select * from s3 where r = 1), s5 as (select * from s4 where h not in (select {h('prompt')} from @prompts where prompt is not null))
      select 'all' as step, count(*) as n from e union all select 'valid', count(*) from s1 union all select 'reviewed', count(*) from s2 union all select 'first_of_text', count(*) from s4 union all select 'not_a_prompt', count(*) from s5"""
