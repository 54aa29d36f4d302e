"""Queries on validation, scores, statistics and comparisons."""

from __future__ import annotations

from .dialect import grams, relational, words, ws
from .select_queries import EX
from .text_queries import gate

@relational("k3_duplicate_ids")
def k3(d):
    """Ids that stand in more than one row, and whether the rows differ in content."""
    return "select example_id, count(*) as n, count(distinct coalesce(instruction, '') || chr(10) || coalesce(response, '')) > 1 as differ from @instruction_examples group by 1 having count(*) > 1"


@relational("k6_distribution_report")
def k6(d):
    """Share of each capability against an even share."""
    return f"select capability, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as actual, round(cast(1 as double) / count(*) over (), 6) as target from {EX} x group by 1"


@relational("k10_repetition_metrics")
def k10(d):
    """Shares of repeated one-, two- and three-word runs, and of repeated sentences."""
    def share(x):
        return d.let(x, "rg", f"case when {d.size('rg')} = 0 then 0.0 else round(1.0 - cast({d.size(d.distinct('rg'))} as double) / {d.size('rg')}, 6) end")

    w = words(d, "lower(text)")
    s = d.keep(d.map(d.split(d.sub("text", r"[.!?]+", "\x01"), "\x01"), "z", ws(d, "z")), "z", "z <> ''")
    return f"select doc_id, {share(w)} as unigrams, {share(grams(d, w, 2, ' '))} as bigrams, {share(grams(d, w, 3, ' '))} as trigrams, {share(s)} as sentences from @documents"


@relational("k13_corpus_distinct_n")
def k13(d):
    """Share of different two-word runs over all responses of a capability; runs don't cross responses."""
    return f"with g as (select capability, {d.explode(grams(d, words(d, 'lower(response)'), 2, ' '))} as g from {EX} x where response is not null) select capability, round(count(distinct g) / cast(count(*) as double), 6) as distinct_2 from g group by 1"


@relational("k14_choice_ranking")
def k14(d):
    """Best source of each mixture by raw and by length-normalized weight, with margins; ties give none."""
    return f"""with x as (select mixture_id, source_id, weight, weight / length(source_id) as nw from @mixture_sources), r as (select mixture_id, source_id, row_number() over (partition by mixture_id order by weight desc, source_id) as a, row_number() over (partition by mixture_id order by nw desc, source_id) as b,
        weight - lead(weight) over (partition by mixture_id order by weight desc, source_id) as raw_margin, nw - lead(nw) over (partition by mixture_id order by nw desc, source_id) as norm_margin from x)
      select mixture_id, max(case when a = 1 and raw_margin > 0 then source_id end) as raw_best, max(case when b = 1 and norm_margin > 0 then source_id end) as normalized_best, round(max(case when a = 1 then raw_margin end), 6) as raw_margin, round(max(case when b = 1 then norm_margin end), 6) as normalized_margin from r group by 1"""


@relational("k16_arithmetic_outcomes")
def k16(d):
    """Outcomes of the worked sums in the documents: the stated result against the recomputed one."""
    hit = d.all("text", r"\b[0-9]{1,6} [+×] [0-9]{1,6} = [0-9]{1,12}\b")
    num = lambda i: d.int(d.at(d.split("q", " "), i))
    return f"""with s as (select doc_id, {d.explode(hit)} as q from @documents where text is not null), v as (select {d.at(d.split('q', ' '), 2)} as op, {num(1)} as a, {num(3)} as b, {num(5)} as c from s)
      select op, case when c = case when op = '+' then a + b else a * b end then 'correct' else 'incorrect' end as outcome, count(*) as n from v group by 1, 2"""


@relational("k17_token_repetition")
def k17(d):
    """Share of repeated token bigrams of each chunk, and whether it ends in three equal bigrams."""
    n = d.size("token_ids")
    at = lambda i: d.at("token_ids", f"cast({n} - {i} as int)" if d.spark else f"{n} - {i}")
    g = d.map(d.seq("1", d.int(f"greatest({n} - 1, 1)")), "i", f"cast({d.at('token_ids', 'cast(i as int)' if d.spark else 'i')} as bigint) * 100000 + {d.at('token_ids', 'cast(i + 1 as int)' if d.spark else 'i + 1')}")
    return f"""with c as (select distinct chunk_id, token_ids from @base_text_chunks where {n} >= 6)
      select chunk_id, round(1.0 - cast({d.size(d.distinct(g))} as double) / ({n} - 1), 6) as repetition, {at(0)} = {at(2)} and {at(2)} = {at(4)} and {at(1)} = {at(3)} and {at(3)} = {at(5)} as terminal_loop from c"""


@relational("k24_style_indicators")
def k24(d):
    pats = {"heading": r"(?m)^#+ |^[A-Z][a-z]+:$", "citation": r"\[\d+\]|\(\d{4}\)", "article_lead": r"^(?:The|A|An) [a-z]+ "}
    cols = ", ".join(f"{d.int(f'sum(case when {d.like(chr(116) + chr(101) + chr(120) + chr(116), p)} then 1 else 0 end)')} as {k}" for k, p in pats.items())
    return f"select source, count(*) as n, {cols} from @documents where text is not null group by 1"


@relational("k25_malformed_spacing")
def k25(d):
    return f"select distinct record_id, {d.size(d.all('text', ' +[,.;:!?]|[a-z][.!?][A-Z]'))} as places from @retrieved_source_records where text is not null and {d.like('text', ' +[,.;:!?]|[a-z][.!?][A-Z]')}"


@relational("l2_diversity")
def l2(d):
    """Parents, chunks and sizes of each source's chunks."""
    return f"""with c as (select distinct chunk_id, parent_document_id, source_id, length(text) as n from @text_chunks where text is not null), p as (select source_id, parent_document_id, count(*) as k from c group by 1, 2), m as (select source_id, max(k) as most from p group by 1)
      select c.source_id, count(*) as chunks, count(distinct parent_document_id) as parents, cast(min(n) as bigint) as shortest, cast(max(n) as bigint) as longest, round(avg(n), 6) as mean, round(median(n), 6) as median, max(most) as most_of_a_parent from c left join m on c.source_id = m.source_id group by 1"""


@relational("l3_ratios")
def l3(d):
    return f"select source, count(*) as n, round(sum(length(text)) / cast(greatest(sum({d.size(words(d, 'text'))}), 1) as double), 6) as chars_per_word, round(sum({d.size(words(d, 'text'))}) / cast(count(*) as double), 6) as words_per_doc from @documents where text is not null group by 1"


@relational("l4_category_means")
def l4(d):
    return f"select capability, count(*) as n, round(avg(length(response)), 6) as mean_chars, round(avg({d.size(words(d, 'response'))}), 6) as mean_words from {EX} x where response is not null group by 1"


@relational("l5_grouping_sets")
def l5(d):
    """Means over all, by capability, language, difficulty and split."""
    return f"""select coalesce(capability, 'all') as capability, coalesce(language, 'all') as language, coalesce(difficulty, 'all') as difficulty, coalesce(split, 'all') as split, count(*) as n, round(avg(length(response)), 6) as mean_chars
      from {EX} x where language is not null and difficulty is not null and split is not null and response is not null group by grouping sets ((), (capability), (language), (difficulty), (split))"""


@relational("l10_paired_runs")
def l10(d):
    """Chunks of two tables' sources compared: counts and difference, with sources that only one has."""
    return "with a as (select source_id, count(distinct chunk_id) as n from @text_chunks group by 1), b as (select source_id, count(distinct chunk_id) as n from @base_text_chunks group by 1) select coalesce(a.source_id, b.source_id) as source_id, coalesce(a.n, 0) as left_n, coalesce(b.n, 0) as right_n, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full outer join b on a.source_id = b.source_id"


@relational("l12_promotion_gates")
def l12(d):
    """Test against training by capability: whether mean length stays within a twentieth."""
    return f"""with m as (select capability, avg(case when split = 'train' then length(response) end) as a, avg(case when split = 'test' then length(response) end) as b from {EX} x group by 1)
      select capability, round(b / a - 1.0, 6) as delta, coalesce(abs(b / a - 1.0) <= 0.05, false) as passes from m"""


@relational("l13_seed_statistics")
def l13(d):
    """Mean, extremes and deviation of event values by type."""
    return "select event_type, count(*) as n, round(avg(value), 4) as mean, min(value) as lowest, max(value) as highest, round(stddev_pop(value), 4) as deviation from @events group by 1"


@relational("l15_distributions")
def l15(d):
    return "with x as (select distinct example_id, schema_version, format_constraints.type as kind, answer_style from @instruction_examples) select schema_version, kind, answer_style, count(*) as n from x group by 1, 2, 3"


@relational("l17_recovery_classes")
def l17(d):
    """Whether the stated fingerprint is the hash of the kept text."""
    t = d.sub("item_text", r"^\s+|\s+$", "")
    return f"""with x as (select distinct item_id, fingerprint, item_text from @fingerprints)
      select case when item_text is null then 'not_found' when fingerprint is null or not {d.like('fingerprint', '^[0-9a-fA-F]{64}$')} then 'malformed' when lower(fingerprint) = {d.sha(t)} then 'exact' else 'mismatch' end as class, count(*) as n from x group by 1"""


@relational("l18_reconciliation")
def l18(d):
    """Items of each source against its checkpoint; sources that only one side has."""
    return "with a as (select source_id, count(distinct item_id) as items from @fingerprints where source_id is not null group by 1), b as (select source_id, max(processed) as processed from @source_progress group by 1) select coalesce(a.source_id, b.source_id) as source_id, coalesce(items, 0) as items, coalesce(processed, 0) as processed, a.source_id is null as no_items, b.source_id is null as no_checkpoint from a full outer join b on a.source_id = b.source_id"


@relational("l19_projection")
def l19(d):
    """Requests and seconds that a batched lookup of all items would take at four requests a second."""
    return f"with n as (select count(distinct item_id) as n from @fingerprints), b as (select {d.explode('array(1, 5, 10, 25)' if d.spark else '[1, 5, 10, 25]')} as size) select {d.int('size')} as size, {d.int('ceil(n / cast(size as double))')} as requests, round(cast(ceil(n / cast(size as double)) as double) / cast(4 as double), 6) as seconds from b, n"


@relational("l23_review_summary")
def l23(d):
    """Reasons of the document filter over a fixed list, with those that never occur."""
    rs = "('accepted', 'empty_text', 'missing_identity', 'non_english', 'redirect', 'disambiguation', 'too_short', 'too_long')"
    items = "explode(array" + rs + ")" if d.spark else "unnest([" + rs[1:-1] + "])"
    return f"{gate(d)}, r as (select {items} as reason) select r.reason, count(g.doc_id) as n from r left join gated g on coalesce(g.reason, 'accepted') = r.reason group by 1"
