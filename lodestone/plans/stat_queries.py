"""Queries on summaries, intervals and comparisons."""

from __future__ import annotations

from .dialect import fold, relational, words
from .select_queries import EX, rank_key

SAMPLES = 48


def resamples(d, rows, group, value, key):
    """b: group, s and the mean of each of SAMPLES Poisson resamples of the rows; a row's weights come from hashes of its id, so they don't depend on partitions, and each group is summed before it is shuffled."""
    hashes = [rank_key(d, f"'{i}'", key) for i in range(SAMPLES // 8)]
    u = lambda i: f"{d.hex_int(f'substr({hashes[i // 8]}, {8 * (i % 8) + 1}, 8)')}"
    # The cumulative probabilities of a Poisson number of mean 1, times 2^32.
    steps = (1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609778)
    weight = lambda x: " + ".join(f"case when {x} >= {c} then 1 else 0 end" for c in steps)
    sums = ", ".join(f"sum(({weight(f'u{i}')}) * v) as a{i}, sum({weight(f'u{i}')}) as c{i}" for i in range(SAMPLES))
    cols = ", ".join(f"{u(i)} as u{i}" for i in range(SAMPLES))
    means = d.struct_list(*[f"case when c{i} > 0 then a{i} / cast(c{i} as double) end" for i in range(SAMPLES)])
    return f"""u as (select {group}, {value} as v, {cols} from {rows}), t as (select {group}, count(*) as n, avg(v) as mean, {sums} from u group by {group}),
      b as (select {group}, n, mean, {'array_sort' if d.spark else 'list_sort'}({d.keep(means, 'z', 'z is not null')}) as draws from t)"""


@relational("l8_bootstrap_means")
def l8(d):
    """Mean length of the responses of each capability, with a bootstrap interval whose ends are the places floor(p * count)."""
    n = d.size("draws")
    at = lambda p: d.at("draws", f"cast(least(floor({p} * {n}), {n} - 1) as int) + 1")
    return f"with {resamples(d, f'{EX} x where response is not null', 'capability', 'cast(length(response) as double)', 'example_id')} select capability, n, round(mean, 6) as mean, round({at(0.025)}, 5) as low, round({at(0.975)}, 5) as high, {n} as draws from b"


@relational("l9_bootstrap_variants")
def l9(d):
    """The same with ends at floor(p * (count - 1)), and at floor(0.025 * count) and floor(0.975 * count) - 1; and the interval of the difference of two halves of the examples, paired by capability."""
    n = d.size("draws")
    at = lambda x: d.at("draws", f"cast({x} as int) + 1")
    half = d.hex_int(f"substr({rank_key(d, chr(39) + 'half' + chr(39), 'example_id')}, 1, 1)")
    v = f"cast(case when {half} < 8 then length(response) else -length(response) end as double)"
    return f"""with {resamples(d, f'{EX} x where response is not null', 'capability', v, 'example_id')} select capability, n, round(mean, 6) as difference, round({at(f'floor(0.025 * ({n} - 1))')}, 5) as low_last, round({at(f'floor(0.975 * ({n} - 1))')}, 5) as high_last,
      round({at(f'floor(0.025 * {n})')}, 5) as low_paired, round({at(f'floor(0.975 * {n}) - 1')}, 5) as high_paired from b"""


@relational("l7_dimension_summary")
def l7(d):
    """Six dimensions of the examples: of each value the count, the share, mean and deviation of the response's length, and how many are empty."""
    dims = ("capability", "difficulty", "language", "source_type", "split")
    cells = d.struct_list(*[f"'{k}' || chr(31) || coalesce({k}, 'none')" for k in dims], f"'input' || chr(31) || case when input is null or trim(input) = '' then 'without' else 'with' end")
    return f"""with x as (select {d.explode(cells)} as c, length(response) as v, case when response is null or trim(response) = '' then 1 else 0 end as empty from {EX} z),
      y as (select {d.at(d.split('c', chr(31)), 1)} as dimension, {d.at(d.split('c', chr(31)), 2)} as mode, v, empty from x)
      select dimension, mode, count(*) as n, round(count(*) / cast(sum(count(*)) over (partition by dimension) as double), 6) as share, round(avg(v), 6) as mean, round(stddev_pop(v), 5) as deviation, cast(sum(empty) as bigint) as empty_ from y group by 1, 2"""


@relational("l6_strata")
def l6(d):
    """Means over the strata of each example, as pairs of field and name, in one pass."""
    cells = d.struct_list(*[f"case when {k} is not null then '{k}' || chr(31) || {k} end" for k in ("language", "difficulty", "source_type")])
    return f"with x as (select {d.explode(d.keep(cells, 'z', 'z is not null'))} as c, length(response) as v from {EX} y where response is not null) select {d.at(d.split('c', chr(31)), 1)} as field, {d.at(d.split('c', chr(31)), 2)} as name, count(*) as n, round(avg(v), 6) as mean from x group by 1, 2"


@relational("l11_snapshot_diff")
def l11(d):
    """Metrics of the training and of the test snapshot side by side: those that both have, with difference and relative difference."""
    cells = lambda: d.struct_list("'n' || chr(31) || cast(cast(n as bigint) as varchar(40))", "'chars' || chr(31) || cast(cast(chars as bigint) as varchar(40))", "'words' || chr(31) || cast(cast(ws as bigint) as varchar(40))", "'lines' || chr(31) || cast(cast(lines as bigint) as varchar(40))")
    m = f"select split, capability, count(*) as n, sum(length(response)) as chars, sum({d.size(words(d, 'response'))}) as ws, sum({d.size(d.split('response', chr(10)))}) as lines from {EX} x where response is not null and split in ('train', 'test') group by 1, 2"
    return f"""with m as ({m}), u as (select split, capability, {d.explode(cells())} as c from m), v as (select split, capability || '.' || {d.at(d.split('c', chr(31)), 1)} as metric, cast({d.at(d.split('c', chr(31)), 2)} as double) as value from u)
      select a.metric, a.value as before, b.value as after, b.value - a.value as delta, case when a.value <> 0 then round((b.value - a.value) / a.value, 6) end as relative from v a join v b on a.metric = b.metric and a.split = 'train' and b.split = 'test'"""


@relational("l14_manual_scores")
def l14(d):
    """Scores given by people (the events' values), validated against 0 to 5 before they are averaged, by kind and user's tenth."""
    return "select event_type, cast(user_id % 10 as bigint) as reviewer, count(*) as n, cast(sum(case when value between 0 and 5 then 1 else 0 end) as bigint) as valid, round(avg(case when value between 0 and 5 then value end), 4) as mean from @events group by 1, 2"


@relational("l21_generation_aggregates")
def l21(d):
    """Lengths of the responses, and how many show each style or any."""
    pats = {"heading": r"(?m)^#+ |^[A-Z][a-z]+:$", "section": r"(?m)^(?:See also|References|Notes)$", "citation": r"\[\d+\]|\(\d{4}\)", "article_lead": r"^(?:The|A|An) [a-z]+ "}
    like = {k: d.like("response", p) for k, p in pats.items()}
    cols = ", ".join(f"{d.int(f'sum(case when {v} then 1 else 0 end)')} as {k}, round(avg(case when {v} then 1.0e0 else 0.0e0 end), 6) as {k}_rate" for k, v in like.items())
    w = d.size(words(d, "response"))
    return f"select capability, count(*) as n, min({w}) as shortest, max({w}) as longest, round(avg({w}), 6) as mean_words, {cols}, {d.int(f'sum(case when {" or ".join(like.values())} then 1 else 0 end)')} as any_ from {EX} x where response is not null group by 1"


@relational("l24_dashboard")
def l24(d):
    """Artifacts by category: rows, keys and those that lack their text."""
    t = (("documents", "doc_id", "text"), ("retrieved_source_records", "record_id", "text"), ("text_chunks", "chunk_id", "text"), ("fingerprints", "item_id", "item_text"), ("prompts", "id", "prompt"), ("instruction_examples", "example_id", "response"))
    return " union all ".join(f"select '{n}' as category, count(*) as n_rows, count(distinct {k}) as keys, {d.int(f'sum(case when {x} is null then 1 else 0 end)')} as without_text from @{n}" for n, k, x in t)


@relational("l22_category_rollup")
def l22(d):
    """Responses by overlapping groups of capabilities: a row counts in each; incoherent are empty ones, those of under three words, and those that repeat more than 0.65 of their words."""
    groups = d.values("('all', '*'), ('factual', 'short_factual_qa'), ('factual', 'explanation'), ('factual', 'comparison'), ('writing', 'list_writing'), ('writing', 'rewriting'), ('writing', 'advice'), ('judgement', 'reasoning'), ('judgement', 'advice'), ('judgement', 'comparison')", "name, capability")
    w = words(d, fold("coalesce(response, '')"))
    bad = d.let(w, "rw", f"({d.size('rw')} < 3 or 1.0 - cast({d.size(d.distinct('rw'))} as double) / greatest({d.size('rw')}, 1) > 0.65)")
    return f"with g as {groups}, x as (select capability, {d.size(w)} as n_words, {bad} as bad from {EX} z) select g.name, count(*) as n, round(avg(n_words), 6) as mean_words, {d.int('sum(case when bad then 1 else 0 end)')} as incoherent from x join g on g.capability = x.capability or g.capability = '*' group by 1"
