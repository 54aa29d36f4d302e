"""Queries that check records, responses and scores; each reads its table once."""

from __future__ import annotations

from .dialect import fold, grams, norm, relational, words, ws
from .select_queries import EX, rank_key

# What records may hold.
SCHEMA_VERSION = "instruction_quality_v1"
CAPABILITIES = ("short_factual_qa", "explanation", "comparison", "list_writing", "rewriting", "advice", "reasoning")
DIFFICULTIES = ("easy", "medium", "hard")
SOURCE_TYPES = ("human_written", "curated", "synthetic_demo")
REVIEW_STATUSES = ("unreviewed", "approved", "rejected", "minor_issue", "needs_fact_check", "needs_rewrite")
FORMAT_TYPES = ("none", "exact_bullets", "exact_sentences", "maximum_words", "one_word", "json_object", "ordered_list", "unordered_list", "no_list", "required_headings", "required_fields", "plain_text_only", "exact_numbered_items", "exact_labeled_fields", "exact_words")
TEMPLATE_MARKERS = ("User:", "Assistant:", "### Instruction:", "### Response:")
# Which review status may follow which.
TRANSITIONS = (("unreviewed", "approved"), ("unreviewed", "rejected"), ("unreviewed", "minor_issue"), ("unreviewed", "needs_fact_check"), ("unreviewed", "needs_rewrite"), ("minor_issue", "approved"), ("minor_issue", "rejected"), ("minor_issue", "needs_rewrite"), ("needs_fact_check", "approved"), ("needs_fact_check", "rejected"), ("needs_fact_check", "needs_rewrite"), ("needs_rewrite", "approved"), ("needs_rewrite", "rejected"), ("needs_rewrite", "needs_fact_check"), ("approved", "needs_rewrite"), ("approved", "needs_fact_check"), ("approved", "rejected"), ("rejected", "needs_rewrite"), ("rejected", "needs_fact_check"))
# Ids of the examples: a parameter, as each collection has a form of its own.
ID_PATTERN = r"^viq-\d{9}$"


def _in(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def text_kit(d, x):
    """Counts over a response that several checks use."""
    return {"bullets": d.size(d.all(x, r"(?m)^\s*[-*+]\s+")), "ordered": d.size(d.all(x, r"(?m)^\s*\d+[.)]\s+")), "words": d.size(d.all(x, r"[\p{L}\p{N}_'-]+")),
            "sentences": d.size(d.keep(d.split(d.sub(f"trim({x})", r"([.!?])\s+", "$1\x1f"), "\x1f"), "z", "z <> ''")), "lines": d.size(d.keep(d.split(x, "\n"), "z", "trim(z) <> ''"))}


def format_findings(d):
    """(code, condition) of the format rules, over columns kind, want, strict, labels, keys, value_types ("key:type"), headings, fence, response."""
    n = text_kit(d, "response")
    json = f"kind in ('json_object', 'required_fields')"
    valid = f"coalesce({d.json_object('response')}, false)"
    own = d.json_keys("response")
    missing = lambda xs, pat: f"{d.size(d.keep(xs, 'z', 'not ' + pat))} > 0"
    line = lambda end: f"({d.contains('chr(10) || ' + d.sub('response', r'(?m)^[ \t]+', ''), 'chr(10) || z' + end)})"
    kind_of = d.json_kind("response", d.at(d.split("z", ":"), 1))
    wrong = d.keep("value_types", "z", f"({kind_of}) <> {d.at(d.split('z', ':'), 2)}")
    return (
        ("invalid_format_constraint", "kind is null"), ("unsupported_format_constraint", f"kind not in {_in(FORMAT_TYPES)}"),
        ("wrong_bullet_count", f"kind = 'exact_bullets' and {n['bullets']} <> coalesce(want, -1)"), ("wrong_sentence_count", f"kind = 'exact_sentences' and {n['sentences']} <> coalesce(want, -1)"),
        ("maximum_words_exceeded", f"kind = 'maximum_words' and {n['words']} > coalesce(want, -1)"), ("one_word_violation", f"kind = 'one_word' and {n['words']} <> 1"),
        ("wrong_word_count", f"kind = 'exact_words' and {n['words']} <> coalesce(want, -1)"), ("wrong_numbered_item_count", f"kind = 'exact_numbered_items' and {n['ordered']} <> coalesce(want, -1)"),
        ("missing_labeled_fields", f"kind = 'exact_labeled_fields' and {missing('labels', line(' || ' + chr(39) + ':' + chr(39)))}"),
        ("invalid_json", f"{json} and not {valid}"), ("missing_json_keys", f"{json} and {valid} and {missing('keys', d.has_item(own, 'z'))}"),
        ("extra_json_keys", f"{json} and {valid} and coalesce(strict, false) and {d.size(own)} <> {d.common(own, 'keys')}"), ("wrong_json_value_type", f"{json} and {valid} and {d.size(wrong)} > 0"),
        ("json_markdown_fence", f"{json} and not coalesce(fence, false) and {d.contains('response', chr(39) + '```' + chr(39))}"),
        ("ordered_list_required", f"kind = 'ordered_list' and {n['ordered']} = 0"), ("unordered_list_required", f"kind = 'unordered_list' and {n['bullets']} = 0"), ("list_forbidden", f"kind = 'no_list' and {n['bullets']} + {n['ordered']} > 0"),
        ("missing_headings", f"kind = 'required_headings' and {missing('headings', line(''))}"), ("plain_text_violation", f"kind = 'plain_text_only' and {d.like('response', r'(?m)```|^\s*#')}"),
    )


def record_findings(d):
    """(code, condition) of the record rules, over the columns of the examples."""
    # Fixed values below: the rules' patterns and limits.
    rep = d.let(d.keep(d.split(norm(d, "response"), " "), "z", "z <> ''"), "rw", f"case when {d.size('rw')} = 0 then 0.0 else 1.0 - cast({d.size(d.distinct('rw'))} as double) / {d.size('rw')} end")
    every = "coalesce(instruction, '') || chr(10) || coalesce(input, '') || chr(10) || coalesce(response, '')"
    facts = d.keep("facts", "f", "coalesce(f.verification_status, '') <> 'verified'")
    url = d.like("coalesce(source_reference, '')", r"^https?://[^/\s]+")
    return (
        ("unsupported_schema_version", f"coalesce(schema_version, '') <> '{SCHEMA_VERSION}'"), ("invalid_example_id", f"not {d.like('example_id', ID_PATTERN)}"), ("unsupported_capability", f"coalesce(capability, '') not in {_in(CAPABILITIES)}"),
        ("empty_instruction", "instruction is null or trim(instruction) = ''"), ("empty_response", "response is null or trim(response) = ''"), ("invalid_input", "input is null"),
        ("non_normalized_line_endings", d.contains(every, "chr(13)")), ("control_character", d.like(every, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}]")), ("placeholder_text", d.like(every, r"(?i)\[(?:TODO|TBD|PLACEHOLDER)\]|<TODO>")),
        ("template_marker", " or ".join(d.contains("coalesce(response, '')", f"'{m}'") for m in TEMPLATE_MARKERS)), ("joined_word", d.like("coalesce(response, '')", r"(?i)\b(?:such asweb|isalso|isJapan)\b")),
        ("possibly_truncated", d.like("coalesce(response, '')", r"[,;:-]\s*\z")), ("response_repetition", f"response is not null and {rep} > 0.45"),
        ("unsupported_source_type", f"coalesce(source_type, '') not in {_in(SOURCE_TYPES)}"), ("unsupported_language", "coalesce(language, '') <> 'en'"), ("unsupported_difficulty", f"coalesce(difficulty, '') not in {_in(DIFFICULTIES)}"),
        ("invalid_quality", f"coalesce(quality.review_status, '') not in {_in(REVIEW_STATUSES)}"), ("invalid_metadata", "coalesce(metadata.created_at, '') = '' or coalesce(metadata.created_by, '') = '' or coalesce(metadata.license, '') = '' or coalesce(metadata.provenance, '') = ''"),
        ("invalid_facts", "facts is null"), ("invalid_source_reference", f"capability = 'short_factual_qa' and not {url}"),
        ("factual_verification_missing", f"capability = 'short_factual_qa' and (facts is null or {d.size('facts')} = 0 or {d.size(facts)} > 0)"),
        ("time_sensitive_fact", f"capability = 'short_factual_qa' and {d.size(d.keep('facts', 'f', 'coalesce(f.time_sensitive, false)'))} > 0"),
    )


def codes(d, rules):
    """The codes of the rules that a row breaks, as a list."""
    return d.keep(d.struct_list(*[f"case when {cond} then '{code}' end" for code, cond in rules]), "c", "c is not null")


_NONE = "cast({} as {}) as labels, cast({} as {}) as keys, cast({} as {}) as value_types, cast({} as {}) as headings, false as fence"


def plain_formats(d):
    """The format columns of the examples; the table keeps type, count and strictness only, so lists of labels, keys and headings are empty."""
    e, t = ("array()", "array<string>") if d.spark else ("[]", "varchar[]")
    return "format_constraints.type as kind, cast(format_constraints.count as bigint) as want, format_constraints.strict as strict, " + _NONE.format(*[e, t] * 4)


_ROWS = "select distinct schema_version, example_id, capability, instruction, input, response, source_type, source_reference, language, difficulty, answer_style, {} , facts, quality, metadata from @instruction_examples where example_id is not null"


def validated(d):
    """v: example_id, capability, split parts and cs, the codes of all broken rules, of each different row."""
    return f"""src as ({_ROWS.format(plain_formats(d))}), v as (select example_id, capability, quality, {codes(d, record_findings(d))} as c1, {codes(d, format_findings(d))} as c2 from src),
      f as (select example_id, capability, {d.explode('c1')} as code from v union all select example_id, capability, {d.explode('c2')} from v
        union all select example_id, min(capability), 'duplicate_example_id' from src group by example_id having count(*) > 1)"""


@relational("k1_record_validation")
def k1(d):
    """Broken rules of the examples, by code and capability."""
    return f"with {validated(d)} select code, coalesce(capability, '') as capability, count(*) as n from f group by 1, 2"


@relational("k2_format_constraints")
def k2(d):
    """Formats of the examples: how many keep theirs, by kind and count."""
    return f"with src as ({_ROWS.format(plain_formats(d))}), v as (select kind, want, {d.size(codes(d, format_findings(d)))} as broken from src where response is not null) select coalesce(kind, '') as kind, want, count(*) as n, {d.int('sum(case when broken = 0 then 1 else 0 end)')} as kept from v group by 1, 2"


@relational("k4_quality_score")
def k4(d):
    """A score of each example: a hundred less 20 for each broken rule, 15 for a repeated instruction, 10 for odd length."""
    return f"""with {validated(d)}, c as (select example_id, count(*) as errors from f group by 1), e as (select distinct example_id, instruction, response from @instruction_examples where example_id is not null),
      s as (select example_id, {d.size(words(d, "coalesce(response, '')"))} as w, count(*) over (partition by {norm(d, "coalesce(instruction, '')")}) as same from e)
      select s.example_id, greatest(0, 100 - 20 * coalesce(errors, 0) - case when same > 1 then 15 else 0 end - case when w < 3 or w > 400 then 10 else 0 end) as score from s left join c on s.example_id = c.example_id"""


@relational("k5_review_join")
def k5(d):
    """Review decisions (kept with the rows; the first delivery's hash is the decided one) against the examples: orphan, stale, incomplete, and whether the step from the author's status is allowed."""
    h = d.sha("coalesce(instruction, '') || chr(10) || coalesce(input, '') || chr(10) || coalesce(response, '')")
    ok = ", ".join(f"('{a}', '{b}')" for a, b in TRANSITIONS)
    return f"""with x as (select distinct example_id, {h} as h, quality.review_status as status, quality.reviewer_id as who, split from @instruction_examples where example_id is not null),
      now as (select example_id, max(h) as h from x group by 1), dec as (select example_id, min(h) as h, min(status) as status, min(who) as who from x where status is not null and status <> 'unreviewed' group by 1),
      tr as {d.values(ok, 'a, b')}
      select dec.status, dec.h <> now.h as stale, now.example_id is null as orphan, dec.who is null as incomplete, dec.status in (select b from tr where a = 'unreviewed') as allowed, count(*) as n from dec left join now on dec.example_id = now.example_id group by 1, 2, 3, 4, 5"""


@relational("k28_review_queue")
def k28(d):
    """The review queue by status, capability and finding: examples, and the share decided; examples without findings count under none."""
    return f"""with {validated(d)}, q as (select distinct example_id, coalesce(capability, '') as capability, coalesce(quality.review_status, 'unreviewed') as status from v), j as (select q.*, coalesce(f.code, 'none') as code from q left join (select distinct example_id, code from f) f on q.example_id = f.example_id)
      select status, capability, code, count(*) as n, round(count(*) / cast(sum(count(*)) over (partition by capability, code) as double), 6) as share from j group by 1, 2, 3"""


@relational("k7_split_leakage")
def k7(d):
    """Exact groups of the five composites of examples that stand in more than one split."""
    n = lambda x: f"lower({ws(d, x)})"
    e = f"(select example_id, coalesce(split, '') as split, coalesce(instruction, '') as i, coalesce(input, '') as n, coalesce(response, '') as r from {EX} z)"
    kinds = {"instruction": "i", "input": "n", "response": "r", "instruction_input": "i || chr(10) || n", "instruction_input_response": "i || chr(10) || n || chr(10) || r"}
    cells = d.struct_list(*[f"'{k}' || chr(31) || {d.sha(n(x))}" for k, x in kinds.items()])
    return f"""with x as (select example_id, split, {d.explode(cells)} as c from {e} y where trim(i) <> '')
      select {d.at(d.split('c', chr(31)), 1)} as kind, {d.at(d.split('c', chr(31)), 2)} as sha256, count(*) as n, count(distinct split) as splits, min(example_id) as first_id from x group by 1, 2 having count(distinct split) > 1"""


# Phrases of uncertainty and of asking back.
UNCERTAIN = ("i don't know", "i do not know", "not certain", "uncertain", "cannot predict", "can't predict", "it depends", "impossible to know")
CLARIFY = ("could you clarify", "can you clarify", "please clarify", "what do you mean", "which one", "more information", "could you provide", "please provide")


@relational("k8_response_checks")
def k8(d):
    """The thirteen kinds of checks over all responses, by capability; expected values come from the prompts' checks or the examples' formats."""
    n, low = text_kit(d, "response"), fold("response")
    any_of = lambda xs: "(" + " or ".join(d.contains(low, "'" + x.replace("'", "''") + "'") if not d.spark else d.contains(low, '"' + x + '"') for x in xs) + ")"
    w = d.let(d.keep(d.map(d.split(ws(d, low), " "), "z", d.sub("z", r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")), "z", "z <> ''"), "kw", f"case when {d.size('kw')} = 0 then 0.0 else 1.0 - cast({d.size(d.distinct('kw'))} as double) / {d.size('kw')} end")
    answer = lambda x: d.sub(ws(d, fold(x)), r"[ .,!?;:]+$", "")
    keys = d.all(fold("instruction"), r"\p{Lu}?[\p{L}]{9,}")
    checks = {
        "non_empty": "trim(response) <> ''", "exact_answer": f"{answer('response')} = {answer('instruction')}", "accepted_answers": f"{answer('response')} in ('yes', 'no', 'none')",
        "required_keywords": f"{d.size(keys)} > 0 and {d.size(d.keep(keys, 'k', 'not ' + d.contains(low, 'k')))} = 0", "forbidden_keywords": "not " + any_of(("as an ai", "language model")),
        "exact_line_count": f"{n['lines']} = coalesce(want, 1)", "max_line_count": f"{n['lines']} <= coalesce(want, 5)", "exact_word_count": f"{n['words']} = coalesce(want, 10)", "numbered_item_count": f"{n['ordered']} = coalesce(want, 0)",
        "max_repetition_ratio": f"{w} <= 0.35", "uncertainty_required": f"{any_of(UNCERTAIN)} and not {d.like('response', r'\b\d+(?:\.\d+)?\b')}", "clarification_required": any_of(CLARIFY),
        "python_code_required": d.like("response", r"(?m)^\s*(?:def \w+\(|class \w+|import \w+|from \w+ import |for \w+ in |if .+:|print\()"),
    }
    cols = ", ".join(f"{d.int(f'sum(case when {v} then 1 else 0 end)')} as {k}" for k, v in checks.items())
    return f"with x as (select distinct example_id, capability, instruction, response, cast(format_constraints.count as bigint) as want from @instruction_examples where response is not null and instruction is not null) select coalesce(capability, '') as capability, count(*) as n, {cols} from x group by 1"


@relational("k9_repetition_ratio")
def k9(d):
    """Share of repeated words of each document, outer punctuation of words removed."""
    w = d.keep(d.map(d.split(ws(d, fold("text")), " "), "z", d.sub("z", r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")), "z", "z <> ''")
    return f"select doc_id, {d.let(w, 'kw', f'case when {d.size(chr(107) + chr(119))} = 0 then 0.0 else round(1.0 - cast({d.size(d.distinct(chr(107) + chr(119)))} as double) / {d.size(chr(107) + chr(119))}, 6) end')} as ratio from @documents where text is not null"


@relational("k11_rule_scores")
def k11(d):
    """Scores of the responses by each rule: exact, a single number, lines, numbered steps, bullets, JSON keys, keywords. What people judge is in l14_manual_scores."""
    nums = d.all("response", r"(?:^|[^\p{L}\p{N}_.])-?[0-9]+(?:\.[0-9]+)?(?:$|[^\p{L}\p{N}_.])")
    rows = lambda p: d.size(d.all("response", p))
    ids = d.all(fold("instruction"), r"[\p{L}]{9,}")
    share = d.let(d.distinct(ids), "ki", f"case when {d.size('ki')} = 0 then 0.0 else cast({d.size(d.keep('ki', 'k', d.contains(fold('response'), 'k')))} as double) / {d.size('ki')} end")
    s = {"exact": f"{norm(d, 'response')} = {norm(d, 'instruction')}", "number": f"{d.size(nums)} = 1", "count_lines": f"{rows(r'(?m)^.*[^ ].*$')} = 1", "numbered_steps": f"{rows('(?m)^ *[0-9]+[.)] ')} >= 2", "bullet_count": f"{rows('(?m)^ *[-*] ')} >= 2", "json_keys": f"{d.size(d.json_keys('response'))} > 0"}
    cols = ", ".join(f"{d.int(f'sum(case when {v} then 1 else 0 end)')} as {k}" for k, v in s.items())
    return f"select capability, count(*) as n, {cols}, round(avg({share}), 6) as keywords from {EX} x where response is not null and instruction is not null group by 1"


@relational("k12_generation_style")
def k12(d):
    """Distinct and repeated runs of each response, format kept strictly or in kind, and flags of style."""
    ww = d.all(fold("response"), r"[\p{L}\p{N}_'-]+")
    def ratio(k):
        return d.let(grams(d, ww, k, " "), "dn", f"case when {d.size('dn')} = 0 then 0.0 else round(cast({d.size(d.distinct('dn'))} as double) / {d.size('dn')}, 6) end")
    n = text_kit(d, "response")
    strict = f"case kind when 'bullet_list' then {n['bullets']} = want when 'numbered_list' then {n['ordered']} = want else true end"
    loose = f"case kind when 'bullet_list' then {n['bullets']} + {n['ordered']} > 0 when 'numbered_list' then {n['bullets']} + {n['ordered']} > 0 else true end"
    flags = {"has_list": f"{n['bullets']} + {n['ordered']} > 0", "has_heading": d.like("response", r"(?m)^#+ "), "has_code": d.contains("response", "'```'"), "ends_open": d.like("response", r"[,;:-]\s*\z"), "asks": d.like("response", r"\?\s*\z")}
    cols = ", ".join(f"{v} as {k}" for k, v in flags.items())
    return f"""with x as (select distinct example_id, response, format_constraints.type as kind, cast(format_constraints.count as bigint) as want from @instruction_examples where response is not null)
      select example_id, {ratio(1)} as distinct_1, {ratio(2)} as distinct_2, round(1.0 - {ratio(3)}, 6) as repeated_3, {strict} as format_strict, {loose} as format_relaxed, {cols} from x"""


@relational("k15_likelihood")
def k15(d):
    """Loss and perplexity of each chunk under log-likelihoods of its tokens; the bigram counts of the whole table stand for a model's. A loss above 709 would overflow and gives none."""
    pos = "posexplode(token_ids) as (p, t)" if d.spark else "unnest(range(len(token_ids))) as p, unnest(token_ids) as t"
    return f"""with x as (select chunk_id, {pos} from (select distinct chunk_id, token_ids from @base_text_chunks where token_ids is not null) c), u as (select t, count(*) as c from x group by 1), s as (select sum(c) as total from u),
      y as (select chunk_id, count(*) as target_tokens, sum(ln(u.c / cast(s.total as double))) as total from x join u on x.t = u.t cross join s group by 1)
      select chunk_id, target_tokens, round(total, 5) as total_log_likelihood, round(-total / target_tokens, 6) as loss, case when -total / target_tokens <= 709 then round(exp(-total / target_tokens), 4) end as perplexity from y"""


def _answer(d, x):
    return d.sub(d.sub(f"trim({fold(x)})", r"\s+", " "), r"[.,!?;:]+$", "")


@relational("k18_robustness_pairs")
def k18(d):
    """Pairs of examples of one capability with the same instruction but for case and marks: whether both agree, and whether each gives an answer that the group's first one accepts."""
    key = d.sub(fold("instruction"), r"[^\p{L}\p{N}]+", " ")
    return f"""with x as (select example_id, capability, {d.sha(key)} as pair_id, {_answer(d, "coalesce(response, '')")} as a from {EX} z where instruction is not null), g as (select pair_id, min(example_id) as first_id, count(*) as c from x group by 1 having count(*) > 1)
      select x.pair_id, x.example_id as variant_id, g.first_id as baseline_id, b.a = '' as baseline_empty, x.a = '' as variant_empty, b.a = x.a as consistent, case when x.a = b.a then 0 else -1 end as paired_correctness_delta
      from g join x on g.pair_id = x.pair_id and x.example_id <> g.first_id join x b on b.example_id = g.first_id"""


@relational("k19_step_answers")
def k19(d):
    """Worked steps of the documents, recomputed by their sign (+, -, ×, /): the steps' text and whether each and the final answer hold."""
    hit = d.all("text", r"Step [0-9]+: [0-9]{1,9} [-+×/] [0-9]{1,9} = [0-9]{1,12}")
    part = lambda i: d.at(d.split("q", " "), i)
    num = lambda i: d.int(part(i))
    op = part(4)
    return f"""with s as (select doc_id, {d.explode(hit)} as q from @documents where text is not null), v as (select doc_id, {op} as op, {num(3)} as a, {num(5)} as b, {num(7)} as c from s),
      w as (select doc_id, op, c, case op when '+' then a + b when '-' then a - b when '×' then a * b when '/' then case when b <> 0 and a % b = 0 then {d.int('a / b')} end end as right_ from v)
      select doc_id, op, count(*) as steps, {d.int('sum(case when c = right_ then 1 else 0 end)')} as correct, {d.int('sum(right_)')} as total from w group by 1, 2"""


@relational("k22_template_prompts")
def k22(d):
    """Arithmetic problems of the documents whose wording fits a template: their numbers, the stated answer and the recomputed one."""
    pat = r"has [0-9]{1,6} [^.\n]{1,60} and gets [0-9]{1,6} more\. Step 1: [0-9]{1,6} \+ [0-9]{1,6} = [0-9]{1,7}\."
    nums = d.all("q", r"[0-9]+")
    n = lambda i: d.int(d.at("m", i))
    return f"""with s as (select doc_id, {d.explode(d.all('text', pat))} as q from @documents where text is not null), t as (select doc_id, {nums} as m from s), u as (select doc_id, {n(1)} as a, {n(2)} as b, {n(4)} as c, {n(5)} as e, {n(6)} as stated from t where {d.size('m')} = 6)
      select doc_id, count(*) as prompts, {d.int('sum(case when a = c and b = e and c + e = stated then 1 else 0 end)')} as exact from u group by 1"""


@relational("k23_training_signal")
def k23(d):
    """Supervised words of the examples: how long answers are (in steps of ten), means by capability, and words of the last line against the others."""
    w, last = d.size(words(d, "response")), d.size(words(d, d.one("response", r"[^\n]*\z")))
    return f"select capability, {d.int(f'floor({w} / 10.0)')} as tens, count(*) as n, round(avg({w}), 6) as mean_words, {d.int(f'sum({last})')} as final_words, {d.int(f'sum({w} - {last})')} as other_words from {EX} x where response is not null group by 1, 2"


@relational("k26_inventory_checks")
def k26(d):
    """Checks of the prompts as an inventory: repeated ids and texts, missing strata, ratios out of bounds, keywords given twice."""
    p = "(select distinct id, prompt, category, checks.max_repetition_ratio as ratio, checks.required_keywords as keys from @prompts)"
    return f"""select 'reused_prompt' as check_name, count(*) as n from (select {d.sha(norm(d, 'prompt'))} as h from {p} a where prompt is not null group by 1 having count(distinct id) > 1) b
      union all select 'repeated_id', count(*) from (select id from {p} a group by 1 having count(*) > 1) b union all select 'missing_stratum', count(*) from {p} a where category is null
      union all select 'ratio_out_of_bounds', count(*) from {p} a where ratio is not null and (ratio < 0 or ratio > 1) union all select 'keyword_twice', count(*) from {p} a where keys is not null and {d.size('keys')} <> {d.size(d.distinct('keys'))}
      union all select 'empty_prompt', count(*) from {p} a where prompt is null or trim(prompt) = ''"""


@relational("k27_cloze_and_choice")
def k27(d):
    """Cloze answers (the last word of each response against the instruction's) exact and normalized, and choices by score: accuracy and margin by capability."""
    lastw = lambda x: d.one(x, r"[\p{L}\p{N}_]+[^\p{L}\p{N}_]*\z")
    score = lambda o: f"cast({d.hex_int('substr(' + rank_key(d, 'example_id', chr(39) + o + chr(39)) + ', 1, 8)')} as double) / 4294967296.0"
    return f"""with x as (select capability, {lastw('response')} as a, {lastw('instruction')} as b, {score('a')} as s1, {score('b')} as s2 from {EX} z where response is not null and instruction is not null)
      select capability, count(*) as n, {d.int('sum(case when a = b then 1 else 0 end)')} as exact, {d.int(f'sum(case when {_answer(d, "a")} = {_answer(d, "b")} then 1 else 0 end)')} as normalized, round(avg(case when s1 > s2 then 1.0e0 when s1 < s2 then 0.0e0 end), 6) as accuracy, round(avg(abs(s1 - s2)), 6) as mean_margin from x group by 1"""


@relational("k21_pattern_coverage")
def k21(d):
    """How many responses show each style, in one pass."""
    pats = {"numbered": r"(?m)^\s*\d+[.)]", "bulleted": r"(?m)^\s*[-*•]", "question": r"\?\s*$", "code": r"```", "year": r"\b1[4-9]\d\d\b", "quote": r"[“„«]"}
    cols = ", ".join(f"{d.int(f'sum(case when {d.like(chr(114) + chr(101) + chr(115) + chr(112) + chr(111) + chr(110) + chr(115) + chr(101), p)} then 1 else 0 end)')} as {k}" for k, p in pats.items())
    return f"select capability, count(*) as n, {cols} from {EX} x where response is not null group by 1"
