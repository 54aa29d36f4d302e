"""Queries on cleaning, quality and structure of texts."""

from __future__ import annotations

from .dialect import WS, fold, norm, relational, words, ws

# Markers of wrongly decoded text.
MARKERS = ("Ã¢", "Ãƒ", "ÃŽ", "Â°", "Â ", "Î¼", "Î¸", "â€", "âˆ", "ï¿½")
# Words that lost the space between them.
JOINED = ("forauthority", "endof", "withinanarchist", "fromthe", "asdistinct")
# Phrases of boilerplate.
BOILERPLATE = ("cookie policy", "privacy policy", "all rights reserved", "sign up to continue")
# Titles of reference sections.
REFERENCE_TITLES = ("bibliography", "citations", "editions", "external links", "further reading", "general and cited references", "notes", "publications", "references", "see also", "sources", "works cited")
# Markers at which a response ends.
STOP_MARKERS = ("[EOS]", "[BOS]", "[PAD]", "User:", "Assistant:", "Instruction:", "Response:")
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def suspicion(d, x):
    """Score of signs of wrong decoding: markers, lead letter pairs, replacement and control characters."""
    plain = " + ".join(f"(length({x}) - length(replace({x}, '{m}', ''))) / {len(m)}" for m in MARKERS)
    pairs = " + ".join(d.size(d.all(x, c + r"[\x{80}-\x{BF}]")) for c in "ÃÂÎ")
    return d.int(f"{plain} + {pairs} + 4 * (length({x}) - length(replace({x}, '�', ''))) + {d.size(d.all(x, chr(92) + 'x{80}'))} + {d.size(d.all(x, '[' + chr(92) + 'x{81}-' + chr(92) + 'x{9F}]'))}")


def quality_reason(d, x):
    """Why a text fails the quality gate; null if it passes."""
    s = suspicion(d, x)
    return f"""case when {d.contains(x, "'�'")} then 'replacement_character'
      when {d.like(x, r"[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}]")} then 'control_character'
      when {s} >= 2 or {s} > 0.001 * greatest(length({x}), 1) then 'implausible_non_ascii_corruption' end"""


def cleaned(d, x):
    """Text without comments, references, emphasis marks and citation marks; spaces and paragraphs rebuilt."""
    t = d.sub(d.sub(x, r"\r\n", "\n"), r"\r", "\n")
    t = d.sub(t, r"(?s)<!--.*?-->", " ")
    t = d.sub(t, r"(?is)<ref\b[^>]*>.*?</ref\s*>|<ref\b[^>]*/\s*>", " ")
    t = d.sub(t, r"'{2,5}([^'\n]+?)'{2,5}", "$1")
    t = d.sub(t, r"(?i)\[(?:\d{1,4}|citation needed)\]", " ")
    t = d.sub(d.sub(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    t = d.sub(t, r"\s+([,.;:!?])", "$1")
    return f"trim({d.sub(t, chr(92) + 'n{3,}', chr(10) * 2)})"


def repeated_lines(d, x):
    """Share of lines of two words or more that repeat another one."""
    lines = d.keep(d.map(d.split(x, "\n"), "l", fold("l")), "l", d.like("l", r"\S\s+\S"))
    n = d.size(lines)
    return f"case when {n} = 0 then 0.0 else round(1.0 - cast({d.size(d.distinct(lines))} as double) / {n}, 6) end"


@relational("c1_mojibake_score")
def c1(d):
    """Records whose text has signs of wrong decoding, with their score."""
    return f"select record_id, max({suspicion(d, 'text')}) as score from @retrieved_source_records where text is not null group by record_id having max({suspicion(d, 'text')}) > 0"


@relational("c3_quality_gate")
def c3(d):
    """Records by the reason for which they fail the quality gate, and warnings of the others."""
    joined = d.like("lower(text)", r"\b(?:" + "|".join(JOINED) + r")\b")
    return f"""with x as (select distinct record_id, text from @retrieved_source_records where text is not null),
      y as (select record_id, {quality_reason(d, 'text')} as reason, {suspicion(d, 'text')} as score, {joined} as joined from x)
      select coalesce(reason, 'passed') as reason, reason is null and score > 0 as suspicious, reason is null and joined as joined_words, count(*) as n
      from y group by 1, 2, 3"""


@relational("c7_clean_text")
def c7(d):
    """Cleaned text of each document, as a hash, and its length."""
    return f"with x as (select doc_id, {cleaned(d, 'text')} as t from @documents) select doc_id, {d.sha('t')} as sha256, {d.chars('t')} as n_chars from x"


@relational("c8_repeated_line_ratio")
def c8(d):
    return f"select doc_id, {repeated_lines(d, 'text')} as ratio from @documents"


def gate(d):
    """The document filter: the first reason that holds, null for accepted documents."""
    start = f"lower(substr(ltrim(text), 1, 200))"
    marks = " + ".join(f"(length(lower(t)) - length(replace(lower(t), '{m}', ''))) / {len(m)}" for m in BOILERPLATE)
    return f"""with x as (select doc_id, source, lang, title, text, {cleaned(d, "coalesce(text, '')")} as t from @documents),
      xq as (select *, {quality_reason(d, 't')} as q from x), gated as (select doc_id, source, text, t, case
        when text is null or trim(text) = '' then 'empty_text'
        when title is null or trim(title) = '' then 'missing_identity'
        when lang is not null and lower(lang) not in ('en', 'english') then 'non_english'
        when {start} like '#redirect%' or {start} like 'redirect:%' then 'redirect'
        when lower(trim(title)) like '%(disambiguation)' or {d.contains(start, "'may refer to:'")} or {d.contains(start, "'can refer to:'")} then 'disambiguation'
        when {d.like("coalesce(text, '')", r'[\x{FFFE}\x{FFFF}]')} then 'malformed_unicode' when q is not null then q
        when length(t) < 200 then 'too_short' when length(t) > 100000 then 'too_long'
        when not {d.like('t', r'[\p{L}]')} then 'no_alphabetic_text'
        when {d.size(d.split('t', chr(10)))} >= 6 and {repeated_lines(d, 't')} > 0.5 then 'repeated_low_information_lines'
        when {marks} >= 3 then 'excessive_boilerplate' end as reason from xq)"""


@relational("c9_document_filter")
def c9(d):
    """Why each document is rejected, or 'accepted'."""
    return f"{gate(d)} select doc_id, coalesce(reason, 'accepted') as reason from gated"


@relational("l1_rejection_counts")
def l1(d):
    """Documents by reason of rejection and source."""
    return f"{gate(d)} select source, coalesce(reason, 'accepted') as reason, count(*) as n from gated group by 1, 2"


@relational("c10_smart_quotes")
def c10(d):
    """Hash of each text with typographic quotes made plain."""
    return f"select doc_id, {d.sha('''translate(text, '“”’‘', '\"\"' || chr(39) || chr(39))''')} as sha256 from @documents"


@relational("c11_stop_markers")
def c11(d):
    """Responses cut at the first stop marker."""
    pattern = "(?s)(?:" + "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in STOP_MARKERS) + ").*$"
    return f"select distinct example_id, trim({d.sub('response', pattern, '')}) as response from @instruction_examples where response is not null"


@relational("c12_preview_windows")
def c12(d):
    """First and last 200 characters of each chunk, without overlap."""
    return """select distinct chunk_id, substr(text, 1, 200) as preview_start,
      case when length(text) > 200 then substr(text, cast(greatest(201, length(text) - 199) as int)) else '' end as preview_end from @text_chunks where text is not null"""


@relational("c13_match_context")
def c13(d, pattern=r"[\p{L}\p{N}_]+\?"):
    """140 characters around the first match of a pattern in each document (by default the end of a question), white space collapsed."""
    hit, at = d.one("text", pattern), d.strpos("text", "hit")
    return f"""with x as (select doc_id, text, {hit} as hit from @documents where {d.like('text', pattern)}), y as (select doc_id, text, hit, {at} as p from x)
      select doc_id, {ws(d, "substr(text, cast(greatest(p - 140, 1) as int), cast(least(p - 1, 140) + length(hit) + 140 as int))")} as context from y"""


# What kinds of list lines look like.
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
KINDS = (
    ("explicit", r"^\s*(?:[-*•▪◦]|\d+[.)])\s+"),
    ("dated", r"^\s*(?:c\.\s*)?\d{1,4}\s*[–—-]\s*\S+"),
    ("dated", rf"(?i)^\s*(?:{_MONTHS})\s+\d{{1,2}}\b"),
    ("bibliography", r"^\s*(?:[A-Z][\p{L}\p{N}_'’.-]+,\s*(?:[A-Z]\.|[A-Z][\p{L}\p{N}_'’.-]+)|.+\(\d{4}[a-z]?\)\.|ISBN\b|doi\s*:)"),
    ("bibliography", r"^\s*[^.!?\n]{2,220}(?::|,)\s*[^.!?\n]{1,220}\b(?:1[5-9]\d{2}|20\d{2})\b[.!]?\s*$"),
    ("bibliography", r"(?i)(?:\b(?:translated|edited)\s+by\b|\bvols?\.?\s+\d+\b|\([^():\n]{1,60}:\s*[^,\n]{2,100},\s*(?:1[5-9]\d{2}|20\d{2})\)|\[(?:contains?|translations?)\b)"),
    ("bibliography", r"(?i)^(?:\d{4}\s*[–—-]|(?:Film|Television|Radio|Stage|Novel|Series|Album|Edition|Volume)\s*:|[^.!?\n]{2,100}\(\d{4}\)\s*$)"),
    ("taxonomy", r"(?i)^\s*(?:order|family|subfamily|tribe|genus|species)\s+\S+"),
    ("taxonomy", r"(?i)^\s*(?:category|class|family|genus|order)\s*:"),
    ("category", r"^\s*[A-Z][\p{L}\p{N}_ &'/-]{0,40}:\s*$"),
    ("glossary", r"^\s*\S.{1,220}?\s+[–—-]\s+\S"),
)
# Institutions, ends of sentences, names and tokens as the line kinds take them.
_INSTITUTION = r"(?i)\b(?:academy|battalion|chapel|church|college|detachment|faculty|hospital|institute|institution|ministry|regiment|school|service|subdivision|university|unit)\b"
_SENTENCE_END = r"""[.!?](?:["'’”)]*)\s*(?:$|\s)"""
_NAMES = r"^\s*(?:[A-Z][\p{L}\p{N}_'’.-]+(?:\s+|$)){2,6}$"
_TOKEN = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)?|[^\p{L}\p{N}_\s]"


def line_kind(d, x):
    """Kind of a list-like line, null for prose; the first that holds."""
    ends = d.like(x, _SENTENCE_END)
    cases = " ".join(f"when {d.like(x, p)} then '{k}'" for k, p in KINDS)
    return f"""case {cases} when length({x}) <= 120 and {d.like(x, _INSTITUTION)} and not {ends} then 'institution'
      when {d.like(x, _NAMES)} then 'name' when length({x}) <= 100 and {d.like(x, r'[\p{L}]')} and not {ends} then 'short' end"""


def lines(d, table, key):
    """Trimmed, non-empty lines of each text with their position, kind and tokens."""
    src = f"select distinct {key}, text from @{table} where text is not null"
    pos = f"select {key}, posexplode(split(text, '\\n')) as (p, l) from ({src})" if d.spark else f"select {key}, unnest(range(len(string_split(text, chr(10))))) as p, unnest(string_split(text, chr(10))) as l from ({src})"
    return f"""raw as ({pos}), ln as (select {key}, p, {d.sub('l', '^' + WS + '+|' + WS + '+$', '')} as l from raw),
      line as (select {key}, p, l, {line_kind(d, 'l')} as kind, {d.size(d.all('l', _TOKEN))} as tokens, {d.size(d.all('l', _SENTENCE_END))} as ends from ln where l <> '')"""


@relational("d1_line_kinds")
def d1(d):
    """How many lines of each kind the chunks have."""
    return f"with {lines(d, 'text_chunks', 'chunk_id')} select coalesce(kind, 'prose') as kind, count(*) as n from line group by 1"


def list_metrics(d, table, key):
    """The twelve list measures of each text: islands of list-like lines by the difference of two row numbers."""
    return f"""{lines(d, table, key)},
      isl as (select *, row_number() over (partition by {key} order by p) - row_number() over (partition by {key}, kind is not null order by p) as g from line),
      runs as (select {key}, g, count(*) as c from isl where kind is not null group by 1, 2),
      runs2 as (select {key}, max(c) as longest, count(*) as blocks from runs group by 1),
      kinds as (select {key}, max(c) as most from (select {key}, kind, count(*) as c from line where kind is not null group by 1, 2) k group by 1),
      base as (select {key}, count(*) as n, sum(case when kind is not null then 1 else 0 end) as listed, sum(case when kind <> 'short' then 1 else 0 end) as strong,
        sum(case when length(l) <= 100 then 1 else 0 end) as short_lines, sum(case when kind is null then tokens else 0 end) as prose_tokens, sum(tokens) as tokens,
        sum(case when kind is null then ends else 0 end) as prose_sentences, avg(length(l)) as mean_length from line group by 1),
      m as (select b.{key}, {d.int('n')} as nonempty_line_count, {d.int('listed')} as list_like_line_count, round(listed / cast(n as double), 6) as list_like_line_ratio,
        {d.int('strong')} as strong_list_like_line_count, {d.int('short_lines')} as short_line_count, round(short_lines / cast(n as double), 6) as short_line_ratio,
        {d.int('coalesce(longest, 0)')} as maximum_consecutive_list_like_lines, {d.int('coalesce(blocks, 0)')} as list_block_count, round(coalesce(most, 0) / cast(n as double), 6) as repeated_structure_line_ratio,
        case when tokens > 0 then round(prose_tokens / cast(tokens as double), 6) else 0.0 end as prose_token_ratio, round(mean_length, 6) as average_line_length, {d.int('prose_sentences')} as prose_sentence_count
        from base b left join runs2 r on b.{key} = r.{key} left join kinds k on b.{key} = k.{key})"""


@relational("d2_list_metrics")
def d2(d):
    return f"with {list_metrics(d, 'text_chunks', 'chunk_id')} select * from m"


# Fixed value: how lists are introduced.
_INTRO = r"(?i)\b(?:as follows|the following|include(?:s|d)?|consist(?:s|ed)? of)\s*:\s*$"


def low_information(d, x):
    """No letters, a lone title, or an introduction to a list that isn't there."""
    w = d.split(ws(d, x), " ")
    titled = f"{d.size(d.keep(w, 'w', d.like('w', '[' + chr(92) + 'p{L}]') + ' and not ' + d.like('w', '^' + chr(92) + 'p{Lu}')))} = 0"
    return f"""(not {d.like(x, r'[\p{L}]')} or (not {d.like(f'trim({x})', chr(92) + 'n')} and {d.size(w)} <= 12 and not {d.like(x, r'[.!?]\s*$')} and {d.like(x, r'^\s*\p{Lu}')} and {titled}) or {d.like(x, _INTRO)})"""


@relational("d3_low_information")
def d3(d):
    return f"with x as (select distinct chunk_id, text from @text_chunks where text is not null) select chunk_id, {low_information(d, 'text')} as low_information from x"


# Signs of values that are missing, and of malformed source text. A look-ahead at the end of a pattern is
# written as what follows, and one that forbids as what else may follow, so that both engines read it.
_UNITS = r"(?:earth\s+radii|kilograms?|kilomet(?:er|re)s?|meters?|metres?|miles?|feet|seconds?|degrees?|lit(?:er|re)s?|watts?|volts?|kelvins?)"
_QUANTITY = r"(?:distance|mass|length|height|width|area|volume|weight|speed)"
_TRANSITION = rf"(?:Recognition\b|Upon\s+the\s+conclusion\b|In\s+(?:{_MONTHS})\s+\d{{4}}\b|This\s+is\s+(?:a|the)\s+(?:celebrated|famous|well-known)\s+passage\b)"
_PROMISE = r"\b(?:following|quotation|quote|verses?|words|statement|passage|anecdote|theme|examples?|types?|classified|designated)\b"
_NO_LIST = r'(?:\z|[ \t]|[^-*•▪◦"“0-9 \t]|\d+(?:\z|[^\d.)]|[.)](?:\z|\S)))'
_EMPTY_FIELD, _ONLY_CONNECTOR = r"\(\s*[,;:]+\s*\)", r"(?i)\(\s*[,;]*\s*(?:(?:or|and)\s*[,;]*\s*)+\)"
_ETYMOLOGY = r"\b(?:derived|borrowed|taken)(?:\s+either)?\s+from\s*,\s*(?:meaning|signifying|or\b)"
_UNIT_ONLY = rf"\b{_QUANTITY}\s+of\s+(?:about\s+|approximately\s+)?{_UNITS}\b"
_NO_QUANTITY = r"\b(?:distance|mass|length|height|width|area|volume|weight|speed|parallax)\s+of\s*[,.;]"
_ISOTOPE = r"(?i)\b(?:isotope|nuclide)\s+(?:of\s*)?(?:[,.;]|(?:is|was)\s*[,.;])"
_LIFESPAN = rf"(?i)\b(?:1\d{{3}}|20\d{{2}})(?:0?[1-9]|[12]\d|3[01])\s+(?:{_MONTHS})\b"
_END = r"(?:\n?\z)"
MISSING = (
    _EMPTY_FIELD,
    r"(?i)\b(?:examples?\s+are|the\s+following\s+are|the\s+(?:principal\s+)?types\s+are|(?:is|are|was|were)\s+classified\s+as|designated\s+the\s+types(?:\s+of\s+[^:\n]{1,100})?)\s*:\s*\z",
    r":\s*\z", r"(?i)\b(?:currently|approximately|about|nearly)\s+[.,;]", r"(?i)\b(?:total\s+)?(?:land\s+)?area\s+of\s*[,.;]",
    r"(?i)\bfrom\s+(?:almost|approximately|about)\s+(?:for|to|and)\b", r"(?i)\b(?:more|less|fewer)\s+than\s+(?:of\b|[,.;])", r"(?i)\b(?:over|under|approximately|about|nearly)\s+of\b",
    r"(?i)\b(?:delivering|spilling|containing|producing|covering)\s+of\b", r"(?i),\s*(?:of|as|is|from)\s*,", r"(?i)\b(?:summarized|expressed|written|represented)\s+(?:formally\s+)?as\s+(?:or|and)?\s*[,.;]",
    r"(?i)\bfrom\s+(?:the|an?)\s*,", r"(?i)\b(?:definition|formula|quotation|quote|example)\b[^.\n]{0,120}:[ \t]*\n[ \t]*\n", r"(?i)\b(?:is|are|was|were)\s*\(\s*(?:or|and)\b",
    r"(?i)\bvariously\s+(?:or|and)\b", r"(?i)\b(?:plural|singular|comparative|superlative)\s+form\s+(?:is|are|was|were)\s*[)\],.;]", r"(?i)\b(?:or|and)\s+(?:or|and)\b",
    r"(?i)\b(?:used|called|named|written|spelled|rendered)\s*,\s*(?:while|whereas|with|and)\b", r"(?i)\b(?:called|named)\s+the\s*,", r"(?i)\b(?:river|term|word|name)\s+as\s*[.,;]",
    "(?i)" + _ETYMOLOGY, r"(?i)\bfrom\s+and\s+related\s+words\b", r"(?i)\b(?:mean|median|average|value|result|sum|difference|product|quotient|variance|probability)\s+(?:is|are|was|were)\s*[,.;]",
    r"(?i)\b(?:for example|for instance),?\s+(?:consider|take|suppose)\s+(?:the|a|this)\s+(?:data\s+)?(?:sample|set|sequence|values?|numbers?)\s*[.;]",
    r"(?i)\bsuch as\s*,\s*(?:the|a|an|this|that|these|those|it|they|we)\b", r"\(\s*(?:[A-Z][\p{L}\p{N}_ -]*|[a-z]{2,3})\s*:\s*\)", r'["“]\s*["”]', r"(?i)\bwith\s+(?:the\s+)?formula\s*[.;]",
    "(?i)" + _UNIT_ONLY, "(?i)" + _NO_QUANTITY, _ISOTOPE, r"(?im)^\s*\((?:triangle|parallelogram|rectangle|square|circle|polygon|formula|equation)\)\s*[.;]?\s*$",
    r"(?i)\b(?:at|nearly)\s+Mach\s+\d+(?:\.\d+)?\s+or\s*(?:on\b|[,.;]|\z|\n)", r"(?i)\bhaving\s+reached\s+on\s+\d{1,2}\s+[A-Za-z]+\b", r"(?i)\bfor\s+and\s+respectively\b",
    r"(?i)\b(?:extends?|stretches?)\s+more\s+than\s+(?:through|across|along|over)\b",
    r"(?i)\b(?:the\s+following\s+(?:principles|items|examples)|with\s+these\s+words|the\s+following\s+are|statistics[^.\n]{0,80}(?:released|reported)[^.\n]{0,40})\s*:[ \t]*\n[ \t]*\n" + _NO_LIST,
    r"(?i)\b(?:an?\s+example\s+is|examples?\s+are)\s+[^\n.!?:]{2,240}\s*\n\s*\n\s*[A-Z][^\n]{0,100}\n", r"(?i)\b(?:reacts?|forms?|converts?|alkylates?|hydrogenates?)\b[^\n.]{0,240}:\s*\n\s*\n\s*[A-Z][^\n]{0,100}\n",
    "(?i)" + _PROMISE + r"[^\n]{0,180}:\s*\n\s*\n\s*" + _TRANSITION,
    r"(?i)\b(?:one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:possible\s+)?(?:ways|forms|expressions|equations|identities|cases)\s*:\s*\n\s*\n\s*[A-Z]",
    r"(?i)\bis\s+equivalent\s+to\s*[,.;]", r"(?i)\bmeans\s*,\s*which\s+is\s+not\s+equivalent\b", r"(?i)\bwritten\s+(?:unambiguously\s+)?as\s*\n\s*\n\s*[A-Z]", _ONLY_CONNECTOR, r"\(\s*;",
    r"(?i)\b(?:about|approximately|around|nearly)\s+(?:north|south|east|west)\s+of\b", r"(?i)\bmeasures?\s+long\b", r"(?i)\band\s+across\s+at\s+(?:its|the)\b", r"(?i)\b(?:its|the)\s+area\s+is\s+(?:and\b|[,.;])",
    r"(?im)(?:[.!?]\s*,\s*[A-Za-z]+\b|(?:^|\n)\s*,\s*(?:the|it|there)\b)", r"(?i)\bthe\s+[\p{L}\p{N}_]+(?:ical|ive|ary|ous)\s+\(\s*\d{3,4}\s*[–—-]\s*\d{2,4}\s*\)", r"\(\s*\)", r"(?:=|≈|≃|~)\s*(?:[,.;]|\z)",
)
_IBID = r"\b[A-Za-z]{4,}\.\s*,"
MALFORMED = (
    r"(?i)\bof\s+allowed\b", r"(?i)\bAfter\s+s\s+", r"(?i)\bproject\s*,\s*,", r"\b[\p{L}\p{N}_]+\s*,\s*,\s*[\p{L}\p{N}_]+", r"(?m)(?:^|\n\s*\n)\s*,\s*[A-Z]", r"\)\s*\.\s*;",
    r"(?:\A|\n)\s*[^\n()]{1,100}\)\s*(?:\z|\n)", r"(?m)\b\d+,\s*(?:$|\n)", r",{2,}", r";\s*,", _IBID, rf"(?i)\b(?:{_MONTHS})\d+\b", r"(?i)\b(?:age|or|the|figure|hours?|minutes?|seconds?)\d+\b", _LIFESPAN,
)


def has(d, x, p):
    """Whether a text has a pattern; abbreviated sentences' "ibid." is no sign of lost text."""
    return f"({d.size(d.keep(d.all(x, p), 'm', 'not ' + d.like('lower(m)', '^ibid[.]')))} > 0)" if p == _IBID else d.like(x, p)


def any_of(d, x, bank):
    """Whether a text has a pattern of a bank: case-sensitive and other ones as one alternation each, but for those with options of their own."""
    plain = [p for p in bank if not p.startswith("(?") and p != _IBID]
    folded = [p[4:] for p in bank if p.startswith("(?i)")]
    rest = [p for p in bank if p.startswith("(?") and not p.startswith("(?i)") or p == _IBID]
    one = [d.like(x, "|".join(f"(?:{p})" for p in plain))] if plain else []
    one += [d.like(x, "(?i)" + "|".join(f"(?:{p})" for p in folded))] if folded else []
    return "(" + " or ".join(one + [has(d, x, p) for p in rest]) + ")"


def final_gate(d):
    """The gate of finished chunks: the first reason that holds, null for kept chunks."""
    short = "array_contains(array('token_fallback'), boundary_start_type)" if d.spark else "boundary_start_type = 'token_fallback'"
    return f"""{list_metrics(d, 'text_chunks', 'chunk_id')},
      c as (select chunk_id, max(text) as text, max(boundary_start_type) as b0, max(boundary_end_type) as b1 from @text_chunks where text is not null group by 1),
      cq as (select *, {quality_reason(d, 'text')} as q from c), g as (select c.chunk_id, case when q is not null then q
        when {d.size(words(d, 'text'))} < 32 then 'below_minimum_chunk_tokens' when {low_information(d, 'text')} then 'low_information'
        when {any_of(d, 'text', MISSING)} then 'missing_source_value' when {any_of(d, 'text', MALFORMED)} then 'malformed_source_text'
        when (nonempty_line_count >= 4 and list_like_line_ratio >= 0.8 and prose_sentence_count < greatest(2, ceil(nonempty_line_count * (1.0 - 0.8))))
          or (maximum_consecutive_list_like_lines >= 6 and prose_token_ratio < 0.85) or (strong_list_like_line_count >= 8 and list_like_line_ratio >= 0.35 and prose_token_ratio < 0.75)
          or (list_block_count >= 2 and list_like_line_count >= 6 and prose_token_ratio < 0.65)
          or (nonempty_line_count >= 8 and list_like_line_ratio >= 0.6 and maximum_consecutive_list_like_lines >= 4 and prose_token_ratio < 0.6) then 'list_dominated'
        when coalesce(b0, '') = 'token_fallback' or coalesce(b1, '') = 'token_fallback' then 'token_fallback_boundary' end as reason
        from cq c join m on c.chunk_id = m.chunk_id)"""


@relational("d4_missing_values")
def d4(d):
    return f"select distinct chunk_id from @text_chunks where text is not null and {any_of(d, 'text', MISSING)}"


@relational("d5_malformed_source")
def d5(d):
    return f"select distinct chunk_id from @text_chunks where text is not null and {any_of(d, 'text', MALFORMED)}"


@relational("d6_final_chunk_gate")
def d6(d):
    return f"with {final_gate(d)} select chunk_id, coalesce(reason, 'kept') as reason from g"


# Fixed value: words that lost the space before a number.
_JOINED_WORD = rf"(?i)\b(?:{_MONTHS}|age|or|the|figure|hours?|minutes?|seconds?)\d+\b"
# Families of defects that a pattern tells, with what is done about them.
FAMILIES = (
    ("empty_pronunciation_or_alternate_name", "reject", _EMPTY_FIELD),
    ("connector_only_language_field", "reject", r"(?i)\(\s*[,;:]*\s*(?:(?:or|and)\s*[,;:]*\s*)+\)"),
    ("missing_etymological_source_term", "reject", rf"(?i){_ETYMOLOGY}|\bfrom\s+and\s+related\s+words\b"),
    ("missing_measurement_unit_or_quantity", "reject", rf"(?i){_UNIT_ONLY}|{_NO_QUANTITY}"),
    ("missing_isotope_identifier", "reject", _ISOTOPE),
    ("malformed_or_joined_lifespan_date", "reject", _LIFESPAN),
    ("missing_formula_or_mathematical_operand", "reject", r"(?i)\bis\s+equivalent\s+to\s*[,.;]|\bmeans\s*,\s*which\s+is\s+not\s+equivalent\b|(?:=|≈|≃|~)\s*(?:[,.;]|\z)"),
    ("missing_quoted_passage_or_enumeration", "reject", r":\s*\z"),
    ("repeated_punctuation_from_removed_markup", "reject", r",{2,}|;\s*,|\)\s*\.\s*;"),
    ("joined_date_or_function_word", "reject", _JOINED_WORD),
)
# Letters joined with digits, and units that may be.
_MIXED = r"\b[A-Za-z]*[a-z]{2,}\d+\b"
_EXPONENT = r"(?i)^(?:cm|mm|km|ft|yd|in|mi|sp|mc|dw|sdh)\d+$"


def findings(d):
    """y: chunk_id, text and f, its findings as strings of family, disposition and evidence; one pass over each text.

    Paragraphs that end in a promise and whose next one passes on to other matter come from a pattern over both, as
    blank lines part them. Families of lists come from the measures of D2 and the counts of D9.
    """
    sep = "chr(31)"
    cell = lambda f, a, ev, cond: f"case when {cond} then '{f}' || {sep} || '{a}' || {sep} || substr({ev}, 1, 240) end"
    cells = [cell(f, a, d.one("text", p), d.like("text", p)) for f, a, p in FAMILIES if f != "repeated_punctuation_from_removed_markup"]
    ibid = d.keep(d.all("text", _IBID), "m", "not " + d.like("lower(m)", "^ibid[.]"))
    punct = FAMILIES[8][2]
    cells.append(cell(FAMILIES[8][0], "reject", f"case when {d.like('text', punct)} then {d.one('text', punct)} else {d.at(ibid, 1)} end", f"({d.like('text', punct)} or {d.size(ibid)} > 0)"))
    promise = "(?i)" + _PROMISE + r"[^\n]{0,180}:[ \t]*\n\s*\n\s*" + _TRANSITION
    cells.append(cell("heading_or_commentary_after_omitted_material", "reject", d.one("text", promise), d.like("text", promise)))
    mixed = d.keep(d.all("text", _MIXED), "m", f"not {d.like('m', _EXPONENT)} and not {d.like('m', '^(?:' + _JOINED_WORD + ')$')}")
    cells.append(cell("possible_joined_alphanumeric_formatting", "manual_review", d.at(mixed, 1), f"{d.size(mixed)} > 0"))
    entries = f"greatest(publications, entries)"
    cells.append(cell("publication_adaptation_or_catalogue_dominated", "manual_review", "text", f"{entries} >= 4 and {entries} >= 0.5 * nonempty_line_count and prose_token_ratio >= 0.65"))
    cells.append(cell("publication_adaptation_or_catalogue_dominated", "reject", "text", f"{entries} >= 4 and {entries} >= 0.5 * nonempty_line_count and prose_token_ratio < 0.65"))
    cells.append(cell("fragmented_or_structured_list", "reject", "text", "(maximum_consecutive_list_like_lines >= 6 or list_block_count >= 2) and list_like_line_count >= 6 and prose_token_ratio < 0.65"))
    arr = f"{'array' if d.spark else 'list_value'}({', '.join(cells)})"
    return f"""{list_metrics(d, 'text_chunks', 'chunk_id')}, {_entries(d)},
      t as (select chunk_id, max(text) as text from @text_chunks where text is not null group by 1),
      y as (select t.chunk_id, t.text, {d.keep(arr, 'z', 'z is not null')} as f from t left join m on t.chunk_id = m.chunk_id left join ent on t.chunk_id = ent.chunk_id),
      fd as (select chunk_id, {d.explode('f')} as z from y), found as (select chunk_id, {d.at(d.split('z', chr(31)), 1)} as family, {d.at(d.split('z', chr(31)), 2)} as disposition, {d.at(d.split('z', chr(31)), 3)} as evidence from fd)"""


def _entries(d):
    pub, cat = KINDS[5][1], KINDS[6][1]
    return f"""ent as (select chunk_id, {d.int("sum(case when " + d.like('l', pub) + " then 1 else 0 end)")} as publications, {d.int("sum(case when " + d.like('l', cat) + " then 1 else 0 end)")} as entries, count(*) as n_lines from line group by 1)"""


@relational("d7_defect_families")
def d7(d):
    """Each family of defects that a chunk shows, what is done about it, and the text that shows it."""
    return f"with {findings(d)} select chunk_id, family, disposition, evidence from found"


@relational("d10_quality_audit")
def d10(d):
    """Chunks by family of defect, and how many of them are to be reviewed or rejected by the gate."""
    gate_ = final_gate(d)[len(list_metrics(d, 'text_chunks', 'chunk_id')):]
    return f"with {findings(d)}{gate_} select family, disposition, count(*) as n, {d.int("sum(case when disposition = 'manual_review' or reason is not null then 1 else 0 end)")} as explained from found join g on found.chunk_id = g.chunk_id group by 1, 2"


@relational("d8_promised_material")
def d8(d):
    """Paragraphs that promise something where the next paragraph passes on to other matter."""
    src = "select distinct chunk_id, text from @text_chunks where text is not null"
    sep = r"\n\s*\n"
    ps = f"select chunk_id, posexplode(split(text, {d.q(sep)})) as (p, t) from ({src})" if d.spark else f"select chunk_id, unnest(range(len(regexp_split_to_array(text, {d.q(sep)})))) as p, unnest(regexp_split_to_array(text, {d.q(sep)})) as t from ({src})"
    nxt = "lead(t) over (partition by chunk_id order by p)"
    return f"with x as ({ps}), y as (select chunk_id, p, t, {nxt} as after from (select chunk_id, p, trim(t) as t from x) x2 where t <> '') select chunk_id, {d.int('p')} as paragraph from y where after is not null and {d.like('t', '(?i)' + _PROMISE + r'[^\n]{0,180}:\z')} and {d.like('after', '(?i)^' + _TRANSITION)}"


@relational("d9_catalogue_dominance")
def d9(d):
    """Chunks of which half the lines, four or more, are catalogue entries; those of much prose are to be reviewed."""
    return f"""with {list_metrics(d, 'text_chunks', 'chunk_id')}, {_entries(d)} select ent.chunk_id, publications, entries, n_lines as n, case when prose_token_ratio >= 0.65 then 'manual_review' else 'reject' end as disposition
      from ent join m on ent.chunk_id = m.chunk_id where greatest(publications, entries) >= 4 and greatest(publications, entries) >= 0.5 * n_lines"""


def heading(d, x):
    return f"(not {d.like(x, chr(92) + 'n')} and {d.like(x, r'^\p{Lu}')} and {d.size(d.split(ws(d, x), ' '))} <= 12 and length({x}) <= 120 and not {d.like(x, r'[.!?;:,]\s*$')})"


@relational("e1_headings")
def e1(d):
    """Lines that look like headings, with how often they occur."""
    return f"with {lines(d, 'text_chunks', 'chunk_id')} select l as heading, count(*) as n from line where {heading(d, 'l')} group by 1"


@relational("e2_reference_sections")
def e2(d):
    """Section titles, normalized, and whether they begin a reference section."""
    t = ws(d, d.sub(fold("section_title"), r"[^\p{L}\p{N}_\s]", " "))
    return f"with x as (select distinct chunk_id, {t} as title from @text_chunks where section_title is not null) select title, title in {_IN(REFERENCE_TITLES)} as is_reference, count(*) as n from x group by 1, 2"


@relational("e3_paragraph_units")
def e3(d):
    """Paragraphs of each document up to its first reference heading, in order."""
    sep = r"\n\s*\n"
    ps = f"select doc_id, posexplode(split(text, {d.q(sep)})) as (p, t) from @documents" if d.spark else f"select doc_id, unnest(range(len(regexp_split_to_array(text, {d.q(sep)})))) as p, unnest(regexp_split_to_array(text, {d.q(sep)})) as t from documents"
    ref = f"{ws(d, d.sub(fold('t'), r'[^' + chr(92) + r'p{L}' + chr(92) + r'p{N}_' + chr(92) + 's]', ' '))} in {_IN(REFERENCE_TITLES)}"
    return f"""with x as ({ps}), y as (select doc_id, p, {ws(d, 't')} as t, max(case when {ref} then 1 else 0 end) over (partition by doc_id order by p rows between unbounded preceding and current row) as ended from x)
      select doc_id, {d.int('p')} as paragraph, {d.sha('t')} as sha256, {d.size(words(d, 't'))} as n_words from y where ended = 0 and t <> ''"""


@relational("e8_end_marker")
def e8(d):
    return f"select doc_id, {d.sha("text || chr(10) || '[EOS]' || chr(10)")} as sha256 from @documents"


@relational("e11_length_audit")
def e11(d, limit=400, k=10):
    """Word lengths of each source: smallest, largest, mean, floor-index percentiles, how many pass the limit, and the longest ten. Ranks are taken over the counts of each length, so no source is sorted whole."""
    n = d.size(words(d, "text"))
    pick = lambda q: f"min(case when upto >= {d.int(f'floor((c - 1) * {q})')} + 1 then n end)"
    return f"""with x as (select source, doc_id, {n} as n from @documents where text is not null), h as (select source, n, count(*) as m from x group by 1, 2), y as (select source, n, m, sum(m) over (partition by source order by n) as upto, sum(m) over (partition by source) as c from h),
      s as (select source, min(n) as smallest, max(n) as largest, round(sum(n * m) / cast(sum(m) as double), 6) as mean, {pick(0.5)} as p50, {pick(0.95)} as p95, {pick(0.99)} as p99, cast(sum(case when n > {limit} then m else 0 end) as bigint) as truncated from y group by 1),
      top as (select source, {d.join(d.collect("lpad(cast(999999 - n as varchar(8)), 6, '0') || ':' || cast(doc_id as varchar(20))"), ',')} as longest from (select source, n, doc_id, row_number() over (partition by source order by n desc, doc_id) as r from (select x.* from x join (select source, min(n) as least from (select source, n, sum(m) over (partition by source order by n desc) - m as above from h) g where above < {k} group by 1) l on x.source = l.source and x.n >= l.least) z) w where r <= {k} group by 1)
      select s.*, top.longest from s join top on s.source = top.source"""


@relational("d11_review_prechecks")
def d11(d):
    """Checks that block a chunk's review: gate, empty or repeated text, repeated previews, missing parent, sizes that don't agree, boundaries that parted a word."""
    gate_ = final_gate(d)
    checks = d.struct_list("case when g.reason is not null then 'gate_' || g.reason end", "case when x.parent_document_id is null then 'missing_parent' end", "case when x.copies > 1 then 'repeated_text' end", "case when x.previews > 1 and x.copies = 1 then 'repeated_preview' end",
                           "case when x.overlap_characters > length(x.text) then 'overlap_beyond_text' end", "case when x.token_count is null or x.token_count <= 0 then 'no_token_count' end", f"case when {d.like('x.text', '^[a-z]')} and x.boundary_start_type = 'paragraph' then 'starts_within_sentence' end")
    return f"""with {gate_}, x as (select y.*, count(*) over (partition by {d.sha('text')}) as copies, count(*) over (partition by substr(text, 1, 120), right(text, 120)) as previews from (select chunk_id, min(parent_document_id) as parent_document_id, max(text) as text, min(token_count) as token_count, min(overlap_characters) as overlap_characters, min(boundary_start_type) as boundary_start_type from @text_chunks where text is not null group by 1) y),
      z as (select x.chunk_id, {d.explode(d.keep(checks, 'k', 'k is not null'))} as check_name from x join g on x.chunk_id = g.chunk_id) select check_name, count(*) as n, min(chunk_id) as first_chunk from z group by 1"""


@relational("n1_match_hash")
def n1(d):
    """Hash of each document's text as it is matched."""
    return f"select doc_id, {d.sha(norm(d, 'text'))} as sha256 from @documents"
