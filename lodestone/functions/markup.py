"""Cleaning of wiki markup: repair of wrong decoding, templates, comments, references and emphasis."""

from __future__ import annotations

import re
import unicodedata

# Signs of UTF-8 that was read as a one-byte encoding.
SIGNS = ("Ã¢", "Ãƒ", "ÃŽ", "Â°", "Â ", "Î¼", "Î¸", "â€", "âˆ", "ï¿½")
_PAIR = re.compile("[ÃÂÎ][\x80-\xbf]")
_HIGH_CONTROL = re.compile("[\x80-\x9f]")


def suspicion(text: str) -> int:
    """How many signs of wrong decoding a text shows; a lost character counts four times."""
    return sum(map(text.count, SIGNS)) + len(_PAIR.findall(text)) + 4 * text.count("�") + len(_HIGH_CONTROL.findall(text))


def _read_again(text: str, wrong: str) -> str | None:
    try:
        return text.encode(wrong).decode()
    except UnicodeError:
        return None


def repair(text: str, passes: int = 2) -> tuple[str, int, list[str], str | None]:
    """(text, repairs, warnings, reason of rejection): wrong decoding undone where that lowers the suspicion.

    A whole text is read back strictly from cp1252 or latin-1; the least
    suspicious result counts, the smaller text of equals. Text that no reading
    improves is left as it is.
    """
    if "�" in text:
        return text, 0, [], "replacement_character"
    score = before = suspicion(text)
    if not score:
        return text, 0, [], None
    now, repairs = text, 0
    while score and repairs < passes:
        better = [(suspicion(x), x) for x in (_read_again(now, e) for e in ("cp1252", "latin-1")) if x is not None and "�" not in x]
        better = [b for b in better if b[0] < score]
        if not better:
            break
        score, now = min(better)
        repairs += 1
    if score < before:
        return now, repairs, ["encoding_repaired"] + (["residual_mojibake_markers"] if score else []), "low_confidence_encoding_corruption" if score else None
    return text, 0, ["suspicious_mojibake_markers"], "low_confidence_encoding_corruption"


# Fields of a template that are named; others with an equals sign are plain values.
NAMED = {"text", "quote", "title", "lang", "abbr", "disp", "output"}
# Names of templates by what is kept of them.
ALL_JOINED = {"chem", "chem2", "chemical formula"}
FIRST = {"math", "mvar", "var", "nowrap", "nobr", "italic title", "title"}
FRACTIONS, MEASURES = {"sfrac", "frac"}, {"convert", "cvt"}
LAST = {"transl", "transliteration"}
QUOTES = {"quote", "quotation", "blockquote"}
LISTS = {"ubl", "unbulleted list", "plainlist", "flatlist"}


def parse_template(template: str) -> tuple[str, list[str], dict[str, str]]:
    """Name (folded, underscores as spaces), plain values and named values of a template in double braces."""
    head, *fields = (x.strip() for x in template[2:-2].split("|"))
    plain, named = [], {}
    for field in fields:
        key, sign, value = field.partition("=")
        key = key.casefold().strip()
        if sign and (key.isdigit() or key in NAMED):
            named[key] = value.strip()
        elif field:
            plain.append(field)
    return head.casefold().replace("_", " ").strip(), plain, named


def render_template(template: str) -> str | None:
    """What a reader sees of a template, null for those that are unknown or have nothing to show."""
    name, plain, named = parse_template(template)
    first, one = (plain or [None])[0], named.get("1")
    if name in ALL_JOINED:
        return "".join(plain) or one
    if name in FIRST:
        return first if plain else one
    if name in FRACTIONS and len(plain) > 1:
        return "/".join(plain[-2:])
    if name in MEASURES and len(plain) > 1:
        return " ".join(plain[:2])
    if name == "lang" and len(plain) > 1:
        return plain[1]
    if name == "lang" or name.startswith("lang-"):
        return first if plain else named.get("text")
    if name in LAST:
        return plain[-1] if plain else named.get("text")
    if name in QUOTES:
        return named.get("text") or named.get("quote") or first
    if name in LISTS:
        return "\n".join(plain) if plain else one
    return named.get("title") if name.startswith("cite ") else None


_INNERMOST = re.compile(r"\{\{[^{}]*\}\}")


def replace_templates(text: str) -> tuple[str, int, int]:
    """(text, removed, preserved): templates rendered from the inside out until none is left."""
    counts = [0, 0]

    def shown(m: re.Match) -> str:
        seen = (render_template(m.group()) or "").strip()
        counts[bool(seen)] += 1
        return f" {seen} " if seen else " "

    found = 1
    while found:
        text, found = _INNERMOST.subn(shown, text)
    return text, *counts


_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REFERENCE = re.compile(r"<ref\b[^>]*>.*?</ref\s*>|<ref\b[^>]*/\s*>", re.I | re.S)
_EMPHASIS = re.compile(r"'{2,5}([^'\n]+?)'{2,5}")
_CITATION = re.compile(r"\[(?:\d{1,4}|citation needed)\]", re.I)
_BLANKS, _BEFORE_MARK = re.compile(r"[ \t]+"), re.compile(r"\s+([,.;:!?])")


def clean(text: str | None) -> tuple[str, dict[str, int], list[str], str | None]:
    """(text, counts, warnings, reason): text for training, with what was removed; empty where the encoding can't be trusted."""
    now, repairs, warnings, reason = repair(text or "")
    counts = {"encoding_repairs": repairs, "comments": 0, "references": 0, "templates_removed": 0, "templates_preserved": 0, "citations": 0}
    if reason:
        return "", counts, warnings, reason
    now = re.sub("\r\n?", "\n", unicodedata.normalize("NFC", now))
    now, counts["comments"] = _COMMENT.subn(" ", now)
    now, counts["references"] = _REFERENCE.subn(" ", now)
    now, counts["templates_removed"], counts["templates_preserved"] = replace_templates(now)
    now, counts["citations"] = _CITATION.subn(" ", _EMPHASIS.sub(r"\1", now))
    lines = [_BEFORE_MARK.sub(r"\1", _BLANKS.sub(" ", x).strip()) for x in now.splitlines()]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines).strip("\n")).strip(), counts, warnings, None
