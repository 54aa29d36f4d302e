"""Cutting documents into chunks of a target number of tokens, along sections, paragraphs and sentences."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

_PARAGRAPHS, _SENTENCES = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")
# Titles at which the references of an article begin.
REFERENCES = frozenset(("bibliography", "citations", "editions", "external links", "further reading", "general and cited references", "notes", "publications", "references", "see also", "sources", "works cited"))
Count = Callable[[str], int]


@dataclass(frozen=True)
class Chunk:
    text: str
    tokens: int
    section: str | None
    start: str = "paragraph"
    end: str = "paragraph"
    overlap: int = 0


@dataclass(frozen=True)
class Limits:
    """Numbers of tokens: chunks reach target and stay within most, smaller ones than least are merged or dropped."""

    target: int = 256
    most: int = 384
    least: int = 48
    overlap: int = 24

    def __post_init__(self):
        if not 0 <= self.overlap < self.least <= self.target <= self.most:
            raise ValueError("limits must satisfy 0 <= overlap < least <= target <= most")


def is_reference_title(line: str) -> bool:
    return " ".join(re.sub(r"[^\w\s]", " ", line.casefold()).split()) in REFERENCES


def is_heading(paragraph: str) -> bool:
    """A line of up to 12 words and 120 characters that begins with a capital and ends without punctuation."""
    return "\n" not in paragraph and paragraph[:1].isupper() and len(paragraph) <= 120 and len(paragraph.split()) <= 12 and paragraph.rstrip()[-1:] not in tuple(".!?;:,")


def _longest(n: int, fits: Callable[[int], bool]) -> int:
    """The largest of 0..n that fits, if all smaller ones do."""
    return bisect_right(range(1, n + 1), False, key=lambda i: not fits(i))


def words_within(sentence: str, count: Count, most: int, start: str, end: str) -> Iterator[tuple[str, str, str]]:
    """(text, kind of start, kind of end): a sentence in pieces of at most ``most`` tokens, cut between words where one ends in reach."""
    rest, begin = sentence, start
    while count(rest) > most:
        room = _longest(len(rest), lambda i: count(rest[:i]) <= most)  # noqa: B023
        if not room:
            raise ValueError("one character has more tokens than a chunk may have")
        cut = next((i for i in range(room, 0, -1) if i == len(rest) or not (rest[i - 1].isalnum() and rest[i].isalnum())), 0)
        kind = "word_fallback" if cut else "token_fallback"
        piece, rest = (rest[:cut].rstrip(), rest[cut:].lstrip()) if cut else (rest[:room], rest[room:])
        if not piece:
            raise ValueError("a piece without text")
        yield piece, begin, kind
        begin = kind
    if rest.strip():
        yield rest.strip(), start if begin == start else "word_fallback", end


def units(text: str, count: Count, most: int, references: str = "keep") -> tuple[list[Chunk], int]:
    """Paragraphs, or their sentences where they are too long, with their section; and how many reference sections ended the text.

    references: "keep" (they are sections like others), "flag" (likewise) or
    "exclude" (the text ends at the first).
    """
    out: list[Chunk] = []
    section = None

    def add(paragraph: str) -> None:
        if not paragraph:
            return
        if count(paragraph) <= most:
            out.append(Chunk(paragraph, 0, section))
            return
        parts = [x.strip() for x in _SENTENCES.split(paragraph) if x.strip()]
        for i, x in enumerate(parts):
            edges = "paragraph" if i == 0 else "sentence", "paragraph" if i == len(parts) - 1 else "sentence"
            out.extend(Chunk(t, 0, section, a, z) for t, a, z in words_within(x, count, most, *edges))

    for paragraph in filter(None, map(str.strip, _PARAGRAPHS.split(text))):
        lines = [x for x in map(str.strip, paragraph.splitlines()) if x]
        at = next((i for i, x in enumerate(lines) if is_reference_title(x)), None)
        if at is not None:
            add("\n".join(lines[:at]))
            if references == "exclude":
                return out, 1
            section = lines[at]
            add("\n".join(lines[at + 1 :]))
        elif is_heading(paragraph):
            section = paragraph
        else:
            add(paragraph)
    return out, 0


def tail(text: str, count: Count, most: int) -> str:
    """The sentences at a text's end that have at most so many tokens together; none if no sentence begins there."""
    room = _longest(len(text), lambda i: count(text[len(text) - i :]) <= most) if most else 0
    end = text[len(text) - room :]
    return next((x for m in _SENTENCES.finditer(end) if (x := end[m.end() :].strip())), "")


def packed(parts: list[Chunk], count: Count, limits: Limits) -> list[Chunk]:
    """Units joined while they fit and the target isn't reached; each chunk begins with the last sentences of the one before, except in a new section."""
    out: list[Chunk] = []
    open_: Chunk | None = None

    def close() -> None:
        if open_ and open_.text.strip():
            out.append(replace(open_, text=open_.text.strip(), tokens=count(open_.text.strip())))

    for u in parts:
        if open_ and u.section is not None and u.section != open_.section:
            close()
            open_ = None
        if open_ and (count(open_.text) >= limits.target or count(f"{open_.text}\n\n{u.text}") > limits.most):
            close()
            again = tail(open_.text, count, limits.overlap)
            if again and count(f"{again}\n\n{u.text}") <= limits.most:
                open_ = Chunk(again, 0, open_.section, "sentence", u.end, len(again))
            else:
                open_ = Chunk("", 0, None if again else open_.section, u.start)
        if open_ is None:
            open_ = Chunk("", 0, None, u.start)
        open_ = replace(open_, text=f"{open_.text}\n\n{u.text}" if open_.text else u.text, section=open_.section or u.section, end=u.end)
    close()
    return out


def merged(chunks: list[Chunk], count: Count, limits: Limits) -> tuple[list[Chunk], int]:
    """Small chunks joined to the one before, else to the one after, of the same section if both fit; others are dropped and counted."""
    out: list[Chunk] = []
    dropped, todo = 0, list(reversed(chunks))
    while todo:
        c = todo.pop()
        if c.tokens >= limits.least:
            out.append(c)
            continue
        own = lambda x: x.text[x.overlap :].lstrip() if x.overlap > 0 else x.text
        if out and out[-1].section == c.section and (n := count(both := f"{out[-1].text}\n\n{own(c)}".strip())) <= limits.most:
            out[-1] = replace(out[-1], text=both, tokens=n, end=c.end)
        elif todo and todo[-1].section == c.section and (n := count(both := f"{own(c)}\n\n{own(todo[-1])}".strip())) <= limits.most:
            todo[-1] = replace(c, text=both, tokens=n, end=todo[-1].end)
        else:
            dropped += 1
    return out, dropped


def chunks(text: str | None, count: Count, limits: Limits = Limits(), references: str = "keep") -> tuple[list[Chunk], int, int]:
    """The chunks of a text, how many small ones were dropped, and how many reference sections ended it. Null and empty texts give none."""
    if references not in ("keep", "flag", "exclude"):
        raise ValueError("references must be keep, flag or exclude")
    parts, ended = units(text or "", count, limits.most, references)
    kept, dropped = merged(packed(parts, count, limits), count, limits)
    return kept, dropped, ended
