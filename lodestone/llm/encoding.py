"""Garbled text from wrong character encoding (problem 5).

Tables of garbled sequences are computed once per worker, by rule, for all
pairs of a true and a wrong encoding, and put into one multi-pattern
automaton. Only matched spans are replaced, so correct text around them stays.

* UTF-8 read as a one-byte encoding. The automaton holds what the first two
  bytes of every character give in each wrong encoding; the bytes after are
  read back and must end an assigned character. Sequences that also occur in
  correct text (a capital letter and a quotation mark, say) count only beside
  another one of the same pair; those of rarer characters that are letters of
  one alphabet only where they make up their whole word.
* A one-byte encoding read as another: single characters. They count where
  correct text can't have them (a capital or a symbol within a lower-case
  word, a sign between a number and a unit, a word of accented letters only).
  Once a text has such a place, the other changed characters of the pair are
  restored as well.
* East Asian two-byte encodings read as Western: long runs without ASCII.
* Replacement characters, C1 controls and cut sequences: reported, and
  restored only where the sequence is whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The encodings that text is wrongly read in.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "cp1257", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "cp1253", "cp1255", "cp1256", "cp1258", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15", "koi8_u")

_BOX = range(0x2500, 0x25A0)
# Signs that follow letters in correct text.
_PLAIN = set("“”‘’„‚–—…«»‹›!?.,;:() ­ \"'·")


def _read(raw: bytes, enc: str) -> str | None:
    """Bytes read in a wrong encoding; undefined ones become C1 controls, as common readers do."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            if not enc.startswith("cp125"):
                return None
            out.append(chr(b))
    return "".join(out)


# Ranges of the characters that garbled text of the common kinds stands for; others need more evidence.
_COMMON = ((0xA0, 0x180), (0x218, 0x21C), (0x300, 0x340), (0x370, 0x460), (0x490, 0x492), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2300), (0x2500, 0x2800), (0x3000, 0x3100), (0x4E00, 0xA000), (0xFB00, 0xFB07), (0xFE00, 0xFE10), (0xFEFF, 0xFF00), (0xFF01, 0xFF5F), (0x1F300, 0x1FB00))
_FIRST = len(WRONG) - 9  # the encodings before it are the common ones


@cache
def _byte_tables() -> list[tuple[str, list[str | None], dict[str, int]]]:
    """For each wrong encoding: the character of each byte, and the byte of each character."""
    out = []
    for enc in WRONG:
        chars = [_read(bytes([b]), enc) for b in range(256)]
        out.append((enc, chars, {c: b for b, c in enumerate(chars) if c is not None and b > 127}))
    return out


@cache
def utf8_automaton():
    """Automaton of what the first two bytes of a character of UTF-8 give in the wrong encodings; values: [(encoding's number, length)]."""
    import ahocorasick

    table: dict[str, list] = {}
    for number, (_, chars, _) in enumerate(_byte_tables()):
        for lead in range(0xC2, 0xF5):
            size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            for after in range(0x80, 0xC0):
                if chars[lead] is not None and chars[after] is not None:
                    table.setdefault(chars[lead] + chars[after], []).append((number, size))
    machine = ahocorasick.Automaton()
    for start, how in table.items():
        machine.add_word(start, how)
    machine.make_automaton()
    return machine


def _weak(bad: str) -> bool:
    """Whether a sequence is of such characters as stand together in correct text."""
    if (len(bad) == 2 or bad[0].isalpha() and ord(bad[0]) > 0x24F) and all(c in _PLAIN for c in bad[1:]):
        return True
    return bad.isalpha() and len({_alphabet(x) for x in bad}) == 1 and not any(x.islower() and y.isupper() for x, y in zip(bad, bad[1:], strict=False))


_SEQUENCES: dict[str, tuple[str, list]] = {}


def _sequence(window: str) -> tuple[str, list]:
    """The longest garbled sequence at the start of a window of four characters, with [(encoding, restored, weak, rare)]."""
    got = _SEQUENCES.get(window)
    if got is None:
        if len(_SEQUENCES) > 200_000:
            _SEQUENCES.clear()
        best: dict[int, list] = {}
        for number, size in utf8_automaton().get(window[:2], ()):
            enc, _, back = _byte_tables()[number]
            bad = window[:size]
            raw = [back.get(c) for c in bad]
            if len(bad) < size or None in raw:
                continue
            try:
                c = bytes(raw).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if unicodedata.category(c) not in ("Cn", "Co", "Cs") and c != bad:
                cp = ord(c)
                rare = number >= _FIRST or not any(a <= cp < z for a, z in _COMMON)
                best.setdefault(size, []).append((enc, c, _weak(bad), rare))
        size = max(best, default=0)
        # Pairs of common kinds go before those of rare ones.
        how = best.get(size, [])
        if any(not r for *_, r in how):
            how = [h for h in how if not h[3]]
        got = _SEQUENCES[window] = (window[:size], how)
    return got


_CYRILLIC = re.compile("[а-я]{2}")


def _alphabet(c: str) -> str:
    return unicodedata.name(c, " ").split(" ")[0]


def _whole_run(text: str, at: int) -> bool:
    """Whether the characters above ASCII around a place decompose into two sequences or more of one script."""
    a = z = at
    while a > 0 and text[a - 1] > "\x7f":
        a -= 1
    while z < len(text) and text[z] > "\x7f":
        z += 1
    return _decomposes(text[a:z])


@lru_cache(maxsize=50_000)
def _decomposes(word: str) -> bool:
    for enc in WRONG:
        i, scripts, n = 0, set(), 0
        while i < len(word):
            bad, how = _sequence(word[i : i + 4])
            c = next((x[1] for x in how if x[0] == enc), None)
            if c is None:
                break
            scripts.add(_alphabet(c))
            i, n = i + len(bad), n + 1
        if i >= len(word) and n >= 2 and len(scripts) == 1:
            return True
    return False


def _utf8_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, restored) of garbled UTF-8 sequences, longest first at each place."""
    hits: dict[int, tuple[str, list]] = {}
    later: dict[int, tuple[str, list]] = {}
    for end, _ in utf8_automaton().iter(text):
        bad, how = _sequence(text[end - 1 : end + 3])
        if how:
            doubtful = how[0][3] and all(c.isalpha() or c in _PLAIN for c in bad) and not _whole_run(text, end - 1)
            (later if doubtful else hits)[end - 1] = (bad, [h[:3] for h in how])
    if later and hits:
        # Doubtful sequences of a pair count where two others show that pair.
        seen = Counter(e for _, how in hits.values() for e, _, weak in how if not weak)
        hits |= {at: (bad, some) for at, (bad, how) in later.items() if (some := [h for h in how if seen[h[0]] > 1])}
    if not hits:
        return []
    # Which encodings have certain evidence in this text, and where sequences touch.
    sure: dict[str, int] = {}
    chosen, last = [], 0
    for at in sorted(hits):
        if at < last:
            continue
        bad, how = hits[at]
        chosen.append((at, bad, how))
        last = at + len(bad)
        for enc, _, weak in how:
            if (not weak or _mid_word(text, at)) and _fits(text, at, bad):
                sure[enc] = sure.get(enc, 0) + 1
    runs: dict[str, int] = {}
    for (p, bad, how), (q, _, after) in zip(chosen, chosen[1:], strict=False):
        if p + len(bad) == q:
            for enc in {e for e, *_ in how} & {e for e, *_ in after}:
                runs[enc] = runs.get(enc, 0) + 1
    best = sorted({*sure, *runs}, key=lambda e: (-sure.get(e, 0) - runs.get(e, 0), WRONG.index(e)))
    out = []
    for at, bad, how in chosen:
        options = {enc: c for enc, c, _ in how}
        enc = next((e for e in best if e in options), how[0][0] if bad[0] in "ÃÂÐÑ" else None)
        if enc is None:
            continue
        weak = next(w for e, _, w in how if e == enc) and not _mid_word(text, at)
        if weak and not _beside(text, at, bad, enc) and ((at > 0 and text[at - 1].isupper()) or not sure.get(enc)):
            # Alone, it counts after a space, digit or small letter, where no capital ends a word.
            lone = at > 0 and (text[at - 1].isspace() or text[at - 1].isdigit() or text[at - 1].islower())
            if not (lone and (bad[0] in "ÃÂ" or (bad[0] in "ÐÑ" and _CYRILLIC.search(text)))):
                continue
        if not weak and not _fits(text, at, bad):
            continue
        out.append((at, at + len(bad), options[enc]))
    return out


def _mid_word(text: str, at: int) -> bool:
    """Whether a capital stands right after a small letter here."""
    return at > 0 and text[at - 1].islower() and text[at].isupper()


def _beside(text: str, at: int, bad: str, enc: str) -> bool:
    """Whether another sequence of the pair touches this one."""
    for n in (2, 3):
        for piece in (text[at + len(bad) : at + len(bad) + n], text[max(0, at - n) : at]):
            if len(piece) == n:
                got, how = _sequence(piece)
                if got == piece and any(e == enc for e, *_ in how):
                    return True
    return False


def _fits(text: str, at: int, bad: str) -> bool:
    """False where a match is likely drawn lines or mathematics."""
    if any(ord(c) in _BOX for c in bad):
        around = text[max(0, at - 1) : at] + text[at + len(bad) : at + len(bad) + 1]
        box = sum(ord(c) in _BOX for c in bad)
        if box == len(bad) and any(ord(c) in _BOX for c in around) and not any(c.isalpha() for c in around):
            return False
    if bad[0] == "√":
        around = text[max(0, at - 1) : at] + text[at + len(bad) : at + len(bad) + 1]
        return any(c.isalpha() for c in around) or bad[1] not in "πΩ∞≤≥∏∑∫"
    return True


def _pair(true: str, wrong: str) -> dict[str, str]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            good, bad = bytes([b]).decode(true), bytes([b]).decode(wrong)
        except UnicodeDecodeError:
            continue
        if good != bad and not bad.isspace() and bad != "\xad" and bad.isprintable():
            out[bad] = good
    return out


# One-byte pairs (true, wrong) of Western text, and of Cyrillic text.
WESTERN = (("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp437", "cp1252"))
CYRILLIC = (("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("cp1251", "mac_roman"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"))
# Letters that Western texts are written with.
_LATIN = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜŒ")
_MARKS = set("“”‘’„‚–—…«»€×°¿¡£§©®·")
# Signs that join or follow small letters in correct text, so that they are no evidence alone.
_JOINING = set("’‘“”·'­–—…•™†‡®©°‹›/")


@cache
def _western() -> list[tuple[str, str, dict[str, str], re.Pattern, re.Pattern]]:
    """(true, wrong, table, forms of evidence, the form of which one place is enough)."""
    out = []
    for true, wrong in WESTERN:
        table = {bad: good for bad, good in _pair(true, wrong).items() if good in _LATIN | _MARKS}
        letters = {b for b, g in table.items() if g in _LATIN and g.islower()}
        caps = "".join(re.escape(b) for b in letters if b.isupper())
        signs = "".join(re.escape(b) for b in letters if not b.isalpha() and b not in "’‘“”„·'­")
        first = "".join(re.escape(b) for b in letters if not b.isalpha() and b not in "’‘“”„‚·'­†‡•°©®™")
        dot = re.escape("·") if "·" in letters else ""
        quote_in = "".join(re.escape(b) for b, g in table.items() if g in "“„«¿¡" and b.isalpha())
        quote_out = "".join(re.escape(b) for b, g in table.items() if g in "”»" and b.isalpha())
        dash = "".join(re.escape(b) for b, g in table.items() if g in "—–" and b.isalpha())
        euro = "".join(re.escape(b) for b, g in table.items() if g == "€" and b != "€")
        times = "".join(re.escape(b) for b, g in table.items() if g == "×")
        degree = "".join(re.escape(b) for b, g in table.items() if g == "°")
        low = "a-zß-öø-ÿœ"
        forms = []
        if caps:
            forms += [rf"[{low}][{caps}][{low}]", rf"[a-z]{{2}}[{caps}](?![\w’'])"]
        if signs:
            forms += [rf"[a-z][{signs}][a-z]"]
            if wrong == "mac_roman":
                forms += [rf"[A-Z][{signs}][a-z]", rf"(?<![^\s(“„«´ìÑ])[{first}][a-z]{{2}}"]
        if dot:
            forms += [r"(?:[a-km-z]·[a-z]|[a-z]·[a-km-z])"]
        if quote_in:
            forms += [rf"(?<!\w)[{quote_in}][A-Z][a-z]"]
        if quote_out:
            forms += [rf"[.,!?][{quote_out}](?!\w)"]
        if dash:
            forms += [rf"(?<=[a-z\d]) [{dash}] (?=[a-z])"] if wrong == "mac_roman" else []
        if euro:
            forms += [rf"\d [{euro}](?= [a-z])"]
        if times:
            forms += [rf"\d ?[{times}] ?\d"]
        if degree:
            forms += [rf"\d ?[{degree}][CF]\b"]
        odd = "".join(re.escape(b) for b in letters - _JOINING if b.isupper() or not b.isalpha() or _alphabet(b) == "GREEK")
        alone = [rf"[{low}]{{2}}[{odd}][{low}]|[{low}][{odd}][{low}]{{2}}"]
        form = re.compile("|".join(alone + forms))
        out.append((true, wrong, table, form, form if "mac_roman" in (true, wrong) else re.compile(alone[0])))
    return out


@cache
def _cyrillic() -> list[tuple[str, str, dict[str, str]]]:
    return [(t, w, {b: g for b, g in _pair(t, w).items() if "А" <= g <= "я" or g in "ёЁ"}) for t, w in CYRILLIC]


_WORDS = re.compile(r"(?<![A-Za-z])[ª-˿Ѐ-ӿ─-■]{2,}+(?![A-Za-z])")
# How often letters stand in Russian text, in percent.
_RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (11.0, 8.5, 8.0, 7.4, 6.7, 6.3, 5.5, 4.7, 4.5, 4.3, 3.5, 3.2, 3.0, 2.8, 2.6, 2.0, 1.9, 1.7, 1.7, 1.6, 1.6, 1.4, 1.2, 1.0, 0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.3, 0.04, 0.04), strict=True))


def _likeness(ws: list[str]) -> float:
    """The mean share of the letters in Russian text; less for words of mixed case."""
    total = n = 0
    for w in ws:
        n += len(w)
        if w[1:].islower() or w.isupper() or len(w) == 1:
            total += sum(_RUSSIAN.get(c, 0) for c in w.lower())
    return total / n if n else 0.0


def _latin_looking(text: str) -> dict[str, str] | None:
    """The table of the pair that makes the accented words of a sentence Russian, if one does; Cyrillic words don't count.

    Fewer letters than 10 count only with a word of 5 accented letters or more.
    """
    ws = [w for w in _WORDS.findall(text) if any(c.isalpha() for c in w) and not any("Ѐ" <= c <= "ӿ" for c in w)]
    best = None
    for (_, wrong), (_, _, table) in zip(CYRILLIC, _cyrillic(), strict=True):
        own = [w for w in ws if all(c in table for c in w)]
        n, good = sum(map(len, own)), ["".join(table[c] for c in w) for w in own]
        if wrong not in ("cp1252", "mac_roman") or n * 2 < sum(map(len, ws)) or not any(len(w) >= 4 for w in own):
            continue
        if n < 10 and not any(len(w) >= 5 and g.islower() and all("À" <= c <= "ÿ" for c in w) for w, g in zip(own, good, strict=True)):
            continue
        like = _likeness(good)
        if like > 4.0 and (best is None or like > best[0]):
            best = like, table
    return best[1] if best else None


def _single_byte(text: str) -> tuple[str, bool]:
    """Text with the characters of one-byte pairs restored, and whether there was evidence of one."""
    ws = [w for w in _WORDS.findall(text) if any(c.isalpha() for c in w)]
    if sum(map(len, ws)) >= 10:
        now, best = _likeness(ws), None
        for _, _, table in _cyrillic():
            own = [w for w in ws if all(c in table for c in w)]
            if sum(map(len, own)) * 2 < sum(map(len, ws)):
                continue
            like = _likeness(["".join(table[c] for c in w) for w in own])
            if like > 4.0 and like > 1.3 * now and (best is None or like > best[0]):
                best = like, table
        if best:
            table = best[1]
            fix = lambda m: "".join(table.get(c, c) for c in m.group())
            return re.sub(r"(?<![A-Za-z])[¡-˿Ѐ-ӿ─-■]++(?![A-Za-z])", fix, text), True
    # Other texts are judged sentence by sentence; only words that the pair explains whole are restored.
    parts, hit = re.split(r"(?<=[.!?\n])(\s+)", text), False
    for i, x in enumerate(parts):
        if not x.isascii() and (table := _latin_looking(x)):
            hit, parts[i] = True, _WORDS.sub(lambda m: "".join(table[c] for c in m.group()) if all(c in table for c in m.group()) else m.group(), x)  # noqa: B023
    if hit:
        return "".join(parts), True
    now, seen = text, set()
    while True:
        best = None
        evidence = _evidence(now)
        for number, (_, _, table, form, _) in enumerate(_western()):
            # Evidence that an earlier pair explains isn't another one's.
            new = {c: g for c, g in table.items() if c not in seen}
            proof = [m for m in evidence[number][0] if any(c in new for c in m)]
            # Two places count if not all their signs are such as join words in correct text.
            enough = any(c in new for m in evidence[number][1] for c in m) or (len(proof) >= 2 and any(c in new and c not in _JOINING for m in proof for c in m))
            if enough and (best is None or len(proof) > best[0]):
                best = len(proof), new, form
        if best is None:
            return now, bool(seen)
        # Sentences that hold evidence are restored whole, others are left as they are.
        _, new, form = best
        seen |= set(new)
        parts = re.split(r"(?<=[.!?\n])(\s+)", now)
        now = "".join("".join(new.get(c, c) for c in x) if any(c in new for m in form.findall(x) for c in m) else x for x in parts)


_BEYOND = re.compile(r"[^\x00-\x7f]+")
# The patterns tell ASCII letters apart only as far as this.
_FLAT = str.maketrans({**{c: "a" for c in "abcdefghijkmnopqrstuvwxyz"}, **{c: "A" for c in "ABDEGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "123456789"}, "\n": " ", "\t": " "})
_CONTEXTS: dict[tuple[str, int, int], list] = {}


def _evidence(text: str) -> list[tuple[list[str], list[str]]]:
    """For each Western pair the places of evidence, and those of which one is enough.

    Only what surrounds characters beyond ASCII is looked at, with its ASCII
    letters made alike, so that nearly all contexts have been met before.
    """
    out = [([], []) for _ in WESTERN]
    flat = text.translate(_FLAT)
    for m in _BEYOND.finditer(flat):
        a, z = m.span()
        key = (flat[max(0, a - 4) : z + 4], min(a, 4), z - a)
        got = _CONTEXTS.get(key)
        if got is None:
            if len(_CONTEXTS) > 300_000:
                _CONTEXTS.clear()
            x, at, n = key
            own = lambda p: [h.group() for h in p.finditer(x) if h.start() < at + n and h.end() > at]  # noqa: B023, E731
            got = [(i, own(form), own(alone)) for i, (_, _, _, form, alone) in enumerate(_western())]
            got = _CONTEXTS[key] = [g for g in got if g[1] or g[2]]
        for i, f, s in got:
            out[i][0].extend(f), out[i][1].extend(s)
    return out


# Letters of other languages by how often they stand in text, the commonest first; and the one-byte encodings of their alphabets.
OTHER_LETTERS = {"GREEK": "αοιετσνηυρπκμλωςδγχθφβξζψ", "HEBREW": "יוהלאמרתבשנעםדקפחןטצגסכזץךף", "ARABIC": "اليمنوتربةعدسفهكقحجشطصخضذزثغظ", "THAI": "านรกเงอมยลวดทสตปบคพหชจขผแไใโ"}
OTHER_ALPHABETS = (("cp1253", "GREEK"), ("cp1255", "HEBREW"), ("cp1256", "ARABIC"), ("cp874", "THAI"), ("iso8859_7", "GREEK"), ("mac_greek", "GREEK"))
_HIGH_RUN = re.compile(r"[\x80-\xffŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{4,}")
# Two-byte encodings, with the lead bytes of their common characters.
TWO_BYTE = (("gb2312", 0xB0, 0xD7), ("euc_kr", 0xB0, 0xC8), ("big5", 0xA4, 0xC6), ("euc_jp", 0xA4, 0xCF))


def _plain_marks(c: str) -> str:
    """A letter without its accents."""
    return unicodedata.normalize("NFD", c)[0]


@lru_cache(maxsize=20_000)
def _other_script(run: str) -> str | None:
    """What a run of characters above ASCII was, if it is text of another alphabet or of a two-byte encoding; None if it may be correct."""
    raw = []
    back = _byte_tables()[0][2]
    for c in run:
        if c not in back:
            return None
        raw.append(back[c])
    raw, best = bytes(raw), None
    for cut in (raw, raw[:-1], raw[1:]):  # the sequences of UTF-8 have their own table
        try:
            return cut.decode("utf-8") and None
        except UnicodeDecodeError:
            pass
    letters = sum(b >= 0xC0 for b in raw)
    for enc, alphabet in OTHER_ALPHABETS:
        try:
            text = raw.decode(enc)
        except UnicodeDecodeError:
            continue
        order = OTHER_LETTERS[alphabet]
        own = [_plain_marks(c.lower()) for c in text if c.isalpha()]
        if len(own) < 4 or any(_alphabet(c) != alphabet for c in text if c.isalpha()) or not (text[1:].islower() or text.lower() == text or text.isupper()):
            continue
        like = sum(11 * 0.88 ** order.find(c) if c in order else 0 for c in own) / len(own)
        if like > 4.0 and (best is None or like > best[0]):
            best = like, text
    if best is None and len(raw) >= 6 and len(raw) % 2 == 0 and letters < len(raw):
        for enc, lo, hi in TWO_BYTE:
            try:
                text = raw.decode(enc)
            except UnicodeDecodeError:
                continue
            share = sum(lo <= b <= hi for b in raw[::2]) / len(text)
            if share >= 0.8 and all(ord(c) > 0x2E7F for c in text) and (best is None or share > best[0]):
                best = share, text
    return best[1] if best else None


def _other_runs(text: str) -> tuple[str, bool]:
    """Text with the runs of other alphabets and of two-byte encodings restored, and whether there was one."""
    hit = False

    def fix(m: re.Match) -> str:
        nonlocal hit
        a, z = m.span()
        if (a and text[a - 1].isascii() and text[a - 1].isalnum()) or (z < len(text) and text[z].isascii() and text[z].isalnum()):
            return m.group()
        now = _other_script(m.group())
        hit = hit or now is not None
        return m.group() if now is None else now

    return _HIGH_RUN.sub(fix, text), hit


_LOST = re.compile("[�\u0080-\u0084\u0086-\u009f]")
# Beginnings of garbled punctuation that lost its last character.
_CUT = re.compile("â€|вЂ|ΓÇ|ÔÇ|‚Ä|Ã¢â|Гў|Ă˘")


def restore(text: str | None) -> tuple[bool, str | None, bool]:
    """(garbled, text with the garbled spans restored, whether nothing garbled is left).

    Null and plain ASCII are never garbled. Text that was garbled more than
    once is restored step by step.
    """
    if text is None or text.isascii():
        return False, text, True
    now, garbled = text, False
    while spans := _utf8_spans(now):  # each pass makes the text shorter
        garbled, parts, last = True, [], 0
        for a, b, c in spans:
            parts += [now[last:a], c]
            last = b
        now = "".join(parts) + now[last:]
    fixed, hit = _single_byte(now)
    if not hit:
        fixed, hit = _other_runs(now)
    if hit:
        garbled, now = True, fixed
    lost = bool(_LOST.search(now) or _CUT.search(now))
    return garbled or lost, now, not lost


def repaired(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored, whole): the rows of df whose text is garbled.

    whole is false where some characters are lost for good. Repeated rows of a
    key count once; rows without key or text give none.
    """

    def run(batches):
        for b in batches:
            keys, out, whole = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bad, now, all_ = restore(t)
                if bad:
                    keys.append(k), out.append(now), whole.append(all_)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(out, pa.string()), pa.array(whole, pa.bool_())], ["k", "restored", "whole"])

    rows = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    # Only texts beyond ASCII go to Python.
    rows = rows.filter(F.col(text).rlike(r"[^\x00-\x7f]"))
    out = rows.mapInArrow(run, f"k {dict(df.dtypes)[key]}, restored string, whole boolean")
    return out.groupBy(F.col("k").alias(key)).agg(F.min("restored").alias("restored"), F.min("whole").alias("whole"))
