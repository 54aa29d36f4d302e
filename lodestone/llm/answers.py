"""Broken prompt and response pairs (problem 6).

One defect or none for each pair, looked for in this order:

* empty: nothing visible, only punctuation, or a placeholder;
* copied: the response's words align with the prompt's (longest common
  subsequence over the prompt, repeated where the response is longer, and
  shingle containment) with no longer stretch of its own;
* refusal: the response's sentences align with refusal templates (who, refuses,
  what, in any order), and all but a small share of it does or stands beside;
* other_language: prose whose function words are of another language than the
  prompt's, which does not ask for that language;
* truncated: an open quotation, bracket, fence or list item, a dangling comma,
  colon, marker or abbreviation, or prose that ends without a full stop.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import words

# Words that stand for a missing answer.
PLACEHOLDERS = frozenset("none;null;nil;na;n a;nan;tbd;tba;todo;empty;blank;no response;no answer;no output;response;answer;undefined;missing;placeholder;your answer here;insert response here;to be done;pending;void;left blank;no data;not available;not applicable;lorem ipsum;xxx;deleted;removed;redacted;withheld;content removed;answer removed;no comment;unknown response;see above;coming soon;under construction;not provided;no text;no content;keine antwort;pas de reponse;sin respuesta;sem resposta;нет ответа".split(";"))

# Refusal templates: what is refused (A), how (N) and by whom (S), folded, by language; * stands for any ending.
# A sentence refuses where it has all three, in any order; words of two parts are written with _.
REFUSAL_WORDS = {
    "en": ("i me my myself we our this_assistant the_assistant ai model",
           "cannot can_t won_t will_not does_not doesn_t do_not don_t would_not wouldn_t am_not m_not are_not re_not unable refus* declin* must_pass pass_on nothing no_answer no_reply no_response never outside beyond impossible not_possible not_appropriate off_limits turn_down turned_down unwilling prefer_not rather_not not_comfortable don_t_feel do_not_feel don_t_have do_not_have not_allowed not_permitted keep_me keeps_me prevent* forbid* prohibit* leave skip abstain against not_something",
           "help* assist* answer* respond* response reply* discuss* talk* comment* comply request* question* topic* subject* matter* conversation* write writing say speak share provid* information guidelines access role scope task remit get_into go_into engag* do_that do_this tell explain advice advise take_part take_up come_from hear_from get_from"),
    "de": ("ich mir mich mein* meine* wir uns* assistent*", "nicht nichts kein* ablehn* verweiger* ausserhalb unmoglich leider_nicht offen untersag* lieber_nicht weiger*", "helf* hilfe antwort* beantwort* frag* anfrage* thema dazu aufgabe* auskunft sagen aussern sprechen unterstutz* behilflich information* dieser_bitte"),
    "fr": ("je j me m mon ma moi nous notre assistant", "ne_peux n_ai ne_suis ne_vais ne_veux ne_souhaite ne_releve impossib* refus* declin* prefere_ne hors interdit pas_en_mesure incapable m_abstiens ne_saurais", "repond* aid* demande* question* sujet* parler role reponse* discuter commenter information* traiter assist* aborder"),
    "es": ("yo me mi mis nosotros nuestro asistente puedo debo prefiero tengo quiero voy", "no fuera rechaz* imposible neg* abst* incapaz prohib* permitido", "ayud* respond* pregunta* peticion* solicitud* tema* hablar contest* funcion respuesta* comentar informacion asist*"),
    "pt": ("eu me meu minha meus nos assistente posso devo prefiro tenho quero vou", "nao fora recus* impossivel neg* incapaz proib* permitido abst*", "ajud* respond* pergunta* pedido* solicitacao tema* assunto* falar funcao resposta* comentar informac* atender"),
    "it": ("io mi mio mia noi assistente posso devo preferisco sono voglio", "non fuori rifiut* impossibile declin* incapace vietato", "aiut* rispond* domand* richiesta argomento parlar* discut* ruolo risposta commentar* informazion* tema"),
    "nl": ("ik me mij mijn we ons assistent", "niet geen niets weiger* buiten onmogelijk afwijz* liever_niet", "help* hulp antwoord* beantwoord* vraag vragen verzoek onderwerp bespreken rol reageren zeggen informatie"),
    "sv": ("jag mig min mitt vi assistent*", "inte ej vagra* avbojer avsta* utanfor omojligt hellre_inte", "hjalp* svar* besvara* fraga* begaran amne* diskutera roll uttala* kommentera"),
    "da": ("jeg mig min mit vi assistent*", "ikke nekt* naegt* afvis* udenfor umuligt helst_ikke", "hjelp* hjaelp* svar* besvar* spørsmal* spørgsmal* sporsmal* sporgsmal* emne* diskutere rolle anmodning*"),
    "pl": ("ja mi mnie moj* moze moge musze jestem wole nie_moge asystent*", "nie odmow* odmawiam poza niemozliw* odmawia", "pomoc* odpowie* odpowiedz* pytani* prosb* temat* rozmawiac zakres* rol* komentowac informacj*"),
    "cs": ("ja me muj moje mohu musim nemohu nemuzu nejsem", "nemohu nemuzu odmit* mimo nejsem nelze nesmim", "pomoc* odpoved* otazk* zadost* tema* mluvit rol*"),
    "ru": ("я мне меня мой моя мои мое мы ассистент могу должен", "не отказ* вынужден_отказ* вне невозможн* нельзя воздерж* запрещ*", "ответ* отвеч* помо* вопрос* запрос* тема теме тему обсужд* говорить роли комментир* информац*"),
    "tr": ("ben bana benim yardimci", "edemem veremem yapamam olamam reddet* disinda mumkun_degil degilim istemiyorum", "yardim* cevap* yanit* soru* talep* konu* istek*"),
}
# Verbs that refuse by themselves, so that a short sentence of the speaker needs no more (beginnings).
PERFORMATIVE = tuple("declin refus pass_on abstain ablehn verweiger rechaz recus rifiut weiger vagra avboj afvis odmow odmawiam odmit отказ reddet".split())
# What may stand beside a refusal in a sentence of its own: apologies, thanks, offers.
BESIDE = frozenset("sorry apologi* unfortunately thank* understand else instead another different alternativ* rephrase contact consult professional expert leider verzeih* entschuldig* tut_mir_leid danke stattdessen andere* desole* malheureusement merci autre* plutot siento lamentablemente gracias otr* lamento infelizmente desculpe obrigad* outr* spiace purtroppo grazie altr* helaas sorry bedankt ander* tyvarr tack annan beklager desværre tak przepraszam niestety dziekuje inn* bohuzel omlouvam dekuji простите извините сожалению спасибо друг* uzgunum maalesef tesekkur baska".split())

# Common words of each language (folded: without accents and case).
FUNCTION_WORDS = {
    "en": "the of and a an in for with which near that was were as to did what who how why when where one it its by at every but not from are is this they each into on after before because would could should between",
    "de": "die der das den dem und in bei zu im von fur nicht wie auch zwischen uber ist nur wurde waren sie ein eine einer als wahrend schrieb alles ob noch wer warum laut mit sich aus nach um jahr auf durch",
    "fr": "les le la des et en de du avec que plus ces aussi puis pendant par tres sur selon une un il quelques ou comment pourquoi tout dans est pour au aux ses lorsque deja meme",
    "es": "las los el la y en de del que muy no sino con como por entre hacia despues sus segun cuando tambien lo mas porque durante una un para son junto incluso nadie antes",
    "pt": "as os o a e em do da dos das no na nos nas com nao tambem segundo quando depois anos uma um ate sao foi ha para muito entre por mais que pelo pela seus suas",
    "it": "il lo la gli le e di del della dei delle in che non con per una un anche quando dopo tra come sono piu alla nel nella",
    "pl": "nie sie na jest ze do to jak za od po przez czy oraz ktory ktora ktore dla przy tylko bylo byl byla jego jej ich tym bez pod nad kiedy",
    "sv": "och att det som en ett av den pa inte med for till ar var har om men fran eller vid efter nar sin deras under mellan over alla genom",
    "da": "og at det som en et af den pa ikke med for til er var har om men fra eller ved efter nar sin deres under mellem over alle gennem blev",
    "cs": "a se na je ze to jako za od po pres nebo pro pri bylo byl byla jeho jeji jejich tim bez pod nad kdyz ktery ktera ktere mezi jen",
    "tr": "ve bir bu da de icin ile olan olarak gibi daha en cok kadar sonra ama ne her mi o ise ya veya onun hem",
    "fi": "ja on ei etta se oli joka mutta kun niin myos tai kuin ovat han sen jos vain viela kanssa ennen sitten",
    "ro": "si de la in un o nu pe cu este din pentru care ca mai au fost dar sau prin dupa intre cand lor",
    "hu": "a az es hogy nem egy is volt meg de csak ez mint mar ha aki amely utan kozott alatt minden",
    "id": "dan yang di ke dari untuk dengan ini itu tidak pada adalah dalam akan juga oleh ada atau mereka setelah antara",
    "nl": "de het een en van in op met voor niet ook dat die was waren tussen als bij aan door naar over",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
# Scripts that stand for a language of their own here.
SCRIPTS = {"CYRILLIC": "ru", "GREEK": "el", "CJK": "zh", "HIRAGANA": "ja", "KATAKANA": "ja", "HANGUL": "ko", "ARABIC": "ar", "HEBREW": "he", "DEVANAGARI": "hi"}
# Names of languages, folded, as a prompt asks for them.
LANGUAGE_NAMES = {
    "en": "english englisch englischen englische anglais ingles inglesa английский английском",
    "de": "german deutsch deutschen deutsche allemand aleman alemao немецкий немецком",
    "fr": "french franzosisch franzosischen franzosische francais frances francesa французский французском",
    "es": "spanish spanisch spanischen spanische espagnol espanol castellano espanhol испанский испанском",
    "pt": "portuguese portugiesisch portugiesischen portugais portugues португальский",
    "it": "italian italienisch italien italiano итальянский",
    "nl": "dutch niederlandisch neerlandais holandes neerlandes",
    "pl": "polish polnisch polonais polaco polski", "sv": "swedish schwedisch suedois sueco svenska", "da": "danish norwegian danisch danois danes dansk", "cs": "czech tschechisch tcheque checo cesky", "tr": "turkish turkisch turc turco turkce",
    "fi": "finnish finnisch finnois finlandes suomi", "ro": "romanian rumanisch roumain rumano romana", "hu": "hungarian ungarisch hongrois hungaro magyar", "id": "indonesian indonesisch indonesien indonesio",
    "ru": "russian russisch russischen russe ruso russo русский русском",
    "el": "greek griechisch grec griego grego", "zh": "chinese chinesisch chinois chino chines", "ja": "japanese japanisch japonais japones", "ko": "korean koreanisch coreen coreano",
    "ar": "arabic arabisch arabe", "he": "hebrew hebraisch hebreu hebreo", "hi": "hindi",
}
_NAMES = {w: k for k, v in LANGUAGE_NAMES.items() for w in v.split()}
# Abbreviations that end no sentence.
_OPEN_SHORT = re.compile(r"(?:^|[\s(“„«\"])(?:dr|mr|mrs|ms|prof|st|e\.g|i\.e|z\.b|p\.ex|vgl|cf|no|nr|vs|bzw)\.$", re.I)


def is_empty(text: str | None) -> bool:
    """Null, nothing visible, only punctuation, or a placeholder."""
    return not text or not (w := words(text)) or (len(w) < 5 and " ".join(w) in PLACEHOLDERS)


def common_subsequence(a: list, b: list) -> list[bool]:
    """Which members of a are in a longest common subsequence of a and b; rows are bit sets, a row for each member of a."""
    m, places = len(b), {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = v = (1 << m) - 1
    rows = [v]
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # In a row, bit j is clear where the j + 1 first members of b have one more in common than the j first.
    out, i, j = [False] * len(a), len(a), m
    while i and j:
        low = (1 << j) - 1
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif (~rows[i - 1] & low).bit_count() == (~rows[i] & low).bit_count():
            i -= 1
        else:
            i, j = i - 1, j - 1
            out[i] = True
    return out


def is_copied(prompt: list[str], response: list[str]) -> bool:
    """Whether the response only repeats the prompt, perhaps slightly changed, labelled or doubled, any number of times."""
    if not prompt or not response or len(response) * 2 < len(prompt):
        return False
    known = set(prompt)
    if sum(w in known for w in response) < 0.6 * len(response):
        return False
    pairs = set(zip(prompt, prompt[1:], strict=False))
    own = set(zip(response, response[1:], strict=False))
    if len(prompt) > 3 and len(own & pairs) < 0.45 * len(own):
        return False
    times = -(-len(response) // len(prompt)) if len(response) > 1.3 * len(prompt) else 1
    met = common_subsequence(response, prompt * times)
    longest = run = 0
    for x in met:
        run = 0 if x else run + 1
        longest = max(longest, run)
    return sum(met) >= 0.7 * len(met) and longest <= max(4, len(prompt) // 4) and len(set(response) & known) >= 0.6 * len(known)


@cache
def _refusal_words() -> list[tuple[dict[str, set[str]], list[tuple[str, str]]]]:
    """For each language: whole words and beginnings, with their parts."""
    out = []
    for parts in REFUSAL_WORDS.values():
        whole, starts = {}, []
        for part, listed in zip("SNA", parts, strict=True):
            for w in listed.split():
                if w.endswith("*") and "_" not in w:
                    starts.append((w[:-1], part))
                elif "_" not in w:
                    whole.setdefault(w, set()).add(part)
        out.append((whole, starts))
    return out


@cache
def _refusal_runs() -> dict[str, list[tuple[int, list[str], str]]]:
    """By first word: language, words and part of the runs of words."""
    out: dict[str, list] = {}
    for n, parts in enumerate(REFUSAL_WORDS.values()):
        for part, listed in zip("SNA", parts, strict=True):
            for w in listed.split():
                if "_" in w:
                    run = w.rstrip("*").split("_")
                    out.setdefault(run[0], []).append((n, run, part))
    return out


@lru_cache(maxsize=100_000)
def _parts_of(w: str) -> tuple[tuple[int, str], ...]:
    """(language, part) of a word."""
    out = []
    for n, (whole, starts) in enumerate(_refusal_words()):
        out += [(n, p) for p in sorted(whole.get(w, set()) | {p for start, p in starts if w.startswith(start)})]
    return tuple(out)


@lru_cache(maxsize=100_000)
def _is_beside(w: str) -> bool:
    return w in BESIDE or any(x.endswith("*") and w.startswith(x[:-1]) for x in BESIDE)


_TEMPLATES = tuple(list(x) for x in ("SNA", "SAN", "NSA", "NAS", "ASN", "ANS"))


def refuses(sentence: list[str]) -> bool:
    """Whether a sentence aligns with a refusal template: whole with one order of its three parts, or a speaker's refusing verb in a short one."""
    seen: dict[int, list[str]] = {}
    for i, w in enumerate(sentence):
        for n, p in _parts_of(w):
            seen.setdefault(n, []).append(p)
        for n, run, p in _refusal_runs().get(w, ()):
            if sentence[i : i + len(run)] == run:
                seen.setdefault(n, []).append(p)
    if not seen:
        return False
    if len(sentence) <= 12 and any("S" in p for p in seen.values()) and any(w.startswith(PERFORMATIVE) or f"{w}_{x}" in PERFORMATIVE for w, x in zip(sentence, [*sentence[1:], ""], strict=True)):
        return True
    return any(len(set(p)) == 3 and any(sum(common_subsequence(t, p)) == 3 for t in _TEMPLATES) for p in seen.values())


_QUOTED = re.compile("^[\\s]*[“„«\"‘].*?[”“»\"’]", re.S)
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|\n+")
#: A refusal's sentences that neither refuse nor stand beside a refusal hold at most this share of its words.
OWN_SHARE = 0.35


def is_refusal(text: str, response: list[str]) -> bool:
    """Whether refusal templates explain the response but for a small share of its words."""
    if not response or _QUOTED.match(text):
        return False
    refused = own = n = 0
    for x in _SENTENCE.split(text):
        ws = words(x)
        n += len(ws)
        if refuses(ws):
            refused += len(ws)
        elif not any(_is_beside(w) for w in ws):
            own += len(ws)
    return refused > 0 and own <= OWN_SHARE * n


@lru_cache(maxsize=5000)
def _script_of(c: str) -> str | None:
    return SCRIPTS.get(unicodedata.name(c, " ").split(" ")[0].split("-")[0]) if c.isalpha() else None


@cache
def _languages_of() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for k, own in _FUNCTION.items():
        for w in own:
            out.setdefault(w, []).append(k)
    return out


def language(text: str, folded: list[str]) -> str | None:
    """The language of prose (two words or more) by its script and function words; None if they don't tell."""
    if len(folded) < 2 and len(text) < 12:
        return None
    if not text.isascii():
        foreign = Counter(k for c in text if c > "\u036f" and (k := _script_of(c)))
        if foreign:
            kind, n = foreign.most_common(1)[0]
            if n * 2 > sum(c.isalpha() for c in text):
                return kind
    of, score, different = _languages_of(), Counter(), {}
    for w in folded:
        for k in of.get(w, ()):
            score[k] += 1
            different.setdefault(k, set()).add(w)
    ranked = sorted(((n, len(different[k]), k) for k, n in score.items()), reverse=True)
    if not ranked:
        return None
    first, second = ranked[0], ranked[1] if len(ranked) > 1 else (0, 0, "")
    if first[0] < 3 or first[1] < 2 or first[0] < 0.12 * len(folded):
        return None
    return first[2] if first[0] > second[0] or first[1] > second[1] else None


def _prose(text: str) -> str:
    """Text without code fences, JSON and quotations of others' words."""
    t = re.sub(r"```.*?(?:```|$)", " ", text, flags=re.S)
    return " " if t.strip()[:1] in "{[" and t.strip()[-1:] in "}]" else t


def speaks_other_language(prompt: str, response: str, prompt_words: list[str], response_words: list[str]) -> bool:
    t = _prose(response)
    asked = language(prompt, prompt_words)
    own = language(t, response_words if t == response else words(t)) if asked else None
    return own is not None and asked is not None and own != asked and own not in {_NAMES[w] for w in prompt_words if w in _NAMES}


_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])(?:\s+|$)")
_ENDS = ".!?…。！？"
_CLOSERS = "”“»\"'’)]*_`’"


def is_truncated(text: str) -> bool:
    """Whether the response stops before its sentence or structure is complete."""
    t = re.sub("[​-‏⁠﻿­]", "", text).strip()
    if t.count("```") % 2:
        return True
    if t[:1] in "{[":
        depth, inside, skip = 0, False, False
        for c in t:
            if skip:
                skip = False
            elif inside:
                skip, inside = c == "\\", c != '"'
            elif c == '"':
                inside = True
            else:
                depth += (c in "{[") - (c in "}]")
        return depth > 0 or inside
    if t.endswith("```"):
        return False
    bare = t.rstrip(_CLOSERS).rstrip()
    lines = [x for x in t.split("\n") if x.strip()]
    items = [x for x in lines if _ITEM.match(x)]
    if items and _ITEM.match(lines[-1]):
        bodies = [_ITEM.sub("", x).strip() for x in items]
        last, before = bodies[-1], bodies[:-1]
        if not last:
            return True
        if before and all(b[-1:] in _ENDS or b.rstrip(_CLOSERS)[-1:] in _ENDS for b in before) and bare[-1:] not in _ENDS:
            return True
        counts = [len(b.split()) for b in before]
        if len(counts) >= 1 and bare[-1:] not in _ENDS and min(counts) >= 3 and len(last.split()) < min(counts):
            return True
        if bare[-1:] in ",;:–—" or bare[-1:] in "-" or words(last)[-1:] and words(last)[-1] in _DANGLING:
            return True
        if bare[-1:] not in _ENDS:
            return t.count("(") > t.count(")")
    if re.search(r"\|", lines[-1]) and lines[-1].strip().startswith("|"):
        return not lines[-1].strip().endswith("|")
    if t.count("(") > t.count(")") or t.count("[") > t.count("]") or t.count("«") > t.count("»"):
        return True
    low = t.count("„")
    if (low and t.count("“") < low) or (not low and t.count("“") > t.count("”")):
        return True
    if _OPEN_SHORT.search(t):
        return True
    if bare[-1:] in ",;:-–—":
        return True
    if bare[-1:] in _ENDS:
        return False
    ws = words(t)
    return len(ws) >= 8 or bool(len(ws) > 1 and ws[-1] in _DANGLING) or bool(re.search(rf"[{_ENDS}]\s", t))


# Folded words that no complete phrase ends with.
_DANGLING = frozenset("the a an of and or to for with that which from by der die das und von fur mit zu ein eine les le la des et de du un une avec las los el y del que con os e em do da um uma na".split())


def defect(prompt: str | None, response: str | None) -> str | None:
    """The pair's defect, None if it is sound; a null or empty prompt can't be copied or answered in another language."""
    if is_empty(response):
        return "empty"
    p, r = words(prompt), words(response)
    if is_copied(p, r):
        return "copied"
    if is_refusal(response, r):
        return "refusal"
    if prompt and speaks_other_language(prompt, response, p, r):
        return "other_language"
    return "truncated" if is_truncated(response) else None


def defective_pairs(df: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """(key, defect): the defective pairs of df. Rows without key give none, repeated rows of a key count once."""
    def run(batches):
        for b in batches:
            found = [defect(p, r) for p, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["k", "defect"])
            yield out.filter(pa.array([f is not None for f in found], pa.bool_()))

    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), prompt, response).mapInArrow(run, f"k {dict(df.dtypes)[key]}, defect string")
    return rows.groupBy(F.col("k").alias(key)).agg(F.min("defect").alias("defect"))
