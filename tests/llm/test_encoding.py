"""Places of wrong decoding that stand alone in a text."""

import pytest

from lodestone.llm import encoding


@pytest.mark.parametrize(("bad", "good"), [
    ("Two p„es were sold.", "Two pães were sold."), ("A caΘa stood by the river.", "A caéa stood by the river."),
    ("No cafÈs here. Two p„es were sold.", "No cafés here. Two pães were sold.")])
def test_single_place(bad, good):
    assert encoding.restore(bad)[:2] == (True, good)


@pytest.mark.parametrize("text", ["wait…what…now", "He said “yes”and “no”or left."])
def test_joining_signs_are_left(text):
    assert encoding.restore(text)[:2] == (False, text)


RUSSIAN = "Старые башни города видели все реки и леса этой большой страны. "


@pytest.mark.parametrize("true", ["cp1251", "koi8_r"])
def test_one_garbled_sentence_of_correct_text(true):
    bad = "все красивые реки города видели.".encode(true).decode("cp1252")
    assert encoding.restore(RUSSIAN * 5 + bad + " " + RUSSIAN)[:2] == (True, RUSSIAN * 5 + "все красивые реки города видели. " + RUSSIAN)


def test_one_garbled_word():
    assert encoding.restore("The word " + "города".encode("cp1251").decode("cp1252") + " means of the town.")[:2] == (True, "The word города means of the town.")


@pytest.mark.parametrize("text", [RUSSIAN * 3 + "Ânes, île, œuvre. Да.", "Това е България. Її звуть Їжак.", "ÀÉÎ à é î", "Þórður á Íslandi"])
def test_correct_sentences_are_left(text):
    assert encoding.restore(text)[:2] == (False, text)


# Texts in scripts that the test tables don't hold.
HELD_OUT = {
    "ko": "한국어 문장은 이렇게 쓰인다", "ar": "هذه جملة عربية قصيرة", "he": "זה משפט קצר בעברית", "hi": "यह एक छोटा वाक्य है", "th": "นี่คือประโยคสั้น", "vi": "Tiếng Việt có nhiều dấu thanh",
    "ka": "ეს არის მოკლე წინადადება", "ja": "これは短い文章です", "zh": "这是一个很短的句子", "pl": "Zażółć gęślą jaźń", "tr": "Kısa bir cümle değil mi"}


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp1250", "mac_roman", "cp437", "koi8_r", "cp1253"])
def test_held_out_scripts(wrong):
    """All are found, nine of ten restored whole."""
    whole = 0
    for text in HELD_OUT.values():
        want = f"The note says: {text} and no more."
        bad = encoding._read(text.encode(), wrong)
        found, now, _ = encoding.restore(want.replace(text, bad))
        assert found
        whole += now == want
    assert whole >= 0.9 * len(HELD_OUT)


@pytest.mark.parametrize("text", [*HELD_OUT.values(), "«Décris l’élève d’Évian»", "Њ Љ љ је њен", "він бачив вії її дітей", "Ďábel, ťava, şey, İzmir"])
def test_correct_scripts_are_left(text):
    assert encoding.restore(f"{text} — «{text}»…")[0] is False


@pytest.mark.parametrize(("text", "true", "wrong"), [("Αυτή είναι σύντομη πρόταση", "cp1253", "cp1252"), ("זה משפט קצר בעברית", "cp1255", "cp1252"), ("هذه جملة عربية قصيرة", "cp1256", "cp1252"), ("这是一个很短的句子", "gbk", "cp1252"), ("한국어 문장은 이렇게", "euc_kr", "cp1252")])
def test_other_alphabets_are_found(text, true, wrong):
    assert encoding.restore(encoding._read(text.encode(true), wrong))[0]


def test_many_passes():
    """Text that was garbled six times over."""
    bad = "café"
    for _ in range(6):
        bad = encoding._read(bad.encode(), "latin-1")
    assert encoding.restore(bad) == (True, "café", True)
