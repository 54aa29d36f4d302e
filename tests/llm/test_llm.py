"""Training-data operators against brute force and round trips on small inputs, with nulls, empty texts, ties, repeats and clashing columns."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import answers, batches, encoding, leaks, mixing, packing, pieces, spans, splits
from lodestone.llm.fmindex import FMIndex, WaveletTree, suffix_array
from lodestone.llm.words import words

rng = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(60)]


def sentence(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def grams(ws, k):
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_words():
    assert words("Éa_b ﬁne​ly ½ STRASSE straße") == ["ea", "b", "finely", "1", "2", "strasse", "strasse"]
    assert words(None) == words("") == words("…") == []


def test_leaks(spark):
    prompts = [("p1", sentence(14)), ("p2", "two words"), ("p3", None), ("p4", ""), ("p5", sentence(8)), ("p5b", None)]
    p = dict(prompts)
    corpus = [(1, sentence(20) + " " + p["p1"].upper() + " " + sentence(5)), (2, "x two​ WÖRDS two  wórds"), (3, None), (4, ""), (5, p["p5"].replace(" ", ", ")), (6, " ".join(p["p1"].split()[:7])), (None, p["p1"]), (1, sentence(20)), (7, sentence(5000) + " " + p["p5"])]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in corpus], "record_id long, text string, prompt string, item int")
    pr = spark.createDataFrame([(i, t, 0) for i, t in prompts] + [("p1", p["p1"], 9)], "id string, prompt string, place int")
    got = {(r.record_id, r.prompt_id) for r in leaks.leaked_prompts(df, pr, "record_id", "text").collect()}
    want = set()
    for i, t in corpus:
        for q, x in prompts:
            w = words(x)
            if i is not None and w and grams(words(t), min(8, len(w))) & grams(w, min(8, len(w))):
                want.add((i, q))
    assert got == want and (1, "p1") in want and (2, "p2") in want
    assert leaks.leaked_prompts(df.limit(0), pr, "record_id", "text").count() == 0
    assert leaks.leaked_prompts(df, pr.limit(0), "record_id", "text").count() == 0


def edited(t, n):
    ws = t.split()
    for _ in range(n):
        ws[rng.randrange(len(ws))] = rng.choice(VOCABULARY)
    return " ".join(ws)


def brute_rejected(rows):
    acc, out = [], {}
    for b, i, f, t in sorted(set(rows), key=lambda r: r[:2]):
        f = f.strip().lower() if f and re.fullmatch("[0-9a-fA-F]{64}", f.strip()) else None
        g = grams(words(t), 5)
        hit = [j for j, fj, gj in acc if (f and f == fj) or jac(g, gj) >= 0.6]
        if hit and b > 0:
            out[i] = min(hit)
        else:
            acc.append((i, f, g))
    return {(v, k) for k, v in out.items()}


def test_batches(spark):
    rows, n = [], 0
    for b in range(4):
        for _ in range(12):
            n += 1
            text = sentence(30) if not rows or rng.random() < 0.4 else edited(rng.choice([r[3] for r in rows if r[3]]), rng.randrange(4))
            fp = rng.choice([None, "short", "AB" * 32, f"{n:064x}", f"{max(1, n - 5):064X}", f"{n:064x}"])
            rows.append((b, n, fp, text if rng.random() < 0.85 else rng.choice([None, "", "one two"])))
    hist = [r for r in rows if r[0] == 0]  # the accepted history holds no repeats
    keep = {r[1] for r in hist} - {k for _, k in brute_rejected([(1, *r[1:]) for r in hist])}
    rows = [r for r in rows if r[0] > 0 or r[1] in keep]
    rows += rows[10:14]
    df = spark.createDataFrame([(*r, "q") for r in rows], "batch_no int, item_id long, fingerprint string, item_text string, set_key string")
    got = {(r.item_id, r.dup_item_id) for r in batches.rejected_items(df).collect()}
    want = brute_rejected(rows)
    assert {b for _, b in got} == {b for _, b in want} and got == want
    assert batches.rejected_items(df.limit(0)).count() == 0


def batch_rows(n, batch):
    out = []
    for i in range(n):
        text = sentence(30) if not out or rng.random() < 0.4 else edited(rng.choice(out)[3], rng.randrange(4))
        out.append((batch, 1000 * batch + i, f"{rng.randrange(10**6):064x}", text))
    return out


@pytest.mark.parametrize("last", [100_000, 0])
def test_batches_one_by_one(spark, tmp_path, last, monkeypatch):
    """Batches appended one after another to the stored table, when history's texts are gone, give what one pass gives."""
    monkeypatch.setattr(batches, "LAST", last)
    import shutil

    hist = [(0, i, f"{i:064x}", sentence(30)) for i in range(8)]
    new = [[*batch_rows(9, b), (b, 1000 * b + 500, hist[b][2].upper(), None), (b, 1000 * b + 501, None, edited(hist[b][3], 1))] for b in (1, 2)]
    schema = "batch_no int, item_id long, fingerprint string, item_text string"
    spark.createDataFrame(hist, schema).write.parquet(f"{tmp_path}/history")
    table = batches.PivotTable(spark, f"{tmp_path}/table").create(spark.read.parquet(f"{tmp_path}/history"))
    shutil.rmtree(f"{tmp_path}/history")
    got = set()
    for b, rows in enumerate(new):
        got |= {(r.item_id, r.dup_item_id) for r in table.append(spark.createDataFrame(rows, schema), str(b + 1)).collect()}
    want = brute_rejected(hist + [r for rows in new for r in rows])
    assert got == want and len(want) > 4
    kept = {r.item_id for r in spark.read.parquet(f"{tmp_path}/table/sets").collect()}
    assert kept and not kept & {j for _, j in want}


def test_batches_rounds_then_one_task(spark, monkeypatch):
    """Items left for the last task that repeat one which a round has accepted are rejected, whatever number is left."""
    a, b, c = sentence(30), sentence(30), sentence(30)
    rows = [(1, 1, None, a), (1, 2, None, b), (2, 3, None, a + " end"), (2, 4, "AB" * 32, b + " end"), (3, 5, "ab" * 32, c), (3, 6, None, c + " end")]
    df = spark.createDataFrame(rows, "batch_no int, item_id long, fingerprint string, item_text string")
    want = brute_rejected(rows)
    assert want == {(1, 3), (2, 4), (5, 6)}
    for last in (5, 3, 1):
        monkeypatch.setattr(batches, "LAST", last)
        assert {(r.item_id, r.dup_item_id) for r in batches.rejected_items(df).collect()} == want


def test_large_text_in_the_table(spark):
    """A text of more windows than a 16-bit number counts."""
    long = " ".join(f"x{i}" for i in range(40_000))
    df = spark.createDataFrame([(0, 1, None, long), (1, 2, None, long + " y"), (1, 3, None, "a b")], "batch_no int, item_id long, fingerprint string, item_text string")
    assert [(r.item_id, r.dup_item_id) for r in batches.rejected_items(df).collect()] == [(1, 2)]


def test_splits(spark):
    base = [sentence(16) for _ in range(4)]
    rows = [(f"e{i:03d}", rng.choice(["train", " TRAIN", "Test ", "validation", None, "dev"]), rng.choice([rng.choice(base), edited(rng.choice(base), 1), None, "", "a b"])) for i in range(90)]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(*rows[0], 2), (None, "test", base[0], 3)], "example_id string, split string, instruction string, key int")
    got = {(r.key_a, r.key_b) for r in splits.keyed_pairs(splits.cross_split_pairs(df, "example_id", "split", "instruction", "text", 3, 0.5)).collect()}
    side = {i: (s or "").strip().lower() for i, s, _ in rows}
    g = {i: grams(words(t), 3) for i, _, t in rows}
    want = {(a, b) for a in g for b in g if a < b and {side[a] == "train", side[b] == "train"} == {True, False} and {side[a], side[b]} - {"train"} <= {"test", "validation"} and jac(g[a], g[b]) >= 0.5}
    assert got == want and want


def test_moved_parts(spark):
    """Texts with moved parts are found by their windows, others by their alignment."""
    a, b = " ".join(VOCABULARY[:30]), " ".join(VOCABULARY[30:])
    rows = [("t", "train", f"{a} {b}"), ("m", "test", f"{b} {a}"), ("n", "test", f"{a} {b} more")]
    df = spark.createDataFrame(rows, "example_id string, split string, instruction string")
    got = {(r.eval_key, r.match) for r in splits.cross_split_pairs(df, "example_id", "split", "instruction", "text", 3, 0.5).collect()}
    assert got == {("m", "moved"), ("n", "near")}


def test_token_splits_with_nulls(spark):
    t = list(range(20))
    rows = [("a", "train", "AA", t, 1), ("b", "test", "aa", None, 1), ("c", "test", None, t[:-1] + [None], 1), ("d", "validation", None, [], 1), ("e", "test", "bb", t, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, split string, text_sha256 string, token_ids array<int>, n int")
    got = {(r.train_key, r.eval_key, r.match) for r in splits.cross_split_pairs(df, "chunk_id", "split", "token_ids", "tokens", 5, 0.7, "text_sha256").collect()}
    assert got == {("a", "b", "exact"), ("a", "c", "near"), ("a", "e", "same")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_banded_edits(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    got = splits.alignment(a, b, 18)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in got[1]) and sum(n for *_, n in got[1]) >= max(len(a), len(b)) - d[-1][-1]
    for most in (0, 2, 9):
        assert splits.banded_edits(a, b, most) == (d[-1][-1] if d[-1][-1] <= most else None)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n。é́👩‍", max_size=400), st.integers(20, 60), st.integers(0, 19))
def test_pieces_round_trip(t, limit, overlap):
    cuts = pieces.split_text(t, limit, overlap)
    assert all(z - a <= limit for a, z, _ in cuts) and cuts[0][0] == 0 and cuts[-1][1] == len(t)
    assert all(b == z - overlap for (_, z, _), (b, _, _) in zip(cuts, cuts[1:], strict=False))
    assert t[: cuts[0][1]] + "".join(t[a + overlap : z] for a, z, _ in cuts[1:]) == t


def test_pieces_table(spark):
    long = ". ".join(sentence(12) for _ in range(80)) + "."
    df = spark.createDataFrame([("a", long, "T", None, 5), ("a", long, "T", None, 5), ("b", "short", None, "section", 1), ("c", None, None, None, 1), (None, long, None, None, 1)], "chunk_id string, text string, section_title string, boundary_end_type string, piece int")
    got = sorted(pieces.oversized_pieces(df, "chunk_id", "text", "section_title", "boundary_end_type").collect(), key=lambda r: r.piece)
    assert {r.chunk_id for r in got} == {"a"} and len(got) == got[0].n_pieces and got[-1].boundary_end_type is None
    assert all(r.boundary_end_type == "sentence" and r.text.rstrip().endswith(".") for r in got[:-1])


def test_deepest_valley_is_cut():
    """The topic changes at one sentence end of many; the cut goes there and not to the latest one."""
    a = [" ".join(rng.choice(["kiln", "clay", "brick", "oven", "ash"]) for _ in range(7)) + "." for _ in range(24)]
    b = [" ".join(rng.choice(["sail", "harbour", "mast", "tide", "rope"]) for _ in range(7)) + "." for _ in range(24)]
    text = " ".join(a) + " " + " ".join(b)
    at = len(" ".join(a)) + 1
    cuts = pieces.split_text(text, at + 300, 50)
    assert cuts[0][1] == at and cuts[0][2] == "sentence"


GOOD = "“It wasn’t the café,” wrote Ana; für größere Straßen — 20 °C, 5 × 6, 9 € où déjà señales e canções."


@pytest.mark.parametrize("enc", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
def test_garbled_round_trip(enc):
    bad = encoding._read(GOOD.encode("utf-8"), enc)
    assert encoding.restore(bad) == (True, GOOD, True)
    mixed = GOOD + " Correct: naïve Größe. " + bad
    found, now, _ = encoding.restore(mixed)
    assert found and now.startswith(GOOD + " Correct: naïve Größe. ")


@pytest.mark.parametrize("text", [None, "", "plain", GOOD, "SÃO 191 MANHÃ DE AÇÃO E TRADIÇÃO", "naïvely, Â and Ã are letters", "├── a\n│   └── b", "∂f/∂x ≈ √2·π ± 3 µm at 4 °C, so Δ ≤ ∞", "Η λίμνη του βουνού", "Старые башни защищали «СССР»", "山田。学校！", "L’ÂGE DE FER : L’ÎLE", "👨‍👩‍👧 ¿Qué?"])
def test_correct_text_is_left(text):
    assert encoding.restore(text)[:2] == (False, text)


@pytest.mark.parametrize(("bad", "good"), [("âñå êðàñèâûå ðåêè ãîðîäà âèäåëè", "все красивые реки города видели"), ("No cafÈ in F¸rth, 225 ◊ 107 metres", "No café in Fürth, 225 × 107 metres")])
def test_one_byte_pairs(bad, good):
    assert encoding.restore(bad)[:2] == (True, good)


def test_lost_characters():
    assert encoding.restore("Au�erdem") == (True, "Au�erdem", False)


Q = "Why did Ana Maria leave the old harbour near Porto before the storm arrived in 1901?"


@pytest.mark.parametrize(("p", "r", "want"), [
    (Q, None, "empty"), (Q, " ​", "empty"), (Q, "[no response]", "empty"), (Q, "N/A", "empty"), (Q, "—", "empty"),
    (Q, Q, "copied"), (Q, "Question: " + Q.lower(), "copied"), (Q, Q + " " + Q, "copied"),
    (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "Leider muss ich diese Anfrage ablehnen.", "refusal"),
    (Q, "Las antiguas murallas de la ciudad cambiaron las señales cercanas en el año y los caminos.", "other_language"),
    ("Translate the note about the old harbour into Spanish for the office.", "Las antiguas murallas de la ciudad cambiaron las señales cercanas en el año y los caminos.", None),
    (Q, "The storm came early and the harbour was closed by the", "truncated"), (Q, '{"place": "Porto", "items": ["a", "b', "truncated"), (Q, "```\nx = 1", "truncated"), (Q, "- one of them\n- two of them\n-", "truncated"),
    (Q, "In 1782", None), (Q, "682", None), (Q, '{"place": "Porto"}', None), (Q, "“I can't help you, and I must decline,” said Ana in the tale. The storm passed. Then the old harbour was opened again by the town.", None),
    (Q, "- the old mill\n- the new mill", None), (None, "A sound answer in full.", None), ("", "The end.", None)])
def test_answers(p, r, want):
    assert answers.defect(p, r) == want


@pytest.mark.parametrize("r", [
    "I'd rather not get into that.", "That's something I can't discuss, I'm afraid.", "Mi dispiace, ma non posso aiutarti con questa richiesta.", "Przepraszam, nie mogę pomóc w tej sprawie.", "Tyvärr kan jag inte svara på den frågan.",
    "I'm afraid that request is beyond what I can assist with.", "Het spijt me, maar ik kan daar geen antwoord op geven.", "We do not comment on such matters.", "Извините, я не могу обсуждать эту тему.",
    "As an AI, I have to decline. My guidelines prevent me from engaging with this subject, so please contact a professional instead.", "I'm sorry, but I can't help with that request. " * 9])
def test_refusals_in_other_words(r):
    """Sentences that no table holds, and refusals of any length."""
    assert answers.defect(Q, r) == "refusal"


@pytest.mark.parametrize("r", [
    "The storm came early. I could not answer the captain's question, so the crew waited, and in the morning the harbour was opened again by the town council and the old ferry returned to the islands.",
    "No, it is impossible to answer with certainty; most records of the town were lost in 1790, though two letters survive in the library.", "The topic of the talk was not the harbour but the mill."])
def test_sound_answers_with_such_words(r):
    assert answers.defect(Q, r) is None


def test_defects_beyond_former_bounds():
    short = "Name the old river town of Porto"
    assert answers.defect(short, " ".join([short] * 8)) == "copied" and answers.defect(Q, "[deleted]") == "empty"
    assert answers.defect(Q, "Port zamknięto, ponieważ burza przyszła wcześniej i nie było już czasu na powrót statków do miasta.") == "other_language"
    assert answers.defect(Q, "Порт закрыли.") == "other_language"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    met = [x for x, ok in zip(a, answers.common_subsequence(a, b)) if ok]
    it = iter(b)
    assert len(met) == best[-1][-1] and all(x in it for x in met)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    box, n = packing.best_fit(sizes, 50)
    used = [0] * n
    for s, b in zip(sizes, box, strict=True):
        used[b] += s
    assert all(0 < u <= 50 for u in used) and sum(sorted(used)[:2]) > 50 or n < 2


def test_packing(spark):
    docs = [(i, rng.choice(["a", "a", "b", None]), sentence(rng.randrange(1, 300))) for i in range(120)] + [(None, "a", "x"), (200, "a", None), (201, "a", ""), (0, "a", "y")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, window int")
    prof = spark.createDataFrame([("n", 64, 8), ("w", 4000, 0), (None, 5, 0)], "profile_id string, capacity_tokens int, overlap_tokens int")
    out = packing.packed(df, prof, window=5).collect()
    ids = {i for i, _, t in docs if i is not None and t}
    for p, cap, over in (("n", 64, 8), ("w", 4000, 0)):
        own = [r for r in out if r.profile_id == p]
        assert {r.doc_id for r in own} == ids
        used = {}
        for r in own:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        assert max(used.values()) <= cap
        for d in ids:
            ps = sorted((r.piece, r.start, r.n_tokens) for r in own if r.doc_id == d)
            assert [x[0] for x in ps] == list(range(len(ps)))
            assert all(b[1] == a[1] + cap - over and a[2] == cap for a, b in zip(ps, ps[1:], strict=False))


def test_packing_to_proportions(spark):
    """Windows hold the asked proportions while the queues last; unlisted sources come last."""
    docs = [(i, "abc"[i % 3], sentence(40)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    prof = spark.createDataFrame([("n", 500, 0)], "profile_id string, capacity_tokens int, overlap_tokens int")
    want = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("z", 5.0), ("c", None)], "source string, weight double")
    out = packing.packed(df, prof, window=10, proportions=want).collect()
    assert {r.doc_id for r in out} == set(range(600))
    windows = {}
    for r in out:
        windows.setdefault(int(r.container_id[:8]), {}).setdefault(r.source, []).append(r.n_tokens)
    n = {w: {k: sum(v) for k, v in x.items()} for w, x in windows.items()}
    first = [w for w in sorted(n) if "a" in n[w] and w + 1 in n and "a" in n[w + 1]]
    assert len(first) > 2 and all(n[w]["a"] / (n[w]["a"] + n[w]["b"]) == pytest.approx(0.75, abs=0.05) and "c" not in n[w] for w in first)
    assert set(n[max(n)]) == {"c"}


def test_mixture_of_a_given_size(spark):
    docs = [(i, "ab"[i % 2], sentence(30)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    mix = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 1)], "mixture_id string, source_id string, weight double, max_repeats int")
    got, _ = mixing.mixed(df, mix, total_tokens=4000)
    assert sum(r.repeats * r.n_tokens for r in got.collect()) == pytest.approx(4000, rel=0.03)


def test_leaks_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", 1)
    test_leaks(spark)


def test_flight_keeps_totals():
    r = random.Random(1)
    t, p = [r.uniform(1, 90) for _ in range(300)], [r.random() for _ in range(300)]
    q = mixing.flight(t, p, r)
    assert sum(0 < x < 1 for x in q) <= 2
    assert sum(q) == pytest.approx(sum(p), abs=1e-5) and sum(a * b for a, b in zip(t, q)) == pytest.approx(sum(a * b for a, b in zip(t, p)), rel=1e-6)


def test_mixing(spark):
    docs = [(i, rng.choice(["a", "b"]), sentence(rng.randrange(20, 60))) for i in range(400)] + [(900, "c", sentence(30)), (None, "a", "x"), (901, None, "x"), (902, "a", None), (3, "a", "again")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, ratio int")
    mix = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.4, 1), ("m", "none", 0.1, 3), ("z", "c", 1.0, 3), ("y", "b", None, 2)], "mixture_id string, source_id string, weight double, max_repeats int")
    chosen, goals = mixing.mixed(df, mix, block=60)
    rows = {(r.mixture_id, r.source_id): r for r in mixing.shares(chosen, goals).collect()}
    got = chosen.collect()
    assert all(1 <= r.repeats <= {"a": 2, "b": 1, "c": 3}[r.source_id] for r in got) and len({(r.mixture_id, r.doc_id) for r in got}) == len(got)
    assert rows["m", "a"].actual_share == pytest.approx(5 / 9, abs=0.01) and rows["m", "none"].tokens == 0
    assert rows["z", "c"].doc_uses == 3 and rows["y", "b"].tokens == 0


def test_fm_index():
    r = np.random.default_rng(3)
    s = r.integers(0, 5, 300)
    tree = WaveletTree(s, 5)
    at = r.integers(0, 301, 80)
    for c in range(5):
        assert (tree.rank(np.full(80, c), at) == [(s[:i] == c).sum() for i in at]).all()
    v = np.concatenate([s + 1, [0]])
    assert suffix_array(v).tolist() == sorted(range(len(v)), key=lambda i: v[i:].tolist())
    held, streamed = ["abcabcab", "zzabcabzz", "", "q", "bcab"], ["zabcabq", "", "cabcabcabz", "xyx", "abcabcab"]
    for rate in (1, 16):
        FMIndex.RATE = rate
        index = FMIndex([spans.points(t) for t in held], 4)
        assert not any(len(np.atleast_1d(x)) > 40 and np.asarray(x).dtype == np.int64 for x in vars(index).values() if isinstance(x, np.ndarray))
        text, place, lo, hi = index.matches([spans.points(t) for t in streamed])
        got = {(int(t), int(p)): int(b - a) for t, p, a, b in zip(text, place, lo, hi)}
        every = [t[i : i + 4] for t in held for i in range(len(t) - 3)]
        assert got == {(i, j): every.count(t[j : j + 4]) for i, t in enumerate(streamed) for j in range(len(t) - 3) if t[j : j + 4] in every}
        rows = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
        t, p = index.locate(rows)
        want = [streamed[i][j : j + 4] for i, j, a, b in zip(text, place, lo, hi) for _ in range(b - a)]
        assert [held[i][j : j + 4] for i, j in zip(t, p)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=30), min_size=1, max_size=5), st.lists(st.text(alphabet="abc", max_size=40), max_size=4))
def test_matching_statistics(held, streamed):
    index = FMIndex([spans.points(t) for t in held], 5)
    text, place, lo, hi = index.matches([spans.points(t) for t in streamed])
    every = [t[i : i + 5] for t in held for i in range(len(t) - 4)]
    got = {(int(t), int(p)): int(b - a) for t, p, a, b in zip(text, place, lo, hi)}
    assert got == {(i, j): every.count(t[j : j + 5]) for i, t in enumerate(streamed) for j in range(len(t) - 4) if t[j : j + 5] in every}


def test_spans_need_backward_search(spark, monkeypatch):
    """Without ranks in the wavelet tree nothing is found."""
    from lodestone.llm.fmindex import WaveletTree

    monkeypatch.setattr(WaveletTree, "rank", lambda self, symbol, at: np.zeros_like(at))
    part = sentence(40)
    a, b = spans.points("left " + part + " one"), spans.points("other " + part + " two")
    assert not len(FMIndex([a], 40).matches([b])[0])


def brute_spans(docs, L):
    sub = {i: {t[j : j + L] for j in range(len(t) - L + 1)} for i, t in docs.items()}
    return {(a, b) for a in sub for b in sub if a < b and sub[a] & sub[b]}


@pytest.mark.parametrize("hot", [False, True])
def test_shared_spans(spark, hot, monkeypatch):
    if hot:  # every anchor is cut into blocks
        monkeypatch.setattr(spans, "SHARD", 1), monkeypatch.setattr(spans, "BLOCK", 2)
    parts = [sentence(20) for _ in range(6)]
    docs = {i: sentence(rng.randrange(5, 30)) + rng.choice([p[: rng.randrange(30, len(p))] for p in parts]) + sentence(9) for i in range(40)}
    docs |= {50: docs[1], 51: "a" * 300, 52: "a" * 200, 53: "", 54: "é" * 41 + parts[0], 55: docs[1][:41]}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()] + [(60, None, 1), (None, docs[1], 1), (1, docs[1], 2)], "doc_id long, text string, start int")
    passages, links, copies = spans.shared_passages(df, span=40, gram=16)
    got = {(r.doc_a, r.doc_b) for r in spans.sharing_pairs(links, copies).collect()}
    assert got == brute_spans(docs, 40)
    assert {r.doc_id: r.n_copies for r in spans.sharing_classes(links, copies).collect()} == {x: 2 if x in (1, 50) else 1 for p in got for x in p}
    rep = {r.doc_id: r for r in spans.sharing_report(df, passages, copies).collect()}
    assert rep[1].shared_part == 1.0 and set(rep) == {x for p in got for x in p}
    for i in set(rep) - {1, 50}:
        others = [t for j, t in docs.items() if j != i]
        t, cover = docs[i], set()
        for j in range(len(t) - 39):
            if any(t[j : j + 40] in o for o in others):
                cover |= set(range(j, j + 40))
        assert rep[i].shared_chars == len(cover)
