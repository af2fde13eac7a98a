"""Language identification: automata against brute force, and the stated cases."""

import itertools
import random

import numpy as np
import pytest

from tallyloom.llm import langid

SAMPLES = {
    "en": "the old baker washed the green cups and then she said that nobody was there when the driver came back from the market " * 3,
    "de": "die alte bäckerin wusch die grünen tassen und dann sagte sie dass niemand dort war als der fahrer vom markt zurückkam " * 3,
    "es": "la vieja panadera lavó las tazas verdes y luego dijo que no había nadie allí cuando el conductor volvió del mercado " * 3,
    "fr": "la vieille boulangère a lavé les tasses vertes puis elle a dit que personne n'était là quand le chauffeur est revenu du marché " * 3,
    "zh": "面包店的老板洗了绿色的杯子然后她说司机从市场回来的时候没有人在那里" * 3,
}
MODEL = langid.Model(SAMPLES)


def brute_phrases(text, z):
    n, i = 0, 0
    while i < len(z):
        j = i + 1
        while j <= len(z) and z[i:j] in text:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
        z = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30)))
        assert langid.SuffixAutomaton(text).phrases(z) == brute_phrases(text, z)
    assert langid.SuffixAutomaton("abc").phrases("xxxxxx", 2) == 3


def test_flat_automata_step_many_texts_as_one():
    """Phrases by letter of many texts together, the few longest to their ends alone, against one automaton at a time."""
    rng = random.Random(4)
    words = [w for t in SAMPLES.values() for w in t.split()] + ["qqq", "ж"]
    texts = langid.normal_texts([" ".join(rng.choice(words)[:20] for _ in range(rng.randrange(1, 12))) for _ in range(80)] + ["a", "ж", " ".join(rng.choice(words) for _ in range(400))])
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = MODEL.ends(np.frombuffer(" ".join(texts).encode("utf-32-le"), dtype=np.uint32), starts, lengths)
    for k, (_, sample) in enumerate(MODEL.texts):
        one = langid.SuffixAutomaton(sample)
        assert [int(ends[k, a : a + n].sum()) for a, n in zip(starts, lengths, strict=True)] == [one.phrases(t) for t in texts]


def test_blocks_do_not_change_judgements(monkeypatch):
    texts = [["The driver washed the cups.", None, ""], [], ["Der Fahrer wusch die Tassen."], [" "], ["司机洗了杯子。", "the driver"], ["\0"]]
    whole = langid.judge_texts(MODEL, texts)
    monkeypatch.setattr(langid, "STEP_LETTERS", 5)
    assert langid.judge_texts(MODEL, texts) == whole == [langid.judge_turn(MODEL, t) for t in texts]
    assert whole[1] == whole[3] == whole[5] == (None, 0.0, False, [])


def test_a_change_inside_an_utterance_is_found():
    language, confidence, whole, segments = langid.judge_turn(MODEL, ["and then she said that nobody was there die alte bäckerin wusch die grünen tassen und dann sagte sie"])
    assert [s["language"] for s in segments] == ["en", "de"] and not whole and language == "de" and 0.5 < confidence < 1
    assert sum(s["letters"] for s in segments) == 82
    assert [s["language"] for s in langid.judge_turn(MODEL, ["面包店的老板洗了绿色的杯子 the driver came back from the market 没有人在那里然后她说"])[3]] == ["zh", "en", "zh"]


def test_paths_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(30):
        sizes = rng.integers(1, 6, 4)
        costs = rng.integers(0, 9, (sizes.sum(), 3)).astype(float)
        first = np.cumsum(sizes) - sizes
        got = langid._cheapest_paths(costs, first, np.add.reduceat(costs, first, axis=0))
        for a, n in zip(first, sizes, strict=True):
            def cost(path):
                return sum(costs[a + w, k] for w, k in enumerate(path)) + langid.CHANGE * sum(x != y for x, y in itertools.pairwise(path))

            assert cost(got[a : a + n]) == min(cost(p) for p in itertools.product(range(3), repeat=int(n)))


@pytest.mark.parametrize(("code", "text"), [("en", "The driver washed the cups."), ("de", "Der Fahrer wusch die Tassen."), ("es", "El conductor lavó las tazas."), ("fr", "Le chauffeur a lavé les tasses."), ("zh", "司机洗了杯子。")])
def test_languages(code, text):
    found, confidence, letters = MODEL.judge(text)
    assert found == code and 0.5 < confidence <= 1 and letters > 0


def test_empty_and_turns():
    assert MODEL.judge(None) == MODEL.judge("") == MODEL.judge(" 12 !") == (None, 0.0, 0)
    assert langid.judge_turn(MODEL, []) == langid.judge_turn(MODEL, [None, ""]) == (None, 0.0, False, [])
    language, _, whole, segments = langid.judge_turn(MODEL, ["The old baker washed the green cups.", "Die alte Bäckerin wusch die grünen Tassen und dann."])
    assert not whole and [s["language"] for s in segments] == ["en", "de"] and language == "de"
    assert langid.judge_turn(MODEL, ["the old baker", "washed the green cups"])[2]


@pytest.mark.parametrize(
    ("label", "code"),
    [("en", "en"), ("EN", "en"), ("en-US", "en"), ("es_MX", "es"), ("zh-CN", "zh"), ("Mandarin", "zh"), ("中文", "zh"), ("Français", "fr"), ("deu", "de"), (" Spanish ", "es"), (None, None), ("", None), ("mixed", None), ("en/es", None), ("multilingual", None), ("und", None), ("??", None), ("n/a", None), ("auto", None)],
)
def test_labels(label, code):
    assert langid.named_language(label) == code


def test_wrong_labels_are_left_out():
    rng = random.Random(2)
    rows = []
    for code, text in SAMPLES.items():
        words = text.split() if code != "zh" else [text[i : i + 4] for i in range(0, len(text), 4)]
        rows += [(code, langid.normal_text(" ".join(rng.choice(words) for _ in range(40)))) for _ in range(10)]
    wrong = [("de", langid.normal_text(SAMPLES["en"]))] * 2
    model = langid.fit_texts([*rows[::2], *wrong, *rows[1::2]])
    assert "driver" not in dict(model.texts)["de"]


def test_turn_languages_keeps_rows(spark):
    df = spark.createDataFrame([("a", ["The driver washed the cups"]), ("b", None), ("c", [])], "id string, utterances array<string>")
    got = {r.id: (r.language, r.whole) for r in langid.turn_languages(df, MODEL).collect()}
    assert got == {"a": ("en", True), "b": (None, False), "c": (None, False)}


def test_fit_without_documents(spark):
    model = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert model.judge("any text") == (None, 0.0, 7)


def test_document_languages(spark):
    rows = [(1, "The driver washed the cups. Der Fahrer wusch die Tassen und dann sagte sie dass niemand dort war.", "German", "x"), (2, None, "en", "x"), (3, "  \n", None, "x"), (4, "el conductor volvió del mercado", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    got = {r.doc_id: r for r in langid.document_languages(df, MODEL).collect()}
    assert [s.language for s in got[1].segments] == ["en", "de"] and got[1].named == "de"
    assert got[2].language is None and got[3].language is None and not got[3].segments
    assert (got[4].language, got[4].whole, got[4].named) == ("es", True, "en")


def test_other_languages_by_parameter(spark):
    rng = random.Random(3)
    nl, en = "de oude bakker waste de groene kopjes en zei toen dat er niemand was".split(), SAMPLES["en"].split()
    rows = [(i, " ".join(rng.choice(w) for _ in range(40)), c) for i in range(40) for c, w in [("nl", nl) if i % 2 else ("en", en)]]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=("en", "nl"))
    assert model.languages == ("en", "nl") and model.judge("de bakker zei dat er niemand was")[0] == "nl"
