"""Reading levels: prose or not, calibration, and accuracy on documents left out."""

import random

import numpy as np
import pytest

from tallyloom.llm import reading as R

BASIC = ["The dog ran to the house.", "My sister has a red hat.", "We saw the boat and it was old.", "He is here and she is not."]
MIDDLE = ["Although the driver was late, the people in the house waited because they had no key.", "When the dog ran away, my sister said that it was the fault of the old man who had left the gate open."]
HARD = ["Notwithstanding the heterogeneity of the posited covariates, the regularised estimator presupposes an admissible counterfactual.", "The provisional exclusion of unreliable observations is demonstrably confounded by the asymmetric censoring of the intervals."]


def make(rng, band, n=8):
    return " ".join(rng.choice((BASIC, MIDDLE, HARD)[band]) for _ in range(n))


@pytest.mark.parametrize("text", [None, "", " \n", '{"a": 1, "b": 2}', "states:\n  - id: S1\n    metrics: [a]\n    weights: [0.5]", "dog\ncat\nowl\nfox\nbee\nant\nelk\nbat\nhen", "perro, gato, burro, loro, nutria, morsa, tejón, garza, hurón", "鸽子、甲虫、水獭、鸽子、甲虫、苍鹭、仓鼠、水獭", "too short", "<|endoftext|>", "🙂"])
def test_no_prose(text):
    assert R.features(text) is None


def test_transcripts_are_read_without_labels():
    _, words = R.prose("Q: Where was the dog that you saw in the house?\nA: um, it was [laughs] in the old boat and it was wet.\nQ: And then?")
    assert "q" not in {w for s in words for w in s} and "um" not in {w for s in words for w in s} and ["and", "then"] in words


def test_isotonic_pools():
    knots, levels = R.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 2.0, 1.0, 2.0]))
    assert list(levels) == [0.0, 1.5, 1.5, 2.0] and (np.diff(levels) >= 0).all() and list(knots) == [1, 2, 3, 4]


def test_held_out_accuracy_with_wrong_labels():
    rng = random.Random(5)
    docs = [(make(rng, b := i % 3), b) for i in range(240)]
    found = [R.features(t) for t, _ in docs]
    noisy = [b if rng.random() > 0.05 else rng.randrange(3) for _, b in docs[:160]]
    scale = R.fit_rows(found[:160], noisy)
    hit = [R.band_of(scale.level(scale.score(f))) == R.BANDS[b] for f, (_, b) in zip(found[160:], docs[160:], strict=True)]
    assert sum(hit) / len(hit) > 0.9


def test_frames(spark):
    rng = random.Random(6)
    rows = [(i, make(rng, i % 3), "x") for i in range(90)] + [(90, None, "x"), (91, "", "x"), (0, make(rng, 0), "dup")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, level string")
    labels = spark.createDataFrame([(i, R.BANDS[i % 3]) for i in range(60)] + [(1, None), (2, "odd"), (500, "basic")], "doc_id long, band string")
    out = R.read_levels(docs, R.fit(docs, labels)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.band for r in out}
    assert got[90] is None and got[91] is None
    assert sum(got[i] == R.BANDS[i % 3] for i in range(90)) > 80
    with pytest.raises(ValueError, match="no rated document"):
        R.fit(docs, labels.limit(0))


def test_many_texts_at_once_as_one_by_one():
    rng = random.Random(7)
    texts = [make(rng, i % 3, 1 + i % 5) for i in range(30)] + [None, "", "Lists: a, b, c", "我们看见那条旧船，所以大家都在家里等着他回来。" * 3, "İstanbul'da bir gün, kimse yoktu ve hava soğuktu.", " \n"]
    rows, syntax, start, places, values = R.many_features(texts)
    assert set(range(len(texts))) - set(rows.tolist()) == {30, 31, 32, 35}
    for i, a, b, own in zip(rows, start[:-1], start[1:], syntax, strict=True):
        one = R.features(texts[i])
        assert np.allclose(one[0], own) and one[1] == places[a:b].tolist() and np.allclose(one[2], values[a:b])
        assert abs(sum(v * v for v in one[2]) - 1) < 1e-9


def test_syntax_by_hand():
    s, _, _ = R.features("The old man saw it, and he ran. Was it a well-known dog of the house?")
    f = dict(zip(R.SYNTAX, s, strict=True))
    assert f["log_words"] == pytest.approx(np.log1p(16)) and f["log_sentence"] == pytest.approx(np.log1p(8)) and f["sentence_spread"] == 0
    assert f["commas"] == pytest.approx(1 / 16) and f["questions"] == pytest.approx(1 / 2) and f["joined_marks"] == pytest.approx(1 / 16) and f["distinct"] == pytest.approx(14 / 8)


def test_the_gate_is_learned_from_texts_without_a_band(spark):
    rng = random.Random(8)
    beasts = "otter donkey walrus turtle ferret parrot hamster pigeon badger beetle salmon heron".split()
    lists = [" ".join(rng.choice(beasts) for _ in range(14)) for _ in range(40)]
    rows = [(i, make(rng, i % 3)) for i in range(90)] + [(100 + i, t) for i, t in enumerate(lists)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, R.BANDS[i % 3]) for i in range(60)] + [(100 + i, None) for i in range(20)], "doc_id long, band string")
    got = {r.doc_id: r.band for r in R.read_levels(docs, R.fit(docs, labels)).collect()}
    assert all(got[i] is None for i in range(100, 140)) and all(got[i] is not None for i in range(90))
    assert R.vocabulary_gate([R.features(make(rng, 0))], []) == (None, 0.0)
