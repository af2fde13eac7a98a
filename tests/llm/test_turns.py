"""Transcripts of every layout into the same turns."""

import pytest

from tallyloom.llm import speakers, turns


def flat(text, learned=None):
    return [(s, " / ".join(" ".join(w) for w in said)) for s, said in turns.turns_of(text, learned)]


WANT = [("interviewer", "What do you see"), ("participant", "The the boy fell / He ran"), ("interviewer", "And then")]

CHAT = "@UTF8\n@Begin\n@Participants:\tPAR Participant, INV Investigator\n*INV:\tWhat do you see? \x150_900\x15\n*PAR:\tThe [/] the &-uh boy\n\tfell xxx. \x151000_2000\x15\n%com:\tpoints at it\n*INV:\t&=laughs \x152100_2200\x15\n*Par:\tHe ran +... \x153000_4000\x15\n*inv:\tAnd then? \x155000_6000\x15\n@End"
SRT = "1\r\n00:00:00,000 --> 00:00:01,000\r\nInterveiwer: What do you see?\r\n\r\n2\r\n00:00:05,000 --> 00:00:06,000\r\nInterveiwer: And then?\r\n\r\n3\r\n00:00:01,000 --> 00:00:02,000\r\nParticpant: The the um... boy fell.\r\n\r\n4\r\n00:00:03,000 --> 00:00:04,000\r\nPt: He {laughs} ran.\r\n"
LINES = "[00:00:01] Dr. : What do you\n   see?\n\n[00:00:02] PAR : The, the boy erm fell [inaudible].\n(door closes)\n[00:00:03] Patient : He ran.\n[00:00:09] Dr. : And then?"
AFTER = "Q 1.0s> What do you see?\nA 2.0s> The the boy fell\nA 2.5s> hmm...\nA 3.0s> He ran\nQ 4.0s> And then?"
DASH = "Int. - What do you see?\nSubject - The - the boy ♪ fell\nSubject - He ran\nInt. - And then?"
INLINE = "Q： What do you see? A： The the boy fell. A： He ran [00:00:18]. Q： And then?"


@pytest.mark.parametrize("text", [CHAT, SRT, LINES, AFTER, DASH, INLINE, "﻿" + LINES.replace(" ", " "), INLINE.replace("Q：", "Q​：")])
def test_layouts(text):
    assert flat(text) == WANT


def test_nothing_spoken():
    for t in (None, "", "  \n ", "[laughs]", "Q: [coughs]\nA: um, uh...\nA: xxx", "@Begin\n@End", "1\n00:00:01,000 --> 00:00:02,000\n\n"):
        assert flat(t) == []


def test_silent_utterances_do_not_break_a_turn():
    assert flat("Q: [x]\nA: One.\nQ: uhm\nA: Two.") == [("participant", "One / Two")]


def test_german_words_are_no_hesitation():
    assert turns.spoken_words("Er sagt, dass er um den Tisch und nicht äh auf die Bank ging") == "Er sagt dass er um den Tisch und nicht auf die Bank ging".split()
    assert turns.spoken_words("I er think um yes") == ["I", "think", "yes"]
    assert turns.spoken_words("呃……我看见，嗯，店主") == ["我看见", "店主"]


def test_labels():
    assert speakers.role_of("Interveiwer") == "interviewer" and speakers.role_of("Particpant") == "participant"
    assert speakers.role_of("Enquêtrice") == "interviewer" and speakers.role_of("访谈者") == "interviewer" and speakers.role_of("a") is None
    assert speakers.role_of("caliente") is None and speakers.role_of("Look") is None
    assert flat("Zed: Where was it?\nPAR: There.\nZed: Why?") == [("interviewer", "Where was it"), ("participant", "There"), ("interviewer", "Why")]
    assert flat("Xo: Where was it?\nYo: There.\nXo: Why?\nYo: So.")[0][0] == "interviewer"
    assert flat("just words without a label") == [("participant", "just words without a label")]


def test_letters_count_whole_unicode(spark):
    df = spark.createDataFrame([("c", "Q: Qué és esto2?\nA: 它很好 3", "x"), ("n", None, "x"), ("c", "", "x"), (None, "A: Hi", "x")], "case_id string, transcript string, turn_no string")
    got = [tuple(r) for r in turns.speaker_turns(df, "case_id", "transcript").select("case_id", "turn_no", "speaker", "n_letters").collect()]
    assert sorted(got, key=str) == sorted([("c", 1, "interviewer", 9), ("c", 2, "participant", 3), (None, 1, "participant", 2)], key=str)


def test_labels_learned_from_other_transcripts(spark):
    rows = [(str(i), f"Zed: How are you?\nPAR: Fine {i}.\nZed: And now?", "") for i in range(5)]
    df = spark.createDataFrame(rows, "case_id string, transcript string, x string")
    assert turns.learn_labels(df, "transcript") == {"zed": "interviewer"}


def test_more_labels_than_the_driver_would_hold(spark):
    names = ["Zq" + "".join(chr(97 + i // 26**j % 26) for j in range(3)) + "zz" for i in range(turns.LEARNED_LABELS + 1)]
    rows = [(f"{x}{i}", f"{x}: Tell me.\nPAR: Yes.\n{x}: Go on.") for x in names for i in range(3)]
    rows += [("beside", "Bob: Tell me.\nPAR: Yes.\nBob: Go on."), ("alone", "Bob: Tell me.\nBob: Go on.")]
    got = turns.speaker_turns(spark.createDataFrame(rows, "case_id string, transcript string"), "case_id", "transcript")
    assert [r.speaker for r in got.where("case_id = 'alone'").collect()] == ["interviewer"]
    assert got.count() == 3 * (len(rows) - 1) + 1


def test_labels_of_a_transcript_use_both_roles(spark):
    neither_asks = "Zoe: Tell me more.\nBea: Well, the boy fell.\nZoe: Go on.\nBea: He ran."
    rows = [(f"n{i}", neither_asks) for i in range(4)] + [("asks", neither_asks.replace("Go on.", "What then?"))]
    rows += [(f"k{i}", "INV: Look at this.\nUma: I see.\nINV: Go on.\nUma: Yes.") for i in range(4)] + [("beside", "PAR: I see.\nUma: Go on.\nPAR: Yes.\nUma: Good.")]
    rows += [("digits", "@Begin\n*SPK1:\tHe ran.\n*SPK2:\tWhy?\n*SPK1:\tSo."), ("one", "Bea: He ran.\nBea: So.")]
    got = turns.speaker_turns(spark.createDataFrame(rows, "case_id string, transcript string"), "case_id", "transcript")
    said = {}
    for r in got.orderBy("case_id", "turn_no").collect():
        said[r.case_id] = said.get(r.case_id, "") + r.speaker[0]
    assert said == {f"n{i}": "ipip" for i in range(4)} | {"asks": "ipip", "beside": "pipi", "digits": "pip", "one": "p"} | {f"k{i}": "ipip" for i in range(4)}


def test_least_cost_moves_one_label_only():
    n = {x: (4, 0) for x in ("Uma", "Bea", "Zoe")}
    assert speakers.assign_roles(n, {"uma": -0.9, "bea": -1.0, "zoe": -0.2}, {}) == {"Uma": "participant", "Bea": "participant", "Zoe": "interviewer"}
    assert speakers.assign_roles(n | {"INV": (4, 4)}, {"uma": 0.9, "bea": 0.1, "zoe": 0.2}, {}) == {"INV": "interviewer", "Uma": "interviewer", "Bea": "participant", "Zoe": "interviewer"}


def test_very_long_text():
    text = "\n".join(f"{'Q' if i % 2 else 'A'}: {'word ' * 50}" for i in range(4000))
    assert len(flat(text)) == 4000


def test_utterances_cleaned_together_as_one_by_one():
    """Open brackets, codes at an edge, marks and hesitations do not reach into the next utterance."""
    said = ["um, yes [laughs", "so] +... it was (the end", "&-uh well) xxx fine", "", "+/ and er then", "ich gehe nicht und er sagt es", "嗯 我们 看见 船", "a\x00b", "\x15100_200", "300\x15 done", "<b {c", "d} e>", "HMM Er UM word"]
    assert turns.spoken_many(said) == [turns.spoken_words(s) for s in said]
    assert turns.spoken_many([]) == [] and turns.spoken_words("a\x00b") == ["a", "b"]
    assert turns.spoken_words("HMM Er UM word") == ["word"] and "er" in turns.spoken_words("ich gehe nicht und er sagt es")
