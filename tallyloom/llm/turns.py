"""Speech transcripts into ordered turns of interviewer and participant.

Method: the lines of a transcript, in any of its layouts, become utterances with
a label, a start time where the line bears one, and what was said. Labels are
normalised against rosters that all transcripts share (``speakers``). Lexical
noise is taken out, utterances are put in order of their times, and the longest
runs of one speaker are joined to turns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import speakers
from tallyloom.operators.skew import hot_split_join
from tallyloom.session import materialise

#: Labels outside the roster that ``learn_labels`` brings to the driver; beyond it raises.
#: ``speaker_turns`` keeps them in a written table, however many there are.
LEARNED_LABELS = 5000

_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_CLOCK = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?|\d+(?:[.,]\d+)?[ ]?s(?:ec)?"
_TIME = rf"(?:[\[(][ ]*(?:{_CLOCK})[ ]*[\])]|(?:{_CLOCK}))"
_SEPARATOR = r"(?:[ ]?[:：>＞](?=[ ]|\S|$)|[ ]+[-–—](?=[ ]|$))"
_HEAD = re.compile(rf"^(?P<before>{_TIME})?[ ]*(?P<label>{speakers.LABEL})(?:[ ]*(?P<after>{_TIME}))?(?P<separator>{_SEPARATOR})[ ]*")
_INLINE = re.compile(rf"(?:^|(?<=[ ]))(?:(?P<before>{_TIME})[ ]+)?(?P<label>{speakers.LABEL})(?:[ ]*(?P<after>{_TIME}))?(?P<separator>[ ]?[:：>＞])(?=[ ]|$)")
#: What every inline label ends with.
_INLINE_END = re.compile(r"[:：>＞](?=[ ]|$)")
_CUE = re.compile(r"^\s*(?P<start>(?:\d+:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?)\s*-->")
_CHAT = re.compile(r"^\*(?P<label>[^\W_][\w.]*)\s*[:：]")
_BULLET = re.compile(r"\x15(\d+)_(\d+)\x15")

#: Everything inside brackets is an annotation, a time or a mark.
_BRACKETS = re.compile(r"\[[^\[\]\0]*\]|\([^()\0]*\)|\{[^{}\0]*\}|<[^<>\0]*>|（[^（）\0]*）|【[^【】\0]*】|〔[^〔〕\0]*〕|《[^《》\0]*》|\x15[^\x15\0]*\x15?")
_OPENING = re.compile(r"[\[({<（【〔《\x15]")
_CODES = re.compile(r"&[-=+~*]?[^\s,.;:!?，。？！…]+|(?<!\S)\+\S*|\b(?:xxx|yyy|www|xx|yy)\b", re.IGNORECASE)
_WORD_OR_END = re.compile(r"\0|[^\W\d_]+(?:[\u0300-\u036f'’]+[^\W\d_]+)*[\u0300-\u036f]*")
_WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f'’]+[^\W\d_]+)*[\u0300-\u036f]*")

#: Hesitation sounds, whole words, in any length of their drawn-out letter. Fixed values.
_HESITATION = re.compile(r"u+h+|u+h*m+|e+r+m*|h+m+|m+h*m+|m{2,}|e+h+m*|e+m+|h+e+m+|a+h+m+|ä+h+m*|ö+h+m*|ö+m+|ä+m+|e+u+h+|h+e+u+h*|h+u+m+|[呃嗯唔]+", re.IGNORECASE)
#: Of these, words of a language: German personal pronoun and preposition. Fixed values.
_GERMAN_WORDS = frozenset({"er", "um"})
#: Frequent words that German does not share with the other languages here. Fixed values.
_GERMAN_MARKS = frozenset("aber auf beim dass dem den der doch das denn die ein eine einen es hat ich ist mein meine mit nach nein nicht noch schau sein sie und unser unsere vom von vor war weil wie zu zum zur".split())
_INVISIBLE, _BLANK = regex.compile(r"\p{Cf}+"), regex.compile(r"[\p{Zs}--[ ]]", regex.V1)
_CJK = regex.compile(r"[呃嗯唔]+")


@dataclass
class Utterance:
    label: str | None
    start: float | None
    text: str


@dataclass
class Transcript:
    utterances: list[Utterance] = field(default_factory=list)
    declared: dict[str, str] = field(default_factory=dict)


def clean_characters(text: str) -> str:
    """Composed letters; no invisible characters; every blank but line breaks and tabs a plain space."""
    if text.isascii():
        return text
    return _BLANK.sub(" ", _INVISIBLE.sub("", unicodedata.normalize("NFC", text)))


def seconds(clock: str) -> float:
    """``1:02:03.5``, ``02:03`` or ``12.5s`` in seconds."""
    s = clock.strip("[]() ").replace(",", ".")
    if s.endswith(("s", "sec")):
        return float(s.rstrip("sec "))
    total = 0.0
    for part in s.split(":"):
        total = total * 60 + float(part)
    return total


def read(text: str) -> Transcript:
    """The utterances of a transcript as written, whatever its layout."""
    lines = _BREAK.split(clean_characters(text))
    if any(line.startswith(("@Begin", "@UTF8", "@Participants")) or _CHAT.match(line) for line in lines):
        return _read_chat(lines)
    filled = [line for line in lines if line.strip()]
    if len(filled) == 1:
        return _read_inline(filled[0].strip())
    if any(_CUE.match(line) for line in filled):
        return _read_cues(filled)
    return _read_lines(filled)


def _read_chat(lines: list[str]) -> Transcript:
    out, tier = Transcript(), ""
    for line in lines:
        if not line.strip():
            continue
        if line[0] in " \t":
            if tier == "*":
                out.utterances[-1].text += " " + line.strip()
            continue
        tier = line[0]
        if m := _CHAT.match(line):
            out.utterances.append(Utterance(m["label"], None, line[m.end() :].strip()))
        elif line.startswith("@Participants"):
            for part in line.partition(":")[2].split(","):
                words = part.split()
                if len(words) > 1 and (role := speakers.role_of(words[-1])):
                    out.declared[speakers.label_key(words[0])] = role
        elif tier == "*":
            tier = ""
    for u in out.utterances:
        if times := _BULLET.findall(u.text):
            u.start = int(times[0][0]) / 1000
    return out


def _read_cues(lines: list[str]) -> Transcript:
    out, start, fresh = Transcript(), None, False
    for i, line in enumerate(lines):
        if m := _CUE.match(line):
            start, fresh = seconds(m["start"]), True
            continue
        if line.strip().isdigit() and i + 1 < len(lines) and _CUE.match(lines[i + 1]):
            continue
        line = line.strip()
        head = _HEAD.match(line)
        if head and _is_label(head["label"]):
            out.utterances.append(Utterance(head["label"], start, line[head.end() :]))
        elif fresh or not out.utterances:
            out.utterances.append(Utterance(out.utterances[-1].label if out.utterances else None, start, line))
        else:
            out.utterances[-1].text += " " + line
        fresh = False
    return out


def _is_label(label: str) -> bool:
    return speakers.role_of(label) is not None


def _read_lines(lines: list[str]) -> Transcript:
    """Lines that begin with a label, before or after a time; other lines go on with the utterance above.

    A head that the roster does not know is a label if it stands at the head of two
    or more lines with the separator that most heads of this transcript have.
    """
    heads = [None if line[:1] in " \t" and i else _HEAD.match(line.strip()) for i, line in enumerate(lines)]
    count: dict[tuple[str, str], int] = {}
    usual: dict[str, int] = {}
    for h in heads:
        if h:
            mark = h["separator"].strip()
            count[h["label"], mark] = count.get((h["label"], mark), 0) + 1
            usual[mark] = usual.get(mark, 0) + (2 if _is_label(h["label"]) else 1)
    common = max(usual, key=lambda k: usual[k], default="")
    out = Transcript()
    for line, h in zip(lines, heads, strict=True):
        text = line.strip()
        if h and (_is_label(h["label"]) or (h["separator"].strip() == common and count[h["label"], common] > 1)):
            clock = h["before"] or h["after"]
            out.utterances.append(Utterance(h["label"], seconds(clock) if clock else None, text[h.end() :]))
        elif out.utterances:
            out.utterances[-1].text += " " + text
        else:
            out.utterances.append(Utterance(None, None, text))
    return out


def _read_inline(text: str) -> Transcript:
    """One line in which labels of the roster stand before what is said."""
    out, at, label, start = Transcript(), 0, None, None
    if not _INLINE_END.search(text):
        return Transcript([Utterance(None, None, text)])
    for m in _INLINE.finditer(text):
        name, begin = m["label"], m.start()
        first, _, last = name.partition(" ")
        if last and _is_label(last):
            # The first word ends the utterance before.
            begin, name = m.start("label") + len(first) + 1, last
        elif not _is_label(name):
            continue
        if label is not None or text[at:begin].strip():
            out.utterances.append(Utterance(label, start, text[at:begin].strip()))
        clock = m["before"] or m["after"]
        label, start, at = name, seconds(clock) if clock else None, m.end()
    out.utterances.append(Utterance(label, start, text[at:].strip()))
    if any(u.start is None for u in out.utterances if u.label is not None):
        # Where some labels bear no time, those before the others are annotations.
        for u in out.utterances:
            u.start = None
    return out


def spoken_words(text: str) -> list[str]:
    """The words of an utterance that were spoken, in order.

    Annotations, times, codes, marks of unintelligible speech and hesitation sounds
    are left out; repeated words stay. ``er`` and ``um`` are words in German.
    """
    return spoken_many([text])[0]


def spoken_many(texts: list[str]) -> list[list[str]]:
    """``spoken_words`` of each utterance of a transcript, in one pass over all of them; nothing reaches from one into the next."""
    if not texts:
        return []
    joined = " \0 ".join([t.replace("\0", " ") if "\0" in t else t for t in texts])
    if _OPENING.search(joined):
        while (less := _BRACKETS.sub(" ", joined)) != joined:
            joined = less
    joined = _CODES.sub(" ", joined)
    if not joined.isascii():
        joined = _CJK.sub(" ", joined)
    out: list[list[str]] = []
    found = _WORD_OR_END.findall(joined)
    start = 0
    for _ in range(len(texts) - 1):
        end = found.index("\0", start)
        out.append(_without_hesitation(found[start:end]))
        start = end + 1
    out.append(_without_hesitation(found[start:]))
    return out


def _without_hesitation(words: list[str]) -> list[str]:
    if not any(map(is_hesitation, words)):
        return words
    low = [w.lower() for w in words]
    german = sum(w in _GERMAN_MARKS for w in low)
    is_german = german >= 2 and german * 6 >= len(low)
    return [w for w, k in zip(words, low, strict=True) if not is_hesitation(w) or (is_german and k in _GERMAN_WORDS)]


def letters(word: str) -> int:
    """Unicode letters (category L) of a word."""
    return len(word) if word.isalpha() else sum(c.isalpha() for c in word)


@lru_cache(maxsize=100_000)
def is_hesitation(word: str) -> bool:
    """Whether a word is a hesitation sound, in any case."""
    return _HESITATION.fullmatch(word) is not None


def in_order(utterances: list[Utterance]) -> list[Utterance]:
    """By start time; one without a time stays behind the one written before it. Equal times stay as written."""
    keyed, last = [], float("-inf")
    for u in utterances:
        last = u.start if u.start is not None else last
        keyed.append((last, u))
    return [u for _, u in sorted(keyed, key=lambda x: x[0])]


def label_counts(t: Transcript) -> dict[str, tuple[int, int]]:
    out: dict[str, tuple[int, int]] = {}
    for u in t.utterances:
        if u.label is not None:
            n, q = out.get(u.label, (0, 0))
            out[u.label] = (n + 1, q + ("?" in u.text or "？" in u.text))
    return out


def label_votes(t: Transcript) -> list[dict]:
    """What a transcript says of each label that neither the roster nor its header knows.

    vote: 1 where the only known role beside it is the participant, -1 the reverse,
    0 where both or neither are known; n and q: utterances and questions among them.
    """
    counts = label_counts(t)
    known = {x: t.declared.get(speakers.label_key(x)) or speakers.role_of(x) for x in counts}
    roles = set(known.values()) - {None}
    vote = 0 if len(roles) != 1 else 1 if speakers.PARTICIPANT in roles else -1
    return [{"label": speakers.label_key(x), "vote": vote, "n": n, "q": q} for x, (n, q) in counts.items() if known[x] is None]


def turns_of(text: str | None, learned: Mapping[str, float] | None = None) -> list[tuple[str, list[list[str]]]]:
    """speaker and the words of each utterance, of every turn in order.

    Null, empty and blank texts, and texts in which nothing is spoken, have no
    turn. Utterances before any label, and texts without labels, are the
    participant's.
    """
    if text is None or not text.strip():
        return []
    return joined(read(text), learned or {})


def joined(t: Transcript, learned: Mapping[str, float]) -> list[tuple[str, list[list[str]]]]:
    """The turns of a transcript that was read."""
    roles = speakers.assign_roles(label_counts(t), learned, t.declared)
    out: list[tuple[str, list[list[str]]]] = []
    ordered = in_order(t.utterances)
    for u, words in zip(ordered, spoken_many([u.text for u in ordered]), strict=True):
        if not words:
            continue
        speaker = roles.get(u.label, speakers.PARTICIPANT) if u.label is not None else speakers.PARTICIPANT
        if out and out[-1][0] == speaker:
            out[-1][1].append(words)
        else:
            out.append((speaker, [words]))
    return out


_TURN = ["turn_no", "speaker", "utterances", "n_letters"]
_TURN_TYPES = "turn_no int, speaker string, utterances array<string>, n_letters long"


def _rows(key: object, found: list[tuple[str, list[list[str]]]]) -> list[tuple]:
    out = []
    for no, (speaker, said) in enumerate(found, 1):
        whole = "".join(["".join(w) for w in said])
        out.append((key, no, speaker, [" ".join(w) for w in said], letters(whole)))
    return out


def _read_all(narrow: DataFrame) -> DataFrame:
    """k and the turns of each transcript whose labels are all known; of every other one, a row with its text t and its votes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, value in zip(batch["k"], batch["t"], strict=True):
                if value is None or not value.strip():
                    continue
                t = read(value)
                if votes := label_votes(t):
                    rows.append((key, 0, None, None, 0, value, votes))
                else:
                    rows += [(*row, None, None) for row in _rows(key, joined(t, {}))]
            yield pd.DataFrame(rows, columns=["k", *_TURN, "t", "votes"])

    return narrow.mapInPandas(run, f"k {dict(narrow.dtypes)['k']}, {_TURN_TYPES}, t string, votes array<struct<label:string,vote:long,n:long,q:long>>")


def _label_leans(unsure: DataFrame) -> DataFrame:
    """label and lean of every label in ``votes``, from all transcripts it occurs in: above 0 the interviewer.

    A label's transcripts vote: for the interviewer where the only known role beside
    it is the participant, or the reverse; the lean is the votes' mean. Where they
    cancel out or both or neither role are known, it is the share of questions among
    its utterances above a half, times two. Counts are aggregated before the shuffle.
    """
    v = unsure.select(F.explode("votes").alias("v")).select("v.*").where("label <> ''")
    total = v.groupBy("label").agg(F.count("*").alias("texts"), *[F.sum(c).alias(c) for c in ("vote", "n", "q")])
    return total.select("label", F.when(F.col("vote") != 0, F.col("vote") / F.col("texts")).otherwise((F.col("q") * 2 - F.col("n")) / F.col("n")).alias("lean"))


def learn_labels(transcripts: DataFrame, text: str) -> dict[str, str]:
    """Roles that labels outside the roster lean to (``_label_leans``), for a look at few of them: more than ``LEARNED_LABELS`` raise."""
    read_ = _read_all(transcripts.where(F.col(text).isNotNull()).select(F.lit(0).alias("k"), F.col(text).alias("t")))
    found = _label_leans(read_.where(F.col("votes").isNotNull())).limit(LEARNED_LABELS + 1).collect()
    if len(found) > LEARNED_LABELS:
        raise ValueError(f"more than {LEARNED_LABELS} labels outside the roster")
    return {r.label: speakers.INTERVIEWER if r.lean > 0 else speakers.PARTICIPANT for r in found}


def speaker_turns(transcripts: DataFrame, record_id: str, text: str) -> DataFrame:
    """record_id, turn_no (from 1), speaker, utterances (the spoken words of each, blank-joined) and n_letters of every turn.

    One row per turn of every row of ``transcripts``: repeated rows give repeated
    turns. Only the two named columns are read. A transcript is read where it lies,
    in Arrow batches, and its turns are written if all its labels are known. The
    others wait for the leans of their labels: those of all labels are a written
    table, joined to the distinct labels of each text. Only these texts shuffle.
    """
    narrow = transcripts.where(F.col(text).isNotNull()).select(F.col(record_id).alias("k"), F.col(text).alias("t"))
    found = materialise(_read_all(narrow).withColumn("h", F.sha2("t", 256)), "turns")
    sure = found.where(F.col("t").isNull()).select(F.col("k").alias(record_id), *_TURN)
    unsure = found.where(F.col("t").isNotNull()).select("k", "t", "votes", "h")
    if unsure.isEmpty():
        return sure
    leans = materialise(_label_leans(unsure), "label-leans")
    pairs = materialise(unsure.select("h", F.explode("votes.label").alias("label")).distinct(), "text-labels")
    learned = hot_split_join(pairs, leans, "label").groupBy("h").agg(F.collect_list(F.struct("label", "lean")).alias("x"))
    waiting = hot_split_join(unsure, learned, "h", "left").select("k", "t", F.col("x.label").alias("labels"), F.col("x.lean").alias("leans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, value, labels, own in zip(batch["k"], batch["t"], batch["labels"], batch["leans"], strict=True):
                rows += _rows(key, turns_of(value, {} if labels is None else dict(zip(labels, own, strict=True))))
            yield pd.DataFrame(rows, columns=["k", *_TURN])

    later = waiting.mapInPandas(run, f"k {dict(narrow.dtypes)['k']}, {_TURN_TYPES}")
    return sure.unionByName(later.withColumnRenamed("k", record_id))
