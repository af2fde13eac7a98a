"""Languages of texts and of their parts, with a confidence.

Method: cross-parsing entropy. The labelled text of each language becomes a
suffix automaton. A text is parsed from left to right into the longest phrases
that occur in a language's text; the language that needs the fewest phrases per
letter wins, for its text predicts this one best. Where a text changes its
language, the cheapest path over its words says: the phrases that end in a word
are its cost in a language, and a change costs ``CHANGE`` phrases.

All parses are whole. The automata become flat tables, and the texts of a batch
are stepped through them together, a letter of each at a time.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.sequence import below_share

LANGUAGES = ("de", "en", "es", "fr", "zh")

#: Names and codes of the languages. Fixed values.
NAMES = {
    "de": ("de", "deu", "ger", "german", "germany", "deutsch", "aleman", "alemán", "allemand", "德语", "德文"),
    "en": ("en", "eng", "english", "englisch", "ingles", "inglés", "anglais", "英语", "英文"),
    "es": ("es", "spa", "spanish", "espanol", "español", "castellano", "castilian", "spanisch", "espagnol", "西班牙语", "西班牙文"),
    "fr": ("fr", "fra", "fre", "french", "francais", "français", "franzosisch", "französisch", "frances", "francés", "法语", "法文"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "putonghua", "hans", "hant", "chinesisch", "chino", "chinois", "中文", "汉语", "漢語", "普通话", "华语", "国语", "简体中文", "繁體中文"),
}
_BY_NAME = {name: code for code, names in NAMES.items() for name in names}

#: The labelled sample: documents a language, letters taken of each, letters of a language in all; shorter texts are not drawn.
SAMPLE_DOCUMENTS, SAMPLE_LETTERS, LANGUAGE_LETTERS, LEAST_LETTERS = 200, 400, 48_000, 100
#: A part's language counts from this confidence on.
LEAST_CONFIDENCE = 0.6
#: What a change of language inside a text costs, in phrases.
CHANGE = 6.0
#: Letters that are parsed together, and texts from which on a step of all is cheaper than one after the other.
STEP_LETTERS, STEP_TEXTS = 1_000_000, 24

_NOT_LETTERS = regex.compile(r"[^\p{L}]+")
_NOT_LETTERS_OF_MANY = regex.compile(r"[^\p{L}\0]+")
_PARTS = re.compile(r"[\r\n.!?;。！？；]+")
_CODE = re.compile(r"([A-Za-z]{2,3})[-_]([A-Za-z]{2,4}|\d{3})(?:[-_.].*)?")


def named_language(label: str | None) -> str | None:
    """The one language a label names, else None: null, blank, placeholders, unknown names and labels of several languages."""
    if label is None:
        return None
    text = unicodedata.normalize("NFC", label).strip()
    if m := _CODE.fullmatch(text):
        return _BY_NAME.get(m[1].lower())
    words = [w for w in _NOT_LETTERS.split(text.lower()) if w]
    found = {_BY_NAME[w] for w in words if w in _BY_NAME}
    rest = [w for w in words if w not in _BY_NAME]
    return found.pop() if len(found) == 1 and not any(w in ("mixed", "multi", "multilingual", "bilingual", "unknown", "other", "not") for w in rest) else None


def normal_text(text: str) -> str:
    """Letters in lower case, composed; anything between them is one blank."""
    low = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
    if "  " not in low and low.replace(" ", "").isalpha():
        return low.strip()
    return _NOT_LETTERS.sub(" ", low).strip()


def normal_texts(texts: Sequence[str | None]) -> list[str]:
    """``normal_text`` of each; null gives an empty one. One pass over all of them."""
    joined = "\0".join("" if t is None else t.replace("\0", " ") for t in texts)
    low = (joined if joined.isascii() else unicodedata.normalize("NFC", joined)).lower()
    return _NOT_LETTERS_OF_MANY.sub(" ", low).replace(" \0", "\0").replace("\0 ", "\0").strip(" ").split("\0") if texts else []


class SuffixAutomaton:
    """Recognises every substring of a text. ``steps[state]`` maps a letter to the next state; state 0 is the start."""

    def __init__(self, text: str) -> None:
        self.steps: list[dict[str, int]] = [{}]
        self.size = len(text)
        link, length = [-1], [0]
        last = 0
        for c in text:
            last = self._append(c, last, link, length)

    def _append(self, c: str, last: int, link: list[int], length: list[int]) -> int:
        steps = self.steps
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        return new

    def phrases(self, text: str, most: float = math.inf) -> int:
        """Phrases of the greedy parse; a letter the automaton lacks is a phrase of its own. Stops beyond ``most``."""
        here = count = 0
        steps = self.steps
        for c in text:
            at = steps[here].get(c)
            if at is None:
                at = steps[0].get(c)
                # The phrase so far ends here; a letter that no phrase begins with is one itself.
                count += (here != 0) + (at is None)
                if count > most:
                    return count
                at = at or 0
            here = at
        return count + (here != 0)


class FlatAutomaton:
    """A suffix automaton as one table of slots.

    A state is its base; the slot ``base + letter code`` holds that code and the
    base of the next state. Bases differ, so a slot that bears the code belongs to
    the state. The start has base 0. first: where a letter leads from the start
    (0 if nowhere); lacks: 1 for letters that no phrase begins with.
    """

    def __init__(self, a: SuffixAutomaton, code_of: Mapping[str, int], codes: int) -> None:
        src = np.array([i for i, step in enumerate(a.steps) for _ in step], dtype=np.int64)
        code = np.array([code_of[c] for step in a.steps for c in step], dtype=np.int64)
        dst = np.array([to for step in a.steps for to in step.values()], dtype=np.int64)
        size = 1 << max(12, int(4 * len(src) + 2 * codes).bit_length())
        base = _bases(src, code, len(a.steps), size, codes)
        self.shift = 20 if size <= 1 << 20 and codes < 1 << 12 else 40
        self.kind = np.uint32 if self.shift == 20 else np.uint64
        self.table = np.zeros(size, dtype=self.kind)
        self.table[base[src] + code] = (code << self.shift | base[dst]).astype(self.kind)
        self.first = np.zeros(codes + 1, dtype=np.int64)
        own = src == 0
        self.first[code[own]] = base[dst[own]]
        self.lacks = (self.first == 0).astype(np.uint8)
        self.bits = math.log2(a.size + 2)

    def step_all(self, codes: np.ndarray, counts: np.ndarray, live: list[int]) -> np.ndarray:
        """Add the phrases that end at each letter to ``counts``; the states at the end.

        codes, counts: position-major; ``live[p]`` texts have a letter at position p, the longest first.
        """
        mask, shift = self.kind((1 << self.shift) - 1), self.kind(self.shift)
        narrow = codes.astype(self.kind)
        state = np.zeros(live[0], dtype=np.int64)
        at = 0
        for p, n in enumerate(live):
            if n < len(state):
                counts[at - len(state) + n : at] += state[n:] != 0
                state = state[:n]
            here = slice(at, at + n)
            found = self.table.take(state + codes[here])
            missed = np.flatnonzero((found >> shift) != narrow[here])
            ends = (state[missed] != 0).astype(np.uint8)
            state = (found & mask).astype(np.int64)
            if len(missed):
                c = codes[here][missed]
                counts[at + missed] += ends + self.lacks[c]
                state[missed] = self.first[c]
            at += n
        return state

    def step_one(self, codes: list[int], state: int, counts: np.ndarray) -> None:
        """The same for the rest of one text, whose last letter closes its phrase."""
        table, first, lacks, shift, mask = self._views
        for i, c in enumerate(codes):
            found = table[state + c]
            if found >> shift == c:
                state = found & mask
            else:
                counts[i] += (state != 0) + lacks[c]
                state = first[c]
        if codes:
            counts[len(codes) - 1] += state != 0

    @cached_property
    def _views(self) -> tuple:
        return memoryview(self.table), self.first.tolist(), self.lacks.tolist(), self.shift, (1 << self.shift) - 1

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_views"}


def _bases(src: np.ndarray, code: np.ndarray, states: int, size: int, codes: int, seed: int = 11) -> np.ndarray:
    """A base for each state, so that no two states share a base or a slot; drawn at random, those with most letters first."""
    rng = np.random.default_rng(seed)
    base = np.zeros(states, dtype=np.int64)
    slots, bases = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    slots[code[src == 0]] = bases[0] = True
    letters = np.bincount(src, minlength=states)
    waiting = np.argsort(-letters[1:], kind="stable") + 1
    rank = np.full(states, -1)
    while len(waiting):
        rank[:] = -1
        rank[waiting] = np.arange(len(waiting))
        tried = rng.integers(1, size - codes - 1, len(waiting))
        own = np.flatnonzero(rank[src] >= 0)
        own = own[np.argsort(rank[src[own]], kind="stable")]
        who = rank[src[own]]
        at = tried[who] + code[own]
        won = np.zeros(len(at), dtype=bool)
        won[np.unique(at, return_index=True)[1]] = True
        fits = np.bincount(who, won & ~slots[at], len(waiting)) == letters[waiting]
        alone = np.zeros(len(waiting), dtype=bool)
        alone[np.unique(tried, return_index=True)[1]] = True
        fits &= alone & ~bases[tried]
        base[waiting[fits]] = tried[fits]
        bases[tried[fits]] = True
        slots[at[fits[who]]] = True
        waiting = waiting[~fits]
    return base


class Model:
    """The suffix automata of the languages, flat, as they travel to the tasks."""

    def __init__(self, texts: Mapping[str, str]) -> None:
        self.texts = tuple(sorted((k, v) for k, v in texts.items() if v))
        self.languages = tuple(k for k, _ in self.texts)
        letters = sorted({c for _, t in self.texts for c in t} | {" "})
        self.code_of = {c: i for i, c in enumerate(letters, 1)}

    @cached_property
    def automata(self) -> list[FlatAutomaton]:
        return [FlatAutomaton(SuffixAutomaton(t), self.code_of, len(self.code_of) + 1) for _, t in self.texts]

    @cached_property
    def weights(self) -> np.ndarray:
        """Cost of a phrase: the bits that point into the language's text, over those of the largest text."""
        bits = np.array([math.log2(len(t) + 2) for _, t in self.texts])
        return bits / bits.max(initial=1.0)

    @cached_property
    def _code(self) -> np.ndarray:
        """Letter code by code point; letters of no language share the last code."""
        table = np.full(0x110000, len(self.code_of) + 1, dtype=np.int64 if len(self.code_of) > 60_000 else np.uint16)
        for c, i in self.code_of.items():
            table[ord(c)] = i
        return table

    def __getstate__(self) -> dict:
        self.automata  # noqa: B018 - built once, before it travels
        return {k: v for k, v in self.__dict__.items() if k != "_code"}

    def ends(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases that end at each letter, one row a language, of the texts that lie at ``starts`` in the code points."""
        out = np.zeros((len(self.texts), len(points)), dtype=np.uint8)
        if not len(points) or not len(self.texts) or not lengths.max(initial=0):
            return out
        code = self._code[points].astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths, starts = lengths[order], starts[order]
        live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        together = int((live >= STEP_TEXTS).sum())
        live = live[:together]
        at = starts[np.arange(live.sum()) - np.repeat(np.cumsum(live) - live, live)] + np.repeat(np.arange(together), live)
        rest = int((lengths > together).sum())
        for a, own in zip(self.automata, out, strict=True):
            states = np.zeros(len(lengths), dtype=np.int64)
            if together:
                counts = np.zeros(len(at), dtype=np.uint8)
                last = a.step_all(code[at], counts, live.tolist())
                states[: len(last)] = last
                own[at] = counts
                closed = np.arange(rest, len(last))
                own[starts[closed] + together - 1] += states[closed] != 0
            for i in range(rest):
                here = slice(starts[i] + together, starts[i] + lengths[i])
                a.step_one(code[here].tolist(), int(states[i]), own[here])
        return out

    def costs(self, text: str) -> tuple[dict[str, float], int]:
        """Cost of the text in each language, and its letters."""
        plain = normal_text(text)
        letters = len(plain) - plain.count(" ")
        if not letters:
            return {}, 0
        points = np.frombuffer(plain.encode("utf-32-le"), dtype=np.uint32)
        phrases = self.ends(points, np.zeros(1, dtype=np.int64), np.array([len(points)])).sum(axis=1, dtype=np.int64)
        return dict(zip(self.languages, (phrases * self.weights).tolist(), strict=True)), letters

    def judge(self, text: str | None) -> tuple[str | None, float, int]:
        """language, confidence and letters. No letters or no labelled text: no language, confidence 0.

        The confidence is the winner's share of exp(-cost). Equal costs: the first
        code, at a confidence of a half or less.
        """
        found, letters = self.costs(text) if text else ({}, 0)
        return (*winner(found), letters)


def winner(costs: Mapping[str, float]) -> tuple[str | None, float]:
    """The language of least cost and its share of exp(-cost)."""
    if not costs:
        return None, 0.0
    least, code = min((c, k) for k, c in costs.items())
    return code, 1.0 / sum(math.exp(least - c) for c in costs.values())


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", languages: Sequence[str] = LANGUAGES) -> Model:
    """A model of labelled documents.

    For each language, the ``SAMPLE_DOCUMENTS`` documents with the least hash among
    those whose label names it come to the driver, ``SAMPLE_LETTERS`` letters of
    each from a place the hash of its id gives: a bounded sample that does not
    depend on order or size. Labels may be wrong: each half of the sample judges
    the other, and documents it gives another language are left out. Null, blank
    and very short texts are not drawn. languages: codes; a label names one by its
    code, or by one of ``NAMES``.
    """
    known = {name: code for name, code in _BY_NAME.items() if code in languages} | {code: code for code in languages}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    low = F.lower(F.trim(label))
    code = F.coalesce(F.try_element_at(names, low), F.try_element_at(names, F.regexp_extract(low, "^([a-z]{2,3})[-_]", 1)))
    room = F.greatest(F.length(text) - 4 * SAMPLE_LETTERS, F.lit(0)) + 1
    span = F.col(text).substr((F.pmod(F.xxhash64(doc_id, F.lit("place")), room) + 1).cast("int"), F.lit(4 * SAMPLE_LETTERS))
    usable = documents.select(F.col(doc_id).alias("d"), code.alias("code"), span.alias("t")).where(F.col("code").isNotNull() & (F.length(F.trim("t")) >= LEAST_LETTERS))
    counts = {r.code: r["count"] for r in usable.groupBy("code").count().collect()}
    if not counts:
        return fit_texts([], languages)
    # Four times the documents wanted lie below the threshold on average, whatever the number of rows or tasks.
    share = F.element_at(F.create_map(*[F.lit(x) for c, n in sorted(counts.items()) for x in (c, min(1.0, 4.0 * SAMPLE_DOCUMENTS / n))]), F.col("code"))
    few = usable.where(below_share(share, "d")).select("code", "t", F.xxhash64("d").alias("h"), "d").collect()
    drawn: list[tuple[str, str]] = []
    for c in languages:
        rows = sorted((r for r in few if r.code == c), key=lambda r: (r.h, str(r.d), r.t))[:SAMPLE_DOCUMENTS]
        drawn += [(c, normal_text(r.t)[:SAMPLE_LETTERS]) for r in rows]
    return fit_texts(drawn, languages)


def fit_texts(labelled: list[tuple[str, str]], languages: Sequence[str] = LANGUAGES) -> Model:
    """A model of (language, normalised text) pairs, some of them wrong. Repeated texts count once, or not at all under two languages."""
    named: dict[str, set[str]] = {}
    for c, t in labelled:
        named.setdefault(t, set()).add(c)
    labelled = [(next(iter(cs)), t) for t, cs in named.items() if len(cs) == 1]

    def model(rows: list[tuple[str, str]]) -> Model:
        return Model({c: " ".join(t for k, t in rows if k == c)[:LANGUAGE_LETTERS] for c in languages})

    halves = labelled[::2], labelled[1::2]
    kept: list[tuple[str, str]] = []
    for own, other in (halves, halves[::-1]):
        judge = model(other)
        if len(judge.texts) < 2:
            kept += own
            continue
        kept += [pair for pair, (found, *_) in zip(own, judge_texts(judge, [[t] for _, t in own]), strict=True) if found == pair[0]]
    return model(kept)


#: language, confidence, whole and segments
Judgement = tuple[str | None, float, bool, list[dict]]


def judge_texts(model: Model, texts: Sequence[Sequence[str | None]]) -> list[Judgement]:
    """The judgement of each text, given as its parts (utterances, sentences); texts go through the automata in blocks."""
    parts, owner = [], []
    for i, own in enumerate(texts):
        parts += own
        owner += [i] * len(own)
    plain = normal_texts(parts)
    out: list[Judgement] = [(None, 0.0, False, [])] * len(texts)
    block: list[str] = []
    owners: list[int] = []
    size = 0
    for i, t in zip(owner, plain, strict=True):
        if size > STEP_LETTERS and i != owners[-1]:
            _judge_block(model, block, owners, out)
            block, owners, size = [], [], 0
        if t:
            block.append(t)
            owners.append(i)
            size += len(t)
    _judge_block(model, block, owners, out)
    return out


def _judge_block(model: Model, block: list[str], owners: list[int], out: list[Judgement]) -> None:
    k = len(model.texts)
    if not block or not k:
        return
    points = np.frombuffer(" ".join(block).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in block])
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = model.ends(points, starts, lengths)
    running = np.zeros((k, len(points) + 1), dtype=np.int64)
    np.cumsum(ends, axis=1, out=running[:, 1:])
    letter = points != 32
    spoken = np.concatenate(([0], np.cumsum(letter)))
    # One row a part, and the sums of the parts of each text.
    who, first_part = np.unique(np.array(owners), return_index=True)
    part_costs = ((running[:, starts + lengths] - running[:, starts]) * model.weights[:, None]).T
    text_costs = np.add.reduceat(part_costs, first_part, axis=0)
    shares = _shares(part_costs)
    part_best, part_sure = part_costs.argmin(axis=1), shares.max(axis=1) >= LEAST_CONFIDENCE
    text_shares = _shares(text_costs)
    text_best = text_costs.argmin(axis=1)
    # Words: what stands between blanks; every Han letter is one.
    han = (points >= 0x3400) & (points < 0xA000)
    before = np.concatenate(([True], ~letter[:-1] | han[:-1]))
    words = np.flatnonzero(letter & (before | han))
    edges = np.append(words, len(points))
    word_costs = ((running[:, edges[1:]] - running[:, edges[:-1]]) * model.weights[:, None]).T
    word_letters = spoken[edges[1:]] - spoken[edges[:-1]]
    first_word = np.searchsorted(words, starts[first_part])
    path = _cheapest_paths(word_costs, first_word, text_costs)
    # Runs of one language inside a text.
    new = np.zeros(len(words), dtype=bool)
    new[first_word] = True
    new[1:] |= path[1:] != path[:-1]
    run = np.flatnonzero(new)
    run_costs, run_letters = np.add.reduceat(word_costs, run, axis=0), np.add.reduceat(word_letters, run).tolist()
    run_language = path[run].tolist()
    run_share = _shares(run_costs)[np.arange(len(run)), path[run]].tolist()
    run_from = np.append(np.searchsorted(run, first_word), len(run)).tolist()
    odd_part = part_sure & (part_best != np.repeat(text_best, np.diff(np.append(first_part, len(block)))))
    odd = np.add.reduceat(odd_part.astype(np.int64), first_part).tolist()
    best_list, share_list = text_best.tolist(), text_shares[np.arange(len(who)), text_best].tolist()
    for j, i in enumerate(who.tolist()):
        span = range(run_from[j], run_from[j + 1])
        segments = [{"language": model.languages[run_language[r]], "confidence": run_share[r], "letters": run_letters[r]} for r in span]
        if len(segments) == 1 and run_language[span[0]] == best_list[j]:
            out[i] = model.languages[best_list[j]], share_list[j], not odd[j] and share_list[j] >= LEAST_CONFIDENCE, segments
            continue
        per: dict[str, int] = {}
        for s in segments:
            per[s["language"]] = per.get(s["language"], 0) + s["letters"]
        best = max(sorted(per), key=lambda x: per[x])
        out[i] = best, per[best] / sum(per.values()), False, segments


def _shares(costs: np.ndarray) -> np.ndarray:
    e = np.exp(costs.min(axis=1, keepdims=True) - costs)
    return e / e.sum(axis=1, keepdims=True)


def _cheapest_paths(costs: np.ndarray, first: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The language of each word on the cheapest path through its text, a change costing ``CHANGE``.

    costs: words by languages; first: the first word of each text; whole: each
    text's cost in one language. Texts whose words, each in its best language, and
    one change cost no less than one language for all keep that one.
    """
    count = np.diff(np.append(first, len(costs)))
    path = np.repeat(whole.argmin(axis=1), count)
    least = np.add.reduceat(costs.min(axis=1), first) if len(first) else np.zeros(0)
    open_ = np.flatnonzero(least + CHANGE < whole.min(axis=1))
    if not len(open_):
        return path
    open_ = open_[np.argsort(-count[open_], kind="stable")]
    first, count = first[open_], count[open_]
    live = (len(count) - np.searchsorted(count[::-1], np.arange(count[0]), side="right")).tolist()
    total = costs[first].copy()
    came, change = [], []
    for w, n in enumerate(live[1:], 1):
        best = total[:n].argmin(axis=1)
        least = total[np.arange(n), best] + CHANGE
        moved = least[:, None] < total[:n]
        total[:n] = np.where(moved, least[:, None], total[:n]) + costs[first[:n] + w]
        came.append(best)
        change.append(moved)
    state = np.zeros(len(first), dtype=np.int64)
    below = 0
    for w in reversed(range(len(live))):
        n = live[w]
        state[below:n] = total[below:n].argmin(axis=1)
        below = n
        path[first[:n] + w] = state[:n]
        if w:
            moved = change[w - 1][np.arange(n), state[:n]]
            state[:n] = np.where(moved, came[w - 1], state[:n])
    return path


def turn_languages(turns: DataFrame, model: Model, text: str = "utterances") -> DataFrame:
    """The turns with ``language``, ``confidence``, ``whole`` and ``segments``.

    text: array of the turn's utterances. segments: the runs of words of one
    language on the cheapest path (``CHANGE``), with their letters and confidence;
    a change may lie inside an utterance. language: the one with most letters.
    whole: there is one segment, every utterance of ``LEAST_CONFIDENCE`` is in its
    language, and its own confidence suffices. Null or empty arrays and texts
    without letters: language null, confidence 0, not whole. Row-wise, without a
    shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _with_judgements(batch, judge_texts(model, [[] if u is None else list(u) for u in batch[text]]))

    schema = turns.schema.simpleString()[len("struct<") : -1]
    return turns.mapInPandas(run, f"{schema},{_JUDGED}")


_JUDGED = "language string, confidence double, whole boolean, segments array<struct<language:string,confidence:double,letters:bigint>>"


def _with_judgements(batch: pd.DataFrame, found: list[Judgement]) -> pd.DataFrame:
    for i, name in enumerate(("language", "confidence", "whole", "segments")):
        batch[name] = [f[i] for f in found]
    return batch


def document_languages(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """doc_id, the label and the language it names, and language, confidence, whole and segments of every document.

    As ``turn_languages``, of the whole text; its lines and sentences are the parts.
    Null, empty and blank texts have no language. One row per row, without a shuffle.
    """
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [[] if t is None else _PARTS.split(t) for t in batch.pop("t")]
            batch["named"] = [named_language(x) for x in batch["label"]]
            yield _with_judgements(batch, judge_texts(model, parts))

    narrow = documents.select(doc_id, F.col(label).alias("label"), F.col(text).alias("t"))
    return narrow.mapInPandas(run, f"`{doc_id}` {kinds[doc_id]}, label string, named string, {_JUDGED}")


def judge_turn(model: Model, utterances: list[str | None]) -> Judgement:
    """language, confidence, whole and segments of one turn; its costs are the sums over its utterances."""
    return judge_texts(model, [utterances])[0]
