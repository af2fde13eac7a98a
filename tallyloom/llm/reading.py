"""How demanding a document's running prose is, on the raters' scale.

Method: a linear ranker learned from pairs of documents of which raters gave one
a higher band, over syntax and vocabulary features; isotonic regression turns
its scores into levels. The fit uses a bounded sample of labelled documents
(``MAX_LABELLED``); every document is scored on its whole text.

What is running prose is a matter of form in any language (words that stand in
stretches, not alone between marks), and of the vocabulary that raters left
without a band.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import turns
from tallyloom.operators.sequence import below_share
from tallyloom.session import materialise

BANDS = ("basic", "intermediate", "demanding")

#: Labelled documents the fit may use, those of the least hash; vocabulary places; pairs; rounds.
MAX_LABELLED, PLACES, PAIRS, ROUNDS = 3000, 4096, 40_000, 200
#: A text is running prose from this many words of prose on.
LEAST_PROSE_WORDS = 8
#: Texts whose features are computed together.
BLOCK_TEXTS = 1000

#: A stretch of so many words between marks or line ends is running text; a Han character is half a word.
STRETCH_WORDS = 3.0
#: Documents without a band that the vocabulary gate needs, and words a task remembers.
LEAST_UNRATED, REMEMBERED_WORDS = 8, 400_000

SYNTAX = ("log_sentence", "sentence_spread", "word_length", "long_words", "commas", "distinct", "short_words", "log_words", "joined_marks", "han", "questions", "capitals")

_SENTENCE = regex.compile(r"[.!?。！？；;]+(?=\s|$|[\"'”’)]|\p{Han})|[。！？；]+")
#: A word, a mark that ends a stretch, or a break between sentences, texts or lines.
_TOKEN = regex.compile(r"\p{Han}|[^\P{L}\p{Han}][\p{L}\p{M}]*(?:[-'’][\p{L}\p{M}]+)*|[\0,，、;:：|/\t]")
_HEADING = re.compile(r"^\s*(?:#+|={2,})\s")
_ENTRY = re.compile(r"""^\s*(?:[-*]\s+)?["']?[\w.\- ]{1,40}["']?\s*[:=]\s*(?:["'\[{].*|[-\d][\W\d_]*[a-zA-Z%]{0,4}|\S{0,30},?)?$|^\s*[{}\[\],]+\s*$""")


#: Features of a text: syntax, and places and weights of its vocabulary.
Found = tuple[list[float], list[int], list[float]]


def _body(text: str | None) -> str:
    """The lines of a text that may be running prose; empty where there is none."""
    if not text or not text.strip():
        return ""
    body = text.strip()
    if body[0] in "{[" and body[-1] in "}]":
        return ""
    spoken = _transcript(text)
    lines = [s for s in (spoken if spoken is not None else turns.clean_characters(text).splitlines()) if s.strip() and not _HEADING.match(s)]
    if spoken is None:
        lines = [s for s in lines if not _ENTRY.match(s)]
    return "\n".join(lines)


class _Words(dict):
    """Ids of words, and what the features need to know of each; ids 0 and 1 are a sentence's and a stretch's end."""

    def __init__(self) -> None:
        super().__init__({"\0": 0} | dict.fromkeys(",，、;:：|/\t", 1))
        self.names: list[str] = ["", ""]
        self._table = np.zeros((2, 6))

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self.names)
        self.names.append(word)
        return i

    def table(self) -> np.ndarray:
        """A row a word: letters, long, short, with a joining mark, Han, place."""
        new = self.names[len(self._table) :]
        if new:
            rows = [(len(w), len(w) > 9, len(w) <= 3, "-" in w, "㐀" <= w <= "鿿", zlib.crc32(w.encode())) for w in new]
            self._table = np.concatenate((self._table, np.array(rows, dtype=float)))
        return self._table


_words = _Words()


def prose(text: str | None) -> tuple[str, list[list[str]]]:
    """The running prose of a text and the words of its sentences; empty where there is none.

    Headings, settings (key and value lines, JSON, YAML), speaker labels,
    annotations and hesitation sounds are no prose. A text of which fewer than
    ``LEAST_PROSE_WORDS`` words, or less than half, stand in stretches of
    ``STRETCH_WORDS`` has none, as word lists have.
    """
    body = _body(text)
    block = _block([body])
    if block is None or not block.running[0]:
        return "", []
    sentences, names = [], [_words.names[i] for i in block.ids]
    for part in np.split(np.arange(len(names)), np.flatnonzero(block.ids == 0)):
        if words := [names[i] for i in part if block.ids[i] > 1]:
            sentences.append(words)
    return body, sentences


@dataclass
class _Block:
    """The tokens of several texts: their ids, the text each stands in, and whether the texts are running prose."""

    ids: np.ndarray
    owner: np.ndarray
    running: np.ndarray
    sentence: np.ndarray  # the sentence of each token, numbered over the block


def _block(bodies: Sequence[str]) -> _Block | None:
    global _words
    if len(_words.names) > REMEMBERED_WORDS:
        _words = _Words()
    ids = []
    for body in bodies:
        tokens = _TOKEN.findall("\0" + _SENTENCE.sub("\0", body).replace("\n", "\0").lower()) if body else ["\0"]
        ids.append(np.fromiter(map(_words.__getitem__, tokens), dtype=np.int64, count=len(tokens)))
    if not ids:
        return None
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    flat = np.concatenate(ids)
    table = _words.table()
    word = flat > 1
    weight = np.where(word, 1.0 - 0.5 * table[flat, 4], 0.0)
    stretch = np.cumsum(~word)
    long = np.bincount(stretch, weight)[stretch] >= STRETCH_WORDS
    n = len(ids)
    words, running = np.bincount(owner, word, n), np.bincount(owner, word & long, n)
    return _Block(flat, owner, (running >= LEAST_PROSE_WORDS) & (2 * running >= words), np.cumsum(flat == 0))


def _transcript(text: str) -> list[str] | None:
    """What is said in a transcript, with its punctuation; None if the text is no transcript."""
    # Every layout sets labels off by one of these marks, and a transcript has two labels.
    if "@Begin" not in text and sum(text.count(c) for c in (":", "：", ">", "＞", " -", " –", " —")) < 2:
        return None
    t = turns.read(text)
    labelled = [u for u in t.utterances if u.label is not None]
    if len(labelled) < 2 or len(labelled) * 2 < len(t.utterances):
        return None
    out = []
    for u in t.utterances:
        said = u.text
        while (less := turns._BRACKETS.sub(" ", said)) != said:
            said = less
        said = turns._CODES.sub(" ", said)
        out.append(" ".join(w for w in said.split() if not _hesitates(w)))
    return out


@lru_cache(maxsize=200_000)
def _hesitates(token: str) -> bool:
    """Whether a token and the marks around it are a hesitation sound."""
    return turns.is_hesitation(token.strip(",.;:!?-…，。").lower())


def features(text: str | None) -> Found | None:
    """Syntax features, and places and weights of the vocabulary; None without running prose.

    Vocabulary: the square roots of the shares of words (in Chinese, of neighbouring
    pairs of characters), hashed to ``PLACES`` places, scaled to length 1.
    """
    rows, syntax, start, places, values = many_features([text])
    return (syntax[0].tolist(), places.tolist(), values.tolist()) if len(rows) else None


def many_features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The features of several texts at once: which of them hold running prose, a row of syntax each, where their vocabulary starts, and its places and weights."""
    bodies = [_body(t) for t in texts]
    block = _block(bodies)
    if block is None or not block.running.any():
        return np.zeros(0, dtype=int), np.zeros((0, len(SYNTAX))), np.zeros(1, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
    rows = np.flatnonzero(block.running)
    rank = np.cumsum(block.running) - 1
    kept = block.running[block.owner] & (block.ids > 1)
    ids, owner, sentence = block.ids[kept], rank[block.owner[kept]], block.sentence[kept]
    table, n = _words.table()[ids], len(rows)
    words = np.bincount(owner, minlength=n).astype(float)
    letters, long, short, joined, han = (np.bincount(owner, table[:, i], n) for i in range(5))
    # Sentences: their number, and the first two moments of their lengths.
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    lengths, of = np.diff(np.append(first, len(sentence))).astype(float), owner[first]
    sentences = np.bincount(of, minlength=n)
    mean = np.bincount(of, lengths, n) / sentences
    spread = np.sqrt(np.maximum(np.bincount(of, lengths**2, n) / sentences - mean**2, 0.0))
    distinct = np.bincount(np.unique(owner << 32 | ids) >> 32, minlength=n)
    marks = [[sum(bodies[i].count(c) for c in some) for i in rows] for some in (",，、", "?？")]
    capitals = np.array([_capitals(bodies[i]) for i in rows], dtype=float)
    syntax = np.stack(
        [
            np.log1p(mean), np.log1p(spread), letters / words, long / words, np.array(marks[0]) / words, distinct / words**0.75, short / words, np.log1p(words),
            joined / words, han / words, np.array(marks[1]) / sentences, capitals / np.maximum(1, letters),
        ], axis=1,
    )
    code = table[:, 5].astype(np.int64)
    is_han = table[:, 4] > 0
    pair = is_han[:-1] & (sentence[1:] == sentence[:-1])
    what = np.concatenate((code[~is_han], code[:-1][pair] * 31 + code[1:][pair])) % PLACES
    whose = np.concatenate((owner[~is_han], owner[:-1][pair]))
    at, counts = np.unique(whose * PLACES + what, return_counts=True)
    whose = at // PLACES
    # Scaled to length 1, the root of a share is the root of a count over that of the sum of counts.
    values = np.sqrt(counts / np.bincount(whose, counts, n)[whose])
    return rows, syntax, np.searchsorted(whose, np.arange(n + 1)), at % PLACES, values


def _capitals(body: str) -> int:
    low = body.lower()
    if len(low) != len(body):
        return sum(c.isupper() for c in body)
    return int(np.count_nonzero(np.frombuffer(body.encode("utf-32-le"), np.uint32) != np.frombuffer(low.encode("utf-32-le"), np.uint32)))


@dataclass(frozen=True)
class Scale:
    """The fitted ranker and its calibration."""

    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    #: Log odds of the vocabulary in rated prose, and the least sum of a text that is prose; none where too few texts without a band are known.
    odds: np.ndarray | None = None
    least: float = 0.0

    def scores(self, syntax: np.ndarray, start: np.ndarray, places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores of texts as ``many_features`` gives them, and whether their vocabulary is that of prose."""
        k, n = len(SYNTAX), len(syntax)
        script = (syntax[:, SYNTAX.index("han")] > 0.5).astype(int)
        own = np.stack([self.weights[:k], self.weights[k : 2 * k]])[script]
        whose = np.repeat(np.arange(n), np.diff(start))
        score = (((syntax - self.mean[script]) / self.spread[script]) * own).sum(axis=1) + np.bincount(whose, values * self.weights[2 * k + places], n)
        return score, np.ones(n, dtype=bool) if self.odds is None else np.bincount(whose, values * self.odds[places], n) >= self.least

    def score(self, found: Found) -> float:
        syntax, places, values = found
        k, script = len(SYNTAX), _script(syntax)
        at = slice(script * k, script * k + k)
        return float(((np.array(syntax) - self.mean[script]) / self.spread[script]) @ self.weights[at] + np.array(values) @ self.weights[2 * k + np.array(places, dtype=int)])

    def level(self, score: float) -> float:
        """0 basic, 1 intermediate, 2 demanding, by interpolation between the knots."""
        return float(np.interp(score, self.knots, self.levels))


def _script(syntax: Sequence[float]) -> int:
    """1 for mostly Chinese characters: sentence and word lengths mean something else there, so they get weights of their own."""
    return int(syntax[SYNTAX.index("han")] > 0.5)


def band_of(level: float) -> str:
    return BANDS[0 if level < 0.5 else 1 if level < 1.5 else 2]


def _rank(x: np.ndarray, y: np.ndarray, seed: int = 5, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the ranker: logistic loss over pairs of different bands, by accelerated gradient steps."""
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1], dtype=np.float32)
    by = [np.flatnonzero(y == b) for b in range(len(BANDS))]
    pairs = [(hi, lo) for hi in range(3) for lo in range(hi) if len(by[hi]) and len(by[lo])]
    if not pairs:
        return w
    each = PAIRS // len(pairs)
    up = np.concatenate([rng.choice(by[h], each) for h, _ in pairs])
    down = np.concatenate([rng.choice(by[lo], each) for _, lo in pairs])
    step, momentum = 2.0, np.zeros_like(w)
    for _ in range(ROUNDS):
        s = x @ (w + np.float32(0.9) * momentum)
        p = 1.0 / (1.0 + np.exp(np.clip(s[up] - s[down], -30, 30)))
        g = ((np.bincount(down, p, len(y)) - np.bincount(up, p, len(y))) / len(up)).astype(np.float32)
        momentum = np.float32(0.9) * momentum - np.float32(step) * (x.T @ g + np.float32(ridge) * w)
        w = w + momentum
    return w


def isotonic(scores: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators: knots and their levels."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first and last score
    for s, v in zip(scores[order], values[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, _, last = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += n
            blocks[-1][3] = last
    knots, levels = [], []
    for total, n, first, last in blocks:
        knots += [first, last] if last > first else [first]
        levels += [total / n] * (2 if last > first else 1)
    return np.array(knots), np.array(levels)


def vocabulary_gate(prose_: Sequence[Found], other: Sequence[Found]) -> tuple[np.ndarray | None, float]:
    """Log odds of the places in prose, and the sum from which on a text is prose: the cut with the fewest errors, of equal ones the lowest."""
    if len(other) < LEAST_UNRATED or not prose_:
        return None, 0.0
    means = []
    for some in (prose_, other):
        total = np.zeros(PLACES)
        for _, places, values in some:
            total[np.array(places, dtype=int)] += values
        means.append(total / len(some) + 0.01)
    odds = np.log(means[0] / means[1])
    sums = [np.array([np.array(v) @ odds[np.array(p, dtype=int)] for _, p, v in some]) for some in (prose_, other)]
    cuts = np.sort(np.concatenate([[-np.inf], *sums]))
    cuts[1:-1] = (cuts[1:-1] + cuts[2:]) / 2
    wrong = np.searchsorted(np.sort(sums[0]), cuts) + len(other) - np.searchsorted(np.sort(sums[1]), cuts)
    return odds, float(cuts[int(wrong.argmin())])


def fit_rows(found: Sequence[Found], bands: Sequence[int], folds: int = 4, unrated: Sequence[Found] = ()) -> Scale:
    """A scale from features and bands (0, 1, 2), and the features of texts that raters left without a band.

    The calibration sees scores of documents left out of their fit.
    """
    k, y = len(SYNTAX), np.asarray(bands)
    syntax = np.array([f[0] for f in found], dtype=float).reshape(len(y), k)
    script = np.array([_script(f[0]) for f in found], dtype=int)
    mean, spread = np.zeros((2, k)), np.ones((2, k))
    x = np.zeros((len(y), 2 * k + PLACES), dtype=np.float32)
    for c in (0, 1):
        own = script == c
        if own.any():
            mean[c], spread[c] = syntax[own].mean(axis=0), syntax[own].std(axis=0) + 1e-6
            x[own, c * k : c * k + k] = 0.1 * (syntax[own] - mean[c]) / spread[c]
    for i, (_, places, values) in enumerate(found):
        x[i, 2 * k + np.array(places, dtype=int)] = values
    # Rare words get a larger step than their few documents alone would give.
    rare = np.ones(2 * k + PLACES, dtype=np.float32)
    rare[2 * k :] = 0.1 / np.sqrt(np.sqrt((x[:, 2 * k :] ** 2).mean(axis=0)) + 1e-3)
    x *= rare
    weights = _rank(x, y)
    out = np.zeros(len(y))
    for fold in range(folds):
        held = np.arange(len(y)) % folds == fold
        out[held] = x[held] @ _rank(x[~held], y[~held])
    knots, levels = isotonic(out, y.astype(float))
    scaled = (weights * rare).astype(np.float64)
    scaled[: 2 * k] *= 0.1
    return Scale(scaled, mean, spread, knots, levels, *vocabulary_gate(found, unrated))


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", band: str = "band") -> Scale:
    """A scale from rated documents.

    A document's band is the one most of its ratings give, of equally frequent
    ones the middle; unknown bands do not count. Documents with ratings of which
    none gives a band show what has none. At most ``MAX_LABELLED`` documents come
    to the driver, those with the least hash, as features and not as texts.
    """
    known = labels.where(F.col(band).isNull() | F.col(band).isin(*BANDS)).select(doc_id, F.array_position(F.array(*map(F.lit, BANDS)), F.col(band)).cast("int").alias("b"))
    per = known.groupBy(doc_id, "b").count().groupBy(doc_id).agg(F.coalesce(F.max_by("b", F.when(F.col("b").isNotNull(), F.struct("count", -F.abs(F.col("b") - 2)))), F.lit(0)).alias("b"))
    # A threshold first, so that no task offers more rows than the sample needs.
    per = materialise(per, "reading-bands")
    drawn = per.where(below_share(F.lit(min(1.0, 2.0 * MAX_LABELLED / max(1, per.count()))), doc_id)).orderBy(F.xxhash64(doc_id), doc_id).limit(MAX_LABELLED)
    texts = documents.select(doc_id, text).join(F.broadcast(drawn), doc_id).select(text, "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, syntax, start, places, values = many_features(batch[text].tolist())
            spans = [slice(a, b) for a, b in zip(start[:-1], start[1:], strict=True)]
            yield pd.DataFrame({"syntax": list(syntax), "places": [places[x] for x in spans], "weights": [values[x] for x in spans], "b": batch["b"].to_numpy()[rows]})

    rows = texts.mapInPandas(run, "syntax array<double>, places array<int>, weights array<double>, b int").collect()
    rows.sort(key=lambda r: (r.b, r.syntax, r.places))
    rated = [r for r in rows if r.b]
    if not rated:
        raise ValueError("no rated document has running prose")
    found = {kind: [(r.syntax, r.places, r["weights"]) for r in rows if bool(r.b) == kind] for kind in (True, False)}
    order = np.random.default_rng(1).permutation(len(rated))
    return fit_rows([found[True][i] for i in order], [rated[i].b - 1 for i in order], unrated=found[False])


def read_levels(documents: DataFrame, scale: Scale, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, level (0 to 2) and band of every document; all null where it holds no running prose.

    Null, empty and blank texts, word lists and settings have no band. Equal texts
    get equal levels. Row-wise, without a shuffle.
    """
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # In blocks, so that the tokens of very long texts are not all held at once.
            for at in range(0, len(batch), BLOCK_TEXTS):
                part = batch.iloc[at : at + BLOCK_TEXTS]
                rows, *found = many_features(part[text].tolist())
                score, is_prose = scale.scores(*found)
                rows, score = rows[is_prose], score[is_prose]
                level = np.interp(score, scale.knots, scale.levels)
                out = pd.DataFrame({doc_id: part[doc_id].to_numpy(), "score": np.nan, "level": np.nan, "band": None})
                out["band"] = out["band"].astype(object)
                out.loc[rows, "score"], out.loc[rows, "level"] = score, level
                out.loc[rows, "band"] = [band_of(x) for x in level.tolist()]
                yield out

    spread = documents.select(doc_id, text).mapInPandas(run, f"`{doc_id}` {kind}, score double, level double, band string")
    return spread.select(doc_id, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("score", "level")], "band")
