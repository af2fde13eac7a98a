"""Text functions as columns; all of them stay in the JVM but ``mattr`` and ``mtld``, which fold with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Language names and codes brought to one code. Fixed values.
LANGUAGE_ALIASES = {"english": "en", "eng": "en", "spanish": "es", "spa": "es", "mandarin": "zh", "chinese": "zh", "zho": "zh", "cmn": "zh", "german": "de", "deu": "de", "french": "fr", "fra": "fr"}

#: Fillers, pronouns and function words by language. Fixed values.
FILLERS = {"en": ("uh", "um", "er", "erm", "hmm", "uhm"), "es": ("eh", "em", "ehm", "este"), "de": ("äh", "ähm", "hm", "öhm"), "fr": ("euh", "heu", "hum", "hem")}
PRONOUNS = {"en": ("i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them"), "es": ("yo", "tú", "él", "ella", "usted", "nosotros", "ellos"), "de": ("ich", "du", "er", "sie", "es", "wir", "ihr"), "fr": ("je", "tu", "il", "elle", "nous", "vous", "ils", "elles")}
#: Articles, prepositions, conjunctions and auxiliaries by language, which with the two above are no content words. Fixed values.
FUNCTION_WORDS = {
    "en": ("a", "an", "and", "are", "at", "be", "but", "by", "for", "from", "had", "has", "have", "in", "is", "of", "on", "or", "so", "that", "the", "then", "this", "to", "was", "were", "with"),
    "es": ("a", "al", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "para", "pero", "por", "que", "se", "sin", "su", "un", "una", "y"),
    "de": ("am", "auf", "aus", "bei", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "oder", "und", "von", "war", "zu", "zum"),
    "fr": ("a", "au", "aux", "avec", "ce", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "ou", "par", "pour", "que", "qui", "sur", "un", "une"),
}

#: Task families by words of the task name, first match wins. Fixed values.
TASK_FAMILIES = (("picture", "picture_description"), ("fluency", "semantic_fluency"), ("recall", "story_recall"), ("interview", "interview"), ("speech", "spontaneous_speech"))


def slug(x: Column) -> Column:
    """Lower-case ASCII letters and digits with single underscores between."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))


def canonical_language(x: Column) -> Column:
    """The base code of a language label: aliases resolved, regions dropped, ``unknown`` for null and blank."""
    base = F.element_at(F.split(F.regexp_replace(F.lower(F.trim(x)), "_", "-"), "-"), 1)
    alias = F.create_map(*[F.lit(v) for kv in LANGUAGE_ALIASES.items() for v in kv])
    return F.when(x.isNull() | (F.trim(x) == ""), "unknown").otherwise(F.coalesce(F.try_element_at(alias, base), base))


def words(x: Column) -> Column:
    """Lower-case words of letters with an inner apostrophe; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+(?:'\p{L}+)?)"), F.lit(1)), F.array().cast("array<string>"))


def type_token_ratio(tokens: Column) -> Column:
    """Distinct over all tokens; null without tokens."""
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens))


def _moving_ttr(tokens: list[str], window: int) -> float | None:
    n = len(tokens)
    if n <= window:
        return len(set(tokens)) / n if n else None
    held: dict[str, int] = {}
    for t in tokens[:window]:
        held[t] = held.get(t, 0) + 1
    total = kinds = len(held)
    for new, old in zip(tokens[window:], tokens, strict=False):
        k = held.get(new, 0)
        held[new] = k + 1
        kinds += k == 0
        k = held[old] - 1
        held[old] = k
        kinds -= k == 0
        total += kinds
    return total / (n - window + 1) / window


def mattr(tokens: Column, window: int = 50) -> Column:
    """Mean type-token ratio of all windows of ``window`` tokens; the plain ratio of shorter texts; null without tokens.

    One step a token in Arrow batches: as an array expression, each window would be
    counted anew.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else _moving_ttr(t.tolist(), window)).astype("float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType())(tokens)


def lexicon_rate(tokens: Column, lexicon: tuple[str, ...], per: float = 100.0) -> Column:
    """Tokens of the lexicon per ``per`` tokens; null without tokens."""
    return F.when(F.size(tokens) > 0, per * F.size(F.filter(tokens, lambda t: t.isin(*lexicon))) / F.size(tokens))


def repeated_tokens(tokens: Column) -> Column:
    """How often a token equals the one before it."""
    n = F.size(tokens)
    return F.when(n > 1, F.size(F.filter(F.arrays_zip(F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"]))).otherwise(0)


def repeated_pairs(tokens: Column) -> Column:
    """How often two tokens equal the two before them."""
    n = F.size(tokens)
    at = F.filter(F.sequence(F.lit(3), n - 1), lambda i: (F.element_at(tokens, i) == F.element_at(tokens, i - 2)) & (F.element_at(tokens, i + 1) == F.element_at(tokens, i - 1)))
    return F.when(n > 3, F.size(at)).otherwise(0)


def occurrences(x: Column, part: str) -> Column:
    """Non-overlapping occurrences of a text in another."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part)))) / len(part)).cast("int")


def _earlier(ids: np.ndarray) -> np.ndarray:
    """Where each token stood last before, -1 for first occurrences."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), -1)
    out[order[1:]] = np.where(ids[order[1:]] == ids[order[:-1]], order[:-1], -1)
    return out


def _factors(ids: np.ndarray, threshold: float) -> float:
    """How many stretches of a text fall to the threshold of different over all tokens; the rest counts by how far it fell.

    A token is new to a stretch if it last stood before the stretch, so the share
    of new tokens of a whole block is one running sum.
    """
    earlier, start, full = _earlier(ids), 0, 0
    width = 128
    while start < len(ids):
        stop = min(len(ids), start + width)
        share = np.cumsum(earlier[start:stop] < start) / np.arange(1, stop - start + 1)
        low = np.flatnonzero(share <= threshold)
        if len(low):
            full, start, width = full + 1, start + int(low[0]) + 1, 128
        elif stop == len(ids):
            return full + (1.0 - float(share[-1])) / (1.0 - threshold)
        else:
            width *= 2
    return float(full)


@F.pandas_udf(DoubleType())
def mtld(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Mean of the forward and backward measure of textual lexical diversity (threshold 0.72): tokens over factors; null under 10 tokens."""

    def both(t: object) -> float | None:
        if t is None or len(t) < 10:
            return None
        known: dict[str, int] = {}
        ids = np.fromiter((known.setdefault(x, len(known)) for x in t), dtype=np.int64, count=len(t))
        found = [_factors(x, 0.72) for x in (ids, ids[::-1])]
        return sum(len(ids) / f if f > 0 else float(len(ids)) for f in found) / 2

    for s in tokens:
        yield s.map(both).astype("float64")


def repair_mojibake(x: Column) -> Column:
    """Text whose UTF-8 bytes were read as Latin-1, read again; kept only if that leaves fewer tell-tale characters."""
    telltale = lambda c: F.length(c) - F.length(F.regexp_replace(c, "[ÃÂâ]", ""))
    latin = F.when(x.rlike(r"^[\x00-\xFF]*$"), x)
    fixed = F.try_validate_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    return F.when((telltale(x) > 0) & fixed.isNotNull() & (telltale(fixed) < telltale(x)), fixed).otherwise(x)


def pseudonym(x: Column, salt: str, length: int = 12) -> Column:
    """The first digits of a salted SHA-256 of an id."""
    return F.substring(F.sha2(F.concat(F.lit(salt + "::"), x), 256), 1, length)


def typed_id(kind: str, x: Column) -> Column:
    """``kind:value``, unless the value already has that kind; null for null and blank."""
    t = F.trim(x)
    return F.when(t == "", None).when(t.startswith(kind + ":"), t).otherwise(F.concat(F.lit(kind + ":"), t))


def composite_identity(**parts: Column) -> Column:
    """``name=value`` parts joined by colons, values escaped so that identities never collide; null is the empty value."""
    return F.concat_ws(":", *[F.concat(F.lit(f"{k}="), F.url_encode(F.coalesce(v.cast("string"), F.lit("")))) for k, v in parts.items()])


def task_family(x: Column) -> Column:
    """The family of a task by the first matching word, else ``other``."""
    low, out = F.lower(F.coalesce(x, F.lit(""))), F.lit("other")
    for word, family in reversed(TASK_FAMILIES):
        out = F.when(low.contains(word), family).otherwise(out)
    return out


def clean_chat(x: Column) -> Column:
    """Transcript text without codes in brackets, ``&`` codes and repeated blanks."""
    bare = F.regexp_replace(F.regexp_replace(x, r"\[[^\]]*\]", " "), r"&[-=+~]?\S*", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def sentences(x: Column) -> Column:
    """Non-blank sentences, split behind . ! ? and their wide forms."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"(?<=[.!?])\s+|(?<=[。！？])"), F.trim), lambda s: s != "")


def redact(x: Column, pattern: str, mark: str = "[redacted]") -> Column:
    """Sentences in which the pattern occurs replaced by the mark; the rest joined as it was."""
    return F.array_join(F.transform(sentences(x), lambda s: F.when(s.rlike(pattern), mark).otherwise(s)), " ")


def rubric(x: Column, words_: tuple[str, ...], most: int = 5) -> Column:
    """How many of the words occur, at most ``most``."""
    low, total = F.lower(F.coalesce(x, F.lit(""))), F.lit(0)
    for w in words_:
        total = total + F.when(low.contains(w), 1).otherwise(0)
    return F.least(F.lit(most), total)


def grams(tokens: Column, parts: int = 3) -> Column:
    """Terms of a text: its words, its neighbouring pairs, and the ``parts`` letters at every place of each word with a blank around it."""
    words = F.transform(tokens, lambda x: F.concat(F.lit("w:"), x))
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(F.lit("w:"), a, F.lit(" "), b))
    inside = F.flatten(F.transform(tokens, lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.lit("c:"), F.substring(F.concat(F.lit(" "), x, F.lit(" ")), i, F.lit(parts))))))
    return F.concat(words, pairs, inside)
