"""Token ids of texts by a public byte-level tokenizer.

Method: the tokenizer's pattern cuts a text into words; within a word, pairs of
neighbouring tokens are merged in order of rank. A segment tree over the word's
byte positions holds the leftmost position of the least pair rank; a merge
changes at most three positions of live neighbours, each in logarithmic time, so
a word of n bytes costs n log n however long it is.

The vocabulary is a file outside this repository and its path a parameter. It is
read once on the driver and sent to the workers; its size is bounded by
``MAX_VOCABULARY_BYTES``.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_VOCABULARY_BYTES = 64 * 2**20
#: Words whose ids a worker remembers, and the longest such word in bytes.
REMEMBERED_WORDS, REMEMBERED_BYTES = 100_000, 64

NEVER = 2**31 - 1


def default_folder() -> str:
    """Where the public vocabulary files are: the installed package's folder."""
    import public_tokenizers

    return str(Path(public_tokenizers.__file__).parent)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 text and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class MergeTree:
    """Least pair rank and its leftmost position over the positions of one word."""

    def __init__(self, ranks: list[int]) -> None:
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        self.least = [NEVER] * size + ranks + [NEVER] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            a, b = self.least[2 * i], self.least[2 * i + 1]
            self.least[i] = a if a <= b else b

    def update(self, position: int, rank: int) -> None:
        least = self.least
        i = position + self.size
        least[i] = rank
        i >>= 1
        while i:
            a, b = least[2 * i], least[2 * i + 1]
            m = a if a <= b else b
            if least[i] == m:
                break
            least[i] = m
            i >>= 1

    def leftmost(self) -> int:
        """The leftmost position of the least rank, or -1 if no pair can be merged."""
        least = self.least
        m = least[1]
        if m == NEVER:
            return -1
        i = 1
        while i < self.size:
            i *= 2
            if least[i] != m:
                i += 1
        return i - self.size


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    n = len(word)
    if n < 2:
        return [ranks[word]] if n else []
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n - 1))  # start of the token before it
    tree = MergeTree([ranks.get(word[i : i + 2], NEVER) for i in range(n - 1)] + [NEVER])
    while (i := tree.leftmost()) >= 0:
        j = end[i]
        end[i] = end[j]
        after = end[i]
        tree.update(j, NEVER)
        if after < n:
            before[after] = i
            tree.update(i, ranks.get(word[i : end[after]], NEVER))
        else:
            tree.update(i, NEVER)
        p = before[i]
        if p >= 0:
            tree.update(p, ranks.get(word[p:after], NEVER))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if len(missing := [b for b in range(256) if bytes([b]) not in ranks]):
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks, self.words = ranks, regex.compile(pattern)
        self.seen: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; the strings of special tokens are ordinary text. Null and empty give none."""
        out: list[int] = []
        seen = self.seen
        for word in self.words.findall(text or ""):
            ids = seen.get(word)
            if ids is None:
                raw = word.encode("utf-8", "replace")
                ids = merge_word(raw, self.ranks)
                if len(raw) <= REMEMBERED_BYTES:
                    if len(seen) >= REMEMBERED_WORDS:
                        seen.clear()
                    seen[word] = ids
            out += ids
        return out


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary as it travels: the packed file and the word pattern."""

    packed: bytes
    pattern: str

    @classmethod
    def load(cls, name: str = "byte_bpe_50k.tiktoken", folder: str | None = None, pattern: str | None = None) -> Tokenizer:
        raw = Path(folder or default_folder(), name).read_bytes()
        if len(raw) > MAX_VOCABULARY_BYTES:
            raise ValueError("the vocabulary is too large to send to every worker")
        return cls(zlib.compress(raw), pattern or default_pattern())

    def encoder(self) -> Encoder:
        key = hash(self)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(read_ranks(zlib.decompress(self.packed)), self.pattern)
        return _ENCODERS[key]


_ENCODERS: dict[int, Encoder] = {}


def encode(documents: DataFrame, tokenizer: Tokenizer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every row; an empty list for null and empty texts, also for repeated rows.

    Other columns are not read. Row-wise, without a shuffle; whole texts.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tokenizer)
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for b in batches:
            ids = pa.array([encoder.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[doc_id, "ids"])

    return documents.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, tokenizer: Tokenizer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row; the ids stay in the worker."""
    shared = documents.sparkSession.sparkContext.broadcast(tokenizer)
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for b in batches:
            n = pa.array([len(encoder.encode(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=[doc_id, "n_tokens"])

    return documents.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long")
