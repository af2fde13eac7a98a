"""Percentiles per group from mergeable sketches with bounded error.

Method: dyadic Count-sketches. A value is encoded as an unsigned integer in
order of value; for each binary resolution of that integer a signed Count-sketch
counts the prefixes. Sketches are linear, so those of separate partitions, files
or days merge by addition and rows can be deleted by adding them with weight -1.
A rank is a sum of at most one prefix count per resolution; a quantile is found
by descending the resolutions.

The coarsest resolutions are exact counts. The error of a rank is bounded from
the sketch itself: three standard deviations, from the second moment of each
level's counters over the width. Groups with few different values stay plain
codes and have no error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """Only sketches of one shape merge. bits: of the encoding, at most 64; exact: leading bits counted exactly."""

    bits: int = 32
    exact: int = 12
    width: int = 512
    depth: int = 5
    seed: int = 20240229

    def __post_init__(self) -> None:
        if not (0 < self.exact < self.bits <= 64 and self.width & (self.width - 1) == 0 and self.depth % 2):
            raise ValueError("bits, exact, width or depth don't fit")

    @property
    def levels(self) -> range:
        """Hashed levels: level l counts codes without their last l bits."""
        return range(self.bits - self.exact)


DEFAULT = Shape()

#: Values a task holds before it folds them, groups it holds sketches of before it hands them on, and rows of an outgoing batch.
BUFFER_VALUES, BUFFER_GROUPS, BATCH_ROWS = 2_000_000, 256, 2048
#: A group with at most this many different codes in a fold travels as plain codes, which take less room than a sketch of them.
PLAIN_CODES = 1024
#: Levels of the rows that hold plain codes and the exact counts.
PLAIN, EXACT = -2, -1


def encode(values: np.ndarray, bits: int = 32) -> np.ndarray:
    """The leading bits of doubles as unsigned integers in order of value. -0.0 is 0.0."""
    raw = (np.asarray(values, dtype=np.float64) + 0.0).view(np.uint64)
    negative = (raw >> np.uint64(63)).astype(bool)
    ordered = np.where(negative, ~raw, raw | np.uint64(1 << 63))
    return ordered >> np.uint64(64 - bits)


def decode(codes: np.ndarray, bits: int = 32) -> np.ndarray:
    """The value nearest to zero of each code's cell."""
    full = np.asarray(codes, dtype=np.uint64) << np.uint64(64 - bits)
    positive = (full >> np.uint64(63)).astype(bool)
    low_ones = np.uint64((1 << (64 - bits)) - 1)
    raw = np.where(positive, full & np.uint64((1 << 63) - 1), ~(full | low_ones))
    return raw.view(np.float64)


@lru_cache(maxsize=8)
def _hashes(shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets by level and row, for places and for signs."""
    rng = np.random.default_rng(shape.seed)
    size = (len(shape.levels), shape.depth, 2)
    return rng.integers(1, 2**63, size=size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, size=size, dtype=np.uint64)


def _mixed(prefixes: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, so that multiply-shift sees well-spread bits."""
    with np.errstate(over="ignore"):
        x = prefixes.copy()
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _places(mixed: np.ndarray, level: int, row: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    mul, add = _hashes(shape)
    shift = np.uint64(64 - shape.width.bit_length() + 1)
    with np.errstate(over="ignore"):
        place = (mixed * mul[level, row, 0] + add[level, row, 0]) >> shift
        sign = ((mixed * mul[level, row, 1] + add[level, row, 1]) >> np.uint64(63)).astype(np.int64) * 2 - 1
    return place.astype(np.int64), sign


class Sketch:
    """The counters of one group. ``count`` is the number of values, deletions taken off."""

    def __init__(self, shape: Shape = DEFAULT) -> None:
        self.shape, self.count = shape, 0
        self.exact = np.zeros(1 << shape.exact, dtype=np.int64)
        self.hashed = np.zeros((len(shape.levels), shape.depth, shape.width), dtype=np.int64)

    def add(self, codes: np.ndarray, weights: np.ndarray | None = None) -> None:
        """Count codes, with weights where given (negative weights delete)."""
        codes, inverse = np.unique(codes, return_inverse=True)
        w = np.bincount(inverse, weights=weights, minlength=len(codes)).astype(np.int64)
        self.count += int(w.sum())
        for level in self.shape.levels:
            if level:
                prefixes = codes >> np.uint64(1)
                starts = np.flatnonzero(np.concatenate(([True], prefixes[1:] != prefixes[:-1]))) if len(prefixes) else np.zeros(0, dtype=np.int64)
                w, codes = (np.add.reduceat(w, starts), prefixes[starts]) if len(starts) else (w, prefixes)
            mixed = _mixed(codes)
            for row in range(self.shape.depth):
                place, sign = _places(mixed, level, row, self.shape)
                self.hashed[level, row] += np.bincount(place, weights=sign * w, minlength=self.shape.width).astype(np.int64)
        top = (codes >> np.uint64(1)).astype(np.int64)
        self.exact += np.bincount(top, weights=w, minlength=len(self.exact)).astype(np.int64)

    def estimate(self, prefix: int, level: int) -> float:
        """The count of a prefix at a level: the median over the rows."""
        if level == len(self.shape.levels):
            return float(self.exact[prefix])
        mixed = _mixed(np.array([prefix], dtype=np.uint64))
        found = []
        for row in range(self.shape.depth):
            place, sign = _places(mixed, level, row, self.shape)
            found.append(int(sign[0]) * int(self.hashed[level, row, place[0]]))
        return float(np.median(found))

    def rank(self, code: int) -> float:
        """About how many values have a smaller code."""
        if code >= 1 << self.shape.bits:
            return float(self.count)
        top = code >> len(self.shape.levels)
        below = float(self.exact[:top].sum())
        for level in self.shape.levels:
            prefix = code >> level
            if prefix & 1:
                below += max(0.0, self.estimate(prefix ^ 1, level))
        return min(max(below, 0.0), float(self.count))

    def rank_error(self) -> float:
        """The tail guarantee of Count-sketches: a bound of the error of ``rank`` where no prefix meets the largest counters; ``sure_error`` is the one reported."""
        keep = self.shape.width // 8
        total = 0.0
        for level in self.shape.levels:
            squares = np.sort(self.hashed[level].astype(np.float64) ** 2, axis=1)
            total += float(np.median(squares[:, : self.shape.width - keep].sum(axis=1)))
        return 3.0 * float(np.sqrt(total / self.shape.width))

    def sure_error(self) -> float:
        """A bound of the error of ``rank`` that counts collisions with heavy values too: three standard deviations, from all counters of the worst row of each level."""
        total = sum(float((self.hashed[level].astype(np.float64) ** 2).sum(axis=1).max()) for level in self.shape.levels)
        return min(3.0 * float(np.sqrt(total / self.shape.width)), float(max(self.count, 0)))

    def rank_between(self, code: int) -> tuple[float, float]:
        """Least and most values with a smaller code: by ``sure_error``, and never beyond what the exact counts of the leading bits leave."""
        if code >= 1 << self.shape.bits:
            return float(self.count), float(self.count)
        top = code >> len(self.shape.levels)
        floor, rank, e = float(self.exact[:top].sum()), self.rank(code), self.sure_error()
        return max(floor, rank - e), min(floor + float(self.exact[top]), rank + e)

    def quantile(self, q: float) -> float | None:
        """A value whose rank is about ``q`` of the count; None of an empty sketch."""
        if self.count <= 0:
            return None
        target = min(max(q, 0.0), 1.0) * (self.count - 1)
        running = np.cumsum(self.exact)
        code = int(np.searchsorted(running, target, side="right"))
        code = min(code, len(self.exact) - 1)
        inside = float(self.exact[code])
        target -= float(running[code]) - inside
        for level in reversed(self.shape.levels):
            left = min(max(self.estimate(code << 1, level), 0.0), inside)
            right = min(max(self.estimate((code << 1) | 1, level), 0.0), inside)
            # The two halves are scaled to what their parent holds.
            left = inside * left / (left + right) if left + right > 0 else inside / 2
            code <<= 1
            if target >= left:
                code, target, inside = code | 1, target - left, inside - left
            else:
                inside = left
        return float(decode(np.array([code], dtype=np.uint64), self.shape.bits)[0])

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """Level and packed counters."""
        yield EXACT, _pack(self.exact)
        for level in self.shape.levels:
            yield level, _pack(self.hashed[level].ravel())

    @classmethod
    def of_parts(cls, parts: Sequence[tuple[int, bytes]], count: int, shape: Shape = DEFAULT) -> Sketch | Codes:
        """What the parts of a group add up to; plain codes alone stay plain."""
        plain = [_unpack_codes(packed) for level, packed in parts if level == PLAIN]
        if len(plain) == len(parts):
            return Codes(shape).add(*map(np.concatenate, zip(*plain, strict=True))) if plain else cls(shape)
        self = cls(shape)
        for codes, weights in plain:
            self.add(codes, weights)
        self.count = count
        for level, packed in parts:
            if level == EXACT:
                self.exact += _unpack(packed)
            elif level >= 0:
                self.hashed[level] += _unpack(packed).reshape(shape.depth, shape.width)
        return self


class Codes:
    """A small group as its different codes and their counts: what a sketch answers, without error."""

    def __init__(self, shape: Shape = DEFAULT) -> None:
        self.shape, self.codes, self.weights = shape, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, codes: np.ndarray, weights: np.ndarray) -> Codes:
        self.codes, at = np.unique(np.concatenate((self.codes, codes)), return_inverse=True)
        self.weights = np.bincount(at, np.concatenate((self.weights, weights)), len(self.codes)).astype(np.int64)
        return self

    @property
    def count(self) -> int:
        return int(self.weights.sum())

    def sketch(self) -> Sketch:
        s = Sketch(self.shape)
        s.add(self.codes, self.weights)
        return s

    def rank(self, code: int) -> float:
        return float(self.weights[: np.searchsorted(self.codes, np.uint64(code))].sum())

    def sure_error(self) -> float:
        return 0.0

    def rank_between(self, code: int) -> tuple[float, float]:
        return self.rank(code), self.rank(code)

    def quantile(self, q: float) -> float | None:
        if self.count <= 0:
            return None
        target = min(max(q, 0.0), 1.0) * (self.count - 1)
        at = int(np.searchsorted(np.cumsum(self.weights), target, side="right"))
        return float(decode(self.codes[min(at, len(self.codes) - 1)][None], self.shape.bits)[0])


def _pack(counters: np.ndarray) -> bytes:
    """Non-zero counters and the gaps between them, each as narrow as it can be, deflated."""
    at = np.flatnonzero(counters)
    kept = counters[at]
    gaps = np.diff(at, prepend=0).astype(np.int32)
    narrow = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not len(kept) or (np.iinfo(t).min <= kept.min() and kept.max() <= np.iinfo(t).max))
    head = np.array([len(counters), len(at), np.dtype(narrow).itemsize], dtype=np.int32).tobytes()
    return zlib.compress(head + (gaps.astype(np.int16) if len(counters) < 2**15 else gaps).tobytes() + kept.astype(narrow).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    size, n, item = np.frombuffer(raw, dtype=np.int32, count=3)
    gap = np.int16 if size < 2**15 else np.int32
    gaps = np.frombuffer(raw, dtype=gap, count=n, offset=12).astype(np.int64)
    kept = np.frombuffer(raw, dtype=f"<i{item}", count=n, offset=12 + int(n) * np.dtype(gap).itemsize)
    out = np.zeros(size, dtype=np.int64)
    out[np.cumsum(gaps)] = kept
    return out


def _pack_codes(codes: np.ndarray, weights: np.ndarray) -> bytes:
    kept = weights != 0
    return _pack(np.concatenate((codes[kept].astype(np.uint64).view(np.int64), weights[kept].astype(np.int64))))


def _unpack_codes(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes, weights = np.split(_unpack(packed), 2)
    return codes.view(np.uint64), weights


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def sketch(rows: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, shape: Shape = DEFAULT) -> DataFrame:
    """Partial sketches of each task and group, as rows of keys, level, n and counters.

    keys: group columns (null is a group). value: numeric; null, NaN and infinite
    values are not counted. weight: a column of whole numbers, -1 to delete a row;
    null counts as 0. Other columns are ignored. No shuffle: what leaves a task is
    its counters and not its rows. ``merge`` adds the parts up.

    A task folds ``BUFFER_VALUES`` values at a time. Of a fold, groups with few
    different codes leave at once as plain codes (``PLAIN_CODES``); the others, which
    number at most ``BUFFER_VALUES / PLAIN_CODES``, are added to sketches, of which
    a task holds ``BUFFER_GROUPS``. So memory does not grow with the groups.
    """
    narrow = rows.select(*keys, F.col(value).cast("double").alias("__v"), (F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))).cast("long").alias("__w"))
    narrow = narrow.where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _outgoing(_folded(batches, keys, shape), keys, narrow_types)

    from pyspark.sql.pandas.types import to_arrow_type

    narrow_types = [to_arrow_type(narrow.schema[k].dataType) for k in keys]
    return narrow.mapInArrow(run, schema=f"{_fields(rows, keys)}, level int, n long, counters binary")


def _groups(waiting: list[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """names, values and weights of each group of the batches."""
    table = pa.Table.from_batches(waiting)
    code, columns = np.zeros(len(table), dtype=np.int64), []
    for k in keys:
        d = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        columns.append(d.dictionary.to_pylist())
        # Renumbered after each key, so that the product of the keys' sizes cannot overflow.
        _, code = np.unique(code * max(1, len(columns[-1])) + np.asarray(d.indices.to_numpy(zero_copy_only=False), dtype=np.int64), return_inverse=True)
        columns[-1] = (columns[-1], np.asarray(d.indices.to_numpy(zero_copy_only=False)))
    values, weights = table.column("__v").to_numpy(), table.column("__w").to_numpy()
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    for at in np.split(order, starts[1:]):
        yield tuple(names[indices[at[0]]] for names, indices in columns), values[at], weights[at]


def _folded(batches: Iterator[pa.RecordBatch], keys: Sequence[str], shape: Shape) -> Iterator[tuple[tuple, int, int, bytes]]:
    held: dict[tuple, Sketch] = {}
    waiting: list[pa.RecordBatch] = []

    def fold() -> Iterator[tuple[tuple, int, int, bytes]]:
        for names, values, weights in _groups(waiting, keys):
            codes, at = np.unique(encode(values, shape.bits), return_inverse=True)
            w = np.bincount(at, weights, len(codes)).astype(np.int64)
            if names in held:
                held[names].add(codes, w)
            elif len(codes) <= PLAIN_CODES:
                yield names, PLAIN, int(w.sum()), _pack_codes(codes, w)
            else:
                if len(held) >= BUFFER_GROUPS:
                    oldest = next(iter(held))
                    yield from _sketch_rows(oldest, held.pop(oldest))
                held[names] = Sketch(shape)
                held[names].add(codes, w)

    size = 0
    for b in batches:
        waiting.append(b)
        size += len(b)
        if size >= BUFFER_VALUES:
            yield from fold()
            waiting.clear()
            size = 0
    if size:
        yield from fold()
    while held:
        names = next(iter(held))
        yield from _sketch_rows(names, held.pop(names))


def _sketch_rows(names: tuple, s: Sketch) -> Iterator[tuple[tuple, int, int, bytes]]:
    for level, packed in s.parts():
        yield names, level, s.count, packed


def _outgoing(rows: Iterator[tuple[tuple, int, int, bytes]], keys: Sequence[str], types: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The rows in Arrow batches of at most ``BATCH_ROWS``."""
    for some in batched(rows, BATCH_ROWS):
        names, levels, ns, counters = zip(*some, strict=True)
        arrays = [pa.array([n[i] for n in names], type=t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(levels, pa.int32()), pa.array(ns, pa.int64()), pa.array(counters, pa.binary())], names=[*keys, "level", "n", "counters"])


def merge(parts: DataFrame, keys: Sequence[str], shape: Shape = DEFAULT) -> DataFrame:
    """Add up the parts of each group and level: one row each, or two where plain codes outgrew ``PLAIN_CODES``.

    parts: rows of ``sketch``, of one call or of several joined by
    ``unionByName`` (other files or days, deletions), of one shape. ``keys`` may
    be fewer than those sketched, which merges over the others. Parts come sorted,
    so a task holds one sum at a time, however many parts and groups there are;
    the levels of a group lie with different tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _outgoing(_summed(batches, len(keys), shape), keys, types)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(parts.schema[k].dataType) for k in keys]
    narrow = parts.select(*keys, "level", "n", "counters").repartition(*keys, "level").sortWithinPartitions(*keys, "level")
    return narrow.mapInArrow(run, schema=f"{_fields(parts, keys)}, level int, n long, counters binary")


def _summed(batches: Iterator[pa.RecordBatch], width: int, shape: Shape) -> Iterator[tuple[tuple, int, int, bytes]]:
    rows = (row for b in batches for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True))
    for (*names, level), some in groupby(rows, key=lambda row: row[: width + 1]):
        n = 0
        if level != PLAIN:
            total = None
            for *_, part, packed in some:
                n += part
                counters = _unpack(packed)
                total = counters if total is None else total + counters
            yield tuple(names), level, n, _pack(total)
            continue
        plain, grown = Codes(shape), None
        for *_, packed in some:
            codes, weights = _unpack_codes(packed)
            if grown is not None:
                grown.add(codes, weights)
            elif len(plain.add(codes, weights).codes) > 8 * PLAIN_CODES:
                grown = plain.sketch()
        if grown is not None:
            yield from _sketch_rows(tuple(names), grown)
        else:
            yield tuple(names), PLAIN, plain.count, _pack_codes(plain.codes, plain.weights)


def _whole(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a group with its parts, of which there are at most two a level."""
    return merged.groupBy(*keys).agg(F.sum(F.when(F.col("level") < 0, F.col("n")).otherwise(0)).alias("n"), F.collect_list(F.struct("level", "counters")).alias("parts"))


def percentiles(merged: DataFrame, keys: Sequence[str], at: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), shape: Shape = DEFAULT) -> DataFrame:
    """n, one column p05, p25 ... per asked percentile, and rank_error (a share of n) of each group.

    A percentile's true rank differs from the asked one by at most rank_error, and
    its value from a value of that rank by a part in 2^(bits - 12).
    """
    names = [f"p{round(q * 100):02d}" for q in at]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.drop(columns="parts")
            found = [Sketch.of_parts([(p["level"], p["counters"]) for p in ps], int(n), shape) for ps, n in zip(batch["parts"], batch["n"], strict=True)]
            for q, name in zip(at, names, strict=True):
                out[name] = [s.quantile(q) for s in found]
            out["rank_error"] = [s.sure_error() / s.count if s.count > 0 else None for s in found]
            yield out

    return _whole(merged, keys).mapInPandas(run, schema=f"{_fields(merged, keys)}, n long, {', '.join(f'{x} double' for x in names)}, rank_error double")


def rank_bounds(merged: DataFrame, keys: Sequence[str], points: DataFrame, point: str, shape: Shape = DEFAULT) -> DataFrame:
    """For each group with a point: n, and least and most values strictly below and strictly above it.

    points: at most one row a group with the keys and the column ``point``; a
    group with a null, NaN or infinite point has no row. Null keys match.
    """
    kinds = dict(points.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ps, n, p in zip(batch["parts"], batch["n"], batch[point], strict=True):
                s = Sketch.of_parts([(x["level"], x["counters"]) for x in ps], int(n), shape)
                code = int(encode(np.array([p]), shape.bits)[0])
                (low, _), (_, high) = s.rank_between(code), s.rank_between(code + 1)
                rows.append((low, high, n - high, n - low))
            extra = pd.DataFrame(rows, columns=["below_least", "below_most", "above_least", "above_most"], index=batch.index, dtype=float)
            yield pd.concat([batch.drop(columns="parts"), extra], axis=1)

    whole = _whole(merged, keys)
    p = points.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(point).cast("double").alias(point)).where(F.col(point).isNotNull() & ~F.isnan(point) & (F.abs(point) < float("inf")))
    match = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        match = one if match is None else match & one
    joined = whole.join(p, match).select(*keys, "n", point, "parts")
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return joined.mapInPandas(run, schema=f"{fields}, n long, `{point}` double, below_least double, below_most double, above_least double, above_most double")
