"""Values out of loosely typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean an unknown label. Fixed values.
UNKNOWN_WORDS = ("", "nan", "none", "null", "na", "n/a", "unknown")


def finite(x: Column) -> Column:
    """The number, null where it is null, NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number(x: Column) -> Column:
    """A finite double from text; null for anything else."""
    return finite(x.try_cast("double"))


def clip(x: Column, low: float, high: float, missing: float | None = None) -> Column:
    """x bounded to [low, high]; null stays null unless ``missing`` is given."""
    bounded = F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
    return bounded if missing is None else F.coalesce(bounded, F.lit(missing))


def flag_word(x: Column, true_words: tuple[str, ...], missing: bool = False) -> Column:
    """Whether the text is one of the words that mean true; null gives ``missing``."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*true_words), F.lit(missing))


def flag_yes(x: Column, missing: bool = False) -> Column:
    """The vocabulary 1, true, yes, y."""
    return flag_word(x, ("1", "true", "yes", "y"), missing)


def flag_true(x: Column, missing: bool = False) -> Column:
    """The vocabulary 1, true, yes."""
    return flag_word(x, ("1", "true", "yes"), missing)


def flag_mapped(x: Column, default: bool = False) -> Column:
    """true, 1, 1.0 or false, 0, 0.0; anything else gives ``default``."""
    low = F.lower(F.trim(x.cast("string")))
    return F.when(low.isin("true", "1", "1.0"), True).when(low.isin("false", "0", "0.0"), False).otherwise(default)


def flag_strict(x: Column, name: str) -> Column:
    """true or false, 1 or 0; any other value, null included, stops the query with its name."""
    low = F.lower(F.trim(x.cast("string")))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit(f"{name} is no boolean: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("boolean"))


def known_label(x: Column) -> Column:
    """The label trimmed, or ``unknown`` for null and the words that mean it."""
    t = F.trim(x)
    return F.when(x.isNull() | F.lower(t).isin(*UNKNOWN_WORDS), "unknown").otherwise(t)


def json_strings(x: Column) -> Column:
    """A JSON list of texts as an array; an empty array for null, torn JSON and anything but a list."""
    return F.coalesce(F.when(F.trim(x).startswith("["), F.from_json(x, "array<string>")), F.array().cast("array<string>"))


def id_list(x: Column) -> Column:
    """Ids from a JSON list or a single text; null and blank give none."""
    t = F.trim(x)
    return F.when(x.isNull() | (t == ""), F.array().cast("array<string>")).when(t.startswith("["), json_strings(t)).otherwise(F.array(t))


def split_list(x: Column, mark: str = ";") -> Column:
    """The trimmed non-empty parts of a marked list."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), mark), F.trim), lambda p: p != "")
