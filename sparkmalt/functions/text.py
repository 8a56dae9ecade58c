"""Text predicates and small helpers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for "nothing": fixed values.
EMPTY_TOKENS = ["", "-", "—", "–", "nan", "none", "null", "n/a", "na", "хх", "xx", "н/д", "н.д."]
DASHES = ["", "-", "—", "–"]


def clean(c: Column) -> Column:
    """Trimmed text, '' for null."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def present(c: Column) -> Column:
    """True if there is text in it."""
    return clean(c) != ""


def truthy(c: Column) -> Column:
    """A number that is neither null nor 0."""
    return F.coalesce(c != 0, F.lit(False))


def null_if_empty(c: Column) -> Column:
    """Null for texts that stand for nothing."""
    return F.when(~F.lower(clean(c)).isin(EMPTY_TOKENS), clean(c))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def contains_ci(c: Column, part: str) -> Column:
    """Substring test without regard to case; % and _ are ordinary characters."""
    return F.lower(F.coalesce(c, F.lit(""))).contains(part.lower())


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(clean(c), r"\s+"), lambda w: w != ""))


def is_empty(c: Column) -> Column:
    return clean(c).isin(DASHES)


def description_like(c: Column) -> Column:
    t, n = clean(c), word_count(c)
    return (F.length(t) >= 70) | (n >= 12) | (t.rlike("[,.:]") & (n >= 8))


def name_like(c: Column) -> Column:
    t = clean(c)
    return (t != "") & (F.length(t) <= 80) & (word_count(c) <= 8)


def upper_title(c: Column) -> Column:
    """At most six words, four fifths of those with letters in capitals."""
    words = F.filter(F.split(clean(c), r"\s+"), lambda w: w != "")
    lettered = F.filter(words, lambda w: w.rlike(r"\p{L}"))
    capitals = F.filter(lettered, lambda w: w == F.upper(w))
    return (F.size(words).between(1, 6)) & (F.size(lettered) > 0) & (F.size(capitals) >= 0.8 * F.size(lettered))


def clean_name(c: Column) -> Column:
    """A name without its marks in brackets and without edge signs."""
    t = F.regexp_replace(clean(c), r"(?iu)\((fresh brewed|new|limited|лимитирован[а-я]*)\)", "")
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"^[ \-—–,;]+|[ \-—–,;]+$", "")


def matches(field: Column, mode: str, query: str) -> Column:
    """One of contains, equals, starts_with, ends_with, without regard to case."""
    f, q = F.lower(F.coalesce(field.cast("string"), F.lit(""))), F.lit(query.lower())
    return {"contains": f.contains(q), "equals": f == q, "starts_with": f.startswith(q), "ends_with": f.endswith(q)}[mode]


def settled(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``df.withColumns(fields)``, by way of a generator: the optimizer then reads the results as columns and doesn't copy long expressions into each place that uses them.

    The generator only takes a struct apart. What the fields are is worked out in the projection below it, as
    generators don't compile expressions with functions of lambdas in them.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in fields]
    made = df.select(*rest, F.struct(*[c.alias(name) for name, c in fields.items()]).alias("__settled"))
    return made.select(*rest, F.inline(F.array("__settled")))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, whatever the uses of it."""
    return F.transform(F.array(value), use)[0]
