"""Numbers in price-list texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmalt.functions.text import clean

NUMBER = r"(\d+[.,]?\d*)"


def safe_float(c: Column, default: float | None = None) -> Column:
    """A number, comma or point; ``default`` where there is none."""
    value = F.replace(clean(c), F.lit(","), F.lit(".")).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def safe_int(c: Column, default: int | None = None) -> Column:
    """The whole part of a number."""
    value = F.when(F.abs(safe_float(c)) < 9e18, safe_float(c).cast("long"))
    return value if default is None else F.coalesce(value, F.lit(default))


def number_text(c: Column) -> Column:
    """'1 234,50' and '1.234,50' as '1234.50'."""
    t = F.regexp_replace(clean(c), "[\\s ]", "")
    both = t.contains(",") & t.contains(".")
    european = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(both & (F.instr(t, ".") < F.instr(t, ",")), european).when(both, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))


def first_number(c: Column) -> Column:
    """The first number in a text."""
    return F.replace(F.regexp_extract(clean(c), NUMBER, 1), F.lit(","), F.lit(".")).try_cast("double")


def probe(c: Column) -> Column:
    """A cell as a number after all but digits, point, sign, slash and percent is gone."""
    t = F.regexp_replace(F.replace(F.replace(clean(c), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), r"[^\d.\-/%]", "")
    return F.regexp_replace(t, "%+$", "").try_cast("double")


def counted(c: Column) -> Column:
    """``probe`` of a cell in which little but a number and its unit stands: at most two letters before the first digit and eight after it."""
    return F.when(clean(c).rlike(r"(?u)^\P{L}*(\p{L}\P{L}*){0,2}?\d\P{L}*(\p{L}\P{L}*){0,8}$"), probe(c))
