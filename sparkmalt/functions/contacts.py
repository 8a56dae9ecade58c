"""Contacts and service phrases in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns: fixed values.
PHONES = [r"\+?[0-9]{1,3}[-.\s]?\(?[0-9]{1,4}\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}", r"\+?7[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{2}[-.\s]?[0-9]{2}", r"\+?375[-.\s]?\(?[0-9]{2}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{2}[-.\s]?[0-9]{2}"]
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
LINKS = [r"https?://[^\s]+", r"www\.[^\s]+", r"[a-zA-Z0-9-]+\.[a-zA-Z]{2,}[^\s]*"]
ADDRESSES = [r"ул\.\s*[^,\n]+", r"улица\s+[^,\n]+", r"пр\.\s*[^,\n]+", r"проспект\s+[^,\n]+", r"г\.\s*[^,\n]+", r"город\s+[^,\n]+"]
SERVICE = ["цены без ндс", "без ндс", "цена указана без ндс", "акция", "новинка", "скидка", "специальное предложение"]


def all_of(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)), lambda x: F.trim(x))


def phones(c: Column) -> Column:
    return all_of(c, "|".join(PHONES))


def emails(c: Column) -> Column:
    return all_of(c, EMAIL)


def links(c: Column) -> Column:
    return all_of(c, "|".join(LINKS))


def addresses(c: Column) -> Column:
    """By pattern, then by place."""
    return F.flatten(F.array(*[all_of(c, f"(?iu){p}") for p in ADDRESSES]))


def service_phrases(c: Column, phrases: list[str] = SERVICE) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: t.contains(p))


def contacts(c: Column) -> Column:
    return F.struct(phones(c).alias("phones"), emails(c).alias("emails"), addresses(c).alias("addresses"), links(c).alias("links"))
