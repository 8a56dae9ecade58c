"""Beer styles from names, descriptions and page texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmalt.functions.text import clean, contains_any, present

# Words in the order in which they are tried: fixed values.
BY_NAME = [
    ("Berliner Weisse", ["берлинер вайссе", "berliner weisse"]),
    ("Gose", ["гозэ", "гозе", "gose"]),
    ("Sour Ale", ["саур", "sour"]),
    ("Stout", ["стаут", "stout"]),
    ("Porter", ["портер", "porter"]),
    ("IPA", ["ипа", "ipa"]),
    ("Lager", ["лагер", "lager"]),
    ("Ale", ["эль", "ale"]),
]
FINER = {"Stout": ("Imperial Stout", ["имперский", "imperial"]), "Ale": ("Pale Ale", ["пале", "pale"])}
BY_DESCRIPTION = [("Gose", ["гозэ", "гозе", "gose"]), ("Berliner Weisse", ["берлинер вайссе", "berliner weisse"]), ("Sour Ale", ["саур эль", "sour ale"]), ("Stout", ["стаут", "stout"]), ("Porter", ["портер", "porter"])]


def first_of(text: Column, rules: list[tuple[str, list[str]]], finer: dict) -> Column:
    """The style of the first rule of which a word is contained."""

    def named(style: str) -> Column:
        return F.when(contains_any(text, finer[style][1]), F.lit(finer[style][0])).otherwise(F.lit(style)) if style in finer else F.lit(style)

    return reduce(lambda rest, r: F.when(contains_any(text, r[1]), named(r[0])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def inferred(name: Column, description: Column) -> Column:
    """A style by the name, else by the description; null where there is no name."""
    n, d = F.lower(clean(name)), F.lower(clean(description))
    mixed = d.contains("sour") & d.contains("эль")
    by_description = first_of(F.when(mixed, F.concat(d, F.lit(" sour ale"))).otherwise(d), BY_DESCRIPTION, {"Stout": FINER["Stout"]})
    return F.when(n != "", F.coalesce(first_of(n, BY_NAME, FINER), F.when(d != "", by_description)))


def filled(style: Column, name: Column, description: Column) -> Column:
    """The style, inferred where it is missing."""
    return F.when(present(style), clean(style)).otherwise(inferred(name, description))


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1)), F.lit(""))


def page_links(html: Column) -> Column:
    """Distinct link targets of a page, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1)))


# Style names of product pages, group after group, and marks of label images: fixed values.
PAGE_STYLES = [
    "IPA|India Pale Ale|Imperial IPA|Double IPA|Triple IPA|Hazy IPA|New England IPA|West Coast IPA|Milkshake IPA|Sour IPA|Brut IPA|Black IPA|Red IPA|White IPA|Brown IPA|Rye IPA|Belgian IPA|English IPA|Session IPA",
    "Stout|Imperial Stout|Russian Imperial Stout|Oatmeal Stout|Milk Stout|Sweet Stout|Coffee Stout|Chocolate Stout|Pastry Stout|Barrel-Aged Stout|Foreign Extra Stout|Dry Stout|Irish Stout",
    "Porter|Baltic Porter|Imperial Porter|Robust Porter|Brown Porter|Smoked Porter|Coffee Porter|Chocolate Porter|Vanilla Porter|Peanut Butter Porter|Coconut Porter",
    "Lager|Pilsner|German Pilsner|Czech Pilsner|Bohemian Pilsner|American Pilsner|Imperial Pilsner|Mexican Lager|Vienna Lager|Märzen|Oktoberfest|Helles|Dunkel|Schwarzbier|Bock|Doppelbock|Eisbock|Maibock|Kellerbier|Zwickelbier",
    "Wheat|Hefeweizen|Weizenbock|Dunkelweizen|Weissbier|Witbier|Belgian Wit|American Wheat|Wheatwine|Berliner Weisse|Gose",
    "Sour|Wild Ale|Lambic|Gueuze|Flanders Red|Flanders Brown|Oud Bruin|Kriek|Framboise|Peche|Spontaneously Fermented|Mixed Fermentation|Brett|Brettanomyces|Pediococcus|Lactobacillus",
    "Saison|Farmhouse|Bière de Garde|Grisette|Table Beer|Petite Saison",
    "Barleywine|Barley Wine|English Barleywine|American Barleywine",
    "Pale Ale|American Pale Ale|English Pale Ale|Blonde Ale|Golden Ale|Amber Ale|Red Ale|Brown Ale|Scottish Ale|Irish Red Ale",
    "Belgian|Dubbel|Tripel|Quad|Quadrupel|Singel|Blonde|Dark|Strong|Weak|Table|Trappist|Abbey|Golden Strong|Dark Strong",
]
JSON_NOTHING = ["", "0", "false", "[]", "{}"]
META_STYLES = "IPA|Stout|Porter|Lager|Ale|Wheat|Sour|Gose|Pilsner|Saison|Farmhouse|Barleywine"
NO_LABELS = ["badge-beer-default", "beer-default", "brewery-default", "default_avatar", "/temp/", "placeholder", "blank.gif", "/badges/", "/profile/", "_100x100", "_50x50", "/og/beer/"]
LABEL_RANKS = [("/site/beer_logos_hd/", 500), ("/site/beer_logos/beer-.*_hd\\.", 450), ("/site/beer_logos/beer-.*_sm\\.", 200), ("/site/beer_logos/beer-", 250), ("assets\\..*brewery", 40)]


def page_text(html: Column) -> Column:
    """The text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.regexp_replace(bare, "<[^>]*>", " ")


def page_style(html: Column, name: Column) -> Column:
    """A style by a page: from its meta fields, else the first style group in its text that isn't in the beer's name, else from the first of its JSON objects that names one."""
    found = lambda c, words: F.nullif(F.regexp_extract(c, f"(?iu)({words})", 1), F.lit(""))
    meta = F.filter(F.regexp_extract_all(html, F.lit(r'(?i)<meta[^>]*property="(?:og:|beer:)[^"]*"[^>]*content="([^"]*)"'), F.lit(1)), lambda x: F.lower(x).rlike("style|ipa|stout"))
    by_meta = F.get(F.filter(F.transform(meta, lambda x: found(x, META_STYLES)), lambda x: x.isNotNull()), F.lit(0))
    text, low = page_text(html), F.lower(F.coalesce(name, F.lit("")))
    own = [F.when((F.length(found(text, g)) > 2) & ~F.contains(low, F.lower(found(text, g))), found(text, g)) for g in PAGE_STYLES]
    data = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    some = lambda c: F.when(~c.isin(JSON_NOTHING), c)
    told = F.transform(data, lambda t: F.coalesce(*[some(F.get_json_object(t, f"$.{k}")) for k in ("genre", "category", "keywords")]))
    first = F.get(F.filter(told, lambda x: x.rlike("(?i)(IPA|Stout|Porter|Lager|Ale|Wheat|Sour)")), F.lit(0))
    return F.coalesce(by_meta, *own, F.trim(first))


def label_candidates(html: Column) -> Column:
    """Distinct addresses of images on a page, without what follows ? or #: images and their sources, then those of the meta fields."""
    images = F.regexp_extract_all(html, F.lit(r'(?i)<(?:img|source)[^>]*\s(?:src|data-src|data-original|data-lazy)="([^"]*)"'), F.lit(1))
    meta = F.regexp_extract_all(html, F.lit(r'(?i)<meta[^>]*(?:property="og:image"|name="twitter:image")[^>]*content="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.transform(F.filter(F.concat(images, meta), lambda u: u.startswith("http")), lambda u: F.regexp_replace(F.trim(u), "[?#].*$", "")))


def usable_label(url: Column) -> Column:
    """An address that can be a label: no default picture, badge, small preview or card for sharing."""
    u = F.lower(url)
    return (F.length(url) >= 12) & u.rlike("^https?://") & ~contains_any(u, NO_LABELS)


def label_rank(url: Column) -> Column:
    u = F.lower(url)
    return reduce(lambda rest, r: F.when(u.rlike(r[0]), r[1]).otherwise(rest), reversed(LABEL_RANKS), F.lit(10))


def best_label(urls: Column) -> Column:
    """The best label image of an array of addresses, the first among equals; null if none is usable."""
    ranked = F.transform(F.filter(urls, usable_label), lambda u, i: F.struct((-label_rank(u)).alias("r"), i.alias("i"), u.alias("u")))
    return F.array_min(ranked)["u"]


def scraped_name(c: Column) -> Column:
    """A name without the mark of a new product before it."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)^\(NEW\)\s*", ""), r"(?i)^NEW\s+", ""))


# Word groups for English names, first match wins: fixed values, without the longer names that hold a shorter one of their group.
GROUPS = [
    ("ipa", ["ipa", "india pale ale"]),
    ("Stout", ["stout"]),
    ("Porter", ["porter"]),
    ("Lager", ["lager", "pilsner", "helles", "dunkel", "bock"]),
    ("Sour Ale", ["sour", "gose", "berliner weisse", "lambic", "gueuze", "wild ale"]),
    ("Wheat Beer", ["wheat", "weizen", "witbier", "belgian wit"]),
    ("Pale Ale", ["pale ale", "blonde ale"]),
    ("Saison", ["saison", "farmhouse", "bière de garde"]),
    ("Barleywine", ["barleywine", "barley wine"]),
]


def guessed(name: Column) -> Column:
    """A style group by English words in a name; null if none."""
    return first_of(F.lower(clean(name)), GROUPS, {})
