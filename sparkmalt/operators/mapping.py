"""Schema matching: which column of a sheet is which field.

Headings are scored against the word registry and column contents against the
fields, both as Column expressions; only the fuzzy ratio (for pairs that could
reach it) and the choice per sheet, over tens of rows, run in Python.

One choice is made for a sheet over headings, contents and rules: headings that
name a field beyond doubt or that equal one of its words are fixed, and the other
columns go to the other fields so that the scores of all pairs add up to most.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkmalt.functions.numbers import counted
from sparkmalt.functions.text import settled
from sparkmalt.operators.headers import SHEET, heading, with_rows
from sparkmalt.sources.registry import FIELDS
from sparkmalt.sources.shared import written

SAMPLE_ROWS = 40
CONTENT_WEIGHT = 3.0
EXACT, PART, WITHIN, FUZZY, FUZZY_FROM = 10.0, 6.0, 3.0, 4.0, 0.82
RULE_WEIGHT = 10.0  # what a pair gains if the rules propose it, too
# Words that lower or raise a field's score, and rules for headings, in order: fixed values.
LOWER, RAISE = {"beer_name": ["описан", "description", "стиль", "style", "коммент", "примечан"]}, {"description": ["описан", "description", "коммент", "примечан"]}
CONTENT_STYLES = ["ipa", "lager", "ale", "stout", "porter", "pilsner", "gose", "neipa", "сайсон", "стаут", "эль", "лагер"]
CONTENT_STOCK = ["много", "мало", "есть", "нет", "в наличии", "под заказ"]
CONTENT_PACKS = ["банка", "can", "кег", "keg", "бутыл", "bottle", "розлив", "тара", "фасов"]
CONTENT_LABELS = r"(?iu)(банка|бутылк|кег|can|keg|шт/кор|не дробим)"
SKIPPED = ["этикетка", "годен до", "скидки", "акции", "заказ (кег", "сайт", "почта", "telegram"]
RULES = [
    ("beer_name", ["наименование", "название товара", "название пива"]),
    ("brewery", ["наименование пивоварни", "пивоварня", "производитель", "бренд"]),
    ("format_type", ["тип тары", "тип фасовки", "фасовка", "упаковка", "тара"]),
    ("stock", ["наличие", "остаток", "в наличии"]),
    ("price", ["цена", "стоимость", "price", "cost"]),
    ("style", ["стиль", "style", "сорт"]),
    ("abv", ["abv", "крепость", "алк"]),
    ("ibu", ["ibu", "горечь"]),
    ("volume", ["объем", "объём", "литраж", "volume"]),
    ("description", ["описание", "description", "комментар", "примечан"]),
    ("currency", ["валюта", "currency"]),
]


def locked_field(c: Column) -> Column:
    """The field that a heading names beyond doubt, '__skip__', '__og__' or null."""
    h = heading(c)
    field = F.lit(None).cast("string")
    for name, words in reversed(RULES):
        hit = h.rlike("|".join(words))
        if name == "beer_name":
            hit = hit & ~h.contains("пивоварни")
        if name == "brewery":
            hit = hit & (~h.contains("наименование") | h.contains("пивоварни"))
        field = F.when(hit, name).otherwise(field)
    skip = F.exists(F.array(*map(F.lit, SKIPPED)), lambda w: h.contains(w))
    return F.when(h == "", None).when(skip, "__skip__").when(h.isin("og", "original gravity") | h.startswith("og "), "__og__").otherwise(field)


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def header_scores(headers: DataFrame, keywords: dict[str, list[str]] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """``headers`` (with ``header``) times fields: field, field_order, header_score, and exact for a heading that equals one of the field's words.

    Words are literals, and each different heading is scored once, however many sheets have it.
    """
    keywords, weights = keywords or FIELDS, weights or {}
    # one literal, not a Column for each word: a session builds a Column in several calls
    table = [{"field": f, "field_order": i, "word": heading_text(w), "weight": float(weights.get(f, 1.0))} for i, (f, ws) in enumerate(keywords.items()) for w in ws]
    words = F.from_json(F.lit(json.dumps(table)), "array<struct<field:string,field_order:int,word:string,weight:double>>")
    told = headers.distinct().withColumn("h", heading(F.col("header"))).where("h <> ''")
    pairs = told.select("h").distinct().withColumn("k", F.explode(words))
    w, h, n, m = F.col("k.word"), F.col("h"), F.length("k.word"), F.length("h")
    plain = F.when(w == h, EXACT).when(h.contains(w), PART).when(w.contains(h), WITHIN)
    # a ratio can't exceed twice the shorter length over both; only pairs that can reach the least ratio go to Python
    likely = plain.isNull() & (2 * F.least(n, m) >= FUZZY_FROM * (n + m))
    alike = pairs.where(likely).select("h", w.alias("word")).distinct().withColumn("ratio", fuzzy_ratio(F.col("word"), F.col("h"))).where(F.col("ratio") >= FUZZY_FROM)
    pairs = pairs.withColumn("word", w).join(alike.hint("merge"), ["h", "word"], "left")
    best = F.coalesce(plain, FUZZY * F.col("ratio"), F.lit(0.0)) * F.col("k.weight")
    scored = pairs.groupBy("h", F.col("k.field").alias("field"), F.col("k.field_order").alias("field_order")).agg(F.max(best).alias("score"), F.max(w == h).alias("exact"))
    change = F.lit(0.0)
    for field, found in LOWER.items():
        for x in found:
            change = change - F.when((F.col("field") == field) & F.col("h").contains(x), 6.0).otherwise(0.0)
    for field, found in RAISE.items():
        for x in found:
            change = change + F.when((F.col("field") == field) & F.col("h").contains(x), 2.0).otherwise(0.0)
    scored = scored.withColumn("header_score", F.greatest(F.col("score") + change, F.lit(0.0))).drop("score")
    return told.join(scored, "h").drop("h").select(*headers.columns, "field", "field_order", "exact", "header_score")


def heading_text(word: str) -> str:
    return " ".join(word.lower().split())


def content_scored(columns: DataFrame) -> DataFrame:
    """``columns`` (with ``values``, a column's first cell texts) with scores 0 to 10, s_<field>, instead of the values."""
    out = settled(columns, {"__v": F.transform("values", lambda x: F.trim(x))})
    out = settled(out, {"__numbers": F.filter(F.transform("__v", counted), lambda x: x.isNotNull()), "__text": F.lower(F.array_join("__v", " ")), "__n": F.size("__v")})
    v, n, numbers, k, text = F.col("__v"), F.col("__n"), F.col("__numbers"), F.size("__numbers"), F.col("__text")
    out = settled(out, {"__share": F.when(n > 0, k / n).otherwise(0.0), "__length": F.aggregate(v, F.lit(0.0), lambda a, x: a + F.length(x)) / F.greatest(n, F.lit(1))})
    share, length = F.col("__share"), F.col("__length")
    within = lambda lo, hi: F.size(F.filter(numbers, lambda x: x.between(lo, hi)))
    some = lambda pattern: F.size(F.filter(v, lambda x: x.rlike(pattern)))
    ten = lambda c: F.least(F.lit(10.0), c.cast("double"))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    style_hits = F.size(F.filter(F.array(*map(F.lit, CONTENT_STYLES)), lambda w: text.contains(w)))
    abv_hits = some(r"%|(?iu)\babv\b")
    whole = F.size(F.filter(numbers, lambda x: (x == F.floor(x)) & x.between(0, 50_000)))
    packs, lines = some(CONTENT_LABELS), F.size(F.filter(v, lambda x: x.contains("\n") & (F.length(x) > 20)))
    of_numbers = lambda c: c / F.greatest(k, F.lit(1))
    scores = {
        "price": F.when(share < 0.5, 0.0).when(within(15, 100_000) == 0, 1.0).otherwise(ten(4 + 6 * of_numbers(within(15, 100_000)) + F.least(F.lit(2.0), some(r"\d+\s*/\s*\d+") * 0.5))),
        "abv": F.when((within(0, 20) > 0) & (share >= 0.4), ten(3 + 7 * of_numbers(within(0, 20)) + abv_hits)).when(abv_hits > 0, 6.0).otherwise(0.0),
        "ibu": F.when((within(0, 120) > 0) & (share >= 0.5), ten(5 + 5 * of_numbers(within(0, 120)))).otherwise(0.0),
        "volume": F.when((share >= 0.7) & (of_numbers(within(0.5, 25)) >= 0.8) & (some(r"(?iu)\d+[.,]?\d*\s*л") == 0), 0.0).when((within(0.05, 100) > 0) & (share >= 0.4), ten(4 + 6 * of_numbers(within(0.05, 100)))).otherwise(0.0),
        "stock": F.when((whole > 0) & (share >= 0.6), ten(3 + 7 * of_numbers(whole))).when(has(CONTENT_STOCK), 5.0).otherwise(0.0),
        "beer_name": F.when(packs >= F.greatest(F.lit(1), F.floor(n / 2)), 0.0).when(share > 0.8, 0.0).when(lines > 0, ten(6 + lines)).when(length < 8, 1.0).when(length > 120, 2.0).otherwise(ten(2 + 8 * some("(?iu)[а-яa-z]") / F.greatest(n, F.lit(1)))),
        "brewery": F.when(share > 0.5, 0.0).when(length.between(3, 40), ten(3 + 7 * F.size(F.filter(v, lambda x: F.length(x).between(2, 35))) / F.greatest(n, F.lit(1)))).otherwise(0.0),
        "style": F.when((style_hits > 0) & (length < 60), ten(4 + 2 * style_hits)).otherwise(0.0),
        "description": F.when(length > 50, ten(4 + (length - 50) / 25)).otherwise(0.0),
        "format_type": F.when(has(CONTENT_PACKS), 8.0).otherwise(0.0),
    }
    out = settled(out, {f"s_{f}": F.when(n > 0, s).otherwise(0.0) for f, s in scores.items()})
    return out.drop("values", "__v", "__numbers", "__text", "__n", "__share", "__length")


def samples(cells: DataFrame, header_rows: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(file_id, sheet, col_idx, values): the filled cells of the first rows under the headings, in order."""
    return sampled(near(cells, header_rows, rows))


def near(cells: DataFrame, header_rows: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Cells, with header_row, of the heading rows and the first rows under them."""
    return with_rows(cells, header_rows).where(F.col("row_idx").between(F.col("header_row"), F.col("header_row") + rows))


def sampled(cells: DataFrame) -> DataFrame:
    """``samples`` of cells that are ``near``."""
    body = cells.where(F.col("row_idx") > F.col("header_row"))
    body = body.where(~F.lower(F.trim("value")).isin("", "-", "—", "–", "nan", "none", "null", "n/a", "xx", "хх"))
    return body.groupBy(*SHEET, "col_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "value"))), lambda x: F.trim(x["value"])).alias("values"))


def candidates(cells: DataFrame, header_rows: DataFrame, keywords: dict[str, list[str]] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(file_id, sheet, col_idx, header, locked, field, field_order, header_score, exact, content_score)."""
    first = written(near(cells, header_rows), "near-cells")
    headers = first.where("row_idx = header_row").select(*SHEET, "col_idx", F.trim("value").alias("header"))
    headers = headers.withColumn("locked", locked_field(F.col("header")))  # here, as below each column stands once for every field
    # a row per column of a sheet, whose size is guessed from packed files, too: looked up by shuffled hash, as in ``with_rows``
    content = content_scored(sampled(first)).hint("shuffle_hash")
    out = header_scores(headers, keywords, weights).join(content, [*SHEET, "col_idx"], "left")
    score = F.coalesce(*[F.when(F.col("field") == c[2:], F.col(c)) for c in content.columns if c.startswith("s_")], F.lit(0.0))
    return out.select(*SHEET, "col_idx", "header", "locked", "field", "field_order", "header_score", "exact", score.alias("content_score"))


def matched(weights: list[list[float]]) -> list[int]:
    """For rows and columns of weights, each row's column in the matching of greatest sum, -1 for none; only weights over 0 count.

    Of equal sums the one is taken that gives the first row the smallest column,
    then the second, and so on, none last. Shortest augmenting paths over whole
    numbers: a weight in thousandths, above digits that hold the rule for ties.
    """
    n, m = len(weights), len(weights[0]) if weights else 0
    scale = (m + 1) ** n
    cost = [[-(round(w * 1000) * scale + (m - j) * (m + 1) ** (n - 1 - i)) if w > 0 else 1 for j, w in enumerate(row)] + [0] * n for i, row in enumerate(weights)]
    high, low = [0] * (n + 1), [0] * (m + n + 1)
    owner = [0] * (m + n + 1)  # row of each column, both from 1
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least: list[int | None] = [None] * (m + n + 1)
        before, done = [0] * (m + n + 1), [False] * (m + n + 1)
        while owner[at]:
            done[at] = True
            i, step, best = owner[at], None, 0
            for j in range(1, m + n + 1):
                if not done[j]:
                    now = cost[i - 1][j - 1] - high[i] - low[j]
                    if least[j] is None or now < least[j]:
                        least[j], before[j] = now, at
                    if step is None or least[j] < step:
                        step, best = least[j], j
            for j in range(m + n + 1):
                if done[j]:
                    high[owner[j]] += step
                    low[j] -= step
                elif least[j] is not None:
                    least[j] -= step
            at = best
        while at:
            owner[at] = owner[before[at]]
            at = before[at]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j] and weights[owner[j] - 1][j - 1] > 0:
            out[owner[j] - 1] = j - 1
    return out


def choice(pairs: list[SimpleNamespace]) -> dict[str, int]:
    """Field to column for the pairs of one sheet (col_idx, field, field_order, total, exact, locked): locks, exact headings, then the best matching of the rest.

    The leftmost column of a lock gets its field; of several headings that equal
    a field's words the one of the highest total, then the leftmost. A locked
    column is for no other field.
    """
    locks = {r.col_idx: r.locked for r in pairs if r.locked is not None}
    chosen: dict[str, int] = {}
    for c in sorted(locks):
        if not locks[c].startswith("__"):
            chosen.setdefault(locks[c], c)
    used = set(chosen.values())
    rows = sorted(pairs, key=lambda r: (r.field_order, -r.total, r.col_idx))
    free = lambda r: r.field not in chosen and r.col_idx not in used and locks.get(r.col_idx) is None
    for r in rows:
        if r.exact and free(r):
            chosen[r.field] = r.col_idx
            used.add(r.col_idx)
    left = [r for r in rows if r.field not in chosen and r.total > 0 and r.col_idx not in used and locks.get(r.col_idx, r.field) == r.field]
    fields, columns = list(dict.fromkeys(r.field for r in left)), sorted({r.col_idx for r in left})
    total = {(r.field, r.col_idx): r.total for r in left}
    found = matched([[total.get((f, c), 0.0) for c in columns] for f in fields])
    return chosen | {f: columns[j] for f, j in zip(fields, found, strict=True) if j >= 0}


def assigned(scored: DataFrame, ruled: DataFrame | None = None) -> DataFrame:
    """(file_id, sheet, field, col_idx): the choice for every sheet, each field and column once.

    ``ruled`` (same columns as the result) are pairs that rules propose; they
    weigh RULE_WEIGHT more. A sheet has columns times fields rows, so a group is small.
    """
    total = F.col("header_score") + CONTENT_WEIGHT * F.col("content_score")
    locked = F.col("locked") if "locked" in scored.columns else locked_field(F.col("header"))
    rows = scored
    if ruled is not None:
        keys = [*SHEET, "field", "col_idx"]
        rows = rows.join(ruled.select(*keys).distinct().withColumn("ruled", F.lit(RULE_WEIGHT)), keys, "left")
        total = total + F.coalesce("ruled", F.lit(0.0))
    rows = rows.select(*SHEET, "col_idx", "field", "field_order", "exact", locked.alias("locked"), total.alias("total"))

    def choose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sheets in batches:
            chosen = [list(choice([SimpleNamespace(**p) for p in s.as_py()]).items()) for s in sheets]
            yield pa.array(chosen, pa.map_(pa.string(), pa.int32()))

    pairs = rows.groupBy(*SHEET).agg(F.collect_list(F.struct("col_idx", "field", "field_order", "exact", "locked", "total")).alias("pairs"))
    chosen = F.arrow_udf(choose, "map<string, int>").asNondeterministic()
    return pairs.select(*SHEET, chosen("pairs").alias("chosen")).select(*SHEET, F.explode("chosen").alias("field", "col_idx"))


def top_candidates(scored: DataFrame, n: int = 3) -> DataFrame:
    """The best columns by heading for each field, with the sheet's confidence: the mean of its fields' best scores."""
    w = Window.partitionBy(*SHEET, "field").orderBy(F.desc("header_score"), "col_idx")
    best = scored.where("header_score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("score", F.bround("header_score", 3))
    top = best.groupBy(*SHEET).agg(F.bround(F.avg(F.when(F.col("rank") == 1, F.col("score"))), 3).alias("confidence"))
    return best.join(top, SHEET).select(*SHEET, "field", "rank", "col_idx", "header", "score", "confidence")


def recommendations(candidates_: DataFrame, gap: float = 1.0, least: float = 1.0) -> DataFrame:
    """Fields whose two best columns are within ``gap``."""
    two = candidates_.groupBy(*SHEET, "field").agg(F.max(F.when(F.col("rank") == 1, F.struct("col_idx", "header", "score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.struct("col_idx", "header", "score"))).alias("b"))
    return two.where((F.col("a.score") >= least) & (F.abs(F.col("a.score") - F.col("b.score")) <= gap)).select(*SHEET, "field", F.col("a.header").alias("header"), F.col("a.col_idx").alias("col_idx"), F.col("a.score").alias("score"), F.col("b.header").alias("second_header"), F.col("b.score").alias("second_score"))

