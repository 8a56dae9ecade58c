"""Rules that few rows of a list reach: contacts between the products, breweries that are names, headings among the stock, cities as breweries, lists parsed again, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.functions import normalize
from sparkmalt.operators import classify, extract, mapping, repair, rules
from sparkmalt.plans import bound, ingest, lists, sheets
from sparkmalt.sources import files
from sparkmalt.sources.shared import fresh


def one_of(number: Column, *texts: str | Column | None) -> Column:
    """The text whose place is ``number`` modulo their count."""
    values = [t if isinstance(t, Column) else F.lit(t).cast("string") for t in texts]
    return F.get(F.array(*values), (number % len(values)).cast("int"))


def filled(rows: DataFrame, **given: Column) -> DataFrame:
    """``rows`` with the text fields of a list: those ``given``, others null."""
    return rows.withColumns({f: given.get(f, F.lit(None).cast("string")) for f in (*classify.FIELDS, "currency")})


def list_metadata(s: SparkSession, d: str) -> DataFrame:
    """Contacts and service phrases of each list, from rows between the products."""
    i = F.col("id")
    number = (i % 900 + 100).cast("string")
    said = F.concat(
        F.lit("Тел. +7 495 1234567, почта info"), number, F.lit("@brew.example (офис), ул. Ленина "), number, F.lit(", г. Тверь, "), one_of(i, "акция", "Новинка"), F.when(i % 3 == 0, ", Цены без НДС").otherwise("")
    )
    rows = lists.numbered(s, d).select("id", "file_id", F.col("at").alias("row_idx"), F.col("beer_name").alias("name"), (F.col("at") % 17 == 3).alias("other"))
    rows = filled(rows, beer_name=F.when(~F.col("other"), F.col("name")), price=F.when(~F.col("other"), "100"), description=F.when(F.col("other"), said))
    joined = lambda f: F.array_join(f, "|").alias(f)
    return classify.metadata(classify.classified(rows)).select("file_id", *map(joined, ["phones", "emails", "addresses", "links", "extra_text"]), "skipped_rows")


def doubtful_breweries(s: SparkSession, d: str) -> DataFrame:
    """Lists whose brewery column holds names, one long brewery, or short ones; every second row has no name."""
    i = F.col("id").cast("string")
    brewery = one_of(F.col("list"), F.concat(F.lit("dark lot number "), i, F.lit(" of it")), "dark house of the north", F.concat(F.lit("b"), i))
    rows = lists.numbered(s, d).select("id", "file_id", "list", "at")
    rows = filled(rows, brewery=brewery, beer_name=F.when(F.col("at") % 2 == 1, F.concat(F.lit("Helles "), i)))
    return repair.repaired(rows).select("id", "brewery", "beer_name")


def stock_headings(s: SparkSession, d: str) -> DataFrame:
    """Price headings that stand in the stock column of rows."""
    rows = filled(bound.items(s, d).select("id"), beer_name=F.lit("Helles"), stock=one_of(F.col("id"), "Цена банка", "12", "Cost, EUR", None, "много"))
    return extract.split_cells(rows).select("id", "stock")


def normal_fields(s: SparkSession, d: str) -> DataFrame:
    """Fields in their normal form: cities beside and instead of breweries, breweries in names, strengths, currencies and volumes in price cells."""
    i, name, brand = F.col("id"), F.col("name"), F.col("brand")
    rows = bound.items(s, d).select("id", F.col("beer_name").alias("name"), F.col("brewery").alias("brand"))
    rows = filled(
        rows,
        beer_name=F.when(i % 6 == 3, F.concat(F.lit("Dusk - "), name)).otherwise(name),
        brewery=one_of(i, "Москва", F.concat(brand, F.lit(" г. Москва")), F.concat(brand, F.lit(" г. Тверь")), None, "СПб", brand),
        abv=one_of(i, "5,5%", "4.8", "нет", None),
        price=one_of(i, "200 руб", "12 €", "15 usd", "-", "$ 8 (0,5 л)"),
        currency=F.lit("евро"),
        volume=one_of(i, "500 мл", None, "20"),
        format_type=one_of(i, "CAN", "keg", "ящик", None),
    )
    return normalize.normalized(rows).select("id", "brewery", "beer_name", "abv", F.col("price").cast("double").alias("price"), "currency", "volume", "format_type")


def replaced_files(s: SparkSession, d: str) -> DataFrame:
    """Items stored by file; every fourth file is parsed again, with other prices and fewer rows, and replaces itself alone."""
    path = fresh(s, "items-by-file")
    items = bound.items(s, d).select("id", "file_id", "price_cents")
    files.replace_files(items, path)
    files.replace_files(items.where("file_id % 4 = 1 AND id % 3 = 0").withColumn("price_cents", F.col("price_cents") * 2), path)
    return s.read.parquet(path).groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.count("*").alias("items"), F.sum("price_cents").alias("cents"))


def archived(of: dict) -> Iterator[tuple]:
    """(file_id, content): an archive of a list, with a folder of system files; every fifth is no archive."""
    fid, held = of["file_id"], io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{fid}/", "")
        z.writestr(f"{fid}/items.csv", of["text"])
        z.writestr(f"__MACOSX/{fid}/items.csv", "x,y")
    yield f"{fid}.zip", b"no archive" if of["list"] % 5 == 4 else held.getvalue()


def zip_members(s: SparkSession, d: str) -> DataFrame:
    """Lists as CSV files in archives, read back: rows, cells and characters of each file."""
    line = F.concat_ws(",", "brewery", "beer_name", F.col("id").cast("string"))
    whole = lists.numbered(s, d).groupBy("file_id", "list").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", line.alias("line"))))["line"], "\n").alias("text"))  # sheets.ROWS rows each
    archives = files.one_by_one(whole.select("file_id", "list", "text"), archived, files.CONTENTS)
    cells = files.csv_records(files.members(archives))
    return cells.groupBy("file_id").agg(F.count_distinct("row_idx").alias("rows"), F.count("*").alias("cells"), F.sum(F.length("value")).alias("chars"))


def profile_columns(s: SparkSession, d: str) -> DataFrame:
    """What the kind of supplier says of columns: a distributor's brewery column or names with several breweries, one brewery's names and styles; names beyond the third column say nothing."""
    n, i = F.col("list"), F.col("id")
    kind = n % 3
    name = F.concat(F.when((kind == 2) | (i % 2 == 0), "NORD BREW").otherwise("SUED BRAU"), F.lit(" (lot "), i.cast("string"), F.lit(") pale"))
    first = F.when(kind == 0, F.upper("brewery")).otherwise(F.concat(F.lit("K"), (i % 9).cast("string")))
    rows = lists.numbered(s, d).withColumn("values", F.array(first, name, one_of(i, "Session Ale", "Black IPA"), (i % 900 + 50).cast("string")))
    heading = F.array(F.when(kind == 0, "Пивоварня").otherwise("Wert A"), *map(F.lit, ["Wert B", "Wert C", "Wert D"]))
    cells = lists.spread(rows, heading, F.lit(0), F.lit(4))
    told = rules.with_supplier(rules.profiles(*ingest.headed(cells)))
    return told.select("file_id", F.col("supplier.kind").alias("kind"), F.explode(rules.profile_map(F.col("supplier"), F.col("columns"))).alias("field", "col_idx"))


KINDS = ["price", "strength", "litres", "name", "brewery", "packaging", "text"]


def content_scores(s: SparkSession, d: str) -> DataFrame:
    """How much each column of a list looks like each field, by its first values."""
    i = F.col("id")
    values = [
        (i % 900 + 50).cast("string"),
        F.concat((i % 9 + 3).cast("string"), F.lit(".5")),
        F.col("volume").cast("int").cast("string"),
        F.col("beer_name"),
        F.col("brewery"),
        F.col("format_type"),
        F.concat(F.lit("Сухой и хмелевой, с нотами хлеба, карамели и цитруса: "), F.col("beer_name")),
    ]
    cells = lists.numbered(s, d).where(F.col("at") < mapping.SAMPLE_ROWS).select("file_id", "at", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in zip(KINDS, values, strict=True)])).alias("c"))
    columns = cells.groupBy("file_id", "c.kind").agg(F.sort_array(F.collect_list(F.struct("at", "c.v")))["v"].alias("values"))
    scored = mapping.content_scored(columns)
    fields = [c for c in scored.columns if c.startswith("s_")]
    long = scored.select("file_id", "kind", F.explode(F.array(*[F.struct(F.lit(c[2:]).alias("field"), F.col(c).cast("double").alias("score")) for c in fields])).alias("s"))
    return long.select("file_id", "kind", "s.field", F.round("s.score", 6).alias("score"))


QUERIES = {
    "content_scores": content_scores,
    "profile_columns": profile_columns,
    "list_metadata": list_metadata,
    "doubtful_breweries": doubtful_breweries,
    "stock_headings": stock_headings,
    "normal_fields": normal_fields,
    "replaced_files": replaced_files,
    "zip_members": zip_members,
}
_LISTS = f"WITH {bound.ITEMS}, lists AS (SELECT *, format('list-{{:06d}}', id // {sheets.ROWS}) AS fid, (id // {sheets.ROWS})::INT AS n, (id % {sheets.ROWS})::INT AS pos FROM items)"
_SAID = " UNION ALL ".join(f"SELECT fid, '{phrase}' AS p FROM c WHERE {when}" for phrase, when in [("акция", "id % 2 = 0"), ("новинка", "id % 2 = 1"), ("без ндс", "id % 3 = 0"), ("цены без ндс", "id % 3 = 0")])
_VALUES = ["(id % 900 + 50)::VARCHAR", "(id % 9 + 3) || '.5'", "volume::INT::VARCHAR", "beer_name", "brewery", "format_type", "'Сухой и хмелевой, с нотами хлеба, карамели и цитруса: ' || beer_name"]


def _any(words: list[str]) -> str:
    return " + ".join(f"contains(t, '{w}')::INT" for w in words)


_SCORES = {
    "price": "CASE WHEN k < 0.5 * n THEN 0 WHEN in_price = 0 THEN 1 ELSE 4 + 6 * in_price / k END",
    "abv": "CASE WHEN in_abv > 0 AND k >= 0.4 * n THEN 3 + 7 * in_abv / k ELSE 0 END",
    "ibu": "CASE WHEN in_ibu > 0 AND k >= 0.5 * n THEN 5 + 5 * in_ibu / k ELSE 0 END",
    "volume": "CASE WHEN k >= 0.7 * n AND in_litres >= 0.8 * k THEN 0 WHEN in_volume > 0 AND k >= 0.4 * n THEN 4 + 6 * in_volume / k ELSE 0 END",
    "stock": f"CASE WHEN whole > 0 AND k >= 0.6 * n THEN 3 + 7 * whole / k WHEN {_any(mapping.CONTENT_STOCK)} > 0 THEN 5 ELSE 0 END",
    "beer_name": "CASE WHEN packs >= greatest(1, n // 2) OR k > 0.8 * n THEN 0 WHEN len < 8 THEN 1 WHEN len > 120 THEN 2 ELSE 2 + 8 * worded / n END",
    "brewery": "CASE WHEN k > 0.5 * n THEN 0 WHEN len BETWEEN 3 AND 40 THEN 3 + 7 * short / n ELSE 0 END",
    "style": f"CASE WHEN {_any(mapping.CONTENT_STYLES)} > 0 AND len < 60 THEN 4 + 2 * ({_any(mapping.CONTENT_STYLES)}) ELSE 0 END",
    "description": "CASE WHEN len > 50 THEN 4 + (len - 50) / 25 ELSE 0 END",
    "format_type": f"CASE WHEN {_any(mapping.CONTENT_PACKS)} > 0 THEN 8 ELSE 0 END",
}
ORACLES = {
    "content_scores": _LISTS
    + f""", c AS ({" UNION ALL ".join(f"SELECT fid, pos, '{k}' AS kind, {v} AS v FROM lists WHERE pos < {mapping.SAMPLE_ROWS}" for k, v in zip(KINDS, _VALUES, strict=True))}),
        w AS (SELECT *, try_cast(v AS DOUBLE) AS x FROM c),
        a AS (SELECT fid, kind, count(*) AS n, count(x) AS k, avg(length(v)) AS len, lower(string_agg(v, ' ' ORDER BY pos)) AS t, count(*) FILTER (x BETWEEN 15 AND 100000) AS in_price, count(*) FILTER (x BETWEEN 0 AND 20) AS in_abv,
          count(*) FILTER (x BETWEEN 0 AND 120) AS in_ibu, count(*) FILTER (x BETWEEN 0.5 AND 25) AS in_litres, count(*) FILTER (x BETWEEN 0.05 AND 100) AS in_volume, count(*) FILTER (x = floor(x) AND x BETWEEN 0 AND 50000) AS whole,
          count(*) FILTER (v IN ('банка', 'бутылка', 'кега')) AS packs, count(*) FILTER (x IS NULL) AS worded, count(*) FILTER (length(v) BETWEEN 2 AND 35) AS short FROM w GROUP BY fid, kind)
        {" UNION ALL ".join(f"SELECT fid AS file_id, kind, '{f}' AS field, round(least(10, {score})::DOUBLE, 6) AS score FROM a" for f, score in _SCORES.items())}""",
    "profile_columns": _LISTS
    + """, told AS (SELECT DISTINCT fid, n, unnest(CASE n % 3 WHEN 0 THEN ['brewery'] WHEN 1 THEN ['beer_name'] ELSE ['beer_name', 'style'] END) AS field FROM lists WHERE n % 3 = 0 OR n % 4 <> 2)
        SELECT fid AS file_id, CASE WHEN n % 3 = 2 THEN 'brewery' ELSE 'distributor' END AS kind, field, ((CASE field WHEN 'brewery' THEN 0 WHEN 'beer_name' THEN 1 ELSE 2 END + n) % 4)::INT AS col_idx FROM told""",
    "list_metadata": _LISTS
    + f""", c AS (SELECT id, fid, pos, (id % 900 + 100)::VARCHAR AS k FROM lists WHERE pos % 17 = 3), said AS (SELECT fid, string_agg(DISTINCT p, '|' ORDER BY p) AS extra_text FROM ({_SAID}) GROUP BY fid)
        SELECT fid AS file_id, string_agg('+7 495 1234567', '|') AS phones, string_agg('info' || k || '@brew.example', '|' ORDER BY pos) AS emails, string_agg('ул. Ленина ' || k || '|г. Тверь', '|' ORDER BY pos) AS addresses,
          string_agg('brew.example', '|') AS links, any_value(extra_text) AS extra_text, count(*) AS skipped_rows FROM c JOIN said USING (fid) GROUP BY fid""",
    "doubtful_breweries": _LISTS
    + """, r AS (SELECT id, fid, CASE n % 3 WHEN 0 THEN 'dark lot number ' || id || ' of it' WHEN 1 THEN 'dark house of the north' ELSE 'b' || id END AS b, CASE WHEN pos % 2 = 1 THEN 'Helles ' || id ELSE '' END AS name FROM lists),
        f AS (SELECT fid, count(DISTINCT b) > 0.7 * count(*) AND count(*) FILTER (len(string_split(b, ' ')) >= 3 OR length(b) > 25) > 0.3 * count(*) AS doubtful FROM r GROUP BY fid)
        SELECT id, CASE WHEN doubtful AND name = '' THEN '' ELSE b END AS brewery, CASE WHEN doubtful AND name = '' THEN b ELSE name END AS beer_name FROM r JOIN f USING (fid)""",
    "stock_headings": "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 1 THEN '12' WHEN 4 THEN 'много' END AS stock FROM part",
    "normal_fields": f"""WITH {bound.ITEMS} SELECT id, CASE id % 6 WHEN 0 THEN 'Москва' WHEN 3 THEN 'Dusk' WHEN 4 THEN 'СПб' ELSE brewery END AS brewery, beer_name, CASE id % 4 WHEN 0 THEN 5.5 WHEN 1 THEN 4.8 END::DOUBLE AS abv,
        CASE id % 5 WHEN 0 THEN 200 WHEN 1 THEN 12 WHEN 2 THEN 15 WHEN 4 THEN 8 END::DOUBLE AS price, CASE id % 5 WHEN 0 THEN 'RUB' WHEN 1 THEN 'EUR' WHEN 3 THEN 'EUR' ELSE 'USD' END AS currency,
        CASE WHEN id % 3 = 0 THEN 0.5 WHEN id % 3 = 2 THEN 20 WHEN id % 5 = 4 THEN 0.5 END::DOUBLE AS volume, CASE id % 4 WHEN 0 THEN 'банка' WHEN 1 THEN 'кега' WHEN 2 THEN 'ящик' ELSE '' END AS format_type FROM items""",
    "replaced_files": f"""WITH {bound.ITEMS} SELECT file_id, count(*) AS items, sum(CASE WHEN file_id % 4 = 1 THEN 2 * price_cents ELSE price_cents END)::BIGINT AS cents FROM items WHERE file_id % 4 <> 1 OR id % 3 = 0 GROUP BY file_id""",
    "zip_members": _LISTS + " SELECT fid || '/items.csv' AS file_id, count(*) AS rows, 3 * count(*) AS cells, sum(length(brewery) + length(beer_name) + length(id::VARCHAR))::BIGINT AS chars FROM lists WHERE n % 5 <> 4 GROUP BY fid",
}
