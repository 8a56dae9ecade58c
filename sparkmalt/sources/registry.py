"""Field names of price lists and the words that head their columns, with layers of learned words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words by field: fixed values.
FIELDS: dict[str, list[str]] = {
    "brewery": ["пивоварня", "производитель", "brewery", "manufacturer", "brand", "бренд", "марка", "производитель пива", "наименование пивоварни", "пивоварня/производитель"],
    "beer_name": ["название", "пиво", "beer", "name", "наименование", "товар", "продукт", "product", "наименование товара", "название пива", "наименование пива", "название товара"],
    "style": ["стиль", "style", "тип", "type", "категория", "category", "сорт", "вид", "класс"],
    "abv": ["abv", "крепость", "алкоголь", "alcohol", "%", "объем алкоголя", "алк.объем", "abv%"],
    "ibu": ["ibu", "горечь", "bitterness", "горькость"],
    "price": ["цена", "price", "стоимость", "cost", "руб", "рублей", "цена за", "цена/шт", "цена за шт", "цена за единицу", "цена руб", "цена (руб)", "стоимость руб", "сумма", "сумма руб", "цена за литр"],
    "currency": ["валюта", "currency", "вал"],
    "volume": ["объём", "volume", "литр", "литров", "л", "ml", "мл", "литраж", "объем", "объем упаковки", "объем тары", "объем (л)", "литраж (л)"],
    "format_type": ["формат", "format", "упаковка", "packaging", "тара", "фасовки", "тип фасовки", "фасовка", "тип упаковки", "формат упаковки", "тип тары", "упаковка/формат", "кол-во в уп"],
    "stock": ["остаток", "stock", "наличие", "availability", "в наличии", "количество на складе", "склад"],
    "supplier_name": ["поставщик", "supplier", "компания", "компания-поставщик"],
    "description": ["описание", "description", "опис", "desc", "комментарий", "comment", "примечание"],
}
# The first words that the older heading rule looks for: fixed values.
HEADINGS = ["наименование пивоварни", "пивоварня", "производитель", "brewery", "manufacturer", "бренд", "brand", "марка", "название", "пиво"]
LAYERS = ["global", "supplier", "exact_file", "manual"]
WEIGHTS = {"manual": 1.5, "exact_file": 1.35, "supplier": 1.35, "global": 1.35}


def glob_matches(name: Column, pattern: Column) -> Column:
    """A file name against a pattern with * and ?, without regard to case; an empty pattern matches all."""
    literal = F.regexp_replace(F.lower(pattern), r"([.\\+()\[\]{}^$|])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    return (F.coalesce(pattern, F.lit("")) == "") | F.regexp_like(F.lower(name), regex)


def merged_layers(layers: DataFrame) -> DataFrame:
    """(field, keywords, weight) from rows (layer, field, keyword): the union of all layers and the weight of the strongest."""
    weight = F.coalesce(*[F.when(F.col("layer") == k, F.lit(w)) for k, w in WEIGHTS.items()], F.lit(1.0))
    return layers.groupBy("field").agg(F.array_sort(F.collect_set(F.lower(F.trim("keyword")))).alias("keywords"), F.max(weight).alias("weight"))


def learned(feedback: DataFrame) -> DataFrame:
    """Layer rows from accepted feedback (supplier_id, source_column, suggested_field, accepted)."""
    return feedback.where("accepted").select(F.when(F.col("supplier_id").isNull(), "global").otherwise("supplier").alias("layer"), F.col("suggested_field").alias("field"), F.lower(F.trim("source_column")).alias("keyword")).distinct()


def keyword_list(text: Column) -> Column:
    """Words of a list parted by commas or semicolons."""
    return F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
