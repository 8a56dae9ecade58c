"""Repair of rows whose fields landed in the wrong columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmalt.functions.text import clean, clean_name, description_like, is_empty, name_like, settled, upper_title, word_count
from sparkmalt.sources.shared import written


def fields_repaired(rows: DataFrame) -> DataFrame:
    """Rows with brewery, beer_name and description put right one by one; of the rules that end the repair the first wins."""
    c = F.col
    lines = F.filter(F.transform(F.split(clean(c("description")), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    out = settled(rows, {"__name": clean(c("beer_name")), "__text": clean(c("description")), "__style": clean(c("style")), "__brewery": clean(c("brewery")), "__lines": lines})
    title = clean_name(F.coalesce(F.get(c("__lines"), F.lit(0)), F.lit("")))
    body = F.trim(F.array_join(F.slice("__lines", 2, F.greatest(F.size("__lines") - 1, F.lit(1))), " "))
    words = F.filter(F.split(c("__brewery"), r"\s+"), lambda w: w != "")
    out = settled(out, {"__title": title, "__body": body, "__words": words, "__swapped": description_like(c("__name")) & name_like(c("__text"))})
    # a first line that is a name, over a description
    titled = (c("__title") != "") & name_like(c("__title")) & description_like(c("__body")) & (is_empty(c("__name")) | description_like(c("__name")))
    out = settled(out, {"__titled": titled})
    out = settled(out, {"__name1": F.when(c("__titled"), c("__title")).otherwise(c("__name")), "__text1": F.when(c("__titled"), c("__body")).otherwise(c("__text"))})
    only_text = is_empty(c("__name1")) & name_like(c("__text1"))
    is_style = (c("__name1") != "") & (c("__style") != "") & (F.lower("__name1") == F.lower("__style")) & name_like(c("__text1"))
    both = (c("__brewery") != "") & (is_empty(c("__name1")) | (c("__brewery") == c("__name1"))) & upper_title(c("__brewery")) & (F.size("__words") >= 2)
    out = settled(out, {"__ends": only_text | is_style, "__both": both})
    name2 = F.when(c("__both"), F.array_join(F.slice("__words", 2, F.greatest(F.size("__words") - 1, F.lit(1))), " ")).otherwise(c("__name1"))
    out = settled(out, {"__name2": name2, "__brewery2": F.when(c("__both"), c("__words")[0]).otherwise(c("__brewery"))})
    out = settled(out, {"__long": description_like(c("__name2")) & (c("__title") != "") & name_like(c("__title"))})
    out = settled(out, {"__name3": F.when(c("__long"), c("__title")).otherwise(c("__name2")), "__text3": F.when(c("__long") & (c("__body") != ""), c("__body")).otherwise(c("__text1"))})
    paragraph = description_like(c("__brewery2")) & name_like(c("__name3"))
    out = settled(
        out,
        {
            "beer_name": F.when(c("__swapped"), c("__text")).when(c("__ends"), c("__text1")).otherwise(c("__name3")),
            "description": F.when(c("__swapped"), c("__name")).when(c("__ends"), c("__text1")).otherwise(c("__text3")),
            "brewery": F.when(c("__swapped") | c("__ends"), c("__brewery")).otherwise(F.when(paragraph, F.lit("")).otherwise(c("__brewery2"))),
        },
    )
    return out.drop(*[x for x in out.columns if x.startswith("__") and x not in rows.columns])


def repaired(rows: DataFrame, key: str = "file_id", crowded: bool = False) -> DataFrame:
    """Rows repaired one by one; in files whose brewery column looks like names, breweries of rows without a name become names.

    With ``crowded`` files may have more rows than a task should see: their
    breweries are then counted in partial sums, and the verdict is joined.
    """
    brewery = F.when(~is_empty(F.col("brewery")), clean(F.col("brewery")))
    long = (word_count(brewery) >= 3) | (F.length(brewery) > 25)
    if crowded:
        rows = written(rows, "rows")
        names = rows.groupBy(F.struct(key).alias("__file"), brewery.alias("__b")).agg(F.count(brewery).alias("n"), F.count(F.when(long, 1)).alias("long"))
        files = names.groupBy("__file").agg((F.count("__b") > 0.7 * F.sum("n")).alias("varied"), (F.sum("long") > 0.3 * F.sum("n")).alias("long"))
        verdict = files.select("__file", (F.col("varied") & F.col("long")).alias("__doubtful"))
        judged = rows.withColumn("__file", F.struct(key)).join(verdict, "__file").drop("__file")
    else:
        w = Window.partitionBy(key)
        filled = F.count(brewery).over(w)
        judged = rows.withColumn("__doubtful", (F.size(F.collect_set(brewery).over(w)) > 0.7 * filled) & (F.count(F.when(long, 1)).over(w) > 0.3 * filled))
    out = fields_repaired(judged)
    moved = F.col("__doubtful") & (F.col("brewery") != "") & is_empty(F.col("beer_name"))
    return settled(out, {"beer_name": F.when(moved, F.col("brewery")).otherwise(F.col("beer_name")), "brewery": F.when(moved, F.lit("")).otherwise(F.col("brewery"))}).drop("__doubtful")
