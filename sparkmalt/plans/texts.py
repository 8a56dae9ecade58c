"""Free texts and pages: contacts, service phrases, styles and labels of product pages, text-line sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmalt.functions import contacts, style
from sparkmalt.operators import classify, extract
from sparkmalt.plans import bound


def found(docs: DataFrame, what: Column, name: str) -> DataFrame:
    """(doc_id, pos, name): one row per find."""
    return docs.select("doc_id", F.posexplode(what).alias("pos", name))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return bound.table(s, d, "documents")


def classified(s: SparkSession, d: str) -> DataFrame:
    """Parts as raw rows, some broken by rule, told apart as products and others."""
    c, i = F.col, F.col("p_partkey")
    rows = bound.table(s, d, "part").select(
        i.alias("id"),
        F.when(i % 4 == 0, F.lit(None)).otherwise(c("p_brand")).alias("brewery"),
        F.when(i % 5 == 0, F.lit("Наличие")).when(i % 7 == 0, F.lit("ab")).when(i % 3 == 0, F.lit("")).otherwise(c("p_name")).alias("beer_name"),
        F.when(i % 2 == 0, c("p_type")).alias("style"),
        F.when(i % 6 == 0, c("p_size").cast("string")).alias("price"),
    )
    return classify.classified(rows).groupBy("is_product").agg(F.count("*").alias("rows"), F.sum(F.length("row_text")).alias("chars"))


def sessions(s: SparkSession, d: str) -> DataFrame:
    """Text lines grouped into blocks, each opened by a line that begins with a capital 'E' and closed by a blank line."""
    lines = extract.lines_of(_docs(s, d), "doc_id", "text", blank=True)
    out = extract.sessions(lines, F.col("text").startswith("E"), ["doc_id"], "line", F.trim("text") == "")
    return out.groupBy("doc_id", "session").agg(F.count("*").alias("lines"), F.min_by("text", "line").alias("opening"))


QUERIES = {
    "contact_emails": lambda s, d: found(_docs(s, d), contacts.emails(F.col("text")), "email"),
    "contact_phones": lambda s, d: found(_docs(s, d), contacts.phones(F.col("text")), "phone"),
    "contact_links": lambda s, d: found(_docs(s, d), contacts.links(F.col("text")), "link"),
    "service_phrases": lambda s, d: found(_docs(s, d).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" Новинка, без НДС"))).otherwise(F.col("text"))), contacts.service_phrases(F.col("text")), "phrase"),
    "page_titles": lambda s, d: bound.table(s, d, "pages").select("page_id", style.page_title(F.col("html")).alias("title"), style.guessed(F.col("html")).alias("style")),
    "page_links": lambda s, d: bound.table(s, d, "pages").select("page_id", F.explode(style.page_links(F.col("html"))).alias("link")),
    "row_classes": classified,
    "line_sessions": sessions,
}
_PHONE, _LINK = "|".join(contacts.PHONES), "|".join(contacts.LINKS)
_PHRASES = " UNION ALL ".join(f"SELECT {i} AS i, '{p}' AS phrase" for i, p in enumerate(contacts.SERVICE))
_GROUPS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(h, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in style.GROUPS) + " END"
ORACLES = {
    "contact_emails": "SELECT doc_id, unnest(range(len(f)))::INT AS pos, trim(unnest(f)) AS email FROM (SELECT doc_id, regexp_extract_all(text, '" + contacts.EMAIL + "') AS f FROM documents)",
    "contact_phones": "SELECT doc_id, unnest(range(len(f)))::INT AS pos, trim(unnest(f)) AS phone FROM (SELECT doc_id, regexp_extract_all(text, '" + _PHONE + "') AS f FROM documents)",
    "contact_links": "SELECT doc_id, unnest(range(len(f)))::INT AS pos, trim(unnest(f)) AS link FROM (SELECT doc_id, regexp_extract_all(text, '" + _LINK + "') AS f FROM documents)",
    "service_phrases": f"WITH p AS ({_PHRASES}), t AS (SELECT doc_id, lower(CASE WHEN doc_id % 3 = 0 THEN text || ' Новинка, без НДС' ELSE text END) AS t FROM documents) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, phrase FROM t JOIN p ON contains(t, phrase)",
    "page_titles": f"SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, {_GROUPS} AS style FROM (SELECT *, lower(html) AS h FROM pages)",
    "page_links": "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages",
    "row_classes": """WITH r AS (SELECT p_partkey AS i, CASE WHEN i % 4 = 0 THEN '' ELSE p_brand END AS b,
        CASE WHEN i % 5 = 0 THEN 'Наличие' WHEN i % 7 = 0 THEN 'ab' WHEN i % 3 = 0 THEN '' ELSE p_name END AS n,
        CASE WHEN i % 2 = 0 THEN p_type ELSE '' END AS s, CASE WHEN i % 6 = 0 THEN p_size::VARCHAR ELSE '' END AS p FROM part)
      SELECT (n <> '' OR b <> '' OR p <> '') AND NOT (b <> '' AND n = '' AND p = '' AND s = '') AND n <> 'Наличие' AND length(n) NOT BETWEEN 1 AND 2 AS is_product,
        count(*) AS rows, sum(length(array_to_string(list_filter([b, n, s, p], lambda x: x <> ''), ' ')))::BIGINT AS chars FROM r GROUP BY 1""",
    "line_sessions": """WITH l AS (SELECT doc_id, unnest(range(len(p)))::INT AS line, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
        s AS (SELECT *, count(CASE WHEN starts_with(text, 'E') THEN 1 END) OVER w AS session, last_value(CASE WHEN starts_with(text, 'E') THEN 1 WHEN trim(text) = '' THEN 0 END IGNORE NULLS) OVER w AS opened
          FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line))
      SELECT doc_id, session, count(*) AS lines, arg_min(text, line) AS opening FROM s WHERE session > 0 AND opened = 1 GROUP BY 1, 2""",
}
