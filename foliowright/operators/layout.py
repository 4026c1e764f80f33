"""The page and paragraph model of an output document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowright.functions import text as T

# The longest heading, the four patterns of headings, and what an empty page says.
MAX_HEADING = 500
EXACT = r"(?iUd)^Chapter\s+\d[\d,]*:\s*.*?[.?!]\s*$"
LOOSE = r"(?iUd)^Chapter\s+\d[\d,]*:\s*.*?[.?!]?\s*$"
WITH_QUOTE = r"""(?iUd)^(Chapter\s+\d+:\s*[^"'“‘\n]+)\s+(["'“‘].*)"""
WITH_SENTENCE = r"(?iUd)^(Chapter\s+\d+:\s*.+?)\s+([A-Z][^.]+\.\s+.*)"
NOTHING = "(no extractable text)"


def is_heading(c: Column) -> Column:
    x = T.strip(c)
    return (F.length(x) <= MAX_HEADING) & x.rlike(EXACT)


def _parts(p: Column) -> Column:
    """The parts of a paragraph: (kind, text); a heading merged with body becomes two."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    head = F.when(p.rlike(WITH_QUOTE), F.regexp_extract(p, WITH_QUOTE, 1)).when(p.rlike(WITH_SENTENCE), F.regexp_extract(p, WITH_SENTENCE, 1))
    body = F.when(p.rlike(WITH_QUOTE), F.regexp_extract(p, WITH_QUOTE, 2)).when(p.rlike(WITH_SENTENCE), F.regexp_extract(p, WITH_SENTENCE, 2))
    head = F.regexp_replace(head, r"(?U)\s+$", "")
    head = F.when(head.rlike(r"[.?!]$"), head).otherwise(F.concat(head, F.lit(".")))
    merged = head.isNotNull() & (F.length(head) <= MAX_HEADING)
    two = F.filter(F.array(part("heading", head), part("body", T.strip(body))), lambda x: x["text"] != "")
    return F.when(is_heading(p), F.array(part("heading", p))).when(merged, two).otherwise(F.array(part("body", p)))


def layout(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, page_no, para_no, part_no, kind, text); a document without text has the one marker paragraph."""
    full = lambda x: T.strip(x) != ""
    sheets = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\f", -1), full)
    page = df.select(id_col, F.posexplode_outer(sheets).alias("page", "sheet"))
    paras = F.filter(F.split("sheet", "\n\n", -1), full)
    para = page.select(id_col, "page", F.posexplode_outer(paras).alias("para", "p"))
    flat = T.strip(F.regexp_replace("p", r"(?U)\s+", " "))
    part = para.select(id_col, "page", "para", F.posexplode(F.when(F.col("p").isNull(), F.array(F.struct(F.lit("body").alias("kind"), F.lit(NOTHING).alias("text")))).otherwise(T.let(flat, _parts))).alias("part", "x"))
    number = lambda c: (F.coalesce(F.col(c), F.lit(0)) + 1).cast("long")
    return part.select(id_col, number("page").alias("page_no"), number("para").alias("para_no"), number("part").alias("part_no"), F.col("x.kind").alias("kind"), F.col("x.text").alias("text"))


def heading_only(text: Column) -> Column:
    """array<int>: numbers of the pages whose only line is a heading, in a text of two pages or more."""

    def of(sheets: Column) -> Column:
        def lone(sheet: Column, i: Column) -> Column:
            rows = F.filter(F.transform(F.split(sheet, "\n", -1), T.strip), lambda x: x != "")
            return F.when((F.size(rows) == 1) & F.get(rows, F.lit(0)).rlike(LOOSE), i + 1)

        return F.when(F.size(sheets) >= 2, F.filter(F.transform(sheets, lone), lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>"))

    return T.let(F.filter(F.split(text, "\f", -1), lambda x: T.strip(x) != ""), of)


def heading_only_pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, page_no) of pages whose only line is a heading, in documents of two pages or more; nothing is removed."""
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(F.transform(heading_only(F.col(text_col)), lambda x: x.cast("long"))).alias("page_no"))
