"""Line, paragraph and page relations: the sequential passes as window queries.

Each takes (id, text) and explodes once; every window is over one document, so one exchange by id
serves all of them.  Null and empty texts have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliowright.functions import text as T


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line), from 1."""
    at = df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("n", "line"))
    return at.select(id_col, (F.col("n") + 1).cast("long").alias("line_no"), "line")


def paragraph_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, para_no, paragraph): wrapped lines gathered by a running count of breaks."""
    order = Window.partitionBy(id_col).orderBy("line_no")
    x = lines(df, id_col, text_col).withColumn("line", T.strip(F.col("line")))
    prev = F.lag("line").over(order)
    fresh = prev.isNull() | (prev == "") | F.col("line").rlike(T.HEADING_START) | prev.rlike(T.HEADING_START) | (prev.rlike(r"""[.!?…:]["'’”)\]]*$""") & ~F.col("line").rlike(r"^\p{IsLowercase}"))
    x = x.withColumn("fresh", (fresh & (F.col("line") != "")).cast("int"))
    x = x.withColumn("para_no", F.sum("fresh").over(order).cast("long")).where("line <> ''")
    parts = x.groupBy(id_col, "para_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))  # as many as one paragraph has lines
    return parts.select(id_col, "para_no", F.array_join(F.transform("parts", lambda p: p["line"]), " ").alias("paragraph"))


def doubled_headings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line) of heading lines that repeat an earlier one."""
    x = lines(df, id_col, text_col).withColumn("line", T.strip(F.col("line"))).where(F.startswith(F.lower("line"), F.lit("chapter ")))
    n = F.row_number().over(Window.partitionBy(id_col, "line").orderBy("line_no"))
    return x.withColumn("n", n).where("n > 1").drop("n")


def numbered_headings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, heading_no, line): heading lines with their number in the document, as they are set aside before repairs."""
    x = lines(df, id_col, text_col).where(F.col("line").rlike(T.HEADING_START))
    return x.withColumn("heading_no", F.row_number().over(Window.partitionBy(id_col).orderBy("line_no")).cast("long"))


def duplicate_titles(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, para_no, chapter) of heading paragraphs whose number came before."""
    ps = df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n\n", -1)).alias("n", "p"))
    number = F.regexp_extract(T.strip(F.col("p")), T.HEADING_PARAGRAPH, 1)
    x = ps.select(id_col, (F.col("n") + 1).cast("long").alias("para_no"), F.replace(number, F.lit(","), F.lit("")).alias("chapter"), number.alias("raw")).where("raw <> ''").drop("raw")
    rank = F.row_number().over(Window.partitionBy(id_col, "chapter").orderBy("para_no"))
    return x.withColumn("r", rank).where("r > 1").drop("r")


def pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, page_no, n_lines): pages begin at every heading after the first."""
    order = Window.partitionBy(id_col).orderBy("line_no")
    head = F.startswith(F.lower(T.strip(F.col("line"))), F.lit("chapter ")).cast("int")
    x = lines(df, id_col, text_col).withColumn("page_no", F.greatest(F.sum(head).over(order), F.lit(1)).cast("long"))
    return x.groupBy(id_col, "page_no").agg(F.count("*").alias("n_lines"))
