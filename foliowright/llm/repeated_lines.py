"""Problem 5: lines that one site repeats in thousands of its documents.

Duplicate documents are collapsed first: rows of a site with the same text form one cluster that
carries its number of rows and its publication dates.  Each line is then counted over the clusters it
stands in, with the rows of those clusters and their publication dates beside it.  Two readings decide:

* ``rows``: a line is excessive at ``MIN_ROWS`` rows and ``MIN_SHARE`` of the site's rows, rows of a
  cluster counted one by one, as the project states it;
* ``clusters``: a line is boilerplate at ``MIN_ROWS`` clusters on ``MIN_DATES`` dates (or hours, by ``period``) and
  ``MIN_SHARE`` of the site's clusters, so the lines of a republished article are not mistaken for it.

Only hashes travel: 64 + 32 bits of the normalised line, 64 + 32 of the text.  Rows are deduplicated
by id before anything is counted; partial sums are formed before each shuffle; the final look-up is
salted, because a site's most repeated line may stand in a third of all rows.

Defined results: null and empty texts count as rows of their site and hold no line; a null site is a
site of its own; lines without a letter never count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROWS, MIN_SHARE, MIN_DATES, SALT = 5, 0.03, 2, 16


def normal(line: Column) -> Column:
    """Lines are equal if they are so after trimming, reducing inner white space and ignoring case."""
    return F.lower(F.trim(F.regexp_replace(line, "(?U)\\s+", " ")))


def _key(line: Column) -> Column:
    n = normal(line)
    return F.struct(F.xxhash64(n).alias("a"), F.hash(n).alias("b"))


def _lines(df: DataFrame) -> DataFrame:
    """Rows with their lines' keys in order; a line without a letter has a null key."""
    keys = F.transform(F.split("text", "\n", -1), lambda x: F.when(x.rlike("\\p{L}"), _key(x)))
    return df.withColumn("keys", F.when(F.col("text").isNull(), F.array().cast("array<struct<a:bigint,b:int>>")).otherwise(keys))


def statistics(df: DataFrame, id_col: str = "render_id", site_col: str = "site", text_col: str = "text", time_col: str = "rendered_at", period: str = "day") -> DataFrame:
    """Every line key of a site with enough rows: rows, clusters and dates it stands in, the site's rows and clusters, and both decisions."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(site_col), F.lit("")).alias("site"), F.col(text_col).alias("text"), F.date_trunc(period, time_col).alias("day"))
    rows = _lines(rows).select("id", "site", "day", F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b")).alias("cluster"), F.array_distinct(F.filter("keys", lambda k: k.isNotNull())).alias("keys"))
    once = rows.groupBy("id", "site").agg(F.first("cluster").alias("cluster"), F.first("keys").alias("keys"), F.min("day").alias("day"))
    # rows of a cluster are summed per date before they meet, so a text copied a million times arrives as a few rows
    dated = once.groupBy("site", "cluster", "day").agg(F.count("*").alias("rows"), F.first("keys").alias("keys"))
    clusters = dated.groupBy("site", "cluster").agg(F.sum("rows").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.first("keys").alias("keys"))
    total = clusters.groupBy("site").agg(F.sum("rows").alias("site_rows"), F.count("*").alias("site_clusters"))
    lines = clusters.select("site", "rows", "first_day", F.explode("keys").alias("key"))
    by_day = lines.groupBy("site", "key", "first_day").agg(F.sum("rows").alias("rows"), F.count("*").alias("clusters"))
    counted = by_day.groupBy("site", "key").agg(F.sum("rows").alias("n_rows"), F.sum("clusters").alias("n_clusters"), F.count("first_day").alias("n_dates"))
    excessive = (F.col("n_rows") >= MIN_ROWS) & (F.col("n_rows") >= MIN_SHARE * F.col("site_rows"))
    own = (F.col("n_clusters") >= MIN_ROWS) & (F.col("n_dates") >= MIN_DATES) & (F.col("n_clusters") >= MIN_SHARE * F.col("site_clusters"))
    return counted.where(F.col("n_rows") >= MIN_ROWS).join(total, "site").withColumn("excessive", excessive).withColumn("boilerplate", own)


def excessive_lines(df: DataFrame, id_col: str = "render_id", site_col: str = "site", text_col: str = "text", time_col: str = "rendered_at", by: str = "rows", period: str = "day") -> DataFrame:
    """(id, line_no) of every line to remove, by ``rows`` or by ``clusters``."""
    bad = statistics(df, id_col, site_col, text_col, time_col, period).where({"rows": "excessive", "clusters": "boilerplate"}[by]).select("site", F.col("key.a").alias("a"), F.col("key.b").alias("b"))
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(site_col), F.lit("")).alias("site"), F.col(text_col).alias("text"))
    at = _lines(rows).select("id", "site", F.posexplode("keys").alias("n", "key")).where("key is not null")
    at = at.select("id", "site", F.col("key.a").alias("a"), F.col("key.b").alias("b"), (F.col("n") + 1).cast("long").alias("line_no"), F.pmod("id", F.lit(SALT)).cast("int").alias("salt"))
    return at.join(bad, ["site", "a", "b", "salt"], "left_semi").select(F.col("id").alias(id_col), "line_no").distinct()


def without_lines(df: DataFrame, id_col: str = "render_id", site_col: str = "site", text_col: str = "text", time_col: str = "rendered_at") -> DataFrame:
    """Each row once, its text without the site's repeated lines, and how many went."""
    gone = excessive_lines(df, id_col, site_col, text_col, time_col).groupBy(id_col).agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    once = df.select(id_col, site_col, text_col).dropDuplicates([id_col])
    kept = F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("gone", (i + 1).cast("long")), F.lit(False)))
    return once.join(gone, id_col, "left").select(id_col, site_col, F.array_join(kept, "\n").alias("clean_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
