"""Audit rows: what each rule removed or changed, as an array of structs in pipeline order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowright.functions import text as T

ENTRY = "struct<original:string,replacement:string,rule:string,category:string,context:string>"
NONE = f"array<{ENTRY}>"


def entry(original: Column, replacement: Column, rule: Column, category: str, context: Column) -> Column:
    return F.struct(
        original.alias("original"), replacement.alias("replacement"), rule.alias("rule"), F.lit(category).alias("category"), T.snippet(context).alias("context")
    )


def empty() -> Column:
    return F.array().cast(NONE)


def only(condition: Column, e: Column) -> Column:
    return F.when(condition, F.array(e)).otherwise(empty())


def removals(text: Column, pattern: str, rule: str) -> Column:
    """One entry per match, with an empty replacement; blank matches leave none."""
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: T.strip(x) != "")
    return F.transform(found, lambda x: entry(x, F.lit(""), F.lit(rule), "fingerprint", x))


def markers(text: Column) -> Column:
    """One entry per marker, however often it stands."""
    hits = F.filter(F.array(*[F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in T.MARKERS]), lambda x: x.isNotNull())
    return F.transform(hits, lambda x: entry(x, F.lit(""), F.lit("junk_strip.marker"), "fingerprint", x))


def summary(count: Column, rule: str, category: str, note: str) -> Column:
    """One row with the number of places, if there are any."""
    return only(count > 0, entry(F.concat(count.cast("string"), F.lit(" occurrence(s)")), F.lit(note), F.lit(rule), category, F.lit(note)))


def effective(entries: Column) -> Column:
    """Entries that change something."""
    return F.filter(entries, lambda e: e["original"] != e["replacement"])


def edit_count(entries: Column) -> Column:
    """Entries other than flags."""
    return F.size(F.filter(effective(entries), lambda e: e["category"] != "integrity_flag")).cast("long")


def rows(df: DataFrame, id_col: str, entries_col: str = "edits") -> DataFrame:
    """(id, seq, original, replacement, rule, category, context), seq from 0."""
    return df.select(id_col, F.posexplode(effective(F.col(entries_col))).alias("seq", "e")).select(id_col, "seq", "e.*")


def jsonl(df: DataFrame, id_col: str, metadata: Column | None = None) -> DataFrame:
    """(id, line_no, line): JSON lines with the run's header first, in order."""
    body = rows(df, id_col).select(id_col, (F.col("seq") + 1).cast("long").alias("line_no"), F.to_json(F.struct("original", "replacement", "rule", "category", "context")).alias("line"))
    if metadata is None:
        return body
    return df.select(id_col, F.lit(0).cast("long").alias("line_no"), F.to_json(metadata).alias("line")).unionByName(body)
