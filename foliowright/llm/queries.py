"""The pN_ queries: problem N's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowright.llm import language, leakage, mixing, mojibake, repeated_lines, residue, scans, sentences, sql, textforms
from foliowright.session import shared_path


def read(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet").select(*columns)


@lru_cache(4)
def _garble_model(spark: SparkSession, sf: str) -> mojibake.Model:
    samples = read(spark, sf, "lang_samples", "lang", "text").unionByName(read(spark, sf, "eval_items", "lang", "text"))
    return mojibake.fit(samples)


@lru_cache(4)
def _language_model(spark: SparkSession, sf: str) -> language.Model:
    return language.fit(read(spark, sf, "lang_samples", "lang", "text"))


# 1 visually identical text


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of build_pdf.text and edits.original holding look-alike characters, without garbled ones."""
    model = _garble_model(spark, sf)
    build = textforms.cases(read(spark, sf, "build_pdf", "render_id", "text"), "render_id", "text", "build_pdf", model)
    edits = textforms.cases(read(spark, sf, "edits", "edit_id", "original"), "edit_id", "original", "edits", model)
    return build.unionByName(edits).distinct()


def p1_unified(spark: SparkSession, sf: str) -> DataFrame:
    """Every chapter and every logged original in its consistent form: (src, row_id, unified_text)."""
    build = read(spark, sf, "build_pdf", "render_id", "text").dropDuplicates(["render_id"]).select(F.lit("build_pdf").alias("src"), F.col("render_id").alias("row_id"), "text")
    edits = read(spark, sf, "edits", "edit_id", "original").dropDuplicates(["edit_id"]).select(F.lit("edits").alias("src"), F.col("edit_id").alias("row_id"), F.col("original").alias("text"))
    return textforms.unified(build.unionByName(edits), "text").drop("text")


# 2 template residue


def _residue(spark: SparkSession, sf: str) -> residue.Residue:
    """Units of chapters and audit snippets, written once because templates and cases both read them."""

    def write(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    build = residue.scan(read(spark, sf, "build_pdf", "render_id", "text"), "render_id", "text", "build_pdf")
    edits = residue.scan(read(spark, sf, "edits", "edit_id", "context"), "edit_id", "context", "edits", cut=True)
    return residue.Residue(write(build.unionByName(edits), "residue"), write)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters and audit snippets where residue stands in place of prose."""
    return _residue(spark, sf).cases()


def p2_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Page templates, their induced slots and the slots left with a variable name, default or blank."""
    return _residue(spark, sf).templates()


# 3 wrong character encoding


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Renders with at least one garbled passage."""
    rows = mojibake.garbled_rows(read(spark, sf, "build_pdf", "render_id", "text"), _garble_model(spark, sf))
    return rows.distinct().withColumnRenamed("row_id", "render_id")


def p3_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Affected renders with their original text where nothing was lost."""
    src = read(spark, sf, "build_pdf", "render_id", "text")
    out = mojibake.restore(src, _garble_model(spark, sf)).dropDuplicates(["row_id"])
    return out.withColumnRenamed("row_id", "render_id").withColumn("whole", F.col("n_restored") == F.col("n_spans"))


# 4 sentences


def _ebooks(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "build_pdf", "render_id", "medium", "text").where("medium = 'ebook'").select("render_id", "text")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Where each sentence of the ebook renders ends."""
    return sentences.ends(_ebooks(spark, sf))


def p4_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Every render as its sentences in reading order."""
    return sentences.sentences(read(spark, sf, "build_pdf", "render_id", "text"))


# 5 lines repeated across a site


def _web(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "build_pdf", "render_id", "site", "medium", "text", "rendered_at").where("medium = 'web'")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines to remove from web renders."""
    return repeated_lines.excessive_lines(_web(spark, sf))


def p5_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of web renders that many of their site's articles hold, republished ones counted once."""
    return repeated_lines.excessive_lines(_web(spark, sf), by="clusters", period="hour")  # small tables span one day


def p5_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Web renders without the lines their site repeats."""
    return repeated_lines.without_lines(_web(spark, sf))


# 6 scanned pages


def _scans(spark: SparkSession, sf: str) -> scans.Analysis:
    return scans.Analysis(spark, read(spark, sf, "build_pdf", "render_id", "medium", "novel", "text"), read(spark, sf, "lang_samples", "lang", "text"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Furniture, cut words and misread words of scans, by line."""
    return _scans(spark, sf).found()


def p6_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Scans as continuous, corrected paragraphs."""
    return _scans(spark, sf).repaired()


# 7 evaluation texts


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the items they leak."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    return leakage.matches(spark, docs, read(spark, sf, "eval_items", "item_id", "lang", "text")).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The longest leaked passage of each document and item, with its places."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    return leakage.matches(spark, docs, read(spark, sf, "eval_items", "item_id", "lang", "text"))


def p7_proximity(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a passage of an item in which a few words differ."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    return leakage.near_matches(spark, docs, read(spark, sf, "eval_items", "item_id", "lang", "text"))


# 8 mixing


def _mix(spark: SparkSession, sf: str, by: str = "targets") -> mixing.Mix:
    return mixing.Mix(spark, read(spark, sf, "documents", "doc_id", "source", "text"), read(spark, sf, "mix_targets", "mix_name", "source", "target_share", "max_repeats"), by=by)


def p8_draws(spark: SparkSession, sf: str) -> DataFrame:
    """The documents each mix draws and how often."""
    return _mix(spark, sf).draws()


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Reached shares beside the targets."""
    return _mix(spark, sf).report()


def p8_temperature(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached by temperature alone: exponents bisected to the targets' entropy within the repetition limits."""
    return _mix(spark, sf, "temperature").report()


# 9 languages


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of documents whose label is missing or wrong, or whose paragraphs are of several languages."""
    docs = read(spark, sf, "documents", "doc_id", "text", "lang")
    return language.mislabelled(language.documents(docs, _language_model(spark, sf))).distinct()


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every paragraph of every document."""
    return language.segments(read(spark, sf, "documents", "doc_id", "text"), _language_model(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_unified, p2_found, p2_templates, p3_found, p3_restored, p4_found, p4_sentences, p5_found, p5_boilerplate, p5_cleaned, p6_found, p6_repaired, p7_found, p7_matches, p7_proximity, p8_draws, p8_report, p8_temperature, p9_found, p9_segments)
}
ORACLES: dict[str, str] = {"p5_found": sql.P5_FOUND, "p5_boilerplate": sql.P5_BOILERPLATE, "p5_cleaned": sql.P5_CLEANED}
