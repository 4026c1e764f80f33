"""Inputs: folder and upload scans, page text, term files, editing notes, rosters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowright.functions import naming as N
from foliowright.functions import text as T


def scan_upload(paths: DataFrame, path_col: str = "path", order_col: str = "seq") -> DataFrame:
    """The PDFs of an upload in the caller's order."""
    return paths.where(N.is_pdf(F.col(path_col))).orderBy(order_col)


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, rank) of all PDFs below a folder, own files before subfolders, in natural order; a missing root raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root).select("path")
    return in_natural_order(files, "path")


def in_natural_order(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Paths sorted on a derived key; the sort is distributed, no rank needs one task."""
    return paths.withColumn("natural_key", N.natural_key(F.col(path_col))).orderBy("natural_key", path_col)


def missing(requested: DataFrame, present: DataFrame, path_col: str = "path") -> DataFrame:
    return requested.join(present.select(path_col), path_col, "left_anti")


def page_text(pages: DataFrame, id_col: str, page_col: str, text_col: str) -> DataFrame:
    """One text per document from its pages in order, pages without text left out."""
    full = pages.where(T.strip(F.col(text_col)) != "")
    parts = F.array_sort(F.collect_list(F.struct(page_col, text_col)))  # as many as one document has pages
    return full.groupBy(id_col).agg(parts.alias("p")).select(id_col, F.array_join(F.transform("p", lambda x: x[text_col]), "\n").alias("text"))


def extract_pdfs(files: DataFrame) -> DataFrame:
    """(path, text, error) of binary PDFs, where a PDF reader is installed; a broken file gives an error, not a failure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        try:
            import pdfplumber
        except ImportError:
            pdfplumber = None
        for b in batches:
            texts, errors = [], []
            for content in b.column(1).to_pylist():
                text, error = None, None
                try:
                    if pdfplumber is None:
                        raise RuntimeError("no PDF reader is installed")
                    with pdfplumber.open(io.BytesIO(content)) as pdf:
                        text = "\n".join(t for t in (p.extract_text(x_tolerance=5, y_tolerance=3) for p in pdf.pages) if t)
                except Exception as e:  # noqa: BLE001 - one bad file must not end the batch
                    error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def term_file(spark: SparkSession, path: str, profile: str) -> DataFrame:
    """(profile, term) of a term file: lines with # comments, or JSON; a missing or broken file has none."""
    from foliowright.operators.lexicon import cleaned, from_json

    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    json = path.lower().endswith(".json")
    try:
        text = spark.read.text(path, wholetext=json).select(F.lit(profile).alias("profile"), F.col("value").alias("json" if json else "term"))
    except (AnalysisException, Py4JJavaError):  # no such file
        return spark.createDataFrame([], "profile string, term string")
    return cleaned(from_json(text, "json") if json else text)


def notes(universal: DataFrame, layers: DataFrame, novels: DataFrame, novel_col: str = "novel") -> DataFrame:
    """(novel, combined, universal_only): the base notes (name, text) with the novel's layer, if one matches its name."""
    base = F.lit(universal.agg(F.max("text")).first()[0] or "")  # one row by the aggregate, one text
    own = layers.select(N.norm_key(F.regexp_replace("name", r"(?i)\.md$", "")).alias("key"), F.col("text").alias("layer")).where("key <> 'universal'").groupBy("key").agg(F.min("layer").alias("layer"))
    d = novels.withColumn("key", N.norm_key(F.coalesce(F.col(novel_col), F.lit("")))).join(own, "key", "left")
    combined = T.strip(F.concat_ws("\n\n", F.nullif(base, F.lit("")), "layer"))
    return d.select(novel_col, combined.alias("combined"), F.col("layer").isNull().alias("universal_only"))


def roster(index_files: DataFrame, reg: DataFrame, name_col: str = "index_filename") -> DataFrame:
    """(position, entry): the universal entry, then every novel with an index file by name, marked where it has no profile."""
    shown = index_files.where(F.col(name_col).isNotNull() & F.lower(name_col).endswith(".txt")).select(N.display_name(F.col(name_col)).alias("name")).distinct()
    d = shown.withColumn("norm_key", N.norm_key(F.col("name"))).join(reg.select("norm_key", "profile"), "norm_key", "left")
    entries = d.select(F.lit(1).alias("group"), "name", F.when(F.col("profile").isNull(), F.concat("name", F.lit(N.NO_PROFILE))).otherwise(F.col("name")).alias("entry"))
    first = index_files.sparkSession.createDataFrame([(0, N.UNIVERSAL, N.UNIVERSAL)], "group int, name string, entry string")
    return first.unionByName(entries).select("group", "name", "entry")
