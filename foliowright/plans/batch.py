"""Batches: dispatch to profiles, statuses of inputs, summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowright.functions import naming as N
from foliowright.functions import text as T


def registry(cases: DataFrame) -> DataFrame:
    """(norm_key, profile, display_name, index_filename): novels with a profile, from a table of spellings."""
    known = cases.where("has_profile and profile is not null").select(N.norm_key(F.col("input_name")).alias("norm_key"), "profile", T.strip(F.col("input_name")).alias("display_name"))
    one = known.groupBy("norm_key", "profile").agg(F.max("display_name").alias("display_name"))
    return one.withColumn("index_filename", N.index_filename(F.col("display_name")))


def dispatch(df: DataFrame, novel_col: str, reg: DataFrame) -> DataFrame:
    """Add norm_key, profile, display_name, index_filename, has_profile and pipeline; names without a profile are universal."""
    key = N.norm_key(F.coalesce(F.col(novel_col), F.lit("")))
    r = reg.withColumnRenamed("display_name", "_display").withColumnRenamed("index_filename", "_index")  # broadcast if its measured size allows
    d = df.withColumn("norm_key", key).join(r, "norm_key", "left")
    shown = F.coalesce(F.nullif(T.strip(F.col(novel_col)), F.lit("")), F.lit(N.UNIVERSAL))
    d = d.withColumn("has_profile", F.col("profile").isNotNull()).withColumn("display_name", F.coalesce("_display", shown))
    d = d.withColumn("index_filename", F.coalesce("_index", N.index_filename(F.col(novel_col)))).drop("_display", "_index")
    return d.withColumn("pipeline", F.coalesce("profile", F.lit("universal"))).withColumn("mode", F.when(F.col("has_profile"), "novel-profile").otherwise("universal-only"))


def statuses(inputs: DataFrame) -> DataFrame:
    """Inputs with their status: succeeded, failed, or skipped and why; one fails without touching another."""
    missing = ~F.coalesce(F.col("file_exists"), F.lit(False))
    status = F.when(missing, "skipped (not found)").when(F.col("raises").isNotNull(), "failed").when(T.low_confidence(F.col("text")), "skipped (image-only/empty)").otherwise("succeeded")
    return inputs.withColumn("status", status)


def summaries(states: DataFrame, run_col: str = "run_id") -> DataFrame:
    """(run, total, succeeded, failed, skipped); the three add up to the total."""
    n = lambda c: F.sum(c.cast("long")).alias
    s = F.col("status")
    return states.groupBy(run_col).agg(F.count("*").alias("total"), n(s == "succeeded")("succeeded"), n(s == "failed")("failed"), n(F.startswith(s, F.lit("skipped")))("skipped"))
