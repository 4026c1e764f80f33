"""Cleaning as files arrive: one micro-batch at a time, with a gate between them."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliowright.plans.clean import clean

CHAPTERS = "render_id bigint, novel string, text string"


def chapters(spark: SparkSession, folder: str, schema: str = CHAPTERS, files_per_batch: int = 1) -> DataFrame:
    """A stream of chapter rows from Parquet files put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start(stream: DataFrame, out: str, checkpoint: str, terms: tuple[str, ...] = (), gate: threading.Event | None = None, id_col: str = "render_id") -> StreamingQuery:
    """Clean every micro-batch into ``out/clean`` and ``out/edits``.

    The gate is waited for before each batch but the first: a batch that began is always finished.
    Each batch writes its own folder, so a batch repeated after a failure replaces what it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        if gate is not None and number > 0:
            gate.wait()
        done = clean(batch, "text", terms).persist()
        try:
            done.select(id_col, "clean_text", "error_reason").write.mode("overwrite").parquet(f"{out}/clean/batch={number}")
            done.select(id_col, F.posexplode("edits").alias("seq", "e")).select(id_col, "seq", "e.*").write.mode("overwrite").parquet(f"{out}/edits/batch={number}")
        finally:
            done.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
