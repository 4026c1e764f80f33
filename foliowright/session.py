"""Session building and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "foliowright", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the queries are written for; on a cluster use your own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.driver.memory": "8g", "spark.sql.files.maxPartitionBytes": "16m",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``; only where that is unset, as in tests, a local one.

    Tables written there are intermediate results: they are read by later stages, also after executors are lost.  All of an
    application lie in one folder, which ``remove_shared`` takes away; it runs by itself when the driver's Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "foliowright")
        os.makedirs(root.removeprefix("file://"), exist_ok=True)
    folder = f"{root.rstrip('/')}/foliowright-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(remove_shared, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_FOLDERS: set[str] = set()


def remove_shared(spark: SparkSession, folder: str | None = None) -> None:
    """Delete the intermediate tables of an application; results that are not yet computed need them."""
    for f in {folder} if folder else set(_FOLDERS):
        if f.startswith("file://"):
            shutil.rmtree(f.removeprefix("file://"), ignore_errors=True)
            continue
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may have ended first
            pass


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than cores, as one small file has; no other input is shuffled.

    It changes where rows are worked on, never which.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, for sessions whose workers do not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="foliowright-"), "foliowright.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("foliowright", os.path.relpath(path, root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
