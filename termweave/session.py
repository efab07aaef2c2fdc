"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def build_session(app_name: str = "termweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Adaptive execution turns a shuffle join into a broadcast join only after the
    small side has been *measured*, and splits skewed join partitions, so the
    library gives no unconditional broadcast hints.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends the package to the workers, once per application, so that their Python can import it."""
    name = f"{os.path.basename(PACKAGE)}.zip"
    path = os.path.join(SparkFiles.getRootDirectory(), f"sent-{name}")
    if not os.path.exists(path):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, files in os.walk(PACKAGE):
                for file in files:
                    if file.endswith(".py"):
                        full = os.path.join(folder, file)
                        archive.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
        spark.sparkContext.addPyFile(path)
    return spark


def _prepare_checkpoints(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    else:  # the warehouse is shared too; only where nothing was set, as in tests
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def scratch_path(spark: SparkSession) -> str:
    """A new, unused path below the shared checkpoint folder."""
    _prepare_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write `df` below the shared checkpoint folder and read it back, which cuts its lineage.

    Used where a result is read more than once and must not change between the
    reads (range partitions, loop frontiers). A written table survives the loss of
    any executor, and later plans see its true size instead of an estimate that
    grows with every join. It is deleted by `release`, or when the session ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def release(*tables: DataFrame) -> None:
    """Delete tables made by `durable` that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
