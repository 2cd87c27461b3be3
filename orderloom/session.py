"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_Result = TypeVar("_Result")

# Steps that do not depend on each other are submitted together; Spark shares out the slots.
CONCURRENT_STEPS = 4

# Settings the plans in this library are written for.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Delimited files may come in any character set Java knows, such as cp1252.
    "spark.sql.legacy.javaCharsets": "true",
}


def build_session(app_name: str = "orderloom", **conf: str) -> SparkSession:
    """Session with the defaults above; master and sizing come from spark-submit or ``conf``.

    The number of shuffle partitions is left to the deployment: AQE merges small partitions, so it
    should be set for the largest shuffle (about 200 MB per partition), not for the smallest.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder named by ``spark.checkpoint.dir``, or else beside the warehouse.

    Both are folders that the driver and all executors share; a local disk is used only where the
    session itself was set up with one.
    """
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch data of this application; frames that were built on it end with it."""
    remove_folder(spark, _scratch_root(spark))


def _scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch"
    )
    return f"{root.rstrip('/')}/orderloom/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, for frames several plans start from.

    The written table cuts the lineage: what is built on it outlives the executors that made it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *steps: Callable[[], _Result]) -> list[_Result]:
    """Results of steps that do not depend on each other, in the order given.

    The tasks of one fill the slots that the last or few tasks of another leave idle.
    """
    with ThreadPoolExecutor(CONCURRENT_STEPS) as pool:
        return list(pool.map(lambda step: inheritable_thread_target(spark)(step)(), steps))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the session's file system; one that is not there is fine."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
