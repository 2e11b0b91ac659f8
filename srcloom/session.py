"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on. The adaptive join splits partitions that turn out large, also where
# that costs another shuffle; operators/skew.py gives it joins that it can split.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Replies with a repeated key keep the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str, app: str = "srcloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as set in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share a disk, may go without.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return _own_folder()


def _own_folder() -> str:
    """A temporary folder of this process, which is gone when it ends."""
    folder = tempfile.mkdtemp(prefix="srcloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for a session's context."""
    context = spark.sparkContext
    if getattr(context, "_srcloom_sent", None) is None:
        package = os.path.dirname(os.path.abspath(__file__))
        root, name = os.path.split(package)
        context._srcloom_sent = shutil.make_archive(os.path.join(_own_folder(), name), "zip", root, name)
        context.addPyFile(context._srcloom_sent)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize in the shared folder, so that partition numbers stay what they are."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it back, for plans that use it twice.

    It outlives the executors that computed it, and its plan ends at the files.
    """
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rebalance rows when a scan has fewer splits than cores; large tables stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
