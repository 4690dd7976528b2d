"""Session settings every job relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from functools import cache

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a repeated name in a JSON object keeps its last value, as common readers do
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the results depend on.

    The package is also marked to travel with its closures, so executors need
    no installed copy of it.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", app: str = "trueframe") -> SparkSession:
    """A one-process session for tests and benches, with a fresh folder of its own as the shared one."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", _own_folder(app))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the folder that ``spark.checkpoint.dir`` names.

    All executors must share it. Only a local master, where the driver runs
    every task, may leave the setting out; a folder is then made for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _own_folder(application: str) -> str:
    """A local folder for one process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many tasks as there are cores.

    For scans of few, small files ahead of heavy per-row work; a scan that is
    already split that far is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settled(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back.

    For a result that several branches of one job use: it is computed once, a
    lost executor does not undo it, and its size on disk lets Spark decide by
    its own threshold whether a join may broadcast it.
    """
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
