"""Helpers the training-data operators share."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a maximal run of bytes outside the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows in one Arrow batch: whole texts travel, so a batch is kept to a few megabytes.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Let closures carry this package, so executors need no installed copy, and
    bound the batches that go to Python workers."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share.

    Only a local master may do without that setting: there the session's own
    warehouse folder serves, since driver and tasks are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back.

    The lineage is cut, several readers compute it once, and its size on disk
    lets Spark's own threshold decide whether a join may broadcast it.
    """
    folder = shared(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def text_of(col: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def blank_split(text: str) -> list[str]:
    """Words of a text: maximal runs outside the six ASCII white-space characters."""
    for blank in "\t\n\r\v\f":
        if blank in text:
            text = text.replace(blank, " ")
    words = text.split(" ")
    return [w for w in words if w] if "" in words else words
