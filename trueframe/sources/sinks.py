"""Exclusive report outputs and incremental progress files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def sink_report(rows: DataFrame, report: DataFrame, folder: str) -> None:
    """Per-row predictions and the report; an existing folder is never reused.

    Both are written by the executors; nothing is gathered on the driver.
    """
    rows.write.mode("errorifexists").json(f"{folder}/predictions")
    report.write.mode("errorifexists").json(f"{folder}/report")


def sink_append_progress(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows as they arrive; the checkpoint makes a restart exact."""
    return (stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
