"""Rows a document classifier may learn from, shared by the quality and toxicity scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Labelled rows a fit may use; which ones is settled by a hash of the id.
SAMPLE = 20_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out part.

    The chosen ids are bounded in number, so they are broadcast to the scan.
    Repeated labels of one id count once, the larger of them.
    """
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("label_id")).agg(F.max(label).cast("int").alias("label")).orderBy(
        F.xxhash64("label_id"), "label_id").limit(rows)
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select(
        "doc_id", "text", "label")


def matrix(rows: DataFrame, features: Callable[[list[str]], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and a fold number of a bounded sample, in id order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": list(features(batch["text"].tolist()))})

    got = rows.mapInPandas(run, "doc_id long, label int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), width)
    ids, y = got["doc_id"].to_numpy(np.int64), got["label"].to_numpy(float)
    order = np.lexsort((*x.T, y, ids))
    fold = pd.util.hash_array(ids[order].astype(np.uint64)) % 4
    return x[order], y[order], fold


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], cut: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select("doc_id", text_of().alias("text"), held_out(F.col("doc_id")).alias("held_out"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = score(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": value,
                                "predicted": (value >= cut).astype("int32")})

    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
