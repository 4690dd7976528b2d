"""Embedding-sequence operators.

A clip is rows (clip_id, frame_no, embedding) with frame_no counted from 0.
Neighbours are found inside blocks of frames that carry a small halo of the
next block's first frames, so a clip of any length is one shuffle over many
tasks and nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1024


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def scaled(vector: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    size = norm(vector)
    return F.transform(vector, lambda x: x / F.when(size == 0, 1.0).otherwise(size))


def ahead(frames: DataFrame, reach: int = 1, column: str = "embedding") -> DataFrame:
    """Each frame with the next ``reach`` vectors as next_1, next_2, ..."""
    block = F.floor(F.col("frame_no") / BLOCK)
    owners = F.when((F.col("frame_no") % BLOCK < reach) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    haloed = frames.withColumn("_own", block).withColumn("_block", F.explode(owners))
    order = W.partitionBy("clip_id", "_block").orderBy("frame_no")
    out = haloed.select("*", *[F.lead(column, k).over(order).alias(f"next_{k}") for k in range(1, reach + 1)])
    return out.filter("_own = _block").drop("_own", "_block")


def frame_deltas(frames: DataFrame, absolute: bool = False) -> DataFrame:
    """Difference to the next frame. Signed: the last frame has none.
    Absolute: the last frame's row is zero."""
    both = ahead(frames)
    a, b = as_doubles(F.col("embedding")), as_doubles(F.col("next_1"))
    if absolute:
        delta = F.coalesce(F.zip_with(a, b, lambda x, y: F.abs(y - x)), F.transform(a, lambda x: F.lit(0.0)))
        return both.withColumn("delta", delta).drop("next_1")
    return both.filter("next_1 is not null").withColumn("delta", minus(b, a)).drop("next_1")


def velocity_jerk(frames: DataFrame) -> DataFrame:
    """First and second differences of a sequence and their lengths."""
    three = ahead(frames, 2).filter("next_1 is not null")
    x, y, z = (as_doubles(F.col(c)) for c in ("embedding", "next_1", "next_2"))
    return three.withColumn("velocity", minus(y, x)).withColumn(
        "acceleration", minus(minus(z, y), F.col("velocity"))).withColumns(
        {"speed": norm(F.col("velocity")), "jerk": norm(F.col("acceleration"))}).drop("next_1", "next_2")


def l2_normalize(frames: DataFrame, column: str = "embedding") -> DataFrame:
    return frames.withColumn("unit", scaled(as_doubles(F.col(column))))


def second_order_std(frames: DataFrame) -> DataFrame:
    """Negated sample deviation of the change in neighbour distance, per clip."""
    three = ahead(frames, 2).filter("next_2 is not null")
    x, y, z = (as_doubles(F.col(c)) for c in ("embedding", "next_1", "next_2"))
    change = norm(minus(z, y)) - norm(minus(y, x))
    return three.groupBy("clip_id").agg((-F.stddev_samp(change)).alias("score"), F.count(F.lit(1)).alias("changes"))


def frame_mean_score(scores: DataFrame, expected: int = 8) -> DataFrame:
    """Mean frame logit; strictly above zero is positive. A clip with another
    number of finite frames is an error, not a score."""
    finite = F.when(~F.isnan("logit") & (F.abs("logit") < float("inf")), F.col("logit"))
    return scores.groupBy("clip_id").agg(F.count(finite).alias("frames"), F.avg(finite).alias("m")).select(
        "clip_id", "frames", F.when(F.col("frames") == expected, F.col("m")).alias("score"),
        F.when(F.col("frames") != expected, "error").when(F.col("m") > 0, "ai").otherwise("not_ai").alias("decision"))


def one_frame_per_clip(frames: DataFrame, salt: str = "fit-v1:") -> DataFrame:
    """The frame with the smallest hash of each clip; combined before the shuffle."""
    rank = F.sha2(F.concat(F.lit(salt), F.col("clip_id").cast("string"), F.lit(":"), F.col("frame_no").cast("string")), 256)
    return frames.groupBy("clip_id").agg(F.min_by(F.struct("frame_no", "embedding"), rank).alias("f")).select(
        "clip_id", "f.*")


def vector_agreement(pairs: DataFrame, max_abs: float = 3e-3, max_rel: float = 1e-3) -> DataFrame:
    """Largest difference and relative length of the difference of paired vectors."""
    a, b = as_doubles(F.col("first")), as_doubles(F.col("second"))
    delta = minus(a, b)
    return pairs.withColumns({
        "max_abs": F.array_max(F.transform(delta, F.abs)),
        "rel_l2": norm(delta) / F.greatest(norm(a), F.lit(1e-12))}).withColumn(
        "passed", (F.col("max_abs") <= max_abs) & (F.col("rel_l2") <= max_rel))


class Whitening:
    """Mean, projection and kept eigenvalues of a fitted transform (D x D, driver-sized)."""

    def __init__(self, mean: np.ndarray, matrix: np.ndarray, eigenvalues: np.ndarray):
        self.mean, self.matrix, self.eigenvalues = mean, matrix, eigenvalues


def moments(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Count, sums and cross products as (pos, value) rows, one set per task,
    added up by position: the shuffle carries D*D numbers per task, not rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross, count = np.zeros(dim), np.zeros((dim, dim)), 0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(-1, dim)
            count += len(rows)
            total += rows.sum(axis=0)
            cross += rows.T @ rows
        values = np.concatenate([[count], total, cross.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["pos", "value"])

    sums = vectors.select(as_doubles(F.col(column)).alias("v")).mapInArrow(partial, "pos long, value double")
    return sums.groupBy("pos").agg(F.sum("value").alias("value"))


def whitening_fit(vectors: DataFrame, dim: int, column: str = "embedding") -> Whitening:
    """Eigen-decomposition of the sample covariance; D*D + D + 1 numbers reach the driver."""
    got = moments(vectors, dim, column).toPandas().set_index("pos")["value"].sort_index().to_numpy()
    count, total, cross = got[0], got[1:dim + 1], got[dim + 1:].reshape(dim, dim)
    mean = total / count
    covariance = (cross - count * np.outer(mean, mean)) / (count - 1)
    values, basis = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][: int(min(count - 1, dim))]
    order = order[values[order] > 0]
    if not len(order):
        raise ValueError("no positive eigenvalue")
    return Whitening(mean, basis[:, order] / np.sqrt(values[order] + 1e-5), values[order])


def whitened_loglik(vectors: DataFrame, fit: Whitening, column: str = "embedding", out: str = "loglik") -> DataFrame:
    """Gaussian log-likelihood of each whitened vector; batched in Arrow."""
    shared = vectors.sparkSession.sparkContext.broadcast((fit.mean, fit.matrix))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mean, matrix = shared.value
        base = matrix.shape[1] * np.log(2 * np.pi)
        for part in parts:
            if not len(part):
                yield pd.Series([], dtype=float)
                continue
            white = (np.stack(part.to_numpy()).astype(np.float64) - mean) @ matrix
            yield pd.Series(-0.5 * (base + (white ** 2).sum(axis=1)))

    return vectors.withColumn(out, score(as_doubles(F.col(column))))


def unit_deltas(frames: DataFrame) -> DataFrame:
    """Direction of each step; a step of length zero is kept and marked."""
    return frame_deltas(frames).withColumns({"unit": scaled(F.col("delta")), "still": norm(F.col("delta")) == 0})


def spatial_temporal_agg(frames: DataFrame, spatial: Whitening, temporal: Whitening) -> DataFrame:
    """Largest frame likelihood and smallest step likelihood of each clip; a
    still step carries no information and never wins the minimum. A clip of one
    frame has no step: its temporal value is null and the problem is named."""
    still = whitened_loglik(frames, spatial).groupBy("clip_id").agg(F.max("loglik").alias("spatial"))
    steps = whitened_loglik(unit_deltas(frames), temporal, "unit")
    moving = steps.groupBy("clip_id").agg(F.min(F.when(F.col("still"), float("inf")).otherwise(F.col("loglik"))).alias("temporal"))
    return still.join(moving, "clip_id", "left").withColumn(
        "problem", F.when(F.col("temporal").isNull(), "too_few_frames"))


def percentile_score(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean of the spatial and temporal percentile against reference clips.

    Both tables are read several times: pass written ones. Clips without a
    temporal value are left to their error row.
    """
    scores, reference = (df.filter(F.col("temporal").isNotNull()) for df in (scores, reference))
    from .ranking import calibration_rank
    a = calibration_rank(scores.select("clip_id", F.col("spatial").alias("score")), reference.select(F.col("spatial").alias("score")))
    b = calibration_rank(scores.select("clip_id", F.col("temporal").alias("score")), reference.select(F.col("temporal").alias("score")))
    return a.select("clip_id", F.col("percentile").alias("spatial")).join(
        b.select("clip_id", F.col("percentile").alias("temporal")), "clip_id").withColumn(
        "score", 0.5 * (F.col("spatial") + F.col("temporal")))


def batch_logits(frames: DataFrame, head: dict[str, np.ndarray], column: str = "embedding") -> DataFrame:
    """Logit of each clip by a small fixed head (layer norm, linear, GELU,
    linear) applied to every frame, maximum over frames. One non-finite frame
    rejects the clip. Frames are scored where they lie; only maxima move."""
    shared = frames.sparkSession.sparkContext.broadcast(head)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.stack(part.to_numpy()).astype(np.float64) if len(part) else np.zeros((0, len(shared.value["scale"])))
            yield pd.Series(head_logits(x, shared.value))

    scored = frames.withColumn("_l", score(as_doubles(F.col(column))))
    finite = ~F.isnan("_l") & (F.abs("_l") < float("inf"))
    return scored.groupBy("clip_id").agg(F.max("_l").alias("m"), F.count_if(~finite | F.col("_l").isNull()).alias("bad")).select(
        "clip_id", F.when(F.col("bad") == 0, F.col("m")).alias("logit"))


def head_logits(x: np.ndarray, h: dict[str, np.ndarray]) -> np.ndarray:
    """(frames, width) -> (frames,)."""
    centred = x - x.mean(-1, keepdims=True)
    normed = centred / np.sqrt((centred ** 2).mean(-1, keepdims=True) + 1e-5) * h["scale"] + h["shift"]
    hidden = normed @ h["w1"] + h["b1"]
    # exact GELU: x * Phi(x), with Phi from the error function
    active = hidden * 0.5 * (1 + erf(hidden / np.sqrt(2.0)))
    return active @ h["w2"] + h["b2"]


def erf(x: np.ndarray) -> np.ndarray:
    """Error function by its all-positive series exp(-x^2) sum 2^n x^(2n+1) / (2n+1)!!, which is 1 to the last digit past 6."""
    inside = np.clip(np.nan_to_num(x), -6.0, 6.0)
    term, total, n = inside.copy(), inside.copy(), 0
    while n < 160 and np.any(np.abs(term) > 1e-17 * np.abs(total)):
        n += 1
        term = term * (2 * inside * inside / (2 * n + 1))
        total += term
    return np.where(np.isnan(x), np.nan, 2 / np.sqrt(np.pi) * np.exp(-inside * inside) * total)


def feature_splice(hosts: DataFrame, donors: DataFrame, pairs: DataFrame, length: int = 2) -> DataFrame:
    """Host frames with ``length`` frames from ``start`` on taken from the donor."""
    host = pairs.join(hosts.select(F.col("clip_id").alias("host_id"), "frame_no", F.col("embedding").alias("_h")), "host_id")
    donor = donors.select(F.col("clip_id").alias("donor_id"), "frame_no", F.col("embedding").alias("_d"))
    inside = F.col("frame_no").between(F.col("start"), F.col("start") + (length - 1))
    return host.join(donor, ["donor_id", "frame_no"], "left").withColumns({
        "spliced": inside, "embedding": F.when(inside, F.col("_d")).otherwise(F.col("_h"))}).drop("_h", "_d")
