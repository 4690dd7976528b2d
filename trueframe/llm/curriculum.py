"""Mixing of sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1, piecewise linear
between knots. Its integral, scaled to the source's target, is the cumulative
token demand of the source; a document that stands at word ``c`` of its
source's stream gets the training position at which the demand reaches ``c``.
Sorting by position interleaves all sources as their schedules ask.

Defined results. Null text: size 0. Null source: a source of its own, last in
code-point order. Null ids order first. Repeated rows are separate documents.
A source without words has target 0. An empty table gives an empty result.
Other columns of the input are ignored, whatever their names.

The order of a source's documents is the MD5 of the id. It is cut into 4,096
buckets by the first three digits, so no source is one window: rows are summed
inside (source, bucket), the buckets' sums are scanned per source, and the
carry is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, text_of, written

#: One schedule per weight class: (time, weight) knots; weights are relative to each other inside a schedule.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)
BUCKET_DIGITS = 3


def position(fraction: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the schedule has spent ``fraction`` of its integral."""
    spans = [(t0, w0, t1 - t0, (w1 - w0) / (t1 - t0)) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    areas = [d * (w0 + m * d / 2) for _, w0, d, m in spans]
    whole, before, out = sum(areas), 0.0, None
    for (t0, w0, _, m), area in zip(spans, areas):
        left = F.greatest(fraction * whole - before, F.lit(0.0))
        at = t0 + F.when(left <= 0, 0.0).otherwise(2 * left / (w0 + F.sqrt(w0 * w0 + 2 * m * left)))
        out = at if out is None else F.when(fraction * whole < before, out).otherwise(at)
        before += area
    return F.least(out, F.lit(1.0))


def targets(sources: DataFrame, share: float, repeats: float, weights: Sequence[float]) -> DataFrame:
    """Adds weight class and target to one row per source (source, source_size).

    Sharing by weight with every target stopped at ``repeats`` times its source
    is water-filling: with sources in rising order of cap per weight, the level
    is the largest of (what the smaller caps leave) / (weight still open).
    """
    ranked = sources.withColumn("class", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("class") + 1).cast("int")))
    ranked = ranked.withColumn("cap", repeats * F.col("source_size"))
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("class"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    spent = F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = share * F.sum("source_size").over(every)
    levelled = ranked.withColumn("level", (total - spent) / open_weight)
    return levelled.select("source", "source_size", "class", F.least(
        F.col("cap"), F.max("level").over(every) * F.col("weight")).alias("target"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size in words, order key and text hash."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("order_key"),
        F.xxhash64(text).alias("text_hash"))


def takes(rows: DataFrame, *, share: float = 1.5, repeats: float = 2.0, weights: Sequence[float] = (5, 2, 1),
          schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """``sized`` rows with source_size, target, ``copies`` and the ``positions`` of the copies.

    A source with target T and size S gives floor(T / S) passes over all its
    documents; the rest of T goes to the documents first in order, the last of
    them if more than half of it fits.
    """
    rows = rows.withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.coalesce(F.sum("bucket_size").over(
        W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carry = buckets.select("source", "bucket", before.alias("before"))
    shares = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, repeats, weights)
    carry = carry.alias("b").join(shares.alias("s"), F.expr("b.source <=> s.source")).select(
        F.col("b.source").alias("carry_source"), F.col("bucket").alias("carry_bucket"), "before", "source_size", "class", "target")
    local = F.coalesce(F.sum("size").over(
        W.partitionBy("source", "bucket").orderBy("order_key", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("local", local).join(
        carry, F.expr("source <=> carry_source AND bucket = carry_bucket")).withColumn("start", F.col("before") + F.col("local"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    extra = ((F.col("source_size") > 0) & (2 * F.col("start") + F.col("size") <= 2 * rest)).cast("long")
    placed = placed.withColumn("passes", passes).withColumn("copies", F.col("passes") + extra)

    def at(copy: Column) -> Column:
        done = F.when(F.col("target") > 0, (copy * F.col("source_size") + F.col("start")) / F.col("target")).otherwise(F.lit(0.0))
        out = position(F.least(done, F.lit(1.0)), schedules[0])
        for number, knots in list(enumerate(schedules))[1:]:
            out = F.when(F.col("class") == number, position(F.least(done, F.lit(1.0)), knots)).otherwise(out)
        return out

    return placed.withColumn("positions", F.when(F.col("copies") > 0, F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))).select(
        "doc_id", "source", "size", "text_hash", "source_size", "target", "copies", "positions")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training stream: the documents' columns, one row per copy, range-sorted by position.

    Documents the mix does not take are absent, those it repeats come again at
    a later position. Rows of equal id, source and text are numbered, by their
    other columns here and by their positions there, and joined one to one, so
    each keeps its own columns and appears as often as it was taken.
    """
    key = ["mix_id", "mix_source", "mix_text"]
    alike = W.partitionBy(*key)
    plan = takes(written(sized(docs), "sized"), **options).select(
        F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("text_hash").alias(key[2]), "positions")
    plan = plan.withColumn("mix_no", F.row_number().over(alike.orderBy("positions")))
    # the row travels as one column, whatever its columns are called
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(whole.alias("mix_row"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_hash"),
                        F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.xxhash64(text_of()).alias(key[2]))
    keyed = keyed.withColumn("mix_no", F.row_number().over(alike.orderBy("mix_hash"))).drop("mix_hash")
    joined = keyed.alias("d").join(plan.alias("p"), F.expr(" AND ".join(f"d.{k} <=> p.{k}" for k in [*key, "mix_no"])))
    placed = joined.select("mix_row", F.explode("positions").alias("mix_position")).sort("mix_position")
    return placed.select(*[F.col("mix_row").getField(c).alias(c) for c in docs.columns])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """One row per document with the words the mix takes, in order of first position."""
    # what the mix leaves out follows, spread by hash so that no range holds it all
    left_out = 1 + F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 20)) / (1 << 20)
    return takes(written(sized(docs), "sized"), **options).sort(F.coalesce(F.try_element_at("positions", F.lit(1)), left_out)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
