"""Exclusion, overlap and set comparison joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_of

IDENTITY_KEYS = (("basename",), ("crc", "size"), ("sha256",))


#: Bits of a membership filter: 4,096 bitmaps of 4 KiB, at most 16 MiB.
FILTER_BITS = 1 << 27


def filter_bits(known: int, most: int = FILTER_BITS) -> int:
    """Bits for so many known values: at least 16 for each, a power of two, between one bitmap and ``most``."""
    return min(most, max(1 << 15, 1 << (16 * known).bit_length()))


def _bit(key: Sequence[str], bits: int) -> Column:
    """A row's bit for one identity, from 1 as the bitmap functions count; null if part of the key is."""
    whole = F.lit(True)
    for name in key:
        whole &= F.col(name).isNotNull()
    return F.when(whole, F.pmod(F.xxhash64(*key), F.lit(bits)) + 1)


def membership_filter(known: DataFrame, key: Sequence[str], bits: int = FILTER_BITS) -> DataFrame:
    """(bucket, bitmap) with one bit set for each known value of an identity.

    Bitmaps of 32,768 bits are merged before and after the shuffle, so what
    leaves a task, and the whole filter, is bounded by ``bits`` and not by the
    number of known rows.
    """
    return known.select(_bit(key, bits).alias("bit")).filter("bit is not null").groupBy(
        F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def mark_suspects(candidates: DataFrame, known: DataFrame, keys: Sequence[Sequence[str]] = IDENTITY_KEYS,
                  bits: int = FILTER_BITS, out: str = "suspect") -> DataFrame:
    """Marks candidates that may be known by some identity; an unmarked row is surely unknown.

    The filters are broadcast (their size is bounded by ``bits``), so no candidate is shuffled.
    """
    rows, hit = candidates, F.lit(False)
    for i, key in enumerate(keys):
        sieve = membership_filter(known, key, bits).select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_bitmap{i}"))
        rows = rows.withColumn(f"_bit{i}", _bit(key, bits)).withColumn(f"_bucket{i}", F.bitmap_bucket_number(f"_bit{i}"))
        rows = rows.join(F.broadcast(sieve), f"_bucket{i}", "left")
        at = F.bitmap_bit_position(f"_bit{i}")
        byte = F.conv(F.hex(F.substring(f"_bitmap{i}", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        hit |= F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.select(*candidates.columns, hit.alias(out))


def exclude_known(candidates: DataFrame, known: DataFrame, keys: Sequence[Sequence[str]] = IDENTITY_KEYS,
                  bits: int | None = None) -> DataFrame:
    """Candidates that match no registered item on any identity.

    A filter of the known values clears most candidates where they are read;
    only suspects are shuffled, once per identity, to exact anti-joins (an OR
    condition would fall back to a nested loop). Known rows are counted first to
    size the filters, unless ``bits`` is given; with more known values than
    bits nearly everything is a suspect, and the result is the same. A
    candidate with a null in an identity cannot match by it.
    """
    bits = filter_bits(known.count()) if bits is None else bits
    marked = mark_suspects(candidates, known, keys, bits, "_suspect")
    left = marked.filter("_suspect")
    for key in keys:
        left = left.join(known.select(*key).dropna().distinct(), list(key), "left_anti")
    return marked.filter("not _suspect").unionByName(left).select(*candidates.columns)


def overlap_audit(first: DataFrame, second: DataFrame, keys: Sequence[Sequence[str]] = IDENTITY_KEYS) -> DataFrame:
    """How many rows of each corpus share an identity with the other.

    Both sides are reduced to counts per key value before they meet, so a
    value held by very many rows is one row in the join.
    """
    out = None
    for key in keys:
        a = first.select(*key).dropna().groupBy(*key).agg(F.count(F.lit(1)).alias("a"))
        b = second.select(*key).dropna().groupBy(*key).agg(F.count(F.lit(1)).alias("b"))
        row = a.join(b, list(key)).agg(
            F.count(F.lit(1)).alias("shared_values"), F.coalesce(F.sum("a"), F.lit(0)).alias("first_rows"),
            F.coalesce(F.sum("b"), F.lit(0)).alias("second_rows")).withColumn("identity", F.lit("+".join(key)))
        out = row if out is None else out.unionByName(row)
    return out


def split_leakage(manifest: DataFrame, keys: Sequence[str] = ("group_id", "sha256")) -> DataFrame:
    """Group or content keys that occur in more than one split."""
    out = None
    for key in keys:
        row = manifest.groupBy(F.lit(key).alias("key"), F.col(key).alias("value")).agg(
            F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("rows")).filter("splits > 1")
        out = row if out is None else out.unionByName(row)
    return out


def set_difference(left: DataFrame, right: DataFrame, key: str = "id", fields: Sequence[str] = ()) -> DataFrame:
    """Keys on one side only, and keys whose identity fields differ."""
    a = left.select(key, F.struct(F.lit(1), *fields).alias("_a"))
    b = right.select(key, F.struct(F.lit(1), *fields).alias("_b"))
    return a.join(b, key, "full_outer").select(key, first_of(
        (F.col("_b").isNull(), "only_left"), (F.col("_a").isNull(), "only_right"),
        (~F.col("_a").eqNullSafe(F.col("_b")), "identity_differs")).alias("problem")).filter("problem is not null")


def cohort_set_equal(selected: DataFrame, cohorts: DataFrame, key: str = "id", fields: Sequence[str] = ()) -> DataFrame:
    """Per registered cohort, whether the selection is exactly it."""
    want = cohorts.groupBy("cohort").agg(F.count(F.lit(1)).alias("registered"))
    have = selected.agg(F.count(F.lit(1)).alias("selected"))
    hit = cohorts.join(selected.select(key, *[F.col(f).alias(f"_s_{f}") for f in fields]), key).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("common"),
        F.count_if(F.array_contains(F.array(*[F.col(f).eqNullSafe(F.col(f"_s_{f}")) for f in fields], F.lit(True)), False)).alias("changed"))
    return want.crossJoin(F.broadcast(have)).join(hit, "cohort", "left").fillna(0, ["common", "changed"]).withColumn(
        "equal", (F.col("registered") == F.col("selected")) & (F.col("common") == F.col("registered")) & (F.col("changed") == 0))


def case_set_match(planned: DataFrame, received: DataFrame, key: str = "id") -> DataFrame:
    """Receipts that are missing, unplanned or repeated."""
    seen = received.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return planned.select(key, F.lit(True).alias("_p")).join(seen, key, "full_outer").select(key, first_of(
        (F.col("copies").isNull(), "not_retained"), (F.col("_p").isNull(), "unplanned"),
        (F.col("copies") > 1, "duplicate")).alias("problem")).filter("problem is not null")


def union_cohorts(parts: dict[str, DataFrame]) -> DataFrame:
    """Manifests stacked with their cohort name and whether AI is expected."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("cohort", F.lit(name)).withColumn("expected_ai", F.col("label").isin("ai", "mixed"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def known_subset(known: DataFrame, excluded: DataFrame, key: str = "sha256") -> DataFrame:
    """Known values the exclusion list lacks; empty when it is complete."""
    return known.select(key).distinct().join(excluded.select(key), key, "left_anti")


def dedupe_content(rows: DataFrame, content: str = "sha256") -> DataFrame:
    """Content held under several ids."""
    return rows.groupBy(content).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


def dedupe_by_key(rows: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Latest row per key, combined before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_r")).select(key, "_r.*")


def ancestor_sets(cases: DataFrame, receipts: DataFrame, ancestors: str = "ancestors") -> DataFrame:
    """Ancestors without exactly one receipt, and receipts nobody descends from."""
    need = cases.select(F.explode(ancestors).alias("parent_id")).distinct().withColumn("_n", F.lit(True))
    have = receipts.groupBy("parent_id").agg(F.count(F.lit(1)).alias("copies"))
    return need.join(have, "parent_id", "full_outer").select("parent_id", first_of(
        (F.col("copies").isNull(), "missing_receipt"), (F.col("_n").isNull(), "unused_receipt"),
        (F.col("copies") > 1, "duplicate_receipt")).alias("problem")).filter("problem is not null")
