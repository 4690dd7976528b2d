"""Ordered scans that do not put one key's rows into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. The
functions here split each key by a *bucket*: any column that does not decrease
along the key's order (a day of a timestamp, a hash prefix, a score band).
Rows are ranked or scanned inside (key, bucket), a one-row-per-bucket summary
is scanned per key, and the summary's carry is joined back. The large side is
shuffled once, on (key, bucket), and that partitioning serves the join too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled


ROWS_PER_TASK = 4_000_000


def split_hot(df: DataFrame, keys: Sequence[str], fine: Column, out: str = "bucket",
              rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Bucket column that splits only the keys too large for one task.

    Splitting every key would close runs and sums in many tiny buckets. The
    keys above the bound are counted first (keys only, combined before the
    shuffle); there are at most rows / bound of them, and they are written out
    so that the join back is broadcast only if Spark's size threshold allows.
    """
    hot = settled(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task).select(
        *keys, F.lit(True).alias("_hot")), "hot-keys")
    if hot.isEmpty():
        return df.withColumn(out, F.lit(0).cast("long"))
    return df.join(hot, list(keys), "left").withColumn(
        out, F.when(F.col("_hot"), fine.cast("long")).otherwise(F.lit(0).cast("long"))).drop("_hot")


def _found(carry: Column, kind: str) -> Column:
    """Carry of a row's bucket; a row whose key is null has none and stops the
    job, where an inner join would have dropped it."""
    return F.coalesce(carry, F.raise_error(F.lit("null ordering key")).cast(kind))


def _local(keys: Sequence[str], bucket: str, order: Sequence[Column]):
    return W.partitionBy(*keys, bucket).orderBy(*order)


def _earlier(keys: Sequence[str], bucket: str, descending: bool):
    by = F.col(bucket).desc() if descending else F.col(bucket).asc()
    return W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)


def running_sums(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column],
                 sums: dict[str, Column], *, inclusive: bool = True, descending: bool = False) -> DataFrame:
    """Running total of each named value along the key's order."""
    local = _local(keys, bucket, order).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    carry = totals.select(*keys, bucket, *[
        F.coalesce(F.sum(f"_t_{n}").over(_earlier(keys, bucket, descending)), F.lit(0)).alias(f"_c_{n}")
        for n in sums])
    scanned = df.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_l_{n}") for n, v in sums.items()])
    joined = scanned.join(carry, [*keys, bucket], "left")
    kinds = {f.name: f.dataType.simpleString() for f in carry.schema}
    for n in sums:
        joined = joined.withColumn(n, F.col(f"_l_{n}") + _found(F.col(f"_c_{n}"), kinds[f"_c_{n}"]))
    return joined.drop(*[f"_{p}_{n}" for n in sums for p in "lc"])


def row_rank(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column],
             out: str = "rank", *, start: int = 1, descending: bool = False, total: str | None = None) -> DataFrame:
    """Dense position of each row along its key's (total) order; ``total`` also
    names a column for the key's row count."""
    local = _local(keys, bucket, order)
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    whole = [F.sum("_n").over(W.partitionBy(*keys)).alias(total)] if total else []
    carry = sizes.select(*keys, bucket, F.coalesce(
        F.sum("_n").over(_earlier(keys, bucket, descending)), F.lit(0)).alias("_before"), *whole)
    return (df.withColumn("_at", F.row_number().over(local)).join(carry, [*keys, bucket], "left")
              .withColumn(out, _found(F.col("_before"), "long") + F.col("_at") + F.lit(start - 1)).drop("_before", "_at"))


def _span(df: DataFrame, position: Column) -> tuple[int, int]:
    """The lowest position and how far the highest lies above it."""
    ends = df.agg(F.min(position).cast("long").alias("low"), F.max(position).cast("long").alias("high")).first()
    return (0, 0) if ends["low"] is None else (ends["low"], ends["high"] - ends["low"])


def prefix_sums(df: DataFrame, keys: Sequence[str], position: Column, order: Sequence[Column], sums: dict[str, Column],
                fan: int = 4096) -> DataFrame:
    """Running total (inclusive) of each named value along one long order, over as many levels as it takes.

    ``position`` is a whole number that does not decrease along the order. Blocks
    of ``fan`` positions are scanned on their own; their totals are the rows of
    the next level, whose positions are the blocks' numbers, and so on until
    every key has one block. The carries then come down again, level by level, by
    joins on (key, block). No window is wider than ``fan`` rows above the first
    level, however long the order is and however many rows one key has.
    """
    names = list(sums)
    low, wide = _span(df, position)
    levels = [df.withColumns({"_at": position.cast("long") - low, **{f"_v_{n}": v for n, v in sums.items()}})]
    while wide >= fan:
        wide //= fan
        above = levels[-1].withColumn("_block", F.floor(F.col("_at") / fan)).groupBy(*keys, "_block").agg(
            *[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in names])
        levels.append(settled(above.withColumnRenamed("_block", "_at"), "blocks"))
    carry = None
    for depth in range(len(levels) - 1, -1, -1):
        rows = levels[depth].withColumn("_block", F.floor(F.col("_at") / fan))
        inside = W.partitionBy(*keys, "_block").orderBy(*(order if depth == 0 else [F.col("_at")]))
        scanned = rows.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0)) for n in names})
        if carry is not None:
            kinds = {f.name: f.dataType.simpleString() for f in carry.schema}
            scanned = scanned.join(carry, [*keys, "_block"], "left")
            scanned = scanned.withColumns({n: F.col(n) + _found(F.col(f"_c_{n}"), kinds[f"_c_{n}"]) for n in names})
        if depth:
            # what stands before a block: its own running total without itself
            carry = scanned.select(*keys, F.col("_at").alias("_block"), *[
                (F.col(n) - F.coalesce(F.col(f"_v_{n}"), F.lit(0))).alias(f"_c_{n}") for n in names])
    return scanned.drop("_at", "_block", *[f"_v_{n}" for n in names], *[f"_c_{n}" for n in names])


def next_in_order(df: DataFrame, keys: Sequence[str], position: str, order: Sequence[str], fan: int = 4096) -> DataFrame:
    """Each row with ``_next``, the struct of ``order`` of the row behind it, over as many levels as it takes.

    Inside a block of ``fan`` positions the next row is a lead. A block's last row
    needs the first row of the next block that has any, which is the same question
    one level up, asked of one row per block.
    """
    def link(rows: DataFrame, by: list[Column], wide: int) -> DataFrame:
        """``rows`` has keys, ``_at`` up to ``wide``, and ``_first``, the struct it begins with; gives ``_next``."""
        blocked = rows.withColumn("_block", F.floor(F.col("_at") / fan))
        local = W.partitionBy(*keys, "_block").orderBy(*by)
        led = blocked.withColumn("_next", F.lead("_first").over(local))
        if wide < fan:
            return led.drop("_block")
        heads = settled(blocked.groupBy(*keys, "_block").agg(F.min("_first").alias("_first")).withColumnRenamed("_block", "_at"), "heads")
        above = link(heads, [F.col("_at")], wide // fan).select(*keys, F.col("_at").alias("_block"), F.col("_next").alias("_behind"))
        return led.join(above, [*keys, "_block"], "left").withColumn("_next", F.coalesce("_next", "_behind")).drop("_block", "_behind")

    low, wide = _span(df, F.col(position))
    start = df.withColumns({"_at": F.col(position).cast("long") - low, "_first": F.struct(*order)})
    return link(start, [F.col(c) for c in order], wide).drop("_at", "_first")


def adjacent_pairs(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str],
                   cols: Sequence[str] = ()) -> DataFrame:
    """One row per pair of neighbouring rows: ``prev`` and ``cur`` structs.

    Pairs inside a bucket come from a local lag; the pair that spans two
    buckets comes from the buckets' end rows, so nothing is joined back.
    """
    names = list(dict.fromkeys([*order, *cols]))
    local = W.partitionBy(*keys, bucket).orderBy(*order)
    seen = df.select(*keys, bucket, *names, *[F.lag(c).over(local).alias(f"_p_{c}") for c in names],
                     F.lag(F.lit(1)).over(local).isNull().alias("_head"), F.lead(F.lit(1)).over(local).isNull().alias("_tail"))
    cur, prev = F.struct(*names), F.struct(*[F.col(f"_p_{c}").alias(c) for c in names])
    inside = seen.filter(~F.col("_head")).select(*keys, prev.alias("prev"), cur.alias("cur"))
    # at most two rows of a bucket get here
    by = F.struct(*order)
    ends = seen.filter("_head or _tail").groupBy(*keys, bucket).agg(F.min_by(cur, by).alias("cur"), F.max_by(cur, by).alias("_last"))
    across = ends.select(*keys, F.lag("_last").over(W.partitionBy(*keys).orderBy(bucket)).alias("prev"), "cur")
    return inside.unionByName(across.filter(F.col("prev").isNotNull()))


def islands(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], member: Column,
            linked: Callable[[Column, Column], Column], cols: Sequence[str] = (),
            totals: dict[str, tuple[Column, str]] | None = None, keep_first: int = 0) -> DataFrame:
    """Maximal runs of neighbouring member rows whose links hold.

    ``linked(prev, cur)`` tests two neighbouring member rows given as structs
    of ``order + cols``. ``totals`` are per-run values with their merge
    ("sum", "min" or "max"). Runs are closed inside (key, bucket) first; only
    the first and last run of a bucket, member or not, are then joined up along
    the key, so the per-key step sees at most two rows per bucket.

    The local step is one sort: every window shares it, and a run's first and
    last values are plain aggregates of its marked end rows.
    """
    totals = {"n": (F.lit(1), "sum"), **(totals or {})}
    names = list(dict.fromkeys([*order, *cols]))
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    local = W.partitionBy(*keys, bucket).orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, W.currentRow)

    base = df.select(*dict.fromkeys([*keys, bucket, *names]), F.coalesce(member, F.lit(False)).alias("_in"),
                     *[c.alias(f"_v_{n}") for n, (c, _) in totals.items()])
    before = base.withColumns({
        "_was": F.lag("_in").over(local), "_tail": F.lead(F.lit(1)).over(local).isNull(),
        **{f"_p_{c}": F.lag(c).over(local) for c in names}})
    here, prev = F.struct(*names), F.struct(*[F.col(f"_p_{c}").alias(c) for c in names])
    joined = (F.col("_in") == F.col("_was")) & (~F.col("_in") | F.coalesce(linked(prev, here), F.lit(False)))
    broken = before.withColumn("_break", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).drop(*[f"_p_{c}" for c in names])
    numbered = broken.withColumns({
        "_no": F.sum("_break").over(upto), "_end": F.coalesce(F.lead("_break").over(local), F.lit(1)) == 1,
        **({"_row": F.row_number().over(local)} if keep_first else {})})
    if keep_first:
        numbered = numbered.withColumn("_seat", F.col("_row") - F.max(F.when(F.col("_break") == 1, F.col("_row"))).over(upto))
    head = F.col("_was").isNull()
    # of the rows outside runs, only a bucket's end rows say anything
    kept = numbered.filter(F.col("_in") | head | F.col("_tail"))
    begins, closes = F.col("_break") == 1, F.col("_end")
    aggs = [merge[how](f"_v_{n}").alias(n) for n, (_, how) in totals.items()]
    edges = [F.max(F.when(mark, F.col(c))).alias(f"_{side}_{c}") for side, mark in (("f", begins), ("l", closes)) for c in names]
    # an aggregate that falls back to sorting does not keep the order of its rows
    firsts = [F.array_sort(F.collect_list(F.when(F.col("_in") & (F.col("_seat") < keep_first), F.struct(*order)))).alias("firsts")] if keep_first else []
    closed = kept.groupBy(*keys, bucket, "_no", "_in").agg(
        *aggs, *edges, *firsts, F.max(head.cast("int")).alias("_head"), F.max(F.col("_tail").cast("int")).alias("_last"))
    shaped = closed.withColumns({
        "first": F.struct(*[F.col(f"_f_{c}").alias(c) for c in names]), "last": F.struct(*[F.col(f"_l_{c}").alias(c) for c in names])
    }).drop(*[f"_{x}_{c}" for x in "fl" for c in names])
    outer = (F.col("_head") == 1) | (F.col("_last") == 1)
    out = [*keys, *totals, "first", "last", *(["firsts"] if keep_first else [])]
    inner = shaped.filter(~outer & F.col("_in")).select(out)

    along = W.partitionBy(*keys).orderBy(bucket, "_no")
    earlier = lambda c: F.lag(c).over(along)
    joins = ((earlier(bucket) != F.col(bucket)) & (F.col("_in") == earlier("_in")) & (
        ~F.col("_in") | F.coalesce(linked(earlier("last"), F.col("first")), F.lit(False))))
    chained = (shaped.filter(outer)
               .withColumn("_cut", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
               .withColumn("_run", F.sum("_cut").over(along.rowsBetween(W.unboundedPreceding, 0))))
    at = F.struct(bucket, "_no")
    merged = chained.filter("_in").groupBy(*keys, "_run").agg(
        *[merge[how](n).alias(n) for n, (_, how) in totals.items()],
        F.min_by("first", at).alias("first"), F.max_by("last", at).alias("last"),
        *([F.slice(F.array_sort(F.flatten(F.collect_list("firsts"))), 1, keep_first).alias("firsts")]
          if keep_first else []))
    return inner.unionByName(merged.select(out))


def hash_bucket(digest: Column, bits: int = 12) -> Column:
    """Order-preserving bucket of a lower-case hex digest (4 bits a digit)."""
    return F.substring(digest, 1, max(1, bits // 4))


def score_bucket(score: Column, per_octave: int = 128) -> Column:
    """Order-preserving bucket of a finite score, ever finer towards 0 and 1.

    Detector scores pile up at both ends, so up to 1/2 a bucket is a fixed
    share of the distance to 0, from there on of the distance to 1, and beyond
    1 of the value; negative scores mirror that. No bucket of scores that are
    spread evenly over [0.999, 1] holds more than 1% of them.
    """
    size, n = F.abs(score), per_octave
    near_zero = F.floor(F.log2(2 * F.greatest(size, F.lit(1e-300))) * n)
    near_one = 1 + F.floor(-F.log2(2 * (1 - size)) * n)
    beyond = 60 * n + F.floor(F.log2(size) * n)
    rank = 1100 * n + F.when(size <= 0.5, near_zero).when(size < 1, near_one).otherwise(beyond)
    return F.when(score < 0, -rank).otherwise(rank)


def as_of(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Last non-null ``value`` at or before each row along its key's order."""
    local = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = df.withColumn("_v", value)
    lasts = marked.groupBy(*keys, bucket).agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
    carry = lasts.select(*keys, bucket, F.last("_last", ignorenulls=True).over(
        _earlier(keys, bucket, False)).alias("_carry"))
    return (marked.withColumn("_own", F.last("_v", ignorenulls=True).over(local)).join(carry, [*keys, bucket], "left")
            .withColumn(out, F.coalesce("_own", "_carry")).drop("_v", "_own", "_carry"))
