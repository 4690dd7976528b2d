"""Source-group bootstrap on sufficient counts.

Every resampled metric is a ratio of sums, so rows are reduced to one count
vector per group first; a replicate is a set of group multiplicities. Four
ways to draw them:

* ``split``, the default: counts are split down a tree of group cells, so
  multiplicities arise beside the vectors and no draw is a row (``splitting``).
* ``addressed``: draw (replicate, slot) is a hash of its address; repeatable in
  any engine and on any partitioning. Draws are made and counted as arrays and
  meet their groups by ranges of ordinals, as those of ``lcg`` do.
* ``lcg``: the 32-bit congruential sequence of the published results, each
  state computed from its draw number by modular powers, so no draw waits for
  the one before it.
* ``multinomial``: groups with equal count vectors are interchangeable, so a
  replicate is one multinomial draw over the distinct vectors. Its work grows
  with the number of distinct vectors and not with the number of groups.

The caller names the method; the number of groups never changes it. Below two
groups there is nothing to resample and the interval is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import completed, is_positive, truthy
from ..functions.stats import ratio
from ..session import settled
from .metrics import RATES, outcome_flags
from .ordered import hash_bucket, row_rank, score_bucket
from .splitting import split_histograms, split_sums

MULTIPLIER, INCREMENT, MODULUS = 1664525, 1013904223, 1 << 32
#: Rotations of the four rounds of MD5.
TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
#: Ordinals in a range (two bytes), replicates in a block, slots drawn at once, replicates counted at once.
RANGE, BLOCK, SLOTS, SLAB = 32_768, 500, 8192, 16
#: Rows of one range that a task takes.
ROWS = 262_144

VECTOR = ("completed", "tp", "fn", "fp", "tn", "abstained_ai", "abstained_non_ai", "high", "high_wrong")


def group_vectors(df: DataFrame, sums: dict[str, Column], first_seen: Column | None = None) -> DataFrame:
    """One row per group with its sums and a dense ordinal from 0.

    The ordinal follows ``first_seen`` (the order of appearance) when given,
    else the hash of the group, whose prefix splits the ranking evenly.
    """
    aggs = [v.alias(k) for k, v in sums.items()]
    if first_seen is not None:
        grouped = df.groupBy("group_id").agg(*aggs, F.min(first_seen).alias("_seen"))
        ranked = row_rank(grouped.withColumn("band", F.floor(F.col("_seen") / 65536)), [], "band",
                          [F.col("_seen")], "ordinal", start=0)
        return settled(ranked.drop("band", "_seen"), "vectors")
    grouped = df.groupBy("group_id").agg(*aggs).withColumn("_h", F.md5("group_id"))
    ranked = row_rank(grouped.withColumn("band", hash_bucket(F.col("_h"))), [], "band",
                      [F.col("_h"), F.col("group_id")], "ordinal", start=0)
    return settled(ranked.drop("band", "_h"), "vectors")


def lcg_states(numbers: np.ndarray, seed: int) -> np.ndarray:
    """State of the congruential sequence after ``numbers`` steps."""
    mask = np.uint64(MODULUS - 1)
    scale, shift = np.ones(len(numbers), np.uint64), np.zeros(len(numbers), np.uint64)
    a, c = np.uint64(MULTIPLIER), np.uint64(INCREMENT)
    left = numbers.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        shift = np.where(odd, (shift * a + c) & mask, shift)
        scale = np.where(odd, (scale * a) & mask, scale)
        c = (c * a + c) & mask
        a = (a * a) & mask
        left >>= np.uint64(1)
    return (scale * np.uint64(seed) + shift) & mask


def md5_heads(prefix: bytes, numbers: np.ndarray) -> np.ndarray:
    """First 60 bits of the MD5 of ``prefix`` and each number in decimal.

    All numbers have equally many digits, and a text stays below 56 bytes, which
    is one block; each of its steps is then one array operation over all texts.
    """
    digits = len(str(int(numbers[0])))
    size = len(prefix) + digits
    text = [*prefix, *[(numbers // 10 ** k % 10 + 48).astype(np.uint32) for k in range(digits - 1, -1, -1)], 128,
            *[0] * (55 - size), *(8 * size).to_bytes(8, "little")]
    words = [sum((byte << (8 * k) for k, byte in enumerate(text[at:at + 4])), start=0) for at in range(0, 64, 4)]
    start = [np.full(len(numbers), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        if i < 16:
            mixed, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, at = c ^ (b | ~d), 7 * i % 16
        mixed += a
        constant = int(abs(math.sin(i + 1)) * MODULUS)
        if isinstance(words[at], int):
            constant = (constant + words[at]) % MODULUS
        else:
            mixed += words[at]
        mixed += np.uint32(constant)
        turn = TURNS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + (mixed << turn | mixed >> (32 - turn))
    high, low = ((x + y).byteswap().astype(np.int64) for x, y in zip((a, b), start))
    return (high << 28) | (low >> 4)


def addressed(seed: int, replicate: int, slots: np.ndarray, groups: int) -> np.ndarray:
    """Group that each of the consecutive ``slots`` of a replicate draws."""
    tens = 10 ** np.arange(1, 19)
    parts = np.split(slots, np.searchsorted(slots, tens[(tens > slots[0]) & (tens <= slots[-1])]))
    return np.concatenate([md5_heads(f"{seed}:{replicate}:".encode(), part) for part in parts]) % groups


def congruential(seed: int, replicate: int, slots: np.ndarray, groups: int) -> np.ndarray:
    states = lcg_states(replicate * groups + slots + 1, seed).astype(float)
    return np.floor(states / MODULUS * groups).astype(np.int64)


DRAW = {"addressed": addressed, "lcg": congruential}


def draws(spark: SparkSession, groups: int, replicates: int, seed: int, method: str) -> DataFrame:
    """Every draw, packed: a row holds those of ``SLOTS`` slots and ``BLOCK`` replicates that fall in one range of ordinals.

    ``counts`` are the draws per replicate (int32) and ``seats`` their places in
    the range (uint16), replicate by replicate: two bytes a draw.
    """
    if method not in DRAW:
        raise ValueError(f"unknown draw method: {method}")
    blocks, draw = -(-replicates // BLOCK), DRAW[method]
    units = blocks * -(-groups // SLOTS)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in (u for batch in batches for u in batch["id"].tolist()):
            first, low = unit % blocks * BLOCK, unit // blocks * SLOTS
            slots = np.arange(low, min(low + SLOTS, groups))
            rows = [np.sort(draw(seed, r, slots, groups)) for r in range(first, min(first + BLOCK, replicates))]
            cuts = np.array([np.searchsorted(row, np.arange(0, groups + RANGE, RANGE)) for row in rows])
            counts, seats = np.diff(cuts).astype("<i4"), [(row % RANGE).astype("<u2") for row in rows]
            met = np.flatnonzero(counts.any(axis=0))
            yield pd.DataFrame({
                "range": met, "first": first, "counts": [counts[:, q].tobytes() for q in met],
                "seats": [b"".join(row[i:j] for row, i, j in zip(seats, cuts[:, q].tolist(), cuts[:, q + 1].tolist())) for q in met]})

    ids = spark.range(0, units, 1, max(1, min(units, 4096)))
    return ids.mapInPandas(pack, "range long, first long, counts binary, seats binary")


def multiplicities(counts: Sequence[bytes], seats: Sequence[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first replicate, replicates x seats) of one range and block, in slabs of replicates."""
    many = [np.frombuffer(c, "<i4") for c in counts]
    ends = [np.cumsum(np.concatenate([[0], m])) for m in many]
    places = [np.frombuffer(s, "<u2") for s in seats]
    for low in range(0, len(many[0]), SLAB):
        high = min(low + SLAB, len(many[0]))
        flat = np.concatenate([p[e[low]:e[high]] + np.repeat(np.arange(high - low) * width, m[low:high])
                               for m, e, p in zip(many, ends, places)])
        yield low, np.bincount(flat, minlength=(high - low) * width).reshape(high - low, width)


def met_draws(rows: DataFrame, groups: int, replicates: int, seed: int, method: str, work: Callable, schema: str) -> DataFrame:
    """``work`` gets the rows of a range of ordinals, as (table, slabs of multiplicities of one block of replicates).

    Rows and packed draws meet by a shuffle on (range, block). A range with more
    than ``ROWS`` rows is dealt over several tasks, each of which gets its draws.
    """
    names, width = [c for c in rows.columns if c != "ordinal"], min(RANGE, groups)
    dealt = rows.select(F.floor(F.col("ordinal") / RANGE).cast("long").alias("range"),
                        (F.col("ordinal") % RANGE).cast("int").alias("seat"), *names)
    # Spark takes packed draws for as small as the numbers they are made from and would broadcast them; ranges are one row in RANGE groups
    sizes = F.broadcast(settled(dealt.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("long").alias("parts")), "ranges"))
    cells = dealt.join(sizes, "range").withColumn("part", F.pmod(F.xxhash64(*names), F.col("parts"))).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"), F.lit(BLOCK).cast("long"))))
    packed = draws(rows.sparkSession, groups, replicates, seed, method).join(sizes, "range").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        drawn = whole.filter(pc.is_valid(whole["seats"]))
        mine = whole.filter(pc.is_valid(whole["seat"])).combine_chunks()
        if drawn.num_rows and mine.num_rows:
            first = key[2].as_py()
            slabs = multiplicities(drawn["counts"].to_pylist(), drawn["seats"].to_pylist(), width)
            yield from work(mine, ((first + low, times) for low, times in slabs))

    both = packed.drop("parts").unionByName(cells.drop("parts"), allowMissingColumns=True)
    return both.groupBy("range", "part", "first").applyInArrow(run, schema)


def drawn_sums(vectors: DataFrame, names: Sequence[str], replicates: int, seed: int, method: str) -> DataFrame:
    """Sums of ``names`` per replicate. Whole numbers below 2^53 are exact."""
    kinds = {f.name: f.dataType for f in vectors.schema}
    whole = {n: isinstance(kinds[n], (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) for n in names}

    def work(mine: pa.Table, slabs: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        seat = mine["seat"].to_numpy()
        matrix = np.column_stack([pc.fill_null(mine[n].cast(pa.float64()), 0.0).to_numpy() for n in whole])
        for at, times in slabs:
            total = times[:, seat].astype(float) @ matrix
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + len(total))), *[pa.array(t.astype(np.int64) if whole[n] else t) for n, t in zip(whole, total.T)]],
                ["replicate", *whole])

    schema = "replicate long, " + ", ".join(f"`{n}` {'long' if whole[n] else 'double'}" for n in whole)
    parts = met_draws(vectors.select("ordinal", *names), vectors.count(), replicates, seed, method, work, schema)
    return parts.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in names])


def drawn_histograms(cells: DataFrame, groups: int, replicates: int, seed: int, method: str) -> DataFrame:
    """Weighted positives and negatives per replicate and score, from rows (ordinal, score, pos, neg)."""
    kind = cells.schema["score"].dataType.simpleString()

    def work(mine: pa.Table, slabs: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        coded = mine["score"].combine_chunks().dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        seat, *sides = (mine[n].to_numpy()[order] for n in ("seat", "pos", "neg"))
        for at, times in slabs:
            taken = times[:, seat]
            pos, neg = (np.add.reduceat(taken * side, starts, axis=1) for side in sides)
            replicate, score = np.nonzero(pos | neg)
            yield pa.RecordBatch.from_arrays(
                [pa.array(replicate + at), coded.dictionary.take(pa.array(score)), pa.array(pos[replicate, score]), pa.array(neg[replicate, score])],
                ["replicate", "score", "pos", "neg"])

    parts = met_draws(cells.select("ordinal", "score", "pos", "neg"), groups, replicates, seed, method, work,
                      f"replicate long, score {kind}, pos long, neg long")
    return parts.groupBy("replicate", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _multinomial(vectors: DataFrame, names: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Replicate sums from one multinomial draw each over the distinct vectors.

    Distinct vectors are split into numbered cells; the group count of a cell
    in a replicate is itself multinomial, so cells are drawn level by level and
    no task needs more than one cell's vectors.
    """
    kinds = vectors.groupBy(*names).agg(F.count(F.lit(1)).alias("groups"))
    cells = kinds.withColumn("cell", F.pmod(F.xxhash64(*names), F.lit(1024)))
    sizes = [(r["cell"], r["n"]) for r in cells.groupBy("cell").agg(F.sum("groups").alias("n")).collect()]  # <= 1024
    sizes.sort()
    total = sum(n for _, n in sizes)
    share = np.array([n for _, n in sizes], float) / max(total, 1)
    index = {c: i for i, (c, _) in enumerate(sizes)}

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cell = int(part["cell"].iloc[0])
            weights = part["groups"].to_numpy(float)
            matrix = part[list(names)].to_numpy(float)
            out = np.zeros((replicates, len(names)))
            for r in range(replicates):
                per_cell = np.random.default_rng([seed, r]).multinomial(total, share)
                taken = np.random.default_rng([seed, r, cell + 1]).multinomial(
                    int(per_cell[index[cell]]), weights / weights.sum())
                out[r] = taken @ matrix
            frame = pd.DataFrame(out, columns=list(names))
            frame.insert(0, "replicate", np.arange(replicates))
            yield frame

    schema = "replicate long, " + ", ".join(f"{n} double" for n in names)
    one_cell = cells.groupBy("cell").applyInPandas(lambda part: next(draw(iter([part]))), schema)
    return one_cell.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in names])


def replicate_sums(vectors: DataFrame, names: Sequence[str], replicates: int, seed: int,
                   method: str = "split") -> DataFrame:
    if method == "split":
        return split_sums(vectors, names, replicates, seed)
    if method == "multinomial":
        return _multinomial(vectors, names, replicates, seed)
    return drawn_sums(vectors, names, replicates, seed, method)


def percentile_interval(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Order statistics at floor(.025 n) and floor(.975 n); at most one value per replicate."""
    kept = values.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(value)).alias("v")) if keys else values.filter(
        F.col(value).isNotNull()).agg(F.sort_array(F.collect_list(value)).alias("v"))
    n = F.size("v")
    at = lambda q: F.get("v", F.least(n - 1, F.floor(n * q)).cast("int"))
    return kept.select(*keys, n.cast("long").alias("valid_replicates"), at(0.025).alias("low"), at(0.975).alias("high"))


def resampled(vectors: DataFrame) -> DataFrame:
    """The settled vectors, or none of them where there are fewer than two groups."""
    return vectors if vectors.limit(2).count() == 2 else vectors.limit(0)


def cluster_bootstrap(df: DataFrame, replicates: int = 1000, seed: int = 5149304, method: str = "split",
                      first_seen: Column | None = None) -> DataFrame:
    """Percentile interval of every rate; undefined replicates are left out and counted."""
    flagged = outcome_flags(df)
    names = ["attempted", *VECTOR]
    vectors = group_vectors(flagged, {"attempted": F.count(F.lit(1)), **{c: F.sum(f"is_{c}") for c in VECTOR}},
                            first_seen)
    sums = replicate_sums(resampled(vectors), names, replicates, seed, method)
    long = sums.select("replicate", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rate"), ratio(F.expr(top), F.expr(base)).alias("estimate"))
        for name, (top, base) in RATES.items()])).alias("r")).select("replicate", "r.*")
    found = percentile_interval(long, ["rate"], "estimate")
    every = vectors.limit(1).select(F.explode(F.array(*[F.lit(name) for name in RATES])).alias("rate"))
    return every.join(found, "rate", "left").withColumn("valid_replicates", F.coalesce("valid_replicates", F.lit(0).cast("long")))


def score_bands(cells: DataFrame, bands: int) -> DataFrame:
    """Adds ``band``, from 0 along the distinct scores: one score each while there are no more than ``bands`` of them."""
    scores = settled(row_rank(cells.select("score").distinct().withColumn("_b", score_bucket(F.col("score"))), [], "_b",
                              [F.col("score")], "at", start=0).drop("_b"), "scores")
    wide = max(1, -(-scores.count() // bands))
    return cells.join(scores.select("score", F.floor(F.col("at") / wide).cast("long").alias("band")), "score")


def auroc_bootstrap(df: DataFrame, replicates: int = 1000, seed: int = 1937303, method: str = "split",
                    score: str = "score", first_seen: Column | None = None, bands: int = 4096) -> DataFrame:
    """Interval of AUROC over group resamples, from counts per group and score.

    ``split`` sums multiplicities into score bands inside tasks. While there are
    no more than ``bands`` distinct scores each is its own band and the AUROC of a
    replicate is exact; beyond, scores of one band count as ties, which moves it
    by at most half the share of positive-negative pairs that meet in a band,
    about 1 / (2 bands) where scores do not repeat. The other methods keep every
    score: they cost two shuffled bytes for each of replicates x groups draws, and
    a row for each replicate, range of ordinals and distinct score in it.
    """
    vectors = group_vectors(df, {"n": F.count(F.lit(1))}, first_seen).select("group_id", "ordinal")
    pos = is_positive(F.col("label"))
    cells = settled(df.groupBy("group_id", F.col(score).alias("score")).agg(
        F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg")).join(vectors, "group_id").drop("group_id"), "cells")
    groups = resampled(vectors).count()
    if method == "split":
        banded = score_bands(cells, bands)
        weighted = split_histograms(banded if groups else banded.limit(0), groups, replicates, seed).withColumnRenamed("band", "score")
    else:
        weighted = drawn_histograms(cells, groups, replicates, seed, method)
    from .ranking import auroc_from_counts
    return percentile_interval(auroc_from_counts(weighted, ["replicate"]), [], "auroc")


def paired_bootstrap(pairs: DataFrame, replicates: int = 10_000, seed: int = 9183327, method: str = "split",
                     first_seen: Column | None = None) -> DataFrame:
    """Interpolated 2.5/97.5% of the recall difference over positive pairs.

    ``pairs`` has group_id, label and the decision/error of both runs.
    """
    hit = lambda side: truthy(completed(F.col(f"{side}_error"), F.col(f"{side}_decision"))
                              & (F.col(f"{side}_decision") == "ai")).cast("int")
    vectors = group_vectors(pairs.filter(is_positive(F.col("label"))), {
        "pairs": F.count(F.lit(1)), "gain": F.sum(hit("after") - hit("before"))}, first_seen)
    sums = replicate_sums(resampled(vectors), ["pairs", "gain"], replicates, seed, method)
    diffs = sums.select(ratio(F.col("gain"), F.col("pairs")).alias("d"))
    return diffs.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"),
                     F.count("d").alias("replicates"))
