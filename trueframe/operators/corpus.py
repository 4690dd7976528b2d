"""Hash-ranked selection, splits, derivatives and fingerprints of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import first_of
from ..session import settled
from .ordered import hash_bucket, row_rank


def sha(*parts: Column | str) -> Column:
    """SHA-256 hex of the joined text; strings are literals."""
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def hash_rank(df: DataFrame, keys: Sequence[str], digest: Column, tie: str, out: str = "rank",
              total: str | None = None) -> DataFrame:
    """Rank by digest inside each key; the digest's prefix splits every key evenly."""
    ready = df.withColumn("_h", digest).withColumn("_b", hash_bucket(F.col("_h")))
    return row_rank(ready, keys, "_b", [F.col("_h"), F.col(tie)], out, total=total).drop("_h", "_b")


def hash_split(df: DataFrame, group: str = "group_id", salt: str = "split-v1:", forced: DataFrame | None = None) -> DataFrame:
    """40/20/40 split by group hash; groups listed in ``forced`` stay in development."""
    bucket = F.conv(F.substring(sha(salt, F.col(group)), 1, 8), 16, 10).cast("long") % 10
    split = first_of((bucket < 4, "development"), (bucket < 6, "calibration"), otherwise="holdout")
    if forced is None:
        return df.withColumn("split", split)
    known = forced.select(group).distinct().withColumn("_forced", F.lit(True))
    return df.join(known, group, "left").withColumn(
        "split", F.when(F.col("_forced"), "development").otherwise(split)).drop("_forced")


def hash_ranked_sample(df: DataFrame, stratum: str, name: str, count: int, salt: str = "selection-v1:",
                       special: dict[str, int] | None = None) -> DataFrame:
    """First ``count`` of each stratum by hash (``special`` sets other counts).

    The bound on the rank is a literal, so Spark also limits each stratum
    before the shuffle and a large stratum sends few rows per task.
    """
    order = W.partitionBy(stratum).orderBy(sha(salt, F.col(name)), name)
    limit = first_of(*[(F.col(stratum) == k, n) for k, n in special.items()], otherwise=count) if special else F.lit(count)
    most = max([count, *(special or {}).values()])
    return df.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= most) & (F.col("rank") <= limit))


def hash_ranked_split(df: DataFrame, stratum: str, name: str, train: int, dev: int,
                      salt: str = "selection-v1:") -> tuple[DataFrame, DataFrame]:
    """Selected rows with their split, and the strata too small for the quota."""
    picked = hash_ranked_sample(df, stratum, name, train + dev, salt).withColumn(
        "split", F.when(F.col("rank") <= train, "train").otherwise("internal_development"))
    short = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("available")).filter(F.col("available") < train + dev)
    return picked, short


def round_robin(df: DataFrame, digest: Column, labels: Sequence[str], final: Column, tie: str) -> DataFrame:
    """Deal labels in hash order, then number the rows by another hash."""
    dealt = hash_rank(df, [], digest, tie, "_turn").withColumn(
        "quality", F.element_at(F.array(*[F.lit(x) for x in labels]), ((F.col("_turn") - 1) % len(labels) + 1).cast("int")))
    return hash_rank(dealt.drop("_turn"), [], final, tie, "position")


def stratified_split(df: DataFrame, source: str, name: str, cap: int, salt: str = "sample-v1:",
                     targets: dict[str, int] | None = None) -> DataFrame:
    """Up to ``cap`` rows of each source by hash, a tenth (at least one) of them validation.

    ``targets`` sets other counts for the sources it names; 0 leaves one out.
    """
    picked = hash_ranked_sample(df, source, name, cap, salt, targets)
    kept = F.count(F.lit(1)).over(W.partitionBy(source))  # of at most the source's count
    held = F.greatest(F.lit(1), F.floor(kept * 0.1))
    return picked.withColumn("split", F.when(F.col("rank") <= held, "validation").otherwise("train"))


def target_summary(df: DataFrame, picked: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """What each planned source gave: target, available, train, validation and short.

    ``plan`` holds source, label, difficulty and target. Rows named ``all``
    sum up each difficulty of a label, each label, and everything; a planned
    source without rows counts as zero.
    """
    there = df.groupBy(source).agg(F.count(F.lit(1)).alias("available"))
    taken = picked.groupBy(source).agg(F.count_if(F.col("split") == "train").alias("train"),
                                       F.count_if(F.col("split") == "validation").alias("validation"))
    counts = ("available", "train", "validation")
    rows = plan.join(there, source, "left").join(taken, source, "left").fillna(0, list(counts)).withColumn(
        "short", F.greatest(F.lit(0), F.col("target") - F.col("train") - F.col("validation")))
    named = rows.rollup("label", "difficulty", source).agg(*[F.sum(c).alias(c) for c in ("target", *counts, "short")], F.grouping_id().alias("_up"))
    return named.select(*[F.when(F.col("_up").bitwiseAND(F.lit(bit)) == 0, F.col(c)).otherwise("all").alias(c)
                          for c, bit in (("label", 4), ("difficulty", 2), (source, 1))], "target", *counts, "short")


def split_three_way(df: DataFrame, source: str, name: str, train: float = 0.8, val: float = 0.1,
                    salt: str = "shuffle-v1:") -> DataFrame:
    """80/10/10 inside each source in hash order; counts are floored, the rest is test."""
    ranked = hash_rank(df, [source], sha(salt, F.col(name)), name, total="_n")
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    return ranked.withColumn("split", first_of((F.col("rank") <= a, "train"), (F.col("rank") <= a + b, "val"),
                                               otherwise="test")).drop("_n")


# Generator family by source name, in order of precedence.
GENERATOR_FAMILIES = (
    ("zeroscope", "t2v"), ("opensora", "t2v"), ("open_sora", "t2v"), ("latte", "t2v"), ("modelscope", "t2v"),
    ("morphstudio", "t2v"), ("hotshot", "t2v"), ("show_1", "t2v"), ("showone", "t2v"), ("lavie", "t2v"),
    ("videocrafter", "t2v"), ("crafter", "t2v"), ("sora", "t2v"), ("kling", "t2v"), ("runway", "t2v"),
    ("pika", "t2v"), ("gen2", "t2v"), ("i2vgen_xl", "i2v"), ("i2vgenxl", "i2v"), ("svd", "i2v"),
    ("seine", "i2v"), ("dynamicrafter", "i2v"), ("msrvtt", "real"), ("msr_vtt", "real"), ("msrvtt_youku", "real"),
    ("youku", "real"), ("kinetics", "real"), ("kinetics400", "real"),
)
SKIPPED_SOURCES = ("zeroscope",)


def generator_family(name: Column) -> Column:
    """Exact name first, then the first family name that contains or is contained."""
    word = F.translate(F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", "")), "- ", "__")
    exact = [(word == key, kind) for key, kind in GENERATOR_FAMILIES]
    loose = [(F.contains(word, F.lit(key)) | F.contains(F.lit(key), word), kind) for key, kind in GENERATOR_FAMILIES]
    return first_of(*exact, *loose, otherwise="unknown")


def recipe_cross(originals: DataFrame, recipes: Sequence[str]) -> DataFrame:
    """Planned derivative rows: originals times a fixed recipe list."""
    return originals.withColumn("recipe", F.explode(F.array(*[F.lit(r) for r in recipes])))


def derivative_manifest(originals: DataFrame, recipes: Sequence[str]) -> DataFrame:
    """Child rows with their own id, same group and split as the parent."""
    planned = recipe_cross(originals.withColumnRenamed("id", "parent_id"), recipes)
    return planned.withColumn("id", F.substring(sha(F.col("parent_id"), ":", F.col("recipe"), ":v1"), 1, 24)).withColumn(
        "transformation", F.col("recipe")).drop("recipe")


def opaque_ids(df: DataFrame, name: str, revision: str) -> DataFrame:
    ident = sha(revision, "|", F.col(name))
    return df.withColumn("id", ident).withColumn("parent_id", ident).withColumn(
        "group_id", F.concat(F.lit("entry:"), ident))


def collisions(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def epoch_pairs(rows: DataFrame, epoch: int, salt: str = "epoch-v1:") -> DataFrame:
    """Training examples of one epoch.

    Every row is one whole example. Per quality each real row also hosts one AI
    donor (label 1) and one other real donor (label 0) at a hashed start frame.
    Hosts and donors are ranked by hash and met by rank; real donors are the
    hosts rotated by a hashed offset between 1 and n-1.
    """
    tag = f"{salt}{epoch}:"
    real = settled(hash_rank(rows.filter("label = 'real'").select("id", "quality"), ["quality"], sha("host:", F.col("id")), "id", "r", "n"), "hosts")
    fake = settled(hash_rank(rows.filter("label = 'ai'").select(F.col("id").alias("donor_id"), "quality"), ["quality"],
                     sha(tag, F.col("donor_id")), "donor_id", "r", "m"), "donors")
    number = lambda text, base: F.conv(F.substring(text, 1, 12), 16, 10).cast("long") % base
    start = number(sha(tag, "start:", F.col("id")), 7)
    sizes = fake.groupBy("quality").agg(F.max("m").alias("m"))
    hosts = real.join(sizes, "quality").withColumn("start", start)
    with_ai = hosts.withColumn("r", (F.col("r") - 1) % F.col("m") + 1).join(
        fake.drop("m"), ["quality", "r"]).select("id", "donor_id", "start", F.lit(1).alias("target"), F.lit("real_ai_splice").alias("kind"), "quality")
    offset = 1 + number(sha(tag, "offset:", F.col("quality")), F.greatest(F.lit(1), F.col("n") - 1))
    turned = hosts.filter("n > 1").withColumn("r", (F.col("r") - 1 + offset) % F.col("n") + 1)
    with_real = turned.join(real.select(F.col("id").alias("donor_id"), "quality", "r"), ["quality", "r"]).select(
        "id", "donor_id", "start", F.lit(0).alias("target"), F.lit("real_real_splice").alias("kind"), "quality")
    none = F.lit(None)
    whole = rows.select("id", none.cast("string").alias("donor_id"), none.cast("long").alias("start"),
                        (F.col("label") == "ai").cast("int").alias("target"), F.lit("whole").alias("kind"), "quality")
    return whole.unionByName(with_ai).unionByName(with_real)


def feature_manifest(parents: DataFrame, found: DataFrame, qualities: Sequence[str], salt: str = "|feature-v1|") -> DataFrame:
    """Missing, unplanned and repeated feature rows against parents x qualities."""
    planned = parents.select(F.col("id").alias("parent_id")).withColumn(
        "quality", F.explode(F.array(*[F.lit(q) for q in qualities]))).withColumn(
        "id", F.substring(sha(F.col("parent_id"), salt, F.col("quality")), 1, 24))
    seen = found.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    return planned.select("id", F.lit(True).alias("_p")).join(seen, "id", "full_outer").select("id", first_of(
        (F.col("copies").isNull(), "missing"), (F.col("_p").isNull(), "unplanned"),
        (F.col("copies") > 1, "duplicate")).alias("problem")).filter("problem is not null")


def row_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SHA-256 of each row as key-sorted JSON."""
    return df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def set_fingerprint(rows: DataFrame, tie: str, fan: int = 1024, levels: int = 4) -> DataFrame:
    """Digest of a whole set in fingerprint order.

    Digests are combined ``fan`` at a time, level by level, so no task ever
    joins more than ``fan`` of them. There are at least ``levels`` levels, so
    that small sets' digests keep their form, and as many more as it takes to
    be left with one row.
    """
    level = hash_rank(rows.select("fingerprint", tie), [], F.col("fingerprint"), tie, "at").select(
        (F.col("at") - 1).alias("at"), F.col("fingerprint").alias("d"))
    left, done = rows.count(), 0
    while done < levels or left > 1:
        level = level.groupBy(F.floor(F.col("at") / fan).alias("up")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), ""), 256).alias("d")
        ).select(F.col("up").alias("at"), "d")
        left, done = -(-left // fan), done + 1
    return level.select(F.col("d").alias("digest"))


def tree_depth(rows: int, leaf: int = 4096) -> int:
    """Levels below the root at which a leaf of a 256-fold tree holds about ``leaf`` rows or fewer."""
    depth = 0
    while rows > leaf:
        rows, depth = rows // 256, depth + 1
    return depth


def fingerprint_tree(rows: DataFrame, depth: int) -> DataFrame:
    """Digest tree of a set of fingerprints: level, prefix, rows, digest.

    A node covers the fingerprints that begin with its prefix, so equal subsets
    have equal nodes wherever else two sets differ. Equal rows are counted
    before they are joined into a leaf, and a node has at most 256 children.
    """
    counted = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows"))
    at = lambda level, name: F.substring(name, 1, 2 * level).alias("prefix")
    digest = lambda name: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(name), F.col("rows"), *(
        [F.col("digest")] if name == "prefix" else [])))), lambda x: F.to_json(x)), ","), 256).alias("digest")
    level = settled(counted.groupBy(at(depth, "fingerprint")).agg(digest("fingerprint"), F.sum("rows").alias("rows")), "tree-leaves")
    tree = level.withColumn("level", F.lit(depth))
    for up in range(depth - 1, -1, -1):
        level = level.groupBy(at(up, "prefix")).agg(digest("prefix"), F.sum("rows").alias("rows"))
        tree = tree.unionByName(level.withColumn("level", F.lit(up)))
    return settled(tree.select("level", "prefix", "rows", "digest"), "tree")


def fingerprint_differences(first: DataFrame, second: DataFrame, first_tree: DataFrame, second_tree: DataFrame, depth: int) -> DataFrame:
    """Fingerprints that two sets hold unequally often: fingerprint, in_first, in_second.

    Both trees are descended from the root, only below nodes that differ; rows
    are read for the leaves that are left. Equal sets end at the root.
    """
    open_nodes = None
    for level in range(depth + 1):
        sides = [t.filter(F.col("level") == level).select("prefix", F.col("digest").alias(name))
                 for t, name in ((first_tree, "a"), (second_tree, "b"))]
        if open_nodes is not None:
            sides = [s.join(open_nodes, F.substring("prefix", 1, 2 * (level - 1)) == F.col("parent"), "left_semi") for s in sides]
        open_nodes = sides[0].join(sides[1], "prefix", "full_outer").filter(
            ~F.col("a").eqNullSafe(F.col("b"))).select(F.col("prefix").alias("parent"))
    below = lambda rows, name: rows.select("fingerprint").join(
        open_nodes, F.substring("fingerprint", 1, 2 * depth) == F.col("parent"), "left_semi").groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias(name))
    return below(first, "in_first").join(below(second, "in_second"), "fingerprint", "full_outer").fillna(
        0, ["in_first", "in_second"]).filter("in_first <> in_second")


def budget_filter(df: DataFrame, size: str, item_cap: int, total_cap: int) -> tuple[DataFrame, DataFrame]:
    kept = df.filter(F.col(size) <= item_cap)
    total = kept.agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).withColumn(
        "over_budget", F.col("bytes") > total_cap)
    return kept, total


def census_bucket(name: Column) -> tuple[Column, Column]:
    """(label, generator) from an archive path; null label outside real/fake folders."""
    parts = F.split(name, "/")
    at = F.array_position(parts, F.lit("fake"))
    real = F.array_contains(parts, "real")
    return (first_of((real, "real"), (at > 0, "ai")),
            F.when(~real & (at > 0), F.try_element_at(parts, (at + 1).cast("int"))))
