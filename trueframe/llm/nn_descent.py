"""Embedding near-duplicates by NN-descent.

Vectors are compared only within a label. The neighbour graph starts from
random-hyperplane leaves, each vector meeting the others of its leaf in several
tables, and is refined by joining neighbours of neighbours: every vector gathers
those that list it and those it lists, and all that meet there are compared.
Only neighbours within three times the threshold's angle are followed: farther
ones lead to a link by chance alone, and what that leaves out the audit shows.
Rounds end when few lists change; a brute-force audit of a bounded sample of
vectors then measures the recall of pairs above the threshold, and lists are
enlarged and refined again while it is too low. Tables grow with the label's
size, so that a lone pair at the threshold is missed once in a thousand by
calculation; crowded leaves are cut by planes through their own centre.

The finished components are audited label by label: sampled vectors are compared
with all of their label, and one that has a link out of its component is missed.
The sample grows until enough vectors with links were seen, or it is the whole
label; a label below the target recall is compared whole, block against block.

A list that holds only neighbours above the threshold is saturated: there may
be more. Saturated lists are enlarged to all vectors that can be reached through
threshold edges, block against block, and the links are counted there, so large
groups of near copies give exact counts without a row per pair. A pair that no
list holds because both its lists are full is found apart: full vectors of a
component form balls (centre and largest angle), and two balls of different
components are compared whole unless their angle rules a link out.

Defined results. Null vectors, vectors of length zero, with null or non-finite
components, or without a label link with nothing: n_links 0, component their own
id. Vectors of different length are never compared. Equal vectors are one node,
counted as often as they occur. Rows with the same id are separate vectors with
one name; an id's row with the smallest component counts. Null ids: no links,
component null, kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Neighbours per list at first, and after how many doublings to stop.
NEIGHBOURS, DOUBLINGS = 10, 3
#: Random-hyperplane tables and aimed leaf size; a leaf beyond the block size is dealt into blocks.
TABLES, LEAF, BLOCK = 8, 32, 256
#: Chance that all leaf tables miss a lone pair at the threshold, most tables, and planes that cut a crowded leaf.
MISS, MOST_TABLES, PLANES = 1e-3, 64, 24
ROUNDS, CHANGED = 3, 0.01
#: Vectors audited at least, the recall they must show, and how many with links must be seen.
AUDITED, RECALL, SHOWN = 512, 0.99, 100
GROUP_BLOCK, AUDIT_BLOCK = 512, 2048
#: Balls compared with each other in one task.
BALL_BLOCK = 1024
EDGES = "a long, b long, near double"


def _unit(rows) -> np.ndarray:
    v = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def nodes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(rows with their node, nodes): usable vectors, equal ones merged.

    A node is (node, space, copies, vec): its smallest id, label and length,
    count, and the components as little-endian doubles.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"),
                          F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # scaled by the largest component first, so no square over- or underflows; adding 0 makes -0 equal 0
            packed = [(np.asarray(v, float) / np.abs(v).max() + 0.0).tobytes() for v in batch["v"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "vec": packed})

    good = rows.filter(usable).select("vec_id", F.col("label").cast("string").alias("label"), "v").mapInPandas(
        pack, "vec_id long, label string, vec binary")
    good = good.select("vec_id", F.concat_ws("/", "label", F.length("vec").cast("string")).alias("space"), "vec", F.sha2("vec", 256).alias("same"))
    good = written(good, "vectors")
    merged = written(good.groupBy("space", "same").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "nodes")
    return good.select("vec_id", "space", "same"), merged


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each list; the bound on the rank also limits what is shuffled."""
    once = edges.groupBy("a", "b").agg(F.max("near").alias("near"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("near"), "b"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _tables(bits: Column, threshold: float) -> Column:
    """Tables after which a pair at the threshold has missed all of them with chance MISS."""
    together = F.pow(F.lit(1 - float(np.arccos(np.clip(threshold, -1, 1))) / np.pi), bits)
    wanted = F.when(together < 1, F.ceil(F.log(F.lit(MISS)) / F.log(1 - together)))
    return F.least(F.greatest(F.lit(TABLES), wanted), F.lit(MOST_TABLES)).cast("int")


def _uncrowded(dealt: DataFrame) -> DataFrame:
    """Leaves with a ``cut``: those above the block size are cut by planes through their mean."""
    leaf = ["space", "side", "leaf"]
    crowds = written(dealt.groupBy(*leaf).agg(F.count(F.lit(1)).alias("crowd")).filter(F.col("crowd") > BLOCK), "crowds")
    if crowds.isEmpty():
        return dealt.withColumn("cut", F.lit(0).cast("long"))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (side, width), part in batch.groupby([batch["side"], batch["vec"].map(len)]):
                unit = _unit(part["vec"].tolist())
                planes = np.random.default_rng((7, side, width)).standard_normal((unit.shape[1], PLANES))
                yield part.assign(at=list(unit @ planes))

    found = written(dealt.join(crowds, leaf).select("node", "space", "vec", "side", "leaf", "crowd").mapInPandas(
        project, "node long, space string, vec binary, side int, leaf long, crowd long, at array<double>"), "crowded")
    centres = found.groupBy(*leaf).agg(F.array(*[F.avg(F.col("at")[i]) for i in range(PLANES)]).alias("centre"))
    bits = F.least(F.ceil(F.log2(F.col("crowd") / BLOCK)) + 2, F.lit(PLANES))
    cut = sum((F.when((F.lit(i) < bits) & (F.col("at")[i] > F.col("centre")[i]), 1 << i).otherwise(0) for i in range(PLANES)), F.lit(0)).cast("long")
    return dealt.join(crowds, leaf, "left_anti").withColumn("cut", F.lit(0).cast("long")).unionByName(
        found.join(centres, leaf).select("node", "space", "vec", "side", "leaf", cut.alias("cut")))


def _leaves(points: DataFrame, k: int, seed: int, threshold: float = 0.98) -> DataFrame:
    """Each vector's nearest within its leaves, both ways."""
    sizes = points.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int")
    placed = points.join(sizes, "space").select("node", "space", "vec", bits.alias("bits"), _tables(bits, threshold).alias("tables"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby(batch["vec"].map(len)):
                unit = _unit(part["vec"].tolist())
                tables = part["tables"].to_numpy()
                for t in range(int(tables.max())):
                    planes = np.random.default_rng((seed, t, width)).standard_normal((unit.shape[1], 30))
                    code = ((unit @ planes > 0) << np.arange(30)).sum(axis=1)
                    yield pd.DataFrame({"node": part["node"], "space": part["space"], "vec": part["vec"], "side": t,
                                        "leaf": code & ((1 << np.minimum(part["bits"].to_numpy(np.int64), 30)) - 1)})[t < tables]

    dealt = _uncrowded(placed.mapInPandas(place, "node long, space string, vec binary, side int, leaf long"))
    crowd = dealt.groupBy("space", "side", "leaf", "cut").agg(F.count(F.lit(1)).alias("crowd"))
    dealt = dealt.join(crowd, ["space", "side", "leaf", "cut"]).withColumn(
        "part", F.pmod(F.xxhash64("node", "side"), F.ceil(F.col("crowd") / BLOCK)))
    grouped = dealt.groupBy("space", "side", "leaf", "cut", "part").agg(F.collect_list(F.struct("node", "vec")).alias("members"))
    return grouped.select("members").mapInPandas(_meet(k), EDGES)


def _meet(k: int):
    """Compares all members of a bounded group and keeps each one's k nearest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for members in batch["members"]:
                if len(members) < 2:
                    continue
                ids = np.array([m["node"] for m in members])
                unit = _unit([bytes(m["vec"]) for m in members])
                near = unit @ unit.T
                np.fill_diagonal(near, -2)
                if "least" in members[0]:
                    near[near <= np.array([m["least"] for m in members])[:, None]] = -2
                keep = min(k, len(ids) - 1)
                best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
                value = np.take_along_axis(near, best, 1)
                r, c = np.nonzero(value > -1.5)
                out.append((ids[r], ids[best[r, c]], value[r, c]))
            if out:
                a, b, near = map(np.concatenate, zip(*out))
                yield pd.DataFrame({"a": a, "b": b, "near": near})
    return run


def _refined(lists: DataFrame, points: DataFrame, k: int, reach: float) -> DataFrame:
    """Lists after one join of neighbours of neighbours nearer than ``reach``.

    A vector's own list and itself are put beside each block of those that list
    it, so a hub's callers are split but each still meets what the hub lists.
    """
    followed = lists.filter(F.col("near") >= reach)
    forward = followed.select(F.col("a").alias("hub"), F.col("b").alias("node"))
    back = followed.select(F.col("b").alias("hub"), F.col("a").alias("node")).join(forward, ["hub", "node"], "left_anti")
    callers = back.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / 32).alias("parts"))
    back = back.join(callers, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node")
    forward = forward.join(callers, "hub", "left").select(
        "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "node")
    least = lists.groupBy("a").agg(F.when(F.count(F.lit(1)) >= k, F.min("near")).otherwise(F.lit(-1.5)).alias("least"))
    carried = points.join(least.withColumnRenamed("a", "node"), "node", "left").select("node", "vec", F.coalesce("least", F.lit(-1.5)).alias("least"))
    met = forward.unionByName(back).join(carried, "node").groupBy("hub", "part").agg(
        F.collect_list(F.struct("node", "vec", "least")).alias("members")).select("members").mapInPandas(_meet(k), EDGES)
    return _top(lists.unionByName(met), k)


def _audit(lists: DataFrame, points: DataFrame, threshold: float) -> float:
    """Share of a bounded sample's pairs above the threshold, found by brute force, that the lists hold.

    A full list of such pairs is not held against the search: it is enlarged later.
    """
    asked = points.orderBy(F.xxhash64("node"), "node").limit(AUDITED).select("node", "space", "vec").toPandas()
    if not len(asked):
        return 1.0
    groups = {s: (g["node"].to_numpy(), _unit([bytes(v) for v in g["vec"]])) for s, g in asked.groupby("space")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for space, part in batch.groupby("space"):
                if space in groups:
                    ids, queries = groups[space]
                    near = queries @ _unit([bytes(v) for v in part["vec"]]).T
                    other = part["node"].to_numpy()
                    near[ids[:, None] == other[None, :]] = -2
                    i, j = np.nonzero(near >= threshold)
                    yield pd.DataFrame({"a": ids[i], "b": other[j]})

    true = points.select("node", "space", "vec").mapInPandas(run, "a long, b long")
    full = lists.groupBy("a").agg(F.min("near").alias("least")).filter(F.col("least") >= threshold).select("a")
    found = true.join(full, "a", "left_anti").join(lists.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    counted = found.agg(F.count(F.lit(1)), F.count("hit")).first()
    return counted[1] / counted[0] if counted[0] else 1.0


def _bridges(placed: DataFrame, lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """Links (a, b) between components whose vectors' lists are full, at least one for any two that are linked.

    A vector whose list is not full lists its links itself, so only full ones are compared.
    """
    full = lists.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("least")).filter(
        (F.col("n") >= k) & (F.col("least") >= threshold - 1e-9)).select("node")
    full = written(placed.join(full, "node").select("space", "component", "node", "vec"), "full")
    balls = full.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).alias("balls"))
    full = written(full.join(balls, "component").select("space", "component", F.pmod(F.xxhash64("node"), F.col("balls")).alias("ball"), "node", "vec"), "balls")
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def ball(frame: pd.DataFrame) -> pd.DataFrame:
        unit = _unit([bytes(v) for v in frame["vec"]])
        centre = unit.mean(axis=0)
        norm = np.sqrt(centre @ centre)
        centre = centre / norm if norm > 1e-9 else unit[0]
        first = frame[["space", "component", "ball"]].head(1)
        return first.assign(centre=[centre.tobytes()], radius=float(np.arccos(np.clip(unit @ centre, -1, 1)).max()))

    found = written(full.groupBy("space", "component", "ball").applyInPandas(
        ball, "space string, component long, ball long, centre binary, radius double"), "centres")
    blocks = found.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / BALL_BLOCK).alias("blocks"))
    dealt = found.join(blocks, "space").withColumn("mine", F.pmod(F.xxhash64("component", "ball"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        unit = _unit([bytes(v) for v in frame["centre"]])
        component, which, mine, radius = (frame[c].to_numpy() for c in ("component", "ball", "mine", "radius"))
        near = np.arccos(np.clip(unit @ unit.T, -1, 1)) <= radius[:, None] + radius[None, :] + reach
        near &= component[:, None] < component[None, :]
        if frame["low"].iloc[0] != frame["high"].iloc[0]:
            near &= mine[:, None] != mine[None, :]
        i, j = np.nonzero(near)
        return pd.DataFrame({"component_a": component[i], "ball_a": which[i], "component_b": component[j], "ball_b": which[j]})

    pair = ["component_a", "ball_a", "component_b", "ball_b"]
    met = written(dealt.groupBy("space", "low", "high").applyInPandas(meet, ", ".join(f"{c} long" for c in pair)), "near-balls")
    sides = [met.join(full.select(F.col("component").alias(f"component_{c}"), F.col("ball").alias(f"ball_{c}"), "node", "vec"),
                      [f"component_{c}", f"ball_{c}"]).select(*pair, F.lit(c).alias("end"), "node", "vec") for c in "ab"]

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        unit, ids, a = _unit([bytes(v) for v in frame["vec"]]), frame["node"].to_numpy(), (frame["end"] == "a").to_numpy()
        i, j = np.nonzero(unit[a] @ unit[~a].T >= threshold - 1e-9)
        return pd.DataFrame({"a": ids[a][i[:1]], "b": ids[~a][j[:1]]})

    return sides[0].unionByName(sides[1]).groupBy(*pair).applyInPandas(compare, "a long, b long")


def _placed(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their component."""
    return written(points.join(components(edges), "node", "left").select(
        "space", "node", "copies", "vec", F.coalesce("component", "node").alias("component")), "placed")


def _against(asked: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """Asked vectors against all of their space: rows (space, a, b, pairs, missed).

    A row with b = a counts a's pairs above the threshold in one block, and those
    that lead to another component; the other rows are links to other components.
    """
    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / AUDIT_BLOCK).alias(name))

    cells = written(blocks(asked, "rows").join(blocks(placed, "columns"), "space"), "cells")

    def dealt(side: DataFrame, mine: str, other: str, asks: bool) -> DataFrame:
        counts = {"row": "rows", "column": "columns"}
        return side.join(cells, "space").withColumn(mine, F.pmod(F.xxhash64("node"), F.col(counts[mine]))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(counts[other]) - 1))).select(
            "space", "row", "column", "node", "component", "vec", F.lit(asks).alias("asks"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        empty = pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("space", str), ("a", int), ("b", int), ("pairs", int), ("missed", int))})
        if asks.all() or not asks.any():
            return empty
        unit, ids, component = _unit([bytes(v) for v in frame["vec"]]), frame["node"].to_numpy(), frame["component"].to_numpy()
        link = unit[asks] @ unit[~asks].T >= threshold
        link &= ids[asks][:, None] != ids[~asks][None, :]
        apart = link & (component[asks][:, None] != component[~asks][None, :])
        pairs, missed, a = link.sum(axis=1), apart.sum(axis=1), ids[asks]
        seen = pairs > 0
        i, j = np.nonzero(apart)
        _, once = np.unique(np.stack([component[asks][i], component[~asks][j]], axis=1), axis=0, return_index=True)
        i, j = i[once], j[once]
        return pd.DataFrame({"space": frame["space"].iloc[0], "a": np.concatenate([a[seen], a[i]]), "b": np.concatenate([a[seen], ids[~asks][j]]),
                             "pairs": np.concatenate([pairs[seen], np.zeros(len(i), int)]), "missed": np.concatenate([missed[seen], np.zeros(len(i), int)])})

    return dealt(asked, "row", "column", True).unionByName(dealt(placed, "column", "row", False)).groupBy(
        "space", "row", "column").applyInPandas(compare, "space string, a long, b long, pairs long, missed long")


def _completed(points: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """The edges, with those that the audit of each space finds until its recall is shown or it was compared whole."""
    sizes = points.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    open_ = written(sizes.select("space", "n", F.least("n", F.greatest(F.lit(AUDITED), F.ceil(F.sqrt("n")))).cast("long").alias("asked")), "audits")
    while not open_.isEmpty():
        placed = _placed(points, edges).join(open_, "space")
        drawn = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) * F.col("n") < F.lit(1 << 30) * F.col("asked").cast("double")
        seen = written(_against(placed.filter(drawn), placed, threshold), "audited")
        edges = written(edges.unionByName(seen.filter("a <> b").select("a", "b")), "completed")
        shown = seen.filter("a = b").groupBy("space", "a").agg(F.sum("missed").alias("missed")).groupBy("space").agg(
            F.count(F.lit(1)).alias("shown"), F.count_if(F.col("missed") > 0).alias("missed"))
        held = open_.join(shown, "space", "left").filter("asked < n").fillna(0, ["shown", "missed"])
        low = F.col("missed") > (1 - RECALL) * F.col("shown")
        open_ = written(held.filter(low | (F.col("shown") < SHOWN)).select(
            "space", "n", F.when(low, F.col("n")).otherwise(F.least("n", 8 * F.col("asked"))).cast("long").alias("asked")), "audits")
    return edges


def neighbour_lists(points: DataFrame, threshold: float, k: int = NEIGHBOURS) -> tuple[DataFrame, int]:
    """The refined graph (a, b, near) and the length of its full lists."""
    lists = None
    reach = float(np.cos(min(3 * np.arccos(min(threshold, 1.0)), np.pi)))
    for attempt in range(DOUBLINGS):
        start = _leaves(points, k, attempt, threshold)
        lists = written(_top(start if lists is None else lists.unionByName(start), k), "lists")
        for _ in range(ROUNDS):
            better = written(_refined(lists, points, k, reach), "lists")
            near = better.filter(F.col("near") >= reach)
            changed, total = near.join(lists, ["a", "b"], "left_anti").count(), near.count()
            lists = better
            if changed <= CHANGED * total:
                break
        if attempt == DOUBLINGS - 1 or _audit(lists, points, threshold) >= RECALL:
            break
        k *= 2
    return lists, k


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, k: int = NEIGHBOURS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, points = nodes(vectors)
    lists, k = neighbour_lists(points, threshold, k)
    # a little below the threshold: the exact test is made on the enlarged lists
    edges = written(lists.filter(F.col("near") >= threshold - 1e-9).select("a", "b"), "edges")
    edges = written(edges.unionByName(_bridges(_placed(points, edges), lists, threshold, k)), "bridged")
    edges = _completed(points, edges, threshold)
    found = components(edges)
    members = found.select("node", "component").unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    members = written(members.join(points.select("node", "copies", "vec"), "node"), "members")
    blocks = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).alias("blocks"))
    dealt = members.join(blocks, "component").select("component", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("mine"), "blocks", "node", "copies", "vec")
    met = dealt.select("component", "mine", "node", "copies", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = met.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        unit, ids, copies = _unit([bytes(v) for v in frame["vec"]]), frame["node"].to_numpy(), frame["copies"].to_numpy()
        link = unit @ unit.T >= threshold
        if frame["low"].iloc[0] != frame["high"].iloc[0]:
            mine = frame["mine"].to_numpy()
            link &= mine[:, None] != mine[None, :]
        np.fill_diagonal(link, False)
        linked = link @ copies
        # the group's own components, so that one row per vector carries all its links
        np.fill_diagonal(link, True)
        least, before = ids, None
        while before is None or (least != before).any():
            least, before = np.where(link, least[None, :], np.iinfo(np.int64).max).min(axis=1), least
        return pd.DataFrame({"node": ids, "linked": linked, "least": least})

    counted = written(met.groupBy("component", "low", "high").applyInPandas(compare, "node long, linked long, least long"), "counted")
    links = counted.groupBy("node").agg(F.sum("linked").alias("linked"))
    final = components(counted.select(F.col("node").alias("a"), F.col("least").alias("b")))
    named = points.select("space", "same", "node", "copies").join(links, "node", "left").join(final, "node", "left").select(
        "space", "same", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    good = rows.join(named, ["space", "same"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(good, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                        F.col("vec_id").eqNullSafe(component).alias("kept"))
