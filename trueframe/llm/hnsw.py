"""Approximate nearest neighbours: a navigable small-world graph per shard.

Different vectors are dealt by hash into shards of about ``SHARD_ROWS``. A
shard becomes one row of flat arrays: its vectors, and for every layer of its
graph a table of neighbours, as many places a node as the layer allows. A
node's top layer is drawn from the hash of its place. Nodes are inserted from
the highest layer down, in growing blocks: a block searches the graph built so
far and itself, chooses neighbours that are nearer to the node than to each
other, and adds the links back, choosing again where a list is full. Searches
run for a whole block of queries at once, with a beam that expands its best open
nodes until none is left.

Queries are all rows whose id is divisible by ``every``, in blocks; each block
meets each shard of its dimension, candidates are scored again in double
precision on the vectors as given, and the shards' results are merged by rank.
Graphs travel once per ``GROUP_BLOCKS`` blocks of queries, so neither a task's
queries nor its graph grow with the table.

Equal vectors are one node that keeps the k + 1 smallest ids, which is all that
ranks with ties to the smaller id can ask for, so a vector that fills half the
table is no hot group. All rows are indexed; the result is approximate, and
``recall`` measures it against comparing all rows for given queries.

Defined results. Vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part. Vectors of different
dimensions are never compared. Several vectors of one id are all tried; a
neighbour counts once, with its best score, and is never its own neighbour;
repeated rows count once. Queries without a candidate, and empty tables, give no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Links a node: in upper layers, and in the lowest one.
LINKS, LOWEST_LINKS = 16, 32
#: Widths of the beams that build and search.
BUILD_WIDTH, SEARCH_WIDTH = 96, 128
#: Best open nodes expanded in one step of a beam.
EXPANDED = 4
#: Different vectors in a shard, by expectation; queries in a block; blocks that share one copy of a graph.
SHARD_ROWS, BLOCK_ROWS, GROUP_BLOCKS = 8192, 512, 64

GRAPH = "dims int, shard long, n int, vectors binary, ids array<array<long>>, tops binary, neighbours array<binary>"
FOUND = "query_id long, vec_id long, score double"


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, which rounds nothing, so that squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(-1, keepdims=True))[1])


def _normalised(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    scaled = _scaled(vectors)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the rows of ``b`` at its place, in double precision."""
    a, b = _scaled(a), _scaled(b)
    dots = np.einsum("qd,qkd->qk", a, b)
    return dots / (np.sqrt(np.einsum("qd,qd->q", a, a))[:, None] * np.sqrt(np.einsum("qkd,qkd->qk", b, b)))


def _choose(near: np.ndarray, score: np.ndarray, units: np.ndarray, most: int) -> np.ndarray:
    """Of candidates by falling score, those nearer to their node than to any chosen before, then the nearest others."""
    rows, width = near.shape
    own = units[np.maximum(near, 0)]
    between = own @ own.transpose(0, 2, 1)
    chosen = np.zeros((rows, width), bool)
    worst = np.full((rows, width), -np.inf, np.float32)
    for k in range(width):
        take = (near[:, k] >= 0) & (score[:, k] > worst[:, k]) & (chosen.sum(1) < most)
        chosen[:, k] = take
        worst = np.where(take[:, None], np.maximum(worst, between[:, k]), worst)
    # chosen ones first, then what is left, each by falling score
    order = np.argsort(np.where(near < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, order, 1)


def _best(near: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-score, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)


class Graph:
    """Layers of neighbour tables over the unit vectors of one shard."""

    def __init__(self, units: np.ndarray, tops: np.ndarray, layers: list[np.ndarray]):
        # nodes are ordered by falling top layer, so a layer's nodes are the first ones
        self.units, self.tops, self.layers = units, tops, layers

    @classmethod
    def build(cls, units: np.ndarray, tops: np.ndarray) -> Graph:
        n = len(units)
        sizes = [int((tops >= layer).sum()) for layer in range(int(tops.max(initial=0)) + 1)]
        graph = cls(units, tops, [np.full((size, LINKS if layer else LOWEST_LINKS), -1, np.int32) for layer, size in enumerate(sizes)])
        done = 0
        while done < n:
            # blocks grow with the graph and stay within one top layer
            until = min(done + max(1, min(done, BLOCK_ROWS)), sizes[tops[done]])
            graph._insert(done, until)
            done = until
        return graph

    def _insert(self, lo: int, hi: int) -> None:
        fresh = np.arange(lo, hi)
        queries = self.units[lo:hi]
        mutual = queries @ queries.T
        np.fill_diagonal(mutual, -np.inf)
        near = self._descend(queries, int(self.tops[lo]), lo)
        for layer in range(int(self.tops[lo]), -1, -1):
            found, score = self._beam(layer, queries, near, BUILD_WIDTH, lo)
            near = found
            found = np.concatenate([found, np.where(np.isfinite(mutual), fresh[None, :], -1)], 1)
            score = np.concatenate([score, mutual], 1)
            found, score = _best(found, score, BUILD_WIDTH)
            links = _choose(np.where(np.isfinite(score), found, -1), score, self.units, LINKS)
            table = self.layers[layer]
            table[lo:hi, :links.shape[1]] = links
            self._link_back(table, fresh, links)

    def _link_back(self, table: np.ndarray, fresh: np.ndarray, links: np.ndarray) -> None:
        """Adds the new nodes to the lists of their neighbours."""
        source = np.repeat(fresh, links.shape[1])
        target = links.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        score = np.einsum("kd,kd->k", self.units[source], self.units[target])
        order = np.lexsort((-score, target))
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, counts)
        most = table.shape[1]
        inside = place < 2 * most  # the nearest newcomers decide a list
        added = np.full((len(nodes), min(int(counts.max()), 2 * most)), -1, np.int32)
        added[np.repeat(np.arange(len(nodes)), counts)[inside], place[inside]] = source[inside]
        for a in range(0, len(nodes), BLOCK_ROWS):
            part = nodes[a:a + BLOCK_ROWS]
            both = np.concatenate([table[part], added[a:a + BLOCK_ROWS]], 1)
            # a node of the same block may be listed already
            both = -np.sort(-both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            value = np.einsum("nd,nkd->nk", self.units[part], self.units[np.maximum(both, 0)])
            value[both < 0] = -np.inf
            near, value = _best(both, value, min(both.shape[1], 2 * most))
            fits = (near >= 0).sum(1) <= most
            out = near[:, :most].copy()
            if not fits.all():
                out[~fits] = _choose(near[~fits], value[~fits], self.units, most)
            table[part, :out.shape[1]] = out
            table[part, out.shape[1]:] = -1

    def _descend(self, queries: np.ndarray, layer: int, n: int) -> np.ndarray:
        """Entry points for a layer: the nearest node of the layers above it."""
        near = np.zeros((len(queries), 1), np.int32) if n else np.full((len(queries), 1), -1, np.int32)
        for above in range(len(self.layers) - 1, layer, -1):
            near = self._beam(above, queries, near, 1, n)[0]
        return near

    def _beam(self, layer: int, queries: np.ndarray, entry: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes met below ``n``, by falling score; -1 where there are fewer."""
        rows, table = len(queries), self.layers[layer]
        near = np.full((rows, width), -1, np.int32)
        score = np.full((rows, width), -np.inf, np.float32)
        if not n:
            return near, score
        # one more column, which stands for no node
        seen = np.zeros((rows, n + 1), bool)
        seen[:, n] = True
        entry = entry[:, :width]
        near[:, :entry.shape[1]] = entry
        met = np.einsum("qd,qkd->qk", queries, self.units[np.maximum(entry, 0)])
        score[:, :entry.shape[1]] = np.where(entry >= 0, met, -np.inf)
        seen[np.arange(rows)[:, None], np.where(entry >= 0, entry, n)] = True
        open_ = near >= 0
        busy = np.arange(rows)
        step = min(EXPANDED, width)
        while True:
            waiting = np.where(open_[busy], score[busy], -np.inf)
            pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step] if step < width else np.tile(np.arange(width), (len(busy), 1))
            live = np.isfinite(np.take_along_axis(waiting, pick, 1))
            going = live.any(1)
            busy, pick, live = busy[going], pick[going], live[going]
            if not len(busy):
                order = np.argsort(-score, axis=1, kind="stable")
                return np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
            open_[busy[:, None], pick] = False
            nodes = near[busy[:, None], pick]
            links = np.where(live[:, :, None], table[np.maximum(nodes, 0)], -1).reshape(len(busy), -1)
            links = np.where((links >= 0) & (links < n), links, n)
            links = np.sort(links, axis=1)
            links[:, 1:][links[:, 1:] == links[:, :-1]] = n
            fresh = ~seen[busy[:, None], links]
            seen[busy[:, None], links] = True
            # only as many columns as the busiest row has new nodes
            most = int(fresh.sum(1).max(initial=0))
            if not most:
                continue
            place = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
            fresh, links = np.take_along_axis(fresh, place, 1), np.take_along_axis(links, place, 1)
            value = np.matmul(self.units[np.where(fresh, links, 0)], queries[busy][:, :, None])[:, :, 0]
            value[~fresh] = -np.inf
            all_near = np.concatenate([near[busy], links.astype(np.int32)], 1)
            all_score = np.concatenate([score[busy], value], 1)
            all_open = np.concatenate([open_[busy], fresh], 1)
            keep = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
            near[busy] = np.take_along_axis(all_near, keep, 1)
            score[busy] = np.take_along_axis(all_score, keep, 1)
            open_[busy] = np.take_along_axis(all_open, keep, 1) & np.isfinite(score[busy])

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        n = len(self.units)
        near, score = self._beam(0, queries, self._descend(queries, 0, n), width, n)
        return np.where(np.isfinite(score), near, -1)


def _tops(n: int, seed: int) -> np.ndarray:
    """Top layers of nodes: each layer holds about one in LINKS of the one below."""
    drawn = np.random.default_rng([seed, n]).random(n)
    return np.floor(-np.log(1 - drawn) / np.log(LINKS)).astype(np.int32)


def vectors(embeddings: DataFrame) -> DataFrame:
    """Rows that take part, as ``vec_id``, ``dims`` and ``embedding`` in double precision."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    infinite = F.lit(float("inf"))
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
                      & F.exists(v, lambda x: x != 0), F.lit(False))
    return embeddings.filter(F.col("vec_id").isNotNull() & good).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), v.alias("embedding"))


def _packed(frame: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in frame])


def _shards(rows: DataFrame, shard_rows: int) -> DataFrame:
    """How many shards each dimension has: one row per dimension, no more than the longest vector has components."""
    return rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))


def build_index(rows: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of flat arrays per shard, from the rows of ``vectors``."""
    # the least ids of each different vector: k others and the query itself
    ranked = rows.select("vec_id", "dims", "embedding", F.xxhash64("embedding").alias("h")).distinct().withColumn(
        "place", F.row_number().over(W.partitionBy("h", "embedding").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    nodes = written(ranked.groupBy("h", "embedding").agg(
        F.first("dims").alias("dims"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    dealt = nodes.join(F.broadcast(_shards(nodes, shard_rows)), "dims").withColumn("shard", F.pmod(F.xxhash64("h"), F.col("shards")))

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(least=[i[0] for i in part["ids"]]).sort_values(["least", "h"])
        tops = _tops(len(part), int(key[1]))
        order = np.argsort(-tops, kind="stable")
        part, tops = part.iloc[order], tops[order]
        matrix = _packed(part["embedding"])
        graph = Graph.build(_normalised(matrix), tops)
        return pd.DataFrame({"dims": key[0], "shard": key[1], "n": len(part), "vectors": [matrix.tobytes()],
                             "ids": [[list(map(int, i)) for i in part["ids"]]], "tops": [tops.tobytes()],
                             "neighbours": [[layer.tobytes() for layer in graph.layers]]})

    return written(dealt.select("h", "dims", "shard", "embedding", "ids").groupBy("dims", "shard").applyInPandas(work, GRAPH), "shards")


def _loaded(row: pd.Series) -> tuple[Graph, np.ndarray, list]:
    """The graph of a shard, its vectors as given, and the ids of each."""
    matrix = np.frombuffer(row["g_vectors"], np.float64).reshape(row["g_n"], row["g_dims"])
    tops = np.frombuffer(row["g_tops"], np.int32)
    layers = [np.frombuffer(b, np.int32).reshape(-1, LINKS if i else LOWEST_LINKS) for i, b in enumerate(row["g_neighbours"])]
    return Graph(_normalised(matrix), tops, layers), matrix, [i.tolist() for i in row["g_ids"]]


def _in_shard(shard: tuple[Graph, np.ndarray, list], ids: np.ndarray, queries: np.ndarray, k: int, width: int) -> pd.DataFrame:
    """The k best of a shard for each query, by score, ties to the smaller id."""
    graph, matrix, members = shard
    near = graph.search(_normalised(queries), width)
    score = cosines(queries, matrix[np.maximum(near, 0)])
    score[near < 0] = -np.inf
    out = []
    for own, nodes, values in zip(ids.tolist(), near.tolist(), score):
        # k + 1 nodes hold k other ids, the nodes that tie with the last of them included
        last = np.sort(values)[-min(k + 1, len(values))]
        best: dict[int, float] = {}
        for place in np.flatnonzero((values >= last) & (values > -np.inf)).tolist():
            for i in members[nodes[place]]:
                if i != own:
                    best[i] = max(best.get(i, -2.0), values[place])
        out.extend((own, i, v) for v, i in sorted((-v, i) for i, v in best.items())[:k])
    found = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return found.assign(score=-found["score"])


def _blocks(queries: DataFrame) -> DataFrame:
    """Queries packed into rows of about BLOCK_ROWS, numbered by part."""
    total = queries.agg(F.count(F.lit(1))).first()[0]
    n = max(1, -(-total // BLOCK_ROWS))
    dealt = queries.distinct().withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dims": key[0], "part": [key[1] // GROUP_BLOCKS], "asked": [part["vec_id"].to_numpy(np.int64).tobytes()],
                             "matrix": [_packed(part["embedding"]).tobytes()]})

    packed = dealt.groupBy("dims", "block").applyInPandas(work, "dims int, part long, asked binary, matrix binary")
    return written(packed, "queries")


def search(index: DataFrame, queries: DataFrame, k: int = 5, width: int = SEARCH_WIDTH) -> DataFrame:
    """The k nearest indexed vectors of each query: query_id, rank, vec_id, score."""
    blocks = _blocks(queries)
    shards = index.groupBy("dims").agg(F.collect_list("shard").alias("shards"))
    parts = blocks.groupBy("dims").agg(F.max("part").alias("parts"))
    # one row per dimension on either small side
    dealt = blocks.join(F.broadcast(shards), "dims").select("dims", F.explode("shards").alias("shard"), "part", "asked", "matrix")
    graphs = index.join(F.broadcast(parts), "dims").select(
        *[F.col(c).alias(f"g_{c}") for c in index.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts"))).alias("g_part"))

    def work(key: tuple, asked: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if len(graph):
            shard = _loaded(graph.iloc[0])
            for ids, matrix in zip(asked["asked"], asked["matrix"]):
                ids = np.frombuffer(ids, np.int64)
                found.append(_in_shard(shard, ids, np.frombuffer(matrix, np.float64).reshape(len(ids), -1), k, width))
        return pd.concat(found)

    found = dealt.groupBy("dims", "shard", "part").cogroup(graphs.groupBy("g_dims", "g_shard", "g_part")).applyInPandas(work, FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(
        W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, width: int = SEARCH_WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest others of every row whose id is divisible by ``every``."""
    rows = written(vectors(embeddings), "rows")
    return search(build_index(rows, k, shard_rows), rows.filter(F.col("vec_id") % every == 0), k, width)


def recall(found: DataFrame, embeddings: DataFrame, ids: list[int], k: int = 5) -> float:
    """Share of the true k nearest of the given queries that were found, by comparing all rows with them.

    The queries are a stated, short list; their vectors travel to all rows.
    """
    rows = vectors(embeddings)
    asked = rows.filter(F.col("vec_id").isin(ids)).collect()
    if not asked:
        return 1.0
    own = np.array([r["vec_id"] for r in asked])
    matrix = [np.array(r["embedding"]) for r in asked]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for dims, same in part.groupby("dims"):
                all_of = _packed(same["embedding"])
                for i, v in zip(own, matrix):
                    if len(v) == dims:
                        values = cosines(v[None, :], all_of[None, :, :])[0]
                        other = same["vec_id"].to_numpy() != i
                        top = np.argsort(-values[other], kind="stable")[:k + 1]
                        yield pd.DataFrame({"query_id": i, "vec_id": same["vec_id"].to_numpy()[other][top], "score": values[other][top]})

    near = rows.mapInPandas(work, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    true = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    worst = true.groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("wanted"))
    hits = found.join(worst, "query_id", "right").groupBy("query_id").agg(
        F.count_if(F.col("score") >= F.col("worst")).alias("hits"), F.first("wanted").alias("wanted"))
    total = hits.agg(F.sum(F.least("hits", "wanted")), F.sum("wanted")).first()
    return total[0] / total[1]
