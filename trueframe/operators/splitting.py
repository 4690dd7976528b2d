"""Bootstrap draws by splitting counts down a tree.

A replicate of n groups is n draws with replacement. Groups stand in cells of
``CELL`` by their dense ordinal, so the number of groups under any node of the
binary tree over cells follows from n alone. A node's draws are divided between
its halves by one binomial, whose random numbers are addressed by the seed and
the node; a task that holds a cell walks from the root to it and finds the same
counts as every other task. Inside the cell the draws fall on groups by
integers addressed by the seed, the cell and the block of replicates.
Multiplicities thus arise beside the groups' own rows: no draw is a row, is
joined or is shuffled. A task adds up what its cells give and emits one row per
replicate, or per replicate and score band, so the shuffle grows with tasks and
replicates and not with groups.

Sums of whole numbers are exact in double precision, so results are the same on
any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups in a cell, and replicates drawn at once inside one.
CELL, REPLICATES_AT_ONCE = 4096, 64


class CountTree:
    """Numbers of draws per cell in every replicate, found from the root down."""

    def __init__(self, groups: int, replicates: int, seed: int, cell: int = CELL):
        self.groups, self.replicates, self.seed, self.cell = groups, replicates, seed, cell
        self.cells = -(-groups // cell)
        # the last path: tasks meet their cells in order, so most of it serves the next cell too
        self.path: list[tuple[int, int, np.ndarray]] = [(0, self.cells, np.full(replicates, groups, np.int64))]

    def size(self, low: int, high: int) -> int:
        """Groups in cells from ``low`` up to ``high``."""
        return min(high * self.cell, self.groups) - low * self.cell

    def counts(self, cell: int) -> np.ndarray:
        while not self.path[-1][0] <= cell < self.path[-1][1]:
            self.path.pop()
        low, high, drawn = self.path[-1]
        while high - low > 1:
            middle = (low + high) // 2
            share = self.size(low, middle) / self.size(low, high)
            left = np.random.default_rng([self.seed, 0, low, high]).binomial(drawn, share)
            low, high, drawn = (low, middle, left) if cell < middle else (middle, high, drawn - left)
            self.path.append((low, high, drawn))
        return drawn

    def multiplicities(self, cell: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first replicate, replicates x groups of the cell) in blocks of replicates."""
        drawn, n = self.counts(cell), self.size(cell, cell + 1)
        for first in range(0, self.replicates, REPLICATES_AT_ONCE):
            part = drawn[first:first + REPLICATES_AT_ONCE]
            seats = np.random.default_rng([self.seed, 1, cell, first]).integers(0, n, int(part.sum()))
            seats += np.repeat(np.arange(len(part)) * n, part)
            yield first, np.bincount(seats, minlength=len(part) * n).reshape(len(part), n)


def by_cell(rows: DataFrame, columns: Sequence[str], work: Callable, schema: str) -> DataFrame:
    """``work`` gets the cells of a task, in order, as (cell, frame of its rows)."""
    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            for cell, part in batch.groupby("_cell", sort=True):
                if kept and kept[0]["_cell"].iloc[0] != cell:
                    yield int(kept[0]["_cell"].iloc[0]), pd.concat(kept)
                    kept = []
                kept.append(part)
        if kept:
            yield int(kept[0]["_cell"].iloc[0]), pd.concat(kept)

    dealt = rows.select("ordinal", *columns, F.floor(F.col("ordinal") / CELL).cast("long").alias("_cell"))
    return dealt.repartition("_cell").sortWithinPartitions("_cell").mapInPandas(lambda batches: work(cells(batches)), schema)


def split_sums(vectors: DataFrame, names: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Sums of ``names`` per replicate, from one row per group with its dense ``ordinal``."""
    groups, cell, names = vectors.count(), CELL, list(names)

    def work(cells: Iterator[tuple[int, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        tree, total = CountTree(groups, replicates, seed, cell), np.zeros((replicates, len(names)))
        found = False
        for number, rows in cells:
            found = True
            matrix = np.zeros((tree.size(number, number + 1), len(names)))
            matrix[rows["ordinal"].to_numpy() - number * cell] = rows[names].to_numpy(float)
            for first, times in tree.multiplicities(number):
                total[first:first + len(times)] += times @ matrix
        if found:
            out = pd.DataFrame(total, columns=names)
            out.insert(0, "replicate", np.arange(replicates))
            yield out

    parts = by_cell(vectors, names, work, "replicate long, " + ", ".join(f"`{n}` double" for n in names))
    return parts.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in names])


def split_histograms(cells: DataFrame, groups: int, replicates: int, seed: int) -> DataFrame:
    """Weighted positives and negatives per replicate and band.

    ``cells`` has rows (ordinal, band, pos, neg), any number for a group; bands
    are small numbers from 0.
    """
    size = CELL

    def work(found: Iterator[tuple[int, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        tree = CountTree(groups, replicates, seed, size)
        total: dict[str, np.ndarray] = {side: np.zeros((replicates, 0)) for side in ("pos", "neg")}
        for number, rows in found:
            rows = rows.sort_values("band")
            bands, starts = np.unique(rows["band"].to_numpy(), return_index=True)
            seat = rows["ordinal"].to_numpy() - number * size
            missing = int(bands[-1]) + 1 - total["pos"].shape[1]
            if missing > 0:
                total = {side: np.pad(t, ((0, 0), (0, missing))) for side, t in total.items()}
            for first, times in tree.multiplicities(number):
                drawn = times[:, seat]
                for side, t in total.items():
                    t[first:first + len(times), bands] += np.add.reduceat(drawn * rows[side].to_numpy(), starts, axis=1)
        pos, neg = total["pos"], total["neg"]
        for first in range(0, replicates, REPLICATES_AT_ONCE):
            replicate, band = np.nonzero((pos[first:first + REPLICATES_AT_ONCE] != 0) | (neg[first:first + REPLICATES_AT_ONCE] != 0))
            yield pd.DataFrame({"replicate": replicate + first, "band": band, "pos": pos[replicate + first, band].astype(np.int64),
                                "neg": neg[replicate + first, band].astype(np.int64)})

    parts = by_cell(cells, ["band", "pos", "neg"], work, "replicate long, band long, pos long, neg long")
    return parts.groupBy("replicate", "band").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
