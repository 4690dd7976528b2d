"""A trie over the turns of conversations, from adaptive radix trees.

A turn's id is 16 bytes, the head of a SHA-256 over its role and text, so ids
have a fixed width, need no numbering and compare as big-endian numbers. A
conversation's key is the ids of its turns in a row. Keys are sorted over the
cluster into ranges of about ``RANGE_TURNS`` turns, equal keys by conversation
id, and each range becomes one adaptive radix tree: inner nodes of 4, 16, 48 or
256 places that grow when they are full, with the bytes all keys below share
kept in the node. Only depths at whole turns are nodes of the trie; a long
shared path holds several of them and a split inside an id none.

A trie node whose keys reach over the end of a range is met in each range it
touches. Ranges know the last key before and the first key behind them, so a
node is counted once, in the range where it begins, and a childless one where
it ends; every column is then a sum or a minimum over ranges. Such nodes are
few: per border those on the shared path. Only they are grouped again, and only
their children need their final least member.

Defined results. Null roles and texts are empty. Turns go by number, null
first, then by role and turn id, so repeated rows are repeated turns. A null
conversation id names no conversation and takes no part. An empty table gives
no rows, not even a root. Other columns are ignored, whatever their names. A
conversation is one row of 16 bytes a turn, up to the 2 GB of a row; its text
stays where it was read. The digest over the members that end in one node is
sequential: it is one task's stream over blocks of ids, never held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

WIDTH = 16
#: Turns in one range of keys, and ids in one block of members.
RANGE_TURNS, BLOCK = 200_000, 65_536
GROUP, HEADS = 5, 9

SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
PARTIAL = ("range long, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
           "n_leaves long, saved_tokens long, ends_sha256 string, ends array<binary>")


def sequences(turns: DataFrame) -> DataFrame:
    """One row per conversation: its turn ids in order, ``ids``, and the texts' bytes, ``sizes``."""
    role, text = text_of("role"), text_of("text")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(F.unhex(digest), 1, WIDTH).alias("id"),
                 F.octet_length(text).cast("long").alias("size")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: t["id"]).alias("ids"), F.transform("t", lambda t: t["size"]).alias("sizes"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the first of its group of five.

    At most eight turns of a group's first conversation are ever taken, so only these travel.
    """
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = convs.filter(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("first"), F.slice("ids", 1, HEADS - 1).alias("head_ids"), F.slice("sizes", 1, HEADS - 1).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")

    def joined(head: str, own: str) -> Column:
        rest = F.slice(F.col(own), h + 1, F.greatest(F.size(own) - h, F.lit(0)))
        return F.when(F.col(head).isNull(), rest).otherwise(F.concat(F.slice(F.col(head), F.lit(1), h), rest))

    both = convs.withColumn("first", first).join(heads, "first", "left")
    return both.select("conv_id", joined("head_ids", "ids").alias("ids"), joined("head_sizes", "sizes").alias("sizes"))


class Inner:
    """An inner node of a radix tree: children by their next byte, in a layout that grows.

    Layouts of 4 and 16 places keep sorted bytes beside their children, that of
    48 a table from bytes to places, that of 256 one place per byte.
    """

    __slots__ = ("path", "size", "bytes", "slots", "leaf")

    def __init__(self, path: bytes, leaf: Leaf | None = None):
        self.path, self.leaf = path, leaf
        self.size = 4
        self.bytes = bytearray()
        self.slots: list = []

    def find(self, byte: int):
        if self.size <= 16:
            at = self.bytes.find(byte)
            return self.slots[at] if at >= 0 else None
        if self.size == 48:
            at = self.bytes[byte]
            return self.slots[at - 1] if at else None
        return self.slots[byte]

    def put(self, byte: int, child) -> None:
        """Adds a child, or puts another one in its place."""
        if self.size <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.slots[at] = child
                return
            if len(self.slots) == self.size:
                self._grow()
                self.put(byte, child)
                return
            at = sum(b < byte for b in self.bytes)
            self.bytes.insert(at, byte)
            self.slots.insert(at, child)
        elif self.size == 48:
            if self.bytes[byte]:
                self.slots[self.bytes[byte] - 1] = child
            elif len(self.slots) == 48:
                self._grow()
                self.put(byte, child)
            else:
                self.slots.append(child)
                self.bytes[byte] = len(self.slots)
        else:
            self.slots[byte] = child

    def _grow(self) -> None:
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            table = bytearray(256)
            for place, byte in enumerate(self.bytes):
                table[byte] = place + 1
            self.size, self.bytes = 48, table
        else:
            self.slots = [self.slots[place - 1] if place else None for place in self.bytes]
            self.size, self.bytes = 256, bytearray()

    def children(self) -> Iterator:
        """Children by ascending byte."""
        if self.size == 48:
            yield from (self.slots[place - 1] for place in self.bytes if place)
        else:
            yield from (child for child in self.slots if child is not None)


class Leaf:
    """The rest of a key, and the rows that have this key."""

    __slots__ = ("path", "first", "last")

    def __init__(self, path: bytes, row: int):
        self.path, self.first, self.last = path, row, row


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common head of two byte strings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        low, n = (mid, n) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class RadixTree:
    """Adaptive radix tree of keys that come in ascending order; equal keys share a leaf."""

    def __init__(self):
        self.root = Inner(b"")

    def insert(self, key: bytes, row: int) -> None:
        node, above, at = self.root, None, 0
        while True:
            path = node.path
            common = len(path) if key.startswith(path, at) else _shared(path, key[at:at + len(path)])
            if common < len(path):
                # the key leaves inside the shared bytes: split them
                split = Inner(path[:common])
                node.path = path[common:]
                split.put(node.path[0], node)
                self._add(split, key, at + common, row)
                above.put(split.path[0] if split.path else key[at], split)
                return
            at += common
            if isinstance(node, Leaf):
                if at == len(key):
                    node.last = row
                    return
                # a longer key: the leaf becomes what ends at an inner node
                inner = Inner(path, Leaf(b"", node.first))
                inner.leaf.last = node.last
                self._add(inner, key, at, row)
                above.put(path[0], inner)
                return
            child = node.find(key[at]) if at < len(key) else None
            if child is None:
                self._add(node, key, at, row)
                return
            node, above = child, node

    @staticmethod
    def _add(node: Inner, key: bytes, at: int, row: int) -> None:
        if at < len(key):
            node.put(key[at], Leaf(key[at:], row))
        elif node.leaf is None:
            node.leaf = Leaf(b"", row)
        else:
            node.leaf.last = row


def _spans(tree: RadixTree) -> Iterator[tuple[int, int, int, int]]:
    """(bytes above, bytes down to its end, first row, last row) of every node, children before parents."""
    stack: list = [(tree.root, 0, False)]
    spans: list[tuple[int, int]] = []
    while stack:
        node, above, seen = stack.pop()
        below = above + len(node.path)
        if isinstance(node, Leaf):
            spans.append((node.first, node.last))
        elif not seen:
            stack.append((node, above, True))
            stack.extend((child, below, False) for child in node.children())
            continue
        else:
            own = [spans.pop() for _ in node.children()]
            if node.leaf is not None:
                own.append((node.leaf.first, node.leaf.last))
            spans.append((min(f for f, _ in own), max(n for _, n in own)))
        yield above, below, *spans[-1]


def _turn_nodes(tree: RadixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth in turns, first and last row of every whole turn on the tree's paths, parents before children."""
    found = [(0, 0, 0)]
    for above, below, first, last in _spans(tree):
        found[0] = (0, 0, last)  # the root of all comes last
        found.extend((d, first, last) for d in range(above // WIDTH + 1, below // WIDTH + 1))
    depth, first, last = np.array(found, np.int64).T
    order = np.lexsort((depth, first))
    return depth[order], first[order], last[order]


def trie_of_range(number: int, keys: list[bytes], sizes: list[np.ndarray], convs: np.ndarray,
                  before: bytes | None, behind: bytes | None) -> pd.DataFrame:
    """The trie nodes of one range of sorted keys, as far as this range knows them.

    Keys ascend, equal ones by conversation; ``before`` and ``behind`` are the
    keys next to the range.
    """
    tree = RadixTree()
    for row, key in enumerate(keys):
        tree.insert(key, row)
    depth, first, last = _turn_nodes(tree)
    n = len(depth)
    begins = (first > 0) | (depth > (_shared(before, keys[0]) // WIDTH if before is not None else -1))
    reaches = (last == len(keys) - 1) & (depth <= (_shared(behind, keys[-1]) // WIDTH if behind is not None else -1))
    shared = ~begins | reaches
    # rows that end in a node are its first ones
    heads = np.flatnonzero([True, *(a != b for a, b in zip(keys, keys[1:]))])
    same_until = np.repeat(np.append(heads[1:], len(keys)), np.diff(np.append(heads, len(keys))))
    own_until = np.where(np.array([len(k) for k in keys])[first] == depth * WIDTH, same_until[first], first)
    size = np.array([sizes[f][d - 1] if d else 0 for f, d in zip(first, depth)], np.int64)
    least = np.where(own_until > first, convs[first], np.iinfo(np.int64).max)
    members = last - first + 1
    saved = members * size - np.where(begins, size, 0)
    # members of a node come before its children, so a node that ends here with nothing but members has no children
    leaves = ((own_until == last + 1) & ~reaches).astype(np.int64)
    children = np.zeros(n, np.int64)
    parent = np.full(n, -1)
    path: list[int] = []
    for k in range(n):
        del path[depth[k]:]
        if path:
            parent[k] = path[-1]
        path.append(k)
    for k in range(n - 1, 0, -1):
        p = parent[k]
        saved[p] += saved[k]
        leaves[p] += leaves[k]
        children[p] += begins[k]
        least[p] = min(least[p], least[k])

    def name(k: int) -> bytes:
        return hashlib.sha256(keys[first[k]][:depth[k] * WIDTH]).digest()

    def digest(k: int) -> str | None:
        return None if shared[k] else hashlib.sha256(",".join(map(str, convs[first[k]:own_until[k]].tolist())).encode()).hexdigest()

    def blocks(k: int) -> list[bytes]:
        return [convs[i:min(i + BLOCK, own_until[k])].tobytes() for i in range(first[k], own_until[k], BLOCK)] if shared[k] else []

    return pd.DataFrame({
        "range": number, "node": [name(k) if shared[k] else None for k in range(n)],
        "parent": [name(p) if p >= 0 and shared[p] else None for p in parent], "depth": depth, "conv_id": least,
        "parent_conv_id": pd.array([int(least[p]) if p >= 0 and not shared[p] else None for p in parent], "Int64"),
        "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "ends_sha256": [digest(k) for k in range(n)], "ends": [blocks(k) for k in range(n)]})


def _partial(convs: DataFrame) -> DataFrame:
    """Trie nodes per range of keys: whole ones, and parts of those that ranges share."""
    size = convs.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    key = F.unhex(F.array_join(F.transform("ids", lambda i: F.hex(i)), ""))
    ranges = convs.select("conv_id", key.alias("key"), "sizes").repartitionByRange(
        max(1, -(-size // RANGE_TURNS)), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ranges = written(ranges.withColumn("range", F.spark_partition_id().cast("long")), "trie-keys")
    ends = ranges.groupBy(F.col("range").alias("at")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # ranges are numbered without gaps: every one but the last holds its own upper bound
    borders = ends.select("at").join(ends.select((F.col("at") + 1).alias("at"), F.col("high").alias("before")), "at", "left").join(
        ends.select((F.col("at") - 1).alias("at"), F.col("low").alias("behind")), "at", "left")

    def work(key: tuple, rows: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "conv_id"])
        side = border.iloc[0]
        return trie_of_range(int(key[0]), rows["key"].tolist(), rows["sizes"].tolist(), rows["conv_id"].to_numpy(np.int64),
                             side["before"], side["behind"])

    return written(ranges.groupBy("range").cogroup(borders.groupBy("at")).applyInPandas(work, PARTIAL), "trie-parts")


def _end_digests(parts: DataFrame) -> DataFrame:
    """Digest over the members that end in a node, streamed over their blocks in order."""
    blocks = parts.select("node", "range", F.posexplode("ends").alias("place", "block"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            done = []
            for name, block in zip(batch["node"], batch["block"]):
                listed = ",".join(map(str, np.frombuffer(block, np.int64).tolist())).encode()
                if name == node:
                    state.update(b"," + listed)
                else:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(listed)
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])

    dealt = blocks.repartition("node").sortWithinPartitions("node", "range", "place").select("node", "block")
    return dealt.mapInPandas(work, "node binary, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations given as ``conv_id``, ``ids`` and ``sizes``."""
    parts = _partial(convs)
    apart = parts.filter(F.col("node").isNotNull())
    whole = apart.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in SUMS])
    nothing = hashlib.sha256(b"").hexdigest()
    whole = written(whole.join(_end_digests(apart), "node", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(nothing))), "trie-borders")
    every = parts.filter(F.col("node").isNull()).drop("ends", "range").unionByName(whole)
    above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    return every.join(above, "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), *SUMS, "ends_sha256")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first of its group of five."""
    return trie(written(rebuilt(written(sequences(turns), "turn-ids")), "rebuilt"))
