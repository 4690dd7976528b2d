"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set is its distinct five-word shingles. Of K minwise coordinates,
two sets of similarity s agree in about s K. A pair is a candidate if at least
T agree; T is the largest count at which a pair at the asked similarity is
missed with a chance of about one in ten million (38 of 64 at 0.85). Candidates are confirmed on the full sets of words.

Documents are posted under (coordinate, value) pairs. With all documents'
pairs in one order, rarest first, two that share T of K meet within the first
K - T + 1 of each (prefix), and a document of which fewer than T pairs occur
anywhere else needs no posting at all (skip). So frequent passages are posted
only by documents that consist of little else.

Links are only needed up to connectivity, and a group of near copies is never
expanded into rows of all pairs: first each posting list is tried against a few
heads and the confirmed links are closed to components. Lists that still hold
several components are then counted block against block inside tasks: a pair of
different components is taken up under the smallest key both are posted under,
confirmed where it was counted, and only a spanning set of the links leaves the
task. So no link between different components is left out.

Defined results. Null or empty text, or only white space: an empty set, linked
with nothing, its own component. Fewer than five words: the whole sequence is
the one shingle. Documents with equal sets are one class, represented by its
smallest id. Rows with the same id are one node. Null ids: linked with nothing,
component null, kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_split, text_of, written
from .components import components

WORDS, COORDINATES = 5, 64
#: Chance that a pair at exactly the asked similarity is no candidate.
MISS = 1.6e-7
#: Heads each posting list's members may be tried against first; lists longer than a block are joined block by block.
HEADS, BLOCK = 6, 512
_UP = {i: i + 32 for i in range(65, 91)}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def agreeing(percent: int) -> int:
    """Coordinates that must agree: the most that miss a pair of that similarity with chance MISS at most."""
    s, below, need = percent / 100, 0.0, 0
    while need < COORDINATES:
        below += math.comb(COORDINATES, need) * s ** need * (1 - s) ** (COORDINATES - need)
        if below > MISS:
            break
        need += 1
    return max(need, 1)


_SEEDS = _mix(np.arange(1, 2 * COORDINATES + WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD, _PLACE = _SEEDS[:COORDINATES, None], _SEEDS[COORDINATES:2 * COORDINATES, None] | np.uint64(1), _SEEDS[2 * COORDINATES:] | np.uint64(1)


class WordHashes(dict):
    """64-bit hash of each word, A-Z lowered; remembered, and forgotten when many."""

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.translate(_UP).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) > 200_000:
            self.clear()
        self[word] = value
        return value


def shingle_hashes(words: list[str], known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's shingles."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    if len(h) < WORDS:
        return _mix((h * _PLACE[:len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    total = h[:n] * _PLACE[0]
    for i in range(1, WORDS):
        total += h[i:i + n] * _PLACE[i]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least of each coordinate's 32-bit hash over the set, a slice at a time."""
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = (((shingles[None, at:at + 4096] ^ _XOR) * _ODD) >> np.uint64(32)).min(axis=1)
        np.minimum(least, part, out=least)
    return least.astype(np.uint32).view(np.int32)


SIGNED = "doc_id long, n_shingles long, set_id string, sig array<int>"


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, set identity and signature of every document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sizes, names, sigs = [], [], []
            for text in batch["text"]:
                shingles = shingle_hashes(blank_split(text), known)
                sizes.append(len(shingles))
                names.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest() if len(shingles) else None)
                sigs.append(signature(shingles) if len(shingles) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": sizes, "set_id": names, "sig": sigs})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, SIGNED)


def _postings(classes: DataFrame, agree: int) -> DataFrame:
    """(key, rep) of the pairs under which each class representative is posted, rarest first."""
    key = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    tokens = classes.select("rep", F.posexplode("sig")).select("rep", key.alias("key"))
    often = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return tokens.join(often, "key").groupBy("rep").agg(F.count(F.lit(1)).alias("shared"), F.collect_list(F.struct("n", "key")).alias("all")).filter(
        F.col("shared") >= agree).select("rep", F.explode(F.slice(F.sort_array("all"), F.lit(1), F.col("shared").cast("int") - (agree - 1))).alias("p")).select(
        "rep", F.col("p.key").alias("key"))


def _agreeing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _agree(pairs: DataFrame, sigs: DataFrame, agree: int) -> DataFrame:
    """Pairs with enough agreeing coordinates."""
    left, right = (sigs.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").filter(_agreeing(F.col("sig_a"), F.col("sig_b")) >= agree).select("a", "b")


def shingle_set(text: str) -> frozenset:
    words = blank_split(text.translate(_UP))
    if len(words) < WORDS:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(WORDS))))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, frozenset()
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(batch["a"], batch["text_a"], batch["text_b"]):
                if last != (a, text_a):
                    last, mine = (a, text_a), shingle_set(text_a)
                other = shingle_set(text_b)
                both = len(mine & other)
                keep.append(both > 0 and 100 * both >= percent * (len(mine) + len(other) - both))
            yield batch.loc[keep, ["a", "b"]]

    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long").distinct()


_OPEN = "key long, low long, high long, docs array<long>, pairs binary"


def _counted(key: int, mine: np.ndarray, rep: np.ndarray, component: np.ndarray, size: np.ndarray, sig: np.ndarray,
             posted: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of a block pair that agree enough, lie in different components and have no smaller common key."""
    if len(rep) <= 64:
        agree = (sig[:, None, :] == sig[None, :, :]).sum(axis=2)
    else:
        agree = np.zeros((len(rep), len(rep)), np.uint8)
        for j in range(sig.shape[1]):
            agree += sig[:, None, j] == sig[None, :, j]
    near = (agree >= agreeing(percent)) & (component[:, None] != component[None, :]) & (rep[:, None] < rep[None, :])
    near &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    if mine.min() != mine.max():
        near &= mine[:, None] != mine[None, :]
    if near.any():
        owner = np.repeat(np.arange(len(rep)), [len(k) for k in posted])
        keys = np.concatenate(posted)
        owner, keys = owner[keys < key], keys[keys < key]
        _, column, n = np.unique(keys, return_inverse=True, return_counts=True)
        common = np.flatnonzero(n[column] > 1) if len(keys) else np.zeros(0, np.int64)
        if len(common):
            _, column = np.unique(column[common], return_inverse=True)
            for at in range(0, int(column.max()) + 1, 2048):
                part = (column >= at) & (column < at + 2048)
                has = np.zeros((len(rep), 2048), np.float32)
                has[owner[common][part], column[part] - at] = 1
                near &= has @ has.T == 0
    return np.nonzero(near)


def _open_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of each block pair, packed: the documents and pairs of their places."""
    def emit(group: pa.Table) -> tuple | None:
        column = lambda name: group[name].to_numpy()
        rep = column("rep")
        if len(rep) < 2:
            return None
        key = int(group["key"][0].as_py())
        sig = group["sig"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        a, b = _counted(key, column("mine"), rep, column("component"), column("n"), sig, [np.asarray(k) for k in group["posted"].to_pylist()], percent)
        if not len(a):
            return None
        docs, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        return key, group["low"][0].as_py(), group["high"][0].as_py(), rep[docs].tolist(), places.astype(np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        waiting: list[pa.Table] = []
        last = None

        def done(tables: list[pa.Table]) -> list[pa.RecordBatch]:
            row = emit(pa.concat_tables(tables)) if tables else None
            return [pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["key", "low", "high", "docs", "pairs"])] if row else []

        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids = np.stack([table[c].to_numpy() for c in ("key", "low", "high")], axis=1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                now = tuple(ids[i].tolist())
                if now != last:
                    yield from done(waiting)
                    waiting, last = [], now
                waiting.append(table.slice(i, j - i))
        yield from done(waiting)

    dealt = lists.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.select("key", "low", "high", "mine", "rep", "component", "n", "sig", "posted").mapInArrow(run, _OPEN)


def _spanning(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span what the packed pairs confirm, block pair by block pair."""
    def run(found: pa.Table, packed: pa.Table) -> pa.Table:
        known, sets, links = WordHashes(), {}, []
        for doc, text in zip(found["doc"].to_pylist(), found["text"].to_pylist()):
            sets.setdefault(doc, []).append(shingle_hashes(blank_split(text), known))
        for docs, blob in zip(packed["docs"].to_pylist(), packed["pairs"].to_pylist()):
            a, b = np.frombuffer(blob, np.int32).reshape(2, -1)
            root = np.arange(len(docs))
            for i, j in zip(a.tolist(), b.tolist()):
                if root[i] != root[j] and any(similar(x, y, percent) for x in sets.get(docs[i], ()) for y in sets.get(docs[j], ())):
                    links.append((docs[i], docs[j]))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    key = ["key", "low", "high"]
    asked = pairs.select(*[F.col(c).alias(f"for_{c}") for c in key], F.explode("docs").alias("doc"))
    wanted = asked.join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")
    return wanted.groupBy(*[f"for_{c}" for c in key]).cogroup(pairs.groupBy(*key)).applyInArrow(run, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes reach the similarity."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = written(signed(docs, id_col, text_col), "signed")
    classes = written(rows.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    postings = written(_postings(classes, agreeing(percent)), "postings")
    posted = postings.groupBy("rep").agg(F.collect_set("key").alias("posted"))
    sigs = written(classes.join(posted, "rep").select("rep", "n", "sig", "posted"), "posted")
    texts = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).join(
        sigs.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "posted-texts")

    # a few heads per list
    drawn = F.xxhash64("rep", F.pmod(F.xxhash64("key"), F.lit(HEADS)))
    heads = postings.groupBy("key").agg(F.min_by("rep", drawn).alias("head"))
    stars = postings.join(heads, "key").filter("rep <> head").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
    first = written(_confirmed(_agree(stars, sigs, agreeing(percent)), texts, percent), "first-links")
    labels = components(first)

    # what is left: lists with several components, block against block
    placed = postings.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"))
    several = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("posts")).filter(
        "least <> most").select("key", F.ceil(F.col("posts") / BLOCK).alias("blocks"))
    dealt = placed.join(several, "key").join(sigs, "rep").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn(
        "low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    second = _spanning(written(_open_pairs(dealt, percent), "open-pairs"), texts, percent)
    final = components(first.unionByName(second))

    reps = classes.select(F.col("set_id").alias("class_id"), "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "class_id", F.coalesce("component", "rep").alias("class_component"))
    joined = rows.select("doc_id", "n_shingles", "set_id").join(reps, F.col("set_id") == F.col("class_id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents that stay: the least id of each group, once; rows without an id all stay."""
    found = written(near_duplicates(docs, percent), "near-duplicates")
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(written(gone, "gone"), "doc_id", "left_anti")
    again = written(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").unionByName(once)
