"""Runs of periodic words, found by internal pattern matching.

A run is a stretch of consecutive words in which words ``q`` apart are equal,
``q`` is the smallest such distance, the stretch holds at least ``max(12, 2q)``
words and no neighbouring word extends it.

Words become numbers per text, so that equal numbers mean equal words of one
text, and the texts of an Arrow batch are worked on together as one sequence.
Prefix doubling names every block of 1, 2, 4, ... words and leaves a suffix
array, in which the suffixes that start with one name stand side by side. A
wavelet tree over the part of that array whose suffixes repeat four words
answers the range successor: the next place, from a given one on, where a block
occurs. A text is cut into dyadic blocks. A block of ``b`` words asks for its
occurrences 2b - 1 to 4b - 2 words further on, the least block of four for all
distances up to 14: a run of period ``q`` in that range holds in its first
period a whole block, which occurs again ``q`` words later. For ``q`` = 6 and
twelve words the block may stand in the second period, so blocks of four also
look six words back. Where a block overlaps its own next occurrence it lies in
a stretch of a short period, and its occurrences inside that stretch, an
arithmetic progression, give multiples of the short period; they are passed
over. Every other occurrence gives a candidate period. The longest common
extensions to both sides, by names from large to small, give its stretch;
stretches with the same ends keep the smallest period.

Defined results. Null text: empty. No words: no run, nothing kept. Null ids
have no decimal digits, so such a text is not edited. Repeated rows give
repeated results. An empty table gives no rows. Other columns are ignored,
whatever their names. A text is one task's work: about 150 bytes of memory a
word, more for names of long blocks if much of it repeats.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Least length of a run, and of the blocks that ask for their occurrences.
LEAST_LENGTH, LEAST_BLOCK = 12, 4
#: Words worked on together; a longer text stands alone.
CHUNK_WORDS = 400_000

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")
RUNS_SCHEMA = "doc_id long, start long, length long, period long"


class Names:
    """Names of all blocks of 2^k symbols: equal names, equal blocks.

    A name is the first place in the suffix array of a suffix that starts with
    the block, so the names of level k also say where its suffixes stand.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        first = np.ones(n, bool)
        first[1:] = symbols[order[1:]] != symbols[order[:-1]]
        self.levels: list[np.ndarray] = []
        while True:
            heads = np.flatnonzero(first)
            sizes = np.diff(np.append(heads, n))
            # one more place than there are symbols: extensions that reach the end meet no equal name
            level = np.full(n + 1, -1, np.int32)
            level[order] = np.repeat(heads, sizes)
            self.levels.append(level)
            shared = np.repeat(sizes > 1, sizes)
            if not shared.any():
                break
            step = 1 << (len(self.levels) - 1)
            places = np.flatnonzero(shared)
            suffixes = order[places]
            beyond = suffixes + step
            after = np.where(beyond < ends[suffixes], level[np.minimum(beyond, n)].astype(np.int64) + 1, 0)
            key = level[suffixes].astype(np.int64) * (n + 1) + after
            by_key = np.argsort(key, kind="stable")
            order[places] = suffixes[by_key]
            key = key[by_key]
            first[places[1:]] = key[1:] != key[:-1]
        self.order = order

    def common_right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols from ``x`` and from ``y`` (behind ``x``) on are equal."""
        at = y.copy()
        gap = y - x
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            at = np.where(level[at - gap] == level[at], at + (1 << k), at)
        return at - y

    def common_left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols before ``x`` and before ``y`` are equal."""
        at = x.copy()
        gap = y - x
        for k in range(len(self.levels) - 1, -1, -1):
            level, back = self.levels[k], at - (1 << k)
            safe = np.maximum(back, 0)
            at = np.where((back >= 0) & (level[safe] == level[safe + gap]), back, at)
        return x - at


class WaveletTree:
    """Order statistics of ranges of an array, one bit of the values per level."""

    def __init__(self, values: np.ndarray, top: int):
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.bits = max(int(top).bit_length(), 1)
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``least`` in each range, -1 where there is none."""
        lo, hi, smaller = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for depth, ones in enumerate(self.ones):
            bit = least >> (self.bits - 1 - depth) & 1
            a, b = ones[lo], ones[hi]
            smaller += np.where(bit == 1, (hi - b) - (lo - a), 0)
            lo = np.where(bit == 1, self.zeros[depth] + a, lo - a)
            hi = np.where(bit == 1, self.zeros[depth] + b, hi - b)
        found = (smaller < high - low) & (least >> self.bits == 0)
        lo, hi, rank = low[found], high[found], smaller[found]
        value = np.zeros(len(lo), np.int64)
        for depth, ones in enumerate(self.ones):
            a, b = ones[lo], ones[hi]
            in_zeros = (hi - b) - (lo - a)
            right = rank >= in_zeros
            value = value << 1 | right
            lo = np.where(right, self.zeros[depth] + a, lo - a)
            hi = np.where(right, self.zeros[depth] + b, hi - b)
            rank = np.where(right, rank - in_zeros, rank)
        out = np.full(len(low), -1, np.int64)
        out[found] = value
        return out


def candidates(names: Names, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and candidate periods, from the occurrences of dyadic blocks near themselves."""
    n = len(starts)
    level_of_least = LEAST_BLOCK.bit_length() - 1
    none = np.empty(0, np.int64)
    if len(names.levels) <= level_of_least:
        return none, none
    counts = np.bincount(names.levels[level_of_least][:n], minlength=n + 1)
    repeated = counts[names.levels[level_of_least][names.order]] > 1
    if not repeated.any():
        return none, none
    kept_before = np.concatenate([[0], np.cumsum(repeated)])
    tree = WaveletTree(names.order[repeated].astype(np.int64), n)
    found_at, found_period = [none], [none]
    for k in range(level_of_least, len(names.levels)):
        b, level = 1 << k, names.levels[k]
        share = np.bincount(level[:n], minlength=n + 1)
        at = np.flatnonzero(((np.arange(n) - starts) % b == 0) & (share[level[:n]] > 1))
        at = at[at + b <= ends[at]]
        if not len(at):
            continue
        low = kept_before[level[at]]
        high = kept_before[level[at] + share[level[at]]]
        nearest, furthest = (1, 4 * b - 2) if b == LEAST_BLOCK else (2 * b - 1, 4 * b - 2)
        if b == LEAST_BLOCK:
            back = at - 6
            hit = (back >= starts[at]) & (tree.successor(low, high, np.maximum(back, 0)) == back)
            found_at.append(back[hit])
            found_period.append(np.full(int(hit.sum()), 6))
        following = tree.successor(low, high, at + 1)
        near = (following >= 0) & (following <= at + furthest)
        at, low, high, following = at[near], low[near], high[near], following[near]
        # a block that overlaps its next occurrence: pass over the stretch of that period
        gap = following - at
        least = np.maximum(at + nearest, following)
        short = np.flatnonzero(gap <= b // 2)
        if len(short):
            if nearest == 1:
                found_at.append(at[short])
                found_period.append(gap[short])
            stretch = following[short] + names.common_right(at[short], following[short])
            least[short] = np.maximum(least[short], stretch - b + 1)
        while len(at):
            hit = tree.successor(low, high, least)
            on = (hit >= 0) & (hit <= at + furthest)
            at, low, high, hit = at[on], low[on], high[on], hit[on]
            found_at.append(at)
            found_period.append(hit - at)
            least = hit + 1
    return np.concatenate(found_at), np.concatenate(found_period)


def find_runs(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period.

    ``symbols`` are the words of all texts in a row, as numbers that no two
    texts share; ``sizes`` are the texts' numbers of words.
    """
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    if not len(symbols):
        return np.empty((0, 4), np.int64)
    starts, ends = bounds[text], bounds[text + 1]
    names = Names(symbols, ends)
    at, period = candidates(names, starts, ends)
    if not len(at):
        return np.empty((0, 4), np.int64)
    pairs = np.unique(np.stack([at, period], 1), axis=0)
    at, period = pairs[:, 0], pairs[:, 1]
    before = names.common_left(at, at + period)
    length = before + period + names.common_right(at, at + period)
    long = length >= np.maximum(LEAST_LENGTH, 2 * period)
    begin, length, period = (at - before)[long], length[long], period[long]
    order = np.lexsort((period, length, begin))
    begin, length, period = begin[order], length[order], period[order]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    begin, length, period = begin[new], length[new], period[new]
    rows = np.stack([text[begin], begin - bounds[text[begin]], length, period], 1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of all texts as numbers, words per text, and the word of each number."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    owner = pc.list_parent_indices(parts).to_numpy()
    flat = parts.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(filled).dictionary_encode()
    sizes = np.bincount(owner[filled.to_numpy(zero_copy_only=False)], minlength=len(texts)).astype(np.int64)
    return coded.indices.to_numpy().astype(np.int64), sizes, coded.dictionary


def edited(codes: np.ndarray, h: int) -> np.ndarray:
    """A text's words, made periodic from place ``a`` on where the hash of its id says so."""
    n, g = len(codes), h // 10
    if h % 10 or not n:
        return codes
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([codes[:a], codes[a + np.arange(n - a) % p]])


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, pa.Array]]:
    """Texts of a batch in groups of about CHUNK_WORDS words, with their ids."""
    ids, texts = batch.column(0), batch.column(1)
    # a word takes two bytes at least, its blank counted, and about six in most languages
    weight = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // (6 * CHUNK_WORDS)
    cuts = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts, cuts[1:]):
        if lo < hi:
            yield ids.slice(lo, hi - lo).to_pylist(), *_numbered(texts.slice(lo, hi - lo))


def _searched(batch: pa.RecordBatch, edit: bool) -> Iterator[tuple[list, list[np.ndarray], pa.Array, np.ndarray]]:
    """Ids, word numbers per text, words, and the runs of each chunk of a batch."""
    for ids, codes, sizes, words in _chunks(batch):
        per_text = np.split(codes, np.cumsum(sizes)[:-1])
        if edit:
            per_text = [c if i is None else edited(c, zlib.crc32(str(i).encode())) for i, c in zip(ids, per_text)]
        text = np.repeat(np.arange(len(ids)), sizes)
        symbols = text * max(len(words), 1) + (np.concatenate(per_text) if len(per_text) else codes)
        yield ids, per_text, words, find_runs(symbols, sizes)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _summaries(ids: list, per_text: list[np.ndarray], words: pa.Array, runs: np.ndarray) -> pa.RecordBatch:
    out = []
    by_text = np.searchsorted(runs[:, 0], np.arange(len(ids) + 1))
    for t, (doc_id, codes) in enumerate(zip(ids, per_text)):
        own = runs[by_text[t]:by_text[t + 1], 1:]
        kept = codes
        best: tuple = (None,) * 4
        if len(own):
            start, length, period = own.T
            k = np.lexsort((period, start, -length))[0]
            best = int(start[k]), int(length[k]), int(period[k]), int(1000 * length[k] // period[k])
            edge = np.zeros(len(codes) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            kept = codes[np.cumsum(edge[:-1]) == 0]
        text = " ".join(words.take(pa.array(kept)).to_pylist())
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in own.tolist())
        out.append((doc_id, len(own), *best, _digest(listed), _digest(text)))
    types = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                      [c.split()[0] for c in SCHEMA.split(", ")])


def runs(docs: DataFrame) -> DataFrame:
    """One row per run of the texts as they are: doc_id, start, length, period."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, _, found in _searched(batch, edit=False):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()).take(pa.array(found[:, 0])), *(pa.array(found[:, c]) for c in (1, 2, 3))],
                    ["doc_id", "start", "length", "period"])

    return _columns(docs).mapInArrow(work, RUNS_SCHEMA)


def summaries(docs: DataFrame, edit: bool = False) -> DataFrame:
    """Per text the number of runs, the longest, and digests of all runs and of the
    words that are left when each run keeps its first period only.

    With ``edit``, texts whose id hashes to a multiple of ten are made periodic first.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _searched(batch, edit):
                yield _summaries(*chunk)

    return _columns(docs).mapInArrow(work, SCHEMA)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
