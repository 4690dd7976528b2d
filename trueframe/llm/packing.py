"""Sum-of-squares packing of tokenised documents into sequences.

A document's ids are cut into pieces of at most one sequence only where they
are longer. Pieces are dealt into blocks by hash; inside a block each piece
goes to the open bin, or to a new one, that makes the sum of squared counts of
open bins per residual gap smallest. Pieces that fill a sequence are sequences
of their own.

Defined results. Null text: empty, so one piece holding the end id. Null ids are
kept. Repeated rows are separate documents that may share a sequence. An empty
table gives no rows. Other columns are ignored, whatever their names.

The text never moves: tokenising emits one small row per piece, those are
written once, and only they are shuffled by block.
"""

from __future__ import annotations

import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

CAPACITY = 4096
BLOCK = 65_536
END_ID = 1
#: Words in a worker's memory of ids; longer ones are encoded anew in each chunk.
REMEMBERED, LONGEST = 1_000_000, 64
#: Bytes of text worked on together; a longer text stands alone.
CHUNK_BYTES = 8 << 20
#: Words the tokenizer gets at once: its own notes on them are many times their ids.
TOGETHER = 16_384


class Memory:
    """Ids of words seen by this process: the words as one Arrow array, their ids
    as one table. When it is full it turns: words not met since the last turn go."""

    def __init__(self, limit: int = REMEMBERED):
        self.limit = limit
        self.words = pa.array([], pa.large_string())
        self.begin, self.width, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.table = np.zeros(0, "<u4")

    def turn(self) -> None:
        if len(self.words) < self.limit and len(self.table) < 16 * self.limit:
            return
        keep = np.flatnonzero(self.met)[-(self.limit // 2 + 1):]
        self.table = spans(self.table, self.begin[keep], self.width[keep])
        self.words, self.width, self.met = self.words.take(pa.array(keep)), self.width[keep], np.zeros(len(keep), bool)
        self.begin = np.cumsum(self.width) - self.width

    @property
    def young(self) -> list[str]:
        return self.words.to_pylist()

    def forget(self, lasting: int) -> None:
        """Only the first ``lasting`` words stay known."""
        self.words, self.begin, self.width, self.met = (x[:lasting] for x in (self.words, self.begin, self.width, self.met))
        self.table = self.table[:self.begin[-1] + self.width[-1] if lasting else 0]

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word, -1 for one not known."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def add(self, words: pa.Array, ids: list[bytes]) -> None:
        width = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.words = pa.concat_arrays([self.words, words])
        self.begin = np.concatenate([self.begin, len(self.table) + np.cumsum(width) - width])
        self.width, self.met = np.concatenate([self.width, width]), np.concatenate([self.met, np.zeros(len(ids), bool)])
        self.table = np.concatenate([self.table, np.frombuffer(b"".join(ids), "<u4")])


def spans(table: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The stretches of ``table`` that start at ``begin``, one after the other."""
    ends = np.cumsum(width)
    return table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - width), width)]


def process_memory(path: str) -> Memory:
    """One memory per Python worker and vocabulary, so later tasks of the worker find it filled."""
    return sys.modules.setdefault("_word_ids", types.ModuleType("_word_ids")).__dict__.setdefault(path, Memory())


class Encoder:
    """Ids of a text as little-endian uint32 bytes, exactly as the tokenizer gives them.

    The vocabulary's pre-tokenizer drops white space and never joins across it,
    and neither its normalizer nor its added tokens look past a blank, so a
    text's ids are those of its blank-separated parts in turn; a part of letters
    (in the tokenizer's normal form) and one closing mark is in the same way the
    letters and the mark. Parts are
    mostly repeated words, each encoded once and remembered. Words of letters
    are encoded as one text and cut after each token that ends a word.
    """

    MARKS = frozenset(".,;:!?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer, self.memory = Tokenizer.from_file(path), process_memory(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")

    def _plain(self, parts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.asarray(g.ids, dtype="<u4").tobytes() for g in got]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters. A word is at least one pre-token, so as many ends as words means one each."""
        # the fast form leaves out the offsets into the text
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._plain(words)
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[i:j] for i, j in zip(at, at[1:])]

    @staticmethod
    def letters(word: str) -> bool:
        return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts that this worker does not know. Letters before a mark may be known to it."""
        cut = {p: (p[:-1], p[-1]) for p in parts if p[-1] in self.MARKS and self.letters(p[:-1])}
        stems = list({x for pair in cut.values() for x in pair}.difference(parts))
        at = self.memory.find(pa.array(stems, pa.large_string()))
        begin, width = self.memory.begin, self.memory.width
        met = {x: self.memory.table[begin[i]:begin[i] + width[i]].tobytes() for x, i in zip(stems, at.tolist()) if i >= 0}
        words, others = [], []
        for p in [p for p in (*parts, *stems) if p not in cut and p not in met]:
            (words if self.letters(p) else others).append(p)
        for group, encode in ((words, self._words), (others, self._plain)):
            for i in range(0, len(group), TOGETHER):
                part = group[i:i + TOGETHER]
                met.update(zip(part, encode(part)))
        return [met[cut[p][0]] + met[cut[p][1]] if p in cut else met[p] for p in parts]

    def places(self, words: pa.Array) -> tuple[np.ndarray, int]:
        """Places of different words in the memory, to which the unknown ones are
        added, long ones at the end; and how many words may stay there."""
        self.memory.turn()
        at = self.memory.find(words)
        missing, known = np.flatnonzero(at < 0), len(self.memory.words)
        short = pc.less_equal(pc.utf8_length(words.take(pa.array(missing))), LONGEST).to_numpy(zero_copy_only=False)
        if len(missing):
            missing = np.concatenate([missing[short], missing[~short]])
            new = words.take(pa.array(missing))
            at[missing] = known + np.arange(len(missing))
            self.memory.add(new, self.ids_of(new.to_pylist()))
        self.memory.met[at] = True
        return at, known + int(short.sum())

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text]), END_ID)[0][:-1].tobytes()

    def batch(self, texts: pa.Array, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``closing``, and how many each text has.

        Parts are numbered over the whole batch, the different ones are found in
        the memory, and every part's ids are gathered from its table by index.
        """
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
        filled = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(filled).dictionary_encode()
        parts = np.bincount(owner[filled.to_numpy(zero_copy_only=False)], minlength=len(texts))
        place, lasting = self.places(coded.dictionary)
        at = place[coded.indices.to_numpy()]
        width = self.memory.width[at]
        ids = spans(self.memory.table, self.memory.begin[at], width)
        self.memory.forget(lasting)
        behind = np.concatenate([[0], np.cumsum(width)])[np.cumsum(parts)]
        return np.insert(ids, behind, closing), np.diff(behind, prepend=0) + 1


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def pieces(encode: Encoder, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ids, lengths = encode.batch(texts, END_ID)
        count = -(-lengths // capacity)
        of = np.repeat(np.arange(len(lengths)), count)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(lengths[of] - start, capacity)
        first = np.repeat(np.cumsum(lengths) - lengths, count) + start
        view = memoryview(np.ascontiguousarray(ids)).cast("B")
        crc = [zlib.crc32(view[4 * i:4 * (i + n)]) for i, n in zip(first.tolist(), length.tolist())]
        return pa.RecordBatch.from_arrays(
            [doc_ids.take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            weight = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(weight // CHUNK_BYTES)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    held.append(batch.slice(lo, hi - lo))
                    size += int(weight[hi - 1]) - (int(weight[lo - 1]) if lo else 0)
                    if size >= CHUNK_BYTES:
                        yield pa.Table.from_batches(held)
                        held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for chunk in chunks(batches):
            doc_ids, texts = (chunk.column(i).cast(kind).combine_chunks() for i, kind in enumerate((pa.int64(), pa.large_string())))
            yield pieces(encode, doc_ids, texts)
        # the worker lives on, also for other operators' tasks
        chunk = doc_ids = texts = None
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order.

    Moving a bin from gap g to g - s changes the sum by 2(N[g-s] - N[g]) + 2, a
    new bin by 2 N[C-s] + 1, and a bin that becomes full leaves the sum, so its
    own count never enters. Ties go to the smallest gap, then to open bins.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made, never = 0, np.iinfo(np.int64).max // 4
    for i, s in enumerate(lengths.tolist()):
        if s < capacity:
            here = counts[s:capacity]
            change = np.where(here > 0, 2 * (counts[:capacity - s] - here) + 2, never)
            change[0] -= 1
            g = int(change.argmin())
            if change[g] <= 2 * counts[capacity - s] + 1:
                b = open_at[g + s].pop()
                counts[g + s] -= 1
                bins[i], offsets[i] = b, capacity - g - s
                if g:
                    open_at[g].append(b)
                    counts[g] += 1
                continue
            open_at[capacity - s].append(made)
            counts[capacity - s] += 1
        bins[i], offsets[i] = made, 0
        made += 1
    return bins, offsets


def orders(lengths: np.ndarray) -> list[np.ndarray]:
    """Orders to try: mixed with the smallest three tenths last, which fill what is left open, and all by falling length."""
    falling = np.argsort(-lengths, kind="stable")
    small = lengths <= np.quantile(lengths, 0.3)
    return [np.concatenate([np.flatnonzero(~small), falling[small[falling]]]), falling]


def placed(frame: pd.DataFrame, rows: np.ndarray, capacity: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    taken = frame.iloc[rows]
    return taken, *sum_of_squares(taken["length"].to_numpy(), capacity)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row per piece with its sequence_id and offset.

    A block is one task's work, about ``block`` pieces; the number of blocks
    follows the number of pieces. Sequence ids hold the block above 32 bits.
    """
    pieces = written(tokenised(docs, tokenizer, capacity), "pieces")
    full = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        order = frame.assign(mix=pd.util.hash_array(frame["ids_crc32"].to_numpy(np.uint64))).sort_values(
            ["mix", "doc_id", "piece"], kind="stable").drop(columns="mix").reset_index(drop=True)
        order, bins, offsets = min((placed(order, rows, capacity) for rows in orders(order["length"].to_numpy())),
                                   key=lambda found: found[1].max())
        return order.assign(sequence_id=(order["block"].to_numpy(np.int64) << 32) + bins, offset=offsets)[[*cols, "sequence_id", "offset"]]

    dealt = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("long"))
    packed = dealt.groupBy("block").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    alone = full.select(*cols, (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
