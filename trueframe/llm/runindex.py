"""Repeated-passage removal with a run-compressed Burrows-Wheeler index.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller id. Equal strings are brought together by anchors: the positions where
the hash of 16 bytes is least among those of some 50-byte string. Equal strings
choose equal anchors, so only what surrounds an anchor has to be compared, and
only anchors that occur in two documents.

The 84 bytes around an anchor (34 either side) are its context and hold every
50-byte string over the anchor. Per bucket of anchors, the distinct contexts are
indexed column by column from the right: the rows in order of what follows, the
preceding symbols run-compressed, each run with its target in the next column
and the context sampled at its end, and the row ranges of long matches with
their least document. Contexts then stream through the index from right to
left, one run lookup a column, and learn for each 50-byte string the least
document that holds it. Copies of a context need no index: all but those of its
least document are covered entirely.

Documents are dealt into chunks by a hash of the id. The chunked text is
shuffled once and read by three steps: anchors out, contexts out, marks
applied. Between them only packed hashes, contexts of repeated anchors and
marks move. Whole copies are found by digest first and need no anchors.

Defined results. Null text: empty. Null ids: nothing is removed and nothing is
compared with them. Rows with one id are separate documents, neither smaller
than the other. Texts under 50 bytes are kept. An empty table gives no rows.
Other columns are ignored or, in ``cleaned``, passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LENGTH, GRAM = 50, 16
SIDE = LENGTH - GRAM
WIDTH = LENGTH + SIDE
#: Bytes of text and documents in a chunk on average, at most; documents in one while there are no more than ``CHUNKS``
#: of them; and bytes of text that send their anchors to one bucket. A chunk meets every bucket, hence few, large chunks.
CHUNK_BYTES, CHUNK_DOCS, CHUNK, CHUNKS, BUCKET_BYTES = 8 << 20, 16_384, 256, 1024, 16 << 20
#: Bytes of text whose anchors are looked for at once.
BLOCK = 1 << 18
_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FAR = np.iinfo(np.int64).max


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling."""
    k = 1
    out = a
    while 2 * k <= width:
        out = op(out[:-k], out[k:])
        k *= 2
    return op(out[:len(out) - (width - k)], out[width - k:]) if k < width else out


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes at every position that has them; even, the last bit is free."""
    h, power, n = buf.astype(np.uint64) + np.uint64(1), int(_B), 1
    while n < GRAM:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power % (1 << 64), 2 * n
    h = (h ^ (h >> np.uint64(29))) * _M1
    h = (h ^ (h >> np.uint64(32))) * _M2
    return (h ^ (h >> np.uint64(30))) & ~np.uint64(1)


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts that lie end to end in ``buf``."""
    if len(buf) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(buf) | np.uint64(1)  # never 0, which marks strings that leave their text
    until = np.repeat(ends, np.diff(ends, prepend=0))
    inside = np.arange(LENGTH, len(buf) + 1) <= until[:len(buf) - LENGTH + 1]
    least = np.where(inside, _slide(h, SIDE + 1, np.minimum), np.uint64(0))
    edge = np.zeros(SIDE, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), SIDE + 1, np.maximum) == h)
    return at, h[at] & ~np.uint64(1)


def contexts(buf: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes around each anchor, zero outside its text, and the columns that are inside."""
    low, high = np.maximum(SIDE - (at - start), 0), np.minimum(end - at + SIDE, WIDTH)
    padded = np.concatenate([np.zeros(SIDE, np.uint8), buf, np.zeros(WIDTH, np.uint8)])
    got = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    cut = np.flatnonzero((low > 0) | (high < WIDTH))
    column = np.arange(WIDTH)
    got[cut] *= ((column >= low[cut, None]) & (column < high[cut, None])).astype(np.uint8)
    return got, low, high


def distinct(context: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of each distinct context; hashes group, bytes decide."""
    wide = np.zeros((len(context), WIDTH + 12), np.uint8)
    wide[:, :WIDTH], wide[:, WIDTH], wide[:, WIDTH + 1] = context, low, high
    words = wide.view(np.uint64)
    h = np.zeros(len(wide), np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * _M1
        h ^= h >> np.uint64(31)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    if (words != words[first[number]]).any():
        _, first, number = np.unique(wide.view(f"V{wide.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, number


class RunIndex:
    """Run-compressed positional BWT of distinct contexts, columns from right to left."""

    def __init__(self, context: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray):
        order = np.arange(len(context))
        for c in range(WIDTH - 1, SIDE, -1):
            order = order[np.argsort(context[order, c], kind="stable")]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.arange(len(order))
        self.columns = []
        for c in range(SIDE, -1, -1):
            symbols = context[order, c]
            lf = np.empty(len(order), np.int64)
            target = np.argsort(symbols, kind="stable")
            lf[target] = np.arange(len(order))
            runs = np.flatnonzero(np.diff(symbols, prepend=symbols[0] ^ 1)) if len(order) else np.zeros(0, np.int64)
            samples = order[np.append(runs[1:], len(order)) - 1] if len(order) else runs
            order = order[target]
            window = context[order, c:c + LENGTH]
            starts = np.flatnonzero(np.append(True, (window[1:] != window[:-1]).any(axis=1)))
            held = np.where((low[order] <= c) & (c + LENGTH <= high[order]), doc[order], FAR)
            self.columns.append((c, runs, lf[runs], samples, starts, np.minimum.reduceat(held, starts)))

    def statistics(self):
        """(column, least document holding the 50 bytes there) of every context, as they stream by."""
        row = self.entry
        for c, runs, targets, _, starts, least in self.columns:
            run = np.searchsorted(runs, row, side="right") - 1
            row = targets[run] + row - runs[run]
            yield c, least[np.searchsorted(starts, row, side="right") - 1]


def long_matches(context: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns [from, to) of each context that smaller documents hold; from = to where none.

    All strings lie over the anchor, so their union is one stretch.
    """
    first, last = np.full(len(context), WIDTH, np.int64), np.zeros(len(context), np.int64)
    if len(context):
        for c, least in RunIndex(context, low, high, doc).statistics():
            hit = (least < doc) & (low <= c) & (c + LENGTH <= high)
            first[hit] = np.minimum(first[hit], c)
            last[hit] = np.maximum(last[hit], c + LENGTH)
    return np.minimum(first, last), last


def _texts(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Bytes, ends, ids and usability of a chunk's documents, in a fixed order.

    Rows of one id are separate documents, so whole copies are told by ``row_key``,
    a hash of id and text, and not by the id.
    """
    docs = docs.append_column("_digest", pa.array([hashlib.md5(b).digest() for b in docs["body"].to_pylist()], pa.binary()))
    docs = docs.sort_by([("doc_id", "ascending"), ("_digest", "ascending")]).drop_columns("_digest").combine_chunks()
    bodies = docs["body"].to_pylist()
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum([len(b) for b in bodies], dtype=np.int64)
    known = np.array(docs["doc_id"].is_valid())
    return buf, ends, docs["doc_id"].fill_null(0).to_numpy().astype(np.int64), known, docs


def _arrays(blob: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in blob.to_pylist()]


def _packed(places: np.ndarray) -> bytes:
    """Places in a chunk: four bytes each, eight if the chunk goes beyond 2 GiB."""
    return places.astype(np.int32 if not len(places) or places.max() <= np.iinfo(np.int32).max else np.int64).tobytes()


def _places(blob: bytes, local: bytes) -> np.ndarray:
    """What ``_packed`` wrote; ``local`` has four bytes for each place."""
    return np.frombuffer(blob, np.int32 if len(blob) == len(local) else np.int64).astype(np.int64)


def _copies(other: pa.Table) -> np.ndarray:
    found = [np.asarray(x, np.int64) for x in other["copies"].to_pylist() if x is not None]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _covered(size: int, other: pa.Table) -> np.ndarray:
    """Which bytes of a chunk the marks of all buckets cover, from the marks alone: no pass over the text for each bucket."""
    told = [(_places(p, n), np.frombuffer(n, np.int32)) for p, n in zip(other["place"].to_pylist(), other["length"].to_pylist()) if p is not None]
    turns = np.zeros(size + 1, np.int8)
    if told:
        at, length = (np.concatenate(x) for x in zip(*told))
        order = np.argsort(at, kind="stable")
        at, reach = at[order], np.maximum.accumulate((at + length)[order])
        # stretches that overlap or touch are one
        cuts = np.flatnonzero(at[1:] > reach[:-1])
        turns[at[np.append(0, cuts + 1)]] = 1
        turns[reach[np.append(cuts, len(at) - 1)]] = -1
    return np.cumsum(turns[:-1], dtype=np.int8) > 0


def _searched(buf: np.ndarray, ends: np.ndarray, docs: pa.Table, known: np.ndarray, copies: np.ndarray):
    """Anchors of the chunk's documents that have an id and are no whole copies: position, hash, document."""
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    blocks = np.flatnonzero(np.diff(begins // BLOCK, prepend=-1))
    found = []
    for i, j in zip(blocks.tolist(), [*blocks[1:].tolist(), len(ends)]):
        at, h = anchors(buf[begins[i]:ends[j - 1]], ends[i:j] - begins[i])
        found.append((at + begins[i], h))
    at, h = (np.concatenate(x) for x in zip(*found))
    local = np.searchsorted(ends, at, side="right")
    use = (known & ~np.isin(docs["row_key"].to_numpy(), copies))[local]
    return at[use], h[use], local[use]


_HASHES = "bucket long, chunk long, hashes binary"
_REPLY = "chunk long, hashes binary"
_CONTEXTS = ("bucket long, chunk long, context binary, low binary, high binary, least binary, "
             "number binary, doc binary, local binary, place binary")
_MARKS = "chunk long, local binary, place binary, length binary"


def _split(bucket: np.ndarray, buckets: int):
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b]:cuts[b + 1]]


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns)})


def _chunks(count: int, size: int) -> int:
    """How many chunks documents of that number and size in bytes are dealt into."""
    return max(1, min(-(-count // CHUNK), CHUNKS), -(-count // CHUNK_DOCS), -(-size // CHUNK_BYTES))


def _chunked(docs: DataFrame, id_col: str, text_col: str, also: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """The chunked text, each chunk's whole copies, and how many buckets its anchors need."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_of(text_col), "UTF-8").alias("body"),
                       *[F.col(f"`{c}`").alias(f"also_{i}") for i, c in enumerate(also)])
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    # rows without an id are dealt by their text, so that they do not meet in one chunk
    dealt = F.xxhash64(F.when(F.col("doc_id").isNull(), F.col("body")), "doc_id")
    chunk = F.pmod(dealt, F.lit(_chunks(count, size))).alias("chunk")
    row_key = F.xxhash64("doc_id", "body").alias("row_key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.filter(F.octet_length("body") >= LENGTH).select("doc_id", row_key, chunk, F.sha2("body", 256).alias("digest"))
    # copies of a digest in a document with a larger id than its least
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    copies = keyed.join(first, "digest").filter("doc_id > first").select("chunk", "row_key")
    return rows.select("*", row_key, chunk).repartition(parts, "chunk"), copies, max(1, -(-size // BUCKET_BYTES))


def _marks(chunked: DataFrame, copies: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(copies by chunk, marks by chunk): packed places and lengths to remove."""
    flagged = copies.groupBy("chunk").agg(F.sort_array(F.collect_set("row_key")).alias("copies"))

    def hashes_out(docs: pa.Table, other: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(_HASHES, [])
        buf, ends, ids, known, docs = _texts(docs)
        _, h, local = _searched(buf, ends, docs, known, _copies(other))
        # once per chunk; the last bit says that two documents of the chunk have it
        order = np.lexsort((ids[local], h))
        h, doc = h[order], ids[local][order]
        starts = np.flatnonzero(np.diff(h, prepend=~h[:1])) if len(h) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts) if len(h) else starts
        once = h[starts] | several.astype(np.uint64)
        chunk = docs["chunk"][0].as_py()
        return _table(_HASHES, [(b, chunk, once[i].tobytes()) for b, i in _split(((once >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64), buckets)])

    def repeated(table: pa.Table) -> pa.Table:
        parts = _arrays(table["hashes"], np.uint64)
        every = np.concatenate(parts)
        values, n = np.unique(every & ~np.uint64(1), return_counts=True)
        again = np.union1d(values[n > 1], every[(every & np.uint64(1)) == 1] & ~np.uint64(1))
        out = []
        for chunk, part in zip(table["chunk"].to_pylist(), parts):
            h = part & ~np.uint64(1)
            mine = h[again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h] if len(again) else h[:0]
            if len(mine):
                out.append((chunk, mine.tobytes()))
        return _table(_REPLY, out)

    def contexts_out(docs: pa.Table, other: pa.Table) -> pa.Table:
        if not docs.num_rows or not other.num_rows:
            return _table(_CONTEXTS, [])
        buf, ends, ids, known, docs = _texts(docs)
        at, h, local = _searched(buf, ends, docs, known, _copies(other))
        wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(b, np.uint64) for b in other["hashes"].to_pylist() if b is not None]]))
        if not len(wanted) or not len(at):
            return _table(_CONTEXTS, [])
        keep = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
        at, h, local = at[keep], h[keep], local[keep]
        out, chunk = [], docs["chunk"][0].as_py()
        for b, i in _split(((h >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64), buckets):
            place, of = at[i], local[i]
            start = np.where(of > 0, ends[of - 1], 0)
            got, low, high = contexts(buf, place, start, ends[of])
            first, number = distinct(got, low, high)
            least = np.full(len(first), FAR)
            np.minimum.at(least, number, ids[of])
            out.append((b, chunk, pa.compress(got[first].tobytes(), codec="zstd", asbytes=True), low[first].astype(np.uint8).tobytes(), high[first].astype(np.uint8).tobytes(),
                        least.tobytes(), number.astype(np.int32).tobytes(), ids[of].tobytes(), of.astype(np.int32).tobytes(),
                        _packed(place)))
        return _table(_CONTEXTS, out)

    def marked(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(pa.decompress(packed, len(low) * WIDTH, codec="zstd"), np.uint8).reshape(-1, WIDTH)
                 for packed, low in zip(table["context"].to_pylist(), table["low"].to_pylist())]
        sizes = np.cumsum([0, *map(len, parts)])
        every = np.concatenate(parts)
        low, high = (np.concatenate(_arrays(table[c], np.uint8)).astype(np.int64) for c in ("low", "high"))
        first, number = distinct(every, low, high)
        doc = np.full(len(first), FAR)
        np.minimum.at(doc, number, np.concatenate(_arrays(table["least"], np.int64)))
        every, low, high = every[first], low[first], high[first]
        # an anchor with one context has nothing to compare it with
        anchor = np.ascontiguousarray(every[:, SIDE:SIDE + GRAM]).view(np.uint64)
        key = (anchor[:, 0] * _M1) ^ (anchor[:, 1] * _M2)
        _, kind, n = np.unique(key, return_inverse=True, return_counts=True)
        several = np.flatnonzero(n[kind] > 1)
        begin, end = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        begin[several], end[several] = long_matches(every[several], low[several], high[several], doc[several])
        out = []
        for k, chunk in enumerate(table["chunk"].to_pylist()):
            mine = number[sizes[k]:sizes[k + 1]][np.frombuffer(table["number"][k].as_py(), np.int32)]
            ids = np.frombuffer(table["doc"][k].as_py(), np.int64)
            whole = (ids > doc[mine]) & (high[mine] - low[mine] >= LENGTH)
            start, stop = np.where(whole, low[mine], begin[mine]), np.where(whole, high[mine], end[mine])
            hit = stop > start
            if hit.any():
                local = table["local"][k].as_py()
                place = _places(table["place"][k].as_py(), local) - SIDE + start
                out.append((chunk, np.frombuffer(local, np.int32)[hit].tobytes(), _packed(place[hit]), (stop - start)[hit].astype(np.int32).tobytes()))
        return _table(_MARKS, out)

    by_chunk = chunked.groupBy("chunk")
    hashes = by_chunk.cogroup(flagged.groupBy("chunk")).applyInArrow(hashes_out, _HASHES)
    reply = hashes.groupBy("bucket").applyInArrow(repeated, _REPLY)
    none = F.lit(None)
    asked = reply.select("chunk", "hashes", none.cast("array<long>").alias("copies")).unionByName(
        flagged.select("chunk", none.cast("binary").alias("hashes"), "copies"))
    wanted = by_chunk.cogroup(asked.groupBy("chunk")).applyInArrow(contexts_out, _CONTEXTS)
    return flagged, wanted.groupBy("bucket").applyInArrow(marked, _MARKS)


def _applied(docs: DataFrame, id_col: str, text_col: str, also: list[str], schema: str, row) -> DataFrame:
    """Applies ``row(ids, bodies, masks, docs)`` to each chunk with its bytes to remove."""
    chunked, copies, buckets = _chunked(docs, id_col, text_col, also)
    flagged, marks = _marks(chunked, copies, buckets)
    none = F.lit(None)
    told = marks.select("*", none.cast("array<long>").alias("copies")).unionByName(flagged.select(
        "chunk", *[none.cast("binary").alias(c) for c in ("local", "place", "length")], "copies"))

    def apply(docs: pa.Table, other: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return row(docs, [], [])
        buf, ends, ids, known, docs = _texts(docs)
        gone = _covered(len(buf), other)
        bounds = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        copied = known & np.isin(docs["row_key"].to_numpy(), _copies(other))
        for i in np.flatnonzero(copied).tolist():
            start, end = bounds[i]
            gone[start:end] = True
        return row(docs, [buf[a:b] for a, b in bounds], [gone[a:b] for a, b in bounds])

    return chunked.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(apply, schema)


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    def row(docs: pa.Table, bodies: list[np.ndarray], gone: list[np.ndarray]) -> pa.Table:
        return pa.table({
            "doc_id": docs["doc_id"], "n_bytes": pa.array([len(b) for b in bodies], pa.int64()),
            "n_removed": pa.array([int(g.sum()) for g in gone], pa.int64()),
            "n_spans": pa.array([int((g[1:] & ~g[:-1]).sum() + g[:1].sum()) for g in gone], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(b[~g].tobytes()).hexdigest() for b, g in zip(bodies, gone)], pa.string())})

    return _applied(docs, id_col, text_col, [], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", row)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with what is left of their text; those that lose all of it go.

    A character of which some bytes go is dropped whole. Other columns are passed on.
    """
    also = [c for c in docs.columns if c not in (id_col, text_col)]
    schema = "doc_id long, body string, emptied boolean" + "".join(f", also_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(also))

    def row(docs: pa.Table, bodies: list[np.ndarray], gone: list[np.ndarray]) -> pa.Table:
        return pa.table({
            "doc_id": docs["doc_id"], "body": pa.array([b[~g].tobytes().decode("utf-8", "ignore") for b, g in zip(bodies, gone)], pa.string()),
            "emptied": pa.array([bool(len(g) and g.all()) for g in gone], pa.bool_()),
            **{f"also_{i}": docs[f"also_{i}"] for i in range(len(also))}})

    done = _applied(docs, id_col, text_col, also, schema, row).filter(~F.col("emptied"))
    names = {id_col: "doc_id", text_col: "body", **{c: f"also_{i}" for i, c in enumerate(also)}}
    return done.select(*[F.col(names[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
