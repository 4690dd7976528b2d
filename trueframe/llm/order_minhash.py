"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are runs of five words, each numbered by how often it has
occurred before, so repeats count. One hash deals the numbered k-mers into 32
sketches; a sketch selects its two smallest, puts them back into text order and
hashes them as a tuple. Equal tuples mean that two texts share k-mers in the
same order, so likeness falls with edit distance, not only with set overlap.

All work on a text stays in array functions of its row and is n log n: hashes
are sorted once, the two smallest of a sketch stand next to each other, text
order comes from ``array_intersect``, which keeps the order of its first
argument, and occurrence numbers, needed only where a text repeats a k-mer,
from a binary search for the start of a run of equal hashes.

Defined results. Null text: empty. No words: the empty fingerprint, whose
likeness to another empty one is 1. Fewer than five words: the whole sequence
is the one k-mer. The next document follows in order of id, then text, null ids
first, so rows with one id follow each other; the last is followed by the
first, and a single document by itself. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import adjacent_pairs
from .common import WORD, text_of, written

WORDS, LEAST = 5, 2
#: 32 sketches: the top five bits of a hash.
SKETCH_SHIFT = 59
#: Ids per window when documents are put in order.
SPAN = 4096


def _sketch(h: Column) -> Column:
    return F.shiftright(h, SKETCH_SHIFT)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the sketches' tuples as strings, two digits of sketch and eight of hash."""
    cols = df.columns
    hashed = df.select(*cols, F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("_w"))
    n = F.size("_w")
    kmers = F.when(n >= WORDS, F.transform(
        F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(WORDS)]))).when(
        n > 0, F.array(F.xxhash64(F.concat_ws(" ", F.transform("_w", lambda h: h.cast("string")))))).otherwise(F.array().cast("array<bigint>"))
    numbered = hashed.select(*cols, kmers.alias("_k"))
    repeats = F.size(F.array_distinct("_k")) < F.size("_k")
    numbered = numbered.select("*", F.when(repeats, F.sort_array(F.transform("_k", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_r"))
    numbered = numbered.select("*", F.when(F.col("_r").isNotNull(), F.transform(
        F.sequence(F.lit(0), F.ceil(F.log2(F.size("_k"))).cast("int")), lambda b: F.pow(F.lit(2), b).cast("int"))).alias("_s"))

    def before(x: Column, i: Column) -> Column:
        """How many equal hashes stand before place i of the sorted array."""
        def step(c: Column, power: Column) -> Column:
            return F.when((i >= c + power) & (F.get("_r", i - c - power)["h"] == x["h"]), c + power).otherwise(c)
        return F.when(i == 0, F.lit(0)).when(F.get("_r", i - 1)["h"] != x["h"], F.lit(0)).otherwise(
            F.aggregate(F.reverse("_s"), F.lit(0), step))

    again = F.transform(F.sort_array(F.transform("_r", lambda x, i: F.struct(x["i"].alias("i"), F.xxhash64(x["h"], before(x, i)).alias("h")))), lambda y: y["h"])
    hashes = numbered.select(*cols, F.when(F.col("_r").isNotNull(), again).otherwise(F.transform("_k", lambda h: F.xxhash64(h, F.lit(0)))).alias("_h"))
    ranked = hashes.select("*", F.sort_array("_h").alias("_o"))
    least = ranked.select(*cols, "_h", F.filter("_o", lambda h, i: F.when(i < LEAST, F.lit(True)).otherwise(
        _sketch(F.get("_o", i - LEAST)) != _sketch(h))).alias("_l"))
    placed = least.select(*cols, "_l", F.array_intersect("_h", "_l").alias("_t"))

    def pair(h: Column, i: Column) -> Column:
        other = F.get("_l", i + 1)
        both = F.when(F.array_position("_t", h) < F.array_position("_t", other), F.xxhash64(h, other)).otherwise(F.xxhash64(other, h))
        value = F.when(other.isNotNull() & (_sketch(other) == _sketch(h)), both).otherwise(F.xxhash64(h))
        return F.when((i == 0) | (_sketch(F.get("_l", i - 1)) != _sketch(h)), F.concat(
            F.lpad((_sketch(h) + 16).cast("string"), 2, "0"), F.lpad(F.lower(F.hex(value.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")))

    return placed.select(*cols, F.filter(F.transform("_l", pair), lambda t: t.isNotNull()).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of the sketches either text fills whose tuples are equal."""
    def filled(tuples: Column) -> Column:
        return F.transform(tuples, lambda t: F.substring(t, 1, 2))
    either = F.size(F.array_union(filled(a), filled(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def with_next(rows: DataFrame, order_key: str, tie: str, carried: list[str]) -> DataFrame:
    """Adds ``next``: the carried columns of the following row, cyclically.

    Rows are windowed by spans of the key; the first rows of each span are also
    sent, marked, to the span before, where they follow its last row.
    """
    rows = rows.withColumn("span", F.floor(F.col(order_key) / SPAN))
    spans = written(rows.groupBy("span").agg(F.min(order_key).alias("first")), "spans").withColumn("high", F.floor(F.col("span") / SPAN))
    pairs = adjacent_pairs(spans.withColumn("all", F.lit(0)), ["all"], "high", ["span"], ["first"]).select(
        F.col("prev.span").alias("to"), F.col("cur.span").alias("from"), F.col("cur.first").alias("first"))
    ends = spans.agg(F.max("span").alias("to"), F.min("span").alias("from"), F.min("first").alias("first")).filter("to IS NOT NULL")
    ahead = written(pairs.unionByName(ends), "span-pairs")
    copies = rows.join(ahead.withColumnRenamed("from", "span").withColumnRenamed("first", "_first"), "span").filter(
        F.col(order_key) == F.col("_first")).withColumn("span", F.col("to")).drop("to", "_first")
    every = rows.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    following = F.lead(F.struct(*carried)).over(W.partitionBy("span").orderBy("copy", order_key, tie))
    return every.withColumn("next", following).filter("copy = 0").drop("copy", "span")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likenesses.

    The edited text has its last quarter replaced by the beginning of the next document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = with_fingerprint(rows, "text", "own").withColumn("order_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ordered = with_next(rows, "order_key", "text", ["text", "own"]).drop("order_key")
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, CAST(n_chars - n_chars DIV 4 AS INT))"), F.expr("substring(next.text, 1, CAST(n_chars DIV 4 AS INT))"))
    changed = ordered.withColumn("n_chars", n.cast("long")).select(
        "doc_id", "n_chars", "own", F.col("next.own").alias("following"), edited.alias("edited"))
    both = with_fingerprint(changed, "edited", "new")
    return both.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                       F.array_join("own", "").alias("fingerprint"), F.array_join("new", "").alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
