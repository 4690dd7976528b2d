"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all its
predecessor kept; between stages the rows are written as Parquet and read
again. All but the last return the columns of ``documents``. Columns beyond those
are passed on, whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trueframe.llm import curriculum, minhash, packing, quality, runindex
from trueframe.llm.common import prepare, table, written

TOKENIZER = "word_bpe_49k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts.

    A null or empty text is scored from its zero statistics, a very long one
    whole; equal texts get one answer; rows without an id are scored like any.
    """
    prepare(spark)
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Null, empty and blank texts resemble nothing and stay, as do all rows
    without an id. Rows of one id are one document and leave one row.
    """
    prepare(spark)
    return minhash.deduplicated(docs)


def passages_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids hold.

    A document that loses its whole text goes; one that was null or empty stays,
    with an empty text. Rows without an id neither lose nor take anything, nor
    do rows of one id from each other.
    """
    prepare(spark)
    return runindex.cleaned(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often and in the order the curriculum takes them.

    A document without words counts nothing; null sources are one source.
    Repeated rows are taken as separate documents, each with its own columns.
    """
    prepare(spark)
    return curriculum.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences.

    A null or empty text is one piece with the end id; a text beyond 4,096
    tokens is cut into pieces; repeated rows are packed as separate documents.
    """
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_deduplicated),
    ("suffix_dedup", passages_removed),
    ("mix", mixed),
    ("pack", packed),
]

#: A trained classifier decides which rows there are, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
