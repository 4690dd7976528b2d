import os

import pytest

import corpus_pipeline
from trueframe.llm import curriculum, minhash, packing, quality, runindex
from trueframe.llm import queries
from trueframe.llm.common import table, written

from .conftest import words

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="tables not present")


def rows(df):
    return sorted(map(str, df.collect()))


def test_stages_are_their_operators(work):
    docs = table(work, PATH, "documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_dedup", "suffix_dedup", "mix", "pack"]

    good = written(stage["quality"](work, docs, PATH), "t")
    assert good.columns == columns
    accepted = quality.score(docs, quality.train(docs, table(work, PATH, "labels"))).filter("predicted = 1")
    assert rows(good.select("doc_id")) == rows(accepted.select("doc_id"))

    single = written(stage["near_dedup"](work, good, PATH), "t")
    assert single.columns == columns
    assert rows(single.select("doc_id")) == rows(minhash.near_duplicates(good).filter("kept").select("doc_id"))

    cut = written(stage["suffix_dedup"](work, single, PATH), "t")
    assert cut.columns == columns and cut.filter("n_chars <> char_length(text)").isEmpty()
    left = runindex.removal(single).filter("n_removed < n_bytes OR n_bytes = 0")
    assert rows(cut.select("doc_id")) == rows(left.select("doc_id"))

    stream = written(stage["mix"](work, cut, PATH), "t")
    assert stream.columns == columns
    taken = sum(r.taken for r in curriculum.mixed(cut).collect())
    assert stream.select(curriculum.n_words(stream["text"]).alias("n")).groupBy().sum("n").first()[0] == taken

    packed = stage["pack"](work, stream, PATH)
    assert packed.filter("piece = 0").count() == stream.count()
    assert packed.groupBy("sequence_id").sum("length").filter(f"`sum(length)` > {packing.CAPACITY}").isEmpty()


def test_run_is_registered_and_repeats(work):
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    first, second = (corpus_pipeline.run(work, PATH).drop("sequence_id", "offset") for _ in range(2))
    assert rows(first) == rows(second) and first.count() > 0


def test_empty_documents(work, documents):
    docs = documents([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(work, docs, PATH), "t")
    assert docs.count() == 0


def test_odd_rows_through_every_stage(work, documents):
    import random
    rng = random.Random(11)
    shared = words(rng, 80)
    odd = [(None, None, None), (None, shared), (1, None), (2, ""), (3, " \t\n "), (4, shared), (5, shared), (6, words(rng, 40, 10 ** 6) + " " + shared),
           (7, words(rng, 60_000, 10 ** 6), "b"), (8, "same row here", "b"), (8, "same row here", "b"), (9, "漢字" * 400, "")]
    docs = documents(odd)
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert stage["quality"](work, docs, PATH).columns == columns

    single = written(stage["near_dedup"](work, docs, PATH), "t")
    assert single.columns == columns
    assert sorted((r.doc_id for r in single.collect()), key=str) == [1, 2, 3, 4, 6, 7, 8, 9, None, None]

    cut = written(stage["suffix_dedup"](work, single, PATH), "t")
    texts = {r.doc_id: r.text for r in cut.filter("doc_id IS NOT NULL").collect()}
    assert cut.columns == columns and cut.count() == single.count()
    assert texts[1] == texts[2] == "" and texts[4] == shared and shared[1:-1] not in texts[6] and texts[7] == odd[8][1] and texts[9] == "漢字" * 400
    assert {r.text for r in cut.filter("doc_id IS NULL").collect()} == {"", shared}

    stream = written(stage["mix"](work, cut, PATH), "t")
    assert stream.columns == columns and {r.text for r in stream.collect()} <= {*texts.values(), "", shared}

    packed = stage["pack"](work, docs, PATH).collect()
    assert sorted({(r.doc_id, r.length) for r in packed if r.doc_id in (1, 2)}) == [(1, 1), (2, 1)]
    assert sum(r.piece == 0 for r in packed) == len(odd)
    long = sorted((r.piece, r.start, r.length) for r in packed if r.doc_id == 7)
    assert len(long) > 1 and all(start == 4096 * piece for piece, start, _ in long) and all(n == 4096 for _, _, n in long[:-1])
