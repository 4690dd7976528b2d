import random
import zlib

import numpy as np
import pytest

from trueframe.llm import gbt, quality, scoring, toxicity

from .conftest import words

LABELS = "doc_id long, quality int, toxic int, label int"


def corpus(n=700):
    """Documents of three kinds: plain, shouting junk, and plain with insults."""
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        kind, text = rng.choice(["plain", "plain", "junk", "toxic"]), words(rng, rng.randrange(20, 120))
        if kind == "junk":
            text = " ".join(w.upper() + rng.choice(["!!", "%%%"]) for w in text.split(" "))
        if kind == "toxic":
            parts = text.split(" ")
            for bad in rng.sample(["idiot", "Scum,", "m0ron", "blorvek", "blorvest", "blorva"], 3):
                parts[rng.randrange(len(parts))] = bad
            text = " ".join(parts)
        rows.append((i, text, rng.choice("abc")))
        labels.append((i, int(kind != "junk"), int(kind == "toxic"), 9))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("module,at,cut", [(quality, 1, 0.7), (toxicity, 2, 0.3)])
def test_held_out_accuracy_and_contract(work, documents, module, at, cut):
    rows, labels = corpus()
    # what is held out is labelled wrongly: a fit that looked would show it
    shown = [(r[0], 1 - r[1], 1 - r[2], 9) if held(r[0]) else r for r in labels]
    extra = [(9000, None, None), (9001, "", "a"), (None, "no id", "a"), (9002, words(random.Random(2), 30_000), "a"), (3, rows[3][1], "b")]
    docs = documents(rows + extra)
    out = module.score(docs, module.train(docs, work.createDataFrame(shown + [(1, None, None, 9), (None, 1, 1, 9)] + shown[:1], LABELS))).toPandas()
    assert len(out) == len(rows) + len(extra)
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= cut)).all()
    known = out[out["doc_id"].notna()]
    assert (known["held_out"] == [held(int(i)) for i in known["doc_id"]]).all() and not out[out["doc_id"].isna()]["held_out"].any()
    truth = {r[0]: r[at] for r in labels}
    test = known[known["held_out"] & known["doc_id"].isin(list(truth))]
    assert (test["predicted"] == [truth[int(i)] for i in test["doc_id"]]).mean() > 0.93


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_labels_one_class_empty_tables(work, documents, module):
    docs = documents([(i, f"text {i}") for i in range(20)])
    for labels in ([], [(i, 1, 1, 0) for i in range(20)]):
        out = module.score(docs, module.train(docs, work.createDataFrame(labels, LABELS))).toPandas()
        assert len(out) == 20 and out["score"].between(0, 1).all() and out["score"].nunique() == 1
    none = documents([])
    assert module.score(none, module.train(none, work.createDataFrame([], LABELS))).count() == 0


def test_accepted_keeps_all_columns(work, documents):
    rows, labels = corpus(300)
    docs = documents(rows + [(None, None)])
    model = quality.train(docs, work.createDataFrame(labels, LABELS))
    left = quality.accepted(docs, model)
    assert left.columns == docs.columns
    want = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in left.collect()} == want


def test_sample_is_bounded_and_never_held_out(work, documents):
    rows, labels = corpus(400)
    got = scoring.sample(documents(rows), work.createDataFrame(labels, LABELS), "toxic", rows=50).collect()
    assert len(got) == 50 and not any(held(r.doc_id) for r in got)


def test_trees_equal_a_row_by_row_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = gbt.fit(x, y, trees=20, depth=3)
    for row, raw in zip(x[:40], model.raw(x[:40])):
        total = model.base
        for t in range(20):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - 7]
        assert raw == pytest.approx(total)
    assert ((model.raw(x) > 0) == (y == 1)).mean() > 0.95


def test_isotonic_pools_violators():
    raw, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1, 0])
    fit = gbt.isotonic(raw, y)
    got = fit(raw)
    assert (np.diff(got) >= 0).all() and len(fit.x) == 3
    assert fit(np.array([-9.0, 9.0])).tolist() == [fit.y[0], fit.y[-1]]
    assert gbt.isotonic(np.zeros(0), np.zeros(0))(np.array([0.0]))[0] == pytest.approx(0.5)


def test_hidden_and_learned_words():
    code = toxicity.Codes(frozenset(["blor"]))
    assert [code[w] for w in ("Idiot!", "1d10t", "l.o.s.e.r", "blorvek", "you", "plain", "a1b")] == [
        toxicity.INSULT, toxicity.HIDDEN, toxicity.HIDDEN, toxicity.STEM, toxicity.SECOND, toxicity.PLAIN, toxicity.MIXED]
