import hashlib
import random
import time

import numpy as np
import pyarrow as pa

from trueframe.llm import runindex

from .conftest import words


def plain(rows):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for i, b in bodies:
        if i is not None:
            for p in range(len(b) - 49):
                least[b[p:p + 50]] = min(i, least.get(b[p:p + 50], i))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if i is not None and least[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(rng):
    passages = [words(rng, rng.choice([8, 10, 12, 40, 200])) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [words(rng, rng.randrange(1, 60)) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2))
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([p, p[a:b], p.replace("w1", "v1")]))
        rows.append((rng.randrange(-200, 100_000), " ".join(parts)))
    return rows


def test_equals_a_table_of_all_strings(documents):
    rng = random.Random(1)
    rows = corpus(rng) + [(7, None), (8, ""), (9, "x" * 49), (10, "x" * 50), (11, "x" * 51), (12, "ab" * 4000), (13, "ba" * 100), (None, "x" * 60),
                          (14, "é" * 40), (15, "aé" + "é" * 40), (16, "\0" * 80), (17, "\0" * 60 + "b"), (18, words(rng, 20_000))]
    rows += [(19, rows[-1][1][5000:9000]), (20, rows[-1][1]), (21, "x" * 50 + "\n"), (21, "x" * 50 + "\n"), (22, "x" * 50 + "\n")]
    assert got(runindex.removal(documents(rows))) == plain(rows)


def test_many_near_copies_and_a_common_line(documents):
    rng = random.Random(2)
    base, line = words(rng, 60).split(" "), "The same line of more than fifty characters stands here. "
    rows = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(w) + " " + line * rng.randrange(3)))
    assert got(runindex.removal(documents(rows))) == plain(rows)


def test_index_streams_what_sorting_gives():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 99, (6, runindex.WIDTH)).astype(np.uint8)
    context = base[rng.integers(0, 6, 80)]
    context[np.arange(80), rng.integers(0, runindex.WIDTH, 80)] = 120
    first, _ = runindex.distinct(context, np.zeros(80, np.int64), np.full(80, runindex.WIDTH))
    context = context[first]
    low, high, doc = np.zeros(len(context), np.int64), np.full(len(context), runindex.WIDTH), rng.permutation(len(context)).astype(np.int64)
    low[::7], high[::5] = 9, 70
    index = runindex.RunIndex(context, low, high, doc)
    for c, least in index.statistics():
        for i in range(len(context)):
            same = [doc[j] for j in range(len(context)) if low[j] <= c and c + 50 <= high[j] and (context[j, c:c + 50] == context[i, c:c + 50]).all()]
            assert least[i] == (min(same) if same else runindex.FAR)
    for c, runs, targets, samples, _, _ in index.columns:
        assert len(runs) == len(targets) == len(samples) <= len(context)


def test_cleaned_texts_and_other_columns(documents):
    shared = "A passage of well over fifty bytes that two documents have in common, word for word."
    rows = [(1, f"one {shared} end"), (2, f"two {shared} fin"), (3, shared), (4, None), (5, "é" * 30), (6, "aé" + "é" * 29)]
    docs = documents(rows)
    out = runindex.cleaned(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    texts = {r.doc_id: (r.text, r["size"], r.chunk, r.lang) for r in out.collect()}
    assert 3 not in texts and texts[1] == (rows[0][1], "x", "y", "en")
    assert texts[2][0] == "twofin" and texts[4][0] == "" and texts[6][0] == "a"


def test_many_rows_without_an_id(documents):
    rng = random.Random(4)
    rows = [(None, words(rng, 30)) for _ in range(700)] + [(1, words(rng, 30))]
    assert got(runindex.removal(documents(rows))) == plain(rows)


def test_empty_table(documents):
    assert got(runindex.removal(documents([]))) == []
    assert runindex.cleaned(documents([])).count() == 0


def test_places_beyond_two_gib_are_kept():
    for places in ([], [0, 7, 2 ** 31 - 1], [3, 2 ** 31, 2 ** 40]):
        local = np.zeros(len(places), np.int32).tobytes()
        assert runindex._places(runindex._packed(np.array(places, np.int64)), local).tolist() == places


def test_small_blocks_few_chunks_and_many_buckets(documents, monkeypatch):
    for name, value in {"BLOCK": 700, "CHUNKS": 2, "CHUNK": 10, "BUCKET_BYTES": 3000}.items():
        monkeypatch.setattr(runindex, name, value)
    rows = corpus(random.Random(5)) + [(1, ""), (2, None), (3, "y" * 5000), (4, "y" * 4000 + "z"), (5, "")]
    assert got(runindex.removal(documents(rows))) == plain(rows)


def test_marks_cost_what_they_are_and_not_the_text_for_each_bucket():
    """3,000 buckets mark an 8 MB chunk; two passes over its bytes for each took about 0.03 s a bucket."""
    rng = np.random.default_rng(6)
    size = 8 << 20
    marks = [(np.sort(rng.integers(0, size - 200, n)), rng.integers(50, 118, n).astype(np.int32)) for n in [1, 0, 7] * 1000]
    marks += [(np.array([0, 60, 120]), np.array([60, 60, 50], np.int32)), (np.array([size - 84, size - 84]), np.array([84, 50], np.int32))]
    other = pa.table({"place": pa.array([None, *[runindex._packed(a) for a, _ in marks]], pa.binary()),
                      "length": pa.array([None, *[n.tobytes() for _, n in marks]], pa.binary())})
    gone = np.zeros(size, bool)
    for a, n in marks:
        for i, k in zip(a.tolist(), n.tolist()):
            gone[i:i + k] = True
    began = time.process_time()
    assert (runindex._covered(size, other) == gone).all()
    assert time.process_time() - began < 10
    assert not runindex._covered(60, other.slice(0, 1)).any() and not len(runindex._covered(0, other.slice(0, 0)))


def test_pieces_grow_with_the_text():
    """A chunk meets every bucket, so chunks must not multiply with the buckets."""
    assert runindex._chunks(256_410, 864 << 20) == 1002 and runindex._chunks(0, 0) == 1
    assert runindex._chunks(12 * 256_410, 12 * 864 << 20) == 12 * 864 // 8
    assert runindex._chunks(40_000_000, 1 << 20) == -(-40_000_000 // runindex.CHUNK_DOCS)
