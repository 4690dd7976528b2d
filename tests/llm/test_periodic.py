import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from trueframe.llm import periodic, queries
from trueframe.llm.common import blank_split

PATH = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every run, by trying every period; the smallest period of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text, edit=True):
    words = blank_split(text or "")
    n = len(words)
    if edit and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts(seed, count):
    """Words of few kinds, periodic stretches with faults, Fibonacci words, powers of short blocks."""
    rng = random.Random(seed)
    for _ in range(count):
        kind, n, k = rng.randrange(5), rng.randrange(0, 120), rng.choice([1, 2, 2, 3, 5, 50])
        out = []
        if kind < 2:
            out = [rng.randrange(k) for _ in range(n)]
        elif kind == 2:
            base = [rng.randrange(k) for _ in range(rng.randrange(1, 20))]
            out = [base[i % len(base)] for i in range(n)]
            for _ in range(rng.randrange(3) if out else 0):
                out[rng.randrange(len(out))] = rng.randrange(k)
        elif kind == 3:
            a, out = [0], [0, 1]
            while len(out) < n:
                a, out = out, out + a
        else:
            while len(out) < n:
                out += [rng.randrange(k) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 8)
        yield out


def test_runs_equal_trying_every_period():
    every = list(texts(5, 600))
    for a in range(0, len(every), 7):
        group = every[a:a + 7]
        symbols = np.array([1000 * t + w for t, words in enumerate(group) for w in words], np.int64)
        found = periodic.find_runs(symbols, np.array([len(w) for w in group])).tolist()
        assert [tuple(r[1:]) for r in found] == [r for w in group for r in plain_runs(w)]
        assert [r[0] for r in found] == sorted(r[0] for r in found)


def test_range_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(700).astype(np.int64)
    tree = periodic.WaveletTree(values, 700)
    low = rng.integers(0, 700, 500)
    high = low + rng.integers(0, 700 - low + 1)
    least = rng.integers(0, 1100, 500)
    want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(low, high, least)]
    assert tree.successor(low, high, least).tolist() == want


def test_long_periodic_texts():
    for period in (1, 7, 1000):
        found = periodic.find_runs(np.arange(50_000, dtype=np.int64) % period, np.array([50_000]))
        assert found.tolist() == [[0, 0, 50_000, period]]


def test_rows_equal_the_definition(work, documents):
    rows = [(i, " ".join(f"w{w}" for w in t)) for i, t in enumerate(texts(8, 150))]
    rows += [(7, "a b " * 30), (7, "a b " * 30), (None, "x y z " * 9), (None, None), (901, None), (902, ""), (903, " \t\n"), (-5, "é b " * 20),
             (904, "long " * 3000), (905, "\x0bq\x0c" * 14)]
    got = periodic.summaries(documents(rows), edit=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(*r) for r in rows), key=str)
    plain = periodic.runs(documents(rows)).collect()
    want = [(i, *r) for i, t in rows for r in plain_runs(blank_split(t or ""))]
    assert sorted(map(tuple, plain), key=str) == sorted(want, key=str)


def test_small_chunks_change_nothing(work, documents, monkeypatch):
    rows = [(i, " ".join(f"w{w}" for w in t)) for i, t in enumerate(texts(9, 60))]
    want = sorted(map(tuple, periodic.summaries(documents(rows)).collect()), key=str)
    monkeypatch.setattr(periodic, "CHUNK_WORDS", 10)
    assert sorted(map(tuple, periodic.summaries(documents(rows)).collect()), key=str) == want


def test_empty_table(work, documents):
    assert periodic.summaries(documents([(1, "a")]).limit(0), edit=True).collect() == []


@pytest.mark.skipif(not os.path.isdir(PATH), reason="tables not present")
def test_registered_query(work):
    got = queries.QUERIES["op12_periodic"](work, PATH).collect()
    docs = work.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in docs if len(r["text"]) < 6000}
    assert len(got) == len(docs)
    assert sorted(tuple(r) for r in got if r["doc_id"] in short) == sorted(plain_row(i, t) for i, t in short.items())
