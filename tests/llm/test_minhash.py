import random
import re

import numpy as np
import pyarrow as pa

from trueframe.llm import components, minhash

from .conftest import words


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] is None or rows[j][0] is None or not a or not b:
                continue
            if rows[i][0] == rows[j][0] or 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        least = None if doc is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and root(j) == root(i))
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_equals_comparing_all_pairs(documents):
    rng, rows = random.Random(1), []
    for g in range(25):
        base = words(rng, rng.choice([7, 30, 120, 300]))
        rows += [(100 * g + k, edited(rng, base, rng.randrange(0, 4))) for k in range(rng.randrange(1, 6))]
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one two"), (9004, "ONE\ttwo"), (9005, "two one"), (None, "one two"), (9006, "Ä b c d e"), (9007, "ä b c d e")]
    rows += [(9008, rows[0][1].upper()), (9009, words(rng, 30_000)), (9010, "la " * 500), (9011, "la la la la la")]
    assert got(minhash.near_duplicates(documents(rows))) == plain(rows)


def test_chain_and_large_group_of_near_copies(documents):
    rng = random.Random(2)
    base = words(rng, 170, 10**6)
    rows = [(k, edited(rng, base, rng.choice([1, 2, 3]))) for k in range(700)]
    chain = words(rng, 200, 10**6).split(" ")
    for k in range(20):
        chain[9 * k] = f"c{k}"
        rows.append((2000 + k, " ".join(chain)))
    assert got(minhash.near_duplicates(documents(rows))) == plain(rows)


def test_common_passage_does_not_link(documents):
    rng = random.Random(3)
    passage = words(rng, 60)
    rows = [(k, passage + " " + words(rng, 60)) for k in range(200)]
    assert got(minhash.near_duplicates(documents(rows))) == plain(rows)


def test_rows_of_one_id_and_deduplicated(documents):
    rng = random.Random(4)
    text = words(rng, 50)
    rows = [(1, text), (1, text), (2, text), (3, words(rng, 50)), (None, text), (None, text), (4, "")]
    assert got(minhash.near_duplicates(documents(rows))) == plain(rows)
    left = minhash.deduplicated(documents(rows))
    assert left.columns == documents(rows).columns
    assert sorted((str(r.doc_id) for r in left.collect())) == ["1", "3", "4", "None", "None"]


def test_deduplicated_at_80_percent(documents):
    rng = random.Random(6)
    rows = []
    for g in range(40):
        base = words(rng, 204, 10**6).split(" ")
        copy = list(base)
        for k in range(3 + g % 4):
            copy[20 + 40 * k if k < 5 else 190] = f"c{k}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    sets = [shingles(t) for _, t in rows]
    gone = {2 * g + 1 for g in range(40) if 100 * len(sets[2 * g] & sets[2 * g + 1]) >= 80 * len(sets[2 * g] | sets[2 * g + 1])}
    between = {d for d in gone if 100 * len(sets[d] & sets[d - 1]) < 85 * len(sets[d] | sets[d - 1])}
    assert between and len(gone) < 40
    left = minhash.deduplicated(documents(rows), 80)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - gone
    assert minhash.agreeing(85) == 38 and 30 <= minhash.agreeing(80) < 38


def test_empty_table(documents):
    assert got(minhash.near_duplicates(documents([]))) == []
    assert minhash.deduplicated(documents([])).count() == 0


def test_pairs_are_taken_up_under_their_smallest_key():
    sig = np.zeros((70, 64), np.int32)
    keys = [np.array([3, 7]) if i % 2 else np.array([7, 9]) for i in range(70)]
    rep, component = np.arange(70), np.arange(70)
    args = (np.zeros(70), rep, component, np.full(70, 100), sig, keys, 85)
    a, b = minhash._counted(7, *args)
    assert {(i % 2, j % 2) for i, j in zip(a.tolist(), b.tolist())} == {(0, 0), (0, 1), (1, 0)}
    assert len(a) == 70 * 69 // 2 - 35 * 34 // 2


def test_components_of_random_links(work):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (5, 5)]
    label = {v: v for pair in links for v in pair if v is not None}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a is not None and b is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    found = components.components(work.createDataFrame(pa.Table.from_pylist([{"a": a, "b": b} for a, b in links]).to_pandas().astype("Int64")))
    assert {(r.node, r.component) for r in found.collect()} == {(v, c) for v, c in label.items() if v != c}
