import numpy as np
import pytest

from trueframe.llm import nn_descent
from trueframe.llm.common import written

SCHEMA = "vec_id long, embedding array<float>, label int, node string, space string"


def make(work, rows):
    return work.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def plain(rows, threshold=0.98):
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows
            if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    good = [(i, v / np.abs(v).max(), label) for i, v, label in good]
    good = [(i, v / np.linalg.norm(v), label) for i, v, label in good]
    links = {i: 0 for i, _, _ in rows}
    label = {i: i for i, _, _ in rows}
    pairs = [(a, b) for k, (a, u, x) in enumerate(good) for b, v, y in good[:k] if x == y and len(u) == len(v) and u @ v >= threshold]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(len(good)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {(i, links[i], label[i], i == label[i]) for i, _, _ in rows}


def got(df):
    return {tuple(r) for r in df.collect()}


def clusters(seed, sizes, noise, dims=32):
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rng.standard_normal(dims)
        for _ in range(size):
            out.append((centre / np.linalg.norm(centre) + noise * rng.standard_normal(dims)).tolist())
    return out


def test_equals_comparing_all_pairs(work):
    vectors = clusters(1, [1] * 200 + [2] * 20 + [7, 40], 0.015)
    rows = [(3 * i, v, i % 2) for i, v in enumerate(vectors)] + [(3 * i + 1, v, 1) for i, v in enumerate(vectors[::9])]
    rows += [(9001, None, 1), (9002, [0.0] * 32, 1), (9003, [float("nan")] + [1.0] * 31, 1), (9004, [None] + [1.0] * 31, 1),
             (9005, [float("inf")] + [1.0] * 31, 1), (9006, vectors[0], None), (9007, [], 1), (9008, [1.0, 2.0], 1), (9009, [2.0, 4.0], 1),
             (9010, [1e-38, 2e-38], 1), (9011, [3e38, 3e38], 1)]
    assert got(nn_descent.near_duplicates(make(work, rows))) == plain(rows)


def test_saturated_lists_are_enlarged(work):
    vectors = clusters(2, [700, 30], 0.004) + clusters(3, [5], 0.002) * 8
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    assert got(nn_descent.near_duplicates(make(work, rows))) == plain(rows)


def test_full_lists_of_two_tight_groups_and_a_vector_between(work):
    rng = np.random.default_rng(6)

    def around(angle, size, noise=0.002):
        centre = np.zeros(32)
        centre[:2] = np.cos(angle), np.sin(angle)
        return [(centre + noise * rng.standard_normal(32)).tolist() for _ in range(size)]

    # 0.985 between the groups, 0.9998 inside
    near = float(np.arccos(0.985))
    rows = [(i, v, 0) for i, v in enumerate(around(0, 100) + around(near, 100))]
    # two groups out of each other's reach, and one vector that links with both
    far = [(500 + i, v, 1) for i, v in enumerate(around(0, 60) + around(1.8 * near, 60) + around(0.88 * near, 1, 0))]
    found = got(nn_descent.near_duplicates(make(work, rows + far)))
    assert found == plain(rows + far)
    assert {r[1] for r in found if r[0] < 500} == {199} and {r[2] for r in found} == {0, 500}


def test_labels_that_miss_the_recall_are_compared_whole(work, monkeypatch):
    monkeypatch.setattr(nn_descent, "AUDITED", 40)
    # a search that finds nothing: label 0 has many lone pairs, label 1 one that the first sample need not show
    monkeypatch.setattr(nn_descent, "neighbour_lists", lambda points, threshold, k: (work.createDataFrame([], "a long, b long, near double"), k))
    vectors = clusters(7, [2] * 60, 0.01)
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(500 + i, v, 1) for i, v in enumerate(clusters(8, [1] * 90 + [2], 0.01))]
    assert got(nn_descent.near_duplicates(make(work, rows))) == plain(rows)


def test_tables_grow_and_crowded_leaves_keep_pairs(work):
    bits = work.createDataFrame([(0,), (8,), (12,), (19,)], "bits int")
    chance = 1 - np.arccos(0.98) / np.pi
    for r in bits.select("bits", nn_descent._tables(bits["bits"], 0.98).alias("t")).collect():
        assert r.t >= nn_descent.TABLES and (1 - chance ** r.bits) ** r.t <= 1e-3
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(32)
    # a narrow cone: planes through the origin leave almost all vectors in one leaf
    base = centre / np.linalg.norm(centre) + 0.02 * rng.standard_normal((1000, 32))
    vectors = np.concatenate([base, base + 0.001 * rng.standard_normal((1000, 32))])
    _, points = nn_descent.nodes(make(work, [(i, v.tolist(), 0) for i, v in enumerate(vectors)]))
    met = {(r.a, r.b) for r in nn_descent._leaves(points, 3, 0).collect()}
    assert sum((i, i + 1000) in met for i in range(1000)) >= 995


def test_rounds_find_what_the_leaves_missed(work):
    vectors = clusters(4, [1] * 150 + [6] * 15, 0.01)
    _, points = nn_descent.nodes(make(work, [(i, v, 0) for i, v in enumerate(vectors)]))
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T
    # a poor graph: each vector of a group knows only the next of its group
    start = [(i, i + 1, float(near[i, i + 1])) for i in range(150, 239) if near[i, i + 1] >= 0.9]
    lists = work.createDataFrame(start, "a long, b long, near double")
    assert nn_descent._audit(lists, points, 0.98) < 0.5
    for _ in range(3):
        lists = written(nn_descent._refined(lists, points, 10, 0.8), "test-lists")
    assert nn_descent._audit(lists, points, 0.98) == pytest.approx(1.0)


def test_rows_of_one_id_and_empty_table(work):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (2, [0.0, 2.0], 0)]
    assert got(nn_descent.near_duplicates(make(work, rows))) == {(1, 1, 1, True), (None, 0, None, True), (2, 1, 1, False)}
    assert got(nn_descent.near_duplicates(make(work, []))) == set()
