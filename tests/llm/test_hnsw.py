import os

import numpy as np
import pytest

from trueframe.llm import hnsw, queries

PATH = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, shard string, block string, n string"


def make(work, rows):
    return work.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, every=50, k=5):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    found = {}
    for q, u in good:
        if q % every == 0:
            best = found.setdefault(q, {})
            for i, v in good:
                if i != q and len(v) == len(u):
                    best[i] = max(best.get(i, -2), hnsw.cosines(u[None], v[None, None])[0, 0])
    return {q: sorted(((-s, i) for i, s in best.items()))[:k] for q, best in found.items() if best}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, true):
    return np.mean([sum(s <= true[q][-1][0] for s, _ in found.get(q, [])) / len(true[q]) for q in true])


def points(seed, n, dims=24, groups=30, noise=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    return (centres[rng.integers(groups, size=n)] + noise * rng.standard_normal((n, dims))).tolist()


def test_recall_over_several_shards(work):
    rows = list(enumerate(points(1, 2500)))
    true = plain(rows, every=25)
    found = got(hnsw.nearest(make(work, rows), every=25, shard_rows=600))
    assert set(found) == set(true) and recall(found, true) >= 0.97
    df = work.createDataFrame([(q, k + 1, i, -s) for q, v in found.items() for k, (s, i) in enumerate(v)],
                              "query_id long, rank int, vec_id long, score double")
    asked = [q for q in true if q % 250 == 0]
    part = {q: true[q] for q in asked}
    assert hnsw.recall(df.filter(df.query_id.isin(asked)), make(work, rows), asked) == pytest.approx(recall(found, part))


def test_recall_needs_the_graph():
    """With links cut, the beam finds almost nothing: results come from the graph."""
    units = hnsw._normalised(np.array(points(3, 1500)))
    tops = np.sort(hnsw._tops(1500, 0))[::-1]
    graph = hnsw.Graph.build(units, tops)
    true = np.argsort(-(units @ units.T), axis=1)[:, :6]
    share = lambda g: np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(g.search(units, 64), true)])
    assert share(graph) >= 0.97
    cut = hnsw.Graph(units, tops, [np.full_like(layer, -1) for layer in graph.layers])
    assert share(cut) < 0.1
    # lists hold no node twice and never their own node
    for layer in graph.layers:
        for node, links in enumerate(layer):
            inside = links[links >= 0]
            assert node not in inside and len(set(inside.tolist())) == len(inside)


def test_equal_vectors_and_ties(work):
    """One vector fills half the table: ties go to the smaller ids, and nothing else is lost."""
    rows = [(i, v) for i, v in enumerate(points(4, 300, 8))] + [(1000 + i, [1.0] * 8) for i in range(400)]
    true = plain(rows)
    found = got(hnsw.nearest(make(work, rows), shard_rows=150))
    assert found.keys() == true.keys()
    for q in (1000, 1050, 1350):
        assert [i for _, i in found[q]] == [i for i in range(1000, 1006) if i != q][:5]
    assert recall(found, true) >= 0.97


def test_odd_rows(work):
    rows = [(i, [float(i % 7), 1.0, 2.0]) for i in range(60)]
    rows += [(50, [1.0, 0.0, 1.0]), (None, [1.0, 2.0, 3.0]), (100, [1.0, 1.0]), (101, [1.0, 2.0]), (150, None), (200, [0.0, 0.0]),
             (250, [float("nan"), 1.0]), (300, [1.0, 2.0, 3.0, 4.0]), (0, [0.0, 1.0, 2.0]), (0, [0.0, 1.0, 2.0]), (350, []), (400, [None, 1.0]),
             (450, [float("inf"), 1.0]), (500, [3e38, 3e38]), (501, [1e-38, 2e-38])]
    found, true = got(hnsw.nearest(make(work, rows))), plain(rows)
    assert {q: [i for _, i in v] for q, v in found.items()} == {q: [i for _, i in v] for q, v in true.items()}
    assert all(s == pytest.approx(t, abs=1e-15) for q in true for (s, _), (t, _) in zip(found[q], true[q]))
    assert hnsw.nearest(make(work, rows).limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(PATH), reason="tables not present")
def test_registered_query(work):
    rows = [(r["vec_id"], r["embedding"]) for r in work.read.parquet(f"{PATH}/embeddings.parquet").collect()]
    true = plain(rows)
    found = got(queries.QUERIES["op11_hnsw"](work, PATH))
    assert found.keys() == true.keys() and all(len(v) == 5 for v in found.values())
    assert recall(found, true) >= 0.95
