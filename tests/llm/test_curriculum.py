import hashlib
import random
import re

import pytest
from .conftest import words

from trueframe.llm import curriculum


def plain(rows, share=1.5, weights=(5, 2, 1)):
    """Targets and taken words by the rule as stated, one source after the other."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:
        left = share * sum(total.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            break
        target |= {s: 2 * total[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    out = []
    for s in sources:
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), size(r[1])))
        passes = int(target[s] // total[s]) if total[s] else 0
        start, rest = 0, target[s] - passes * total[s]
        for r in mine:
            more = total[s] > 0 and 2 * start + size(r[1]) <= 2 * rest
            out.append((r[0], size(r[1]), total[s], round(target[s], 6), size(r[1]) * (passes + more)))
            start += size(r[1])
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def test_equals_the_rule(documents):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([1, 5, 40, 300])), rng.choice(["a", "a", "a", "b", "c", "Ä", None])) for i in range(300)]
    rows += [(None, "one two", "b"), (7, None, "a"), (8, "", "only-empty"), (9, " \t\n", "c"), (10, "x y", "a"), (10, "x y", "a")]
    assert got(curriculum.mixed(documents(rows))) == plain(rows)


def test_taken_is_near_target_and_within_two_copies(documents):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(1, 60)), rng.choice("abcd")) for i in range(800)]
    out = curriculum.mixed(documents(rows)).toPandas()
    assert (out["taken"] <= 2 * out["size"]).all()
    by = out.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by["taken"] - by["target"]).abs() <= 30).all()


def test_stream_has_each_copy_in_order_of_position(documents):
    rng = random.Random(5)
    docs = documents([(i, words(rng, 20), rng.choice("ab")) for i in range(100)] + [(100, "same", "a")] * 2)
    stream = curriculum.mix(docs)
    assert stream.columns == docs.columns
    want = {r.doc_id: r.taken // r["size"] for r in curriculum.mixed(docs).filter("doc_id < 100").collect() if r.taken}
    have = {r.doc_id: r["count"] for r in stream.filter("doc_id < 100").groupBy("doc_id").count().collect()}
    assert have == want


@pytest.mark.parametrize("knots", curriculum.SCHEDULES)
def test_position_inverts_the_integral(work, knots):
    from pyspark.sql import functions as F
    rows = work.range(0, 101).select((F.col("id") / 100).alias("f")).select("f", curriculum.position(F.col("f"), knots).alias("t")).collect()
    area = sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(knots, knots[1:]))
    for r in rows:
        spent = 0.0
        for (a, u), (b, v) in zip(knots, knots[1:]):
            at = min(max(r.t, a), b)
            spent += (at - a) * (u + (u + (v - u) * (at - a) / (b - a))) / 2
        assert spent / area == pytest.approx(r.f, abs=1e-9)


def test_empty_and_wordless_tables(documents):
    assert got(curriculum.mixed(documents([]))) == []
    assert curriculum.mix(documents([])).count() == 0
    assert got(curriculum.mixed(documents([(1, "", "a"), (2, None, None)]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
