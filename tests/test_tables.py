"""Log-structured keyed table and the carry of a budget, with crashes between their steps."""

import random

import pytest
from pyspark.sql import functions as F

from trueframe.session import shared_folder
from trueframe.streaming import tables

SCHEMA = "k string, at long, id long, until long"


def batches(seed, count, rows=30):
    rng = random.Random(seed)
    out, i = [], 0
    for _ in range(count):
        part = []
        for _ in range(rows):
            i += 1
            # late arrivals: the order does not follow the batches
            part.append((f"k{rng.randrange(25)}", rng.randrange(1000), i, rng.choice([100, 5000])))
        out.append(part)
    return out


def newest(parts):
    out = {}
    for row in (r for p in parts for r in p):
        if row[0] not in out or row[1:3] > out[row[0]][1:3]:
            out[row[0]] = row
    return out


def table(spark, fan=3):
    return tables.KeyedTable(spark, shared_folder(spark, "keyed"), SCHEMA, "k", ["at", "id"], fan)


def held(t):
    return {r.k: tuple(r) for r in t.latest().collect()}


def test_merge_on_read_over_levels(spark):
    t, parts = table(spark), batches(1, 11)
    assert held(t) == {}
    for n, part in enumerate(parts):
        t.add(n, spark.createDataFrame(part, SCHEMA))
        assert held(t) == newest(parts[:n + 1])
        version, last, live, _ = t.runs()
        assert (version, last) == (n, n) and all(sum(at == x for at, _ in live) < 3 for x in range(4))
    # 11 batches in base 3 are 1 0 2: one run of nine, none of three, two of one
    assert sorted(at for at, _ in t.runs()[2]) == [0, 0, 2]
    assert {r.k for r in t.latest(F.col("k").isin("k1", "k2")).collect()} == {"k1", "k2"}


def test_a_batch_writes_only_its_rows_and_counts_once(spark):
    t, parts = table(spark, fan=50), batches(2, 3)
    for n, part in enumerate(parts):
        t.add(n, spark.createDataFrame(part, SCHEMA))
        t.add(n, spark.createDataFrame([("k1", 9999, 9999, 1)], SCHEMA))  # the batch again: nothing happens
    for (_, name), part in zip(sorted(t.runs()[2], key=lambda r: r[1]), parts):
        assert {tuple(r) for r in spark.read.parquet(f"{t.folder}/{name}").collect()} == set(newest([part]).values())
    assert held(t) == newest(parts)


@pytest.mark.parametrize("step", ["run", "merge", "commit"])
def test_a_crash_leaves_the_old_table(spark, monkeypatch, step):
    t, parts = table(spark), batches(3, 4)
    for n in (0, 1):
        t.add(n, spark.createDataFrame(parts[n], SCHEMA))
    write, calls = t._write, []

    def failing(rows, name):
        calls.append(name)
        write(rows, name)
        if step == "run" or step == "merge" and len(calls) == 2:
            raise OSError("lost")

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(t, "_write", failing)
        if step == "commit":
            broken.setattr(t, "_commit", lost)
        with pytest.raises(OSError):
            t.add(2, spark.createDataFrame(parts[2], SCHEMA))
    assert held(t) == newest(parts[:2])
    t.add(2, spark.createDataFrame(parts[2], SCHEMA))
    t.add(3, spark.createDataFrame(parts[3], SCHEMA))
    assert held(t) == newest(parts)


def test_a_torn_commit_falls_back(spark):
    t, parts = table(spark), batches(4, 2)
    for n, part in enumerate(parts):
        t.add(n, spark.createDataFrame(part, SCHEMA))
    # a writer that had emptied the next slot and not filled it
    spark.createDataFrame([], t.ring.shape).write.mode("overwrite").parquet(f"{t.ring.folder}/slot=2")
    assert held(t) == newest(parts)


def test_expired_rows_go_when_everything_is_merged(spark):
    t, alive = table(spark), F.col("until") > 1000
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    t.add(0, rows(("a", 5, 1, 9999), ("b", 5, 2, 100)), alive)
    t.add(1, rows(("a", 6, 3, 100)), alive)
    assert set(held(t)) == {"a", "b"} and held(t)["a"][3] == 100
    t.add(2, rows(("c", 7, 4, 9999)), alive)
    # the expired row of "a" went together with the one that it hid
    assert set(held(t)) == {"c"}


def test_merged_runs_are_emptied_later(spark):
    t = table(spark, fan=2)
    for n, part in enumerate(batches(5, 9, rows=6)):
        t.add(n, spark.createDataFrame(part, SCHEMA))
    retired = {name for name, _ in t.runs()[3]}
    assert spark.read.schema(SCHEMA).parquet(f"{t.folder}/run-0-0").count() == 0 and "run-0-0" not in retired
    assert all(spark.read.schema(SCHEMA).parquet(f"{t.folder}/{name}").count() for name in retired)


def test_budget_reads_few_files_and_survives_a_restart(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    want, total, seq = {}, 0, 0

    def arrive(n):
        nonlocal seq, total
        rows = []
        for _ in range(20):
            kind = "reserve" if seq % 3 else "release"
            total += seq % 11 + 1 if kind == "reserve" else 0
            want[seq] = (total, "over_budget" if kind == "reserve" and total > 400 else None)
            rows.append((seq, kind, seq, seq % 11 + 1))
            seq += 1
        spark.createDataFrame(rows, "seq long, kind string, sequence long, bytes long").coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        (source / f"{n}.parquet").write_bytes(next((tmp_path / f"p{n}").glob("*.parquet")).read_bytes())

    folder = shared_folder(spark, "budget")

    def run():
        stream = spark.readStream.schema("seq long, kind string, sequence long, bytes long").parquet(str(source))
        tables.account(stream, 400, folder, f"{folder}/check").awaitTermination(120)

    for n in range(7):
        arrive(n)
        if n == 3:  # rows are written, the carry is not
            with monkeypatch.context() as broken:
                broken.setattr(tables.Ring, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(Exception, match="lost"):
                    run()
        run()
    rows = spark.read.schema("seq long, kind string, reserved long, problem string").parquet(f"{folder}/rows/*").collect()
    assert {r.seq: (r.reserved, r.problem) for r in rows} == want and len(rows) == len(want)
    ring = tables.Ring(spark, f"{folder}/carry", "reserved long, rows long")
    assert [(r.version, r.reserved, r.rows) for r in ring.latest()] == [(6, total, seq)]
    assert spark.read.parquet(f"{folder}/carry").count() == tables.SLOTS
