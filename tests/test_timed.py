"""Event-time processors over files out of order, against plain loops and with their state gone afterwards."""

import os
import random

import pytest

from trueframe.session import shared_folder
from trueframe.streaming import jobs, timed

SHAPE = "case_id long, at_us long, event_id long, nano long, score double, valid boolean, error string"
SECOND = 1_000_000
DELAY = 400


@pytest.fixture(scope="module")
def events():
    rng = random.Random(8)
    out, at = [], 1_000 * SECOND
    for i in range(400):
        at += rng.choice([1, 5, 40, 200]) * SECOND // 10
        out.append((rng.choice([1, 1, 1, 2, 3]), at, i, i * 400_000_000, rng.choice([.1, .9, .9]), rng.random() < .9, rng.choice(["a", "a", "b", None])))
    return out


@pytest.fixture(scope="module")
def parts(events):
    """Rows out of order by less than the delay, and a few that come far too late, in the last file."""
    rng = random.Random(2)
    late = {e[2] for e in rng.sample(events[:150], 9)}
    order = sorted((e for e in events if e[2] not in late), key=lambda e: e[1] + rng.random() * DELAY * SECOND)
    cut = len(order) // 4
    out = [order[n * cut:(n + 1) * cut if n < 3 else None] for n in range(4)]
    out[3] = out[3] + [e for e in events if e[2] in late]
    return out, late


def run(spark, parts, tmp_path, key, processor, delay=f"{DELAY} seconds"):
    source = tmp_path / "src"
    source.mkdir()
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        target = source / f"{n}.parquet"
        target.write_bytes(next((tmp_path / f"p{n}").glob("*.parquet")).read_bytes())
        os.utime(target, (1_000_000 + n, 1_000_000 + n))
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(source))
    return timed.finished(stream, lambda s: timed.by_time(s, key, processor, delay), "timed").collect()


def kept(events, late):
    out = {}
    for e in events:
        if e[2] not in late:
            out.setdefault(e[0], []).append(e)
    return out


def test_admission(spark, events, parts, tmp_path):
    window = 60 * SECOND
    rows = run(spark, parts[0], tmp_path, "case_id", timed.TimedAdmission(4, window))
    assert {r.event_id for r in rows if r.late} == parts[1] == {r.event_id for r in rows if r.outcome == "late"}
    got = {r.event_id: (r.outcome, r.retry_after) for r in rows if not r.late}
    assert len(rows) == len(events)
    for items in kept(events, parts[1]).values():
        times = []
        for _, at, i, *_ in items:
            times = [t for t in times if t > at - window]
            if len(times) >= 4:
                assert got[i] == ("refused", max(1, -(-(times[0] + window - at) // SECOND)))
            else:
                times.append(at)
                assert got[i] == ("admitted", None)
    assert {o for o, _ in got.values()} == {"admitted", "refused"}


def test_coalesce(spark, events, parts, tmp_path):
    rows = run(spark, parts[0], tmp_path, "case_id", timed.TimedCoalesce(45 * SECOND))
    assert {r.event_id for r in rows if r.late} == parts[1] and len(rows) == len(events)
    got = {r.event_id: (r.leader, r.opened_flight) for r in rows}
    for items in kept(events, parts[1]).values():
        leader, opened = None, None
        for _, at, i, *_ in items:
            if opened is None or at >= opened + 45 * SECOND:
                leader, opened = i, at
            assert got[i] == (leader, leader == i)


def plain_runs(items, gap):
    run, out = [], []
    for _, _, i, nano, score, ok, _ in items:
        good = ok and score >= .5
        if run and not (good and 0 < nano - run[-1][1] <= gap):
            out.append(run)
            run = []
        if good:
            run.append((i, nano, score))
    return {(r[0][0], len(r), r[0][1], r[-1][1], max(s for _, _, s in r)) for r in [*out, run] if r}


def test_runs_close_by_rows_and_by_silence(spark, events, parts, tmp_path):
    rows = run(spark, parts[0], tmp_path, "case_id", timed.TimedRuns(900_000_000, 10_000 * SECOND))
    assert {r.first_event_id for r in rows if r.late} == parts[1] and all(r.n == 0 for r in rows if r.late)
    for case, items in kept(events, parts[1]).items():
        mine = [(r.first_event_id, r.n, r.first_nano, r.last_nano, r.max_score) for r in rows if not r.late and r.case_id == case]
        assert len(mine) == len(set(mine)) and set(mine) == plain_runs(items, 900_000_000)


def test_error_stop(spark, events, parts, tmp_path):
    rows = run(spark, parts[0], tmp_path, "case_id", timed.TimedErrorStop(3, 10_000 * SECOND))
    assert {r.event_id for r in rows if r.late} == parts[1]
    want = {}
    for case, items in kept(events, parts[1]).items():
        last, n = None, 0
        for e in items:
            n = 0 if e[6] is None else n + 1 if e[6] == last else 1
            last = e[6]
            if n == 3:
                want[case] = e[2]
                break
    assert {r.case_id: r.event_id for r in rows if not r.late} == want and len(want) == 3


def test_state_of_an_idle_key_goes(spark, tmp_path):
    """Key 1 falls silent; key 2 moves the watermark past its window and stays."""
    rows = [(1, SECOND, 1, 0, .9, True, "a"), (2, 2 * SECOND, 2, 0, .9, True, "a"), (2, 500 * SECOND, 3, 0, .9, True, "a")]
    source = tmp_path / "src"
    source.mkdir()
    for n, row in enumerate(rows):
        spark.createDataFrame([row], SHAPE).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        target = source / f"{n}.parquet"
        target.write_bytes(next((tmp_path / f"p{n}").glob("*.parquet")).read_bytes())
        os.utime(target, (1_000_000 + n, 1_000_000 + n))
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = timed.by_time(stream, "case_id", timed.TimedAdmission(4, 60 * SECOND), "0 seconds")
    folder = shared_folder(spark, "idle")
    jobs.to_files(out, f"{folder}/out", f"{folder}/check").awaitTermination(120)
    read = lambda name, **more: spark.read.format("statestore").options(stateVarName=name, **more).load(f"{folder}/check")
    keys = {r.key.case_id for r in read("state").collect()} | {r.key.case_id for r in read("waiting").collect()}
    assert keys == {2}
    done = spark.read.schema(out.schema).parquet(f"{folder}/out").collect()
    assert {r.event_id for r in done} >= {1, 2}
