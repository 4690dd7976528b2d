"""Streams over several micro-batches against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from trueframe.session import shared_folder
from trueframe.streaming import jobs

SHAPE = "case_id long, at_us long, event_id long, nano long, score double, valid boolean, error string"


@pytest.fixture(scope="module")
def events():
    rng = random.Random(8)
    out, at = [], 0
    for i in range(300):
        at += rng.choice([1, 5, 40, 200]) * 1_000_000
        out.append((rng.choice([1, 1, 2, 3]), at, i, i * 400_000_000, rng.choice([.1, .9]), rng.random() < .9, rng.choice(["a", "a", "b", None])))
    return out


@pytest.fixture()
def stream(spark, events, tmp_path):
    for n in range(3):  # three files in time order, one micro-batch each
        spark.createDataFrame(events[n * 100:(n + 1) * 100], SHAPE).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    files = sorted((next((tmp_path / f"in{n}").glob("*.parquet")), n) for n in range(3))
    source = tmp_path / "src"
    source.mkdir()
    import os
    for file, n in files:
        target = source / f"{n}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_000_000 + n, 1_000_000 + n))
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(source))


def collected(spark, stream, name):
    folder = shared_folder(spark, name)
    query = jobs.to_files(stream, f"{folder}/out", f"{folder}/check")
    query.awaitTermination(120)
    assert query.lastProgress["batchId"] == 2
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def by_case(events):
    out = {}
    for e in events:
        out.setdefault(e[0], []).append(e)
    return out


def test_admission_counts_only_admitted(spark, stream, events):
    got = {r.event_id: (r.outcome, r.retry_after) for r in collected(spark, jobs.admission(stream, "case_id", 5, jobs.WINDOW_US).withColumnRenamed("key", "k"), "adm")}
    for rows in by_case(events).values():
        times = []
        for _, at, i, *_ in rows:
            times = [t for t in times if t > at - jobs.WINDOW_US]
            if len(times) >= 5:
                assert got[i] == ("refused", max(1, -(-(times[0] + jobs.WINDOW_US - at) // 1_000_000)))
            else:
                times.append(at)
                assert got[i] == ("admitted", None)
    assert {o for o, _ in got.values()} == {"admitted", "refused"}


def test_runs_equal_the_batch_rule(spark, stream, events):
    rows = collected(spark, jobs.runs(stream, 600_000_000), "runs")
    longest = {}
    for r in rows:
        if r.n > longest.get((r.case_id, r.first_event_id), (0,))[0]:
            longest[r.case_id, r.first_event_id] = (r.n, r.last_nano)
    want = {}
    for case, items in by_case(events).items():
        run = []
        for _, _, i, nano, score, ok, _ in items:
            good = ok and score >= .5
            if run and not (good and 0 < nano - run[-1][1] <= 600_000_000):
                want[case, run[0][0]] = (len(run), run[-1][1])
                run = []
            if good:
                run.append((i, nano))
        if run:
            want[case, run[0][0]] = (len(run), run[-1][1])
    assert longest == want


def test_error_stop_once_per_key(spark, stream, events):
    got = {r.case_id: r.event_id for r in collected(spark, jobs.error_stop(stream), "err")}
    want = {}
    for case, items in by_case(events).items():
        last, n = None, 0
        for e in items:
            n = 0 if e[6] is None else n + 1 if e[6] == last else 1
            last = e[6]
            if n == 3:
                want[case] = e[2]
                break
    assert got == want


def test_coalesce_opens_a_flight_after_landing(spark, stream, events):
    got = {r.event_id: r.leader for r in collected(spark, jobs.coalesce_requests(stream, "case_id", 60_000_000).withColumnRenamed("key", "k"), "co")}
    for items in by_case(events).values():
        leader, opened = None, None
        for _, at, i, *_ in items:
            if opened is None or at >= opened + 60_000_000:
                leader, opened = i, at
            assert got[i] == leader


def test_upsert_keeps_one_latest_row(spark, stream, events, tmp_path):
    rows = stream.select(F.concat(F.lit("k"), F.col("case_id")).alias("canonical_key"), F.col("at_us").alias("analyzed_us"), "event_id", "valid")
    table = str(tmp_path / "table")
    jobs.cache_upsert(rows, table, str(tmp_path / "stage"), str(tmp_path / "check"), F.col("valid"), buckets=4).awaitTermination(120)
    got = {r.canonical_key: r.event_id for r in spark.read.parquet(table).collect()}
    want = {}
    for e in events:
        if e[5]:
            want[f"k{e[0]}"] = e[2]
    assert got == want and spark.read.parquet(table).count() == len(want)


def test_budget_runs_on_over_batches(spark, stream, events, tmp_path):
    rows = stream.select(F.col("event_id").alias("seq"), F.lit("reserve").alias("kind"), F.col("event_id").alias("sequence"), (F.col("event_id") % 7 + 1).alias("bytes"))
    jobs.op_budget(rows, 900, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r.seq: (r.reserved, r.problem) for r in spark.read.parquet(str(tmp_path / "out/rows/*")).collect()}
    total = 0
    for i in range(300):
        total += i % 7 + 1
        assert got[i] == (total, "over_budget" if total > 900 else None)


def test_late_rows_come_out_marked_and_change_nothing(spark, events, tmp_path):
    """Files out of order: what is in order per key equals the batch rule, the rest is counted."""
    import os
    parts = [events[100:200], events[:100], events[200:]]
    source = tmp_path / "late"
    source.mkdir()
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(str(tmp_path / f"late{n}"))
        target = source / f"{n}.parquet"
        target.write_bytes(next((tmp_path / f"late{n}").glob("*.parquet")).read_bytes())
        os.utime(target, (1_000_000 + n, 1_000_000 + n))
    late = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(source))
    seen_first = {e[0] for e in parts[0]}
    dropped = {e[2] for e in parts[1] if e[0] in seen_first}
    kept = [e for e in events if e[2] not in dropped]

    rows = collected(spark, jobs.coalesce_requests(late, "case_id", 60_000_000).withColumnRenamed("key", "k"), "late")
    assert {r.event_id for r in rows if r.late} == dropped
    got = {r.event_id: r.leader for r in rows if not r.late}
    for items in by_case(kept).values():
        leader, opened = None, None
        for _, at, i, *_ in items:
            if opened is None or at >= opened + 60_000_000:
                leader, opened = i, at
            assert got[i] == leader
    errors = collected(spark, jobs.error_stop(late), "late-errors")
    assert {r.event_id for r in errors if r.late} == dropped
    runs = collected(spark, jobs.runs(late, 600_000_000), "late-runs")
    assert {r.first_event_id for r in runs if r.late} == dropped
