import hashlib

import pytest
from pyspark.sql import functions as F

from trueframe.operators import corpus as c
from trueframe.operators import joins as j
from trueframe.sources import readers, sinks


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def names(spark):
    data = [("real" if i % 4 else "fake", f"clip-{i}") for i in range(400)]
    return data, spark.createDataFrame(data, "bucket string, name string").repartition(6)


def test_ranked_sample_is_the_hash_order(names):
    data, df = names
    got = {(r.bucket, r.name) for r in c.hash_ranked_sample(df, "bucket", "name", 5, special={"real": 9}).collect()}
    want = set()
    for bucket, k in (("real", 9), ("fake", 5)):
        want |= {(bucket, n) for n in sorted((n for b, n in data if b == bucket), key=lambda n: sha("selection-v1:" + n))[:k]}
    assert got == want


def test_splits_are_disjoint_and_shortage_is_reported(names):
    _, df = names
    picked, short = c.hash_ranked_split(df, "bucket", "name", 80, 30)
    rows = picked.collect()
    assert len({r.name for r in rows}) == len(rows)
    counts = {(r.bucket, r.split): r["count"] for r in picked.groupBy("bucket", "split").count().collect()}
    assert counts == {("real", "train"): 80, ("real", "internal_development"): 30, ("fake", "train"): 80, ("fake", "internal_development"): 20}
    assert [(r.bucket, r.available) for r in short.collect()] == [("fake", 100)]


def test_hash_split_shares_and_override(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("group_id"))
    counts = {r.split: r["count"] for r in c.hash_split(df).groupBy("split").count().collect()}
    assert abs(counts["development"] - 1200) < 120 and abs(counts["calibration"] - 600) < 100
    forced = c.hash_split(df, forced=df.filter("group_id < '2'")).filter("group_id < '2'")
    assert {r.split for r in forced.select("split").distinct().collect()} == {"development"}
    one = c.hash_split(df).filter("group_id = '17'").first().split
    bucket = int(sha("split-v1:17")[:8], 16) % 10
    assert one == ("development" if bucket < 4 else "calibration" if bucket < 6 else "holdout")


def test_round_robin_is_balanced(names):
    _, df = names
    out = c.round_robin(df, c.sha("q|", F.col("name")), ["a", "b", "c"], c.sha("o|", F.col("name")), "name").collect()
    assert sorted(r.position for r in out) == list(range(1, 401))
    assert sorted([sum(r.quality == q for r in out) for q in "abc"]) == [133, 133, 134]


def test_epoch_pairs_never_pair_a_host_with_itself(spark):
    rows = spark.createDataFrame([(f"{k}{i}", k, q) for q in ("original", "mild") for k in ("real", "ai") for i in range(9)], "id string, label string, quality string")
    for epoch in (1, 2):
        got = c.epoch_pairs(rows, epoch).collect()
        kinds = {k: [r for r in got if r.kind == k] for k in ("whole", "real_ai_splice", "real_real_splice")}
        assert {k: len(v) for k, v in kinds.items()} == {"whole": 36, "real_ai_splice": 18, "real_real_splice": 18}
        assert all(r.id != r.donor_id and r.donor_id.startswith("real") and r.target == 0 for r in kinds["real_real_splice"])
        assert all(r.donor_id.startswith("ai") and r.target == 1 and 0 <= r.start <= 6 for r in kinds["real_ai_splice"])
        assert len({(r.donor_id, r.quality) for r in kinds["real_ai_splice"]}) == 18


def test_set_digest_sees_any_change_and_no_order(spark):
    df = c.row_fingerprint(spark.range(3000).withColumn("x", F.col("id") * 2), ["x", "id"])
    base = c.set_fingerprint(df, "id", fan=16).first().digest
    assert base == c.set_fingerprint(df.repartition(7), "id", fan=16).first().digest
    assert base != c.set_fingerprint(df.filter("id <> 5"), "id", fan=16).first().digest


@pytest.mark.parametrize("name, want", [("Sora", "t2v"), ("open-sora", "t2v"), ("I2VGen XL", "i2v"), ("youku", "real"), ("gen", "t2v"), ("camera", "unknown")])
def test_generator_family(spark, name, want):
    assert spark.range(1).select(c.generator_family(F.lit(name)).alias("x")).first().x == want


def test_exclusion_by_any_identity(spark):
    shape = "id string, basename string, crc string, size long, sha256 string"
    new = spark.createDataFrame([("a", "x", "c1", 1, "h1"), ("b", "y", "c2", 2, "h2"), ("c", "z", "c3", 3, "h3"), ("d", "w", "c2", 9, "h4")], shape)
    known = spark.createDataFrame([("1", "x", None, None, None), ("2", "q", "c2", 2, "n"), ("3", "r", "c9", 9, "h3")], shape)
    assert [r.id for r in j.exclude_known(new, known).collect()] == ["d"]
    audit = {r.identity: (r.shared_values, r.first_rows, r.second_rows) for r in j.overlap_audit(new, known).collect()}
    assert audit == {"basename": (1, 1, 1), "crc+size": (1, 1, 1), "sha256": (1, 1, 1)}


def test_leakage_and_sets(spark):
    m = spark.createDataFrame([("g", "h1", "development"), ("g", "h2", "holdout"), ("k", "h3", "holdout")], "group_id string, sha256 string, split string")
    assert [(r.key, r.value) for r in j.split_leakage(m).collect()] == [("group_id", "g")]
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, label string")
    b = spark.createDataFrame([("2", "z"), ("3", "x")], "id string, label string")
    assert {r.id: r.problem for r in j.set_difference(a, b, fields=["label"]).collect()} == {"1": "only_left", "2": "identity_differs", "3": "only_right"}


def test_track_tree_and_exclusive_sink(spark, tmp_path):
    for path in ("id/real/a.mp4", "ood/fake/sora/b.mp4", "ood/fake/sora/c.txt", "wild/fake/d.mp4", "other/real/e.mp4"):
        file = tmp_path / "tree" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x")
    got = sorted((r.track, r.solution, r.subcat) for r in readers.scan_track_tree(spark, str(tmp_path / "tree")).collect())
    assert got == [("id", "A", "real"), ("ood", "B", "sora")]
    rows = spark.createDataFrame([("1",)], "id string")
    sinks.sink_report(rows, rows, str(tmp_path / "run"))
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.sink_report(rows, rows, str(tmp_path / "run"))


def test_malformed_manifest_stops_the_read(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id":"1"}\n\n{"id":\n')
    with pytest.raises(Exception):
        readers.scan_manifest(spark, str(tmp_path)).collect()


def test_targets_of_sources(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)], "id long, source string")
    plan = spark.createDataFrame([("a", "ai", "hard", 20), ("b", "ai", "easy", 50), ("none", "real", "hard", 5)],
                                 "source string, label string, difficulty string, target long")
    picked = c.stratified_split(rows, "source", "id", 0, targets={"a": 20, "b": 50, "none": 5})
    got = {(r.label, r.difficulty, r.source): tuple(r)[3:] for r in c.target_summary(rows, picked, plan, "source").collect()}
    assert got[("ai", "hard", "a")] == (20, 30, 18, 2, 0) and got[("ai", "easy", "b")] == (50, 30, 27, 3, 20)
    assert got[("real", "hard", "none")] == (5, 0, 0, 0, 5) and got[("all", "all", "all")] == (75, 60, 45, 5, 25)
    assert got[("ai", "all", "all")] == (70, 60, 45, 5, 20) and len(got) == 3 + 3 + 2 + 1
    assert picked.filter("source = 'c'").count() == 0
