"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

With --duckdb: the queries' check SQL in DuckDB on the same tables instead.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trueframe.plans import QUERIES, registry  # noqa: E402
from trueframe.session import local_session  # noqa: E402

HEADLINE = (
    "breakdown", "rates_wilson", "auroc", "threshold_at_fpr", "cluster_bootstrap", "paired_bootstrap", "ece",
    "mcnemar", "persistent_runs", "temporal_verdict", "window_membership", "shot_windows", "op_ledger",
    "hash_split", "stratified_split", "exclude_known", "overlap_audit", "canonical_urls", "caption_claims",
    "verdict_waterfall", "pass_agreement", "velocity_jerk", "spatial_temporal_agg", "acceptance_gates", "clip_from_windows",
)


#: Run once untimed: one query each with joins, windows and Python workers.
WARM_UP = ("mcnemar", "persistent_runs", "frame_mean_score", "whitened_loglik")


def duckdb_seconds(path: str, cores: str) -> dict[str, float]:
    import duckdb

    db = duckdb.connect(config={"threads": cores})
    for name in registry.TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    spent, oracles = {}, registry.oracle_sql()
    for name in HEADLINE:
        started = time.perf_counter()
        db.execute(oracles[name]).fetchall()
        spent[name] = round(time.perf_counter() - started, 3)
    return spent


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    if "--duckdb" in sys.argv:
        print(json.dumps(duckdb_seconds(path, cores)))
        return
    spark = local_session(cores, "bench")
    # start threads, readers and Python workers and let the JVM compile before anything is timed
    for name in WARM_UP:
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
    spent = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": os.path.basename(path.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
