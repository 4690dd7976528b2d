"""Registered queries against their check SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import normal
from trueframe.plans import registry

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="tables not present")
# one query per family; tools/check.py runs all of them
NAMES = ("breakdown", "rates_wilson", "auroc", "threshold_at_fpr", "mcnemar", "persistent_runs", "coverage_gaps", "temporal_verdict",
         "window_membership", "shot_windows", "hash_ranked_sample", "split_three_way", "exclude_known", "verdict_waterfall",
         "specialist_fusion", "canonical_urls", "scrub_links", "velocity_jerk", "acceptance_gates", "validate_manifest", "flatten_frames",
         "validate_document", "fingerprint_differences", "stratified_targets", "match_disclosures")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_check_sql(spark, db, name):
    import pandas as pd
    got = entry.queries()[name](spark, PATH).toPandas()
    cursor = db.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[c[0] for c in cursor.description])
    assert sorted(got.columns) == sorted(want.columns)
    a = normal(pd.DataFrame({c: list(got[c].astype(object)) for c in got.columns}))
    b = normal(want)
    assert len(a) == len(b)
    for column in a.columns:
        assert [x if x == x else None for x in a[column]] == [x if x == x else None for x in b[column]], column


def test_every_query_has_a_name_and_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
