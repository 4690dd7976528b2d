import os

import duckdb
import pytest

from trueframe.llm import queries

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="tables not present")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_matches_check_sql(work, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    cursor = db.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in cursor.fetchall()), key=str)
    got = queries.QUERIES[name](work, PATH)
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(round(r[n], 6) if isinstance(r[n], float) else r[n] for n in names) for r in got.collect()), key=str)
    assert rows == want


def test_one_query_per_operator():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 14)] == [1] * 13
