"""Queries over rows that are derived from the given tables, with typed edge cases, against their SQL."""

import duckdb
import pytest

from quillspark import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["p17_signature", "p25_diff", "p26_diagnostics", "f3_branch", "f9_f10_sandbox", "x1_dispatch", "t7_push_jobs", "j10_changed_files", "s4_branch_tip", "g2_callers", "a17_ancestors", "t1_source_chunks"]


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "events", "orders", "lineitem"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = duck.execute(catalog.SQL[name])
    cols = [c[0] for c in rel.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    want, got = sorted(map(str, rel.fetchall())), sorted(str(tuple(r)) for r in df.select(*cols).collect())
    assert len(want) > 20
    assert want == got
