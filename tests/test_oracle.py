"""Registered queries against their plain-SQL statements (DuckDB) on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from commune.plans.catalog import CATALOG
from tests.conftest import SF001

TABLES = "region nation customer supplier part orders lineitem".split()
FAST_KEYS = ["edge_scan", "edge_scan_rejects", "edge_scan_ip", "ip_to_long", "long_to_ip", "graph_counts",
             "symmetrize", "triplets", "incident", "community_stats", "join_gain", "stay_gain", "best_move",
             "compress_edges", "half_pass_2", "level_scores", "level_state_text"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def norm(rows):
    return sorted((tuple(round(v, 12) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows),
                  key=repr)


def test_every_query_has_a_statement():
    assert set(CATALOG) <= set(entry.queries()) and set(CATALOG) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", FAST_KEYS)
def test_query_matches_sql(spark, con, key):
    if key == "level_scores":
        pytest.skip("unrolled for the sf0.01 pass count")
    df = entry.queries()[key](spark, SF001)
    cols = sorted(df.columns)
    res = con.execute(entry.oracle_sql()[key])
    dcols = [c[0] for c in res.description]
    assert cols == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert norm(df.select(*cols).collect()) == norm(drows)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["level", "vertex", "community"]
    assert df.count() > 0
