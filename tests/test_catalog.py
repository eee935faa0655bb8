"""Queries against their SQL counterparts on the stored tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridweave import catalog, oracle

FOLDER = os.environ.get("GRIDWEAVE_TEST_DIR", "/root/testdata/sf0.001")
TABLES = ("nation", "supplier", "part", "lineitem", "events", "embeddings")
# A cross-section that runs quickly; the driver compares all of them.
CHECKED = (
    "point_validate", "domain_box", "boxes", "leaf_membership", "collapsed_boxes", "eta_sweep", "interaction_pairs",
    "admissible_pairs", "coverage_audit", "sampling_constraints", "constraint_conflicts", "constraint_sets",
    "constraint_set_columns", "conflict_edges", "conflict_graph", "sample_counts", "level_sample", "leaf_boxes", "rmatvec_thick",
    "difference_matvec", "kernel_entries", "admissible_sketch", "leaf_probe", "leaf_blocks", "hier_matvec",
)


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip(f"no tables at {FOLDER}")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (df[cols].sort_values(cols).reset_index(drop=True) for df in (got, want))
    assert len(got) == len(want) > 0
    for c in cols:
        assert (got[c] == want[c]).all(), c


def test_entry(spark):
    if not os.path.isdir(entry.FLAGSHIP_DIR):
        pytest.skip("no tables")
    assert {r.depth for r in entry.entry(spark).collect()} == {0, 1, 2, 3}
