import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave import Grid
from gridweave.operators import mesh, near
from gridweave.sources import points


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


@pytest.mark.parametrize(
    "op,d,given,want,col",
    [
        (mesh.patch_to_rows, 2, [0, 2, 3], [0, 1, 4, 5, 6, 7], "i"),
        (mesh.patch_to_cols, 3, [1, 3], [2, 3, 6, 7], "j"),
        (mesh.patch_to_rows, 3, [0, 2], [0, 1, 2, 6, 7, 8], "i"),
    ],
)
def test_index_expansion(spark, op, d, given, want, col):
    assert sorted(r[col] for r in op(ids(spark, given), d).collect()) == want


def test_summary(make_points):
    row = mesh.mesh_summary(make_points(np.zeros((5, 3))), 3).first()
    assert (row.n_patches, row.n_rows, row.n_cols, row.dof_row, row.dof_col) == (5, 15, 10, 3, 2)
    with pytest.raises(ValueError):
        mesh.mesh_summary(make_points(np.zeros((5, 3))), 4)


def test_validate_counts_every_reason(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.0, 0.0, 0.1), (1, 1.0, 1.0, 0.1), (1, 1.0, 1.0, 0.1), (2, None, 0.0, 0.1), (3, nan, 0.0, 0.1),
            (4, 0.0, -inf, 0.1), (None, 0.0, 0.0, 0.1), (None, 0.0, 0.0, 0.1), (5, 0.0, 0.0, -1.0), (6, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, len double")
    got = {r.reason: r.n_rows for r in points.validate(df).collect()}
    assert got == {"duplicate_id": 2, "null_id": 2, "null_coordinate": 1, "nan_coordinate": 1,
                   "infinite_coordinate": 1, "bad_len": 2}
    with pytest.raises(ValueError):
        points.validate(df, ("x",))
    with pytest.raises(ValueError):
        points.validate(df, ("x", "z"))


def test_grid_rejects_bad_input(spark, make_points):
    with pytest.raises(ValueError):
        Grid.fit(make_points([[0.0, 0.0]]), ("x",))
    with pytest.raises(ValueError):
        Grid.fit(make_points([[0.0, 0.0]]).limit(0))
    with pytest.raises(ValueError):
        Grid.fit(make_points([[0.0, 0.0]])).check_depth(27)


def test_domain_box(make_points):
    rows = {r.axis: r for r in mesh.domain_box(make_points([[0.0, 5.0], [2.0, 5.0]]), ("x", "y")).collect()}
    assert rows["x"].lo == 0.0 and rows["x"].hi == 2.0 + 2e-9
    assert rows["y"].hi == 5.0 + 1e-12


def test_distances_of_listed_pairs(spark, make_points):
    pts = make_points([[0, 0, 0], [1, 2, 2], [0, 0, 7]])
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "a long, b long")
    got = {(r.a, r.b): r.distance for r in mesh.pairwise_distances(pairs, pts, ("x", "y", "z")).collect()}
    assert got == {(0, 1): 3.0, (0, 2): 7.0, (1, 1): 0.0}


def test_kernel_values(spark, make_points):
    pts = make_points([[0, 0], [3, 4]])
    pairs = spark.createDataFrame([(0, 1), (0, 0)], "a long, b long")
    got = {(r.a, r.b): (r.k00, r.k10) for r in mesh.kernel_of_pairs(pairs, pts, ("x", "y")).collect()}
    assert got[0, 1] == pytest.approx((0.054372490556417, 0.019184647676929), abs=1e-12)
    assert got[0, 0] == pytest.approx((1e6, 0.0))


@pytest.mark.parametrize("crowded", [5_000, 4])
def test_distance_join_against_brute_force(make_points, monkeypatch, crowded):
    monkeypatch.setattr(near, "CROWDED", crowded)
    rng = np.random.default_rng(0)
    base = rng.uniform(-2, 2, (60, 2))
    coords = np.vstack([base, np.repeat(base[:1], 30, axis=0)])
    got = near.distance_join(make_points(coords), ("x", "y"), 0.4).toPandas()
    dist = np.linalg.norm(base[:, None] - base[None], axis=2)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if dist[a, b] <= 0.4}
    assert {(r.a, r.b) for r in got.itertuples()} == want
    for r in got.itertuples():
        assert r.distance == pytest.approx(dist[r.a, r.b])
        assert (r.a_copies, r.b_copies) == (31 if r.a == 0 else 1, 1)
    with pytest.raises(ValueError):
        near.distance_join(make_points(coords), ("x", "y"), 0.0)


def test_epoch_seconds_ignores_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'1970-01-02 00:00:00.25' AS ts")
    assert df.select(points.epoch_seconds(df, "ts").alias("s")).first().s == 86400.25


def test_unit_scaled(make_points):
    out = points.unit_scaled(make_points([[1, 5], [3, 5], [2, 5]])).orderBy("id").collect()
    assert [(r.x, r.y) for r in out] == [(0.0, 0.0), (1.0, 0.0), (0.5, 0.0)]


def test_suggest_eta(spark):
    from gridweave.functions.geometry import suggest_eta

    row = spark.range(1).select(
        suggest_eta().alias("a"), suggest_eta(d=2).alias("b"), suggest_eta(gamma=0.0).alias("c"),
        suggest_eta(F.lit(-1.0)).alias("bad"),
    ).first()
    assert math.isclose(row.a, 0.3641588833612779) and math.isclose(row.b, 0.9) and row.c == 0.0 and row.bad is None
    for bad in ({"gamma": -1}, {"target": 0}, {"target": 1}, {"d": 4}):
        with pytest.raises(ValueError):
            suggest_eta(**bad)
