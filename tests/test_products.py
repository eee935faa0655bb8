import numpy as np
import pandas as pd
import pytest
from conftest import dense_kernel, lattice, to_dense, to_vector
from pyspark.sql import functions as F

from gridweave import Grid, catalog
from gridweave.operators import boxes, near, norms, pairs, products
from gridweave.skew import hot_keys, hot_table, skew_join
from gridweave.sources import matrices


def vector(spark, x, key="j"):
    return spark.createDataFrame(pd.DataFrame({key: np.arange(len(x)), "x": x}))


def thick(spark, xs, key="j"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(xs)], f"{key} long, xs array<double>")


@pytest.mark.parametrize("shape", [(6, 6), (8, 4), (9, 6)])
def test_products_equal_dense(spark, make_matrix, shape):
    rng = np.random.default_rng(shape[0])
    a, b = rng.normal(size=shape), rng.normal(size=shape)
    m, n = shape
    x, y = rng.normal(size=n), rng.normal(size=m)
    xs, ys = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
    ma, mb = make_matrix(a), make_matrix(b)
    assert np.allclose(to_vector(products.matvec(ma, vector(spark, x)), "i", m), a @ x)
    assert np.allclose(to_vector(products.matvec(ma, vector(spark, x), n), "i", m), a @ x)
    assert np.allclose(to_vector(products.rmatvec(ma, vector(spark, y, "i")), "j", n), a.T @ y)
    got = products.matvec_thick(ma, thick(spark, xs), 3).orderBy("i").toPandas()
    assert np.allclose(np.array(got.ys.tolist()), a @ xs)
    got = products.rmatvec_thick(ma, thick(spark, ys, "i"), 3).orderBy("j").toPandas()
    assert np.allclose(np.array(got.ys.tolist()), a.T @ ys)
    diff = products.difference(mb, ma)
    assert np.allclose(to_vector(products.matvec(diff, vector(spark, x)), "i", m), (b - a) @ x)
    rows = spark.createDataFrame([(1,), (3,)], "i long")
    cols = spark.createDataFrame([(0,), (2,)], "j long")
    want = np.zeros(shape)
    want[np.ix_([1, 3], [0, 2])] = a[np.ix_([1, 3], [0, 2])]
    assert np.array_equal(to_dense(products.matrix_block(ma, rows, cols), shape), want)


def test_empty_rows_are_zero(spark):
    m = spark.createDataFrame([(0, 0, 2.0)], "i long, j long, v double")
    y = products.with_zero_rows(products.matvec(m, vector(spark, [3.0])), spark.range(3).withColumnRenamed("id", "i"))
    assert sorted((r.i, r.y) for r in y.collect()) == [(0, 6.0), (1, 0.0), (2, 0.0)]


def test_sources(spark):
    t = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (0, 1, 5)], "a int, b int, c int")
    assert sorted(map(tuple, matrices.matrix_from_table(t, "a", "b", "c").collect())) == [(0, 1, 5.0), (1, 2, 7.0)]
    t = spark.createDataFrame([(4, [1.5, 2.5])], "id long, e array<float>")
    assert sorted(map(tuple, matrices.matrix_from_arrays(t, "id", "e").collect())) == [(4, 0, 1.5), (4, 1, 2.5)]


def test_skew_join_equals_plain_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = hot_keys(big, ["k"], 100)
    assert {(r.k, r._salts) for r in hot.collect()} == {(7, 11)}
    assert hot_table(big, ["k"]) is None
    got = skew_join(big, small, ["k"], ["id"], hot_table(big, ["k"], 100))
    want = big.join(small, "k")
    assert sorted(map(tuple, got.select("k", "id", "w").collect())) == sorted(map(tuple, want.select("k", "id", "w").collect()))


def test_every_hot_key_is_split(spark, monkeypatch):
    from gridweave import skew

    # More hot keys than any fixed list would hold, joined and not broadcast.
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 10)
    big = spark.range(9000).select((F.col("id") % 1500).alias("k"), "id")
    small = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = hot_table(big, ["k"], 4)
    assert {r._salts for r in hot.collect()} == {2} and hot.count() == 1500
    got = skew_join(big, small, ["k"], ["id"], hot).select("k", "id", "w")
    assert sorted(map(tuple, got.collect())) == [(i % 1500, i, i % 1500 * 2) for i in sorted(range(9000), key=lambda i: (i % 1500, i))]


def test_hot_column_product(spark, make_matrix):
    rng = np.random.default_rng(0)
    a = np.where(rng.random((60, 8)) < 0.2, rng.normal(size=(60, 8)), 0)
    a[:, 3] = 1.0
    m = make_matrix(a).where("v <> 0")
    x = rng.normal(size=8)
    got = products.matvec(m, vector(spark, x), hot=hot_table(m, ["j"], 10))
    assert np.allclose(to_vector(got, "i", 60), a @ x)


def test_block_spectrum_of_kernel_blocks(spark):
    near_pts = lattice(4, 4)
    both = np.vstack([near_pts, near_pts + 100.0])
    k = dense_kernel(both)
    rows = [("far", [float(v) for v in r]) for r in k[:32, 16:]] + [("near", [float(v) for v in r]) for r in k[:32, :16]]
    got = {r.block: r for r in products.block_spectrum(
        spark.createDataFrame(rows, "block string, row array<double>").repartition(5), "block", "row", 16).collect()}
    assert got["far"].n_rows == 32
    assert np.allclose(got["near"].sigma, np.linalg.svd(k[:32, :16], compute_uv=False))
    assert got["far"].sigma[-1] / got["far"].sigma[0] < 1e-6
    assert got["near"].sigma[-1] / got["near"].sigma[0] > 1e-3


def test_norms(spark, make_matrix):
    diag = make_matrix(np.diag([1.0, 2.0, 3.0, 10.0]))
    assert norms.spectral_norm(diag, 8) == pytest.approx(10, rel=1e-6)
    zero = make_matrix(np.zeros((4, 4)))
    assert norms.spectral_norm(zero, 2) == 0.0
    assert norms.relative_error(zero, zero, 2) == 0.0
    assert norms.relative_error(diag, zero, 2) == float("inf")
    assert norms.relative_error(diag, diag, 2) == 0.0
    assert norms.relative_error(make_matrix(1.1 * np.diag([1.0, 2.0, 3.0, 10.0])), diag, 6) == pytest.approx(0.1, rel=1e-2)
    with pytest.raises(ValueError):
        norms.spectral_norm(diag, 0)


def test_norm_of_rectangular_matrix(spark, make_matrix):
    a = np.random.default_rng(4).normal(size=(20, 10))
    a[:, 0] *= 3
    assert norms.spectral_norm(make_matrix(a), 15) == pytest.approx(np.linalg.norm(a, 2), rel=1e-3)


def test_kernel_entries_and_product(spark, make_points, monkeypatch):
    monkeypatch.setattr(near, "TILE", 3)
    rng = np.random.default_rng(2)
    base = rng.uniform(0, 1, (24, 2))
    coords = np.vstack([base, np.repeat(base[:1], 9, axis=0), base[1:3]])
    pts = make_points(coords)
    grid = Grid.fit(pts)
    a = dense_kernel(coords, 1e-2)
    x = rng.normal(size=len(coords))
    pr = pairs.block_pairs(boxes.boxes(pts, grid, 3), grid)
    y = near.kernel_matvec(pts, grid, pr, 3, vector(spark, x), 1e-2)
    assert np.allclose(to_vector(y, "i", len(a)), a @ x, rtol=1e-9)
    got = near.kernel_entries(pts, grid, 3, 1e-2).toPandas()
    cells = pts.select("id", *grid.cells(3)).toPandas().sort_values("id")[["ix", "iy"]].to_numpy()
    want = {(p, q) for p in range(24) for q in range(24) if np.abs(cells[p] - cells[q]).max() <= 1}
    assert {(r.a, r.b) for r in got.itertuples()} == want and len(got) == len(want)
    for r in got.itertuples():
        assert (r.k00, r.k10) == pytest.approx((a[2 * r.a, r.b], a[2 * r.a + 1, r.b]))
    assert got[got.a == 0].a_copies.unique().tolist() == [10]


def test_kernel_product_in_3d(spark, make_points):
    coords = np.random.default_rng(6).uniform(0, 1, (40, 3))
    pts = make_points(coords)
    grid = Grid.fit(pts, ("x", "y", "z"))
    x = np.random.default_rng(7).normal(size=80)
    pr = pairs.block_pairs(boxes.boxes(pts, grid, 2), grid)
    y = near.kernel_matvec(pts, grid, pr, 2, vector(spark, x))
    assert np.allclose(to_vector(y, "i", 120), dense_kernel(coords) @ x)


def test_difference_queries_read_a_stored_matrix(spark, tmp_path, monkeypatch):
    """Both sides of the difference read the summed entries, which are made once."""
    lines = [(p, s, float(10 * p + s), 1) for p in range(1, 6) for s in range(1, 4)] * 2
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 6).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 4).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    seen, real = [], products.difference
    monkeypatch.setattr(products, "difference", lambda approx, matrix: (seen.extend((approx, matrix)), real(approx, matrix))[-1])
    y = catalog.difference_matvec(spark, str(tmp_path)).collect()
    z = catalog.difference_rmatvec(spark, str(tmp_path)).collect()
    assert len(seen) == 4 and not any("Aggregate" in df._jdf.queryExecution().toString() for df in seen)
    off = {(s, p): (20 * p + 2 * s) // 10 * 10 - (20 * p + 2 * s) for p in range(1, 6) for s in range(1, 4)}
    assert {r.i: r.y for r in y} == {s: pytest.approx(sum(off[s, p] / (1 + p) for p in range(1, 6)), abs=1e-6) for s in range(1, 4)}
    assert {r.j: r.y for r in z} == {p: pytest.approx(sum(off[s, p] / (1 + s) for s in range(1, 4)), abs=1e-6) for p in range(1, 6)}


def test_tile_pairs_keep_their_partitions(spark, make_points):
    """Few bytes, much work: adaptive execution would put all tile pairs into one task."""
    pts = make_points(lattice(8, 8))
    grid = Grid.fit(pts)
    pr = near.covering(pairs.block_pairs(boxes.boxes(pts, grid, 2), grid), 2)
    places = near.at_depths(near.weights_by_location(pts, grid, vector(spark, np.ones(64))), 2)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        assert near.tile_pairs(pr, near.tiles(places, grid, 2, ["ws"]), grid).rdd.getNumPartitions() == 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
