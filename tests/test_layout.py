import numpy as np
import pandas as pd
import pytest
from conftest import to_vector
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.operators import blockfactor, layout, norms, products, scan, treeqr
from gridweave.skew import hot_table


def vector(spark, x, key):
    return spark.createDataFrame(pd.DataFrame({key: np.arange(len(x)), "x": x}))


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("hot", [None, 10])
def test_stored_products(spark, make_matrix, monkeypatch, no_broadcast, hot):
    if hot:
        monkeypatch.setattr(layout, "hot_table", lambda t, k: hot_table(t, k, hot))
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 17)) * (rng.uniform(size=(30, 17)) < 0.5)
    a[:, 3] = 1.0
    stored = layout.StoredMatrix.write(cut_lineage(make_matrix(a).where("v <> 0")))
    x, y = rng.normal(size=17), rng.normal(size=30)
    assert np.allclose(to_vector(stored.matvec(vector(spark, x, "j")), "i", 30), a @ x)
    assert np.allclose(to_vector(stored.rmatvec(vector(spark, y, "i")), "j", 17), a.T @ y)
    assert (stored.hot_j is None) == (hot is None)
    stored.forget()


@pytest.mark.parametrize("hot", [None, 8])
def test_no_exchange_between_matrix_and_join(spark, make_matrix, monkeypatch, no_broadcast, capsys, hot):
    if hot:
        monkeypatch.setattr(layout, "hot_table", lambda t, k: hot_table(t, k, hot))
    stored = layout.StoredMatrix.write(cut_lineage(make_matrix(np.ones((20, 9)))))
    for out in (stored.matvec(vector(spark, np.ones(9), "j")), stored.rmatvec(vector(spark, np.ones(20), "i"))):
        capsys.readouterr()
        out.explain()
        text = capsys.readouterr().out
        assert "Bucketed: true" in text
        # Between the scan of the matrix and the join above it no line is an exchange.
        lines = text.split("\n")
        at = next(k for k, line in enumerate(lines) if "Bucketed: true" in line)
        above = []
        for line in reversed(lines[:at]):
            above.append(line)
            if "Join" in line:
                break
        assert above and "Join" in above[-1] and not any("Exchange" in line for line in above)
    stored.forget()


def test_norm_does_not_depend_on_the_layout(spark, make_matrix, monkeypatch):
    a = np.random.default_rng(3).normal(size=(20, 10))
    matrix = make_matrix(a)
    plain = norms.spectral_norm(matrix, 12)
    monkeypatch.setattr(norms, "BROADCAST_DOUBLES", 5)
    assert norms.spectral_norm(matrix, 12) == pytest.approx(plain, rel=1e-12)
    assert plain == pytest.approx(np.linalg.norm(a, 2), rel=1e-2)
    b = a + 0.01 * np.random.default_rng(4).normal(size=a.shape)
    want = norms.relative_error(make_matrix(b), matrix, 30)
    assert want == pytest.approx(np.linalg.norm(b - a, 2) / np.linalg.norm(a, 2), rel=1e-2)
    assert norms.relative_error(matrix, matrix, 3) == 0.0


def test_r_factors(spark, monkeypatch):
    monkeypatch.setattr(treeqr, "HELD_NUMBERS", 60)
    rng = np.random.default_rng(6)
    blocks = {k: rng.normal(size=(n, 4)) for k, n in enumerate((1, 3, 4, 50, 200))}
    blocks[3] = blocks[3] @ np.diag(10.0 ** -np.arange(0, 16, 4)) @ np.linalg.qr(rng.normal(size=(4, 4)))[0]
    rows = [(k, [float(v) for v in r]) for k, b in blocks.items() for r in b] + [(None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "block int, v array<double>").repartition(9)
    for use in (4, 2):
        got = {r.block: r for r in treeqr.r_factors(df, ["block"], "v", 4, use).collect()}
        assert set(got) == {*blocks, None}
        for k, b in {**blocks, None: np.array([[1.0, 2.0, 3.0, 4.0]])}.items():
            r = np.reshape(got[k].r, (use, use))
            assert got[k].n_rows == len(b)
            assert np.allclose(r.T @ r, b[:, :use].T @ b[:, :use], atol=1e-12)
    sigma = {r.block: r.sigma for r in products.block_spectrum(df, "block", "v", 4).collect()}
    want = np.linalg.svd(blocks[3], compute_uv=False)
    assert want[-1] < 1e-10 * want[0]
    assert np.allclose(sigma[3], want, rtol=1e-3)  # far below the square root of rounding
    with pytest.raises(ValueError):
        treeqr.r_factors(df, ["block"], "v", 4, 5)


def test_orth_of_a_badly_scaled_block(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=(60, 4)) @ np.diag([1.0, 1e-4, 1e-8, 1e-11]) @ np.linalg.qr(rng.normal(size=(4, 4)))[0]
    df = spark.createDataFrame([(2, 0, 0, k, [float(v) for v in r]) for k, r in enumerate(y)], "depth int, a long, b long, i long, ys array<double>")
    basis = cut_lineage(blockfactor.block_orth(df, "i", 4, 4, "qr"))
    rep = blockfactor.orth_report(basis, 4).first()
    assert rep.k_eff == 4 and rep.orth_ok
    u = np.array(basis.orderBy("i").toPandas().us.tolist())
    left = np.linalg.svd(y, full_matrices=False)[0]
    assert np.linalg.norm(left - u @ (u.T @ left)) < 1e-4
    assert blockfactor.orth_report(blockfactor.block_orth(df, "i", 4, 4, "qr", rank_cut=1e-6), 4).first().k_eff == 2


@pytest.mark.parametrize("shares", [None, 5])
def test_running_total_over_sparse_keys(spark, shares):
    rng = np.random.default_rng(8)
    keys = np.sort(rng.choice(2**60, 900, replace=False))
    rows = [(int(g), int(k), int(v)) for k, v, g in zip(keys, rng.integers(0, 50, 900), rng.choice([0, 0, 0, 1], 900))]
    df = spark.createDataFrame(rows, "g int, k long, v long").repartition(6)
    got = {(r.g, r.k): r.t for r in scan.running_total(df, ["g"], "k", F.col("v"), "t", shares=shares).collect()}
    total = {0: 0, 1: 0}
    for g, k, v in rows:
        assert got[g, k] == total[g]
        total[g] += v
    assert len(got) == 900


def test_shares_are_even(spark, monkeypatch):
    """Keys spread over 2^60, nearly all of one group: no share holds much more than its part."""
    seen = []
    monkeypatch.setattr(scan, "cut_lineage", lambda df: seen.append(cut_lineage(df)) or seen[-1])
    df = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("g"), (F.abs(F.xxhash64("id")) % 2**60).alias("k"))
    scan.running_total(df, ["g"], "k", F.lit(1), "t", shares=8).count()
    sizes = [r["count"] for r in seen[0].groupBy("_share").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_vectors_of_a_step_are_bounded_together(spark, make_matrix, monkeypatch):
    """Rows and columns below the limit each, but not together, use the stored copies."""
    a = np.random.default_rng(5).normal(size=(7, 6))
    matrix = cut_lineage(make_matrix(a))
    made, real = [], norms.StoredMatrix.write
    monkeypatch.setattr(norms.StoredMatrix, "write", lambda *given: made.append(given) or real(*given))
    monkeypatch.setattr(norms, "BROADCAST_STEP", 13)
    norms.matrix_products(matrix)
    assert not made
    monkeypatch.setattr(norms, "BROADCAST_STEP", 12)
    forward, adjoint = norms.matrix_products(matrix)
    assert len(made) == 1
    x = spark.createDataFrame([(j, float(j)) for j in range(6)], "j long, x double")
    assert np.allclose(to_vector(forward(x), "i", 7), a @ np.arange(6.0))


@pytest.mark.parametrize("shape", [(6, 11), (11, 6)])
def test_packed_norms(spark, shape, monkeypatch):
    """Both norms in the same passes, packed by either side, with keys and values that are null and rows that repeat."""
    rng = np.random.default_rng(9)
    rows = [(int(i), int(j), float(rng.normal())) for i in range(shape[0]) for j in range(shape[1]) if rng.uniform() < 0.7]
    rows += [*rows[:4], (0, 0, None), (None, 1, 3.0), (1, None, 4.0)]
    matrix = cut_lineage(spark.createDataFrame(rows, "i long, j long, v double"))
    near = matrix.withColumn("v", F.floor("v").cast("double")).where("i IS NULL OR i <> 3")
    start = norms.start_vector(matrix.select("j").distinct())
    plain = norms.power_norm(*norms.matrix_products(matrix), start, 6)
    apart = cut_lineage(products.merged(products.difference(near, matrix)))
    want = norms.power_norm(*norms.matrix_products(apart), start, 6) / plain
    monkeypatch.setattr(norms, "power_norm", None)
    assert norms.spectral_norm(matrix, 6) == pytest.approx(plain, rel=1e-9)
    assert norms.relative_error(near, matrix, 6) == pytest.approx(want, rel=1e-9)
