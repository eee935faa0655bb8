import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import dense_kernel, lattice, to_dense, to_vector
from pyspark.sql import functions as F

from gridweave import Grid
from gridweave.durable import cut_lineage
from gridweave.operators import blockfactor, boxes, factors, pairs, products
from gridweave.operators.norms import ratio
from gridweave.plans import compress
from gridweave.skew import hot_table

K, P = 4, 6


def sample_table(spark, blocks, name="i"):
    rows = [
        (2, int(a), 0, r, [float(v) for v in y[r]]) for a, y in blocks.items() for r in range(len(y))
    ]
    return spark.createDataFrame(rows, f"depth int, a long, b long, {name} long, ys array<double>")


def dense_blocks(df, key, name):
    pdf = df.toPandas()
    return {
        int(a): np.array(part.sort_values(key)[name].tolist()) for a, part in pdf.groupby("a")
    }


@pytest.mark.parametrize("method", ["qr", "svd"])
def test_block_orth(spark, method, monkeypatch):
    monkeypatch.setattr(blockfactor, "hot_table", lambda t, k: hot_table(t, k, 20))
    rng = np.random.default_rng(0)
    y = {
        0: rng.normal(size=(40, 6)),
        1: rng.normal(size=(30, 2)) @ rng.normal(size=(2, 6)),
        2: rng.normal(size=(1, 6)),
        3: rng.normal(size=(12, 6)) * 10.0 ** -np.arange(6),
        4: np.zeros((3, 6)),
    }
    basis = blockfactor.block_orth(sample_table(spark, y), "i", 6, 3, method)
    u = dense_blocks(basis, "i", "us")
    rep = {r.a: r for r in blockfactor.orth_report(basis, 3).collect()}
    assert {a: r.k_eff for a, r in rep.items()} == {0: 3, 1: 2, 2: 1, 3: 3, 4: 0}
    assert all(r.orth_ok and r.n_rows == len(y[a]) for a, r in rep.items())
    for a in (0, 3):
        want = y[a][:, :3] if method == "qr" else np.linalg.svd(y[a], full_matrices=False)[0][:, :3]
        q = np.linalg.qr(want)[0]
        assert np.linalg.norm(q - u[a] @ (u[a].T @ q)) < 1e-6
    assert np.allclose(y[1] - u[1] @ (u[1].T @ y[1]), 0, atol=1e-10)


def test_block_orth_checks_arguments(spark):
    t = sample_table(spark, {0: np.ones((2, 3))})
    for k, method in ((0, "qr"), (4, "qr"), (2, "lu")):
        with pytest.raises(ValueError):
            blockfactor.block_orth(t, "i", 3, k, method)


def gauss(spark, width, seed, depth, n, key):
    from gridweave.functions.gaussian import gaussian_array

    df = spark.range(n).selectExpr(f"id as {key}", f"{depth} as depth")
    return np.array(df.select(key, gaussian_array(width, seed, "depth", key).alias("g")).orderBy(key).toPandas().g.tolist())


def test_exact_rank_block_is_rebuilt(spark):
    rng = np.random.default_rng(1)
    u0, v0 = np.linalg.qr(rng.normal(size=(8, 3)))[0], np.linalg.qr(rng.normal(size=(5, 3)))[0]
    block = u0 @ np.diag([1, 2 / 3, 1 / 3]) @ v0.T
    width = 3 + 4
    gb, ga = gauss(spark, width, compress.COL_SEED, 2, 5, "j"), gauss(spark, width, compress.ROW_SEED, 2, 8, "i")
    f = compress.factor_blocks(
        sample_table(spark, {0: block @ gb}), sample_table(spark, {0: block.T @ ga}, "j"), 3, 4
    )
    u, v = dense_blocks(f.u, "i", "us")[0], dense_blocks(f.v, "j", "vs")[0]
    core = np.array(f.core.first().core).reshape(3, 3)
    assert np.abs(u @ core @ v.T - block).max() < 1e-8


@pytest.fixture(scope="module")
def mesh8(spark, make_points, make_matrix):
    coords = lattice(8, 8)
    pts = make_points(coords)
    grid = Grid.fit(pts)
    a = dense_kernel(coords)
    matrix = cut_lineage(make_matrix(a))
    pr = cut_lineage(pairs.block_pairs(boxes.boxes(pts, grid, 3), grid))
    held = cut_lineage(compress.locate(matrix, pts, grid, 3))
    return pts, grid, a, matrix, pr, held


@pytest.fixture(scope="module")
def entry_factors(mesh8):
    return compress.compress_entries(mesh8[-1], K, P)


def assemble(f, shape):
    """The matrix the factors stand for."""
    u, core, v = f.u.toPandas(), f.core.toPandas(), f.v.toPandas()
    block = ["depth", "a", "b"]
    left, right = dict(list(u.groupby(block))), dict(list(v.groupby(block)))
    out = np.zeros(shape)
    for r in core.itertuples():
        key = (r.depth, r.a, r.b)
        p, q = left[key], right[key]
        out[np.ix_(p.i, q.j)] += np.array(p.us.tolist()) @ np.reshape(r.core, (f.k, f.k)) @ np.array(q.vs.tolist()).T
    return out


def test_entries_find_their_block(mesh8):
    pts, grid, a, _, pr, held = mesh8
    got = held.toPandas()
    assert len(got) == a.size
    cell = pts.select("id", *grid.cells(3)).toPandas().sort_values("id")[["ix", "iy"]].to_numpy()
    for r in got.sample(300, random_state=0).itertuples():
        p, q = cell[r.i // 2] >> (3 - r.depth), cell[r.j] >> (3 - r.depth)
        side = 1 << r.depth
        assert (r.a, r.b) == (p[0] * side + p[1], q[0] * side + q[1])
        assert (np.abs(p - q).max() > 1) == r.far
        assert not r.far or np.abs((p >> 1) - (q >> 1)).max() <= 1
        assert r.far or r.depth == 3
    near = to_dense(compress.leaf_blocks(held), a.shape)
    assert np.array_equal(near[near != 0], a[near != 0])


def test_entry_compression(spark, mesh8, entry_factors):
    pts, grid, a, _, _, held = mesh8
    approx = assemble(entry_factors.factors, a.shape)
    near = to_dense(entry_factors.near, a.shape)
    far = a - near
    assert ratio(np.linalg.norm(far - approx, 2), np.linalg.norm(far, 2)) < 0.02
    x, y = np.random.default_rng(0).normal(size=a.shape[1]), np.random.default_rng(1).normal(size=a.shape[0])
    vx = spark.createDataFrame(pd.DataFrame({"j": np.arange(len(x)), "x": x}))
    vy = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(y)), "x": y}))
    f = entry_factors.factors
    assert np.allclose(to_vector(factors.apply_truncated(f, vx), "i", len(y)), approx @ x)
    assert np.allclose(to_vector(factors.apply_truncated_t(f, vy), "j", len(x)), approx.T @ y)
    assert np.allclose(to_vector(compress.hier_matvec(entry_factors, vx), "i", len(y)), (near + approx) @ x)
    assert np.allclose(to_vector(compress.hier_rmatvec(entry_factors, vy), "j", len(x)), (near + approx).T @ y)
    matrix = held.select("i", "j", "v")
    assert np.allclose(to_vector(factors.peeled_matvec(matrix, vx, f), "i", len(y)), (a - approx) @ x)
    assert np.allclose(to_vector(factors.peeled_rmatvec(matrix, vy, f), "j", len(x)), (a - approx).T @ y)
    raw = to_vector(factors.peeled_matvec(matrix, vx, None), "i", len(y))
    assert np.allclose(raw, a @ x)


def test_hot_blocks_change_nothing(spark, mesh8, entry_factors):
    _, _, a, _, _, _ = mesh8
    f = entry_factors.factors
    block = list(blockfactor.BLOCK)
    hot = factors.Factors(f.u, f.core, f.v, f.k, hot_table(f.u, block, 5), hot_table(f.v, block, 3))
    vx = spark.range(a.shape[1]).selectExpr("id as j", "1 / (1 + id) as x")
    vy = spark.range(a.shape[0]).selectExpr("id as i", "1 / (1 + id) as x")
    for op, vec, key, n in ((factors.apply_truncated, vx, "i", a.shape[0]), (factors.apply_truncated_t, vy, "j", a.shape[1])):
        assert np.allclose(to_vector(op(hot, vec), key, n), to_vector(op(f, vec), key, n), atol=1e-12)
    assert f.above(3).u.where("depth >= 3").count() == 0


def test_report(mesh8, entry_factors):
    _, grid, a, _, _, held = mesh8
    row = compress.compression_report(held, entry_factors, grid, 4).first()
    assert 0 < row.rel_error < row.far_rel_error < 0.02
    assert row.n_near == held.where("not far").count() and row.n_full == a.size
    assert row.n_core == entry_factors.factors.core.count() * K * K


def test_black_box_compression(mesh8):
    pts, grid, a, matrix, pr, held = mesh8
    f = compress.compress_black_box(matrix, pts, grid, pr, 3, K, P)
    near = to_dense(compress.leaf_blocks(held), a.shape)
    far = a - near
    assert ratio(np.linalg.norm(far - assemble(f, a.shape), 2), np.linalg.norm(far, 2)) < 0.02


def test_column_bases_of_level_two(mesh8):
    """Coarsest level, black-box sample against the true blocks."""
    pts, grid, a, matrix, pr, held = mesh8
    y = compress.level_sample(matrix, pts, grid, 2, 6 + 8)
    basis = compress.column_bases(compress.block_samples(y, pr, pts, grid, 2), 6, 8, "qr").toPandas()
    cells = pts.select("id", *grid.cells(2)).toPandas()
    cells["box"] = cells.ix * 4 + cells.iy
    assert basis.groupby(["a", "b"]).ngroups == 156
    for (p, q), part in basis.groupby(["a", "b"]):
        part = part.sort_values("i")
        u = np.array(part.us.tolist())
        cols = np.sort(cells.id[cells.box == q].to_numpy())
        block = a[np.ix_(part.i, cols)]
        live = int(part.k_eff.iloc[0])
        assert np.abs(u.T @ u - np.diag([1.0] * live + [0.0] * (6 - live))).max() < 1e-10
        assert np.linalg.norm(block - u @ (u.T @ block)) < 1e-2 * np.linalg.norm(block)


@pytest.mark.parametrize("shape,depth", [((8, 8), 3), ((4, 4, 4), 2)])
def test_kernel_compression(make_points, shape, depth):
    coords = lattice(*shape)
    coords = np.vstack([coords, coords[:3]])
    pts = make_points(coords)
    grid = Grid.fit(pts, ("x", "y", "z")[: len(shape)])
    pr = cut_lineage(pairs.block_pairs(boxes.boxes(pts, grid, depth), grid))
    f = compress.compress_kernel(pts, grid, pr, depth, K, P)
    a = dense_kernel(coords)
    approx = assemble(f, a.shape)
    cell = pts.select("id", *grid.cells(depth)).toPandas().sort_values("id")[list(grid.keys)].to_numpy()
    apart = np.abs(cell[:, None] - cell[None]).max(axis=2) > 1
    mask = np.kron(apart, np.ones((grid.dof_row, grid.dof_col)))
    far = a * mask
    assert not (approx * (1 - mask)).any()
    assert ratio(np.linalg.norm(far - approx, 2), np.linalg.norm(far, 2)) < 0.05


def test_no_far_blocks(make_points, make_matrix):
    coords = lattice(2, 2)
    pts = make_points(coords)
    grid = Grid.fit(pts)
    held = cut_lineage(compress.locate(make_matrix(dense_kernel(coords)), pts, grid, 1))
    assert held.where("far").count() == 0
    assert compress.compress_entries(held, 1, 1).factors.core.count() == 0
    with pytest.raises(ValueError):
        compress.compress_black_box(make_matrix(dense_kernel(coords)), pts, grid, pairs.block_pairs(boxes.boxes(pts, grid, 1), grid), 1, 1, 1)


@pytest.mark.parametrize("limit", [0, factors.BROADCAST_BLOCKS])
def test_sides_that_follow_the_input_are_not_broadcast(spark, monkeypatch, capsys, limit):
    """Tables of a few bytes a row, whose files are far below Spark's limit for a broadcast."""
    monkeypatch.setattr(factors, "BROADCAST_BLOCKS", limit)
    keys = spark.range(2000).select(F.lit(2).alias("depth"), (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"), "id")
    one = F.array(F.lit(1.0))
    fac = factors.Factors.write(
        keys.select("depth", "a", "b", F.col("id").alias("i"), one.alias("us")),
        keys.select("depth", "a", "b").distinct().select("depth", "a", "b", one.alias("core")),
        keys.select("depth", "a", "b", F.col("id").alias("j"), one.alias("vs")),
        1,
    )
    vec = cut_lineage(spark.range(2000).select(F.col("id").alias("j"), F.lit(1.0).alias("x")))
    back = vec.withColumnRenamed("j", "i")
    matrix = cut_lineage(keys.select(F.col("a").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")))
    made = (
        factors.apply_truncated(fac, vec), factors.apply_truncated_t(fac, back),
        factors.peeled_matvec(matrix, vec, fac), factors.peeled_rmatvec(matrix, back, fac),
    )
    for at, out in enumerate(made):
        out.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "BuildLeft" not in plan, plan
        # The thin vector of the plain product may be: its size is not far from that of its files.
        assert limit or plan.count("BroadcastHashJoin") == (at > 1), plan


def test_packed_vectors_meet_their_rows_at_once(spark, monkeypatch):
    """The same parts as by a join per vector, also with nulls and salts, from one row per box, row and vector."""
    rng = np.random.default_rng(5)
    k, width = 2, 3
    numbers = lambda n: [float(x) for x in rng.standard_normal(n)]
    blocks = [(2, a, b) for a in range(2) for b in range(4)] + [(3, 7, 1)]
    u = spark.createDataFrame([(*at, i, numbers(k)) for at in blocks for i in range(3 * at[1], 3 * at[1] + 5)] + [(2, 0, 0, 90, [None, None]), (2, 9, 9, 91, [1.0, 1.0])], "depth int, a long, b long, i long, us array<double>")
    v = spark.createDataFrame([(*at, 10 * at[2] + j, numbers(k)) for at in blocks for j in range(3)], "depth int, a long, b long, j long, vs array<double>")
    core = spark.createDataFrame([(*at, numbers(k * k)) for at in blocks], "depth int, a long, b long, core array<double>")
    vec = spark.createDataFrame([(j % 4, j % 2, j, numbers(width)) for j in range(34)], "pattern int, chunk int, j long, xs array<double>")
    fac = factors.Factors(u, core, v, k)

    def rows(df, by):
        return {tuple(r[c] for c in (*by, "i")): r.ys for r in df.collect()}

    for hot in (1 << 40, 4):
        monkeypatch.setattr(factors, "hot_table", lambda t, keys, n=hot: hot_table(t, keys, n))
        monkeypatch.setattr(factors, "HELD_NUMBERS", hot)
        for by in (["pattern"], ["pattern", "chunk"]):
            want = rows(factors.apply_truncated_thick(fac, vec, width, by), by)
            got = rows(factors.apply_truncated_thick(fac, vec, width, by, packed=["pattern"]), by)
            assert got.keys() == want.keys() and any(key[-1] == 90 for key in got)
            for key, ys in want.items():
                assert got[key] == ys if None in ys else np.allclose(got[key], ys, atol=1e-12)
    parts = []
    inner = factors._by_row_box
    monkeypatch.setattr(factors, "hot_table", lambda t, keys: None)
    monkeypatch.setattr(factors, "HELD_NUMBERS", 1 << 40)
    monkeypatch.setattr(factors, "_by_row_box", lambda *a: parts.append(inner(*a)) or parts[-1])
    factors.apply_truncated_thick(fac, vec, width, ["pattern"], packed=["pattern"])
    # Box 0 has five rows and the one of nulls, box 1 five, box 7 five; a join would make a row per block too.
    assert parts[0].count() <= (6 + 5 + 5) * 4


def test_a_vector_that_follows_the_input_is_not_broadcast(spark):
    matrix = cut_lineage(spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "i long, j long, v double"))
    for made, key, want in ((factors.peeled_matvec, "j", {0: 3.0, 1: 6.0}), (factors.peeled_rmatvec, "i", {0: 3.0})):
        vec = cut_lineage(spark.createDataFrame([(0, 3.0)], f"{key} long, x double"))
        out = made(matrix, vec, None, follows_input=True)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r[0]: r[1] for r in out.collect()} == want


def test_products_of_arrays_keep_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1.0, 0.0, 0.0, 1.0]), (2, [1.0, None], [1.0, 0.0, 0.0, 1.0]), (3, None, [1.0] * 4), (None, [3.0, 4.0, 9.0], [0.0, 2.0, 1.0, 0.0])], "id long, x array<double>, t array<double>")
    # One row's products are not one long expression.
    out = blockfactor._times(df, "x", "t", 2, 2, "y")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.x, r.y) for r in out.collect()} == {1: ([1.0, 2.0], [1.0, 2.0]), 2: ([1.0, None], [None, None]), 3: (None, [None, None]), None: ([3.0, 4.0, 9.0], [4.0, 6.0])}


def test_draws_of_a_batch_are_those_of_the_expression(spark):
    from gridweave.functions.gaussian import gaussian_array, normals

    rows = spark.range(3000).selectExpr("if(id % 7 = 0, null, id * id * 977) AS a", "cast(id % 3 AS int) AS b")
    for width in (1, 3, 8):
        got = rows.select("a", "b", gaussian_array(width, 11, "b", "a").alias("g")).toArrow().combine_chunks()
        assert np.abs(normals(width, 11, got["b"].chunk(0), got["a"].chunk(0)) - np.array(got["g"].to_pylist())).max() < 1e-14
    # Texts beyond one block of the hash.
    long = pa.array([2**62 + x for x in range(5)])
    want = spark.range(5).select(gaussian_array(2, 11, *["id + 4611686018427387904"] * 4).alias("g")).collect()
    assert np.abs(normals(2, 11, *[long] * 4) - np.array([r.g for r in want])).max() < 1e-14


def test_block_sums_skip_single_nulls_and_send_full_tables_on(spark, monkeypatch):
    monkeypatch.setattr(blockfactor, "HELD_SUMS", 30)
    rng = np.random.default_rng(3)
    rows = [(None if b == 4 else int(b), [None if rng.random() < 0.1 else float(x) for x in rng.integers(-5, 6, 2)]) for b in rng.integers(0, 25, 900)]
    rows += [(7, None), (99, [None, 2.0]), (99, [None, 3.0])]
    df = spark.createDataFrame(rows, "b long, ys array<double>").repartition(3)
    got = {r.b: (r.n_rows, r.gram) for r in blockfactor.gram_table(df, ["b"], 2, "ys").collect()}
    assert set(got) == {b for b, _ in rows}
    for key, (n, gram) in got.items():
        mine = [ys or [None, None] for b, ys in rows if b == key]
        assert n == len(mine)
        for cell, (p, q) in zip(gram, [(0, 0), (0, 1), (1, 1)], strict=True):
            met = [ys[p] * ys[q] for ys in mine if ys[p] is not None and ys[q] is not None]
            assert cell == (sum(met) if met else None)


def test_dealt_factors_give_the_same_products_without_shuffling_rows(spark):
    rng = np.random.default_rng(5)
    blocks = [(2, a, b) for a in range(4) for b in range(3)]
    u = spark.createDataFrame([(*k, int(i), rng.random(2).tolist()) for k in blocks for i in range(k[1] * 5, k[1] * 5 + 5)], "depth int, a long, b long, i long, us array<double>")
    v = spark.createDataFrame([(*k, int(j), rng.random(2).tolist()) for k in blocks for j in range(k[2] * 6, k[2] * 6 + 6)], "depth int, a long, b long, j long, vs array<double>")
    core = spark.createDataFrame([(*k, rng.random(4).tolist()) for k in blocks], "depth int, a long, b long, core array<double>")
    plain = factors.Factors.write(u, core, v, 2)
    x = spark.range(18).selectExpr("id AS j", "1 / (1 + id) AS x")
    y = spark.range(20).selectExpr("id AS i", "1 / (1 + id) AS x")
    with plain.dealt_out() as dealt:
        for product, vec in ((factors.apply_truncated, x), (factors.apply_truncated_t, y)):
            want = {r[0]: r[1] for r in product(plain, vec).collect()}
            for rows in (None, 20):
                got = {r[0]: r[1] for r in product(dealt, vec, rows).collect()}
                assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
            plan = product(dealt, vec)._jdf.queryExecution().sparkPlan().toString()
            assert "ShuffledHashJoin" in plan
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            plan = product(dealt, vec)._jdf.queryExecution().executedPlan().toString()
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            # The vector and the sums of the blocks; neither table of rows.
            assert plan.count("Exchange hashpartitioning") == 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gridweave_")]
