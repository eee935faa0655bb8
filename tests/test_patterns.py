import numpy as np
import pytest
from conftest import dense_kernel, lattice
from pyspark.sql import functions as F

from gridweave import Grid
from gridweave.functions.gaussian import gaussian_array, sketch_width
from gridweave.operators import boxes, patterns
from gridweave.operators.scan import running_total


def test_running_total_over_small_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), int(k), int(v)) for g in range(3) for k, v in zip(rng.permutation(200)[:90], rng.integers(1, 9, 90))]
    df = spark.createDataFrame(rows, "g int, k long, v long")
    got = running_total(df, ["g"], "k", F.col("v"), "t", block_bits=3).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.t == sum(v for g, k, v in rows if g == r.g and k < r.k)


def test_gaussians_are_standard_and_reproducible(spark):
    df = spark.range(20000).select("id", gaussian_array(6, 5, "id").alias("g"))
    a = np.array(df.orderBy("id").toPandas().g.tolist())
    b = np.array(df.repartition(7).orderBy("id").toPandas().g.tolist())
    assert (a == b).all()
    assert np.abs(a.mean(axis=0)).max() < 0.03 and np.abs(a.std(axis=0) - 1).max() < 0.03
    assert np.abs(np.corrcoef(a.T) - np.eye(6)).max() < 0.03
    other = np.array(spark.range(20000).select(gaussian_array(6, 6, "id").alias("g")).toPandas().g.tolist())
    assert abs(np.corrcoef(a[:, 0], other[:, 0])[0, 1]) < 0.03
    assert spark.range(1).select(gaussian_array(0, 1, "id").alias("g")).first().g == []
    with pytest.raises(ValueError):
        gaussian_array(-1, 0, "id")
    for bad in ((-1, 0), (1, -1)):
        with pytest.raises(ValueError):
            sketch_width(*bad)


@pytest.mark.parametrize("shape", [(8, 8), (4, 4, 4)])
def test_sketch_has_each_column_once_per_depth(make_points, shape):
    pts = make_points(lattice(*shape))
    grid = Grid.fit(pts, ("x", "y", "z")[: len(shape)])
    got = patterns.admissible_sketch(pts, grid, 2, 3, 2, 1, 1).toPandas()
    for _, part in got.groupby("depth"):
        assert sorted(part.j) == list(range(grid.n * grid.dof_col))
    assert set(got.gs.map(len)) == {5} and got.pattern.max() < 6**grid.d
    one, two = (got[got.depth == k].sort_values("j").gs.map(lambda g: g[0]).to_numpy() for k in (1, 2))
    assert not np.allclose(one, two)


@pytest.mark.parametrize("shape", [(8, 8), (4, 4, 4)])
def test_probe_reads_neighbor_blocks(make_points, shape):
    coords = lattice(*shape)
    pts = make_points(coords)
    grid = Grid.fit(pts, ("x", "y", "z")[: len(shape)])
    a = dense_kernel(coords)
    probe = patterns.leaf_probe(pts, grid, 2).toPandas()
    assert sorted(probe.j) == list(range(a.shape[1]))
    for _, part in probe.groupby("pattern"):
        assert sorted(part.slot) == list(range(len(part)))
        omega = np.zeros((a.shape[1], len(part)))
        omega[part.j, part.slot] = 1.0
        assert np.allclose((a @ omega)[:, part.slot], a[:, part.j])
        runs = part.sort_values("slot").box.to_numpy()
        assert len(set(runs)) == 1 + (runs[1:] != runs[:-1]).sum()


def test_pattern_groups(make_points):
    pts = make_points(lattice(8, 8))
    grid = Grid.fit(pts)
    box = boxes.boxes(pts, grid, 3)
    got = patterns.pattern_groups(box, grid).where("depth = 3").toPandas()
    assert len(got) == 36 and got.n_boxes.sum() == 64 and got.n_cols.sum() == 64
    cells = patterns.pattern_cells(box, grid, patterns.LEAF_PERIOD).where("depth = 3").toPandas()
    assert (cells.pattern == (cells.ix % 3) * 3 + cells.iy % 3).all()


def test_draws_added_by_batches_are_those_of_the_expression(spark):
    from gridweave.functions.gaussian import with_normals

    rows = spark.range(500).selectExpr("if(id % 9 = 0, null, id * 31) AS j", "cast(id % 4 AS int) AS depth")
    both = with_normals(rows, 3, 7, ["depth", "j"], "gs").select("gs", gaussian_array(3, 7, "depth", "j").alias("want")).toPandas()
    assert len(both) == 500
    assert np.abs(np.stack(both.gs) - np.stack(both.want)).max() < 1e-14
    assert with_normals(rows, 0, 7, ["j"], "gs").first().gs == []
    with pytest.raises(ValueError):
        with_normals(rows, -1, 7, ["j"], "gs")
