import numpy as np
import pandas as pd
import pytest
from conftest import dense_kernel, lattice, to_vector

from gridweave import Grid
from gridweave.durable import cut_lineage
from gridweave.operators import boxes, pairs
from gridweave.plans import farfield


def cloud(d, n, seed=0):
    rng = np.random.default_rng(seed)
    pts = rng.uniform(0, 1, (n, d))
    pts[:3] = pts[5]  # copies of one location
    return pts


def setup(spark, make_points, coords, depth):
    pts = make_points(coords)
    d = coords.shape[1]
    grid = Grid.fit(pts, ("x", "y", "z")[:d])
    box = cut_lineage(boxes.boxes(pts, grid, depth))
    pr = cut_lineage(pairs.block_pairs(box, grid))
    x = np.random.default_rng(1).normal(size=len(coords) * (d - 1))
    return pts, grid, box, pr, x, spark.createDataFrame(pd.DataFrame({"j": np.arange(len(x)), "x": x}))


def test_polynomials():
    t = np.r_[-1.0, 1.0, farfield.nodes(5), 0.123]
    w = farfield.weights_at(5, t)
    assert np.allclose(w.sum(axis=1), 1) and np.allclose(w[2:7], np.eye(5))
    assert np.allclose(w @ farfield.nodes(5) ** 4, t**4)
    # A parent's polynomial is known at the nodes of a child.
    shift = farfield._shift(4, (1, 0))
    x, y = np.meshgrid(farfield.nodes(4), farfield.nodes(4), indexing="ij")
    assert np.allclose(shift @ (x**3 * y).ravel(), (((x + 1) / 2) ** 3 * (y - 1) / 2).ravel())


@pytest.mark.parametrize(("d", "n", "depth", "order", "bound"), [(2, 300, 3, 4, 3e-2), (2, 300, 3, 8, 3e-5), (2, 300, 4, 12, 3e-8), (3, 160, 2, 5, 3e-2)])
def test_fast_product(spark, make_points, d, n, depth, order, bound):
    coords = cloud(d, n)
    pts, grid, box, pr, x, vec = setup(spark, make_points, coords, depth)
    got = to_vector(farfield.kernel_matvec_fast(pts, grid, box, pr, depth, vec, order), "i", n * d)
    cell = pts.select("id", *grid.cells(depth)).toPandas().sort_values("id")[list(grid.keys)].to_numpy()
    touch = np.abs(cell[:, None] - cell[None]).max(axis=2) <= 1
    a = dense_kernel(coords)
    far = a * np.kron(~touch, np.ones((d, d - 1)))
    assert far.any()
    assert np.abs(got - a @ x).max() < bound * np.abs(far).sum(axis=1).max()


def test_far_field_alone(spark, make_points):
    """A lattice, whose points lie on cell edges, and a vector with missing columns."""
    coords = lattice(8, 8)
    pts, grid, box, pr, x, vec = setup(spark, make_points, coords, 3)
    got = {r["loc"]: r.ys for r in farfield.far_field(pts, grid, box, pr, 3, vec.where("j < 10"), 10).collect()}
    cell = pts.select("id", *grid.cells(3)).toPandas().sort_values("id")[list(grid.keys)].to_numpy()
    apart = np.kron(np.abs(cell[:, None] - cell[None]).max(axis=2) > 1, np.ones((2, 1)))
    want = ((dense_kernel(coords) * apart)[:, :10] @ x[:10]).reshape(-1, 2)
    assert np.abs(np.array([got[k] for k in range(64)]) - want).max() < 1e-7


def test_shallow_trees(spark, make_points):
    coords = cloud(2, 20)
    pts, grid, box, pr, x, vec = setup(spark, make_points, coords, 1)
    got = to_vector(farfield.kernel_matvec_fast(pts, grid, box, pr, 1, vec), "i", 40)
    assert np.allclose(got, dense_kernel(coords) @ x)
    with pytest.raises(ValueError):
        farfield.far_field(pts, grid, box, pr, 1, vec)
    with pytest.raises(ValueError):
        farfield.far_field(pts, grid, box, pr, 2, vec, 0)
