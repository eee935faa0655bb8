import math

import numpy as np
import pytest
from conftest import lattice

from gridweave import Grid
from gridweave.operators import boxes

GOLDEN = {  # fixed values: boxes per depth of full lattices
    (8, 8): [1, 4, 16, 64],
    (4, 4, 4): [1, 8, 64],
    (8, 1): [1, 2, 4, 8],
}


def fit(points, d):
    return Grid.fit(points, ("x", "y", "z")[:d])


@pytest.mark.parametrize("shape", GOLDEN)
def test_box_counts(make_points, shape):
    pts = make_points(lattice(*shape))
    grid = fit(pts, len(shape))
    depth = len(GOLDEN[shape]) - 1
    prof = {r.depth: r for r in boxes.level_profile(boxes.boxes(pts, grid, depth)).collect()}
    assert [prof[k].n_boxes for k in range(depth + 1)] == GOLDEN[shape]
    assert all(r.n_points == math.prod(shape) for r in prof.values())


def recursive_collapsed(coords, lo, hi, m):
    """Bisect at midpoints, skipping cells with a single non-empty child: set of (ids, level, leaf)."""
    out = set()

    def visit(ids, lo, hi, level):
        if len(ids) >= max(m, 2):
            for _ in range(60):
                mid = (lo + hi) / 2
                side = coords[ids] >= mid
                kinds = {tuple(s) for s in side}
                if len(kinds) > 1:
                    out.add((frozenset(ids), level, False))
                    for kind in kinds:
                        mask = (side == kind).all(axis=1)
                        k = np.array(kind)
                        visit(ids[mask], np.where(k, mid, lo), np.where(k, hi, mid), level + 1)
                    return
                k = np.array(next(iter(kinds)))
                lo, hi = np.where(k, mid, lo), np.where(k, hi, mid)
        out.add((frozenset(ids), level, True))

    visit(np.arange(len(coords)), lo, hi, 0)
    return out


@pytest.mark.parametrize("kind,m", [("uniform", 2), ("uniform", 5), ("clusters", 2), ("coincident", 2), ("line", 1)])
def test_collapsed_tree_equals_recursion(make_points, kind, m):
    rng = np.random.default_rng(3)
    coords = {
        "uniform": rng.uniform(-1, 1, (40, 2)),
        "clusters": np.vstack([rng.normal(0, 1e-4, (15, 2)), rng.normal(1, 1e-4, (15, 2))]),
        "coincident": np.vstack([np.zeros((5, 2)), np.ones((4, 2))]),
        "line": np.column_stack([np.zeros(10), np.arange(10.0)]),
    }[kind]
    pts = make_points(coords)
    grid = fit(pts, 2)
    got = boxes.collapsed_boxes(boxes.boxes(pts, grid, grid.finest), grid, m).toPandas()
    want = recursive_collapsed(coords, np.array(grid.lo), np.array(grid.hi), m)
    cells = pts.select("id", *grid.cells(grid.finest)).toPandas().sort_values("id")
    found = set()
    for r in got.itertuples():
        up = grid.finest - r.depth
        inside = (cells.ix.to_numpy() >> up == r.ix) & (cells.iy.to_numpy() >> up == r.iy)
        found.add((frozenset(np.flatnonzero(inside)), r.level, r.is_leaf))
    assert found == want


def test_leaves_partition_points(make_points):
    rng = np.random.default_rng(5)
    coords = np.vstack([rng.uniform(-1, 1, (80, 3)), np.repeat([[0.3, 0.3, 0.3]], 40, axis=0)])
    pts = make_points(coords)
    grid = fit(pts, 3)
    box = boxes.boxes(pts, grid, 6)
    leaves = boxes.leaf_boxes(box, grid, 6, 6)
    got = boxes.leaf_membership(pts, leaves, grid, 6).toPandas()
    assert sorted(got.id) == list(range(len(coords)))
    sizes = got.groupby(["depth", "ix", "iy", "iz"]).size()
    table = leaves.toPandas().set_index(["depth", "ix", "iy", "iz"]).n
    assert sizes.sort_index().tolist() == table.sort_index().tolist()
    assert (table[table.index.get_level_values(0) < 6] < 6).all()


def test_leaf_membership_with_hot_cell(make_points, monkeypatch):
    from gridweave import skew

    coords = np.vstack([np.full((50, 2), 0.25), lattice(4, 4)])
    pts = make_points(coords)
    grid = fit(pts, 2)
    leaves = boxes.leaf_boxes(boxes.boxes(pts, grid, 4), grid, 3, 4)
    plain = {tuple(r) for r in boxes.leaf_membership(pts, leaves, grid, 4).collect()}
    monkeypatch.setattr(boxes, "hot_table", lambda t, k: skew.hot_table(t, k, 10))
    assert {tuple(r) for r in boxes.leaf_membership(pts, leaves, grid, 4).collect()} == plain
    assert len(plain) == 66


def test_m_is_checked(make_points):
    pts = make_points(lattice(2, 2))
    grid = fit(pts, 2)
    box = boxes.boxes(pts, grid, 2)
    for op in (lambda: boxes.adaptive_boxes(box, grid, 0, 2), lambda: boxes.collapsed_boxes(box, grid, 0)):
        with pytest.raises(ValueError):
            op()


def test_tight_bounds_of_corners(make_points):
    pts = make_points([[0, 0], [2, 0], [0, 1], [2, 1]])
    root = boxes.box_tight_bounds(pts, fit(pts, 2), 1).where("depth = 0").first()
    assert (root.x_mid, root.y_mid) == (1.0, 0.5) and math.isclose(root.diam, math.sqrt(5))


def test_geometry_tiles_domain(make_points):
    pts = make_points(lattice(4, 4))
    grid = fit(pts, 2)
    geo = boxes.box_geometry(boxes.boxes(pts, grid, 2), grid).where("depth = 2").toPandas()
    assert geo.x_lo.min() == grid.lo[0] and geo.x_hi.max() == pytest.approx(grid.hi[0])
    assert np.allclose(geo.x_hi - geo.x_lo, grid.width[0] / 4)


def test_zero_width_axis_at_large_magnitude(make_points):
    pts = make_points([[1e6, 0.0], [1e6, 1.0]])
    cells = pts.select(*fit(pts, 2).cells(3)).collect()
    assert sorted((r.ix, r.iy) for r in cells) == [(0, 0), (0, 7)]


def test_children_and_levels(make_points):
    pts = make_points(lattice(8, 8))
    grid = fit(pts, 2)
    box = boxes.boxes(pts, grid, 3)
    kids = boxes.box_children(box, grid).toPandas()
    assert len(kids) == 84 and (kids.groupby(["p_depth", "p_ix", "p_iy"]).n.sum() == kids.groupby(["p_depth", "p_ix", "p_iy"]).p_n.first()).all()
    assert boxes.boxes_at_depth(box, 2).count() == 16 and boxes.boxes_at_depth(box, 9).count() == 0


def test_finest_needed_ignores_copies(make_points):
    coords = np.vstack([lattice(4, 4), np.zeros((100, 2))])
    pts = make_points(coords)
    assert boxes.finest_needed(pts, fit(pts, 2), 1) == 2
    assert boxes.finest_needed(pts, fit(pts, 2), 16) == 0


def test_result_does_not_depend_on_partitioning(make_points):
    rng = np.random.default_rng(1)
    pts = make_points(rng.normal(size=(300, 2)))
    grid = fit(pts, 2)
    got = [{tuple(r) for r in boxes.boxes(pts.repartition(k), grid, 5).collect()} for k in (1, 3, 64)]
    assert got[0] == got[1] == got[2]


def test_crowded_cells_go_on_splitting(make_points):
    rng = np.random.default_rng(9)
    # A dense clump beside scattered points, and copies of one location.
    coords = np.concatenate([rng.random((60, 2)), 0.5 + 1e-4 * rng.random((200, 2)), np.full((9, 2), 0.25)])
    pts = make_points(coords)
    grid = Grid.fit(pts)
    leaves = boxes.leaf_boxes(boxes.crowded_boxes(pts, grid, 4, 2, 3), grid, 4, grid.finest).toPandas()
    assert leaves["n"].sum() == len(coords)
    assert (leaves.loc[leaves["depth"] < grid.finest, "n"] < 4).all()
    assert leaves.loc[leaves["depth"] == grid.finest, "n"].tolist() == [9]
    whole = boxes.leaf_boxes(boxes.boxes(pts, grid, grid.finest), grid, 4, grid.finest).toPandas()
    key = ["depth", "ix", "iy", "n"]
    assert sorted(map(tuple, leaves[key].to_numpy())) == sorted(map(tuple, whole[key].to_numpy()))
