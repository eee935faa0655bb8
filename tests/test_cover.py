import itertools

import numpy as np
import pytest
from conftest import lattice

from gridweave import Grid
from gridweave.operators import boxes
from gridweave.plans import compress, cover


def clusters(d):
    rng = np.random.default_rng(d)
    return np.vstack([rng.uniform(0, 1, (25, d)), rng.normal(0.4, 0.01, (20, d)), np.full((5, d), 0.7)])


def held_pairs(blocks, pts, grid, finest):
    """How often each ordered pair of points is in a block."""
    cell = pts.select("id", *grid.cells(finest)).toPandas().sort_values("id")[list(grid.keys)].to_numpy()
    n = len(cell)
    out = np.zeros((n, n), int)
    for r in blocks:
        side = []
        for s in ("a", "b"):
            up = finest - r[f"{s}_depth"]
            side.append((cell >> up == [r[f"{s}_{k}"] for k in grid.keys]).all(axis=1))
        assert (r.n_a, r.n_b) == (side[0].sum(), side[1].sum())
        out += np.outer(side[0], side[1])
    return out


@pytest.mark.parametrize("d", [2, 3])
@pytest.mark.parametrize("m", [1, 4])
def test_uneven_lists_hold_every_pair_once(make_points, d, m):
    pts = make_points(clusters(d))
    grid = Grid.fit(pts, ("x", "y", "z")[:d])
    tree = boxes.adaptive_boxes(boxes.crowded_boxes(pts, grid, m, 3), grid, m, grid.finest)
    found = cover.pair_cover(tree, grid)
    rows = found.collect()
    assert (held_pairs(rows, pts, grid, grid.finest) == 1).all()
    assert cover.cover_audit(found, grid).first().complete
    assert {r.kind for r in rows} == {"near", "far", "coarse", "fine"}
    keyed = {tuple(r)[: 2 * d + 2] for r in rows}
    assert len(keyed) == len(rows)
    for r in rows:
        fine = max(r.a_depth, r.b_depth)
        gap = []
        for k in grid.keys:
            a, b = r[f"a_{k}"], r[f"b_{k}"]
            gap.append(max((b << fine - r.b_depth) - (a + 1 << fine - r.a_depth), (a << fine - r.a_depth) - (b + 1 << fine - r.b_depth)))
        assert (max(gap) > 0) == (r.kind != "near")
        assert r.kind != "far" or r.a_depth == r.b_depth
        assert r.kind != "coarse" or r.a_depth < r.b_depth


@pytest.mark.parametrize("eta", [0.3, 0.7, 1.9])
def test_metric_cover(make_points, eta):
    coords = np.vstack([lattice(8, 8), clusters(2) * 7])
    pts = make_points(coords)
    grid = Grid.fit(pts)
    depth = 4
    tree = cover.uniform_tree(boxes.boxes(pts, grid, depth), depth)
    found = cover.pair_cover(tree, grid, cover.metric_apart(eta))
    rows = found.collect()
    assert (held_pairs(rows, pts, grid, depth) == 1).all()
    wide = np.array(grid.width)

    def apart(level, a, b):
        gap = np.maximum(np.abs(np.subtract(a, b)) - 1, 0) * wide / 2**level
        return np.linalg.norm(gap) >= eta * np.linalg.norm(wide) / 2**level

    for r in rows:
        a, b = (np.array([r[f"{s}_{k}"] for k in grid.keys]) for s in ("a", "b"))
        assert r.a_depth == r.b_depth and apart(r.a_depth, a, b) == (r.kind == "far")
        assert r.a_depth == 0 or not apart(r.a_depth - 1, a >> 1, b >> 1)
        assert r.kind == "far" or r.a_depth == depth
    assert sum(r.n_blocks for r in cover.cover_census(found).collect()) == len(rows)


def test_metric_cover_equals_where_entries_are_located(spark, make_points, make_matrix):
    coords = lattice(8, 8)
    pts = make_points(coords)
    grid = Grid.fit(pts)
    for eta in (0.6, 1.1):
        held = compress.locate(make_matrix(np.ones((128, 64))), pts, grid, 3, eta)
        got = {(r.depth, r.a, r.b) for r in held.where("far").select("depth", "a", "b").distinct().collect()}
        tree = cover.uniform_tree(boxes.boxes(pts, grid, 3), 3)
        code = lambda r, s: r[f"{s}_ix"] * 2 ** r[f"{s}_depth"] + r[f"{s}_iy"]
        far = {(r.a_depth, code(r, "a"), code(r, "b")) for r in cover.pair_cover(tree, grid, cover.metric_apart(eta)).where("kind = 'far'").collect()}
        assert got == far
        assert held.count() == 128 * 64


def test_wider_separation_leaves_more_near_pairs(make_points):
    pts = make_points(lattice(16, 16))
    grid = Grid.fit(pts)
    tree = cover.uniform_tree(boxes.boxes(pts, grid, 4), 4)
    near = [cover.pair_cover(tree, grid, cover.metric_apart(eta)).where("kind = 'near'").count() for eta in (0.4, 0.9, 1.9)]
    assert near == sorted(near) and near[0] < near[2]
    with pytest.raises(ValueError):
        cover.metric_apart(0.0)
    with pytest.raises(ValueError):
        compress.separation_depth(grid, 3, eta=-1.0)


def test_single_box(make_points):
    pts = make_points(np.zeros((3, 2)))
    grid = Grid.fit(pts)
    tree = boxes.adaptive_boxes(boxes.crowded_boxes(pts, grid, 8, 0), grid, 8, grid.finest)
    rows = cover.pair_cover(tree, grid).collect()
    assert [(r.kind, r.n_a, r.n_b) for r in rows] == [("near", 3, 3)]


def test_param_sweep_over_eta(make_points, make_matrix):
    from conftest import dense_kernel

    coords = lattice(8, 8)
    pts = make_points(coords)
    grid = Grid.fit(pts)
    settings = [(4, 6, 2), (4, 6, 2, 0.6), (4, 6, 2, 1.6), (1, 2, 2, 0.6)]
    rows = compress.param_sweep(make_matrix(dense_kernel(coords)), pts, grid, settings, 5).collect()
    got = {(r.k, r.eta): r for r in rows}
    assert len(rows) == 4 and {r.depth for r in rows} == {3}
    assert all(got[4, e].far_rel_error < 0.02 for e in (None, 0.6, 1.6))
    assert got[4, 1.6].n_near > got[4, 0.6].n_near
    # Blocks further apart are smoother; a lower rank is worse.
    assert got[4, 1.6].far_rel_error < got[4, 0.6].far_rel_error < got[1, 0.6].far_rel_error
    assert list(itertools.chain(*[[r.p] for r in rows])) == [6, 6, 6, 2]


def test_boxes_are_not_broadcast(spark, make_points, capsys):
    """Every step joins the open pairs to the children of all boxes, which follow the points."""
    pts = make_points(np.random.default_rng(3).uniform(size=(200, 2)))
    grid = Grid.fit(pts)
    cover.pair_cover(cover.uniform_tree(boxes.boxes(pts, grid, 3), 3), grid)
    seen = []
    real = cover.cut_lineage
    cover.cut_lineage = lambda df: (df.explain(), seen.append(capsys.readouterr().out), real(df))[-1]
    try:
        cover.pair_cover(cover.uniform_tree(boxes.boxes(pts, grid, 3), 3), grid)
    finally:
        cover.cut_lineage = real
    steps = [plan for plan in seen if "kids" in plan and "Join" in plan]
    assert steps and not any("BroadcastHashJoin" in plan for plan in steps)


def test_pairs_are_split_and_written_one_way(make_points, monkeypatch):
    pts = make_points(clusters(2))
    grid = Grid.fit(pts)
    tree = boxes.adaptive_boxes(boxes.crowded_boxes(pts, grid, 4, 3), grid, 4, grid.finest)
    seen, real = [], cover.cut_lineage
    monkeypatch.setattr(cover, "cut_lineage", lambda df: seen.append(real(df)) or seen[-1])
    found = cover.pair_cover(tree, grid)
    ends = ("depth", *grid.keys)
    written = [
        tuple(tuple(r[f"{s}_{c}"] for c in ends) for s in ("a", "b"))
        for df in seen if "kind" in df.columns for r in df.where("kind IS NOT NULL").collect()
    ]
    assert written and len(set(written)) == len(written)
    assert not {(b, a) for a, b in written if a != b} & set(written)
    assert found.count() == sum(1 + (a != b) for a, b in written)
