import itertools

import numpy as np
import pytest
from conftest import lattice
from pyspark.sql import functions as F

from gridweave import Grid
from gridweave.functions.geometry import box_gap, boxes_adjacent, cells_adjacent
from gridweave.operators import boxes, pairs, patterns

GOLDEN = {  # fixed values: (neighbor, interaction) pairs per depth
    (8, 8): [(1, 0), (16, 0), (100, 156), (484, 1116)],
    (4, 4, 4): [(1, 0), (64, 0), (1000, 3096)],
    (8, 1): [(1, 0), (4, 0), (10, 6), (22, 18)],
}


def build(make_points, coords, depth):
    coords = np.asarray(coords, dtype=float)
    pts = make_points(coords)
    grid = Grid.fit(pts, ("x", "y", "z")[: coords.shape[1]])
    box = boxes.boxes(pts, grid, depth)
    return pts, grid, box, pairs.block_pairs(box, grid)


@pytest.mark.parametrize("shape", GOLDEN)
def test_census(make_points, shape):
    want = GOLDEN[shape]
    _, _, box, pr = build(make_points, lattice(*shape), len(want) - 1)
    got = {r.depth: (r.nei, r.int, r.absent, r.n_boxes) for r in pairs.block_census(box, pr).collect()}
    for k, (nei, inter) in enumerate(want):
        assert got[k][:2] == (nei, inter) and sum(got[k][:3]) == got[k][3] ** 2


def brute(box, grid):
    out = set()
    for depth, part in box.toPandas().groupby("depth"):
        cells = [tuple(r) for r in part[list(grid.keys)].to_numpy()]
        for a, b in itertools.product(cells, cells):
            up = all(abs(p // 2 - q // 2) <= 1 for p, q in zip(a, b))
            near = all(abs(p - q) <= 1 for p, q in zip(a, b))
            if near or (up and depth > 0):
                out.add((depth, a, b, "nei" if near else "int"))
    return out


@pytest.mark.parametrize("d", [2, 3])
def test_pairs_against_brute_force(make_points, d):
    rng = np.random.default_rng(d)
    coords = np.vstack([rng.uniform(0, 1, (30, d)), rng.normal(0.2, 0.01, (15, d))])
    pts, grid, box, pr = build(make_points, coords, 4)
    k = list(grid.keys)

    def keyed(df, kind=None):
        return {
            (r["depth"], tuple(r[f"a_{x}"] for x in k), tuple(r[f"b_{x}"] for x in k), kind or r["kind"])
            for r in df.collect()
        }

    want = brute(box, grid)
    rows = pr.collect()
    assert keyed(pr) == want and len(rows) == len(want)
    assert keyed(pairs.neighbor_pairs(box, grid), "nei") == {w for w in want if w[3] == "nei"}
    assert keyed(pairs.interaction_pairs(box, grid), "int") == {w for w in want if w[3] == "int"}
    assert {(w[0], w[2], w[1], w[3]) for w in want} == want
    audit = pairs.coverage_audit(pr, grid, 4).first()
    assert audit.complete and int(audit.covered) == len(coords) ** 2
    some = next(w for w in want if w[0] == 3 and w[3] == "int")
    got = {tuple(r[x] for x in k) for r in pairs.interaction_list(box, grid, 3, some[1]).collect()}
    assert got == {w[2] for w in want if w[0] == 3 and w[1] == some[1] and w[3] == "int"}


def test_root_has_no_interactions(make_points):
    _, grid, box, _ = build(make_points, lattice(4, 4), 2)
    assert pairs.interaction_list(box, grid, 0, (0, 0)).count() == 0
    with pytest.raises(ValueError):
        pairs.interaction_list(box, grid, 1, (0, 0, 0))


def box_cols(*edges):
    return [(F.lit(float(lo)), F.lit(float(hi))) for lo, hi in edges]


def test_gap_and_adjacency(spark):
    unit = box_cols((0, 1), (0, 1))
    one = spark.range(1)
    gap = lambda other: one.select(box_gap(unit, other).alias("g")).first().g
    assert gap(box_cols((2, 3), (0, 1))) == 1.0
    assert gap(box_cols((2, 3), (2, 3))) == pytest.approx(2**0.5)
    assert gap(box_cols((1, 2), (0, 1))) == 0.0
    touch = one.select(
        boxes_adjacent(unit, box_cols((1, 2), (1, 2))).alias("corner"),
        boxes_adjacent(unit, box_cols((1.1, 2), (0, 1))).alias("apart"),
    ).first()
    assert touch.corner and not touch.apart
    with pytest.raises(ValueError):
        boxes_adjacent(unit, box_cols((0, 1)))
    with pytest.raises(ValueError):
        cells_adjacent([F.lit(1)], [])


def test_kind_and_admissibility_agree_on_cubic_domain(make_points):
    _, grid, _, pr = build(make_points, lattice(8, 8), 3)
    rows = pairs.admissibility_audit(pr, grid).collect()
    assert all(r.admissible == (r.kind == "int") for r in rows)


@pytest.mark.parametrize("shape", [(8, 8), (4, 4, 4)])
def test_constraints(make_points, shape):
    pts, grid, box, pr = build(make_points, lattice(*shape), 2)
    rows = pr.withColumn("alpha", grid.code(F.col("depth"), "a_")).withColumn("beta", grid.code(F.col("depth"), "b_")).collect()
    lists = {}
    for r in rows:
        lists.setdefault((r.depth, r.alpha), {})[r.beta] = r.kind
    got = {(r.depth, r.alpha, r.beta): r.zero_boxes for r in pairs.sampling_constraints(pr, grid).collect()}
    want = {(*key, b): sorted(set(m) - {b}) for key, m in lists.items() for b, kind in m.items() if kind == "int"}
    assert got == want
    for r in patterns.constraint_violations(pr, grid).collect():
        assert r.n_violations == 0
    if grid.d == 2:
        assert sum(r.n_violations for r in patterns.constraint_violations(pr, grid, 3).collect()) > 0


def test_constraint_columns(make_points):
    pts, grid, box, pr = build(make_points, lattice(8, 8), 2)
    cols = pairs.box_columns(pairs.members(pts, grid, 2), grid.dof_col)
    cons = {(r.depth, r.alpha, r.beta): len(r.zero_boxes) for r in pairs.sampling_constraints(pr, grid).collect()}
    for r in pairs.constraint_columns(pr, cols, grid).collect():
        assert r.n_random == 4 and r.n_zero == 4 * cons[r.depth, r.alpha, r.beta]


def test_sums_of_large_ids_are_exact(make_points, spark):
    first = 2**60
    pts = make_points(lattice(4, 4)).withColumn("id", F.col("id") + first)
    grid = Grid.fit(pts)
    root = pairs.box_columns(pairs.members(pts, grid, 1), 1).where("depth = 0").first()
    assert int(root.col_sum) == 16 * first + 120


def test_box_columns_in_3d(make_points):
    pts, grid, _, _ = build(make_points, lattice(2, 2, 2), 1)
    root = pairs.box_columns(pairs.members(pts, grid, 1), 2).where("depth = 0").first()
    assert (root.n_cols, root.col_sum) == (16, sum(range(16)))


def test_conflicts_merge_equal_sets(make_points):
    _, grid, _, pr = build(make_points, lattice(8, 8), 3)
    cons = pairs.sampling_constraints(pr, grid).collect()
    sets = {(r.depth, r.beta, tuple(r.zero_boxes)) for r in cons}
    got = pairs.constraint_conflicts(pr, grid).collect()
    assert sum(r.n_random_sets for r in got) == len(sets) < len(cons)
    zero = {}
    for depth, _, z in sets:
        for b in z:
            zero[depth, b] = zero.get((depth, b), 0) + 1
    assert {(r.depth, r.box): r.n_zero_sets for r in got} == zero
