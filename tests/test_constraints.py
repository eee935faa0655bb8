import itertools

import numpy as np
import pytest
from conftest import lattice
from pyspark.sql import functions as F

from gridweave import Grid
from gridweave.durable import cut_lineage
from gridweave.operators import boxes, constraints, pairs

SHAPES = {"8x8": (lattice(8, 8), 3), "4x4x4": (lattice(4, 4, 4), 2), "clusters": (None, 4)}


@pytest.fixture(scope="module", params=SHAPES)
def case(request, spark, make_points):
    coords, depth = SHAPES[request.param]
    if coords is None:
        rng = np.random.default_rng(5)
        coords = np.vstack([rng.uniform(0, 1, (25, 2)), rng.normal(0.3, 0.02, (15, 2))])
    pts = make_points(coords)
    grid = Grid.fit(pts, ("x", "y", "z")[: coords.shape[1]])
    box = cut_lineage(boxes.boxes(pts, grid, depth))
    pr = cut_lineage(pairs.block_pairs(box, grid))
    return pts, grid, depth, box, pr


def coded(box, grid):
    """{depth: {code: cell}}"""
    rows = box.select("depth", grid.code(F.col("depth")).alias("code"), *grid.keys).collect()
    out = {}
    for r in rows:
        out.setdefault(r.depth, {})[r.code] = tuple(r[k] for k in grid.keys)
    return out


def lists_of(cells):
    """Both lists of every box of one depth, by definition."""
    out = {}
    for a, p in cells.items():
        near = {b for b, q in cells.items() if max(abs(x - y) for x, y in zip(p, q)) <= 1}
        far = {b for b, q in cells.items() if max(abs((x >> 1) - (y >> 1)) for x, y in zip(p, q)) <= 1} - near
        out[a] = (near, far)
    return out


def test_sets_of_every_pair_of_boxes(spark, case):
    """All ordered pairs of all depths, also across depths, of empty boxes and with nulls."""
    pts, grid, depth, box, pr = case
    known = coded(box, grid)
    every = [(d, c) for d in known for c in known[d]]
    if len(every) > 90:
        every = [e for e in every if e[0] == depth][:40] + every[:20]
    requests = [(*a, *b) for a, b in itertools.product(every, every)]
    gone = 10**9
    requests += [(depth, every[0][1], depth, gone), (depth, gone, depth, every[0][1]), (None, None, 1, 0), (1, 0, None, None)]
    table = spark.createDataFrame(requests, "depth int, alpha long, beta_depth int, beta long")
    got = constraints.constraint_sets(table, box, pr, grid).collect()
    assert len(got) == len(requests)
    lists = {d: lists_of(cells) for d, cells in known.items()}
    cols = {(r.depth, r.code): (r.n_cols, int(r.col_sum)) for r in constraints.box_column_sums(pts, grid, depth).collect()}
    held = {(r.depth, r.alpha, r.beta_depth, r.beta): r for r in constraints.constraint_set_columns(table, box, pr, constraints.box_column_sums(pts, grid, depth), grid).collect()}
    seen = set()
    for r in got:
        seen.add(r.place)
        c = held[(r.depth, r.alpha, r.beta_depth, r.beta)]
        assert c.place == r.place
        if r.depth is None or r.beta_depth is None or r.alpha == gone or r.beta == gone:
            assert r.place == "no_box" and r.zero_boxes is None and c.n_zero is None
            continue
        if r.depth != r.beta_depth:
            assert r.place == "depths_differ" and r.zero_boxes is None and c.n_random is None
            continue
        near, far = lists[r.depth][r.alpha]
        want = "own" if r.alpha == r.beta else "nei" if r.beta in near else "int" if r.beta in far else "out"
        assert r.place == want
        assert r.zero_boxes == sorted((near | far) - {r.beta})
        assert (c.n_random, int(c.random_sum)) == cols[r.depth, r.beta]
        assert c.n_zero == sum(cols[r.depth, z][0] for z in r.zero_boxes)
        assert int(c.zero_sum) == sum(cols[r.depth, z][1] for z in r.zero_boxes)
    assert {"own", "nei", "int", "no_box", "depths_differ"} <= seen


def test_column_sums(case):
    pts, grid, depth, _, _ = case
    want = {(r.depth, r.code): (r.n_cols, int(r.col_sum)) for r in pairs.box_columns(pairs.members(pts, grid, depth), grid.dof_col).collect()}
    got = {(r.depth, r.code): (r.n_cols, int(r.col_sum)) for r in constraints.box_column_sums(pts, grid, depth).collect()}
    assert got == want


def test_conflict_edges(case):
    _, grid, depth, box, pr = case
    sets = cut_lineage(constraints.distinct_sets(pr, grid))
    edges = cut_lineage(constraints.conflict_edges(sets))
    want_sets, want_edges, blocks = {}, set(), 0
    for d, cells in coded(box, grid).items():
        lists = lists_of(cells)
        found = {}
        for a, (near, far) in lists.items():
            for b in far:
                blocks += 1
                found.setdefault((b, frozenset((near | far) - {b})), []).append(a)
        for p, q in itertools.combinations(found, 2):
            if p[0] in q[1] or q[0] in p[1]:
                ends = sorted((x[0], min(a for a, (n, f) in lists.items() if n | f == x[1] | {x[0]})) for x in (p, q))
                want_edges.add((d, *ends[0], *ends[1]))
        for (b, zero), alphas in found.items():
            want_sets[(d, b, min(a for a, (n, f) in lists.items() if n | f == zero | {b}))] = len(alphas)
    assert {(r.depth, r.beta, r.list_of): r.n_blocks for r in sets.collect()} == want_sets
    assert sum(want_sets.values()) == blocks and len(want_sets) < blocks
    rows = [tuple(r) for r in edges.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want_edges
    degree = {k: 0 for k in want_sets}
    for d, *ends in want_edges:
        for k in (0, 2):
            degree[(d, ends[k], ends[k + 1])] += 1
    graph = constraints.conflict_graph(sets, edges).collect()
    assert {(r.depth, r.beta, r.list_of): r.degree for r in graph} == degree


def test_nothing_to_constrain(spark, make_points):
    pts = make_points(lattice(2, 2))
    grid = Grid.fit(pts)
    box = boxes.boxes(pts, grid, 1)
    pr = pairs.block_pairs(box, grid)
    sets = constraints.distinct_sets(pr, grid)
    assert sets.count() == 0 and constraints.conflict_edges(sets).count() == 0
    empty = spark.createDataFrame([], "depth int, alpha long, beta_depth int, beta long")
    assert constraints.constraint_sets(empty, box, pr, grid).count() == 0
