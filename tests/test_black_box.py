import numpy as np
import pytest
from conftest import dense_kernel, lattice, to_dense

from gridweave import Grid
from gridweave.durable import checkpoint_folder, cut_lineage
from gridweave.operators import boxes, factors, pairs, patterns
from gridweave.operators.norms import ratio
from gridweave.plans import compress

K, P = 4, 6


@pytest.fixture(scope="module")
def mesh(spark, make_points, make_matrix):
    coords = np.vstack([lattice(8, 8), lattice(8, 8)[:5] + 0.3])
    pts = make_points(coords)
    grid = Grid.fit(pts)
    a = dense_kernel(coords)
    matrix = cut_lineage(make_matrix(a))
    box = cut_lineage(boxes.boxes(pts, grid, 3))
    pr = cut_lineage(pairs.block_pairs(box, grid))
    held = cut_lineage(compress.locate(matrix, pts, grid, 3))
    return pts, grid, a, matrix, box, pr, held


@pytest.fixture(scope="module")
def exact(mesh):
    """Factors of the separated blocks that lose nothing: every block has at most 16 rows and 8 columns."""
    return compress.compress_entries(mesh[-1], 10, 2).factors


def test_level_samples_peel_coarser_depths(spark, mesh, exact):
    pts, grid, a, matrix, _, _, held = mesh
    got = compress.level_samples(matrix, pts, grid, 3, 2, exact).toPandas()
    assert set(got.depth) == {2, 3}
    for depth in (2, 3):
        one = compress.level_sample(matrix, pts, grid, depth, 2, exact.above(depth) if depth > 2 else None).toPandas()
        mine = got[got.depth == depth].drop(columns="depth").sort_values(["pattern", "i"])
        one = one.sort_values(["pattern", "i"])
        assert np.allclose(np.array(mine.ys.tolist()), np.array(one.ys.tolist()), atol=1e-9)
    # At depth 3 nothing of depth 2 is left: the sample is that of depth 3 and the touching blocks.
    coarse = to_dense(held.where("far and depth = 2").select("i", "j", "v"), a.shape)
    rest = compress.level_sample(cut_lineage(held.where("not (far and depth = 2)").select("i", "j", "v")), pts, grid, 3, 2).toPandas().sort_values(["pattern", "i"])
    mine = got[got.depth == 3].sort_values(["pattern", "i"])
    key = ["pattern", "i"]
    met = mine.merge(rest, on=key, how="outer")
    assert np.abs(coarse).max() > 0 and len(met) == len(mine)
    for x, y in zip(met.ys_x, met.ys_y):
        assert np.allclose(x, y if isinstance(y, list | np.ndarray) else 0, atol=1e-7)
    with pytest.raises(ValueError):
        compress.level_samples(matrix, pts, grid, 1, 2)


@pytest.mark.parametrize("width", [1, 3, 8])
def test_packed_probe(mesh, width):
    pts, grid, *_ = mesh
    got = patterns.packed_probe(pts, grid, 3, width).toPandas()
    assert sorted(got.j) == list(range(grid.n))
    assert (got["at"] < width).all()
    for _, part in got.groupby("box"):
        part = part.sort_values("j")
        assert list(part.chunk * width + part["at"]) == list(range(len(part)))
        assert part.pattern.nunique() == 1
    with pytest.raises(ValueError):
        patterns.packed_probe(pts, grid, 3, 0)


@pytest.mark.parametrize("width", [2, 8])
def test_probes_give_the_touching_blocks(mesh, exact, width):
    pts, grid, a, matrix, _, pr, held = mesh
    got = compress.probe_blocks(matrix, pts, grid, pr, 3, exact, width).toPandas()
    want = compress.leaf_blocks(held).toPandas()
    key = ["depth", "a", "b", "i", "j"]
    met = got.merge(want, on=key, how="outer", suffixes=("", "_w"), indicator=True)
    assert len(got) == len(want) == len(met) and (met["_merge"] == "both").all()
    assert np.abs(met.v - met.v_w).max() < 1e-6 * np.abs(a).max()


def test_unpeeled_probes_do_not(mesh):
    pts, grid, _, matrix, _, pr, held = mesh
    got = compress.probe_blocks(matrix, pts, grid, pr, 3, None).toPandas()
    met = got.merge(compress.leaf_blocks(held).toPandas(), on=["depth", "a", "b", "i", "j"], suffixes=("", "_w"))
    assert np.abs(met.v - met.v_w).max() > 1e-2


def test_the_whole_from_products_alone(spark, mesh, monkeypatch):
    """Factors and touching blocks from black-box products; a run that was ended goes on where it was."""
    pts, grid, a, matrix, _, pr, held = mesh
    state = f"{checkpoint_folder(spark)}/black-box-state-{np.random.default_rng().integers(1 << 60)}"
    shallow = compress.compress_black_box(matrix, pts, grid, pr, 3, K, P, state=state)
    asked = []
    sample = compress.level_sample
    monkeypatch.setattr(compress, "level_sample", lambda *args, **kw: asked.append(args[3]) or sample(*args, **kw))
    again = compress.compress_black_box(matrix, pts, grid, pr, 3, K, P, state=state)
    assert asked == []
    for table in ("u", "core", "v"):
        assert getattr(shallow, table).count() == getattr(again, table).count()
    near = compress.probe_blocks(matrix, pts, grid, pr, 3, again)
    full = to_dense(near, a.shape) + _assembled(again, a.shape)
    assert ratio(np.linalg.norm(full - a, 2), np.linalg.norm(a, 2)) < 1e-2
    true_far = a - to_dense(compress.leaf_blocks(held), a.shape)
    assert ratio(np.linalg.norm(_assembled(again, a.shape) - true_far, 2), np.linalg.norm(true_far, 2)) < 2e-2
    with pytest.raises(ValueError):
        compress.compress_black_box(matrix, pts, grid, pr, 3, K + 1, P, state=state)


def _assembled(f, shape):
    u, core, v = f.u.toPandas(), f.core.toPandas(), f.v.toPandas()
    block = ["depth", "a", "b"]
    left, right = dict(list(u.groupby(block))), dict(list(v.groupby(block)))
    out = np.zeros(shape)
    for r in core.itertuples():
        p, q = left[r.depth, r.a, r.b], right[r.depth, r.a, r.b]
        out[np.ix_(p.i, q.j)] += np.array(p.us.tolist()) @ np.reshape(r.core, (f.k, f.k)) @ np.array(q.vs.tolist()).T
    return out


def test_saved_factors(spark, mesh, exact):
    folder = f"{checkpoint_folder(spark)}/saved-{np.random.default_rng().integers(1 << 60)}"
    assert factors.Factors.load(spark, folder) is None
    exact.save(folder, "a")
    back = factors.Factors.load(spark, folder, "a")
    assert back.k == exact.k and back.u.count() == exact.u.count()
    with pytest.raises(ValueError):
        factors.Factors.load(spark, folder, "b")


def test_sample_counts(mesh):
    _, grid, _, _, box, _, _ = mesh
    got = {r.depth: r for r in patterns.sample_counts(box, grid, 3, K, P).collect()}
    cells = box.toPandas()
    for depth, r in got.items():
        part = cells[cells.depth == depth]
        n = len({(x % 6, y % 6) for x, y in zip(part.ix, part.iy)}) * (K + P) if depth >= 2 else 0
        assert (r.n_forward, r.n_adjoint) == (n, n)
        most = part.groupby([part.ix % 3, part.iy % 3]).n.max().sum() if depth == 3 else 0
        assert r.n_probe == most


def test_blocks_of_rounding_alone_have_no_factors(spark, mesh, make_matrix):
    """Entries in four columns only: peeling leaves rounding of the other blocks, of which bases of full rank were made before."""
    pts, grid, a, _, _, pr, _ = mesh
    few = np.zeros_like(a)
    few[:, [0, 9, 37, 60]] = a[:, [0, 9, 37, 60]]
    matrix = cut_lineage(make_matrix(few).where("v <> 0"))
    held = cut_lineage(compress.locate(matrix, pts, grid, 3).where("far"))
    got = compress.compress_black_box(matrix, pts, grid, pr, 3, K, P)
    block = ["depth", "a", "b"]
    want = {tuple(r) for r in held.select(*block).distinct().collect()}
    assert {d for d, _, _ in want} == {2, 3}
    assert {tuple(r) for r in got.core.select(*block).collect()} == want
    rows = held.select(*block, "i").distinct().count()
    assert got.u.select(*block, "i").distinct().count() == got.u.count() == rows
    assert got.v.count() == held.select(*block, "j").distinct().count()
    true_far = to_dense(held.select("i", "j", "v"), a.shape)
    assert np.abs(_assembled(got, a.shape) - true_far).max() < 1e-6 * np.abs(a).max()
