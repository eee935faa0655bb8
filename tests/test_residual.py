import numpy as np
import pytest
from conftest import dense_kernel, lattice, to_dense

from gridweave import Grid
from gridweave.durable import cut_lineage
from gridweave.operators import residual
from gridweave.plans import compress

NAMES = (residual.ERROR, residual.FAR, residual.WHOLE)


@pytest.fixture(scope="module")
def mesh(spark, make_points, make_matrix):
    coords = np.vstack([lattice(8, 8), lattice(8, 8)[:5] + 0.3])
    pts = make_points(coords)
    grid = Grid.fit(pts)
    a = dense_kernel(coords)
    held = cut_lineage(compress.locate(cut_lineage(make_matrix(a)), pts, grid, 3))
    return grid, a, held, compress.compress_entries(held, 2, 1)


def test_norms_in_shared_passes_equal_norms_by_products(mesh, monkeypatch):
    grid, a, held, comp = mesh
    error, (far, whole) = compress._norms_apart(held, comp, 6, 3, (0.0, 0.0))[0], _apart(held, monkeypatch)
    monkeypatch.setattr(residual, "PIECE_RECORDS", 50)
    got = residual.located_norms(held, comp.factors, NAMES, 6, 3)
    for name, want in zip(NAMES, (error, far, whole)):
        assert got[name] == pytest.approx(want, rel=1e-8)
    assert 1e-4 < got[residual.ERROR] < got[residual.FAR] < got[residual.WHOLE]
    # One by one where they do not fit together, not at all where one does not.
    n, blocks = a.shape[1], comp.factors.core.count()
    apart = residual.located_norms(held, comp.factors, NAMES, 6, 3, n + 2 * blocks * 2)
    assert apart == pytest.approx(got, rel=1e-10)
    assert residual.located_norms(held, comp.factors, NAMES, 6, 3, n) is None
    with pytest.raises(ValueError):
        residual.located_norms(held, comp.factors, NAMES, 0)


def _apart(held, monkeypatch):
    with monkeypatch.context() as patch:
        patch.setattr(compress, "located_norms", lambda *args: None)
        return compress.entry_norms(held, 6, 3)


def test_many_steps_reach_the_dense_norms(mesh):
    grid, a, held, comp = mesh
    far = to_dense(held.where("far").select("i", "j", "v"), a.shape)
    got = residual.located_norms(held, None, (residual.FAR, residual.WHOLE), 30)
    assert got[residual.FAR] == pytest.approx(np.linalg.norm(far, 2), rel=1e-3)
    assert got[residual.WHOLE] == pytest.approx(np.linalg.norm(a, 2), rel=1e-3)


def test_a_report_needs_no_products_of_tables(mesh, monkeypatch):
    """A step of the three norms once took a join per table; such steps are left to vectors too long for the driver."""
    grid, _, held, comp = mesh

    def fail(*args, **kw):
        raise AssertionError("a norm by products of tables")

    monkeypatch.setattr(compress, "power_norm", fail)
    row = compress.compression_report(held, comp, grid, 3).first()
    assert 0 < row["rel_error"] < row["far_rel_error"] < 1


def test_nothing_separated(mesh):
    _, _, held, _ = mesh
    near = cut_lineage(held.where("not far"))
    got = residual.located_norms(near, None, (residual.FAR, residual.WHOLE), 3)
    assert got[residual.FAR] == 0.0 and got[residual.WHOLE] > 0
    assert residual.located_norms(cut_lineage(held.where("false")), None, (residual.WHOLE,), 3) == {residual.WHOLE: 0.0}
