"""Named queries over the stored tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.functions.gaussian import sketch_width
from gridweave.functions.geometry import box_gap, boxes_adjacent
from gridweave.grid import Grid
from gridweave.operators import blockfactor, boxes, constraints, factors, mesh, near, norms, pairs, patterns, products
from gridweave.plans import compress, cover, farfield
from gridweave.skew import shuffled
from gridweave.sources import matrices, points

Query = Callable[[SparkSession, str], DataFrame]

LEAF = 8
NEAR_LEAF = 8
CONFLICT_LEAF = 32
FAST_LEAF, FAST_ORDER = 16, 12
RANK, OVER = 3, 2
# Two separated boxes of the nation lattice hold at most six nations, so this rank is exact there.
NATION_RANK = 6
ITERS = 20
RADIUS = 1.0
TARGETS = (0.1, 0.01, 0.001)
EPS = 1e-3
# (rank, oversampling, leaf size, eta)
SWEEP = ((1, 2, 8, None), (6, 2, 8, None), (6, 2, 32, None), (6, 2, 8, 0.6), (6, 2, 8, 0.9), (6, 2, 32, 1.6))
ETAS = (0.6, 0.9, 1.6)


# -- shared inputs -----------------------------------------------------------
def _part(spark: SparkSession, sf: str) -> tuple[DataFrame, Grid, int]:
    pts = points.part_points(spark, sf)
    grid = Grid.fit(pts)
    return pts, grid, grid.depth_for(LEAF)


def _events(spark: SparkSession, sf: str) -> tuple[DataFrame, Grid, int]:
    pts = points.event_points(spark, sf)
    grid = Grid.fit(pts, points.XYZ)
    return pts, grid, grid.depth_for(LEAF)


def _trade(spark: SparkSession, sf: str) -> tuple[DataFrame, Grid, int]:
    pts = points.trade_points(spark, sf)
    grid = Grid.fit(pts)
    return pts, grid, max(grid.depth_for(LEAF), compress.FIRST_DEPTH)


def _unit_part(spark: SparkSession, sf: str) -> tuple[DataFrame, Grid, int]:
    pts = points.unit_scaled(points.part_points(spark, sf))
    grid = Grid.fit(pts)
    return pts, grid, boxes.finest_needed(pts, grid, NEAR_LEAF)


def _box(mesh_of, spark: SparkSession, sf: str) -> tuple[DataFrame, Grid, int, DataFrame]:
    pts, grid, depth = mesh_of(spark, sf)
    return pts, grid, depth, boxes.boxes(pts, grid, depth)


def _pairs(mesh_of, spark: SparkSession, sf: str) -> tuple[DataFrame, Grid, int, DataFrame, DataFrame]:
    """Boxes are written, so that the points are read for them once."""
    pts, grid, depth, box = _box(mesh_of, spark, sf)
    box = cut_lineage(box)
    return pts, grid, depth, box, pairs.block_pairs(box, grid)


def _traded(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct traded pairs of patch ids."""
    lines = points.read(spark, sf, "lineitem")
    return lines.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct()


def _r(name: str, digits: int = 6):
    """Rounded column without negative zero."""
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


# -- points --------------------------------------------------------------------
def point_validate(spark, sf):
    pts = points.event_points(spark, sf)
    return points.validate(pts, points.XYZ)


def mesh_summary(spark, sf):
    return mesh.mesh_summary(points.part_points(spark, sf), 2)


def patch_to_rows(spark, sf):
    return mesh.patch_to_rows(points.event_points(spark, sf).select("id"), 3)


def patch_to_cols(spark, sf):
    return mesh.patch_to_cols(points.event_points(spark, sf).select("id"), 3)


def domain_box(spark, sf):
    return mesh.domain_box(points.event_points(spark, sf), points.XYZ)


def dyadic_cells(spark, sf):
    pts, grid, depth = _events(spark, sf)
    return mesh.dyadic_cells(pts, grid, depth)


def pairwise_distances(spark, sf):
    pts = points.trade_points(spark, sf)
    out = mesh.pairwise_distances(_traded(spark, sf), pts, points.XY)
    return out.select("a", "b", _r("distance"))


def kernel_block(spark, sf):
    pts = points.trade_points(spark, sf)
    out = mesh.kernel_of_pairs(_traded(spark, sf), pts, points.XY, EPS)
    return out.select("a", "b", _r("k00", 4), _r("k10", 4))


def distance_join(spark, sf):
    out = near.distance_join(points.part_points(spark, sf), points.XY, RADIUS)
    return out.select("a", "b", "a_copies", "b_copies", _r("distance"))


# -- boxes ---------------------------------------------------------------------
def all_boxes(spark, sf):
    _, _, _, box = _box(_events, spark, sf)
    return box


def boxes_2d(spark, sf):
    _, _, _, box = _box(_part, spark, sf)
    return box


def box_children(spark, sf):
    _, grid, _, box = _box(_events, spark, sf)
    return boxes.box_children(box, grid)


def leaf_boxes(spark, sf):
    pts, grid, depth = _events(spark, sf)
    return boxes.leaf_boxes(boxes.crowded_boxes(pts, grid, LEAF, depth), grid, LEAF, grid.finest)


def collapsed_boxes(spark, sf):
    pts, grid, depth = _part(spark, sf)
    return boxes.collapsed_boxes(boxes.crowded_boxes(pts, grid, 2, depth), grid, 2)


def box_geometry(spark, sf):
    _, grid, _, box = _box(_part, spark, sf)
    out = boxes.box_geometry(box, grid)
    return out.select("depth", *grid.keys, *[_r(c) for c in out.columns if c not in ("depth", *grid.keys)])


def box_tight_bounds(spark, sf):
    pts, grid, depth = _events(spark, sf)
    out = boxes.box_tight_bounds(pts, grid, depth)
    return out.select("depth", *grid.keys, "n", *[_r(c, 3) for c in out.columns if c not in ("depth", "n", *grid.keys)])


def leaf_membership(spark, sf):
    pts, grid, depth = _events(spark, sf)
    leaves = cut_lineage(boxes.leaf_boxes(boxes.crowded_boxes(pts, grid, LEAF, depth), grid, LEAF, grid.finest))
    return boxes.leaf_membership(pts, leaves, grid, leaves.agg(F.max("depth")).first()[0])


def boxes_at_depth(spark, sf):
    _, _, depth, box = _box(_events, spark, sf)
    return boxes.boxes_at_depth(box, depth)


def level_profile(spark, sf):
    _, _, _, box = _box(_events, spark, sf)
    return boxes.level_profile(box)


def eta_sweep(spark, sf):
    pts, grid, depth = _part(spark, sf)
    out = boxes.eta_sweep(boxes.box_tight_bounds(pts, grid, depth), grid, TARGETS)
    return out.select("depth", *grid.keys, "target", _r("gamma"), _r("eta"))


def pattern_cells(spark, sf):
    _, grid, _, box = _box(_events, spark, sf)
    return patterns.pattern_cells(box, grid)


def leaf_pattern_cells(spark, sf):
    _, grid, _, box = _box(_events, spark, sf)
    return patterns.pattern_cells(box, grid, patterns.LEAF_PERIOD)


def pattern_groups(spark, sf):
    _, grid, _, box = _box(_events, spark, sf)
    return patterns.pattern_groups(box, grid)


# -- pairs ---------------------------------------------------------------------
def neighbor_pairs(spark, sf):
    _, grid, _, box = _box(_events, spark, sf)
    return pairs.neighbor_pairs(box, grid)


def interaction_pairs(spark, sf):
    _, grid, _, box = _box(_events, spark, sf)
    return pairs.interaction_pairs(box, grid)


def interaction_list(spark, sf):
    """List of the fullest box of the last depth (lowest cell on ties)."""
    _, grid, depth, box = _box(_part, spark, sf)
    fullest = boxes.boxes_at_depth(box, depth).orderBy(F.desc("n"), *grid.keys).limit(1).first()
    return pairs.interaction_list(box, grid, depth, [fullest[k] for k in grid.keys])


def box_adjacency(spark, sf):
    _, grid, _, _, pr = _pairs(_part, spark, sf)
    depth = F.col("depth")
    flag = boxes_adjacent(grid.edges(depth, "a_"), grid.edges(depth, "b_"))
    return pr.select("depth", "a_ix", "a_iy", "b_ix", "b_iy", flag.alias("adjacent"))


def box_gap_query(spark, sf):
    _, grid, _, _, pr = _pairs(_part, spark, sf)
    depth = F.col("depth")
    gap = box_gap(grid.edges(depth, "a_"), grid.edges(depth, "b_"))
    return pr.withColumn("gap", gap).select("depth", "a_ix", "a_iy", "b_ix", "b_iy", _r("gap"))


def admissible_pairs(spark, sf):
    _, grid, _, _, pr = _pairs(_part, spark, sf)
    out = pairs.pair_geometry(pr, grid)
    return out.where("admissible").select("depth", "a_ix", "a_iy", "b_ix", "b_iy", "kind", _r("gap"))


def _as_text(name: str):
    """A whole number that may be beyond a long, as its digits."""
    return F.col(name).cast("decimal(38,0)").cast("string").alias(name)


def _census(box: DataFrame, pr: DataFrame) -> DataFrame:
    return pairs.block_census(box, pr).withColumn("absent", _as_text("absent"))


def block_census(spark, sf):
    _, _, _, box, pr = _pairs(_part, spark, sf)
    return _census(box, pr)


def block_census_events(spark, sf):
    _, _, _, box, pr = _pairs(_events, spark, sf)
    return _census(box, pr)


def admissibility_audit(spark, sf):
    _, grid, _, _, pr = _pairs(_part, spark, sf)
    return pairs.admissibility_audit(pr, grid)


def coverage_audit(spark, sf):
    _, grid, depth, _, pr = _pairs(_part, spark, sf)
    out = pairs.coverage_audit(pr, grid, depth)
    return out.select(_as_text("covered"), _as_text("expected"), "complete")


def sampling_constraints(spark, sf):
    _, grid, _, _, pr = _pairs(_part, spark, sf)
    out = pairs.sampling_constraints(pr, grid)
    return out.select("depth", "alpha", "beta", F.array_join(F.col("zero_boxes").cast("array<string>"), ",").alias("zero_boxes"))


def constraint_columns(spark, sf):
    pts, grid, depth, _, pr = _pairs(_part, spark, sf)
    cols = pairs.box_columns(pairs.members(pts, grid, depth), grid.dof_col)
    out = pairs.constraint_columns(pr, cols, grid)
    return out.withColumns({c: _as_text(c) for c in ("random_sum", "zero_sum")})


def constraint_violations(spark, sf):
    _, grid, _, _, pr = _pairs(_events, spark, sf)
    return patterns.constraint_violations(pr, grid)


def constraint_conflicts(spark, sf):
    _, grid, _, _, pr = _pairs(_part, spark, sf)
    return pairs.constraint_conflicts(pr, grid)


def _requests(box: DataFrame, pr: DataFrame, grid: Grid) -> DataFrame:
    """Constraint requests over all boxes: every listed pair, the box's mirror image, and its parent."""
    depth = F.col("depth")
    listed = pr.select("depth", grid.code(depth, "a_").alias("alpha"), depth.alias("beta_depth"), grid.code(depth, "b_").alias("beta"))
    last = grid.side(depth).cast("bigint") - 1
    mirror = grid.code(depth, cells=[last - F.col(k) for k in grid.keys])
    mirrored = box.select("depth", grid.code(depth).alias("alpha"), depth.alias("beta_depth"), mirror.alias("beta"))
    up = (depth - 1).cast("int")
    parents = box.where("depth > 0").select("depth", grid.code(depth).alias("alpha"), up.alias("beta_depth"), grid.code(up, cells=grid.coarsen(1)).alias("beta"))
    return listed.unionByName(mirrored.unionByName(parents))


def constraint_sets(spark, sf):
    _, grid, _, box, pr = _pairs(_part, spark, sf)
    out = constraints.constraint_sets(_requests(box, pr, grid), box, pr, grid)
    return out.withColumn("zero_boxes", F.coalesce(F.array_join(F.col("zero_boxes").cast("array<string>"), ","), F.lit("")))


def constraint_set_columns(spark, sf):
    pts, grid, depth, box, pr = _pairs(_part, spark, sf)
    cols = constraints.box_column_sums(pts, grid, depth)
    out = constraints.constraint_set_columns(_requests(box, pr, grid), box, pr, cols, grid)
    # A request without a list shows zeros; its place says so.
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_random", "n_zero", "random_sum", "zero_sum")}
    return out.withColumns(zero).withColumns({c: _as_text(c) for c in ("random_sum", "zero_sum")})


def _sets(spark, sf) -> DataFrame:
    """Distinct sets of the parts at the depth of larger leaves, as every set has hundreds of edges."""
    pts = points.part_points(spark, sf)
    grid = Grid.fit(pts)
    pr = pairs.block_pairs(cut_lineage(boxes.boxes(pts, grid, grid.depth_for(CONFLICT_LEAF))), grid)
    return cut_lineage(constraints.distinct_sets(pr, grid))


def conflict_edges(spark, sf):
    return constraints.conflict_edges(_sets(spark, sf))


def conflict_graph(spark, sf):
    held = _sets(spark, sf)
    return constraints.conflict_graph(held, constraints.conflict_edges(held))


# -- matrices ------------------------------------------------------------------
def matrix_from_table(spark, sf):
    return matrices.supply_matrix(spark, sf)


def matrix_from_arrays(spark, sf):
    return matrices.embedding_matrix(spark, sf)


def _part_columns(spark, sf, key: str = "j") -> DataFrame:
    """The harmonic vector over all parts, read from the part table."""
    ids = points.read(spark, sf, "part").select(F.col("p_partkey").alias(key))
    return ids.select(key, (F.lit(1.0) / (F.lit(1.0) + F.col(key))).alias("x"))


def _supplier_rows(spark, sf, key: str = "i") -> DataFrame:
    ids = points.read(spark, sf, "supplier").select(F.col("s_suppkey").alias(key))
    return ids.select(key, (F.lit(1.0) / (F.lit(1.0) + F.col(key))).alias("x"))


def _thick(vec: DataFrame, key: str) -> DataFrame:
    """Three columns: x, x^2, x^3."""
    x = F.col("x")
    return vec.select(key, F.array(x, x * x, x * x * x).alias("xs"))


def _long(df: DataFrame, keys: list[str], name: str = "ys", digits: int = 6) -> DataFrame:
    return df.select(*keys, F.posexplode(name).alias("c", "y")).select(*keys, "c", _r("y", digits))


def matvec(spark, sf):
    out = products.matvec(matrices.supply_matrix(spark, sf), _part_columns(spark, sf))
    return out.select("i", _r("y"))


def matvec_thick(spark, sf):
    vec = _thick(_part_columns(spark, sf), "j")
    return _long(products.matvec_thick(matrices.supply_matrix(spark, sf), vec, 3), ["i"])


def rmatvec(spark, sf):
    out = products.rmatvec(matrices.supply_matrix(spark, sf), _supplier_rows(spark, sf))
    return out.select("j", _r("y"))


def rmatvec_thick(spark, sf):
    vec = _thick(_supplier_rows(spark, sf), "i")
    return _long(products.rmatvec_thick(matrices.supply_matrix(spark, sf), vec, 3), ["j"])


def _coarse(matrix: DataFrame) -> DataFrame:
    """An approximation to compare with: entries rounded down to tens."""
    return matrix.select("i", "j", (F.floor(F.col("v") / 10.0) * 10.0).cast("double").alias("v"))


def difference_matvec(spark, sf):
    # Written, as both sides of the difference read it.
    a = cut_lineage(matrices.supply_matrix(spark, sf))
    out = products.matvec(products.difference(_coarse(a), a), _part_columns(spark, sf))
    return out.select("i", _r("y"))


def difference_rmatvec(spark, sf):
    # Written, as both sides of the difference read it.
    a = cut_lineage(matrices.supply_matrix(spark, sf))
    out = products.rmatvec(products.difference(_coarse(a), a), _supplier_rows(spark, sf))
    return out.select("j", _r("y"))


def matrix_block(spark, sf):
    """Rows of suppliers in debt, columns of large parts."""
    rows = points.read(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("i"))
    cols = points.read(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("j"))
    return products.matrix_block(matrices.supply_matrix(spark, sf), rows, cols)


def block_spectrum(spark, sf):
    """Spectrum of the embedding rows of each label, by its second and fourth power sums, which the entries fix."""
    emb = points.read(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    out = products.block_spectrum(emb, "label", "e", 64)
    energy = F.aggregate("sigma", F.lit(0.0), lambda acc, s: acc + s * s)
    fourth = F.aggregate("sigma", F.lit(0.0), lambda acc, s: acc + s * s * s * s)
    falling = F.forall(F.sequence(F.lit(1), F.lit(63)), lambda q: F.col("sigma")[q - 1] >= F.col("sigma")[q])
    return out.select("label", "n_rows", F.round(energy, 4).alias("energy"), F.round(fourth, 4).alias("fourth"), falling.alias("falling"))


def spectral_norm(spark, sf):
    a = matrices.supply_matrix(spark, sf)
    value = norms.spectral_norm(a, ITERS)
    return spark.range(1).select(F.lit(ITERS).alias("n_iters"), F.round(F.lit(value), 4).alias("norm"))


def relative_error(spark, sf):
    a = cut_lineage(matrices.supply_matrix(spark, sf))
    value = norms.relative_error(_coarse(a), a, ITERS, written=True)
    return spark.range(1).select(F.lit(ITERS).alias("n_iters"), F.round(F.lit(value), 6).alias("rel_error"))


# -- kernel --------------------------------------------------------------------
def kernel_entries(spark, sf):
    pts, grid, depth = _unit_part(spark, sf)
    out = near.kernel_entries(pts, grid, depth, EPS)
    return out.select("a", "b", "a_copies", "b_copies", _r("k00", 2), _r("k10", 2))


def kernel_matvec(spark, sf):
    pts, grid, _ = _unit_part(spark, sf)
    depth = grid.depth_for(64)
    pr = pairs.block_pairs(boxes.boxes(pts, grid, depth), grid)
    vec = pts.select(F.col("id").alias("j"), (F.lit(1.0) / (F.lit(1.0) + F.col("id"))).alias("x"))
    out = near.kernel_matvec(pts, grid, pr, depth, vec, EPS)
    return out.select("i", _r("y", 3))


def kernel_matvec_fast(spark, sf):
    """The same product by interpolation; so many nodes leave an error far below the last digit shown."""
    pts, grid, _ = _unit_part(spark, sf)
    depth = max(grid.depth_for(FAST_LEAF), compress.FIRST_DEPTH)
    box = cut_lineage(boxes.boxes(pts, grid, depth))
    pr = cut_lineage(pairs.block_pairs(box, grid))
    vec = pts.select(F.col("id").alias("j"), (F.lit(1.0) / (F.lit(1.0) + F.col("id"))).alias("x"))
    out = farfield.kernel_matvec_fast(pts, grid, box, pr, depth, vec, FAST_ORDER, EPS)
    return out.select("i", _r("y", 1))


# -- sketches --------------------------------------------------------------------
def gaussian_sketch(spark, sf):
    cols = points.read(spark, sf, "part").select(F.col("p_partkey").alias("j"))
    return _long(patterns.gaussian_sketch(cols, "j", RANK, OVER, 7, "ys"), ["j"])


def admissible_sketch(spark, sf):
    pts, grid, depth = _events(spark, sf)
    out = patterns.admissible_sketch(pts, grid, depth, RANK, 0, 7, 2).withColumnRenamed("gs", "ys")
    return _long(out, ["depth", "pattern", "box", "j"])


def leaf_probe(spark, sf):
    pts, grid, depth = _events(spark, sf)
    return patterns.leaf_probe(pts, grid, depth)


def _entries(spark, sf) -> tuple[DataFrame, DataFrame, Grid, int]:
    pts, grid, depth = _trade(spark, sf)
    matrix = cut_lineage(matrices.trade_matrix(spark, sf))
    return cut_lineage(compress.locate(matrix, pts, grid, depth)), pts, grid, depth


def leaf_blocks(spark, sf):
    pts, grid, depth = _trade(spark, sf)
    return compress.leaf_blocks(compress.locate(cut_lineage(matrices.trade_matrix(spark, sf)), pts, grid, depth))


def _mean_factors(held: DataFrame, pts: DataFrame, grid: Grid, depth: int, last: int | None = None) -> factors.Factors:
    """Rank-one factors that hold each interaction block's mean."""
    far = held.where("far")
    if last is not None:
        far = far.where(F.col("depth") <= last)
    total = far.groupBy(*blockfactor.BLOCK).agg(F.sum("v").alias("s"))
    member = pairs.members(pts, grid, depth, compress.FIRST_DEPTH)
    size = member.groupBy("depth", "code").agg(F.count(F.lit(1)).alias("n"))
    for side in ("a", "b"):
        total = total.join(size.select("depth", F.col("code").alias(side), F.col("n").alias(f"n_{side}")), ["depth", side])
    count = F.col("n_a") * grid.dof_row * F.col("n_b") * grid.dof_col
    core = total.select(*blockfactor.BLOCK, F.array(F.col("s") / count).alias("core"))
    keys = core.select(*blockfactor.BLOCK)
    one = F.array(F.lit(1.0))
    rows = mesh.patch_to_rows(member, grid.d).select("depth", F.col("code").alias("a"), "i")
    cols = mesh.patch_to_cols(member, grid.d).select("depth", F.col("code").alias("b"), "j")
    u = keys.join(shuffled(rows), ["depth", "a"]).select(*blockfactor.BLOCK, "i", one.alias("us"))
    v = keys.join(shuffled(cols), ["depth", "b"]).select(*blockfactor.BLOCK, "j", one.alias("vs"))
    return factors.Factors.write(u, core, v, 1)


def _patch_vector(pts: DataFrame, dof: int, key: str) -> DataFrame:
    first = F.col("id") * dof
    ids = pts.select(F.explode(F.sequence(first, first + (dof - 1))).alias(key))
    return ids.select(key, (F.lit(1.0) / (F.lit(1.0) + F.col(key))).alias("x"))


def level_sample(spark, sf):
    """Every depth, after peeling the block means of the coarser ones."""
    held, pts, grid, depth = _entries(spark, sf)
    means = _mean_factors(held, pts, grid, depth)
    out = compress.level_samples(held.select("i", "j", "v"), pts, grid, depth, RANK, means)
    return _long(out, ["depth", "pattern", "i"])


def apply_truncated(spark, sf):
    held, pts, grid, depth = _entries(spark, sf)
    fac = _mean_factors(held, pts, grid, depth)
    out = factors.apply_truncated(fac, _patch_vector(pts, grid.dof_col, "j"))
    return out.select("i", _r("y"))


def apply_truncated_t(spark, sf):
    held, pts, grid, depth = _entries(spark, sf)
    fac = _mean_factors(held, pts, grid, depth)
    out = factors.apply_truncated_t(fac, _patch_vector(pts, grid.dof_row, "i"))
    return out.select("j", _r("y"))


def peeled_matvec(spark, sf):
    held, pts, grid, depth = _entries(spark, sf)
    fac = _mean_factors(held, pts, grid, depth)
    out = factors.peeled_matvec(held.select("i", "j", "v"), _patch_vector(pts, grid.dof_col, "j"), fac, follows_input=True)
    return out.select("i", _r("y"))


def peeled_rmatvec(spark, sf):
    held, pts, grid, depth = _entries(spark, sf)
    fac = _mean_factors(held, pts, grid, depth)
    out = factors.peeled_rmatvec(held.select("i", "j", "v"), _patch_vector(pts, grid.dof_row, "i"), fac, follows_input=True)
    return out.select("j", _r("y"))


# -- factors -------------------------------------------------------------------
def _nation_entries(spark, sf) -> tuple[DataFrame, DataFrame, Grid]:
    pts = points.nation_points(spark, sf)
    grid = Grid.fit(pts)
    depth = max(grid.depth_for(LEAF), compress.FIRST_DEPTH)
    matrix = cut_lineage(matrices.nation_matrix(spark, sf))
    return cut_lineage(compress.locate(matrix, pts, grid, depth)), pts, grid


def _report_basis(basis: DataFrame, out: str, k: int = NATION_RANK) -> DataFrame:
    rep = blockfactor.orth_report(basis, k, out=out)
    fits = (F.col("k_eff") >= 1) & (F.col("k_eff") <= F.least(F.lit(k), F.col("n_rows")))
    return rep.select("depth", "a", "b", "n_rows", fits.alias("k_ok"), "orth_ok")


def _with_captured(report: DataFrame, held: DataFrame, basis: DataFrame, key: str, out: str) -> DataFrame:
    """``report`` with the energy of each block's entries inside its basis: all of it where the rank is exact."""
    other = "j" if key == "i" else "i"
    met = held.where("far").join(basis.select(*blockfactor.BLOCK, key, out), [*blockfactor.BLOCK, key])
    inside = met.groupBy(*blockfactor.BLOCK, other).agg(products.sum_arrays(NATION_RANK, lambda c: f"v * {out}[{c}]").alias("w"))
    square = F.aggregate("w", F.lit(0.0), lambda acc, c: acc + c * c)
    energy = inside.groupBy(*blockfactor.BLOCK).agg(F.sum(square).alias("captured"))
    return report.join(energy.select(*blockfactor.BLOCK, _r("captured", 2)), list(blockfactor.BLOCK))


def column_bases(spark, sf):
    held, _, _ = _nation_entries(spark, sf)
    y = compress.entry_samples(held, sketch_width(NATION_RANK, OVER))
    basis = cut_lineage(compress.column_bases(y, NATION_RANK, OVER))
    return _with_captured(_report_basis(basis, "us"), held, basis, "i", "us")


def row_bases(spark, sf):
    held, _, _ = _nation_entries(spark, sf)
    z = compress.entry_row_samples(held, sketch_width(NATION_RANK, OVER))
    basis = cut_lineage(compress.row_bases(z, NATION_RANK, OVER))
    return _with_captured(_report_basis(basis, "vs"), held, basis, "j", "vs")


def block_orth(spark, sf):
    """Leading basis of each label's whole embedding rows: every rank reached, every basis orthonormal."""
    emb = points.read(spark, sf, "embeddings").select(
        F.lit(0).alias("depth"),
        F.col("label").cast("bigint").alias("a"),
        F.col("label").cast("bigint").alias("b"),
        F.col("vec_id").alias("i"),
        F.col("embedding").cast("array<double>").alias("ys"),
    )
    basis = blockfactor.block_orth(emb, "i", 64, 4)
    rep = blockfactor.orth_report(basis, 4)
    return rep.select(F.col("a").alias("label"), "n_rows", "k_eff", "orth_ok")


def two_sample_compress(spark, sf):
    held, _, _, _ = _entries(spark, sf)
    width = sketch_width(RANK, OVER)
    y = cut_lineage(compress.entry_samples(held, width))
    z = cut_lineage(compress.entry_row_samples(held, width))
    u, v = blockfactor.two_sample_compress(y, z, width, RANK, "qr")
    left = _report_basis(u, "us", RANK).withColumnRenamed("n_rows", "n_u").withColumnRenamed("orth_ok", "u_ok").drop("k_ok")
    right = _report_basis(v, "vs", RANK).withColumnRenamed("n_rows", "n_v").withColumnRenamed("orth_ok", "v_ok").drop("k_ok")
    return left.join(right, list(blockfactor.BLOCK))


def _compressed(spark, sf) -> tuple[compress.Compressed, DataFrame, DataFrame, Grid]:
    held, pts, grid = _nation_entries(spark, sf)
    return compress.compress_entries(held, NATION_RANK, OVER), held, pts, grid


def _energy(core: DataFrame) -> DataFrame:
    """Sum of squares of each core, which orthonormal bases make equal to the block's own."""
    square = F.aggregate("core", F.lit(0.0), lambda acc, c: acc + c * c)
    return core.select("depth", "a", "b", square.alias("energy"))


def core_matrix(spark, sf):
    comp, _, _, _ = _compressed(spark, sf)
    return _energy(comp.factors.core).select("depth", "a", "b", _r("energy", 2))


def core_matrices(spark, sf):
    """Cores and their energy per depth."""
    comp, _, _, _ = _compressed(spark, sf)
    return _energy(comp.factors.core).groupBy("depth").agg(
        F.count(F.lit(1)).alias("n_cores"), F.round(F.sum("energy"), 1).alias("energy")
    )


def hier_matvec(spark, sf):
    comp, _, pts, grid = _compressed(spark, sf)
    y = compress.hier_matvec(comp, _patch_vector(pts, grid.dof_col, "j"))
    return products.with_zero_rows(y, mesh.patch_to_rows(pts.select("id"), grid.d)).select("i", _r("y", 2))


def hier_rmatvec(spark, sf):
    comp, _, pts, grid = _compressed(spark, sf)
    y = compress.hier_rmatvec(comp, _patch_vector(pts, grid.dof_row, "i"))
    return products.with_zero_rows(y, mesh.patch_to_cols(pts.select("id"), grid.d), "j").select("j", _r("y", 2))


def sample_counts(spark, sf):
    """Products with the whole matrix that black-box compression of the events' mesh needs."""
    _, grid, depth, box = _box(_events, spark, sf)
    return patterns.sample_counts(box, grid, depth, RANK, OVER)


def _black_box(spark, sf) -> tuple[factors.Factors, DataFrame, DataFrame, Grid, int, DataFrame]:
    """Factors from products with the whole nation matrix alone, and the located entries to compare with."""
    held, pts, grid = _nation_entries(spark, sf)
    depth = max(grid.depth_for(LEAF), compress.FIRST_DEPTH)
    pr = cut_lineage(pairs.block_pairs(boxes.boxes(pts, grid, depth), grid))
    fac = compress.compress_black_box(held.select("i", "j", "v"), pts, grid, pr, depth, NATION_RANK, OVER)
    return fac, held, pts, grid, depth, pr


def black_box_bases(spark, sf):
    """Column bases of all depths from peeled samples, with the energy of each block's entries inside its basis."""
    fac, held, _, _, _, _ = _black_box(spark, sf)
    basis = cut_lineage(fac.u)
    return _with_captured(_report_basis(basis, "us").drop("n_rows"), held, basis, "i", "us")


def black_box_report(spark, sf):
    fac, held, _, grid, _, _ = _black_box(spark, sf)
    comp = compress.Compressed(compress.leaf_blocks(held).select("i", "j", "v"), fac)
    out = compress.compression_report(held, comp, grid, ITERS)
    return out.select("k", "n_near", "n_full", _r("rel_error"), _r("far_rel_error"))


def probe_blocks(spark, sf):
    """Entries of the touching blocks of the last depth, from products with packed probes."""
    fac, held, pts, grid, depth, pr = _black_box(spark, sf)
    out = compress.probe_blocks(held.select("i", "j", "v"), pts, grid, pr, depth, fac)
    return out.select("depth", "a", "b", "i", "j", _r("v", 2)).where("v <> 0")


def compression_report(spark, sf):
    comp, held, _, grid = _compressed(spark, sf)
    out = compress.compression_report(held, comp, grid, ITERS)
    return out.select("k", "n_near", "n_core", "n_full", _r("rel_error"), _r("far_rel_error"))


def param_sweep(spark, sf):
    """Reports over rank, oversampling, leaf size and eta; the far error vanishes from the data's rank on.

    Below that rank the SQL knows no error, as it has no factors: it is -1 there.  An eta of 0 stands for touching cells.
    """
    pts = points.nation_points(spark, sf)
    grid = Grid.fit(pts)
    held = cut_lineage(matrices.nation_matrix(spark, sf))
    out = compress.param_sweep(held, pts, grid, SWEEP, ITERS, len(SWEEP))
    known = F.when(F.col("k") >= NATION_RANK, F.round("far_rel_error", 6) + F.lit(0.0)).otherwise(-1.0).alias("far_rel_error")
    some = (F.col("k") < NATION_RANK) & (F.col("far_rel_error") > 1e-6)
    return out.select("k", "p", "leaf", F.coalesce("eta", F.lit(0.0)).alias("eta"), "depth", "n_near", "n_core", known, some.alias("truncated"))


def metric_cover(spark, sf):
    """Blocks of the metric cover of the parts."""
    pts, grid, _ = _unit_part(spark, sf)
    depth = grid.depth_for(LEAF)
    tree = cover.uniform_tree(boxes.boxes(pts, grid, depth), depth)
    return cover.pair_cover(tree, grid, cover.metric_apart(ETAS[1]))


def metric_coverage(spark, sf):
    """Blocks and point pairs per kind and depth for three separations; each covers all pairs."""
    pts, grid, _ = _unit_part(spark, sf)
    depth = grid.depth_for(LEAF)
    tree = cut_lineage(cover.uniform_tree(boxes.boxes(pts, grid, depth), depth))
    out = None
    for eta in ETAS:
        part = cover.cover_census(cover.pair_cover(tree, grid, cover.metric_apart(eta))).withColumn("eta", F.lit(eta))
        out = part if out is None else out.unionByName(part)
    total = out.groupBy("eta").agg(F.sum("n_pairs").alias("covered"))
    whole = F.lit(grid.n).cast("decimal(38,0)") * F.lit(grid.n).cast("decimal(38,0)")
    joined = out.join(total, "eta")
    return joined.select("eta", "kind", F.col("a_depth").alias("depth"), "n_blocks", _as_text("n_pairs"), (F.col("covered") == whole).alias("complete"))


def _uneven(spark, sf, mesh_of) -> tuple[DataFrame, Grid]:
    pts, grid, depth = mesh_of(spark, sf)
    tree = boxes.adaptive_boxes(cut_lineage(boxes.crowded_boxes(pts, grid, LEAF, depth)), grid, LEAF, grid.finest)
    return cover.pair_cover(tree, grid), grid


def uneven_lists(spark, sf):
    """Lists of the parts' adaptive leaves: near, far, and between a leaf and finer boxes."""
    found, _ = _uneven(spark, sf, _part)
    return found


def uneven_coverage(spark, sf):
    """The lists of the events' adaptive tree cover all point pairs."""
    found, grid = _uneven(spark, sf, _events)
    found = cut_lineage(cover.cover_census(found))
    audit = cover.cover_audit(found.select(F.col("n_pairs").alias("n_a"), F.lit(1).alias("n_b")), grid).first()
    per_kind = found.groupBy("kind").agg(F.sum("n_blocks").alias("n_blocks"), F.sum("n_pairs").alias("n_pairs"))
    return per_kind.select("kind", "n_blocks", _as_text("n_pairs"), F.lit(str(audit["expected"])).alias("expected"), F.lit(audit["complete"]).alias("complete"))


def queries() -> dict[str, Query]:
    plain = (
        point_validate, mesh_summary, patch_to_rows, patch_to_cols, domain_box, dyadic_cells, pairwise_distances,
        kernel_block, distance_join, boxes_2d, box_children, leaf_boxes, collapsed_boxes, box_geometry,
        box_tight_bounds, leaf_membership, boxes_at_depth, level_profile, eta_sweep, pattern_cells,
        leaf_pattern_cells, pattern_groups, neighbor_pairs, interaction_pairs, interaction_list, admissible_pairs,
        block_census, block_census_events, admissibility_audit, coverage_audit, sampling_constraints,
        constraint_columns, constraint_violations, constraint_conflicts, constraint_sets, constraint_set_columns,
        conflict_edges, conflict_graph, matrix_from_table, matrix_from_arrays,
        matvec, matvec_thick, rmatvec, rmatvec_thick, difference_matvec, difference_rmatvec, matrix_block,
        block_spectrum, spectral_norm, relative_error, kernel_entries, kernel_matvec, kernel_matvec_fast, gaussian_sketch,
        admissible_sketch, leaf_probe, leaf_blocks, level_sample, apply_truncated, apply_truncated_t,
        peeled_matvec, peeled_rmatvec, column_bases, row_bases, block_orth, two_sample_compress, core_matrix,
        core_matrices, hier_matvec, hier_rmatvec, sample_counts, black_box_bases, black_box_report, probe_blocks,
        compression_report, param_sweep, metric_cover, metric_coverage, uneven_lists, uneven_coverage,
    )
    out = {f.__name__: f for f in plain}
    out |= {"boxes": all_boxes, "boxes_adjacent": box_adjacency, "box_gap": box_gap_query}
    return out
