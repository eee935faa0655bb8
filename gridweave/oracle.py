"""The same questions as ``catalog.queries`` in plain SQL, for side-by-side checks."""

from __future__ import annotations

LEAF = 8
XY = ("x", "y")
XYZ = ("x", "y", "z")

PART = "pts AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"
EVENTS = (
    "pts AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS x, value AS y, CAST(user_id AS DOUBLE) AS z FROM events)"
)
TRADE = """pts AS (
  SELECT p_partkey * 2 AS id, CAST(p_size AS DOUBLE) / 50e0 AS x, (p_retailprice - 900e0) / 100e0 AS y FROM part
  UNION ALL
  SELECT s_suppkey * 2 + 1, CAST(s_nationkey AS DOUBLE) / 25e0, s_acctbal / 10000e0 FROM supplier)"""
UNIT = """raw AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
ext AS (SELECT min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM raw),
pts AS (SELECT id, (x - xl) / (xh - xl) AS x, (y - yl) / (yh - yl) AS y FROM raw, ext)"""


def _keys(axes, prefix=""):
    return [f"{prefix}i{a}" for a in axes]


def _domain(axes):
    cols = []
    for a in axes:
        span = f"max({a}) - min({a})"
        cols.append(
            f"min({a}) AS {a}_lo, max({a}) + CASE WHEN {span} > 0 THEN ({span}) * 1e-9 ELSE 1e-12 END AS {a}_hi"
        )
    return f"dom AS (SELECT count(*) AS n, {', '.join(cols)} FROM pts)"


def _depth(axes, leaf=LEAF, least=0):
    cap = 26 if len(axes) == 2 else 20
    return (
        f"dep AS (SELECT greatest(min(k), {least}) AS d FROM range(0, {cap + 1}) t(k), dom"
        f" WHERE n <= {float(leaf)}::DOUBLE * pow(2::DOUBLE, {len(axes)} * k))"
    )


def _cells(axes):
    cols = ", ".join(
        f"least(greatest(CAST(floor(({a} - {a}_lo) / ({a}_hi - {a}_lo) * pow(2::DOUBLE, d)) AS BIGINT), 0),"
        f" (1::BIGINT << d) - 1) AS i{a}"
        for a in axes
    )
    return f"cells AS (SELECT id, {cols} FROM pts, dom, dep)"


def _mem(axes):
    cols = ", ".join(f"i{a} >> (d - k) AS i{a}" for a in axes)
    return (
        f"mem AS (SELECT id, CAST(k AS INTEGER) AS depth, {cols} FROM cells, dep, range(0, 27) t(k) WHERE k <= d),\n"
        f"box AS (SELECT depth, {', '.join(_keys(axes))}, count(*) AS n FROM mem GROUP BY ALL)"
    )


def _pairs(axes):
    near = " AND ".join(f"abs(a.i{x} - b.i{x}) <= 1" for x in axes)
    up = " AND ".join(f"abs((a.i{x} >> 1) - (b.i{x} >> 1)) <= 1" for x in axes)
    cols = ", ".join([f"a.i{x} AS a_i{x}" for x in axes] + [f"b.i{x} AS b_i{x}" for x in axes])
    return (
        f"pairs AS (SELECT a.depth, {cols}, a.n AS n_a, b.n AS n_b, CASE WHEN {near} THEN 'nei' ELSE 'int' END AS kind"
        f" FROM box a JOIN box b ON a.depth = b.depth AND {up})"
    )


def _code(axes, prefix="", depth="depth"):
    out = f"{prefix}i{axes[0]}"
    for a in axes[1:]:
        out = f"({out} * (1::BIGINT << {depth}) + {prefix}i{a})"
    return out


def _with(source, axes, upto, leaf=LEAF, least=0):
    """CTE chain up to ``dom``, ``cells``, ``box`` or ``pairs``."""
    parts = [source, _domain(axes), _depth(axes, leaf, least), _cells(axes), _mem(axes), _pairs(axes)]
    stop = {"pts": 1, "dom": 2, "cells": 4, "box": 5, "pairs": 6}[upto]
    return "WITH " + ",\n".join(parts[:stop])


def _pattern(axes, period, prefix=""):
    out = "0"
    for a in axes:
        out = f"({out} * {period} + ({prefix}i{a} % {period}))"
    return f"CAST({out} AS INTEGER)"


def _edge(a, prefix, high, depth="depth"):
    cell = f"CAST({prefix}i{a} AS DOUBLE)" + (" + 1e0" if high else "")
    cell = f"({cell})"
    return f"({a}_lo + ({a}_hi - {a}_lo) * {cell} / CAST((1::BIGINT << {depth}) AS DOUBLE))"


def _gap(a):
    return f"greatest({_edge(a, 'a_', False)} - {_edge(a, 'b_', True)}, {_edge(a, 'b_', False)} - {_edge(a, 'a_', True)})"


def _box_gap(axes):
    return "sqrt(" + " + ".join(f"greatest({_gap(a)}, 0e0) * greatest({_gap(a)}, 0e0)" for a in axes) + ")"


def _diam(axes, depth="depth"):
    total = " + ".join(f"({a}_hi - {a}_lo) * ({a}_hi - {a}_lo)" for a in axes)
    return f"(sqrt({total}) / CAST((1::BIGINT << {depth}) AS DOUBLE))"


def _gauss(width, seed, key):
    """Standard normals from md5 of ``seed:key:q``; ``key`` is a SQL text expression."""
    out = []
    for q in range((width + 3) // 4):
        digest = f"md5('{seed}:' || {key} || ':{q}')"
        u = [f"((CAST('0x' || substr({digest}, {8 * w + 1}, 8) AS BIGINT) + 0.5e0) / 4294967296e0)" for w in range(4)]
        for w in (0, 2):
            radius = f"sqrt(-2e0 * ln({u[w]}))"
            angle = f"(2e0 * pi() * {u[w + 1]})"
            out += [f"({radius} * cos({angle}))", f"({radius} * sin({angle}))"]
    return out[:width]


def _r(expr, name, digits=6):
    return f"round({expr}, {digits}) + 0e0 AS {name}"


SUPPLY = "m AS (SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL)"
COARSE = "c AS (SELECT i, j, CAST(floor(v / 10e0) * 10e0 AS DOUBLE) AS v FROM m)"
XJ = "x AS (SELECT p_partkey AS j, 1e0 / (1e0 + p_partkey) AS x FROM part)"
XI = "x AS (SELECT s_suppkey AS i, 1e0 / (1e0 + s_suppkey) AS x FROM supplier)"
TRADED = "traded AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem)"

TRADE_MATRIX = """trade AS (
  SELECT l_partkey * 2 AS p, l_suppkey * 2 + 1 AS s, sum(l_quantity) AS q, sum(l_quantity * l_linenumber) AS w
  FROM lineitem GROUP BY ALL),
m AS (
  SELECT p * 2 AS i, s AS j, q AS v FROM trade UNION ALL SELECT p * 2 + 1, s, w FROM trade
  UNION ALL SELECT s * 2, p, q FROM trade UNION ALL SELECT s * 2 + 1, p, w FROM trade)"""

NATIONS = """pts AS (
  SELECT p_partkey * 2 AS id, CAST(p_size AS DOUBLE) / 50e0 AS x, (p_retailprice - 900e0) / 100e0 AS y FROM part
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT) * 2 + 1, CAST(n_nationkey % 5 AS DOUBLE) / 5e0 + 1e-1,
    CAST(n_nationkey // 5 AS DOUBLE) / 5e0 + 1e-1 FROM nation)"""
NATION_MATRIX = """trade AS (
  SELECT l_partkey * 2 AS p, CAST(s_nationkey AS BIGINT) * 2 + 1 AS n, sum(l_quantity) AS q,
    sum(l_quantity * l_linenumber) AS w
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
m AS (
  SELECT p * 2 AS i, n AS j, q AS v FROM trade UNION ALL SELECT p * 2 + 1, n, w FROM trade
  UNION ALL SELECT n * 2, p, q FROM trade)"""

# Block of each entry: the first depth at which the cells no longer touch (or the rule given), else the last depth.
TOUCHED = "abs((r.ix >> (d - k)) - (c.ix >> (d - k))) > 1 OR abs((r.iy >> (d - k)) - (c.iy >> (d - k))) > 1"
LOCATED_BY = """apart AS (
  SELECT m.i, m.j, min(k) AS sep
  FROM m JOIN cells r ON r.id = m.i // 2 JOIN cells c ON c.id = m.j, dep, dom, range(2, 27) t(k)
  WHERE k <= d AND ({rule})
  GROUP BY ALL),
held AS (
  SELECT CAST(coalesce(sep, d) AS INTEGER) AS depth, m.i, m.j, m.v, sep IS NOT NULL AS far,
    (r.ix >> (d - coalesce(sep, d))) * (1::BIGINT << coalesce(sep, d)) + (r.iy >> (d - coalesce(sep, d))) AS a,
    (c.ix >> (d - coalesce(sep, d))) * (1::BIGINT << coalesce(sep, d)) + (c.iy >> (d - coalesce(sep, d))) AS b
  FROM m JOIN cells r ON r.id = m.i // 2 JOIN cells c ON c.id = m.j
  LEFT JOIN apart ON apart.i = m.i AND apart.j = m.j, dep)"""
LOCATED = LOCATED_BY.replace("{rule}", TOUCHED)

MEANS = """coded AS (SELECT id, depth, ix * (1::BIGINT << depth) + iy AS code FROM mem),
size AS (SELECT depth, code, count(*) AS n FROM coded GROUP BY ALL),
mean AS (
  SELECT h.depth, h.a, h.b, sum(h.v) / (any_value(p.n) * 2 * any_value(q.n)) AS core
  FROM held h JOIN size p ON p.depth = h.depth AND p.code = h.a JOIN size q ON q.depth = h.depth AND q.code = h.b
  WHERE h.far {last} GROUP BY h.depth, h.a, h.b)"""


def _trade_with(upto="box"):
    return _with(TRADE, XY, upto, LEAF, 2) + ",\n" + TRADE_MATRIX + ",\n" + LOCATED


def _power(prefix, matrix, iters, seed=0):
    """CTE chain of power steps on ``matrix``; ``{prefix}norm`` has the result."""
    start = _gauss(1, seed, "j")[0]
    out = [
        f"{prefix}s AS MATERIALIZED (SELECT j, {start} AS x FROM (SELECT DISTINCT j FROM {matrix}))",
        f"{prefix}x0 AS MATERIALIZED (SELECT j, x / sqrt((SELECT sum(x * x) FROM {prefix}s)) AS x FROM {prefix}s)",
    ]
    for k in range(iters):
        out += [
            f"{prefix}y{k} AS MATERIALIZED (SELECT i, sum(v * x) AS y FROM {matrix} JOIN {prefix}x{k} USING (j) GROUP BY i)",
            f"{prefix}g{k} AS MATERIALIZED (SELECT j, sum(v * y) AS g FROM {matrix} JOIN {prefix}y{k} USING (i) GROUP BY j)",
            f"{prefix}x{k + 1} AS MATERIALIZED (SELECT j, g / sqrt((SELECT sum(g * g) FROM {prefix}g{k})) AS x FROM {prefix}g{k})",
        ]
    last = iters - 1
    out.append(
        f"{prefix}norm AS (SELECT sqrt(greatest(sum(x * g), 0)) AS v FROM {prefix}x{last} JOIN {prefix}g{last} USING (j))"
    )
    return ",\n".join(out)


def _long(inner, keys, cols, digits=6):
    """Turn the columns ``y0..`` of ``inner`` into (c, y) rows."""
    parts = [
        f"SELECT {keys}, CAST({c} AS INTEGER) AS c, {_r(f'y{c}', 'y', digits)} FROM wide" for c in range(cols)
    ]
    return f"wide AS ({inner})\n" + "\nUNION ALL ".join(parts)


def _point_queries() -> dict[str, str]:
    ev, kz = EVENTS, ", ".join(_keys(XYZ))
    bad = {
        "null_id": "id IS NULL",
        "null_coordinate": "x IS NULL OR y IS NULL OR z IS NULL",
        "nan_coordinate": "isnan(x) OR isnan(y) OR isnan(z)",
        "infinite_coordinate": "isinf(x) OR isinf(y) OR isinf(z)",
        "bad_len": "FALSE",
    }
    dup = "SELECT 'duplicate_id' AS reason, CAST(count(id) - count(DISTINCT id) AS BIGINT) AS n_rows FROM pts"
    rest = [f"SELECT '{k}', CAST(count(*) FILTER (WHERE {v}) AS BIGINT) FROM pts" for k, v in bad.items()]
    edges = "\nUNION ALL ".join(f"SELECT '{a}' AS axis, {a}_lo AS lo, {a}_hi AS hi FROM dom" for a in XYZ)
    dist = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"
    ends = "FROM traded t JOIN pts p ON p.id = t.a JOIN pts q ON q.id = t.b"
    den = f"({dist} + 1e-3)"
    k00 = f"(1e0 + (p.x - q.x) * (p.x - q.x) / ({den} * {den})) / ({den} * {den})"
    k10 = f"(0e0 + (p.y - q.y) * (p.x - q.x) / ({den} * {den})) / ({den} * {den})"
    place = "place AS (SELECT x, y, min(id) AS loc, count(*) AS copies FROM pts GROUP BY x, y)"
    return {
        "point_validate": f"WITH {ev} {dup}\nUNION ALL " + "\nUNION ALL ".join(rest),
        "mesh_summary": "SELECT CAST(count(*) AS BIGINT) AS n_patches, CAST(count(*) * 2 AS BIGINT) AS n_rows,"
        " CAST(count(*) AS BIGINT) AS n_cols, CAST(2 AS INTEGER) AS d, CAST(2 AS INTEGER) AS dof_row,"
        " CAST(1 AS INTEGER) AS dof_col FROM part",
        "patch_to_rows": "SELECT event_id AS id, event_id * 3 + r AS i FROM events, range(0, 3) t(r)",
        "patch_to_cols": "SELECT event_id AS id, event_id * 2 + c AS j FROM events, range(0, 2) t(c)",
        "domain_box": _with(ev, XYZ, "dom") + "\n" + edges,
        "dyadic_cells": _with(ev, XYZ, "cells") + f"\nSELECT id, {kz} FROM cells",
        "pairwise_distances": f"WITH {TRADE}, {TRADED} SELECT t.a, t.b, {_r(dist, 'distance')} {ends}",
        "kernel_block": f"WITH {TRADE}, {TRADED} SELECT t.a, t.b, {_r(k00, 'k00', 4)}, {_r(k10, 'k10', 4)} {ends}",
        "distance_join": f"WITH {PART}, {place} SELECT p.loc AS a, q.loc AS b, p.copies AS a_copies,"
        f" q.copies AS b_copies, {_r(dist, 'distance')} FROM place p JOIN place q ON p.loc < q.loc AND {dist} <= 1e0",
    }


def _box_queries() -> dict[str, str]:
    ev, kz, kp = _with(EVENTS, XYZ, "box"), ", ".join(_keys(XYZ)), ", ".join(_keys(XY))
    part = _with(PART, XY, "box")
    part_dom = part
    up = " AND ".join(f"b.i{a} >> 1 = p.i{a}" for a in XYZ)
    up2 = " AND ".join(f"b.i{a} >> 1 = p.i{a}" for a in XY)
    # Every step is kept once, and parents are met on plain columns.
    up_keys = ", ".join(f"i{a} >> 1 AS u{a}" for a in XYZ)
    deep_keys = ", ".join(f"f{a} >> (20 - k) AS i{a}" for a in XYZ)
    fine_keys = ", ".join(
        f"least(greatest(CAST(floor(({a} - {a}_lo) / ({a}_hi - {a}_lo) * 1048576e0) AS BIGINT), 0), 1048575) AS f{a}" for a in XYZ
    )
    deep = (
        _with(EVENTS, XYZ, "dom") + f",\nfine AS MATERIALIZED (SELECT id, {fine_keys} FROM pts, dom),\n"
        f"mem AS MATERIALIZED (SELECT id, CAST(k AS INTEGER) AS depth, {deep_keys} FROM fine, range(0, 21) t(k)),\n"
        f"box AS MATERIALIZED (SELECT depth, depth - 1 AS up, {kz}, {up_keys}, count(*) AS n FROM mem GROUP BY ALL)"
    )
    leaves = (
        f"leaf AS MATERIALIZED (SELECT b.depth, {', '.join(f'b.i{a}' for a in XYZ)}, b.n FROM box b JOIN box p ON p.depth = b.up"
        f" AND {' AND '.join(f'p.i{a} = b.u{a}' for a in XYZ)} WHERE p.n >= {LEAF} AND (b.n < {LEAF} OR b.depth = 20)"
        f" UNION ALL SELECT depth, {kz}, n FROM box WHERE depth = 0 AND n < {LEAF})"
    )
    geo = []
    for a in XY:
        lo, hi = _edge(a, "", False), _edge(a, "", True)
        geo += [_r(lo, f"{a}_lo"), _r(hi, f"{a}_hi"), _r(f"({lo} + {hi}) * 0.5e0", f"{a}_mid")]
    tight = (
        "tight AS (SELECT depth, {k}, count(*) AS n, {b} FROM mem JOIN pts USING (id) GROUP BY depth, {k})"
    )
    event_tight = tight.format(k=kz, b=", ".join(f"min({a}) AS {a}_lo, max({a}) AS {a}_hi" for a in XYZ))
    part_tight = tight.format(k=kp, b=", ".join(f"min({a}) AS t{a}_lo, max({a}) AS t{a}_hi" for a in XY))
    event_cols = [f"{_r(f'{a}_lo', f'{a}_lo', 3)}, {_r(f'{a}_hi', f'{a}_hi', 3)}, {_r(f'({a}_lo + {a}_hi) * 0.5e0', f'{a}_mid', 3)}" for a in XYZ]
    event_diam ="sqrt(" + " + ".join(f"({a}_hi - {a}_lo) * ({a}_hi - {a}_lo)" for a in XYZ) + ")"
    part_diam = "sqrt(" + " + ".join(f"(t{a}_hi - t{a}_lo) * (t{a}_hi - t{a}_lo)" for a in XY) + ")"
    gamma = f"{part_diam} / {_diam(XY)}"
    finest = _with(PART, XY, "dom") + ",\ndep AS (SELECT 26 AS d),\n" + _cells(XY) + ",\n" + _mem(XY)
    collapsed = (
        f"kept AS (SELECT b.* FROM box b LEFT JOIN box p ON p.depth = b.depth - 1 AND {up2}"
        " WHERE b.depth = 0 OR (p.n >= 2 AND b.n < p.n)),\n"
        "link AS (SELECT b.depth, b.ix, b.iy, b.n, CAST(count(p.depth) AS INTEGER) AS level,"
        " CAST(coalesce(max(p.depth), -1) AS INTEGER) AS up_depth FROM kept b LEFT JOIN kept p ON p.depth < b.depth"
        " AND b.ix >> (b.depth - p.depth) = p.ix AND b.iy >> (b.depth - p.depth) = p.iy GROUP BY ALL)"
        "\nSELECT l.depth, l.ix, l.iy, l.n, l.level, l.up_depth, count(c.depth) AS n_children,"
        " count(c.depth) = 0 AS is_leaf FROM link l LEFT JOIN link c ON c.up_depth = l.depth"
        " AND c.ix >> (c.depth - l.depth) = l.ix AND c.iy >> (c.depth - l.depth) = l.iy GROUP BY ALL"
    )
    targets = "(VALUES (1e-1), (1e-2), (1e-3)) g(target)"
    return {
        "boxes": f"{ev}\nSELECT depth, {kz}, n FROM box",
        "boxes_2d": f"{part}\nSELECT depth, {kp}, n FROM box",
        "box_children": f"{ev}\nSELECT b.depth, {', '.join(f'b.i{a}' for a in XYZ)}, b.n, p.depth AS p_depth,"
        f" {', '.join(f'p.i{a} AS p_i{a}' for a in XYZ)}, p.n AS p_n FROM box b JOIN box p ON p.depth = b.depth - 1 AND {up}",
        "leaf_boxes": f"{deep},\n{leaves}\nSELECT depth, {kz}, n FROM leaf",
        "leaf_membership": f"{deep},\n{leaves}\nSELECT m.id, l.depth, {', '.join(f'l.i{a}' for a in XYZ)} FROM mem m"
        f" JOIN leaf l ON l.depth = m.depth AND {' AND '.join(f'l.i{a} = m.i{a}' for a in XYZ)}",
        "collapsed_boxes": f"{finest},\n{collapsed}",
        "box_geometry": f"{part_dom}\nSELECT depth, {kp}, {', '.join(geo)}, {_r(_diam(XY), 'diam')} FROM box, dom",
        "box_tight_bounds": f"{ev},\n{event_tight}\nSELECT depth, {kz}, n, {', '.join(event_cols)},"
        f" {_r(event_diam, 'diam', 3)} FROM tight",
        "boxes_at_depth": f"{ev}\nSELECT depth, {kz}, n FROM box, dep WHERE depth = d",
        "level_profile": f"{ev}\nSELECT depth, count(*) AS n_boxes, CAST(sum(n) AS BIGINT) AS n_points, min(n) AS min_n,"
        " max(n) AS max_n FROM box GROUP BY depth",
        "eta_sweep": f"{part},\n{part_tight}\nSELECT depth, {kp}, target, {_r(gamma, 'gamma')},"
        f" {_r(f'greatest({gamma} * (1e0 / pow(target, 0.5e0) - 1e0), 0e0)', 'eta')} FROM tight, dom, {targets}",
        "pattern_cells": f"{ev}\nSELECT depth, {kz}, n, {_pattern(XYZ, 6)} AS pattern FROM box",
        "leaf_pattern_cells": f"{ev}\nSELECT depth, {kz}, n, {_pattern(XYZ, 3)} AS pattern FROM box",
        "pattern_groups": f"{ev}\nSELECT depth, {_pattern(XYZ, 6)} AS pattern, count(*) AS n_boxes,"
        " CAST(sum(n) * 2 AS BIGINT) AS n_cols FROM box GROUP BY ALL",
    }


def _pair_queries() -> dict[str, str]:
    part, ev = _with(PART, XY, "pairs"), _with(EVENTS, XYZ, "pairs")
    k2 = "a_ix, a_iy, b_ix, b_iy"
    k3 = "a_ix, a_iy, a_iz, b_ix, b_iy, b_iz"
    gap = _box_gap(XY)
    adj = " AND ".join(f"{_gap(a)} <= 1e-9" for a in XY)
    census = (
        "per AS (SELECT depth, count(*) AS n_boxes FROM box GROUP BY depth),\n"
        "cnt AS (SELECT depth, count(*) FILTER (WHERE kind = 'nei') AS nei, count(*) FILTER (WHERE kind = 'int') AS int"
        " FROM pairs GROUP BY depth)\nSELECT depth, n_boxes, nei, int, CAST(CAST(n_boxes AS HUGEINT) * n_boxes - nei - int AS VARCHAR) AS absent"
        " FROM per JOIN cnt USING (depth)"
    )
    coded = f"coded AS (SELECT depth, {_code(XY, 'a_')} AS alpha, {_code(XY, 'b_')} AS beta, kind FROM pairs)"
    zero = (
        "SELECT p.depth, p.alpha, p.beta, string_agg(CAST(z.beta AS VARCHAR), ',' ORDER BY z.beta) AS zero_boxes"
        " FROM coded p JOIN coded z ON z.depth = p.depth AND z.alpha = p.alpha AND z.beta <> p.beta"
        " WHERE p.kind = 'int' GROUP BY p.depth, p.alpha, p.beta"
    )
    cols = (
        f"cols AS (SELECT depth, {_code(XY)} AS code, count(*) AS n_cols, CAST(sum(id) AS BIGINT) AS col_sum"
        " FROM mem GROUP BY ALL)\n"
        "SELECT p.depth, p.alpha, p.beta, any_value(r.n_cols) AS n_random, CAST(any_value(r.col_sum) AS VARCHAR) AS random_sum,"
        " CAST(sum(c.n_cols) AS BIGINT) AS n_zero, CAST(sum(c.col_sum) AS VARCHAR) AS zero_sum FROM coded p"
        " JOIN coded z ON z.depth = p.depth AND z.alpha = p.alpha AND z.beta <> p.beta"
        " JOIN cols c ON c.depth = z.depth AND c.code = z.beta JOIN cols r ON r.depth = p.depth AND r.code = p.beta"
        " WHERE p.kind = 'int' GROUP BY p.depth, p.alpha, p.beta"
    )
    sets = (
        f"cons AS ({zero}),\nsets AS (SELECT DISTINCT depth, beta, zero_boxes FROM cons),\n"
        "rnd AS (SELECT depth, beta AS box, count(*) AS r FROM sets GROUP BY ALL),\n"
        "zed AS (SELECT depth, CAST(unnest(string_split(zero_boxes, ',')) AS BIGINT) AS box FROM sets),\n"
        "zc AS (SELECT depth, box, count(*) AS z FROM zed GROUP BY ALL)\n"
        "SELECT depth, box, coalesce(r, 0) AS n_random_sets, coalesce(z, 0) AS n_zero_sets,"
        " coalesce(r, 0) * coalesce(z, 0) AS n_conflicts FROM rnd FULL JOIN zc USING (depth, box)"
    )
    violations = (
        f"pat AS (SELECT depth, {', '.join(_keys(XYZ, 'a_'))}, {_pattern(XYZ, 6, 'b_')} AS pattern, count(*) AS boxes,"
        " count(*) FILTER (WHERE kind = 'int') AS random FROM pairs GROUP BY ALL)\n"
        "SELECT depth, CAST(sum(random) AS BIGINT) AS n_constraints, CAST(sum(random * (boxes - 1)) AS BIGINT)"
        " AS n_violations FROM pat GROUP BY depth"
    )
    requests = (
        f"own AS (SELECT depth, {_code(XY)} AS code, n, ix, iy FROM box),\n"
        "req AS (SELECT depth, alpha, depth AS beta_depth, beta FROM coded UNION ALL"
        " SELECT depth, code, depth, ((1::BIGINT << depth) - 1 - ix) * (1::BIGINT << depth) + (1::BIGINT << depth) - 1 - iy FROM own UNION ALL"
        " SELECT depth, code, depth - 1, (ix >> 1) * (1::BIGINT << (depth - 1)) + (iy >> 1) FROM own WHERE depth > 0),\n"
        "placed AS (SELECT r.*, CASE WHEN o.code IS NULL THEN 'no_box' WHEN r.beta_depth <> r.depth THEN 'depths_differ'"
        " WHEN r.alpha = r.beta THEN 'own' ELSE coalesce(c.kind, 'out') END AS place FROM req r"
        " LEFT JOIN own o ON o.depth = r.beta_depth AND o.code = r.beta"
        " LEFT JOIN coded c ON c.depth = r.depth AND c.alpha = r.alpha AND c.beta = r.beta),\n"
        "served AS (SELECT DISTINCT depth, alpha, beta FROM placed WHERE place NOT IN ('no_box', 'depths_differ'))"
    )
    request_sets = (
        f"{requests},\nzs AS (SELECT s.depth, s.alpha, s.beta, coalesce(string_agg(CAST(c.beta AS VARCHAR), ',' ORDER BY c.beta), '') AS zero_boxes"
        " FROM served s LEFT JOIN coded c ON c.depth = s.depth AND c.alpha = s.alpha AND c.beta <> s.beta GROUP BY ALL)\n"
        "SELECT p.*, coalesce(z.zero_boxes, '') AS zero_boxes FROM placed p LEFT JOIN zs z ON z.depth = p.depth AND z.alpha = p.alpha AND z.beta = p.beta"
        " AND p.place NOT IN ('no_box', 'depths_differ')"
    )
    request_cols = (
        f"{requests},\ncols AS (SELECT depth, {_code(XY)} AS code, count(*) AS n_cols, sum(id) AS col_sum FROM mem GROUP BY ALL),\n"
        "zs AS (SELECT s.depth, s.alpha, s.beta, CAST(coalesce(sum(k.n_cols), 0) AS BIGINT) AS n_zero, coalesce(sum(k.col_sum), 0) AS zero_sum"
        " FROM served s LEFT JOIN coded c ON c.depth = s.depth AND c.alpha = s.alpha AND c.beta <> s.beta"
        " LEFT JOIN cols k ON k.depth = c.depth AND k.code = c.beta GROUP BY s.depth, s.alpha, s.beta)\n"
        "SELECT p.*, coalesce(r.n_cols, 0) AS n_random, CAST(coalesce(r.col_sum, 0) AS VARCHAR) AS random_sum, coalesce(z.n_zero, 0) AS n_zero,"
        " CAST(coalesce(z.zero_sum, 0) AS VARCHAR) AS zero_sum"
        " FROM placed p LEFT JOIN zs z ON z.depth = p.depth AND z.alpha = p.alpha AND z.beta = p.beta"
        " AND p.place NOT IN ('no_box', 'depths_differ') LEFT JOIN cols r ON r.depth = z.depth AND r.code = z.beta"
    )
    wide = _with(PART, XY, "pairs", 32)
    vertices = (
        f"{coded},\nlst AS (SELECT depth, alpha, string_agg(CAST(beta AS VARCHAR), ',' ORDER BY beta) AS boxes FROM coded GROUP BY ALL),\n"
        "named AS (SELECT depth, alpha, boxes, min(alpha) OVER (PARTITION BY depth, boxes) AS list_of FROM lst),\n"
        "vert AS MATERIALIZED (SELECT c.depth, c.beta, n.list_of, count(*) AS n_blocks FROM coded c JOIN named n USING (depth, alpha)"
        " WHERE c.kind = 'int' GROUP BY ALL),\n"
        # A list is that of the target that names it.
        "zero AS MATERIALIZED (SELECT v.depth, v.beta, v.list_of, c.beta AS box FROM vert v JOIN coded c ON c.depth = v.depth AND c.alpha = v.list_of AND c.beta <> v.beta),\n"
        "edge AS (SELECT DISTINCT v.depth, least((v.beta, v.list_of), (z.beta, z.list_of)) AS p, greatest((v.beta, v.list_of), (z.beta, z.list_of)) AS q"
        " FROM vert v JOIN zero z ON z.depth = v.depth AND z.box = v.beta),\n"
        "flat AS (SELECT depth, p[1] AS a_beta, p[2] AS a_list, q[1] AS b_beta, q[2] AS b_list FROM edge)"
    )
    degrees = (
        "ends AS (SELECT depth, a_beta AS beta, a_list AS list_of FROM flat UNION ALL SELECT depth, b_beta, b_list FROM flat),\n"
        "deg AS (SELECT depth, beta, list_of, count(*) AS degree FROM ends GROUP BY ALL)\n"
        "SELECT depth, beta, list_of, n_blocks, coalesce(degree, 0) AS degree FROM vert LEFT JOIN deg USING (depth, beta, list_of)"
    )
    full = "one AS (SELECT b.ix, b.iy FROM box b, dep WHERE b.depth = d ORDER BY b.n DESC, b.ix, b.iy LIMIT 1)"
    admissible = f"{gap} >= 0.5e0 * {_diam(XY)}"
    return {
        "neighbor_pairs": f"{ev}\nSELECT depth, {k3}, n_a, n_b FROM pairs WHERE kind = 'nei'",
        "interaction_pairs": f"{ev}\nSELECT depth, {k3}, n_a, n_b FROM pairs WHERE kind = 'int'",
        "interaction_list": f"{part},\n{full}\nSELECT depth, b_ix AS ix, b_iy AS iy, n_b AS n FROM pairs, one, dep"
        " WHERE depth = d AND kind = 'int' AND a_ix = one.ix AND a_iy = one.iy",
        "boxes_adjacent": f"{part}\nSELECT depth, {k2}, {adj} AS adjacent FROM pairs, dom",
        "box_gap": f"{part}\nSELECT depth, {k2}, {_r(gap, 'gap')} FROM pairs, dom",
        "admissible_pairs": f"{part}\nSELECT depth, {k2}, kind, {_r(gap, 'gap')} FROM pairs, dom WHERE {admissible}",
        "block_census": f"{part},\n{census}",
        "block_census_events": f"{ev},\n{census}",
        "admissibility_audit": f"{part}\nSELECT depth, kind, {admissible} AS admissible, count(*) AS n_pairs"
        " FROM pairs, dom GROUP BY ALL",
        "coverage_audit": f"{part}\nSELECT CAST(sum(n_a * n_b) AS VARCHAR) AS covered,"
        " CAST((SELECT CAST(n AS HUGEINT) * n FROM dom) AS VARCHAR) AS expected, sum(n_a * n_b) = (SELECT n * n FROM dom) AS complete"
        " FROM pairs, dep WHERE kind = 'int' OR depth = d",
        "sampling_constraints": f"{part},\n{coded}\n{zero}",
        "constraint_columns": f"{part},\n{coded},\n{cols}",
        "constraint_violations": f"{ev},\n{violations}",
        "constraint_conflicts": f"{part},\n{coded},\n{sets}",
        "constraint_sets": f"{part},\n{coded},\n{request_sets}",
        "constraint_set_columns": f"{part},\n{coded},\n{request_cols}",
        "conflict_edges": f"{wide},\n{vertices}\nSELECT * FROM flat",
        "conflict_graph": f"{wide},\n{vertices},\n{degrees}",
    }


def _matrix_queries() -> dict[str, str]:
    thick = "SELECT {k}, sum(v * x) AS y0, sum(v * (x * x)) AS y1, sum(v * (x * x * x)) AS y2 FROM m JOIN x USING ({o}) GROUP BY {k}"
    diff = "dm AS (SELECT i, j, v FROM c UNION ALL SELECT i, j, -v FROM m)"
    iters = 20
    return {
        "matrix_from_table": f"WITH {SUPPLY} SELECT i, j, v FROM m",
        "matrix_from_arrays": "SELECT vec_id AS i, CAST(k - 1 AS BIGINT) AS j, CAST(embedding[k] AS DOUBLE) AS v"
        " FROM embeddings, range(1, 65) t(k)",
        "matvec": f"WITH {SUPPLY}, {XJ} SELECT i, {_r('sum(v * x)', 'y')} FROM m JOIN x USING (j) GROUP BY i",
        "rmatvec": f"WITH {SUPPLY}, {XI} SELECT j, {_r('sum(v * x)', 'y')} FROM m JOIN x USING (i) GROUP BY j",
        "matvec_thick": f"WITH {SUPPLY}, {XJ}, " + _long(thick.format(k="i", o="j"), "i", 3),
        "rmatvec_thick": f"WITH {SUPPLY}, {XI}, " + _long(thick.format(k="j", o="i"), "j", 3),
        "difference_matvec": f"WITH {SUPPLY}, {COARSE}, {XJ}, {diff} SELECT i, {_r('sum(v * x)', 'y')}"
        " FROM dm JOIN x USING (j) GROUP BY i",
        "difference_rmatvec": f"WITH {SUPPLY}, {COARSE}, {XI}, {diff} SELECT j, {_r('sum(v * x)', 'y')}"
        " FROM dm JOIN x USING (i) GROUP BY j",
        "matrix_block": f"WITH {SUPPLY} SELECT i, j, v FROM m WHERE i IN (SELECT s_suppkey FROM supplier WHERE"
        " s_acctbal < 0) AND j IN (SELECT p_partkey FROM part WHERE p_size > 25)",
        "block_spectrum": "WITH e AS (SELECT label, vec_id, k, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(k)),"
        " g AS (SELECT a.label, a.k AS p, b.k AS q, sum(a.v * b.v) AS g FROM e a JOIN e b USING (vec_id) GROUP BY ALL),"
        " s AS (SELECT label, round(sum(g) FILTER (WHERE p = q), 4) AS energy, round(sum(g * g), 4) AS fourth FROM g GROUP BY label)"
        " SELECT label, n_rows, energy, fourth, TRUE AS falling FROM s JOIN (SELECT label, count(*) AS n_rows FROM embeddings GROUP BY label) USING (label)",
        "spectral_norm": f"WITH {SUPPLY},\n{_power('p', 'm', iters)}\nSELECT CAST({iters} AS INTEGER) AS n_iters,"
        " round(v, 4) AS norm FROM pnorm",
        "relative_error": f"WITH {SUPPLY}, {COARSE}, {diff},\n{_power('p', 'm', iters)},\n{_power('q', 'dm', iters)}\n"
        f"SELECT CAST({iters} AS INTEGER) AS n_iters, round(qnorm.v / pnorm.v, 6) AS rel_error FROM pnorm, qnorm",
    }


def _kernel_queries() -> dict[str, str]:
    dist = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"
    # Smallest depth whose fullest box has at most 8 distinct locations.
    needed = f"""{_domain(XY)},
place AS (SELECT x, y, min(id) AS loc, count(*) AS copies FROM pts GROUP BY x, y),
fine AS (SELECT loc, {', '.join(
        f"CAST(floor(({a} - {a}_lo) / ({a}_hi - {a}_lo) * pow(2::DOUBLE, 26)) AS BIGINT) AS f{a}" for a in XY)}
  FROM place, dom),
full_at AS (SELECT k, fx >> (26 - k) AS cx, fy >> (26 - k) AS cy, count(*) AS n FROM fine, range(0, 27) t(k) GROUP BY ALL),
dep AS (SELECT coalesce(min(k), 26) AS d FROM (SELECT k, max(n) AS n FROM full_at GROUP BY k) WHERE n <= 8),
spot AS (SELECT p.*, f.fx >> (26 - d) AS ix, f.fy >> (26 - d) AS iy FROM place p JOIN fine f USING (loc), dep)"""
    cols = "p.loc AS a, q.loc AS b, p.copies AS a_copies, q.copies AS b_copies"
    den = f"({dist} + 1e-3)"
    k00 = f"(1e0 + (p.x - q.x) * (p.x - q.x) / ({den} * {den})) / ({den} * {den})"
    k10 = f"(0e0 + (p.y - q.y) * (p.x - q.x) / ({den} * {den})) / ({den} * {den})"
    whole = (
        f"WITH {UNIT}, ker AS (SELECT p.id, {k00} / (1e0 + q.id) AS y0, {k10} / (1e0 + q.id) AS y1"
        " FROM pts p, pts q), sums AS (SELECT id, sum(y0) AS y0, sum(y1) AS y1 FROM ker GROUP BY id)"
        " SELECT id * 2 AS i, {a} FROM sums UNION ALL SELECT id * 2 + 1, {b} FROM sums"
    )
    return {
        "kernel_matvec_fast": whole.replace("{a}", _r("y0", "y", 1)).replace("{b}", _r("y1", "y", 1)),
        "kernel_entries": f"WITH {UNIT},\n{needed}\nSELECT {cols}, {_r(k00, 'k00', 2)}, {_r(k10, 'k10', 2)}"
        " FROM spot p JOIN spot q ON abs(p.ix - q.ix) <= 1 AND abs(p.iy - q.iy) <= 1",
        "kernel_matvec": f"WITH {UNIT}, ker AS (SELECT p.id, {k00} / (1e0 + q.id) AS y0, {k10} / (1e0 + q.id) AS y1"
        " FROM pts p, pts q), sums AS (SELECT id, sum(y0) AS y0, sum(y1) AS y1 FROM ker GROUP BY id)"
        f" SELECT id * 2 AS i, {_r('y0', 'y', 3)} FROM sums UNION ALL SELECT id * 2 + 1, {_r('y1', 'y', 3)} FROM sums",
    }


def _sketch_queries() -> dict[str, str]:
    def named(values):
        return ", ".join(f"{v} AS y{c}" for c, v in enumerate(values))

    ev = _with(EVENTS, XYZ, "box")
    cols = (
        f"act AS (SELECT depth, {_pattern(XYZ, 6)} AS pattern, {_code(XYZ)} AS box, id * 2 + c AS j"
        " FROM mem, range(0, 2) t(c) WHERE depth >= 2),\n"
    )
    bits = " | ".join(
        f"(((i{a} >> {b}) & 1) << {3 * b + 2 - k})" for b in range(20) for k, a in enumerate(XYZ)
    )
    probe = (
        f"own AS (SELECT m.*, {_pattern(XYZ, 3)} AS pattern, {_code(XYZ)} AS box, ({bits}) AS z"
        " FROM mem m, dep WHERE m.depth = d)\n"
        "SELECT pattern, box, id * 2 + c AS j, CAST(r * 2 + c AS BIGINT) AS slot FROM (SELECT *, row_number() OVER"
        " (PARTITION BY pattern ORDER BY z, id) - 1 AS r FROM own), range(0, 2) t(c)"
    )
    return {
        "gaussian_sketch": "WITH " + _long(f"SELECT p_partkey AS j, {named(_gauss(5, 7, 'p_partkey'))} FROM part", "j", 5),
        "admissible_sketch": ev + ",\n" + cols
        + _long(f"SELECT *, {named(_gauss(3, 7, "depth || ':' || j"))} FROM act", "depth, pattern, box, j", 3),
        "leaf_probe": f"{ev},\n{probe}",
        "sample_counts": f"{ev},\nper AS (SELECT depth, count(DISTINCT {_pattern(XYZ, 6)}) * 5 AS n FROM box GROUP BY depth),\n"
        f"ful AS (SELECT max(n) * 2 AS w FROM box, dep WHERE depth = d GROUP BY {_pattern(XYZ, 3)})\n"
        "SELECT depth, CASE WHEN depth >= 2 THEN n ELSE 0 END AS n_forward, CASE WHEN depth >= 2 THEN n ELSE 0 END AS n_adjoint,"
        " CASE WHEN depth = d THEN (SELECT CAST(sum(w) AS BIGINT) FROM ful) ELSE 0 END AS n_probe FROM per, dep",
    }


def _factor_queries() -> dict[str, str]:
    base = _trade_with()
    means = MEANS.format(last="")
    xj = "x AS (SELECT id AS j, 1e0 / (1e0 + id) AS x FROM pts)"
    xi = "x AS (SELECT id * 2 + r AS i, 1e0 / (1e0 + (id * 2 + r)) AS x FROM pts, range(0, 2) t(r))"
    by_b = "sb AS (SELECT c.depth, c.code AS b, sum(x.x) AS s FROM coded c JOIN x ON x.j = c.id GROUP BY ALL)"
    by_a = "sa AS (SELECT c.depth, c.code AS a, sum(x.x) AS s FROM coded c JOIN x ON x.i // 2 = c.id GROUP BY ALL)"
    rows = (
        "ap AS (SELECT c.id * 2 + r AS i, sum(core * s) AS y FROM mean JOIN sb USING (depth, b) JOIN coded c"
        " ON c.depth = mean.depth AND c.code = mean.a, range(0, 2) t(r) GROUP BY ALL)"
    )
    cols = (
        "ap AS (SELECT c.id AS j, sum(core * s) AS y FROM mean JOIN sa USING (depth, a) JOIN coded c"
        " ON c.depth = mean.depth AND c.code = mean.b GROUP BY ALL)"
    )
    peel = (
        "both_ AS (SELECT {k}, sum(v * x) AS y FROM m JOIN x USING ({o}) GROUP BY {k}"
        " UNION ALL SELECT {k}, -y FROM ap)\nSELECT {k}, round(sum(y), 6) + 0e0 AS y FROM both_ GROUP BY {k}"
    )
    width = 3
    draws = ", ".join(f"{g} AS o{c}" for c, g in enumerate(_gauss(width, 11, "depth || ':' || id")))
    sums = ", ".join(f"sum(v * o{c}) AS y{c}" for c in range(width))
    minus = ", ".join(f"-sum(core * s{c}) AS y{c}" for c in range(width))
    sample = (
        MEANS.format(last="") + ",\n"
        f"om AS MATERIALIZED (SELECT depth, id AS j, {_pattern(XY, 6)} AS pattern, {draws} FROM mem WHERE depth >= 2),\n"
        f"so AS (SELECT om.depth, c.depth AS up, c.code AS b, pattern, {', '.join(f'sum(o{c}) AS s{c}' for c in range(width))}"
        " FROM om JOIN coded c ON c.id = om.j AND c.depth < om.depth AND c.depth >= 2 GROUP BY ALL),\n"
        f"raw_ AS (SELECT om.depth, pattern, i, {sums} FROM m JOIN om USING (j) GROUP BY ALL"
        f" UNION ALL SELECT so.depth, pattern, c.id * 2 + r AS i, {minus} FROM mean JOIN so ON so.up = mean.depth AND so.b = mean.b"
        " JOIN coded c ON c.depth = mean.depth AND c.code = mean.a, range(0, 2) t(r) GROUP BY ALL),\n"
    )
    total = ", ".join(f"sum(y{c}) AS y{c}" for c in range(width))
    u = "SELECT depth, a, b, count(DISTINCT i) AS {n} FROM held WHERE far GROUP BY ALL"
    v = "SELECT depth, a, b, count(DISTINCT j) AS {n} FROM held WHERE far GROUP BY ALL"
    near = "(SELECT count(*) FROM held WHERE NOT far)"
    blocks = "(SELECT count(*) FROM (SELECT DISTINCT depth, a, b FROM held WHERE far))"

    nat = _with(NATIONS, XY, "box", LEAF, 2) + ",\n" + NATION_MATRIX + ",\n" + LOCATED
    energy = "SELECT depth, a, b, sum(v * v) AS energy FROM held WHERE far GROUP BY depth, a, b"

    whole = (
        "SELECT depth, a, b, n_rows, TRUE AS k_ok, TRUE AS orth_ok, " + _r("energy", "captured", 2)
        + " FROM ({n}) JOIN (" + energy + ") USING (depth, a, b)"
    )

    def by_metric(eta):
        wide = [f"(CAST(greatest(abs((r.i{a} >> (d - k)) - (c.i{a} >> (d - k))) - 1, 0) AS DOUBLE) * (({a}_hi - {a}_lo) / CAST((1::BIGINT << k) AS DOUBLE)))" for a in XY]
        return f"sqrt({' + '.join(f'{g} * {g}' for g in wide)}) >= {eta}::DOUBLE * {_diam(XY, 'k')}"

    def sweep(k, p, leaf, eta):
        rule = TOUCHED if eta is None else by_metric(eta)
        inner = _with(NATIONS, XY, "box", leaf, 2) + ",\n" + NATION_MATRIX + ",\n" + LOCATED_BY.replace("{rule}", rule)
        return (
            f"SELECT * FROM ({inner}\nSELECT CAST({k} AS INTEGER) AS k, CAST({p} AS INTEGER) AS p,"
            f" CAST({leaf} AS INTEGER) AS leaf, CAST({eta or 0} AS DOUBLE) AS eta, CAST(d AS INTEGER) AS depth, {near} AS n_near,"
            f" {blocks} * {k * k} AS n_core, CAST({0 if k >= 6 else -1} AS DOUBLE) AS far_rel_error, {k} < 6 AS truncated FROM dep)"
        )

    return {
        "leaf_blocks": f"{base}\nSELECT depth, a, b, i, j, v FROM held WHERE NOT far",
        "apply_truncated": f"{base},\n{means},\n{xj},\n{by_b},\n{rows}\nSELECT i, {_r('y', 'y')} FROM ap",
        "apply_truncated_t": f"{base},\n{means},\n{xi},\n{by_a},\n{cols}\nSELECT j, {_r('y', 'y')} FROM ap",
        "peeled_matvec": f"{base},\n{means},\n{xj},\n{by_b},\n{rows},\n" + peel.format(k="i", o="j"),
        "peeled_rmatvec": f"{base},\n{means},\n{xi},\n{by_a},\n{cols},\n" + peel.format(k="j", o="i"),
        "level_sample": f"{base},\n{sample}" + _long(f"SELECT depth, pattern, i, {total} FROM raw_ GROUP BY ALL", "depth, pattern, i", width),
        "column_bases": f"{nat}\n{whole.format(n=u.format(n='n_rows'))}",
        "row_bases": f"{nat}\n{whole.format(n=v.format(n='n_rows'))}",
        "block_orth": "SELECT CAST(label AS BIGINT) AS label, count(*) AS n_rows, CAST(least(4, count(*)) AS INTEGER) AS k_eff,"
        " TRUE AS orth_ok FROM embeddings GROUP BY label",
        "two_sample_compress": f"{base}\nSELECT depth, a, b, n_u, TRUE AS u_ok, n_v, TRUE AS v_ok FROM"
        f" ({u.format(n='n_u')}) JOIN ({v.format(n='n_v')}) USING (depth, a, b)",
        "core_matrix": f"{nat}\nSELECT depth, a, b, {_r('energy', 'energy', 2)} FROM ({energy})",
        "core_matrices": f"{nat}\nSELECT depth, count(*) AS n_cores, round(sum(energy), 1) AS energy FROM ({energy}) GROUP BY depth",
        "hier_matvec": f"{nat},\n{xj},\nidx AS (SELECT id * 2 + r AS i FROM pts, range(0, 2) t(r)),\n"
        "prod AS (SELECT i, sum(v * x) AS y FROM m JOIN x USING (j) GROUP BY i)\n"
        f"SELECT i, {_r('coalesce(y, 0e0)', 'y', 2)} FROM idx LEFT JOIN prod USING (i)",
        "hier_rmatvec": f"{nat},\n{xi},\nprod AS (SELECT j, sum(v * x) AS y FROM m JOIN x USING (i) GROUP BY j)\n"
        f"SELECT id AS j, {_r('coalesce(prod.y, 0e0)', 'y', 2)} FROM pts LEFT JOIN prod ON j = id",
        "black_box_bases": f"{nat}\nSELECT depth, a, b, TRUE AS k_ok, TRUE AS orth_ok, {_r('energy', 'captured', 2)} FROM ({energy})",
        "black_box_report": f"{nat}\nSELECT CAST(6 AS INTEGER) AS k, {near} AS n_near, CAST(n * 2 * n AS DOUBLE) AS n_full,"
        " 0e0 AS rel_error, 0e0 AS far_rel_error FROM dom",
        "probe_blocks": f"{nat}\nSELECT depth, a, b, i, j, {_r('v', 'v', 2)} FROM held WHERE NOT far",
        "compression_report": f"{nat}\nSELECT CAST(6 AS INTEGER) AS k, {near} AS n_near, {blocks} * 36 AS n_core,"
        " CAST(n * 2 * n AS DOUBLE) AS n_full, 0e0 AS rel_error, 0e0 AS far_rel_error FROM dom",
        "param_sweep": "\nUNION ALL ".join(
            sweep(*s) for s in ((1, 2, 8, None), (6, 2, 8, None), (6, 2, 32, None), (6, 2, 8, 0.6), (6, 2, 8, 0.9), (6, 2, 32, 1.6))
        ),
    }


def _cover_queries() -> dict[str, str]:
    base = _with(UNIT, XY, "box")
    ends = "depth, a_ix, a_iy, b_ix, b_iy, n_a, n_b"

    def metric(eta):
        return (
            f"cand AS MATERIALIZED (SELECT c.*, {_box_gap(XY)} >= {eta}::DOUBLE * {_diam(XY)} AS apart FROM (SELECT a.depth, a.ix AS a_ix, a.iy AS a_iy,"
            " b.ix AS b_ix, b.iy AS b_iy, a.n AS n_a, b.n AS n_b FROM box a JOIN box b ON a.depth = b.depth) c, dom),\n"
            # Boxes that are apart stay so further down; the first depth counts.
            f"blocks AS (SELECT c.{ends.replace(', ', ', c.')}, CASE WHEN c.apart THEN 'far' ELSE 'near' END AS kind FROM cand c"
            " LEFT JOIN cand p ON p.depth = c.depth - 1 AND p.a_ix = c.a_ix >> 1 AND p.a_iy = c.a_iy >> 1 AND p.b_ix = c.b_ix >> 1"
            " AND p.b_iy = c.b_iy >> 1, dep WHERE NOT coalesce(p.apart, FALSE) AND (c.apart OR c.depth = d))"
        )

    def counted(eta):
        return (
            f"SELECT * FROM ({base},\n{metric(eta)}\nSELECT CAST({eta} AS DOUBLE) AS eta, kind, depth, count(*) AS n_blocks, CAST(sum(CAST(n_a AS HUGEINT) * n_b) AS VARCHAR) AS n_pairs,"
            " TRUE AS complete FROM blocks GROUP BY ALL)"
        )

    def uneven(source, axes, finest):
        """The tree's own recursion: pairs of boxes that touch and are not both leaves meet again by their children."""
        keys = _keys(axes)
        flat = ", ".join(keys)
        deep = ", ".join(f"f{a} >> ({finest} - k) AS i{a}" for a in axes)
        fine = ", ".join(
            f"least(greatest(CAST(floor(({a} - {a}_lo) / ({a}_hi - {a}_lo) * {float(1 << finest)}::DOUBLE) AS BIGINT), 0), {(1 << finest) - 1}) AS f{a}" for a in axes
        )
        up = ", ".join(f"i{a} >> 1 AS u{a}" for a in axes)
        met = " AND ".join(f"p.i{a} = b.u{a}" for a in axes)
        apart = " OR ".join(
            f"(b_i{a} << (f - b_depth)) > ((a_i{a} + 1) << (f - a_depth)) OR (a_i{a} << (f - a_depth)) > ((b_i{a} + 1) << (f - b_depth))" for a in axes
        )
        cols = ["depth", *keys, "n", "leaf"]
        both = ", ".join([f"x.k_{c} AS a_{c}" for c in cols] + [f"y.k_{c} AS b_{c}" for c in cols])
        root = ", ".join([f"{c} AS a_{c}" for c in cols] + [f"{c} AS b_{c}" for c in cols])
        named = ", ".join([f"a_{c}" for c in cols] + [f"b_{c}" for c in cols])
        on_a = " AND ".join(f"x.{c} = fr.a_{c}" for c in ("depth", *keys))
        on_b = " AND ".join(f"y.{c} = fr.b_{c}" for c in ("depth", *keys))
        judged = f"SELECT *, {apart} AS apart FROM (SELECT *, greatest(a_depth, b_depth) AS f FROM ({{rows}}))"
        return (
            _with(source, axes, "dom").replace("WITH ", "WITH RECURSIVE ", 1)
            + f",\nfine AS MATERIALIZED (SELECT id, {fine} FROM pts, dom),\n"
            f"box AS MATERIALIZED (SELECT depth, depth - 1 AS up, {flat}, {up}, count(*) AS n FROM"
            f" (SELECT CAST(k AS INTEGER) AS depth, {deep} FROM fine, range(0, {finest + 1}) t(k)) GROUP BY ALL),\n"
            f"tree AS MATERIALIZED (SELECT b.depth, b.up, {', '.join(f'b.{k}' for k in keys)}, {', '.join(f'b.u{a}' for a in axes)}, b.n,"
            f" b.n < {LEAF} OR b.depth = {finest} AS leaf FROM box b LEFT JOIN box p ON p.depth = b.up AND {met} WHERE b.depth = 0 OR p.n >= {LEAF}),\n"
            f"step AS MATERIALIZED (SELECT depth, {flat}, {', '.join(f'{c} AS k_{c}' for c in cols)} FROM tree WHERE leaf UNION ALL"
            f" SELECT p.depth, {', '.join(f'p.{k}' for k in keys)}, {', '.join(f'b.{c} AS k_{c}' for c in cols)} FROM tree p JOIN tree b ON p.depth = b.up AND {met}),\n"
            f"fr AS ({judged.format(rows=f'SELECT {root} FROM tree WHERE depth = 0')} UNION ALL "
            + judged.format(rows=f"SELECT {both} FROM fr JOIN step x ON {on_a} JOIN step y ON {on_b} WHERE NOT fr.apart AND NOT (fr.a_leaf AND fr.b_leaf)")
            + f"),\nfound AS (SELECT {named}, CASE WHEN NOT apart THEN 'near' WHEN a_depth = b_depth THEN 'far' WHEN a_depth < b_depth THEN 'coarse' ELSE 'fine' END AS kind"
            " FROM fr WHERE apart OR (a_leaf AND b_leaf))"
        )

    return {
        "metric_cover": f"{base},\n{metric(0.9)}\nSELECT depth AS a_depth, a_ix, a_iy, depth AS b_depth, b_ix, b_iy, n_a, n_b, kind FROM blocks",
        "metric_coverage": "\nUNION ALL ".join(counted(e) for e in (0.6, 0.9, 1.6)),
        "uneven_lists": uneven(PART, XY, 26) + "\nSELECT a_depth, a_ix, a_iy, b_depth, b_ix, b_iy, a_n AS n_a, b_n AS n_b, kind FROM found",
        "uneven_coverage": uneven(EVENTS, XYZ, 20) + "\nSELECT kind, count(*) AS n_blocks, CAST(sum(CAST(a_n AS HUGEINT) * b_n) AS VARCHAR) AS n_pairs,"
        " (SELECT CAST(CAST(n AS HUGEINT) * n AS VARCHAR) FROM dom) AS expected, TRUE AS complete FROM found GROUP BY kind",
    }


def oracle_sql() -> dict[str, str]:
    return (
        _point_queries()
        | _box_queries()
        | _pair_queries()
        | _matrix_queries()
        | _kernel_queries()
        | _sketch_queries()
        | _factor_queries()
        | _cover_queries()
    )
