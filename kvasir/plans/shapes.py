"""Points, edges, planes, loops and solids: parametric shapes over parts, edges between successive points, against closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.functions import geometry as g
from kvasir.functions import shapes as sh
from kvasir.functions import vectors as v
from kvasir.plans.analysis import _PT, _vec
from kvasir.sources import tables

_S = lambda: F.col("p_size").cast("double")
_E = lambda: F.col("e")


def _r(c, n: int = 7):
    return F.round(c, n) + F.lit(0.0)


def _uv(**columns):
    """Measures of points ``u`` and ``v``, the edge ``e`` between them, and the edge ``f``, ``e`` extended."""

    def run(spark, d):
        df = _vec(spark, d).withColumn("e", g.edge(F.col("u"), F.col("v"))).withColumn("f", g.extend(F.col("e"), 1.0))
        return df.select("pid", *[c().alias(k) for k, c in columns.items()])

    return run


def _part(**columns):
    """Measures of shapes whose size is the part's: columns ``rect``, ``l_``, ``t_``, ``ring``, ``box_``, made once a row."""

    def run(spark, d):
        s = _S()
        made = {"rect": sh.rectangle(s, 2.0), "l_": sh.l_shape(s, s * 2, s / 4, s / 5), "t_": sh.t_shape(s, s * 2, s / 4, s / 5), "ring": sh.circle(s, 12), "box_": sh.cube(s)}
        df = tables.table(spark, d, "part").select("p_partkey", "p_size", *[c.alias(k) for k, c in made.items()])
        return df.select("p_partkey", *[c().alias(k) for k, c in columns.items()])

    return run


_DIAGONAL = lambda: g.edge(g.origin(), g.point(1, 1, 0))
_AXIS = lambda: g.edge(g.origin(), g.point(1, 0, 0))
_LOOP = lambda: F.array(F.col("u"), F.col("v"), g.origin())
_FOUR = lambda: F.array(F.col("u"), F.col("v"), g.point(1, 0, 0), g.point(0, 1, 0))
_L = lambda: F.col("l_")
_T = lambda: F.col("t_")
_RECT = lambda: F.col("rect")

#: Solids by name: the mesh for a size, its numbers of vertices, edges and faces, and SQL of its volume and surface.
_RING = lambda n, r: f"({n} / 2.0 * {r} * {r} * sin(2 * pi() / {n}))"
SOLIDS = {
    "cube": (lambda s: sh.cube(s), (8, 12, 6), "power(s, 3)", "6 * s * s"),
    "prism": (lambda s: sh.prism(s, 2.0, 3.0), (8, 12, 6), "6 * s", "2 * (2 * s + 3 * s + 6)"),
    "cylinder": (lambda s: sh.cylinder(s, 2.0, 12), (24, 36, 14), f"2 * {_RING(12, 's')}", f"2 * {_RING(12, 's')} + 12 * 2 * s * sin(pi() / 12) * 2"),
    "frustum": (lambda s: sh.frustum(s, s / 2, 3.0, 8), (16, 24, 10), "1.75 * 4 * s * s * sin(pi() / 4)",
                "5 * s * s * sin(pi() / 4) + 8 * (3 * s * sin(pi() / 8) / 2) * sqrt(9 + power(s * cos(pi() / 8) / 2, 2))"),
    "cone": (lambda s: sh.cone(s, 3.0, 8), (9, 16, 9), _RING(8, "s"), f"{_RING(8, 's')} + 8 * s * sin(pi() / 8) * sqrt(9 + power(s * cos(pi() / 8), 2))"),
    "wedge": (lambda s: sh.wedge(s, 2.0, s), (6, 9, 5), "s * s", "s * s + 4 * s + 2 * s * sqrt(2)"),
    "sphere": (lambda s: sh.sphere(s, 8, 4), (26, 56, 32), "2 * 4 * sin(pi() / 4) * power(s, 3) * ((1 - sqrt(0.5)) / 3 * 0.5 + sqrt(0.5) / 3 * (1.5 + sqrt(0.5)))", None),
    "torus": (lambda s: sh.torus(s, s / 4, 12, 6), (72, 144, 72), "12 * sin(pi() / 6) * s * 3 * power(s / 4, 2) * sin(pi() / 3)", None),
    "tetrahedron": (lambda s: sh.tetrahedron(s), (4, 6, 4), "8 * sqrt(3) / 27 * power(s, 3)", "8 / sqrt(3) * s * s"),
    "octahedron": (lambda s: sh.octahedron(s), (6, 12, 8), "4.0 / 3 * power(s, 3)", "4 * sqrt(3) * s * s"),
    "icosahedron": (lambda s: sh.icosahedron(s), (12, 30, 20), "5.0 / 12 * (3 + sqrt(5)) * power(s / sin(2 * pi() / 5), 3)", "5 * sqrt(3) * power(s / sin(2 * pi() / 5), 2)"),
    "dodecahedron": (lambda s: sh.dodecahedron(s), (20, 30, 12), "(15 + 7 * sqrt(5)) / 4 * power(4 * s / (sqrt(3) * (1 + sqrt(5))), 3)", "3 * sqrt(25 + 10 * sqrt(5)) * power(4 * s / (sqrt(3) * (1 + sqrt(5))), 2)"),
    "capsule": (lambda s: sh.capsule(s, 4 * s, 8, 2), (34, 72, 40), "2 * 4 * sin(pi() / 4) * power(s, 3) * ((1 - sqrt(0.5)) / 3 * 0.5 + sqrt(0.5) / 3 * (1.5 + sqrt(0.5))) + 2 * s * 4 * s * s * sin(pi() / 4)", None),
}


def _solids(s, d):
    """A row for each size of part and solid."""
    sizes = tables.table(s, d, "part").select(_S().alias("s")).distinct()
    out = None
    for name, (make, *_rest) in SOLIDS.items():
        m = F.col("m")
        one = sizes.withColumn("m", make(F.col("s"))).select(
            F.lit(name).alias("solid"), "s", _r(sh.volume(m), 4).alias("volume"), (_r(sh.surface_area(m), 4) if _rest[-1] else F.lit(None).cast("double")).alias("surface"),
            sh.counts(m)["vertices"].alias("n_vertices"), sh.counts(m)["edges"].alias("n_edges"), sh.counts(m)["faces"].alias("n_faces"), sh.counts(m)["euler"].alias("euler"),
            sh.is_closed(m).alias("closed"), sh.contains(m, g.origin()).alias("holds_origin"), sh.contains(m, g.point(1e6, 0, 0)).alias("holds_far"))
        out = one if out is None else out.unionByName(one)
    return out


def _solids_sql() -> str:
    rows = []
    for name, (_, (n, e, f), volume, surface) in SOLIDS.items():
        euler, inside = n - e + f, "false" if name == "torus" else "true"
        rows.append(f"SELECT '{name}' AS solid, s, round({volume}, 4) AS volume, {f'round({surface}, 4)' if surface else 'NULL::DOUBLE'} AS surface, {n} AS n_vertices, {e} AS n_edges, {f} AS n_faces, {euler} AS euler, true AS closed, {inside} AS holds_origin, false AS holds_far FROM sizes")
    return "WITH sizes AS (SELECT DISTINCT p_size::DOUBLE AS s FROM part) " + " UNION ALL ".join(rows)


QUERIES = {
    "geo_points": _uv(
        d=lambda: _r(g.distance(F.col("u"), F.col("v"))), q=lambda: _r(g.quadrance(F.col("u"), F.col("v"))), same=lambda: g.is_coincident(F.col("u"), F.col("u")),
        zx=lambda: F.array_join(F.transform(g.coordinates(F.col("u"), "zx"), lambda c: F.round(c, 4).cast("string")), ",").startswith("x") | (g.x(F.col("u")) == F.element_at(g.coordinates(F.col("u"), "zx"), 2)),
        moved=lambda: _r(g.y(g.translate(F.col("u"), 1, 2, 3))), along=lambda: _r(g.z(g.translate_along(F.col("u"), g.point(0, 0, 5), 2.0))),
        scaled=lambda: _r(g.x(g.scale(F.col("u"), g.point(1, 1, 1), 2.0, 1.0, 1.0))), placed=lambda: _r(g.x(g.place(F.col("u"), F.col("u"), F.col("v")))),
        turned=lambda: _r(g.x(g.rotate(F.col("u"), g.origin(), g.point(0, 0, 1), 90.0))), snapped=lambda: _r(g.x(g.align(F.col("u"), {"x": F.array(F.lit(0.0), F.lit(2.0))}, 10.0)))),
    "geo_point_lists": _uv(
        cx=lambda: _r(g.x(g.centroid(_FOUR())), 9), at=lambda: g.index(F.col("v"), _FOUR()), missing=lambda: g.index(g.point(99, 9, 9), _FOUR()),
        near=lambda: _r(g.distance(F.col("u"), g.nearest(F.col("u"), F.array(F.col("v"), g.origin())))), hi=lambda: _r(g.x(g.bounds(_FOUR())["hi"])), lo=lambda: _r(g.z(g.bounds(_FOUR())["lo"])),
        line=lambda: g.are_collinear(F.array(F.col("u"), F.col("v"), g.at_parameter(_E(), 3.0))), bent=lambda: g.are_collinear(F.array(g.origin(), g.point(1, 0, 0), g.point(0, 1, 0)))),
    "geo_planes": _uv(
        away=lambda: _r(g.perpendicular_distance(g.point(1, 1, 1), g.plane(_LOOP()))), flat=lambda: g.are_coplanar(_LOOP()),
        foot=lambda: _r(g.perpendicular_distance(g.project(g.point(1, 1, 1), g.plane(_LOOP())), g.plane(_LOOP()))),
        dropped=lambda: _r(g.z(g.project(F.col("u"), g.plane(sh.square(2.0)), g.point(0, 0, 1)))), side=lambda: g.are_ipsilateral(F.array(F.col("u"), F.col("v")), g.plane(sh.square(2.0)), 0.0),
        area=lambda: _r(g.area(_LOOP())), perimeter=lambda: _r(g.wire_length(_LOOP()))),
    "geo_edges": _uv(
        length=lambda: _r(g.edge_length(_E())), dx=lambda: _r(g.x(g.edge_direction(_E()))), mid=lambda: _r(g.x(g.at_parameter(_E(), 0.5))), u0=lambda: _r(g.parameter_at(_E(), g.origin())),
        away=lambda: _r(g.distance_to_edge(g.origin(), _E())), on=lambda: g.is_on_edge(g.at_parameter(_E(), 0.25), _E()), off=lambda: g.is_on_edge(g.at_parameter(_E(), 2.0), _E(), 1e-9),
        back=lambda: _r(g.x(g.edge_reverse(_E())["a"])), ends=lambda: F.size(g.edge_vertices(_E())), q=lambda: _r(g.edge_quadrance(_E()))),
    "geo_edge_changes": _uv(
        extended=lambda: _r(g.edge_length(g.extend(_E(), 2.0))), forward=lambda: _r(g.distance(F.col("u"), g.extend(_E(), 2.0, False)["b"])), backward=lambda: _r(g.distance(F.col("v"), g.extend(_E(), 2.0, False, True)["a"])),
        trimmed=lambda: _r(g.edge_length(g.trim(_E(), 0.01))), three=lambda: _r(g.edge_length(g.set_length(_E(), 3.0))), unit=lambda: _r(g.edge_length(g.normalized(_E(), True))),
        one=lambda: _r(g.x(g.at_distance(_E(), 1.0))), centred=lambda: _r(g.x(g.line(F.col("u"), 4.0)["a"])), begun=lambda: _r(g.z(g.edge_by_origin(F.col("u"), g.point(0, 0, 2), 3.0)["b"]))),
    "geo_edge_pairs": _uv(
        angle=lambda: _r(g.edge_angle(_E(), _AXIS(), True)), spread=lambda: _r(g.edge_spread(_E(), _AXIS())), parallel=lambda: g.edges_parallel(_E(), g.extend(_E(), 1.0)),
        collinear=lambda: g.edges_collinear(_E(), F.col("f")), coplanar=lambda: g.edges_coplanar(_E(), g.edge(F.col("u"), g.origin())),
        joined=lambda: _r(g.edge_length(g.connection(_E(), g.edge(F.col("v"), g.origin())))), halfway=lambda: _r(g.edge_length(g.bisect(_E(), g.edge(F.col("u"), g.point(9, 9, 9)), 2.0)))),
    "geo_edge_2d": _uv(
        slope=lambda: _r(g.equation_2d(_E())["slope"]), cut=lambda: _r(g.equation_2d(_E())["y_intercept"]), upright=lambda: _r(g.equation_2d(g.edge(F.col("u"), g.translate(F.col("u"), 0, 1, 0)))["x_intercept"]),
        left=lambda: _r(g.x(g.offset_2d(_E(), 2.0)["a"])), moved=lambda: _r(g.y(g.offset_point_2d(F.col("v"), _E(), 2.0))), crossing=lambda: _r(g.x(g.intersect_2d(_E(), _DIAGONAL())), 5),
        none=lambda: g.intersect_2d(_AXIS(), g.edge(g.point(0, 1, 0), g.point(1, 1, 0))).isNull(),
        met=lambda: _r(g.x(g.extend_to_edge(_AXIS(), g.edge(g.point(3, -1, 0), g.point(3, 1, 0)))["b"])), kept=lambda: _r(g.edge_length(g.trim_by_edge(g.edge(g.origin(), g.point(4, 0, 0)), g.edge(g.point(3, -1, 0), g.point(3, 1, 0)))))),
    "shape_loops": _part(
        circle=lambda: _r(g.area(F.col("ring"))), around=lambda: _r(g.wire_length(F.col("ring"))), ellipse=lambda: _r(g.area(sh.ellipse(_S(), 3.0, 32))), rectangle=lambda: _r(g.area(_RECT())),
        square=lambda: _r(g.wire_length(sh.square(_S()))), trapezoid=lambda: _r(g.area(sh.trapezoid(_S(), _S() / 2, 3.0, 0.0, 1.0))), star=lambda: _r(g.area(sh.star(_S(), _S() / 2, 6))),
        squircle=lambda: _r(g.area(sh.squircle(_S(), 40, 1.0, 1.0)))),
    "shape_profiles": _part(
        l=lambda: _r(g.area(_L())), t=lambda: _r(g.area(_T())), i=lambda: _r(g.area(sh.i_shape(_S(), _S() * 2, _S() / 4, _S() / 5, _S() / 8))), c=lambda: _r(g.area(sh.c_shape(_S(), _S() * 2, _S() / 4, _S() / 5, _S() / 8))),
        cross=lambda: _r(g.area(sh.cross_shape(_S(), _S() * 2, _S() / 4, _S() / 5))), around=lambda: _r(g.wire_length(_L())), chs=lambda: _r(sh.ring_area(_S(), _S() / 4, 12)), rhs=lambda: _r(sh.hollow_area(_S(), 2 * _S(), _S() / 8)),
        shs=lambda: _r(sh.hollow_area(_S(), _S(), _S() / 8)), solid=lambda: _r(sh.volume(sh.extrude(_T(), 8, 2.0)))),
    "shape_angles": _part(
        inner=lambda: _r(F.array_max(g.interior_angles(_L()))), total=lambda: _r(F.aggregate(g.interior_angles(_T()), F.lit(0.0), lambda s, x: s + x)), outer=lambda: _r(F.array_min(g.exterior_angles(_L()))),
        convex=lambda: g.is_convex(_RECT()), bent=lambda: g.is_convex(_L()), compact=lambda: _r(g.compactness(sh.square(_S()))), open=lambda: g.is_closed(_RECT()), shut=lambda: g.is_closed(g.close(_RECT())),
        corners=lambda: F.size(g.remove_collinear(F.concat(F.slice(_RECT(), 1, 1), F.array(g.point(0, -1, 0)), F.slice(_RECT(), 2, 3)))), down=lambda: _r(g.z(g.normal(g.reversed_loop(_RECT())))),
        ordered=lambda: g.counter_clockwise(F.reverse(_RECT())) == _RECT(), turned=lambda: g.clockwise(_RECT()) == F.reverse(_RECT())),
    "shape_faces": _part(
        mid=lambda: _r(g.x(g.at_parameters(_RECT(), 0.75, 0.5))), back=lambda: _r(F.element_at(g.parameters_of(_RECT(), g.point(0, 0.5, 0)), 2)), inside=lambda: g.is_inside_2d(g.point(0, 0, 0), _RECT()),
        outside=lambda: g.is_inside_2d(g.point(_S() * 0.4, _S() * 0.5, 0), _L()), rim=lambda: g.is_inside_2d(g.point(0, -1, 0), _RECT(), False), box=lambda: _r(g.area(g.bounding_rectangle(F.col("ring")))),
        fans=lambda: _r(F.aggregate(F.transform(g.fan(F.col("ring")), g.area), F.lit(0.0), lambda s, x: s + x)), up=lambda: g.facing_toward(_RECT(), g.point(0, 0, 1)), angle=lambda: _r(g.faces_angle(_RECT(), F.reverse(_RECT()))),
        coplanar=lambda: g.faces_coplanar(_RECT(), sh.square(1.0)), lifted=lambda: g.faces_coplanar(_RECT(), sh.rectangle(1.0, 1.0, 1.0)), rises=lambda: _r(g.z(g.normal_edge(_RECT(), 2.5)["b"])),
        compass=lambda: _r(g.face_compass_angle(F.transform(_RECT(), lambda p: g.rotate(p, g.origin(), g.point(0, 1, 0), 90.0)))), level=lambda: F.size(g.planarize(_RECT()))),
    "shape_chains": _part(
        arc=lambda: _r(g.wire_length(sh.arc(_S(), 0, 90, 8), False)), helix=lambda: _r(g.wire_length(sh.spiral(_S(), _S(), 6.0, 2, 12), False)), half=lambda: _r(g.x(g.along(sh.rectangle(_S(), 2.0), _S() / 2))),
        quarter=lambda: _r(g.x(g.along_parameter(sh.square(_S()), 0.125, True))), beyond=lambda: g.along(_RECT(), 1e9).isNull(), at=lambda: _r(g.distance_along(_RECT(), g.point(0, -1, 0))), u=lambda: _r(g.parameter_along(sh.square(_S()), g.point(0, -_S() / 2, 0), True)),
        off=lambda: g.distance_along(_RECT(), g.point(0, 0, 9)).isNull(), golden=lambda: _r(F.element_at(sh.golden_rectangles(_S(), 3), 3)), edges=lambda: F.size(g.edges_of(_RECT(), False)),
        focal=lambda: _r(sh.ellipse_measures(_S() + 3, F.lit(3.0))["focal_length"]), eccentricity=lambda: _r(sh.ellipse_measures(_S() + 3, F.lit(3.0))["eccentricity"])),
    "shape_solids": _solids,
    "shape_meshes": _part(
        shell=lambda: _r(sh.surface_area(sh.grid_mesh(_S(), 2.0, 3, 2))), rim=lambda: F.size(sh.boundary_edges(sh.grid_mesh(_S(), 2.0, 3, 2))), open=lambda: sh.is_closed(sh.grid_mesh(_S(), 2.0, 3, 2)),
        bowl=lambda: _r(g.z(F.element_at(sh.paraboloid(0.25, _S(), 2.0, 2, 2)["vertices"], 1))), saddle=lambda: _r(g.z(F.element_at(sh.hyperbolic_paraboloid(_S(), 2.0, 0.5, 2, 2)["vertices"], 1))),
        edge=lambda: sh.on_boundary(F.col("box_"), g.point(_S() / 2, 0, 0)), inner=lambda: sh.on_boundary(F.col("box_"), g.origin()), round=lambda: _r(sh.compactness(F.col("box_"))), square=lambda: _r(sh.compactness(F.col("box_"), "cube")),
        moved=lambda: _r(g.x(sh.centre(sh.transformed(F.col("box_"), lambda p: g.translate(p, 5, 0, 0))))), burst=lambda: _r(F.array_max(F.transform(sh.exploded(F.col("box_"), 2.0), lambda f: g.x(g.centroid(f))))),
        top=lambda: sh.decompose(F.col("box_"))["top"], walls=lambda: sh.decompose(F.col("box_"))["vertical"], slopes=lambda: sh.decompose(sh.octahedron(_S()))["inclined"], lines=lambda: F.size(sh.mesh_edges(F.col("box_")))),
}

_UV = f"{_PT}, uv AS (SELECT a.pid, a.x, a.y, a.z, b.x AS bx, b.y AS by_, b.z AS bz, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS l FROM pt a JOIN pt b ON b.pid = a.pid + 1)"
_D2 = "((bx - x) ** 2 + (by_ - y) ** 2 + (bz - z) ** 2)"
_U0 = f"((-x * (bx - x) - y * (by_ - y) - z * (bz - z)) / {_D2})"
_CLAMP = f"least(1.0, greatest(0.0, {_U0}))"
_CX = "(y * bz - z * by_), (z * bx - x * bz), (x * by_ - y * bx)"
_P = "WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s FROM part) SELECT p_partkey"
SQL = {
    "geo_points": f"WITH {_UV} SELECT pid, round(l, 7) AS d, round(l * l, 7) AS q, true AS same, true AS zx, round(y + 2, 7) AS moved, round(z + 2, 7) AS along, round(1 + 2 * (x - 1), 7) AS scaled, round(bx, 7) AS placed, round(-y, 7) AS turned, 0.0::DOUBLE AS snapped FROM uv",
    "geo_point_lists": f"WITH {_UV} SELECT pid, round((x + bx + 1) / 4, 9) AS cx, 1 AS at, NULL::INTEGER AS missing, round(least(l, sqrt(x * x + y * y + z * z)), 7) AS near, round(greatest(x, bx, 1), 7) AS hi, round(least(z, bz, 0), 7) AS lo, true AS line, false AS bent FROM uv",
    "geo_planes": f"WITH {_UV}, n AS (SELECT *, y * bz - z * by_ AS nx, z * bx - x * bz AS ny, x * by_ - y * bx AS nz FROM uv) SELECT pid, round(abs(nx + ny + nz) / sqrt(nx * nx + ny * ny + nz * nz), 7) AS away, true AS flat, 0.0::DOUBLE AS foot, 0.0::DOUBLE AS dropped, NOT ((z > 0 AND bz < 0) OR (z < 0 AND bz > 0)) AS side, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 7) AS area, round(l + sqrt(x * x + y * y + z * z) + sqrt(bx * bx + by_ * by_ + bz * bz), 7) AS perimeter FROM n",
    "geo_edges": f"WITH {_UV} SELECT pid, round(l, 7) AS length, round((bx - x) / l, 7) AS dx, round(x + 0.5 * (bx - x), 7) AS mid, round({_U0}, 7) AS u0, round(sqrt((x + {_CLAMP} * (bx - x)) ** 2 + (y + {_CLAMP} * (by_ - y)) ** 2 + (z + {_CLAMP} * (bz - z)) ** 2), 7) AS away, true AS \"on\", false AS off, round(bx, 7) AS back, 2 AS ends, round(l * l, 7) AS q FROM uv",
    "geo_edge_changes": f"WITH {_UV} SELECT pid, round(l + 2, 7) AS extended, round(l + 2, 7) AS forward, round(l + 2, 7) AS backward, round(abs(l - 0.01), 7) AS trimmed, 3.0::DOUBLE AS three, 1.0::DOUBLE AS unit, round(x + (bx - x) / l, 7) AS one, round(x - 2, 7) AS centred, round(z + 3, 7) AS begun FROM uv",
    "geo_edge_pairs": f"WITH {_UV} SELECT pid, round(degrees(acos(least(1.0, abs(bx - x) / l))), 7) AS angle, round(1 - power((bx - x) / l, 2), 7) AS spread, true AS parallel, true AS collinear, true AS coplanar, 0.0::DOUBLE AS joined, 2.0::DOUBLE AS halfway FROM uv",
    "geo_edge_2d": f"WITH {_UV} SELECT pid, round((by_ - y) / (bx - x), 7) AS slope, round(y - (by_ - y) / (bx - x) * x, 7) AS cut, round(x, 7) AS upright, round(x - 2 * (by_ - y) / sqrt((bx - x) ** 2 + (by_ - y) ** 2), 7) AS \"left\", round(by_ + 2 * (bx - x) / sqrt((bx - x) ** 2 + (by_ - y) ** 2), 7) AS moved, round(x + (y - x) / ((bx - x) - (by_ - y)) * (bx - x), 5) AS crossing, true AS \"none\", 3.0::DOUBLE AS met, 3.0::DOUBLE AS kept FROM uv",
    "shape_loops": f"{_P}, round(3 * s * s, 7) AS circle, round(24 * s * sin(pi() / 12), 7) AS around, round(16 * s / 2 * 1.5 * sin(pi() / 16), 7) AS ellipse, round(2 * s, 7) AS rectangle, round(4 * s, 7) AS square, round(2.25 * s, 7) AS trapezoid, round(1.5 * s * s, 7) AS star, round(20 * s * s * sin(pi() / 20), 7) AS squircle FROM p",
    "shape_profiles": f"{_P}, round(s * s / 2 + 0.15 * s * s, 7) AS l, round(0.25 * 1.8 * s * s + 0.2 * s * s, 7) AS t, round(s * s * (0.325 + 0.25 * 1.675), 7) AS i, round(s * s * (0.5 + 0.75 * 0.325), 7) AS c, round(s * s * (0.5 + 0.2 - 0.05), 7) AS \"cross\", round(6 * s, 7) AS around, round(3 * s * s * (1 - 0.5625), 7) AS chs, round(2 * s * s - 0.75 * 1.75 * s * s, 7) AS rhs, round(s * s * (1 - 0.5625), 7) AS shs, round(2 * (0.25 * 1.8 * s * s + 0.2 * s * s), 7) AS solid FROM p",
    "shape_angles": f"{_P}, 270.0::DOUBLE AS \"inner\", 1080.0::DOUBLE AS total, 90.0::DOUBLE AS \"outer\", true AS convex, false AS bent, round(sqrt(pi()) / 2, 7) AS compact, false AS open, true AS shut, 4 AS corners, -1.0::DOUBLE AS down, true AS ordered, true AS turned FROM p",
    "shape_faces": f"{_P}, round(s / 4, 7) AS mid, 0.75::DOUBLE AS back, true AS inside, false AS outside, false AS rim, round(4 * s * s, 7) AS box, round(3 * s * s, 7) AS fans, true AS up, 180.0::DOUBLE AS angle, true AS coplanar, false AS lifted, 2.5::DOUBLE AS rises, 90.0::DOUBLE AS compass, 4 AS level FROM p",
    "shape_chains": f"{_P}, round(16 * s * sin(pi() / 32), 7) AS arc, round(24 * sqrt(power(2 * s * sin(pi() / 12), 2) + 0.0625), 7) AS helix, 0.0::DOUBLE AS half, 0.0::DOUBLE AS quarter, true AS beyond, round(s / 2, 7) AS at, 0.125::DOUBLE AS u, true AS off, round(s * power((1 + sqrt(5)) / 2, -2), 7) AS golden, 3 AS edges, round(sqrt((s + 3) * (s + 3) - 9) / 2, 7) AS focal, round(sqrt((s + 3) * (s + 3) - 9) / (s + 3), 7) AS eccentricity FROM p",
    "shape_solids": _solids_sql(),
    "shape_meshes": f"{_P}, round(2 * s, 7) AS shell, 10 AS rim, false AS open, round(s * s / 4 + 1, 7) AS bowl, round(s / 4, 7) AS saddle, true AS edge, false AS \"inner\", round(power(pi() / 6, 1 / 3.0), 7) AS round, 1.0::DOUBLE AS square, 5.0::DOUBLE AS moved, round(s, 7) AS burst, 1 AS top, 4 AS walls, 8 AS slopes, 12 AS lines FROM p",
}
