import math

import pytest
from pyspark.sql import functions as F

from kvasir.functions import geometry as g
from kvasir.functions import shapes as sh
from kvasir.plans.shapes import SOLIDS


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_points_and_planes(spark):
    loop = F.array(g.point(0, 0, 1), g.point(4, 0, 1), g.point(4, 3, 1), g.point(0, 3, 1))
    r = one(spark, n=g.normal(loop), plane=g.plane(loop), away=g.perpendicular_distance(g.point(1, 1, 6), g.plane(loop)), foot=g.project(g.point(1, 1, 6), g.plane(loop)),
            slant=g.project(g.point(1, 1, 2), g.plane(loop), g.point(1, 0, 1)), none=g.project(g.point(1, 1, 2), g.plane(loop), g.point(1, 0, 0)), c=g.centroid(loop),
            turned=g.rotate(g.point(2, 0, 0), g.point(1, 0, 0), g.point(0, 0, 1), 90.0), at=g.index(g.point(4, 3, 1.00001), loop), gone=g.index(g.origin(), loop),
            same=g.align(g.point(1.00001, 5, 0), {"x": F.array(F.lit(1.0)), "y": F.array(F.lit(9.0))}))
    assert r.n == [0, 0, 1] and r.plane == [0, 0, 1, -1] and r.away == 5 and r.foot == [1, 1, 1] and r.slant == [0, 1, 1] and r.none is None
    assert r.c == [2, 1.5, 1] and r.turned == pytest.approx([1, 1, 0]) and r.at == 2 and r.gone is None and r.same == [1, 5, 0]


def test_edges(spark):
    e, up = g.edge(g.origin(), g.point(4, 0, 0)), g.edge(g.point(3, -1, 0), g.point(3, 1, 0))
    r = one(spark, both=g.extend(e, 2.0), end=g.extend(e, 2.0, False), start=g.extend(e, 2.0, False, True), cut=g.trim_by_edge(e, up), rest=g.trim_by_edge(e, up, True), miss=g.trim_by_edge(e, g.edge(g.point(9, 1, 0), g.point(9, 2, 0))),
            left=g.offset_2d(e, 2.0), u=g.parameter_at(e, g.point(1, 7, 0)), far=g.distance_to_edge(g.point(7, 4, 0), e), near=g.connection(e, g.edge(g.point(5, 0, 0), g.point(9, 0, 0))),
            eq=g.equation_2d(up), t=g.edge_angle(e, g.edge(g.origin(), g.point(-1, 1, 0))), tb=g.edge_angle(e, g.edge(g.origin(), g.point(-1, 1, 0)), True))
    assert (r.both.a[0], r.both.b[0]) == (-1, 5) and r.end.b[0] == 6 and r.start.a[0] == -2
    assert r.cut.b == [3, 0, 0] and r.rest.a == [3, 0, 0] and r.miss.b == [4, 0, 0] and r.left.a == [0, 2, 0] and r.u == 0.25 and r.far == 5
    assert (r.near.a, r.near.b) == ([4, 0, 0], [5, 0, 0]) and r.eq.slope is None and r.eq.x_intercept == 3 and r.t == pytest.approx(135) and r.tb == pytest.approx(45)


def test_loops(spark):
    shape = sh.l_shape(4.0, 4.0, 1.0, 1.0)
    r = one(spark, angles=g.interior_angles(shape), area=g.area(shape), inside=g.is_inside_2d(g.point(-1.5, 1, 0), shape), notch=g.is_inside_2d(g.point(1, 1, 0), shape), rim=g.is_inside_2d(g.point(0, -2, 0), shape),
            at=g.along(shape, 5.0), beyond=g.along(shape, 99.0), d=g.distance_along(shape, g.point(2, -1.5, 0)), uv=g.parameters_of(sh.rectangle(4.0, 2.0), g.point(1, 0, 0)))
    assert [round(x) for x in r.angles] == [90, 90, 90, 270, 90, 90] and r.area == 7 and r.inside and not r.notch and r.rim
    assert r.at == [2, -1, 0] and r.beyond is None and r.d == 4.5 and r.uv == [0.75, 0.5]


@pytest.mark.parametrize("name", sorted(SOLIDS))
def test_solids_are_closed_and_oriented_outward(spark, name):
    m = SOLIDS[name][0](F.lit(2.0))
    r = one(spark, closed=sh.is_closed(m), n=sh.counts(m), faces=sh.loops(m), vertices=m["vertices"], volume=sh.volume(m))
    assert r.closed and (r.n.vertices, r.n.edges, r.n.faces) == SOLIDS[name][1] and r.volume > 0
    if name != "torus":  # convex: every corner lies behind every face
        for loop in r.faces:
            a, b, c = loop[:3]
            u, w = ([q - p for p, q in zip(a, x)] for x in (b, c))
            n = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
            assert all(sum(k * (q - p) for k, p, q in zip(n, a, x)) < 1e-9 for x in r.vertices)


def test_sphere_tends_to_its_volume(spark):
    r = one(spark, v=sh.volume(sh.sphere(1.0, 48, 32)), a=sh.surface_area(sh.sphere(1.0, 48, 32)))
    assert r.v == pytest.approx(4 / 3 * math.pi, rel=0.02) and r.a == pytest.approx(4 * math.pi, rel=0.02)
