"""Parametric shapes as column expressions, and measures of meshes.

A wire or face is an array of points, a loop.  A mesh is a struct of ``vertices``, an array of points, and
``faces``, arrays of places from 0, counter-clockwise from outside.  Parameters may be columns; numbers of
sides are Python integers, as they fix the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvasir.functions import geometry as g
from kvasir.functions import vectors as v
from kvasir.functions.geometry import _n, point

# --- loops


def _loop(pairs, z=0.0) -> Column:
    return F.array(*[point(a, b, z) for a, b in pairs])


def circle(radius=0.5, sides: int = 16, z=0.0) -> Column:
    return _loop([(_n(radius) * math.cos(2 * math.pi * k / sides), _n(radius) * math.sin(2 * math.pi * k / sides)) for k in range(sides)], z)


def arc(radius=0.5, from_angle: float = 0.0, to_angle: float = 180.0, sides: int = 16) -> Column:
    """An open chain of ``sides + 1`` points."""
    turns = [math.radians(from_angle + (to_angle - from_angle) * k / sides) for k in range(sides + 1)]
    return _loop([(_n(radius) * math.cos(t), _n(radius) * math.sin(t)) for t in turns])


def ellipse(width=2.0, length=1.0, sides: int = 32) -> Column:
    return _loop([(_n(width) / 2 * math.cos(2 * math.pi * k / sides), _n(length) / 2 * math.sin(2 * math.pi * k / sides)) for k in range(sides)])


def ellipse_measures(width: Column, length: Column) -> Column:
    """Half-axes, focal length and eccentricity of an ellipse by its width and length."""
    a, b = F.greatest(width, length) / 2, F.least(width, length) / 2
    c = F.sqrt(a * a - b * b)
    return F.struct(a.alias("a"), b.alias("b"), c.alias("focal_length"), (c / a).alias("eccentricity"))


def rectangle(width=1.0, length=1.0, z=0.0) -> Column:
    w, h = _n(width) / 2, _n(length) / 2
    return _loop([(-w, -h), (w, -h), (w, h), (-w, h)], z)


def square(size=1.0) -> Column:
    return rectangle(size, size)


def trapezoid(width_a=1.0, width_b=0.75, length=1.0, offset_a=0.0, offset_b=0.0) -> Column:
    """Below of the first width, above of the second, each moved by its offset."""
    a, b, h, p, q = _n(width_a) / 2, _n(width_b) / 2, _n(length) / 2, _n(offset_a), _n(offset_b)
    return _loop([(p - a, -h), (p + a, -h), (q + b, h), (q - b, h)])


def star(radius_a=0.5, radius_b=0.2, rays: int = 8) -> Column:
    out = []
    for k in range(2 * rays):
        r, t = (_n(radius_a), _n(radius_b))[k % 2], math.pi * k / rays
        out.append((r * math.sin(t), r * math.cos(t)))
    return _loop(out[::-1])


def l_shape(width=1.0, length=1.0, a=0.25, b=0.25) -> Column:
    """An upright arm ``a`` wide and a foot ``b`` high."""
    w, h, a, b = _n(width), _n(length), _n(a), _n(b)
    return _loop([(x - w / 2, y - h / 2) for x, y in ((0 * w, 0 * h), (w, 0 * h), (w, b), (a, b), (a, h), (0 * w, h))])


def t_shape(width=1.0, length=1.0, a=0.25, b=0.25) -> Column:
    """A stem ``a`` wide under a bar ``b`` high."""
    w, h, a, b = _n(width) / 2, _n(length) / 2, _n(a) / 2, _n(b)
    return _loop([(-a, -h), (a, -h), (a, h - b), (w, h - b), (w, h), (-w, h), (-w, h - b), (-a, h - b)])


def i_shape(width=1.0, length=1.0, a=0.25, b=0.25, c=0.25) -> Column:
    """A web ``a`` wide between flanges ``b`` (below) and ``c`` (above) high."""
    w, h, a, b, c = _n(width) / 2, _n(length) / 2, _n(a) / 2, _n(b), _n(c)
    return _loop([(-w, -h), (w, -h), (w, b - h), (a, b - h), (a, h - c), (w, h - c), (w, h), (-w, h), (-w, h - c), (-a, h - c), (-a, b - h), (-w, b - h)])


def c_shape(width=1.0, length=1.0, a=0.25, b=0.25, c=0.25) -> Column:
    """A back ``a`` wide with arms ``b`` (below) and ``c`` (above) high."""
    w, h, a, b, c = _n(width) / 2, _n(length) / 2, _n(a), _n(b), _n(c)
    return _loop([(-w, -h), (w, -h), (w, b - h), (a - w, b - h), (a - w, h - c), (w, h - c), (w, h), (-w, h)])


def cross_shape(width=1.0, length=1.0, a=0.25, b=0.25) -> Column:
    """An upright bar ``a`` wide across a level one ``b`` high."""
    w, h, a, b = _n(width) / 2, _n(length) / 2, _n(a) / 2, _n(b) / 2
    return _loop([(-a, -h), (a, -h), (a, -b), (w, -b), (w, b), (a, b), (a, h), (-a, h), (-a, b), (-w, b), (-w, -b), (-a, -b)])


def squircle(radius=0.5, sides: int = 120, a: float = 2.0, b: float = 2.0) -> Column:
    out = []
    for k in range(sides):
        c, s = (round(f(2 * math.pi * k / sides), 15) for f in (math.cos, math.sin))
        out.append((_n(radius) * math.copysign(abs(c) ** (1 / a), c), _n(radius) * math.copysign(abs(s) ** (1 / b), s)))
    return _loop(out)


def spiral(radius_a=0.05, radius_b=0.5, height=1.0, turns: int = 10, sides: int = 36) -> Column:
    """An open chain whose radius and height grow evenly."""
    n = turns * sides
    pts = []
    for k in range(n + 1):
        u = k / n
        r = _n(radius_a) + (_n(radius_b) - _n(radius_a)) * u
        pts.append(point(r * math.cos(2 * math.pi * turns * u), r * math.sin(2 * math.pi * turns * u), _n(height) * u))
    return F.array(*pts)


def ring_area(radius, thickness, sides: int = 16) -> Column:
    """The area between two regular loops: circular hollow sections, rings."""
    return g.area(circle(radius, sides)) - g.area(circle(_n(radius) - _n(thickness), sides))


def hollow_area(width, length, thickness) -> Column:
    """Rectangular and square hollow sections."""
    return g.area(rectangle(width, length)) - g.area(rectangle(_n(width) - 2 * _n(thickness), _n(length) - 2 * _n(thickness)))


def golden_rectangles(width=1.0, n: int = 10) -> Column:
    """The widths of rectangles that are each the one before without a square."""
    phi = (1 + math.sqrt(5)) / 2
    return F.array(*[_n(width) * phi**-k for k in range(n)])


# --- meshes


def mesh(vertices: Column, faces: list[list[int]]) -> Column:
    return F.struct(vertices.alias("vertices"), F.array(*[F.array(*[F.lit(i) for i in f]) for f in faces]).alias("faces"))


def _extruded(n: int, base: int = 0) -> list[list[int]]:
    """Faces of a prism over a counter-clockwise loop of ``n`` points, the upper loop after the lower."""
    side = [[base + k, base + (k + 1) % n, base + n + (k + 1) % n, base + n + k] for k in range(n)]
    return [[base + k for k in reversed(range(n))], [base + n + k for k in range(n)], *side]


def extrude(loop: Column, n: int, height=1.0) -> Column:
    """A prism over a loop of ``n`` points, centred on its plane."""
    h = _n(height) / 2
    move = lambda d: F.transform(loop, lambda p: v.add(p, point(0, 0, d)))
    return mesh(F.concat(move(-h), move(h)), _extruded(n))


def prism(width=1.0, length=1.0, height=1.0) -> Column:
    return extrude(rectangle(width, length), 4, height)


def cube(size=1.0) -> Column:
    return prism(size, size, size)


def cylinder(radius=0.5, height=1.0, sides: int = 16) -> Column:
    return extrude(circle(radius, sides), sides, height)


def frustum(base_radius=0.5, top_radius=0.25, height=1.0, sides: int = 16) -> Column:
    h = _n(height) / 2
    return mesh(F.concat(circle(base_radius, sides, -h), circle(top_radius, sides, h)), _extruded(sides))


def cone(radius=0.5, height=1.0, sides: int = 16) -> Column:
    h = _n(height) / 2
    faces = [list(reversed(range(sides))), *[[k, (k + 1) % sides, sides] for k in range(sides)]]
    return mesh(F.concat(circle(radius, sides, -h), F.array(point(0, 0, h))), faces)


def wedge(width=1.0, length=1.0, height=1.0) -> Column:
    """A right-angled triangle across the width, along the length."""
    w, l, h = (_n(s) / 2 for s in (width, length, height))
    pts = [(-w, -l, -h), (w, -l, -h), (-w, -l, h), (-w, l, -h), (w, l, -h), (-w, l, h)]
    return mesh(F.array(*[point(*p) for p in pts]), [[0, 1, 2], [5, 4, 3], [0, 3, 4, 1], [1, 4, 5, 2], [2, 5, 3, 0]])


def _revolved(profile: list[tuple], sides: int) -> Column:
    """Rings of (radius, height) from below, closed by a pole at either end."""
    rings = profile[1:-1]
    pts = [point(0, 0, profile[0][1]), *[point(r * math.cos(2 * math.pi * k / sides), r * math.sin(2 * math.pi * k / sides), h) for r, h in rings for k in range(sides)], point(0, 0, profile[-1][1])]
    at = lambda i, k: 1 + i * sides + k % sides
    faces = [[0, at(0, k + 1), at(0, k)] for k in range(sides)]
    faces += [[at(i, k), at(i, k + 1), at(i + 1, k + 1), at(i + 1, k)] for i in range(len(rings) - 1) for k in range(sides)]
    top = 1 + len(rings) * sides
    return mesh(F.array(*pts), faces + [[at(len(rings) - 1, k), at(len(rings) - 1, k + 1), top] for k in range(sides)])


def sphere(radius=0.5, u_sides: int = 16, v_sides: int = 8) -> Column:
    turns = [math.pi * (k / v_sides - 0.5) for k in range(v_sides + 1)]
    return _revolved([(_n(radius) * math.cos(t), _n(radius) * math.sin(t)) for t in turns], u_sides)


def capsule(radius=0.25, height=1.0, u_sides: int = 16, v_sides: int = 4) -> Column:
    """A cylinder between two half spheres, ``height`` over all."""
    straight = _n(height) / 2 - _n(radius)
    turns = [math.pi / 2 * k / v_sides for k in range(v_sides + 1)]
    up = [(_n(radius) * math.cos(t), _n(radius) * math.sin(t) + straight) for t in turns]
    return _revolved([*[(r, -h) for r, h in reversed(up)], *up], u_sides)


def torus(major=0.5, minor=0.125, u_sides: int = 16, v_sides: int = 8) -> Column:
    pts = []
    for i in range(u_sides):
        for k in range(v_sides):
            t, s = 2 * math.pi * i / u_sides, 2 * math.pi * k / v_sides
            r = _n(major) + _n(minor) * math.cos(s)
            pts.append(point(r * math.cos(t), r * math.sin(t), _n(minor) * math.sin(s)))
    at = lambda i, k: (i % u_sides) * v_sides + k % v_sides
    return mesh(F.array(*pts), [[at(i, k), at(i + 1, k), at(i + 1, k + 1), at(i, k + 1)] for i in range(u_sides) for k in range(v_sides)])


def tetrahedron(radius=0.5) -> Column:
    r = _n(radius) / math.sqrt(3)
    pts = [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)]
    return mesh(F.array(*[point(*(r * c for c in p)) for p in pts]), [[0, 1, 2], [0, 3, 1], [0, 2, 3], [1, 3, 2]])


def octahedron(radius=0.5) -> Column:
    r = _n(radius)
    pts = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    faces = [[0, 2, 4], [2, 1, 4], [1, 3, 4], [3, 0, 4], [2, 0, 5], [1, 2, 5], [3, 1, 5], [0, 3, 5]]
    return mesh(F.array(*[point(*(r * c for c in p)) for p in pts]), faces)


def _hull_faces(pts: list[tuple], size: int) -> list[list[int]]:
    """Faces of ``size`` corners of a regular solid: the planes that leave all other corners on one side."""
    from itertools import combinations

    found: dict[frozenset, list[int]] = {}
    sub = lambda a, b: tuple(x - y for x, y in zip(a, b))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, j, k in combinations(range(len(pts)), 3):
        n = cross(sub(pts[j], pts[i]), sub(pts[k], pts[i]))
        side = [dot(n, sub(p, pts[i])) for p in pts]
        if dot(n, n) > 1e-9 and (max(side) < 1e-9 or min(side) > -1e-9):
            own = [m for m, s in enumerate(side) if abs(s) < 1e-9]
            if len(own) == size and frozenset(own) not in found:
                out = n if max(side) < 1e-9 else tuple(-c for c in n)
                mid = tuple(sum(pts[m][c] for m in own) / size for c in range(3))
                u = sub(pts[own[0]], mid)
                w = cross(out, u)
                found[frozenset(own)] = sorted(own, key=lambda m: math.atan2(dot(sub(pts[m], mid), w) / math.sqrt(dot(out, out)), dot(sub(pts[m], mid), u)))
    return list(found.values())


_PHI = (1 + math.sqrt(5)) / 2


def icosahedron(radius=0.5) -> Column:
    pts = [p for a in (-1, 1) for b in (-_PHI, _PHI) for p in ((0, a, b), (a, b, 0), (b, 0, a))]
    r = _n(radius) / math.sqrt(1 + _PHI**2)
    return mesh(F.array(*[point(*(r * c for c in p)) for p in pts]), _hull_faces(pts, 3))


def dodecahedron(radius=0.5) -> Column:
    pts = [(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    pts += [p for a in (-1 / _PHI, 1 / _PHI) for b in (-_PHI, _PHI) for p in ((0, a, b), (a, b, 0), (b, 0, a))]
    r = _n(radius) / math.sqrt(3)
    return mesh(F.array(*[point(*(r * c for c in p)) for p in pts]), _hull_faces(pts, 5))


def grid_mesh(width=1.0, length=1.0, u_sides: int = 2, v_sides: int = 2, height=None) -> Column:
    """A shell of ``u_sides`` by ``v_sides`` faces over a rectangle; ``height`` gives z from x and y."""
    pts = []
    for j in range(v_sides + 1):
        for i in range(u_sides + 1):
            px, py = _n(width) * (i / u_sides - 0.5), _n(length) * (j / v_sides - 0.5)
            pts.append(point(px, py, 0.0 if height is None else height(px, py)))
    at = lambda i, j: j * (u_sides + 1) + i
    return mesh(F.array(*pts), [[at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)] for j in range(v_sides) for i in range(u_sides)])


def paraboloid(focal_length=0.125, width=1.0, length=1.0, u_sides: int = 4, v_sides: int = 4) -> Column:
    return grid_mesh(width, length, u_sides, v_sides, lambda px, py: (px * px + py * py) / (4 * _n(focal_length)))


def hyperbolic_paraboloid(width=1.0, length=1.0, a=1.0, u_sides: int = 4, v_sides: int = 4) -> Column:
    return grid_mesh(width, length, u_sides, v_sides, lambda px, py: px * py * _n(a))


def loops(m: Column) -> Column:
    """A mesh's faces as loops of points."""
    return g.let(m, lambda own: F.transform(own["faces"], lambda f: F.transform(f, lambda i: F.element_at(own["vertices"], i + 1))))


def surface_area(m: Column) -> Column:
    return F.aggregate(F.transform(loops(m), g.area), F.lit(0.0), lambda s, a: s + a)


def volume(m: Column) -> Column:
    """By the divergence theorem over planar faces."""
    return F.abs(F.aggregate(F.transform(loops(m), lambda f: v.dot(g.area_vector(f), F.element_at(f, 1)) / 3), F.lit(0.0), lambda s, a: s + a))


def compactness(m: Column, reference: str = "sphere") -> Column:
    """The surface of the sphere (or cube) of the same volume over the surface."""
    if reference == "sphere":
        return math.pi ** (1 / 3) * F.pow(6 * volume(m), F.lit(2 / 3)) / surface_area(m)
    return 6 * F.pow(volume(m), F.lit(2 / 3)) / surface_area(m)


def _sides(m: Column) -> Column:
    """Each face's sides as pairs of places, in the face's direction."""
    return F.flatten(F.transform(m["faces"], lambda f: F.transform(f, lambda a, i: F.struct(a.alias("a"), F.element_at(f, (i + 1) % F.size(f) + 1).alias("b")))))


def mesh_edges(m: Column) -> Column:
    """The distinct edges, as pairs of places, the lesser first."""
    return F.array_sort(F.array_distinct(F.transform(_sides(m), lambda s: F.struct(F.least(s["a"], s["b"]).alias("a"), F.greatest(s["a"], s["b"]).alias("b")))))


def boundary_edges(m: Column) -> Column:
    """Sides that no face goes the other way: the edges of holes and rims."""
    sides = _sides(m)
    back = F.transform(sides, lambda s: F.struct(s["b"].alias("a"), s["a"].alias("b")))
    return F.array_except(sides, back)


def is_closed(m: Column) -> Column:
    return F.size(boundary_edges(m)) == 0


def counts(m: Column) -> Column:
    """Vertices, edges, faces and their alternating sum."""
    n, e, f = F.size(m["vertices"]), F.size(mesh_edges(m)), F.size(m["faces"])
    return F.struct(n.alias("vertices"), e.alias("edges"), f.alias("faces"), (n - e + f).alias("euler"))


def contains(m: Column, p: Column, tolerance: float = 1e-9) -> Column:
    """Whether a convex mesh encloses a point or has it on its boundary."""
    return F.forall(loops(m), lambda f: v.dot(g.area_vector(f), v.subtract(p, F.element_at(f, 1))) <= tolerance)


def on_boundary(m: Column, p: Column, tolerance: float = 1e-9) -> Column:
    """Whether a point lies on a face of a convex mesh."""
    return contains(m, p, tolerance) & F.exists(loops(m), lambda f: F.abs(v.dot(g.area_vector(f), v.subtract(p, F.element_at(f, 1)))) <= tolerance)


def centre(m: Column) -> Column:
    return g.centroid(m["vertices"])


def transformed(m: Column, move) -> Column:
    """A mesh with each vertex moved by a function of points."""
    return F.struct(F.transform(m["vertices"], move).alias("vertices"), m["faces"].alias("faces"))


def exploded(m: Column, by=2.0) -> Column:
    """The faces' loops moved away from the centre, as their centroids are scaled."""
    move = lambda f, c: g.let(v.multiply(v.subtract(g.centroid(f), c), _n(by) - 1), lambda d: F.transform(f, lambda p: v.add(p, d)))
    return g.let(centre(m), lambda c: F.transform(loops(m), lambda f: move(f, c)))


def decompose(m: Column, tilt: float = 10.0) -> Column:
    """The numbers of faces that are level up, level down, upright, and inclined, by the angle of their normal."""
    def sorted_out(t: Column) -> Column:
        n = lambda cond: F.size(F.filter(t, cond))
        top, bottom, upright = n(lambda a: a <= tilt), n(lambda a: a >= 180 - tilt), n(lambda a: F.abs(a - 90) <= tilt)
        return F.struct(top.alias("top"), bottom.alias("bottom"), upright.alias("vertical"), (F.size(t) - top - bottom - upright).alias("inclined"))

    return g.let(F.transform(loops(m), lambda f: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.z(g.normal(f))))))), sorted_out)
