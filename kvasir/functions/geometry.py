"""Points, straight edges and planes as column expressions.

A point is an array of three doubles, an edge a struct of points ``a`` and ``b``, a plane an array of the
four coefficients of ``ax + by + cz + d = 0`` with a unit normal.  Everything is a built-in expression, so it
stays in the JVM and is folded, pruned and pushed down like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvasir.functions import vectors as v
from kvasir.functions.vectors import let

TOLERANCE = 1e-4


def _n(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


# --- points


def point(x=0.0, y=0.0, z=0.0) -> Column:
    return F.array(_n(x), _n(y), _n(z))


def origin() -> Column:
    return point()


def x(p: Column) -> Column:
    return F.element_at(p, 1)


def y(p: Column) -> Column:
    return F.element_at(p, 2)


def z(p: Column) -> Column:
    return F.element_at(p, 3)


def coordinates(p: Column, output: str = "xyz") -> Column:
    """Those of the named axes, in their order."""
    return F.array(*[F.element_at(p, "xyz".index(c) + 1) for c in output.lower()])


def quadrance(p: Column, q: Column) -> Column:
    return v.quadrance(v.subtract(q, p))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(quadrance(p, q))


def is_coincident(p: Column, q: Column, tolerance: float = TOLERANCE) -> Column:
    return distance(p, q) <= tolerance


def centroid(points: Column) -> Column:
    """The mean of an array of points."""
    s = F.aggregate(points, origin(), v.add)
    return F.transform(s, lambda c: c / F.size(points))


def index(p: Column, points: Column, tolerance: float = TOLERANCE) -> Column:
    """The place, from 0, of the first point within tolerance; null if there is none."""
    at = F.array_position(F.transform(points, lambda q: is_coincident(p, q, tolerance)), F.lit(True))
    return F.when(at > 0, at - 1)


def nearest(p: Column, points: Column) -> Column:
    """The nearest of an array of points, the first on ties."""
    ranked = F.transform(points, lambda q, i: F.struct(quadrance(p, q).alias("d"), i.alias("i"), q.alias("q")))
    return F.array_min(ranked)["q"]


def align(p: Column, lists: dict[str, Column], epsilon: float = TOLERANCE) -> Column:
    """Each coordinate moved to the first value of its axis's list within ``epsilon``, else left."""
    def one(k: int, axis: str) -> Column:
        own = F.element_at(p, k)
        if axis not in lists:
            return own
        return F.coalesce(F.get(F.filter(lists[axis], lambda t: F.abs(t - own) <= epsilon), F.lit(0)), own)

    return F.array(*[one(k + 1, axis) for k, axis in enumerate("xyz")])


def normal(points: Column) -> Column:
    """The unit normal of a closed loop of points (Newell's sums)."""
    return let(area_vector(points), v.normalize)


def plane(points: Column) -> Column:
    """The plane of a closed loop, through its centroid."""
    return let(normal(points), lambda n: F.concat(n, F.array(-v.dot(n, centroid(points)))))


def signed_distance(p: Column, of: Column) -> Column:
    return let(of, lambda own: v.dot(F.slice(own, 1, 3), p) + F.element_at(own, 4))


def perpendicular_distance(p: Column, of: Column) -> Column:
    return F.abs(signed_distance(p, of))


def project(p: Column, onto: Column, direction: Column | None = None) -> Column:
    """Along a direction, or the normal; null if the direction lies in the plane."""
    def moved(of: Column) -> Column:
        n = F.slice(of, 1, 3)
        d = n if direction is None else direction
        along = v.dot(n, d)
        return F.when(F.abs(along) > 1e-12, v.subtract(p, v.multiply(d, signed_distance(p, of) / along)))

    return let(onto, moved)


def are_collinear(points: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether all lie on the line through the first and the point farthest from it."""
    def judged(pts: Column) -> Column:
        first = F.element_at(pts, 1)
        far = F.array_max(F.transform(pts, lambda q: F.struct(quadrance(first, q).alias("d"), q.alias("q"))))["q"]
        return let(v.subtract(far, first), lambda d: F.forall(pts, lambda q: v.magnitude(v.cross(v.subtract(q, first), d)) <= tolerance * F.greatest(v.magnitude(d), F.lit(tolerance))))

    return let(points, judged)


def are_coplanar(points: Column, tolerance: float = TOLERANCE) -> Column:
    return F.coalesce(let(plane(points), lambda of: F.forall(points, lambda q: perpendicular_distance(q, of) <= tolerance)), F.lit(True))


def are_ipsilateral(points: Column, of: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether no two lie strictly on different sides of a plane."""
    def judged(own: Column) -> Column:
        return ~(F.exists(points, lambda q: signed_distance(q, own) > tolerance) & F.exists(points, lambda q: signed_distance(q, own) < -tolerance))

    return let(of, judged)


def _turn(points: Column) -> Column:
    return let(centroid(points), lambda c: F.transform(points, lambda q, i: F.struct(F.atan2(y(q) - y(c), x(q) - x(c)).alias("t"), i.alias("i"), q.alias("q"))))


def counter_clockwise(points: Column) -> Column:
    """Sorted by the angle about the centroid, from -180 degrees up, in plan."""
    return F.transform(F.array_sort(_turn(points)), lambda s: s["q"])


def clockwise(points: Column) -> Column:
    return F.reverse(counter_clockwise(points))


def bounds(points: Column) -> Column:
    """A struct of the least and greatest corner of an array of points."""
    axis = lambda k: F.transform(points, lambda q: F.element_at(q, k))
    side = lambda f: F.array(*[f(axis(k)) for k in (1, 2, 3)])
    return F.struct(side(F.array_min).alias("lo"), side(F.array_max).alias("hi"))


def translate(p: Column, dx=0.0, dy=0.0, dz=0.0) -> Column:
    return v.add(p, point(dx, dy, dz))


def translate_along(p: Column, direction: Column, by) -> Column:
    return v.add(p, v.multiply(v.normalize(direction), _n(by)))


def scale(p: Column, about: Column, sx=1.0, sy=1.0, sz=1.0) -> Column:
    return let(v.subtract(p, about), lambda d: v.add(about, F.array(x(d) * _n(sx), y(d) * _n(sy), z(d) * _n(sz))))


def rotate(p: Column, about: Column, axis: Column, degrees) -> Column:
    """Counter-clockwise about an axis through a point (Rodrigues)."""
    k, d, t = v.normalize(axis), v.subtract(p, about), F.radians(_n(degrees))
    turned = v.add(v.add(v.multiply(d, F.cos(t)), v.multiply(v.cross(k, d), F.sin(t))), v.multiply(k, v.dot(k, d) * (1 - F.cos(t))))
    return v.add(about, turned)


def place(p: Column, old: Column, new: Column) -> Column:
    """Moved as ``old`` moves to ``new``."""
    return v.add(p, v.subtract(new, old))


# --- edges


def edge(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def edge_by_origin(o: Column, direction: Column, length=1.0) -> Column:
    return edge(o, translate_along(o, direction, length))


def line(o: Column, length=1.0, direction: Column | None = None, placement: str = "center") -> Column:
    """Centred on, begun at or ended at its origin."""
    d = point(1, 0, 0) if direction is None else direction
    back = {"center": 0.5, "start": 0.0, "end": 1.0}[placement]
    a = translate_along(o, d, -back * _n(length))
    return edge(a, translate_along(a, d, length))


def edge_direction(e: Column) -> Column:
    return let(v.subtract(e["b"], e["a"]), v.normalize)


def edge_length(e: Column) -> Column:
    return distance(e["a"], e["b"])


def edge_quadrance(e: Column) -> Column:
    return quadrance(e["a"], e["b"])


def edge_vertices(e: Column) -> Column:
    return F.array(e["a"], e["b"])


def edge_reverse(e: Column) -> Column:
    return edge(e["b"], e["a"])


def edge_angle(e: Column, f: Column, bracket: bool = False) -> Column:
    """Degrees between directions; bracketed, at most 90."""
    t = v.angle(edge_direction(e), edge_direction(f))
    return let(t, lambda a: F.when(a > 90, 180 - a).otherwise(a)) if bracket else t


def edge_spread(e: Column, f: Column) -> Column:
    return v.spread(edge_direction(e), edge_direction(f))


def edges_parallel(e: Column, f: Column, tolerance: float = TOLERANCE) -> Column:
    return v.is_parallel(edge_direction(e), edge_direction(f), tolerance)


def edges_collinear(e: Column, f: Column, tolerance: float = TOLERANCE) -> Column:
    return are_collinear(F.array(e["a"], e["b"], f["a"], f["b"]), tolerance)


def edges_coplanar(e: Column, f: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether the volume that the two span vanishes."""
    d = v.cross(v.subtract(e["b"], e["a"]), v.subtract(f["b"], f["a"]))
    return F.abs(v.dot(d, v.subtract(f["a"], e["a"]))) <= tolerance


def at_parameter(e: Column, u) -> Column:
    return v.add(e["a"], v.multiply(v.subtract(e["b"], e["a"]), _n(u)))


def at_distance(e: Column, by, start: Column | None = None) -> Column:
    """Along the edge's direction from a point, its start by default."""
    return translate_along(e["a"] if start is None else start, edge_direction(e), by)


def parameter_at(e: Column, p: Column) -> Column:
    """Where the point's foot lies on the edge, from 0 to 1 within it."""
    return let(v.subtract(e["b"], e["a"]), lambda d: v.dot(v.subtract(p, e["a"]), d) / v.dot(d, d))


def distance_to_edge(p: Column, e: Column) -> Column:
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), parameter_at(e, p)))
    return distance(p, at_parameter(e, u))


def is_on_edge(p: Column, e: Column, tolerance: float = TOLERANCE) -> Column:
    return distance_to_edge(p, e) <= tolerance


def equation_2d(e: Column) -> Column:
    """Slope and y-intercept; an upright edge has its x-intercept and no others."""
    dx, dy = x(e["b"]) - x(e["a"]), y(e["b"]) - y(e["a"])
    slope = F.when(dx != 0, dy / dx)
    return F.struct(slope.alias("slope"), F.when(dx == 0, x(e["a"])).alias("x_intercept"), (y(e["a"]) - slope * x(e["a"])).alias("y_intercept"))


def intersect_2d(e: Column, f: Column) -> Column:
    """Where the two lines cross in plan; null if they are parallel."""
    d, g, w = v.subtract(e["b"], e["a"]), v.subtract(f["b"], f["a"]), v.subtract(f["a"], e["a"])
    det = x(d) * y(g) - y(d) * x(g)
    u = (x(w) * y(g) - y(w) * x(g)) / det
    return F.when(F.abs(det) > 1e-12, point(x(e["a"]) + u * x(d), y(e["a"]) + u * y(d)))


def extend(e: Column, by, both: bool = True, reverse: bool = False) -> Column:
    """By half the distance at both ends, or by all of it at the end or, reversed, at the start."""
    d = F.abs(_n(by))
    a, b = (d / 2, d / 2) if both else (d, F.lit(0.0)) if reverse else (F.lit(0.0), d)
    return edge(at_distance(e, -a), at_distance(e, b, e["b"]))


def trim(e: Column, by, both: bool = True, reverse: bool = False) -> Column:
    d = F.abs(_n(by))
    a, b = (d / 2, d / 2) if both else (d, F.lit(0.0)) if reverse else (F.lit(0.0), d)
    return edge(at_distance(e, a), at_distance(e, -b, e["b"]))


def set_length(e: Column, length=1.0, both: bool = True, reverse: bool = False) -> Column:
    more = _n(length) - edge_length(e)
    a, b = (more / 2, more / 2) if both else (more, F.lit(0.0)) if reverse else (F.lit(0.0), more)
    return edge(at_distance(e, -a), at_distance(e, b, e["b"]))


def normalized(e: Column, from_end: bool = False) -> Column:
    """Of length one, from the start or, reversed in place, up to the end."""
    d = edge_direction(e)
    return edge(v.subtract(e["b"], d), e["b"]) if from_end else edge(e["a"], v.add(e["a"], d))


def offset_2d(e: Column, by=1.0) -> Column:
    """Moved to its left in plan, down to z = 0; null for an edge without length in plan."""
    dx, dy = x(e["b"]) - x(e["a"]), y(e["b"]) - y(e["a"])
    size = F.sqrt(dx * dx + dy * dy)
    ox, oy = -dy / size * _n(by), dx / size * _n(by)
    return F.when(size >= TOLERANCE, edge(point(x(e["a"]) + ox, y(e["a"]) + oy), point(x(e["b"]) + ox, y(e["b"]) + oy)))


def offset_point_2d(p: Column, e: Column, by=1.0) -> Column:
    """A point moved by the edge's left-hand normal in plan."""
    dx, dy = x(e["b"]) - x(e["a"]), y(e["b"]) - y(e["a"])
    size = F.sqrt(dx * dx + dy * dy)
    return F.when(size >= TOLERANCE, point(x(p) - dy / size * _n(by), y(p) + dx / size * _n(by), z(p)))


def connection(e: Column, f: Column) -> Column:
    """The shortest edge from an end of the first to an end of the second; the earlier ends on ties."""
    pairs = [(a, b) for a in "ab" for b in "ab"]  # their places settle ties
    ranked = F.array(*[F.struct(quadrance(e[a], f[b]).alias("d"), F.lit(i).alias("i"), edge(e[a], f[b]).alias("e")) for i, (a, b) in enumerate(pairs)])
    return F.array_min(ranked)["e"]


def extend_to_edge(e: Column, f: Column) -> Column:
    """The nearer end of the first moved to where the lines cross in plan; unchanged if they do not."""
    def moved(p: Column) -> Column:
        return F.when(p.isNotNull(), F.when(quadrance(e["a"], p) < quadrance(e["b"], p), edge(p, e["b"])).otherwise(edge(e["a"], p)))

    return F.coalesce(let(intersect_2d(e, f), moved), e)


def trim_by_edge(e: Column, f: Column, reverse: bool = False) -> Column:
    """The part before, or reversed after, the crossing; unchanged if there is none within both edges."""
    def part(p: Column) -> Column:
        within = lambda own: parameter_at(own, p).between(-1e-9, 1 + 1e-9)
        return F.when(p.isNotNull() & within(e) & within(f), edge(p, e["b"]) if reverse else edge(e["a"], p))

    return F.coalesce(let(intersect_2d(e, f), part), e)


def bisect(e: Column, f: Column, length=1.0) -> Column:
    """From the common start along the mean of both directions."""
    return edge_by_origin(e["a"], v.bisect(edge_direction(e), edge_direction(f)), length)


# --- loops of points: wires and faces


def _next(points: Column, i: Column) -> Column:
    return F.element_at(points, (i + 1) % F.size(points) + 1)


def edges_of(points: Column, closed: bool = True) -> Column:
    all_edges = let(points, lambda pts: F.transform(pts, lambda p, i: edge(p, _next(pts, i))))
    return all_edges if closed else F.slice(all_edges, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))


def wire_length(points: Column, closed: bool = True) -> Column:
    return F.aggregate(edges_of(points, closed), F.lit(0.0), lambda s, e: s + edge_length(e))


def is_closed(points: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether a chain of points ends where it begins."""
    return is_coincident(F.element_at(points, 1), F.element_at(points, -1), tolerance)


def close(points: Column) -> Column:
    return F.when(is_closed(points), points).otherwise(F.concat(points, F.slice(points, 1, 1)))


def reversed_loop(points: Column) -> Column:
    return F.reverse(points)


def area_vector(points: Column) -> Column:
    doubled = let(points, lambda pts: F.aggregate(F.transform(pts, lambda p, i: v.cross(p, _next(pts, i))), origin(), v.add))
    return F.transform(doubled, lambda c: c / 2)


def area(points: Column) -> Column:
    return let(area_vector(points), v.magnitude)


def compactness(points: Column) -> Column:
    """The perimeter of the circle of the same area over the perimeter."""
    return 2 * math.sqrt(math.pi) * F.sqrt(area(points)) / wire_length(points)


def interior_angles(points: Column) -> Column:
    """Degrees at each corner of a planar loop, over 180 where it turns back."""
    def angles(given: Column) -> Column:
        pts, n = given["points"], given["normal"]

        def at(p: Column, i: Column) -> Column:
            back = v.subtract(F.element_at(pts, (i + F.size(pts) - 1) % F.size(pts) + 1), p)
            ahead = v.subtract(_next(pts, i), p)
            t = v.angle(back, ahead)
            return F.when(v.dot(v.cross(ahead, back), n) < -1e-12, 360 - t).otherwise(t)

        return F.transform(pts, at)

    return let(F.struct(points.alias("points"), normal(points).alias("normal")), angles)


def exterior_angles(points: Column) -> Column:
    return F.transform(interior_angles(points), lambda t: 360 - t)


def is_convex(points: Column, tolerance: float = TOLERANCE) -> Column:
    return F.forall(interior_angles(points), lambda t: t <= 180 + tolerance)


def faces_angle(a: Column, b: Column) -> Column:
    return v.angle(normal(a), normal(b))


def faces_coplanar(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return let(plane(a), lambda of: F.forall(b, lambda q: perpendicular_distance(q, of) <= tolerance))


def facing_toward(points: Column, direction: Column, tolerance: float = TOLERANCE) -> Column:
    return v.dot(normal(points), v.normalize(direction)) > tolerance


def face_compass_angle(points: Column) -> Column:
    return v.compass_angle(normal(points))


def normal_edge(points: Column, length=1.0) -> Column:
    return edge_by_origin(centroid(points), normal(points), length)


def planarize(points: Column) -> Column:
    return let(plane(points), lambda of: F.transform(points, lambda q: project(q, of)))


def remove_collinear(points: Column, tolerance: float = TOLERANCE) -> Column:
    """Without the corners of a loop where it goes straight on."""
    def bent(pts: Column) -> Column:
        n = F.size(pts)

        def straight(i: Column) -> Column:
            p = F.element_at(pts, i + 1)
            a = v.subtract(p, F.element_at(pts, (i + n - 1) % n + 1))
            b = v.subtract(F.element_at(pts, (i + 1) % n + 1), p)
            return (v.magnitude(v.cross(a, b)) <= tolerance * v.magnitude(a) * v.magnitude(b)) & (v.dot(a, b) > 0)

        return F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~straight(i)), lambda i: F.element_at(pts, i + 1))

    return let(points, bent)


def along(points: Column, by, closed: bool = False) -> Column:
    """The point at a distance along a chain; null beyond its ends."""
    es = edges_of(points, closed)
    d = _n(by)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("array<double>").alias("p"))

    def step(acc: Column, e: Column) -> Column:
        size = edge_length(e)
        here = acc["p"].isNull() & (d >= acc["s"]) & (d <= acc["s"] + size)
        return F.struct((acc["s"] + size).alias("s"), F.when(here, at_distance(e, d - acc["s"])).otherwise(acc["p"]).alias("p"))

    return F.aggregate(es, zero, step)["p"]


def along_parameter(points: Column, u, closed: bool = False) -> Column:
    return along(points, _n(u) * wire_length(points, closed), closed)


def distance_along(points: Column, p: Column, closed: bool = False, tolerance: float = TOLERANCE) -> Column:
    """The distance along a chain up to a point on it; null if it is on none of its edges."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("at"))

    def step(acc: Column, e: Column) -> Column:
        here = acc["at"].isNull() & is_on_edge(p, e, tolerance)
        return F.struct((acc["s"] + edge_length(e)).alias("s"), F.when(here, acc["s"] + distance(e["a"], p)).otherwise(acc["at"]).alias("at"))

    return F.aggregate(edges_of(points, closed), zero, step)["at"]


def parameter_along(points: Column, p: Column, closed: bool = False) -> Column:
    return distance_along(points, p, closed) / wire_length(points, closed)


def is_inside_2d(p: Column, points: Column, boundary: bool = True) -> Column:
    """Whether a loop encloses a point in plan: an upward ray's crossings are odd, or the point is on its boundary."""
    flat = lambda q: point(x(q), y(q))
    es = edges_of(F.transform(points, flat))
    crossings = F.size(F.filter(es, lambda e: ((y(e["a"]) > y(p)) != (y(e["b"]) > y(p))) & (x(p) < (x(e["b"]) - x(e["a"])) * (y(p) - y(e["a"])) / (y(e["b"]) - y(e["a"])) + x(e["a"]))))
    on = F.exists(es, lambda e: is_on_edge(flat(p), e))
    return F.when(on, F.lit(boundary)).otherwise(crossings % 2 == 1)


def bounding_rectangle(points: Column) -> Column:
    """The loop of the least rectangle along the axes in plan, at the lowest z."""
    b = bounds(points)
    lo, hi = b["lo"], b["hi"]
    return F.array(point(x(lo), y(lo), z(lo)), point(x(hi), y(lo), z(lo)), point(x(hi), y(hi), z(lo)), point(x(lo), y(hi), z(lo)))


def at_parameters(points: Column, u, w) -> Column:
    """The point of a rectangle of four corners at two parameters along its first two sides."""
    a, b, d = F.element_at(points, 1), F.element_at(points, 2), F.element_at(points, 4)
    return v.add(v.add(a, v.multiply(v.subtract(b, a), _n(u))), v.multiply(v.subtract(d, a), _n(w)))


def parameters_of(points: Column, p: Column) -> Column:
    """The two parameters of a point on a rectangle of four corners."""
    a, b, d = F.element_at(points, 1), F.element_at(points, 2), F.element_at(points, 4)
    r, s, t = v.subtract(b, a), v.subtract(d, a), v.subtract(p, a)
    return F.array(v.dot(t, r) / v.dot(r, r), v.dot(t, s) / v.dot(s, s))


def fan(points: Column) -> Column:
    """The triangles of a convex loop, all from its first corner."""
    return let(points, lambda pts: F.transform(F.sequence(F.lit(2), F.size(pts) - 1), lambda i: F.array(F.element_at(pts, 1), F.element_at(pts, i), F.element_at(pts, i + 1))))
