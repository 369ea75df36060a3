"""Vectors and matrices as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where ``body`` names it often or in a lambda."""
    return F.get(F.transform(F.array(value), lambda c: body(c)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(quadrance(a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def normalize(a: Column) -> Column:
    """A unit vector; null for the zero vector."""
    def unit(own: Column) -> Column:
        return let(magnitude(own), lambda m: F.when(m > 0, F.transform(own, lambda x: x / m)))

    return let(a, unit)


def cross(a: Column, b: Column) -> Column:
    def of(both: Column) -> Column:
        g = lambda k, i: F.element_at(both[k], i)
        return F.array(*[g("a", i) * g("b", j) - g("a", j) * g("b", i) for i, j in ((2, 3), (3, 1), (1, 2))])

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def angle(a: Column, b: Column) -> Column:
    """Degrees between two vectors."""
    def of(both: Column) -> Column:
        c = dot(both["a"], both["b"]) / (magnitude(both["a"]) * magnitude(both["b"]))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def compass_angle(a: Column) -> Column:
    """Degrees clockwise from north (the y axis), in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(F.element_at(a, 1), F.element_at(a, 2))) + 360, F.lit(360.0))


def is_parallel(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    return magnitude(cross(a, b)) <= tolerance * magnitude(a) * magnitude(b)


def matrix_multiply(a: Column, b: Column) -> Column:
    """Rows of a times columns of b."""
    width = F.size(F.element_at(b, 1))
    return F.transform(a, lambda row: F.transform(F.sequence(F.lit(1), width), lambda j: dot(row, F.transform(b, lambda r: F.element_at(r, j)))))


def matrix_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, add)


def transpose(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(F.element_at(a, 1))), lambda j: F.transform(a, lambda r: F.element_at(r, j)))


def identity(n: int) -> Column:
    return F.array(*[F.array(*[F.lit(float(i == j)) for j in range(n)]) for i in range(n)])


def transform_point(matrix: Column, p: Column) -> Column:
    """A 4x4 matrix applied to a point of three coordinates."""
    h = F.concat(p, F.array(F.lit(1.0)))
    return F.slice(F.transform(matrix, lambda row: dot(row, h)), 1, 3)


#: Unit vectors by direction; x is east, y north, z up.
DIRECTIONS = {
    "north": (0.0, 1.0, 0.0), "south": (0.0, -1.0, 0.0), "east": (1.0, 0.0, 0.0), "west": (-1.0, 0.0, 0.0), "up": (0.0, 0.0, 1.0), "down": (0.0, 0.0, -1.0),
    "northeast": (1.0, 1.0, 0.0), "northwest": (-1.0, 1.0, 0.0), "southeast": (1.0, -1.0, 0.0), "southwest": (-1.0, -1.0, 0.0),
}


def direction(name: str) -> Column:
    return F.array(*[F.lit(x) for x in DIRECTIONS[name]])


def quadrance(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def spread(a: Column, b: Column) -> Column:
    """The squared sine of the angle."""
    return 1 - dot(a, b) * dot(a, b) / (dot(a, a) * dot(b, b))


def reverse(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def set_magnitude(a: Column, size: float) -> Column:
    return multiply(normalize(a), F.lit(size))


def bisect(a: Column, b: Column) -> Column:
    return normalize(add(normalize(a), normalize(b)))


def is_same(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda t: t)


def is_antiparallel(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    return is_parallel(a, b, tolerance) & (dot(a, b) < 0)


def compass_direction(a: Column, tolerance: float = 1e-4) -> Column:
    """north, northeast, ... by the signs of x and y; up, down or origin where both vanish."""
    sign = lambda i: F.when(F.element_at(a, i) > tolerance, 1).when(F.element_at(a, i) < -tolerance, -1).otherwise(0)
    ns = F.when(sign(2) > 0, "north").when(sign(2) < 0, "south").otherwise("")
    ew = F.when(sign(1) > 0, "east").when(sign(1) < 0, "west").otherwise("")
    upright = F.when(sign(3) > 0, "up").when(sign(3) < 0, "down").otherwise("origin")
    return F.when((sign(1) == 0) & (sign(2) == 0), upright).otherwise(F.concat(ns, ew))


def azimuth(a: Column) -> Column:
    return compass_angle(a)


def altitude(a: Column) -> Column:
    """Degrees above the horizon."""
    return F.degrees(F.atan2(F.element_at(a, 3), F.sqrt(F.element_at(a, 1) ** 2 + F.element_at(a, 2) ** 2)))


def by_azimuth_altitude(az: Column, alt: Column) -> Column:
    r = F.cos(F.radians(alt))
    return F.array(r * F.sin(F.radians(az)), r * F.cos(F.radians(az)), F.sin(F.radians(alt)))


def average(v: Column, size: int = 3) -> Column:
    """Aggregate: the mean vector of a group."""
    return F.array(*[F.avg(F.element_at(v, i + 1)) for i in range(size)])


def total(v: Column, size: int = 3) -> Column:
    """Aggregate: the sum vector of a group."""
    return F.array(*[F.sum(F.element_at(v, i + 1)) for i in range(size)])


def _rows(*rows) -> Column:
    return F.array(*[F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in r]) for r in rows])


def translation(x: Column, y: Column, z: Column) -> Column:
    return _rows((1, 0, 0, x), (0, 1, 0, y), (0, 0, 1, z), (0, 0, 0, 1))


def scaling(x: Column, y: Column, z: Column) -> Column:
    return _rows((x, 0, 0, 0), (0, y, 0, 0), (0, 0, z, 0), (0, 0, 0, 1))


def rotation(axis: str, degrees: Column) -> Column:
    """Counter-clockwise about an axis, seen from its tip."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    rows = {"x": ((1, 0, 0, 0), (0, c, -s, 0), (0, s, c, 0)), "y": ((c, 0, s, 0), (0, 1, 0, 0), (-s, 0, c, 0)), "z": ((c, -s, 0, 0), (s, c, 0, 0), (0, 0, 1, 0))}
    return _rows(*rows[axis], (0, 0, 0, 1))


def matrix_subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, subtract)
