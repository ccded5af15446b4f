"""Column expressions: colour, eigenvalues, point to triangle, polygons, dip, raster cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def micro(c: Column) -> Column:
    """Millionths as a whole number: how doubles leave a query."""
    return F.floor(c * 1e6 + 0.5).cast("long")


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


#: The stops of the field ramp, blue to red.
RAMP = ((0.0, 0.0, 1.0), (0.0, 1.0, 1.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.0, 0.0))


def ramp(t: Column) -> list[Column]:
    """Red, green, blue of 0 to 1 along the stops."""
    s = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * float(len(RAMP) - 1)
    k = F.least(F.floor(s), F.lit(len(RAMP) - 2))
    out = []
    for channel in range(3):
        c = F.lit(0.0)
        for i in reversed(range(len(RAMP) - 1)):
            low, high = RAMP[i][channel], RAMP[i + 1][channel]
            c = F.when(k == i, F.lit(low) + (s - float(i)) * (high - low)).otherwise(c)
        out.append(c)
    return out


def byte(c: Column) -> Column:
    return F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int")


def colour(mode: str, z_range: tuple[float, float] = (0.0, 1.0), field: str = "field", field_range: tuple[float, float] = (0.0, 1.0)) -> list[Column]:
    """Red, green, blue of 0 to 1 for a display mode."""
    rgb = [F.col(c) / 255.0 for c in "rgb"]
    shine = F.col("intensity") / 255.0
    scaled = lambda c, lo, hi: (c - lo) / ((hi - lo) or 1.0)
    # Fixed values below: the floor and the gain of shine, and the flat colour.
    if mode == "rgb":
        return rgb
    if mode == "intensity":
        return [shine] * 3
    if mode == "shaded":
        return [c * (F.lit(0.35) + shine * 0.9) for c in rgb]
    if mode == "elevation":
        return ramp(scaled(F.col("z"), *z_range))
    if mode == "normal":
        return [F.col(f"n{c}") * 0.5 + 0.5 for c in "xyz"]
    if mode == "field":
        return ramp(scaled(F.col(field), *field_range))
    if mode == "flat":
        return [F.lit(v) for v in (0.72, 0.75, 0.76)]
    raise ValueError(f"no colour mode {mode!r}")


def toned(c: Column, bright: float = 1.0, gamma: float = 1.0) -> Column:
    return F.pow(c * bright, F.lit(1.0 / gamma))


#: The light on a face that looks down and on one that looks up.
SHADE = (0.45, 1.25)


def shaded(c: Column, nz: Column) -> Column:
    """A channel under light from above; what has no normal stays as it is."""
    return F.coalesce(c * (F.lit(SHADE[0]) + (nz * 0.5 + 0.5) * (SHADE[1] - SHADE[0])), c)


def tinted(rgb: list[Column], tint: tuple[float, float, float] | None) -> list[Column]:
    """Channels multiplied by a layer's tint of 0 to 1, if it has one."""
    return rgb if tint is None else [c * float(t) for c, t in zip(rgb, tint, strict=True)]


def exact_sum(c: Column, places: int = 12) -> Column:
    """A sum that does not depend on the order of rows or partitions: decimals of so many places add exactly."""
    return F.sum(F.round(c, places).cast(f"decimal(28,{places})")).cast("double")


#: What a part of a number counts of the next, and the size from which a number is not taken apart.
PART, LARGE = float(1 << 30), float(1 << 32)


def split(c: Column) -> list[Column]:
    """Three whole numbers and a double that a number is the ``joined`` of: its floor, two times thirty bits of what is left,
    and the number itself where it is too large or not finite. Sums of whole numbers do not depend on the order of rows."""
    small = F.abs(c) < LARGE
    bits = (c - F.floor(c)) * PART
    parts = [F.floor(c), F.floor(bits), F.floor((bits - F.floor(bits)) * PART)]
    return [*[F.when(small, p).when(~small, F.lit(0)).cast("long") for p in parts], F.when(small, 0.0).otherwise(c)]


def joined(parts: list[Column]) -> Column:
    """The number whose parts, or sums of parts, these are."""
    whole, high, low, large = (p.cast("double") for p in parts)
    return whole + (high + low / PART) / PART + large


def true_sum(c: Column) -> Column:
    """A sum to 60 binary places that does not depend on the order of rows, of numbers of any size below LARGE."""
    return joined([F.sum(p) for p in split(c)])


def eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> tuple[Column, Column, Column]:
    """Of a symmetric 3x3 matrix, ascending, in closed form: the mean plus scaled cosines of a third of an angle."""
    q = (xx + yy + zz) / 3.0
    p1 = xy * xy + xz * xz + yz * yz
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + p1 * 2.0
    p = F.sqrt(p2 / 6.0)
    s = F.nullif(p, F.lit(0.0))
    a, b, c, d, e, f = (xx - q) / s, (yy - q) / s, (zz - q) / s, xy / s, xz / s, yz / s
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2.0
    angle = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3.0
    high = F.coalesce(q + p * 2.0 * F.cos(angle), q)
    low = F.coalesce(q + p * 2.0 * F.cos(angle + 2.0 * math.pi / 3.0), q)
    return low, q * 3.0 - high - low, high


def eigenvector(value: Column, xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> list[Column]:
    """A unit vector for an eigenvalue: the longest cross product of two rows of the matrix less the value."""
    rows = [(xx - value, xy, xz), (xy, yy - value, yz), (xz, yz, zz - value)]

    def cross(u, v):
        return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])

    options = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    squares = [o[0] * o[0] + o[1] * o[1] + o[2] * o[2] for o in options]
    best = F.greatest(*squares)
    length = F.nullif(F.sqrt(best), F.lit(0.0))
    return [F.when(squares[0] == best, options[0][k]).when(squares[1] == best, options[1][k]).otherwise(options[2][k]) / length for k in range(3)]


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a, b) -> tuple:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def point_triangle(p, a, b, c) -> tuple[Column, Column]:
    """(squared distance, side) of a point and a triangle: the nearest of its plane, edges and corners, by which lies beside the point.

    The foot on the plane counts if it falls inside; else the nearest point of the three edges. side is the sign of
    the offset along the triangle's normal."""
    ab, ac, ap = minus(b, a), minus(c, a), minus(p, a)
    n = (ab[1] * ac[2] - ab[2] * ac[1], ab[2] * ac[0] - ab[0] * ac[2], ab[0] * ac[1] - ab[1] * ac[0])
    nn = F.nullif(dot(n, n), F.lit(0.0))
    d00, d01, d11, d20, d21 = dot(ab, ab), dot(ab, ac), dot(ac, ac), dot(ap, ab), dot(ap, ac)
    v, w = (d11 * d20 - d01 * d21) / nn, (d00 * d21 - d01 * d20) / nn
    inside = (v >= 0) & (w >= 0) & (v + w <= 1)

    def edge(s, e):
        d, f = minus(e, s), minus(p, s)
        t = F.least(F.greatest(F.coalesce(dot(f, d) / F.nullif(dot(d, d), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        away = tuple(f[k] - d[k] * t for k in range(3))
        return dot(away, away)

    height = dot(ap, n)
    d2 = F.when(inside, height * height / nn).otherwise(F.least(edge(a, b), edge(b, c), edge(c, a)))
    return d2, F.signum(height)


def in_polygon(u: Column, v: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd: an odd number of edges crossed by a ray. The polygon is part of the plan, so edges unroll; u and v stand
    in a struct of their own, so each is computed once, not once for each edge."""
    edges = [(a, b) for a, b in zip(polygon, [*polygon[1:], polygon[0]], strict=True) if a[1] != b[1]]

    def odd(p: Column) -> Column:
        crossed = F.lit(0)
        for (x1, y1), (x2, y2) in edges:
            at = (p["v"] - y1) / (y2 - y1) * (x2 - x1) + x1
            crossed = crossed + F.when(((F.lit(y1) > p["v"]) != (F.lit(y2) > p["v"])) & (p["u"] < at), 1).otherwise(0)
        return crossed % 2 == 1

    return F.exists(F.array(F.struct(u.alias("u"), v.alias("v"))), odd)


def dip(nx: Column, ny: Column, nz: Column) -> tuple[Column, Column]:
    """Dip and dip direction of a plane in degrees; the direction of a plane that hardly dips is 0."""
    steep = F.degrees(F.acos(F.least(F.abs(nz), F.lit(1.0))))
    toward = F.degrees(F.atan2(-nx, -ny))
    return steep, F.when(steep < 0.01, F.lit(0.0)).otherwise(toward - F.floor(toward / 360.0) * 360.0)
