"""3-vector, plane and 4x4 algebra as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.numbers import f64, finite

TINY = 1e-12
EDGE_ON = 1e-9
IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column


class Plane(NamedTuple):
    """``normal . p + offset = 0`` with the normal pointing up."""

    normal: Vec
    offset: Column


def vec(x: str, y: str, z: str) -> Vec:
    return Vec(F.col(x), F.col(y), F.col(z))


def fixed(x: float, y: float, z: float) -> Vec:
    return Vec(f64(x), f64(y), f64(z))


def plane(prefix: str = "") -> Plane:
    return Plane(vec(prefix + "nx", prefix + "ny", prefix + "nz"), F.col(prefix + "d"))


def dot(a: Vec, b: Vec) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def length(a: Vec) -> Column:
    return F.sqrt(a.x * a.x + a.y * a.y + a.z * a.z)


def minus(a: Vec, b: Vec) -> Vec:
    return Vec(a.x - b.x, a.y - b.y, a.z - b.z)


def plus(a: Vec, b: Vec) -> Vec:
    return Vec(a.x + b.x, a.y + b.y, a.z + b.z)


def scaled(a: Vec, k: Column) -> Vec:
    return Vec(a.x * k, a.y * k, a.z * k)


def distance(a: Vec, b: Vec) -> Column:
    return length(minus(a, b))


def unit(a: Vec) -> Vec:
    """NULL components when the vector has no usable length."""
    size = length(a)
    return Vec(*(F.when(size > f64(TINY), part / size) for part in a))


def signed_height(p: Plane, at: Vec) -> Column:
    return dot(p.normal, at) + p.offset


def plane_elevation_at(p: Plane, reference: Vec, up: Vec) -> Column:
    """Where the plane crosses the vertical through ``reference``; NULL when seen edge-on."""
    axis = unit(up)
    along = dot(p.normal, axis)
    return F.when(
        F.abs(along) >= f64(EDGE_ON), dot(reference, axis) - signed_height(p, reference) / along
    )


def angle_deg(a: Vec, b: Vec) -> Column:
    cosine = dot(unit(a), unit(b))
    # greatest/least skip NULLs, so guard: a degenerate vector has no angle.
    return F.when(
        cosine.isNotNull(), F.degrees(F.acos(F.greatest(f64(-1), F.least(f64(1), cosine))))
    )


def tilt_deg(n: Vec, up: Vec) -> Column:
    """Angle between two vectors already of unit length."""
    cosine = dot(n, up)
    return F.when(
        cosine.isNotNull(), F.degrees(F.acos(F.greatest(f64(-1), F.least(f64(1), cosine))))
    )


def ground_axes(up: Vec) -> tuple[Vec, Vec]:
    """Two unit axes across the ground for a unit ``up``.

    The seed is the world axis least aligned with ``up`` (x, then y, on ties), and
    its cross product with ``up`` is written out per case to keep the plan small.
    """
    ax, ay, az = (F.abs(part) for part in up)
    x_least = (ax <= ay) & (ax <= az)
    y_least = ay <= az
    zero = f64(0)
    size = F.sqrt(
        F.when(x_least, up.y * up.y + up.z * up.z)
        .when(y_least, up.x * up.x + up.z * up.z)
        .otherwise(up.x * up.x + up.y * up.y)
    )
    e1 = Vec(
        F.when(x_least, zero).when(y_least, up.z).otherwise(-up.y) / size,
        F.when(x_least, -up.z).when(y_least, zero).otherwise(up.x) / size,
        F.when(x_least, up.y).when(y_least, -up.x).otherwise(zero) / size,
    )
    return e1, cross(up, e1)


def entry(matrix: Column, index: int) -> Column:
    return matrix.getItem(index).cast("double")


def transform_point(matrix: Column, p: Vec) -> Vec:
    return Vec(
        *(
            entry(matrix, r) * p.x
            + entry(matrix, r + 1) * p.y
            + entry(matrix, r + 2) * p.z
            + entry(matrix, r + 3)
            for r in (0, 4, 8)
        )
    )


def transform_direction(matrix: Column, v: Vec) -> Vec:
    return unit(
        Vec(
            *(
                entry(matrix, r) * v.x + entry(matrix, r + 1) * v.y + entry(matrix, r + 2) * v.z
                for r in (0, 4, 8)
            )
        )
    )


def usable_alignment(matrix: Column) -> Column:
    """The stored 4x4, or the identity when it is missing or malformed."""
    good = (F.size(matrix) == 16) & F.forall(matrix, lambda v: finite(v.cast("double")))
    identity = F.array(*(f64(v) for v in IDENTITY))
    return F.when(F.coalesce(good, F.lit(False)), matrix.cast("array<double>")).otherwise(identity)


def invert_rigid4(matrix: Column) -> Column:
    """Inverse of an affine 4x4 (last row 0 0 0 1) by cofactors; NULL when singular or not affine.

    Singular is meant relative to the matrix's own scale, so a small uniform scale has an inverse.
    """
    m = [[entry(matrix, 4 * r + c) for c in range(4)] for r in range(3)]

    def cofactor(r: int, c: int) -> Column:
        r1, r2 = (r + 1) % 3, (r + 2) % 3
        c1, c2 = (c + 1) % 3, (c + 2) % 3
        return m[r1][c1] * m[r2][c2] - m[r1][c2] * m[r2][c1]

    det = sum((m[0][c] * cofactor(0, c) for c in range(1, 3)), m[0][0] * cofactor(0, 0))
    rows: list[Column] = []
    for r in range(3):
        linear = [cofactor(c, r) / det for c in range(3)]
        shift = -(linear[0] * m[0][3] + linear[1] * m[1][3] + linear[2] * m[2][3])
        rows += [*linear, shift]
    rows += [f64(0), f64(0), f64(0), f64(1)]
    size = F.greatest(*(F.abs(m[r][c]) for r in range(3) for c in range(3)))
    affine = F.lit(True)
    for c, wanted in enumerate((0, 0, 0, 1)):
        affine = affine & (F.abs(entry(matrix, 12 + c) - f64(wanted)) <= f64(TINY))
    return F.when(affine & (det != 0) & (F.abs(det) >= f64(TINY) * size * size * size), F.array(*rows))
