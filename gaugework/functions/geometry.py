"""Plane normals and projected positions from direction cosines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: tolerance of the axial test.
AXIAL_TOLERANCE = 1e-6


def _at(c: Column, i: int) -> Column:
    return F.get(c, F.lit(i)).cast("double")


def plane_normal(orientation: Column) -> Column:
    """Unit normal of the plane spanned by six direction cosines; null if undefined."""
    a = [_at(orientation, i) for i in range(3)]
    b = [_at(orientation, i) for i in range(3, 6)]
    cross = F.array(
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )
    norm = F.sqrt(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v * v))
    usable = (F.size(orientation) == 6) & (norm > 0)
    return F.when(usable, F.transform(cross, lambda v: v / norm))


def projected_position(position: Column, normal: Column) -> Column:
    """Dot product of a position with the plane normal."""
    return sum((_at(position, i) * _at(normal, i) for i in range(1, 3)), _at(position, 0) * _at(normal, 0))


def is_axial(normal: Column, tolerance: float = AXIAL_TOLERANCE) -> Column:
    """True when the normal is the z axis, in either direction."""
    near = F.lit(tolerance)
    return (
        (F.abs(_at(normal, 0)) <= near)
        & (F.abs(_at(normal, 1)) <= near)
        & (F.abs(F.abs(_at(normal, 2)) - F.lit(1.0)) <= near)
    )
