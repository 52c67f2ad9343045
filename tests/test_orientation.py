"""Presence and constancy of the geometry of entities."""

import math

from gaugework.operators.profile import orientation_report

SCHEMA = "entity string, orientation array<double>, position array<double>, instance long"
AXIAL, FLIPPED, SIDE = [1.0, 0, 0, 0, 1, 0], [0.0, 1, 0, 1, 0, 0], [0.0, 1, 0, 0, 0, 1]
TILTED = [1.0, 0, 0, 0, math.cos(1e-8), math.sin(1e-8)]


def report(spark, rows):
    rows = [(e, o and list(map(float, o)), p and list(map(float, p)), i) for e, o, p, i in rows]
    units = spark.createDataFrame(rows, SCHEMA)
    return {r["entity"]: r for r in orientation_report(units, *units.columns).collect()}


def test_constancy_is_exact_for_orientations_and_up_to_sign_and_tolerance_for_planes(spark):
    got = report(
        spark,
        [("same", AXIAL, [0.0, 0, k], k) for k in range(5)]
        + [("flipped", AXIAL, [0.0, 0, 1], 1), ("flipped", FLIPPED, [0.0, 0, 2], 2)]
        + [("near", AXIAL, [0.0, 0, 1], 1), ("near", TILTED, [0.0, 0, 2], 2)]
        + [("turned", AXIAL, [5.0, 0, 1], 1), ("turned", SIDE, [5.0, 0, 2], 2)],
    )
    columns = ("distinct_orientations", "orientation_constant", "plane_constant", "all_axial")
    assert [got["same"][c] for c in columns] == [1, True, True, True] and got["same"]["units"] == 5
    assert [got["flipped"][c] for c in columns] == [2, False, True, True]
    assert [got["near"][c] for c in columns] == [2, False, True, True]
    assert [got["turned"][c] for c in columns] == [2, False, False, False]
    assert got["same"]["max_projected_minus_z"] == 0 and got["flipped"]["max_projected_minus_z"] == 4
    assert got["turned"]["max_projected_minus_z"] == 3


def test_missing_geometry(spark):
    got = report(
        spark,
        [("none", None, None, None), ("none", None, None, 1), ("flat", [1.0, 0, 0, 1, 0, 0], [0.0, 0, 1], 1)]
        + [("part", AXIAL, None, 1), ("part", None, [0.0, 0, 1], None), (None, AXIAL, [0.0, 0, 1], 1)],
    )
    judged = ("orientation_constant", "plane_constant", "all_axial", "max_projected_minus_z")
    fractions = ("position_fraction", "orientation_fraction", "instance_fraction")
    assert [got["none"][c] for c in judged] == [None] * 4 and [got["none"][c] for c in fractions] == [0, 0, 0.5]
    assert [got["flat"][c] for c in judged] == [True, None, None, None]
    assert [got["part"][c] for c in judged] == [True, True, True, None] and [got["part"][c] for c in fractions] == [0.5] * 3
    assert got[None]["units"] == 1 and not report(spark, [])
