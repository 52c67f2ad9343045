"""What a method asked for beside what clipping left."""

from gaugework.operators.scoring import change_diagnostics, change_summary


def test_cells_at_the_limits_and_cells_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 5, [-1.0, 0.0, 0.5, 1.0, 2.0]), (2, [0.5] * 3, [nan, inf, -inf])]
    units = change_diagnostics(spark.createDataFrame(rows, "id int, given array<double>, raw array<double>"), "given", "raw")
    columns = ("cells", "below", "above", "clamped", "at_low", "at_high", "not_finite")
    assert [tuple(r[c] for c in columns) for r in units.orderBy("id").collect()] == [(5, 1, 1, 2, 2, 2, 0), (3, 1, 1, 2, 1, 1, 3)]
    whole = change_summary(units.where("id = 1")).first()
    assert (whole["fraction_at_low"], whole["fraction_at_high"], whole["failures"]) == (0.4, 0.4, 0)
    assert change_summary(units).first()["failures"] == 1
