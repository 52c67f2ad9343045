"""One-pass gates against the checks that run one by one, and their plans."""

import random
from functools import reduce

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gaugework.operators import constraints as q
from gaugework.operators.gates import Gates, RowGates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 2, 3, None]), r.choice(["a", "b", None]), r.choice([1.5, -0.5, None]), bytes([r.randrange(3)]), [r.randrange(2)]) for _ in range(60)]
    schema = "k long, part string, x double, raw binary, list array<int>"
    left = spark.createDataFrame(rows, schema)
    return left.repartition(4), spark.createDataFrame([(i, "a", 1.0, b"", []) for i in (1, 2, 9)], schema)


def rows_of(report):
    return sorted((r["check"], r["passed"], r["n_bad"]) for r in report.collect())


def test_one_pass_equals_one_by_one(tables):
    left, right = tables
    gates = Gates()
    one, two = gates.table(left), gates.table(right)
    one.unique(["k", "part"]).unique(["raw", "list"]).constant(["k"], ["part", "x"]).no_leakage("part", "k")
    one.rows({"positive": F.col("x") > 0, "labelled": F.col("part").isNotNull()}).domain("part", ["a"])
    two.unique(["k"]).not_empty().only_partitions("part", ["a"])
    gates.same_keys(one, ["k"], two, ["k"])
    gates.planned(two, ["k"], one, ["k"])
    singly = [
        q.unique(left, ["k", "part"]), q.unique(left, ["raw", "list"]), q.constant(left, ["k"], ["part", "x"]),
        q.no_leakage(left, "part", "k"), q.rows(left, {"positive": F.col("x") > 0, "labelled": F.col("part").isNotNull()}),
        q.domain(left, "part", ["a"]), q.unique(right, ["k"]), q.not_empty(right), q.only_partitions(right, "part", ["a"]),
        q.same_keys(left.select("k"), right.select("k"), ["k"]),
    ]
    report = rows_of(gates.report())
    missing = ("plan complete", False, 1)
    extra = ("nothing unplanned", False, 2)  # 3 and the null key
    assert report == sorted(rows_of(reduce(lambda a, b: a.unionByName(b), singly)) + [missing, extra])


def test_counts_routes_and_empty_tables(tables):
    left, right = tables
    gates = Gates()
    n = left.count()
    parts = {r["part"]: r["count"] for r in left.groupBy("part").count().collect() if r["part"]}
    rows = gates.table(left)
    rows.expected_counts("part", parts, check="without the null group").expected_counts("part", {"a": parts["a"], "z": 3}, n, "missing z")
    rows.two_routes(["k"], "x", ["part"], 1e-9)
    empty = gates.table(left.where("false"))
    empty.not_empty("rows wanted").unique(["k"], "unique of none").expected_counts("part", {"a": 1}, check="none of one")
    found = {c: (ok, bad) for c, ok, bad in rows_of(gates.report())}
    assert found == {
        "without the null group": (False, 2),  # the group, and the total
        "missing z": (False, 3),  # z is missing, b and null are unplanned
        "two routes agree": (True, 0),
        "rows wanted": (False, 1),
        "unique of none": (True, 0),
        "none of one": (False, 2),
    }


def test_every_table_is_read_once(spark):
    plan = contract.queries()["gate_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_row_gates_ride_on_the_pass(spark, tables, tmp_path):
    gates = RowGates({"positive": F.col("x") > 0, "all": F.lit(True)}, "k")
    gates.watch(tables[0]).write.parquet(str(tmp_path / "kept"))
    bad = tables[0].where("x is null or x <= 0")
    found = {r["check"]: r for r in gates.report(spark).collect()}
    assert gates.n_rows == 60 and found["positive"]["n_bad"] == bad.count() and not found["positive"]["passed"]
    assert found["positive"]["detail"] == str(bad.agg(F.min("k")).first()[0]) and found["all"]["passed"]


def test_only_open_rows_reach_a_reader(tables):
    left, _ = tables
    open_rows = left.where("part = 'a'")
    assert q.require_open(open_rows, "part", ["a"]).count() == open_rows.count()
    for label in ("part = 'b'", "part is null"):
        with pytest.raises(PySparkException, match="sealed or unknown partition"):
            q.require_open(left.where(label), "part", ["a"]).select("k").collect()
    with pytest.raises(q.ConstraintError, match="no column"):
        q.require_open(left.drop("part"), "part", ["a"])
