"""A complete evaluation on a small cohort, its refusals, and the multi-run comparison."""

import dataclasses
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugework.operators import protocol, scoring
from gaugework.operators.constraints import ConstraintError

STUDY = protocol.Study(
    unit="key", entity="entity", partition="split", stratum="grp",
    metrics=("mae", "psnr"), baseline="none", methods=("none", "shrink"), allowed=("train", "validation"),
    expected={"train": 12, "validation": 9, "test": 7},
)
METHODS = {"none": lambda c: c, "shrink": lambda c: F.transform(c, lambda v: 0.9 * v + 0.05)}


@pytest.fixture(scope="module")
def manifest(spark):
    rng = np.random.default_rng(8)
    rows = []
    for entity, split, n in (("1", "train", 5), ("2", "train", 7), ("3", "validation", 2), ("10", "validation", 7), ("4", "test", 7)):
        for i in range(n):
            clean = rng.random(16)
            rows.append((f"{entity}/{i}", entity, split, "AB"[int(entity) % 2], clean.tolist(), np.clip(clean + rng.normal(0, 0.1, 16), 0, 1).tolist()))
    return spark.createDataFrame(rows, "key string, entity string, split string, grp string, clean array<double>, given array<double>").cache()


def score(units):
    out = scoring.score_methods(units, ["key", "entity", "grp"], "given", "clean", METHODS)
    return out.select("key", "entity", "grp", "method", "input_digest", "mae", "psnr")


def test_complete_run_then_refused(spark, manifest, tmp_path):
    dest = str(tmp_path / "validation")
    tables = protocol.evaluate(manifest, STUDY, "validation", score, dest)
    assert tables["units"].count() == 18
    assert {r["entity"]: r["unit_count"] for r in tables["entities"].where("method = 'none'").collect()} == {"3": 2, "10": 7}
    primary = {(r["method"], r["metric"]): r["mean"] for r in tables["primary"].collect()}
    entity = tables["entities"].where("method = 'shrink'").agg(F.avg("mean_mae")).first()[0]
    assert primary["shrink", "mae"] == pytest.approx(entity)
    row = tables["summary_shrink"].where("metric = 'mae'").first()
    assert row["improved"] + row["worsened"] + row["tied"] == 2
    assert row["mean"] == pytest.approx(primary["shrink", "mae"] - primary["none", "mae"])
    assert spark.read.parquet(dest + "/units").where("method = 'none'").count() == 9
    assert os.path.exists(dest + "/receipt.json")
    with pytest.raises(Exception, match="exists already"):
        protocol.evaluate(manifest, STUDY, "validation", score, dest)


def test_gates_stop_before_scoring(spark, manifest):
    def untouched(_):
        raise AssertionError("scored in spite of a failed gate")

    with pytest.raises(ConstraintError, match="not open"):
        protocol.evaluate(manifest, STUDY, "test", untouched)
    leaking = manifest.withColumn("split", F.when(F.col("key") == "1/0", "validation").otherwise(F.col("split")))
    with pytest.raises(ConstraintError, match="expected counts.*no entity in two partitions"):
        protocol.evaluate(leaking, STUDY, "validation", untouched)
    with pytest.raises(ConstraintError, match="unique key"):
        protocol.evaluate(manifest.union(manifest.where("key = '4/0'")), STUDY, "validation", untouched)


@pytest.mark.parametrize("label", [None, "sealed", "stress"])
def test_unknown_labels_stop_before_scoring(manifest, label):
    def untouched(_):
        raise AssertionError("scored in spite of a failed gate")

    study = dataclasses.replace(STUDY, expected={})
    wrong = manifest.withColumn("split", F.when(F.col("entity") == "4", F.lit(label)).otherwise(F.col("split")))
    with pytest.raises(ConstraintError, match="only partitions train,validation: 7 bad"):
        protocol.evaluate(wrong, study, "validation", untouched)
    # A label that the study declares as sealed may stand in the manifest, and is not opened.
    declared = dataclasses.replace(study, sealed=("test",))
    assert protocol.evaluate(manifest, declared, "validation", score)["units"].count() == 18
    with pytest.raises(ConstraintError, match="not open"):
        protocol.evaluate(manifest, declared, "test", untouched)


def test_score_gates(manifest):
    def partial(units):
        return score(units).where("not (method = 'shrink' and key = '3/0')")

    with pytest.raises(ConstraintError, match="plan complete: 1 bad"):
        protocol.evaluate(manifest, STUDY, "validation", partial)

    def broken(units):
        return score(units).withColumn("psnr", F.when(F.col("key") == "3/0", float("nan")).otherwise(F.col("psnr")))

    with pytest.raises(ConstraintError, match="finite psnr: 2 bad 3/0"):
        protocol.evaluate(manifest, STUDY, "validation", broken)

    def other_input(units):
        return score(units).withColumn("input_digest", F.concat("input_digest", F.when(F.col("method") == "none", "x").otherwise("")))

    with pytest.raises(ConstraintError, match="shared input digest: 9 bad"):
        protocol.evaluate(manifest, STUDY, "validation", other_input)


def test_partial_run_may_not_publish(manifest, tmp_path):
    with pytest.raises(Exception, match="limited to 3"):
        protocol.evaluate(manifest, STUDY, "validation", score, str(tmp_path / "c" / "x"), limit=3, canonical=(str(tmp_path / "c"),))


def test_compare_runs(spark):
    results = [
        (m, r, metric, 10.0 + (1.0 if m == "b" else 0.0) * (1 if metric == "full_psnr" else -1))
        for m in "ab" for r in range(5) for metric in ("full_psnr", "full_mae")
    ]
    results = spark.createDataFrame(results, "method string, run int, metric string, value double")
    plan = results.select("method", "run").distinct()
    names = F.explode(F.array(*[F.lit(w) for w in ("plan", "config", "summary", "metrics")]))
    witnesses = plan.select("method", "run", F.lit("seed").alias("field"), names.alias("witness"), F.col("run").cast("string").alias("value"))
    args = ("a", "b", ["full_psnr", "full_mae"], ("mae",), ("psnr",))
    out = protocol.compare_runs(results, plan, witnesses, *args)
    assert out["claim"].first()["claim"] == "b"
    assert {r["phrase"] for r in out["summary"].collect()} == {"all 5 runs favoured b"}
    with pytest.raises(ConstraintError, match="nothing unplanned"):
        protocol.compare_runs(results, plan.where("run < 4"), witnesses, *args)
    with pytest.raises(ConstraintError, match="witnesses agree"):
        protocol.compare_runs(results, plan, witnesses.withColumn("value", F.when(F.col("witness") == "plan", "9").otherwise(F.col("value"))), *args)
    with pytest.raises(ConstraintError, match="witnesses agree"):
        protocol.compare_runs(results, plan, witnesses.where("not (run = 2 and witness = 'plan')"), *args)
    with pytest.raises(PySparkException, match="not paired"):
        short = results.where("not (method = 'a' and run = 3 and metric = 'full_mae')")
        protocol.compare_runs(short, plan, witnesses, *args)["summary"].collect()
