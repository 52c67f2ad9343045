import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugework.operators.constraints import ConstraintError
from gaugework.sources import catalog, publish


@pytest.fixture
def cohort_dir(tmp_path):
    for source, entity, file, text in [
        ("Train", "1", "a10.json", '{"v": 1}'), ("Train", "1", "a2.JSON", '{"v": 2}'), ("Train", "1", "sub/a1.json", "{bad"),
        ("Train", "2", "x.json", '{"v": 3}'), ("Test", "10", "y z+1.json", '{"v": 4}'), ("Test", "11", "notes.txt", "none"),
    ]:
        path = tmp_path / "root" / source / "CT" / entity / file
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "root")


def test_catalogue(spark, cohort_dir):
    found = catalog.file_catalog(spark, cohort_dir, ".json")
    rows = [(r["source"], r["entity_id"], r["file"], r["entity_files"]) for r in catalog.catalog_order(found).collect()]
    assert rows == [
        ("Train", "1", "a1.json", 3), ("Train", "1", "a2.JSON", 3), ("Train", "1", "a10.json", 3),
        ("Train", "2", "x.json", 1), ("Test", "10", "y z+1.json", 1),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_entity_in_two_sources_is_refused(spark, cohort_dir):
    path = os.path.join(cohort_dir, "Test", "CT", "1")
    os.makedirs(path)
    open(os.path.join(path, "b.json"), "w").write("{}")
    with pytest.raises(PySparkException, match="two sources: 1"):
        catalog.file_catalog(spark, cohort_dir, ".json").collect()


def test_ingest_survives_bad_files(spark, cohort_dir):
    rows = catalog.ingest(spark, cohort_dir, lambda b: json.loads(b), "v bigint", "*.{json,JSON}")
    good, bad = catalog.quarantine(rows)
    assert sorted(r["v"] for r in good.collect()) == [1, 2, 3, 4]
    (row,) = bad.collect()
    assert row["error"].startswith("JSONDecodeError") and row["path"].endswith("a1.json")


def test_parse_json(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("{oops",), (None,)], "t string")
    good, bad = catalog.quarantine(catalog.parse_json(df, "t", "k bigint"))
    assert good.select("parsed.k").first()[0] == 1 and bad.count() == 2


MANIFEST = """subject_id,split,source_archive,acquisition_group,relative_dicom_path,geometric_slice_position,geometric_slice_index
007,train,Train,A,Train/CT/007/a.dcm,1.5,0
10,train,Train,B,Train/CT/10/a.dcm,-2.5,0
2,validation,Train,B,Train/CT/2/b.dcm,2.0,1
2,validation,Train,B,Train/CT/2/a.dcm,1.0,0
3,test,Test,B,Test/CT/3/a.dcm,1.0,0
"""


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    open(path, "w").write(MANIFEST)
    rows = catalog.manifest_order(catalog.read_manifest(spark, path, "train", ["train", "validation"])).collect()
    assert [r["subject_id"] for r in rows] == ["007", "10"] and rows[1]["geometric_slice_position"] == -2.5
    with pytest.raises(ConstraintError, match="not open"):
        catalog.read_manifest(spark, path, "test", ["train", "validation"])
    with pytest.raises(ConstraintError, match="no row"):
        catalog.read_manifest(spark, path, "stress", ["stress"])


def test_summaries(spark, tmp_path):
    for name, value in (("a", 1.5), ("b", 2.5)):
        document = {"split": "validation", "primary_result": {"full_mae": {"mean": value, "std": 0.1}, "full_psnr": {"mean": 30.0}}}
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=2))
    rows = catalog.read_summaries(spark, str(tmp_path), ["full_mae", "full_psnr"])
    assert sorted(r["value"] for r in rows.where("metric = 'full_mae'").collect()) == [1.5, 2.5]
    with pytest.raises(PySparkException, match="no value of body_mae"):
        catalog.read_summaries(spark, str(tmp_path), ["body_mae"]).collect()


def test_file_reads(spark, tmp_path):
    for name in ("a b", "c+d", "e"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / "data" / name))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(str(tmp_path / "data")).select("path")
    listed = listed.where(~F.contains("path", F.lit("/e/"))).withColumn(
        "partition", F.when(F.contains("path", F.lit("a")) & F.contains("path", F.lit("c+d")), "val").otherwise("train")
    )
    read = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "data"))
    got = {r["partition"]: (r["files"], r["rows"], r["refused"]) for r in catalog.file_reads(read, listed, "partition", ["train"]).collect()}
    assert got["unlisted"] == (1, 3, True) and got["train"][2] is False
    assert sum(v[0] for v in got.values()) == 3


def outputs(spark):
    report = spark.createDataFrame([(1 / 3, "x")], "value double, name string")
    return {
        "report": publish.Output(report, "csv", ("name", "value")),
        "summary": publish.Output(report, "json"),
        "units": publish.Output(spark.range(6).withColumn("part", F.col("id") % 2), "parquet", (), ("part",)),
    }


def read_text(folder):
    (name,) = [f for f in os.listdir(folder) if f.startswith("part-")]
    return open(os.path.join(folder, name)).read()


def test_publish_once(spark, tmp_path):
    dest = str(tmp_path / "result")
    publish.publish_once(spark, outputs(spark), dest)
    assert sorted(os.listdir(dest)) == [".receipt.json.crc", "receipt.json", "report", "summary", "units"]
    assert read_text(dest + "/report") == "name,value\nx,0.3333333333\n"
    assert json.loads(read_text(dest + "/summary")) == {"value": 0.3333333333, "name": "x"}
    assert set(json.load(open(dest + "/receipt.json"))["tables"]) == {"report", "summary", "units"}
    assert spark.read.parquet(dest + "/units").where("part = 1").count() == 3
    with pytest.raises(publish.PublicationError, match="exists already"):
        publish.publish_once(spark, outputs(spark), dest)


def test_failed_publication_is_kept_and_not_retried(spark, tmp_path):
    dest = str(tmp_path / "result")
    bad = outputs(spark)
    bad["summary"] = publish.Output(spark.createDataFrame([(float("inf"),)], "value double"), "json")
    with pytest.raises(PySparkException, match="not finite"):
        publish.publish_once(spark, bad, dest)
    assert not os.path.exists(dest) and "FAILED.json" in os.listdir(dest + ".staging")
    with pytest.raises(publish.PublicationError, match="staging exists already"):
        publish.publish_once(spark, outputs(spark), dest)


def test_partial_runs_may_not_publish(spark, tmp_path):
    dest = str(tmp_path / "canonical" / "x")
    with pytest.raises(publish.PublicationError, match="limited to 5"):
        publish.publish_once(spark, outputs(spark), dest, limit=5, canonical=(str(tmp_path / "canonical"),))
    publish.guard_partial(5, str(tmp_path / "debug"), (str(tmp_path / "canonical"),))
    assert publish.run_path("/r", "cnn", 2026) == "/r/cnn/run=2026" and publish.run_path("/r", "none", None) == "/r/none"
