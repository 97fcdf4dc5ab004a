"""Readers, writers and generators."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import learning
from tessera.operators import order_quality as oq
from tessera.plans.generated import EXPECTED
from tessera.sources import files, generators


def test_text_csv_keeps_text_and_json_array_round_trips(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n007,x\n2,\n")
    df = files.read_text_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "string", "name": "string"} and df.first().id == "007"
    assert json.loads(files.json_array(df, ["id"]).first().json) == [{"id": "007", "name": "x"}, {"id": "2", "name": ""}]


def test_null_and_empty_stay_apart(spark, tmp_path):
    (tmp_path / "b.csv").write_text('log_id,raw\n1,\n2,""\n3,"a\nb, ""q"""\n')
    got = {r.log_id: r.raw for r in files.read_multiline_csv(spark, str(tmp_path / "b.csv"), "log_id long, raw string").collect()}
    assert got[1] is None and got[3] == 'a\nb, "q"' and got[2] in ("", None)


def test_landing_adds_origin(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "12":
        (tmp_path / "in" / f"f{n}.csv").write_text("a,b\n x ,NULL\ny,null\n,z\n")
    got = files.landed(spark, str(tmp_path / "in"), ["a", "b"], F.lit("2026-01-01").cast("timestamp_ntz")).collect()
    assert sorted((r.source_file, r.source_row, r.a, r.b) for r in got if r.source_file == "f1.csv") == [("f1.csv", 1, "x", None), ("f1.csv", 2, "y", None), ("f1.csv", 3, None, "z")]
    assert len({r.load_batch_id for r in got}) == 2


def test_publish_checks_before_it_replaces(spark, tmp_path):
    df = spark.range(5)
    with pytest.raises(ValueError):
        files.publish(df, str(tmp_path / "t"), F.col("id") < 4)
    assert files.publish(df, str(tmp_path / "t"), F.col("id") < 5).count() == 5
    with pytest.raises(ValueError):
        files.publish(df, str(tmp_path / "t"), F.col("id") < 5)
    files.load_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.load_once(df, str(tmp_path / "once"))


def test_new_files_are_converted_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,v\n1,x\n")
    run = lambda: files.convert_new_files(spark, str(tmp_path / "in"), "id string, v string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "b.csv").write_text("id,v\n2,y\n")
    run()
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_dated_folders(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP '2026-03-04 05:00:00' AS ts, 1 AS x")
    files.write_dated(df, str(tmp_path / "d"), "ts")
    assert (tmp_path / "d/year=2026/month=03/day=04").exists()


def test_every_planted_defect_is_found_and_nothing_else(spark):
    rows = generators.orders(spark, 24)
    e = oq.evaluate(rows).select("defect", "quality_status", "quality_reason").collect()
    assert all((r.quality_status == "GOOD") for r in e if r.defect is None)
    for r in e:
        if r.defect and r.defect != "duplicate_id":
            assert EXPECTED[r.defect] in r.quality_reason
    a, b = rows.select("order_id", "amount"), generators.orders(spark, 24).repartition(3).select("order_id", "amount")
    assert a.exceptAll(b).count() == 0


def test_model_is_saved_and_predicts_the_same(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), ((F.col("id") % 20) > 9).cast("double").alias("label"))
    train, test = learning.split(df, "id")
    model = learning.fit(train, ["x"], "label")
    model.save(str(tmp_path / "m"))
    again = learning.predict(PipelineModel.load(str(tmp_path / "m")), test)
    assert learning.report(again, "label").first().accuracy > 0.9
    assert again.select("id", "prediction").exceptAll(learning.predict(model, test).select("id", "prediction")).count() == 0
