"""Client reads, guards, remembered results, failure rows and file names."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import order_quality as oq
from tessera.operators import relations as rel
from tessera.sources import files


def test_client_rows_are_bounded(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id int, skills array<string>")
    assert sorted(rel.to_client(df), key=lambda r: r["id"]) == [{"id": 1, "skills": ["a", "b"]}, {"id": 2, "skills": None}]
    with pytest.raises(ValueError, match="over 1 rows"):
        rel.to_client(df, 1)


def test_a_guard_sees_changed_inputs(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    read = lambda: spark.read.schema("id long").parquet(path)
    assert rel.guarded(spark, {"t": read}, lambda: read().agg(F.sum("id").alias("s"))).first().s == 3

    def bad():
        spark.range(1).write.mode("append").parquet(path)
        spark.catalog.refreshByPath(path)
        return read()

    with pytest.raises(RuntimeError, match="read-only"):
        rel.guarded(spark, {"t": read}, bad)


def test_a_result_is_remembered(spark):
    rel.remember(spark.range(4))
    assert spark.sql("SELECT count(*) FROM last_result").first()[0] == 4
    spark.catalog.uncacheTable("last_result")


def test_a_failed_run_leaves_a_row(spark):
    report = spark.createDataFrame([("2026-01-01", 5, "HEALTHY", "fine")], "report_date string, total long, status string, remarks string").withColumn("report_date", F.to_date("report_date"))
    assert oq.verified_report(report, True, True).first().status == "HEALTHY"
    r = oq.verified_report(report, False, True).first()
    assert (r.status, r.details) == ("FAILED", "rows do not add up")
    kept = []

    def build():
        raise KeyError("orders")

    with pytest.raises(KeyError):
        oq.run_report(spark, "2026-01-02", build, lambda df: kept.append(df.first()), report)
    assert (str(kept[0].report_date), kept[0].status, kept[0].total, kept[0].details) == ("2026-01-02", "FAILED", None, "KeyError: 'orders'")


def test_names_and_arrays(spark, tmp_path):
    names = {"a-1_b.json": True, "../x": False, "a b": False, "": False, "x\n": False}
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("ok", files.is_safe_name("n"))
    assert {r.n: r.ok for r in df.collect()} == names
    assert files.json_name("in/a.csv") == "in/a.json"
    with pytest.raises(ValueError, match="too many"):
        files.json_array(spark.range(5), ["id"], most=4)
    files.write_json_lines(spark.createDataFrame([(1, None)], "id int, x string"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()[0] == '{"id":1,"x":null}'
