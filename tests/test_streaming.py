"""Acceptance cases of the loader, of change capture and of windows, with files as the source and restarts from the checkpoint."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.streaming import cdc, kafka, loader, messages, upkeep, windows

GOOD = {"event_id": "e1", "event_time": "2026-10-06T12:23:49.370Z", "order_id": "O1", "customer_id": 7, "product": "pen", "quantity": 2, "unit_price": 1.5, "status": "NEW"}


@pytest.fixture
def land(spark, tmp_path):
    state = {"n": 0}

    def put(values):
        rows = []
        for v in values:
            body = v if isinstance(v, bytes | bytearray | type(None)) else json.dumps(v).encode()
            rows.append((b"k", body, "orders", state["n"] % 3, state["n"]))
            state["n"] += 1
        df = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long").withColumn("timestamp", F.lit("2026-10-06 12:00:00").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return put


def run(spark, tmp_path, **kw):
    job = loader.Loader(spark, str(tmp_path / "out"), **kw)
    job.run(spark.readStream.schema(messages.SOURCE_SCHEMA).parquet(str(tmp_path / "in"))).awaitTermination()
    return job


def test_loads_evolves_rejects_and_restarts(spark, land, tmp_path):
    land([GOOD, GOOD | {"event_id": "e2"}])
    job = run(spark, tmp_path)
    assert job.table().count() == 2 and job.dead_letters().count() == 0
    land([GOOD | {"event_id": "e3", "discount %": 5, "is_gift": True, "shipping_address": {"city": "Pune"}}, GOOD | {"event_id": "e4", "discount %": 7.5}])
    job = run(spark, tmp_path)
    t = job.table()
    assert {"DISCOUNT__", "IS_GIFT", "SHIPPING_ADDRESS"} <= set(t.columns)
    got = {r.EVENT_ID: r for r in t.collect()}
    assert got["e1"]["DISCOUNT__"] is None and got["e3"]["DISCOUNT__"] == 5.0 and got["e4"]["DISCOUNT__"] == 7.5 and got["e3"]["IS_GIFT"] is True
    assert json.loads(got["e3"]["SHIPPING_ADDRESS"]) == {"city": "Pune"} and got["e1"].QUANTITY == 2
    land([GOOD | {"event_id": "e5"}, GOOD | {"event_id": "e6", "quantity": "not-a-number"}, b"\xff\xfe", b"{oops", None, [1], GOOD | {"event_id": "e7"}])
    job = run(spark, tmp_path)
    assert {r.EVENT_ID for r in job.table().collect()} == {"e1", "e2", "e3", "e4", "e5", "e7"}
    assert job.dead_letters().count() == 5
    assert "value does not fit column QUANTITY" in {r.reject_reason for r in job.dead_letters().collect()}
    before = job.table().count()
    run(spark, tmp_path)
    assert job.table().count() == before  # nothing new, nothing twice
    job.load(spark.read.schema(messages.SOURCE_SCHEMA).parquet(str(tmp_path / "in")).filter("offset < 2"), 0)
    assert job.table().count() == before  # a batch that runs again replaces itself
    land([GOOD, GOOD])
    job = run(spark, tmp_path)
    assert job.unique_events().filter("EVENT_ID = 'e1'").count() == 1
    a = job.audit().agg(F.sum("received").alias("r"), F.sum("loaded").alias("l"), F.sum("rejected").alias("x")).first()
    assert a.r == a.l + a.x == 13


def test_too_wide_messages_are_dead_letters(spark, land, tmp_path):
    land([GOOD | {f"f{i}": i for i in range(6)}, GOOD | {"only": 1}])
    job = run(spark, tmp_path, most_new=5)
    assert job.table().count() == 1 and "ONLY" in job.table().columns


@pytest.mark.parametrize(
    ("value", "reason"),
    [
        (b'{"a": 1}', None), (b'{"a": NaN}', "message contains a number that JSON has not"), (b'{"a": "NaN, "}', None), (b"[1]", "message is not a JSON object"), (b'{"a b": 1, "a_b": 2}', "several fields map to one column"),
        (b'{"_kafka_topic": 1}', "field clashes with a metadata column"), (b'{"": 1}', "field name is empty"), (b'{"' + b"x" * 300 + b'": 1}', "field name is too long"), (b"5", "message is not a JSON object"), (b"", "message is not valid JSON"),
    ],
)
def test_message_rules(spark, value, reason):
    df = spark.createDataFrame([(None, bytearray(value), "t", 0, 0, None)], messages.SOURCE_SCHEMA)
    assert messages.parsed(df).first().reject_reason == reason


@pytest.mark.parametrize(("name", "want"), [("discount %", "DISCOUNT__"), ("2nd_item", "_2ND_ITEM"), ("order_id", "ORDER_ID")])
def test_column_names(spark, name, want):
    assert spark.range(1).select(messages.column_name(F.lit(name))).first()[0] == want


def test_a_batch_is_loaded_in_parts_of_few_new_columns(spark, land, tmp_path):
    land([GOOD | {"event_id": f"p{i}", f"c{2 * i}": 1, f"c{2 * i + 1}": "x"} for i in range(4)] + [GOOD | {"event_id": "p4", "c0": 2, "c7": "y"}, GOOD | {"event_id": "p5"}])
    job = run(spark, tmp_path, most_new=3)
    t = job.table()
    assert t.count() == 6 and {f"C{i}" for i in range(8)} <= set(t.columns)
    a = job.audit().first()
    assert (a.parts, a.status, a.loaded, a.rejected) == (3, "LOADED", 6, 0) and len(a.new_columns.split(",")) == 8
    known = set(loader.KNOWN) | set(messages.METADATA)
    for part in range(3):
        new = set(spark.read.parquet(str(tmp_path / f"out/data/batch_id=0/load_part={part}")).columns) - known
        assert len(new) <= 3 * (part + 1)
    got = {r.EVENT_ID: r for r in t.collect()}
    assert got["p4"].C0 == 2.0 and got["p4"].C7 == "y" and got["p5"].C0 is None


def test_results_of_parts_add_up():
    r = loader.combined([loader.Result(3, 0, ("A",)), loader.Result(2, 1, ("B", "C"))])
    assert (r.loaded, r.rejected, r.new_columns, r.parts, r.status) == (5, 1, ("A", "B", "C"), 2, "PARTIALLY_LOADED")
    assert loader.Result(0, 2, ()).status == "LOAD_FAILED" and loader.Result(0, 0, ()).status == "LOADED"
    assert loader.parts_of(["a", "b", "c"], 2) == {"a": 0, "b": 0, "c": 1}


def test_a_load_without_its_rows_is_a_failure(spark, land, tmp_path, monkeypatch):
    land([GOOD])
    job = loader.Loader(spark, str(tmp_path / "out"))
    batch = spark.read.schema(messages.SOURCE_SCHEMA).parquet(str(tmp_path / "in"))
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, path, *a, f=type(spark.read).parquet: f(self, path, *a).limit(0) if "load_part" in str(path) else f(self, path, *a))
    with pytest.raises(RuntimeError, match="holds 0 rows of 1"):
        job.load(batch, 0)


def test_retries_wait_longer_each_time():
    waits, left = [], [3]

    def action():
        left[0] -= 1
        if left[0] >= 0:
            raise ValueError

    assert upkeep.with_retries(action, first=1, most=3, sleep=waits.append) and waits == [1, 2, 3]
    left[0] = 9
    assert not upkeep.with_retries(action, stop=lambda: True, sleep=waits.append)


def test_broker_options(spark):
    o = kafka.source_options("host:9092", "orders", "g")
    assert o["startingOffsets"] == "earliest" and o["maxOffsetsPerTrigger"] == "500" and o["kafka.enable.auto.commit"] == "false" and o["subscribe"] == "orders"
    o = kafka.sink_options("host:9092", "orders")
    assert o["kafka.enable.idempotence"] == "true" and o["kafka.acks"] == "all" and o["topic"] == "orders"
    r = kafka.keyed(spark.createDataFrame([("O1", 5, None)], "order_id string, n int, x string"), "order_id").first()
    assert bytes(r.key) == b"O1" and json.loads(bytes(r.value)) == {"order_id": "O1", "n": 5}


def test_a_drained_query_has_loaded_everything(spark, land, tmp_path):
    land([GOOD, GOOD | {"event_id": "e2"}])
    job = loader.Loader(spark, str(tmp_path / "out"))
    q = job.run(spark.readStream.schema(messages.SOURCE_SCHEMA).parquet(str(tmp_path / "in")), once=False)
    upkeep.drain(q)
    assert not q.isActive and job.table().count() == 2


def test_refreshes_touch_only_what_has_changed(spark, tmp_path):
    from tessera.operators import order_quality as oq
    from tessera.sources import generators

    rows = generators.orders(spark, 24).withColumn("loaded_at", F.col("loaded_at").cast("timestamp_ntz")).cache()
    cut = rows.agg(F.max("loaded_at")).first()[0]
    path = str(tmp_path / "curated")
    assert upkeep.refresh(rows, path) > 1 and upkeep.is_fresh(rows, path)
    late = rows.filter("order_id IS NOT NULL").limit(2).withColumn("loaded_at", F.lit(cut) + F.expr("INTERVAL 1 HOUR")).cache()
    more = rows.unionByName(late)
    assert not upkeep.is_fresh(more, path)
    assert 1 <= upkeep.refresh(more, path) <= 2 and upkeep.is_fresh(more, path)
    assert upkeep.refresh(more, path) == 0
    want, got = oq.evaluate(more).select("source_file", "source_row", "loaded_at", "quality_reason"), spark.read.parquet(path).select("source_file", "source_row", "loaded_at", "quality_reason")
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0


def test_backfill_wants_its_columns(spark):
    with pytest.raises(ValueError, match="missing"):
        upkeep.backfill(spark.createDataFrame([(1,)], "a int"), ["a", "b"])


ROW = {"id": 1, "event_id": "6F9619FF-8B86-D011-B42D-00CF4FC964FF", "event_time": "2026-10-06T17:53:49.370999+05:30", "order_id": "O1", "customer_id": 7, "quantity": 2, "unit_price": "1.50", "is_gift": False, "discount_pct": None, "loyalty_tier": "0", "shipping_address": '{"city": "Pune"}', "record_source": "app"}


def change(**kw):
    return {"op": "c", "source": {"table": "order_events"}, "after": ROW} | kw


@pytest.mark.parametrize(
    ("message", "action", "reason"),
    [
        (change(), "forward", None), (change(op="u"), "skip", "update"), (change(op="d"), "skip", "delete"), (change(op="r"), "skip", "snapshot row"), (None, "skip", "tombstone"),
        (change(after=ROW | {"record_source": "backfill"}), "skip", "backfill row"), (change(source={"table": "other"}), "skip", "another table"), (change(op="z"), "reject", "unknown operation"), ({"a": 1}, "reject", "no op field"), ([1], "reject", "not a JSON object"),
        (change(after=None), "reject", "insert without a row"), (change(after=ROW | {"event_id": "x"}), "reject", "event_id is not a UUID"), (change(after=ROW | {"event_time": "2026-13-06T12:00:00Z"}), "reject", "event_time is not a time with a zone"),
        (change(after=ROW | {"quantity": 2.5}), "reject", "quantity is not a whole number"), (change(after=ROW | {"unit_price": True}), "reject", "unit_price is not a number"), (change(after=ROW | {"unit_price": "AfQ="}), "reject", "unit_price is not a number"),
        (change(after=ROW | {"shipping_address": "{"}), "reject", "shipping_address is not JSON"), (change(after=ROW | {"order_id": None}), "reject", "row has no order_id"), (change(after=ROW | {"order_id": 5}), "reject", "order_id is not text"),
        ({"schema": {"a": 1}, "payload": change()}, "forward", None),
    ],
)
def test_change_events(spark, message, action, reason):
    value = None if message is None else bytearray(json.dumps(message).encode())
    r = cdc.classified(spark.createDataFrame([(value,)], "value binary")).first()
    assert (r.action, r.reason) == (action, reason)
    if action == "forward":
        assert r.event_key == "O1"
        assert json.loads(r.event) == {"event_id": ROW["event_id"].lower(), "event_time": "2026-10-06T12:23:49.370Z", "order_id": "O1", "customer_id": 7, "quantity": 2, "unit_price": 1.5, "is_gift": False, "loyalty_tier": "0", "shipping_address": {"city": "Pune"}}


def test_streaming_windows_equal_the_batch(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    windows.collected(windows.tumbling(stream, "ts", "6 hours", "60 days", ["event_type"], "value"), str(tmp_path / "none"))
    q = windows.tumbling(stream, "ts", "6 hours", "60 days", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.table("tumbling").collect()}
    want = {(r.w.start, r.event_type): r.n for r in src.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want
    src.unionByName(src).write.parquet(str(tmp_path / "twice"))
    windows.collected(windows.once(spark.readStream.schema(src.schema).parquet(str(tmp_path / "twice")), "ts", "60 days", ["event_id"]), str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one/rows")).count() == src.count()
