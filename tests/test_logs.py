"""Grammars on lines with known answers: each value, its position, its validity."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators.logs import grammars, parser, publish, validators, vocabulary
from tessera.plans import registry
from tests.oracle import differences

LINES = [
    ("F4", '10.0.0.1 - - [23/Apr/2026:17:00:00 +0000] "GET /account HTTP/1.1" 200 5120 "-" "Mozilla/5.0 (X11; Linux x86_64; rv:125.0) Gecko/20100101 Firefox/125.0" xff="203.0.113.5, 10.0.0.1" user=<ethan.murphy@corp.example.com> type=User msg="Access granted"',
     {"entity_type": ("User", 223), "email_address": ("ethan.murphy@corp.example.com", 187), "resource_url": ("/account", 48), "event_timestamp": ("23/Apr/2026:17:00:00 +0000", 15), "tool": ("Mozilla/5.0 (X11; Linux x86_64; rv:125.0) Gecko/20100101 Firefox/125.0", 81), "ip_address": ("203.0.113.5", 158), "action_phrase": ("Access granted", 233), "status": ("200", 67)}, "VALID"),
    ("F4", '  [2001:db8::1]:443 - joe@x.org [01/Jan/2026:00:00:00 +0530] "-" - - "http://a.org/" "curl/8.5" type=Service Account loc=POINT(72.5 19.25)',
     {"ip_address": ("2001:db8::1", 4), "email_address": ("joe@x.org", 23), "tool": ("curl/8.5", None), "entity_type": ("Service Account", None), "latitude": ("19.25", None), "longitude": ("72.5", None), "resource_url": ("-", None), "status": ("-", None), "event_timestamp": ("01/Jan/2026:00:00:00 +0530", None)}, "VALID"),
    ("F4", '1.2.3.4 - - [01/Jan/2026:00:00:00 +0000] "GET /a HTTP/1.1" 404 1 "-" "curl/8', {"tool": ("curl/8", None), "status": ("404", None), "ip_address": ("1.2.3.4", 1), "resource_url": ("/a", None), "event_timestamp": ("01/Jan/2026:00:00:00 +0000", None), "email_address": ("-", None)}, "BROKEN"),
    ("F1", '2026-03-22 14:30:00 IST | entity=Admin | user=<mailto:a.b@c.org> | action="Access denied | escalated" | path=C:\\Share\\Budget 2026.xlsx | geo=18.5, 73.8 | ip=10.0.0.300 | status=DENIED (policy) | retry_action=login | tool=',
     {"event_timestamp": ("2026-03-22 14:30:00 IST", 1), "entity_type": ("Admin", 34), "email_address": ("a.b@c.org", 55), "action_phrase": ("Access denied | escalated", None), "resource_url": ("C:\\Share\\Budget 2026.xlsx", None), "latitude": ("18.5", None), "longitude": ("73.8", None), "ip_address": ("10.0.0.300", None), "status": ("DENIED", None)}, "INVALID"),
    ("F1", "entity=Bot\tstatus=ok\tlat=48° 51′ 30″ N", {"entity_type": ("Bot", 8), "status": ("ok", 19), "latitude": ("48° 51′ 30″ N", 26)}, "VALID"),
    ("F1", "2026-01-01T00:00:00Z | user=a@b.org | ip=1.2.3.4", {"event_timestamp": ("2026-01-01T00:00:00Z", 1), "email_address": ("a@b.org", 29), "ip_address": ("1.2.3.4", 42)}, "BROKEN"),
    ("F3", 'Jan  9 14:02:11 host app[1]: {"user": "a@b.org", "notify": "c@d.org", "geo": {"lat": -33.5, "lng": 151.0}, "status": 401, "result": "FAILED", "msg": "login \\"x\\" failed", "ip": null}',
     {"event_timestamp": ("Jan  9 14:02:11", 1), "email_address": ("a@b.org", 40), "latitude": ("-33.5", None), "longitude": ("151.0", None), "status": ("401", None), "action_phrase": ('login \\"x\\" failed', None), "ip_address": ("null", None)}, "VALID"),
    ("F3", '<34>1 2026-05-01T10:00:00.123Z host {"geometry":{"type":"Point","coordinates":[ 77.5 ,\n 12.9]},"entity":"USER","res":"/x/y', {"event_timestamp": ("2026-05-01T10:00:00.123Z", 7), "longitude": ("77.5", None), "latitude": ("12.9", None), "entity_type": ("USER", None), "resource_url": ("/x/y", None)}, "BROKEN"),
    ("F5", "14/Mar/2026:09:22:17 +0530;GUEST;x@y.org;curl/8;/a;12.5;unknown;::1;read;✓", {"event_timestamp": ("14/Mar/2026:09:22:17 +0530", 1), "entity_type": ("GUEST", 28), "email_address": ("x@y.org", 34), "tool": ("curl/8", None), "resource_url": ("/a", None), "latitude": ("12.5", None), "longitude": ("unknown", None), "ip_address": ("::1", None), "action_phrase": ("read", None), "status": ("✓", None)}, "VALID"),
    ("F2", "[14/Mar/2026:09:22:17 +0530] Service Account svc@corp.example.com was blocked from accessing https://a.example.org/x via curl/8.5 from 10.1.2.3:5501 (18.5, 73.8) - 403 Forbidden",
     {"event_timestamp": ("14/Mar/2026:09:22:17 +0530", 2), "entity_type": ("Service Account", 30), "email_address": ("svc@corp.example.com", 46), "action_phrase": ("was blocked from accessing", 67), "resource_url": ("https://a.example.org/x", 94), "tool": ("curl/8.5", None), "ip_address": ("10.1.2.3", None), "latitude": ("18.5", None), "longitude": ("73.8", None), "status": ("403 Forbidden", None)}, "VALID"),
    ("F2", "2026-01-02T03:04:05Z [SUCCESS] Admin <a@b.org> connecting from 10.0.0.9 with Ansible 2.16.4 located 1.5, 2.5 updated /etc/hosts.", {"event_timestamp": ("2026-01-02T03:04:05Z", 1), "status": ("SUCCESS", None), "entity_type": ("Admin", None), "email_address": ("a@b.org", None), "ip_address": ("10.0.0.9", None), "tool": ("Ansible 2.16.4", None), "latitude": ("1.5", None), "longitude": ("2.5", None), "action_phrase": ("updated", None), "resource_url": ("/etc/hosts", None)}, "VALID"),
    ("F2", "1773480137 WARN Guest anonymous viewed an unspecified resource using Chrome/120 from 10.0.0.1, result OK", {"event_timestamp": ("1773480137", 1), "entity_type": ("Guest", None), "action_phrase": ("viewed", None), "tool": ("Chrome/120", None), "ip_address": ("10.0.0.1", None), "status": ("OK", None)}, "VALID"),
    ("NONE", "#####", {}, "BROKEN"), ("NONE", None, {}, "BROKEN"), ("NONE", " \n", {}, "BROKEN"), ("NONE", "a;b;c;d;e;f;g;h;i;j", {}, "BROKEN"),
]


@pytest.mark.parametrize(("family", "line", "want", "validity"), LINES)
def test_lines(family, line, want, validity):
    p = parser.parse(line)
    got = {f["field"]: f for f in p["fields"] if f["value"] is not None}
    assert p["family"] == family and {k: f["value"] for k, f in got.items()} == {k: x for k, (x, _) in want.items()}
    for k, (_, at) in want.items():
        assert at is None or got[k]["start_pos"] == at
    for f in [*got.values(), *p["secondary"]]:
        assert line[f["start_pos"] - 1 :].startswith(f["value"])
    assert p["record_validity"] == validity


def test_secondary_and_reasons():
    kinds = {(s["kind"], s["value"]) for s in parser.parse(LINES[0][1])["secondary"]}
    assert ("proxy_ip", "10.0.0.1") in kinds
    p = parser.parse(LINES[3][1])
    assert {("status_reason", "policy"), ("retry_action", "login")} <= {(s["kind"], s["value"]) for s in p["secondary"]}
    assert next(f for f in p["fields"] if f["field"] == "tool")["missing_reason"] == "empty"
    assert {"result", "notify_email"} <= {s["kind"] for s in parser.parse(LINES[6][1])["secondary"]}
    assert next(f for f in parser.parse(LINES[11][1])["fields"] if f["field"] == "resource_url")["missing_reason"] == "sentinel"


@pytest.mark.parametrize(
    ("field", "text", "ok"),
    [
        ("ip_address", "010.0.0.1", False), ("ip_address", "1.2.3.4.5", False), ("ip_address", "fe80::1%eth0", True), ("ip_address", "::ffff:1.2.3.4", True), ("ip_address", "1::2::3", False), ("email_address", "a..b@c.org", False), ("email_address", "a@b", False),
        ("event_timestamp", "2026-02-29T00:00:00Z", False), ("event_timestamp", "Feb 28 23:59:59", True), ("event_timestamp", "13/01/2026 01:00 PM", False), ("event_timestamp", "12/31/2026 12:00 AM", True), ("status", "404 Not Found", True), ("status", "404 OK", False), ("status", "600", False), ("status", "rate_limited", True),
        ("latitude", "90.0000001", False), ("latitude", "45 N", True), ("latitude", "45 E", False), ("longitude", "W179.5", True), ("longitude", "12°30'60\"E", False), ("resource_url", "\\\\srv\\x", True), ("resource_url", "gopher://x", False), ("resource_url", "s3://b/k", True), ("entity_type", "api client", True), ("entity_type", "Robot", False),
    ],
)
def test_validators(field, text, ok):
    assert validators.is_valid(field, text, 2026) is ok


def test_positions_survive_a_run_on_spark(spark):
    logs = spark.createDataFrame([(i, line) for i, (_, line, *_) in enumerate(LINES)], "log_id long, raw_log string").repartition(3)
    parsed = parser.parse_logs(logs).cache()
    assert parsed.count() == len(LINES) and parser.inexact(logs, parsed).count() == 0
    key = spark.createDataFrame([(i, k, x) for i, (_, _, want, _) in enumerate(LINES) for k, (x, _) in want.items()], "log_id long, field string, value string")
    got = parser.field_rows(parsed).select("log_id", "field", "value").filter("value IS NOT NULL")
    assert got.exceptAll(key).count() == 0 and key.exceptAll(got).count() == 0


def test_flat_form_and_documents(spark):
    logs = spark.createDataFrame([(i, line) for i, (_, line, *_) in enumerate(LINES)], "log_id long, raw_log string").repartition(3)
    flat = publish.published(logs, run_id=7).cache()
    assert len(flat.columns) == 71 and flat.count() == len(LINES)
    t = {r.log_id: r for r in flat.collect()}
    assert str(t[0].event_timestamp_utc) == "2026-04-23 17:00:00" and t[8].event_timestamp_utc_offset_minutes == 330 and t[4].entity_type_code == "BOT" and float(t[4].latitude_degrees) == 48.8583333
    assert t[3].event_timestamp_shape == "iso8601" and t[3].event_timestamp_local is not None and t[3].event_timestamp_utc is None  # a zone given by its name
    assert t[3].tool_missing_reason == "empty" and t[11].email_address_missing_reason == "sentinel" and t[3].ip_address_address is None
    assert (t[9].status_code, t[9].status_word, t[10].status_word) == (403, None, "SUCCESS") and t[2].is_truncated and t[2].diagnostics == ["truncated"]
    assert t[13].record_validity == "BROKEN" and t[13].event_timestamp_shape is None and t[13].run_id == 7
    want = flat.drop("loaded_at")
    docs = publish.documents(flat)
    for back in (publish.leaves(docs), publish.variant_leaves(docs)):
        assert back.schema.simpleString() == want.schema.simpleString() and back.columns == want.columns
        assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    wide = publish.pivoted(parser.field_rows(parser.parse_logs(logs)))
    assert len(wide.columns) == 51 and wide.exceptAll(flat.select(wide.columns)).count() == 0 and wide.count() == len(LINES)


def test_flat_form_of_zones_and_shapes(spark):
    lines = [(1, "::1;USER"), (2, "fe80::1%eth0"), (3, "2026-02-30T00:00:00Z")]
    rows = [(i, f"2026-01-01T00:00:00Z;USER;a@b.org;t;/a;1.5;2.5;{x};read;OK" if i == 2 else f"{x if i == 3 else '2026-01-01T00:00:00Z'};USER;a@b.org;t;/a;1.5;2.5;::1;read;OK") for i, x in lines]
    t = {r.log_id: r for r in publish.published(spark.createDataFrame(rows, "log_id long, raw_log string")).collect()}
    assert (t[2].ip_address_address, t[2].ip_address_zone_id) == ("fe80::1", "eth0") and (t[1].ip_address_address, t[1].ip_address_zone_id) == ("::1", None)
    assert t[3].event_timestamp_validity == "INVALID" and t[3].event_timestamp_shape == "iso8601" and t[3].event_timestamp_local is None


def test_imprecise_coordinates(spark):
    values = ["1.1234567", "1.12345678", "W1.12345678", "12°30'15.123\"N", "12°30'15.1234\"N", "x.123456789"]
    flat = spark.createDataFrame([(i, x, "INVALID" if x[0] == "x" else "VALID", None, "MISSING") for i, x in enumerate(values)], "log_id long, latitude string, latitude_validity string, longitude string, longitude_validity string")
    assert sorted(r.log_id for r in publish.imprecise(flat).collect()) == [1, 2, 4]


def test_events_end_before_the_line_feed():
    assert grammars.event_end("abc\r\nx") == 3 and grammars.event_end("abc") == 3 and grammars.event_end("\nabc") == 0


def test_accuracy_counts_what_the_key_has(spark):
    lines = [(i, line) for i, (_, line, *_) in enumerate(LINES)]
    known = [{f["field"]: (f["value"], f["validity"]) for f in parser.parse(line)["fields"]} for _, line in lines]
    known[0]["status"], known[1]["tool"], known[2]["tool"], known[14]["tool"] = ("201", "VALID"), (None, "VALID"), ("curl/8", "PLACEHOLDER"), ("", "MISSING")
    want = {f: (len(lines), len(lines) - {"status": 1, "tool": 3}.get(f, 0)) for f in vocabulary.FIELDS}
    key = spark.createDataFrame([(i, f, *x) for i, k in enumerate(known) for f, x in k.items()], "log_id long, field string, value string, validity string")
    apart = parser.accuracy(parser.parse_logs(spark.createDataFrame(lines, "log_id long, raw_log string")), key)
    rows = spark.createDataFrame([(i, line, [(f, *k[f]) for f in vocabulary.FIELDS]) for (i, line), k in zip(lines, known, strict=True)], "log_id long, raw_log string, key array<struct<field:string,value:string,validity:string>>")
    beside = parser.accuracy_beside(parser.parse_logs(rows, keep=("key",)), F.col("key"))
    for got in (apart, beside):
        assert {r.field: (r.n_rows, r.right) for r in got.collect()} == want
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    turned = parser.accuracy_beside(parser.parse_logs(rows, keep=("key",)), F.reverse("key"))
    assert {(r.n_rows, r.right) for r in turned.collect()} == {(len(lines), 0)}


def test_accuracy_of_repeated_orders_without_a_broadcast(spark, sf, tmp_path):
    for f in os.listdir(sf):
        os.symlink(f"{sf}/{f}", tmp_path / f)
    (tmp_path / "orders.parquet").unlink()
    orders = pq.read_table(f"{sf}/orders.parquet")
    pq.write_table(pa.concat_tables([orders, orders.take([1, 1, 2])]), tmp_path / "orders.parquet")
    got = registry.queries()["logs_accuracy"](spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert differences(got, str(tmp_path), registry.oracle_sql()["logs_accuracy"]) == ""


def test_inexact_values_without_a_broadcast(spark, sf):
    logs = spark.createDataFrame([(i, line) for i, (_, line, *_) in enumerate(LINES)], "log_id long, raw_log string")
    moved = logs.withColumn("raw_log", F.when(F.col("log_id") == 8, F.concat(F.lit("x"), "raw_log")).otherwise(F.col("raw_log")))
    wrong = sorted((8, f["value"], f["start_pos"]) for f in [*parser.parse(LINES[8][1])["fields"], *parser.parse(LINES[8][1])["secondary"]] if f["value"] is not None)
    apart = parser.inexact(moved, parser.parse_logs(logs))
    beside = parser.inexact_beside(parser.parse_logs(logs.join(moved.withColumnRenamed("raw_log", "moved"), "log_id"), keep=("moved",)), "moved")
    for got in (apart, beside):
        assert sorted((r.log_id, r.value, r.start_pos) for r in got.collect()) == wrong
    query = registry.queries()["logs_inexact_values"](spark, sf)
    for got, word in ((apart, "Broadcast"), (query, "Join")):
        assert word not in got._jdf.queryExecution().executedPlan().toString()
