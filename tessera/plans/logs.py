"""Log lines of five grammars written from `orders`, read back by the parser; the SQL twin knows what was written."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.logs import parser, publish
from tessera.sources.tables import spread, table

#: The same text for both engines. Each line has its parts as columns, so that the answer is known without reading the line.
_PARTS = """SELECT o_orderkey AS log_id, o_orderkey % 6 AS shape,
  CASE WHEN o_orderkey % 6 = 3 THEN '01/Mar/2026:00:00:00 +0000' ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T08:01:02Z') END AS ts, CASE o_orderkey % 4 WHEN 0 THEN 'User' WHEN 1 THEN 'Service Account' WHEN 2 THEN 'bot' ELSE 'Robot' END AS entity,
  CASE WHEN o_custkey % 17 = 0 THEN concat('u', o_custkey, '..x@corp.example.org') ELSE concat('u', o_custkey, '@corp.example.org') END AS email,
  concat('/files/', o_custkey, '/report.pdf') AS resource, concat('curl/8.', o_custkey % 10) AS tool, CAST(CAST(o_custkey % 181 - 90 AS DECIMAL(9,4)) AS STRING) AS lat, CAST(CAST(o_orderkey % 361 - 180 AS DECIMAL(9,4)) AS STRING) AS lon,
  CASE WHEN o_custkey % 13 = 0 THEN '10.0.0.300' ELSE concat('10.', o_orderkey % 200, '.', o_custkey % 250, '.7') END AS ip, 'opened the file' AS action, CASE o_orderkey % 5 WHEN 0 THEN '200' WHEN 1 THEN 'DENIED' WHEN 2 THEN '404' WHEN 3 THEN 'nope' ELSE '-' END AS status FROM orders"""
#: Each shape of a line: its family, what it is written from, and where its parts say they come from.
_LAYOUTS = (
    ("F1", '{ts} | entity={entity} | user=<{email}> | action="{action}" | path={resource} | client={tool} | geo={lat}, {lon} | ip={ip} | status={status}', "ts segment[1], entity entity, email user, action action, resource path, tool client, lat geo, lon geo, ip ip, status status"),
    ("F5", "{ts};{entity};{email};{tool};{resource};{lat};{lon};{ip};{action};{status}", "ts column[1], entity column[2], email column[3], tool column[4], resource column[5], lat column[6], lon column[7], ip column[8], action column[9], status column[10]"),
    ("F3", '<34>1 {ts} host app {{"entity": "{entity}", "user": "{email}", "res": "{resource}", "tool": "{tool}", "geo": {{"lat": {lat}, "lng": {lon}}}, "ip": "{ip}", "msg": "{action}", "status": "{status}"}}', "ts header, entity entity, email user, resource res, tool tool, lat geo.lat, lon geo.lng, ip ip, action msg, status status"),
    ("F4", '{ip} - {email} [{ts}] "GET {resource} HTTP/1.1" {status} 12 "-" "{tool}" type={entity} loc=POINT({lon} {lat}) msg="{action}"', "ip ip, email remote_user, ts timestamp, resource request.target, status status, tool user_agent, entity extras.type, lon extras.loc, lat extras.loc, action extras.msg"),
    ("F2", "{ts} {entity} {email} {action} {resource} via {tool} from {ip}:443 ({lat}, {lon})", "ts prefix, entity entity, email actor, action action, resource resource, tool tool, ip ip, lat coordinates, lon coordinates"),
)


def _written(layout: str) -> str:
    return "concat(" + ", ".join(x for text, part, *_ in string.Formatter().parse(layout) for x in ([f"'{text}'"] if text else []) + ([part] if part else [])) + ")"


_LINE = f"SELECT *, CASE shape {' '.join(f'WHEN {n} THEN {_written(layout)}' for n, (_, layout, _) in enumerate(_LAYOUTS))} ELSE '##### nothing here' END AS raw_log FROM parts"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(table(spark, sf_dir, "orders")).createOrReplaceTempView("orders")
    spark.sql(_PARTS).createOrReplaceTempView("parts")
    return spark.sql(_LINE)


def parsed(spark, sf_dir):
    """The ten values of each line, with the verdict on each and on the line."""
    return parser.wide(parser.parse_logs(lines(spark, sf_dir).select("log_id", "raw_log"))).drop("sub_format")


def _published(spark, sf_dir):
    return publish.published(lines(spark, sf_dir).select("log_id", "raw_log")).drop("loaded_at")


def _plain(flat):
    """Times and lists as text."""
    times = {f"event_timestamp_{c}": F.date_format(f"event_timestamp_{c}", "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("local", "utc")}
    return flat.withColumns(times | {"diagnostics": F.array_join("diagnostics", ",")})


def flat(spark, sf_dir):
    """All columns of the flat form but the time of loading."""
    return _plain(_published(spark, sf_dir))


def leaves(spark, sf_dir):
    """The same 70 values, read back from documents."""
    return _plain(publish.leaves(publish.documents(_published(spark, sf_dir))))


def variant_leaves(spark, sf_dir):
    return _plain(publish.variant_leaves(publish.documents(_published(spark, sf_dir))))


def pivoted(spark, sf_dir):
    return publish.pivoted(parser.field_rows(parser.parse_logs(lines(spark, sf_dir).select("log_id", "raw_log"))))


def imprecise(spark, sf_dir):
    return publish.imprecise(_published(spark, sf_dir)).agg(F.count("*").alias("n"))


def field_states(spark, sf_dir):
    return parser.field_rows(parser.parse_logs(lines(spark, sf_dir).select("log_id", "raw_log"))).groupBy("field", "validity", "missing_reason").agg(F.count("*").alias("n"))


def line_profile(spark, sf_dir):
    return parser.profile(parser.parse_logs(lines(spark, sf_dir).select("log_id", "raw_log")))


def accuracy(spark, sf_dir):
    """By field, lines and those whose value and validity are as the answer key has them. The key comes from the parts, not from the line;
    they go through the parser beside it."""
    known = F.col("shape") < 5
    value = {
        "entity_type": F.col("entity"), "email_address": F.col("email"), "resource_url": F.col("resource"), "event_timestamp": F.col("ts"),
        "tool": F.col("tool"), "latitude": F.col("lat"), "longitude": F.col("lon"), "ip_address": F.col("ip"), "action_phrase": F.col("action"), "status": F.when(F.col("shape") != 4, F.col("status")),
    }
    wrong = {"entity_type": F.col("entity") == "Robot", "email_address": F.col("email").contains(".."), "ip_address": F.col("ip") == "10.0.0.300", "status": F.col("status") == "nope"}
    key = F.array(*[F.struct(F.lit(f).alias("field"), F.when(known, v).alias("value"), F.when(~known | v.isNull(), "MISSING").when((F.lit(f) == "status") & (v == "-"), "PLACEHOLDER").when(wrong.get(f, F.lit(False)), "INVALID").otherwise("VALID").alias("validity")) for f, v in value.items()])
    return parser.accuracy_beside(parser.parse_logs(lines(spark, sf_dir), keep=("shape", *_NAMES)), key)


def inexact_values(spark, sf_dir):
    return parser.inexact_beside(parser.parse_logs(lines(spark, sf_dir), keep=("raw_log",))).agg(F.count("*").alias("n"))


def ports(spark, sf_dir):
    s = parser.secondary_rows(parser.parse_logs(lines(spark, sf_dir).select("log_id", "raw_log")))
    return s.filter("kind = 'client_port'").groupBy("value").agg(F.count("*").alias("n"))


def input_fingerprint(spark, sf_dir):
    return parser.fingerprint(lines(spark, sf_dir).select("log_id", "raw_log")).drop("digest")


_OK = {
    "entity": "entity <> 'Robot'", "email": "NOT contains(email, '..')", "lat": "TRUE", "lon": "TRUE", "ip": "ip <> '10.0.0.300'", "status": "status IN ('200', 'DENIED', '404')",
}
_V = lambda c: f"CASE WHEN {_OK[c]} THEN 'VALID' ELSE 'INVALID' END"
_SQL = f"""parts AS ({_PARTS}), raw AS ({_LINE}), w AS (SELECT log_id, shape, raw_log, CASE shape {' '.join(f"WHEN {n} THEN '{family}'" for n, (family, *_) in enumerate(_LAYOUTS))} ELSE 'NONE' END AS family,
  ts, entity, email, resource, tool, lat, lon, ip, action, CASE shape WHEN 4 THEN NULL ELSE status END AS status,
  {_V("entity")} AS ev, {_V("email")} AS mv, {_V("ip")} AS iv, CASE WHEN shape = 4 THEN 'MISSING' WHEN status = '-' THEN 'PLACEHOLDER' ELSE {_V("status")} END AS sv FROM raw),
p AS (SELECT log_id, family, CASE WHEN shape = 5 THEN 'BROKEN' WHEN 'INVALID' IN (ev, mv, iv, sv) THEN 'INVALID' ELSE 'VALID' END AS record_validity,
  {", ".join(f"CASE WHEN shape <> 5 THEN {c} END AS {n}" for c, n in (("entity", "entity_type"), ("email", "email_address"), ("resource", "resource_url"), ("ts", "event_timestamp"), ("tool", "tool"), ("lat", "latitude"), ("lon", "longitude"), ("ip", "ip_address"), ("action", "action_phrase"), ("status", "status")))},
  {", ".join(f"CASE WHEN shape = 5 THEN 'MISSING' ELSE {c} END AS {n}_validity" for c, n in (("ev", "entity_type"), ("mv", "email_address"), ("'VALID'", "resource_url"), ("'VALID'", "event_timestamp"), ("'VALID'", "tool"), ("'VALID'", "latitude"), ("'VALID'", "longitude"), ("iv", "ip_address"), ("'VALID'", "action_phrase"), ("sv", "status")))} FROM w)"""
_FIELDS = "entity_type email_address resource_url event_timestamp tool latitude longitude ip_address action_phrase status".split()
_NAMES = dict(zip("entity email resource ts tool lat lon ip action status".split(), _FIELDS, strict=True))


def _starts(layout: str) -> dict[str, str]:
    """Where each part of a line begins, counted from 1."""
    at, found = "1", {}
    for text, part, *_ in string.Formatter().parse(layout):
        at += f" + {len(text)}"
        if part:
            found[part] = at
            at += f" + length(w.{part})"
    return found


def _by_shape(value) -> str:
    """A CASE over the shapes; value gives SQL for a shape's (family, starts, sources), or None."""
    cases = [(n, value(family, _starts(layout), dict(x.split(" ") for x in sources.split(", ")))) for n, (family, layout, sources) in enumerate(_LAYOUTS)]
    return f"CASE w.shape {' '.join(f'WHEN {n} THEN {sql}' for n, sql in cases if sql is not None)} END"


def _common_sql(part: str, f: str) -> str:
    start, source = _by_shape(lambda _, starts, __: starts.get(part)), _by_shape(lambda family, _, sources: f"'{family}.{sources[part]}'" if part in sources else None)
    return f"p.{f}, p.{f}_validity, {start} AS {f}_start_pos, {source} AS {f}_source, CASE WHEN p.{f} IS NULL THEN 'absent' END AS {f}_missing_reason"


_MOMENT = "CASE family WHEN 'NONE' THEN NULL WHEN 'F4' THEN '2026-03-01 00:00:00.000000' ELSE replace(replace(event_timestamp, 'T', ' '), 'Z', '.000000') END"
_FLAT_SQL = f"""common AS (SELECT log_id, CAST(1 AS BIGINT) AS run_id, p.family, p.family AS format_family, 'DET-' || p.family AS detection_rule,
  CASE p.family WHEN 'F1' THEN 'pipe-delimited' WHEN 'F2' THEN 'template-A' WHEN 'F3' THEN 'rfc5424' WHEN 'F4' THEN 'ipv4' WHEN 'F5' THEN 'iso8601' END AS sub_format, p.record_validity, FALSE AS is_truncated,
  CASE WHEN p.family <> 'NONE' THEN length(raw_log) END AS event_end_pos, CASE WHEN p.family = 'NONE' THEN 'no_format_detected' ELSE '' END AS diagnostics, {", ".join(_common_sql(part, f) for part, f in _NAMES.items())}
  FROM w JOIN p USING (log_id)),
flat AS (SELECT * EXCLUDE (family), CASE WHEN entity_type_validity = 'VALID' THEN upper(replace(entity_type, ' ', '_')) END AS entity_type_code,
  CASE family WHEN 'NONE' THEN NULL WHEN 'F4' THEN 'apache_clf' ELSE 'iso8601' END AS event_timestamp_shape, {_MOMENT} AS event_timestamp_local, CASE WHEN family <> 'NONE' THEN 0 END AS event_timestamp_utc_offset_minutes, {_MOMENT} AS event_timestamp_utc,
  CAST(latitude AS DECIMAL(10,7)) AS latitude_degrees, CAST(longitude AS DECIMAL(10,7)) AS longitude_degrees, CASE WHEN ip_address_validity = 'VALID' THEN ip_address END AS ip_address_address, CAST(NULL AS VARCHAR) AS ip_address_zone_id,
  CASE WHEN status IN ('200', '404') THEN CAST(status AS INT) END AS status_code, CASE WHEN status = 'DENIED' THEN 'DENIED' END AS status_word FROM common)"""
QUERIES = {f"logs_{f.__name__}": f for f in (parsed, flat, leaves, variant_leaves, pivoted, imprecise, field_states, line_profile, accuracy, inexact_values, ports, input_fingerprint)}
ORACLE = {
    "logs_parsed": f"WITH {_SQL} SELECT * FROM p",
    "logs_flat": f"WITH {_SQL}, {_FLAT_SQL} SELECT * FROM flat",
    "logs_leaves": f"WITH {_SQL}, {_FLAT_SQL} SELECT * FROM flat",
    "logs_variant_leaves": f"WITH {_SQL}, {_FLAT_SQL} SELECT * FROM flat",
    "logs_pivoted": f"WITH {_SQL}, {_FLAT_SQL} SELECT log_id, {', '.join(publish.column(f, leaf) for f in _FIELDS for leaf, _ in publish.COMMON)} FROM flat",
    "logs_imprecise": "SELECT CAST(0 AS BIGINT) AS n",
    "logs_field_states": f"WITH {_SQL} SELECT field, validity, missing_reason, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT '{f}' AS field, {f}_validity AS validity, CASE WHEN {f} IS NULL THEN 'absent' END AS missing_reason FROM p" for f in _FIELDS)}) GROUP BY ALL",
    "logs_line_profile": f"WITH {_SQL} SELECT family, CASE family WHEN 'F1' THEN 'pipe-delimited' WHEN 'F2' THEN 'template-A' WHEN 'F3' THEN 'rfc5424' WHEN 'F4' THEN 'ipv4' WHEN 'F5' THEN 'iso8601' END AS sub_format, record_validity, count(*) AS n, CAST(0 AS BIGINT) AS truncated FROM p GROUP BY ALL",
    "logs_accuracy": f"SELECT f AS field, count(*) AS n_rows, count(*) AS \"right\" FROM orders CROSS JOIN (SELECT unnest({_FIELDS}) AS f) GROUP BY f",
    "logs_inexact_values": "SELECT CAST(0 AS BIGINT) AS n",
    "logs_ports": "SELECT '443' AS value, count(*) AS n FROM orders WHERE o_orderkey % 6 = 4 HAVING count(*) > 0",
    "logs_input_fingerprint": f"WITH {_SQL} SELECT count(*) AS n_rows, count(raw_log) AS with_text, count(*) FILTER (WHERE raw_log = '') AS empty, CAST(sum(length(raw_log)) AS BIGINT) AS n_chars, CAST(sum(strlen(raw_log)) AS BIGINT) AS n_octets FROM raw",
}
