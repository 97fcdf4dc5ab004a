"""Fixed values of the log grammars: fields, key names, words, shapes."""

FIELDS = ("entity_type", "email_address", "resource_url", "event_timestamp", "tool", "latitude", "longitude", "ip_address", "action_phrase", "status")
PLACEHOLDERS = frozenset(("-", "N/A", "NULL", "null", "unknown"))
ENTITY_TYPES = frozenset(("USER", "CUSTOMER", "ADMIN", "SERVICE_ACCOUNT", "API_CLIENT", "GUEST", "BOT"))
STATUS_WORDS = frozenset((
    "SUCCESS", "OK", "ALLOWED", "DENIED", "FAILED", "FAIL", "BLOCKED", "PASS", "REJECTED", "PENDING", "NOT_FOUND", "ERROR", "RATE_LIMITED", "THROTTLED",
    "EXPIRED", "TIMEOUT", "CHALLENGE", "DECLINED",
))
CHECK_MARK = "✓"
REASONS = {
    200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 302: "Found", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 429: "Too Many Requests",
    500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable",
}
SCHEMES = frozenset(("http", "https", "ftp", "s3", "db", "postgres", "vpn"))
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
#: Key names of key=value lines.
KEYS_F1 = {
    "entity": "entity_type", "entity_type": "entity_type", "type": "entity_type", "email": "email_address", "user": "email_address", "principal": "email_address",
    "action": "action_phrase", "event": "action_phrase", "resource": "resource_url", "url": "resource_url", "path": "resource_url", "tool": "tool", "client": "tool", "agent": "tool",
    "ip": "ip_address", "src_ip": "ip_address", "client_ip": "ip_address", "lat": "latitude", "latitude": "latitude", "lon": "longitude", "lng": "longitude", "longitude": "longitude",
    "status": "status", "result": "status", "outcome": "status",
}
SIDE_KEYS_F1 = {"ingested_at": "event_timestamp", "retry_action": "action_phrase"}
#: Key names of JSON bodies, nested ones with their path.
KEYS_F3 = {
    "entity_type": "entity_type", "entity": "entity_type", "principal_type": "entity_type", "user": "email_address", "principal": "email_address", "email": "email_address",
    "resource": "resource_url", "target": "resource_url", "res": "resource_url", "tool": "tool", "user_agent": "tool", "client": "tool", "src_ip": "ip_address", "ip": "ip_address", "remote_addr": "ip_address",
    "msg": "action_phrase", "event": "action_phrase", "action": "action_phrase", "status": "status", "result": "status", "outcome": "status", "http_status": "status",
    "latitude": "latitude", "longitude": "longitude", "geo.lat": "latitude", "geo.lng": "longitude", "geometry.coordinates[0]": "longitude", "geometry.coordinates[1]": "latitude",
}
#: Key names after the quoted fields of access lines.
KEYS_F4 = {"type": "entity_type", "entity": "entity_type", "role": "entity_type", "lat": "latitude", "lon": "longitude"}
#: Columns of semicolon lines.
COLUMNS_F5 = ("event_timestamp", "entity_type", "email_address", "tool", "resource_url", "latitude", "longitude", "ip_address", "action_phrase", "status")
LOG_LEVELS = ("TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL")
#: What an address inside another field is called.
ADDRESS_KINDS = {"resource_url": "ip_like_in_resource", "tool": "ip_like_in_tool"}
NO_RESOURCE = "an unspecified resource"
NO_ACTOR = "anonymous"
#: Shapes of timestamps in the order in which they are tried. Y M D H I S are year, month, day, hour, minute and second with all digits,
#: m d h with one or two; N a month's name, P a day padded with a blank, s seconds that may lack, F a fraction, A the half of the day,
#: T what parts date and time, Z and O zones, E and L seconds and milliseconds since 1970.
SHAPES = (
    ("epoch_milliseconds", "%L"), ("epoch_seconds", "%E"), ("iso8601", "%Y-%M-%D%T%H:%I:%S%F%Z"), ("apache_clf", "%D/%N/%Y:%H:%I:%S %O"), ("us_mdy_12h", "%m/%d/%Y %h:%I%s %A"),
    ("syslog_rfc3164", "%N %P %H:%I:%S"), ("dmy_dash", "%D-%M-%Y %H:%I%s"), ("ymd_slash", "%Y/%M/%D %H:%I:%S"), ("compact_basic", "%Y%M%DT%H%I%S"),
)
EPOCHS = {"epoch_milliseconds": "milliseconds", "epoch_seconds": "seconds"}
