"""Feature queries with their full columns: transactions, fields, parser sessions, sequences, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import intervals as iv
from tessera.operators import sessions as se
from tessera.plans.contracts import _SQL_RECORD, v_record
from tessera.plans.manifests import _ASSIGNED, assigned
from tessera.plans.sessions import _T, v_tx
from tessera.plans.tabular import _IV, attributed
from tessera.plans.views import sql, table, v_interval, v_log, v_manifest, v_probe, v_score

c = F.col

# --- transactions and their fields ----------------------------------------------------------

#: Of a page as a transaction: path, query and headers, for both engines.
_HEADERS = {
    "host": "regexp_extract(url, '^[a-z]+://([^/]+)', 1)",
    "etag": "concat('W/\"', page_id, '\"')",
    "authorization": "concat('Bearer ', {sha})",
    "cookie": "concat('id=', page_id, '; lang=', regexp_extract(url, '/([a-z]+)/', 1))",
    "x-trace": "concat(page_id, '.', page_id % 7, '.', page_id % 11)",
}
_PATH, _QUERY = "regexp_extract(url, '^[a-z]+://[^/]+([^?]*)', 1)", "regexp_extract(url, '[?](.*)$', 1)"


def v_trace(s, d) -> DataFrame:
    """(page_id, method, kind, status, path, query, headers map, body): the body came as base64 and is clipped."""
    pages = table(s, d, "pages").where("html is not null")
    headers = [F.struct(F.lit(k).alias("key"), F.expr(e.format(sha="sha2(url, 256)")).alias("value")) for k, e in _HEADERS.items()]
    return pages.select("page_id", F.when(c("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), F.concat(F.lit("kind"), c("page_id") % 4).alias("kind"), (200 + c("page_id") % 5).cast("int").alias("status"), F.expr(_PATH).alias("path"), F.expr(_QUERY).alias("query"),
                        F.map_from_entries(F.array(*headers)).alias("headers"), F.length(F.encode("html", "UTF-8")).alias("body_length"), F.substring(F.try_to_binary(F.base64(F.encode("html", "UTF-8")), F.lit("base64")), 1, 16_384).alias("body"))


_TRACE = f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, concat('kind', page_id % 4) AS kind, (200 + page_id % 5)::INTEGER AS status, {_PATH} AS path, {_QUERY} AS query, " + ", ".join(f"{e.format(sha='sha256(url)')} AS h{i}" for i, e in enumerate(_HEADERS.values())) + ", strlen(html) AS body_length, substr(hex(encode(html)), 1, 32768) AS body FROM pages WHERE html IS NOT NULL"


def tx_features(s, d) -> DataFrame:
    blob = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\n")
    rows = v_trace(s, d).withColumn("blob", blob)
    return rows.select(
        "page_id", "kind", "method", F.char_length("path").alias("path_length"), F.char_length("query").alias("query_length"), F.size("headers").alias("header_count"), F.octet_length("blob").alias("header_bytes"),
        F.round(tx.byte_entropy(F.encode("blob", "UTF-8")), 6).alias("header_entropy"), c("body_length").alias("request_body_length"), F.round(tx.byte_entropy(c("body")), 6).alias("request_body_entropy"), (c("body_length") > 16_384).alias("request_body_truncated"), c("status").alias("response_status"), (c("page_id") * 37 % 5000).alias("response_body_length"),
    )


_BLOB = "concat_ws(chr(10), " + ", ".join(f"concat('{k}:', h{i})" for i, k in enumerate(_HEADERS)) + ")"


def _entropy_sql(source: str, keys: str, hexed: str) -> str:
    return f"SELECT {keys}, round(coalesce(-sum(n / t * log2(n / t)), 0), 6) AS entropy FROM (SELECT {keys}, b, count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY {keys}))::DOUBLE AS t FROM (SELECT {keys}, unnest(regexp_extract_all({hexed}, '..')) AS b FROM {source}) GROUP BY {keys}, b) GROUP BY {keys}"


_TX_SQL = f"SELECT page_id, kind, method, length(path)::INTEGER AS path_length, length(query)::INTEGER AS query_length, {len(_HEADERS)} AS header_count, strlen({_BLOB})::INTEGER AS header_bytes, coalesce(he.entropy, 0) AS header_entropy, body_length::INTEGER AS request_body_length, coalesce(be.entropy, 0) AS request_body_entropy, body_length > 16384 AS request_body_truncated, status AS response_status, page_id * 37 % 5000 AS response_body_length FROM tr LEFT JOIN he USING (page_id) LEFT JOIN be USING (page_id)"


def v_field(s, d) -> DataFrame:
    """One row per field of a transaction: path, query if there is one, headers, and the body as Latin-1."""
    one = lambda name, value, role: F.struct(F.lit(name).alias("field_name"), value.alias("value"), F.lit(role).alias("field_role"))
    heads = F.transform(F.map_entries("headers"), lambda e: F.struct(e["key"].alias("field_name"), e["value"].alias("value"), F.lit("request_header").alias("field_role")))
    body = F.decode("body", "ISO-8859-1")
    fields = F.concat(F.array(one(":path", c("path"), "request_target"), one(":query", c("query"), "request_target"), one(":body", body, "request_body")), heads)
    rows = v_trace(s, d).select("page_id", F.explode(fields).alias("f")).select("page_id", "f.*")
    return rows.where("not (field_name in (':query', ':body') and value = '')")


_FIELD = ("SELECT page_id, ':path' AS field_name, path AS value, 'request_target' AS field_role, hex(encode(path)) AS raw FROM tr UNION ALL SELECT page_id, ':query', query, 'request_target', hex(encode(query)) FROM tr WHERE query <> '' UNION ALL "
          + " UNION ALL ".join(f"SELECT page_id, '{k}', h{i}, 'request_header', hex(encode(h{i})) FROM tr" for i, k in enumerate(_HEADERS))
          + " UNION ALL SELECT page_id, ':body', latin, 'request_body', hex(encode(latin)) FROM (SELECT page_id, array_to_string(list_transform(regexp_extract_all(body, '..'), lambda x: chr(('0x' || x)::INTEGER)), '') AS latin FROM tr) WHERE latin <> ''")
#: ASCII classes of characters.
CLASSES = {"digit_ratio": "0-9", "alpha_ratio": "A-Za-z", "hex_ratio": "0-9A-Fa-f", "b64_ratio": "0-9A-Za-z+/=", "b64url_ratio": "0-9A-Za-z_=-", "delimiter_ratio": ":;,.|/_=+&?%-"}
FLAGS = {"authorization": "field_name = 'authorization'", "cookie": "field_name = 'cookie'", "etag": "field_name IN ('etag', 'if-none-match')", "range": "field_name = 'range'", "referer": "field_name = 'referer'", "custom_header": "field_role = 'request_header' AND field_name LIKE 'x-%'", "body": "field_role = 'request_body'"}
NUMERIC = ["raw_length", "byte_length", "entropy", "printable_ratio", "unique_char_ratio", *CLASSES, *tx.GRAMMARS, *(f"field_is_{k}" for k in FLAGS)]


def field_features(s, d) -> DataFrame:
    v = c("value")
    n = F.greatest(F.lit(1), F.char_length(v))
    return v_field(s, d).select(
        "page_id", "field_name", "field_role", F.char_length(v).alias("raw_length"), F.octet_length(v).alias("byte_length"), F.round(tx.byte_entropy(F.encode(v, "UTF-8")), 6).alias("entropy"),
        F.round(F.coalesce(F.try_divide(F.regexp_count(v, F.lit(r"[\x20-\x7E]")), F.octet_length(v)), F.lit(0.0)), 6).alias("printable_ratio"), F.round(tx.unique_share(v), 6).alias("unique_char_ratio"),
        F.when(v == "", "").otherwise(F.substring(F.sha2(F.expr("left(value, 8)"), 256), 1, 12)).alias("prefix8_hash"), *(F.round(F.regexp_count(v, F.lit(f"[{x}]")) / n, 6).alias(k) for k, x in CLASSES.items()),
        *(v.rlike(p).cast("int").alias(k) for k, p in tx.GRAMMARS.items()), *(F.expr(e).cast("int").alias(f"field_is_{k}") for k, e in FLAGS.items()),
    )


_COUNT = "length(regexp_replace(value, '[^{x}]', '', 'g'))"
_FIELD_SQL = (
    "SELECT page_id, field_name, field_role, length(value)::INTEGER AS raw_length, strlen(value)::INTEGER AS byte_length, coalesce(entropy, 0) AS entropy, round(coalesce(" + _COUNT.format(x=r"\x20-\x7E") + " / nullif(strlen(value), 0)::DOUBLE, 0), 6) AS printable_ratio, round(len(list_distinct(string_split(value, ''))) / greatest(1, length(value))::DOUBLE, 6) AS unique_char_ratio, CASE WHEN value = '' THEN '' ELSE substr(sha256(left(value, 8)), 1, 12) END AS prefix8_hash, "
    + ", ".join(f"round({_COUNT.format(x=x)} / greatest(1, length(value))::DOUBLE, 6) AS {k}" for k, x in CLASSES.items()) + ", " + ", ".join(f"regexp_matches(value, '{p}')::INTEGER AS {k}" for k, p in tx.GRAMMARS.items()) + ", " + ", ".join(f"({e})::INTEGER AS field_is_{k}" for k, e in FLAGS.items())
    + " FROM f LEFT JOIN fe USING (page_id, field_name)"
)
_FIELDS = dict(tr=_TRACE, f=_FIELD, fe=_entropy_sql("f", "page_id, field_name", "raw"))


def field_aggregate(s, d) -> DataFrame:
    kinds = {"mean": lambda x: F.round(F.avg(x), 10), "max": lambda x: F.max(x).cast("double"), "sum": lambda x: F.round(F.sum(x).cast("double"), 6)}
    return field_features(s, d).groupBy("page_id").agg(*(f(n).alias(f"field_{n}_{k}") for n in NUMERIC for k, f in kinds.items()))


_FIELD_AGG = "SELECT page_id, " + ", ".join(f"round(avg({n}), 10) AS field_{n}_mean, max({n})::DOUBLE AS field_{n}_max, round(sum({n})::DOUBLE, 6) AS field_{n}_sum" for n in NUMERIC) + " FROM ff GROUP BY page_id"

# --- parser sessions ------------------------------------------------------------------------

FAMILIES = ["ja4", "ja4s", "ja4h", "ja4x", "ja4t"]
#: A log row of one of two sources; its address stands in one of two places, its fingerprints in nested keys.
_LOG_COLUMNS = {
    "source": "CASE WHEN stream = 'A' THEN 'first' ELSE 'second' END",
    "log": "CASE event_id % 7 WHEN 0 THEN 'http' WHEN 1 THEN 'tls' WHEN 2 THEN 'dns' WHEN 3 THEN 'quic' WHEN 4 THEN 'flow' WHEN 5 THEN CASE WHEN stream = 'A' THEN 'alert' ELSE 'websocket' END ELSE 'other' END",
    "proto": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('p', service) END", "service_name": "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('s', service) END",
    "sni": "CASE WHEN event_id % 5 = 1 THEN concat('h', host) ELSE '' END", "hostname": "CASE WHEN event_id % 5 IN (0, 2) THEN concat('h', host) ELSE NULL END", "status": "CASE WHEN event_id % 2 = 0 THEN 200 + host ELSE NULL END",
    "flow_id": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 31 END", "uid": "CASE WHEN event_id % 8 = 0 THEN '' ELSE concat('u', event_id % 29) END",
    **{f"{f}_value": f"CASE event_id % {6 + i} WHEN 0 THEN '-' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE concat('{f}', host % {3 + i}) END" for i, f in enumerate(FAMILIES)},
}


def parser_rows(s, d) -> DataFrame:
    """Rows of both logs as they are nested, then with the address from either place and every fingerprint key below any parent."""
    logs = v_log(s, d).selectExpr("event_id", "src", "ts_us", *(f"{e} AS {k}" for k, e in _LOG_COLUMNS.items()))
    nested = logs.select("*", F.when(c("source") == "first", c("src")).alias("src_flat"), F.struct(F.when(c("source") == "second", c("src")).alias("orig")).alias("id"), F.struct(*(c(f"{f}_value").alias(f) for f in FAMILIES[:3])).alias("tls"), F.struct(F.struct(*(c(f"{f}_value").alias(f) for f in FAMILIES[3:])).alias("inner")).alias("quic"))
    return nested.drop("src", *(f"{f}_value" for f in FAMILIES)).withColumn("src", F.coalesce("src_flat", "id.orig"))


def _leaves(schema, prefix: str = "") -> list[str]:
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += _leaves(f.dataType, name + ".") if f.dataType.typeName() == "struct" else [name]
    return out


def parser_aggregates(s, d) -> DataFrame:
    """26 columns for each session that has log rows."""
    rows = parser_rows(s, d)
    keys = {f: [x for x in _leaves(rows.schema) if x.lower() == f or x.lower().endswith("." + f)] for f in FAMILIES}
    held = iv.attribute(rows.select("src", "ts_us", *(x for x in rows.columns if x not in ("src", "ts_us"))), v_interval(s, d)).where("session_id is not null")
    first, second = c("source") == "first", c("source") == "second"
    # each value of a row is a row of its own, so what is counted once by value is short, however many columns are counted
    said = lambda x: F.when(c(x) != "", c(x))
    marks = {f: F.get(F.filter(F.array(*map(F.col, k)), lambda x: x.isNotNull() & ~x.isin("", "-")), F.lit(0)) for f, k in keys.items()}
    values = {
        "kind": F.concat(c("source"), F.lit(":"), F.coalesce("log", F.lit(""))), "proto": F.when(first, said("proto")), "service": F.when(second, said("service_name")), "sni": said("sni"), "host": said("hostname"),
        "status": c("status"), "flow_id": F.when(first, c("flow_id")), "uid": F.when(second, said("uid")), **marks,
    }
    at = {name: i for i, name in enumerate(values)}
    each = held.select("session_id", F.posexplode(F.array(*(v.cast("string") for v in values.values()))).alias("at", "value")).where("value is not null")
    each = each.groupBy("session_id", "at", "value").agg(F.count("*").alias("n"))
    number = lambda of: F.sum(F.when((c("at") == at["kind"]) & of, c("n")).otherwise(0))
    log = lambda name: number(c("value").isin(f"first:{name}", f"second:{name}"))
    unique = lambda name: F.count_if(c("at") == at[name])
    return each.groupBy("session_id").agg(
        number(c("value").startswith("first:")).alias("first_events"), number(c("value").startswith("second:")).alias("second_events"), number(c("value") == "first:alert").alias("alerts"), log("http").alias("http_events"), log("tls").alias("tls_events"), log("dns").alias("dns_events"), log("quic").alias("quic_events"),
        number(c("value") == "second:websocket").alias("websocket_events"), log("flow").alias("flow_events"), *(unique(x).alias(f"{x}_unique") for x in list(at)[1:]), *((unique(f) > 0).cast("int").alias(f"{f}_present") for f in marks),
    )


def parser_features(s, d) -> DataFrame:
    per = parser_aggregates(s, d)
    joined = v_interval(s, d).select("session_id").join(per, "session_id", "left")
    return joined.select("session_id", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in per.columns[1:]))


_PARSER_ROWS = "SELECT event_id AS rec, src, ts_us, " + ", ".join(f"{e} AS {k}" for k, e in _LOG_COLUMNS.items()) + " FROM v_log"
_MARK = "CASE WHEN {f}_value IS NOT NULL AND {f}_value NOT IN ('', '-') THEN {f}_value END"
_PARSER_COLUMNS = {
    "first_events": "count_if(source = 'first')", "second_events": "count_if(source = 'second')", "alerts": "count_if(source = 'first' AND log = 'alert')", "http_events": "count_if(log = 'http')", "tls_events": "count_if(log = 'tls')", "dns_events": "count_if(log = 'dns')", "quic_events": "count_if(log = 'quic')", "websocket_events": "count_if(source = 'second' AND log = 'websocket')",
    "flow_events": "count_if(log = 'flow')", "proto_unique": "count(DISTINCT CASE WHEN source = 'first' AND proto <> '' THEN proto END)", "service_unique": "count(DISTINCT CASE WHEN source = 'second' AND service_name <> '' THEN service_name END)", "sni_unique": "count(DISTINCT nullif(sni, ''))", "host_unique": "count(DISTINCT nullif(hostname, ''))", "status_unique": "count(DISTINCT status)",
    "flow_id_unique": "count(DISTINCT CASE WHEN source = 'first' THEN flow_id END)", "uid_unique": "count(DISTINCT CASE WHEN source = 'second' AND uid <> '' THEN uid END)", **{f"{f}_unique": f"count(DISTINCT {_MARK.format(f=f)})" for f in FAMILIES}, **{f"{f}_present": f"max(({_MARK.format(f=f)} IS NOT NULL)::INT)" for f in FAMILIES},
}
_PARSER = "SELECT session_id, " + ", ".join(f"coalesce({k}, 0)::BIGINT AS {k}" for k in _PARSER_COLUMNS) + " FROM (SELECT session_id FROM v_interval) LEFT JOIN (SELECT session_id, " + ", ".join(f"{e} AS {k}" for k, e in _PARSER_COLUMNS.items()) + " FROM att JOIN pr USING (rec) WHERE session_id IS NOT NULL GROUP BY session_id) USING (session_id)"

# --- time -----------------------------------------------------------------------------------


def temporal(s, d) -> DataFrame:
    """18 columns of a session's transactions: gaps, bursts, silences, entropies, changes and correlations with one and two rows before."""
    return se.temporal_full(v_tx(s, d).withColumn("size", c("req") + c("resp")), "session_id", ["rec"], "ts_us", ["method", "kind", "status"], "size")


def _corr(x: str, y: str) -> str:
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"CASE WHEN count(*) {both} >= 3 AND round(stddev_pop({x}) {both}, 9) <> 0 AND round(stddev_pop({y}) {both}, 9) <> 0 THEN round(covar_pop({x}, {y}) {both} / (stddev_pop({x}) {both} * stddev_pop({y}) {both}), 4) ELSE 0 END"


_GAPS = "SELECT *, lag(size) OVER w AS size1, lag(size, 2) OVER w AS size2, (ts_us - lag(ts_us) OVER w) / 1000000.0::DOUBLE AS gap, method <> lag(method) OVER w AS cm, kind <> lag(kind) OVER w AS ck, status <> lag(status) OVER w AS cs FROM (SELECT *, (req + resp)::DOUBLE AS size FROM tx) WINDOW w AS (PARTITION BY session_id ORDER BY rec)"
_TEMPORAL = ("SELECT session_id, n, duration, gap_mean, gap_std, gap_cv, gap_p95, burst_share, silence_share, method_entropy, kind_entropy, status_entropy, method_change, kind_change, status_change, size_lag1, size_lag2, gap_lag1, gap_lag2 FROM (SELECT session_id, count(*) AS n, round((max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE, 4) AS duration, round(coalesce(avg(gap), 0), 4) AS gap_mean, round(coalesce(stddev_pop(gap), 0), 4) AS gap_std, round(coalesce(CASE WHEN avg(gap) <> 0 THEN stddev_pop(gap) / avg(gap) END, 0), 4) AS gap_cv, round(coalesce(quantile_cont(gap, 0.95), 0), 4) AS gap_p95, round(coalesce(avg((gap <= mg / 2)::INT::DOUBLE) FILTER (WHERE gap IS NOT NULL), 0), 6) AS burst_share, round(coalesce(avg((gap >= mg * 2)::INT::DOUBLE) FILTER (WHERE gap IS NOT NULL), 0), 6) AS silence_share, round(coalesce(avg(cm::INT::DOUBLE), 0), 6) AS method_change, round(coalesce(avg(ck::INT::DOUBLE), 0), 6) AS kind_change, round(coalesce(avg(cs::INT::DOUBLE), 0), 6) AS status_change, "
             + f"{_corr('size', 'size1')} AS size_lag1, {_corr('size', 'size2')} AS size_lag2, {_corr('gap', 'gap1')} AS gap_lag1, {_corr('gap', 'gap2')} AS gap_lag2 FROM g2 JOIN m USING (session_id) GROUP BY session_id) "
             + " ".join(f"JOIN (SELECT session_id, round(sum(-p * log2(p)), 6) AS {x}_entropy FROM (SELECT session_id, count(*) / (sum(count(*)) OVER (PARTITION BY session_id))::DOUBLE AS p FROM tx GROUP BY session_id, {x}) GROUP BY session_id) USING (session_id)" for x in ("method", "kind", "status")))
_TEMPORAL_CTES = dict(g=_GAPS, g2="SELECT *, lag(gap) OVER w AS gap1, lag(gap, 2) OVER w AS gap2 FROM g WINDOW w AS (PARTITION BY session_id ORDER BY rec)", m="SELECT session_id, quantile_cont(gap, 0.5) AS mg FROM g GROUP BY session_id")

# --- sequences ------------------------------------------------------------------------------

STEPS = 96
#: What protocols and kinds are sorted into.
PROTOCOLS, KINDS = ["http", "https", "h2", "h3", "wss", "grpc", "mqtt", "quic", "other"], ["poll", "request", "response", "result", "upload", "download", "heartbeat", "other"]


def bucket_of(value: Column, buckets: list[str]) -> Column:
    return tx.bucket(value, buckets[:-1], buckets[-1])


def packet_rows(s, d) -> DataFrame:
    rows = attributed(s, d).where("session_id is not null")
    rows = iv.first_of(rows, ["session_id", "flow"], "rec", "flow_boundary", c("flow") == "signup")
    rows = iv.seen_before(rows, ["session_id", "flow", "direction", "seq"], "rec", "retransmit", c("size") > 0)
    return iv.delta_t(rows)


def packet_channels() -> dict[str, Column]:
    scale = lambda x, cap: F.round(F.log1p(F.greatest(x, F.lit(0.0))) / F.log1p(F.lit(float(cap))), 6)
    flag = lambda x: x.cast("double")
    return {
        "direction": c("direction").cast("double"), "size": scale(c("size"), 65535), "delta_t": scale(c("delta_t"), 3600), "transport_tcp": flag(c("flow") == "click"), "transport_udp": flag(c("flow") == "view"), "syn": flag(c("flow") == "signup"), "ack": flag(c("seq") % 2 == 0), "fin": flag(c("seq") % 11 == 0),
        "rst": flag(c("flow") == "error"), "psh": flag(c("seq") % 3 == 0), "retransmit": flag(c("retransmit")), "flow_boundary": flag(c("flow_boundary")),
    }


def visible_channels() -> dict[str, Column]:
    scale = lambda x, cap: F.round(F.log1p(F.greatest(x.cast("double"), F.lit(0.0))) / F.log1p(F.lit(float(cap))), 6)
    protocol, kind = bucket_of(c("protocol"), PROTOCOLS), bucket_of(c("word"), KINDS)
    return {
        "direction": F.signum((c("req") - c("resp")).cast("double")), "size": scale(c("req") + c("resp"), 1_000_000), "delta_t": scale(c("delta_t"), 3600), "status": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("status") / 599.0)), 6),
        **{f"protocol_{x}": (protocol == x).cast("double") for x in PROTOCOLS}, **{f"kind_{x}": (kind == x).cast("double") for x in KINDS},
    }


_WORDS = "CASE rec % 5 WHEN 0 THEN 'Long-Poll' WHEN 1 THEN 'request' WHEN 2 THEN 'UPLOAD' WHEN 3 THEN 'heartbeat' ELSE 'x' END"
_PROTOCOL = "CASE rec % 4 WHEN 0 THEN 'https' WHEN 1 THEN 'WSS' WHEN 2 THEN 'h3' ELSE 'odd' END"


def visible_rows(s, d) -> DataFrame:
    return iv.delta_t(v_tx(s, d).selectExpr("*", f"{_PROTOCOL} AS protocol", f"{_WORDS} AS word"))


def steps_of(rows: DataFrame, channels: dict[str, Column]) -> DataFrame:
    """(session_id, step, channels, mask) for all STEPS steps; those after a session's last row are 0."""
    held = se.sequences(rows, "session_id", "rec", channels, STEPS)
    long = held.select("session_id", F.posexplode("seq").alias("step", "x"), "mask")
    return long.select("session_id", "step", *(F.get("x", F.lit(i)).alias(n) for i, n in enumerate(channels)), F.element_at("mask", c("step") + 1).alias("mask"))


def _steps_sql(rows: str, channels: dict[str, str]) -> str:
    half = STEPS // 2
    return f"SELECT session_id, step::INTEGER AS step, " + ", ".join(f"coalesce({n}, 0)::DOUBLE AS {n}" for n in channels) + f", (place IS NOT NULL)::INTEGER AS mask FROM (SELECT DISTINCT session_id FROM {rows}) CROSS JOIN range({STEPS}) t(step) LEFT JOIN (SELECT session_id, place, row_number() OVER (PARTITION BY session_id ORDER BY place) - 1 AS step, " + ", ".join(f"{e} AS {n}" for n, e in channels.items()) + f" FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rec) AS place, count(*) OVER (PARTITION BY session_id) AS held FROM {rows}) WHERE held <= {STEPS} OR place <= {half} OR place > held - {half}) USING (session_id, step)"


def _scale(x: str, cap: int) -> str:
    return f"round(ln(1 + greatest(({x})::DOUBLE, 0)) / ln(1 + {cap}.0::DOUBLE), 6)"


_PACKETS = "SELECT *, greatest(0.0::DOUBLE, coalesce((ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY rec)) / 1000000.0::DOUBLE, 0)) AS delta_t, (row_number() OVER (PARTITION BY session_id, flow ORDER BY rec) = 1 OR flow = 'signup') AS flow_boundary, (row_number() OVER (PARTITION BY session_id, flow, direction, seq ORDER BY rec) > 1 AND size > 0) AS retransmit FROM att WHERE session_id IS NOT NULL"
_PACKET_CHANNELS = {"direction": "direction", "size": _scale("size", 65535), "delta_t": _scale("delta_t", 3600), **{k: f"({e})::INT" for k, e in {"transport_tcp": "flow = 'click'", "transport_udp": "flow = 'view'", "syn": "flow = 'signup'", "ack": "seq % 2 = 0", "fin": "seq % 11 = 0", "rst": "flow = 'error'", "psh": "seq % 3 = 0", "retransmit": "retransmit", "flow_boundary": "flow_boundary"}.items()}}
_VISIBLE = f"SELECT *, {_PROTOCOL} AS protocol, {_WORDS} AS word, greatest(0.0::DOUBLE, coalesce((ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY rec)) / 1000000.0::DOUBLE, 0)) AS delta_t FROM tx"


def _bucket_sql(column: str, buckets: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{b}') THEN '{b}'" for b in buckets[:-1]) + f" ELSE '{buckets[-1]}' END"


_VISIBLE_CHANNELS = {"direction": "sign(req - resp)", "size": _scale("req + resp", 1_000_000), "delta_t": _scale("delta_t", 3600), "status": "round(greatest(0, least(1, status / 599.0::DOUBLE)), 6)", **{f"protocol_{x}": f"({_bucket_sql('protocol', PROTOCOLS)} = '{x}')::INT" for x in PROTOCOLS}, **{f"kind_{x}": f"({_bucket_sql('word', KINDS)} = '{x}')::INT" for x in KINDS}}

# --- identifiers, relabelling, selection ----------------------------------------------------

TRANSFORMS, TIMINGS, SIZES = ["raw_utf8", "base64", "base64url", "hex", "zlib_base64", "semantic_uuid"], ["fixed", "low_jitter", "medium_jitter", "burst"], ["tiny", "small", "medium", "large"]
CORE = 37  # rows of the core catalogue
_IDS = "CASE doc_id % 8 WHEN 0 THEN concat('a-', doc_id % 5, '-', doc_id % 3, '-', doc_id, '-', doc_id % 2) WHEN 1 THEN concat('b-', doc_id, '-', doc_id % 4) WHEN 2 THEN concat('c-', doc_id, '-1') WHEN 3 THEN concat('f-', doc_id, '-', doc_id % 9) WHEN 4 THEN concat('h-', doc_id, '-', doc_id % 9, '-2') WHEN 5 THEN concat('d-', doc_id % 30, '-', doc_id) WHEN 6 THEN concat('adv-', doc_id) ELSE concat('z-', doc_id) END"
#: Grammar of an id, and what its numbers give for transform, timing and size.
ID_RULES = [
    (r"^a-\d+-\d+-(\d+)-[01]$", lambda x, y: (x, x, x)),
    (r"^b-(\d+)-\d+$", lambda x, y: (F.floor(x / CORE), F.floor(x / 7), F.floor(x / 13))),
    (r"^c-(\d+)-\d+$", lambda x, y: (x, x, x)),
    (r"^[fgh]-(\d+)-(\d+)(?:-\d+)?$", lambda x, y: (x + y, x + y, x + y)),
    (r"^d-(\d+)-(\d+)$", lambda x, y: (x + y, x + y, x + y)),
    (r"^adv-(\d+)$", lambda x, y: (x * 3, x * 7, x * 11)),
]


def factors(s, d) -> DataFrame:
    ids = table(s, d, "documents").selectExpr("doc_id", f"{_IDS} AS id")
    number = lambda p, n: F.try_element_at(F.regexp_extract_all("id", F.lit(p), F.lit(n)), F.lit(1)).cast("long")
    chosen = []
    for which, (values, fallback) in enumerate(((TRANSFORMS, 0), (TIMINGS, 0), (SIZES, 1))):
        index = None
        for pattern, rule in ID_RULES:
            x = number(pattern, 1)
            y = number(pattern, 2) if pattern.count("(") - pattern.count("(?") > 1 else F.lit(0)
            hit = rule(x, y)[which]
            index = F.when(c("id").rlike(pattern), hit) if index is None else index.when(c("id").rlike(pattern), hit)
        index = F.pmod(F.coalesce(index, F.lit(fallback)).cast("long"), F.lit(len(values)))
        chosen.append(F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int")))
    return ids.select("doc_id", "id", *(x.alias(n) for x, n in zip(chosen, ("transform", "timing", "size_class"), strict=True)))


def _factor_sql(values: list[str], fallback: int, numbers: list[str]) -> str:
    index = f"CASE doc_id % 8 WHEN 0 THEN {numbers[0]} WHEN 1 THEN {numbers[1]} WHEN 2 THEN doc_id WHEN 3 THEN doc_id + doc_id % 9 WHEN 4 THEN doc_id + doc_id % 9 WHEN 5 THEN doc_id % 30 + doc_id WHEN 6 THEN doc_id * {numbers[2]} ELSE {fallback} END"
    return f"{values}[{index} % {len(values)} + 1]"


_FACTORS = f"SELECT doc_id, {_IDS} AS id, {_factor_sql(TRANSFORMS, 0, ['doc_id', f'doc_id // {CORE}', '3'])} AS transform, {_factor_sql(TIMINGS, 0, ['doc_id', 'doc_id // 7', '7'])} AS timing, {_factor_sql(SIZES, 1, ['doc_id', 'doc_id // 13', '11'])} AS size_class FROM documents"


def relabelled(s, d) -> DataFrame:
    """Background records get benign semantics whatever they said; a positive mixed one of the background family is moved to another."""
    forced = c("record_id").startswith("g-")
    moved = c("record_id").startswith("d-") & (c("label") == 1) & (c("family") == "background")
    put = lambda value, other: F.when(forced, F.lit(value)).otherwise(c(other)).alias(other)
    return v_record(s, d).select("doc_id", "record_id", put(0, "label"), put("benign", "intent"), put("", "mapping"), put("background", "stage"), put("hard_negative", "role"), F.when(forced, "trusted").alias("source_family"), F.when(forced, "detection").alias("target_task"),
                                 F.when(moved, c("family")).alias("requested_family"), F.when(moved, "not_a_positive_target").alias("substitution_reason"), F.when(moved, "socket").otherwise(c("family")).alias("family"))


_FORCED, _MOVED = "record_id LIKE 'g-%'", "record_id LIKE 'd-%' AND label = 1 AND family = 'background'"
_RELABELLED = f"SELECT doc_id, record_id, CASE WHEN {_FORCED} THEN 0 ELSE label END AS label, CASE WHEN {_FORCED} THEN 'benign' ELSE intent END AS intent, CASE WHEN {_FORCED} THEN '' ELSE mapping END AS mapping, CASE WHEN {_FORCED} THEN 'background' ELSE stage END AS stage, CASE WHEN {_FORCED} THEN 'hard_negative' ELSE role END AS role, CASE WHEN {_FORCED} THEN 'trusted' END AS source_family, CASE WHEN {_FORCED} THEN 'detection' END AS target_task, CASE WHEN {_MOVED} THEN family END AS requested_family, CASE WHEN {_MOVED} THEN 'not_a_positive_target' END AS substitution_reason, CASE WHEN {_MOVED} THEN 'socket' ELSE family END AS family FROM r"

FAMILY_SETS = {"core": ["uri", "header", "body", "timing"], "web": ["socket", "http2", "stream"], "challenge": ["browser", "tunnel", "mail"]}
_CATALOGUE = "SELECT p_partkey AS scenario, CASE p_partkey % 12 WHEN 0 THEN 'uri' WHEN 1 THEN 'header' WHEN 2 THEN 'body' WHEN 3 THEN 'timing' WHEN 4 THEN 'socket' WHEN 5 THEN 'http2' WHEN 6 THEN 'stream' WHEN 7 THEN 'browser' WHEN 8 THEN 'tunnel' WHEN 9 THEN 'mail' ELSE 'rest' END AS family FROM part"


def select_stage(catalogue: DataFrame, stage: str, shard: int = 0, shards: int = 1) -> DataFrame:
    """Rows of a stage's families in catalogue order (of ``parser`` the first 60), then each ``shards``-th one; an unknown stage is an error."""
    if stage not in (*FAMILY_SETS, "parser", "all"):
        raise ValueError(f"unknown stage: {stage}")
    if stage in FAMILY_SETS:
        catalogue = catalogue.where(c("family").isin(FAMILY_SETS[stage]))
    if stage == "parser":
        catalogue = catalogue.orderBy("scenario").limit(60)
    place = se.row_numbers(catalogue, "scenario")
    return place.where((c("place") - 1) % shards == shard).drop("place")


def stages(s, d) -> DataFrame:
    catalogue, out = table(s, d, "part").selectExpr("p_partkey AS scenario", _CATALOGUE.split("scenario, ")[1].split(" AS family")[0] + " AS family"), None
    for stage, shard in (("core", 1), ("web", 0), ("challenge", 2), ("parser", 1), ("all", 2)):
        part = select_stage(catalogue, stage, shard, 3).withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    return out


_STAGES = " UNION ALL ".join(
    f"SELECT scenario, family, '{stage}' AS stage FROM (SELECT *, row_number() OVER (ORDER BY scenario) AS place FROM cat" + (f" WHERE family IN ({', '.join(repr(x) for x in FAMILY_SETS[stage])})" if stage in FAMILY_SETS else "") + (" ORDER BY scenario LIMIT 60" if stage == "parser" else "") + f") WHERE (place - 1) % 3 = {shard}"
    for stage, shard in (("core", 1), ("web", 0), ("challenge", 2), ("parser", 1), ("all", 2))
)

GROUPS = {"header": "carrier IN ('src0', 'src2') OR family = 'header'", "wss": "family IN ('socket', 'tunnel') OR transport = 'wss'", "timing": "family = 'timing' OR carrier = 'src4'", "h3": "family = 'http3' OR transport IN ('h3', 'quic')", "tunnel": "family IN ('tunnel', 'connect')"}
_COMPOSED = "SELECT doc_id, source AS carrier, CASE doc_id % 5 WHEN 0 THEN 'header' WHEN 1 THEN 'socket' WHEN 2 THEN 'timing' WHEN 3 THEN 'tunnel' ELSE 'http3' END AS family, CASE doc_id % 4 WHEN 0 THEN 'wss' WHEN 1 THEN 'h3' WHEN 2 THEN 'quic' ELSE 'tcp' END AS transport FROM documents"


def compositions(s, d) -> DataFrame:
    """Membership of each technique group, and the groups joined in their order."""
    rows = table(s, d, "documents").selectExpr("doc_id", "source AS carrier", _COMPOSED.split("carrier, ", 1)[1].split(" AS family, ")[0] + " AS family", _COMPOSED.split(" AS family, ")[1].split(" AS transport")[0] + " AS transport")
    flags = {g: F.coalesce(F.expr(e), F.lit(False)) for g, e in GROUPS.items()}
    key = F.concat_ws("+", *(F.when(f, g) for g, f in flags.items()))
    return rows.select("doc_id", *(f.cast("int").alias(f"holdout_{g}") for g, f in flags.items()), F.when(key == "", "other").otherwise(key).alias("composition_key"))


_COMPOSITIONS = "SELECT doc_id, " + ", ".join(f"coalesce({e}, FALSE)::INTEGER AS holdout_{g}" for g, e in GROUPS.items()) + ", CASE WHEN k = '' THEN 'other' ELSE k END AS composition_key FROM (SELECT *, concat_ws('+', " + ", ".join(f"CASE WHEN {e} THEN '{g}' END" for g, e in GROUPS.items()) + f") AS k FROM ({_COMPOSED}))"

QUERIES = {
    "tx_features": tx_features,
    "field_features": field_features,
    "feat_field_agg": field_aggregate,
    "feat_parser_session": parser_features,
    "feat_temporal": temporal,
    "seq_packets": lambda s, d: steps_of(packet_rows(s, d), packet_channels()),
    "seq_transactions": lambda s, d: steps_of(visible_rows(s, d), visible_channels()),
    "factor_decode": factors,
    "relabel_background": relabelled,
    "dim_stage_select": stages,
    "feat_composition_key": compositions,
    "tx_enrich_fields": lambda s, d: v_tx(s, d).join(attributed(s, d).where("session_id is not null").groupBy("session_id", "ts_us").agg(F.count("*").alias("n_rows"), F.round(F.sum("size"), 4).alias("size_sum"), F.max("direction").alias("direction")), ["session_id", "ts_us"], "left").select("rec", "session_id", "ts_us", "n_rows", "size_sum", "direction"),
    "topk_compositions": lambda s, d: compositions(s, d).where(F.contains("composition_key", F.lit("+"))).groupBy("composition_key").agg(F.count("*").alias("n")).where("n >= 20").orderBy(F.desc("n"), "composition_key").limit(8),
}

ORACLES = {
    "tx_features": sql(_TX_SQL, tr=_TRACE, he=_entropy_sql(f"(SELECT page_id, hex(encode({_BLOB})) AS raw FROM tr)", "page_id", "raw"), be=_entropy_sql("tr", "page_id", "body")),
    "field_features": sql(_FIELD_SQL, **_FIELDS),
    "feat_field_agg": sql(_FIELD_AGG, **_FIELDS, ff=_FIELD_SQL),
    "feat_parser_session": sql(_PARSER, "v_interval", "v_probe", "v_log", **{k: v for k, v in _T.items() if k != "tx"}, pr=_PARSER_ROWS),
    "feat_temporal": sql(_TEMPORAL, *_IV, **_T, **_TEMPORAL_CTES),
    "seq_packets": sql(_steps_sql("pk", _PACKET_CHANNELS), *_IV, **_T, pk=_PACKETS),
    "seq_transactions": sql(_steps_sql("vs", _VISIBLE_CHANNELS), *_IV, **_T, vs=_VISIBLE),
    "factor_decode": _FACTORS,
    "relabel_background": sql(_RELABELLED, r=_SQL_RECORD),
    "dim_stage_select": sql(_STAGES, cat=_CATALOGUE),
    "feat_composition_key": _COMPOSITIONS,
    "tx_enrich_fields": sql("SELECT rec, session_id, ts_us, n_rows, size_sum, direction FROM tx LEFT JOIN (SELECT session_id, ts_us, count(*) AS n_rows, round(sum(size), 4) AS size_sum, max(direction) AS direction FROM att WHERE session_id IS NOT NULL GROUP BY 1, 2) USING (session_id, ts_us)", *_IV, **_T),
    "topk_compositions": f"SELECT composition_key, count(*) AS n FROM ({_COMPOSITIONS}) WHERE contains(composition_key, '+') GROUP BY 1 HAVING count(*) >= 20 ORDER BY n DESC, composition_key LIMIT 8",
}
