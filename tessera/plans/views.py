"""Stand-in tables for the reports and feature queries, once as DataFrames and once as SQL for the independent check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds since 1970 of a timestamp without zone, whatever the session's zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_client(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "date_add(DATE'1950-01-01', cast(pmod(c_custkey * 37, 20000) AS int)) AS birthdate")


def v_card(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS id_cards", "o_custkey AS id_per", "o_orderstatus = 'O' AS active", "o_orderpriority AS payment_system")


def v_txn(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS id_cards", "l_linenumber AS line", "l_shipdate AS operation_date", "CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS operation", "l_extendedprice AS amount")


def v_loans(spark, d):
    return table(spark, d, "orders").selectExpr("o_custkey AS id", "o_totalprice AS creditlimit", "o_orderdate AS dt", "nullif(pmod(o_orderkey, 4), 0) AS program")


def v_offers(spark, d):
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return joined.selectExpr(
        "l_partkey AS sku", "l_extendedprice / l_quantity AS comp_price", "CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_linenumber END AS rank", "p_retailprice AS base_price",
        "CASE pmod(p_size, 6) WHEN 0 THEN 'avg' WHEN 1 THEN 'med' WHEN 2 THEN 'min' WHEN 3 THEN 'max' WHEN 4 THEN 'rnk' ELSE 'unknown' END AS agg", "l_orderkey * 10 + l_linenumber AS row_no",
    )


def v_pay(spark, d):
    return table(spark, d, "orders").groupBy(F.expr("date_format(o_orderdate, 'yyyy-MM')").alias("time"), F.col("o_orderpriority").alias("mode")).agg(F.expr("100.0D * avg(cast(o_orderstatus = 'F' AS double))").alias("percents"))


def v_interval(spark, d):
    start = MICROS.format("ts")
    return table(spark, d, "events").where("event_type = 'signup'").selectExpr("concat('x-', event_id) AS session_id", "user_id AS src", f"{start} AS start_us", f"{start} + 21600000000 AS end_us", "event_id AS ordinal")


def v_probe(spark, d):
    return table(spark, d, "events").selectExpr(
        "user_id AS src", f"{MICROS.format('ts')} AS ts_us", "value AS size", "CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN 1 ELSE -1 END AS direction",
        "event_type AS flow", "cast(get_json_object(props, '$.k') AS bigint) AS seq", "event_id AS rec",
    )


def v_manifest(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").selectExpr(
        "concat('a-', doc_id) AS id", "doc_id", "coalesce(toxic, 0) AS label", "concat('client', doc_id % 8) AS client", "source AS carrier", "lang",
        "element_at(array('isolated', 'sequence', 'mixed', 'background', 'challenge', 'parser'), cast(doc_id % 6 + 1 AS int)) AS stage",
        "CASE WHEN doc_id % 11 = 0 THEN 'external' ELSE 'core' END AS role", "doc_id % 25 AS scenario", "CASE WHEN doc_id % 3 = 0 THEN 'encode+split' WHEN doc_id % 3 = 1 THEN 'encode' ELSE 'none' END AS transform",
        "CASE WHEN coalesce(toxic, 0) = 1 THEN 'probe' ELSE 'benign' END AS intent", "doc_id % 997 AS seed", "sha2(text, 256) AS payload", "n_chars",
    )


def v_child(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id AS parent", "turn", "role", "text")


def v_score(spark, d):
    score = "cast(conv(substr(sha2(cast(doc_id AS string), 256), 1, 8), 16, 10) AS bigint) % 1000 / 1000.0D"
    return table(spark, d, "labels").where("quality is not null").selectExpr("doc_id", "quality AS label", f"{score} AS score")


def v_log(spark, d):
    k = "cast(get_json_object(props, '$.k') AS bigint)"
    return table(spark, d, "events").selectExpr("event_id", "user_id AS src", "CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS stream", "event_type AS kind", f"{k} % 5 AS service", f"{k} % 11 AS host", f"{MICROS.format('ts')} AS ts_us")


#: SQL of the views, in order of use.
SQL_VIEWS = {
    "v_manifest": "SELECT 'a-' || doc_id AS id, doc_id, coalesce(toxic, 0) AS label, 'client' || (doc_id % 8) AS client, source AS carrier, lang, ['isolated', 'sequence', 'mixed', 'background', 'challenge', 'parser'][doc_id % 6 + 1] AS stage, CASE WHEN doc_id % 11 = 0 THEN 'external' ELSE 'core' END AS role, doc_id % 25 AS scenario, CASE WHEN doc_id % 3 = 0 THEN 'encode+split' WHEN doc_id % 3 = 1 THEN 'encode' ELSE 'none' END AS transform, CASE WHEN coalesce(toxic, 0) = 1 THEN 'probe' ELSE 'benign' END AS intent, doc_id % 997 AS seed, sha256(text) AS payload, n_chars FROM documents LEFT JOIN labels USING (doc_id)",
    "v_child": "SELECT conv_id AS parent, turn, role, text FROM conversations",
    "v_score": "SELECT doc_id, quality AS label, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE AS score FROM labels WHERE quality IS NOT NULL",
    "v_log": "SELECT event_id, user_id AS src, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS stream, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS service, CAST(json_extract_string(props, '$.k') AS BIGINT) % 11 AS host, epoch_us(ts) AS ts_us FROM events",
    "v_client": "SELECT c_custkey AS id, c_name AS name, (DATE '1950-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER))::DATE AS birthdate FROM customer",
    "v_card": "SELECT o_orderkey AS id_cards, o_custkey AS id_per, o_orderstatus = 'O' AS active, o_orderpriority AS payment_system FROM orders",
    "v_txn": "SELECT l_orderkey AS id_cards, l_linenumber AS line, l_shipdate AS operation_date, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS operation, l_extendedprice AS amount FROM lineitem",
    "v_loans": "SELECT o_custkey AS id, o_totalprice AS creditlimit, o_orderdate AS dt, nullif(o_orderkey % 4, 0) AS program FROM orders",
    "v_offers": "SELECT l_partkey AS sku, l_extendedprice / l_quantity AS comp_price, CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_linenumber END AS rank, p_retailprice AS base_price, CASE p_size % 6 WHEN 0 THEN 'avg' WHEN 1 THEN 'med' WHEN 2 THEN 'min' WHEN 3 THEN 'max' WHEN 4 THEN 'rnk' ELSE 'unknown' END AS agg, l_orderkey * 10 + l_linenumber AS row_no FROM lineitem JOIN part ON l_partkey = p_partkey",
    "v_pay": "SELECT strftime(o_orderdate, '%Y-%m') AS time, o_orderpriority AS mode, 100.0::DOUBLE * avg((o_orderstatus = 'F')::INT::DOUBLE) AS percents FROM orders GROUP BY 1, 2",
    "v_interval": "SELECT 'x-' || event_id AS session_id, user_id AS src, epoch_us(ts) AS start_us, epoch_us(ts) + 21600000000 AS end_us, event_id AS ordinal FROM events WHERE event_type = 'signup'",
    "v_probe": "SELECT user_id AS src, epoch_us(ts) AS ts_us, value AS size, CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN 1 ELSE -1 END AS direction, event_type AS flow, CAST(json_extract_string(props, '$.k') AS BIGINT) AS seq, event_id AS rec FROM events",
}


def sql(body: str, *views: str, **ctes: str) -> str:
    """``body`` with the named views, and further common table expressions, before it."""
    parts = [f"{v} AS ({SQL_VIEWS[v]})" for v in views] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
