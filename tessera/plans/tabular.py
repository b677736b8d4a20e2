"""Queries of relational reports, pricing, rates and interval attribution."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessera.operators import intervals as iv
from tessera.operators import pricing as pr
from tessera.operators import relational as rel
from tessera.plans.views import sql, table, v_card, v_client, v_interval, v_loans, v_offers, v_pay, v_probe, v_txn

AS_OF = datetime.date(2024, 1, 1)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def prices(spark, d):
    return pr.reprice(pr.aggregate_by_rule(v_offers(spark, d)))


def dev_prices(spark, d):
    p = prices(spark, d).where("sku % 10 <> 0")
    return p.select("sku", F.when(F.col("sku") % 7 == 0, F.round(F.col("new_price"), 4) + 1).otherwise(F.round("new_price", 4)).alias("new_price"))


def attributed(spark, d):
    return iv.attribute(v_probe(spark, d), v_interval(spark, d))


def ours(spark, d):
    return prices(spark, d).select("sku", F.round("new_price", 4).alias("new_price"))


def snapshots(spark, d):
    per = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"))
    kinds = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("event_type").alias("types"))
    return per.groupBy("day").agg(F.sum("n").alias("events"), F.expr("max_by(user_id, struct(n, -user_id))").alias("top_user")).join(kinds, "day")


def snapshot_diff(df, order: str, fields: list[str]):
    """Each snapshot against the one before: which fields changed, from what to what; the first is ``initial``."""
    from pyspark.sql import Window

    w = Window.orderBy(order)
    before = {f: F.lag(f).over(w) for f in fields}
    changes = F.concat_ws(";", *(F.when(~before[f].eqNullSafe(F.col(f)), F.concat(F.lit(f + ":"), before[f].cast("string"), F.lit(">"), F.col(f).cast("string"))) for f in fields))
    return df.select(order, *fields, F.when(F.row_number().over(w) == 1, "initial").otherwise(changes).alias("changes"), F.sha2(F.concat_ws("|", *(F.col(f).cast("string") for f in fields)), 256).alias("digest"))


QUERIES = {
    "sql_sum_by_id": lambda s, d: rel.sum_by(v_loans(s, d), "id", "creditlimit", "total").withColumn("total", F.round("total", 2)),
    "sql_sum_by_id_sorted": lambda s, d: rel.sum_by(v_loans(s, d), "id", "creditlimit", "total", ordered=True).withColumn("total", F.round("total", 2)),
    "sql_year_filter": lambda s, d: rel.since_year(v_loans(s, d), "dt", 1998),
    "sql_not_in_null": lambda s, d: rel.not_in(v_loans(s, d), "program", [1, 2]).select("id", "program"),
    "sql_multi_active_cards": lambda s, d: rel.many_active_cards(v_client(s, d), v_card(s, d), 3, ["name"]),
    "sql_age_activity": lambda s, d: rel.active_in_age_band(v_client(s, d), v_card(s, d), v_txn(s, d), 25, 45, AS_OF, 20),
    "sql_monthly_median": lambda s, d: rel.monthly_median(v_txn(s, d)),
    "sql_spend_threshold": lambda s, d: rel.spenders(v_client(s, d), v_card(s, d), v_txn(s, d), "1-URGENT", "1995-01-01", "1998-12-31", 10000.0),
    "pricing_agg": lambda s, d: pr.aggregate_by_rule(v_offers(s, d)).select("sku", F.round("agg_price", 6).alias("agg_price"), "base_price"),
    "pricing_new_price": lambda s, d: prices(s, d).select("sku", F.round("new_price", 6).alias("new_price")),
    "pricing_reconcile": lambda s, d: pr.reconcile(ours(s, d), dev_prices(s, d), "sku", "new_price"),
    "pricing_missing_in_dev": lambda s, d: pr.missing_from(ours(s, d), dev_prices(s, d), "sku"),
    "pay_pivot": lambda s, d: pr.pivot_mean(v_pay(s, d), "time", "mode", "percents", PRIORITIES),
    "pay_stability": lambda s, d: v_pay(s, d).groupBy("mode").agg(F.round(F.stddev_samp("percents"), 6).alias("std")).orderBy("std", "mode"),
    "pay_mean_rank": lambda s, d: v_pay(s, d).groupBy("mode").agg(F.round(F.avg("percents"), 6).alias("mean")).orderBy(F.desc("mean"), "mode"),
    "pay_moving_avg": lambda s, d: pr.moving_mean(v_pay(s, d), "mode", "time", "percents").withColumn("percents", F.round("percents", 6)),
    "pay_box_summary": lambda s, d: pr.box_summary(v_pay(s, d), "mode", "percents"),
    "pay_histogram": lambda s, d: pr.histogram(v_pay(s, d), "mode", "percents"),
    "join_interval_asof": lambda s, d: attributed(s, d).select("rec", "src", "ts_us", "session_id"),
    "join_interval_all": lambda s, d: iv.all_containing(v_probe(s, d), v_interval(s, d)).select("rec", "src", "ts_us", "session_id"),
    "quality_mapping_coverage": lambda s, d: iv.mapping_coverage(attributed(s, d)),
    "quality_zero_traffic": lambda s, d: iv.zero_traffic(iv.packet_features(v_interval(s, d), attributed(s, d).where("direction < 0"))),
    "quality_tail_guard": lambda s, d: iv.tail_guard(v_interval(s, d), v_probe(s, d)),
    "feat_packet_session": lambda s, d: iv.packet_features(v_interval(s, d), attributed(s, d)),
    "win_delta_t": lambda s, d: iv.delta_t(attributed(s, d)).select("session_id", "rec", F.round("delta_t", 6).alias("delta_t")),
    "win_first_seen": lambda s, d: iv.first_of(attributed(s, d).where("session_id is not null"), ["session_id", "flow"], "rec", "flow_boundary", F.col("flow") == "signup").select("session_id", "rec", "flow_boundary"),
    "win_repeat_seen": lambda s, d: iv.seen_before(attributed(s, d).where("session_id is not null"), ["session_id", "flow", "direction", "seq"], "rec", "retransmit", F.col("size") > 0).select("session_id", "rec", "retransmit"),
    "win_head_tail": lambda s, d: iv.head_and_tail(attributed(s, d).where("session_id is not null"), "session_id", "rec", 96).select("session_id", "rec", F.col("place").cast("long").alias("place")),
    "rank_with_consent": lambda s, d: iv.rank_with_consent(table(s, d, "supplier").selectExpr("s_suppkey", "s_acctbal", "s_suppkey % 2 = 0 AS consent"), "s_suppkey", "s_acctbal", "consent", 9),
    "snapshot_diff": lambda s, d: snapshot_diff(snapshots(s, d), "day", ["events", "top_user", "types"]),
}

_PRICES = dict(
    a="SELECT sku, arg_min(agg, row_no) AS kind, avg(comp_price) AS m, quantile_cont(comp_price, 0.5) AS md, min(comp_price) AS mn, max(comp_price) AS mx, arg_min(comp_price, rank * 100000000000 + row_no) FILTER (WHERE rank <> -1) AS rk, arg_min(base_price, row_no) AS base_price FROM v_offers GROUP BY sku",
    b="SELECT sku, CASE kind WHEN 'avg' THEN m WHEN 'med' THEN md WHEN 'min' THEN mn WHEN 'max' THEN mx WHEN 'rnk' THEN rk END AS agg_price, base_price FROM a",
    c="SELECT sku, CASE WHEN abs((agg_price - base_price) / base_price) <= 0.2::DOUBLE THEN agg_price ELSE base_price END AS new_price FROM b",
    o="SELECT sku, round(new_price, 4) AS new_price FROM c",
    dev="SELECT sku, CASE WHEN sku % 7 = 0 THEN new_price + 1 ELSE new_price END AS new_price FROM o WHERE sku % 10 <> 0",
)
_ASOF = dict(
    u="SELECT src, start_us AS t, 0 AS kind, ordinal, {'id': session_id, 's': start_us, 'e': end_us} AS held, NULL AS rec, NULL AS size, NULL AS direction, NULL AS flow, NULL AS seq FROM v_interval UNION ALL SELECT src, ts_us, 1, 0, NULL, rec, size, direction, flow, seq FROM v_probe",
    w="SELECT *, last_value(held IGNORE NULLS) OVER (PARTITION BY src ORDER BY t, kind, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first_value(held IGNORE NULLS) OVER (PARTITION BY src ORDER BY t, kind, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM u",
    att="SELECT rec, src, t AS ts_us, size, direction, flow, seq, CASE WHEN t BETWEEN p.s - 100000 AND p.e + 100000 THEN p.id WHEN t BETWEEN n.s - 100000 AND n.e + 100000 THEN n.id END AS session_id FROM w WHERE kind = 1",
)
_IV = ("v_interval", "v_probe")
_FEATURES = (
    "SELECT session_id, coalesce(packet_count, 0)::BIGINT AS packet_count, round(coalesce(byte_count, 0), 4) AS byte_count, round(coalesce(duration, 0), 4) AS duration, round(coalesce(size_mean, 0), 4) AS size_mean, round(coalesce(size_std, 0), 4) AS size_std, round(coalesce(size_p95, 0), 4) AS size_p95, round(coalesce(gap_mean, 0), 4) AS gap_mean, round(coalesce(gap_std, 0), 4) AS gap_std, round(coalesce(up_bytes, 0), 4) AS up_bytes, round(coalesce(down_bytes, 0), 4) AS down_bytes, coalesce(up_packets, 0)::BIGINT AS up_packets, coalesce(down_packets, 0)::BIGINT AS down_packets, coalesce(tcp_packets, 0)::BIGINT AS tcp_packets, coalesce(udp_packets, 0)::BIGINT AS udp_packets, coalesce(syn_packets, 0)::BIGINT AS syn_packets, coalesce(rst_packets, 0)::BIGINT AS rst_packets, round(coalesce(CASE WHEN gap_mean <> 0 THEN gap_std / gap_mean END, 0), 4) AS gap_cv, round(coalesce(up_bytes / greatest(down_bytes, 1.0::DOUBLE), 0), 4) AS up_down_ratio FROM (SELECT session_id FROM v_interval) LEFT JOIN per USING (session_id)"
)
_PER = dict(
    g="SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, rec)) / 1000000.0::DOUBLE AS gap FROM att WHERE session_id IS NOT NULL",
    per="SELECT session_id, count(*) AS packet_count, sum(size) AS byte_count, (max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE AS duration, avg(size) AS size_mean, stddev_pop(size) AS size_std, quantile_disc(size, 0.95) AS size_p95, coalesce(avg(gap), 0) AS gap_mean, coalesce(stddev_pop(gap), 0) AS gap_std, sum(CASE WHEN direction > 0 THEN size ELSE 0 END) AS up_bytes, sum(CASE WHEN direction < 0 THEN size ELSE 0 END) AS down_bytes, count_if(direction > 0) AS up_packets, count_if(direction < 0) AS down_packets, count_if(flow = 'click') AS tcp_packets, count_if(flow = 'view') AS udp_packets, count_if(flow = 'signup') AS syn_packets, count_if(flow = 'error') AS rst_packets FROM g GROUP BY session_id",
)
ORACLES = {
    "sql_sum_by_id": sql("SELECT id, round(sum(creditlimit), 2) AS total FROM v_loans GROUP BY id", "v_loans"),
    "sql_sum_by_id_sorted": sql("SELECT id, round(sum(creditlimit), 2) AS total FROM v_loans GROUP BY id ORDER BY id", "v_loans"),
    "sql_year_filter": sql("SELECT * FROM v_loans WHERE year(dt) >= 1998", "v_loans"),
    "sql_not_in_null": sql("SELECT id, program FROM v_loans WHERE program IS NOT NULL AND program NOT IN (1, 2)", "v_loans"),
    "sql_multi_active_cards": sql("SELECT name, count(id_cards) AS n_cards FROM v_client JOIN v_card ON id = id_per WHERE active GROUP BY name HAVING count(id_cards) > 3", "v_client", "v_card"),
    "sql_age_activity": sql("SELECT id, name, count(amount) AS n_operations FROM v_client JOIN v_card ON id = id_per JOIN v_txn USING (id_cards) WHERE datesub('year', birthdate, DATE '2024-01-01') BETWEEN 25 AND 45 GROUP BY id, name HAVING count(amount) > 20", "v_client", "v_card", "v_txn"),
    "sql_monthly_median": sql("SELECT date_trunc('month', operation_date)::DATE AS month, round(sum(CASE WHEN operation = 1 THEN amount ELSE 0 END), 2) AS income, round(quantile_cont(CASE WHEN operation = -1 THEN amount END, 0.5), 4) AS median_withdrawal FROM v_txn GROUP BY 1", "v_txn"),
    "sql_spend_threshold": sql("SELECT id, name, round(sum(amount), 2) AS spent FROM v_client JOIN v_card ON id = id_per JOIN v_txn USING (id_cards) WHERE payment_system = '1-URGENT' AND operation = -1 AND operation_date BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31' GROUP BY id, name HAVING round(sum(amount), 2) > 10000", "v_client", "v_card", "v_txn"),
    "pricing_agg": sql("SELECT sku, round(agg_price, 6) AS agg_price, base_price FROM b", "v_offers", **_PRICES),
    "pricing_new_price": sql("SELECT sku, round(new_price, 6) AS new_price FROM c", "v_offers", **_PRICES),
    "pricing_reconcile": sql("SELECT sku, o.new_price AS ours, dev.new_price AS theirs FROM o JOIN dev USING (sku) WHERE o.new_price IS DISTINCT FROM dev.new_price", "v_offers", **_PRICES),
    "pricing_missing_in_dev": sql("SELECT sku FROM o WHERE sku NOT IN (SELECT sku FROM dev)", "v_offers", **_PRICES),
    "pay_pivot": sql("SELECT time, " + ", ".join(f"round(avg(percents) FILTER (WHERE mode = '{p}'), 6) AS \"{p}\"" for p in PRIORITIES) + " FROM v_pay GROUP BY time", "v_pay"),
    "pay_stability": sql("SELECT mode, round(stddev_samp(percents), 6) AS std FROM v_pay GROUP BY mode", "v_pay"),
    "pay_mean_rank": sql("SELECT mode, round(avg(percents), 6) AS mean FROM v_pay GROUP BY mode", "v_pay"),
    "pay_moving_avg": sql("SELECT time, mode, round(percents, 6) AS percents, CASE WHEN count(percents) OVER w = 3 THEN round(avg(percents) OVER w, 6) END AS moving_avg FROM v_pay WINDOW w AS (PARTITION BY mode ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "v_pay"),
    "pay_box_summary": sql("SELECT mode, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(percents) FILTER (WHERE inside), 6) AS low, round(max(percents) FILTER (WHERE inside), 6) AS high, count_if(NOT inside)::BIGINT AS outliers FROM x GROUP BY mode, q1, q2, q3", "v_pay", q="SELECT mode, quantile_cont(percents, 0.25) AS q1, quantile_cont(percents, 0.5) AS q2, quantile_cont(percents, 0.75) AS q3 FROM v_pay GROUP BY mode", x="SELECT *, percents BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM v_pay JOIN q USING (mode)"),
    "pay_histogram": sql("SELECT mode, CASE WHEN hi > lo THEN least(floor((percents - lo) / ((hi - lo) / 10)) + 1, 10)::INTEGER ELSE 1 END AS bin, count(*) AS n FROM v_pay JOIN (SELECT mode, min(percents) AS lo, max(percents) AS hi FROM v_pay GROUP BY mode) USING (mode) GROUP BY 1, 2", "v_pay"),
    "join_interval_asof": sql("SELECT rec, src, ts_us, session_id FROM att", *_IV, **_ASOF),
    "join_interval_all": sql("SELECT rec, p.src, ts_us, session_id FROM v_probe p JOIN v_interval i ON p.src = i.src AND ts_us BETWEEN start_us - 100000 AND end_us + 100000", *_IV),
    "quality_mapping_coverage": sql("SELECT count(session_id) AS mapped, count(*) AS total, round(coalesce(avg((session_id IS NOT NULL)::INT::DOUBLE), 0), 6) AS coverage FROM att", *_IV, **_ASOF),
    "quality_zero_traffic": sql("SELECT session_id, count(*) OVER () AS n_zero FROM v_interval WHERE session_id NOT IN (SELECT session_id FROM att WHERE session_id IS NOT NULL AND direction < 0) ORDER BY session_id LIMIT 500", *_IV, **_ASOF),
    "quality_tail_guard": sql("SELECT last_packet_us, latest_start_us, last_packet_us + 50000 >= latest_start_us AS passed FROM (SELECT max(ts_us) AS last_packet_us FROM v_probe), (SELECT max(start_us) AS latest_start_us FROM v_interval)", *_IV),
    "feat_packet_session": sql(_FEATURES, *_IV, **_ASOF, **_PER),
    "win_delta_t": sql("SELECT session_id, rec, round(greatest(0.0::DOUBLE, coalesce((ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY rec)) / 1000000.0::DOUBLE, 0)), 6) AS delta_t FROM att WHERE session_id IS NOT NULL", *_IV, **_ASOF),
    "win_first_seen": sql("SELECT session_id, rec, (row_number() OVER (PARTITION BY session_id, flow ORDER BY rec) = 1 OR flow = 'signup')::INTEGER AS flow_boundary FROM att WHERE session_id IS NOT NULL", *_IV, **_ASOF),
    "win_repeat_seen": sql("SELECT session_id, rec, (row_number() OVER (PARTITION BY session_id, flow, direction, seq ORDER BY rec) > 1 AND size > 0)::INTEGER AS retransmit FROM att WHERE session_id IS NOT NULL", *_IV, **_ASOF),
    "win_head_tail": sql("SELECT session_id, rec, place FROM (SELECT session_id, rec, row_number() OVER (PARTITION BY session_id ORDER BY rec) AS place, count(*) OVER (PARTITION BY session_id) AS n FROM att WHERE session_id IS NOT NULL) WHERE n <= 96 OR place <= 48 OR place > n - 48", *_IV, **_ASOF),
    "rank_with_consent": "SELECT s_suppkey, consent, position, consents_above, consents_above + 1 AS consent_rank, CASE WHEN consents_above < 9 THEN 'inside' WHEN consents_above < 18 THEN 'near' ELSE 'outside' END AS state FROM (SELECT s_suppkey, s_suppkey % 2 = 0 AS consent, row_number() OVER o AS position, coalesce(sum((s_suppkey % 2 = 0)::INT) OVER (ORDER BY s_acctbal DESC, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS consents_above FROM supplier WINDOW o AS (ORDER BY s_acctbal DESC, s_suppkey))",
    "snapshot_diff": "WITH per AS (SELECT ts::DATE AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT day, sum(n)::BIGINT AS events, arg_max(user_id, n * 1000000000 - user_id) AS top_user FROM per GROUP BY day), t AS (SELECT s.*, types FROM s JOIN (SELECT ts::DATE AS day, count(DISTINCT event_type) AS types FROM events GROUP BY 1) USING (day)), l AS (SELECT *, row_number() OVER w AS r, lag(events) OVER w AS e0, lag(top_user) OVER w AS u0, lag(types) OVER w AS t0 FROM t WINDOW w AS (ORDER BY day)) SELECT day, events, top_user, types, CASE WHEN r = 1 THEN 'initial' ELSE concat_ws(';', CASE WHEN e0 IS DISTINCT FROM events THEN 'events:' || e0 || '>' || events END, CASE WHEN u0 IS DISTINCT FROM top_user THEN 'top_user:' || u0 || '>' || top_user END, CASE WHEN t0 IS DISTINCT FROM types THEN 'types:' || t0 || '>' || types END) END AS changes, sha256(concat_ws('|', events::VARCHAR, top_user::VARCHAR, types::VARCHAR)) AS digest FROM l",
}
