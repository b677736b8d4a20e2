"""Queries of transactions, fields, sequences, files, gates and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import decimal_comma, log_scale
from tessera.operators import audits as au
from tessera.operators import sessions as se
from tessera.operators.ranges import percentiles
from tessera.plans.manifests import _ASSIGNED, assigned
from tessera.plans.tabular import _ASOF, _IV, attributed
from tessera.plans.views import sql, table, v_manifest, v_score
from tessera.sources import readers as rd

_TX = "SELECT session_id, rec, ts_us, flow AS method, seq % 4 AS kind, 200 + seq % 3 AS status, floor(size)::BIGINT AS req, seq AS resp FROM att WHERE session_id IS NOT NULL"
KINDS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def v_tx(s, d):
    return attributed(s, d).where("session_id is not null").selectExpr("session_id", "rec", "ts_us", "flow AS method", "seq % 4 AS kind", "200 + seq % 3 AS status", "floor(size) AS req", "seq AS resp")


def written(df, name: str):
    """What comes back after a table is written and read again."""
    path = rd.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.parquet(path)


def jsonl(s, d):
    path = rd.scratch(s, "events")
    lines = table(s, d, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("value"))
    broken = table(s, d, "events").where("event_id % 10 = 0").select(F.lit('{"event_id": ').alias("value"))
    lines.unionByName(broken).write.text(path)
    return rd.read_jsonl_tolerant(s, path, "event_id bigint, user_id bigint, event_type string, value double")


def nested(s, d):
    return table(s, d, "events").select("event_id", F.struct("user_id", F.struct("event_type", "value").alias("what")).alias("body"))


def shards(s, d):
    root = rd.scratch(s, "shards")
    parts = table(s, d, "part")
    for n in range(3):  # each shard holds half of the one before again
        parts.where(f"p_partkey % 3 = {n} OR p_partkey % 6 = {(n + 1) % 3}").write.parquet(f"{root}/shard{n}/parts")
    return rd.load_shards(s, root, "parts", ["p_partkey"]).select("p_partkey", "p_name", "p_size")


def comma_csv(s, d):
    path = rd.scratch(s, "csv")
    rows = table(s, d, "part").select(F.col("p_partkey").cast("string"), F.translate(F.col("p_retailprice").cast("string"), ".", ",").alias("price"))
    head = s.createDataFrame([("key", "price")], "p_partkey string, price string")
    rows.unionByName(head).write.csv(path, sep=";")
    return rd.read_positional_csv(s, path, ["key", "price"])


def medians(df, columns):
    """One row: the exact median of each column, 0 where there is none."""
    out = None
    for c in columns:
        one = percentiles(df, c, {c: 0.5}).select(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def _w(by, *order):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(*order)


def evidence(s, d):
    return v_manifest(s, d).groupBy("carrier").agg(F.count("*").alias("sessions"), F.countDistinct("payload").alias("captures"), F.sum("label").alias("positives"))


def needed(s, d):
    return v_manifest(s, d).select("carrier").distinct().unionByName(s.createDataFrame([("src99",)], "carrier string"))


def field_rows(s, d):
    pages = table(s, d, "pages").select("page_id", F.create_map(F.lit("path"), F.regexp_extract("url", r"^\w+://[^/]+(/[^?]*)", 1), F.lit("host"), F.regexp_extract("url", r"^\w+://([^/]+)", 1)).alias("m"), F.char_length("html").alias("n"))
    return pages.select("page_id", F.explode(F.map_concat("m", F.create_map(F.lit(":body"), F.col("n").cast("string")))).alias("name", "value"))


QUERIES = {
    "tx_label_join": lambda s, d: v_tx(s, d).join(v_manifest(s, d).select((F.col("doc_id") * 5).alias("rec"), "label").dropDuplicates(["rec"]), "rec").select("rec", "session_id", "label"),
    "feat_tx_agg": lambda s, d: se.aggregate_all(v_tx(s, d), ["session_id"], ["req", "resp", "status"], KINDS),
    "agg_entropy": lambda s, d: se.entropy(v_tx(s, d), "session_id", "method"),
    "agg_lag_corr": lambda s, d: se.lag_correlation(v_tx(s, d), "session_id", ["rec"], "req", 1),
    "agg_medians": lambda s, d: medians(v_tx(s, d), ["req", "resp", "status"]),
    "field_explode": lambda s, d: field_rows(s, d),
    "feat_numeric_matrix": lambda s, d: se.numeric_matrix(v_manifest(s, d).join(v_score(s, d).select("doc_id", "score"), "doc_id", "left").select("id", "doc_id", "label", "seed", "score", "n_chars"), ["id"], ["doc_id", "label"]),
    "feat_prefix_allowlist": lambda s, d: se.by_prefix(table(s, d, "part"), ("p_r", "p_s"), ["p_partkey"]),
    "feat_visibility_mask": lambda s, d: se.visible_only(v_manifest(s, d), v_manifest(s, d), "id", F.col("transform") == "none").select("id", "label"),
    "seq_encode": lambda s, d: se.sequences(v_tx(s, d), "session_id", "rec", {"req": F.round(log_scale(F.col("req").cast("double"), 1000.0), 6), "sign": F.signum((F.col("req") - F.col("resp")).cast("double"))}, 96).select("session_id", F.posexplode("seq").alias("step", "x"), "mask").select("session_id", "step", F.col("x")[0].alias("req"), F.col("x")[1].alias("sign"), F.element_at("mask", F.col("step") + 1).alias("mask")),
    "src_jsonl_tolerant": jsonl,
    "src_flatten_json": lambda s, d: rd.flatten(nested(s, d), "_"),
    "src_multi_shard_union": shards,
    "src_csv_positional": lambda s, d: comma_csv(s, d).select("key", "price"),
    "cast_decimal_comma": lambda s, d: comma_csv(s, d).select(F.col("key").cast("long").alias("key"), *decimal_comma(["price"])),
    "sink_parquet_roundtrip": lambda s, d: written(table(s, d, "supplier"), "supplier")[1],
    "backfill_missing_shards": lambda s, d: rd.missing_shards(v_manifest(s, d), v_manifest(s, d).where("carrier NOT IN ('src1', 'src4')"), "carrier"),
    "evidence_sufficiency": lambda s, d: needed(s, d).join(evidence(s, d), "carrier", "left").select("carrier", F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions"), F.coalesce("captures", F.lit(0)).cast("long").alias("captures"), ((F.coalesce("sessions", F.lit(0)) >= 45) & (F.coalesce("captures", F.lit(0)) >= 40)).alias("filled")),
    "evidence_interval_coverage": lambda s, d: v_manifest(s, d).groupBy("stage").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ",").alias("labels"), F.min("n_chars").alias("least"), (F.countDistinct("label") == 2).alias("ready")),
    "evidence_missing_modes": lambda s, d: needed(s, d).join(evidence(s, d), "carrier", "left_anti"),
}

_EVIDENCE = "SELECT carrier, count(*) AS sessions, count(DISTINCT payload) AS captures, sum(label)::BIGINT AS positives FROM v_manifest GROUP BY carrier"
_NEEDED = "SELECT DISTINCT carrier FROM v_manifest UNION ALL SELECT 'src99'"
_FIELD_ROWS = "SELECT page_id, 'path' AS name, regexp_extract(url, '^\\w+://[^/]+(/[^?]*)', 1) AS value FROM pages UNION ALL SELECT page_id, 'host', regexp_extract(url, '^\\w+://([^/]+)', 1) FROM pages UNION ALL SELECT page_id, ':body', length(html)::VARCHAR FROM pages"
_LOG = "round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ln(1 + greatest(req::DOUBLE, 0.0::DOUBLE)) / ln(1001.0::DOUBLE))), 6)"
_T = {**_ASOF, "tx": _TX}
_CSV = "SELECT p_partkey::VARCHAR AS key, replace(p_retailprice::VARCHAR, '.', ',') AS price FROM part"
_TEMPORAL = "SELECT session_id, count(*) AS n, round((max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE, 4) AS duration, round(coalesce(avg(gap), 0), 4) AS gap_mean, round(coalesce(stddev_pop(gap), 0), 4) AS gap_std, round(coalesce(CASE WHEN avg(gap) <> 0 THEN stddev_pop(gap) / avg(gap) END, 0), 4) AS gap_cv, round(coalesce(quantile_cont(gap, 0.95), 0), 4) AS gap_p95, round(coalesce(avg((gap <= mg / 2)::INT::DOUBLE) FILTER (WHERE gap IS NOT NULL), 0), 6) AS burst_share, round(coalesce(avg((gap >= mg * 2)::INT::DOUBLE) FILTER (WHERE gap IS NOT NULL), 0), 6) AS silence_share, round(coalesce(avg(cm::INT::DOUBLE), 0), 6) AS method_change, round(coalesce(avg(ck::INT::DOUBLE), 0), 6) AS kind_change, round(coalesce(avg(cs::INT::DOUBLE), 0), 6) AS status_change FROM g JOIN m USING (session_id) GROUP BY session_id"
ORACLES = {
    "tx_label_join": sql("SELECT rec, session_id, label FROM tx JOIN (SELECT doc_id * 5 AS rec, label FROM v_manifest) USING (rec)", *_IV, "v_manifest", **_T),
    "feat_tx_agg": sql("SELECT session_id, " + ", ".join(f"round({f}({c}), 6) AS {c}_{k}" if k in ("mean", "std") else f"{f}({c}) AS {c}_{k}" for c in ("req", "resp", "status") for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM tx GROUP BY session_id", *_IV, **_T),
    "agg_entropy": sql("SELECT session_id, round(sum(-p * log2(p)), 6) AS entropy FROM (SELECT session_id, count(*) / (sum(count(*)) OVER (PARTITION BY session_id))::DOUBLE AS p FROM tx GROUP BY session_id, method) GROUP BY session_id", *_IV, **_T),
    "agg_lag_corr": sql("SELECT session_id, round(CASE WHEN count(b) >= 3 THEN coalesce(CASE WHEN stddev_pop(x) * stddev_pop(b) <> 0 THEN covar_pop(x, b) / (stddev_pop(x) * stddev_pop(b)) END, 0) ELSE 0 END, 4) AS lag1 FROM (SELECT session_id, b, CASE WHEN b IS NOT NULL THEN req END AS x FROM (SELECT session_id, req, lag(req) OVER (PARTITION BY session_id ORDER BY rec) AS b FROM tx)) GROUP BY session_id", *_IV, **_T),
    "agg_medians": sql("SELECT " + ", ".join(f"round(coalesce(quantile_cont({c}::DOUBLE, 0.5), 0), 6) AS {c}" for c in ("req", "resp", "status")) + " FROM tx", *_IV, **_T),
    "field_explode": sql("SELECT * FROM f", f=_FIELD_ROWS),
    "feat_numeric_matrix": sql("SELECT id, coalesce(n_chars, 0)::DOUBLE AS n_chars, (n_chars IS NULL)::INTEGER AS n_chars__missing, coalesce(score, 0)::DOUBLE AS score, (score IS NULL)::INTEGER AS score__missing, coalesce(seed, 0)::DOUBLE AS seed, (seed IS NULL)::INTEGER AS seed__missing FROM v_manifest LEFT JOIN v_score USING (doc_id)", "v_manifest", "v_score"),
    "feat_prefix_allowlist": "SELECT p_partkey, p_size, p_retailprice FROM part",
    "feat_visibility_mask": sql("SELECT id, label FROM v_manifest WHERE transform = 'none'", "v_manifest"),
    "seq_encode": sql(f"SELECT session_id, step::INTEGER AS step, coalesce(r, 0)::DOUBLE AS req, coalesce(sg, 0)::DOUBLE AS sign, (r IS NOT NULL)::INTEGER AS mask FROM (SELECT DISTINCT session_id FROM k) CROSS JOIN range(96) t(step) LEFT JOIN k USING (session_id, step)", *_IV, **_T, p="SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rec) AS place, count(*) OVER (PARTITION BY session_id) AS n FROM tx", k=f"SELECT session_id, {_LOG} AS r, sign((req - resp)::DOUBLE) AS sg, row_number() OVER (PARTITION BY session_id ORDER BY place) - 1 AS step FROM p WHERE n <= 96 OR place <= 48 OR place > n - 48"),
    "src_jsonl_tolerant": "SELECT event_id, user_id, event_type, value FROM events",
    "src_flatten_json": "SELECT event_id, user_id AS body_user_id, event_type AS body_what_event_type, value AS body_what_value FROM events",
    "src_multi_shard_union": "SELECT p_partkey, p_name, p_size FROM part",
    "src_csv_positional": _CSV,
    "cast_decimal_comma": "SELECT p_partkey AS key, p_retailprice AS price FROM part",
    "sink_parquet_roundtrip": "SELECT * FROM supplier",
    "backfill_missing_shards": sql("SELECT DISTINCT carrier FROM v_manifest WHERE carrier IN ('src1', 'src4')", "v_manifest"),
    "evidence_sufficiency": sql("SELECT carrier, coalesce(sessions, 0) AS sessions, coalesce(captures, 0) AS captures, coalesce(sessions, 0) >= 45 AND coalesce(captures, 0) >= 40 AS filled FROM n LEFT JOIN e USING (carrier)", "v_manifest", e=_EVIDENCE, n=_NEEDED),
    "evidence_interval_coverage": sql("SELECT stage, count(*) AS n, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR) AS labels, min(n_chars) AS least, count(DISTINCT label) = 2 AS ready FROM v_manifest GROUP BY stage", "v_manifest"),
    "evidence_missing_modes": sql("SELECT carrier FROM n WHERE carrier NOT IN (SELECT carrier FROM e)", "v_manifest", e=_EVIDENCE, n=_NEEDED),
}
