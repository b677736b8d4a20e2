"""Queries of splits, audits, contracts, string functions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import hashing as hs
from tessera.functions import text as tx
from tessera.operators import audits as au
from tessera.operators import evaluation as ev
from tessera.plans.views import MICROS, sql, table, v_child, v_log, v_manifest, v_score

ROLES = ["calibration", "tuning", "fusion", "report"]
BINS = [(1, "1"), (3, "2-3"), (10, "4-10"), (30, "10-30"), (60, "30-60")]


def assigned(s, d):
    m = v_manifest(s, d)
    rules = [(F.col("role") == "external", "challenge"), (F.col("stage").isin("background", "challenge"), "challenge"), (F.col("client") == "client7", "challenge"), (F.col("carrier") == "src3", "test"), (F.contains("transform", F.lit("split")), "test")]
    return m.withColumn("split", hs.first_match(rules, hs.hash_split(F.col("id"))))


def bins(n):
    out = None
    for most, name in BINS:
        out = F.when(n <= most, name) if out is None else out.when(n <= most, name)
    return out.otherwise("60+")


def turns(s, d):
    return v_child(s, d).groupBy("parent").agg(F.count("*").alias("n"), (F.max("turn") + 1).alias("expected"))


def fields(s, d):
    return table(s, d, "documents").select("doc_id", F.col("source").alias("field_name"), F.col("text").alias("value"))


#: Classes of ASCII signs.
SIGNS = {"digits": "0-9", "upper": "A-Z", "lower": "a-z", "spaces": r"\x20", "printable": r"\x20-\x7E", "delimiters": ":;,.|/_=+&?%-"}


def char_ratios(df):
    shares = df.select("doc_id", tx.ascii_shares(F.col("value"), SIGNS).alias("x"))
    return shares.select("doc_id", *(F.round(f"x.{n}", 6).alias(n) for n in SIGNS))


def field_shape(df):
    return df.select("doc_id", F.char_length("value").alias("n_chars"), F.octet_length("value").alias("n_bytes"), F.round(tx.unique_share(F.col("value")), 6).alias("unique_share"), F.substring(F.sha2(F.expr("left(value, 8)"), 256), 1, 12).alias("prefix_hash"))


QUERIES = {
    "split_hash": lambda s, d: v_manifest(s, d).select("id", hs.hash_split(F.col("id")).alias("split")),
    "split_validation_role": lambda s, d: v_manifest(s, d).select("id", hs.four_way_role(F.col("id"), ROLES).alias("role4")),
    "split_assign": lambda s, d: assigned(s, d).select("id", "split"),
    "split_counts": lambda s, d: assigned(s, d).groupBy("split").agg(F.count("*").alias("n")),
    "split_membership": lambda s, d: assigned(s, d).groupBy("split").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n")),
    "split_calibration_alternate": lambda s, d: hs.alternate(v_manifest(s, d), "label", "id").select("id", "label", "part"),
    "shard_rows": lambda s, d: hs.shard(v_manifest(s, d), "doc_id", 4, 1).select("id"),
    "audit_cross_split": lambda s, d: au.crossing(assigned(s, d), ["seed", "payload"]),
    "audit_duplicates": lambda s, d: au.duplicates(v_manifest(s, d), "payload"),
    "audit_holdout": lambda s, d: au.shared_values(assigned(s, d).where("split = 'train'"), assigned(s, d).where("split = 'test'"), "client"),
    "contract_referential": lambda s, d: au.orphans(v_child(s, d), v_manifest(s, d).where("doc_id % 3 <> 0"), "parent", "doc_id").select("parent", "turn"),
    "readiness_bins": lambda s, d: turns(s, d).groupBy(bins(F.col("n")).alias("bin")).agg(F.count("*").alias("n")),
    "semi_by_ids": lambda s, d: v_manifest(s, d).join(table(s, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("id", "label"),
    "dim_lookup": lambda s, d: v_manifest(s, d).join(F.broadcast(table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("scenario"), "n_name", "r_name")), "scenario", "left").select("id", "n_name", "r_name"),
    "union_manifests": lambda s, d: v_manifest(s, d).select("id", "label").unionByName(v_child(s, d).select(F.concat(F.lit("c-"), "parent").alias("id"), "role"), allowMissingColumns=True),
    "dedup_keep_last": lambda s, d: au.keep_last(v_manifest(s, d), ["payload"], "doc_id").select("payload", "doc_id"),
    "feat_bucket": lambda s, d: v_manifest(s, d).select("id", tx.bucket(F.col("transform"), ["split", "encode"]).alias("bucket")),
    "feat_onehot": lambda s, d: v_manifest(s, d).select("id", *((F.col("lang") == x).cast("int").alias(f"lang_{x}") for x in ("en", "de", "fr", "es"))),
    "fn_entropy": lambda s, d: fields(s, d).select("doc_id", F.round(tx.byte_entropy(F.col("value")), 6).alias("entropy")),
    "fn_char_ratios": lambda s, d: char_ratios(fields(s, d)),
    "fn_grammar": lambda s, d: fields(s, d).select("doc_id", *(c.alias(n) for n, c in tx.grammar_flags(F.col("value")).items())),
    "fn_field_shape": lambda s, d: field_shape(fields(s, d)),
    "fn_log_scale": lambda s, d: table(s, d, "events").select("event_id", F.round(tx.log_scale(F.col("value"), 100.0), 6).alias("scaled")),
    "fn_epoch": lambda s, d: table(s, d, "events").select("event_id", F.expr(MICROS.format("ts")).alias("micros"), tx.iso_micros(F.expr(f"concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '' ELSE ' x' END)")).alias("iso_micros")),
    "fn_body_decode": lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 3, F.lit("?? no base64 ??")).otherwise(F.base64(F.encode("text", "UTF-8"))).alias("b")).select("doc_id", F.sha2(tx.decode_body(F.col("b")), 256).alias("body_sha256"), F.char_length(tx.decode_body(F.col("b"))).alias("body_length")),
    "eval_confusion": lambda s, d: ev.confusion(v_score(s, d), 0.5),
    "eval_auc": lambda s, d: ev.areas(v_score(s, d)),
    "eval_threshold_recall": lambda s, d: ev.threshold_for_recall(v_score(s, d), 0.9),
    "eval_score_summary": lambda s, d: ev.score_summary(v_score(s, d), 0.25),
    "eval_pair_delta": lambda s, d: ev.pair_delta(v_score(s, d).withColumn("pair", F.col("doc_id") % 50), "pair", F.col("label") == 1, "doc_id"),
    "eval_pool_scores": lambda s, d: ev.pooled(v_score(s, d).withColumn("session", F.col("doc_id") % 40), "session"),
    "topk_lowest_scores": lambda s, d: v_score(s, d).orderBy("score", "doc_id").limit(50).select("doc_id", "score", (F.col("score") < 0.25).alias("below")),
}

_ASSIGNED = "SELECT *, CASE WHEN role = 'external' THEN 'challenge' WHEN stage IN ('background', 'challenge') THEN 'challenge' WHEN client = 'client7' THEN 'challenge' WHEN carrier = 'src3' THEN 'test' WHEN contains(transform, 'split') THEN 'test' WHEN ('0x' || substr(sha256(id), 1, 8))::BIGINT % 100 < 85 THEN 'train' ELSE 'validation' END AS split FROM v_manifest"
_TURNS = "SELECT parent, count(*) AS n, max(turn) + 1 AS expected FROM v_child GROUP BY parent"
_FIELDS = "SELECT doc_id, source AS field_name, text AS value FROM documents"
_STEPS = "SELECT s, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM (SELECT score AS s, count_if(label = 1) AS p, count_if(label <> 1) AS n FROM v_score GROUP BY 1) WINDOW w AS (ORDER BY s DESC)"


def _rates(source: str, threshold: float, by: str = "") -> str:
    counts = f"count_if(score >= {threshold} AND label = 1)::BIGINT AS tp, count_if(score >= {threshold} AND label <> 1)::BIGINT AS fp, count_if(score < {threshold} AND label = 1)::BIGINT AS fn, count_if(score < {threshold} AND label <> 1)::BIGINT AS tn"
    part, tail = (f"{by} AS part, ", " GROUP BY 1") if by else ("", "")
    ratio = lambda a, b, n: f"round(coalesce({a}::DOUBLE / nullif({b}, 0), 0), 6) AS {n}"
    rates = ", ".join((ratio("tp", "(tp + fp)", "precision"), ratio("tp", "(tp + fn)", "recall"), ratio("(2 * tp)", "(2 * tp + fp + fn)", "f1"), ratio("fp", "(fp + tn)", "fpr"), ratio("(1000000 * fp)", "(fp + tn)", "fp_per_million"), ratio("(10000 * (tp + fp))", "(tp + fp + fn + tn)", "alerts_per_10k")))
    return f"SELECT *, {rates} FROM (SELECT {part}{counts} FROM {source}{tail})"


ORACLES = {
    "split_hash": sql("SELECT id, CASE WHEN ('0x' || substr(sha256(id), 1, 8))::BIGINT % 100 < 85 THEN 'train' ELSE 'validation' END AS split FROM v_manifest", "v_manifest"),
    "split_validation_role": sql("SELECT id, ['calibration', 'tuning', 'fusion', 'report'][('0x' || substr(sha256('v3-validation:' || id), 1, 8))::BIGINT % 4 + 1] AS role4 FROM v_manifest", "v_manifest"),
    "split_assign": sql("SELECT id, split FROM x", "v_manifest", x=_ASSIGNED),
    "split_counts": sql("SELECT split, count(*) AS n FROM x GROUP BY split", "v_manifest", x=_ASSIGNED),
    "split_membership": sql("SELECT split, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM x GROUP BY split", "v_manifest", x=_ASSIGNED),
    "split_calibration_alternate": sql("SELECT id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sha256('calibration:' || id), id) % 2 = 1 THEN 'calibration' ELSE 'tuning' END AS part FROM v_manifest", "v_manifest"),
    "shard_rows": sql("SELECT id FROM v_manifest WHERE doc_id % 4 = 1", "v_manifest"),
    "audit_cross_split": sql("SELECT kind, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) AS n_splits FROM (SELECT 'seed' AS kind, seed::VARCHAR AS value, split FROM x UNION ALL SELECT 'payload', payload, split FROM x) GROUP BY 1, 2 HAVING count(DISTINCT split) > 1", "v_manifest", x=_ASSIGNED),
    "audit_duplicates": sql("SELECT payload, count(*) AS n FROM v_manifest GROUP BY payload HAVING count(*) > 1", "v_manifest"),
    "audit_holdout": sql("SELECT DISTINCT client FROM x WHERE split = 'train' AND client IN (SELECT client FROM x WHERE split = 'test')", "v_manifest", x=_ASSIGNED),
    "contract_referential": sql("SELECT parent, turn FROM v_child WHERE parent NOT IN (SELECT doc_id FROM v_manifest WHERE doc_id % 3 <> 0)", "v_manifest", "v_child"),
    "readiness_bins": sql("SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' WHEN n <= 30 THEN '10-30' WHEN n <= 60 THEN '30-60' ELSE '60+' END AS bin, count(*) AS n FROM t GROUP BY 1", "v_child", t=_TURNS),
    "semi_by_ids": sql("SELECT id, label FROM v_manifest WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "v_manifest"),
    "dim_lookup": sql("SELECT id, n_name, r_name FROM v_manifest LEFT JOIN nation ON scenario = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", "v_manifest"),
    "union_manifests": sql("SELECT id, label, NULL::VARCHAR AS role FROM v_manifest UNION ALL SELECT 'c-' || parent, NULL, role FROM v_child", "v_manifest", "v_child"),
    "dedup_keep_last": sql("SELECT payload, max(doc_id) AS doc_id FROM v_manifest GROUP BY payload", "v_manifest"),
    "feat_bucket": sql("SELECT id, CASE WHEN contains(transform, 'split') THEN 'split' WHEN contains(transform, 'encode') THEN 'encode' ELSE 'other' END AS bucket FROM v_manifest", "v_manifest"),
    "feat_onehot": sql("SELECT id, " + ", ".join(f"(lang = '{x}')::INTEGER AS lang_{x}" for x in ("en", "de", "fr", "es")) + " FROM v_manifest", "v_manifest"),
    "fn_entropy": sql("SELECT doc_id, round(coalesce(-sum(c / t * log2(c / t)), 0), 6) AS entropy FROM (SELECT doc_id, b, count(*)::DOUBLE AS c, (sum(count(*)) OVER (PARTITION BY doc_id))::DOUBLE AS t FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(value)), '..')) AS b FROM f) GROUP BY 1, 2) GROUP BY doc_id", f=_FIELDS),
    "fn_char_ratios": sql("SELECT doc_id, " + ", ".join(f"round(length(regexp_replace(value, '[^{c}]', '', 'g')) / greatest(1, length(value))::DOUBLE, 6) AS {n}" for n, c in (("digits", "0-9"), ("upper", "A-Z"), ("lower", "a-z"), ("spaces", r"\x20"), ("printable", r"\x20-\x7E"), ("delimiters", ":;,.|/_=+&?%-"))) + " FROM f", f=_FIELDS),
    "fn_grammar": "SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}')::INTEGER AS {n}" for n, p in tx.GRAMMARS.items()) + " FROM documents",
    "fn_field_shape": sql("SELECT doc_id, length(value)::INTEGER AS n_chars, strlen(value)::INTEGER AS n_bytes, round(len(list_distinct(string_split(value, ''))) / greatest(1, length(value))::DOUBLE, 6) AS unique_share, substr(sha256(left(value, 8)), 1, 12) AS prefix_hash FROM f", f=_FIELDS),
    "fn_log_scale": "SELECT event_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ln(1 + greatest(value, 0.0::DOUBLE)) / ln(101.0::DOUBLE))), 6) AS scaled FROM events",
    "fn_epoch": "SELECT event_id, epoch_us(ts) AS micros, CASE event_id % 4 WHEN 1 THEN epoch_us(ts) - 7200000000 WHEN 3 THEN NULL ELSE epoch_us(ts) END AS iso_micros FROM events",
    "fn_body_decode": "SELECT doc_id, CASE WHEN doc_id % 5 <> 3 AND text IS NOT NULL THEN sha256(array_to_string(list_transform(regexp_extract_all(substr(hex(encode(text)), 1, 32768), '..'), lambda x: chr(('0x' || x)::INTEGER)), '')) END AS body_sha256, CASE WHEN doc_id % 5 <> 3 THEN least(strlen(text), 16384)::INTEGER END AS body_length FROM documents",
    "eval_confusion": sql(_rates("v_score", 0.5), "v_score"),
    "eval_auc": sql("SELECT round(sum(n * (2 * tp - p)) / (2.0::DOUBLE * sum(p) * sum(n)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)::DOUBLE) / sum(p), 6) AS pr_auc FROM st", "v_score", st=_STEPS),
    "eval_threshold_recall": sql("SELECT s AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision FROM st, (SELECT sum(p) AS n1 FROM st) WHERE tp >= 0.9::DOUBLE * n1 ORDER BY tp / (tp + fp)::DOUBLE DESC, s DESC LIMIT 1", "v_score", st=_STEPS),
    "eval_score_summary": sql("SELECT count(*) AS n, min(score) AS min, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.95), 6) AS p95, round(avg((score < 0.25)::INT::DOUBLE), 6) AS share_below FROM v_score", "v_score"),
    "eval_pair_delta": sql("SELECT count(*) AS pairs, round(coalesce(avg(abs(a - b)), 999), 6) AS delta FROM (SELECT doc_id % 50 AS pair, arg_max(score, doc_id) FILTER (WHERE label = 1) AS a, arg_max(score, doc_id) FILTER (WHERE label <> 1) AS b FROM v_score GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL", "v_score"),
    "eval_pool_scores": sql("SELECT doc_id % 40 AS session, round(avg(score), 6) AS mean_score, max(score) AS max_score FROM v_score GROUP BY 1", "v_score"),
    "topk_lowest_scores": sql("SELECT doc_id, score, score < 0.25 AS below FROM v_score ORDER BY score, doc_id LIMIT 50", "v_score"),
}
