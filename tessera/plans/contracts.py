"""Queries of data contracts, quality gates, evidence and acceptance, on records that break each rule somewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import audits as au
from tessera.operators import evaluation as ev
from tessera.plans.manifests import _ASSIGNED, _rates, assigned
from tessera.plans.views import sql, table, v_child, v_score
from tessera.sources import readers as rd

#: The columns of a record, each an expression that Spark and the checking engine read alike.
RECORD = {
    "record_id": "CASE WHEN doc_id % 89 = 7 THEN '' WHEN doc_id % 97 = 5 THEN 'k-again' WHEN doc_id % 9 = 0 THEN concat('g-', doc_id) WHEN doc_id % 9 = 1 THEN concat('d-', doc_id) WHEN doc_id % 9 = 2 THEN concat('k-', doc_id) WHEN doc_id % 9 = 3 THEN concat('l-', doc_id) ELSE concat('a-', doc_id) END",
    "doc_id": "doc_id",
    "stage": "CASE doc_id % 9 WHEN 0 THEN CASE WHEN doc_id % 4 = 1 THEN 'other' ELSE 'background' END WHEN 1 THEN 'mixed' WHEN 2 THEN 'benign_diversity' WHEN 3 THEN 'long_timing' WHEN 4 THEN 'holdout' WHEN 5 THEN 'isolated' ELSE 'sequence' END",
    "role": "CASE WHEN doc_id % 9 = 0 AND doc_id % 5 <> 0 THEN 'hard_negative' WHEN doc_id % 9 = 2 AND doc_id % 4 <> 0 THEN 'benign_background' WHEN doc_id % 9 = 4 AND doc_id % 3 <> 1 THEN 'external_holdout' ELSE 'core' END",
    "label": "coalesce(toxic, CASE WHEN doc_id % 8 = 3 THEN 1 ELSE 0 END)",
    "intent": "CASE WHEN coalesce(toxic, 0) = 1 THEN 'probe' WHEN doc_id % 6 = 0 THEN '' ELSE 'benign' END",
    "mapping": "CASE WHEN doc_id % 10 = 3 THEN 'T1' ELSE '' END",
    "family": "CASE doc_id % 4 WHEN 0 THEN 'background' WHEN 1 THEN 'header' WHEN 2 THEN 'socket' ELSE 'timing' END",
    "eligible": "doc_id % 9 NOT IN (3, 4) AND doc_id % 7 <> 2 OR doc_id % 5 = 1",
    "acceleration": "CASE WHEN doc_id % 12 = 3 THEN 10 ELSE 1 END",
    "interval_s": "CASE doc_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 30 WHEN 2 THEN 120 WHEN 3 THEN 300 WHEN 4 THEN 1200 ELSE 0 END",
    "events": "doc_id % 67",
    "pattern": "concat('p', doc_id % 12)",
    "paired": "doc_id % 50 <> 2",
    "mode": "CASE doc_id % 11 WHEN 0 THEN 'plain' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' WHEN 3 THEN 'suspicious' WHEN 4 THEN 'odd' ELSE '' END",
    "wire_real": "doc_id % 13 <> 1",
    "isolated": "doc_id % 17 <> 1",
    "later_use": "doc_id % 19 = 1",
    "split": "CASE WHEN doc_id % 9 = 4 AND doc_id % 10 <> 4 THEN 'challenge' ELSE 'train' END",
    "framework": "CASE doc_id % 5 WHEN 0 THEN 'first' WHEN 1 THEN 'second' WHEN 2 THEN 'third' WHEN 3 THEN 'fourth' ELSE 'unknown' END",
    "lifecycle": "CASE WHEN doc_id % 15 = 4 THEN 'idle,attack' WHEN doc_id % 15 = 5 THEN '' ELSE 'registration,idle,poll' END",
    "stated_sha": "CASE WHEN doc_id % 31 = 4 THEN 'short' WHEN doc_id % 31 = 5 THEN repeat('0', 64) ELSE {sha} END",
    "capture_sha": "CASE WHEN doc_id % 37 = 4 THEN NULL ELSE {sha} END",
    "client": "concat('client', doc_id % 14)",
    "server": "concat('server', doc_id % 8)",
    "network": "concat('net', doc_id % 9)",
    "sessions": "doc_id % 21 * 10",
}
_SQL_RECORD = "SELECT " + ", ".join(f"{e.format(sha='sha256(text)')} AS {c}" for c, e in RECORD.items()) + " FROM documents LEFT JOIN labels USING (doc_id)"


def v_record(s, d) -> DataFrame:
    joined = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return joined.selectExpr(*(f"{e.format(sha='sha2(text, 256)')} AS {c}" for c, e in RECORD.items()))


def v_event(s, d) -> DataFrame:
    """Events of records: their label disagrees now and then, and some name a record that doesn't exist."""
    return v_child(s, d).selectExpr("parent", "turn", "CASE WHEN parent % 3 = 1 THEN parent + 100000000 ELSE parent END AS owner", "CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END AS label")


_SQL_EVENT = "SELECT parent, turn, CASE WHEN parent % 3 = 1 THEN parent + 100000000 ELSE parent END AS owner, CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END AS label FROM v_child"
c = F.col


def second_revision() -> dict[str, tuple[Column, Column]]:
    trusted = c("record_id").startswith("g-") | (c("stage") == "background") | (c("role") == "hard_negative")
    return {
        "no_id": (c("record_id") == "", c("doc_id")),
        "background_label": (trusted & (c("label") != 0), c("label")),
        "background_intent": (trusted & ~c("intent").isin("", "benign"), c("intent")),
        "background_mapping": (trusted & (c("mapping") != ""), c("mapping")),
        "background_stage": (trusted & (c("stage") != "background"), c("stage")),
        "background_role": (trusted & (c("role") != "hard_negative"), c("role")),
        "mixed_positive_background": ((c("stage") == "mixed") & (c("label") == 1) & (c("family") == "background"), c("family")),
    }


def third_revision() -> dict[str, tuple[Column, Column]]:
    benign, long = (c("stage") == "benign_diversity") | c("record_id").startswith("k-"), (c("stage") == "long_timing") | c("record_id").startswith("l-")
    return {
        "benign_label": (benign & (c("label") != 0), c("label")),
        "benign_role": (benign & (c("role") != "benign_background"), c("role")),
        "benign_eligible": (benign & ~c("eligible"), c("eligible")),
        "timing_accelerated": (long & (c("acceleration") != 1), c("acceleration")),
        "timing_interval": (long & (c("interval_s") <= 0), c("interval_s")),
        "timing_eligible": (long & c("eligible"), c("eligible")),
        "holdout_leaked": ((c("stage") == "holdout") & (c("eligible") | (c("role") != "external_holdout")), c("role")),
        "mode_not_real": ((c("mode") != "") & ~c("wire_real"), c("mode")),
        "mode_is_no_attack": ((c("mode") != "") & (c("mode") != "suspicious") & (c("label") != 0), c("label")),
    }


def contract(s, d) -> DataFrame:
    """Both revisions, repeated ids, and events against their records."""
    records, events = v_record(s, d), v_event(s, d)
    one = au.violations(records, "record_id", second_revision() | third_revision())
    twice = au.duplicates(records.where("record_id <> ''"), "record_id").select(c("record_id").alias("entity_id"), F.lit("duplicate_id").alias("rule"), c("n").cast("string").alias("detail"))
    lost = au.orphans(events, records, "owner", "doc_id").select(c("owner").cast("string").alias("entity_id"), F.lit("unknown_record").alias("rule"), c("turn").cast("string").alias("detail"))
    other = events.withColumnRenamed("label", "own").join(records.select(c("doc_id").alias("owner"), "record_id", "label"), "owner").where("own <> label")
    return one.unionByName(twice).unionByName(lost).unionByName(other.select(c("record_id").alias("entity_id"), F.lit("label_disagrees").alias("rule"), F.concat_ws("/", "turn", "own", "label").alias("detail")))


_TRUSTED = "(record_id LIKE 'g-%' OR stage = 'background' OR role = 'hard_negative')"
_BENIGN, _LONG = "(stage = 'benign_diversity' OR record_id LIKE 'k-%')", "(stage = 'long_timing' OR record_id LIKE 'l-%')"
_SECOND = {
    "no_id": ("record_id = ''", "doc_id"), "background_label": (f"{_TRUSTED} AND label <> 0", "label"), "background_intent": (f"{_TRUSTED} AND intent NOT IN ('', 'benign')", "intent"), "background_mapping": (f"{_TRUSTED} AND mapping <> ''", "mapping"),
    "background_stage": (f"{_TRUSTED} AND stage <> 'background'", "stage"), "background_role": (f"{_TRUSTED} AND role <> 'hard_negative'", "role"), "mixed_positive_background": ("stage = 'mixed' AND label = 1 AND family = 'background'", "family"),
}
_THIRD = {
    "benign_label": (f"{_BENIGN} AND label <> 0", "label"), "benign_role": (f"{_BENIGN} AND role <> 'benign_background'", "role"), "benign_eligible": (f"{_BENIGN} AND NOT eligible", "eligible"), "timing_accelerated": (f"{_LONG} AND acceleration <> 1", "acceleration"),
    "timing_interval": (f"{_LONG} AND interval_s <= 0", "interval_s"), "timing_eligible": (f"{_LONG} AND eligible", "eligible"), "holdout_leaked": ("stage = 'holdout' AND (eligible OR role <> 'external_holdout')", "role"),
    "mode_not_real": ("mode <> '' AND NOT wire_real", "mode"), "mode_is_no_attack": ("mode NOT IN ('', 'suspicious') AND label <> 0", "label"),
}


def _select(rules: dict, entity: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {entity}::VARCHAR AS entity_id, '{n}' AS rule, ({detail})::VARCHAR AS detail FROM {source} WHERE {broken}" for n, (broken, detail) in rules.items())


_CONTRACT = (
    _select(_SECOND | _THIRD, "record_id", "r")
    + " UNION ALL SELECT record_id, 'duplicate_id', count(*)::VARCHAR FROM r WHERE record_id <> '' GROUP BY record_id HAVING count(*) > 1"
    + " UNION ALL SELECT owner::VARCHAR, 'unknown_record', turn::VARCHAR FROM ev WHERE owner NOT IN (SELECT doc_id FROM r)"
    + " UNION ALL SELECT record_id, 'label_disagrees', concat_ws('/', turn, ev.label, r.label) FROM ev JOIN r ON owner = doc_id WHERE ev.label <> r.label"
)

# --- evidence -------------------------------------------------------------------------------

FRAMEWORKS, MODES, STAGES = ["first", "second", "third", "fourth"], ["plain", "accepted", "rejected", "suspicious"], ["registration", "idle", "poll", "task", "result", "sleep", "reconnect"]
INTERVALS = {30: 20, 120: 15, 300: 10, 1200: 5}


def evidence_rules() -> dict[str, dict[str, tuple[Column, Column]]]:
    """Rules of each kind of record, by the rows that they are for."""
    stages = F.filter(F.split("lifecycle", ","), lambda x: x != "")
    file = {"capture_missing": (c("capture_sha").isNull(), c("doc_id")), "capture_differs": (c("capture_sha").isNotNull() & (c("capture_sha") != c("stated_sha")), F.substring("stated_sha", 1, 8))}
    held = {
        "framework_unknown": (~c("framework").isin(FRAMEWORKS), c("framework")), "framework_role": (c("role") != "external_holdout", c("role")), "framework_not_challenge": ((c("split") != "challenge") | c("eligible"), c("split")),
        "framework_unsafe": (~c("isolated") | c("later_use"), c("isolated")), "lifecycle_empty": (F.size(stages) == 0, c("lifecycle")), "lifecycle_unsafe": (F.size(F.array_except(stages, F.array(*map(F.lit, STAGES)))) > 0, c("lifecycle")), "hash_length": (F.length("stated_sha") != 64, c("stated_sha")),
    }
    mode = {"mode_unknown": (~c("mode").isin(MODES), c("mode")), "mode_not_real": (~c("wire_real"), c("mode")), "mode_implies_attack": (c("mode").isin("plain", "accepted", "rejected") & (c("label") != 0), c("label")), "suspicious_is_benign": ((c("mode") == "suspicious") & (c("label") != 1), c("label"))}
    place = {"no_sessions": (c("sessions") <= 0, c("sessions")), "client_unknown": (c("client") == "client13", c("client")), "server_unknown": (c("server") == "server7", c("server")), "network_unknown": (c("network") == "net8", c("network")), "not_real": (~c("wire_real"), c("wire_real")), "not_isolated": (~c("isolated"), c("isolated"))}
    least = F.create_map(*(F.lit(x) for pair in INTERVALS.items() for x in pair))[c("interval_s")]
    timing = {"interval_unexpected": (~c("interval_s").isin(list(INTERVALS)), c("interval_s")), "accelerated": (c("acceleration") != 1, c("acceleration")), "not_real_or_isolated": (~c("wire_real") | ~c("isolated"), c("wire_real")), "too_few_events": (F.coalesce(c("events") < least, F.lit(False)), c("events"))}
    return {"framework": held | file, "mode": mode | file, "environment": place | file, "timing": timing | file}


SOURCES = {"framework": "stage = 'holdout'", "mode": "mode <> ''", "environment": "stage = 'isolated'", "timing": "stage = 'long_timing'"}


def evidence_violations(s, d) -> DataFrame:
    out = None
    for kind, rules in evidence_rules().items():
        rows = au.violations(v_record(s, d).where(SOURCES[kind]), "doc_id", rules).withColumn("source", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.select("source", "entity_id", "rule", "detail")


_FILE = {"capture_missing": ("capture_sha IS NULL", "doc_id"), "capture_differs": ("capture_sha <> stated_sha", "substr(stated_sha, 1, 8)")}
_EVIDENCE_RULES = {
    "framework": {"framework_unknown": ("framework = 'unknown'", "framework"), "framework_role": ("role <> 'external_holdout'", "role"), "framework_not_challenge": ("split <> 'challenge' OR eligible", "split"), "framework_unsafe": ("NOT isolated OR later_use", "isolated"), "lifecycle_empty": ("lifecycle = ''", "lifecycle"), "lifecycle_unsafe": ("lifecycle LIKE '%attack%'", "lifecycle"), "hash_length": ("length(stated_sha) <> 64", "stated_sha")},
    "mode": {"mode_unknown": ("mode = 'odd'", "mode"), "mode_not_real": ("NOT wire_real", "mode"), "mode_implies_attack": ("mode IN ('plain', 'accepted', 'rejected') AND label <> 0", "label"), "suspicious_is_benign": ("mode = 'suspicious' AND label <> 1", "label")},
    "environment": {"no_sessions": ("sessions <= 0", "sessions"), "client_unknown": ("client = 'client13'", "client"), "server_unknown": ("server = 'server7'", "server"), "network_unknown": ("network = 'net8'", "network"), "not_real": ("NOT wire_real", "wire_real"), "not_isolated": ("NOT isolated", "isolated")},
    "timing": {"interval_unexpected": ("interval_s NOT IN (30, 120, 300, 1200)", "interval_s"), "accelerated": ("acceleration <> 1", "acceleration"), "not_real_or_isolated": ("NOT wire_real OR NOT isolated", "wire_real"), "too_few_events": ("interval_s IN (30, 120, 300, 1200) AND events < CASE interval_s WHEN 30 THEN 20 WHEN 120 THEN 15 WHEN 300 THEN 10 ELSE 5 END", "events")},
}
_VIOLATED = " UNION ALL ".join(f"SELECT '{k}' AS source, * FROM ({_select(rules | _FILE, 'doc_id', f'(SELECT * FROM r WHERE {SOURCES[k]})')})" for k, rules in _EVIDENCE_RULES.items())


def evidence_summary(s, d) -> DataFrame:
    """One row: of each of the four sources its records, errors, whether it is valid, and whether all are."""
    counts = None
    for kind, rows in SOURCES.items():
        n = v_record(s, d).where(rows).agg(F.count("*").alias("records")).withColumn("source", F.lit(kind))
        counts = n if counts is None else counts.unionByName(n)
    errors = evidence_violations(s, d).groupBy("source").agg(F.count("*").alias("errors"))
    each = counts.join(errors, "source", "left").withColumn("errors", F.coalesce("errors", F.lit(0)).cast("long"))
    pick = lambda kind, x: F.max(F.when(c("source") == kind, c(x)))
    out = each.agg(*(pick(k, x).alias(f"{k}_{x}") for k in SOURCES for x in ("records", "errors")))
    valid = {k: (c(f"{k}_records") > 0) & (c(f"{k}_errors") == 0) for k in SOURCES}
    every = F.lit(True)
    for v in valid.values():
        every = every & v
    return out.select("*", *(v.alias(f"{k}_valid") for k, v in valid.items()), every.alias("all_valid"))


_SUMMARY = "SELECT *, " + ", ".join(f"{k}_records > 0 AND {k}_errors = 0 AS {k}_valid" for k in SOURCES) + ", " + " AND ".join(f"{k}_records > 0 AND {k}_errors = 0" for k in SOURCES) + " AS all_valid FROM (SELECT " + ", ".join(f"(SELECT count(*) FROM r WHERE {w}) AS {k}_records, (SELECT count(*) FROM v WHERE source = '{k}') AS {k}_errors" for k, w in SOURCES.items()) + ")"

# --- readiness, gates, reuse ----------------------------------------------------------------

BINS = [(1, "1"), (3, "2-3"), (10, "4-10"), (30, "10-30"), (60, "30-60")]


def readiness(s, d) -> DataFrame:
    """One row: counts, bins, matched pairs, patterns and intervals of benign and long-timing records, and what is ready."""
    rows = v_record(s, d).dropDuplicates(["record_id", "stage", "doc_id"])
    benign, long = (c("stage") == "benign_diversity") | c("record_id").startswith("k-"), (c("stage") == "long_timing") | c("record_id").startswith("l-")
    name = None
    for most, label in BINS:
        name = F.when(c("events") <= most, label) if name is None else name.when(c("events") <= most, label)
    rows = rows.withColumn("bin", name.otherwise("60+"))
    out = rows.agg(
        F.count_if(benign).alias("benign"), F.array_sort(F.collect_set(F.when(benign, c("bin")))).alias("bins"), F.count_if(benign & c("paired")).alias("matched"), F.countDistinct(F.when(benign, c("pattern"))).alias("patterns"),
        F.array_sort(F.collect_set(F.when(long & (c("interval_s") > 0), c("interval_s")))).alias("intervals"), F.count_if(long & (c("acceleration") != 1)).alias("accelerated"),
    )
    wanted = F.array(*(F.lit(n) for _, n in BINS), F.lit("60+"))
    ready = (F.size(F.array_except(wanted, c("bins"))) == 0) & (c("matched") >= F.floor(0.95 * F.greatest(c("benign"), F.lit(1)))) & (c("patterns") >= 10)
    covered = F.size(F.array_except(F.array(*map(F.lit, (5, 30, 120, 300))), c("intervals"))) == 0
    return out.select("benign", F.array_join("bins", ",").alias("bins"), "matched", "patterns", F.array_join("intervals", ",").alias("intervals"), "accelerated", (c("benign") >= 60000).alias("enough"), ready.alias("multi_event_ready"), (covered & (c("accelerated") == 0)).alias("timing_ready"))


_BIN = "CASE WHEN events <= 1 THEN '1' WHEN events <= 3 THEN '2-3' WHEN events <= 10 THEN '4-10' WHEN events <= 30 THEN '10-30' WHEN events <= 60 THEN '30-60' ELSE '60+' END"
_READINESS = f"""SELECT benign, bins, matched, patterns, intervals, accelerated, benign >= 60000 AS enough, n_bins = 6 AND matched >= floor(0.95::DOUBLE * greatest(benign, 1)) AND patterns >= 10 AS multi_event_ready, covered = 4 AND accelerated = 0 AS timing_ready FROM (
SELECT count_if(b)::BIGINT AS benign, string_agg(DISTINCT bin, ',' ORDER BY bin) FILTER (WHERE b) AS bins, count(DISTINCT bin) FILTER (WHERE b) AS n_bins, count_if(b AND paired)::BIGINT AS matched, count(DISTINCT pattern) FILTER (WHERE b) AS patterns,
array_to_string(list_sort(list(DISTINCT interval_s) FILTER (WHERE l AND interval_s > 0)), ',') AS intervals, count(DISTINCT interval_s) FILTER (WHERE l AND interval_s IN (5, 30, 120, 300)) AS covered, count_if(l AND acceleration <> 1)::BIGINT AS accelerated FROM (SELECT *, {_BENIGN} AS b, {_LONG} AS l, {_BIN} AS bin FROM r))"""


def quality_gate(s, d) -> DataFrame:
    """Sixteen named checks of one release, and whether all that are true or false hold."""
    m, events = assigned(s, d), v_child(s, d)
    found = m.agg(
        (F.count("*") > 0).alias("capture_exists"), (F.sum("n_chars") > 24).alias("capture_nonempty"), F.count("*").alias("campaign_count"), (F.countDistinct("id") == F.count("*")).alias("unique_ids"),
        F.every(c("payload").isNotNull()).alias("all_success"), F.every(c("role") != "external").alias("external_dependencies_false"), F.round(F.avg((c("n_chars") > 0).cast("double")), 6).alias("mapping_coverage"),
        F.count_if(c("lang") == "en").alias("parser_rows_mapped"), F.every(c("label").isin(0, 1)).alias("labels_known"),
    )
    crossed = au.crossing(m, ["seed", "payload"]).agg((F.count("*") == 0).alias("leakage_audit_passed"))
    turns = events.agg(F.count("*").alias("event_count"), (F.min("turn") == 0).alias("first_exit_zero"), (F.count_if(c("role").isNull()) == 0).alias("second_exit_zero"), (F.sum(F.length("text")) > 0).alias("first_log_nonempty"), (F.countDistinct("parent") > 0).alias("second_log_nonempty"))
    out = found.join(F.broadcast(crossed)).join(F.broadcast(turns)).withColumns({"mapping_coverage_ge_0_95": c("mapping_coverage") >= 0.95, "parser_rows_total": c("campaign_count")})
    flags = [n for n, t in out.dtypes if t == "boolean"]
    return out.withColumn("passed", F.forall(F.array(*flags), lambda x: x))


_GATE_FLAGS = "capture_exists capture_nonempty unique_ids all_success external_dependencies_false labels_known leakage_audit_passed first_exit_zero second_exit_zero first_log_nonempty second_log_nonempty mapping_coverage_ge_0_95".split()
_GATE = f"""SELECT *, {' AND '.join(_GATE_FLAGS)} AS passed FROM (SELECT *, mapping_coverage >= 0.95 AS mapping_coverage_ge_0_95, campaign_count AS parser_rows_total FROM
(SELECT count(*) > 0 AS capture_exists, sum(n_chars) > 24 AS capture_nonempty, count(*) AS campaign_count, count(DISTINCT id) = count(*) AS unique_ids, bool_and(payload IS NOT NULL) AS all_success, bool_and(role <> 'external') AS external_dependencies_false, round(avg((n_chars > 0)::INT::DOUBLE), 6) AS mapping_coverage, count_if(lang = 'en')::BIGINT AS parser_rows_mapped, bool_and(label IN (0, 1)) AS labels_known FROM x),
(SELECT count(*) = 0 AS leakage_audit_passed FROM (SELECT k, v FROM (SELECT 'seed' AS k, seed::VARCHAR AS v, split FROM x UNION ALL SELECT 'payload', payload, split FROM x) GROUP BY 1, 2 HAVING count(DISTINCT split) > 1)),
(SELECT count(*) AS event_count, min(turn) = 0 AS first_exit_zero, count_if(role IS NULL) = 0 AS second_exit_zero, sum(length(text)) > 0 AS first_log_nonempty, count(DISTINCT parent) > 0 AS second_log_nonempty FROM v_child))"""


def reuse(s, d) -> DataFrame:
    """For each shard and source, by preference: the first reason against it, and whether it is the one that is used."""
    from pyspark.sql import Window

    rows = v_record(s, d).groupBy(F.pmod("doc_id", F.lit(23)).alias("shard"), (F.pmod("doc_id", F.lit(3)) + 1).alias("preference")).agg(
        F.count("*").alias("n"), F.max("label").alias("positive"), F.every("wire_real").alias("real"), F.count_if(c("capture_sha").isNull()).alias("missing"))
    reason = F.when(c("n") < 2, "too_few").when(c("missing") > 0, "capture_missing").when(~c("real"), "not_real").when(c("positive") == 0, "no_positive").otherwise("ok")
    rows = rows.withColumn("reason", reason)
    first = F.min(F.when(c("reason") == "ok", c("preference"))).over(Window.partitionBy("shard"))
    return rows.select("shard", "preference", "reason", (F.coalesce(first == c("preference"), F.lit(False))).alias("used"))


def acceptance_r4(s, d) -> DataFrame:
    """Cells of a metrics table against the limits, with what a missing rate means, and the roll-up with evidence."""
    cells = ev.confusion(v_score(s, d).withColumn("part", F.pmod("doc_id", F.lit(5))), 0.02, by=["part"]).withColumns({"rows": c("tp") + c("fp") + c("fn") + c("tn"), "fpr": F.when(c("part") != 4, c("fpr"))})
    ok = (c("rows") > 0) & (c("recall") >= 0.95) & (c("precision") >= 0.5) & (F.coalesce("fpr", F.lit(1.0)) <= 0.999)
    return cells.where("tp + fn > 0").select("part", "rows", "precision", "recall", F.coalesce("fpr", F.lit(1.0)).alias("fpr"), ok.alias("passed")).unionByName(
        s.createDataFrame([(-1, 0, 0.0, 0.0, 1.0, False)], "part long, rows long, precision double, recall double, fpr double, passed boolean"))


def checksum_report(s, d) -> DataFrame:
    """A written table against stated sums, some of which are wrong, left out or of files that aren't there."""
    path = rd.scratch(s, "parts")
    table(s, d, "documents").select("doc_id", "text").repartition(8, "doc_id").write.parquet(path)
    found = rd.checksums(s, path).where("file LIKE '%.parquet'").withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
    stated = found.where("part <> 1").withColumn("sha256", F.when(c("part") == 2, F.lit("0" * 64)).otherwise(c("sha256"))).unionByName(found.limit(1).withColumns({"file": F.lit("lost.parquet")}))
    return rd.verify_checksums(found, stated).groupBy("state").agg(F.count("*").alias("n"))


QUERIES = {
    "contract_violations": contract,
    "contract_report": lambda s, d: au.report(contract(s, d)),
    "contract_expected_count": lambda s, d: v_child(s, d).groupBy("parent").agg(F.count("*").alias("n"), (F.max("turn") + 1 + F.when(c("parent") % 7 == 0, 1).otherwise(0)).alias("expected")).where("n <> expected"),
    "evidence_violations": evidence_violations,
    "evidence_summary": evidence_summary,
    "readiness_scan": readiness,
    "quality_gate": quality_gate,
    "reuse_decision": reuse,
    "acceptance_gate": lambda s, d: ev.acceptance(ev.confusion(v_score(s, d).withColumn("part", c("doc_id") % 4), 0.05, by=["part"]), 0.8, 0.9, 0.95),
    "acceptance_cells": acceptance_r4,
    "file_checksum_verify": checksum_report,
    "coverage_summary": lambda s, d: v_record(s, d).groupBy("family", "stage").agg(F.count("*").alias("n"), F.countDistinct("framework").alias("frameworks"), (F.count("*") == F.max("doc_id") - F.min("doc_id") + 1).alias("as_expected"), (F.countDistinct("record_id") == F.count("*")).alias("unique_ids")),
}

_PARTS = _rates("v_score", 0.02, "doc_id % 5")
ORACLES = {
    "contract_violations": sql(_CONTRACT, "v_child", r=_SQL_RECORD, ev=_SQL_EVENT),
    "contract_report": sql("SELECT rule, count(*) AS n, least(count(*), 200) AS shown FROM v GROUP BY rule", "v_child", r=_SQL_RECORD, ev=_SQL_EVENT, v=_CONTRACT),
    "contract_expected_count": sql("SELECT * FROM (SELECT parent, count(*) AS n, max(turn) + 1 + CASE WHEN parent % 7 = 0 THEN 1 ELSE 0 END AS expected FROM v_child GROUP BY parent) WHERE n <> expected", "v_child"),
    "evidence_violations": sql(_VIOLATED, r=_SQL_RECORD),
    "evidence_summary": sql(_SUMMARY, r=_SQL_RECORD, v=_VIOLATED),
    "readiness_scan": sql(_READINESS, r=_SQL_RECORD),
    "quality_gate": sql(_GATE, "v_manifest", "v_child", x=_ASSIGNED),
    "reuse_decision": sql("SELECT shard, preference, reason, coalesce(preference = min(preference) FILTER (WHERE reason = 'ok') OVER (PARTITION BY shard), FALSE) AS used FROM (SELECT doc_id % 23 AS shard, doc_id % 3 + 1 AS preference, CASE WHEN count(*) < 2 THEN 'too_few' WHEN count_if(capture_sha IS NULL) > 0 THEN 'capture_missing' WHEN NOT bool_and(wire_real) THEN 'not_real' WHEN max(label) = 0 THEN 'no_positive' ELSE 'ok' END AS reason FROM r GROUP BY 1, 2)", r=_SQL_RECORD),
    "acceptance_gate": sql("SELECT count(*) AS groups, count_if(precision >= 0.8 AND recall >= 0.9 AND fpr <= 0.95)::BIGINT AS passed, bool_and(precision >= 0.8 AND recall >= 0.9 AND fpr <= 0.95) AS accepted FROM m WHERE tp + fn > 0", "v_score", m=_rates("v_score", 0.05, "doc_id % 4")),
    "acceptance_cells": sql("SELECT part, rows, precision, recall, fpr, rows > 0 AND recall >= 0.95 AND precision >= 0.5 AND fpr <= 0.999 AS passed FROM (SELECT part, tp + fp + fn + tn AS rows, precision, recall, CASE WHEN part <> 4 THEN fpr ELSE 1.0::DOUBLE END AS fpr FROM m WHERE tp + fn > 0) UNION ALL SELECT -1, 0, 0, 0, 1, FALSE", "v_score", m=_PARTS),
    "file_checksum_verify": "SELECT * FROM (VALUES ('missing', 1), ('mismatch', 1), ('ok', 6), ('unlisted', 1)) t(state, n)",
    "coverage_summary": sql("SELECT family, stage, count(*) AS n, count(DISTINCT framework) AS frameworks, count(*) = max(doc_id) - min(doc_id) + 1 AS as_expected, count(DISTINCT record_id) = count(*) AS unique_ids FROM r GROUP BY 1, 2", r=_SQL_RECORD),
}
