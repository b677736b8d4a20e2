"""Queries of promotion and of histories of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import acceptance as acc
from tessera.operators.evaluation import confusion
from tessera.operators.histories import changes_by_entity
from tessera.plans.contracts import _READINESS, _SQL_RECORD, readiness
from tessera.plans.views import sql, table, v_manifest, v_score

c = F.col

#: Parts of a score table that stand for cells of a model's report: by source for unseen families, by language for compositions.
_PARTS = {"leave_one_family_out": "source", "compositional_holdout": "lang", "framework_cells": "cast(doc_id % 3 AS string)"}
_SCORE = "CASE WHEN doc_id % 40 = 0 THEN score WHEN label = 1 THEN 0.9 ELSE 0.1 END"


def cells(s, d) -> DataFrame:
    """A cell per part: rows, rates at 0.5 and the confusion matrix; the rate of false positives is left out where the part is even."""
    rows = v_score(s, d).withColumn("score", F.expr(_SCORE)).join(table(s, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    out = None
    for fact, part in _PARTS.items():
        one = confusion(rows.withColumns({"part": F.expr(part), "fact": F.lit(fact)}), 0.5, by=["fact", "part"])
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"rows": c("tp") + c("fp") + c("fn") + c("tn"), "fpr": F.when(F.length("part") % 2 == 1, c("fpr"))})


def judged(s, d) -> DataFrame:
    return cells(s, d).select("fact", "part", "rows", "precision", "recall", acc.false_positive_rate().alias("fpr"), acc.cell_passes().alias("passed"))


def facts(s, d) -> DataFrame:
    """(source, fact, ok) of metrics, the manifest's registry, the readiness scan and models; what no source knows is absent."""
    named = lambda source, df: df.select(F.lit(source).alias("source"), "fact", c("ok").cast("boolean").alias("ok"))
    long = lambda df, **flags: df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("fact"), F.expr(e).alias("ok")) for k, e in flags.items()))).alias("x")).select("x.*")
    metrics = acc.all_pass(cells(s, d), "fact", acc.cell_passes(None, 0.9, 0.05))
    registry = v_manifest(s, d).agg(F.countDistinct("client").alias("clients"), F.countDistinct("carrier").alias("servers"), F.countDistinct("lang").alias("networks"), F.countDistinct("stage").alias("stages"))
    models = v_score(s, d).agg(F.count("*").alias("n"), F.countDistinct("label").alias("k"))
    found = named("registry", long(registry, clients="clients >= 4", servers="servers >= 3", networks="networks >= 50", all_frameworks="stages >= 4", framework_validated="stages > 0", ech_validated="servers > 1000"))
    found = found.unionByName(named("metrics", metrics)).unionByName(named("readiness", long(readiness(s, d), benign_ready="enough", benign_multi_event_ready="multi_event_ready", netem_ready="patterns >= 10", long_timing_ready="timing_ready", long_timing_multi_event_ready="timing_ready")))
    return found.unionByName(named("models", long(models, opaque_sequence="n >= 20 AND k = 2", fusion="k = 2", no_plaintext_when_opaque="true")))


def rolled_up(s, d) -> DataFrame:
    valid = v_manifest(s, d).agg((F.countDistinct("id") == F.count("*")).alias("valid"))
    return acc.roll_up(valid, judged(s, d), acc.points(acc.required(s), facts(s, d)))


def daily(s, d) -> DataFrame:
    """A snapshot per user and day with events: how many, of how many kinds, and the total in cents (null where it is small)."""
    per = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.round(F.sum("value") * 100).cast("long").alias("cents"))
    return per.withColumn("cents", F.when(c("cents") >= 1000, c("cents")))


def changes(s, d) -> DataFrame:
    """The change map of every snapshot of every user, a row per changed field."""
    rows = changes_by_entity(daily(s, d), "user_id", "day", ["n", "kinds", "cents"])
    return rows.select("user_id", "day", "state", "digest", F.explode_outer("changes").alias("field", "x")).select("user_id", "day", "state", "digest", "field", c("x.from").alias("was"), c("x.to").alias("became"))


_RATE = "round(coalesce({a} / nullif({b}, 0)::DOUBLE, 0), 6)"
_ROWS = f"SELECT doc_id, label, {_SCORE.replace('0.9', '0.9::DOUBLE').replace('0.1', '0.1::DOUBLE')} AS score, source, lang FROM v_score JOIN documents USING (doc_id)"
_CELLS = "SELECT *, tp + fp + fn + tn AS rows, " + _RATE.format(a="tp", b="(tp + fp)") + " AS precision, " + _RATE.format(a="tp", b="(tp + fn)") + " AS recall, CASE WHEN length(part) % 2 = 1 THEN " + _RATE.format(a="fp", b="(fp + tn)") + " ELSE fp / greatest(fp + tn, 1)::DOUBLE END AS fpr FROM (" + " UNION ALL ".join(
    f"SELECT '{fact}' AS fact, {part} AS part, count_if(score >= 0.5 AND label = 1) AS tp, count_if(score >= 0.5 AND label = 0) AS fp, count_if(score < 0.5 AND label = 1) AS fn, count_if(score < 0.5 AND label = 0) AS tn FROM rw GROUP BY 2" for fact, part in _PARTS.items()) + ")"
_OK = "rows > 0 AND precision >= 0.95 AND recall >= 0.95 AND fpr <= 0.00005::DOUBLE"
_FACTS = (
    "SELECT 'metrics' AS source, fact, bool_and(rows > 0 AND recall >= 0.9 AND fpr <= 0.05) AS ok FROM ce GROUP BY fact"
    " UNION ALL SELECT 'registry', unnest(['clients', 'servers', 'networks', 'all_frameworks', 'framework_validated', 'ech_validated']), unnest([a >= 4, b >= 3, c >= 50, e >= 4, e > 0, b > 1000]) FROM (SELECT count(DISTINCT client) AS a, count(DISTINCT carrier) AS b, count(DISTINCT lang) AS c, count(DISTINCT stage) AS e FROM v_manifest)"
    " UNION ALL SELECT 'readiness', unnest(['benign_ready', 'benign_multi_event_ready', 'netem_ready', 'long_timing_ready', 'long_timing_multi_event_ready']), unnest([enough, multi_event_ready, patterns >= 10, timing_ready, timing_ready]) FROM rd"
    " UNION ALL SELECT 'models', unnest(['opaque_sequence', 'fusion', 'no_plaintext_when_opaque']), unnest([n >= 20 AND k = 2, k = 2, TRUE]) FROM (SELECT count(*) AS n, count(DISTINCT label) AS k FROM v_score)"
)
_NEEDED = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{a}', '{b}')" for p, facts in acc.REQUIRED.items() for a, b in facts) + ") t(point, source, fact)"
_POINTS = "SELECT point, bool_and(coalesce(ok, FALSE)) AS ready, count_if(ok IS NULL)::BIGINT AS missing, count_if(NOT ok)::BIGINT AS failed FROM ne LEFT JOIN fa USING (source, fact) GROUP BY point"
_CTES = dict(rw=_ROWS, ce=_CELLS, r=_SQL_RECORD, rd=_READINESS, fa=_FACTS, ne=_NEEDED, pt=_POINTS)
_FIELDS = ["n", "kinds", "cents"]
_CHANGES = (
    "SELECT user_id, day, CASE WHEN r = 1 THEN 'initial' WHEN " + " AND ".join(f"{f} IS NOT DISTINCT FROM {f}0" for f in _FIELDS) + " THEN 'same' ELSE 'changed' END AS state, sha256(concat_ws('|', " + ", ".join(f"'{f}=' || coalesce({f}::VARCHAR, '')" for f in _FIELDS) + ")) AS digest, x.f AS field, x.a AS was, x.b AS became FROM (SELECT *, "
    + "CASE WHEN r = 1 THEN [NULL] ELSE coalesce(nullif(list_filter([" + ", ".join(f"CASE WHEN {f} IS DISTINCT FROM {f}0 THEN {{'f': '{f}', 'a': {f}0::VARCHAR, 'b': {f}::VARCHAR}} END" for f in _FIELDS) + "], lambda y: y IS NOT NULL), []), [NULL]) END AS xs FROM l), unnest(xs) AS u(x)"
)
_L = "SELECT *, row_number() OVER w AS r, " + ", ".join(f"lag({f}) OVER w AS {f}0" for f in _FIELDS) + " FROM (SELECT user_id, ts::DATE AS day, count(*) AS n, count(DISTINCT event_type) AS kinds, CASE WHEN round(sum(value) * 100) >= 1000 THEN round(sum(value) * 100)::BIGINT END AS cents FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY day)"

QUERIES = {
    "acceptance_limits": judged,
    "acceptance_points": lambda s, d: acc.points(acc.required(s), facts(s, d)),
    "acceptance_rollup": rolled_up,
    "snapshot_changes": changes,
}
ORACLES = {
    "acceptance_limits": sql(f"SELECT fact, part, rows, precision, recall, fpr, {_OK} AS passed FROM ce", "v_score", rw=_ROWS, ce=_CELLS),
    "acceptance_points": sql("SELECT * FROM pt", "v_score", "v_manifest", **_CTES),
    "acceptance_rollup": sql(f"SELECT dataset_valid, quality, cells, cells_passed, evidence, points_ready, dataset_valid AND quality AND evidence AS candidate FROM (SELECT count(DISTINCT id) = count(*) AS dataset_valid FROM v_manifest), (SELECT bool_and({_OK}) AS quality, count(*) AS cells, count_if({_OK})::BIGINT AS cells_passed FROM ce), (SELECT bool_and(ready) AS evidence, count_if(ready)::BIGINT AS points_ready FROM pt)", "v_score", "v_manifest", **_CTES),
    "snapshot_changes": sql(_CHANGES, l=_L),
}
