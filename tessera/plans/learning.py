"""Queries that fit models. Rows and ranges are checked, not values; statuses and roles have SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import four_way_role, hash_number
from tessera.operators import assembly as asm
from tessera.operators import models as mo
from tessera.operators.evaluation import confusion, threshold_for_recall
from tessera.operators.sessions import sequences
from tessera.plans.assembly import CONTENT, OPAQUE, PACKETS, TOTALS, frames, sessions
from tessera.plans.features import compositions, visible_channels, visible_rows
from tessera.plans.views import sql, table
from tessera.sources import readers as rd

FEATURES = ["n_chars", "n_upper", "n_marks", "n_lines"]
#: Disjoint parts by hash: half trains, and calibration, threshold, fusion and report have an eighth each.
PARTS = ["train", "train", "train", "train", "calibration", "tuning", "fusion", "report"]


def rows(s, d) -> DataFrame:
    """Text measures of documents with a quality label, and the part that each belongs to."""
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("double")
    docs = table(s, d, "documents").select("doc_id", "lang", "source", F.char_length("text").cast("double").alias("n_chars"), count("[A-Z]").alias("n_upper"), count("[!$%&*#|]").alias("n_marks"), (count("\n") + 1).alias("n_lines"))
    labels = table(s, d, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("label"))
    part = F.element_at(F.array(*map(F.lit, PARTS)), (hash_number(F.concat(F.lit("part:"), F.col("doc_id").cast("string"))) % len(PARTS) + 1).cast("int"))
    return docs.join(labels, "doc_id").withColumns({"id": F.concat(F.lit("a-"), "doc_id"), "part": part})


def expert(s, d):
    """A model of the training part alone, and all rows."""
    r = rows(s, d)
    return mo.tree_expert(r.where("part = 'train'"), FEATURES), r


def tree_expert(s, d) -> DataFrame:
    """The 20 features with most gain, or one row that says why there is no model."""
    r = rows(s, d)
    status = mo.status_of(r.where("part = 'train'"))
    if status != "ok":
        return s.createDataFrame([("", 0.0, status)], "feature string, gain double, status string")
    model, _ = expert(s, d)
    return mo.importances(model, FEATURES, s).limit(20).withColumn("status", F.lit("ok"))


def statuses(s, d) -> DataFrame:
    """For each source: rows and classes of its training part, and whether a model can be trained on them."""
    r = rows(s, d).where("part = 'train'").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes"))
    every = table(s, d, "documents").select("source").distinct().unionByName(s.createDataFrame([("nowhere",)], "source string"))
    joined = every.join(r, "source", "left").na.fill(0, ["n", "classes"])
    return joined.withColumn("status", F.when(F.col("n") == 0, "empty").when(F.col("classes") < 2, "missing_split_or_label").when(F.col("n") < 20, "insufficient_train").otherwise("ok"))


def calibrated(s, d) -> DataFrame:
    """Calibrated on a part that the expert hasn't seen, applied to one that neither has."""
    model, r = expert(s, d)
    p = mo.scored(model, r.where("part <> 'train'"))
    return mo.calibrate(p.where("part = 'calibration'"), p.where("part = 'report'")).select("doc_id", "label", "score", "calibrated")


def sequence_expert(s, d) -> DataFrame:
    """Trees over the masked means of a session's 21 channels; the label is that of the session's record."""
    channels = visible_channels()
    seq = sequences(visible_rows(s, d), "session_id", "rec", channels, 96)
    total = F.aggregate("mask", F.lit(0.0), lambda a, b: a + b)
    mean = lambda i: F.aggregate(F.transform("seq", lambda x: F.get(x, F.lit(i))), F.lit(0.0), lambda a, b: a + b) / total
    pooled = seq.select("session_id", *(mean(i).alias(n) for i, n in enumerate(channels)))
    labels = table(s, d, "labels").where("quality is not null").select(F.concat(F.lit("x-"), "doc_id").alias("session_id"), F.col("quality").cast("double").alias("label"))
    held = mo._stored(pooled.join(labels, "session_id").withColumn("part", hash_number("session_id") % 4), "pooled")  # read for each statistic of the fit
    train = held.where("part < 3")
    status = mo.status_of(train)
    if status != "ok":
        return held.select("session_id", "label", F.lit(None).cast("double").alias("score"), F.lit(status).alias("status"))
    return mo.scored(mo.tree_expert(train, list(channels)), held.where("part = 3")).select("session_id", "label", "score", F.lit("ok").alias("status"))


ROLES = ["calibration", "tuning", "fusion", "report"]
SCORES = ["p_content", "p_content_max", "p_session", "p_opaque"]


def expert_scores(s, d) -> DataFrame:
    """Calibrated scores of three stored tree experts for sessions that none was trained on, hidden where content is, with flags and roles.

    Experts learn from the training part; validation sessions have one of four roles by a hash of their id. Experts are
    calibrated on the first role, so scores of the other three, of the test part and of the challenge are new to them.
    """
    folder, found = rd.scratch(s, "experts"), {}
    flags = [*asm.availability(), *asm.missing_reasons()]
    features = {"content": CONTENT, "session": [*PACKETS, *TOTALS], "opaque": [*PACKETS, *OPAQUE, *flags]}
    role = F.when(F.col("split") == "validation", four_way_role(F.col("session_id"), ROLES))
    whole, assembled = None, mo._stored(sessions(s, d), "sessions")  # three frames are taken from it
    for name, rows in frames(s, d, assembled).items():
        place = f"{folder}/{name}"
        rows.withColumns({"role": role, **{x: F.col(x).cast("double") for x in features[name]}}).write.parquet(f"{place}/rows")
        rows = s.read.parquet(f"{place}/rows")
        if name == "opaque":
            whole = rows
        new = rows.where("split <> 'train' and (role is null or role <> 'calibration')")
        p = mo.stored_expert(rows.where("split = 'train'"), features[name], rows.where("role = 'calibration'"), new, f"{place}/model")
        mean = F.avg("p").alias(f"p_{name}")
        found[name] = p.groupBy("session_id").agg(mean, F.max("p").alias("p_content_max")) if name == "content" else p.groupBy("session_id").agg(mean)
    out = asm.assemble(whole.where("split <> 'train' and (role is null or role <> 'calibration')").select("session_id", "label", "split", "role", *flags), "session_id", *found.values())
    out = out.withColumns({f"has_{x}": F.col(f"p_{x}").isNotNull().cast("int") for x in found})
    out.write.parquet(f"{folder}/scores")
    for name in found:
        rd.remove(s, f"{folder}/{name}")
    return s.read.parquet(f"{folder}/scores")


def fused(s, d) -> DataFrame:
    """Fused on sessions of one role, a threshold for a recall of .95 from another, reported on the test part and the challenge."""
    scores = expert_scores(s, d)
    columns = [*SCORES, *asm.availability(), *asm.missing_reasons()]
    rows = scores.withColumns({"label": F.col("label").cast("double"), **{x: F.col(x).cast("double") for x in columns}})
    fit = rows.where("role = 'fusion'")
    if mo.status_of(fit, least=2) != "ok":
        return rows.where("role is null").select("session_id", "split", "label", F.lit(None).cast("double").alias("fused"), F.lit(0.5).alias("threshold"), F.lit(None).cast("boolean").alias("predicted"))
    scored = mo.fuse(fit, rows.where("role = 'tuning' or role is null"), columns)
    threshold = threshold_for_recall(scored.where("role = 'tuning'"), 0.95, score="fused").first().threshold
    return scored.where("role is null").select("session_id", "split", "label", "fused", F.lit(threshold).alias("threshold"), (F.col("fused") >= threshold).alias("predicted"))


def frozen(s, d) -> DataFrame:
    """A stored model is loaded again and scores a slice that is for evaluation only."""
    model, r = expert(s, d)
    path = rd.scratch(s, "model")
    model.write().save(path)
    c = confusion(mo.scored(PipelineModel.load(path), r.where("part = 'report'")), 0.5)
    rd.remove(s, path)  # the loaded model holds its trees
    return c.withColumn("accepted", (F.col("recall") >= 0.95) & (F.col("fp_per_million") <= 50))


def held_out(r: DataFrame, column: str, values: list, least: int = 20) -> DataFrame | None:
    """For each value: the status, and where a model can be trained on the training rows of the others, its confusion on all rows of the value."""
    out = None
    for value in values:
        train, test = r.where("part = 'train'").where(~F.col(column).eqNullSafe(F.lit(value))), r.where(F.col(column).eqNullSafe(F.lit(value)))
        status = mo.status_of(train, least=least)
        if status == "ok":
            row = confusion(mo.scored(mo.tree_expert(train, FEATURES), test), 0.5)
        else:
            row = confusion(test.limit(0).withColumn("score", F.lit(0.0)), 0.5)
        row = row.withColumns({"held_out": F.lit(str(value)), "status": F.lit(status)})
        out = row if out is None else out.unionByName(row)
    return out


def families(r: DataFrame, column: str, most: int | None = None) -> list:
    """Values of a small dimension, null among them, the commonest first; all of them, or the first ``most``."""
    found = r.groupBy(column).count().orderBy(F.desc("count"), column)
    return [x[0] for x in (found if most is None else found.limit(most)).collect()]


def leave_one_out(s, d) -> DataFrame:
    r = rows(s, d)
    return held_out(r, "lang", families(r, "lang"))


def compositional(s, d) -> DataFrame:
    """Each of the commonest combinations of techniques (at most 8 with 20 rows or more) held out as a whole."""
    keys = compositions(s, d).where(F.contains("composition_key", F.lit("+"))).select("doc_id", "composition_key")
    r = rows(s, d).join(keys, "doc_id", "left")
    common = r.where("composition_key is not null").groupBy("composition_key").count().where("count >= 20").orderBy(F.desc("count"), "composition_key").limit(8)
    return held_out(r, "composition_key", [x[0] for x in common.collect()])


def external(s, d) -> DataFrame:
    """For each source: a base model (trained without any of them) on its rows, and one whose training rows have those of the other sources stacked on."""
    r = mo._stored(rows(s, d), "measures")  # each of the fits and scores reads the measures, not the texts
    base, outside = r.where("part = 'train'"), r.where("part <> 'train'")
    alone = confusion(mo.scored(mo.tree_expert(base, FEATURES), outside), 0.5, by=["source"]).withColumn("trained", F.lit("base"))

    def stacked(value) -> list:
        own = F.col("source").eqNullSafe(F.lit(value))
        model = mo.tree_expert(base.unionByName(outside.where(~own)), FEATURES)
        return confusion(mo.scored(model, outside.where(own)), 0.5, by=["source"]).withColumn("trained", F.lit("stacked")).collect()

    with ThreadPoolExecutor(4) as pool:  # a fit is many short jobs
        found = [x for part in pool.map(inheritable_thread_target(s)(stacked), families(outside, "source")) for x in part]
    out = alone.unionByName(s.createDataFrame(found, alone.schema))
    return out.select(*(c for c in out.columns if c not in ("source", "trained")), "source", "trained")


def house(s, d) -> DataFrame:
    return table(s, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("price"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 1000).cast("double").alias("place"))


QUERIES = {
    "ml_impute_price": lambda s, d: mo.impute_by_tree(house(s, d).withColumn("district", F.substring("p_brand", -2, 1)), "price", ["size", "place"], "district", 6).select("p_partkey", "district", "filled", "imputed"),
    "ml_tree_expert": tree_expert,
    "ml_expert_status": statuses,
    "ml_parts": lambda s, d: rows(s, d).select("doc_id", "label", "part"),
    "ml_calibrate": calibrated,
    "ml_sequence_expert": sequence_expert,
    "ml_expert_scores": expert_scores,
    "ml_fusion": fused,
    "eval_frozen": frozen,
    "eval_leave_one_out": leave_one_out,
    "ml_compositional_holdout": compositional,
    "ml_external_generalization": external,
}
_ROWS = f"SELECT doc_id, source, quality::DOUBLE AS label, {PARTS}[('0x' || substr(sha256('part:' || doc_id), 1, 8))::BIGINT % {len(PARTS)} + 1] AS part FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"
ORACLES: dict[str, str] = {
    "ml_parts": sql("SELECT doc_id, label, part FROM r", r=_ROWS),
    "ml_expert_status": sql("SELECT source, coalesce(n, 0) AS n, coalesce(classes, 0) AS classes, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN classes < 2 THEN 'missing_split_or_label' WHEN n < 20 THEN 'insufficient_train' ELSE 'ok' END AS status FROM (SELECT DISTINCT source FROM documents UNION ALL SELECT 'nowhere') LEFT JOIN (SELECT source, count(*) AS n, count(DISTINCT label) AS classes FROM r WHERE part = 'train' GROUP BY source) USING (source)", r=_ROWS),
}
