"""Queries that fit models: rows, parts kept apart, ranges of scores, and what was learned."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import models as mo
from tessera.plans import learning
from tessera.plans.assembly import sessions
from tessera.plans.learning import QUERIES

DATA = "/root/testdata/sf0.001"


def test_imputed_prices(spark):
    rows = QUERIES["ml_impute_price"](spark, DATA)
    assert rows.count() == spark.read.parquet(f"{DATA}/part.parquet").count()
    one = rows.agg(F.count_if("imputed").alias("n"), F.count_if(F.col("filled").isNull()).alias("empty"), F.min("filled").alias("low")).first()
    assert one.n > 0 and one.empty == 0 and one.low > 0


def test_tree_expert_and_statuses(spark):
    found = QUERIES["ml_tree_expert"](spark, DATA).collect()
    assert found and (found[0].status != "ok" or [r.gain for r in found] == sorted((r.gain for r in found), reverse=True))


def test_calibrated_scores(spark):
    rows = QUERIES["ml_calibrate"](spark, DATA).collect()
    report = {r.doc_id for r in QUERIES["ml_parts"](spark, DATA).where("part = 'report'").collect()}
    assert {r.doc_id for r in rows} == report and all(0 <= r.calibrated <= 1 for r in rows)


def test_sequence_expert(spark):
    rows = QUERIES["ml_sequence_expert"](spark, DATA).collect()
    assert all(r.score is None or 0 <= r.score <= 1 for r in rows)


def test_experts_and_fusion_keep_parts_apart(spark, monkeypatch):
    """Scores are of sessions that no expert was fitted or calibrated on; fusion, tuning and report share none."""
    seen = {}
    real = mo.fuse

    def spy(train, apply, scores, **more):
        seen["fit"], seen["apply"] = ({r.session_id for r in x.select("session_id").collect()} for x in (train, apply))
        return real(train, apply, scores, **more)

    monkeypatch.setattr(mo, "fuse", spy)
    scores = QUERIES["ml_expert_scores"](spark, DATA)
    whole = {r.session_id: r for r in sessions(spark, DATA).collect()}
    got = {r.session_id: r for r in scores.collect()}
    assert got and all(r.split != "train" and r.role != "calibration" for r in got.values())
    assert set(got) <= {k for k, r in whole.items() if r.split != "train"}
    for r in got.values():
        for p in (r.p_content, r.p_content_max, r.p_session, r.p_opaque):
            assert p is None or 0 <= p <= 1
        if r.available_encrypted or r.available_bypassed:
            assert r.p_content is None and r.p_session is None
    fused = QUERIES["ml_fusion"](spark, DATA).collect()
    assert {r.session_id for r in fused} == {k for k, r in got.items() if r.role is None}
    if "fit" in seen:
        assert seen["fit"].isdisjoint(seen["apply"]) and seen["fit"].isdisjoint({r.session_id for r in fused})
        assert len({r.threshold for r in fused}) == 1 and all(r.predicted == (r.fused >= r.threshold) for r in fused)


def test_stored_expert_learns_and_needs_both_classes(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), i % 2, float(i % 2 + (i % 5) * 0.01), None) for i in range(120)], "session_id string, label int, x double, y double")
    out = mo.stored_expert(rows.where("session_id < '5'"), ["x", "y"], rows.where("session_id >= '8'"), rows, f"file://{tmp_path}/m").collect()
    assert all((r.p > 0.5) == (r.label == 1) for r in out)
    one = mo.stored_expert(rows.where("label = 1"), ["x"], rows, rows, f"file://{tmp_path}/n")
    assert one.where("p is not null").count() == 0 and one.count() == 120


def test_fusion_after_an_observation(spark):
    """A session that has observed a query before can still run what a fused model scores."""
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 5}
    rows = spark.range(120).selectExpr("id", "cast(id % 2 AS double) AS label", "CASE WHEN id % 5 > 0 THEN id % 2 + id / 1000 END AS a", "cast(NULL AS double) AS b")
    out = mo.fuse(rows.where("id < 60"), rows, ["a", "b"]).collect()
    assert len(out) == 120 and all((r.fused > 0.5) == (r.label == 1) for r in out if r.id % 5)


@pytest.mark.parametrize("name", ["eval_frozen", "eval_leave_one_out", "ml_compositional_holdout", "ml_external_generalization"])
def test_holdouts(spark, name):
    found = QUERIES[name](spark, DATA)
    for r in found.collect() if found is not None else []:
        assert 0 <= r.precision <= 1 and 0 <= r.recall <= 1 and min(r.tp, r.fp, r.fn, r.tn) >= 0


def test_holdouts_train_on_the_training_part_alone(spark, monkeypatch):
    parts = set()
    real = mo.tree_expert

    def spy(train, *a, **b):
        parts.update(r.part for r in train.select("part").distinct().collect())
        return real(train, *a, **b)

    monkeypatch.setattr(mo, "tree_expert", spy)
    rows = learning.rows(spark, DATA)
    learning.held_out(rows, "lang", learning.families(rows, "lang", 2))
    assert parts <= {"train"}


def test_shared_inputs_are_stored_once(spark, monkeypatch):
    """Fits over heavy inputs read a stored table: the sequences and the measures are computed once, and sessions are assembled once for three frames."""
    from tessera.operators import models
    from tessera.plans import learning

    class Stop(Exception):
        pass

    stored, keep = [], models._stored

    def stop(*_):
        raise Stop

    monkeypatch.setattr(models, "_stored", lambda df, name: stored.append(name) or keep(df, name))
    for name in ("status_of", "tree_expert", "stored_expert"):
        monkeypatch.setattr(models, name, stop)
    for query in (learning.sequence_expert, learning.external, learning.expert_scores):
        with pytest.raises(Stop):
            query(spark, "/root/testdata/sf0.001")
    assert stored == ["pooled", "measures", "sessions"]


def test_every_source_is_held_out(spark, tmp_path):
    """All sources come back, a null one too, each with a base and a stacked model; no language is left out."""
    rows = [(i, ("a " if i % 2 else "B! ") * (5 + i % 7), ("en", "fr")[i % 2], None if i % 7 == 6 else f"src{i % 7}") for i in range(280)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i // 2 % 2, 0) for i in range(280)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    measured = learning.rows(spark, f"file://{tmp_path}")
    n = {r.source: r["count"] for r in measured.where("part <> 'train'").groupBy("source").count().collect()}
    found = {(r.source, r.trained): r.tp + r.fp + r.fn + r.tn for r in learning.external(spark, f"file://{tmp_path}").collect()}
    assert len(n) == 7 and found == {(k, m): v for k, v in n.items() for m in ("base", "stacked")}
    assert sorted(learning.families(measured.withColumn("x", F.col("doc_id") % 12), "x")) == list(range(12))
