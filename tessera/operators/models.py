"""Models over feature tables: imputation by group, boosted experts, calibration, fusion, holdouts. Only parameters reach the driver."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.readers import remove, scratch


def trees_by_group(df: DataFrame, target: str, features: list[str], group: str, depth: int = 8, bins: int = 64) -> tuple[DataFrame, DataFrame]:
    """A regression tree for each value of ``group``, all grown together: (cuts and tree by group, value by group and leaf).

    Features are cut at quantiles of the group (at most ``bins`` values), and rows of a group with the same bins are one cell
    from then on, as no split tells them apart. A level takes one aggregate of all cells by group, node, feature and bin,
    whatever the number of groups; each node then splits where the squares left over are least (ties:
    the earlier feature, the lower bin). A group's tree is a map of at most 2^``depth`` nodes. Null features count as 0.
    """
    spark = df.sparkSession
    known = df.where(F.col(target).isNotNull()).na.fill(0.0, features).withColumn("_g", _group_key(group))
    shares = [n / bins for n in range(1, bins)]
    cuts = known.groupBy("_g").agg(*(F.array_sort(F.array_distinct(F.percentile_approx(F.col(f).cast("double"), shares, 100 * bins))).alias(f"_c{i}") for i, f in enumerate(features)))
    cuts = _stored(cuts, "cuts")
    binned = known.join(cuts, "_g").select("_g", F.col(target).cast("double").alias("y"), _binned(features).alias("b"))
    cells = _stored(binned.groupBy("_g", "b").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "binned")
    tree = spark.createDataFrame([], "_g string, tree map<int, struct<f: int, bin: int>>")
    for level in range(depth):
        at = cells.join(tree, "_g", "left").select("_g", "n", "s", "b", _leaf(level).alias("node"))
        stats = at.select("_g", "node", "n", "s", F.posexplode("b").alias("f", "bin")).groupBy("_g", "node", "f", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        each = Window.partitionBy("_g", "node", "f")
        upto = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = stats.select("_g", "node", "f", "bin", F.sum("n").over(upto).alias("n0"), F.sum("s").over(upto).alias("s0"), F.sum("n").over(each).alias("n"), F.sum("s").over(each).alias("s"))
        gain = F.col("s0") ** 2 / F.col("n0") + (F.col("s") - F.col("s0")) ** 2 / (F.col("n") - F.col("n0")) - F.col("s") ** 2 / F.col("n")
        best = sums.where("n0 < n").groupBy("_g", "node").agg(F.max(F.struct(F.round(gain, 6).alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"))).alias("x")).where("x.gain > 0")
        new = best.select("_g", "node", F.struct((-F.col("x.f")).cast("int").alias("f"), (-F.col("x.bin")).cast("int").alias("bin")).alias("split"))
        old = tree.select("_g", F.explode("tree").alias("node", "split"))
        grown = _stored(old.unionByName(new).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("node", "split"))).alias("tree")), "trees")
        if level and not new.limit(1).count():
            break
        tree = grown
    value = cells.join(tree, "_g", "left").groupBy("_g", _leaf(depth).alias("leaf")).agg((F.sum("s") / F.sum("n")).alias("value"))
    return cuts.join(tree, "_g", "left"), value


def _group_key(group: str) -> Column:
    return F.to_json(F.struct(F.col(group)))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _binned(features: list[str]) -> Column:
    below = lambda f: lambda cut: cut < F.col(f)
    return F.array(*(F.size(F.filter(f"_c{i}", below(f))) for i, f in enumerate(features)))


def _leaf(depth: int) -> Column:
    """The node that a row's bins lead to in ``depth`` steps."""
    if not depth:
        return F.lit(1)
    tree, bins = F.col("tree"), F.col("b")
    step = lambda node: F.when(tree[node].isNull(), node).otherwise(2 * node + (F.get(bins, tree[node]["f"]) > tree[node]["bin"]).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), lambda node, _: step(node))


def impute_by_tree(df: DataFrame, target: str, features: list[str], group: str, depth: int = 8) -> DataFrame:
    """Missing targets from a tree for each group; known targets stay. A group without known targets stays null."""
    trees, value = trees_by_group(df, target, features, group, depth)
    rows = df.na.fill(0.0, features).withColumn("_g", _group_key(group)).join(trees, "_g", "left")
    missing = F.col(target).isNull()  # others need no leaf
    rows = rows.withColumn("b", F.when(missing, _binned(features))).withColumn("leaf", F.when(missing, _leaf(depth))).join(value, ["_g", "leaf"], "left")
    return rows.select(*df.columns, F.coalesce(F.col(target), F.col("value")).alias("filled"), F.col(target).isNull().alias("imputed"))


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """``weight`` = n / (2 * n of the row's class)."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    return df.join(F.broadcast(n.join(F.broadcast(total)).select(label, (F.col("_t") / (2 * F.col("_n"))).alias("weight"))), label)


def status_of(train: DataFrame, label: str = "label", least: int = 20) -> str:
    """Why a model can't be trained, or ``ok``."""
    r = train.agg(F.count("*").alias("n"), F.countDistinct(label).alias("k")).first()
    return "empty" if not r.n else "missing_split_or_label" if r.k < 2 else "insufficient_train" if r.n < least else "ok"


def tree_expert(train: DataFrame, features: list[str], label: str = "label", trees: int = 10, depth: int = 3):
    """Boosted trees with balanced class weights."""
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTClassifier(labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, seed=7)]
    return Pipeline(stages=stages).fit(balanced(train, label))


def scored(model, df: DataFrame, out: str = "score") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(model, features: list[str], spark) -> DataFrame:
    """Features by gain, ties by name."""
    gain = model.stages[-1].featureImportances
    return spark.createDataFrame([(f, float(gain[i])) for i, f in enumerate(features)], "feature string, gain double").orderBy(F.desc("gain"), "feature")


def stored_expert(train: DataFrame, features: list[str], calibration: DataFrame, apply: DataFrame, path: str, trees: int = 5, depth: int = 3) -> DataFrame:
    """``apply`` with ``p``: scores of trees fitted on ``train``, stored below ``path`` and loaded again, calibrated on ``calibration`` where it has both classes.

    Null features count as 0. Without enough rows or classes to train on, ``p`` is null.
    """
    ready = lambda df: df.na.fill(0.0, features).withColumn("label", F.col("label").cast("double"))
    if status_of(train) != "ok":
        return apply.withColumn("p", F.lit(None).cast("double"))
    tree_expert(ready(train), features, trees=trees, depth=depth).write().overwrite().save(path)
    model = PipelineModel.load(path)
    known = scored(model, ready(calibration))
    out = scored(model, ready(apply))
    if calibration.agg(F.countDistinct("label")).first()[0] == 2:
        return calibrate(known, out).withColumn("p", F.col("calibrated").cast("double")).drop("score", "calibrated")
    return out.withColumnRenamed("score", "p")


def calibrate(fit: DataFrame, apply: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Isotonic calibration learned on ``fit``; constant beyond the range it has seen."""
    model = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(fit.select(F.col(score).cast("double"), F.col(label).cast("double")))
    return model.transform(apply)


def fuse(train: DataFrame, apply: DataFrame, scores: list[str], label: str = "label") -> DataFrame:
    """Logistic regression on expert scores, with the training medians for missing ones and a flag that they were."""
    medians = train.agg(*(F.coalesce(F.percentile(s, F.lit(0.5)), F.lit(0.0)).alias(s) for s in scores)).first().asDict()
    ready = lambda df: df.withColumns({f"{s}_there": F.col(s).isNotNull().cast("double") for s in scores}).na.fill(medians, scores)
    columns = [*scores, *(f"{s}_there" for s in scores)]
    stages = [VectorAssembler(inputCols=columns, outputCol="features"), LogisticRegression(labelCol=label, weightCol="weight", maxIter=30)]
    # a fitted model drags its summary, and with that the session, into its tasks, which fails once the session has observed anything; a loaded one has none
    path = scratch(train.sparkSession, "fusion")
    Pipeline(stages=stages).fit(balanced(ready(train), label)).write().save(path)
    model = PipelineModel.load(path)
    remove(train.sparkSession, path)
    return scored(model, ready(apply), "fused")
