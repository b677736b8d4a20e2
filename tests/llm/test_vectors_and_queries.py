"""Vector operators against brute force; queries and the pipeline on the smallest tables."""

import collections
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.itq_dedup import _tiled_links, near_duplicate_vectors
from tessera.llm.queries import QUERIES
from tessera.llm.topk_search import products, scaled_integers, top_k

DATA = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "x") for i, v, y in rows], "vec_id long, embedding array<float>, label int, v string")


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 8)), 1)
    rows = [(i, x[i], 0) for i in range(400)]
    odd = [(500, None, 0), (600, [None] * 8, 0), (700, [float("nan")] * 8, 0), (None, x[0], 0), (3, x[3], 0), (800, [1.0, 2.0], 0)]
    v = scaled_integers(vectors(spark, rows + odd), "vec_id", "embedding", 1024.0)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(v, v.where("id % 100 = 0"), 10, tile_rows=32, block_rows=3, cell_tiles=2).collect()}
    z = np.floor(x.astype(np.float32).astype(float) * 1024).astype(np.int64)
    want = set()
    for q in range(0, 400, 100):
        s = z @ z[q]
        want |= {(q, n + 1, int(i), int(s[i])) for n, i in enumerate([i for i in np.lexsort((np.arange(400), -s)) if i != q][:10])}
    assert got == want
    twice = v.unionByName(spark.createDataFrame([(3, [9000] * 8), (3, [8000] * 8)], "id long, v array<long>"))
    best = [r.score for r in top_k(twice, v.where("id = 100"), 500).where("vec_id = 3").collect()]
    assert len(best) == 4 and {int(z[100].sum()) * 9000, int(z[100].sum()) * 8000} < set(best)
    assert top_k(v.limit(0), v.limit(0)).count() == 0
    big = np.array([[2**40, 1]])
    assert products(big, big)[0, 0] == 2**63 - 1


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 32))
    rows = [(i, base[i], i % 2) for i in range(60)]
    rows += [(100 + i, base[i % 20] + rng.normal(size=32) * 0.12, i % 2) for i in range(100)]
    rows += [(300 + i, base[1], 1) for i in range(5)] + [(400, base[1], 0), (401, base[1], None), (402, None, 1), (403, [0.0] * 32, 1), (404, [float("inf")] * 32, 1), (405, base[2] * 1e30, 0), (406, [1.0, 0.0], 1)]
    x = {i: np.array(v, np.float32).astype(float) for i, v, y in rows if v is not None and y is not None and np.isfinite(np.array(v, float)).all() and np.any(v)}
    y = {i: b for i, _, b in rows}
    cosine = lambda a, b: len(a) == len(b) and a @ b >= 0.98 * np.linalg.norm(a) * np.linalg.norm(b)
    links = {i: sum(j != i and y[i] == y[j] and cosine(x[i], x[j]) for j in x) if i in x else 0 for i in y}
    got = {r.vec_id: r for r in near_duplicate_vectors(vectors(spark, rows)).collect()}
    assert set(got) == set(y) and all(got[i].n_links <= links[i] for i in y)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(links.values())
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (400, 401, 402, 403, 404, 406))
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in got.values())
    assert near_duplicate_vectors(vectors(spark, rows).limit(0)).count() == 0
    named = [(1, base[0], "a"), (2, base[0], "a"), (1, base[0], "b"), (3, base[0], "b"), (4, base[5], "b")]
    df = spark.createDataFrame([(i, [float(z) for z in v], y, "x") for i, v, y in named], "vec_id long, embedding array<double>, label string, node string")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]
    many = [(i, base[i % 60] + rng.normal(size=32) * 0.1, 0) for i in range(600)]
    z = np.array([v for _, v, _ in many], np.float32).astype(float)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    true = int((z @ z.T >= 0.98).sum()) - len(z)
    assert sum(r.n_links for r in near_duplicate_vectors(vectors(spark, many)).collect()) >= 0.9 * true > 1000


def links_by_hand(x, labels, cosine=0.98):
    """Number of links and least reachable row of each vector."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= cosine) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(near, low[None, :], len(x)).min(1))
        if (new == low).all():
            return near.sum(1), low
        low = new


def _vectors_like(kind, rng):
    n, dim = 900, 64
    labels = [i % 3 for i in range(n)]
    if kind == "centred":
        base = rng.normal(size=(n // 3, dim))
        x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.08, 0.14)])
    elif kind == "common mean":
        x = 1 + 0.14 * rng.normal(size=(n, dim))
    elif kind == "common mean, few links":
        base = 1 + 0.35 * rng.normal(size=(n // 3, dim))
        x = np.concatenate([base, base + 0.12 * rng.normal(size=base.shape), base + 0.16 * rng.normal(size=base.shape)])
    elif kind == "low rank":
        x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, dim)) + 0.01 * rng.normal(size=(n, dim))
    elif kind == "one hot label":
        base = rng.normal(size=(30, dim))
        x = base[rng.integers(0, 30, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.2, 0.6], (n, 1))
        labels = [7] * (n - 5) + [1, 1, 2, 3, 3]
    else:  # labels with means of their own
        x = np.repeat(3 * rng.normal(size=(30, dim)), n // 30, axis=0) + 0.5 * rng.normal(size=(n, dim))
        labels = [i // 30 for i in range(n)]
    return x, labels


@pytest.mark.parametrize("kind", ["centred", "common mean", "common mean, few links", "low rank", "one hot label", "means by label"])
def test_recall_of_near_vectors(spark, kind):
    """At least nine in ten links, no pair that isn't one, whatever mean, rank or label sizes."""
    x, labels = _vectors_like(kind, np.random.default_rng(3))
    true, low = links_by_hand(x, labels)
    got = {r.vec_id: r for r in near_duplicate_vectors(vectors(spark, [(i, v.tolist(), n) for i, (v, n) in enumerate(zip(x, labels, strict=True))]), tile=100).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and true.sum() > 200
    assert found.sum() >= 0.95 * true.sum()
    if (found == true).all():
        assert [got[i].component_id for i in range(len(x))] == low.tolist()


@pytest.mark.parametrize("tile", [7, 1_000])
def test_tiles_against_brute_force(spark, tile):
    """Labels too small to measure are compared whole: every link, copies and single rows included."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    x = np.concatenate([base[rng.integers(0, 12, 60)] + 0.08 * rng.normal(size=(60, 8)), base[:3], base[:3]])
    labels = [i % 2 for i in range(60)] + [0] * 6
    classes = vectors(spark, [(i, v.tolist(), n) for i, (v, n) in enumerate(zip(x, labels, strict=True))]).groupBy(F.col("label").cast("string").alias("label"), F.col("embedding").alias("v")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = classes.withColumn("node", F.struct("label", "rep", F.xxhash64("v").alias("h")))
    out = _tiled_links(classes, 0.98, tile).collect()
    true, _ = links_by_hand(x, labels)
    got = collections.Counter()
    for r in out:
        got[r.node.rep] += r.n
    sizes = {r.rep: r["size"] for r in classes.collect()}
    assert {i: got[i] + sizes[i] - 1 for i in sizes} == {i: true[i] for i in sizes}
    assert any(r.other for r in out)


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(50, 51), (51, 50), (60, 60), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10, 41), 10), 50: 50, 51: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs, ids = spark.read.parquet(f"{DATA}/documents.parquet"), None
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == cp.COLUMNS, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids is None or now <= ids
        docs, ids = out, now
    packed = cp.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_mixing_to_targets", "op9_size_tiered_shards"])
def test_queries_keep_every_document(spark, name):
    assert QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, personal data and near copies through each stage, held against plain Python."""
    import random

    import corpus_pipeline as cp
    from test_text_operators import brute_components, brute_spans

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    texts = [" ".join(word() for _ in range(30)) + f" mail ann{i}@ex.com ip 1.2.3.{i}" for i in range(60)]
    texts += [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(8)] + [None, "", "  ", "one two"]
    bad = range(len(texts), len(texts) + 12)
    texts += [f"!!!! #### {'%' * (i + 3)} $$ " * 30 for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    labels = [(i, 1, int(i % 6 == 0)) for i in range(60)] + [(i, 0, 0) for i in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.unionByName(spark.createDataFrame([(None, "a b c d e f", "en", "s", 11), (3, texts[3], "en", "s", 5)], schema))
    outs = {name: stage(spark, odd, str(tmp_path)) for name, stage in cp.STAGES}
    assert all(out.columns == cp.COLUMNS for name, out in outs.items() if name != "packing")
    kept = [r.doc_id for r in outs["near_duplicates"].collect()]
    assert sorted(x for x in kept if x is not None) == sorted([3] + [i for i, (_, c) in brute_components(texts).items() if c == i]) and kept.count(None) == 1
    clean = {r.doc_id: r for r in outs["personal_data"].collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for kind, a, b in sorted((s.split(":") for s in brute_spans(t).split(",") if s), key=lambda x: int(x[1])):
            if int(a) >= at:
                out += t[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        want = None if t is None else out + t[at:]
        assert clean[i].text == want and clean[i].n_chars == (None if t is None else len(want))
    for name in ("personal_data", "packing"):
        assert {r.doc_id for r in outs[name].select("doc_id").distinct().collect()} == {None, *range(len(texts))}
    mixed = {r.doc_id for r in outs["mixing"].select("doc_id").distinct().collect()}
    assert {i for i in range(60) if i % 6} <= mixed
    good = {r.doc_id for r in outs["quality"].collect()}
    assert set(range(60)) <= good and not good & set(bad)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
