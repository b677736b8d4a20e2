"""Near-duplicate vectors by iterative quantisation: a learned rotation gives balanced binary codes, multi-index
Hamming tables give candidates, and the original vectors decide.

How many tables and how wide a radius the codes need depends on the vectors: where those of a label share a mean or few
directions, vectors within the cosine differ in many bits. So the choice is measured on the sample that the rotation is
learned from, label by label: on pairs that reach the cosine, and on pairs set exactly at it along differences of the
label's vectors. Labels whose pairs no affordable choice finds, and labels that the sample barely holds, are compared
exactly in tiles; a tile gives link counts and a spanning forest, not its links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_materialized, materialize, mix
from tessera.llm.components import connected_components


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions, then the rotation that brings projections closest to their signs."""
    mean = x.mean(0)
    centred = x - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    directions = directions[:, ::-1][:, :bits]
    v = centred @ directions
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, directions @ r


def table_keys(codes: np.ndarray, tables: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For boolean codes (n, bits): keys (n, tables) of the parts, and keys (n, tables, probes) within ``radius`` (0 to 2) flips of them."""
    n, bits = codes.shape
    own, near = [], []
    for t, part in enumerate(np.array_split(np.arange(bits), tables)):
        weights = np.uint64(1) << np.arange(len(part), dtype=np.uint64)
        value = (codes[:, part] * weights).sum(1, dtype=np.uint64) if len(part) else np.zeros(n, np.uint64)
        flips = [np.uint64(0)]
        if radius >= 1:
            flips += list(weights)
        if radius >= 2:
            flips += [a ^ b for i, a in enumerate(weights) for b in weights[:i]]
        own.append(mix(value, 300 + t))
        near.append(mix(value[:, None] ^ np.array(flips, np.uint64)[None, :], 300 + t))
    width = max(x.shape[1] for x in near)
    near = [np.concatenate([x, np.repeat(x[:, :1], width - x.shape[1], axis=1)], axis=1) for x in near]
    return np.stack(own, 1).view(np.int64), np.stack(near, 1).view(np.int64)


#: (tables, radius) that are tried.
CHOICES = [(4, 1), (5, 1), (4, 2), (6, 1), (5, 2), (6, 2)]
RECALL = 0.97


def trial_pairs(x: np.ndarray, cosine: float, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors like ``x`` to measure recall on: up to ``n`` of its own that reach ``cosine``, and ``n`` set exactly at it."""
    own = x[rng.permutation(len(x))[:2_000]]
    i, j = np.nonzero(np.triu(own @ own.T >= cosine, 1))
    some = rng.permutation(len(i))[:n]
    at, u, v = (rng.integers(0, len(x), n) for _ in range(3))
    way = x[u] - x[v]
    flat = np.abs(way).max(1) < 1e-9
    way[flat] = rng.normal(size=(int(flat.sum()), x.shape[1]))
    way -= (way * x[at]).sum(1, keepdims=True) * x[at]
    length = np.linalg.norm(way, axis=1, keepdims=True)
    ok = length[:, 0] > 1e-9
    other = cosine * x[at][ok] + np.sqrt(1 - cosine**2) * way[ok] / length[ok]
    return np.concatenate((own[i[some]], x[at][ok])), np.concatenate((own[j[some]], other))


def part_distances(a: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
    """The least number of bits that differ in any of the parts, for each pair of codes."""
    return np.min([(a[:, part] != b[:, part]).sum(1) for part in np.array_split(np.arange(a.shape[1]), tables)], axis=0)


def choose_tables(x: np.ndarray, labels: np.ndarray, codes, cosine: float, seed: int = 0) -> tuple[int, int, list[str]]:
    """(tables, radius, labels that they serve): the choice with the fewest pairs to compare, where labels it fails are compared whole."""
    rng, found = np.random.default_rng(seed), {}
    names, counts = np.unique(labels, return_counts=True)
    each = int(np.clip(40_000 // max(1, len(names)), 20, 400))
    for name in names[counts >= 3]:
        own = x[labels == name]
        a, b = (codes(y) for y in trial_pairs(own, cosine, each, rng))
        c, d = (codes(own[rng.integers(0, len(own), 200)]) for _ in range(2))
        found[name] = [((part_distances(a, b, t) <= r).mean() if len(a) else 0.0, (part_distances(c, d, t) <= r).mean()) for t, r in CHOICES]
    weight = dict(zip(names, (counts / counts.sum()) ** 2, strict=True))
    cost = [sum(weight[n] * (m[k][1] if m[k][0] >= RECALL else 1.0) for n, m in found.items()) for k in range(len(CHOICES))]
    best = int(np.argmin(cost))
    return *CHOICES[best], [n for n, m in found.items() if m[best][0] >= RECALL and m[best][1] < 0.5]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of a list column, and where each list starts and how long it is."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values), offsets[:-1].astype(np.int64), np.diff(offsets)


def near_duplicate_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, bits: int = 64, sample: int = 20_000, tile: int = 512) -> DataFrame:
    """One row per row: (id_col, n_links, component_id, kept), by links of cosine >= ``cosine`` between rows of one label.

    Vectors that are null, zero, or hold a null, NaN or infinite component, and rows with a null label or id, link with
    nothing (component_id is their own id, kept is true; for a null id both are null). Labels may have any type that casts
    to text. Equal vectors of one label form a class that is searched once. Vectors of different lengths don't link, nor do
    rows of different labels, also where they share an id. The rotation and the tables are learned from at most ``sample``
    vectors (smallest ids by hash); every vector is indexed. Of rows with one id each counts. Other columns are ignored, no
    rows give none. As ``n_links`` counts direct links, each pair of near classes is compared.
    """
    v = F.col(vector_col)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("ok", F.coalesce(F.expr("id is not null and label is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"), F.lit(False)))
    classes = materialize(rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("size")).withColumn("node", F.struct("label", "rep", F.xxhash64("v").alias("h"))), "vectors")

    def learn(batches):
        found: dict[int, list[tuple[str, np.ndarray]]] = {}
        for batch in batches:
            for label, x in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
                found.setdefault(len(x), []).append((label, np.array(x)))
        for dim, held in found.items():
            x, labels = _unit(np.stack([y for _, y in held])), np.array([n for n, _ in held], object)
            mean, projection = learn_rotation(x, min(bits, dim))
            tables, radius, served = choose_tables(x, labels, lambda y: (y - mean) @ projection >= 0, cosine)
            yield pa.RecordBatch.from_pydict({"dim": [dim], "mean": [mean.tobytes()], "projection": [projection.tobytes()], "tables": [tables], "radius": [radius], "served": [served]}, schema=pa.schema([("dim", pa.int32()), ("mean", pa.binary()), ("projection", pa.binary()), ("tables", pa.int32()), ("radius", pa.int32()), ("served", pa.list_(pa.string()))]))

    chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("label", "v")
    learned = chosen.coalesce(1).mapInArrow(learn, "dim int, mean binary, projection binary, tables int, radius int, served array<string>").collect()
    model = {r.dim: (np.frombuffer(r.mean), np.frombuffer(r.projection).reshape(r.dim, -1), r.tables, r.radius, set(r.served)) for r in learned}
    shared = table.sparkSession.sparkContext.broadcast(model)

    def hashed(batches):
        for batch in batches:
            vectors, labels = batch.column("v").to_pylist(), batch.column("node").field("label").to_pylist()
            own, near = [None] * len(vectors), [None] * len(vectors)
            by_dim: dict[int, list[int]] = {}
            for i, x in enumerate(vectors):
                if len(x) in shared.value and labels[i] in shared.value[len(x)][4]:
                    by_dim.setdefault(len(x), []).append(i)
            for dim, at in by_dim.items():
                mean, projection, tables, radius, _ = shared.value[dim]
                a, b = table_keys((_unit(np.array([vectors[i] for i in at])) - mean) @ projection >= 0, tables, radius)
                for k, i in enumerate(at):
                    own[i], near[i] = a[k].tolist(), b[k].ravel().tolist()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))], ["node", "own", "near"])

    node = "struct<label:string,rep:bigint,h:bigint>"
    keys = materialize(classes.select("node", "v").mapInArrow(hashed, f"node {node}, own array<long>, near array<long>"), "codes")
    index = keys.select(F.col("node.label").alias("label"), F.explode("own").alias("key"), F.col("node").alias("b"))
    probes = keys.select(F.col("node.label").alias("label"), F.explode(F.array_distinct("near")).alias("key"), F.col("node").alias("a"))
    pairs = probes.join(index, ["label", "key"]).where("a < b").select("a", "b").distinct()
    sides = [classes.select(F.col("node").alias(x), F.col("v").alias(f"v{x}"), F.col("size").alias(f"size_{x}")) for x in ("a", "b")]

    def compare(batches):
        for batch in batches:
            flat, starts, lengths = zip(*(_lists(batch.column(c)) for c in ("va", "vb")), strict=True)
            keep = np.zeros(batch.num_rows, bool)
            for dim in np.unique(lengths[0][lengths[0] == lengths[1]]):
                at = np.flatnonzero((lengths[0] == dim) & (lengths[1] == dim))
                x, y = (f[s[at][:, None] + np.arange(dim)] for f, s in zip(flat, starts, strict=True))
                x, y = (z / np.abs(z).max(1, keepdims=True) for z in (x, y))
                keep[at] = (x * y).sum(1) >= cosine * np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
            yield batch.filter(pa.array(keep)).select(["a", "b", "size_a", "size_b"])

    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "va", "vb", "size_a", "size_b")
    links = materialize(both.mapInArrow(compare, f"a {node}, b {node}, size_a long, size_b long"), "links")
    ends = links.select(F.col("a").alias("node"), F.col("size_b").alias("n")).unionByName(links.select(F.col("b").alias("node"), F.col("size_a").alias("n")))
    tiled = materialize(_tiled_links(classes.join(keys.where("own is null").select("node"), "node", "left_semi"), cosine, tile), "tiles")
    ends = ends.unionByName(tiled.where("other is null").select("node", "n"))
    counts = ends.groupBy("node").agg(F.sum("n").alias("others"))
    component = connected_components(links.select("a", "b").unionByName(tiled.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))))
    placed = classes.join(counts, "node", "left").join(component, "node", "left")
    placed = placed.select("label", "v", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "node")["rep"].alias("component"))
    valid = rows.where("ok").join(placed, ["label", "v"]).select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = materialize(valid.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")), "near")
    for done in (classes, keys, links, tiled):
        drop_materialized(done)
    return out


def _tiled_links(classes: DataFrame, cosine: float, tile: int) -> DataFrame:
    """(node, other, n): rows without ``other`` add ``n`` linked rows to a class; those with it connect two classes of one component.

    The classes of a label and length are dealt into tiles of about ``tile``; each pair of tiles is one matrix product. A
    class is copied once per tile of its own label.
    """
    dealt = classes.withColumn("dim", F.size("v"))
    tiles = dealt.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = dealt.join(tiles, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    columns = ["label", "dim", "node", "v", "size"]
    left = dealt.select(*columns, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("tiles") - 1)).alias("j"))
    right = dealt.select(*(F.col(c).alias(f"{c}_") for c in columns), F.explode(F.sequence(F.lit(0), "own")).alias("i_"), F.col("own").alias("j_"))

    kind = pa.struct([("label", pa.string()), ("rep", pa.int64()), ("h", pa.int64())])

    def product(key, a: pa.Table, b: pa.Table):
        if not (a.num_rows and b.num_rows):
            return pa.table({"node": pa.array([], kind), "other": pa.array([], kind), "n": pa.array([], pa.int64())})
        x, y = (_unit(np.array(t.column(c).to_pylist())) for t, c in ((a, "v"), (b, "v_")))
        same = key[2].as_py() == key[3].as_py()
        near = x @ y.T >= cosine
        if same:
            order = {n: k for k, n in enumerate(map(str, b.column("node_").to_pylist()))}
            near[np.arange(len(x)), [order[str(n)] for n in a.column("node").to_pylist()]] = False
        nodes = [*a.column("node").to_pylist(), *b.column("node_").to_pylist()]
        n = np.concatenate((near @ a_sizes(b, "size_"), near.T @ a_sizes(a, "size")))
        if same:
            n[len(x) :] = 0
        # the least number that reaches each row, over and over until nothing changes
        low = np.arange(len(nodes))
        while True:
            down = np.where(near, low[: len(x), None], len(nodes)).min(0, initial=len(nodes))
            to_b = np.minimum(low[len(x) :], down)
            to_a = np.minimum(low[: len(x)], np.where(near, to_b[None, :], len(nodes)).min(1, initial=len(nodes)))
            new = np.concatenate((to_a, to_b))
            if (new == low).all():
                break
            low = new
        counted, joined = np.flatnonzero(n), np.flatnonzero(low != np.arange(len(nodes)))
        return pa.table({
            "node": pa.array([nodes[k] for k in (*counted, *joined)], kind), "other": pa.array([*[None] * len(counted), *(nodes[low[k]] for k in joined)], kind),
            "n": pa.array([*n[counted].tolist(), *[0] * len(joined)], pa.int64()),
        })

    def a_sizes(t: pa.Table, column: str) -> np.ndarray:
        return t.column(column).to_numpy()

    node = "struct<label:string,rep:bigint,h:bigint>"
    groups = left.groupBy("label", "dim", "i", "j").cogroup(right.groupBy("label_", "dim_", "i_", "j_"))
    return groups.applyInArrow(product, f"node {node}, other {node}, n long")
