"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.alignment import align_documents
from tessera.llm.common import crc_bucket, new_path, read_table
from tessera.llm.itq_dedup import near_duplicate_vectors
from tessera.llm.jaccard_join import jaccard_classes
from tessera.llm.mixing import mix_to_targets
from tessera.llm.packing import pack
from tessera.llm.pii import KINDS, as_text, count_of, find_personal_data
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.resampling import importance_resample
from tessera.llm.sharding import arrive_and_compact
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.token_files import write_token_files
from tessera.llm.topk_search import scaled_integers, top_k
from tessera.llm.toxicity import count_trigrams, fit_toxicity, language_model, score_toxicity


def _scored(rows: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    return rows.select("doc_id", (crc_bucket("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


#: Wanted shares of tokens by domain.
WEIGHTS = {"good": 0.90, "toxic": 0.04, "poor": 0.06}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: poor where the quality label is 0, else toxic or good."""
    domain = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null")


def op1_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mix_to_targets(docs, labelled_domains(read_table(spark, sf_dir, "labels")), WEIGHTS, "good")
    return mixed.select("doc_id", "n_tokens", "domain", "posterior", "rate", "copies")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("text")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return _scored(score_quality(docs, model).drop("text"), 5, 0, 0.3)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lm = language_model(count_trigrams(docs))
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), lm)
    return _scored(score_toxicity(docs, model, lm).drop("text"), 3, 1, 0.7)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled_integers(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024.0)
    return top_k(vectors, vectors.where("id % 100 = 0"), 10)


def op9_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = arrive_and_compact(read_table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    return store.read().select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return store.read().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    aligned = align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_mixing_to_targets": op1_mixing_to_targets,
    "op2_pii": op2_pii,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_exact_topk": op7_exact_topk,
    "op8_toxicity": op8_toxicity,
    "op9_size_tiered_shards": op9_size_tiered_shards,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_token_files": op12_token_files,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

_SETS = """WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(10))] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], chr(10))) END) AS s FROM w)"""
_REACH = """e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)"""
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: crc32 of each distinct word: a table of 256 remainders by its rule, then one step per byte.
_CRC = """words AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
crc AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) + 1, 2), lambda k: ('0x' || substr(h, k, 2))::BIGINT)), lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)]))) % 10000 AS bucket FROM words, steps)"""
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

#: DuckDB SQL for those that SQL can express on whole tables in reasonable time.
ORACLES: dict[str, str] = {
    "op6_ngram_jaccard_join": _SETS.replace("WITH w", "WITH RECURSIVE w", 1) + """,
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) + any_value(q.n) AS total, count(*) AS common FROM x p JOIN x q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2) WHERE 100 * common >= 80 * (total - common)),
""" + _REACH + " SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN c ON doc_id = x",
    "op7_exact_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS z FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.z, v.z)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM p) WHERE rank <= 10""",
    "op9_size_tiered_shards": "SELECT doc_id, sha256(text) AS text_sha256, strlen(text)::BIGINT AS n_bytes FROM documents",
    "op10_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id WHERE list_cosine_similarity(p.z, q.z) >= 0.98),
""" + _REACH + """, n AS (SELECT a AS x, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM embeddings LEFT JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x""",
    "op11_importance_resampling": f"""WITH d AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), b AS (SELECT unnest({_WORDS}) AS w FROM benchmark), {_CRC},
s AS (SELECT bucket, count(*) AS s FROM d JOIN crc USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (w) GROUP BY 1),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN crc USING (w) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT documents.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, rank FROM x LEFT JOIN (SELECT doc_id, rank FROM r WHERE rank <= 10 * n // 100) USING (doc_id)""",
}
