"""Importance resampling towards a target corpus: hashed n-gram features, scored by what the target has more of.

1. Each text becomes an array of feature buckets; the table of buckets is written once and read from then on.
2. Bucket counts of the corpus and of the target give one gain per bucket: an array of ``buckets`` numbers, whatever the
   corpus. A document's weight is the sum of its buckets' gains, looked up in that array.
3. A draw without replacement by weight keeps the highest weight + Gumbel noise. The cutoff is bracketed by a quantile
   sketch; exact counts above and inside prove the bracket or widen it; only the rows inside are sorted to find the cutoff.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.operators.ranges import running_sums

#: Fixed value: what separates words once A-Z are lowered; digits, a-z and all beyond ASCII are inside words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of_text(text: Column) -> Column:
    """The words of a text, A-Z lowered; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def feature_buckets(words: Column, longest: int, buckets: int) -> Column:
    """Buckets of all runs of 1 to ``longest`` words, repeats kept."""
    bucket = lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int")
    if longest == 1:
        return F.transform(words, bucket)
    none = F.array().cast("array<int>")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))).otherwise(none)

    return F.concat(*(runs(n) for n in range(1, longest + 1)))


def features_of(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``texts`` with ``features`` and ``n_words`` for ``text``."""
    if longest == 1:
        out = texts.withColumn("features", feature_buckets(words_of_text(F.col("text")), 1, buckets))
        return out.withColumn("n_words", F.size("features").cast("long")).drop("text")
    out = texts.withColumn("_w", words_of_text(F.col("text")))
    return out.withColumns({"features": feature_buckets(F.col("_w"), longest, buckets), "n_words": F.size("_w").cast("long")}).drop("text", "_w")


def bucket_counts(featured: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs, as a list of ``buckets`` numbers."""
    found = featured.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    out = [0] * buckets
    for row in found.collect():  # one row per bucket at most
        out[row.bucket] = row.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of the smoothed ratio of shares) for each bucket: above 0 where the target has more of it."""
    s_all, t_all, n = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + float(n)) / ((s + 1.0) * (t_all + float(n))))) for s, t in zip(corpus, target, strict=True)]


def weighed(featured: DataFrame, gain: list[int]) -> DataFrame:
    """``featured`` with ``weight``: the sum of the gains of its features, 0 without any."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one constant array
    return featured.withColumn("weight", F.aggregate("features", F.lit(0).cast("bigint"), lambda total, b: total + F.get(table, b)))


def gumbel_noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256(``seed:key``)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def cutoff(rows: DataFrame, score: str, ties: list[str], k: int, error: float = 0.001) -> tuple | None:
    """(score, *ties) of row ``k`` by descending score, then ascending ``ties``; None where ``k`` is 0 or there is no such row.

    A sketch of the scores brackets the cutoff. Rows above the bracket and inside it are counted exactly; while the row
    isn't inside, the side that misses it is widened, at last to the end of the table. What is inside is sorted in ranges.
    """
    n = rows.count()
    if not 0 < k <= n:
        return None
    while True:
        share = 1 - k / n
        low, high = rows.approxQuantile(score, [max(0.0, share - 2 * error), min(1.0, share + 2 * error)], error)
        low, high = (None if share <= 3 * error else low), (None if share >= 1 - 3 * error else high)
        within = (F.lit(True) if low is None else F.col(score) >= low) & (F.lit(True) if high is None else F.col(score) <= high)
        above = F.lit(False) if high is None else F.col(score) > high
        outside, inside = rows.agg(F.count_if(above), F.count_if(within)).first()
        if outside < k <= outside + inside:
            break
        error *= 4
    bracket = rows.where(within).select(score, *ties)
    found = running_sums(bracket, -F.col(score), ties, {"_n": F.lit(1)}).where(F.col("_n") == k - outside).first()
    return tuple(found[c] for c in (score, *ties))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_features, weight, score and rank (null where not drawn).

    Of the N documents of at least ``least_words`` words, floor(percent * N / 100) are drawn, the highest scores first.
    Equal scores go by the smaller id; rows that also share the id by fewer features, then the smaller weight, and rows
    equal in all of it take ranks in any order. Null and empty texts have no features, weight 0, and are never drawn. A
    row with a null id keeps its features and weight but has no score and isn't counted in N. Texts count whole. No rows,
    or a target without text, give a defined result too (no rows; gains from smoothing alone). Other columns are ignored.
    """
    featured = materialize(features_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), longest, buckets), "features")
    gain = gains(bucket_counts(featured, buckets), bucket_counts(features_of(target.select("text"), longest, buckets), buckets))
    score = (F.col("weight") + gumbel_noise(F.col("doc_id"), seed)).alias("score")
    scored = weighed(featured, gain).select("doc_id", F.size("features").cast("long").alias("n_features"), "weight", score, (F.col("n_words") >= least_words).alias("long_enough"))
    scored = materialize(scored, "scores")
    able = scored.where("long_enough and doc_id is not null")
    ties = ["doc_id", "n_features", "weight"]
    last = cutoff(able, "score", ties, able.count() * percent // 100)
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*out, none)
    first = F.struct((-F.col("score")).alias("s"), *ties) <= F.struct(F.lit(-last[0]).cast("long").alias("s"), *(F.lit(x).cast("long").alias(c) for c, x in zip(ties, last[1:], strict=True)))
    drawn = F.coalesce(F.col("long_enough") & F.col("doc_id").isNotNull() & first, F.lit(False))
    ranked = running_sums(scored.where(drawn).select(*out), -F.col("score"), ties, {"rank": F.lit(1)})
    return ranked.select(*out, F.col("rank").cast("long").alias("rank")).unionByName(scored.where(~drawn).select(*out, none))
