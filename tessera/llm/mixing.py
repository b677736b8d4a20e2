"""Soft-membership mixing: documents get rates so that expected domain token totals match targets.

A classifier learned from a labelled table gives each document its posterior over domains. Rates are nonnegative and
least-squares optimal: projected gradient steps from rate 1, distributed over the documents. Steps are added up before the
projection, so all that they leave behind is one number per domain: a rate is 1 less the posterior times that sum, or its
bound where that is lower. The driver sees one sum per domain and pair of domains in each step.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_materialized, materialize, text_runs
from tessera.llm.nbsvm import LinearModel, fit_on_sample
from tessera.llm.quality import SIZE, quality_features
from tessera.llm.shingles import words_of


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], most_rows: int = 6_000) -> list[LinearModel]:
    """One linear model per domain against the others, from at most ``most_rows`` rows of ``labelled(doc_id, domain)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    number = F.create_map(*(F.lit(x) for i, d in enumerate(domains) for x in (d, i)))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), number[F.col("domain")].cast("int").alias("label"))
    return fit_on_sample(docs, known, F.lit(True), quality_features, SIZE, most_rows, classes=len(domains))


def memberships(docs: DataFrame, models: list[LinearModel]) -> DataFrame:
    """``docs`` with ``n_tokens`` (words between white space) and ``posterior`` (array, adds up to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kept = docs.columns

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            counts = np.concatenate([np.bincount(words_of(data, offsets)[2], minlength=j - i) for i, j, data, offsets in text_runs(text)] or [np.zeros(0, np.int64)])
            out = []
            for x in quality_features(text):
                p = np.array([m.score(x) for m in shared.value]) + 1e-6
                out.append((p / p.sum()).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts.astype(np.int64)), pa.array(out, pa.list_(pa.float64()))], [*kept, "n_tokens", "posterior"])

    schema = docs.withColumns({"n_tokens": F.lit(0).cast("long"), "posterior": F.array(F.lit(0.0))}).schema
    return docs.mapInArrow(run, schema)


def _dot(values: np.ndarray) -> Column:
    """The posterior times ``values``."""
    return sum((F.element_at("posterior", d + 1) * float(v) for d, v in enumerate(values)), F.lit(0.0))


def _bound(least: Column | None) -> Column:
    return F.lit(0.0) if least is None else least


def rate_after(steps: np.ndarray, least: Column | None = None) -> Column:
    """A document's rate after steps that add up to ``steps``: 1 less its share of them, but not below ``least`` (0 by default)."""
    return F.greatest(_bound(least), 1.0 - _dot(steps))


def likeliest() -> Column:
    """The number of a document's likeliest domain, from 1."""
    return F.array_position("posterior", F.array_max("posterior")).cast("int")


def fit_rates(soft: DataFrame, targets: np.ndarray, tolerance: float = 1e-3, most_steps: int = 500, least: Column | None = None) -> np.ndarray:
    """The sum of projected gradient steps that minimises sum_d (sum_i rate_i tokens_i posterior_id - target_d)^2 / target_d.

    Of the rates that reach the minimum it leads to those nearest 1, documents weighing by their tokens: the distance to 1 has
    a weight that goes down to 1e-7, each time from where the last one ended. A gradient is scaled by what documents that
    aren't at their bound can change (at first by the Gram matrix of all), and a step that lowers too little is tried at half
    its length; with the weight above 0 the scaled gradient always descends. A weight is done when its gradient is gone, all
    when every total is within ``tolerance`` of its target. If the least squares themselves miss a target, a warning names the
    totals; the rates are optimal all the same. ``most_steps`` is a guard that a warning names too.
    """
    k = len(targets)
    scale = np.maximum(targets, 1.0)  # 1 over the weight of a domain
    p = [F.element_at("posterior", d + 1) for d in range(k)]

    def look(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """At a sum of steps: what the gradient below is the slope of, the totals, and the Gram matrix of documents above their bound."""
        z, low = _dot(at), _bound(least)
        free = 1.0 - z > low
        n = F.col("n_tokens")
        held = soft.select("n_tokens", "posterior", z.alias("z"), low.alias("low"), free.alias("free"), F.greatest(low, 1.0 - z).alias("r"))
        z, low, free = F.col("z"), F.col("low"), F.col("free")
        value = F.when(free, z * z / 2 - z).otherwise((low * low - 1) / 2 - low * (z - 1 + low))
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        row = held.agg(F.sum(n * value), *(F.sum(n * F.col("r") * x) for x in p), *(F.sum(F.when(free, n * p[a] * p[b])) for a, b in pairs)).first()
        got = np.array([x or 0.0 for x in row])
        gram = np.zeros((k, k))
        for (a, b), x in zip(pairs, got[1 + k :], strict=True):
            gram[a, b] = gram[b, a] = x
        return float(got[0] + targets @ at), got[1 : 1 + k], gram

    close = lambda t: bool((np.abs(t - targets) <= tolerance * scale).all())
    at, taken = np.zeros(k), 0
    value, totals, gram = look(at)
    for weight in (1e-1, 1e-3, 1e-5, 1e-7):
        slope = weight * scale * at + targets - totals
        while not close(totals) and (np.abs(slope) > 1e-6 * scale).any() and taken < most_steps:
            way = -np.linalg.solve(gram + weight * np.diag(scale), slope)
            now, length = value + weight * (scale * at * at).sum() / 2, 1.0
            while taken < most_steps:
                taken += 1
                new = at + length * way
                found = look(new)
                if found[0] + weight * (scale * new * new).sum() / 2 <= now + 1e-4 * length * (slope @ way) + 1e-12 * abs(now):
                    break
                length /= 2
            at, (value, totals, gram) = new, found
            slope = weight * scale * at + targets - totals
            if length < 1e-9:
                break
    if not close(totals):
        warnings.warn(f"rates miss their targets{' after most_steps' if taken >= most_steps else ''}: totals {totals.round(1).tolist()}, targets {np.round(targets, 1).tolist()}", stacklevel=2)
    return at


def mix_to_targets(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str, anchor_scale: float = 1.0, most_rows: int = 6_000, keep_anchor: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``n_tokens``, ``domain`` (likeliest), ``posterior``, ``rate`` and ``copies``.

    ``weights`` are the wanted shares of tokens by domain. The budget is such that ``anchor`` keeps ``anchor_scale``
    times the tokens it has. ``copies`` is the rate, rounded down or up by a hash of the id so that its mean is the rate.
    With ``keep_anchor`` no document whose likeliest domain is ``anchor`` has a rate below 1; the other rates meet the
    targets as closely as that allows. Domains without labelled rows get weight none; without any, every rate is 1. Empty and null texts have 0 tokens.
    Every row has a rate of its own, also where rows repeat; a null id rounds like any other; no rows, none. Columns of
    ``docs`` with the names of the five new ones are replaced.
    """
    docs = docs.drop("n_tokens", "domain", "posterior", "rate", "copies")
    seen = {r.domain for r in labelled.select("domain").distinct().collect() if r.domain in weights}
    domains = sorted(seen)
    if len(domains) < 2:
        one = docs.withColumns({"n_tokens": F.size(F.expr("filter(split(coalesce(text, ''), '[ \\\\t-\\\\r]+'), x -> x <> '')")).cast("long"), "domain": F.lit(domains[0] if domains else None).cast("string"), "posterior": F.array(F.lit(1.0)), "rate": F.lit(1.0), "copies": F.lit(1)})
        return one
    soft = memberships(docs, fit_domains(docs, labelled, domains, most_rows))
    soft = materialize(soft, "memberships")
    facts = materialize(soft.select("n_tokens", "posterior"), "posteriors")
    natural = facts.agg(*(F.sum(F.col("n_tokens") * F.element_at("posterior", d + 1)) for d in range(len(domains)))).first()
    share = np.array([weights[d] for d in domains], float)
    share /= share.sum()
    budget = anchor_scale * (natural[domains.index(anchor)] or 0.0) / share[domains.index(anchor)] if anchor in domains else sum(x or 0.0 for x in natural)
    least = F.when(likeliest() == domains.index(anchor) + 1, 1.0).otherwise(0.0) if keep_anchor and anchor in domains else None
    steps = fit_rates(facts, share * budget, least=least)
    drop_materialized(facts)
    unit = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = soft.withColumns({"domain": F.element_at(F.array(*map(F.lit, domains)), likeliest()), "rate": rate_after(steps, least)})
    return out.withColumn("copies", F.floor(F.col("rate") + unit).cast("int"))
