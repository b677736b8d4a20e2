"""Personal data in texts, with DataFrame functions alone.

Base spans follow four fixed grammars and their validators. High-recall generators propose more spans, which may
overlap: the same kinds written in other ways. Gradient-boosted trees score each by format and context; a span is taken
if it reaches its kind's calibrated threshold and overlaps no span taken before it. The trees learn from real matches
of the base grammars rewritten in those other ways, valid ones against rejected ones and against plain prose, each in
the context where it stood.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: The base grammars, leftmost and non-overlapping. Possessive repeats and looks behind change no match; they keep
#: the search linear on long runs of one class.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that hold for every text with a match.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_FOUR = r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"  # of an ip; it starts at a digit, so the search has nothing to look back for
#: Generators beyond the base grammars: other ways of writing the same kinds.
WIDER = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20@\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){2}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
}
#: Plainer searches that hold for every text with a match: few texts pass them, and only those are searched for the whole.
FIRST = {
    "email": lambda text: F.contains(text, F.lit(" @ ")) | text.rlike(r"[\[(]\x20?at\x20?[\])]"),
    "ip": lambda text: F.contains(text, F.lit("[.]")) | F.contains(text, F.lit("(.)")),
    "card": lambda text: text.rlike(r"[0-9][./_][0-9]{4}[./_][0-9]"),
    "phone": lambda text: text.rlike(r"[0-9]{3}[-.\x20][0-9]{4}"),
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
FEATURES = [
    "is_email", "is_ip", "is_card", "is_phone", "n_groups", "longest_group", "largest_group", "checksum", "letter_before", "letter_after", "digit_before", "digit_after",
    "spaced", "distinct_digits", "local_length", "labels", "ending_length", "ending_odds", "word_odds",
]


def matches(text: Column, pattern: str, hint: str, first: Column | None = None) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, value), in code points, end exclusive. Where ``first`` or the ``hint`` don't hold there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("spans"))

    def add(acc, x):
        first = acc["at"] + x["gap"]
        end = first + F.char_length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(first.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    spans = F.aggregate(pairs, start, add, lambda acc: acc["spans"])
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    likely = F.contains(text, F.lit(hint)) if first is None else F.contains(text, F.lit(hint)) & first
    return F.when(likely & text.rlike(pattern), spans).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    n = F.char_length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.coalesce(F.call_function("luhn_check", F.when(n.between(13, 19), digits(value)).otherwise("x")), F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with arrays ``_pii_base`` (valid spans: kind, start, end, value) and ``_pii_failed`` (matches of a grammar that its validator rejects), by kind and start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumns({f"_pii_{k}": matches(text, BASE[k], HINT[k], text.rlike(_FOUR) if k == "ip" else None) for k in KINDS})

    def named(kind: str, keep: bool) -> Column:
        chosen = F.filter(F.col(f"_pii_{kind}"), lambda x: valid(kind, x["value"]) if keep else ~valid(kind, x["value"]))
        return F.transform(chosen, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    docs = docs.withColumns({"_pii_base": F.concat(*(named(k, True) for k in KINDS)), "_pii_failed": F.concat(*(named(k, False) for k in KINDS))})
    return docs.drop(*(f"_pii_{k}" for k in KINDS))


def wider_spans(text: Column) -> Column:
    """Proposals of the wider generators: (kind, start, end, value). They may overlap anything."""

    def named(kind: str) -> Column:
        return F.transform(matches(text, WIDER[kind], "", FIRST[kind](text)), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    arrays = [named(kind) for kind in KINDS]
    return F.concat(*arrays)


def _around(text: Column, start: Column, end: Column) -> list[Column]:
    before = F.substring(text, F.greatest(start - 15, F.lit(1)), F.least(F.lit(16), start))
    return [before.alias("before"), F.substring(text, end + 1, F.lit(16)).alias("after")]


def ending_of(value: Column) -> Column:
    """What follows the last point of an address, lower case."""
    return F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))


def word_before(before: Column) -> Column:
    return F.lower(F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1))


def rewritten(kind: Column, value: Column, style: Column) -> Column:
    """A match of a base grammar in one of the ways that the wider generators know, by ``style`` from 0 on; null where it has no such form."""
    d = digits(value)
    mail = F.when(style % 3 == 0, F.regexp_replace(value, "@", " [at] ")).when(style % 3 == 1, F.regexp_replace(F.regexp_replace(value, "@", " (at) "), r"\.([^.]*)$", " (dot) $1")).otherwise(F.regexp_replace(value, "@", " @ "))
    mark = F.when(style % 3 == 0, ".").when(style % 3 == 1, "/").otherwise("_")
    card = F.when(F.char_length(d).between(13, 16), F.concat_ws("", F.substring(d, 1, 4), mark, F.substring(d, 5, 4), mark, F.substring(d, 9, 4), mark, F.substring(d, 13, 4)))
    tail = F.expr("right(regexp_replace(value, '[^0-9]', ''), 10)")
    phone = F.when(F.char_length(d) >= 10, F.concat(F.when(style % 2 == 0, F.concat(F.lit("("), F.substring(tail, 1, 3), F.lit(") "))).otherwise(F.concat(F.substring(tail, 1, 3), F.lit("-"))), F.substring(tail, 4, 3), F.lit("-"), F.substring(tail, 7, 4)))
    ip = F.when(F.size(F.split(value, r"\.")) == 4, F.regexp_replace(value, r"\.", F.when(style % 2 == 0, F.lit("[.]")).otherwise(F.lit("(.)"))))
    return F.when(kind == "email", mail).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip)


def span_features(spans: DataFrame, endings: dict[str, float], words: dict[str, float]) -> DataFrame:
    """Format and context features of rows (kind, value, before, after). ``endings``, ``words``: learned log-odds of an address's ending and of the word before, 0 for others and where a row has them ``hidden``."""
    v, d = F.col("value"), digits(F.col("value"))
    groups = F.filter(F.split(v, "[^0-9]+"), lambda x: x != "")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    hidden = F.col("hidden") if "hidden" in spans.columns else F.lit(False)
    known = lambda odds: F.coalesce(F.when(~hidden, odds), F.lit(0.0))
    table = lambda of: F.create_map(*(F.lit(x) for k, y in sorted(of.items()) for x in (k, float(y)))) if of else F.expr("map('', 0.0D)")
    local = F.regexp_extract(v, r"^([A-Za-z0-9._%+-]+)", 1)
    columns = {f"is_{k}": flag(F.col("kind") == k) for k in KINDS}
    columns |= {
        "n_groups": F.size(groups).cast("double"),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, lambda x: F.char_length(x))), F.lit(0)).cast("double"),
        "largest_group": F.coalesce(F.array_max(F.transform(groups, lambda x: F.substring(x, 1, 9).cast("double"))), F.lit(0.0)),
        "checksum": flag(F.call_function("luhn_check", F.when(F.char_length(d).between(8, 30), d).otherwise("x"))),
        "letter_before": flag(F.col("before").rlike(r"\p{L}$")),
        "letter_after": flag(F.col("after").rlike(r"^\p{L}")),
        "digit_before": flag(F.col("before").rlike("[0-9]$")),
        "digit_after": flag(F.col("after").rlike("^[0-9]")),
        "spaced": flag(F.col("before").rlike(r"(?:^|\s)$")),
        "distinct_digits": F.size(F.array_distinct(F.split(d, ""))).cast("double"),
        "local_length": F.char_length(local).cast("double"),
        "labels": F.size(F.split(v, r"\.|dot")).cast("double"),
        "ending_length": F.char_length(ending_of(v)).cast("double"),
        "ending_odds": F.when(F.col("kind") == "email", known(F.try_element_at(table(endings), ending_of(v)))).otherwise(0.0),
        "word_odds": known(F.try_element_at(table(words), F.concat("kind", F.lit(" "), word_before(F.col("before"))))),
    }
    return spans.withColumns(columns)


@dataclass
class SpanModel:
    """Trees, what they know of endings and words, for each kind the least score that a proposal needs (over 1: none is taken), and precision and recall there on held-back rows."""

    trees: GBTClassificationModel | None
    least: dict[str, float]
    endings: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    held_back: dict[str, tuple[float, float]] = field(default_factory=dict)


def _odds(rows: DataFrame, key: Column, least: int, most: int) -> dict[str, float]:
    """Smoothed log-odds of label 1 by a key: the ``most`` commonest keys with ``least`` rows or more, so its size is bounded."""
    n = rows.groupBy(key.alias("key")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(most)
    return {r.key: r.odds for r in n.select("key", F.log((F.col("good") + 0.5) / (F.col("n") - F.col("good") + 0.5)).alias("odds")).collect() if r.key}


def training_rows(found: DataFrame, text: Column) -> DataFrame:
    """(kind, value, label, before, after, h, hidden): every match rewritten, and an address made of prose for each text that has the words."""
    both = found.where("size(_pii_base) > 0 or size(_pii_failed) > 0").withColumn("_pii_all", F.concat(F.transform("_pii_base", lambda x: x.withField("label", F.lit(1.0))), F.transform("_pii_failed", lambda x: x.withField("label", F.lit(0.0)))))
    real = both.select(text.alias("t"), F.explode("_pii_all").alias("s")).select("t", "s.*")
    real = real.select("kind", "value", "label", *_around(F.col("t"), F.col("start"), F.col("end")))
    # digits of a rejected or valid card are no telephone number
    other = real.where("kind = 'card'").withColumns({"kind": F.lit("phone"), "label": F.lit(0.0)})
    words = r"(\p{L}++\x20)([A-Za-z]{2,}+)\x20([A-Za-z]{2,}+)\.\x20?([A-Za-z]{2,}+)"
    # exploded, as a filter would search each text a second time
    prose = found.select(F.explode(F.filter(F.array(F.regexp_extract(text, words, 0)), lambda t: t != "")).alias("t"))
    part = lambda n: F.regexp_extract("t", words, n)
    prose = prose.select(F.lit("email").alias("kind"), F.concat(part(2), F.lit("@"), part(3), F.lit("."), F.lower(part(4))).alias("value"), F.lit(0.0).alias("label"), part(1).alias("before"), F.element_at(F.array(*map(F.lit, (" ", ". ", ", ", "\n", ""))), (F.pmod(F.xxhash64("t"), F.lit(5)) + 1).cast("int")).alias("after"))
    out = None
    for rows in (real, other, prose):
        rows = rows.withColumn("h", F.xxhash64("kind", "value", "before", "after"))
        out = rows if out is None else out.unionByName(rows)
    # names and hosts without digits, cut contexts and unknown words must look familiar too, so a share of the rows has them
    bare = F.expr("concat(left(regexp_extract(value, '^([A-Za-z]*)', 1), 2 + pmod(shiftright(h, 48), 9)), CASE WHEN pmod(shiftright(h, 20), 2) = 0 THEN substring(value, locate('@', value)) ELSE concat('@', regexp_extract(value, '([A-Za-z-]+[.][A-Za-z-]+)$', 1)) END)")
    value_starts = F.col("value").rlike("^[A-Za-z].*@.*[A-Za-z-]+[.][A-Za-z-]+$") & (F.pmod(F.shiftright("h", 16), F.lit(3)) > 0)
    out = out.withColumn("value", F.when((F.col("kind") == "email") & value_starts, bare).otherwise(F.col("value")))
    out = out.withColumn("style", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumns({"part": F.pmod("h", F.lit(3)), "h": F.xxhash64("h", "style")})
    value = rewritten(F.col("kind"), F.col("value"), F.col("style"))
    out = out.withColumns({"value": value, "before": F.expr("right(before, least(16, pmod(shiftright(h, 24), 34)))"), "after": F.expr("left(after, least(16, pmod(shiftright(h, 32), 34)))")})
    return out.withColumn("hidden", F.pmod(F.shiftright("h", 40), F.lit(3)) == 0).where("value is not null")


def fit_spans(found: DataFrame, text: Column, trees: int = 12, depth: int = 4, precision: float = 0.95) -> SpanModel:
    """Boosted trees on all rewritten matches (``training_rows``) but a third.

    The other third calibrates: a kind's threshold lies halfway between the least score from which on ``precision`` or more
    of the held-back rows are valid and the next score below it. Where none is, or only one label occurs, no proposal of that
    kind is taken.
    """
    rows = training_rows(found, text).persist(StorageLevel.DISK_ONLY)
    try:
        fit, held = rows.where("part > 0"), rows.where("part = 0")
        if fit.agg(F.countDistinct("label")).first()[0] < 2:
            return SpanModel(None, dict.fromkeys(KINDS, 2.0))
        endings = _odds(fit.where("kind = 'email'"), ending_of(F.col("value")), 1, 200)
        words = _odds(fit, F.concat("kind", F.lit(" "), word_before(F.col("before"))), 20, 200)
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
        ready = lambda df: vectors.transform(span_features(df, endings, words))
        # each label of each kind weighs the same, however rare its matches are
        each = fit.groupBy("kind", "label").agg(F.count("*").alias("n"))
        weighed = fit.join(F.broadcast(each.select("kind", "label", (1000.0 / F.col("n")).alias("weight"))), ["kind", "label"])
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label", weightCol="weight").fit(ready(weighed).select("label", "features", "weight"))
        scored = model.transform(ready(held)).select("kind", "label", F.round(vector_to_array("probability")[1], 3).alias("p"))
        down, every = Window.partitionBy("kind").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("kind")
        steps = scored.groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count("*").cast("double").alias("n"))
        steps = steps.withColumns({"share": F.sum("good").over(down) / F.sum("n").over(down), "recall": F.sum("good").over(down) / F.sum("good").over(every)})
        # between the last score that is good enough and the next below it
        steps = steps.withColumn("below", F.coalesce(F.lead("p").over(every.orderBy(F.desc("p"))), F.lit(0.0)))
        best = steps.where((F.col("share") >= precision) & (F.col("p") > 0.5)).groupBy("kind").agg(F.min_by(F.struct(F.greatest(F.lit(0.5), (F.col("p") + F.col("below")) / 2).alias("p"), "share", "recall"), "p").alias("b")).collect()
        least = dict.fromkeys(KINDS, 2.0) | {r.kind: r.b.p for r in best}
        return SpanModel(model, least, endings, words, {r.kind: (r.b.share, r.b.recall) for r in best})
    finally:
        rows.unpersist()


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end), by kind as in KINDS and then by start.

    ``base`` are the valid matches of the four grammars in the whole text; ``spans`` adds those proposals that the
    trees accept and that overlap neither a base span nor a proposal before them. Null texts count as empty. Every row is searched on its own, also
    where rows repeat; no rows, none. Columns ``base`` and ``spans`` are replaced, the others stay as they are. What is found is
    written once with a number for each row, so both ways to a row's spans see the same number.
    """
    docs = docs.drop("base", "spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.columns
    found = base_spans(docs, text_col).withColumn("_pii_open", _free(wider_spans(text), F.col("_pii_base"))).withColumn("_pii_row", F.monotonically_increasing_id())
    found = materialize(found, "spans")
    model = fit_spans(found, text)
    bare = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    if model.trees is None:
        return found.select(*kept, bare("_pii_base").alias("base"), bare("_pii_base").alias("spans"))
    # few texts have proposals; only those rows go through the trees
    proposed = found.where("size(_pii_open) > 0").select("_pii_row", text.alias("t"), F.explode("_pii_open").alias("s")).select("_pii_row", "t", "s.*")
    proposed = proposed.select("_pii_row", "kind", "start", "end", "value", *_around(F.col("t"), F.col("start"), F.col("end")))
    proposed = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(span_features(proposed, model.endings, model.words))
    least = F.create_map(*(F.lit(x) for k in KINDS for x in (k, float(model.least[k]))))
    taken = model.trees.transform(proposed).where(F.round(vector_to_array("probability")[1], 3) >= least[F.col("kind")])
    taken = taken.groupBy("_pii_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_pii_more"))
    joined = found.select(*kept, "_pii_row", bare("_pii_base").alias("_pii_base")).join(taken, "_pii_row", "left")
    more = F.coalesce(F.expr("filter(_pii_more, x -> not exists(_pii_more, y -> y.start < x.end and x.start < y.end and struct(y.start, -y.end, y.kind) < struct(x.start, -x.end, x.kind)))"), F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)"))
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    ranked = F.array_sort(F.transform(F.concat("_pii_base", more), lambda x: F.struct(order[x["kind"]].alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return joined.select(*kept, F.col("_pii_base").alias("base"), bare(ranked).alias("spans"))


def _by_start(x: Column, y: Column) -> Column:
    return F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["end"] > y["end"], -1).when(x["end"] < y["end"], 1).otherwise(0)


def _free(spans: Column, taken: Column) -> Column:
    """Those ``spans`` that overlap none of ``taken``."""
    return F.filter(spans, lambda x: ~F.exists(taken, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first is named and their union goes."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        keep = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        fresh = x["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], keep, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(F.array_sort(spans, _by_start), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
