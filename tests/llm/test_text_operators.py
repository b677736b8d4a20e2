"""Operators over texts against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import warnings
import zlib
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tessera.llm import suffix_dedup
from tessera.llm.jaccard_join import _beyond_buckets, _own_shingles, _pairs_across, _texts_of, _unlike, jaccard_classes
from tessera.llm.mixing import fit_rates, likeliest, mix_to_targets, rate_after
from tessera.llm.packing import pack, two_fit_plan
from tessera.llm.pii import as_text, find_personal_data, redact
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.sharding import ShardStore, arrive_and_compact
from tessera.llm.suffix_dedup import SuffixLevels, remove_repeats, repeated_windows
from tessera.llm.tokens import Encoder
from tessera.llm.toxicity import count_trigrams, decode, fit_toxicity, language_model, restore, Restorer, score_toxicity

SCHEMA = "doc_id long, text string, id string, sig int, n int"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, texts, ids=None):
    """Rows with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts = [prose(rng, rng.randint(1, 120), words) for _ in range(60)]
    base = prose(rng, 90, words).split()
    for _ in range(45):  # a template with edits: some link, some only through others
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    shared = prose(rng, 40, words)
    texts += [prose(rng, 25, words) + " " + shared + " " + prose(rng, 25, words) for _ in range(12)]
    texts += texts[:5] + [None, "", "   \n\t ", "One", "one", "one two three", prose(rng, 9000, words)]
    return texts


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("direct", "pairwise"), [(32, None), (3, 0), (3, 10**9)])
def test_jaccard_classes(spark, corpus, direct, pairwise):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(table(spark, corpus), direct=direct, pairwise=pairwise, sample=60, common_least=3).collect()}
    assert got == brute_components(corpus)


def test_jaccard_large_buckets_of_several_mains(spark):
    """Families of 81 sets around an unlinked first one, with a few links; some members' largest bucket is that of a common word."""
    rng, count = random.Random(1), iter(range(10**9))

    def new(n):
        return [f"w1x{next(count)}" for _ in range(n)]

    sets = [["w", *new(19)] for _ in range(700)]
    for _ in range(4):
        core = new(17)
        first, rest = core + new(3), [core + new(3) for _ in range(70)]
        for _ in range(5):
            z = new(1)
            rest += [core + z + new(2), [*core, *z, "w", *new(1)]]
        rng.shuffle(rest)
        sets += [first, *rest]
    held, expected = [set(s) for s in sets], list(range(len(sets)))
    for i, a in enumerate(held):
        for j in range(i):
            if 100 * len(a & held[j]) >= 80 * len(a | held[j]):
                x, y = sorted((expected[i], expected[j]))
                expected = [x if e == y else e for e in expected]
    got = jaccard_classes(table(spark, [" ".join(s) for s in sets]), words=1, common_least=10**6, pairwise=0).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(expected))


def test_jaccard_sets_without_partners(spark):
    """Elements of one class alone are counted over copies, runs and ranges of hashes; a family of unlike sets makes no pairs to read."""
    family = [" ".join(f"f{k}" for k in range(16)) + " " + " ".join(f"x{i}y{k}" for k in range(4)) for i in range(40)]
    counts = sorted(r.own for r in _own_shingles(table(spark, [*family, family[0], None, ""]).repartition(3), 1, 3, 0).collect())
    assert counts == [4] * 40
    half = _own_shingles(table(spark, family), 1, 2, 1).groupBy().sum("own").first()[0]
    assert 40 < half < 120
    members = [{"id": i, "component": i, "n": 20, "held": 16 if i else 20} for i in range(40)]
    made = next(_pairs_across(80)(iter([pa.RecordBatch.from_pylist([{"m": members}])])))
    assert made.num_rows == 0
    members = [{"id": i, "component": i, "n": 20, "held": 18} for i in range(3)]
    assert next(_pairs_across(80)(iter([pa.RecordBatch.from_pylist([{"m": members}])]))).num_rows == 3


def rows_of_joins(spark, keys):
    """What the joins by ``keys`` that have run in this session put out in all."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for k in range(runs.size()):
        run = runs.apply(k).executionId()
        values = {int(i): int(n.replace(",", "")) for i, n in re.findall(r"(\d+) -> ([\d,]*\d)(?=, \d+ -> |\)|, )", store.executionMetrics(run).toString())}
        nodes = store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and re.sub(r"#\d+L?", "", node.desc()).count(keys) == 2:
                held = node.metrics()
                total += sum(values.get(m.accumulatorId(), 0) for m in (held.apply(i) for i in range(held.size())) if m.name() == "number of output rows")
    return total


def _rows_out(df, kind):
    """Rows that nodes of one kind put out, while ``df`` is collected."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    found, total, waiting = 0, 0, [plan]
    while waiting:
        node = waiting.pop()
        if "QueryStage" in node.nodeName():
            waiting.append(node.plan())
        waiting += [node.children().apply(i) for i in range(node.children().size())]
        if kind in node.nodeName():
            found, total = found + 1, total + node.metrics().apply("pythonNumRowsReceived").value()
    assert found
    return total


def test_own_shingles_go_on_packed(spark):
    """300 sets with elements in each of 8 parts: a row for each part and range and one for each set, not 8 for each set."""
    texts = [" ".join(f"w{i}x{k}" for k in range(80)) for i in range(300)]
    own = _own_shingles(table(spark, texts), 1, 8, 0)
    assert {r.own for r in own.collect()} == {80}
    assert _rows_out(own, "FlatMapGroupsInArrow") <= 8 * 8 + 300


def test_texts_without_partners_stay_where_they_are(spark):
    """Of 4,000 texts 20 are asked for: few others reach the join, and none that is asked for is lost."""
    docs = table(spark, [f"text {i}" for i in range(4000)] + ["again", None]).select("doc_id", "text").withColumnRenamed("doc_id", "id")
    docs = docs.unionByName(docs.where("id = 7")).unionByName(spark.createDataFrame([(None, "x")], "id long, text string"))
    asked = spark.createDataFrame([(i,) for i in [*range(0, 4000, 200), 7, 7, 4001, 9999]], "id long")
    got = _texts_of(docs, asked)
    assert {r.id: r.text for r in got.collect()} == {i: f"text {i}" for i in [*range(0, 4000, 200), 7]} | {4001: None}
    assert _rows_out(got, "MapInArrow") <= 24 + 40
    assert _texts_of(docs, asked.limit(0)).count() == 0
    got = _texts_of(docs, asked, most_bits=8)  # so full that all may pass
    assert {r.id for r in got.collect()} == {*range(0, 4000, 200), 7, 4001}


def test_shared_passage_is_one_bucket(spark):
    # of the 300 elements that the same eight sets hold outside their centre one stands for all; two sets share another 20
    outside = {b: [*range(1000, 1300), *range(2000, 2020)] if b < 3 else [*range(1000, 1300), 5000 + b] for b in range(1, 9)}
    compared = spark.createDataFrame([(0, b, False, 1 if b < 3 else 301, x) for b, x in outside.items()], "a long, b long, linked boolean, least long, outside array<long>")
    component = spark.createDataFrame([(b, b) for b in range(9)], "node long, component long")
    sizes = spark.createDataFrame([(b, 400, 400) for b in range(9)], "rep long, n long, held long")
    before = rows_of_joins(spark, "[a, el]")
    got = _beyond_buckets(compared, component, sizes, 80).groupBy("sig").agg(F.sort_array(F.collect_set("id")).alias("ids")).collect()
    # sets that must share 301 elements with a partner hold only 300 that others hold, so they sign with none
    assert sorted(r.ids for r in got) == [[1, 2], [1, 2]]
    assert 0 < rows_of_joins(spark, "[a, el]") - before <= 2 * (8 + 2)  # a plan may be counted before and after it adapts
    # buckets with the same members leave as one before their rows are joined
    once = _beyond_buckets(compared, component, sizes, 80, once=True).collect()
    assert sorted((r.id, r.component, r.size) for r in once) == [(1, 1, 2), (2, 2, 2)]


def test_buckets_that_need_no_more_centres_leave_in_one_pass(spark):
    rows = [(1, 1, 1, 1), (1, 2, 1, 2), (2, 1, 1, 1), (2, 3, 9, 1), (3, 1, 1, 1), (3, 5, 9, 5), (4, 1, 1, 1), (4, 5, 9, 5)]  # one centre, one component, and two lists alike
    got = _unlike(spark.createDataFrame(rows, "sig long, id long, main long, component long")).collect()
    assert sorted(map(tuple, got)) == [(3, 1, 1), (3, 5, 5)]


def test_jaccard_edges(spark):
    assert jaccard_classes(table(spark, ["a b c d e f"]).limit(0)).count() == 0
    rows = jaccard_classes(table(spark, ["a b c d e f"] * 3, [None, 4, 4])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(4, 4), (4, 4)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def brute_repeats(texts, length=50):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), set()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            own.add(w)
            if w in seen:
                gone[k : k + length] = b"\1" * length
        seen |= own
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batches", [(1,), (1, 1, 2), (1, 1, 1, 1)])
def test_remove_repeats(spark, corpus, batches):
    texts = [*corpus, "é" * 80, "a" * 300, "é" * 60 + "x" * 60, "a" * 120]
    crowded = 3 if len(batches) == 3 else 20_000  # anchors with more surroundings than that go window by window
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(table(spark, texts), batches=batches, crowded=crowded).collect()}
    assert got == brute_repeats(texts)


def test_scanned_slices_of_the_last_batch_go(spark, monkeypatch):
    """While a slice is scanned for the last time, the arrays' files of those before it are gone."""
    rng, seen, arrays, write = random.Random(3), [], [], suffix_dedup.materialize

    def watched(df, name, *by):
        out = write(df, name, *by)
        if name in ("suffixes", "level"):
            arrays.append(out)
        elif name == "anchors":
            seen.append(sorted({x.name for a in arrays for x in Path(a._tessera_path.removeprefix("file://")).glob("slice=[0-3]")}))
        return out

    monkeypatch.setattr(suffix_dedup, "materialize", watched)
    docs = table(spark, [prose(rng, 40, ["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(60)])
    repeated_windows(docs.select("doc_id", "text"), batches=(1, 1))
    assert seen[-5:] == [[f"slice={k}" for k in range(n, 4)] for n in (0, 0, 1, 2, 3)]


@pytest.mark.parametrize("batches,merged", [((1, 1, 2), []), ((1, 1, 1, 1), ["level"])])
def test_levels_that_are_read_once_are_not_merged(spark, monkeypatch, batches, merged):
    """A merged level saves reading only if more than one scan reads it."""
    seen, keep = [], suffix_dedup.materialize

    def stored(df, name, *by):
        if name == "level":
            seen.append(name)
        return keep(df, name, *by)

    monkeypatch.setattr(suffix_dedup, "materialize", stored)
    rng = random.Random(5)
    texts = [prose(rng, 30, [f"word{k}" for k in range(50)]) for _ in range(40)]
    texts = [t + " " + texts[i % 3] if i > 20 else t for i, t in enumerate(texts)]
    rows = remove_repeats(table(spark, texts), batches=batches).collect()
    assert seen == merged
    whole = {r.doc_id: r.kept_sha256 for r in remove_repeats(table(spark, texts), batches=(1,)).collect()}
    assert {r.doc_id: r.kept_sha256 for r in rows} == whole and any(r.n_removed for r in rows)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_remove_repeats_edges(spark):
    assert remove_repeats(table(spark, ["a"]).limit(0)).count() == 0
    long = "abcdefghij" * 10
    got = [(r.doc_id, r.n_removed) for r in remove_repeats(table(spark, [long, long, long], [None, 7, 7])).collect()]
    assert sorted(got, key=str) == [(7, 0), (7, 0), (None, 0)]
    assert repeated_windows(table(spark, ["short"])).count() == 0
    windows = repeated_windows(table(spark, [long[:80], long[:80]])).collect()
    assert {r.doc_id for r in windows} == {1} and {x for r in windows for x in range(r.a, r.b + 1)} == set(range(31))
    levels = SuffixLevels(50)
    for n in range(4):
        levels.add(spark.createDataFrame([(n, n, n, 0, 0)], "hi long, lo long, doc_id long, first int, last int"))
    assert [w for _, w in levels.levels] == [4]


def luhn(d):
    return sum((x * 2 - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, p in pats.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (13 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_every_match_trains_personal_data(spark):
    """All matches are learned from, however many there are; none is left out by hash."""
    from tessera.llm.pii import base_spans, training_rows

    docs = spark.range(20_500).select(F.concat(F.lit("write to u"), F.col("id"), F.lit("@host.org now")).alias("text"))
    rows = training_rows(base_spans(docs), F.col("text"))
    assert rows.groupBy("style").count().where("count = 20500").count() == 6


def test_personal_data(spark):
    rng = random.Random(3)
    texts = [None, "", "a@b.c_d@e.f and a@b..c x@y", "é😀 1.2.3.4.5.6.7.8 999.1.1.1 007.1.1.255", "4111 1111 1111 1111, 4111111111111112", "+1 (444) 555-4984 +12 +1-2-3-4-5-6-7-8-9", "5" * 40_000, "+" + "1 " * 9_000, "a" * 50_000 + "@b.co"]
    pieces = ["a.b@c.de", "@", ".", "1.2.3.4", "256.1.1.1", "4111111111111111", "+1 (444) 555-4984", " ", "-", "x", "é", "12", "(444) 555-4984", "\n", "+", "_"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    rows = find_personal_data(table(spark, texts)).select("doc_id", as_text(F.col("base")).alias("base"), as_text(F.col("spans")).alias("spans"), redact(F.col("text"), F.col("base")).alias("clean"), "sig").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base == brute_spans(texts[r.doc_id])
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    clean = {r.doc_id: r.clean for r in rows}
    assert clean[5].startswith("[PHONE] +12 ") and clean[0] is None and clean[8] == "[EMAIL]"
    assert find_personal_data(table(spark, ["a"]).limit(0)).count() == 0


def test_personal_data_written_otherwise(spark):
    """Proposals beyond the base grammars, learned from the base matches of a corpus."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        near = prose(rng, 6, ["time", "goes", "slowly", "now", "we", "meet", "here"]) + f". {rng.choice(['So', 'Then', 'Yet'])} we go on. "
        number = [rng.randrange(10) for _ in range(15)]
        number += [next(d for d in range(10) if luhn("".join(map(str, [*number, d]))))]
        if i % 3 == 0:
            number[-1] = (number[-1] + 1 + i % 8) % 10
        rows.append(near + rng.choice([f"write to ann.{i}@mail{i % 9}.example.com please", f"paid with {''.join(map(str, number))} then", f"call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} soon", f"host {i % 250}.{i % 300}.1.7 up"]))
    cases = ["bill with 4111.1111.1111.1111 then", "bill with 4111.1111.1111.1112 then", "see you [at] home.now please", "write to ann.77 [at] mail3.example.com please", "version (555) 123-4567", None, ""]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows + cases)], "doc_id long, text string, base string, _row string")
    got = {r.doc_id - len(rows): r for r in find_personal_data(docs).where(F.col("doc_id") >= len(rows)).select("doc_id", as_text(F.col("spans")).alias("s"), "_row").collect()}
    assert [got[i].s for i in range(len(cases))] == ["card:10:29", "", "", "email:9:38", "", "", ""] and got[0]._row == "y"


def test_personal_data_in_sentences_of_other_kinds(spark):
    """Learned from the given documents, found in sentences unlike any of theirs; what only looks like it is left alone."""
    there = ["Write to ann [at] example.com soon", "ann.lee [at] example.com", "server at 10[.]0[.]0[.]7", "10[.]0[.]0[.]7 was blocked after that", "host 192(.)168(.)1(.)20 replied", "paid with 4111_1111_1111_1111 last week"]
    not_there = ["version 1.2.3 was released", "the years 1998-2001 were good", "order 555-12-3456-99", "meet at five. then dot your eyes", "she looked at me (at last) and sat", "ISBN 978-3-16-148410-0", "we were at home (dot) dot dot", "pages 100-200-3000", "in section 12[.]3 of 1 law", "he said [at] noon we go", "score 10-12-2024"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    cases = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(there + not_there)], "doc_id long, text string")
    found = find_personal_data(docs.unionByName(cases)).where("size(spans) > size(base)").select("doc_id", as_text(F.col("spans")).alias("s")).collect()
    assert {r.doc_id - 10**6: r.s.split(":")[0] for r in found} == {0: "email", 1: "email", 2: "ip", 3: "ip", 4: "ip", 5: "card"}


def test_query_of_personal_data(spark, tmp_path):
    from tessera.llm.queries import op2_pii

    texts = ["a@b.cd 1.2.3.4 4111111111111111 +1 (444) 555-4984", "none", None, "x@y.z, x@y.z"]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op2_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        spans = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and got[i].spans == spans
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [spans.count(k + ":") for k in ("email", "ip", "card", "phone")]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeiorstnl") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(500):
        t = prose(rng, rng.randint(8, 60), words)
        bad, toxic = i % 5 == 0, i % 4 == 0
        if toxic:
            t += " " + rng.choice(["stupid moron", "worthless idiot"]) + " " + prose(rng, 5, words)
        rows.append((i, t.upper().replace(" ", "!! ") if bad else t, int(not bad), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def accuracy(scored, labels, column, threshold):
    return scored.join(labels, "doc_id").agg(F.avg(((F.col("score") >= threshold).cast("int") == F.col(column)).cast("double"))).first()[0]


def test_quality(spark, labelled):
    docs, labels = labelled
    model = fit_quality(docs, labels)
    held = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    assert accuracy(score_quality(held, model), labels, "quality", 0.3) > 0.97
    odd = score_quality(table(spark, [None, "", "x" * 200_000, "same same"], [None, 1, 2, 2]), model).collect()
    assert all(0 <= r.score <= 1 for r in odd) and len(odd) == 4 and odd[0].sig == 1
    one = fit_quality(docs, labels.where("quality = 1"))
    assert all(r.score > 0.5 for r in score_quality(docs.limit(3), one).collect())
    none = fit_quality(docs, labels.limit(0))
    assert score_quality(docs.limit(0), none).count() == 0


def test_toxicity_sees_through_disguises(spark, labelled):
    docs, labels = labelled
    lm = language_model(count_trigrams(docs))
    words = Restorer(lm)
    assert decode("1d10t", lm) == "idiot" and restore("St00pid? i d i o t m.o.r.o.n w0rthless moooron plain", words)[1:] == ["idiot", "moron", "worthless", "moron", "plain"]
    model = fit_toxicity(docs, labels, lm)
    assert accuracy(score_toxicity(docs, model, lm), labels, "toxic", 0.7) > 0.97
    texts = ["you are a w0rthless 1d10t", "you are an i d i o t worthless", "a calm note", None, ""]
    got = [r.score for r in score_toxicity(table(spark, texts), model, lm).orderBy("doc_id").collect()]
    assert min(got[:2]) > max(got[2:]) and all(0 <= x <= 1 for x in got)


def test_descent_reaches_the_optimum():
    """Dual coordinate descent against projected gradient steps on the whole dual."""
    from tessera.llm.nbsvm import dual_coordinate_descent, log_count_ratio

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(30)]
    labels = np.array([int((x < 6).mean() + rng.normal() * 0.2 > 0.5) for x in rows])
    ratio = log_count_ratio(rows, labels, 12, 1.0)
    w, bias = dual_coordinate_descent(rows, labels, ratio, np.ones(30), 4000)
    x = np.zeros((30, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = ratio[r], 1.0
    y = np.where(labels == 1, 1.0, -1.0)
    q, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(30)
    for _ in range(100_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, 1)
    best = (alpha * y) @ x
    assert np.allclose([*w, bias], [*(best[:12] * ratio), best[12]], atol=1e-2)
    counts = [sum((np.isin(f, r)) for r, t in zip(rows, labels) if t == one) + 1.0 for one in (1, 0) for f in range(12)]
    p, n = np.array(counts[:12]), np.array(counts[12:])
    assert np.allclose(ratio, np.log(p / p.sum()) - np.log(n / n.sum()))


def test_decoder_finds_the_cheapest_path(spark, labelled):
    from tessera.llm.toxicity import AGAIN, DROP, LOOKALIKES, SWAP, _CODE

    lm = language_model(count_trigrams(labelled[0]))

    def every(word, at, p, q, text):
        if at == len(word):
            yield -float(lm[p, q, 0]), text
            return
        ch, ways = word[at], []
        for letter, cost in [(ch, 0.0)] if ch.isalpha() else [(x, SWAP) for x in LOOKALIKES.get(ch, "")]:
            c = int(_CODE[ord(letter)])
            ways.append((q, c, cost - float(lm[p, q, c]), text + letter))
        run = at and ch == word[at - 1] and any(word[i : i + 3] == 3 * ch for i in range(max(0, at - 2), at + 1))
        if text and (run or text[-1] in LOOKALIKES.get(ch, "")):
            ways.append((p, q, AGAIN, text))
        if ch == " ":
            ways.append((q, 0, -float(lm[p, q, 0]), text + " "))
        if not ch.isalnum():
            ways.append((p, q, DROP, text))
        for a, b, cost, t in ways:
            for rest, out in every(word, at + 1, a, b, t):
                yield cost + rest, out

    for word in ["1d10t", "m0r0n", "iiidiot", "st.u.p1d", "a$$", "i d i o t", "s t u p i d m o r o n"]:
        assert decode(word, lm) == min(every(word, 0, 0, 0, ""))[1], word


def test_long_and_odd_disguises(spark, labelled):
    lm = language_model(count_trigrams(labelled[0]))
    words = Restorer(lm)
    assert restore("1d10t" + "t" * 70, words) == ["idiot"]
    assert restore("i  d  i  o  t", words) == ["idiot"] and restore("i d i o t   m o r o n", words) == ["idiot", "moron"]
    assert restore("55 2023 10:30", words) == ["55", "2023", "10:30"]
    assert len(decode("x1" * 20_000, lm)) > 1000
    long = table(spark, ["w0rthless " * 20_000, None, "", "same", "same"], [1, 2, 3, 4, 4])
    model = fit_toxicity(*labelled, lm)
    got = [r.score for r in score_toxicity(long.withColumn("score", F.lit("x")), model, lm).orderBy("doc_id").collect()]
    assert len(got) == 5 and got[3] == got[4] and all(0 <= x <= 1 for x in got)
    assert score_toxicity(long.limit(0), model, lm).count() == 0
    one = fit_toxicity(labelled[0], labelled[1].where("toxic = 0"), lm)
    assert all(r.score < 0.5 for r in score_toxicity(long, one, lm).collect())


def test_encoder_matches_the_tokenizer():
    t, e = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    rng = random.Random(1)
    texts = ["", " ", "a  b", " a", "a ", "x\n y", "don't, stop's.", "\0a b", "<|endoftext|> a", "é ñ... ok!? 12,5", "it's, ok a b", "日本 語 ,a", "a" * 5000]
    texts += ["".join(rng.choice(["a", "The", " ", " ", ",", ".", "\n", "é", "1", "'s", "日"]) for _ in range(40)) for _ in range(300)]
    assert [e(x) for x in texts] == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_packing(spark, corpus):
    rows = pack(table(spark, corpus), VOCABULARY, capacity=64).collect()
    t = Tokenizer.from_file(VOCABULARY)
    total = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in enumerate(corpus)}
    got, bins = collections.Counter(), collections.defaultdict(list)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(corpus)}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        got[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
        assert r.length == 64 or r.piece == 0
    assert dict(got) == total
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * -(-sum(total.values()) // 64) + 1
    assert pack(table(spark, ["a"]).limit(0), VOCABULARY).count() == 0
    twice = pack(table(spark, ["a", "a", None], [3, 3, None]), VOCABULARY).collect()
    assert sorted((r.doc_id or -1, r.offset) for r in twice) == sorted(zip([-1, 3, 3], [r.offset for r in sorted(twice, key=lambda r: (r.doc_id or -1, r.offset))]))


def test_plan_replaces_the_smallest():
    assert two_fit_plan({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]


def test_mixing_reaches_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    soft = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(rng.integers(0, 50, 300), p)], "n_tokens long, posterior array<double>")
    targets = np.array([4000.0, 500.0, 1000.0])
    steps = fit_rates(soft, targets)
    got = soft.withColumn("r", rate_after(steps)).agg(*(F.sum(F.col("r") * F.col("n_tokens") * F.element_at("posterior", d + 1)) for d in range(3)), F.min("r")).first()
    assert np.allclose(got[:3], targets, rtol=5e-3) and got[3] >= 0
    # plain projected gradient steps of the whole problem agree on the totals, and the rates are a solution of least squares
    rows = soft.withColumn("r", rate_after(steps)).collect()
    n, x = np.array([r.n_tokens for r in rows], float), np.array([r.posterior for r in rows])
    w, rate = 1 / targets, np.ones(len(n))
    for _ in range(20_000):
        rate = np.maximum(0, rate - 2e-4 * x @ (w * ((n * rate) @ x - targets)))
    mine = np.array([r.r for r in rows])
    loss = lambda r: float((w * ((n * r) @ x - targets) ** 2).sum())
    assert loss(mine) <= loss(rate) + 1e-2
    with pytest.warns(UserWarning, match="miss their targets"):
        fit_rates(soft, np.array([1e9, 0.0, 0.0]), most_steps=3, least=F.lit(1.0))


@pytest.mark.parametrize("kind", ["unreachable", "one domain hardly there", "bounded"])
def test_mixing_is_optimal_where_targets_are_out_of_reach(spark, kind):
    """Against 20,000 plain projected steps with the Lipschitz bound as their length: the loss is at most 1 % above."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet({"unreachable": [6, 4, 4], "one domain hardly there": [6, 0.2, 0.02], "bounded": [4, 1, 1]}[kind], 250)
    n = rng.integers(1, 90, 250)
    low = (p[:, 0] >= 0.6).astype(float) if kind == "bounded" else np.zeros(250)
    targets = n @ p * {"unreachable": [1.0, 0.05, 0.05], "one domain hardly there": [0.9, 0.5, 40.0], "bounded": [1.0, 0.1, 0.1]}[kind]
    soft = spark.createDataFrame([(int(a), x.tolist()) for a, x in zip(n, p)], "n_tokens long, posterior array<double>")
    least = F.when(F.element_at("posterior", 1) >= 0.6, 1.0).otherwise(0.0) if kind == "bounded" else None
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        steps = fit_rates(soft, targets, least=least)
    w, rate = 1 / targets, np.maximum(low, 1.0)
    longest = 1 / np.linalg.eigvalsh(np.sqrt(w)[:, None] * (p.T @ (n[:, None] * p)) * np.sqrt(w)[None, :])[-1]
    for _ in range(20_000):
        rate = np.maximum(low, rate - longest * p @ (w * ((n * rate) @ p - targets)))
    loss = lambda r: float((w * ((n * r) @ p - targets) ** 2).sum())
    mine = np.array([r.r for r in soft.withColumn("r", rate_after(steps, least)).select("r").collect()])
    assert (mine >= low).all() and loss(mine) <= 1.01 * loss(rate) + 1e-3
    assert any("miss their targets" in str(x.message) for x in said) == (np.abs((n * mine) @ p - targets) > 1e-3 * targets).any()


def test_mixing_keeps_likely_good_documents(spark, labelled):
    rng = np.random.default_rng(4)
    p = np.vstack([rng.dirichlet([8, 1, 1], 400), rng.dirichlet([5, 4, 1], 100), rng.dirichlet([1, 6, 1], 60), rng.dirichlet([1, 1, 6], 60)])
    soft = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(rng.integers(1, 50, len(p)), p)], "n_tokens long, posterior array<double>")
    tokens = np.array([r.n_tokens for r in soft.collect()])
    targets = np.array([1.1, 0.75, 0.85]) * (tokens @ p)
    least = F.when(likeliest() == 1, 1.0).otherwise(0.0)
    free, kept = (soft.withColumn("r", rate_after(fit_rates(soft, targets, most_steps=200, least=x), x)).where(likeliest() == 1).agg(F.count_if(F.col("r") < 1)).first()[0] for x in (None, least))
    assert free > 0 and kept == 0
    got = soft.withColumn("r", rate_after(fit_rates(soft, targets, most_steps=200, least=least), least)).agg(*(F.sum(F.col("r") * F.col("n_tokens") * F.element_at("posterior", d + 1)) for d in range(3))).first()
    assert np.allclose(got, targets, rtol=5e-3)
    docs, labels = labelled
    domain = labels.select("doc_id", F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").otherwise("good").alias("domain"))
    out = mix_to_targets(docs, domain, {"good": 0.9, "toxic": 0.04, "poor": 0.06}, "good", anchor_scale=1.1, keep_anchor=True)
    assert out.where("domain = 'good'").count() > 200 and out.where("domain = 'good' and (rate < 1 or copies < 1)").count() == 0


def test_mixing_edges(spark, labelled):
    docs, labels = labelled
    domain = labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("domain"))
    odd = docs.unionByName(spark.createDataFrame([(None, None), (None, ""), (1, "again")], "doc_id long, text string"))
    out = mix_to_targets(odd, domain, {"good": 0.9, "poor": 0.1}, "good")
    assert out.count() == odd.count() and out.where("rate < 0 or rate is null or copies < 0").count() == 0
    assert {r.copies for r in mix_to_targets(docs, domain.limit(0), {"good": 1.0}, "good").collect()} == {1}
    assert mix_to_targets(docs.limit(0), domain, {"good": 0.9, "poor": 0.1}, "good").count() == 0


def test_shards_round_trip(spark, corpus, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan=3, keep_versions=2)
    docs = table(spark, corpus)
    for n in range(5):
        store.append(docs.where(F.pmod("doc_id", F.lit(5)) == n).coalesce(1), rows_per_shard=10)
    before = len(store.manifest()["shards"])
    store.compact()
    assert len(store.manifest()["shards"]) < before and len(store.versions()) == 2
    assert sorted(map(str, store.read().drop("shard").collect())) == sorted(map(str, docs.collect()))
    store.append(docs.limit(0))
    assert store.read().count() == len(corpus)
    with pytest.raises(ValueError, match="no columns"):
        store.append(docs.withColumn("more", F.lit(1)))
    held = store.read(store.manifest()["version"] - 1)  # of the version before
    assert held.count() == len(corpus)
    empty = arrive_and_compact(docs.withColumn("shard", F.lit("x")).limit(0), f"file://{tmp_path}/e")
    assert empty.read().count() == 0 and dict(empty.read().dtypes)["shard"] == "bigint"
    named = arrive_and_compact(docs.withColumns({"shard": F.lit("x"), "file_path": F.lit("y")}), f"file://{tmp_path}/n").read()
    assert named.count() == len(corpus) and dict(named.dtypes)["shard"] == "bigint" and named.where("file_path = 'y'").count() == len(corpus)
    with pytest.raises(Exception):  # noqa: B017  another writer was first
        store.commit(store.manifest()["version"] - 1, [], "{}")


def test_empty_batch_is_no_text():
    from tessera.llm.common import text_runs

    assert list(text_runs(pa.array([], pa.string()))) == []


def test_remove_repeats_of_the_largest_ids(spark):
    """Batches are cut at quantiles, which are doubles: ids that those round up to 2^63 stay whole and right."""
    rng = random.Random(9)
    shared, words = prose(rng, 20, [f"word{k}" for k in range(50)]), [f"other{k}" for k in range(90)]
    texts = [prose(rng, 15, words) + " " + shared + " " + prose(rng, 15, words) for _ in range(12)]
    ids = [(1 << 63) - 12 + i for i in range(12)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(table(spark, texts, ids)).collect()}
    assert got == {ids[i]: r for i, r in brute_repeats(texts).items()} and sum(r[1] for r in got.values()) > 11 * len(shared)


def test_large_buckets_join_by_pieces(spark):
    """60 sets with about the same buckets: what joins by signature are lists of members, not a row for each member."""
    rng = random.Random(4)
    core = [f"c{k}" for k in range(100)]
    texts = [" ".join([w for w in core if w != core[i]] + [f"own{i}"]) for i in range(60)]
    texts += [" ".join(f"x{i}y{k}" for k in range(rng.randint(1, 9))) for i in range(20)]
    before = rows_of_joins(spark, "[sig]")
    got = {r.doc_id: r.component_id for r in jaccard_classes(table(spark, texts), words=1, common_least=10**6, direct=8).collect()}
    assert got == {i: 0 if i < 60 else i for i in range(80)}
    assert 0 < rows_of_joins(spark, "[sig]") - before < 4 * 60


def test_searches_for_personal_data_are_whole(spark):
    """The plainer searches before the wider generators let every match through, and few other texts."""
    from tessera.llm.pii import _FOUR, BASE, FIRST, KINDS, WIDER, matches

    rng = random.Random(8)
    bits = ["a.b", "at", "dot", "[", "]", "(", ")", " ", " @ ", "@", ".", "[.]", "(.)", "-", "_", "/", "+", "12", "1234", "255", "555", "(555) ", "x", "é", "com", "[at]", "(at)", "[ at ]", " (dot) "]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    made += [f"ann{a}host{d}com" for a in (" [at] ", "(at)", "[ at ]", " @ ") for d in (".", " [dot] ", "(dot)")] + ["1[.]2[.]3[.]4", "9(.)8.7.6", "1234.5678/9012_3456", "1234/5678.1234.1", "(555) 123-4567", "555-123.4567", "555.123 4567", "10.20.30.40", "x1.2.3.4.5"]
    text, docs = F.col("text"), table(spark, made)
    ways = {k: (WIDER[k], FIRST[k](text)) for k in KINDS} | {"base ip": (BASE["ip"], text.rlike(_FOUR))}
    counts = [F.sum(F.size(matches(text, p, ""))).alias(f"{k} all") for k, (p, _) in ways.items()]
    counts += [F.count_if(~matches(text, p, "").eqNullSafe(matches(text, p, "", first))).alias(f"{k} other") for k, (p, first) in ways.items()]
    r = docs.agg(*counts).first()
    assert all(r[f"{k} all"] > 0 and r[f"{k} other"] == 0 for k in ways)
    plain = table(spark, ["The year 2019, at 10.30 or 5-6 on a [sic] page (at 4) cost 1,234.50 a.b."])
    assert plain.where(reduce(lambda x, y: x | y, (first for _, first in ways.values()))).count() == 0
