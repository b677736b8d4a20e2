"""Operators 11 to 13: importance resampling, token files and cross-tokenizer alignment, held against plain Python."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import queries
from tessera.llm.alignment import align_documents, links_of, shared_groups
from tessera.llm.common import new_path
from tessera.llm.resampling import cutoff, gains, importance_resample
from tessera.llm.token_files import FileReader, FileWriter, TokenStore, from_planes, to_planes, write_token_files

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "  two  spaces ", "tab\there\nand line", "<|endoftext|> is text", "</s> <s>", "naïve café ▁ sign", "漢字 かな 😀 mixed", "x" * 5_000, "the same", "the same", "word " * 3_000, "́ mark", "end. ", "it's I'll don't"]


# --- 11: resampling -------------------------------------------------------------------------


def resample_by_hand(docs, target, percent=10, least=20, buckets=10_000, longest=1):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    features = lambda t: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for w in [words(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in features(text))
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        score = None if doc_id is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features(text)), weight, score, len(words(text)) >= least and doc_id is not None])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0], x[1], x[2]))
    rank = {id(x): i + 1 for i, x in enumerate(able[: percent * len(able) // 100])}
    key = lambda x: tuple((v is not None, v) if v is not None else (False, 0) for v in x)
    return sorted(((*x[:4], rank.get(id(x))) for x in out), key=key), key


def test_resampling_query_against_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    want, key = resample_by_hand(docs, target)
    assert sorted(map(tuple, queries.op11_importance_resampling(spark, SF).collect()), key=key) == want


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_of_odd_rows(spark, longest):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one two " * 30), (3, "one two " * 30), (None, "no id " * 30), (50, "One TWO ÄÖ " * 40)] + [(100 + i, f"common words {i} " * 12) for i in range(60)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, features string, score int")
    target = spark.createDataFrame([("one two three",), (None,), ("",)], "text string")
    want, key = resample_by_hand(rows, ["one two three", None, ""], longest=longest)
    assert sorted(map(tuple, importance_resample(docs, target, longest=longest).collect()), key=key) == want


def test_resampling_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert importance_resample(docs, docs).count() == 0
    few = spark.createDataFrame([(1, "a b"), (2, "word " * 30)], "doc_id long, text string")
    assert [r["rank"] for r in importance_resample(few, docs).collect()] == [None, None]


@pytest.mark.parametrize("values", [[5] * 3_000, list(range(3_000)), [0] * 2_900 + list(range(100)), [i % 7 for i in range(3_000)]])
@pytest.mark.parametrize("k", [1, 299, 1_500, 2_999, 3_000])
def test_cutoff_in_ties(spark, values, k):
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "score long, id long").cache()
    assert cutoff(rows, "score", ["id"], k, error=0.01) == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1]))[k - 1]


def test_gain_favours_the_target():
    assert gains([9, 1], [1, 9])[1] > 0 > gains([9, 1], [1, 9])[0]


# --- 12: token files ------------------------------------------------------------------------


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=50), st.sampled_from([1, 8]))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids, bits):
    x = np.array(ids, "<u4")
    assert (from_planes(to_planes(x, bits), len(x), bits) == x).all()


@pytest.mark.parametrize("bits", [1, 8])
def test_file_and_single_chunks(tmp_path, bits):
    fs, rng = pafs.LocalFileSystem(), np.random.default_rng(1)
    docs = [(7, rng.integers(0, 50_000, 10)), (None, rng.integers(0, 2**32, 300)), (9, np.zeros(0)), (10, rng.integers(0, 9, 64))]
    writer = FileWriter(fs.open_output_stream(str(tmp_path / "f"), compression=None), 64, bits)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.astype("<u4"))
    assert writer.close() == os.path.getsize(tmp_path / "f")
    reader = FileReader(fs.open_input_file(str(tmp_path / "f")))
    every = np.concatenate([ids for _, ids in docs]).astype("<u4")
    assert [(d, p, x.tolist()) for d, p, x in reader.documents()] == [(d, sum(len(y) for _, y in docs[:i]), x.astype("<u4").tolist()) for i, (d, x) in enumerate(docs)]
    for start, end in ((0, 374), (60, 70), (64, 128), (200, 201), (5, 5)):
        assert reader.ids_between(start, end).tolist() == every[start:end].tolist()
    with open(tmp_path / "f", "rb") as f, open(tmp_path / "cut", "wb") as cut:
        cut.write(f.read()[:-3])
    with pytest.raises(ValueError):
        FileReader(fs.open_input_file(str(tmp_path / "cut")))


def tokens_by_hand(rows):
    encode = Tokenizer.from_file(BPE).encode
    at, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_query_against_tokenizers(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, queries.op12_token_files(spark, SF).collect())) == tokens_by_hand(rows)


@pytest.mark.parametrize("bits", [1, 8])
def test_token_files_of_odd_rows(spark, bits):
    rows = [(i * 3 - 9, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, "p", 5) for r in rows], "doc_id long, text string, part string, start int").repartition(5)
    store = write_token_files(docs, BPE, bits=bits, chunk_ids=128, file_ids=2_000)
    assert sorted(map(tuple, store.read().select("doc_id", "start", "n_tokens", F.crc32("ids")).collect())) == tokens_by_hand(rows)
    assert store.index().count() > 1


def test_token_files_with_repeats_and_leftovers(spark):
    rows = [(1, "same")] * 40 + [(None, "first"), (2, "b"), (1, "other")]
    store = write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), BPE)
    read = sorted(store.read().collect(), key=lambda r: r.start)
    assert [r.doc_id for r in read] == [None] + [1] * 41 + [2]
    assert [r.start for r in read] == np.concatenate(([0], np.cumsum([r.n_tokens for r in read])[:-1])).tolist()
    fs, folder = pafs.FileSystem.from_uri(f"{store.path}/data")
    fs.copy_file(fs.get_file_info(pafs.FileSelector(folder))[0].path, f"{folder}/000000-0000-lost.tpf")  # as a lost executor leaves it
    assert store.read().count() == len(rows)
    assert store.remove_unlisted() == 1 and store.read().count() == len(rows)


def test_token_files_without_rows(spark):
    store = write_token_files(spark.createDataFrame([], "doc_id long, text string"), BPE, new_path(spark, "empty"))
    assert store.read().count() == 0 and TokenStore(spark, store.path).remove_unlisted() == 0


# --- 13: alignment --------------------------------------------------------------------------

_RISING = st.lists(st.integers(1, 60), min_size=1, max_size=25, unique=True).map(sorted)


@given(_RISING, _RISING)
@settings(max_examples=200, deadline=None)
def test_groups_and_links_against_sets(a, b):
    a, b = np.array(sorted({*a, 61})), np.array(sorted({*b, 61}))
    found = shared_groups(a, b).tolist()
    assert [(a[q - 1], b[t - 1]) for _, q, _, t in found] == [(x, x) for x in sorted({*a} & {*b})]
    assert [f[::2] for f in found] == [[0, 0], *(f[1::2] for f in found[:-1])]
    spans = lambda ends: list(zip([0, *ends], ends))
    want = sorted((i, j) for i, (s, e) in enumerate(spans(a)) for j, (t, f) in enumerate(spans(b)) if s < f and t < e)
    i, j, _ = links_of(a, b)
    assert sorted(zip(i.tolist(), j.tolist())) == want
    # the same for several intervals at once
    twice = shared_groups(np.concatenate((a, a + 61)), np.concatenate((b, b + 61)), np.array([[0, len(a), 0, len(b)], [len(a), 2 * len(a), len(b), 2 * len(b)]])).tolist()
    assert twice == found + [[p + len(a), q + len(a), r + len(b), t + len(b)] for p, q, r, t in found]


def align_by_hand(rows):
    byte, piece = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte.encode_special_tokens = True
    from tessera.llm.tokens import byte_letters

    letters = byte_letters()
    docs, count = [], Counter()
    for doc_id, text in rows:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            a, b = byte.encode(" " + text, add_special_tokens=False), piece.encode(text)
            bytes_a = [bytes(letters[c] for c in t) for t in a.tokens]
            names = [piece.id_to_piece(i) for i in b]
            bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                n_a, n_b = len(a.ids), len(b)
                ends_a, ends_b = np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()
                cuts = sorted({*ends_a} & {*ends_b})
                for s, e in zip([0, *cuts], cuts):
                    groups.append(",".join(str(i) for i, x in zip(a.ids, ends_a) if s < x <= e) + "|" + ",".join(str(i) for i, x in zip(b, ends_b) if s < x <= e))
                j = 0
                for i, (s, e) in enumerate(zip([0, *ends_a], ends_a)):
                    while ends_b[j] <= s:
                        j += 1
                    k = j
                    while k < n_b and ([0, *ends_b[:k]][-1] if k else 0) < e:
                        links.append((a.ids[i], b[k]))
                        k += 1
        docs.append((doc_id, n_a, n_b, groups, links))
        count.update(set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = [(d, n_a, n_b, len(g), len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), ";".join(g)) for d, n_a, n_b, g, x in docs]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[7]))


def test_alignment_query_against_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").collect()]
    whole = queries.op13_tokenizer_alignment(spark, SF)
    assert whole.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = align_documents(docs, BPE, PIECES).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[7])) == align_by_hand(rows)
    digests = align_documents(docs, BPE, PIECES, digest=True)
    assert {(r.doc_id, r.groups) for r in digests.collect()} == {(r.doc_id, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in got}


def test_alignment_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again a"), (3, "again a"), (None, "no id here")]
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, block int, groups string").repartition(3)
    got = sorted(map(tuple, align_documents(docs, BPE, PIECES).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[7]))
    assert got == align_by_hand(rows)
    assert align_documents(docs.limit(0), BPE, PIECES).count() == 0
