"""Operators on hand-made rows."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing as hs
from tessera.functions import text as tx
from tessera.operators import audits as au
from tessera.operators import evaluation as ev
from tessera.operators import intervals as iv
from tessera.operators import models as mo
from tessera.operators import pricing as pr
from tessera.operators import sessions as se
from tessera.sources import readers as rd


def test_interval_attribution_matches_bisect(spark):
    rng = random.Random(5)
    spans, probes = [], []
    for i in range(120):
        start = rng.randrange(0, 50_000_000, 50_000)
        spans.append((f"k{rng.randrange(3)}", f"s{i}", start, start + rng.choice([0, 100_000, 5_000_000, 30_000_000]), i))
    for i in range(500):
        probes.append((f"k{rng.randrange(4)}", rng.randrange(-300_000, 60_000_000, 50_000), i))
    expected = {}
    for src, t, rec in probes:
        own = sorted((s[2], s[4], s) for s in spans if s[0] == src)
        at = bisect.bisect_right([o[0] for o in own], t)
        for candidate in ([own[at - 1]] if at else []) + ([own[at]] if at < len(own) else []):
            if candidate[2][2] - 100_000 <= t <= candidate[2][3] + 100_000:
                expected[rec] = candidate[2][1]
                break
    i = spark.createDataFrame(spans, "src string, session_id string, start_us long, end_us long, ordinal long")
    p = spark.createDataFrame(probes, "src string, ts_us long, rec long")
    got = {r.rec: r.session_id for r in iv.attribute(p, i).collect()}
    assert len(got) == len(probes)
    assert {k: v for k, v in got.items() if v} == expected
    wider = {(r.rec, r.session_id) for r in iv.all_containing(p, i).collect()}
    assert set(expected.items()) <= wider


def as_of_by_bisect(spans, probes, tolerance=100_000):
    """rec: session of each probe, by a binary search for each."""
    found = {}
    for src, t, rec in probes:
        own = sorted((s[2], s[4], s) for s in spans if s[0] == src)
        at = bisect.bisect_right([o[0] for o in own], t)
        fits = [x[2][1] for x in ([own[at - 1]] if at else []) + own[at : at + 1] if x[2][2] - tolerance <= t <= x[2][3] + tolerance]
        found[rec] = fits[0] if fits else None
    return found


@pytest.mark.parametrize("busy, spans_of, instants", [(1.0, 150, 60_000_000), (0.6, 3, 60_000_000), (0.9, 40, 400_000), (0.5, 0, 60_000_000)])
def test_interval_attribution_over_a_hot_key(spark, busy, spans_of, instants):
    """A key with most or all rows is cut into ranges; intervals before, after and across them still count."""
    rng = random.Random(busy * 100 + spans_of)
    spans = [("hot", f"h{i}", t := rng.randrange(0, instants, 10_000), t + rng.choice([0, 100_000, 30_000_000]), i) for i in range(spans_of)]
    spans += [(f"k{i % 5}", f"s{i}", i * 1_000_000, i * 1_000_000 + 5_000_000, i) for i in range(20)]
    probes = [("hot" if rng.random() < busy else rng.choice(["k0", "k1", "k7", None]), rng.randrange(-300_000, instants, 10_000), i) for i in range(900)]
    i = spark.createDataFrame(spans, "src string, session_id string, start_us long, end_us long, ordinal long")
    p = spark.createDataFrame(probes, "src string, ts_us long, rec long")
    out = iv.attribute(p, i, parts=8)
    assert {r.rec: r.session_id for r in out.collect()} == as_of_by_bisect(spans, probes)


def test_hot_key_spreads_and_is_sorted_once(spark):
    rows = [("hot" if i % 10 else f"k{i}", i * 7 % 5_000, i) for i in range(5_000)]
    p = spark.createDataFrame(rows, "src string, t long, rec long")
    pieces = {r.src: r.bounds for r in iv.hot_key_pieces(p, 16).collect()}
    assert list(pieces) == ["hot"] and 12 <= len(pieces["hot"]) <= 15
    sizes = [sum(1 for s, t, _ in rows if s == "hot" and low < t <= high) for low, high in zip([-1, *pieces["hot"]], [*pieces["hot"], 9_999])]
    assert max(sizes) < 2.2 * min(sizes)
    assert iv.hot_key_pieces(p.where("src <> 'hot'"), 16) is None
    i = spark.createDataFrame([("hot", "s", 5, 9, 1)], "src string, session_id string, start_us long, end_us long, ordinal long")
    plan = iv.attribute(p.withColumnRenamed("t", "ts_us"), i, parts=16)._jdf.queryExecution().executedPlan().toString().split("Window [")
    # above the union: one window over one sort of what one exchange deals out
    top = plan[1].split("Union")[0]
    assert top.count("Sort [") == 1 and top.count("Exchange hashpartitioning(src") == 1 and "lead(held" in plan[1] and "last(held" in plan[1]


def test_four_packets_two_sessions(spark):
    i = spark.createDataFrame([("a", "s1", 1_000_000_000, 1_000_500_000, 1), ("b", "s2", 1_001_000_000, 1_001_500_000, 2)], "src string, session_id string, start_us long, end_us long, ordinal long")
    rows = [("a", 1_000_100_000, 10.0, 1, "click", 1, 1), ("a", 1_000_200_000, 20.0, -1, "view", 2, 2), ("b", 1_001_100_000, 30.0, 1, "click", 3, 3), ("b", 1_001_200_000, 40.0, -1, "error", 4, 4)]
    p = spark.createDataFrame(rows, "src string, ts_us long, size double, direction int, flow string, seq long, rec long")
    got = {r.session_id: r for r in iv.packet_features(i, iv.attribute(p, i)).collect()}
    assert [got["s1"].packet_count, got["s1"].up_packets, got["s1"].down_packets] == [2, 1, 1]
    assert got["s2"].byte_count == 70.0 and got["s2"].gap_mean == 0.1


def test_reprice_and_reconcile_nulls(spark):
    p = spark.createDataFrame([(1, 11.0, 10.0), (2, 15.0, 10.0), (3, None, 10.0), (4, 5.0, 0.0)], "sku int, agg_price double, base_price double")
    assert {r.sku: r.new_price for r in pr.reprice(p).collect()} == {1: 11.0, 2: 10.0, 3: 10.0, 4: 0.0}
    a = spark.createDataFrame([(1, None), (2, 1.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, None), (2, 2.0), (3, 0.0)], "k int, v double")
    assert sorted(r.k for r in pr.reconcile(a, b, "k", "v").collect()) == [2, 3]


def test_splits_are_total_and_stable(spark):
    df = spark.range(500).select(F.concat(F.lit("id"), "id").alias("id"))
    roles = df.select(hs.four_way_role(F.col("id"), ["a", "b", "c", "d"]).alias("r")).groupBy("r").count().collect()
    assert sum(r["count"] for r in roles) == 500 and {r.r for r in roles} == set("abcd")


def test_entropy_bounds(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("abcd",), ("é",), (None,)], "s string")
    assert [r[0] for r in df.select(F.round(tx.byte_entropy(F.col("s")), 6)).collect()] == [0.0, 0.0, 2.0, 1.0, 0.0]


def test_matrix_flags_missing(spark):
    df = spark.createDataFrame([("a", 1, 5, 2.0, float("inf")), ("b", 0, 6, None, 1.0)], "id string, label int, expected int, x double, y double")
    out = se.numeric_matrix(df, ["id"], ["label", "expected"])
    assert out.columns == ["id", "x", "x__missing", "y", "y__missing"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [("a", 2.0, 0, 0.0, 1), ("b", 0.0, 1, 1.0, 0)]


def test_sequence_is_padded_and_masked(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(3)], "k string, o int, v double")
    r = se.sequences(df, "k", "o", {"v": F.col("v"), "w": F.col("v") * 2}, 6).first()
    assert r.seq[:3] == [[0.0, 0.0], [1.0, 2.0], [2.0, 4.0]] and len(r.seq) == 6 and sum(r["mask"]) == 3


def test_violations_keep_every_rule(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 5, 9), ("c", None, 9)], "id string, x int, y int")
    got = au.violations(df, "id", {"big_x": (F.col("x") > 2, F.col("x")), "big_y": (F.col("y") > 5, F.col("y"))}).collect()
    assert sorted(map(tuple, got)) == [("b", "big_x", "5"), ("b", "big_y", "9"), ("c", "big_y", "9")]


def test_areas_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "label int, score double")
    assert ev.areas(df).first().roc_auc == 0.875
    assert ev.areas(df.where("label = 1")).first().roc_auc is None
    assert ev.threshold_for_recall(df.where("label = 1"), 0.9).first().threshold == 0.5


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": \n{"x": 2}\n')
    assert sorted(r.x for r in rd.read_jsonl_tolerant(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    assert rd.read_jsonl_tolerant(spark, str(tmp_path / "none"), "x int").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        rd.read_jsonl_strict(spark, str(tmp_path / "a.jsonl"), "x int").collect()
    (tmp_path / "code").write_text("3\n")
    assert rd.read_exit_code(spark, str(tmp_path / "code")).first().code == 3
    assert rd.read_exit_code(spark, str(tmp_path / "no")).first().code == -1
    for n in (1, 2):
        rd.append_snapshot(spark.createDataFrame([(n,)], "n int"), str(tmp_path / "history"))
    assert spark.read.json(str(tmp_path / "history")).count() == 2
    assert rd.ensure_columns(spark.createDataFrame([(1,)], "a int"), {"a": 0, "b": 7}).first() == (1, 7)


def test_model_status_and_calibration(spark):
    rows = spark.createDataFrame([(float(i % 2), float(i % 2) + i / 1000) for i in range(80)], "label double, x double")
    assert mo.status_of(rows) == "ok" and mo.status_of(rows.limit(0)) == "empty" and mo.status_of(rows.where("label = 1")) == "missing_split_or_label"
    p = mo.scored(mo.tree_expert(rows, ["x"]), rows)
    assert ev.areas(p).first().roc_auc == 1.0
    c = mo.calibrate(p, p).select("calibrated").collect()
    assert all(0 <= r[0] <= 1 for r in c)


def test_field_queries_take_whole_texts(spark, tmp_path):
    import collections
    import hashlib
    import math
    import re

    from tessera.plans.registry import QUERIES

    rng = random.Random(8)
    texts = ["", "aaaa", None, "a" * 2500 + "Z9 é" * 700, "".join(chr(rng.randrange(32, 900)) for _ in range(30_000)), "x" * 3000 + ".y.z", "ab " + "k" * 30, "K" * 5000]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def entropy(t):
        b = t.encode()
        return -sum(c / len(b) * math.log2(c / len(b)) for c in collections.Counter(b).values()) if b else 0.0

    def rows(name):
        return {r.doc_id: r for r in QUERIES[name](spark, f"file://{tmp_path}").collect()}

    e, c, g, f = (rows(f"fn_{n}") for n in ("entropy", "char_ratios", "grammar", "field_shape"))
    assert e[2].entropy == 0 and f[2].n_chars is None
    for i, t in enumerate(texts):
        if t is not None:
            assert abs(e[i].entropy - entropy(t)) < 2e-6
            assert abs(c[i].digits - sum("0" <= x <= "9" for x in t) / max(1, len(t))) < 2e-6
            assert abs(c[i].printable - sum(" " <= x <= "~" for x in t) / max(1, len(t))) < 2e-6
            assert (f[i].n_chars, f[i].n_bytes) == (len(t), len(t.encode()))
            assert abs(f[i].unique_share - len(set(t)) / max(1, len(t))) < 2e-6
            assert f[i].prefix_hash == hashlib.sha256(t[:8].encode()).hexdigest()[:12]
            assert {n: g[i][n] for n in tx.GRAMMARS} == {n: int(bool(re.search(p, t))) for n, p in tx.GRAMMARS.items()}


def test_running_sums_and_percentiles(spark):
    from tessera.operators.ranges import percentiles, running_sums

    rng = random.Random(4)
    values = [rng.choice([0.5, 1.0, rng.random() * 9]) for _ in range(500)]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)] + [(900, None, 1)], "id int, v double, n int")
    got = {r.id: r.upto for r in running_sums(df, F.col("v"), ["id"], {"upto": F.col("n")}, parts=7).collect()}
    order = [900] + sorted(range(500), key=lambda i: (values[i], i))
    assert got == {i: n + 1 for n, i in enumerate(order)}
    held = sorted(values)
    r = percentiles(df, "v", {"a": 0.5, "b": 0.95, "c": 0.0}).first()
    assert abs(r.a - (held[249] + held[250]) / 2) < 1e-12 and abs(r.b - (held[474] + 0.05 * (held[475] - held[474]))) < 1e-12 and r.c == held[0]
    assert percentiles(df.limit(0), "v", {"a": 0.5}).first().a is None


def test_captures(spark):
    import struct

    from tessera.sources.captures import decode_captures

    def record(order, ticks, frame, size=None):
        return struct.pack(order + "4I", 1000, ticks, len(frame), size or len(frame)) + frame

    v4 = bytes(12) + b"\x08\x00" + bytes([0x45, 0]) + (20 + 20 + 5).to_bytes(2) + bytes(5) + bytes([6, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + struct.pack(">HHII", 1024, 443, 77, 0) + bytes([0x50, 0x12]) + bytes(6) + b"hello"
    v6 = bytes(12) + b"\x86\xdd" + bytes([0x60, 0, 0, 0]) + (8 + 3).to_bytes(2) + bytes([17, 64]) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + struct.pack(">HHHH", 53, 5353, 11, 0) + b"abc"
    other = bytes(12) + b"\x08\x06" + bytes(28)
    little = b"\xd4\xc3\xb2\xa1" + bytes(20) + record("<", 250_000, v4) + record("<", 1, other) + record("<", 500_000, v6) + b"\x01\x02"
    nano = b"\xa1\xb2\x3c\x4d" + bytes(20) + record(">", 250_000_000, v4, 99)
    files = spark.createDataFrame([("a", little), ("b", nano), ("c", b"no capture"), ("d", b"")], "capture string, content binary")
    got = [tuple(r) for r in decode_captures(files).orderBy("capture", "number").collect()]
    assert got[0] == ("a", 0, 1_000_250_000, len(v4), "10.0.0.1", "10.0.0.2", "tcp", 1024, 443, 0x12, 77, 5)
    assert got[1] == ("a", 1, 1_000_500_000, len(v6), "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:2", "udp", 53, 5353, 0, 0, 3)
    assert got[2][:4] == ("b", 0, 1_000_250_000, 99) and len(got) == 3


def _capture(rng, n, order="<"):
    """A capture whose payloads themselves look like captures, with records of another protocol among them."""
    import struct

    out = {"<": b"\xd4\xc3\xb2\xa1", ">": b"\xa1\xb2\xc3\xd4"}[order] + bytes(20)
    fake = b"".join(struct.pack(order + "4I", 9, 5, 30, 30) + bytes(30) for _ in range(8))
    for i in range(n):
        inner = fake if rng.random() < 0.4 else rng.randbytes(rng.randrange(200))
        kind = b"\x08\x06" if i % 7 == 3 else b"\x08\x00"
        frame = bytes(12) + kind + bytes([0x45, 0]) + (28 + len(inner)).to_bytes(2) + bytes(5) + bytes([17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + struct.pack(">HHHH", 53, i % 65536, 8 + len(inner), 0) + inner
        out += struct.pack(order + "4I", 1000 + i, i, len(frame), len(frame)) + frame
    return out


def test_byte_classes_in_little_memory():
    """Counts of each text, also of empty and of long ones, without sums as wide as eight bytes for each byte."""
    import tracemalloc

    import numpy as np

    from tessera.functions.text import counts_between

    sizes = [0, 5, 0, 3_000_000, *[2_000] * 5_000, 0, 1, 0]
    data, ends = np.arange(sum(sizes), dtype=np.int64).astype(np.uint8), np.concatenate(([0], np.cumsum(sizes)))
    tables = np.array([[b % 3 == 0 for b in range(256)], [b > 250 for b in range(256)]])
    tracemalloc.start()
    got = counts_between(data, ends, tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(data)
    for n, table in zip(got, tables, strict=True):
        assert list(n) == [int(table[data[a:b]].sum()) for a, b in zip(ends, ends[1:])]
    assert [len(n) for n in counts_between(data[:0], np.zeros(1, np.int64), tables)] == [0, 0]


def test_packets_of_many_small_captures_share_a_batch():
    """Neither a batch for each capture nor one for all rows of a large one."""
    from tessera.sources.captures import _in_batches

    row = lambda name, n: (name, n, 0, 1, "", "", "tcp", 1, 2, 0, 0, 0)
    batches = list(_in_batches((row(f"c{i}", n) for i in range(50) for n in range(3)), 60))
    assert [len(b) for b in batches] == [60, 60, 30] and list(batches[0]["number"][:4]) == [0, 1, 2, 0]
    assert not list(_in_batches(iter(()))) and [len(b) for b in _in_batches((row("a", n) for n in range(5)), 2)] == [2, 2, 1]


@pytest.mark.parametrize("split", [61, 500, 4_096, 1 << 20])
def test_captures_by_ranges(spark, tmp_path, split):
    """Cut anywhere, also within payloads that look like records, files give the rows of the whole; what isn't a packet is counted."""
    from tessera.sources import captures as cp

    rng = random.Random(split)
    held = {"a": _capture(rng, 60), "b": _capture(rng, 40, ">")[:-5], "c": b"no capture" * 50, "d": _capture(rng, 1), "e": b""}
    for name, content in held.items():
        (tmp_path / f"{name}.pcap").write_bytes(content)
    want = sorted(tuple(r) for r in cp.decode_captures(spark.createDataFrame([(k, bytearray(v)) for k, v in held.items()], "capture string, content binary")).collect())
    assert sorted(tuple(r) for r in cp.read_captures(spark, f"file://{tmp_path}", split).collect()) == want
    report = {r.capture: r[1:] for r in cp.capture_report(cp.capture_ranges(spark, f"file://{tmp_path}", split)).collect()}
    assert report == {"a": (51, 9, 0), "b": (33, 6, 1), "c": (0, 0, 0), "d": (1, 0, 0)}


@pytest.mark.parametrize("split", [61, 4_096])
def test_captures_packed_and_in_folders(spark, tmp_path, split):
    """Captures end to end in few files give the rows of whole ones, and so do files in folders of folders, whose names the driver never lists."""
    from tessera.sources import captures as cp

    rng = random.Random(split)
    held = {f"c{i}": _capture(rng, i % 9, "<>"[i % 2])[: -3 if i % 4 == 3 else None] for i in range(40)} | {"none": b"", "odd name %": b"no capture" * 9}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in held.items()], "capture string, content binary")
    want = sorted(tuple(r) for r in cp.decode_captures(files).collect())
    packed = cp.pack_captures(files.repartition(3), f"file://{tmp_path}/packs")
    assert len(list((tmp_path / "packs").glob("*.pack"))) <= 3 and packed.count() == len(held)
    assert sorted(tuple(r) for r in cp.read_captures(spark, packed, split).collect()) == want
    for i, (name, content) in enumerate(held.items()):
        folder = tmp_path / "tree" / f"a b{i % 3}" / str(i % 2)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.pcap").write_bytes(content)
    (tmp_path / "tree" / "_SUCCESS").write_bytes(b"")
    listed = cp.listed_captures(spark, f"file://{tmp_path}/tree")
    assert {r.capture: r.length for r in listed.collect()} == {k: len(v) for k, v in held.items()}
    assert "BinaryFile" not in listed._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in cp.read_captures(spark, f"file://{tmp_path}/tree", split).collect()) == want


def test_sessions_assembled_from_their_sources(spark):
    """Two sessions, one without log rows or split: counts are 0, not null; flags as the files of exit codes say."""
    from tessera.operators import assembly as asm

    manifest = spark.createDataFrame([("s1", 0, None, "Clear", "full", "h3", 2), ("s2", None, 1, "ech", "full", "https", 5), ("s3", 3, 1, "clear", "bypass", "MASQUE", 0)], "session_id string, first_exit int, said int, visibility string, inspection string, protocol string, expected_packets int")
    packets = spark.createDataFrame([("s1", 2), ("s2", 4)], "session_id string, packet_count long")
    logs = spark.createDataFrame([("s2", 1, 0)], "session_id string, first_events long, second_events long")
    flags = asm.status_columns(F.col("first_exit"), F.lit(0), F.col("said"), F.lit(1), F.col("packet_count"))
    rows = asm.assemble(manifest, "session_id", packets, logs).withColumns(flags).na.fill(0, ["packet_count", "first_events", "second_events"])
    got = {r.session_id: r for r in rows.withColumns(asm.missing_reasons()).collect()}
    assert [got[x].first_parser_ok for x in ("s1", "s2", "s3")] == [1, 0, 0] and got["s1"].exported == 1 and got["s3"].sequence_available == 0
    why = lambda x: {n[8:] for n, v in got[x].asDict().items() if n.startswith("missing_") and v}
    assert why("s1") == {"parser_unsupported"} and why("s2") == {"encrypted", "parser_failed", "packet_loss"} and why("s3") == {"encrypted", "parser_unsupported", "parser_failed"}


def test_assembly_deals_each_source_once(spark):
    import re

    from tessera.plans.assembly import sessions

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        plan = sessions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    by_session = re.findall(r"Exchange hashpartitioning\(session_id#\d+, \d+\)", plan)
    # manifest, packets, log rows (already counted by value) and splits
    assert len(by_session) == 4


def test_log_values_are_counted_as_short_rows(spark):
    from tessera.plans.features import parser_aggregates

    plan = parser_aggregates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan  # as many copies of every column as there are distinct counts
    assert "Generate posexplode" in plan


def test_rate_expert(spark):
    from tessera.operators.assembly import rate_expert

    train = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0)], "cell int, label int")
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "cell int")
    assert {r.cell: round(r.p, 6) for r in rate_expert(train, rows, ["cell"]).collect()} == {1: 0.6, 2: 0.333333, 3: 0.5, None: 0.5}


def test_channels_stages_and_stored_columns(spark):
    from tessera.plans.features import packet_channels, select_stage, visible_channels

    assert (len(packet_channels()), len(visible_channels())) == (12, 21)
    catalogue = spark.createDataFrame([(i, "uri" if i % 2 else "rest") for i in range(200)], "scenario long, family string")
    assert [r.scenario for r in select_stage(catalogue, "parser", 1, 3).orderBy("scenario").collect()] == list(range(1, 60, 3))
    assert [r.scenario for r in select_stage(catalogue, "core", 0, 2).orderBy("scenario").limit(3).collect()] == [1, 5, 9]
    with pytest.raises(ValueError, match="unknown stage"):
        select_stage(catalogue, "none")
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 3.0)], "id string, seed long, x double")
    assert se.replay_matrix(df, ["id"], ["seed"], ["x", "x__missing", "y", "y__missing"]).orderBy("id").collect() == [("a", 0.0, 1, 0.0, 1), ("b", 3.0, 0, 0.0, 1)]
    with pytest.raises(ValueError, match="forbidden"):
        se.replay_matrix(df, ["id"], ["seed"], ["seed"])


def grown_by_hand(x, y, depth):
    """Means of the leaves of a tree by exhaustive search, for the rows themselves."""
    if depth == 0 or len(y) < 2:
        return [sum(y) / len(y)] * len(y)
    best = None
    for f in range(len(x[0])):
        for cut in sorted({r[f] for r in x})[:-1]:
            left = [v for r, v in zip(x, y) if r[f] <= cut]
            right = [v for r, v in zip(x, y) if r[f] > cut]
            gain = round(sum(left) ** 2 / len(left) + sum(right) ** 2 / len(right) - sum(y) ** 2 / len(y), 6)
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, f, cut
    if best is None:
        return [sum(y) / len(y)] * len(y)
    _, f, cut = best
    out = [None] * len(y)
    for side in (True, False):
        at = [i for i, r in enumerate(x) if (r[f] <= cut) == side]
        for i, v in zip(at, grown_by_hand([x[i] for i in at], [y[i] for i in at], depth - 1)):
            out[i] = v
    return out


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_trees_of_all_groups_at_once(spark, depth):
    """Each group's tree is the one that an exhaustive search grows on its rows alone; a null group is a group."""
    rng = random.Random(depth)
    rows = [(i, g, float(rng.randrange(12)), float(rng.randrange(9)), round(rng.random() * 50, 3)) for i, g in enumerate(rng.choices(["a", "b", None, "few"], [40, 60, 30, 2], k=150))]
    asked = [(1_000 + i, g, float(i), 2.0, None) for i, g in enumerate(["a", "b", None, "new"])]
    df = spark.createDataFrame(rows + asked, "id int, g string, u double, v double, price double")
    trees, value = mo.trees_by_group(df, "price", ["u", "v"], "g", depth)
    got = {r.id: r for r in mo.impute_by_tree(df.withColumn("known", F.col("price")), "price", ["u", "v"], "g", depth).collect()}
    assert all(got[r[0]].filled == r[4] and not got[r[0]].imputed for r in rows)
    assert got[1_003].filled is None and all(got[i].imputed and got[i].filled is not None for i in (1_000, 1_001, 1_002))
    leaves = {(r._g, r.leaf): r.value for r in value.collect()}
    for g in ("a", "b", None):
        own = [r for r in rows if r[1] == g]
        want = sorted({round(m, 6) for m in grown_by_hand([r[2:4] for r in own], [r[4] for r in own], depth)})
        key = "{}" if g is None else f'{{"g":"{g}"}}'
        assert sorted({round(v, 6) for (k, _), v in leaves.items() if k == key}) == want


def test_levels_of_trees_read_cells(spark, monkeypatch):
    """Rows with the same bins are one row for all levels, and their number and sum count."""
    held, stored = {}, mo._stored
    monkeypatch.setattr(mo, "_stored", lambda df, name: held.setdefault(name, stored(df, name)))
    df = spark.createDataFrame([("a", float(i % 3), float(i % 3 * 10 + i % 2)) for i in range(600)], "g string, u double, price double")
    _, value = mo.trees_by_group(df, "price", ["u"], "g", 1)
    assert held["binned"].count() == 3
    assert sorted(round(r.value, 9) for r in value.collect()) == [0.5, 15.5]


def test_jobs_of_trees_dont_grow_with_groups(spark):
    def jobs(groups):
        spark.sparkContext.setJobGroup(f"trees-{groups}", "")
        df = spark.createDataFrame([(i % groups, float(i % 7), float(i % 11)) for i in range(300)], "g int, u double, price double")
        mo.impute_by_tree(df, "price", ["u"], "g", 2).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees-{groups}"))

    assert abs(jobs(2) - jobs(60)) <= 3


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_grouped_percentiles(spark, parts):
    """Against sorted lists: a hot group, ties, single values, a null group, groups of nulls."""
    from tessera.operators.ranges import grouped_percentiles

    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([0.0, 1.5, rng.random(), rng.randrange(5) * 1.0])) for _ in range(700)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = {"low": 0.0, "q1": 0.25, "median": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.k: r for r in grouped_percentiles(df, "k", "x", shares, parts).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        own = sorted(x for g, x in rows if g == k and x is not None)
        if own:
            want[k] = [own[int(s * (len(own) - 1))] * (1 - s * (len(own) - 1) % 1) + own[min(len(own) - 1, int(s * (len(own) - 1)) + 1)] * (s * (len(own) - 1) % 1) for s in shares.values()]
    assert set(got) == set(want)
    for k, values in want.items():
        assert [round(got[k][n], 9) for n in shares] == [round(v, 9) for v in values]


def test_lines_kept_and_rejected_add_up(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(['{"a": 1, "b": 2}', "", "   ", '{"a": 1, ', "[1]", '{"a": null, "b": 3}', '{"a": 5}', '{"a": 6, "b": 1, "more": 0}']))
    found = rd.sort_jsonl(spark, str(tmp_path / "x.jsonl"), "a long, b long", {"no_a": F.col("a").isNull(), "b_first": F.col("b") < F.col("a")})
    assert sorted((r.a, r.b or 0) for r in found.kept.collect()) == [(1, 2), (5, 0)]
    assert sorted((r.reason, r.line) for r in found.rejected.collect()) == sorted([("blank", ""), ("blank", "   "), ("malformed", '{"a": 1, '), ("malformed", "[1]"), ("no_a", '{"a": null, "b": 3}'), ("b_first", '{"a": 6, "b": 1, "more": 0}')])
    assert found.counts == {"read": 8, "kept": 2, "blank": 2, "malformed": 2, "no_a": 1, "b_first": 1}
    none = rd.sort_jsonl(spark, str(tmp_path / "absent"), "a long", {})
    assert none.kept.count() == none.rejected.count() == none.counts["read"] == 0


def test_a_bad_shard_stops_no_other(spark, tmp_path):
    def derive(shard):
        if shard == "bad":
            raise RuntimeError("broken manifest")
        return spark.range(0 if shard == "none" else 3)

    first = {r.shard: (r.state, r.n, r.reason) for r in rd.backfill_shards(spark, ["a", "bad", "b", "none"], derive, str(tmp_path)).collect()}
    assert first == {"a": ("built", 3, ""), "bad": ("error", 0, "RuntimeError"), "b": ("built", 3, ""), "none": ("error", 0, "no rows")}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["a", "b"]  # nothing half done is left
    assert {r.state for r in rd.backfill_shards(spark, ["a", "b"], derive, str(tmp_path)).collect()} == {"skipped"}


def test_cells_points_and_roll_up(spark):
    """A cell without a rate of false positives takes it from its matrix or counts as 1; evidence that no source has is missing, not failed."""
    from tessera.operators import acceptance as acc

    schema = "name string, rows long, precision double, recall double, fpr double, fp long, tn long"
    cells = [("given", 100, 0.96, 0.95, 0.00005, None, None), ("counted", 100, 1.0, 1.0, None, 0, 50), ("too many", 100, 1.0, 1.0, None, 1, 99), ("no rate", 100, 1.0, 1.0, None, None, None), ("no rows", 0, 1.0, 1.0, 0.0, 0, 0), ("unknown", None, None, None, None, None, None), ("imprecise", 9, 0.5, 1.0, 0.0, 0, 9)]
    df = spark.createDataFrame(cells, schema)
    assert {r.name for r in df.where(acc.cell_passes()).collect()} == {"given", "counted"}
    assert {r.name for r in df.where(acc.cell_passes(None)).collect()} == {"given", "counted", "imprecise"}
    needed = acc.required(spark)
    assert needed.select("point").distinct().count() == 9
    every = needed.select("source", "fact").distinct().withColumn("ok", F.lit(True))
    some = every.where("fact <> 'fusion'").withColumn("ok", F.when(F.col("fact") == "clients", F.lit(False)).otherwise(F.when(F.col("fact") != "networks", True)))
    got = {r.point: (r.ready, r.missing, r.failed) for r in acc.points(needed, some).collect()}
    assert got["visibility_fusion"] == (False, 1, 0) and got["client_server_diversity"] == (False, 0, 2) and got["sequence_expert"] == (True, 0, 0)
    valid, passed = spark.createDataFrame([(True,)], "valid boolean"), spark.createDataFrame([(True,)], "passed boolean")
    up = lambda cells, facts, **k: acc.roll_up(valid, cells, acc.points(needed, facts), **k).first().candidate
    assert up(passed, every) and not up(passed, some) and up(passed, some, evidence_required=False) and not up(passed.limit(0), every)


def test_changes_of_many_histories(spark):
    from tessera.operators.histories import changes_by_entity

    rows = [("a", 1, 5, None), ("a", 2, 5, None), ("a", 3, 6, "x"), ("b", 2, 1, "y"), ("b", 9, 1, None)]
    df = changes_by_entity(spark.createDataFrame(rows, "who string, day int, n int, note string"), "who", "day", ["n", "note"])
    got = {(r.who, r.day): (r.state, {k: tuple(v) for k, v in (r.changes or {}).items()}) for r in df.collect()}
    assert got == {("a", 1): ("initial", {}), ("a", 2): ("same", {}), ("a", 3): ("changed", {"n": ("5", "6"), "note": (None, "x")}), ("b", 2): ("initial", {}), ("b", 9): ("changed", {"note": ("y", None)})}
    digests = {(r.who, r.day): r.digest for r in df.collect()}
    assert digests["a", 1] == digests["a", 2] != digests["a", 3]
    assert "Window" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "SinglePartition" not in plan


def test_shares_of_signs(spark):
    import re

    texts = ["", None, "Ab 9-é", "漢字 12", "x" * 3_000 + "é" * 7, "tab\there", "a"]
    classes = {"digits": "0-9", "lower": "a-z", "marks": ",.-"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", tx.ascii_shares(F.col("t"), classes).alias("x")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else tuple(len(re.findall(f"[{c}]", t)) / max(1, len(t)) for c in classes.values())
        assert (got[i] if got[i] is None else tuple(got[i])) == want
