"""Sessions with everything that is known of them, and the frames and scores that experts take from that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import hashing as hs
from tessera.operators import assembly as asm
from tessera.operators import intervals as iv
from tessera.operators import sessions as se
from tessera.plans.features import _PARSER, _PARSER_COLUMNS, _PARSER_ROWS, parser_aggregates
from tessera.plans.sessions import _T, KINDS, v_tx
from tessera.plans.tabular import _FEATURES, _PER, attributed
from tessera.plans.views import sql, table

c = F.col

#: What the manifest says of a session, for both engines.
_SAYS = {
    "label": "CASE WHEN value > 40 THEN 1 ELSE 0 END", "visibility": "CASE event_id % 5 WHEN 0 THEN 'Opaque' WHEN 1 THEN 'encrypted' ELSE CASE WHEN event_id % 13 = 2 THEN 'ECH' ELSE 'clear' END END", "inspection": "CASE WHEN event_id % 7 = 0 THEN 'bypass' ELSE 'full' END", "sni": "CASE WHEN event_id % 6 = 0 THEN 'hidden' ELSE 'Clear' END",
    "protocol": "CASE event_id % 6 WHEN 0 THEN 'quic' WHEN 1 THEN 'H3' WHEN 2 THEN 'webtransport' WHEN 3 THEN 'masque' ELSE 'https' END", "expected_packets": "CASE WHEN event_id % 10 = 0 THEN 3 ELSE 1 END", "first_exit": "CASE WHEN event_id % 41 = 0 THEN 2 WHEN event_id % 37 = 0 THEN NULL ELSE 0 END", "second_exit": "CASE WHEN event_id % 43 = 0 THEN -1 ELSE 0 END",
    "said_exported": "CASE WHEN event_id % 47 = 0 THEN 0 WHEN event_id % 3 = 0 THEN NULL ELSE 1 END", "said_tail": "CASE WHEN event_id % 29 = 0 THEN 0 ELSE 1 END",
}
_OF = "SELECT concat('x-', event_id) AS session_id, event_id, user_id AS src, " + ", ".join(f"{e} AS {k}" for k, e in _SAYS.items()) + " FROM events WHERE event_type = 'signup'"
_HASH = "('0x' || substr(sha256(session_id), 1, 8))::BIGINT"
_SPLIT = f"SELECT session_id, CASE WHEN src % 10 = 3 THEN 'test' WHEN {_HASH} % 100 < 70 THEN 'train' ELSE 'validation' END AS split FROM v_session WHERE event_id % 9 <> 0"


def v_session(s, d) -> DataFrame:
    return table(s, d, "events").where("event_type = 'signup'").selectExpr("concat('x-', event_id) AS session_id", "event_id", "user_id AS src", *(f"{e} AS {k}" for k, e in _SAYS.items()))


def splits(s, d) -> DataFrame:
    """The part of each session but for every ninth, which no list names."""
    return v_session(s, d).where("event_id % 9 <> 0").select("session_id", F.when(c("src") % 10 == 3, "test").otherwise(hs.hash_split(c("session_id"), 70)).alias("split"))


def sessions(s, d) -> DataFrame:
    """Manifest, 18 packet columns, 26 parser columns, the split (``challenge`` where none is named) and status flags."""
    packets, parsed = iv.packet_aggregates(attributed(s, d)), parser_aggregates(s, d)
    joined = asm.assemble(v_session(s, d).drop("event_id", "src"), "session_id", packets, parsed, splits(s, d))
    flags = asm.status_columns(c("first_exit"), c("second_exit"), c("said_exported"), c("said_tail"), c("packet_count"))
    return joined.select(
        "session_id", "label", F.coalesce("split", F.lit("challenge")).alias("split"), "visibility", "inspection", "sni", "protocol", "expected_packets",
        *iv.packet_filled(packets.columns[1:]), *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in parsed.columns[1:]), *(x.alias(n) for n, x in flags.items()),
    )


_FLAGS = "coalesce((first_exit = 0)::INTEGER, 0) AS first_parser_ok, coalesce((second_exit = 0)::INTEGER, 0) AS second_parser_ok, coalesce(said_exported, 1) AS exported, coalesce(said_tail, 1) AS tail_pass, (packet_count > 0)::INTEGER AS sequence_available"
_SESSIONS = f"SELECT * EXCLUDE (event_id, src, split, first_exit, second_exit, said_exported, said_tail), coalesce(split, 'challenge') AS split, {_FLAGS} FROM v_session LEFT JOIN pf USING (session_id) LEFT JOIN ps USING (session_id) LEFT JOIN sp USING (session_id)"
_CTES = {**{k: v for k, v in _T.items() if k != "tx"}, **_PER, "pr": _PARSER_ROWS, "v_session": _OF, "pf": _FEATURES, "ps": _PARSER, "sp": _SPLIT, "f": _SESSIONS}
_VIEWS = ("v_interval", "v_probe", "v_log")
_HID = f"(coalesce(regexp_matches(lower(visibility), '{asm.HIDDEN}'), FALSE) OR coalesce(inspection = 'bypass', FALSE))"
_REASONS = {"encrypted": _HID, "parser_unsupported": f"first_events + second_events = 0 AND lower(protocol) IN ({', '.join(map(repr, asm.UNREAD))})", "parser_failed": "first_parser_ok = 0 OR second_parser_ok = 0", "packet_loss": "expected_packets > 0 AND packet_count < expected_packets * 0.98::DOUBLE", "truncated": "tail_pass = 0", "not_exported": "exported = 0"}
_MISSING = ", ".join(f"({e})::INTEGER AS missing_{n}" for n, e in _REASONS.items()) + ", (NOT (" + " OR ".join(f"({e})" for e in _REASONS.values()) + "))::INTEGER AS missing_genuinely_absent"
_AVAILABLE = f"regexp_matches(lower(visibility), '{asm.HIDDEN}')::INTEGER AS available_encrypted, (inspection = 'bypass')::INTEGER AS available_bypassed, (lower(sni) NOT IN ('clear', 'visible'))::INTEGER AS available_sni_hidden, (first_events + second_events > 0)::INTEGER AS available_parser_any"

# --- frames ---------------------------------------------------------------------------------

PACKETS = ["packet_count", "byte_count", "duration", "size_mean", "size_std", "size_p95", "gap_mean", "gap_std", "up_bytes", "down_bytes", "up_packets", "down_packets", "tcp_packets", "udp_packets", "syn_packets", "rst_packets", "gap_cv", "up_down_ratio"]
CONTENT = ["req", "resp", "kind", "status"]
TOTALS = [f"{x}_{k}" for x in ("req", "resp", "status") for k in KINDS]
OPAQUE = list(_PARSER_COLUMNS)


def session_totals(s, d) -> DataFrame:
    return se.aggregate_all(v_tx(s, d), ["session_id"], ["req", "resp", "status"], KINDS)


def frames(s, d, whole: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows that each expert may learn from: transactions of visible sessions, visible sessions with totals of theirs, and every session with what its wire shows."""
    whole = sessions(s, d) if whole is None else whole
    seen = whole.where(asm.visible())
    keys = ["session_id", "label", "split"]
    return {
        "content": seen.select(*keys).join(v_tx(s, d).select("session_id", "rec", *(c(x).cast("double").alias(x) for x in CONTENT)), "session_id"),
        "session": seen.select(*keys, *(c(x).cast("double").alias(x) for x in PACKETS)).join(session_totals(s, d).select("session_id", *(c(x).cast("double").alias(x) for x in TOTALS)), "session_id", "left"),
        "opaque": whole.select(*keys, *(c(x).cast("double").alias(x) for x in (*PACKETS, *OPAQUE)), *(x.alias(n) for n, x in (asm.availability() | asm.missing_reasons()).items())),
    }


def expert_frames(s, d) -> DataFrame:
    """The three frames in one table; a column is null in frames that may not use it."""
    out = None
    for name, rows in frames(s, d).items():
        rows = rows.withColumn("frame", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


_DOUBLES = lambda names: ", ".join(f"{x}::DOUBLE AS {x}" for x in names)
_TOTALS = "SELECT session_id, " + ", ".join(f"round({f}({x}), 6)::DOUBLE AS {x}_{k}" for x in ("req", "resp", "status") for k, f in {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}.items()) + " FROM tx GROUP BY session_id"
_FRAMES = (f"SELECT 'content' AS frame, session_id, label, split, rec, {_DOUBLES(CONTENT)} FROM f JOIN tx USING (session_id) WHERE NOT {_HID} UNION ALL BY NAME SELECT 'session' AS frame, session_id, label, split, {_DOUBLES(PACKETS)}, {', '.join(TOTALS)} FROM f LEFT JOIN tt USING (session_id) WHERE NOT {_HID}"
           f" UNION ALL BY NAME SELECT 'opaque' AS frame, session_id, label, split, {_DOUBLES((*PACKETS, *OPAQUE))}, {_AVAILABLE}, {_MISSING} FROM f")

# --- scores ---------------------------------------------------------------------------------

_CELLS = {"session": {"size_cell": "floor(ln(1 + size_mean) * 2)"}, "opaque": {"log_cell": "least(first_events + second_events, 5)", "up_cell": "least(up_packets, 3)"}, "content": {"kind": "kind", "req_cell": "floor(ln(1 + req) * 2)"}}


def fusion_table(s, d) -> DataFrame:
    """Scores of three experts (rate tables learned from the training part) by session, hidden where their input is, with flags of what there is."""
    whole = sessions(s, d)
    found = []
    for name, rows in frames(s, d, whole).items():
        celled = rows.withColumns({k: F.expr(e).cast("double") for k, e in _CELLS[name].items()})
        scored = asm.rate_expert(celled.where("split = 'train'"), celled, list(_CELLS[name]))
        found.append(scored.groupBy("session_id").agg(F.round(F.avg("p"), 6).alias(f"p_{name}"), *([F.round(F.max("p"), 6).alias("p_content_max")] if name == "content" else [])))
    out = asm.assemble(whole.select("session_id", "label", "split", "sequence_available"), "session_id", *found)
    names = ["p_content", "p_session", "p_opaque"]
    return out.withColumn("p_opaque", F.when(c("sequence_available") == 1, c("p_opaque"))).select("session_id", "label", "split", "p_content", "p_content_max", "p_session", "p_opaque", *(c(x).isNotNull().cast("int").alias(f"has_{x[2:]}") for x in names))


def _rates(name: str, source: str, where: str) -> str:
    """(session_id, p): the mean rate of a session's cells."""
    cells = ", ".join(f"({e})::DOUBLE AS {k}" for k, e in _CELLS[name].items())
    keys = ", ".join(f"cell_{k}" for k in _CELLS[name])
    held = f"(SELECT session_id, label, split, {cells.replace(' AS ', ' AS cell_')} FROM {source} WHERE {where})"
    return f"SELECT session_id, round(avg(coalesce(p, 0.5::DOUBLE)), 6) AS p, round(max(coalesce(p, 0.5::DOUBLE)), 6) AS most FROM {held} LEFT JOIN (SELECT {keys}, (sum(label) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) AS p FROM {held} WHERE split = 'train' GROUP BY ALL) USING ({keys}) GROUP BY session_id"


_FUSION = "SELECT session_id, label, split, c.p AS p_content, c.most AS p_content_max, s.p AS p_session, CASE WHEN sequence_available = 1 THEN o.p END AS p_opaque, (c.p IS NOT NULL)::INTEGER AS has_content, (s.p IS NOT NULL)::INTEGER AS has_session, (sequence_available = 1)::INTEGER AS has_opaque FROM f LEFT JOIN ec c USING (session_id) LEFT JOIN es s USING (session_id) LEFT JOIN eo o USING (session_id)"
_EXPERTS = dict(ec=_rates("content", "f JOIN tx USING (session_id)", f"NOT {_HID}"), es=_rates("session", "f", f"NOT {_HID}"), eo=_rates("opaque", "f", "TRUE"))

QUERIES = {
    "session_assemble": sessions,
    "feat_missing_reason": lambda s, d: sessions(s, d).select("session_id", *(x.alias(n) for n, x in asm.missing_reasons().items())),
    "feat_availability": lambda s, d: sessions(s, d).select("session_id", *(x.alias(n) for n, x in asm.availability().items())),
    "frames_experts": expert_frames,
    "fusion_table": fusion_table,
}
ORACLES = {
    "session_assemble": sql("SELECT * FROM f", *_VIEWS, **_CTES),
    "feat_missing_reason": sql(f"SELECT session_id, {_MISSING} FROM f", *_VIEWS, **_CTES),
    "feat_availability": sql(f"SELECT session_id, {_AVAILABLE} FROM f", *_VIEWS, **_CTES),
    "frames_experts": sql(_FRAMES, *_VIEWS, **_CTES, tx=_T["tx"], tt=_TOTALS),
    "fusion_table": sql(_FUSION, *_VIEWS, **_CTES, tx=_T["tx"], **_EXPERTS),
}
