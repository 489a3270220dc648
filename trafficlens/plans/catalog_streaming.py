"""Registered queries that run as streams over the event files."""

import glob
import shutil
import uuid

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..sources import derived as D
from ..schema import FEATURES
from ..sources.adapters import events_to_requests, requests_of
from ..session import shared_folder
from ..sources.archive import read_archive
from ..streaming import live as L
from ..streaming.run import disk_state, drain, drain_counters
from . import oracle_base as B
from .catalog_datasets import COMPARED_FEATURES, DECISION_COLUMNS
from .catalog_signals import bind_query
from .registry import Registry, rounded

streaming = Registry()


def request_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return events_to_requests(events)


@streaming.query(
    "stream_closed_sessions",
    B.over_sessions(
        """SELECT ip, start_us, end_us, requests FROM (
        SELECT ip, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS requests FROM ses
        GROUP BY ip, session_no)
        WHERE (end_us + 1800000000) // 1000 <= (SELECT max(ts_us) FROM req) // 1000 - 600000"""
    ),
    "S3 C3",
)
def _(spark, sf):
    return drain(L.closed_sessions(request_stream(spark, sf)))


@streaming.query(
    "stream_decisions", B.over_retained("SELECT * FROM decided", 200, 1800, B.LIVE), "S2 C11"
)
def _(spark, sf):
    rows = L.score_stream(request_stream(spark, sf), S.load_network()).select(DECISION_COLUMNS)
    return rounded(drain(rows), "model_score", "score")


#: What the watermark has passed once all events are read, in microseconds.
PASSED_US = "((SELECT max(ts_us) FROM req) // 1000 - 600000) * 1000"


@streaming.query(
    "stream_session_scores",
    B.with_ctes(
        f"""SELECT ip || '#' || start_us AS session_id, ip, start_us, end_us, requests, user_agent, top_endpoint,
        {", ".join(f"round({f}, 6) AS {f}" for f in COMPARED_FEATURES)}, rule_code,
        round(model_score, 6) AS model_score, round(score, 6) AS score,
        CASE WHEN score >= 0.7 THEN 'bot' ELSE 'human' END AS label
        FROM tailed WHERE end_us + 300000000 <= {PASSED_US}""",
        B.REQ, B.sessions_cte(timeout_s=300), B.FLAG, B.CHAR_ENTROPY, B.INPUTS, B.FEATS, B.TAILED,
    ),
    "S3 C3",
)
def _(spark, sf):
    """Sessions of five minutes scored when they end, from what the stream has kept of them."""
    rows = L.score_sessions(request_stream(spark, sf), S.load_network()).select(
        "session_id", "ip", "start_us", "end_us", "requests", "user_agent", "top_endpoint", *COMPARED_FEATURES,
        "rule_code", "model_score", "score", "label",
    )
    return rounded(drain(rows), *COMPARED_FEATURES, "model_score", "score")


def decision_stream(spark, sf):
    """A stream of decisions by the simplest rule: the user agent."""
    return request_stream(spark, sf).select(
        "ip",
        "ts",
        F.concat(F.lit("d"), (F.col("line_no") - F.col("line_no") % 2).cast("string")).alias("decision_id"),
        F.when(X.is_certain_bot_agent(F.col("user_agent")), "bot").otherwise("human").alias("label"),
        ((F.col("line_no") % 20) / F.lit(20.0)).alias("score"),
    )


@streaming.query(
    "stream_counters",
    B.over_requests(
        f"""SELECT least(floor(((line_no % 20) / 20.0::DOUBLE) * 20), 19)::INT AS bucket,
        CASE WHEN {B.hit("user_agent", B.P.alternation(B.P.CERTAIN_BOT_PATTERNS))} THEN 'bot'
          ELSE 'human' END AS label, count(*) AS n,
        round(sum((line_no % 20) / 20.0::DOUBLE), 6) AS score_sum FROM req GROUP BY ALL"""
    ),
    "S4 E3",
)
def _(spark, sf):
    return rounded(drain_counters(L.live_counters(decision_stream(spark, sf))), "score_sum")


@streaming.query(
    "stream_deduplicated",
    B.over_requests("SELECT DISTINCT 'd' || (line_no - line_no % 2) AS decision_id FROM req"),
    "S8",
)
def _(spark, sf):
    return drain(L.deduplicated(decision_stream(spark, sf)).select("decision_id"))


@streaming.query(
    "stream_enriched",
    B.over_requests("SELECT line_no, user_id % 17 = 0 AS tor_exit FROM req"),
    "S5",
)
def _(spark, sf):
    exits = D.tor_exits(spark, sf).distinct().withColumn("tor_exit", F.lit(True))
    joined = request_stream(spark, sf).join(exits, "ip", "left")
    return drain(joined.select("line_no", F.coalesce("tor_exit", F.lit(False)).alias("tor_exit")))


@streaming.query(
    "stream_bindings",
    "WITH RECURSIVE " + ",".join([B.REQ, """
valid AS (SELECT ip, sha256(CAST(user_id % 10 + CASE WHEN line_no % 11 = 0 THEN 50 ELSE 0 END AS VARCHAR))
    AS hash, ts_us, line_no AS seq, row_number() OVER (PARTITION BY ip ORDER BY ts_us, line_no) AS rn FROM req),
walk AS (
  SELECT ip, seq, rn, hash AS held, ts_us AS since, 'ACCEPTED' AS outcome FROM valid WHERE rn = 1
  UNION ALL
  SELECT v.ip, v.seq, v.rn, CASE WHEN v.ts_us - w.since > 1800000000 THEN v.hash ELSE w.held END,
    CASE WHEN v.ts_us - w.since > 1800000000 THEN v.ts_us ELSE w.since END,
    CASE WHEN v.ts_us - w.since > 1800000000 THEN 'ACCEPTED'
      WHEN v.hash = w.held THEN 'REPEAT' ELSE 'ALREADY_BOUND' END
  FROM walk w JOIN valid v ON v.ip = w.ip AND v.rn = w.rn + 1)"""])
    + "\nSELECT seq, outcome FROM walk",
    "S6 C14",
)
def _(spark, sf):
    uid, eid = F.col("user_id"), F.col("line_no")
    value = F.sha2((uid % 10 + F.when(eid % 11 == 0, 50).otherwise(0)).cast("string"), 256)
    subs = request_stream(spark, sf).select("ip", value.alias("hash"), "ts", "ts_us", eid.alias("seq"))
    return drain(L.bind_stream(subs)).select("seq", "outcome")




_SEEN_US = "((SELECT greatest((SELECT max(ts_us) FROM req), (SELECT max(ts_us) FROM subs))) // 1000 - 600000) * 1000"


def outcome_stream(spark, sf):
    requests = request_stream(spark, sf)
    subs = D.submissions_of(request_stream(spark, sf)).withColumn("ts", F.timestamp_micros("ts_us"))
    return L.submission_outcomes(subs, requests)


@streaming.query(
    "stream_submission_outcomes",
    bind_query(
        f"""SELECT ip, hash, ts_us, seq, outcome FROM (
          SELECT ip, hash, ts_us, seq, outcome FROM walk
          UNION ALL SELECT ip, hash, ts_us, seq, reject FROM checked WHERE reject IS NOT NULL)
        WHERE ts_us <= {_SEEN_US}"""
    ),
    "S6 C14",
)
def _(spark, sf):
    """Requests and submissions as one stream: binding, refusals and their reasons."""
    return drain(outcome_stream(spark, sf)).select("ip", "hash", "ts_us", "seq", "outcome")


@streaming.query(
    "stream_shared_counts",
    bind_query(f"SELECT ip, hash, ts_us, seq, shared_ips FROM shared WHERE ts_us <= {_SEEN_US}"),
    "S6 C13",
)
def _(spark, sf):
    """How many addresses share a fingerprint, counted behind the binding while the stream runs."""
    return drain(L.shared_counts(outcome_stream(spark, sf)))


# --- text that grows, control and signals by time, the archive ----------------------------------


@streaming.query(
    "stream_log_lines",
    B.over_requests("SELECT ip, method, url, status, size, user_agent, raw_line FROM req WHERE line_no % 3 <> 0"),
    "S1 A3",
)
def _(spark, sf):
    """A log that grows between runs and is then replaced: what it holds at the first start is passed
    over, every later line comes once."""
    base = f"{shared_folder(spark)}/tailed-{uuid.uuid4().hex}"
    lines = requests_of(spark, sf)
    for third in range(3):
        lines.where(F.col("line_no") % 3 == third).select("raw_line").write.text(f"{base}/third-{third}")

    def write(third, mode):
        with open(f"{base}/access.log", mode) as log:
            for part in sorted(glob.glob(f"{base}/third-{third}/part-*")):
                with open(part, "rb") as rows:
                    shutil.copyfileobj(rows, log)

    for third, mode in enumerate(("wb", "ab", "wb")):
        write(third, mode)
        found = drain(L.tail_requests(spark, f"{base}/access.log"), f"{base}/drained")
    return found.select("ip", "method", "url", "status", "size", "user_agent", "raw_line")


#: Operators lower the threshold and let exit nodes decide; later the list of exit nodes arrives.
EDITED_US, LISTED_US = 1_704_067_200_000_000 + 21_600_000_000, 1_704_067_200_000_000 + 28_800_000_000

CONTROLLED_SQL = f"""
{B.VERDICTS},
ctl AS (SELECT f.*, u.user_id, end_us >= {EDITED_US} AS tor_promoted, end_us >= {LISTED_US} AND user_id % 17 = 0 AS tor_exit,
    false AS abuse_promoted, 0 AS abuse_score, false AS fp_promoted, NULL AS fingerprint_hash, 0 AS shared_hash_ips,
    CASE WHEN end_us >= {EDITED_US} THEN 0.5::DOUBLE ELSE 0.85 END AS threshold
  FROM feats f JOIN (SELECT DISTINCT ip, user_id FROM req) u USING (ip)),
coded AS (SELECT *, {B.chain_case(True)} AS rule_code FROM ctl),
labelled AS (SELECT * FROM coded JOIN verdicts USING (rule_code)),
modelled AS (SELECT *, CASE WHEN heuristic_label = 'automated-integration' THEN 0 ELSE {B.network_sql()} END AS model_score FROM labelled),
blended AS (SELECT *, CASE WHEN heuristic_label = 'automated-integration' THEN 0 ELSE {B.blend_sql()} END AS score FROM modelled)"""


@streaming.query(
    "stream_controlled",
    B.over_retained(
        """SELECT ip, session_no AS line_no, rule_code, threshold, round(score, 6) AS score,
        heuristic_label <> 'automated-integration' AND score > threshold AS blocked FROM blended""",
        200, 1800, CONTROLLED_SQL,
    ),
    "S7 S5",
)
def _(spark, sf):
    """Threshold, promoted sources and signals change while the stream runs; each request is judged by
    what held at its time."""
    at = lambda us: F.timestamp_micros(F.lit(us))
    edits = spark.range(2).select(
        F.when(F.col("id") == 0, at(0)).otherwise(at(EDITED_US)).alias("valid_from"),
        F.when(F.col("id") == 0, 0.85).otherwise(0.5).alias("threshold"),
        F.when(F.col("id") == 1, F.array(F.lit("tor"))).otherwise(F.array().cast("array<string>")).alias("promoted"),
    )
    users = D.users(spark, sf).select("ip", at(0).alias("valid_from"), F.lit(False).alias("tor_exit"))
    exits = D.tor_exits(spark, sf).select("ip").distinct().select("ip", at(LISTED_US).alias("valid_from"), F.lit(True).alias("tor_exit"))
    signals = users.unionByName(exits).select(
        "ip", "valid_from", F.lit(True).alias("resolved"), "tor_exit", F.lit(False).alias("hosting_range"),
        F.lit(None).cast("double").alias("abuse_score"), F.lit(False).alias("fp_resolved"),
        F.lit(None).cast("string").alias("fingerprint_hash"), F.lit(0).cast("long").alias("shared_hash_ips"),
    )
    rows = L.score_controlled(request_stream(spark, sf), S.load_network(), edits, signals)
    return rounded(drain(rows.select("ip", "line_no", "rule_code", "threshold", "score", "blocked")), "score")


@streaming.query(
    "stream_archive",
    B.over_retained(
        f"""SELECT ip || '-' || line_no AS decision_id, ip, round(score, 6) AS score, round(model_score, 6) AS model_score,
        heuristic_label, blocked, round(endpoint_count, 6) AS endpoint_count FROM (
        SELECT *, session_no AS line_no, CASE WHEN heuristic_label <> 'automated-integration' AND score > 0.85
          THEN true ELSE false END AS blocked FROM blended)""",
        200, 1800, B.LIVE.split("live AS (")[0].rstrip().rstrip(","),
    ),
    "S9 A7 A8",
)
def _(spark, sf):
    """Decisions of the stream appended to the archive, which is then read back."""
    base = f"{shared_folder(spark)}/archived-{uuid.uuid4().hex}"
    decisions = L.archivable(L.score_stream(request_stream(spark, sf), S.load_network()))
    with disk_state(spark):
        query = L.archive_stream(decisions, f"{base}/rows", f"{base}/checkpoint", trigger={"availableNow": True})
    query.awaitTermination()
    rows = read_archive(spark, f"{base}/rows").select(
        "decision_id", "ip", "score", "model_score", "heuristic_label", "blocked",
        F.col("features")[FEATURES.index("endpoint_count")].alias("endpoint_count"),
    )
    return rounded(rows, "score", "model_score", "endpoint_count")
