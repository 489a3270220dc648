"""Structured Streaming forms of the operators.

What a key needs to keep is in ``state``: the retained requests of a client, the totals of an open
session, a claim, the addresses of a fingerprint. Facts about a request come before, features, rules
and scores after the state, as column expressions.
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import patterns as P
from ..functions import scoring as S
from ..functions import text as X
from ..operators.features import feature_vector, with_features
from ..operators.retained import completed, item_columns, retained_inputs
from ..operators.rules import with_verdict
from ..operators.sessions import with_clock
from ..operators.signals import enrich, with_promoted
from ..plans.scan import with_score
from ..schema import REQUEST, SOURCE_ORDER
from ..sources.archive import archive_rows
from ..sources.logs import parse_nginx
from .state import HISTORY_IN, HISTORY_OUT, Claims, History, Sessions, Sharing
from .tail import tail_log_lines

US = 1_000_000


# --- sources --------------------------------------------------------------------------------


def stream_log_lines(spark: SparkSession, path: str, files_per_trigger=None) -> DataFrame:
    """New lines of a directory of rolled log files."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(
        "value",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line_no"),
    )


def stream_requests(spark: SparkSession, path: str, files_per_trigger=None) -> DataFrame:
    return parse_nginx(stream_log_lines(spark, path, files_per_trigger))


def tail_requests(spark: SparkSession, path: str, start="end") -> DataFrame:
    """Requests of log files that grow in place."""
    return parse_nginx(tail_log_lines(spark, path, start))


def stream_request_table(spark: SparkSession, path: str, schema=REQUEST, files_per_trigger=None):
    """New files of a parquet request table."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


# --- one decision per request ---------------------------------------------------------------


def request_inputs(requests: DataFrame, keep=P.RETAINED_REQUESTS, timeout_s=P.SESSION_TIMEOUT_S,
                   lateness="10 minutes") -> DataFrame:
    """Streaming: every request with the inputs of its client's last ``keep`` ones."""
    rows = with_clock(requests).withWatermark("ts", lateness)
    items = rows.select("ip", "ts", *SOURCE_ORDER, *item_columns())
    found = items.select(*HISTORY_IN).groupBy("ip").transformWithState(
        History(keep, timeout_s), HISTORY_OUT, "append", "EventTime"
    )
    columns = F.arrays_zip(*(c for c in found.columns if c != "ip"))
    return completed(found.select("ip", F.inline(columns)))


def decide(inputs: DataFrame, network, threshold=P.BLOCK_THRESHOLD, signals=None, promoted=None) -> DataFrame:
    """Decisions from inputs, batch or stream: rules, model, blend; strictly above the
    threshold is blocked; integrations are let through with score 0."""
    inputs = with_features(inputs)
    if signals is not None:
        inputs = enrich(inputs, signals, promoted)
    verdict = with_verdict(inputs, signals=signals is not None)
    return with_score(verdict, network, threshold, strict=True, integrations="human").withColumn(
        "blocked", F.col("label") == "bot"
    )


def score_stream(requests: DataFrame, network, keep=P.RETAINED_REQUESTS, **options) -> DataFrame:
    """One decision per request of a stream."""
    return decide(request_inputs(requests, keep), network, **options)


def replay(requests: DataFrame, network, keep=P.RETAINED_REQUESTS, timeout_s=P.SESSION_TIMEOUT_S, **options) -> DataFrame:
    """The same decisions over a stored request table."""
    return decide(retained_inputs(requests, keep, timeout_s=timeout_s), network, **options)


# --- sessions that have ended ------------------------------------------------------------------


def closed_sessions(requests: DataFrame, timeout_s=P.SESSION_TIMEOUT_S, lateness="10 minutes") -> DataFrame:
    """Streaming: sessions the watermark has passed, as (ip, start_us, end_us, requests).

    Native session windows; the state per open session is a few numbers.
    """
    return (
        with_clock(requests)
        .withWatermark("ts", lateness)
        .groupBy("ip", F.session_window("ts", f"{timeout_s} seconds"))
        .agg(
            F.min("ts_us").alias("start_us"),
            F.max("ts_us").alias("end_us"),
            F.count("*").alias("requests"),
        )
        .select("ip", "start_us", "end_us", "requests")
    )


def session_totals(requests: DataFrame, timeout_s=P.TAIL_TIMEOUT_S, lateness="10 minutes") -> DataFrame:
    """Streaming: inputs of every session the watermark has passed.

    An open session is kept as totals, so closing it reads nothing again.
    """
    rows = with_clock(requests).withWatermark("ts", lateness)
    items = rows.select("ip", "ts", *SOURCE_ORDER, *item_columns())
    return completed(items.groupBy("ip").transformWithStateInPandas(Sessions(timeout_s), Sessions.OUT, "append", "EventTime"))


def score_sessions(requests: DataFrame, network, timeout_s=P.TAIL_TIMEOUT_S, threshold=P.SCAN_THRESHOLD,
                   lateness="10 minutes") -> DataFrame:
    """Streaming: every session once it has ended, with features, verdict, score and label.

    Tailing knows no label of its own for integrations. A session is named by address and start.
    """
    labelled = with_verdict(with_features(session_totals(requests, timeout_s, lateness)))
    scored = with_score(labelled, network, threshold, integrations="blend")
    return scored.withColumn("session_id", F.concat_ws("#", "ip", F.col("start_us").cast("string")))


# --- counters, archive, control ----------------------------------------------------------------


def live_counters(decisions: DataFrame, bins=20) -> DataFrame:
    """Streaming totals per score bucket and label; totals and rates are sums over them."""
    return decisions.groupBy(
        S.score_bucket(F.col("score"), bins).alias("bucket"), "label"
    ).agg(F.count("*").alias("n"), F.sum("score").alias("score_sum"))


def deduplicated(decisions: DataFrame, lateness="10 minutes") -> DataFrame:
    """Each decision once, by its id."""
    return decisions.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["decision_id"])


def archivable(decisions: DataFrame) -> DataFrame:
    """Decisions with what the archive keeps of them: an id, the vector and the time of the request."""
    return decisions.withColumns(
        {
            "decision_id": F.concat_ws("-", "ip", F.col("line_no").cast("string")),
            "features": feature_vector(),
            "timestamp": F.timestamp_micros("end_us").cast("string"),
        }
    )


def archive_stream(decisions: DataFrame, path: str, checkpoint: str, trigger=None):
    """Append decisions with a full vector as JSON lines; the checkpoint makes it exactly once."""
    return (
        archive_rows(decisions)
        .writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )


#: A version of what operators set: it holds from ``valid_from`` until the next one.
CONTROL = "valid_from timestamp, threshold double, promoted array<string>"


def controlled(inputs: DataFrame, control: DataFrame, default_threshold=P.BLOCK_THRESHOLD, at="end_us") -> DataFrame:
    """Add ``threshold`` and ``wanted`` (promoted sources): the version of ``control`` that held at
    the row's own time, so a replay decides as the stream did.

    A missing or invalid threshold gives the configured one, unknown sources are left out; before
    the first version nothing is promoted. Versions are edits by operators, a few rows.
    """
    usable = F.col("threshold").between(0.0, 1.0)
    known = F.filter("promoted", lambda s: s.isin(*P.SIGNAL_SOURCES))
    version = F.struct(
        F.unix_micros("valid_from").alias("from_us"),
        F.when(usable, F.col("threshold")).alias("threshold"),
        F.coalesce(known, F.array().cast("array<string>")).alias("promoted"),
    )
    versions = control.filter("valid_from IS NOT NULL").agg(F.sort_array(F.collect_list(version))).scalar()
    held = F.try_element_at(F.filter("versions", lambda v: v["from_us"] <= F.col(at)), F.lit(-1))
    return inputs.withColumn("versions", versions).withColumn("held", held).withColumns(
        {
            "threshold": F.coalesce("held.threshold", F.lit(default_threshold)),
            "wanted": F.coalesce("held.promoted", F.array().cast("array<string>")),
        }
    ).drop("versions", "held")


def signals_at(inputs: DataFrame, versions: DataFrame, at="end_us") -> DataFrame:
    """Add the SIGNALS columns that held at the row's own time.

    ``versions`` is SIGNALS (without ``promoted``) with ``valid_from``; an address has a row for each
    time its signals changed. The join is an equality on the address.
    """
    names = [c for c in versions.columns if c not in ("ip", "valid_from")]
    version = F.struct(F.unix_micros("valid_from").alias("from_us"), *names)
    by_ip = versions.filter("valid_from IS NOT NULL").groupBy("ip").agg(F.sort_array(F.collect_list(version)).alias("versions"))
    held = F.try_element_at(F.filter("versions", lambda v: v["from_us"] <= F.col(at)), F.lit(-1))
    joined = inputs.join(by_ip, "ip", "left").withColumn("held", held)
    return joined.select(*inputs.columns, *[F.col(f"held.{c}").alias(c) for c in names])


def score_controlled(requests: DataFrame, network, control: DataFrame, signals: DataFrame, keep=P.RETAINED_REQUESTS) -> DataFrame:
    """Streaming: decisions under the control and with the signals of each request's own time."""
    return decide_controlled(request_inputs(requests, keep), network, control, signals)


def decide_controlled(inputs: DataFrame, network, control: DataFrame, signals: DataFrame) -> DataFrame:
    """The same for inputs of a stream or a batch."""
    rows = signals_at(controlled(with_features(inputs), control), signals)
    rows = with_promoted(rows, F.col("wanted"))
    verdict = with_verdict(rows, signals=True)
    scored = with_score(verdict, network, F.col("threshold"), strict=True, integrations="human")
    return scored.withColumn("blocked", F.col("label") == "bot")


# --- fingerprints -------------------------------------------------------------------------------

_CLAIM = "ip string, hash string, ts_us long, seq long, outcome string"


def claim_holder(ttl_s: int):
    """State per address: the claim in force.  One small tuple, whatever the traffic."""

    def update(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held, since = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["ts_us", "seq"], kind="stable")
        outcomes = []
        for value, ts_us in zip(rows["hash"], rows["ts_us"]):
            if since is None or ts_us - since > ttl_s * US:
                held, since = value, int(ts_us)
                outcomes.append("ACCEPTED")
            else:
                outcomes.append("REPEAT" if value == held else "ALREADY_BOUND")
        state.update((held, since))
        ends_ms = since // 1000 + ttl_s * 1000 + 1
        state.setTimeoutTimestamp(max(ends_ms, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(ip=key[0], outcome=outcomes)[["ip", "hash", "ts_us", "seq", "outcome"]]

    return update


def bind_stream(submissions: DataFrame, ttl_s=P.FINGERPRINT_TTL_S, lateness="10 minutes") -> DataFrame:
    """Streaming form of the binding for valid submissions (ip, hash, ts, ts_us, seq)."""
    return (
        submissions.withWatermark("ts", lateness)
        .select("ip", "hash", "ts_us", "seq", "ts")
        .groupBy("ip")
        .applyInPandasWithState(
            claim_holder(ttl_s),
            _CLAIM,
            "held string, since long",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def submission_outcomes(submissions: DataFrame, requests: DataFrame, ttl_s=P.FINGERPRINT_TTL_S,
                        session_ttl_s=P.SESSION_TIMEOUT_S, lateness="10 minutes") -> DataFrame:
    """Streaming: every submission (ip, hash, ts, ts_us, seq) with its outcome, in order of time.

    Both streams meet in the state of the address. Rows are given out once the watermark has passed
    them; ``at`` is when, and the event time of what follows.
    """
    asks = with_clock(requests).select(
        "ip", "ts", "ts_us", F.lit(0).alias("kind"), F.col("line_no").alias("seq"), F.lit("").alias("hash"),
        F.lit(False).alias("valid"),
    )
    subs = submissions.select(
        "ip", "ts", "ts_us", F.lit(1).alias("kind"), "seq", F.coalesce("hash", F.lit("")).alias("hash"),
        F.coalesce(X.is_fingerprint(F.col("hash")), F.lit(False)).alias("valid"),
    )
    rows = asks.unionByName(subs).withWatermark("ts", lateness)
    return rows.groupBy("ip").transformWithStateInPandas(
        Claims(ttl_s, session_ttl_s), Claims.OUT, "append", "EventTime", eventTimeColumnName="at"
    )


def shared_counts(outcomes: DataFrame, window_s=P.FINGERPRINT_WINDOW_S) -> DataFrame:
    """Streaming: accepted submissions with the addresses that used their hash so far in its window."""
    accepted = outcomes.filter(F.col("outcome") == "ACCEPTED").select("ip", "hash", "ts_us", "seq", "at")
    return accepted.groupBy("hash").transformWithStateInPandas(Sharing(window_s), Sharing.OUT, "append", "EventTime")
