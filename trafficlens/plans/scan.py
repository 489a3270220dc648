"""The full scan: requests -> sessions -> features -> rules -> score -> summary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scoring as S
from ..operators.features import session_inputs, with_features
from ..operators.rules import with_verdict
from ..schema import FEATURES

VERDICT_COLUMNS = [
    "rule_code",
    "heuristic_label",
    "heuristic_confidence",
    "heuristic_reason",
    "model_score",
    "score",
    "label",
    "risk",
]


def with_score(
    labelled: DataFrame,
    network: S.Network | None,
    threshold=P.SCAN_THRESHOLD,
    strict=False,
    integrations="separate",
) -> DataFrame:
    """Add model_score, score, label and risk.

    ``integrations``: ``separate`` gives them their own label and score 0 (batch scan),
    ``human`` score 0 and the label human (live), ``blend`` no special case (tailing).
    ``strict`` compares with > instead of >=.
    """
    model = S.once(S.network_score(network)) if network is not None else F.lit(0.0)
    blended = S.blend(F.col("heuristic_label"), F.col("heuristic_confidence"), F.col("raw_model"))
    spared = (F.col("heuristic_label") == "automated-integration") & F.lit(integrations != "blend")
    flagged = F.col("score") > threshold if strict else F.col("score") >= threshold
    spared_label = "human" if integrations == "human" else "automated-integration"
    return (
        labelled.withColumn("raw_model", model)
        .withColumn("model_score", F.when(spared, 0.0).otherwise(F.col("raw_model")))
        .withColumn("score", F.when(spared, 0.0).otherwise(blended))
        .withColumn(
            "label",
            F.when(spared, spared_label).when(flagged, "bot").otherwise("human"),
        )
        .withColumn("risk", S.risk(F.col("score")))
        .drop("raw_model")
    )


def scan_sessions(
    requests: DataFrame,
    network: S.Network | None,
    threshold=P.SCAN_THRESHOLD,
    timeout_s=P.SESSION_TIMEOUT_S,
    keys=("ip",),
) -> DataFrame:
    """SCORED: one row per session with features, verdict, score and label."""
    sessions = with_features(session_inputs(requests, keys, timeout_s))
    scored = with_score(with_verdict(sessions), network, threshold)
    return scored.withColumn(
        "session_id", F.concat_ws("#", "ip", F.col("session_no").cast("string"))
    )


SESSION_COLUMNS = [
    "session_id",
    "ip",
    "session_no",
    "user_agent",
    "requests",
    "duration",
    "top_endpoint",
    *FEATURES,
    *VERDICT_COLUMNS,
]


def scan_summary(sessions: DataFrame) -> DataFrame:
    """One row: sessions per label and the share of bots among all of them."""
    n = F.count("*")
    of = lambda label: F.count_if(F.col("label") == label)
    return sessions.agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("total_entries"),
        n.alias("total_sessions"),
        of("bot").alias("bot_sessions"),
        of("human").alias("human_sessions"),
        of("automated-integration").alias("integration_sessions"),
        F.coalesce(F.try_divide(of("bot"), n), F.lit(0.0)).alias("bot_rate"),
    )
