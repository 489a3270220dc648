"""Forensic rules on raw lines, and sessions labelled by them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .sessions import sessionize


def searchable_text() -> Column:
    return F.lower(
        F.concat(F.col("raw_line"), F.lit(" code: "), F.col("status").cast("string"))
    )


def match_lines(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests with ``category``: label of the first rule whose tokens all occur, or NULL.

    The rules are configuration (a few dozen); they become one CASE expression, which
    stops at the first hit and needs no join.
    """
    text = F.col("searchable")
    category = F.lit(None).cast("string")
    for rule in sorted(rules.collect(), key=lambda r: r.rule_no, reverse=True):
        hit = F.lit(True)
        for token in rule.tokens:
            hit = hit & text.contains(token)
        category = F.when(hit, rule.label).otherwise(category)
    return (
        requests.withColumn("searchable", searchable_text())
        .withColumn("category", category)
        .drop("searchable")
    )


def label_sessions(requests: DataFrame, rules: DataFrame, keys=("ip",),
                   timeout_s=P.SESSION_TIMEOUT_S) -> DataFrame:
    """Per session: bot with the most frequent category (ties: first seen), or unlabeled.

    Counted per (session, category) first, so a long session is only a few rows.
    """
    keys = list(keys)
    rows = sessionize(match_lines(requests, rules), keys, timeout_s)
    counts = rows.groupBy(*keys, "session_no", "category").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos")
    )
    rank = F.struct((-F.col("n")).alias("n"), "first_pos")
    matched = F.col("category").isNotNull()
    return counts.groupBy(*keys, "session_no").agg(
        F.sum("n").alias("requests"),
        F.min_by(F.when(matched, F.col("category")), F.when(matched, rank)).alias("category"),
    ).withColumn(
        "truth_label", F.when(F.col("category").isNotNull(), "bot").otherwise("unlabeled")
    )
