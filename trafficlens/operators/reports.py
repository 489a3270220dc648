"""Counters and short lists over decisions and scanned sessions."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..session import cut_lineage

#: Addresses that are followed at most.
TRACKED = 1000


def decision_stats(decisions: DataFrame) -> DataFrame:
    """One row: total, blocked, allowed, bot rate, mean score."""
    n, blocked = F.count("*"), F.count_if(F.col("label") == "bot")
    zero = F.lit(0.0)
    return decisions.agg(
        n.alias("total"),
        blocked.alias("blocked"),
        (n - blocked).alias("allowed"),
        F.coalesce(F.try_divide(blocked, n), zero).alias("bot_rate"),
        F.coalesce(F.avg("score"), zero).alias("avg_score"),
    )


def top_blocked(decisions: DataFrame, n=10) -> DataFrame:
    """The addresses blocked most often, from exact counts."""
    return (
        decisions.filter(F.col("label") == "bot")
        .groupBy("ip")
        .agg(F.count("*").alias("blocked"))
        .orderBy(F.col("blocked").desc(), "ip")
        .limit(n)
    )


def heavy_hitters(table: DataFrame, key: str, counters: int) -> DataFrame:
    """(key, low, high): bounds of how often each frequent value of ``key`` occurs.

    Every task counts its values and, whenever it holds more than ``counters`` of them, lowers all
    by what brings half of them to nothing; what a value lost is at most what the task lowered in
    all, and that is at most its rows / (counters / 2). Summaries add up, so a value that occurs
    oftener than the sum of all that was lowered is in the result, and its count lies between its
    bounds. A value that is missing occurs at most as often as the row of the null value says.
    """

    def summary(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, lowered = {}, 0
        for batch in batches:
            for pair in pc.value_counts(batch.column(0).drop_null()).to_pylist():
                held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            if len(held) > counters:
                by = int(np.partition(np.fromiter(held.values(), dtype=np.int64), -(counters // 2) - 1)[-(counters // 2) - 1])
                lowered += by
                held = {k: n - by for k, n in held.items() if n > by}
        keys = pa.array([*held, None], pa.string())
        yield pa.record_batch([keys, pa.array([*held.values(), 0], pa.int64()), pa.array([lowered] * len(keys), pa.int64())],
                              names=["key", "low", "lowered"])

    parts = cut_lineage(table.select(F.col(key).cast("string").alias("key")).mapInArrow(summary, "key string, low long, lowered long"))
    total = parts.where("key IS NULL").agg(F.coalesce(F.sum("lowered"), F.lit(0)).alias("lost"))
    sums = parts.groupBy("key").agg(F.sum("low").alias("low"))
    lost = total.select("lost").scalar()
    return sums.select("key", "low", (F.col("low") + lost).alias("high"))


def busiest(table: DataFrame, key: str, n=TRACKED, counters=20 * TRACKED) -> DataFrame:
    """(key, count, error): the ``n`` most frequent values, by count, then by value.

    A first pass keeps bounded summaries; a second one counts exactly those values whose upper bound
    reaches the n-th lower bound, so only rows of these are shuffled. ``error`` is by how much a value
    that was left out may surpass the last one given: it is 0, for where the summaries can't rule that
    out (counts so even that the n-th is no larger than what was lowered) all values are counted.
    """
    rows = table.select(F.col(key).cast("string").alias("key")).filter("key IS NOT NULL")
    bounds = cut_lineage(heavy_hitters(rows, "key", counters))
    known = bounds.filter("key IS NOT NULL")
    lost = bounds.filter("key IS NULL").agg(F.coalesce(F.max("high"), F.lit(0)).alias("lost")).first().lost
    nth = known.orderBy(F.col("low").desc()).limit(n).agg(F.count("*").alias("found"), F.min("low").alias("least")).first()
    picked = rows.join(known.filter(F.col("high") >= (nth.least if nth.found == n else 0)), "key", "left_semi")
    top = lambda counted: counted.groupBy("key").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "key").limit(n)
    found = cut_lineage(top(picked))
    last = found.agg(F.count("*").alias("found"), F.min("count").alias("least")).first()
    # a value without a counter occurs at most ``lost`` times; with a tie its name could still come first
    if lost and (last.found < n or last.least <= lost):
        found = top(rows)
    return found.withColumn("error", F.lit(0).cast("long"))


def busiest_blocked(decisions: DataFrame, n=TRACKED, counters=20 * TRACKED) -> DataFrame:
    """(ip, blocked, error): the ``n`` addresses blocked most often, the ones that stay tracked."""
    found = busiest(decisions.filter(F.col("label") == "bot"), "ip", n, counters)
    return found.select(F.col("key").alias("ip"), F.col("count").alias("blocked"), "error")


def recent(decisions: DataFrame, n=100) -> DataFrame:
    """The newest decisions."""
    return decisions.orderBy(F.col("ts").desc(), F.col("line_no").desc()).limit(n)


def top_sessions(sessions: DataFrame, n=10) -> DataFrame:
    return sessions.orderBy(F.col("score").desc(), "ip", "session_no").limit(n)


def status(summary: DataFrame) -> DataFrame:
    """Traffic status of a scan summary, and whether an audit gate would fail."""
    rate = F.col("bot_rate")
    return summary.select(
        "bot_rate", S.traffic_status(rate).alias("status"), (rate > 0.1).alias("audit_failed")
    )
