"""Block lists and scan documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def danger_ips(sessions: DataFrame) -> DataFrame:
    """Distinct addresses of sessions in the DANGER band."""
    return sessions.filter((F.col("risk") == "DANGER") & (F.col("ip") != "")).select("ip").distinct()


def nginx_denylist(sessions: DataFrame) -> DataFrame:
    """One deny directive per address, sorted."""
    return (
        danger_ips(sessions)
        .orderBy("ip")
        .select(F.concat(F.lit("deny "), "ip", F.lit(";")).alias("value"))
    )


def firewall_expressions(sessions: DataFrame, per_rule=1000) -> DataFrame:
    """Firewall rule expressions over the sorted addresses, ``per_rule`` in each.

    Rule engines limit the length of one expression, and one text of all addresses would
    have to pass through one task; every address is in exactly one expression.
    """
    from ..operators.ranks import with_global_rank

    ranked = with_global_rank(danger_ips(sessions), "ip", "rank")
    return (
        ranked.withColumn("rule_no", F.floor((F.col("rank") - 1) / per_rule).cast("long"))
        .groupBy("rule_no")
        .agg(F.array_sort(F.collect_list("ip")).alias("ips"))
        .select(
            "rule_no",
            F.concat(F.lit("(ip.src in {"), F.array_join("ips", " "), F.lit("})")).alias("value"),
        )
    )


def write_denylist(sessions: DataFrame, path: str) -> None:
    nginx_denylist(sessions).write.mode("overwrite").text(path)


def write_scan(sessions: DataFrame, summary: DataFrame, path: str, fmt="json") -> None:
    """The scan as a document: session rows and a one-row summary beside them."""
    sessions.write.mode("overwrite").format(fmt).save(f"{path}/sessions")
    summary.write.mode("overwrite").format(fmt).save(f"{path}/summary")
