"""Day-partitioned request tables and subsets of them."""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from .logs import _COMBINED, stripped


def write_days(requests: DataFrame, path: str, mode="overwrite") -> None:
    """One directory per local day.  Rows are spread over many files per day; a busy day
    does not end in one task."""
    requests.write.mode(mode).partitionBy("local_date").parquet(path)


def read_days(spark: SparkSession, path: str, days=None) -> DataFrame:
    """``days`` prunes directories."""
    table = spark.read.parquet(path)
    if days is None:
        return table
    return table.filter(F.col("local_date").isin([date.fromisoformat(str(d)) for d in days]))


def lines_per_day(requests: DataFrame) -> DataFrame:
    return requests.groupBy("local_date").agg(F.count("*").alias("lines"))


def parse_rate(lines: DataFrame, sampled: Column, minimum=0.95) -> DataFrame:
    """Share of the sampled lines that are dated and match the combined format."""
    dated = F.col("value").rlike(r"\[([0-9]{2})/(\w{3})/([0-9]{4}):")
    good = dated & stripped(F.col("value")).rlike(_COMBINED)
    n = F.count_if(sampled)
    return lines.agg(
        F.count("*").alias("total"),
        n.alias("sampled"),
        F.count_if(~dated).alias("undated"),
        F.try_divide(F.count_if(sampled & good), n).alias("parse_rate"),
    ).withColumn("acceptable", F.col("parse_rate") >= minimum)


def subset(requests: DataFrame, actors: DataFrame, on=("ip",), transform=None) -> DataFrame:
    """Requests of the given actors, optionally changed on the way.

    A semi-join; whether the actor list is broadcast is left to its measured size.
    """
    kept = requests.join(actors.select(*on).distinct(), list(on), "left_semi")
    return kept if transform is None else kept.transform(transform)


def plain_agent(requests: DataFrame) -> DataFrame:
    """Every client claims to be an ordinary browser."""
    return requests.withColumn("user_agent", F.lit(P.PLAIN_BROWSER_AGENT))


def without_probes(requests: DataFrame) -> DataFrame:
    return requests.filter(~X.is_probe_path(X.url_path(F.col("url"))))


def dataset_counts(dataset: DataFrame) -> DataFrame:
    """Rows per (day, source, class); the source is the provenance up to ':'."""
    return dataset.groupBy(
        "day",
        F.substring_index("provenance", ":", 1).alias("source"),
        F.when(F.col("label") > 0.5, "bot").otherwise("human").alias("class"),
    ).agg(F.count("*").alias("n"))


def write_dataset(dataset: DataFrame, path: str, mode="overwrite") -> None:
    dataset.write.mode(mode).partitionBy("day").parquet(path)


def sample_fixture(
    requests: DataFrame,
    labels: DataFrame,
    actors_per_class=22,
    lines_per_actor=40,
    seed=0,
) -> DataFrame:
    """A small anonymous extract: some actors per (day, class), some lines per actor.

    ``labels`` is (day, ip, is_bot).  Both limits are rank limits, applied before the
    shuffle; addresses become documentation addresses by rank within the class.
    """
    pick = Window.partitionBy("day", "is_bot").orderBy(F.xxhash64(F.lit(seed), "ip"), "ip")
    chosen = (
        labels.withColumn("rank", F.row_number().over(pick))
        .filter(F.col("rank") <= actors_per_class)
        .withColumn(
            "new_ip",
            F.concat(
                F.when(F.col("is_bot"), "203.0.113.").otherwise("198.51.100."),
                F.col("rank").cast("string"),
            ),
        )
    )
    order = Window.partitionBy("local_date", "ip").orderBy("ts", "src_file", "src_block", "line_no")
    return (
        requests.join(
            chosen.select(F.col("day").alias("local_date"), "ip", "new_ip", "is_bot"),
            ["local_date", "ip"],
        )
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= lines_per_actor)
        .withColumn(
            "raw_line", F.concat("new_ip", F.expr("substring(raw_line, length(ip) + 1)"))
        )
        .withColumn("ip", F.col("new_ip"))
        .drop("new_ip", "rank")
    )
