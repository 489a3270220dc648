"""Threat-intelligence feeds and rule files as tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.address import block_prefix
from ..functions.scoring import once


def parse_exit_list(lines: DataFrame) -> DataFrame:
    """Distinct addresses of a list with '#' comments and blank lines."""
    ip = F.trim("value")
    return lines.filter((ip != "") & ~ip.startswith("#")).select(ip.alias("ip")).distinct()


_RANGES = T.StructType(
    [
        T.StructField(
            "prefixes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("ip_prefix", T.StringType()),
                        T.StructField("ipv4Prefix", T.StringType()),
                        T.StructField("ipv6Prefix", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "ipv6_prefixes",
            T.ArrayType(T.StructType([T.StructField("ipv6_prefix", T.StringType())])),
        ),
    ]
)


def cidr_table(cidrs: DataFrame) -> DataFrame:
    """Add ``prefix`` (the leading bits) to a table with ``cidr``; bad ones are skipped."""
    return cidrs.withColumn("prefix", once(block_prefix(F.col("cidr")))).filter(
        F.col("prefix").isNotNull()
    )


def parse_hosting_feed(documents: DataFrame) -> DataFrame:
    """CIDR blocks of documents with ``prefixes`` and ``ipv6_prefixes``."""
    doc = documents.select(F.from_json("value", _RANGES).alias("d"))
    v4 = doc.select(F.explode("d.prefixes.ip_prefix").alias("cidr"))
    v6 = doc.select(F.explode("d.ipv6_prefixes.ipv6_prefix").alias("cidr"))
    return cidr_table(v4.unionByName(v6).filter(F.col("cidr").isNotNull()))


def parse_crawler_feed(documents: DataFrame) -> DataFrame:
    """(engine, cidr, prefix) of documents tagged with their ``engine``."""
    rows = documents.select(
        "engine", F.explode(F.from_json("value", _RANGES)["prefixes"]).alias("p")
    )
    return cidr_table(
        rows.select("engine", F.coalesce("p.ipv4Prefix", "p.ipv6Prefix").alias("cidr")).filter(
            F.col("cidr").isNotNull()
        )
    )


def reverse_dns_table(rows: DataFrame) -> DataFrame:
    """(ip, hostname, addresses, place) from client, hostname, address_list; ``place`` orders the rows."""
    listed = F.coalesce("address_list", F.lit(""))
    return rows.select(
        F.col("client").alias("ip"),
        F.lower(F.coalesce("hostname", F.lit(""))).alias("hostname"),
        F.array_distinct(
            F.regexp_extract_all(listed, F.lit(r"([0-9a-fA-F:.]{3,})"), F.lit(1))
        ).alias("addresses"),
        F.monotonically_increasing_id().alias("place"),
    )


def read_reverse_dns(spark: SparkSession, path: str) -> DataFrame:
    return reverse_dns_table(
        spark.read.csv(path, header=True, schema="client string, hostname string, address_list string")
    )


def forensic_rules(spark: SparkSession, entries) -> DataFrame:
    """(rule_no, label, sensitivity, tokens) from dicts as a rule file holds them.

    The label defaults to the id; tokens lose blanks and '%' marks around them and case.
    """
    rows = []
    for number, entry in enumerate(entries):
        tokens = [t.strip().strip("%").lower() for t in entry["filter"]]
        label = entry.get("ground_truth_label") or entry["id"]
        rows.append((number, label, entry.get("sensitivity") or "moderate", tokens))
    return spark.createDataFrame(
        rows, "rule_no int, label string, sensitivity string, tokens array<string>"
    )


def read_forensic_rules(spark: SparkSession, path: str) -> DataFrame:
    """A flat YAML list of {id, ground_truth_label, sensitivity, filter: [...]}.

    Rule files are a few kilobytes of configuration, read once.
    """
    entries, current = [], None
    for line in (row.value.strip() for row in spark.read.text(path, wholetext=False).collect()):
        if line.startswith("- id:"):
            current = {"id": line[5:].strip(), "filter": []}
            entries.append(current)
        elif current is None or not line or line.startswith("#"):
            continue
        elif line.startswith("- "):
            token = line[2:].strip()
            quoted = len(token) >= 2 and token[0] == token[-1] == '"'
            current["filter"].append(token[1:-1] if quoted else token)
        else:
            key, _, value = line.partition(":")
            if key in ("ground_truth_label", "sensitivity"):
                current[key] = value.strip()
    return forensic_rules(spark, [e for e in entries if e["filter"]])
