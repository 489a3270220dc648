"""Reputation and fingerprint signals joined by address."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.address import address_bits
from ..functions.scoring import once


def in_blocks(addresses: DataFrame, blocks: DataFrame, carry=()) -> DataFrame:
    """(ip, *carry) of every address inside a CIDR block.

    ``addresses`` holds distinct ``ip``; ``blocks`` a ``prefix`` of leading bits.  An
    address is in a block when its first bits equal the prefix, so each address is
    matched once per prefix length that occurs, by equality: no range comparison and no
    hot bucket.  Lengths are at most 33 + 129 numbers.
    """
    lengths = (
        blocks.select(F.length("prefix").alias("len")).agg(F.collect_set("len")).scalar()
    )
    keyed = (
        addresses.withColumn("bits", once(address_bits(F.col("ip"))))
        .filter(F.col("bits").isNotNull())
        .withColumn("lengths", lengths)
        .select("ip", "bits", F.explode("lengths").alias("len"))
        .filter(F.col("len") <= F.length("bits"))
        .select("ip", F.length("bits").alias("width"), F.expr("substring(bits, 1, len)").alias("prefix"))
    )
    ranges = blocks.select(
        F.when(F.col("cidr").contains(":"), 128).otherwise(32).alias("width"), "prefix", *carry
    ).distinct()
    return keyed.join(ranges, ["width", "prefix"]).select("ip", *carry)


def actor_addresses(requests: DataFrame) -> DataFrame:
    return requests.select("ip").distinct()


def fresh_abuse_scores(cache: DataFrame, now: Column, ttl_s=P.ABUSE_CACHE_TTL_S) -> DataFrame:
    """(ip, abuse_score): the newest cached score per address, if still fresh."""
    return (
        cache.groupBy("ip")
        .agg(F.max("ts").alias("ts"), F.max_by("score", "ts").alias("abuse_score"))
        .filter(F.unix_micros(now) - F.unix_micros("ts") < ttl_s * 1_000_000)
        .select("ip", "abuse_score")
    )


def lookup_plan(
    seen: DataFrame, cache: DataFrame, now: Column, quota=P.ABUSE_DAILY_QUOTA
) -> DataFrame:
    """Addresses to look up: per UTC day the first ``quota`` without a fresh score.

    ``seen`` is (ip, first_seen).  The rank limit is applied before the shuffle.
    """
    stale = seen.join(fresh_abuse_scores(cache, now), "ip", "left_anti")
    day = Window.partitionBy("day").orderBy("first_seen", "ip")
    return (
        stale.withColumn("day", F.to_date("first_seen"))
        .withColumn("place", F.row_number().over(day))
        .filter(F.col("place") <= quota)
    )


def reputation(
    addresses: DataFrame, tor: DataFrame, hosting: DataFrame, abuse: DataFrame
) -> DataFrame:
    """Resolved signals per parseable address.  A missing abuse score stays NULL."""
    known = (
        addresses.withColumn("bits", once(address_bits(F.col("ip"))))
        .filter(F.col("bits").isNotNull())
        .select("ip")
    )
    exits = tor.select("ip").distinct().withColumn("tor_exit", F.lit(True))
    hosted = in_blocks(known, hosting).distinct().withColumn("hosting_range", F.lit(True))
    return (
        known.join(exits, "ip", "left")
        .join(hosted, "ip", "left")
        .join(abuse, "ip", "left")
        .select(
            "ip",
            F.lit(True).alias("resolved"),
            F.coalesce("tor_exit", F.lit(False)).alias("tor_exit"),
            F.coalesce("hosting_range", F.lit(False)).alias("hosting_range"),
            F.col("abuse_score").cast("double").alias("abuse_score"),
        )
    )


def with_fingerprints(signals: DataFrame, bindings: DataFrame) -> DataFrame:
    """Attach the bound hash; ``fp_resolved`` says the bindings were consulted."""
    return signals.join(bindings, "ip", "full_outer").select(
        "ip",
        F.coalesce("resolved", F.lit(False)).alias("resolved"),
        F.coalesce("tor_exit", F.lit(False)).alias("tor_exit"),
        F.coalesce("hosting_range", F.lit(False)).alias("hosting_range"),
        "abuse_score",
        F.lit(True).alias("fp_resolved"),
        "fingerprint_hash",
        F.coalesce("shared_hash_ips", F.lit(0)).cast("long").alias("shared_hash_ips"),
    )


def enrich(sessions: DataFrame, signals: DataFrame | None, promoted: Column | None = None,
           promotion_requires_resolved=True) -> DataFrame:
    """Sessions with SIGNALS columns; an address without a row was never looked up.

    ``promoted`` is the deployment's list of sources that may decide a verdict.  With
    ``promotion_requires_resolved`` it applies only where reputation data is resolved.
    """
    return with_promoted(sessions.join(signals, "ip", "left"), promoted, promotion_requires_resolved)


def with_promoted(joined: DataFrame, promoted: Column | None = None, promotion_requires_resolved=True) -> DataFrame:
    """``promoted``, and values in place of the nulls of addresses that were never looked up."""
    empty = F.array().cast("array<string>")
    wanted = empty if promoted is None else F.coalesce(promoted, empty)
    no = F.lit(False)
    filled = joined.withColumns(
        {
            **{c: F.coalesce(c, no) for c in ("resolved", "tor_exit", "hosting_range", "fp_resolved")},
            "shared_hash_ips": F.coalesce("shared_hash_ips", F.lit(0)),
        }
    )
    allowed = F.col("resolved") if promotion_requires_resolved else F.lit(True)
    return filled.withColumn("promoted", F.when(allowed, wanted).otherwise(empty))


def feed_health(feeds: dict, now: Column) -> DataFrame:
    """One row per feed: entries, whether it holds any, age in seconds.

    ``feeds`` maps a name to (table, fetched_at column literal).
    """
    rows = None
    for name, (table, fetched_at) in feeds.items():
        row = table.agg(F.count("*").alias("entries")).select(
            F.lit(name).alias("source"),
            (F.col("entries") > 0).alias("ok"),
            "entries",
            ((F.unix_micros(now) - F.unix_micros(fetched_at)) / 1e6).alias("age_s"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows
