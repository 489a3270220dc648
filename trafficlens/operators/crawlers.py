"""Labelling of a public log: crawler claims, verification, human evidence, view gaps."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from .ranks import value_counts
from .sessions import SLICE_S, slice_of, with_clock
from .signals import in_blocks

ENGINES = [name for name, _, _ in P.CRAWLER_ENGINES]


def verified_engines(addresses: DataFrame, ranges: DataFrame, dns: DataFrame) -> DataFrame:
    """(ip, engine): by published range (first listed wins), else by a host name that
    resolves back to the address and ends in a suffix of the engine.

    ``ranges`` is (position, engine, cidr, prefix), ``dns`` (ip, hostname, addresses, place). Of several
    lookups of one address the last one counts, also if it does not lead back.
    """
    by_range = (
        in_blocks(addresses, ranges, carry=("position", "engine"))
        .groupBy("ip")
        .agg(F.min_by("engine", "position").alias("range_engine"))
    )
    host = F.col("hostname")
    named = None
    for engine, _, suffixes in P.CRAWLER_ENGINES:
        fits = reduce(or_, [(host == s) | host.endswith("." + s) for s in suffixes])
        named = F.when(fits, engine) if named is None else named.when(fits, engine)
    last = dns.groupBy("ip").agg(F.max_by(F.struct("hostname", "addresses"), "place").alias("last"))
    by_name = (
        last.select("ip", "last.*").filter(F.array_contains("addresses", F.col("ip"))).select("ip", named.alias("name_engine"))
    )
    return (
        addresses.join(by_range, "ip", "left")
        .join(by_name, "ip", "left")
        .select("ip", F.coalesce("range_engine", "name_engine").alias("engine"))
        .filter(F.col("engine").isNotNull())
    )


def evidence(requests: DataFrame) -> DataFrame:
    """Per (day, ip): requests and what was seen, without keeping sets of agents."""
    ua, path = F.col("user_agent"), X.url_path(F.col("url"))
    asset = X.starts_with_any(path, P.ASSET_PREFIXES) | X.matches(path, P.ASSET_SUFFIX_PATTERN)
    return requests.groupBy(F.col("local_date").alias("day"), "ip").agg(
        F.count("*").alias("requests"),
        F.bool_or(X.is_probe_path(path)).alias("probe"),
        F.bool_or(X.starts_with_any(path, P.HUMAN_ACTION_PREFIXES)).alias("human_action"),
        F.bool_or(asset).alias("asset"),
        F.bool_or(path.startswith(P.STAFF_PREFIX)).alias("staff"),
        F.bool_and(X.is_browser_like(ua)).alias("browser_like"),
        *[F.bool_or(X.claims_engine(ua, e)).alias(f"claims_{e}") for e in ENGINES],
    )


def label_actors(seen: DataFrame, verified: DataFrame) -> DataFrame:
    """(day, ip, label, requests, claimed, verified, probe) from the evidence."""
    claims = F.array_compact(F.array(*[F.when(F.col(f"claims_{e}"), e) for e in sorted(ENGINES)]))
    rows = seen.withColumn("claimed", claims).join(verified, "ip", "left")
    claimed = F.size("claimed") > 0
    bot = F.when(
        claimed,
        F.when(
            F.coalesce(F.array_contains("claimed", F.col("engine")), F.lit(False)),
            "verified_crawler",
        ).otherwise("unverified_crawler"),
    ).when(F.col("probe"), "probe_bot")
    human = F.when(
        F.col("browser_like") & F.col("human_action") & F.col("asset"),
        F.when(F.col("staff"), "staff").otherwise("human_proxy"),
    )
    label = F.when(bot.isNotNull() & human.isNotNull(), "conflict").otherwise(
        F.coalesce(bot, human, F.lit("unlabeled"))
    )
    return rows.select(
        "day",
        "ip",
        label.alias("label"),
        "requests",
        "claimed",
        F.when(claimed, F.col("engine")).alias("verified"),
        "probe",
    )


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("day", "label").agg(F.count("*").alias("actors"))


def pool(labels: DataFrame, kind: str) -> DataFrame:
    """Distinct (day, ip) of all ``crawler`` or all ``human`` actors."""
    members = {
        "crawler": ("verified_crawler", "unverified_crawler"),
        "human": ("human_proxy", "staff"),
    }[kind]
    return labels.filter(F.col("label").isin(*members)).select("day", "ip").distinct()


def request_stats(labels: DataFrame, of="human_proxy") -> DataFrame:
    """One row: actors, median, 90th percentile and maximum of their request counts.

    Nearest rank: the value at index n // 2 and int(0.9 n) of the sorted counts.
    """
    spans = value_counts(labels.filter(F.col("label") == of).select("requests"), "requests")
    total = spans.agg(
        F.struct(F.sum("n").alias("actors"), F.max("requests").alias("max_requests"))
    ).scalar()
    at = lambda position: F.max(
        F.when(
            (F.col("upto") - F.col("n") <= position) & (position < F.col("upto")), F.col("requests")
        )
    )
    n = F.col("actors")
    return (
        spans.withColumn("total", total)
        .select("*", "total.*")
        .groupBy("actors", "max_requests")
        .agg(
            at(F.floor(n / 2)).alias("median"),
            at(F.floor(n * F.lit(0.9))).alias("p90"),
        )
    )


def page_views(requests: DataFrame, site: str, keys=("local_date", "ip")) -> DataFrame:
    """GETs answered 200 whose url the same client also sends as a referer.

    A semi-join on (client, url): a busy client spreads over its urls.
    """
    keys = list(keys)
    rows = with_clock(requests)
    referred = (
        rows.select(*keys, X.site_referer_url(F.col("referer"), site).alias("url"))
        .filter(F.col("url").isNotNull())
        .distinct()
    )
    gets = rows.filter((F.col("method") == "GET") & (F.col("status") == 200))
    return gets.select(*keys, "ts_us", "url").join(referred, [*keys, "url"], "left_semi")


def view_gaps(views: DataFrame, keys=("local_date", "ip"), longest_s=P.SESSION_TIMEOUT_S) -> DataFrame:
    """Seconds between consecutive views of a client, in (0, longest].

    In slices: the first view of a slice looks back at the last one of the slice before.
    """
    keys = list(keys)
    rows = views.withColumn("slice", slice_of(F.col("ts_us"), SLICE_S))
    by_time = Window.partitionBy(*keys).orderBy("slice")
    carried = (
        rows.groupBy(*keys, "slice")
        .agg(F.max("ts_us").alias("hi"))
        .select(*keys, "slice", F.lag("hi").over(by_time).alias("carried"))
    )
    inside = Window.partitionBy("slice", *keys).orderBy("ts_us")
    gap = F.col("ts_us") - F.coalesce(F.lag("ts_us").over(inside), F.col("carried"))
    return (
        rows.join(carried, [*keys, "slice"])
        .select(*keys, (gap / 1e6).alias("gap_s"))
        .filter((F.col("gap_s") > 0) & (F.col("gap_s") <= longest_s))
    )


def permille_quantiles(values: DataFrame, value: str) -> DataFrame:
    """(permille, value) for 0..1000 by nearest rank, rounding half to even.

    Each distinct value covers an interval of ranks and names the permilles that fall
    into it, so nothing is sorted in one task.
    """
    spans = value_counts(values, value)
    total = spans.agg(F.sum("n")).scalar()
    lo, hi, last = F.col("upto") - F.col("n"), F.col("upto") - 1, F.col("total") - 1
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(1000), c)).cast("int")
    scale = F.greatest(last, F.lit(1))
    first = F.when(last == 0, F.lit(0)).otherwise(clip(F.floor((lo - 1) * 1000 / scale)))
    final = F.when(last == 0, F.lit(1000)).otherwise(clip(F.ceil((hi + 1) * 1000 / scale)))
    return (
        spans.withColumn("total", total)
        .select(value, lo.alias("lo"), hi.alias("hi"), last.alias("last"),
                F.explode(F.sequence(first, final)).alias("permille"))
        .filter(
            F.rint(F.col("permille") / F.lit(1000) * F.col("last")).between(
                F.col("lo"), F.col("hi")
            )
        )
        .select("permille", value)
    )
