"""Browser fingerprints: binding to an address, sharing between addresses, registry.

A submission is (ip, hash, ts_us, seq).  A valid one claims the address for a fixed time
from the moment it is accepted; while the claim holds, another hash is refused and the
same hash is ignored.  Acceptance therefore depends on the previous acceptance.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..session import cut_lineage
from .sessions import SLICE_S, session_map, slice_of

US = 1_000_000
#: Valid submissions of an address up to which they are settled together, in order of time.
FOLDED = 1_000


def with_last_request(submissions: DataFrame, requests: DataFrame, ttl_s: int) -> DataFrame:
    """Add ``has_session``: whether the address made a request at most ``ttl_s`` before.

    As-of join by merging both tables in time order within (ip, slice).  The last request
    of earlier slices comes from one small row per slice, made behind the same exchange.
    """
    nothing = F.struct(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("long").alias("seq"))
    asks = requests.select("ip", "ts_us", nothing.alias("item"))
    subs = submissions.select("ip", "ts_us", F.struct(F.lit(1).alias("kind"), "hash", "seq").alias("item"))
    merged = (
        asks.unionByName(subs)
        .withColumn("slice", slice_of(F.col("ts_us"), SLICE_S))
        .where("ip IS NOT NULL AND slice IS NOT NULL")
        .repartition("ip", "slice")
    )
    # reads the whole of ``item``, so that Spark shuffles the rows once for both branches
    marks = (
        merged.groupBy("ip", "slice")
        .agg(
            F.expr("max(IF(item.kind = 0, ts_us, NULL))").alias("last_ask"),
            F.expr("count(IF(item.kind < 2, item, NULL))").alias("n"),
        )
        .where("n > 0")
    )
    earlier = Window.partitionBy("ip").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("ip", "slice", F.max("last_ask").over(earlier).alias("carried"))
    inside = (
        Window.partitionBy("ip", "slice")
        .orderBy("ts_us", "kind", "seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    asked = F.max(F.when(F.col("kind") == 0, F.col("ts_us"))).over(inside)
    return (
        merged.select("ip", "slice", "ts_us", "item.*")
        .withColumn("in_slice", asked)
        .filter(F.col("kind") == 1)
        .join(carried, ["ip", "slice"])
        .withColumn("asked", F.coalesce("in_slice", "carried"))
        .select(
            "ip",
            "hash",
            "ts_us",
            "seq",
            F.coalesce(F.col("ts_us") - F.col("asked") <= ttl_s * US, F.lit(False)).alias(
                "has_session"
            ),
        )
    )


def _leap(candidates: DataFrame, ttl_us: int) -> DataFrame:
    """Accepted times, by doubling jumps instead of one long pass.

    ``hop`` leads from a time to the first later one past the claim, which is the holder after
    it whatever came before; hops of length 1, 2, 4, ... are composed by joins on (ip, ts_us),
    each row being unique, until every segment's first time has reached all its successors. The
    number of rounds grows with the logarithm of the longest chain of claims, and a row whose hop
    leaves its segment takes part no longer, so most segments are done after the first round.
    """
    length = max(1, ttl_us // US)
    base = candidates.select("ip", "segment", "ts_us").distinct()
    home = slice_of(F.col("ts_us"), length)
    rows = base.select("ip", "segment", "ts_us", home.alias("slice"), F.lit(1).alias("kind"))
    probes = base.select(
        "ip",
        "segment",
        (F.col("ts_us") + ttl_us).alias("at"),
        F.col("ts_us").alias("origin"),
    )
    # First candidate after the probe: in the probe's slice, or the first of a later one.
    merged = rows.select(
        "ip", "segment", "slice", F.col("ts_us").alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("origin"), F.col("ts_us").alias("time"),
    ).unionByName(
        probes.select(
            "ip", "segment", slice_of(F.col("at"), length).alias("slice"), "at",
            F.lit(2).alias("kind"), "origin", F.lit(None).cast("long").alias("time"),
        )
    )
    by_slice = merged.groupBy("ip", "segment", "slice").agg(F.min("time").alias("first_time"))
    later = (
        Window.partitionBy("ip", "segment").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    )
    carried = by_slice.select("ip", "segment", "slice", F.min("first_time").over(later).alias("next_slice"))
    # Latest first, and probes before rows of the same time: the next one is strictly later.
    nearest = F.min(F.when(F.col("kind") == 1, F.col("time"))).over(
        Window.partitionBy("ip", "segment", "slice")
        .orderBy(F.col("at").desc(), F.col("kind").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hop = (
        merged.join(carried, ["ip", "segment", "slice"])
        .withColumn("hit", F.coalesce(nearest, F.col("next_slice")))
        .filter((F.col("kind") == 2) & F.col("hit").isNotNull())
        .select("ip", F.col("origin").alias("ts_us"), F.col("hit").alias("next_us"))
    )
    hop = cut_lineage(hop)
    reached = cut_lineage(base.groupBy("ip", "segment").agg(F.min("ts_us").alias("ts_us")).select("ip", "ts_us"))
    while not hop.isEmpty():
        jumped = reached.join(hop, ["ip", "ts_us"]).select("ip", F.col("next_us").alias("ts_us"))
        reached = cut_lineage(reached.unionByName(jumped).distinct())
        second = hop.select("ip", F.col("ts_us").alias("next_us"), F.col("next_us").alias("end_us"))
        hop = cut_lineage(hop.join(second, ["ip", "next_us"]).select("ip", "ts_us", F.col("end_us").alias("next_us")))
    return reached


def bind(
    submissions: DataFrame,
    requests: DataFrame,
    ttl_s=P.FINGERPRINT_TTL_S,
    session_ttl_s=P.SESSION_TIMEOUT_S,
) -> DataFrame:
    """Every submission with ``outcome``: ACCEPTED, REPEAT, BAD_HASH, NO_SESSION or
    ALREADY_BOUND.

    The valid submissions of an ordinary address are settled together (``_folded``).  Those of
    a busy one fall into segments separated by pauses longer than the claim; a segment always
    starts with an acceptance, so segments are independent.  All of them are solved by doubling
    jumps, however long they are.
    """
    subs = submissions.select("ip", "hash", "ts_us", "seq")
    checked = with_last_request(subs, requests, session_ttl_s).withColumn(
        "reject",
        F.when(~F.coalesce(X.is_fingerprint(F.col("hash")), F.lit(False)), "BAD_HASH").when(
            ~F.col("has_session"), "NO_SESSION"
        ),
    )
    checked = cut_lineage(checked.drop("has_session"))  # read several times below
    valid = checked.filter(F.col("reject").isNull())
    refused = checked.filter(F.col("reject").isNotNull()).withColumnRenamed("reject", "outcome")
    busy = cut_lineage(valid.groupBy("ip").agg(F.count("*").alias("n")).filter(F.col("n") > FOLDED).select("ip"))
    if busy.isEmpty():
        return refused.unionByName(_folded(valid, ttl_s * US))
    settled = _folded(valid.join(busy, "ip", "left_anti"), ttl_s * US)
    return refused.unionByName(settled).unionByName(_leapt(valid.join(busy, "ip", "left_semi"), ttl_s))


def _folded(valid: DataFrame, ttl_us: int) -> DataFrame:
    """Outcomes of valid submissions, an address at a time in order of time.

    ``since`` is the last accepted time, ``seq`` the first submission in order at that time and
    ``bound`` the hash that one claims.  One without ``seq`` comes before it and claims nothing.
    """
    rows = valid.groupBy("ip").agg(F.sort_array(F.collect_list(F.struct("ts_us", "seq", "hash"))).alias("rows"))
    opens = f"coalesce(r.ts_us - s.since > {ttl_us}L, true)"
    takes = f"r.seq IS NOT NULL AND ({opens} OR r.ts_us = s.since AND coalesce(r.seq = s.seq, true))"
    state = "'since', {}, 'seq', {}, 'bound', {}, 'outcomes', {}"
    start = state.format("CAST(NULL AS bigint)", "CAST(NULL AS bigint)", "CAST(NULL AS string)", "CAST(array() AS array<string>)")
    step = state.format(
        f"IF({opens}, r.ts_us, s.since)",
        f"CASE WHEN {takes} THEN r.seq WHEN {opens} THEN NULL ELSE s.seq END",
        f"IF({takes}, r.hash, s.bound)",
        f"array_append(s.outcomes, CASE WHEN {takes} THEN 'ACCEPTED' WHEN s.bound = r.hash THEN 'REPEAT' ELSE 'ALREADY_BOUND' END)",
    )
    outcomes = f"aggregate(rows, named_struct({start}), (s, r) -> named_struct({step}), s -> s.outcomes)"
    settled = rows.selectExpr("ip", "rows", f"{outcomes} AS outcomes").selectExpr("ip", "explode(arrays_zip(rows, outcomes)) AS x")
    return settled.selectExpr("ip", "x.rows.hash", "x.rows.ts_us", "x.rows.seq", "x.outcomes AS outcome")


def _leapt(valid: DataFrame, ttl_s: int) -> DataFrame:
    """Outcomes of valid submissions of addresses with any number of them."""
    valid = cut_lineage(valid)  # read four times below
    segments = session_map(valid, ("ip",), ttl_s).select("ip", "slice", F.col("session_no").alias("segment"))
    placed = valid.withColumn("slice", slice_of(F.col("ts_us"), min(SLICE_S, ttl_s))).join(
        segments, ["ip", "slice"]
    )
    accepted = _leap(placed.select("ip", "segment", "ts_us"), ttl_s * US)
    # At an accepted time the first submission in order is the one accepted.
    first = (
        placed.join(accepted, ["ip", "ts_us"])
        .groupBy("ip", "ts_us")
        .agg(F.min("seq").alias("seq"), F.min_by("hash", "seq").alias("bound"))
        .withColumn("claim_us", F.col("ts_us"))
    )
    return _with_holder(valid, first, ttl_s)


def _with_holder(valid: DataFrame, claims: DataFrame, ttl_s: int) -> DataFrame:
    """Compare each valid submission with the claim in force (as-of, in slices)."""
    length = min(SLICE_S, ttl_s)
    rows = valid.select(
        "ip", "hash", "ts_us", "seq", slice_of(F.col("ts_us"), length).alias("slice")
    ).join(claims.select("ip", "ts_us", "seq", "claim_us", "bound"), ["ip", "ts_us", "seq"], "left")
    claim = F.when(F.col("claim_us").isNotNull(), F.struct("claim_us", "bound"))
    by_slice = rows.groupBy("ip", "slice").agg(F.max(claim).alias("last_claim"))
    earlier = Window.partitionBy("ip").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_slice.select("ip", "slice", F.max("last_claim").over(earlier).alias("carried"))
    inside = (
        Window.partitionBy("slice", "ip")
        .orderBy("ts_us", "seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    held = F.coalesce(F.max(claim).over(inside), F.col("carried"))
    return (
        rows.join(carried, ["ip", "slice"])
        .withColumn("held", held)
        .select(
            "ip",
            "hash",
            "ts_us",
            "seq",
            F.when(F.col("claim_us").isNotNull(), "ACCEPTED")
            .when(F.col("held.bound") == F.col("hash"), "REPEAT")
            .otherwise("ALREADY_BOUND")
            .alias("outcome"),
        )
    )


def shared_ip_counts(accepted: DataFrame, window_s=P.FINGERPRINT_WINDOW_S) -> DataFrame:
    """Accepted submissions with ``shared_ips``: distinct addresses seen with the hash so
    far in its window, which lasts while acceptances come at most ``window_s`` apart.

    A distinct count in time order is a running count of first occurrences; both are
    computed in slices, so a hash used by very many addresses is not one task.
    """
    keyed = cut_lineage(accepted.select("ip", "hash", "ts_us", "seq"))  # read twice
    windows = session_map(keyed, ("hash",), window_s).select("hash", "slice", "session_no")
    length = min(SLICE_S, window_s)
    rows = keyed.withColumn("slice", slice_of(F.col("ts_us"), length)).join(
        windows, ["hash", "slice"]
    )
    firsts = rows.groupBy("hash", "session_no", "ip").agg(
        F.min(F.struct("ts_us", "seq")).alias("first")
    )
    marked = rows.join(firsts, ["hash", "session_no", "ip"]).withColumn(
        "is_first",
        ((F.col("first.ts_us") == F.col("ts_us")) & (F.col("first.seq") == F.col("seq"))).cast("long"),
    )
    earlier = (
        Window.partitionBy("hash", "session_no")
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        marked.groupBy("hash", "session_no", "slice")
        .agg(F.sum("is_first").alias("n"))
        .select(
            "hash", "session_no", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
        )
    )
    inside = (
        Window.partitionBy("slice", "hash", "session_no")
        .orderBy("ts_us", "seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return marked.join(offsets, ["hash", "session_no", "slice"]).select(
        "ip",
        "hash",
        "ts_us",
        "seq",
        (F.col("base") + F.sum("is_first").over(inside)).alias("shared_ips"),
    )


def current_bindings(shared: DataFrame) -> DataFrame:
    """(ip, fingerprint_hash, shared_hash_ips): the last acceptance per address."""
    return shared.groupBy("ip").agg(
        F.max_by("hash", F.struct("ts_us", "seq")).alias("fingerprint_hash"),
        F.max_by("shared_ips", F.struct("ts_us", "seq")).alias("shared_hash_ips"),
    )


def actor_registry(
    shared: DataFrame, now_us: int, ttl_s=P.ACTOR_TTL_S, keep=P.MAX_TRACKED_ACTORS
) -> DataFrame:
    """Per hash: first and last seen, sightings, distinct addresses at the last one.

    A pause longer than the time to live starts a new record; records not seen for that
    long are gone; of the rest the ``keep`` most recent stay.
    """
    shared = cut_lineage(shared)  # read twice
    lives = session_map(shared, ("hash",), ttl_s).select("hash", "slice", "session_no")
    rows = shared.withColumn("slice", slice_of(F.col("ts_us"), min(SLICE_S, ttl_s))).join(
        lives, ["hash", "slice"]
    )
    place = F.struct("ts_us", "seq")
    return (
        rows.groupBy("hash", "session_no")
        .agg(
            F.min("ts_us").alias("first_seen"),
            F.max("ts_us").alias("last_seen"),
            F.count("*").alias("sightings"),
            F.max_by("shared_ips", place).alias("distinct_ips"),
        )
        .filter(now_us - F.col("last_seen") <= ttl_s * US)
        .drop("session_no")
        .orderBy(F.col("last_seen").desc(), "hash")
        .limit(keep)
    )
