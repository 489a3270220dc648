"""Sessions and order-dependent operators that no single busy client can stall.

One crawler may own a large share of all requests, so nothing here sorts a client's
whole history in one task.  Time is cut into slices no longer than the session timeout.
Two requests of a client inside one slice are then always in the same session, which
means a session is a run of whole slices:

* ``session_map`` reduces the requests to one row per (client, slice) with map-side
  aggregation and finds the session breaks between those few rows;
* row-level windows are partitioned by (client, slice) and continue across the border
  with the totals the map carries over.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..schema import SOURCE_ORDER

SLICE_S = 300


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def with_clock(requests: DataFrame) -> DataFrame:
    """Add ``ts_us`` (epoch microseconds) and any missing source-order column.

    A request without an address or agent counts as one of the empty address or agent: NULL keys
    would be lost in the joins on the client.
    """
    names = [c for c in ("ip", "user_agent") if c in requests.columns]
    out = requests.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in names})
    if "ts_us" not in out.columns:
        out = out.withColumn("ts_us", micros(F.col("ts")))
    for name, value in (("src_file", ""), ("src_block", 0), ("line_no", 0)):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    return out


def slice_of(ts_us: Column, slice_s: int) -> Column:
    return F.floor(ts_us / F.lit(slice_s * 1_000_000)).cast("long")


def slice_length(timeout_s: int) -> int:
    return min(SLICE_S, timeout_s)


def session_map(requests: DataFrame, keys=("ip",), timeout_s=P.SESSION_TIMEOUT_S) -> DataFrame:
    """One row per (client, slice): which session it belongs to and what came before.

    ``session_no``       running number of the session within the client
    ``session_start_us`` / ``session_end_us`` / ``session_rows``
    ``prev_end_us``      last request before this slice, NULL when a session starts here
    ``rows_before``      requests of the client in earlier slices
    ``session_rows_before``  the same, counted from the start of the session

    A break needs a gap longer than the timeout; an equal gap does not break.
    """
    keys = list(keys)
    length = slice_length(timeout_s)
    slices = (
        requests.select(*keys, "ts_us")
        .withColumn("slice", slice_of(F.col("ts_us"), length))
        .groupBy(*keys, "slice")
        .agg(
            F.count("*").alias("n"),
            F.min("ts_us").alias("lo"),
            F.max("ts_us").alias("hi"),
        )
    )
    return sessions_of_slices(slices, keys, timeout_s)


def sessions_of_slices(slices: DataFrame, keys=("ip",), timeout_s=P.SESSION_TIMEOUT_S) -> DataFrame:
    """The same from one row per (client, slice): n requests from ``lo`` to ``hi``."""
    keys = list(keys)
    # A client has at most one row per slice here, so these windows stay small however
    # many requests the client made.
    in_time = Window.partitionBy(*keys).orderBy("slice")
    before = in_time.rowsBetween(Window.unboundedPreceding, -1)
    session = Window.partitionBy(*keys, "session_no")
    marked = slices.withColumn("prev_end", F.lag("hi").over(in_time)).withColumn(
        "opens",
        F.coalesce(F.col("lo") - F.col("prev_end") > timeout_s * 1_000_000, F.lit(True)),
    )
    return (
        marked.withColumn("session_no", F.sum(F.col("opens").cast("long")).over(in_time))
        .withColumn("rows_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("session_start_us", F.min("lo").over(session))
        .withColumn("session_end_us", F.max("hi").over(session))
        .withColumn("session_rows", F.sum("n").over(session))
        .withColumn(
            "session_rows_before", F.col("rows_before") - F.min("rows_before").over(session)
        )
        .select(
            *keys,
            "slice",
            "session_no",
            "session_start_us",
            "session_end_us",
            "session_rows",
            F.when(~F.col("opens"), F.col("prev_end")).alias("prev_end_us"),
            "rows_before",
            "session_rows_before",
        )
    )


def with_session(requests: DataFrame, keys=("ip",), timeout_s=P.SESSION_TIMEOUT_S) -> DataFrame:
    """Requests with their session columns (one equi-join on client and slice)."""
    keys = list(keys)
    clocked = with_clock(requests)
    sliced = clocked.withColumn("slice", slice_of(F.col("ts_us"), slice_length(timeout_s)))
    return sliced.join(session_map(clocked, keys, timeout_s), [*keys, "slice"])


def sessionize(requests: DataFrame, keys=("ip",), timeout_s=P.SESSION_TIMEOUT_S) -> DataFrame:
    """Requests with session, position and gap.

    ``pos``         1-based position of the request in the client's history
    ``session_pos`` the same within the session
    ``gap_s``       seconds since the previous request of the session, NULL for the first
    """
    keys = list(keys)
    order = Window.partitionBy(*keys, "slice").orderBy("ts_us", *SOURCE_ORDER)
    rows = with_session(requests, keys, timeout_s)
    previous = F.coalesce(F.lag("ts_us").over(order), F.col("prev_end_us"))
    return (
        rows.withColumn("rank_in_slice", F.row_number().over(order))
        .withColumn("gap_s", (F.col("ts_us") - previous) / 1e6)
        .withColumn("pos", F.col("rows_before") + F.col("rank_in_slice"))
        .withColumn("session_pos", F.col("session_rows_before") + F.col("rank_in_slice"))
        .drop("rank_in_slice")
    )


def session_table(requests: DataFrame, keys=("ip",), timeout_s=P.SESSION_TIMEOUT_S) -> DataFrame:
    """One row per session with its bounds; the agent is that of the first request."""
    keys = list(keys)
    rows = sessionize(requests, keys, timeout_s)
    return rows.groupBy(*keys, "session_no").agg(
        F.min("session_start_us").alias("start_us"),
        F.max("session_end_us").alias("end_us"),
        F.count("*").alias("request_count"),
        F.min_by("user_agent", "pos").alias("first_agent"),
    )


def rate_limited(
    requests: DataFrame,
    limit=P.RATE_LIMIT_REQUESTS,
    window_s=P.RATE_LIMIT_WINDOW_S,
    keys=("ip",),
) -> DataFrame:
    """Clients with more than ``limit`` requests inside a half-open window, and the
    1-based position of the first request that exceeds it.

    A request exceeds the limit when the one ``limit`` places before it is less than
    ``window_s`` old, so a ``lag`` decides.  Requests near the end of a slice are copied
    into the next slice to serve as its history.
    """
    keys = list(keys)
    # a window then reaches back into one slice at most
    length = max(SLICE_S, window_s)
    window_us = window_s * 1_000_000
    rows = with_clock(requests).select(*keys, "ts_us", *SOURCE_ORDER)
    home = slice_of(F.col("ts_us"), length)
    late = F.col("ts_us") > (home + 1) * F.lit(length * 1_000_000) - window_us
    copies = F.when(late, F.array(home, home + 1)).otherwise(F.array(home))
    spread = rows.withColumn("slice", F.explode(copies)).withColumn(
        "copy", F.col("slice") != home
    )
    order = Window.partitionBy(*keys, "slice").orderBy("ts_us", *SOURCE_ORDER)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = (
        spread.withColumn("back", F.lag("ts_us", limit).over(order))
        .withColumn("rank_in_slice", F.sum((~F.col("copy")).cast("long")).over(so_far))
        .filter(~F.col("copy") & (F.col("ts_us") - F.col("back") < window_us))
        .groupBy(*keys, "slice")
        .agg(F.min("rank_in_slice").alias("rank_in_slice"))
    )
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*keys, home.alias("slice"))
        .agg(F.count("*").alias("n"))
        .select(*keys, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
    )
    return (
        over.join(totals, [*keys, "slice"])
        .groupBy(*keys)
        .agg(F.min(F.col("rows_before") + F.col("rank_in_slice")).alias("first_flag"))
    )


def retained_history(
    requests: DataFrame,
    payload,
    keep=P.RETAINED_REQUESTS,
    keys=("ip",),
    timeout_s=P.SESSION_TIMEOUT_S,
    block=500,
) -> DataFrame:
    """For every request, the last ``keep`` requests of its session up to itself.

    Sessions are cut into blocks of ``block`` positions; each block also receives the
    ``keep - 1`` rows before it, so a task holds at most ``block + keep - 1`` rows of one
    session.  Returns ``history`` (array of ``payload`` structs in order) per request.
    """
    keys = list(keys)
    rows = sessionize(requests, keys, timeout_s)
    item = F.struct(F.col("session_pos").alias("session_pos"), *payload)
    home = F.floor((F.col("session_pos") - 1) / block)
    feeds_next = F.col("session_pos") > (home + 1) * block - (keep - 1)
    blocks = F.when(feeds_next, F.array(home, home + 1)).otherwise(F.array(home))
    grouped = (
        rows.select(*keys, "session_no", F.explode(blocks).alias("block"), item.alias("item"))
        .groupBy(*keys, "session_no", "block")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    first_pos = F.col("block") * block
    index = F.posexplode("items").alias("at", "current")
    return (
        grouped.select(*keys, "session_no", "block", "items", index)
        .filter(F.col("current.session_pos") > first_pos)
        .select(
            *keys,
            "session_no",
            F.col("current.session_pos").alias("session_pos"),
            F.slice(
                "items",
                F.greatest(F.col("at") - (keep - 2), F.lit(1)),
                F.least(F.col("at") + 1, F.lit(keep)),
            ).alias("history"),
        )
    )
