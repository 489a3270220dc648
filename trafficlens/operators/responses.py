"""Profiles of captured HTTP and WebSocket responses (tables, never the network).

RESPONSE: target, seq, status, headers map, body binary, timing map, error.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECURITY_HEADERS = (
    "content-security-policy",
    "x-frame-options",
    "strict-transport-security",
    "x-content-type-options",
)
REDIRECTS = (301, 302, 303, 307, 308)


def byte_entropy(body: Column) -> Column:
    """Entropy (bits) of the bytes of a body.

    As Latin text a byte is a character; how often it occurs is by how much the text shrinks when
    it is taken out, so nothing as long as the body times a string per byte is ever built.
    """
    text = F.decode(body, "ISO-8859-1")
    n = F.length(text)
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(255)), lambda b: n - F.length(F.replace(text, F.char(b), F.lit("")))
    )
    log_sum = F.aggregate(counts, F.lit(0.0), lambda total, c: total + _clog(c))
    return F.when(n > 0, F.greatest(F.log2(n.cast("double")) - log_sum / n, F.lit(0.0))).otherwise(0.0)


def _clog(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(0.0)


def _variation(time: Column) -> Column:
    """Aggregate: population deviation over mean; 0 below two values or for a zero mean."""
    return F.when(
        (F.count(time) >= 2) & (F.avg(time) > 0), F.stddev_pop(time) / F.avg(time)
    ).otherwise(0.0)


def _timing(name: str) -> Column:
    return F.coalesce(F.try_element_at("timing", F.lit(name)), F.lit(0.0))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def response_features(responses: DataFrame) -> DataFrame:
    """One row per target: features of the first response (``seq`` is unique per target) and timing
    across all.

    Which response is first is found without bodies; only then is it fetched, so a body is in no
    aggregate, and it is profiled once per target.
    """
    grouped = responses.groupBy("target").agg(
        F.count("*").alias("responses"),
        F.min("seq").alias("first_seq"),
        _variation(_timing("total")).alias("timing_cv"),
        F.count_if(F.col("status").isin(*REDIRECTS)).alias("redirects"),
    )
    whole = responses.select(F.col("target").alias("of"), "seq", "status", "headers", "body", "timing", "error")
    grouped = grouped.join(whole, F.col("of").eqNullSafe(F.col("target")) & (F.col("seq") == F.col("first_seq")))
    lowered = F.transform_keys("headers", lambda k, v: F.lower(k))
    rows = grouped.drop("of", "seq", "first_seq").withColumn(
        "headers", F.coalesce(lowered, F.create_map().cast("map<string,string>"))
    )
    has = lambda name: F.map_contains_key("headers", F.lit(name))
    text = F.lower(F.col("body").cast("string"))
    server = F.lower(F.coalesce(F.try_element_at("headers", F.lit("server")), F.lit("")))
    listing = F.concat_ws(
        " ", F.map_keys("headers"), F.coalesce(F.array_join(F.map_values("headers"), " "), F.lit(""))
    )
    return rows.withColumns(
        {
            "response_time": _timing("total"),
            "ttfb": _timing("ttfb"),
            "status_code": F.col("status") / 1000.0,
            "header_count": F.least(F.size("headers") / 20.0, F.lit(1.0)),
            "body_bytes": F.coalesce(F.octet_length("body"), F.lit(0)),
            "body_entropy": F.coalesce(byte_entropy(F.col("body")), F.lit(0.0)),
            "body_length": F.least(
                F.coalesce(F.octet_length("body"), F.lit(0)) / F.lit(1024.0 * 100), F.lit(1.0)
            ),
            "has_server_header": _flag(has("server")),
            "has_x_powered_by": _flag(has("x-powered-by")),
            "has_content_security_policy": _flag(has("content-security-policy")),
            "has_x_frame_options": _flag(has("x-frame-options")),
            "has_strict_transport": _flag(has("strict-transport-security")),
            "has_accept_language": _flag(text.contains("lang=") | text.contains("language")),
            "redirect_count": F.least(F.col("redirects") / 5.0, F.lit(1.0)),
            "server_bot_score": F.when(
                server.contains("cloudflare") | server.contains("akamai"), 0.3
            )
            .when(server.contains("apache") | server.contains("nginx"), 0.1)
            .otherwise(0.0),
            "has_rate_limit": _flag(listing.contains("x-ratelimit") | has("retry-after")),
            "security_headers": reduce(
                lambda a, b: a + b, [has(h).cast("int") for h in SECURITY_HEADERS]
            ),
        }
    )


def _chain(rules, default) -> dict[str, Column]:
    """First matching rule gives (probe_score, probe_code, probe_reason)."""
    pick = lambda i: F.coalesce(
        *[F.when(rule[0], rule[i] if isinstance(rule[i], Column) else F.lit(rule[i])) for rule in rules],
        F.lit(default[i - 1]),
    )
    return {"probe_score": pick(1), "probe_code": pick(2), "probe_reason": pick(3)}


def profile_responses(features: DataFrame) -> DataFrame:
    """Score and reason per target from the HTTP features."""
    c, fmt = F.col, F.format_string
    time, status, cv = c("response_time"), c("status"), c("timing_cv")
    rules = [
        (c("error").isNotNull() & (c("error") != ""), 0.6, "ERROR",
         fmt("no response: %s", F.substring("error", 1, 50))),
        (time < 0.05, 0.3, "FAST", fmt("answered in %.3f s, as from a cache", time)),
        (time > 5.0, 0.5, "SLOW", fmt("took %.3f s, perhaps throttled", time)),
        (status == 429, 0.8, "RATE_LIMITED", "status 429: too many requests"),
        (status == 403, 0.7, "FORBIDDEN", "status 403: access denied"),
        (status >= 500, 0.5, "SERVER_ERROR", fmt("status %d: failure of the server", status)),
        (c("security_headers") >= 3, 0.2, "PROTECTED",
         fmt("%d protective headers are set", c("security_headers"))),
        ((c("responses") > 2) & (cv < 0.05) & (cv > 0), 0.7, "STEADY",
         fmt("times hardly vary (%.3f of their mean)", cv)),
        ((c("body_entropy") < 1.0) & (c("body_bytes") > 0), 0.4, "LOW_ENTROPY",
         fmt("body of few different bytes (%.2f bits)", c("body_entropy"))),
        (c("body_entropy") > 7.5, 0.3, "HIGH_ENTROPY",
         fmt("body looks packed or ciphered (%.2f bits)", c("body_entropy"))),
    ]
    return features.withColumns(_chain(rules, (0.3, "DEFAULT", "nothing stands out")))


def handshake_features(handshakes: DataFrame) -> DataFrame:
    """Per target, from target, seq, connected, handshake_ok, status, frames, timing, error."""
    first = lambda c: F.min_by(c, "seq")
    steady = F.when(F.col("connected"), _timing("handshake"))
    rows = handshakes.groupBy("target").agg(
        F.count("*").alias("responses"),
        first(
            F.struct("connected", "handshake_ok", "status", "frames", "timing", "error")
        ).alias("r"),
        _variation(steady).alias("handshake_timing_cv"),
    )
    frame = F.try_element_at("frames", F.lit(1))
    got = F.coalesce(F.size("frames") > 0, F.lit(False))
    return rows.select("target", "responses", "handshake_timing_cv", "r.*").withColumns(
        {
            "handshake_time": _timing("handshake"),
            "connect_time": _timing("connect"),
            "time_to_first_frame": _timing("time_to_first_frame"),
            "got_response_frame": _flag(got),
            "frame_entropy": F.when(got, byte_entropy(frame)).otherwise(0.0),
            "frame_size": F.when(got, F.least(F.octet_length(frame) / 1024.0, F.lit(1.0))).otherwise(
                0.0
            ),
        }
    )


def profile_handshakes(features: DataFrame) -> DataFrame:
    c, fmt = F.col, F.format_string
    cv = c("handshake_timing_cv")
    rules = [
        (~c("connected"), 0.6, "NOT_CONNECTED",
         fmt("not connected: %s", F.substring(F.coalesce(F.nullif("error", F.lit("")), F.lit("unknown")), 1, 50))),
        (~c("handshake_ok"), 0.7, "REJECTED",
         fmt("upgrade refused with status %d", c("status"))),
        (c("handshake_time") < 0.01, 0.3, "FAST",
         fmt("upgraded in %.3f s, as from nearby", c("handshake_time"))),
        ((c("responses") > 2) & (cv > 0) & (cv < 0.05), 0.7, "STEADY",
         fmt("upgrade times hardly vary (%.3f of their mean)", cv)),
        (c("got_response_frame") == 0, 0.4, "SILENT",
         "upgraded, then silent, as most servers are"),
    ]
    return features.withColumns(
        _chain(
            rules,
            (0.3, "DEFAULT", "upgraded and answered; nothing stands out"),
        )
    )
