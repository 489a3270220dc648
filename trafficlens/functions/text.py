"""Column functions over urls, user agents, referers and reasons."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def matches(text: Column, pattern: str) -> Column:
    """Unicode-aware case-insensitive search, as Python's IGNORECASE does."""
    return text.rlike(f"(?iu){pattern}")


def contains_any(text: Column, fragments) -> Column:
    return reduce(or_, [text.contains(f) for f in P.minimal_fragments(fragments)])


def starts_with_any(text: Column, prefixes) -> Column:
    return reduce(or_, [text.startswith(p) for p in prefixes])


def ends_with_any(text: Column, suffixes) -> Column:
    return reduce(or_, [text.endswith(s) for s in suffixes])


# --- url -------------------------------------------------------------------------------


def url_path(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def _segments(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda s: s != "")


def url_depth(url: Column) -> Column:
    return F.size(_segments(url))


def first_segment(url: Column) -> Column:
    """NULL for the root, so a distinct count skips it."""
    return F.try_element_at(_segments(url), F.lit(1))


def url_width(url: Column) -> Column:
    """Aggregate: how many different first segments were asked for."""
    return F.count_distinct(first_segment(url))


def split_path(url: Column) -> Column:
    """Path of an absolute or relative url, without scheme, host, query and fragment."""
    return F.regexp_extract(
        url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )


def split_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def lenient_url_decode(text: Column) -> Column:
    """Percent-decoding that keeps a text it cannot decode; '+' stays '+'."""
    shielded = F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(shielded), text)


def query_values(url: Column, name: str) -> Column:
    """Non-empty decoded values of one query parameter."""
    decode = lambda t: lenient_url_decode(F.replace(t, F.lit("+"), F.lit(" ")))
    pairs = F.split(split_query(url), "&")
    hits = F.filter(
        pairs,
        lambda kv: (decode(F.substring_index(kv, "=", 1)) == name)
        & (F.instr(kv, "=") > 0)
        & (F.length(kv) > F.instr(kv, "=")),
    )
    return F.transform(hits, lambda kv: decode(F.substring(kv, F.instr(kv, "=") + 1, F.length(kv))))


def is_static_file(path: Column) -> Column:
    return matches(path, P.alternation(P.STATIC_FILE_PATTERNS))


def is_api_route(path: Column) -> Column:
    return matches(path, P.alternation(P.API_ROUTE_PATTERNS))


def is_one_path_api(path: Column) -> Column:
    return matches(path, P.alternation(P.ONE_PATH_API_PATTERNS))


def is_grpc_path(path: Column) -> Column:
    return path.rlike(P.GRPC_PATH_PATTERN)


def is_scanner_path(path: Column) -> Column:
    return contains_any(F.lower(path), P.SCANNER_FRAGMENTS)


def is_protected_path(path: Column) -> Column:
    return contains_any(F.lower(path), P.PROTECTED_FRAGMENTS)


def is_botnet_path(path: Column) -> Column:
    return matches(path, P.alternation(P.BOTNET_PATH_PATTERNS))


def is_page_like(path: Column) -> Column:
    return ~is_api_route(path) & ~is_static_file(path)


def is_sign_in_url(url: Column) -> Column:
    return contains_any(F.lower(url), P.SIGN_IN_FRAGMENTS)


def has_credential(url: Column) -> Column:
    # The substring test spares the regular expression on urls without a query.
    return url.contains("=") & matches(url, P.credential_pattern())


def is_post_to_static(method: Column, url: Column) -> Column:
    return (method == "POST") & ends_with_any(url, P.POST_STATIC_SUFFIXES)


def is_image(url: Column) -> Column:
    return ends_with_any(F.lower(url), P.IMAGE_SUFFIXES)


def is_html_view(url: Column) -> Column:
    return url.endswith(".html") | url.endswith("/")


def is_night(local_hour: Column) -> Column:
    return (local_hour >= 2) & (local_hour < 6)


def has_no_referer(referer: Column) -> Column:
    return referer.isin(*P.NO_REFERER_VALUES)


def is_probe_path(path: Column) -> Column:
    return starts_with_any(path, P.PROBE_PREFIXES)


def is_blocked_url(url: Column) -> Column:
    """Probe prefix on the path, or an attack payload after decoding twice."""
    path = F.lower(split_path(url))
    decoded = F.lower(
        F.replace(lenient_url_decode(lenient_url_decode(url)), F.lit("+"), F.lit(" "))
    )
    prefixes = [p.lower() for p in P.PROBE_PREFIXES] + list(P.EXTRA_BLOCKED_PREFIXES)
    return starts_with_any(path, prefixes) | reduce(
        or_, [decoded.contains(m) for m in P.PAYLOAD_MARKERS]
    )


def site_referer_url(referer: Column, site: str) -> Column:
    """Local url behind a referer of ``site`` (host without www), else NULL."""
    host = site.replace(".", r"\.")
    local = F.regexp_extract(referer, rf"^https?://(?:www\.)?{host}(/[^ ]*)$", 1)
    return F.when(local != "", local)


# --- user agent ------------------------------------------------------------------------


def is_browser_agent(ua: Column) -> Column:
    return matches(ua, P.alternation(P.BROWSER_AGENT_PATTERNS))


def is_certain_bot_agent(ua: Column) -> Column:
    return matches(ua, P.alternation(P.CERTAIN_BOT_PATTERNS))


def is_cdn_agent(ua: Column) -> Column:
    return matches(ua, P.alternation(P.CDN_AGENT_PATTERNS))


def is_attack_tool_agent(ua: Column) -> Column:
    return matches(ua, P.alternation(P.ATTACK_TOOL_PATTERNS))


def is_integration_agent(ua: Column) -> Column:
    return matches(ua, P.alternation(P.INTEGRATION_PATTERNS))


def ua_category(ua: Column) -> Column:
    """0 browser, 1 bot, 2 unknown; the bot test comes first."""
    return (
        F.when((ua == "") | (ua == "-"), 2.0)
        .when(matches(ua, P.alternation(P.BOT_AGENT_PATTERNS)), 1.0)
        .when(is_browser_agent(ua), 0.0)
        .otherwise(2.0)
    )


def sends_accept_language(ua: Column) -> Column:
    return F.lower(ua).contains("accept-language") | is_browser_agent(ua)


def is_baseline_bot_agent(ua: Column) -> Column:
    bare = F.trim(ua)
    return (bare == "") | (bare == "-") | matches(bare, P.BASELINE_AGENT_PATTERN)


def claims_engine(ua: Column, engine: str) -> Column:
    claim = {name: pattern for name, pattern, _ in P.CRAWLER_ENGINES}[engine]
    return matches(ua, claim)


def is_browser_like(ua: Column) -> Column:
    return ua.startswith("Mozilla/") & ~matches(ua, P.CRAWLER_TOKEN_PATTERN)


def rewrite_agent_in_line(raw_line: Column, old: Column, new: str) -> Column:
    """Replace the last quoted occurrence of ``old``; NULL when there is none."""
    quoted = F.concat(F.lit('"'), old, F.lit('"'))
    # Position of the last occurrence: search the reversed text from its start.
    back = F.instr(F.reverse(raw_line), F.reverse(quoted))
    start = F.length(raw_line) - back - F.length(quoted) + 2
    head = F.substring(raw_line, F.lit(1), start - 1)
    tail = F.substring(raw_line, start + F.length(quoted), F.length(raw_line))
    return F.when(back > 0, F.concat(head, F.lit(f'"{new}"'), tail))


# --- misc ------------------------------------------------------------------------------


def char_entropy(text: Column) -> Column:
    """Shannon entropy (bits) of the characters of ``text``.

    Counting by removal keeps it in built-in string functions: the number of occurrences
    of a character is the length lost when it is removed.
    """
    n = F.length(text).cast("double")
    chars = F.array_distinct(F.split(text, ""))
    lost = F.transform(
        F.filter(chars, lambda c: c != ""),
        lambda c: n - F.length(F.replace(text, c)),
    )
    weighted = F.aggregate(lost, F.lit(0.0), lambda acc, k: acc + k * F.log2(k))
    return F.when(n > 0, F.log2(n) - weighted / n).otherwise(0.0)


def rule_name(reason: Column) -> Column:
    return F.trim(F.regexp_extract(reason, r"^[^(:]*", 0))


def actor_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def is_fingerprint(value: Column) -> Column:
    return value.rlike(r"^[0-9a-fA-F]{64}\z")


def is_promoted(source: str) -> Column:
    """Whether a SIGNALS row lets ``source`` decide; needs that source to be resolved."""
    if source not in P.SIGNAL_SOURCES:
        raise ValueError(f"unknown signal source {source!r}")
    resolved = F.col("fp_resolved") if source == "fingerprint" else F.col("resolved")
    return F.coalesce(resolved & F.array_contains("promoted", source), F.lit(False))
