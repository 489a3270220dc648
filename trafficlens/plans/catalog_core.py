"""Registered queries: sessions, features, rules, scan and the columns they rest on."""

import uuid

from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import scoring as S
from ..functions import text as X
from ..operators import rules as R
from ..operators import sessions as O
from ..operators.features import session_features
from ..schema import FEATURES
from ..sources import derived as D
from ..sources.adapters import requests_of
from ..session import shared_folder
from ..sources.exports import write_scan
from . import oracle_base as B
from .registry import Registry, rounded
from .scan import scan_sessions, scan_summary

core = Registry()


def scored(spark, sf_dir):
    return scan_sessions(requests_of(spark, sf_dir), S.load_network())


ROUNDED_FEATURES_SQL = ", ".join(f"round({f}, 6) + 0 AS {f}" for f in FEATURES)


@core.query(
    "scan_summary",
    B.over_scored(
        """SELECT sum(requests)::BIGINT AS total_entries, count(*) AS total_sessions,
        count_if(label = 'bot')::BIGINT AS bot_sessions,
        count_if(label = 'human')::BIGINT AS human_sessions,
        count_if(label = 'automated-integration')::BIGINT AS integration_sessions,
        round(count_if(label = 'bot') / count(*), 6) AS bot_rate FROM scored"""
    ),
    "E1 A19",
)
def _(spark, sf):
    return rounded(scan_summary(scored(spark, sf)), "bot_rate")


@core.query(
    "scan_document",
    B.over_scored(
        """SELECT label, risk, count(*) AS sessions, sum(requests)::BIGINT AS requests,
        (SELECT count(*) FROM scored) AS total_sessions,
        (SELECT sum(requests)::BIGINT FROM scored) AS total_entries FROM scored GROUP BY label, risk"""
    ),
    "A19",
)
def _(spark, sf):
    """The scan written as a document and read back: its sessions, and its one-row summary."""
    path = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    sessions = scored(spark, sf)
    write_scan(sessions, scan_summary(sessions), path)
    summary = spark.read.json(f"{path}/summary").select(F.struct("total_sessions", "total_entries")).scalar()
    read = spark.read.json(f"{path}/sessions").groupBy("label", "risk")
    counts = read.agg(F.count("*").alias("sessions"), F.sum("requests").alias("requests"))
    return counts.withColumn("s", summary).select("label", "risk", "sessions", "requests", "s.*")


@core.query(
    "scan_sessions",
    B.over_scored(
        f"""SELECT ip || '#' || session_no AS session_id, ip, session_no::BIGINT AS session_no,
        user_agent, requests, round(duration, 6) AS duration, top_endpoint,
        {ROUNDED_FEATURES_SQL}, rule_code, heuristic_label, heuristic_confidence,
        round(model_score, 6) AS model_score, round(score, 6) AS score, label, risk FROM scored"""
    ),
    "E1 E2 B22 B36 B37 F1",
)
def _(spark, sf):
    rows = scored(spark, sf).select(
        "session_id", "ip", "session_no", "user_agent", "requests", "duration", "top_endpoint",
        *FEATURES, "rule_code", "heuristic_label", "heuristic_confidence", "model_score", "score",
        "label", "risk",
    )
    return rounded(rows, "duration", *FEATURES, "model_score", "score")


@core.query(
    "session_features",
    B.over_features(
        f"""SELECT ip, session_no::BIGINT AS session_no, requests, {ROUNDED_FEATURES_SQL}
        FROM feats"""
    ),
    "D1-D19 C4 C5 C6",
)
def _(spark, sf):
    rows = session_features(requests_of(spark, sf))
    return rounded(rows.select("ip", "session_no", "requests", *FEATURES), *FEATURES)


def _features_at(timeout_s):
    """session_features with another timeout: longer and shorter than any window inside."""

    def oracle():
        return B.with_ctes(
            f"""SELECT ip, session_no::BIGINT AS session_no, requests, {ROUNDED_FEATURES_SQL}
            FROM feats""",
            B.REQ, B.sessions_cte(timeout_s=timeout_s), B.FLAG, B.CHAR_ENTROPY, B.INPUTS, B.FEATS,
        )

    @core.query(f"session_features_{timeout_s}s", oracle(), "D1-D19 C4 C5 C6")
    def _(spark, sf):
        rows = session_features(requests_of(spark, sf), timeout_s=timeout_s)
        return rounded(rows.select("ip", "session_no", "requests", *FEATURES), *FEATURES)


_features_at(7200)
_features_at(5)


@core.query(
    "session_rules",
    B.over_labelled(
        """SELECT ip, session_no::BIGINT AS session_no, pages, night_pages, scanner_hits,
        protected_hits, rule_code, heuristic_label, heuristic_confidence FROM labelled"""
    ),
    "rule chain, label_entries",
)
def _(spark, sf):
    return R.label_sessions(requests_of(spark, sf)).select(
        "ip", "session_no", "pages", "night_pages", "scanner_hits", "protected_hits",
        "rule_code", "heuristic_label", "heuristic_confidence",
    )


@core.query(
    "rule_frequency",
    B.over_scored(
        """SELECT rule_code, label, count(*) AS sessions FROM scored
        GROUP BY ROLLUP (rule_code, label)"""
    ),
    "E37",
)
def _(spark, sf):
    return scored(spark, sf).rollup("rule_code", "label").agg(F.count("*").alias("sessions"))


@core.query(
    "sessionized_requests",
    B.over_sessions(
        """SELECT line_no, ip, session_no::BIGINT AS session_no, pos, session_pos,
        round(gap_us / 1e6, 6) AS gap_s FROM ses"""
    ),
    "C1 C4 C12",
)
def _(spark, sf):
    rows = O.sessionize(requests_of(spark, sf))
    return rounded(
        rows.select("line_no", "ip", "session_no", "pos", "session_pos", "gap_s"), "gap_s"
    )


@core.query(
    "sessions_by_agent",
    B.with_ctes(
        """SELECT ip, user_agent, session_no::BIGINT AS session_no, min(ts_us) AS start_us,
        max(ts_us) AS end_us, count(*) AS request_count FROM ses GROUP BY ALL""",
        B.REQ,
        B.sessions_cte("ip, user_agent"),
    ),
    "C2",
)
def _(spark, sf):
    rows = O.session_table(requests_of(spark, sf), keys=("ip", "user_agent"))
    return rows.select("ip", "user_agent", "session_no", "start_us", "end_us", "request_count")


@core.query(
    "sessions_native_window",
    B.over_sessions(
        """SELECT ip, min(ts_us) AS start_us, count(*) AS request_count FROM ses
        GROUP BY ip, session_no"""
    ),
    "C1 C12",
)
def _(spark, sf):
    rows = requests_of(spark, sf)
    return (
        rows.groupBy("ip", F.session_window("ts", "1800 seconds"))
        .agg(F.min("ts_us").alias("start_us"), F.count("*").alias("request_count"))
        .select("ip", "start_us", "request_count")
    )


@core.query(
    "rate_limit_first_flag",
    B.over_requests(
        """SELECT ip, min(pos)::BIGINT AS first_flag FROM (
        SELECT ip, row_number() OVER w AS pos, ts_us - lag(ts_us, 5) OVER w AS back FROM req
        WINDOW w AS (PARTITION BY ip ORDER BY ts_us, line_no)) WHERE back < 120000000 GROUP BY ip"""
    ),
    "C7",
)
def _(spark, sf):
    # The table is sparse, so the limit is set where it separates clients.
    return O.rate_limited(requests_of(spark, sf), limit=5, window_s=120)


@core.query(
    "rate_limits_first_flag",
    B.over_requests(
        " UNION ALL ".join(
            f"""SELECT {n} AS most, {s} AS seconds, ip, min(pos)::BIGINT AS first_flag FROM (
            SELECT ip, row_number() OVER w AS pos, ts_us - lag(ts_us, {n}) OVER w AS back FROM req
            WINDOW w AS (PARTITION BY ip ORDER BY ts_us, line_no)) WHERE back < {s}000000 GROUP BY ip"""
            for n, s in ((1, 60), (3, 600), (4, 3600))
        )
    ),
    "C7",
)
def _(spark, sf):
    """Three limits, one with a window longer than a slice of time."""
    out = None
    for n, s in ((1, 60), (3, 600), (4, 3600)):
        found = O.rate_limited(requests_of(spark, sf), limit=n, window_s=s)
        found = found.select(F.lit(n).alias("most"), F.lit(s).alias("seconds"), "ip", "first_flag")
        out = found if out is None else out.unionByName(found)
    return out


@core.query(
    "url_facts",
    B.over_requests(
        f"""SELECT line_no, path,
        len(regexp_extract_all(path, '[^/]+'))::INT AS depth,
        {B.hit("path", B.P.alternation(B.P.STATIC_FILE_PATTERNS))} AS static_file,
        {B.hit("path", B.P.alternation(B.P.API_ROUTE_PATTERNS))} AS api_route,
        {B.hit("path", B.P.alternation(B.P.ONE_PATH_API_PATTERNS))} AS one_path_api,
        {B.hit("path", B.P.alternation(B.P.BOTNET_PATH_PATTERNS))} AS botnet,
        regexp_matches(path, {B.sql_text(B.P.GRPC_PATH_PATTERN)}) AS grpc,
        {B.any_of("lower(path)", B.P.SCANNER_FRAGMENTS)} AS scanner,
        {B.any_of("lower(path)", B.P.PROTECTED_FRAGMENTS)} AS protected,
        {B.any_of("lower(url)", B.P.SIGN_IN_FRAGMENTS)} AS sign_in,
        {B.hit("url", B.P.credential_pattern())} AS credential,
        method = 'POST' AND {B.suffixed("url", B.P.POST_STATIC_SUFFIXES)} AS post_static,
        {B.suffixed("lower(url)", B.P.IMAGE_SUFFIXES)} AS image,
        ends_with(url, '.html') OR ends_with(url, '/') AS html_view,
        local_hour >= 2 AND local_hour < 6 AS night,
        referer IN ('-', '', 'none') AS no_referer,
        {B.prefixed("lower(path)", [*B.P.PROBE_PREFIXES, *B.P.EXTRA_BLOCKED_PREFIXES])}
          OR {B.any_of("lower(replace(url_decode(url_decode(url)), '+', ' '))", B.P.PAYLOAD_MARKERS)}
          AS blocked,
        nullif(regexp_extract(referer, '^https?://(?:www[.])?shop[.]example(/[^ ]*)$', 1), '')
          AS site_url
        FROM req"""
    ),
    "B1 B2 B7-B10 B12 B13 B15-B20 B29 B33",
)
def _(spark, sf):
    url, path = F.col("url"), F.col("path")
    return (
        requests_of(spark, sf)
        .withColumn("path", X.url_path(url))
        .select(
            "line_no",
            "path",
            X.url_depth(url).alias("depth"),
            X.is_static_file(path).alias("static_file"),
            X.is_api_route(path).alias("api_route"),
            X.is_one_path_api(path).alias("one_path_api"),
            X.is_botnet_path(path).alias("botnet"),
            X.is_grpc_path(path).alias("grpc"),
            X.is_scanner_path(path).alias("scanner"),
            X.is_protected_path(path).alias("protected"),
            X.is_sign_in_url(url).alias("sign_in"),
            X.has_credential(url).alias("credential"),
            X.is_post_to_static(F.col("method"), url).alias("post_static"),
            X.is_image(url).alias("image"),
            X.is_html_view(url).alias("html_view"),
            X.is_night(F.col("local_hour")).alias("night"),
            X.has_no_referer(F.col("referer")).alias("no_referer"),
            X.is_blocked_url(url).alias("blocked"),
            X.site_referer_url(F.col("referer"), "shop.example").alias("site_url"),
        )
    )


@core.query(
    "page_url_facts",
    f"""WITH p AS (SELECT page_id, url,
        regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path
        FROM pages)
    SELECT page_id, path, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page_no,
      {B.hit("path", B.P.alternation(B.P.STATIC_FILE_PATTERNS))} AS static_file,
      {B.hit("path", B.P.alternation(B.P.API_ROUTE_PATTERNS))} AS api_route,
      {B.hit("url", B.P.credential_pattern())} AS credential FROM p""",
    "B1 E5 url splitting",
)
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = X.split_path(F.col("url"))
    return pages.select(
        "page_id",
        path.alias("path"),
        F.coalesce(F.try_element_at(X.query_values(F.col("url"), "page"), F.lit(1)), F.lit("")).alias(
            "page_no"
        ),
        X.is_static_file(path).alias("static_file"),
        X.is_api_route(path).alias("api_route"),
        X.has_credential(F.col("url")).alias("credential"),
    )


@core.query(
    "agent_facts",
    B.over_requests(
        f"""SELECT user_agent, count(*) AS requests,
        any_value(CASE WHEN user_agent IN ('', '-') THEN 2.0
          WHEN {B.hit("user_agent", B.P.alternation(B.P.BOT_AGENT_PATTERNS))} THEN 1.0
          WHEN {B.hit("user_agent", B.P.alternation(B.P.BROWSER_AGENT_PATTERNS))} THEN 0.0
          ELSE 2.0 END::DOUBLE) AS ua_category,
        any_value({B.hit("user_agent", B.P.alternation(B.P.CERTAIN_BOT_PATTERNS))}) AS certain_bot,
        any_value({B.hit("user_agent", B.P.alternation(B.P.CDN_AGENT_PATTERNS))}) AS cdn,
        any_value({B.hit("user_agent", B.P.alternation(B.P.ATTACK_TOOL_PATTERNS))}) AS attack_tool,
        any_value({B.hit("user_agent", B.P.alternation(B.P.INTEGRATION_PATTERNS))}) AS integration,
        any_value(trim(user_agent) IN ('', '-')
          OR {B.hit("user_agent", B.P.BASELINE_AGENT_PATTERN)}) AS baseline_bot,
        any_value(starts_with(user_agent, 'Mozilla/')
          AND NOT {B.hit("user_agent", B.P.CRAWLER_TOKEN_PATTERN)}) AS browser_like,
        any_value({B.hit("user_agent", "googlebot")}) AS claims_google
        FROM req GROUP BY user_agent"""
    ),
    "B4 B5 B6 B7 B11 B14 B32 C9",
)
def _(spark, sf):
    ua = F.col("user_agent")
    return (
        requests_of(spark, sf)
        .groupBy("user_agent")
        .agg(F.count("*").alias("requests"))
        .select(
            "user_agent",
            "requests",
            X.ua_category(ua).alias("ua_category"),
            X.is_certain_bot_agent(ua).alias("certain_bot"),
            X.is_cdn_agent(ua).alias("cdn"),
            X.is_attack_tool_agent(ua).alias("attack_tool"),
            X.is_integration_agent(ua).alias("integration"),
            X.is_baseline_bot_agent(ua).alias("baseline_bot"),
            X.is_browser_like(ua).alias("browser_like"),
            X.claims_engine(ua, "google").alias("claims_google"),
        )
    )


@core.query(
    "url_width",
    B.over_requests(
        """SELECT ip, count(DISTINCT nullif(split_part(path, '/', 2), ''))::BIGINT AS width
        FROM req GROUP BY ip"""
    ),
    "B3",
)
def _(spark, sf):
    return requests_of(spark, sf).groupBy("ip").agg(X.url_width(F.col("url")).alias("width"))


@core.query(
    "path_entropy",
    B.over_requests(
        "SELECT path, round(bits, 6) + 0 AS bits FROM path_entropy", B.CHAR_ENTROPY
    ),
    "B21",
)
def _(spark, sf):
    paths = requests_of(spark, sf).select(X.url_path(F.col("url")).alias("path")).distinct()
    return rounded(paths.select("path", X.char_entropy(F.col("path")).alias("bits")), "bits")


@core.query(
    "masked_addresses",
    B.over_requests(
        """SELECT ip, regexp_replace(ip, '[.][0-9]+$', '.x') AS masked,
        substr(sha256(ip || '|' || user_agent), 1, 12) AS actor
        FROM (SELECT DISTINCT ip, user_agent FROM req)"""
    ),
    "B26 B27",
)
def _(spark, sf):
    rows = requests_of(spark, sf).select("ip", "user_agent").distinct()
    return rows.select(
        "ip",
        A.mask_ip(F.col("ip")).alias("masked"),
        X.actor_hash(F.col("ip"), F.col("user_agent")).alias("actor"),
    )


@core.query(
    "rewritten_lines",
    B.over_requests(
        # the agent is the last thing in the line, also where the referer reads the same
        f"""SELECT line_no, left(raw_line, length(raw_line) - length(user_agent) - 2) || '"{B.CHROME}"' AS line
        FROM req"""
    ),
    "B30 A11",
)
def _(spark, sf):
    rows = requests_of(spark, sf)
    line = X.rewrite_agent_in_line(F.col("raw_line"), F.col("user_agent"), B.CHROME)
    return rows.select("line_no", line.alias("line"))


# --- a second mapping of the events, one rule a client ------------------------------------------


@core.query(
    "session_rules_all",
    B.with_ctes(
        "SELECT ip, requests, rule_code, heuristic_label, heuristic_confidence FROM labelled",
        D.SCENARIO_SQL, B.SES, B.FLAG, B.CHAR_ENTROPY, B.INPUTS, B.FEATS, B.LABELLED,
    ),
    "rules 1-33 without signals",
)
def _(spark, sf):
    """Every event becomes a client that behaves as one of the rules describes."""
    return R.label_sessions(D.scenario_requests(spark, sf)).select(
        "ip", "requests", "rule_code", "heuristic_label", "heuristic_confidence"
    )


@core.query(
    "rules_found",
    B.with_ctes(
        "SELECT rule_code, count(*) AS sessions FROM labelled GROUP BY rule_code",
        D.SCENARIO_SQL, B.SES, B.FLAG, B.CHAR_ENTROPY, B.INPUTS, B.FEATS, B.LABELLED,
    ),
    "rules, how often each decides",
)
def _(spark, sf):
    return R.label_sessions(D.scenario_requests(spark, sf)).groupBy("rule_code").agg(F.count("*").alias("sessions"))
