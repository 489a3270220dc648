"""Plain-SQL building blocks that state the same results without Spark.

They favour the obvious formulation (one window over a whole client) over the scalable
one; they only serve to check results on small tables.
"""

from ..functions import patterns as P
from ..functions.scoring import load_network
from ..schema import FEATURES


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {sql_text(pattern)}, 'i')"


def any_of(column: str, fragments) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_text(f)})" for f in fragments) + ")"


def prefixed(column: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {sql_text(p)})" for p in prefixes) + ")"


def suffixed(column: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({column}, {sql_text(s)})" for s in suffixes) + ")"


CHROME = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 "
    "(KHTML, like Gecko) Chrome/125.0.0.0 Safari/537.36"
)
FIREFOX = "Mozilla/5.0 (X11; Linux x86_64; rv:125.0) Gecko/20100101 Firefox/125.0"

REQ = f"""
req0 AS (
  SELECT event_id, event_id AS line_no, user_id,
    1704067200000000 + (epoch_us(ts) - 1704067200000000) // 60 AS ts_us,
    '10.' || (user_id // 256) || '.' || (user_id % 256) || '.7' AS ip,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
    CASE event_type
      WHEN 'view' THEN '/product/' || (event_id % 40) || '.html'
      WHEN 'click' THEN '/image/' || (event_id % 25) || '.png'
      WHEN 'purchase' THEN '/basket/checkout?step=' || (event_id % 3)
      WHEN 'signup' THEN CASE WHEN user_id % 13 = 3 THEN '/login?token=' || event_id
                              ELSE '/account/new' END
      ELSE CASE WHEN user_id % 11 = 5 THEN '/.env' ELSE '/missing/' || (event_id % 9) END
    END AS url,
    CASE event_type WHEN 'error' THEN 404 WHEN 'purchase' THEN 302 ELSE 200 END AS status,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
    CASE WHEN user_id % 5 = 0 OR event_id % 7 = 0 THEN '-'
         ELSE 'https://shop.example/product/' || (event_id % 40) || '.html' END AS referer,
    CASE user_id % 8 WHEN 0 THEN 'curl/8.0' WHEN 1 THEN 'python-requests/2.31'
      WHEN 2 THEN 'Stripe/1.0 (webhooks)' WHEN 3 THEN '-' WHEN 4 THEN 'CustomAgent/1.0'
      WHEN 5 THEN '{FIREFOX}' ELSE '{CHROME}' END AS user_agent
  FROM events),
req AS (
  SELECT *, make_timestamp(ts_us) AS ts,
    hour(make_timestamp(ts_us)) AS local_hour,
    CAST(make_timestamp(ts_us) AS DATE) AS local_date,
    split_part(url, '?', 1) AS path,
    ip || ' - - [' || strftime(make_timestamp(ts_us), '%d/%b/%Y:%H:%M:%S') || ' +0000] "'
      || method || ' ' || url || ' HTTP/1.1" ' || status || ' ' || size || ' "' || referer
      || '" "' || user_agent || '"' AS raw_line
  FROM req0)"""


def sessions_cte(key="ip", timeout_s=1800, source="req", out="ses"):
    """``out``: the requests of ``source`` with session number, positions and gap."""
    return f"""
{out}_gap AS (
  SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {key} ORDER BY ts_us, line_no) AS raw_gap
  FROM {source}),
{out}_no AS (
  SELECT *, sum(CASE WHEN raw_gap IS NULL OR raw_gap > {timeout_s}::BIGINT * 1000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY {key} ORDER BY ts_us, line_no ROWS UNBOUNDED PRECEDING) AS session_no,
    row_number() OVER (PARTITION BY {key} ORDER BY ts_us, line_no) AS pos
  FROM {out}_gap),
{out} AS (
  SELECT * EXCLUDE (raw_gap),
    row_number() OVER (PARTITION BY {key}, session_no ORDER BY ts_us, line_no) AS session_pos,
    ts_us - lag(ts_us) OVER (PARTITION BY {key}, session_no ORDER BY ts_us, line_no) AS gap_us
  FROM {out}_no)"""


SES = sessions_cte()

FLAG = f"""
flag AS (
  SELECT *, method = 'POST' AND {suffixed('url', P.POST_STATIC_SUFFIXES)} AS post_static,
    {suffixed('lower(url)', P.IMAGE_SUFFIXES)} AS image,
    ends_with(url, '.html') OR ends_with(url, '/') AS html,
    local_hour >= 2 AND local_hour < 6 AS night,
    referer IN ('-', '', 'none') AS no_referer,
    {hit('url', P.credential_pattern())} AS credential,
    {any_of('lower(url)', P.SIGN_IN_FRAGMENTS)} AS sign_in,
    NOT {hit('path', P.alternation(P.STATIC_FILE_PATTERNS))} AS page,
    {hit('path', P.alternation(P.API_ROUTE_PATTERNS))} AS api_route,
    {hit('path', P.alternation(P.BOTNET_PATH_PATTERNS))} AS botnet,
    regexp_matches(path, {sql_text(P.GRPC_PATH_PATTERN)}) AS grpc,
    {any_of('lower(path)', P.SCANNER_FRAGMENTS)} AS scanner,
    {any_of('lower(path)', P.PROTECTED_FRAGMENTS)} AS protected,
    contains(raw_line, 'HTTP/1.0') AS http10,
    {hit('user_agent', P.alternation(P.BROWSER_AGENT_PATTERNS))}
      OR contains(lower(user_agent), 'accept-language') AS language
  FROM ses)"""

CHAR_ENTROPY = """
path_entropy AS (
  SELECT path, -sum(c / len * log2(c / len)) AS bits FROM (
    SELECT path, ch, count(*)::DOUBLE AS c, any_value(length(path))::DOUBLE AS len
    FROM (SELECT path, unnest(string_split(path, '')) AS ch
          FROM (SELECT DISTINCT path FROM req))
    GROUP BY path, ch) GROUP BY path)"""

INPUTS = """
clicks AS (
  SELECT ip, session_no, max(c) AS clicks, count(*) AS views FROM (
    SELECT ip, session_no, count(*) OVER (PARTITION BY ip, session_no ORDER BY ts_us
      RANGE BETWEEN CURRENT ROW AND 12000000 FOLLOWING) AS c FROM flag WHERE html)
  GROUP BY ip, session_no),
path_counts AS (
  SELECT ip, session_no, path, count(*) AS c, min(session_pos) AS first_pos
  FROM flag GROUP BY ALL),
path_stats AS (
  SELECT ip, session_no, count(*) AS paths, max(c) AS top_hits,
    arg_max(path, c * 1000000 - first_pos) AS top_endpoint,
    -sum(c::DOUBLE / n * log2(c::DOUBLE / n)) AS path_entropy
  FROM (SELECT *, sum(c) OVER (PARTITION BY ip, session_no) AS n FROM path_counts)
  GROUP BY ip, session_no),
status_stats AS (
  SELECT ip, session_no, -sum(c::DOUBLE / n * log2(c::DOUBLE / n)) AS status_entropy
  FROM (SELECT *, sum(c) OVER (PARTITION BY ip, session_no) AS n
        FROM (SELECT ip, session_no, status, count(*) AS c FROM flag GROUP BY ALL))
  GROUP BY ip, session_no),
base AS (
  SELECT f.ip, f.session_no, arg_min(user_agent, session_pos) AS user_agent,
    count(*) AS requests, min(ts_us) AS start_us, max(ts_us) AS end_us,
    (max(ts_us) - min(ts_us)) / 1e6 AS duration,
    coalesce(avg(gap_us) / 1e6, 0) AS avg_gap, coalesce(stddev_samp(gap_us / 1e6), 0) AS sd_gap,
    max(gap_us) AS max_gap_us, min(gap_us) AS min_gap_us,
    count(DISTINCT user_agent) AS agents, max(language::INT) AS language_agents,
    avg(e.bits) AS payload_entropy,
    count_if(post_static) AS post_static, count_if(image) AS image, count_if(html) AS html,
    count_if(night) AS night, count_if(status >= 400) AS error,
    count_if(status >= 400 AND status < 500) AS error_4xx,
    count_if(no_referer) AS no_referer, count_if(credential) AS credential,
    count_if(sign_in) AS sign_in, count_if(sign_in AND method = 'POST') AS post_sign_in,
    count_if(http10) AS http10, count_if(page) AS pages, count_if(page AND night) AS night_pages,
    count_if(scanner) AS scanner_hits, count_if(protected) AS protected_hits,
    count_if(botnet) AS botnet_hits,
    count(DISTINCT CASE WHEN grpc THEN path END) AS grpc_paths,
    count_if(page AND NOT api_route) AS page_like_hits
  FROM flag f JOIN path_entropy e USING (path) GROUP BY f.ip, f.session_no),
recent AS (
  SELECT f.ip, f.session_no, count_if(b.end_us - f.ts_us <= 60000000) AS last_60s,
    count_if(b.end_us - f.ts_us <= 300000000) AS last_300s
  FROM flag f JOIN base b USING (ip, session_no) GROUP BY ALL),
inputs AS (
  SELECT b.*, p.paths, p.top_hits, p.top_endpoint, p.path_entropy, s.status_entropy,
    r.last_60s, r.last_300s, coalesce(c.clicks, 0) AS clicks, coalesce(c.views, 0) AS views
  FROM base b JOIN path_stats p USING (ip, session_no) JOIN status_stats s USING (ip, session_no)
  JOIN recent r USING (ip, session_no) LEFT JOIN clicks c USING (ip, session_no))"""

FEATS = f"""
feats AS (
  SELECT *, avg_gap AS time_since_last_request,
    last_60s::DOUBLE AS requests_per_minute_1m, last_300s::DOUBLE AS requests_per_minute_5m,
    CASE WHEN requests >= 3 AND avg_gap > 0 THEN sd_gap / avg_gap ELSE 0 END
      AS inter_request_time_cv,
    duration AS time_since_session_start, paths::DOUBLE AS endpoint_count,
    path_entropy AS endpoint_sequence_entropy,
    paths / requests AS unique_endpoint_ratio, post_static::DOUBLE AS method_mismatch_count,
    1.0::DOUBLE / agents AS header_consistency_score,
    language_agents::DOUBLE AS has_accept_language,
    CASE WHEN user_agent IN ('', '-') THEN 2.0
         WHEN {hit('user_agent', P.alternation(P.BOT_AGENT_PATTERNS))} THEN 1.0
         WHEN {hit('user_agent', P.alternation(P.BROWSER_AGENT_PATTERNS))} THEN 0.0
         ELSE 2.0 END::DOUBLE AS ua_category,
    status_entropy AS status_code_entropy, top_hits::DOUBLE AS same_endpoint_hits,
    error / requests AS error_rate, image / requests AS image_ratio,
    night / requests AS night_ratio,
    CASE WHEN views >= 2 THEN clicks / 12.0::DOUBLE ELSE 0 END AS max_sustained_click_rate
  FROM inputs)"""


def chain_case(signals=False) -> str:
    outside = """
      WHEN tor_promoted AND tor_exit THEN 'TOR'
      WHEN abuse_promoted AND abuse_score >= 75 THEN 'ABUSE'
      WHEN fp_promoted AND shared_hash_ips >= 5 THEN 'FP_SHARED'
      WHEN fp_promoted AND fingerprint_hash IS NULL AND requests >= 3 AND duration >= 5
        AND page_like_hits > 0 THEN 'FP_ABSENT'"""
    browser = hit("user_agent", P.alternation(P.BROWSER_AGENT_PATTERNS))
    one_path = hit("top_endpoint", P.alternation(P.ONE_PATH_API_PATTERNS))
    return f"""CASE
      WHEN {hit('user_agent', P.alternation(P.INTEGRATION_PATTERNS))} THEN 'INTEGRATION'
      WHEN {hit('user_agent', P.alternation(P.CERTAIN_BOT_PATTERNS))} THEN 'KNOWN_BOT_UA'
      WHEN scanner_hits > 0 THEN 'SCANNER_PATH'
      WHEN requests >= 5 AND avg_gap > 0
        AND (max_gap_us - min_gap_us) / 1e6 / avg_gap < 0.05 AND grpc_paths < 3
        THEN 'UNIFORM_TIMING'
      WHEN http10 = requests AND requests > 5 THEN 'HTTP10'
      WHEN {hit('user_agent', P.alternation(P.CDN_AGENT_PATTERNS))} THEN 'CDN_BYPASS'
      WHEN protected_hits > 0 AND no_referer = requests THEN 'PROTECTED_SCAN'
      WHEN {hit('user_agent', P.alternation(P.ATTACK_TOOL_PATTERNS))} THEN 'ATTACK_TOOL'
      WHEN botnet_hits >= 2 AND requests >= 3 AND botnet_hits / requests > 0.3 THEN 'BOTNET'
      WHEN error_4xx / requests > 0.7 AND requests > 30 THEN 'DIR_BRUTE'
      WHEN agents >= 2 AND agents > least(10, 0.3 * requests) THEN 'UA_ROTATION'
      {outside if signals else ''}
      WHEN pages > 100 THEN 'PAGES_100'
      WHEN requests > 2000 THEN 'RAW_VOLUME'
      WHEN paths = 1 AND requests > 10 AND NOT {one_path} THEN 'SAME_ENDPOINT'
      WHEN duration >= 1 AND pages >= 5 AND pages / (duration / 60) > 50 THEN 'HIGH_RATE'
      WHEN no_referer = requests AND requests > 20 THEN 'NO_REFERER'
      WHEN error / requests > 0.5 AND requests > 10 THEN 'ERROR_RATE'
      WHEN top_hits > 20 AND top_hits / requests > 0.7 AND NOT {one_path} THEN 'REPEATED_PATH'
      WHEN requests >= 5 AND credential / requests > 0.5 THEN 'CRED_PARAM'
      WHEN sign_in >= 5 AND duration < 300
        AND CASE WHEN duration > 0 THEN sign_in / (duration / 60) ELSE 999 END > 5
        THEN 'CRED_BRUTE'
      WHEN post_sign_in >= 10 THEN 'POST_BRUTE'
      WHEN user_agent NOT IN ('', '-') AND NOT {browser} AND requests > 5 THEN 'UNKNOWN_UA'
      WHEN duration < 5 AND pages > 20 THEN 'BURST'
      WHEN pages > 30 AND night_pages / pages > 0.5 THEN 'NIGHT'
      WHEN {browser} AND requests < 50 AND duration > 30 THEN 'BROWSER_OK'
      WHEN requests <= 2000 AND requests >= 3 AND avg_gap > 0
        AND max_gap_us / 1e6 / avg_gap > 3 THEN 'VARIABLE_TIMING'
      WHEN requests <= 2000 AND paths >= 5 AND requests >= 5 THEN 'EXPLORING'
      WHEN requests <= 2000 AND requests - no_referer > requests * 0.5 AND requests >= 3
        THEN 'REFERER_CHAIN'
      ELSE 'DEFAULT' END"""


VERDICTS = """
verdicts(rule_code, heuristic_label, heuristic_confidence) AS (VALUES
  ('INTEGRATION', 'automated-integration', 0.90::DOUBLE), ('KNOWN_BOT_UA', 'bot', 0.95),
  ('SCANNER_PATH', 'bot', 0.95), ('UNIFORM_TIMING', 'bot', 0.90), ('HTTP10', 'bot', 0.90),
  ('CDN_BYPASS', 'bot', 0.90), ('PROTECTED_SCAN', 'bot', 0.90), ('ATTACK_TOOL', 'bot', 0.90),
  ('BOTNET', 'bot', 0.88), ('DIR_BRUTE', 'bot', 0.88), ('UA_ROTATION', 'bot', 0.88),
  ('TOR', 'bot', 0.85), ('ABUSE', 'bot', 0.90), ('FP_SHARED', 'bot', 0.90),
  ('FP_ABSENT', 'bot', 0.80), ('PAGES_100', 'bot', 0.85), ('RAW_VOLUME', 'bot', 0.90),
  ('SAME_ENDPOINT', 'bot', 0.80), ('HIGH_RATE', 'bot', 0.75), ('NO_REFERER', 'bot', 0.70),
  ('ERROR_RATE', 'bot', 0.70), ('REPEATED_PATH', 'bot', 0.70), ('CRED_PARAM', 'bot', 0.90),
  ('CRED_BRUTE', 'bot', 0.90), ('POST_BRUTE', 'bot', 0.90), ('UNKNOWN_UA', 'bot', 0.60),
  ('BURST', 'bot', 0.65), ('NIGHT', 'bot', 0.60), ('BROWSER_OK', 'human', 0.75),
  ('VARIABLE_TIMING', 'human', 0.70), ('EXPLORING', 'human', 0.65),
  ('REFERER_CHAIN', 'human', 0.60), ('DEFAULT', 'human', 0.50))"""

LABELLED = f"""
{VERDICTS},
coded AS (SELECT *, {chain_case()} AS rule_code FROM feats),
labelled AS (SELECT * FROM coded JOIN verdicts USING (rule_code))"""


def network_sql(columns=None, network=None, neutral=()) -> str:
    """The network as one SQL expression over the 19 feature columns."""
    net = network or load_network()
    columns = columns or FEATURES
    scaled = []
    for name, col, lo, hi in zip(FEATURES, columns, net.mins, net.maxs):
        if name in neutral or hi <= lo:
            scaled.append("0.5::DOUBLE")
        else:
            scaled.append(f"(({col} - {lo!r}::DOUBLE) / {hi - lo!r}::DOUBLE)")
    units = []
    for weights, bias in net.hidden_units():
        terms = " + ".join(f"{w!r}::DOUBLE * {x}" for w, x in zip(weights, scaled))
        units.append(f"greatest(0, {bias!r}::DOUBLE + {terms})")
    out_w, out_b = net.output_unit()
    logit = f"{out_b!r}::DOUBLE + " + " + ".join(
        f"{w!r}::DOUBLE * {u}" for w, u in zip(out_w, units)
    )
    return f"1 / (1 + exp(-greatest(-500, least(500, {logit}))))"


def blend_sql(label="heuristic_label", conf="heuristic_confidence", model="model_score") -> str:
    mixed = f"(0.6::DOUBLE * {model} + 0.4::DOUBLE * {conf})"
    return (
        f"CASE {label} WHEN 'bot' THEN greatest({mixed}, {conf}) "
        f"WHEN 'human' THEN least({mixed}, 1 - {conf}) ELSE {mixed} END"
    )


def risk_sql(score="score") -> str:
    return (
        f"CASE WHEN {score} <= 0.30 THEN 'SAFE' WHEN {score} <= 0.59 THEN 'LOW' "
        f"WHEN {score} <= 0.79 THEN 'WARNING' ELSE 'DANGER' END"
    )


def retained(keep: int) -> str:
    """``flag`` where every request is a session of its own: the last ``keep`` up to itself."""
    return f"""
{FLAG.replace("flag AS", "flag0 AS")},
flag AS (
  SELECT h.* EXCLUDE (session_no, gap_us), r.line_no AS session_no,
    CASE WHEN h.session_pos > r.session_pos - {keep - 1} THEN h.gap_us END AS gap_us
  FROM flag0 r JOIN flag0 h ON h.ip = r.ip AND h.session_no = r.session_no
    AND h.session_pos <= r.session_pos AND h.session_pos > r.session_pos - {keep})"""


# The live path takes the agent of the last request; it spares integrations and blocks above 0.85.
LIVE_INPUTS = INPUTS.replace("arg_min(user_agent, session_pos)", "arg_max(user_agent, session_pos)")


def over_retained(select: str, keep: int, timeout_s=1800, *ctes: str) -> str:
    sessions = sessions_cte(timeout_s=timeout_s)
    return with_ctes(select, REQ, sessions, retained(keep), CHAR_ENTROPY, LIVE_INPUTS, FEATS, *ctes)


SCORED = f"""
{LABELLED},
modelled AS (
  SELECT *, CASE WHEN heuristic_label = 'automated-integration' THEN 0
    ELSE {network_sql()} END AS model_score FROM labelled),
blended AS (
  SELECT *, CASE WHEN heuristic_label = 'automated-integration' THEN 0
    ELSE {blend_sql()} END AS score FROM modelled),
scored AS (
  SELECT *, CASE WHEN heuristic_label = 'automated-integration' THEN heuristic_label
    WHEN score >= 0.7 THEN 'bot' ELSE 'human' END AS label, {risk_sql()} AS risk
  FROM blended)"""


LIVE = f"""
{LABELLED},
modelled AS (
  SELECT *, CASE WHEN heuristic_label = 'automated-integration' THEN 0
    ELSE {network_sql()} END AS model_score FROM labelled),
blended AS (
  SELECT *, CASE WHEN heuristic_label = 'automated-integration' THEN 0
    ELSE {blend_sql()} END AS score FROM modelled),
live AS (
  SELECT ip, session_no AS line_no, requests, rule_code, heuristic_label, round(model_score, 6) AS model_score,
    round(score, 6) AS score, CASE WHEN heuristic_label <> 'automated-integration' AND score > 0.85
      THEN 'bot' ELSE 'human' END AS label FROM blended),
decided AS (SELECT *, label = 'bot' AS blocked FROM live)"""

# Tailing knows no label of its own for integrations.
TAILED = f"""
{LABELLED},
modelled AS (SELECT *, {network_sql()} AS model_score FROM labelled),
tailed AS (SELECT *, {blend_sql()} AS score FROM modelled)"""


def with_ctes(select: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


def over_requests(select: str, *ctes: str) -> str:
    return with_ctes(select, REQ, *ctes)


def over_sessions(select: str, *ctes: str) -> str:
    return with_ctes(select, REQ, SES, *ctes)


def over_features(select: str, *ctes: str) -> str:
    return with_ctes(select, REQ, SES, FLAG, CHAR_ENTROPY, INPUTS, FEATS, *ctes)


def over_labelled(select: str, *ctes: str) -> str:
    return over_features(select, LABELLED, *ctes)


def over_scored(select: str, *ctes: str) -> str:
    return over_features(select, SCORED, *ctes)
