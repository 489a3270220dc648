"""Registered queries: reputation, address blocks, fingerprints, crawler labelling."""

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.address import block_prefix
from ..operators import crawlers as C
from ..operators import fingerprints as FP
from ..operators import rules as R
from ..operators import signals as G
from ..operators.evaluation import explain_actors
from ..operators.features import session_inputs
from ..sources import derived as D
from ..sources import feeds
from ..sources.adapters import requests_of
from . import oracle_base as B
from .registry import Registry, rounded

signals = Registry()
NOW_US = 1_706_000_000_000_000


def now():
    return F.timestamp_micros(F.lit(NOW_US))


ABUSE_SQL = f"""
cache AS (
  SELECT DISTINCT ip, ((user_id * 37) % 101)::DOUBLE AS score,
    {NOW_US} - CASE WHEN user_id % 2 = 0 THEN 90000000000 ELSE user_id * 1000000 END AS ts
  FROM req WHERE user_id % 3 <> 0),
fresh AS (SELECT ip, score AS abuse_score FROM cache WHERE {NOW_US} - ts < 86400000000)"""

REPUTATION_SQL = """
reputation AS (
  SELECT u.ip, u.user_id, u.user_id % 17 = 0 AS tor_exit, h.ip IS NOT NULL AS hosting_range,
    f.abuse_score
  FROM (SELECT DISTINCT ip, user_id FROM req) u LEFT JOIN hosted h USING (ip)
  LEFT JOIN fresh f USING (ip))"""


def reputation_of(spark, sf):
    addresses = G.actor_addresses(requests_of(spark, sf))
    return G.reputation(
        addresses,
        D.tor_exits(spark, sf),
        feeds.cidr_table(D.hosting_blocks(spark, sf)),
        G.fresh_abuse_scores(D.abuse_cache(spark, sf), now()),
    )


@signals.query(
    "addresses_in_blocks", B.over_requests("SELECT ip FROM hosted", D.HOSTING_SQL), "J7"
)
def _(spark, sf):
    blocks = feeds.cidr_table(D.hosting_blocks(spark, sf))
    return G.in_blocks(G.actor_addresses(requests_of(spark, sf)), blocks).distinct()


@signals.query(
    "abuse_scores", B.over_requests("SELECT ip, abuse_score FROM fresh", ABUSE_SQL), "J8"
)
def _(spark, sf):
    return G.fresh_abuse_scores(D.abuse_cache(spark, sf), now())


@signals.query(
    "abuse_lookup_plan",
    B.over_requests(
        """SELECT ip, CAST(day AS VARCHAR) AS day, place FROM (
        SELECT ip, CAST(make_timestamp(first_us) AS DATE) AS day,
          row_number() OVER (PARTITION BY CAST(make_timestamp(first_us) AS DATE)
            ORDER BY first_us, ip) AS place
        FROM (SELECT ip, min(ts_us) AS first_us FROM req GROUP BY ip)
        WHERE ip NOT IN (SELECT ip FROM fresh)) WHERE place <= 25""",
        ABUSE_SQL,
    ),
    "J9",
)
def _(spark, sf):
    seen = requests_of(spark, sf).groupBy("ip").agg(F.min("ts").alias("first_seen"))
    plan = G.lookup_plan(seen, D.abuse_cache(spark, sf), now(), quota=25)
    return plan.select("ip", F.col("day").cast("string").alias("day"), F.col("place").cast("long").alias("place"))


@signals.query(
    "reputation",
    B.over_requests(
        "SELECT ip, true AS resolved, tor_exit, hosting_range, abuse_score FROM reputation",
        D.HOSTING_SQL, ABUSE_SQL, REPUTATION_SQL,
    ),
    "J6 J7 J8",
)
def _(spark, sf):
    return reputation_of(spark, sf)


@signals.query(
    "feed_health",
    B.over_requests(
        """SELECT 'tor' AS source, count(*) > 0 AS ok, count(*) AS entries, 60.0::DOUBLE AS age_s
        FROM (SELECT DISTINCT ip FROM req WHERE user_id % 17 = 0)
        UNION ALL SELECT 'abuse', count(*) > 0, count(*), 60.0::DOUBLE FROM cache""",
        ABUSE_SQL,
    ),
    "E35",
)
def _(spark, sf):
    fetched = F.timestamp_micros(F.lit(NOW_US - 60_000_000))
    return G.feed_health(
        {"tor": (D.tor_exits(spark, sf), fetched), "abuse": (D.abuse_cache(spark, sf), fetched)}, now()
    )


BIND_SQL = """
checked AS (
  SELECT s.*, CASE WHEN NOT regexp_full_match(hash, '[0-9a-fA-F]{64}') THEN 'BAD_HASH'
    WHEN coalesce(s.ts_us - (SELECT max(r.ts_us) FROM req r
      WHERE r.ip = s.ip AND r.ts_us <= s.ts_us), 1e15) > 1800000000 THEN 'NO_SESSION' END AS reject
  FROM subs s),
valid AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_us, seq) AS rn
          FROM checked WHERE reject IS NULL),
walk AS (
  SELECT ip, hash, ts_us, seq, rn, hash AS held, ts_us AS since, 'ACCEPTED' AS outcome
  FROM valid WHERE rn = 1
  UNION ALL
  SELECT v.ip, v.hash, v.ts_us, v.seq, v.rn,
    CASE WHEN v.ts_us - w.since > 1800000000 THEN v.hash ELSE w.held END,
    CASE WHEN v.ts_us - w.since > 1800000000 THEN v.ts_us ELSE w.since END,
    CASE WHEN v.ts_us - w.since > 1800000000 THEN 'ACCEPTED'
         WHEN v.hash = w.held THEN 'REPEAT' ELSE 'ALREADY_BOUND' END
  FROM walk w JOIN valid v ON v.ip = w.ip AND v.rn = w.rn + 1),
acc AS (SELECT * FROM walk WHERE outcome = 'ACCEPTED'),
acc_gap AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY hash ORDER BY ts_us, seq) AS g FROM acc),
acc_win AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 600000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY hash ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS win FROM acc_gap),
acc_first AS (SELECT *, row_number() OVER (PARTITION BY hash, win, ip ORDER BY ts_us, seq) = 1 AS f
  FROM acc_win),
shared AS (SELECT ip, hash, ts_us, seq, sum(f::INT)
  OVER (PARTITION BY hash, win ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS shared_ips
  FROM acc_first)"""


def bind_query(select, *extra):
    return "WITH RECURSIVE " + ",".join([B.REQ, D.SUBMISSIONS_SQL, BIND_SQL, *extra]) + "\n" + select


def bound(spark, sf):
    return FP.bind(D.submissions(spark, sf), requests_of(spark, sf))


@signals.query(
    "fingerprint_outcomes",
    bind_query(
        """SELECT ip, hash, ts_us, seq, outcome FROM walk
        UNION ALL SELECT ip, hash, ts_us, seq, reject FROM checked WHERE reject IS NOT NULL"""
    ),
    "C14 B28",
)
def _(spark, sf):
    return bound(spark, sf)


#: One client in sixteen shares one busy address.
_BUSY_REQ = B.REQ.replace(
    "'10.' || (user_id // 256) || '.' || (user_id % 256) || '.7' AS ip",
    "CASE WHEN user_id % 16 = 0 THEN 'busy' ELSE '10.' || (user_id // 256) || '.' || (user_id % 256) || '.7' END AS ip",
)


@signals.query(
    "fingerprint_outcomes_by_leaps",
    "WITH RECURSIVE " + ",".join([_BUSY_REQ, D.SUBMISSIONS_SQL, BIND_SQL])
    + """
    SELECT ip, hash, ts_us, seq, outcome FROM walk
    UNION ALL SELECT ip, hash, ts_us, seq, reject FROM checked WHERE reject IS NOT NULL""",
    "C14, a busy address",
)
def _(spark, sf):
    busy = F.when(F.col("user_id") % 16 == 0, "busy").otherwise(F.col("ip"))
    requests = requests_of(spark, sf).withColumn("ip", busy)
    return FP.bind(D.submissions_of(requests), requests)


def shared_of(spark, sf):
    return FP.shared_ip_counts(bound(spark, sf).filter(F.col("outcome") == "ACCEPTED"))


@signals.query(
    "shared_fingerprints", bind_query("SELECT ip, hash, ts_us, seq, shared_ips FROM shared"), "C13"
)
def _(spark, sf):
    return shared_of(spark, sf)


@signals.query(
    "actor_registry",
    bind_query(
        """SELECT hash, min(ts_us) AS first_seen, max(ts_us) AS last_seen, count(*) AS sightings,
        arg_max(shared_ips, ts_us) AS distinct_ips FROM shared GROUP BY hash
        ORDER BY last_seen DESC, hash LIMIT 10000"""
    ),
    "C15",
)
def _(spark, sf):
    return FP.actor_registry(shared_of(spark, sf), NOW_US)


SIGNAL_CTES = [D.HOSTING_SQL, ABUSE_SQL, REPUTATION_SQL, """
bindings AS (SELECT ip, arg_max(hash, ts_us) AS fingerprint_hash,
  arg_max(shared_ips, ts_us) AS shared_hash_ips FROM shared GROUP BY ip)"""]  # fmt: skip


def all_signals(spark, sf):
    return G.with_fingerprints(reputation_of(spark, sf), FP.current_bindings(shared_of(spark, sf)))


@signals.query(
    "actor_signals",
    bind_query(
        """SELECT ip, true AS resolved, tor_exit, hosting_range, abuse_score, true AS fp_resolved,
        fingerprint_hash, coalesce(shared_hash_ips, 0) AS shared_hash_ips
        FROM reputation LEFT JOIN bindings USING (ip)""",
        *SIGNAL_CTES,
    ),
    "J10",
)
def _(spark, sf):
    return all_signals(spark, sf)


def enriched(spark, sf):
    inputs = session_inputs(requests_of(spark, sf))
    promoted = F.array(*[F.lit(s) for s in P.SIGNAL_SOURCES])
    return R.with_verdict(G.enrich(inputs, all_signals(spark, sf), promoted), signals=True)


SIGNAL_LABELS = [*SIGNAL_CTES, B.SES, B.FLAG, B.CHAR_ENTROPY, B.INPUTS, f"""
sig AS (SELECT i.*, r.tor_exit, r.hosting_range, r.abuse_score, b.fingerprint_hash,
    coalesce(b.shared_hash_ips, 0) AS shared_hash_ips, true AS tor_promoted,
    true AS abuse_promoted, true AS fp_promoted
  FROM inputs i JOIN reputation r USING (ip) LEFT JOIN bindings b USING (ip)),
{B.VERDICTS},
sig_coded AS (SELECT *, {B.chain_case(signals=True)} AS rule_code FROM sig)"""]  # fmt: skip


@signals.query(
    "session_rules_with_signals",
    bind_query(
        """SELECT ip, session_no::BIGINT AS session_no, rule_code, heuristic_label,
        heuristic_confidence FROM sig_coded JOIN verdicts USING (rule_code)""",
        *SIGNAL_LABELS,
    ),
    "rules 9a-10b, B39, S5",
)
def _(spark, sf):
    return enriched(spark, sf).select(
        "ip", "session_no", "rule_code", "heuristic_label", "heuristic_confidence"
    )


@signals.query(
    "actor_explanations",
    bind_query(
        f"""SELECT ip, requests, round(duration, 6) AS duration, user_agent, rule_code,
        heuristic_label, round({B.blend_sql(model="0")}, 6) AS rule_only_score,
        tor_exit, hosting_range, abuse_score, fingerprint_hash, 'enforced' AS tor_state,
        'observe-only' AS hosting_state, last_urls
        FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY session_no DESC) AS back
              FROM sig_coded JOIN verdicts USING (rule_code))
        JOIN (SELECT ip, string_agg(url, ' ' ORDER BY ts_us, line_no) AS last_urls FROM (
          SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_us DESC, line_no DESC) AS k
          FROM req) WHERE k <= 3 GROUP BY ip) USING (ip) WHERE back = 1""",
        *SIGNAL_LABELS,
    ),
    "E36",
)
def _(spark, sf):
    rows = explain_actors(enriched(spark, sf), requests_of(spark, sf))
    shown = rows.select(
        "ip", "requests", "duration", "user_agent", "rule_code", "heuristic_label",
        "rule_only_score", "tor_exit", "hosting_range", "abuse_score", "fingerprint_hash",
        "tor_state", "hosting_state", F.array_join("last_urls", " ").alias("last_urls"),
    )
    return rounded(shown, "duration", "rule_only_score")


# --- crawlers ---------------------------------------------------------------------------------

# Agents that claim engines, spread over the users; some claims come from listed addresses.
CLAIM_SQL = """
creq AS (
  SELECT * REPLACE (CASE user_id % 16 WHEN 1 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)'
      WHEN 9 THEN 'Mozilla/5.0 (compatible; bingbot/2.0)' WHEN 3 THEN 'YandexBot/3.0'
      ELSE user_agent END AS user_agent) FROM req),
engines AS (
  SELECT DISTINCT ip, user_id, CASE WHEN user_id % 5 = 1 THEN 'google' WHEN user_id % 5 = 2 THEN 'bing'
    WHEN user_id % 7 = 3 AND user_id % 14 <> 3 THEN 'yandex' END AS engine FROM req)"""


def claiming(spark, sf):
    uid = F.col("user_id")
    agent = (
        F.when(uid % 16 == 1, "Mozilla/5.0 (compatible; Googlebot/2.1)")
        .when(uid % 16 == 9, "Mozilla/5.0 (compatible; bingbot/2.0)")
        .when(uid % 16 == 3, "YandexBot/3.0")
        .otherwise(F.col("user_agent"))
    )
    return requests_of(spark, sf).withColumn("user_agent", agent)


def engines_of(spark, sf):
    uid = F.col("user_id")
    people = D.users(spark, sf)
    ranges = people.filter((uid % 5).isin(1, 2)).select(
        F.when(uid % 5 == 1, 0).otherwise(1).alias("position"),
        F.when(uid % 5 == 1, "google").otherwise("bing").alias("engine"),
        F.concat(F.substring_index("ip", ".", 3), F.lit(".0/24")).alias("cidr"),
    )
    spider = F.concat(F.lit("spider-"), uid.cast("string"), F.lit(".yandex.ru"))
    name = F.when(uid % 7 == 3, spider).otherwise("pc.example.org").alias("hostname")
    first = people.select("ip", name, F.array("ip").alias("addresses"), F.lit(0).alias("place"))
    # a later lookup of some spiders leads back to another address, and counts
    later = people.filter(uid % 14 == 3).select(
        "ip", F.concat(F.lit("a"), spider).alias("hostname"), F.array(F.lit("10.9.9.9")).alias("addresses"), F.lit(1).alias("place")
    )
    dns = later.unionByName(first)
    ranges = ranges.withColumn("prefix", block_prefix(F.col("cidr")))
    return C.verified_engines(people.select("ip"), ranges, dns)


@signals.query(
    "verified_crawlers",
    B.over_requests("SELECT ip, engine FROM engines WHERE engine IS NOT NULL", CLAIM_SQL),
    "J11 J7",
)
def _(spark, sf):
    return engines_of(spark, sf)


def actor_labels(spark, sf):
    return C.label_actors(C.evidence(claiming(spark, sf)), engines_of(spark, sf))


EVIDENCE_SQL = f"""
{CLAIM_SQL},
ev AS (
  SELECT local_date AS day, ip, count(*) AS requests,
    bool_or({B.prefixed("path", P.PROBE_PREFIXES)}) AS probe,
    bool_or({B.prefixed("path", P.HUMAN_ACTION_PREFIXES)}) AS human_action,
    bool_or({B.prefixed("path", P.ASSET_PREFIXES)} OR {B.hit("path", P.ASSET_SUFFIX_PATTERN)}) AS asset,
    bool_or(starts_with(path, '{P.STAFF_PREFIX}')) AS staff,
    bool_and(starts_with(user_agent, 'Mozilla/') AND NOT {B.hit("user_agent", P.CRAWLER_TOKEN_PATTERN)})
      AS browser_like,
    list_distinct(list(CASE WHEN {B.hit("user_agent", "googlebot")} THEN 'google'
      WHEN {B.hit("user_agent", "bingbot|msnbot")} THEN 'bing'
      WHEN {B.hit("user_agent", "yandex")} THEN 'yandex' END)) AS claims
  FROM creq GROUP BY ALL),
lab AS (
  SELECT ev.*, engine, CASE WHEN len(claims) > 0 THEN CASE WHEN coalesce(list_contains(claims, engine), false)
      THEN 'verified_crawler' ELSE 'unverified_crawler' END WHEN probe THEN 'probe_bot' END AS bot,
    CASE WHEN browser_like AND human_action AND asset THEN CASE WHEN staff THEN 'staff'
      ELSE 'human_proxy' END END AS human
  FROM ev JOIN engines USING (ip)),
labels2 AS (SELECT *, CASE WHEN bot IS NOT NULL AND human IS NOT NULL THEN 'conflict'
  ELSE coalesce(bot, human, 'unlabeled') END AS label FROM lab)"""


@signals.query(
    "actor_evidence",
    B.over_requests(
        """SELECT CAST(day AS VARCHAR) AS day, ip, requests, probe, human_action, asset, staff,
        browser_like FROM ev""",
        EVIDENCE_SQL,
    ),
    "E11",
)
def _(spark, sf):
    rows = C.evidence(claiming(spark, sf))
    return rows.select(
        F.col("day").cast("string").alias("day"), "ip", "requests", "probe", "human_action", "asset",
        "staff", "browser_like",
    )


@signals.query(
    "actor_labels",
    B.over_requests(
        """SELECT CAST(day AS VARCHAR) AS day, ip, label, requests, list_aggregate(claims, 'string_agg', ',')
        AS claimed, CASE WHEN len(claims) > 0 THEN engine END AS verified, probe FROM labels2""",
        EVIDENCE_SQL,
    ),
    "E12",
)
def _(spark, sf):
    return actor_labels(spark, sf).select(
        F.col("day").cast("string").alias("day"), "ip", "label", "requests",
        F.when(F.size("claimed") > 0, F.array_join("claimed", ",")).alias("claimed"), "verified", "probe",
    )


@signals.query(
    "label_counts",
    B.over_requests(
        "SELECT CAST(day AS VARCHAR) AS day, label, count(*) AS actors FROM labels2 GROUP BY ALL",
        EVIDENCE_SQL,
    ),
    "E13",
)
def _(spark, sf):
    counts = C.label_counts(actor_labels(spark, sf))
    return counts.withColumn("day", F.col("day").cast("string"))


@signals.query(
    "actor_pools",
    B.over_requests(
        """SELECT kind, count(*) AS actors FROM (SELECT DISTINCT day, ip,
        CASE WHEN label IN ('verified_crawler', 'unverified_crawler') THEN 'crawler'
          WHEN label IN ('human_proxy', 'staff') THEN 'human' END AS kind FROM labels2)
        WHERE kind IS NOT NULL GROUP BY kind""",
        EVIDENCE_SQL,
    ),
    "U4",
)
def _(spark, sf):
    labels = actor_labels(spark, sf)
    parts = [C.pool(labels, k).withColumn("kind", F.lit(k)) for k in ("crawler", "human")]
    return parts[0].unionByName(parts[1]).groupBy("kind").agg(F.count("*").alias("actors"))


@signals.query(
    "request_stats",
    B.over_requests(
        """SELECT count(*) AS actors, max(requests) AS max_requests,
        max(CASE WHEN rn = n // 2 THEN requests END) AS median,
        max(CASE WHEN rn = CAST(floor(n * 0.9::DOUBLE) AS BIGINT) THEN requests END) AS p90
        FROM (SELECT requests, row_number() OVER (ORDER BY requests) - 1 AS rn,
          count(*) OVER () AS n FROM labels2 WHERE label = 'unlabeled')""",
        EVIDENCE_SQL,
    ),
    "E14",
)
def _(spark, sf):
    return C.request_stats(actor_labels(spark, sf), of="unlabeled")


GAPS_SQL = """
referred AS (SELECT DISTINCT local_date, ip,
  regexp_extract(referer, '^https?://(?:www[.])?shop[.]example(/[^ ]*)$', 1) AS url FROM req),
views AS (SELECT r.local_date, r.ip, r.ts_us FROM req r SEMI JOIN referred USING (local_date, ip, url)
  WHERE r.method = 'GET' AND r.status = 200),
gaps AS (SELECT gap_s FROM (SELECT (ts_us - lag(ts_us) OVER (PARTITION BY local_date, ip ORDER BY ts_us))
  / 1e6 AS gap_s FROM views) WHERE gap_s > 0 AND gap_s <= 1800)"""


@signals.query(
    "page_view_gaps",
    B.over_requests("SELECT round(gap_s, 6) AS gap_s, count(*) AS n FROM gaps GROUP BY 1", GAPS_SQL),
    "C10 J14",
)
def _(spark, sf):
    gaps = C.view_gaps(C.page_views(requests_of(spark, sf), "shop.example"))
    return rounded(gaps, "gap_s").groupBy("gap_s").agg(F.count("*").alias("n"))


@signals.query(
    "gap_quantiles",
    B.over_requests(
        """SELECT q::INT AS permille, round(gap_s, 6) AS gap_s FROM (SELECT unnest(range(0, 1001)) AS q)
        JOIN (SELECT gap_s, row_number() OVER (ORDER BY gap_s) - 1 AS rn, count(*) OVER () AS n FROM gaps)
        ON rn = round_even(q / 1000 * (n - 1), 0)""",
        GAPS_SQL,
    ),
    "C10",
)
def _(spark, sf):
    gaps = C.view_gaps(C.page_views(requests_of(spark, sf), "shop.example"))
    return rounded(C.permille_quantiles(gaps, "gap_s"), "gap_s")
