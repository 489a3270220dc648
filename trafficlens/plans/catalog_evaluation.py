"""Registered queries: live evaluation, detectors, statistics, dashboard counters."""

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scoring as S
from ..operators import detectors as T
from ..operators import evaluation as V
from ..operators import metrics as M
from ..operators import reports as RP
from ..schema import FEATURES
from ..sources import derived as D
from ..sources.adapters import requests_of
from . import oracle_base as B
from .registry import Registry, rounded
from .scan import scan_sessions, scan_summary

evaluation = Registry()
DEC = D.DECISIONS_SQL
PATHS = ["/account/new", "/basket/checkout"]

ACTORS_SQL = f"""
{DEC},
eurl AS (SELECT *, CASE WHEN line_no % 90 = 0 THEN '/_hp/trap' WHEN user_id % 6 = 4 AND line_no % 20 = 0
    THEN '/?x=1&ref=tok%20a' WHEN user_id % 6 = 4 AND line_no % 20 = 1 THEN '/traffic/fp' ELSE url END AS u,
    CASE WHEN user_id % 6 = 4 AND line_no % 20 = 1 THEN 'POST' ELSE method END AS m FROM req),
seen AS (SELECT ip, count(*) AS requests, bool_or(starts_with(u, '/_hp/')) AS hit_honeypot,
    bool_or({B.prefixed("split_part(u, '?', 1)", P.PROBE_PREFIXES)}) AS hit_probe,
    bool_or(contains(u, 'ref=tok%20a')) AS invited,
    bool_or(m = 'POST' AND split_part(u, '?', 1) = '/traffic/fp' AND status = 200) AS ran_fingerprint
  FROM eurl WHERE user_id % 9 <> 8 GROUP BY ip),
judged AS (SELECT ip, max(score) AS max_score, max(model_score) AS max_model_score,
    bool_or(heuristic_label = 'bot') AS heuristic_bot,
    list_sort(list_distinct(list(trim(regexp_extract(heuristic_reason, '^[^(:]*'))))) AS reasons
  FROM dec WHERE user_id % 10 <> 7 GROUP BY ip),
actors AS (SELECT *, CASE WHEN (hit_honeypot OR hit_probe) AND invited AND ran_fingerprint THEN 'conflict'
    WHEN hit_honeypot OR hit_probe THEN 'bot' WHEN invited AND ran_fingerprint THEN 'human'
    ELSE 'unlabeled' END AS truth FROM (
  SELECT ip, coalesce(requests, 0) AS requests, coalesce(hit_honeypot, false) AS hit_honeypot,
    coalesce(hit_probe, false) AS hit_probe, coalesce(invited, false) AS invited,
    coalesce(ran_fingerprint, false) AS ran_fingerprint,
    coalesce(heuristic_bot, false) AS heuristic_bot, max_score, max_model_score,
    coalesce(reasons, []) AS reasons
  FROM seen FULL JOIN judged USING (ip))),
sa AS (SELECT * FROM actors WHERE max_score IS NOT NULL)"""
#: The same with every client seen and judged; the one above leaves some out, to show what is missing.
ALL_ACTORS_SQL = ACTORS_SQL.replace("WHERE user_id % 9 <> 8", "").replace("WHERE user_id % 10 <> 7", "")


def visited(spark, sf):
    """Requests with honeypot, invite and fingerprint visits written over some urls."""
    uid, eid = F.col("user_id"), F.col("line_no")
    guest = uid % 6 == 4
    return (
        requests_of(spark, sf)
        .withColumn("method", F.when(guest & (eid % 20 == 1), "POST").otherwise(F.col("method")))
        .withColumn(
            "url",
            F.when(eid % 90 == 0, "/_hp/trap")
            .when(guest & (eid % 20 == 0), "/?x=1&ref=tok%20a")
            .when(guest & (eid % 20 == 1), "/traffic/fp")
            .otherwise(F.col("url")),
        )
    )


def judged_of(spark, sf, holes=False):
    """Verdicts per client; with ``holes`` one client in ten was never judged."""
    return V.verdicts(D.decisions(spark, sf).filter("user_id % 10 <> 7" if holes else "true"))


def actors_of(spark, sf, holes=False):
    """Clients with evidence and verdicts; with ``holes`` one in nine was never seen either."""
    seen = V.evidence(visited(spark, sf).filter("user_id % 9 <> 8" if holes else "true"), ["tok a", "other"])
    return V.actors(seen, judged_of(spark, sf, holes))


@evaluation.query(
    "live_actors",
    B.over_requests(
        """SELECT ip, requests, hit_honeypot, hit_probe, invited, ran_fingerprint, heuristic_bot,
        round(max_score, 6) AS max_score, round(max_model_score, 6) AS max_model_score,
        list_aggregate(reasons, 'string_agg', ',') AS reasons, truth FROM actors""",
        ACTORS_SQL,
    ),
    "E5 E6 E7 J1",
)
def _(spark, sf):
    joined = F.when(F.size("reasons") > 0, F.array_join("reasons", ","))
    rows = actors_of(spark, sf, holes=True).withColumn("reasons", joined)
    return rounded(rows, "max_score", "max_model_score")


@evaluation.query(
    "live_coverage",
    B.over_requests(
        """SELECT count_if(truth = 'bot')::BIGINT AS bots, count_if(truth = 'human')::BIGINT AS humans,
        count_if(truth = 'conflict')::BIGINT AS conflicts,
        count_if(truth = 'unlabeled')::BIGINT AS unlabeled, count_if(invited)::BIGINT AS invited,
        count_if(invited AND ran_fingerprint)::BIGINT AS invited_ran,
        count_if(truth = 'bot') < 30 OR count_if(truth = 'human') < 30 AS inconclusive FROM sa""",
        ALL_ACTORS_SQL,
    ),
    "E10",
)
def _(spark, sf):
    return V.coverage(actors_of(spark, sf))


SWEEP_RULES = (
    [("heuristic label is bot", "heuristic_bot")]
    + [(f"score > {t:.2f}", f"max_score > {t}") for t in P.EVALUATION_THRESHOLDS]
    + [(f"model score > {t:.2f}", f"max_model_score > {t}") for t in P.EVALUATION_THRESHOLDS]
)
SWEEP_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS flag_rule,
    count_if(truth = 'bot' AND {cond})::BIGINT AS bots_flagged, count_if(truth = 'bot')::BIGINT AS bots_total,
    count_if(truth = 'bot' AND NOT hit_probe AND {cond})::BIGINT AS honeypot_bots_flagged,
    count_if(truth = 'bot' AND NOT hit_probe)::BIGINT AS honeypot_bots_total,
    count_if(truth = 'human' AND {cond})::BIGINT AS humans_flagged,
    count_if(truth = 'human')::BIGINT AS humans_total FROM sa"""
    for name, cond in SWEEP_RULES
)


@evaluation.query("threshold_sweep", B.over_requests(SWEEP_SQL, ALL_ACTORS_SQL), "E8")
def _(spark, sf):
    return V.threshold_sweep(actors_of(spark, sf))


@evaluation.query(
    "reasons_by_truth",
    B.over_requests(
        """SELECT reason, count_if(truth = 'bot')::BIGINT AS bot, count_if(truth = 'human')::BIGINT AS human,
        count_if(truth = 'conflict')::BIGINT AS conflict, count_if(truth = 'unlabeled')::BIGINT AS unlabeled,
        count(*) AS total FROM (SELECT truth, unnest(reasons) AS reason FROM sa) GROUP BY reason""",
        ALL_ACTORS_SQL,
    ),
    "E9",
)
def _(spark, sf):
    return V.reasons_by_truth(actors_of(spark, sf))


@evaluation.query(
    "grey_actors",
    B.over_requests(
        """SELECT regexp_replace(ip, '[.][0-9]+$', '.x') AS ip, round(max_score, 6) AS max_score, requests
        FROM (SELECT * FROM sa WHERE truth = 'unlabeled' AND max_score > 0.85
              ORDER BY max_score DESC, ip LIMIT 20)""",
        ALL_ACTORS_SQL,
    ),
    "C18 B26",
)
def _(spark, sf):
    return rounded(V.grey_actors(actors_of(spark, sf), redact=True), "max_score")


CARD_RULES = (
    [("heuristic", "NULL", "heuristic_bot")]
    + [("model", t, f"max_model_score > {t}") for t in P.EVALUATION_THRESHOLDS]
    + [("blend", t, f"max_score > {t}") for t in P.EVALUATION_THRESHOLDS]
)
CARD_SQL = "card0 AS (" + " UNION ALL ".join(
    f"""SELECT '{d}' AS detector, {t}::DOUBLE AS threshold, count_if(is_bot AND {c})::BIGINT AS tp,
    count_if(NOT is_bot AND {c})::BIGINT AS fp, count_if(is_bot)::BIGINT AS bots,
    count_if(NOT is_bot)::BIGINT AS humans FROM judged JOIN truth USING (ip)"""
    for d, t, c in CARD_RULES
) + """),
card AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, tp / bots AS recall, fp / humans AS fpr
  FROM card0))"""


@evaluation.query(
    "lab_scorecard",
    B.over_requests(
        """SELECT detector, threshold, tp, fp, bots, humans, round(precision, 6) AS precision,
        round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr FROM card""",
        ALL_ACTORS_SQL, D.TRUTH_SQL, CARD_SQL,
    ),
    "E28",
)
def _(spark, sf):
    card = V.scorecard(judged_of(spark, sf), D.truth(spark, sf).select("ip", "is_bot"))
    return rounded(card, "precision", "recall", "f1", "fpr")


@evaluation.query(
    "safe_thresholds",
    B.over_requests(
        """SELECT detector, min(threshold) AS threshold, arg_min(tp, threshold) AS bots_caught,
        max(bots) AS bots FROM card WHERE threshold IS NOT NULL AND fp <= 0 GROUP BY detector""",
        ALL_ACTORS_SQL, D.TRUTH_SQL, CARD_SQL,
    ),
    "E27",
)
def _(spark, sf):
    return V.safe_thresholds(
        V.scorecard(judged_of(spark, sf), D.truth(spark, sf).select("ip", "is_bot"))
    )


@evaluation.query(
    "unscored_actors",
    B.over_requests(
        "SELECT ip FROM truth WHERE ip NOT IN (SELECT ip FROM judged)", ACTORS_SQL, D.TRUTH_SQL
    ),
    "J17",
)
def _(spark, sf):
    return V.unscored(judged_of(spark, sf, holes=True), D.truth(spark, sf))


# --- dashboard counters -------------------------------------------------------------------


@evaluation.query(
    "decision_stats",
    B.over_requests(
        """SELECT count(*) AS total, count_if(label = 'bot')::BIGINT AS blocked,
        count_if(label <> 'bot')::BIGINT AS allowed,
        round(count_if(label = 'bot') / count(*), 6) AS bot_rate, round(avg(score), 6) AS avg_score
        FROM dec""",
        DEC,
    ),
    "E3",
)
def _(spark, sf):
    return rounded(RP.decision_stats(D.decisions(spark, sf)), "bot_rate", "avg_score")


@evaluation.query(
    "decision_histogram",
    B.over_requests(
        """SELECT least(floor(score * 20), 19)::INT AS bucket, count(*) AS n FROM dec GROUP BY 1""", DEC
    ),
    "B24 E3",
)
def _(spark, sf):
    return M.score_histogram(D.decisions(spark, sf))


@evaluation.query(
    "top_blocked_ips",
    B.over_requests(
        """SELECT ip, count(*) AS blocked FROM dec WHERE label = 'bot' GROUP BY ip
        ORDER BY blocked DESC, ip LIMIT 10""",
        DEC,
    ),
    "E3 E4",
)
def _(spark, sf):
    return RP.top_blocked(D.decisions(spark, sf), 10)


@evaluation.query(
    "busiest_blocked",
    B.over_requests(
        """SELECT ip, count(*) AS blocked, 0::BIGINT AS error FROM dec WHERE label = 'bot' GROUP BY ip
        ORDER BY blocked DESC, ip LIMIT 1000""",
        DEC,
    ),
    "E4",
)
def _(spark, sf):
    return RP.busiest_blocked(D.decisions(spark, sf))


@evaluation.query(
    "busiest_urls",
    B.over_requests(
        """SELECT url AS key, count(*) AS count, 0::BIGINT AS error FROM req GROUP BY url
        ORDER BY count DESC, key LIMIT 30"""
    ),
    "E4, more values than counters",
)
def _(spark, sf):
    return RP.busiest(requests_of(spark, sf), "url", 30, 120)


@evaluation.query(
    "recent_decisions",
    B.over_requests(
        """SELECT decision_id, ip, round(score, 6) AS score FROM dec
        ORDER BY ts_us DESC, line_no DESC LIMIT 1000""",
        DEC,
    ),
    "C17 S8",
)
def _(spark, sf):
    rows = RP.recent(D.decisions(spark, sf), 1000).select("decision_id", "ip", "score")
    return rounded(rows, "score")


@evaluation.query(
    "top_sessions",
    B.over_scored(
        """SELECT ip, session_no::BIGINT AS session_no, round(score, 6) AS score, risk FROM scored
        ORDER BY round(score, 6) DESC, ip, session_no LIMIT 10"""
    ),
    "C18",
)
def _(spark, sf):
    rows = rounded(scan_sessions(requests_of(spark, sf), S.load_network()), "score")
    return RP.top_sessions(rows, 10).select("ip", "session_no", "score", "risk")


@evaluation.query(
    "traffic_status",
    B.over_scored(
        """SELECT round(r, 6) AS bot_rate, CASE WHEN r < 0.1 THEN 'HEALTHY' WHEN r < 0.3 THEN 'WARNING'
        ELSE 'CRITICAL' END AS status, r > 0.1 AS audit_failed
        FROM (SELECT count_if(label = 'bot') / count(*) AS r FROM scored)"""
    ),
    "B23",
)
def _(spark, sf):
    summary = scan_summary(scan_sessions(requests_of(spark, sf), S.load_network()))
    return rounded(RP.status(summary), "bot_rate")


# --- detectors ------------------------------------------------------------------------------

VERDICT_SQL = f"""
{DEC},
rpos AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_us, line_no) AS pos FROM req),
dpos AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_us, line_no) AS pos FROM dec),
verdict AS (
  SELECT ip, 'ua_regex' AS detector, min(CASE WHEN trim(user_agent) IN ('', '-')
    OR {B.hit("user_agent", P.BASELINE_AGENT_PATTERN)} THEN pos END) AS first_flag, NULL::DOUBLE AS score
  FROM rpos GROUP BY ip
  UNION ALL
  SELECT ip, 'path_blocklist', min(CASE WHEN {B.prefixed("lower(path)", P.PROBE_PREFIXES)} THEN pos END), NULL
  FROM rpos GROUP BY ip
  UNION ALL
  SELECT ip, 'rate_limit', min(CASE WHEN ts_us - back < 60000000 THEN pos END), NULL
  FROM (SELECT *, lag(ts_us, 60) OVER (PARTITION BY ip ORDER BY ts_us, line_no) AS back FROM rpos) GROUP BY ip
  UNION ALL
  SELECT ip, 'rules', min(CASE WHEN heuristic_label = 'bot' THEN pos END), NULL FROM dpos GROUP BY ip
  UNION ALL
  SELECT ip, 'blend', min(CASE WHEN score > 0.85 THEN pos END), max(score) FROM dpos GROUP BY ip
  UNION ALL
  SELECT ip, 'model', min(CASE WHEN model_score > 0.5 THEN pos END), max(model_score) FROM dpos GROUP BY ip)"""


def verdicts_of(spark, sf):
    return T.run_detectors(requests_of(spark, sf), D.decisions(spark, sf))


@evaluation.query(
    "detector_verdicts",
    B.over_requests(
        """SELECT ip, detector, first_flag IS NOT NULL AS flagged, first_flag,
        round(score, 6) AS score FROM verdict""",
        VERDICT_SQL,
    ),
    "C7 C8 C9 B29",
)
def _(spark, sf):
    return rounded(verdicts_of(spark, sf), "score")


@evaluation.query(
    "external_verdicts",
    B.over_requests(
        """SELECT ip, bool_or(user_id % 17 = 0) AS flagged FROM req GROUP BY ip"""
    ),
    "J4",
)
def _(spark, sf):
    rows = T.from_ip_set(requests_of(spark, sf), D.tor_exits(spark, sf), "external")
    return rows.select("ip", "flagged")


@evaluation.query(
    "scan_verdicts",
    B.over_scored(
        """SELECT ip, bool_or(label = 'bot') AS flagged, round(max(score), 6) AS score FROM scored
        SEMI JOIN (SELECT ip FROM truth WHERE is_bot) USING (ip) GROUP BY ip""",
        D.TRUTH_SQL,
    ),
    "J2 J5",
)
def _(spark, sf):
    sessions = scan_sessions(requests_of(spark, sf), S.load_network())
    rows = T.for_actors(T.from_scan(sessions), D.truth(spark, sf).filter("is_bot"))
    return rounded(rows.select("ip", "flagged", "score"), "score")


WILSON = """
CASE WHEN n = 0 THEN 0 ELSE greatest(0, ((k / n + z2 / (2 * n)) - z * sqrt(k / n * (1 - k / n) / n
  + z2 / (4.0::DOUBLE * n * n))) / (1 + z2 / n)) END AS ci_low,
CASE WHEN n = 0 THEN 1 ELSE least(1, ((k / n + z2 / (2 * n)) + z * sqrt(k / n * (1 - k / n) / n
  + z2 / (4.0::DOUBLE * n * n))) / (1 + z2 / n)) END AS ci_high"""
Z = f"(SELECT {M.Z95!r}::DOUBLE AS z, {M.Z95 * M.Z95!r}::DOUBLE AS z2)"
RATES_SQL = f"""
cells0 AS (SELECT config, seed, level, detector, k, n FROM (
  SELECT config, seed, CASE WHEN class = 'human' THEN 'humans' ELSE level END AS level, d.detector,
    count_if(coalesce(first_flag IS NOT NULL, false))::BIGINT AS k, count(*) AS n
  FROM truth t CROSS JOIN (SELECT DISTINCT detector FROM verdict) d
  LEFT JOIN verdict v ON v.ip = t.ip AND v.detector = d.detector
  GROUP BY GROUPING SETS ((config, CASE WHEN class = 'human' THEN 'humans' ELSE level END, d.detector),
    (config, CASE WHEN class = 'human' THEN 'humans' ELSE level END, d.detector, seed)))),
cells AS (SELECT *, {WILSON} FROM cells0, {Z})"""


@evaluation.query(
    "detector_rates",
    B.over_requests(
        f"""SELECT class, detector, k, n, round(k / n, 6) AS rate, round(ci_low, 6) AS ci_low,
        round(ci_high, 6) AS ci_high FROM (SELECT *, {WILSON} FROM (
          SELECT class, d.detector, count(v.first_flag) AS k, count(*) AS n
          FROM truth t CROSS JOIN (SELECT DISTINCT detector FROM verdict) d
          LEFT JOIN verdict v ON v.ip = t.ip AND v.detector = d.detector GROUP BY ALL), {Z})""",
        VERDICT_SQL, D.TRUTH_SQL,
    ),
    "E15 B34 J2",
)
def _(spark, sf):
    rates = T.rates_by_class(D.truth(spark, sf), verdicts_of(spark, sf), detectors=T.DETECTORS)
    return rounded(rates, "rate", "ci_low", "ci_high")


def ladder_of(spark, sf):
    truth = D.truth(spark, sf)
    verdicts = verdicts_of(spark, sf).join(truth.select("ip", "config", "seed"), "ip")
    return T.ladder(truth, verdicts, T.DETECTORS)


@evaluation.query(
    "ladder_cells",
    B.over_requests(
        """SELECT config, level, detector, seed, k, n, round(k / n, 6) AS rate,
        round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM cells""",
        VERDICT_SQL, D.TRUTH_SQL, RATES_SQL,
    ),
    "E16",
)
def _(spark, sf):
    cells = ladder_of(spark, sf).select(
        "config", "level", "detector", "seed", "k", "n", "rate", "ci_low", "ci_high"
    )
    return rounded(cells, "rate", "ci_low", "ci_high")


@evaluation.query(
    "ladder_beats",
    B.over_requests(
        """SELECT b.config, b.level, b.detector AS baseline, o.ci_low > b.ci_high AND oh.k <= bh.k AS beats
        FROM cells b JOIN cells o ON o.config = b.config AND o.level = b.level AND o.detector = 'rules'
          AND o.seed IS NULL
        JOIN cells bh ON bh.config = b.config AND bh.level = 'humans' AND bh.detector = b.detector
          AND bh.seed IS NULL
        JOIN cells oh ON oh.config = b.config AND oh.level = 'humans' AND oh.detector = 'rules'
          AND oh.seed IS NULL
        WHERE b.seed IS NULL AND b.level <> 'humans'
          AND b.detector IN ('ua_regex', 'rate_limit', 'path_blocklist')""",
        VERDICT_SQL, D.TRUTH_SQL, RATES_SQL,
    ),
    "E17",
)
def _(spark, sf):
    return T.beats(ladder_of(spark, sf), "rules", ["ua_regex", "rate_limit", "path_blocklist"])


@evaluation.query(
    "detection_delays",
    B.over_requests(
        """SELECT d.detector, count(first_flag) AS caught,
        count_if(first_flag IS NULL)::BIGINT AS missed,
        round(quantile_cont(first_flag, 0.5), 6) AS median_request,
        round(quantile_cont(first_flag, 0.9), 6) AS p90_request
        FROM (SELECT * FROM truth WHERE is_bot) t CROSS JOIN (SELECT DISTINCT detector FROM verdict) d
        LEFT JOIN verdict v ON v.ip = t.ip AND v.detector = d.detector GROUP BY d.detector""",
        VERDICT_SQL, D.TRUTH_SQL,
    ),
    "E18",
)
def _(spark, sf):
    rows = T.delays(D.truth(spark, sf), verdicts_of(spark, sf), T.DETECTORS)
    return rounded(rows, "median_request", "p90_request")


@evaluation.query(
    "verdict_confusion",
    B.over_requests(
        """SELECT count_if(is_bot AND f)::BIGINT AS tp, count_if(NOT is_bot AND f)::BIGINT AS fp,
        count_if(is_bot AND NOT f)::BIGINT AS fn, count_if(NOT is_bot AND NOT f)::BIGINT AS tn
        FROM (SELECT is_bot, coalesce(first_flag IS NOT NULL, false) AS f FROM truth
              LEFT JOIN (SELECT * FROM verdict WHERE detector = 'blend') USING (ip))""",
        VERDICT_SQL, D.TRUTH_SQL,
    ),
    "E25",
)
def _(spark, sf):
    blend = T.run_detectors(None, D.decisions(spark, sf), ["blend"]).select("ip", "flagged")
    rows = M.confusion_of_verdicts(D.truth(spark, sf).select("ip", "is_bot"), blend)
    return rows.select("tp", "fp", "fn", "tn")


_OPTIONS = {name: ", ".join(f"{c!r}::DOUBLE" for c in confidences) for name, confidences in P.RULE_CONFIDENCES}
_NAMED = ", ".join(f"{{'t': {B.sql_text(t)}, 'c': {c!r}::DOUBLE}}" for t, c in P.HUMAN_REASON_PREFIXES)


@evaluation.query(
    "recovered_confidence",
    B.over_requests(
        f"""SELECT decision_id, CASE WHEN len(found) = 1 THEN found[1] END AS confidence FROM (
        SELECT decision_id, CASE heuristic_label WHEN 'bot' THEN bots
            WHEN 'human' THEN CASE WHEN len(humans) > 1 THEN list_intersect(humans, named) ELSE humans END END AS found
        FROM (SELECT *,
          list_filter([{_OPTIONS["bot"]}], lambda c: abs(greatest(0.6::DOUBLE * model_score + 0.4::DOUBLE * c, c) - score) <= 1e-9) AS bots,
          list_filter([{_OPTIONS["human"]}], lambda c: abs(least(0.6::DOUBLE * model_score + 0.4::DOUBLE * c, 1 - c) - score) <= 1e-9) AS humans,
          list_transform(list_filter([{_NAMED}], lambda n: starts_with(heuristic_reason, n.t)), lambda n: n.c) AS named
          FROM dec))""",
        DEC,
    ),
    "B38",
)
def _(spark, sf):
    """All decisions: bots, humans whose confidence the reason settles, and integrations without one."""
    found = S.recovered_confidence(
        F.col("heuristic_label"), F.col("score"), F.col("model_score"), F.col("heuristic_reason")
    )
    return D.decisions(spark, sf).select("decision_id", found.alias("confidence"))


NETWORK_OVER_ARRAY = B.network_sql([f"features[{i + 1}]" for i in range(len(FEATURES))])


@evaluation.query(
    "rescored_verdicts",
    B.over_requests(
        f"""SELECT ip, min(CASE WHEN v > 0.5 THEN pos END) IS NOT NULL AS flagged,
        min(CASE WHEN v > 0.5 THEN pos END) AS first_flag, round(max(v), 6) AS score
        FROM (SELECT *, CASE WHEN heuristic_label = 'automated-integration' THEN 0
          ELSE {B.blend_sql(conf="confidence", model="m")} END AS v
          FROM (SELECT *, {NETWORK_OVER_ARRAY} AS m FROM dpos)) GROUP BY ip""",
        VERDICT_SQL,
    ),
    "F14",
)
def _(spark, sf):
    network = S.load_network()
    rows = T.rescored(D.decisions(spark, sf), lambda v: S.array_score(network, v), 0.5)
    return rounded(rows.select("ip", "flagged", "first_flag", "score"), "score")


@evaluation.query(
    "marginal_catches",
    B.over_requests(
        """SELECT level, marginal_catches, added_fp, CASE WHEN level = 'all'
          THEN marginal_catches >= 1 AND added_fp = 0 END AS earns_place FROM (
        SELECT coalesce(level, 'all') AS level, count_if(is_bot)::BIGINT AS marginal_catches,
          count_if(NOT is_bot)::BIGINT AS added_fp
        FROM (SELECT ip, max(model_score) AS s FROM dec GROUP BY ip) JOIN truth USING (ip)
        WHERE s > 0.9 AND ip NOT IN (SELECT ip FROM dec WHERE heuristic_label = 'bot')
        GROUP BY ROLLUP (level))""",
        DEC, D.TRUTH_SQL,
    ),
    "E29 J16 F13",
)
def _(spark, sf):
    decisions = D.decisions(spark, sf)
    scores = decisions.groupBy("ip").agg(F.max("model_score").alias("score"))
    rows = scores.join(D.truth(spark, sf).select("ip", "is_bot", "level"), "ip")
    flagged = decisions.filter("heuristic_label = 'bot'").select("ip").distinct()
    return T.marginal_catches(rows, flagged, threshold=0.9)


@evaluation.query(
    "model_spread",
    B.over_requests(
        """SELECT n, round(median, 6) AS median, round(lo, 6) AS lo, round(hi, 6) AS hi,
        round(q3 - q1, 6) AS iqr, q3 - q1 < 0.05 AS near_constant FROM (
        SELECT count(*) AS n, quantile_cont(model_score, 0.5) AS median, min(model_score) AS lo,
          max(model_score) AS hi,
          max(CASE WHEN rn = (n0 + 1) // 4 THEN model_score END) * (4 - (n0 + 1) % 4) / 4.0
            + max(CASE WHEN rn = (n0 + 1) // 4 + 1 THEN model_score END) * ((n0 + 1) % 4) / 4.0 AS q1,
          max(CASE WHEN rn = 3 * (n0 + 1) // 4 THEN model_score END) * (4 - 3 * (n0 + 1) % 4) / 4.0
            + max(CASE WHEN rn = 3 * (n0 + 1) // 4 + 1 THEN model_score END)
              * (3 * (n0 + 1) % 4) / 4.0 AS q3
        FROM (SELECT model_score, row_number() OVER (ORDER BY model_score) AS rn, count(*) OVER () AS n0
              FROM dec) GROUP BY n0)""",
        DEC,
    ),
    "E19",
)
def _(spark, sf):
    return rounded(M.model_spread(D.decisions(spark, sf)), "median", "lo", "hi", "iqr")


# --- scores and labels of documents ------------------------------------------------------------


@evaluation.query(
    "confusion_at_threshold",
    B.with_ctes(
        """SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall,
        round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
        round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (
        SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r
        FROM (SELECT count_if(score > 0.4 AND label > 0)::BIGINT AS tp,
          count_if(score > 0.4 AND label = 0)::BIGINT AS fp,
          count_if(score <= 0.4 AND label > 0)::BIGINT AS fn,
          count_if(score <= 0.4 AND label = 0)::BIGINT AS tn FROM sc))""",
        D.SCORES_SQL,
    ),
    "E20",
)
def _(spark, sf):
    rows = M.confusion_at(D.document_scores(spark, sf), 0.4)
    return rounded(rows, "precision", "recall", "f1", "accuracy")


@evaluation.query(
    "roc_curve",
    B.with_ctes(
        """SELECT round(t, 6) AS threshold,
        round(coalesce((SELECT count_if(score > t AND label > 0) / nullif(count_if(label > 0), 0) FROM sc), 0), 6)
          AS tpr,
        round(coalesce((SELECT count_if(score > t AND label = 0) / nullif(count_if(label = 0), 0) FROM sc), 0), 6)
          AS fpr
        FROM (SELECT DISTINCT score AS t FROM sc UNION SELECT -1.0 UNION SELECT 1.0)""",
        D.SCORES_SQL,
    ),
    "E21",
)
def _(spark, sf):
    return rounded(M.roc_curve(D.document_scores(spark, sf)), "threshold", "tpr", "fpr")


@evaluation.query(
    "roc_auc",
    B.with_ctes(
        """SELECT round((sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5
        ELSE 0 END)) / count(*), 6) AS auc
        FROM (SELECT score FROM sc WHERE label > 0) p CROSS JOIN (SELECT score FROM sc WHERE label = 0) n""",
        D.SCORES_SQL,
    ),
    "E22",
)
def _(spark, sf):
    return rounded(M.roc_auc(D.document_scores(spark, sf)), "auc")


@evaluation.query(
    "average_precision",
    B.with_ctes(
        """SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap FROM (
        SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
          SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY score)
        WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""",
        D.SCORES_SQL,
    ),
    "E23",
)
def _(spark, sf):
    return rounded(M.average_precision(D.document_scores(spark, sf)), "ap")


@evaluation.query("auc_interval", None, "E24")
def _(spark, sf):
    return M.bootstrap_auc(D.document_scores(spark, sf), replicates=1000)


#: Point estimates of two scorings of the labelled documents.
_POINTS_SQL = """
sc2 AS (SELECT ip, (score * 211 + 37) % 100 / 100.0::DOUBLE AS score, label FROM sc),
both_sc AS (SELECT 'a' AS s, * FROM sc UNION ALL SELECT 'b', * FROM sc2),
aucs AS (SELECT p.s, sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END)
    / count(*) AS auc FROM both_sc p JOIN both_sc n ON n.s = p.s AND n.label = 0 WHERE p.label > 0 GROUP BY p.s),
aps AS (SELECT s, sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM (
    SELECT s, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
      SELECT s, score, sum(label) AS pos, sum(1 - label) AS neg FROM both_sc GROUP BY s, score)
    WINDOW w AS (PARTITION BY s ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY s)"""


def covered(intervals):
    """The point estimate, whether the interval holds it, and the replicates that count."""
    inside = F.col("point").between(F.col("low"), F.col("high"))
    return rounded(intervals.select("statistic", "point", inside.alias("inside"), "survivors"), "point")


@evaluation.query(
    "statistic_intervals",
    B.with_ctes(
        """SELECT 'auc' AS statistic, round(auc, 6) AS point, true AS inside, 1000 AS survivors FROM aucs WHERE s = 'a'
        UNION ALL SELECT 'ap', round(ap, 6), true, 1000 FROM aps WHERE s = 'a'""",
        D.SCORES_SQL, _POINTS_SQL,
    ),
    "E24",
)
def _(spark, sf):
    return covered(M.bootstrap_intervals(D.document_scores(spark, sf)))


@evaluation.query(
    "paired_difference_intervals",
    B.with_ctes(
        """SELECT 'auc' AS statistic, round(a.auc - b.auc, 6) AS point, true AS inside, 1000 AS survivors
        FROM aucs a, aucs b WHERE a.s = 'a' AND b.s = 'b'
        UNION ALL SELECT 'ap', round(a.ap - b.ap, 6), true, 1000 FROM aps a, aps b WHERE a.s = 'a' AND b.s = 'b'""",
        D.SCORES_SQL, _POINTS_SQL,
    ),
    "E24, two scorings of the same actors on the same draws",
)
def _(spark, sf):
    scores = D.document_scores(spark, sf)
    other = scores.withColumn("score", F.round((F.round(F.col("score") * 211) + 37) % 100) / F.lit(100.0))
    return covered(M.bootstrap_intervals(scores, other))


@evaluation.query(
    "model_spread_by_config",
    B.over_requests(
        """SELECT config, count(*) AS seeds, round(quantile_cont(median, 0.5), 6) AS median_of_medians,
        round(max(q3 - q1), 6) AS max_iqr, max(q3 - q1) < 0.05 AS near_constant, round(avg(auc), 6) AS mean_actor_auc
        FROM (SELECT config, seed, quantile_cont(model_score, 0.5) AS median,
            max(CASE WHEN rn = (n0 + 1) // 4 THEN model_score END) * (4 - (n0 + 1) % 4) / 4.0
              + max(CASE WHEN rn = (n0 + 1) // 4 + 1 THEN model_score END) * ((n0 + 1) % 4) / 4.0 AS q1,
            max(CASE WHEN rn = 3 * (n0 + 1) // 4 THEN model_score END) * (4 - 3 * (n0 + 1) % 4) / 4.0
              + max(CASE WHEN rn = 3 * (n0 + 1) // 4 + 1 THEN model_score END)
                * (3 * (n0 + 1) % 4) / 4.0 AS q3
          FROM (SELECT config, seed, model_score, row_number() OVER (PARTITION BY config, seed ORDER BY model_score) AS rn,
              count(*) OVER (PARTITION BY config, seed) AS n0 FROM runs) GROUP BY config, seed, n0)
        JOIN (SELECT p.config, p.seed, sum(CASE WHEN p.s > n.s THEN 1.0::DOUBLE WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*) AS auc
          FROM acts p JOIN acts n ON n.config = p.config AND n.seed = p.seed AND NOT n.is_bot WHERE p.is_bot GROUP BY ALL)
          USING (config, seed)
        GROUP BY config""",
        DEC, D.TRUTH_SQL,
        """
runs AS (SELECT 'c' || (t.user_id % 2) AS config, t.seed, t.ip, t.is_bot, d.model_score
  FROM dec d JOIN truth t ON t.ip = d.ip),
acts AS (SELECT config, seed, ip, is_bot, max(model_score) AS s FROM runs GROUP BY ALL)""",
    ),
    "E19",
)
def _(spark, sf):
    config = F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string"))
    rows = M.spread_by_config(D.decisions(spark, sf).select("ip", "model_score"), D.truth(spark, sf).withColumn("config", config))
    return rounded(
        rows.select("config", "seeds", "median_of_medians", "max_iqr", "near_constant", "mean_actor_auc"),
        "median_of_medians", "max_iqr", "mean_actor_auc",
    )


@evaluation.query(
    "recall_without_false_alarms",
    B.over_requests(
        """SELECT caught, bots, round(caught / bots, 6) AS recall,
        round(CASE WHEN caught > 0 THEN t ELSE 1.0 END, 6) AS threshold FROM (
        SELECT count_if(is_bot AND s > t)::BIGINT AS caught, count_if(is_bot)::BIGINT AS bots, max(t) AS t
        FROM act CROSS JOIN (SELECT max(s) AS t FROM act WHERE NOT is_bot))""",
        DEC,
        D.TRUTH_SQL,
        "act AS (SELECT is_bot, max(score) AS s FROM dec JOIN truth USING (ip) GROUP BY ip, is_bot)",
    ),
    "E26",
)
def _(spark, sf):
    scores = D.decisions(spark, sf).groupBy("ip").agg(F.max("score").alias("score"))
    rows = scores.join(D.truth(spark, sf), "ip").withColumn("label", F.col("is_bot").cast("int"))
    return rounded(M.recall_without_false_alarms(rows), "recall", "threshold")
