"""Registered queries: forensic labels, datasets, checks, training, replay, responses."""

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scoring as S
from ..operators import datasets as DS
from ..operators import groundtruth as GT
from ..operators import responses as RE
from ..operators import training as TR
from ..operators.metrics import roc_auc
from ..schema import FEATURES, STATUS_FEATURES
from ..session import cut_lineage
from ..sources import derived as D
from ..sources.adapters import requests_of
from ..sources.feeds import forensic_rules
from ..streaming.live import replay
from . import oracle_base as B
from .catalog_signals import EVIDENCE_SQL, actor_labels, claiming
from .registry import Registry, rounded

datasets = Registry()
DEC, DSQ = D.DECISIONS_SQL, D.DATASET_SQL

RULES = [
    {"id": "dir_scan", "filter": ["code: 404", "%python%"]},
    {"id": "dir_scan", "ground_truth_label": "dir_scan_tool", "filter": ["code: 404", "curl"]},
    {"id": "probe", "filter": ["/.ENV"]},
    {"id": "checkout", "filter": ["%POST%", "basket", "CustomAgent"]},
    {"id": "signup_abuse", "filter": ["/login?token="]},
    {"id": "any_tool", "filter": ["curl"]},
]

CATEGORY_SQL = """CASE
    WHEN contains(t, 'code: 404') AND contains(t, 'python') THEN 'dir_scan'
    WHEN contains(t, 'code: 404') AND contains(t, 'curl') THEN 'dir_scan_tool'
    WHEN contains(t, '/.env') THEN 'probe'
    WHEN contains(t, 'post') AND contains(t, 'basket') AND contains(t, 'customagent') THEN 'checkout'
    WHEN contains(t, '/login?token=') THEN 'signup_abuse'
    WHEN contains(t, 'curl') THEN 'any_tool' END"""
MATCH_SQL = f"""
matched AS (SELECT *, {CATEGORY_SQL} AS category
  FROM (SELECT *, lower(raw_line || ' code: ' || status) AS t FROM ses)),
gt AS (SELECT ip, session_no, arg_max(category, n * 1000000 - first_pos) AS category FROM (
    SELECT ip, session_no, category, count(*) AS n, min(session_pos) AS first_pos FROM matched
    WHERE category IS NOT NULL GROUP BY ALL) GROUP BY ip, session_no)"""


@datasets.query(
    "forensic_lines",
    B.over_sessions("SELECT line_no, category FROM matched", MATCH_SQL),
    "A16 J12",
)
def _(spark, sf):
    rules = forensic_rules(spark, RULES)
    return GT.match_lines(requests_of(spark, sf), rules).select("line_no", "category")


@datasets.query(
    "forensic_sessions",
    B.over_sessions(
        """SELECT ip, session_no::BIGINT AS session_no, count(*) AS requests, any_value(g.category) AS category,
        CASE WHEN any_value(g.category) IS NULL THEN 'unlabeled' ELSE 'bot' END AS truth_label
        FROM ses LEFT JOIN gt g USING (ip, session_no) GROUP BY ip, session_no""",
        MATCH_SQL,
    ),
    "J13",
)
def _(spark, sf):
    return GT.label_sessions(requests_of(spark, sf), forensic_rules(spark, RULES))


@datasets.query(
    "rule_labelled_sessions",
    B.over_labelled(
        """SELECT ip, session_no::BIGINT AS session_no,
        CASE WHEN heuristic_label = 'bot' THEN 1.0 ELSE 0.0 END::DOUBLE AS label
        FROM labelled WHERE requests >= 3"""
    ),
    "F2",
)
def _(spark, sf):
    return DS.rule_labelled(requests_of(spark, sf)).select("ip", "session_no", "label")


@datasets.query(
    "forensic_dataset",
    B.over_labelled(
        """SELECT l.ip AS group_id, session_no::BIGINT AS session_no,
        CASE WHEN g.category IS NOT NULL THEN 'ground_truth:' || g.category ELSE 'heuristic' END AS provenance,
        round(endpoint_sequence_entropy, 6) + 0 AS endpoint_sequence_entropy
        FROM labelled l LEFT JOIN gt g USING (ip, session_no)
        WHERE requests >= 3 AND (g.category IS NOT NULL OR heuristic_label = 'bot')""",
        MATCH_SQL,
    ),
    "F3 U1",
)
def _(spark, sf):
    # Each client keeps one agent here, so both keys give the same sessions.
    rows = DS.forensic_bots(requests_of(spark, sf), forensic_rules(spark, RULES))
    return rounded(
        rows.select(
            F.substring_index("group_id", "|", 1).alias("group_id"), "session_no", "provenance",
            "endpoint_sequence_entropy",
        ),
        "endpoint_sequence_entropy",
    )


@datasets.query(
    "real_dataset",
    B.over_labelled(
        """SELECT provenance, label, count(*) AS n, count(DISTINCT group_id) AS groups FROM (
        SELECT CASE WHEN g.category IS NOT NULL THEN 'ground_truth:' || g.category ELSE 'heuristic' END AS provenance,
          1.0::DOUBLE AS label, l.ip AS group_id FROM labelled l LEFT JOIN gt g USING (ip, session_no)
        WHERE requests >= 3 AND (g.category IS NOT NULL OR heuristic_label = 'bot')
        UNION ALL SELECT 'archive_human', 0.0, line_no::VARCHAR FROM ds WHERE label <= 0.5) GROUP BY ALL""",
        MATCH_SQL, DEC, DSQ,
    ),
    "F3",
)
def _(spark, sf):
    """Bots found by rules in the requests, humans of another source with their provenance."""
    bots = DS.forensic_bots(requests_of(spark, sf), forensic_rules(spark, RULES))
    humans = DS.external_humans(D.feature_rows(spark, sf), F.col("line_no"), "archive")
    rows = DS.real_dataset(bots, humans).groupBy("provenance", "label")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups"))


@datasets.query(
    "same_site_dataset",
    B.with_ctes(
        """SELECT day, group_id, label, count(*) AS sessions FROM (
        SELECT CAST(l.day AS VARCHAR) AS day, CASE WHEN l.label = 'human_proxy' THEN 0.0 ELSE 1.0 END::DOUBLE
            AS label,
          'shop_' || CAST(l.day AS VARCHAR) || '_' || substr(sha256(CAST(l.day AS VARCHAR) || '|' || l.ip), 1, 12)
            AS group_id,
          row_number() OVER (PARTITION BY l.day, l.ip
            ORDER BY (session_no * 2654435761) % 1000003, session_no) AS k
        FROM (SELECT local_date AS day, ip, session_no FROM dses GROUP BY ALL HAVING count(*) >= 3) s
        JOIN labels2 l USING (day, ip)
        WHERE l.label IN ('human_proxy', 'verified_crawler', 'unverified_crawler', 'probe_bot'))
        WHERE k <= 5 GROUP BY ALL""",
        B.REQ, EVIDENCE_SQL, B.sessions_cte("local_date, ip", source="creq", out="dses"),
    ),
    "F4 J3 C16 B27",
)
def _(spark, sf):
    labels = actor_labels(spark, sf).select("day", "ip", "label")
    rows = DS.same_site(claiming(spark, sf), labels, "shop")
    return rows.groupBy("day", "group_id", "label").agg(F.count("*").alias("sessions"))


@datasets.query(
    "combined_dataset",
    B.over_requests(
        """SELECT provenance, label, count(*) AS n FROM (
        SELECT provenance, label FROM ds
        UNION ALL SELECT provenance, label FROM (SELECT 'extra' AS provenance, 1.0::DOUBLE AS label, line_no
          FROM ds WHERE label > 0.5) WHERE line_no < 0) GROUP BY ALL""",
        DEC, DSQ,
    ),
    "U1 U3",
)
def _(spark, sf):
    rows = D.feature_rows(spark, sf)
    # Bots already outnumber half of the humans, so nothing may be topped up.
    extra = rows.filter("label > 0.5").withColumn("provenance", F.lit("extra"))
    return DS.top_up(rows, extra).groupBy("provenance", "label").agg(F.count("*").alias("n"))


@datasets.query(
    "topped_up_dataset",
    B.over_requests(
        """SELECT provenance, count(*) AS n FROM (
        SELECT provenance FROM ds
        UNION ALL SELECT 'extra' FROM (SELECT row_number() OVER () AS k FROM ds WHERE label > 0.5)
        WHERE k <= (SELECT least(floor(greatest(b, h // 2) * 0.3::DOUBLE), greatest(0, greatest(b, h // 2) - b))
          FROM (SELECT count_if(label > 0.5 AND user_id % 8 = 0) AS b, count_if(label < 0.5 OR user_id % 8 <> 0) AS h
                FROM ds))) GROUP BY provenance""",
        DEC, DSQ,
    ),
    "U3",
)
def _(spark, sf):
    """All rows, of which only the bots of one agent count as bots, so that they fall short."""
    rows = D.feature_rows(spark, sf)
    extra = rows.filter("label > 0.5").withColumn("provenance", F.lit("extra"))
    scarce = rows.withColumn("label", F.expr("IF(label > 0.5 AND user_id % 8 = 0, 1D, 0D)"))
    return DS.top_up(scarce, extra).groupBy("provenance").agg(F.count("*").alias("n"))


@datasets.query(
    "feature_ranges",
    B.over_requests(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, round(min({f}), 6) AS lo, round(max({f}), 6) AS hi FROM ds"
            for f in FEATURES
        ),
        DEC, DSQ,
    ),
    "F5",
)
def _(spark, sf):
    wide = DS.ranges(D.feature_rows(spark, sf))
    cells = [
        F.struct(F.lit(f).alias("feature"), F.col(f"min_{f}").alias("lo"), F.col(f"max_{f}").alias("hi"))
        for f in FEATURES
    ]
    rows = wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rounded(rows, "lo", "hi")


SPLIT_SQL = """
groups AS (SELECT group_id, any_value(user_id) AS uid, arg_min(label, line_no) > 0.5 AS bot FROM ds
  GROUP BY group_id),
splits AS (SELECT group_id, bot, CASE WHEN k <= greatest(1, floor(n * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END
  AS split FROM (SELECT *, row_number() OVER (PARTITION BY bot ORDER BY (uid * 2654435761) % 1000003, group_id)
    AS k, count(*) OVER (PARTITION BY bot) AS n FROM groups))"""


def split_of(spark, sf):
    octets = F.split("group_id", r"\.")
    user = octets[1].cast("long") * 256 + octets[2].cast("long")
    return DS.group_holdout(
        D.feature_rows(spark, sf), F.col("line_no"), DS.arithmetic_hash(user)
    )


@datasets.query(
    "group_holdout",
    B.over_requests(
        """SELECT group_id, split, count(*) AS n FROM ds JOIN splits USING (group_id) GROUP BY ALL""",
        DEC, DSQ, SPLIT_SQL,
    ),
    "F6",
)
def _(spark, sf):
    return split_of(spark, sf).groupBy("group_id", "split").agg(F.count("*").alias("n"))


@datasets.query(
    "day_holdout",
    B.over_requests(
        """SELECT day, CASE WHEN day IN ('2024-01-01') THEN 'test' ELSE 'train' END AS split, count(*) AS n
        FROM ds GROUP BY ALL""",
        DEC, DSQ,
    ),
    "F7",
)
def _(spark, sf):
    rows = DS.day_holdout(D.feature_rows(spark, sf), ["2024-01-01"])
    return rows.groupBy("day", "split").agg(F.count("*").alias("n"))


@datasets.query(
    "training_rows",
    B.over_requests(
        """SELECT line_no FROM (SELECT *, row_number() OVER (PARTITION BY seed, ip
          ORDER BY (line_no * 2654435761) % 1000003, line_no) AS k FROM ds
        WHERE seed IN (1, 2) AND (label < 0.5 OR level IN ('L0', 'L1', 'L2'))) WHERE k <= 20""",
        DEC, DSQ,
    ),
    "F8 C16",
)
def _(spark, sf):
    order = (DS.arithmetic_hash(F.col("line_no")), F.col("line_no"))
    rows = DS.training_rows(D.feature_rows(spark, sf), (1, 2), ("L0", "L1", "L2"), order)
    return rows.select("line_no")


# One leaking column of each kind, so the checks have something to find.
LEAKY_SQL = f"""
leaky AS (SELECT * REPLACE (CASE WHEN label > 0.5 THEN error_rate + 5 ELSE error_rate END AS error_rate,
  CASE WHEN label > 0.5 THEN night_ratio ELSE 0.25 END AS night_ratio) FROM ds),
prof AS ({" UNION ALL ".join(
    f"SELECT '{f}' AS feature, min(CASE WHEN label < 0.5 THEN {f} END) AS hmin, "
    f"max(CASE WHEN label < 0.5 THEN {f} END) AS hmax, min(CASE WHEN label > 0.5 THEN {f} END) AS bmin, "
    f"max(CASE WHEN label > 0.5 THEN {f} END) AS bmax FROM leaky" for f in FEATURES)})"""


@datasets.query(
    "leakage",
    B.over_requests(
        """SELECT feature, round(hmin, 6) AS human_min, round(hmax, 6) AS human_max,
        round(bmin, 6) AS bot_min, round(bmax, 6) AS bot_max,
        (hmin = hmax) <> (bmin = bmax) AS one_sided, hmax < bmin OR bmax < hmin AS separates FROM prof""",
        DEC, DSQ, LEAKY_SQL,
    ),
    "E31 E32",
)
def _(spark, sf):
    bot = F.col("label") > 0.5
    rows = (
        D.feature_rows(spark, sf)
        .withColumn("error_rate", F.when(bot, F.col("error_rate") + 5).otherwise(F.col("error_rate")))
        .withColumn("night_ratio", F.when(bot, F.col("night_ratio")).otherwise(0.25))
    )
    return rounded(DS.leakage(rows), "human_min", "human_max", "bot_min", "bot_max")


@datasets.query(
    "human_sources",
    B.over_requests(
        """SELECT count(DISTINCT provenance) AS human_sources, count(DISTINCT provenance) > 1 AS diverse
        FROM ds WHERE label < 0.5""",
        DEC, DSQ,
    ),
    "E33",
)
def _(spark, sf):
    return DS.human_sources(D.feature_rows(spark, sf))


@datasets.query(
    "actor_scores",
    B.over_requests(
        f"SELECT ip, round(max({B.network_sql()}), 6) AS score, max(label) AS label FROM ds GROUP BY ip",
        DEC, DSQ,
    ),
    "F1 F13",
)
def _(spark, sf):
    score = S.network_score(S.load_network())
    return rounded(DS.actor_scores(D.feature_rows(spark, sf), score), "score")


@datasets.query(
    "normalised_vectors",
    B.over_requests(
        "SELECT line_no, "
        + ", ".join(
            f"round(({f} - min({f}) OVER ()) / (max({f}) OVER () - min({f}) OVER ()), 6) AS {f}"
            for f in FEATURES[:3]
        )
        + " FROM ds",
        DEC, DSQ,
    ),
    "B36",
)
def _(spark, sf):
    rows = D.feature_rows(spark, sf)
    bounds = rows.agg(
        F.struct(
            F.array(*[F.min(f) for f in FEATURES]).alias("mins"),
            F.array(*[F.max(f) for f in FEATURES]).alias("maxs"),
        )
    ).scalar()
    vector = F.array(*[F.col(f) for f in FEATURES])
    scaled = rows.withColumn("b", bounds).withColumn(
        "v", S.normalise_array(vector, F.col("b.mins"), F.col("b.maxs"))
    )
    return rounded(
        scaled.select("line_no", *[F.col("v")[i].alias(f) for i, f in enumerate(FEATURES[:3])]), *FEATURES[:3]
    )


@datasets.query(
    "masked_status_changes",
    B.over_requests(
        f"""SELECT count(*) AS rows_compared, count_if((a > 0.3) <> (b > 0.3))::BIGINT AS rows_changed,
        count_if(a > 0.3)::BIGINT AS flagged_full, count_if(b > 0.3)::BIGINT AS flagged_masked FROM (
        SELECT {B.network_sql()} AS a,
          {B.network_sql(["0::DOUBLE" if f in STATUS_FEATURES else f for f in FEATURES])} AS b FROM ds)""",
        DEC, DSQ,
    ),
    "F16",
)
def _(spark, sf):
    return DS.masked_changes(D.feature_rows(spark, sf), S.load_network(), STATUS_FEATURES, threshold=0.3)


@datasets.query(
    "holdout_metrics",
    B.over_requests(
        f"""SELECT split, count_if(s > 0.3 AND label > 0.5)::BIGINT AS tp,
        count_if(s > 0.3 AND label < 0.5)::BIGINT AS fp, count_if(s <= 0.3 AND label > 0.5)::BIGINT AS fn,
        count_if(s <= 0.3 AND label < 0.5)::BIGINT AS tn
        FROM (SELECT *, {B.network_sql()} AS s FROM ds JOIN splits USING (group_id)) GROUP BY split""",
        DEC, DSQ, SPLIT_SQL,
    ),
    "F15 E20",
)
def _(spark, sf):
    score = S.network_score(S.load_network())
    rows = TR.holdout_metrics(split_of(spark, sf), score, threshold=0.3)
    return rows.select("split", "tp", "fp", "fn", "tn")


@datasets.query(
    "recall_by_provenance",
    B.over_requests(
        f"""SELECT split, provenance, count_if(s > 0.3)::BIGINT AS detected, count(*) AS bots,
        round(count_if(s > 0.3) / count(*), 6) AS recall
        FROM (SELECT *, {B.network_sql()} AS s FROM ds JOIN splits USING (group_id))
        WHERE label > 0.5 GROUP BY split, provenance""",
        DEC, DSQ, SPLIT_SQL,
    ),
    "F15",
)
def _(spark, sf):
    score = S.network_score(S.load_network())
    return rounded(TR.recall_by_provenance(split_of(spark, sf), score, threshold=0.3), "recall")


# --- training: rows only -------------------------------------------------------------------


def learnable(spark, sf):
    """Session features with the verdict of the rules as label, kept: fits read them many times."""
    rows = DS.rule_labelled(requests_of(spark, sf)).withColumn("group_id", F.col("ip"))
    return cut_lineage(rows.select(*FEATURES, "label", "ip", "group_id"))


def _weights(spark, network):
    return spark.createDataFrame(list(enumerate(network.weights)), "position int, weight double")


@datasets.query("trained_network", None, "F9")
def _(spark, sf):
    return _weights(spark, TR.train(learnable(spark, sf), epochs=20, rate=0.1))


@datasets.query("trained_network_without_agent", None, "F12")
def _(spark, sf):
    return _weights(spark, TR.train_without_agent(learnable(spark, sf), epochs=20, rate=0.1))


@datasets.query("fine_tuned_network", None, "F10")
def _(spark, sf):
    vector = F.array(*[F.col(f) for f in FEATURES])
    rows = learnable(spark, sf).select(vector.alias("features"), "label")
    return _weights(spark, TR.fine_tune(rows, S.load_network(), epochs=20))


def _baseline(kind, trees=200):
    def run(spark, sf):
        rows = learnable(spark, sf).select(*FEATURES, "label", "ip")
        return roc_auc(TR.baseline_scores(TR.train_baseline(rows, kind, trees=trees), rows))

    return run


datasets.query("logistic_baseline", None, "F11")(_baseline("logistic"))
datasets.query("forest_baseline", None, "F11")(_baseline("forest"))


#: What must hold of every trained network: its size, finite weights, a lower loss than it began with, both answers.
FACTS_SQL = "SELECT 85 AS weights, true AS finite, true AS loss_fell, 2 AS answers"


def _facts(spark, rows, network, before):
    """One row over the rows the network was trained on."""
    fell = TR.log_loss(rows, network) < TR.log_loss(rows, before)
    finite = all(abs(w) < float("inf") for w in network.weights)
    said = (S.network_score(network) > 0.5).alias("said")
    return rows.agg(
        F.lit(len(network.weights)).alias("weights"), F.lit(finite).alias("finite"), F.lit(fell).alias("loss_fell"),
        F.count_distinct(said).cast("int").alias("answers"),
    )


@datasets.query("trained_network_facts", FACTS_SQL, "F9")
def _(spark, sf):
    rows = learnable(spark, sf)
    return _facts(spark, rows, TR.train(rows, epochs=40, rate=0.3), TR.train(rows, epochs=1, rate=0.0001))


@datasets.query("trained_without_agent_facts", FACTS_SQL, "F12")
def _(spark, sf):
    rows = learnable(spark, sf)
    return _facts(spark, rows, TR.train_without_agent(rows, epochs=40, rate=0.3), TR.train_without_agent(rows, epochs=1, rate=0.0001))


@datasets.query("fine_tuned_facts", FACTS_SQL, "F10")
def _(spark, sf):
    vector = F.array(*[F.col(f) for f in FEATURES])
    rows = learnable(spark, sf)
    return _facts(spark, rows, TR.fine_tune(rows.select(vector.alias("features"), "label"), S.load_network(), epochs=20), S.load_network())


def _held_out_baseline(kind, trees=200):
    def run(spark, sf):
        """Rows and groups of each side, and whether the baseline, fitted on one, has an area on both."""
        scored = TR.held_out_baseline(split_of(spark, sf), kind, trees=trees)
        sizes = scored.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups"))
        areas = roc_auc(scored, by=["split"])
        return sizes.join(areas, "split").select("split", "n", "groups", (F.col("auc").between(0.0, 1.0)).alias("scored"))

    return run


HELD_OUT_SQL = B.over_requests(
    "SELECT split, count(*) AS n, count(DISTINCT group_id) AS groups, true AS scored FROM ds JOIN splits USING (group_id) GROUP BY split",
    DEC, DSQ, SPLIT_SQL,
)
datasets.query("logistic_held_out", HELD_OUT_SQL, "F11")(_held_out_baseline("logistic"))
datasets.query("forest_held_out", HELD_OUT_SQL, "F11")(_held_out_baseline("forest", trees=50))


# --- live replay -----------------------------------------------------------------------------

HISTORY_COLUMNS = "requests, paths, top_endpoint, top_hits, clicks, last_60s, last_300s, min_gap_us, max_gap_us"
#: Without the mean gap: it is a quotient of two others, and often a tie in rounding.
COMPARED_FEATURES = [f for f in FEATURES if f != "time_since_last_request"]


@datasets.query(
    "retained_histories",
    B.over_retained(
        f"""SELECT session_no AS line_no, {HISTORY_COLUMNS},
        {", ".join(f"round({f}, 6) AS {f}" for f in COMPARED_FEATURES)} FROM feats""",
        200,
        86_400,
    ),
    "C11 C12",
)
def _(spark, sf):
    """Sessions of a day, so that many histories are full and let go of their oldest requests."""
    rows = replay(requests_of(spark, sf), S.load_network(), timeout_s=86_400)
    kept = rows.select("line_no", *HISTORY_COLUMNS.split(", "), *COMPARED_FEATURES)
    return rounded(kept, *COMPARED_FEATURES)


DECISION_COLUMNS = [
    "ip", "line_no", "requests", "rule_code", "heuristic_label", "model_score", "score", "label", "blocked",
]


@datasets.query("live_decisions", B.over_retained("SELECT * FROM decided", 200, 1800, B.LIVE), "S2 C11 batch replay")
def _(spark, sf):
    rows = replay(requests_of(spark, sf), S.load_network()).select(DECISION_COLUMNS)
    return rounded(rows, "model_score", "score")


# --- responses --------------------------------------------------------------------------------


def captured(spark, sf):
    """Pages as captured responses: the host is the target; timing and headers by page."""
    pid = F.col("page_id")
    headers = F.map_concat(
        F.create_map(
            F.lit("Server"),
            F.when(pid % 3 == 0, "cloudflare").when(pid % 3 == 1, "nginx/1.25").otherwise("custom"),
            F.lit("Content-Type"), F.lit("text/html"),
        ),
        F.when(
            pid % 4 == 1,
            F.create_map(
                F.lit("Content-Security-Policy"), F.lit("x"), F.lit("X-Frame-Options"), F.lit("DENY"),
                F.lit("Strict-Transport-Security"), F.lit("y"),
            ),
        ).otherwise(F.create_map().cast("map<string,string>")),
    )
    total = F.when(pid % 7 == 0, 0.01).when(pid % 11 == 0, 6.0).otherwise(0.1 + (pid % 5) / F.lit(100.0))
    status = F.when(pid % 13 == 0, 429).when(pid % 17 == 0, 403).when(pid % 19 == 0, 503).when(
        pid % 5 == 0, 302
    ).otherwise(200)
    return spark.read.parquet(f"{sf}/pages.parquet").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("target"),
        pid.alias("seq"),
        status.alias("status"),
        headers.alias("headers"),
        F.col("html").cast("binary").alias("body"),
        F.create_map(F.lit("total"), total, F.lit("ttfb"), total / 2).alias("timing"),
        F.when(pid % 23 == 0, "refused").alias("error"),
    )


RESPONSES_SQL = """
cap AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS target, page_id AS seq,
    CASE WHEN page_id % 13 = 0 THEN 429 WHEN page_id % 17 = 0 THEN 403 WHEN page_id % 19 = 0 THEN 503
      WHEN page_id % 5 = 0 THEN 302 ELSE 200 END AS status, html,
    CASE WHEN page_id % 7 = 0 THEN 0.01::DOUBLE WHEN page_id % 11 = 0 THEN 6.0
      ELSE 0.1::DOUBLE + (page_id % 5) / 100.0::DOUBLE END AS total FROM pages),
agg AS (SELECT target, count(*) AS responses, min(seq) AS seq,
    count_if(status IN (301, 302, 303, 307, 308)) AS redirects,
    CASE WHEN count(*) >= 2 THEN stddev_pop(total) / avg(total) ELSE 0 END AS timing_cv
  FROM cap GROUP BY target),
bytes AS (SELECT target, seq, hex(encode(html)) AS h FROM agg JOIN cap USING (target, seq)),
ent AS (SELECT target, -sum(c / n * log2(c / n)) AS body_entropy, max(n)::BIGINT AS body_bytes FROM (
    SELECT target, b, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY target) AS n
    FROM (SELECT target, substr(h, 2 * i + 1, 2) AS b FROM (
      SELECT target, h, unnest(range(0, length(h) // 2)) AS i FROM bytes)) GROUP BY target, b)
  GROUP BY target),
feat AS (SELECT a.target, responses, timing_cv, c.status, total AS response_time,
    least(redirects / 5, 1.0::DOUBLE) AS redirect_count, body_entropy, body_bytes,
    least(body_bytes / 102400.0::DOUBLE, 1.0) AS body_length,
    CASE WHEN a.seq % 4 = 1 THEN 3 ELSE 0 END AS security_headers,
    CASE WHEN contains(lower(html), 'lang=') OR contains(lower(html), 'language') THEN 1.0 ELSE 0.0 END::DOUBLE
      AS has_accept_language,
    CASE a.seq % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.1 ELSE 0 END::DOUBLE AS server_bot_score, a.seq
  FROM agg a JOIN cap c ON c.target = a.target AND c.seq = a.seq JOIN ent e ON e.target = a.target)"""


@datasets.query(
    "response_features",
    B.with_ctes(
        """SELECT target, responses, round(timing_cv, 6) AS timing_cv, round(body_entropy, 6) AS body_entropy,
        body_bytes, round(body_length, 6) AS body_length, redirect_count, server_bot_score,
        has_accept_language, security_headers FROM feat""",
        RESPONSES_SQL,
    ),
    "P1",
)
def _(spark, sf):
    rows = RE.response_features(captured(spark, sf)).select(
        "target", "responses", "timing_cv", "body_entropy", F.col("body_bytes").cast("long").alias("body_bytes"),
        "body_length", "redirect_count", "server_bot_score", "has_accept_language", "security_headers",
    )
    return rounded(rows, "timing_cv", "body_entropy", "body_length")


@datasets.query(
    "response_profiles",
    B.with_ctes(
        """SELECT target, probe_code, CASE probe_code WHEN 'ERROR' THEN 0.6 WHEN 'FAST' THEN 0.3
        WHEN 'SLOW' THEN 0.5 WHEN 'RATE_LIMITED' THEN 0.8 WHEN 'FORBIDDEN' THEN 0.7
        WHEN 'SERVER_ERROR' THEN 0.5 WHEN 'PROTECTED' THEN 0.2 WHEN 'STEADY' THEN 0.7
        WHEN 'LOW_ENTROPY' THEN 0.4 ELSE 0.3 END::DOUBLE AS probe_score FROM (
        SELECT target, CASE WHEN seq % 23 = 0 THEN 'ERROR' WHEN response_time < 0.05 THEN 'FAST'
          WHEN response_time > 5 THEN 'SLOW' WHEN status = 429 THEN 'RATE_LIMITED'
          WHEN status = 403 THEN 'FORBIDDEN' WHEN status >= 500 THEN 'SERVER_ERROR'
          WHEN security_headers >= 3 THEN 'PROTECTED'
          WHEN responses > 2 AND timing_cv > 0 AND timing_cv < 0.05 THEN 'STEADY'
          WHEN body_entropy < 1 AND body_bytes > 0 THEN 'LOW_ENTROPY'
          WHEN body_entropy > 7.5 THEN 'HIGH_ENTROPY' ELSE 'DEFAULT' END AS probe_code FROM feat)""",
        RESPONSES_SQL,
    ),
    "P2",
)
def _(spark, sf):
    return RE.profile_responses(RE.response_features(captured(spark, sf))).select(
        "target", "probe_code", "probe_score"
    )


@datasets.query(
    "handshake_profiles",
    B.with_ctes(
        """SELECT target, code AS probe_code, round(cv, 6) AS handshake_timing_cv FROM (
        SELECT target, cv, CASE WHEN seq % 23 = 0 THEN 'NOT_CONNECTED' WHEN seq % 5 = 0 THEN 'REJECTED'
          WHEN seq % 7 = 0 THEN 'FAST' WHEN n > 2 AND cv > 0 AND cv < 0.05 THEN 'STEADY'
          WHEN seq % 2 = 0 THEN 'SILENT' ELSE 'DEFAULT' END AS code FROM (
          SELECT target, min(page_id) AS seq, count(*) AS n,
            CASE WHEN count_if(page_id % 23 <> 0) >= 2 THEN
              stddev_pop(CASE WHEN page_id % 23 <> 0 THEN t END) / avg(CASE WHEN page_id % 23 <> 0 THEN t END)
              ELSE 0 END AS cv
          FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS target, page_id,
              CASE WHEN page_id % 7 = 0 THEN 0.005::DOUBLE ELSE 0.1::DOUBLE + (page_id % 4) / 1000.0::DOUBLE END AS t
            FROM pages) GROUP BY target))"""
    ).replace("WITH \n", ""),
    "P3",
)
def _(spark, sf):
    pid = F.col("page_id")
    time = F.when(pid % 7 == 0, 0.005).otherwise(0.1 + (pid % 4) / F.lit(1000.0))
    rows = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("target"),
        pid.alias("seq"),
        (pid % 23 != 0).alias("connected"),
        (pid % 5 != 0).alias("handshake_ok"),
        F.lit(101).alias("status"),
        F.when(pid % 2 == 1, F.array(F.col("html").cast("binary"))).alias("frames"),
        F.create_map(F.lit("handshake"), time).alias("timing"),
        F.lit(None).cast("string").alias("error"),
    )
    out = RE.profile_handshakes(RE.handshake_features(rows))
    return rounded(out.select("target", "probe_code", "handshake_timing_cv"), "handshake_timing_cv")
