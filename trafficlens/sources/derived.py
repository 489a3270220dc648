"""Side tables derived from the event table: decisions, truth, feeds, submissions.

They let every operator run over the given tables; each row follows from an event or a
user by arithmetic, so a plain SQL engine can repeat it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import blend
from ..schema import FEATURES
from .adapters import CHROME, requests_of


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ip), one row per client."""
    return requests_of(spark, sf_dir).select("user_id", "ip").distinct()


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archived decision per request."""
    uid, eid = F.col("user_id"), F.col("line_no")
    kind = uid % 8
    label = (
        F.when(kind.isin(0, 1, 4), "bot").when(kind == 2, "automated-integration").otherwise("human")
    )
    confidence = F.when(kind.isin(0, 1), 0.95).when(kind == 4, 0.6).when(kind == 2, 0.9).when(
        kind == 3, 0.7
    ).otherwise(0.75)
    reason = (
        F.when(kind.isin(0, 1), F.concat(F.lit("known bot/monitoring UA: "), "user_agent"))
        .when(kind == 4, F.lit("unknown user-agent: CustomAgent/1.0"))
        .when(kind == 2, F.lit("known automated client (sends webhooks or remote calls, as Stripe/1.0)"))
        .when(kind == 3, F.lit("variable timing (the longest gap is 4.0 times the mean)"))
        .otherwise("known browser, reasonable session (12 requests over 90 s)")
    )
    vector = F.array(*[((eid * (i + 3)) % 101) / F.lit(101.0) for i in range(len(FEATURES))])
    model = ((eid * 37 + uid * 11) % 1000) / F.lit(1000.0)
    score = F.when(F.col("heuristic_label") == "automated-integration", 0.0).otherwise(
        blend(F.col("heuristic_label"), F.col("confidence"), F.col("model_score"))
    )
    return (
        requests_of(spark, sf_dir)
        .select(
            F.concat(F.lit("d"), eid.cast("string")).alias("decision_id"),
            "ip",
            "user_id",
            "ts_us",
            "ts",
            "src_file",
            "src_block",
            "line_no",
            vector.alias("features"),
            F.when(label == "automated-integration", 0.0).otherwise(model).alias("model_score"),
            label.alias("heuristic_label"),
            confidence.alias("confidence"),
            reason.alias("heuristic_reason"),
        )
        .withColumn("score", score)
        .withColumn("label", F.when(F.col("score") > 0.85, "bot").otherwise("human"))
        .withColumn("blocked", F.col("label") == "bot")
        .withColumn("timestamp", F.col("ts").cast("string"))
    )


DECISIONS_SQL = f"""
dec0 AS (
  SELECT 'd' || line_no AS decision_id, ip, user_id, ts_us, line_no,
    [{', '.join(f"((line_no * {i + 3}) % 101) / 101.0::DOUBLE" for i in range(len(FEATURES)))}]
      AS features,
    CASE WHEN user_id % 8 = 2 THEN 0
      ELSE ((line_no * 37 + user_id * 11) % 1000) / 1000.0::DOUBLE END AS model_score,
    CASE WHEN user_id % 8 IN (0, 1, 4) THEN 'bot' WHEN user_id % 8 = 2
      THEN 'automated-integration' ELSE 'human' END AS heuristic_label,
    CASE user_id % 8 WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 4 THEN 0.6 WHEN 2 THEN 0.9
      WHEN 3 THEN 0.7 ELSE 0.75 END::DOUBLE AS confidence,
    CASE WHEN user_id % 8 IN (0, 1) THEN 'known bot/monitoring UA: ' || user_agent
      WHEN user_id % 8 = 4 THEN 'unknown user-agent: CustomAgent/1.0'
      WHEN user_id % 8 = 2 THEN 'known automated client (sends webhooks or remote calls, as Stripe/1.0)'
      WHEN user_id % 8 = 3 THEN 'variable timing (the longest gap is 4.0 times the mean)'
      ELSE 'known browser, reasonable session (12 requests over 90 s)' END AS heuristic_reason
  FROM req),
dec AS (
  SELECT *, score > 0.85 AS blocked, CASE WHEN score > 0.85 THEN 'bot' ELSE 'human' END AS label
  FROM (SELECT *, CASE heuristic_label
      WHEN 'bot' THEN greatest(0.6::DOUBLE * model_score + 0.4::DOUBLE * confidence, confidence)
      WHEN 'human' THEN least(0.6::DOUBLE * model_score + 0.4::DOUBLE * confidence, 1 - confidence)
      ELSE 0 END AS score FROM dec0))"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ip, is_bot, class, level, seed, config) per client."""
    uid = F.col("user_id")
    bot = (uid % 8).isin(0, 1, 4) | (uid % 11 == 5)
    return users(spark, sf_dir).select(
        "ip",
        "user_id",
        bot.alias("is_bot"),
        F.when(bot, "bot").otherwise("human").alias("class"),
        F.concat(F.lit("L"), (uid % 4).cast("string")).alias("level"),
        (uid % 3 + 1).alias("seed"),
        F.lit("default").alias("config"),
    )


TRUTH_SQL = """
truth AS (
  SELECT ip, user_id, is_bot, CASE WHEN is_bot THEN 'bot' ELSE 'human' END AS class,
    'L' || (user_id % 4) AS level, user_id % 3 + 1 AS seed, 'default' AS config
  FROM (SELECT DISTINCT ip, user_id, user_id % 8 IN (0, 1, 4) OR user_id % 11 = 5 AS is_bot
        FROM req))"""


def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive as text, with damaged, short and blank lines in between."""
    eid = F.col("line_no")
    body = F.to_json(
        F.struct(
            "decision_id",
            F.when(eid % 29 == 0, F.slice("features", 1, 7)).otherwise(F.col("features")).alias(
                "features"
            ),
            "score",
            "model_score",
            "heuristic_label",
            "heuristic_reason",
            "ip",
            "blocked",
            "timestamp",
        )
    )
    cut = F.expr("substring(body, 1, 40)")
    return (
        decisions(spark, sf_dir)
        .withColumn("body", body)
        .select(
            "line_no",
            F.when(eid % 31 == 0, cut).when(eid % 37 == 0, "  ").otherwise(F.col("body")).alias("value"),
        )
    )


def correction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of decisions, several per decision, some truncated."""
    eid = F.col("line_no")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("d"), (eid % 997).cast("string")).alias("decision_id"),
            "features",
            ((eid * 7) % 2).cast("double").alias("label"),
            "timestamp",
        )
    )
    return (
        decisions(spark, sf_dir)
        .withColumn("body", body)
        .select(
            "line_no",
            F.when(eid % 41 == 0, F.expr("substring(body, 1, 25)")).otherwise(F.col("body")).alias(
                "value"
            ),
        )
    )


def tor_exits(spark, sf_dir) -> DataFrame:
    return users(spark, sf_dir).filter("user_id % 17 = 0").select("ip")


def hosting_blocks(spark, sf_dir) -> DataFrame:
    """CIDR texts from the users: hosts, /24 and wider blocks, nested ones, IPv6, bad ones."""
    uid = F.col("user_id")
    text = lambda c: c.cast("string")
    octets = F.concat(
        F.lit("10."), text(F.floor(uid / 256)), F.lit("."), text(uid % 256), F.lit(".0")
    )
    return users(spark, sf_dir).select(
        F.when(uid % 19 == 0, F.concat(octets, F.lit("/24")))
        .when(uid % 23 == 0, F.concat(octets, F.lit("/22")))
        .when(uid % 29 == 0, F.concat("ip", F.lit("/32")))
        .when(uid % 31 == 0, F.concat(F.lit("2001:db8:"), F.lower(F.hex(uid)), F.lit("::/48")))
        .when(uid % 37 == 0, F.concat(octets, F.lit("/99")))
        .alias("cidr")
    ).filter(F.col("cidr").isNotNull())


HOSTING_SQL = """
hosting AS (
  SELECT n, len FROM (
    SELECT (10::BIGINT << 24) + (user_id // 256 << 16) + (user_id % 256 << 8)
        + CASE WHEN user_id % 19 <> 0 AND user_id % 23 <> 0 THEN 7 ELSE 0 END AS n,
      CASE WHEN user_id % 19 = 0 THEN 24 WHEN user_id % 23 = 0 THEN 22
           WHEN user_id % 29 = 0 THEN 32 END AS len
    FROM (SELECT DISTINCT user_id FROM req)) WHERE len IS NOT NULL),
hosted AS (
  SELECT DISTINCT u.ip FROM (SELECT DISTINCT ip, user_id,
    (10::BIGINT << 24) + (user_id // 256 << 16) + (user_id % 256 << 8) + 7 AS n FROM req) u
  JOIN hosting h ON u.n >> (32 - h.len) = h.n >> (32 - h.len))"""


def abuse_cache(spark, sf_dir) -> DataFrame:
    """(ip, score, ts): a score per client of two in three, half of them old."""
    uid = F.col("user_id")
    ts = F.timestamp_micros(
        F.lit(1_706_000_000_000_000) - F.when(uid % 2 == 0, F.lit(90_000_000_000)).otherwise(uid * 1_000_000)
    )
    return users(spark, sf_dir).filter("user_id % 3 <> 0").select(
        "ip", ((uid * 37) % 101).cast("double").alias("score"), ts.alias("ts")
    )


def submissions_of(requests: DataFrame) -> DataFrame:
    """(ip, hash, ts_us, seq): a fingerprint after every request; some are bad."""
    uid, eid = F.col("user_id"), F.col("line_no")
    good = F.sha2((uid % 10 + F.when(eid % 11 == 0, 50).otherwise(0)).cast("string"), 256)
    late = F.when(eid % 7 == 0, F.lit(1_900_000_000)).otherwise(F.lit(500_000))
    return requests.select(
        "ip",
        F.when(eid % 13 == 0, "not-a-hash").otherwise(good).alias("hash"),
        (F.col("ts_us") + late).alias("ts_us"),
        eid.alias("seq"),
    )


def submissions(spark, sf_dir) -> DataFrame:
    return submissions_of(requests_of(spark, sf_dir))


SUBMISSIONS_SQL = """
subs AS (
  SELECT ip, CASE WHEN line_no % 13 = 0 THEN 'not-a-hash' ELSE sha256(CAST(user_id % 10 +
      CASE WHEN line_no % 11 = 0 THEN 50 ELSE 0 END AS VARCHAR)) END AS hash,
    ts_us + CASE WHEN line_no % 7 = 0 THEN 1900000000 ELSE 500000 END AS ts_us, line_no AS seq
  FROM req)"""


def feature_rows(spark, sf_dir) -> DataFrame:
    """The archived vectors as a labelled dataset."""
    uid = F.col("user_id")
    bot = (uid % 8).isin(0, 1, 4) | (uid % 11 == 5)
    return decisions(spark, sf_dir).select(
        *[F.col("features")[i].alias(f) for i, f in enumerate(FEATURES)],
        F.when(bot, 1.0).otherwise(0.0).alias("label"),
        "ip",
        "user_id",
        F.col("ip").alias("group_id"),
        F.concat(F.when(bot, "bot_source_").otherwise("human_source_"), (uid % 2).cast("string")).alias(
            "provenance"
        ),
        F.to_date("ts").cast("string").alias("day"),
        (uid % 3 + 1).alias("seed"),
        F.concat(F.lit("L"), (uid % 4).cast("string")).alias("level"),
        "line_no",
    )


DATASET_SQL = f"""
ds AS (
  SELECT {', '.join(f'features[{i + 1}] AS {f}' for i, f in enumerate(FEATURES))},
    CASE WHEN user_id % 8 IN (0, 1, 4) OR user_id % 11 = 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS label,
    ip, user_id, ip AS group_id,
    CASE WHEN user_id % 8 IN (0, 1, 4) OR user_id % 11 = 5 THEN 'bot_source_'
      ELSE 'human_source_' END || (user_id % 2) AS provenance,
    CAST(CAST(make_timestamp(ts_us) AS DATE) AS VARCHAR) AS day,
    user_id % 3 + 1 AS seed, 'L' || (user_id % 4) AS level, line_no
  FROM dec)"""


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ip, score, label): documents as scored items, their quality label as truth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("ip"),
        ((F.col("n_chars") % 211) / F.lit(211.0)).alias("score"),
        F.col("quality").alias("label"),
    )


SCORES_SQL = """
sc AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS ip, (n_chars % 211) / 211.0::DOUBLE AS score,
    quality AS label
  FROM documents d JOIN labels l USING (doc_id))"""


# --- clients that behave as one rule describes ---------------------------------------------------

#: Name of the behaviour and how many requests a client of it sends.
SCENARIOS = [
    ("UNIFORM_TIMING", 8), ("HTTP10", 7), ("CDN_BYPASS", 3), ("PROTECTED_SCAN", 4), ("ATTACK_TOOL", 3), ("BOTNET", 6),
    ("DIR_BRUTE", 40), ("UA_ROTATION", 9), ("SAME_ENDPOINT", 12), ("HIGH_RATE", 20), ("REPEATED_PATH", 40), ("CRED_PARAM", 6),
    ("CRED_BRUTE", 12), ("POST_BRUTE", 20), ("BURST", 40), ("ERROR_RATE", 14), ("SCANNER_PATH", 2), ("UNKNOWN_UA", 7),
    ("NO_REFERER", 25), ("BROWSER_OK", 9), ("INTEGRATION", 2), ("EXPLORING", 6), ("REFERER_CHAIN", 4), ("VARIABLE_TIMING", 5),
    ("DEFAULT", 1), ("KNOWN_BOT_UA", 2), ("NIGHT", 35),
]
#: Two events in a thousand become clients of very many requests.
RARE = [("RAW_VOLUME", 2001), ("PAGES_100", 120)]

_NAMES = "array(" + ", ".join(f"'{n}'" for n, _ in SCENARIOS) + ")"
_SIZES = "array(" + ", ".join(str(k) for _, k in SCENARIOS) + ")"
# Columns of a request by behaviour ``s`` and number ``i``, as SQL that both engines read.
_OFFSET_US = """CASE s WHEN 'UNIFORM_TIMING' THEN i * 10000000 WHEN 'HIGH_RATE' THEN i * 500000 + (i * i % 3) * 90000
    WHEN 'BURST' THEN i * 10000 + (i * i % 3) * 3000 WHEN 'CRED_BRUTE' THEN i * 10000000 + (i * i % 7) * 1000000
    WHEN 'RAW_VOLUME' THEN i * 200000 + (i * i % 7) * 20000 WHEN 'PAGES_100' THEN i * 4000000 + (i * i % 7) * 100000
    WHEN 'VARIABLE_TIMING' THEN CASE WHEN i = 4 THEN 900000000 ELSE i * 1000000 END
    WHEN 'BROWSER_OK' THEN i * 20000000 + (i * i % 7) * 1700000
    ELSE i * 20000000 + (i * i % 7) * 1700000 END"""
_URL = """CASE s WHEN 'PROTECTED_SCAN' THEN concat('/dashboard/', i) WHEN 'BOTNET' THEN CASE WHEN i % 2 = 0 THEN '/device' ELSE concat('/p', i) END
    WHEN 'SAME_ENDPOINT' THEN '/only.html' WHEN 'REPEATED_PATH' THEN CASE WHEN i % 10 = 0 THEN concat('/p', i, '.html') ELSE '/same.html' END
    WHEN 'CRED_PARAM' THEN concat('/x', i % 4, '?api_key=', i) WHEN 'CRED_BRUTE' THEN concat('/login', i % 3)
    WHEN 'POST_BRUTE' THEN concat('/login', i % 3) WHEN 'RAW_VOLUME' THEN concat('/image/', i % 50, '.png')
    WHEN 'SCANNER_PATH' THEN '/.git/config' WHEN 'REFERER_CHAIN' THEN concat('/p', i % 2, '.html')
    WHEN 'VARIABLE_TIMING' THEN concat('/p', i % 2, '.html') ELSE concat('/p', i % 9, '.html') END"""
_AGENT = f"""CASE s WHEN 'CDN_BYPASS' THEN 'Sucuri proxy' WHEN 'ATTACK_TOOL' THEN 'Wapiti/3.0' WHEN 'UA_ROTATION' THEN concat('{CHROME}', i)
    WHEN 'UNKNOWN_UA' THEN 'CustomAgent/1.0' WHEN 'INTEGRATION' THEN 'Stripe/1.0 (webhooks)' WHEN 'KNOWN_BOT_UA' THEN 'curl/8.0'
    WHEN 'EXPLORING' THEN '-' WHEN 'REFERER_CHAIN' THEN '-' WHEN 'VARIABLE_TIMING' THEN '-' WHEN 'DEFAULT' THEN '-' ELSE '{CHROME}' END"""
_REFERER = """CASE WHEN s IN ('PROTECTED_SCAN', 'NO_REFERER', 'DEFAULT') THEN '-' ELSE 'https://shop.example/' END"""
_STATUS = "CASE WHEN s = 'DIR_BRUTE' AND i % 10 < 8 THEN 404 WHEN s = 'ERROR_RATE' AND i % 10 < 6 THEN 500 ELSE 200 END"
_START_US = f"{1_704_067_200_000_000} + (CASE WHEN s = 'NIGHT' THEN 10800 ELSE 43200 END + event_id % 300) * 1000000"


def scenario_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a client of its own that behaves as one rule describes; the source of the
    remaining rules, which the first mapping never reaches."""
    # an id gives many requests, so ids are dealt to all cores, however few parts the file has
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").repartition("event_id")
    rare = "CASE event_id % 1000 WHEN 7 THEN '{}' WHEN 8 THEN '{}' END".format(*(n for n, _ in RARE))
    size = "CASE event_id % 1000 WHEN 7 THEN {} WHEN 8 THEN {} END".format(*(k for _, k in RARE))
    place = f"int(event_id % {len(SCENARIOS)})"
    clients = events.selectExpr(
        "event_id", f"coalesce({rare}, {_NAMES}[{place}]) AS s", f"coalesce({size}, {_SIZES}[{place}]) AS n"
    ).selectExpr("*", "explode(sequence(0L, n - 1L)) AS i")
    rows = clients.selectExpr(
        "concat('172.', event_id div 65536, '.', event_id div 256 % 256, '.', event_id % 256) AS ip",
        f"{_START_US} + {_OFFSET_US} AS ts_us",
        "IF(s = 'POST_BRUTE', 'POST', 'GET') AS method",
        f"{_URL} AS url", f"{_STATUS} AS status", "1234L AS size", f"{_REFERER} AS referer", f"{_AGENT} AS user_agent",
        "IF(s = 'HTTP10', 'GET / HTTP/1.0', 'GET / HTTP/1.1') AS raw_line",
        "'' AS src_file", "0L AS src_block", "event_id * 10000 + i AS line_no",
    )
    ts = F.timestamp_micros("ts_us")
    return rows.withColumn("ts", ts).withColumn("local_hour", F.hour("ts")).withColumn("local_date", F.to_date("ts"))


SCENARIO_SQL = f"""
clients AS (SELECT event_id, s, unnest(range(n)) AS i FROM (
  SELECT event_id, CASE event_id % 1000 WHEN 7 THEN '{RARE[0][0]}' WHEN 8 THEN '{RARE[1][0]}'
      ELSE [{", ".join(f"'{n}'" for n, _ in SCENARIOS)}][1 + event_id % {len(SCENARIOS)}] END AS s,
    CASE event_id % 1000 WHEN 7 THEN {RARE[0][1]} WHEN 8 THEN {RARE[1][1]}
      ELSE [{", ".join(str(k) for _, k in SCENARIOS)}][1 + event_id % {len(SCENARIOS)}] END AS n FROM events)),
req AS (
  SELECT *, make_timestamp(ts_us) AS ts, hour(make_timestamp(ts_us)) AS local_hour, split_part(url, '?', 1) AS path
  FROM (SELECT '172.' || (event_id // 65536) || '.' || (event_id // 256 % 256) || '.' || (event_id % 256) AS ip,
    {_START_US} + {_OFFSET_US} AS ts_us, CASE WHEN s = 'POST_BRUTE' THEN 'POST' ELSE 'GET' END AS method,
    {_URL} AS url, {_STATUS} AS status, {_REFERER} AS referer, {_AGENT} AS user_agent,
    CASE WHEN s = 'HTTP10' THEN 'GET / HTTP/1.0' ELSE 'GET / HTTP/1.1' END AS raw_line, event_id * 10000 + i AS line_no
    FROM clients))"""
