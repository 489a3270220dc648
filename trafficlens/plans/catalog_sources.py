"""Registered queries: parsers, archives, feeds, day tables, exports."""

import uuid

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scoring as S
from ..session import shared_folder
from ..sources import archive, days, derived, exports, feeds, logs
from ..sources.adapters import combined_line, requests_of
from ..sources.derived import DECISIONS_SQL
from . import oracle_base as B
from .registry import Registry, rounded
from .scan import scan_sessions

sources = Registry()


def as_lines(requests, value):
    return requests.select(
        value.alias("value"), F.lit("one.log").alias("src_file"), F.lit(0).cast("long").alias("src_block"),
        "line_no",
    )


def parsed_columns(df):
    return df.select(
        "line_no", "ip", F.unix_micros("ts").alias("ts_us"), "local_hour",
        F.col("local_date").cast("string").alias("local_date"), "method", "url", "status", "size",
        "referer", "user_agent",
    )


@sources.query(
    "parsed_nginx_lines",
    B.over_requests(
        """SELECT line_no, ip, ts_us // 1000000 * 1000000 AS ts_us, local_hour::INT AS local_hour,
        CAST(local_date AS VARCHAR) AS local_date, method, url, status::INT AS status,
        CASE WHEN line_no % 17 = 0 THEN 0 ELSE size END AS size, referer, user_agent
        FROM req WHERE line_no % 23 <> 0"""
    ),
    "A1 A3",
)
def _(spark, sf):
    line = F.col("raw_line")
    dashed = F.regexp_replace(line, r'" ([0-9]{3}) [0-9]+ "', '" $1 - "')
    value = (
        F.when(F.col("line_no") % 23 == 0, F.regexp_replace(line, '"', ""))
        .when(F.col("line_no") % 17 == 0, dashed)
        .otherwise(line)
    )
    return parsed_columns(logs.parse_nginx(as_lines(requests_of(spark, sf), value)))


@sources.query(
    "scanned_log_files",
    B.over_requests(
        """SELECT line_no % 4 AS kind, count(*)::BIGINT AS requests, count(DISTINCT ip)::BIGINT AS clients,
        sum(status)::BIGINT AS status_sum, sum(size)::BIGINT AS size_sum,
        sum(length(user_agent) + CASE WHEN line_no % 4 = 3 THEN 2 ELSE 0 END)::BIGINT AS agent_chars,
        min(ts_us // 1000000 * 1000000) AS first_us, max(ts_us // 1000000 * 1000000) AS last_us
        FROM req GROUP BY ALL"""
    ),
    "A1 A2 A3 A4 A5",
)
def _(spark, sf):
    """All requests written to log files of four kinds and read back without naming a format.

    Plain lines; gzipped ones with white space around; JSON; agents that hold the byte 1, among
    forged lines that hold nothing but fields parted by it.
    """
    rows = requests_of(spark, sf)
    folder = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    as_json = F.to_json(
        F.struct(
            F.col("ip").alias("remote_addr"), F.col("method").alias("request_method"),
            F.col("url").alias("request_uri"), "status", F.col("size").alias("body_bytes_sent"),
            F.col("referer").alias("http_referer"), F.col("user_agent").alias("http_user_agent"),
            F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss +0000").alias("time_local"),
        )
    )
    odd = rows.withColumn("user_agent", F.concat("user_agent", F.lit("\x01x")))
    forged = F.concat_ws("\x01", "ip", F.lit("01/Jan/2024:00:00:00 +0000"), F.lit("GET"), "url", F.lit("200"), F.lit("1"), F.lit("-"), F.lit("-"))
    lines = [
        rows.select("line_no", combined_line().alias("value")),
        rows.select("line_no", F.concat(F.lit("\t "), combined_line(), F.lit("\u00a0")).alias("value")),
        rows.select("line_no", as_json.alias("value")),
        odd.select("line_no", F.explode(F.array(combined_line(), forged)).alias("value")),
    ]
    paths = [f"{folder}/kind{kind}" for kind in range(4)]
    for kind, (part, path) in enumerate(zip(lines, paths, strict=True)):
        part = part.where(F.col("line_no") % 4 == kind).select("value")
        part.write.text(path, compression="gzip" if kind == 1 else "none")
    read = logs.read_access_log(spark, paths)
    return read.groupBy(F.regexp_extract("src_file", "/kind([0-9])/", 1).cast("long").alias("kind")).agg(
        F.count("*").alias("requests"), F.countDistinct("ip").alias("clients"),
        F.sum("status").alias("status_sum"), F.sum("size").alias("size_sum"),
        F.sum(F.length("user_agent")).alias("agent_chars"),
        F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"),
    )


@sources.query(
    "parsed_json_lines",
    B.over_requests(
        """SELECT line_no, ip, CASE WHEN line_no % 10 = 9 THEN 0 ELSE ts_us // 1000000 * 1000000 END
          AS ts_us,
        CASE WHEN line_no % 10 = 9 THEN 0 ELSE local_hour::INT END AS local_hour,
        CASE WHEN line_no % 10 = 9 THEN '1970-01-01' ELSE CAST(local_date AS VARCHAR) END AS local_date,
        method, url, CASE WHEN line_no % 6 = 0 THEN 200 ELSE status::INT END AS status,
        size, referer, CASE WHEN line_no % 3 = 0 THEN '' ELSE user_agent END AS user_agent
        FROM req WHERE line_no % 19 <> 0"""
    ),
    "A4",
)
def _(spark, sf):
    eid = F.col("line_no")
    log_time = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0000'")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    first = F.to_json(
        F.struct(
            F.col("ip").alias("remote_addr"),
            F.when(eid % 10 == 9, "soon").otherwise(log_time).alias("time_local"),
            F.lower("method").alias("method"),
            "url",
            F.when(eid % 6 == 0, 0).otherwise(F.col("status")).alias("status"),
            F.col("size").cast("string").alias("body_bytes_sent"),
            F.lit("").alias("http_referer"),
            "referer",
        )
    )
    second = F.to_json(
        F.struct(
            F.lit("").alias("remote_addr"),
            "ip",
            F.when(eid % 10 == 9, "").otherwise(iso).alias("timestamp"),
            F.col("method").alias("request_method"),
            F.col("url").alias("request_uri"),
            F.when(eid % 6 == 0, "n/a").otherwise(F.col("status").cast("string")).alias("response_code"),
            F.lit(False).alias("body_bytes_sent"),
            F.col("size").alias("bytes"),
            "referer",
            F.col("user_agent").alias("ua"),
        )
    )
    third = F.to_json(
        F.struct(
            F.col("ip").alias("client_ip"),
            F.when(eid % 10 == 9, "x").otherwise(plain).alias("@timestamp"),
            F.col("method").alias("request_method"),
            F.col("url").alias("uri"),
            F.when(eid % 6 != 0, F.col("status")).alias("status"),
            F.col("size").cast("double").alias("size"),
            "referer",
            "user_agent",
        )
    )
    value = (
        F.when(eid % 19 == 0, F.when(eid % 2 == 0, "[1, 2]").otherwise('{"ip": '))
        .when(eid % 3 == 0, first)
        .when(eid % 3 == 1, second)
        .otherwise(third)
    )
    lines = as_lines(requests_of(spark, sf), value)
    return parsed_columns(logs.parse_json(lines, default_ts=F.timestamp_micros(F.lit(0))))


@sources.query(
    "detected_formats",
    """SELECT 'f' || k || '.log' AS src_file, CASE WHEN k < 12 THEN 'nginx' WHEN k < 19 THEN 'json'
       ELSE 'unknown' END AS fmt FROM (SELECT DISTINCT event_id % 20 AS k FROM events)""",
    "A2",
)
def _(spark, sf):
    k = F.col("line_no") % 20
    as_json = F.to_json(F.struct("ip", "url"))
    # The first lines of some files are blank or junk; one file holds nothing readable.
    value = (
        F.when((F.col("line_no") < 60) & (k % 2 == 0), "   ")
        .when(k < 12, F.col("raw_line"))
        .when(k < 19, as_json)
        .otherwise("nothing to see")
    )
    lines = requests_of(spark, sf).select(
        value.alias("value"),
        F.concat(F.lit("f"), k.cast("string"), F.lit(".log")).alias("src_file"),
        F.lit(0).cast("long").alias("src_block"),
        "line_no",
    )
    return logs.detect_formats(lines)


@sources.query(
    "request_json_round_trip",
    B.over_requests(
        """SELECT line_no, ip, ts_us, local_hour::INT AS local_hour, CAST(local_date AS VARCHAR) AS
        local_date, method, url, status::INT AS status, size, referer, user_agent, raw_line FROM req"""
    ),
    "A6",
)
def _(spark, sf):
    back = logs.from_request_json(logs.to_request_json(requests_of(spark, sf)))
    return parsed_columns(back).join(back.select("line_no", "raw_line"), "line_no")


@sources.query(
    "archive_health",
    B.over_requests(
        """SELECT count_if(line_no % 31 <> 0 AND line_no % 29 <> 0)::BIGINT AS rows_read,
        count_if(line_no % 31 = 0 OR line_no % 29 = 0)::BIGINT AS rows_skipped
        FROM req WHERE line_no % 31 = 0 OR line_no % 37 <> 0"""
    ),
    "A8",
)
def _(spark, sf):
    return archive.archive_health(derived.archive_lines(spark, sf))


@sources.query(
    "archive_rows",
    B.over_requests(
        """SELECT decision_id, ip, round(score, 6) AS score, round(model_score, 6) AS model_score,
        heuristic_label, trim(regexp_extract(heuristic_reason, '^[^(:]*')) AS rule_name, blocked,
        round(list_sum(features), 6) AS feature_sum FROM dec
        WHERE line_no % 31 <> 0 AND line_no % 29 <> 0 AND line_no % 37 <> 0""",
        DECISIONS_SQL,
    ),
    "A7 A8 B25",
)
def _(spark, sf):
    from ..functions.text import rule_name

    rows = archive.parse_archive(derived.archive_lines(spark, sf))
    kept = archive.archive_rows(rows).select(
        "decision_id", "ip", "score", "model_score", "heuristic_label",
        rule_name(F.col("heuristic_reason")).alias("rule_name"), "blocked",
        F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("feature_sum"),
    )
    return rounded(kept, "score", "model_score", "feature_sum")


@sources.query(
    "latest_corrections",
    """SELECT 'd' || (event_id % 997) AS decision_id,
       arg_max((event_id * 7) % 2, event_id)::DOUBLE AS label, max(event_id)::BIGINT AS seq
       FROM events WHERE event_id % 41 <> 0 GROUP BY 1""",
    "A9",
)
def _(spark, sf):
    lines = derived.correction_lines(spark, sf)
    latest = archive.parse_corrections(lines, F.col("line_no"))
    ids = lines.filter(F.col("line_no") % 41 != 0).groupBy(
        F.get_json_object("value", "$.decision_id").alias("decision_id")
    ).agg(F.max("line_no").alias("seq"))
    return latest.select("decision_id", "label").join(ids, "decision_id")


@sources.query(
    "feedback_rails",
    """WITH c AS (SELECT event_id % 997 AS id, arg_max((event_id * 7) % 2, event_id) AS label
       FROM events WHERE event_id % 41 <> 0 GROUP BY 1)
       SELECT count(*) AS corrections,
       round(greatest(sum(label), count(*) - sum(label)) / count(*), 6) AS majority_share,
       count(*) >= 50 AND greatest(sum(label), count(*) - sum(label)) / count(*) <= 0.9 AS trainable
       FROM c""",
    "E34",
)
def _(spark, sf):
    rows = archive.parse_corrections(derived.correction_lines(spark, sf), F.col("line_no"))
    rails = archive.feedback_rails(rows, P.MIN_CORRECTIONS, P.MAX_CLASS_SHARE)
    return rounded(rails, "majority_share")


CORRECTIONS_SQL = """
corr AS (SELECT 'd' || (line_no % 997) AS decision_id,
  arg_max((line_no * 7) % 2, line_no)::DOUBLE AS corrected_label
  FROM req WHERE line_no % 41 <> 0 GROUP BY 1)"""


@sources.query(
    "matched_corrections",
    B.over_requests(
        """SELECT decision_id, corrected_label, heuristic_label, ip FROM corr JOIN dec USING (decision_id)
        WHERE dec.line_no % 5 <> 0""",
        DECISIONS_SQL,
        CORRECTIONS_SQL,
    ),
    "J15",
)
def _(spark, sf):
    corrections = archive.parse_corrections(derived.correction_lines(spark, sf), F.col("line_no"))
    outages = F.when(F.col("line_no") % 5 != 0, F.col("features"))
    decisions = derived.decisions(spark, sf).withColumn("features", outages)
    matched, _unknown = archive.match_corrections(corrections, decisions)
    return matched.select("decision_id", "corrected_label", "heuristic_label", "ip")


@sources.query(
    "unknown_corrections",
    B.over_requests(
        """SELECT decision_id FROM corr WHERE decision_id NOT IN
        (SELECT decision_id FROM dec WHERE line_no % 5 <> 0)""",
        DECISIONS_SQL,
        CORRECTIONS_SQL,
    ),
    "J15",
)
def _(spark, sf):
    corrections = archive.parse_corrections(derived.correction_lines(spark, sf), F.col("line_no"))
    outages = F.when(F.col("line_no") % 5 != 0, F.col("features"))
    decisions = derived.decisions(spark, sf).withColumn("features", outages)
    return archive.match_corrections(corrections, decisions)[1]


@sources.query(
    "lines_per_day",
    B.over_requests(
        "SELECT CAST(local_date AS VARCHAR) AS local_date, count(*) AS lines FROM req GROUP BY 1"
    ),
    "A10",
)
def _(spark, sf):
    counts = days.lines_per_day(requests_of(spark, sf))
    return counts.withColumn("local_date", F.col("local_date").cast("string"))


@sources.query(
    "parse_rate",
    B.over_requests(
        """SELECT count(*) AS total, count_if(line_no % 100 = 0)::BIGINT AS sampled,
        count_if(line_no % 300 = 0)::BIGINT AS undated,
        round(count_if(line_no % 100 = 0 AND line_no % 300 <> 0) / count_if(line_no % 100 = 0), 6)
          AS parse_rate,
        count_if(line_no % 100 = 0 AND line_no % 300 <> 0) / count_if(line_no % 100 = 0) >= 0.95
          AS acceptable FROM req"""
    ),
    "A10",
)
def _(spark, sf):
    value = F.when(F.col("line_no") % 300 == 0, "no date here").otherwise(F.col("raw_line"))
    lines = requests_of(spark, sf).select(value.alias("value"), "line_no")
    return rounded(days.parse_rate(lines, F.col("line_no") % 100 == 0), "parse_rate")


@sources.query(
    "subset_without_probes",
    B.over_requests(
        f"""SELECT line_no, ip, url, '{P.PLAIN_BROWSER_AGENT}' AS user_agent FROM req
        WHERE user_id % 4 = 1 AND NOT {B.prefixed("path", P.PROBE_PREFIXES)}"""
    ),
    "A11 J2",
)
def _(spark, sf):
    actors = derived.users(spark, sf).filter("user_id % 4 = 1")
    rows = days.subset(
        requests_of(spark, sf), actors, transform=lambda r: days.plain_agent(days.without_probes(r))
    )
    return rows.select("line_no", "ip", "url", "user_agent")


@sources.query(
    "tor_exit_list",
    B.over_requests("SELECT DISTINCT ip FROM req WHERE user_id % 17 = 0"),
    "A12",
)
def _(spark, sf):
    # A list as it arrives: comments, blanks, repeated lines.
    r = requests_of(spark, sf)
    value = F.when(F.col("user_id") % 17 == 0, F.concat(F.lit("  "), "ip")).when(
        F.col("user_id") % 17 == 1, F.concat(F.lit("# "), "ip")
    ).otherwise("")
    return feeds.parse_exit_list(r.select(value.alias("value")))


@sources.query(
    "hosting_feed",
    B.over_requests(
        """SELECT DISTINCT cidr, lpad(bin(n), 32, '0')[1:len] AS prefix FROM (
        SELECT '10.' || (user_id // 256) || '.' || (user_id % 256) || '.0/24' AS cidr, 24 AS len,
          (10::BIGINT << 24) + (user_id // 256 << 16) + (user_id % 256 << 8) AS n
        FROM req WHERE user_id % 5 <> 0)"""
    ),
    "A13",
)
def _(spark, sf):
    uid = F.col("user_id")
    cidr = F.concat(
        F.lit("10."), F.floor(uid / 256).cast("string"), F.lit("."), (uid % 256).cast("string"),
        F.when(uid % 5 == 0, ".0/40").otherwise(".0/24"),
    )
    docs = derived.users(spark, sf).select(
        F.to_json(
            F.struct(
                F.array(F.struct(cidr.alias("ip_prefix"), F.lit("x").alias("region"))).alias("prefixes"),
                F.array(F.struct(F.lit("bad").alias("ipv6_prefix"))).alias("ipv6_prefixes"),
            )
        ).alias("value")
    )
    return feeds.parse_hosting_feed(docs).select("cidr", "prefix").distinct()


@sources.query(
    "crawler_feed",
    B.over_requests(
        """SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'google' ELSE 'bing' END AS engine,
        CASE WHEN user_id % 3 = 0 THEN '2001:db8:' || printf('%x', user_id) || '::/48'
          ELSE ip || '/32' END AS cidr,
        CASE WHEN user_id % 3 = 0 THEN 48 ELSE 32 END AS bits FROM req"""
    ),
    "A14",
)
def _(spark, sf):
    uid = F.col("user_id")
    v6 = F.concat(F.lit("2001:db8:"), F.lower(F.hex(uid)), F.lit("::/48"))
    item = F.struct(
        F.when(uid % 3 != 0, F.concat("ip", F.lit("/32"))).alias("ipv4Prefix"),
        F.when(uid % 3 == 0, v6).alias("ipv6Prefix"),
    )
    docs = derived.users(spark, sf).select(
        F.when(uid % 2 == 0, "google").otherwise("bing").alias("engine"),
        F.to_json(F.struct(F.array(item).alias("prefixes"))).alias("value"),
    )
    return feeds.parse_crawler_feed(docs).select(
        "engine", "cidr", F.length("prefix").alias("bits")
    ).distinct()


@sources.query(
    "reverse_dns",
    B.over_requests(
        """SELECT DISTINCT ip, 'host-' || user_id || '.search.msn.com' AS hostname,
        ip || ',10.9.9.9' AS addresses FROM req"""
    ),
    "A15",
)
def _(spark, sf):
    rows = derived.users(spark, sf).select(
        F.col("ip").alias("client"),
        F.concat(F.lit("Host-"), F.col("user_id").cast("string"), F.lit(".Search.MSN.com")).alias("hostname"),
        F.concat(F.lit("['"), "ip", F.lit("', '10.9.9.9']")).alias("address_list"),
    )
    return feeds.reverse_dns_table(rows).withColumn("addresses", F.array_join("addresses", ",")).drop("place")


@sources.query(
    "nginx_denylist",
    B.over_scored("SELECT DISTINCT 'deny ' || ip || ';' AS value FROM scored WHERE risk = 'DANGER'"),
    "A18 U2",
)
def _(spark, sf):
    return exports.nginx_denylist(scan_sessions(requests_of(spark, sf), S.load_network()))


@sources.query(
    "firewall_expressions",
    B.over_scored(
        """SELECT rule_no::BIGINT AS rule_no, '(ip.src in {' || string_agg(ip, ' ' ORDER BY ip) || '})'
        AS value FROM (
          SELECT ip, (row_number() OVER (ORDER BY ip) - 1) // 10 AS rule_no
          FROM (SELECT DISTINCT ip FROM scored WHERE risk = 'DANGER')) GROUP BY rule_no"""
    ),
    "A18",
)
def _(spark, sf):
    return exports.firewall_expressions(
        scan_sessions(requests_of(spark, sf), S.load_network()), per_rule=10
    )


@sources.query(
    "dataset_counts",
    B.over_requests(
        """SELECT day, provenance AS source, CASE WHEN label > 0.5 THEN 'bot' ELSE 'human' END AS class,
        count(*) AS n FROM ds GROUP BY ALL""",
        DECISIONS_SQL,
        derived.DATASET_SQL,
    ),
    "A20",
)
def _(spark, sf):
    path = f"{shared_folder(spark)}/dataset-{uuid.uuid4().hex}"
    days.write_dataset(derived.feature_rows(spark, sf), path)
    stored = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    return days.dataset_counts(stored)


@sources.query(
    "fixture_sample",
    None,
    "A21",
)
def _(spark, sf):
    r = requests_of(spark, sf)
    labels = r.select(
        F.col("local_date").alias("day"), "ip", (F.col("user_id") % 8).isin(0, 1, 4).alias("is_bot")
    ).distinct()
    return days.sample_fixture(r, labels).select(
        F.col("local_date").cast("string").alias("day"), "ip", "url", "raw_line"
    )


