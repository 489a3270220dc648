"""Time the headline queries and the full scan of log text; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from trafficlens.functions.scoring import load_network
from trafficlens.plans.catalog import QUERIES
from trafficlens.plans.scan import scan_sessions, scan_summary
from trafficlens.session import spark_session
from trafficlens.sources.adapters import combined_line, requests_of
from trafficlens.sources.logs import read_access_log

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
COPIES = int(os.environ.get("BENCH_COPIES", "10"))

HEADLINE = [
    "scan_summary",
    "session_features",
    "session_rules",
    "sessionized_requests",
    "sessions_native_window",
    "rate_limit_first_flag",
    "parsed_nginx_lines",
    "reputation",
    "page_view_gaps",
    "live_actors",
    "detector_verdicts",
    "ladder_cells",
    "roc_curve",
    "leakage",
    "decision_stats",
]


def run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def write_log(spark, copies: int) -> str:
    """The requests as combined-format text, ``copies`` times with shifted clients."""
    path = os.path.join(tempfile.mkdtemp(prefix="bench-log-"), "log")
    copy = F.explode(F.sequence(F.lit(1), F.lit(copies)))
    shifted = F.concat((F.lit(10) + F.col("copy")).cast("string"), F.expr("substring(ip, 3)"))
    rows = requests_of(spark, SF_DIR).withColumn("copy", copy).withColumn("ip", shifted)
    rows.repartition(CPUS * 2).sortWithinPartitions("ts").select(
        combined_line().alias("value")
    ).write.text(path)
    return path


def main() -> None:
    spark = spark_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": str(CPUS),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    network = load_network()
    scan = lambda path: scan_summary(scan_sessions(read_access_log(spark, path, "nginx"), network))
    one, many = write_log(spark, 1), write_log(spark, COPIES)
    lines = spark.read.text(one).count()

    seconds = {}
    run(QUERIES["scan_summary"](spark, SF_DIR))  # compile once before timing
    run(scan(one))
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, SF_DIR))
        seconds[name] = round(time.perf_counter() - start, 3)
    for label, path in (("scan_log_text", one), (f"scan_log_text_x{COPIES}", many)):
        start = time.perf_counter()
        run(scan(path))
        seconds[label] = round(time.perf_counter() - start, 3)

    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": CPUS,
                "lines_per_sec": {
                    "scan_log_text": round(lines / seconds["scan_log_text"]),
                    f"scan_log_text_x{COPIES}": round(
                        lines * COPIES / seconds[f"scan_log_text_x{COPIES}"]
                    ),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
