import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from trafficlens.session import spark_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
BROWSER = (
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 "
    "(KHTML, like Gecko) Chrome/111.0.0.0 Safari/537.36"
)
PLAIN = "SomeClient/1.0"
START = datetime(2023, 3, 24, 12, 0, 0, tzinfo=timezone.utc)
COLUMNS = (
    "ip string, ts timestamp, local_hour int, method string, url string, status int, "
    "size bigint, referer string, user_agent string, raw_line string, src_file string, "
    "src_block bigint, line_no bigint"
)


@pytest.fixture(scope="session")
def spark():
    session = spark_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


class Log:
    """Builds a request table row by row."""

    def __init__(self):
        self.rows = []

    def add(self, at=0.0, url="/products", ip="192.168.1.1", ua=BROWSER, method="GET", status=200,
            referer="https://example.com/", raw_line="", start=START):
        ts = start + timedelta(seconds=at)
        self.rows.append(
            (ip, ts, ts.hour, method, url, status, 1234, referer, ua, raw_line, "", 0, len(self.rows))
        )
        return self

    def many(self, count, every=1.0, url="/products", **options):
        pick = lambda v, i: v(i) if callable(v) else v
        for i in range(count):
            at = every(i) if callable(every) else i * every
            self.add(at, pick(url, i), **{k: pick(v, i) for k, v in options.items()})
        return self

    def table(self, spark):
        return spark.createDataFrame(self.rows, COLUMNS)


@pytest.fixture
def log():
    return Log()
