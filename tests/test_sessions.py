"""Sessions, features and order-dependent operators against brute force in Python."""

import math
import random
import re
from collections import Counter
from datetime import timedelta

import pytest
from conftest import START, Log
from pyspark.sql import functions as F

from trafficlens.operators import features as FT
from trafficlens.operators import sessions as SS


def brute_sessions(rows, timeout_s):
    """rows: (ip, ts_us, line_no, ...) -> lists of rows per session."""
    open_, out = {}, []
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        current = open_.get(row[0])
        if current is None or row[1] - current[-1][1] > timeout_s * 1_000_000:
            current = open_[row[0]] = []
            out.append(current)
        current.append(row)
    return out


@pytest.fixture(scope="module")
def dense(spark):
    """One client holds half of the rows, with ties, bursts and exact-timeout gaps."""
    rng = random.Random(5)
    log = Log()
    at = {"hot": 0.0, "a": 3.0, "b": 900.0, "c": 0.0}
    for _ in range(1500):
        ip = "hot" if rng.random() < 0.6 else rng.choice("abc")
        step = rng.choice([0, 0, 1, 2, 5, 11, 12, 13, 59, 60, 61, 290, 300, 310, 1800, 1801])
        at[ip] += step
        url = rng.choice(["/", "/p/1.html", "/p/2.html?x=1", "/a.png", "/b", "/c/"])
        log.add(at[ip], url, ip=ip, status=rng.choice([200, 200, 404, 500]), ua=rng.choice(["x", "y"]))
    return log


def test_timeout_equality_does_not_break(spark, log):
    log.add(0).add(1800).add(3600.000001)
    got = SS.sessionize(log.table(spark)).orderBy("line_no").collect()
    assert [r.session_no for r in got] == [1, 1, 2]
    assert [r.gap_s for r in got] == [None, 1800.0, None]


@pytest.mark.parametrize("timeout_s", [60, 300, 1800])
def test_sessionize_matches_brute_force(spark, dense, timeout_s):
    rows = [(r[0], int(r[1].timestamp() * 1_000_000), r[12]) for r in dense.rows]
    expected = {}
    per_ip = Counter()
    position = Counter()
    for session in brute_sessions(rows, timeout_s):
        per_ip[session[0][0]] += 1
        for i, row in enumerate(session):
            expected[row[2]] = (per_ip[row[0]], i + 1)
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        position[row[0]] += 1
        expected[row[2]] += (position[row[0]],)
    got = SS.sessionize(dense.table(spark), timeout_s=timeout_s).collect()
    assert {r.line_no: (r.session_no, r.session_pos, r.pos) for r in got} == expected


def brute_features(session, rows):
    """The time-dependent features of one session."""
    ts = [r[1] for r in session]
    gaps = [(b - a) / 1e6 for a, b in zip(ts, ts[1:])]
    mean = sum(gaps) / len(gaps) if gaps else 0.0
    cv = 0.0
    if len(gaps) >= 2 and mean:
        cv = math.sqrt(sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1)) / mean
    urls = [rows[r[2]][4] for r in session]
    views = [t for t, u in zip(ts, urls) if u.endswith(".html") or u.endswith("/")]
    best = 0
    if len(views) >= 2:
        best = max(sum(1 for t in views[i:] if t - v <= 12_000_000) for i, v in enumerate(views))
    paths = Counter(u.split("?")[0] for u in urls)
    top = paths.most_common(1)[0]
    return (
        round(mean, 6), round(cv, 6), sum(1 for t in ts if ts[-1] - t <= 60_000_000),
        sum(1 for t in ts if ts[-1] - t <= 300_000_000), round(best / 12, 6), top[0], top[1],
        round(-sum(c / len(urls) * math.log2(c / len(urls)) for c in paths.values()) + 0.0, 6),
    )


def as_tuple(r):
    return (
        round(r.time_since_last_request, 6), round(r.inter_request_time_cv, 6),
        int(r.requests_per_minute_1m), int(r.requests_per_minute_5m),
        round(r.max_sustained_click_rate, 6), r.top_endpoint, r.top_hits,
        round(r.endpoint_sequence_entropy, 6),
    )


@pytest.mark.parametrize("timeout_s", [60, 1800])
def test_features_match_brute_force(spark, dense, timeout_s, monkeypatch):
    monkeypatch.setattr(FT, "ROWS_PER_SALT", 50)  # large sessions take several salts
    rows = [(r[0], int(r[1].timestamp() * 1_000_000), r[12]) for r in dense.rows]
    expected = Counter(
        (s[0][0], s[0][1], *brute_features(s, dense.rows)) for s in brute_sessions(rows, timeout_s)
    )
    got = FT.session_features(dense.table(spark), timeout_s=timeout_s).collect()
    assert Counter((r.ip, r.start_us, *as_tuple(r)) for r in got) == expected


def test_sessions_by_agent_keep_agents_apart(spark, dense):
    rows = FT.session_features(dense.table(spark), keys=("ip", "user_agent"))
    assert rows.filter("agents <> 1").isEmpty()


def test_rate_limit_matches_brute_force(spark, dense):
    rows = sorted((r[0], int(r[1].timestamp() * 1e6), r[12]) for r in dense.rows)
    expected = {}
    for ip in {r[0] for r in rows}:
        times = [t for i, t, _ in sorted(rows, key=lambda r: (r[1], r[2])) if i == ip]
        recent = []
        for i, t in enumerate(times, 1):
            recent = [x for x in recent if t - x < 30_000_000] + [t]
            if len(recent) > 6:
                expected[ip] = i
                break
    got = SS.rate_limited(dense.table(spark), limit=6, window_s=30).collect()
    assert expected and {r.ip: r.first_flag for r in got} == expected


def test_retained_history_is_bounded_and_ordered(spark, dense):
    item = [F.col("line_no").alias("line_no"), F.col("ts_us").alias("ts_us")]
    got = SS.retained_history(dense.table(spark), item, keep=7, block=10).collect()
    rows = [(r[0], int(r[1].timestamp() * 1_000_000), r[12]) for r in dense.rows]
    expected = {
        row[2]: [x[2] for x in s[max(0, i - 6) : i + 1]]
        for s in brute_sessions(rows, 1800)
        for i, row in enumerate(s)
    }
    assert {r.history[-1].line_no: [h.line_no for h in r.history] for r in got} == expected


def test_a_request_is_shuffled_once(spark, log):
    log.many(50, every=20, url=lambda i: f"/p{i}.html")
    entries = FT._entries(FT._flagged(log.table(spark), ["ip"]), ["ip"], 300)
    assert entries.count() == 50 + 4  # four views follow the start of a slice within twelve seconds
    smap = SS.sessions_of_slices(FT._slices(entries, ["ip"]), ["ip"])
    counts = FT._session_counts(FT._with_bursts_and_gaps(entries, smap, ["ip"]), ["ip"])
    # paths differ, the agent and the status come along with them; one more for the views of a slice
    assert counts.filter("n > 0").count() == 50 and counts.count() == 50 + 4
    row = FT.session_features(log.table(spark)).first()
    assert (row.requests, row.endpoint_count, row.requests_per_minute_1m) == (50, 50.0, 4.0)


def test_history_inputs_agree_with_session_inputs(spark, log):
    log.many(60, every=lambda i: i * 3 + i % 4, url=lambda i: f"/p/{i % 9}.html" if i % 3 else "/x.css",
             status=lambda i: 404 if i % 4 == 0 else 200)
    table = log.table(spark)
    whole = FT.session_features(table).first()
    items = SS.retained_history(table, FT.history_item(), keep=200)
    last = FT.with_features(FT.history_inputs(items, "first")).filter("session_pos = 60").first()
    for name in [*FT.feature_columns(), "pages", "night_pages", "top_endpoint", "max_gap_us", "min_gap_us"]:
        a, b = whole[name], last[name]
        assert a == pytest.approx(b, abs=1e-9) if isinstance(a, float) else a == b, name


def test_result_does_not_depend_on_partitioning(spark, dense):
    table = dense.table(spark)
    key = lambda df: sorted(
        (r.ip, r.session_no, *as_tuple(r)) for r in FT.session_features(df).collect()
    )
    assert key(table.repartition(1)) == key(table.repartition(7, "line_no"))


def test_exact_local_hour_is_used(spark, log):
    log.add(0, start=START + timedelta(hours=0)).add(1)
    night = log.table(spark).withColumn("local_hour", F.lit(3))
    assert FT.session_features(night).first().night_ratio == 1.0


def test_a_scan_reads_its_source_once(spark, small, tmp_path):
    """Session map and rows come from one exchange, for a table and for log text."""
    from trafficlens.functions.scoring import load_network
    from trafficlens.plans.scan import scan_sessions, scan_summary
    from trafficlens.sources.adapters import combined_line, requests_of
    from trafficlens.sources.logs import read_access_log

    requests = requests_of(spark, small)
    requests.select(combined_line().alias("value")).write.text(str(tmp_path / "log"))
    log = read_access_log(spark, str(tmp_path / "log"), "nginx")
    for source, kind in ((requests, "parquet"), (log, "text")):
        summary = scan_summary(scan_sessions(source, load_network()))
        assert summary.collect()[0].total_entries == requests.count()
        plan = summary._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count(f"FileScan {kind}") == 1 and "ReusedExchange" in plan


def test_tasks_grow_with_the_requests(spark, log, monkeypatch, capsys):
    log.many(600, every=9.0, ip=lambda i: f"10.0.0.{i % 7}")
    want = sorted(map(str, FT.session_inputs(log.table(spark)).collect()))
    monkeypatch.setattr(FT, "ROWS_PER_TASK", 20)
    inputs = FT.session_inputs(log.table(spark))
    inputs.explain()
    plan = capsys.readouterr().out
    # both shuffles of requests and of their counts, at a number that adaptive execution keeps
    assert plan.count(", 30), REPARTITION_BY_NUM") >= 2
    assert sorted(map(str, inputs.collect())) == want


def test_tasks_of_the_session_map_grow_with_the_requests(spark, log, monkeypatch, capsys):
    log.many(600, every=9.0, ip=lambda i: f"10.0.0.{i % 7}")
    monkeypatch.setattr(FT, "ROWS_PER_TASK", 20)
    FT.session_inputs(log.table(spark)).explain()
    plan = capsys.readouterr().out
    # the windows over all slices of a client
    assert re.search(r"hashpartitioning\(ip#\d+, 30\), REPARTITION_BY_NUM", plan)


def test_tasks_stay_few_enough_to_write_without_sorting(spark, log, monkeypatch):
    requests = log.many(450, every=9.0).table(spark)
    monkeypatch.setattr(FT, "ROWS_PER_TASK", 2)
    assert FT._tasks(requests) == 200
    # very large inputs: the number of rows a task is bounded as well
    monkeypatch.setattr(FT, "MOST_ROWS_PER_TASK", 2)
    assert FT._tasks(requests) == 225
