"""Fingerprints, streams, training and exports end to end on small tables."""

import pytest
from pyspark.sql import functions as F

from trafficlens.functions import scoring as S
from trafficlens.operators import fingerprints as FP
from trafficlens.operators import training as TR
from trafficlens.operators.datasets import group_holdout, leakage, rule_labelled, top_up_size
from trafficlens.plans.catalog import QUERIES
from trafficlens.plans.catalog_datasets import learnable
from trafficlens.plans.scan import scan_sessions
from trafficlens.schema import FEATURES
from trafficlens.sources import archive, days, exports
from trafficlens.sources.adapters import requests_of
from trafficlens.sources.derived import decisions
from trafficlens.streaming import live as L
from trafficlens.streaming.run import drain

HASHES = ["a" * 64, "b" * 64]


def brute_bind(rows, ttl_us):
    held, out = {}, {}
    for ip, value, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        claim = held.get(ip)
        if claim is None or ts - claim[1] > ttl_us:
            held[ip] = (value, ts)
            out[seq] = "ACCEPTED"
        else:
            out[seq] = "REPEAT" if claim[0] == value else "ALREADY_BOUND"
    return out


def test_busy_address_binds_like_a_sequential_pass(spark):
    """One address sends nearly everything, far longer than one claim lasts."""
    rows = [("hot", HASHES[i % 2], i * 37_000_000 + (i % 3), i) for i in range(600)]
    rows += [("cold", HASHES[0], 5_000_000, 1000), ("cold", HASHES[1], 1_805_000_000, 1001),
             ("cold", HASHES[1], 1_805_000_001, 1002)]
    subs = spark.createDataFrame(rows, "ip string, hash string, ts_us bigint, seq bigint")
    requests = subs.select("ip", "ts_us")
    got = {r.seq: r.outcome for r in FP.bind(subs, requests).collect()}
    assert got == brute_bind(rows, 1_800_000_000)


def test_ordinary_addresses_bind_without_leaps(spark, monkeypatch):
    """Settled together, by leaps and in a sequential pass: times shared by several, one repeated."""
    rows = [(f"ip{i % 7}", HASHES[i // 5 % 2], (i // 21) * 400_000_000, i) for i in range(420)]
    schema = "ip string, hash string, ts_us bigint, seq bigint"
    subs = spark.createDataFrame([*rows, rows[3], ("ip0", HASHES[0], 8_400_000_000, None)], schema)
    requests = subs.select("ip", "ts_us")
    monkeypatch.setattr(FP, "FOLDED", 5)
    leapt = sorted(map(str, FP.bind(subs, requests).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(FP, "_leap", lambda *_: pytest.fail("nothing busy here"))
    folded = FP.bind(subs, requests).collect()
    assert sorted(map(str, folded)) == leapt and len(leapt) == len(rows) + 2
    assert {r.seq: r.outcome for r in folded if r.seq is not None} == brute_bind(rows, 1_800_000_000)


def test_explaining_actors_drops_other_columns_of_a_session(spark, small):
    plan = QUERIES["actor_explanations"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    # neither the reason's text nor its arguments
    assert "max_by" in plan and "the address leaves the Tor network" not in plan and "night_pages" not in plan.split("max_by")[1].split("\n")[0]


def test_refusals(spark):
    subs = spark.createDataFrame(
        [("a", "zz", 10, 1), ("a", HASHES[0], 20, 2), ("b", HASHES[0], 30, 3)],
        "ip string, hash string, ts_us bigint, seq bigint",
    )
    requests = spark.createDataFrame([("a", 5), ("b", 40)], "ip string, ts_us bigint")
    got = {r.seq: r.outcome for r in FP.bind(subs, requests).collect()}
    assert got == {1: "BAD_HASH", 2: "ACCEPTED", 3: "NO_SESSION"}


def test_shared_hash_window_is_refreshed(spark):
    minutes = [0, 9, 18, 40, 41]
    rows = [(f"ip{i % 4}", HASHES[0], m * 60_000_000, i) for i, m in enumerate(minutes)]
    table = spark.createDataFrame(rows, "ip string, hash string, ts_us bigint, seq bigint")
    got = {r.seq: r.shared_ips for r in FP.shared_ip_counts(table).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 1, 4: 2}


def split_files(spark, small, path):
    """The requests in time order over several files, as a stream would bring them."""
    rows = requests_of(spark, small).orderBy("ts_us", "line_no").limit(600)
    rows.repartitionByRange(4, "ts_us").write.parquet(path)
    return spark.read.parquet(path)


def test_stream_decides_like_the_replay(spark, small, tmp_path):
    stored = split_files(spark, small, str(tmp_path / "r"))
    network = S.load_network()
    stream = L.stream_request_table(spark, str(tmp_path / "r"), stored.schema)
    columns = ("line_no", "requests", "rule_code", "label", "score")
    key = lambda df: sorted((*r[:4], round(r[4], 9)) for r in df.select(*columns).collect())
    live = key(drain(L.score_stream(stream, network).select(*columns)))
    assert len(live) == 600 and live == key(L.replay(stored, network))


def test_control_holds_from_its_own_time(spark):
    control = spark.createDataFrame(
        [("2024-01-01 00:00:10", 0.6, ["tor", "typo"]), ("2024-01-01 00:00:20", 7.0, None), ("2024-01-01 00:00:30", None, ["fingerprint"]), (None, 0.1, None)],
        "valid_from string, threshold double, promoted array<string>",
    ).withColumn("valid_from", F.col("valid_from").cast("timestamp"))
    rows = spark.range(5).select((F.lit(1_704_067_200_000_000) + F.col("id") * 10_000_000).alias("end_us"))
    got = [(r.threshold, r.wanted) for r in L.controlled(rows, control).orderBy("end_us").collect()]
    assert got == [(0.85, []), (0.6, ["tor"]), (0.85, []), (0.85, ["fingerprint"]), (0.85, ["fingerprint"])]
    assert L.controlled(rows, control.limit(0)).select("threshold").distinct().collect()[0][0] == 0.85


def test_archive_and_days_round_trip(spark, small, tmp_path):
    rows = decisions(spark, small)
    outages = rows.withColumn("features", F.when(F.col("line_no") % 2 == 0, F.col("features")))
    archive.append_archive(outages, str(tmp_path / "a"))
    archive.append_archive(outages.limit(0), str(tmp_path / "a"))
    assert archive.read_archive(spark, str(tmp_path / "a")).count() == rows.filter("line_no % 2 = 0").count()
    requests = requests_of(spark, small)
    days.write_days(requests, str(tmp_path / "d"))
    assert days.read_days(spark, str(tmp_path / "d")).count() == requests.count()
    plan = days.read_days(spark, str(tmp_path / "d"), ["2024-01-01"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(local_date" in plan


def test_denylist_and_rules_hold_every_danger_ip_once(spark, small):
    sessions = scan_sessions(requests_of(spark, small), S.load_network())
    ips = sorted(r.ip for r in exports.danger_ips(sessions).collect())
    assert [r.value for r in exports.nginx_denylist(sessions).collect()] == [f"deny {i};" for i in ips]
    parts = exports.firewall_expressions(sessions, per_rule=2).orderBy("rule_no").collect()
    assert " ".join(p.value[len("(ip.src in {") : -2] for p in parts).split() == ips


def toy(spark, n=200):
    rows = [
        tuple([float((i * 7 + j) % 11) / 10 + (3.0 if i % 2 and j == 0 else 0.0) for j in range(19)])
        + (float(i % 2), f"g{i // 4 * 2 + i % 2}", "s", i)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, [*FEATURES, "label", "group_id", "provenance", "row_no"]).repartition(2)


def test_training_learns_and_refuses_constants(spark):
    data = toy(spark)
    network = TR.train(data, epochs=60, rate=0.1, seed=1)
    found = data.select((S.network_score(network) > 0.5).alias("hit"), "label").collect()
    assert sum(r.hit == (r.label > 0.5) for r in found) > 180
    constant = S.Network(tuple([0.0] * 84 + [5.0]), network.mins, network.maxs)
    with pytest.raises(TR.DegenerateModelError):
        TR.check_not_degenerate(data, constant)
    with pytest.raises(TR.DegenerateModelError):
        TR.train(data, start=constant, epochs=1)
    vectors = data.select(F.array(*FEATURES).alias("features"), "label")
    with pytest.raises(ValueError):
        TR.fine_tune(vectors.limit(10), network)
    with pytest.raises(ValueError):
        TR.fine_tune(vectors.filter("label = 1"), network)


def test_holdout_keeps_groups_whole(spark):
    split = group_holdout(toy(spark), F.col("row_no"), F.xxhash64("group_id"))
    sides = split.groupBy("group_id").agg(F.count_distinct("split").alias("n"))
    assert sides.filter("n > 1").isEmpty()
    classes = split.filter("split = 'test'").select("label").distinct().count()
    assert classes == 2


def test_leakage_finds_the_planted_column(spark):
    bad = {r.feature for r in leakage(toy(spark)).collect() if r.separates}
    assert bad == {FEATURES[0]}


def test_top_up_never_exceeds_its_share():
    assert top_up_size(100, 100) == 0
    assert top_up_size(10, 100) == 15
    assert top_up_size(45, 100) == 5


def test_rule_labelled_needs_three_requests(spark, small):
    assert rule_labelled(requests_of(spark, small)).filter("requests < 3").isEmpty()


def test_rows_to_learn_from_are_made_once(spark, small):
    rows = learnable(spark, small)
    assert rows.inputFiles() == []  # read from the checkpoint, not from the events again
    want = rule_labelled(requests_of(spark, small)).select(*FEATURES, "label", "ip")
    assert rows.select(*FEATURES, "label", "ip").exceptAll(want).isEmpty() and rows.count() == want.count() > 0


def test_registry_is_complete():
    from trafficlens.plans.catalog import COVERS, ORACLES, QUERIES

    assert len(QUERIES) >= 100 and set(ORACLES) <= set(QUERIES)
    assert all(COVERS[name] for name in QUERIES)


def test_log_lines_keep_bytes_that_clients_choose(spark):
    from trafficlens.sources import logs

    good = '1.2.3.4 - - [24/Mar/2023:17:07:41 +0000] "GET /a HTTP/1.1" 200 7 "-" "agent{}"'
    values = [
        good.format(""),
        "\t" + good.format("b") + " ",
        good.format("\x01c\x01"),
        good.format("d").replace("/a", "/\x01a"),
        "\x01".join(["1.2.3.4", "24/Mar/2023:17:07:41 +0000", "GET", "/forged", "200", "1", "-", "x"]),
        "\x01" * 7,
        "noise",
    ]
    lines = spark.createDataFrame(
        [(v, "f", 0, i) for i, v in enumerate(values)], "value string, src_file string, src_block long, line_no long"
    )
    rows = {r.line_no: r for r in logs.parse_nginx(lines).collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert rows[1].user_agent == "agentb" and rows[2].user_agent == "agent\x01c\x01" and rows[3].url == "/\x01a"
    assert logs.detect_formats(lines.filter("line_no = 1")).first().fmt == "nginx"


def test_requests_without_address_are_kept(spark, log):
    table = log.add(0).add(10).add(20, ip=None).add(30, ip=None, ua=None).table(spark)
    from trafficlens.operators.features import session_features
    from trafficlens.operators.sessions import sessionize

    assert sessionize(table).count() == 4
    assert sessionize(table, ("ip", "user_agent")).count() == 4
    assert {r.ip: r.requests for r in session_features(table).collect()} == {"192.168.1.1": 2, "": 2}


def test_detectors_share_their_passes(spark, small):
    import re

    from trafficlens.plans.catalog import QUERIES

    limits = {"detector_verdicts": (11, 6), "ladder_cells": (16, 8)}
    for name, (exchanges, scans) in limits.items():
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) <= exchanges
        assert len(re.findall(r"FileScan", plan)) <= scans
