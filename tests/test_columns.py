"""Parsers, addresses, urls, scores: hand-made rows with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from trafficlens.functions import address as A
from trafficlens.functions import scoring as S
from trafficlens.functions import text as X
from trafficlens.operators import metrics as M
from trafficlens.operators.signals import in_blocks
from trafficlens.schema import FEATURES
from trafficlens.sources import logs
from trafficlens.sources.feeds import cidr_table, read_forensic_rules

LINE = '1.2.3.4 - - [24/Mar/2023:23:07:41 +0530] "get /a?b=1 HTTP/1.1" 200 - "-" "ua x" "extra"'


def lines(spark, *values):
    rows = [(v, "f", 0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "value string, src_file string, src_block bigint, line_no bigint")


def test_nginx_line_keeps_its_own_hour(spark):
    table = logs.parse_nginx(
        lines(spark, LINE, "junk", "", LINE.replace(" +0530", ""), LINE.replace("24/Mar", "99/Foo"))
    )
    got = table.orderBy("line_no").select("*", F.unix_micros("ts").alias("us")).collect()
    assert [r.line_no for r in got] == [0, 3]
    first, bare = got
    assert (first.method, first.url, first.status, first.size) == ("GET", "/a?b=1", 200, 0)
    assert (first.local_hour, str(first.local_date)) == (23, "2023-03-24")
    assert bare.us - first.us == int(5.5 * 3600) * 1_000_000  # without a zone it is UTC


def test_json_falsy_values_fall_through(spark):
    docs = [
        '{"remote_addr": "", "ip": "9.9.9.9", "status": 0, "response_code": 503, "size": "12"}',
        '{"client_ip": "8.8.8.8", "status": "abc", "bytes": 1.9, "method": "post", "uri": "/u"}',
        '[1]',
        '{"broken": ',
        '{"ip": "7.7.7.7", "timestamp": "2023-03-24T10:00:00+02:00", "status": "404"}',
    ]
    got = logs.parse_json(lines(spark, *docs), F.timestamp_micros(F.lit(0))).orderBy("line_no").collect()
    assert [(r.ip, r.status, r.size, r.method, r.url) for r in got] == [
        ("9.9.9.9", 503, 12, "GET", "/"),
        ("8.8.8.8", 200, 1, "POST", "/u"),
        ("7.7.7.7", 404, 0, "GET", "/"),
    ]
    assert got[2].local_hour == 10 and got[2].ts.hour == 8


def test_log_files_round_trip(spark, tmp_path):
    import gzip

    (tmp_path / "a.log").write_text("\n".join([LINE] * 3) + "\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write('{"ip": "5.5.5.5", "url": "/j"}\n')
    rows = logs.read_access_log(spark, str(tmp_path), default_ts=F.timestamp_micros(F.lit(0)))
    assert sorted((r.ip, r.url) for r in rows.collect()) == [("1.2.3.4", "/a?b=1")] * 3 + [("5.5.5.5", "/j")]


ADDRESSES = {
    "10.1.2.3": "10.1.2.x",
    "2001:db8::1": "2001:0db8:0000:x",
    "::": "0000:0000:0000:x",
    "1:2:3:4:5:6:7:8": "0001:0002:0003:x",
    "::ffff:1.2.3.4": "0000:0000:0000:x",
    "1.2.3": "x",
    "1.2.3.04": "x",
    "1.2.3.256": "x",
    "1:2:3": "x",
    "1::2::3": "x",
    "1:2:3:4:5:6:7:8:9": "x",
    "host": "x",
}


def test_masked_addresses(spark):
    table = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    got = {r.ip: r.m for r in table.select("ip", A.mask_ip(F.col("ip")).alias("m")).collect()}
    assert got == ADDRESSES


def test_blocks_match_addresses_of_their_version(spark):
    blocks = ["10.0.0.0/8", "10.1.0.0/16", "1.2.3.4", "2001:db8::/32", "0.0.0.0/99", "x/8"]
    ips = ["10.9.9.9", "10.1.1.1", "1.2.3.4", "1.2.3.5", "2001:db8:1::9", "2001:db9::1", "bad"]
    table = cidr_table(spark.createDataFrame([(b,) for b in blocks], "cidr string"))
    seen = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r.ip for r in in_blocks(seen, table).collect()}
    assert got == {"10.9.9.9", "10.1.1.1", "1.2.3.4", "2001:db8:1::9"}


def test_blocked_urls(spark):
    urls = {
        "/.env": True, "/WP-ADMIN/x": True, "/server-status": True, "/a?q=%2e%2e%2fetc": True,
        "/a?q=%252e%252e%252f": True, "/a?q=1+union+select": True, "/a?q=%zz": False, "/shop": False,
    }
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.b for r in table.select("url", X.is_blocked_url(F.col("url")).alias("b")).collect()}
    assert got == urls


def test_query_values_and_rewrite(spark):
    table = spark.createDataFrame([("/x?ref=a+b&ref=&y=1&ref=c%20d#z", 'q "ua" z "ua" end')], "url string, raw string")
    row = table.select(
        X.query_values(F.col("url"), "ref").alias("v"),
        X.rewrite_agent_in_line(F.col("raw"), F.lit("ua"), "new").alias("r"),
        X.rewrite_agent_in_line(F.col("raw"), F.lit("none"), "new").alias("none"),
        X.url_depth(F.col("url")).alias("depth"),
        X.char_entropy(F.lit("aabb")).alias("bits"),
    ).first()
    assert row.v == ["a b", "c d"] and row.r == 'q "ua" z "new" end' and row.none is None
    assert (row.depth, row.bits) == (1, 1.0)


@pytest.mark.parametrize(
    "label,conf,model,expected",
    [("bot", 0.9, 0.1, 0.9), ("bot", 0.6, 1.0, 0.84), ("human", 0.7, 1.0, 0.3), ("human", 0.5, 0.1, 0.26),
     ("other", 0.5, 1.0, 0.8)],
)
def test_blend(spark, label, conf, model, expected):
    row = spark.range(1).select(S.blend(F.lit(label), F.lit(conf), F.lit(model)).alias("s")).first()
    assert row.s == pytest.approx(expected)


def test_confidence_is_recovered_or_null(spark):
    rows = [("human", 0.3, 1.0, "variable timing (x)"), ("human", 0.3, 0.1, "natural navigation"), ("bot", 0.123, 0.5, "")]
    table = spark.createDataFrame(rows, "l string, s double, m double, r string")
    got = [
        r.c
        for r in table.select(
            S.recovered_confidence(F.col("l"), F.col("s"), F.col("m"), F.col("r")).alias("c")
        ).collect()
    ]
    # 0.6 and 0.7 both give 0.3 at model 0.1; the reason names the rule.
    assert got == [0.7, 0.6, None]


def test_network_matches_a_plain_forward_pass(spark):
    net = S.load_network()
    x = [float(i % 5) + 0.25 for i in range(19)]
    scaled = [(v - lo) / (hi - lo) if hi > lo else 0.5 for v, lo, hi in zip(x, net.mins, net.maxs)]
    hidden = [max(0.0, sum(w * v for w, v in zip(ws, scaled)) + b) for ws, b in net.hidden_units()]
    ow, ob = net.output_unit()
    expected = 1 / (1 + math.exp(-(sum(w * h for w, h in zip(ow, hidden)) + ob)))
    row = spark.createDataFrame([tuple(x)], FEATURES).select(S.network_score(net).alias("s")).first()
    assert row.s == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize(
    "k,n,lo,hi", [(0, 10, 0, 0.2775), (10, 10, 0.7225, 1), (5, 10, 0.2366, 0.7634), (43, 43, 0.918, 1), (0, 0, 0, 1)]
)
def test_wilson(spark, k, n, lo, hi):
    row = M.with_rate(spark.createDataFrame([(k, n)], "k bigint, n bigint")).first()
    assert (row.ci_low, row.ci_high) == (pytest.approx(lo, abs=1e-4), pytest.approx(hi, abs=1e-4))


def test_ranking_statistics_with_ties(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.3, 0), (0.1, 1)]
    table = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert M.roc_auc(table).first().auc == pytest.approx(wins)
    assert M.average_precision(table).first().ap == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 6)
    assert M.roc_auc(table.filter("label = 1")).first().auc is None
    ends = {r.threshold: (r.tpr, r.fpr) for r in M.roc_curve(table).collect()}
    assert ends[-1.0] == (1.0, 1.0) and ends[1.0] == (0.0, 0.0) and ends[0.8] == (1 / 3, 0.0)


def test_bootstrap_interval_surrounds_the_estimate(spark):
    rows = [(f"a{i}", (i * 37 % 101) / 101 + 0.3 * (i % 2), i % 2) for i in range(300)]
    table = spark.createDataFrame(rows, "ip string, score double, label int")
    auc, interval = M.roc_auc(table).first().auc, M.bootstrap_auc(table, 300).first()
    assert interval.low < auc < interval.high and interval.high - interval.low < 0.25
    one_class = table.filter("label = 1")
    assert M.bootstrap_auc(one_class, 50).first().low is None


def plain_statistics(scores, bots, weights):
    """AUC and average precision of weighted actors, by definition."""
    auc = ap = seen = hits = 0.0
    for s in sorted(set(scores), reverse=True):
        here = scores == s
        pos, neg = (weights * bots * here).sum(), (weights * ~bots * here).sum()
        auc += pos * ((weights * ~bots * (scores < s)).sum() + neg / 2)
        hits, seen = hits + pos, seen + pos + neg
        ap += pos * hits / seen if seen else 0.0
    n, m = (weights * bots).sum(), (weights * ~bots).sum()
    return (auc / n / m if n and m else None), (ap / n if n else None)


def test_every_replicate_is_a_weighted_sample(spark):
    """The same draws given to a plain version; ties reach over batches and ranges."""
    import numpy as np

    rows = [(f"a{i}", (i * 37 % 53) / 53, int(i * 7 % 10 < 4)) for i in range(900)]
    table = spark.createDataFrame(rows, "ip string, score double, label int").repartition(5)
    got = {r.replicate: (r.auc, r.ap) for r in M.replicate_statistics(table, replicates=20, ranges=7).collect()}
    hashed = {r.ip: r.h for r in table.select("ip", F.xxhash64("ip").alias("h")).collect()}
    drawn = M._drawn(np.array([hashed[ip] for ip, _, _ in rows]), 20, 0)
    assert 0.9 < drawn.mean() < 1.1 and 0.85 < drawn.var() < 1.15
    scores, bots = np.array([s for _, s, _ in rows]), np.array([y > 0 for _, _, y in rows])
    for k in range(20):
        assert got[k] == pytest.approx(plain_statistics(scores, bots, drawn[:, k]))


def test_intervals_agree_with_plain_resampling(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    bots = draw.random(250) < 0.4
    scores = draw.normal(size=250) + bots
    rows = [(f"a{i}", float(s), int(y)) for i, (s, y) in enumerate(zip(scores, bots, strict=True))]
    table = spark.createDataFrame(rows, "ip string, score double, label int")
    worse = table.withColumn("score", F.col("score") + F.sin(F.col("score") * 50))
    plain = []
    for _ in range(400):
        weights = np.bincount(draw.integers(0, 250, 250), minlength=250).astype(float)
        plain.append(plain_statistics(scores, bots, weights))
    found = {r.statistic: r for r in M.bootstrap_intervals(table, replicates=400).collect()}
    for k, name in enumerate(("auc", "ap")):
        low, high = np.quantile([p[k] for p in plain], [0.025, 0.975])
        assert found[name].low == pytest.approx(low, abs=0.03) and found[name].high == pytest.approx(high, abs=0.03)
        assert found[name].low < found[name].point < found[name].high and found[name].survivors == 400
    paired = {r.statistic: r for r in M.bootstrap_intervals(table, worse, replicates=200).collect()}
    single = found["auc"].high - found["auc"].low
    assert paired["auc"].point > 0 and paired["auc"].high - paired["auc"].low < 1.5 * single


def test_quantiles_of_many_groups(spark):
    import numpy as np

    rows = [(f"g{i % 7 if i % 3 else 0}", (i * 31) % 97 if i % 11 else None) for i in range(800)]
    table = spark.createDataFrame(rows, "g string, x int")
    got = {r.g: (r.a, r.b) for r in M.grouped_quantiles(table, "x", ["g"], {"a": 0.5, "b": 0.9}).collect()}
    for g in {g for g, _ in rows}:
        values = [x for h, x in rows if h == g and x is not None]
        assert got[g] == pytest.approx(tuple(np.quantile(values, [0.5, 0.9])))
    empty = spark.createDataFrame([("g", True, None)], "g string, flagged boolean, first_flag long")
    row = M.detection_delay(empty, by=("g",)).first()
    assert (row.caught, row.missed, row.median_request) == (0, 0, None)


@pytest.mark.parametrize("counters", [4, 40, 4000])
def test_busiest_values_are_exact(spark, counters):
    from collections import Counter

    from trafficlens.operators import reports as RP

    values = [f"v{int(1.02 ** (i * 7919 % 300))}" for i in range(3000)] + ["even%d" % (i % 500) for i in range(1000)]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)] * 9, "k string").repartition(6)
    count = Counter(values)
    for row in RP.heavy_hitters(table, "k", counters).filter("key IS NOT NULL").collect():
        assert row.low <= count[row.key] <= row.high
    lost = RP.heavy_hitters(table, "k", counters).filter("key IS NULL").first().high
    assert lost <= 2 * len(values) / counters + 6
    for n in (3, 25, 10_000):
        want = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:n]
        got = [(r.key, r["count"]) for r in RP.busiest(table, "k", n, counters).collect()]
        assert sorted(got, key=lambda x: (-x[1], x[0])) == want


def test_rule_file(spark, tmp_path):
    (tmp_path / "r.yaml").write_text(
        '# c\n- id: scan\n  ground_truth_label: dir\n  filter:\n    - "%GET%"\n    - "code: 404"\n- id: p\n  filter:\n    - x\n'
    )
    got = read_forensic_rules(spark, str(tmp_path / "r.yaml")).orderBy("rule_no").collect()
    assert [(r.label, r.sensitivity, r.tokens) for r in got] == [
        ("dir", "moderate", ["get", "code: 404"]),
        ("p", "moderate", ["x"]),
    ]
