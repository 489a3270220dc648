"""One case per rule, all cases in one table: the client address names the case."""

import math
import random
from datetime import datetime, timezone

import pytest
from conftest import BROWSER, PLAIN, Log
from pyspark.sql import functions as F

from trafficlens.functions import patterns as P
from trafficlens.operators.features import session_inputs
from trafficlens.operators.rules import chain, label_sessions, with_verdict
from trafficlens.operators.signals import enrich

UNEVEN = lambda i: i * 7.0 + (i % 3) * 2.0 + (i % 5)
NIGHT = datetime(2023, 3, 24, 2, 0, 0, tzinfo=timezone.utc)
DIRS = ["/backup", "/old", "/hidden", "/private", "/tmp", "/beta"]

# code -> (count, options)
CASES = {
    "INTEGRATION": (8, {"ua": "GitHub-Hookshot/abc", "every": 1.0}),
    "KNOWN_BOT_UA": (3, {"ua": "python-requests/2.28.0"}),
    "SCANNER_PATH": (4, {"url": lambda i: ["/products", "/about", "/.env", "/contact"][i]}),
    "UNIFORM_TIMING": (6, {"ua": PLAIN, "url": lambda i: f"/api/items/{i}", "every": 1.0}),
    "HTTP10": (8, {"raw_line": '"GET /a HTTP/1.0"', "every": UNEVEN}),
    "CDN_BYPASS": (1, {"ua": "cf-worker/1.0"}),
    "PROTECTED_SCAN": (4, {"url": "/console", "referer": "-", "every": UNEVEN}),
    "ATTACK_TOOL": (1, {"ua": "Nuclei - Open-source project"}),
    "BOTNET": (9, {"url": lambda i: ["/shell.cgi", "/HNAP1", "/tr069"][i % 3], "every": UNEVEN}),
    "DIR_BRUTE": (40, {"url": lambda i: DIRS[i % 6], "status": lambda i: 403 + i % 2, "every": UNEVEN}),
    "UA_ROTATION": (20, {"ua": lambda i: f"Agent{i}/1.0", "url": lambda i: f"/page/{i}", "every": UNEVEN}),
    "PAGES_100": (101, {"url": lambda i: f"/p/{i}", "every": UNEVEN}),
    "RAW_VOLUME": (2001, {"url": lambda i: f"/static/{i}.js", "every": UNEVEN}),
    "SAME_ENDPOINT": (12, {"url": "/products", "every": UNEVEN}),
    "HIGH_RATE": (10, {"url": lambda i: f"/p/{i}", "every": lambda i: UNEVEN(i) / 20}),
    "NO_REFERER": (21, {"url": lambda i: f"/p/{i}", "referer": "-", "every": UNEVEN}),
    "ERROR_RATE": (12, {"url": lambda i: f"/p/{i}", "status": lambda i: 500 if i % 3 else 200, "every": UNEVEN}),
    "REPEATED_PATH": (30, {"url": lambda i: f"/q?i={i}" if i % 5 else f"/p/{i}", "every": UNEVEN}),
    "CRED_PARAM": (6, {"url": lambda i: f"/p/{i}?token=abc", "every": UNEVEN}),
    "CRED_BRUTE": (8, {"url": lambda i: f"/x{i}/login", "every": lambda i: UNEVEN(i) / 2 + 10 * (i > 3)}),
    "POST_BRUTE": (10, {"url": lambda i: f"/x{i}/login", "method": "POST", "every": lambda i: UNEVEN(i) * 10}),
    "UNKNOWN_UA": (6, {"ua": PLAIN, "url": lambda i: f"/p/{i}", "every": UNEVEN}),
    "BURST": (22, {"ua": "-", "url": lambda i: f"/p/{i}", "every": lambda i: (i > 20) * 0.5}),
    "NIGHT": (60, {"url": lambda i: f"/p/{i}", "every": UNEVEN, "start": NIGHT}),
    "BROWSER_OK": (6, {"url": lambda i: f"/p/{i}", "every": UNEVEN}),
    "VARIABLE_TIMING": (6, {"ua": "-", "url": "/products", "every": lambda i: i if i < 5 else 600}),
    "EXPLORING": (5, {"ua": "-", "url": lambda i: f"/p/{i}", "every": UNEVEN}),
    "REFERER_CHAIN": (3, {"ua": "-", "url": "/p", "every": UNEVEN}),
    "DEFAULT": (2, {"ua": "-", "url": "/p", "referer": "-", "every": UNEVEN}),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    log = Log()
    for code, (count, options) in CASES.items():
        log.many(count, ip=code, **options)
    rows = label_sessions(log.table(spark)).select(
        "ip", "rule_code", "heuristic_label", "heuristic_confidence", "heuristic_reason"
    )
    return {r.ip: r for r in rows.collect()}


@pytest.mark.parametrize("code", CASES)
def test_rule_fires(verdicts, code):
    row = verdicts[code]
    rule = {r.code: r for r in chain()}[code]
    assert row.rule_code == code
    assert (row.heuristic_label, row.heuristic_confidence) == (rule.label, rule.confidence)


def test_reasons_carry_numbers(verdicts):
    assert verdicts["UNIFORM_TIMING"].heuristic_reason == "uniform timing (one every 1.000 s, hardly any spread)"
    assert verdicts["PAGES_100"].heuristic_reason == "extremely high request count: 101 page views"
    assert verdicts["SAME_ENDPOINT"].heuristic_reason == "all 12 requests to same endpoint: always /products"
    assert verdicts["BOTNET"].heuristic_reason == "botnet scanning pattern (9 requests to endpoints of devices)"
    assert verdicts["KNOWN_BOT_UA"].heuristic_reason == "known bot/monitoring UA: named python-requests/2.28.0"


BOUNDARIES = {
    # ip -> (count, options, code that must not fire)
    "uniform_4": (4, {"ua": PLAIN, "url": lambda i: f"/a/{i}"}, "UNIFORM_TIMING"),
    "grpc": (
        9,
        {"ua": PLAIN, "url": lambda i: ["/pkg.Svc/GetUser", "/pkg.Svc/ListItems", "/pkg.Svc/PutItem"][i % 3]},
        "UNIFORM_TIMING",
    ),
    "http10_5": (5, {"raw_line": "HTTP/1.0", "every": UNEVEN}, "HTTP10"),
    "console_with_referer": (4, {"url": "/console", "every": UNEVEN}, "PROTECTED_SCAN"),
    "one_botnet_hit": (3, {"url": lambda i: ["/", "/system", "/status"][i], "every": UNEVEN}, "BOTNET"),
    "graphql": (12, {"url": "/graphql", "every": UNEVEN}, "SAME_ENDPOINT"),
    "pages_100": (100, {"url": lambda i: f"/p/{i}", "every": lambda i: UNEVEN(i)}, "PAGES_100"),
    "volume_2000": (2000, {"url": lambda i: f"/static/{i}.js", "every": UNEVEN}, "RAW_VOLUME"),
    "one_token": (1, {"url": "/signup?token=1"}, "CRED_PARAM"),
    "single_agent": (1, {}, "UA_ROTATION"),
    "night_assets": (60, {"url": lambda i: f"/image/{i}", "every": UNEVEN, "start": NIGHT}, "NIGHT"),
}


def test_boundaries_do_not_fire(spark):
    log = Log()
    for name, (count, options, _code) in BOUNDARIES.items():
        log.many(count, ip=name, **options)
    found = {r.ip: r.rule_code for r in label_sessions(log.table(spark)).collect()}
    for name, (_count, _options, code) in BOUNDARIES.items():
        assert found[name] != code, name


def test_empty_session_is_human(spark):
    log = Log().many(2, ip="a")
    inputs = session_inputs(log.table(spark)).withColumn("requests", F.lit(0).cast("long"))
    assert with_verdict(inputs).first().rule_code == "EMPTY"


def test_signals_need_resolution_and_promotion(spark):
    log = Log()
    for ip in ("tor", "abuse", "shared", "absent", "unresolved", "low"):
        log.many(8, ip=ip, url=lambda i: f"/p/{i}", every=UNEVEN)
    schema = (
        "ip string, resolved boolean, tor_exit boolean, hosting_range boolean, abuse_score double, "
        "fp_resolved boolean, fingerprint_hash string, shared_hash_ips bigint"
    )
    h = "a" * 64
    signals = spark.createDataFrame(
        [
            ("tor", True, True, False, None, True, h, 1),
            ("abuse", True, False, False, 75.0, True, h, 1),
            ("shared", True, False, False, None, True, h, 5),
            ("absent", True, False, False, None, True, None, 0),
            ("unresolved", False, True, False, 99.0, False, None, 9),
            ("low", True, False, True, 74.9, True, h, 4),
        ],
        schema,
    )
    inputs = session_inputs(log.table(spark))
    promoted = F.array(F.lit("tor"), F.lit("abuseipdb"), F.lit("fingerprint"))
    code = lambda df: {r.ip: r.rule_code for r in with_verdict(df, signals=True).collect()}
    assert code(enrich(inputs, signals, promoted)) == {
        "tor": "TOR",
        "abuse": "ABUSE",
        "shared": "FP_SHARED",
        "absent": "FP_ABSENT",
        "unresolved": "BROWSER_OK",
        "low": "BROWSER_OK",
    }
    assert set(code(enrich(inputs, signals, None)).values()) == {"BROWSER_OK"}


def test_browser_constant_is_a_browser():
    assert "Chrome" in BROWSER and not math.isnan(1.0)


PATTERN_LISTS = [getattr(P, n) for n in sorted(dir(P)) if n.endswith("_PATTERNS")]


def test_patterns_match_in_any_case_and_script(spark):
    """The quick search finds what the plain one over all patterns finds, in ASCII and beyond it."""
    draw = random.Random(4)
    texts = ["", "-", None, "\u212aatory", "ma\u017f\u017fcan", "MASSCAN/1", "\u0130 NMAP", "go \n NET/http", "robot", "bots", "a bot"]
    for pattern in (p for some in PATTERN_LISTS for p in some):
        plain = pattern.replace("\\", "")
        odd = plain.replace("k", "\u212a").replace("s", "\u017f")
        texts += [plain, plain.upper(), plain[:-1], plain[1:], odd, f"caf\u00e9 {plain} \u00fc", f"Mozilla/5.0 ({plain.title()};)"]
    texts += ["".join(draw.choices("bcdfgklmnoprstuvwxz/-. 3", k=30)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for some in PATTERN_LISTS:
        both = rows.selectExpr("t", f"{P.matches_sql('t', some)} AS quick", f"t rlike r'(?iu){P.alternation(some)}' AS plain")
        assert both.where("NOT quick <=> plain").collect() == []


def test_fixed_texts_are_sought_by_their_first_characters():
    """Trying every text at every place took about half of the time of judging a request."""
    assert "(?=[ac][bd][xy])(?:abx\\.|cdy)'" in P.matches_sql("t", (r"ABx\.", "cdy", r"e\d"))
