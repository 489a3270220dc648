"""Retained windows, sessions and fingerprints kept in state, against brute force and the batch."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trafficlens.functions import scoring as S
from trafficlens.operators import features as FT
from trafficlens.operators import fingerprints as FP
from trafficlens.operators import retained as R
from trafficlens.operators import sessions as SS
from trafficlens.plans.scan import with_score
from trafficlens.operators.rules import with_verdict
from trafficlens.schema import FEATURES
from trafficlens.sources import derived as D
from trafficlens.sources.adapters import requests_of
from trafficlens.streaming import live as L
from trafficlens.streaming import state as ST
from trafficlens.streaming.run import drain
from trafficlens.streaming.state import SessionTotals


def some_requests(n, seed):
    draw = random.Random(seed)
    ts, out = 0, []
    for _ in range(n):
        ts += draw.choice([0, 0, 100_000, 900_000, 5_000_000, 40_000_000])
        path = f"/p{draw.choice([1, 1, 1, 2, 3, draw.randint(4, 9)])}"
        facts = int(path[2:]) * 37 % 64 | draw.choice([0, R.LANGUAGE])
        flags = draw.getrandbits(len(FT.COUNTED)) if draw.random() < 0.4 else draw.choice([0, R.HTML])
        out.append((ts, path, draw.choice("ab"), draw.choice(["200", "404"]), flags, facts, draw.randint(0, R.UNIT)))
    return out


def plain_inputs(items, agent_at):
    """INPUTS of some requests, by looking at all of them."""
    times = [i[0] for i in items]
    gaps = [b - a for a, b in zip(times, times[1:])]
    paths, status = Counter(i[1] for i in items), Counter(i[3] for i in items)
    first = {p: [i[1] for i in items].index(p) for p in paths}
    top = max(paths, key=lambda p: (paths[p], -first[p]))
    entropy = lambda c: sum(n * math.log2(n) for n in c.values())
    views = [i[0] for i in items if i[4] & R.HTML]
    sums = [sum(i[4] >> k & 1 for i in items) for k in range(len(FT.COUNTED))]
    sums += [sum(bool(held(i[4], i[5])) for i in items) for held in R.WEIGHED.values()]
    squares = sum(g * g for g in gaps)
    grpc = len({i[1] for i in items if i[5] & R.GRPC})
    return (
        items[agent_at][2], len(items), times[0], times[-1], top, paths[top], len(paths), len({i[2] for i in items}),
        pytest.approx(entropy(paths)), pytest.approx(entropy(status)), pytest.approx(sum(i[6] for i in items) / R.UNIT), grpc,
        min(gaps, default=None), max(gaps, default=None), squares >> 32, squares & 0xFFFFFFFF,
        max((sum(t <= u <= t + 12_000_000 for u in views[k:]) for k, t in enumerate(views)), default=0),
        sum(times[-1] - t <= 60_000_000 for t in times), sum(times[-1] - t <= 300_000_000 for t in times), *sums,
    )


@pytest.mark.parametrize("keep", [1, 2, 7, 50])
def test_window_adds_and_takes_out(keep):
    items, window = some_requests(400, keep), R.RetainedWindow(keep)
    for k, item in enumerate(items):
        window.add(*item)
        assert window.inputs() == plain_inputs(items[max(0, k + 1 - keep) : k + 1], -1)


class Kept:
    """State and timers of one client."""

    held, timers = None, ()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def registerTimer(self, at):
        self.timers = (*self.timers, at)

    def deleteTimer(self, at):
        self.timers = tuple(t for t in self.timers if t != at)


def test_history_hands_a_client_over_as_few_rows(monkeypatch):
    """Batches of a client come out as arrays, in order of time, as one window over all would have it."""
    monkeypatch.setattr(ST, "CHUNK", 40)
    items, kept, window = some_requests(100, 3), Kept(), R.RetainedWindow(7)
    history = ST.History(7, 10**6)
    history.init(kept)
    given = []
    for part in (range(50), range(50, 100)):
        rows = [("x", None, "a", 0, i, *items[i]) for i in part]
        random.Random(1).shuffle(rows)
        given += history.handleInputRows(("x",), iter(rows), None)
    assert [len(g["line_no"]) for g in given] == [40, 10, 40, 10]
    got = [row for g in given for row in zip(*list(g)[1:])]
    for i, item in enumerate(items):
        window.add(*item)
        assert got[i] == (i, *window.inputs())
    assert len(kept.timers) == 1


def test_rows_without_a_place_come_last():
    rows = [("x", None, "a", 0, n, t) for n, t in ((3, 9), (None, 5), (2, 5), (1, None))]
    assert [r[4] for r in ST._in_time(rows)] == [2, None, 3, 1]


@pytest.mark.parametrize("cut", [1, 3, 60])
def test_session_totals_survive_the_state(cut):
    """Totals stored and read back after every few requests, the counts merged apart."""
    items, session, counts = some_requests(150, 5), None, {}
    for at in range(0, len(items), cut):
        session = SessionTotals.unpacked(session.packed()) if session else SessionTotals()
        for item in items[at : at + cut]:
            session.add(*item)
        for key, (n, first, special) in session.counts.items():
            old = counts.get(key)
            counts[key] = (n, first, special) if old is None else (n + old[0], old[1], special or old[2])
    assert session.inputs(counts.items()) == plain_inputs(items, 0)


def test_retained_inputs_over_blocks_equal_the_arrays(spark, log):
    """One session far longer than a block, against the features of arrays of structs."""
    table = log.many(130, every=2.5, url=lambda i: f"/p{i % 7}.html", status=lambda i: 404 if i % 5 == 0 else 200)
    table = table.many(40, every=1.0, ip="2.2.2.2", url=lambda i: f"/x{i}").table(spark).repartition(3)
    for keep, block in ((20, 25), (30, 7), (200, 50)):
        arrays = SS.retained_history(table, [F.col("line_no"), *FT.history_item()], keep=keep)
        arrays = arrays.withColumn("line_no", F.element_at("history", F.lit(-1))["line_no"])
        want = FT.with_features(FT.history_inputs(arrays, "last"))
        got = FT.with_features(R.retained_inputs(table, keep, block=block))
        columns = ["ip", "line_no", "requests", "top_endpoint", "top_hits", "pages", "grpc_paths", "session_pos"]
        rows = [
            sorted((*r[:8], *(round(x, 6) for x in r[8:])) for r in df.select(*columns, *FEATURES).collect())
            for df in (want, got)
        ]
        assert rows[0] == rows[1] and len(rows[0]) == 170


def test_empty_and_missing_values(spark, log):
    table = log.add(0, url=None).add(5, ua=None, status=None).add(6, ip=None).table(spark)
    rows = {r.line_no: r for r in R.retained_inputs(table).collect()}
    assert [rows[k].requests for k in (0, 1, 2)] == [1, 2, 1]
    assert R.retained_inputs(table.where("false")).count() == 0


def in_files(df, path, n=4):
    """Rows over several files in time order; rows near a border may lie on its other side."""
    low, high = df.agg(F.min("ts_us"), F.max("ts_us")).first()
    jitter = F.pmod(F.xxhash64("ts_us"), F.lit(240_000_000))
    place = F.floor((F.col("ts_us") - low + jitter) / ((high - low + 240_000_001) / n))
    for k in range(n):
        df.where(place == k).coalesce(1).write.parquet(f"{path}/{k}")
    return f"{path}/*"


def test_sessions_close_with_scores_as_in_the_batch(spark, small, tmp_path):
    stored, network = requests_of(spark, small), S.load_network()
    path = in_files(stored, str(tmp_path))
    stream = L.stream_request_table(spark, path, stored.schema, files_per_trigger=1)
    live = drain(L.score_sessions(stream, network, timeout_s=600))
    batch = FT.with_features(FT.session_inputs(stored, timeout_s=600))
    batch = with_score(with_verdict(batch), network, integrations="blend")
    passed = stored.agg((F.floor(F.max("ts_us") / 1000) * 1000 - 600_000_000).alias("us")).first().us
    key = lambda df: sorted((r.ip, r.start_us, r.requests, r.rule_code, r.label, round(r.score, 9)) for r in df.collect())
    want = key(batch.where(F.col("end_us") + 600_000_000 <= passed))
    assert len(want) > 100 and key(live) == want
    names = [r.session_id for r in live.select("session_id").collect()]
    assert len(set(names)) == len(names)


def test_shared_counts_follow_the_batch(spark, small, tmp_path):
    """Requests and submissions in several files, accepted ones counted behind the binding."""
    stored = requests_of(spark, small)
    subs = D.submissions_of(stored).withColumn("ts", F.timestamp_micros("ts_us"))
    both = [
        L.stream_request_table(spark, in_files(df, str(tmp_path / name)), df.schema, files_per_trigger=1)
        for name, df in (("subs", subs), ("requests", stored))
    ]
    live = drain(L.shared_counts(L.submission_outcomes(*both, lateness="60 days")))
    assert live.count() == 0  # nothing is passed yet
    both = [
        L.stream_request_table(spark, f"{tmp_path}/{name}/*", df.schema) for name, df in (("subs", subs), ("requests", stored))
    ]
    outcomes = drain(L.submission_outcomes(*both)).select("ip", "ts_us", "seq", "outcome")
    batch = FP.bind(subs, stored).select("ip", "ts_us", "seq", "outcome")
    last = max(df.agg(F.max("ts_us")).first()[0] for df in (subs, stored))
    passed = f"ts_us <= {(last // 1000 - 600_000) * 1000}"
    assert sorted(map(tuple, outcomes.collect())) == sorted(map(tuple, batch.where(passed).collect()))
    both = [
        L.stream_request_table(spark, f"{tmp_path}/{name}/*", df.schema) for name, df in (("subs", subs), ("requests", stored))
    ]
    live = drain(L.shared_counts(L.submission_outcomes(*both)))
    counts = FP.shared_ip_counts(FP.bind(subs, stored).where("outcome = 'ACCEPTED'"))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, counts.where(passed).collect()))


def test_decisions_over_several_batches(spark, small, tmp_path):
    """A file a batch: histories are stored and taken up again."""
    stored = requests_of(spark, small).where("user_id % 3 = 0")
    low, high = stored.agg(F.min("ts_us"), F.max("ts_us")).first()
    for k in range(4):
        part = F.floor((F.col("ts_us") - low) * 4 / (high - low + 1)) == k
        stored.where(part).coalesce(1).write.parquet(str(tmp_path / str(k)))
    stream = L.stream_request_table(spark, f"{tmp_path}/*", stored.schema, files_per_trigger=1)
    network, columns = S.load_network(), ("line_no", "requests", "rule_code", "label", "score")
    key = lambda df: sorted((*r[:4], round(r[4], 9)) for r in df.select(*columns).collect())
    assert key(drain(L.score_stream(stream, network, keep=9))) == key(L.replay(stored, network, keep=9))
