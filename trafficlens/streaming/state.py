"""Keyed state of the streams: what each client, address or fingerprint needs to keep, and no more.

State is typed columns and maps in the state store, which spills to disk; Python holds one key's
totals at a time. ``InOrder`` lets rows wait until the watermark has passed them, so that its
subclasses see every key in order of time however late rows arrive inside the allowed lateness.
"""

import math
from collections import deque
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

from ..operators.features import CLICK_WINDOW_S
from ..operators.retained import GRPC, HTML, INPUT_COLUMNS, INPUTS, ITEM, ITEM_COLUMNS, UNIT, RetainedWindow, Totals
from ..schema import SOURCE_ORDER

US = 1_000_000
#: Rows that are handed back to Spark at once.
CHUNK = 5000


def _frames(rows, names) -> Iterator[pd.DataFrame]:
    rows = list(rows)
    for i in range(0, len(rows), CHUNK):
        yield pd.DataFrame(rows[i : i + CHUNK], columns=names)


# --- the last requests of a client ---------------------------------------------------------------

HISTORY = "last_us long, " + ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in ITEM.split(", "))
#: Values of many requests at once: an array per column keeps what is handed over per client small.
HISTORY_OUT = "ip string, " + ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in f"line_no long, {INPUTS}".split(", "))
#: Places of the columns a request is ordered by, of its number and of ITEM, in a row of HISTORY_IN.
HISTORY_IN = ["ip", "ts", *SOURCE_ORDER, *ITEM_COLUMNS]
_IN_TIME = itemgetter(*(HISTORY_IN.index(c) for c in ("ts_us", *SOURCE_ORDER)))
_NUMBERED = itemgetter(*(HISTORY_IN.index(c) for c in ("line_no", *ITEM_COLUMNS)))
_GIVEN = Row("ip", "line_no", *INPUT_COLUMNS)


def _in_time(rows) -> list:
    """Rows of HISTORY_IN in order of time, then of the source; a missing value comes last."""
    rows = list(rows)
    try:
        return sorted(rows, key=_IN_TIME)
    except TypeError:  # raised where a missing value is compared
        return sorted(rows, key=lambda row: [(v is None, 0 if v is None else v) for v in _IN_TIME(row)])


class History(StatefulProcessor):
    """Inputs of every request, from the last ``keep`` of its client; a pause forgets them.

    Rows are taken in order of time inside a micro-batch. A row that comes late, behind others of
    its client, joins the history as it is then; it never sets the clock back.
    """

    def __init__(self, keep: int, timeout_s: int):
        self.keep, self.timeout_us = keep, timeout_s * US

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("history", HISTORY)

    def handleInputRows(self, key, rows, timerValues):
        window, last_us = RetainedWindow(self.keep), None
        if self.held.exists():
            last_us, *columns = self.held.get()
            for item in zip(*(list(c) for c in columns), strict=True):
                window.add(*item)
            self.handle.deleteTimer(self._ends(last_us))
        out = []
        for line_no, ts_us, *rest in map(_NUMBERED, _in_time(rows)):
            if last_us is not None and ts_us - last_us > self.timeout_us:
                window = RetainedWindow(self.keep)
            last_us = ts_us if last_us is None else max(last_us, ts_us)
            window.add(last_us, *rest)
            out.append((line_no, *window.inputs()))
        self.held.update((last_us, *map(list, zip(*window.items, strict=True))))
        self.handle.registerTimer(self._ends(last_us))
        for i in range(0, len(out), CHUNK):
            yield _GIVEN(key[0], *zip(*out[i : i + CHUNK], strict=True))

    def _ends(self, last_us: int) -> int:
        """When no request in time can continue the session any more."""
        return (last_us + self.timeout_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists() and self._ends(self.held.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter([])


# --- rows in order of time -----------------------------------------------------------------------


class InOrder(StatefulProcessor):
    """Rows (the first column is ``ts_us``) wait in state until the watermark has passed them."""

    ROW = OUT = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)
        self.names = [c.split()[0] for c in self.ROW.split(", ")]

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for frame in rows:
            self.waiting.appendList(list(zip(*(frame[c].tolist() for c in self.names), strict=True)))
            least = int(frame["ts_us"].min())
            first = least if first is None else min(first, least)
        self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed_us = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted(r for r in rows if r[0] <= passed_us)
        if ready:
            later = [r for r in rows if r[0] > passed_us]
            self.waiting.clear()
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(min(r[0] for r in later) // 1000 + 1)
        names = [c.split()[0] for c in self.OUT.split(", ")]
        yield from _frames([(key[0], *row) for row in self.fold(ready, passed_us)], names)

    def fold(self, rows: list[tuple], passed_us: int) -> Iterator[tuple]:
        """Take up rows in order; nothing at or before ``passed_us`` will come any more."""
        raise NotImplementedError


# --- whole sessions ------------------------------------------------------------------------------

_LOW = (1 << 32) - 1


class SessionTotals(Totals):
    """What a session adds up to, without its requests; ``counts`` may be kept elsewhere.

    Besides sums and extremes it holds the times of the last five minutes and of the page views of
    the last twelve seconds; ``counts`` has, per path, agent and status, how often and since when.
    """

    def __init__(self):
        super().__init__()
        self.requests = self.clicks = 0
        self.start = self.end = self.agent = self.shortest = self.longest = None
        self.recent, self.views = deque(), deque()
        self.counts = {}

    def add(self, ts_us, path, agent, status, flags, facts, bits) -> None:
        if self.requests:
            gap = ts_us - self.end
            self.gap_sq += gap * gap
            self.shortest = gap if self.shortest is None else min(gap, self.shortest)
            self.longest = gap if self.longest is None else max(gap, self.longest)
        else:
            self.start, self.agent = ts_us, agent
        self.requests += 1
        self.end = ts_us
        self.count(flags, facts, bits, 1)
        for kind, value in (("path", path), ("agent", agent), ("status", status)):
            n, first, special = self.counts.get((kind, value), (0, self.requests, 0))
            self.counts[kind, value] = (n + 1, first, special or (kind == "path" and facts & GRPC))
        self.recent.append(ts_us)
        while ts_us - self.recent[0] > 300 * US:
            self.recent.popleft()
        if flags & HTML:
            self.views.append(ts_us)
            while ts_us - self.views[0] > CLICK_WINDOW_S * US:
                self.views.popleft()
            self.clicks = max(self.clicks, len(self.views))

    STATE = (
        "start_us long, end_us long, requests long, agent string, shortest long, longest long, clicks long, gap_high long,"
        " gap_low long, bits_high long, bits_low long, sums array<long>, recent array<long>, views array<long>"
    )

    def packed(self) -> tuple:
        """STATE: all but the counts."""
        return (
            self.start, self.end, self.requests, self.agent, self.shortest, self.longest, self.clicks, self.gap_sq >> 32,
            self.gap_sq & _LOW, self.bits >> 32, self.bits & _LOW, self.sums, list(self.recent), list(self.views),
        )

    @classmethod
    def unpacked(cls, state) -> "SessionTotals":
        out = cls()
        (out.start, out.end, out.requests, out.agent, out.shortest, out.longest, out.clicks, gap_high, gap_low,
         bits_high, bits_low, sums, recent, views) = state
        out.gap_sq, out.bits = gap_high << 32 | gap_low, bits_high << 32 | bits_low
        out.sums, out.recent, out.views = list(sums), deque(recent), deque(views)
        return out

    def inputs(self, counts) -> tuple:
        """INPUTS of the whole session; the agent is that of its first request."""
        sizes = dict.fromkeys(("path", "agent", "status"), 0)
        n_log_n = dict.fromkeys(sizes, 0.0)
        grpc, top = 0, (0, 0, None)
        for (kind, value), (n, first, special) in counts:
            sizes[kind] += 1
            n_log_n[kind] += n * math.log2(n)
            grpc += bool(special)
            if kind == "path" and (n, -first) > top[:2]:
                top = (n, -first, value)
        last_60 = sum(self.end - t <= 60 * US for t in self.recent)
        return (
            self.agent, self.requests, self.start, self.end, top[2], top[0], sizes["path"], sizes["agent"], n_log_n["path"],
            n_log_n["status"], self.bits / UNIT, grpc, self.shortest, self.longest, *self.squares(), self.clicks, last_60,
            len(self.recent), *self.sums,
        )


class Sessions(InOrder):
    """A session is given out, as INPUTS, once no request can continue it any more.

    What is kept of an open session is SessionTotals; its counts lie in a map of the state store,
    so a session of very many paths costs disk, not memory.
    """

    ROW = ", ".join([ITEM.split(", ")[0], "src_file string, src_block long, line_no long", *ITEM.split(", ")[1:]])
    OUT = f"ip string, {INPUTS}"

    def __init__(self, timeout_s: int):
        self.timeout_us = timeout_s * US

    def init(self, handle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", SessionTotals.STATE)
        self.counts = handle.getMapState("counts", "kind string, value string", "n long, first long, special int")

    def fold(self, rows, passed_us):
        session = SessionTotals.unpacked(self.open.get()) if self.open.exists() else None
        kept = session is not None  # whether the map holds counts of the session
        for ts_us, _, _, _, *rest in rows:
            if session is not None and ts_us - session.end > self.timeout_us:
                yield session.inputs(self._all(session, kept))
                session, kept = None, False
            session = session or SessionTotals()
            session.add(ts_us, *rest)
        if session is None:
            return
        if session.end + self.timeout_us <= passed_us:
            yield session.inputs(self._all(session, kept))
            self.open.clear()
            return
        for key, (n, first, special) in session.counts.items():
            old = self.counts.getValue(key) if kept else None
            self.counts.updateValue(key, (n, first, special) if old is None else (n + old[0], old[1], special or old[2]))
        self.open.update(session.packed())
        self.handle.registerTimer((session.end + self.timeout_us) // 1000 + 1)

    def _all(self, session: SessionTotals, kept: bool):
        """Counts of the whole session; the map is empty afterwards."""
        if not kept:
            yield from session.counts.items()
            return
        fresh = session.counts
        for key, (n, first, special) in self.counts.iterator():
            more = fresh.pop(tuple(key), None)
            yield tuple(key), (n, first, special) if more is None else (n + more[0], first, special or more[2])
        yield from fresh.items()
        self.counts.clear()


# --- fingerprints --------------------------------------------------------------------------------


class Claims(InOrder):
    """Outcome of every fingerprint submission of an address, among its requests.

    Rows are requests (kind 0) and submissions (kind 1). State is the last request and the claim in
    force: three values, whatever the traffic.
    """

    ROW = "ts_us long, kind int, seq long, hash string, valid boolean"
    OUT = "ip string, ts_us long, seq long, hash string, outcome string, at timestamp"

    def __init__(self, ttl_s: int, session_ttl_s: int):
        self.ttl_us, self.session_us = ttl_s * US, session_ttl_s * US

    def init(self, handle) -> None:
        super().init(handle)
        self.claim = handle.getValueState("claim", "asked_us long, held string, since_us long")

    def fold(self, rows, passed_us):
        asked, held, since = self.claim.get() if self.claim.exists() else (None, None, None)
        at = pd.Timestamp(passed_us + 1000, unit="us")
        for ts_us, kind, seq, value, valid in rows:
            if kind == 0:
                asked = ts_us
                continue
            if not valid:
                outcome = "BAD_HASH"
            elif asked is None or ts_us - asked > self.session_us:
                outcome = "NO_SESSION"
            elif since is None or ts_us - since > self.ttl_us:
                held, since, outcome = value, ts_us, "ACCEPTED"
            else:
                outcome = "REPEAT" if value == held else "ALREADY_BOUND"
            yield ts_us, seq, value, outcome, at
        ends = max((asked or 0) + self.session_us, (since or 0) + self.ttl_us)
        if ends < passed_us:
            self.claim.clear()
        else:
            self.claim.update((asked, held, since))
            self.handle.registerTimer(ends // 1000 + 1)


class Sharing(StatefulProcessor):
    """How many addresses used a fingerprint so far in its window, per accepted submission.

    The window lasts while acceptances come at most its length apart: one timer, moved by each of
    them, empties the map of addresses. The rows of a micro-batch lie between two watermarks, as
    the operator before gives them out, so they are taken in order.
    """

    OUT = "ip string, hash string, ts_us long, seq long, shared_ips long"

    def __init__(self, window_s: int):
        self.window_us = window_s * US

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us long, n long")
        self.ips = handle.getMapState("ips", "ip string", "at_us long")

    def handleInputRows(self, key, rows, timerValues):
        last_us, n = self.last.get() if self.last.exists() else (None, 0)
        if last_us is not None:
            self.handle.deleteTimer(self._ends(last_us))
        known, out = set(), []
        found = pd.concat(list(rows)).sort_values(["ts_us", "seq"], kind="stable")
        for ip, ts_us, seq in zip(found["ip"].tolist(), found["ts_us"].tolist(), found["seq"].tolist(), strict=True):
            if last_us is not None and ts_us - last_us > self.window_us:
                self.ips.clear()
                known, n = set(), 0
            if ip not in known:
                if not self.ips.containsKey((ip,)):
                    self.ips.updateValue((ip,), (ts_us,))
                    n += 1
                known.add(ip)
            last_us = ts_us
            out.append((ip, key[0], ts_us, seq, n))
        self.last.update((last_us, n))
        self.handle.registerTimer(self._ends(last_us))
        yield from _frames(out, [c.split()[0] for c in self.OUT.split(", ")])

    def _ends(self, last_us: int) -> int:
        return (last_us + self.window_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists() and self._ends(self.last.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            self.ips.clear()
        return iter([])
