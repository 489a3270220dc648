"""What the last requests of a client add up to, kept up to date request by request.

A client's history is its last ``keep`` requests. Instead of looking at all of them for every
request, ``RetainedWindow`` adds the new request to its totals and takes the oldest one back out:
sums are exact integers, extremes and click bursts are queues whose outdated entries leave at the
front, and entropies are sums of a table of c * log2(c) that change by one entry. A request costs a
fixed number of steps, whatever ``keep`` is. Batch and stream run the same class.
"""

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from .features import CLICK_WINDOW_S, COUNTED, _flag_bits
from .sessions import sessionize

#: Fractions are kept as whole multiples of 2**-40, so that what is added can be taken out again.
UNIT = 1 << 40
#: Facts about a path (and, last, about the agent), one bit each.
FACTS = ("page", "scanner", "protected", "botnet", "grpc", "api", "language")
PAGE, SCANNER, PROTECTED, BOTNET, GRPC, API, LANGUAGE = (1 << i for i in range(len(FACTS)))
NIGHT = 1 << COUNTED.index("night")
HTML = 1 << COUNTED.index("html")
#: Totals next to those of COUNTED, by what a request's facts and flags say.
WEIGHED = {
    "pages": lambda flags, facts: facts & PAGE,
    "night_pages": lambda flags, facts: facts & PAGE and flags & NIGHT,
    "scanner_hits": lambda flags, facts: facts & SCANNER,
    "protected_hits": lambda flags, facts: facts & PROTECTED,
    "botnet_hits": lambda flags, facts: facts & BOTNET,
    "page_like_hits": lambda flags, facts: facts & PAGE and not facts & API,
    "language_rows": lambda flags, facts: facts & LANGUAGE,
}
TOTALS = [*COUNTED, *WEIGHED]

#: One request as the window takes it.
ITEM = "ts_us long, path string, agent string, status string, flags int, facts int, bits long"
ITEM_COLUMNS = [c.split()[0] for c in ITEM.split(", ")]
#: One row of inputs of features and rules.
INPUTS = (
    "user_agent string, requests long, start_us long, end_us long, top_endpoint string, top_hits long, paths long,"
    " agents long, path_nlogn double, status_nlogn double, path_bits double, grpc_paths long, min_gap_us long,"
    " max_gap_us long, gap_sq_high long, gap_sq_low long, clicks long, last_60s long, last_300s long, "
    + ", ".join(f"{name} long" for name in TOTALS)
)
INPUT_COLUMNS = [c.split()[0] for c in INPUTS.split(", ")]


def item_columns() -> list[Column]:
    """ITEM from a request; a missing path or status counts as an empty one."""
    path = F.coalesce(X.url_path(F.col("url")), F.lit(""))
    agent = F.coalesce(F.col("user_agent"), F.lit(""))
    held = [
        ~X.is_static_file(path), X.is_scanner_path(path), X.is_protected_path(path), X.is_botnet_path(path),
        X.is_grpc_path(path), X.is_api_route(path), X.sends_accept_language(agent),
    ]
    facts = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(held)), F.lit(0))
    return [
        F.col("ts_us"),
        path.alias("path"),
        agent.alias("agent"),
        F.coalesce(F.col("status").cast("string"), F.lit("")).alias("status"),
        _flag_bits().cast("int").alias("flags"),
        facts.cast("int").alias("facts"),
        F.round(F.coalesce(X.char_entropy(path), F.lit(0.0)) * UNIT).cast("long").alias("bits"),
    ]


class Totals:
    """Exact sums over requests, which can be taken out again."""

    _hits = {}

    def __init__(self):
        self.sums = [0] * len(TOTALS)
        self.bits = self.gap_sq = 0

    def count(self, flags: int, facts: int, bits: int, sign: int) -> None:
        hits = self._hits.get((flags, facts))
        if hits is None:
            hits = [i for i in range(len(COUNTED)) if flags >> i & 1]
            hits += [len(COUNTED) + i for i, held in enumerate(WEIGHED.values()) if held(flags, facts)]
            self._hits[flags, facts] = hits
        for i in hits:
            self.sums[i] += sign
        self.bits += sign * bits

    def squares(self) -> tuple[int, int]:
        """The sum of squared gaps as a high part and the low 32 bits."""
        return self.gap_sq >> 32, self.gap_sq & 0xFFFFFFFF


class RetainedWindow(Totals):
    """The last ``keep`` requests of one client, in order of time."""

    _n_log_n = [0, 0]

    def __init__(self, keep: int):
        super().__init__()
        while len(self._n_log_n) < keep + 2:
            c = len(self._n_log_n)
            self._n_log_n.append(round(c * math.log2(c) * UNIT))
        self.keep = keep
        self.items = deque()
        self.at = 0  # requests so far; the window holds the last ones of them
        self.paths, self.agents, self.status = {}, {}, {}  # value -> places in the window, or how often
        self.path_nlogn = self.status_nlogn = self.grpc = 0
        self.top = None
        self.shortest, self.longest = deque(), deque()  # (place, gap), the extreme one first
        self.since_60, self.since_300 = deque(), deque()  # times inside the last 60 and 300 seconds
        # page views: their times, (view, first view within the span before it), the best of them
        self.views, self.spans, self.best = deque(), deque(), deque()
        self.view_at = self.view_from = self.span_from = 0
        self.cut = -1  # last view whose span began before the window

    def add(self, ts_us, path, agent, status, flags, facts, bits) -> None:
        if len(self.items) == self.keep:
            self._drop()
        if self.items:
            gap = ts_us - self.items[-1][0]
            self.gap_sq += gap * gap
            while self.shortest and self.shortest[-1][1] >= gap:
                self.shortest.pop()
            while self.longest and self.longest[-1][1] <= gap:
                self.longest.pop()
            self.shortest.append((self.at, gap))
            self.longest.append((self.at, gap))
        self.items.append((ts_us, path, agent, status, flags, facts, bits))
        self.count(flags, facts, bits, 1)
        places = self.paths.setdefault(path, deque())
        if not places and facts & GRPC:
            self.grpc += 1
        self.path_nlogn += self._n_log_n[len(places) + 1] - self._n_log_n[len(places)]
        places.append(self.at)
        if self.top is not None and path != self.top:
            best = self.paths[self.top]
            if (len(places), -places[0]) > (len(best), -best[0]):
                self.top = path
        self.agents[agent] = self.agents.get(agent, 0) + 1
        n = self.status.get(status, 0)
        self.status_nlogn += self._n_log_n[n + 1] - self._n_log_n[n]
        self.status[status] = n + 1
        for times, span in ((self.since_60, 60_000_000), (self.since_300, 300_000_000)):
            times.append(ts_us)
            while ts_us - times[0] > span:
                times.popleft()
        if flags & HTML:
            self._view(ts_us)
        self.at += 1

    def _view(self, ts_us: int) -> None:
        self.views.append(ts_us)
        j = self.view_at
        self.view_at += 1
        self.span_from = max(self.span_from, self.view_from)
        while ts_us - self.views[self.span_from - self.view_from] > CLICK_WINDOW_S * 1_000_000:
            self.span_from += 1
        size = j - self.span_from + 1
        self.spans.append((j, self.span_from))
        while self.best and self.best[-1][2] <= size:
            self.best.pop()
        self.best.append((j, self.span_from, size))

    def _drop(self) -> None:
        """Take the oldest request out."""
        ts_us, path, agent, status, flags, facts, bits = self.items.popleft()
        first = self.at - self.keep  # its place
        if self.items:
            gap = self.items[0][0] - ts_us
            self.gap_sq -= gap * gap
            for queue in (self.shortest, self.longest):
                if queue and queue[0][0] <= first + 1:
                    queue.popleft()
        self.count(flags, facts, bits, -1)
        places = self.paths[path]
        places.popleft()
        self.path_nlogn += self._n_log_n[len(places)] - self._n_log_n[len(places) + 1]
        if not places:
            del self.paths[path]
            if facts & GRPC:
                self.grpc -= 1
        if path == self.top:
            self.top = None
        self.agents[agent] -= 1
        if not self.agents[agent]:
            del self.agents[agent]
        n = self.status[status]
        self.status_nlogn += self._n_log_n[n - 1] - self._n_log_n[n]
        self.status[status] = n - 1
        if n == 1:
            del self.status[status]
        for times in (self.since_60, self.since_300):
            if len(times) > len(self.items):
                times.popleft()
        if flags & HTML:
            self.views.popleft()
            self.view_from += 1
            while self.spans and self.spans[0][1] < self.view_from:
                self.cut = self.spans.popleft()[0]
            while self.best and self.best[0][1] < self.view_from:
                self.best.popleft()

    def inputs(self) -> tuple:
        """INPUTS of the requests in the window, the last of which names the agent."""
        if self.top is None:
            self.top = max(self.paths, key=lambda p: (len(self.paths[p]), -self.paths[p][0]))
        start, end, n = self.items[0][0], self.items[-1][0], len(self.items)
        clicks = max(self.cut - self.view_from + 1, self.best[0][2] if self.best else 0)
        return (
            self.items[-1][2], n, start, end, self.top, len(self.paths[self.top]), len(self.paths),
            len(self.agents), self.path_nlogn / UNIT, self.status_nlogn / UNIT, self.bits / UNIT, self.grpc,
            self.shortest[0][1] if n > 1 else None, self.longest[0][1] if n > 1 else None, *self.squares(),
            max(clicks, 0), len(self.since_60), len(self.since_300), *self.sums,
        )


def completed(rows: DataFrame) -> DataFrame:
    """Rows of INPUTS with the two columns that follow from them."""
    return rows.withColumn("language_agents", (F.col("language_rows") > 0).cast("long")).withColumn(
        "duration", (F.col("end_us") - F.col("start_us")) / 1e6
    ).drop("language_rows")


def retained_inputs(
    requests: DataFrame,
    keep=P.RETAINED_REQUESTS,
    keys=("ip",),
    timeout_s=P.SESSION_TIMEOUT_S,
    block=4000,
) -> DataFrame:
    """For every request the inputs of features and rules from the last ``keep`` requests of its
    session up to itself, with session_no, session_pos and line_no.

    A session is cut into blocks of ``block`` positions, each led in by the ``keep - 1`` requests
    before it, so one busy client is the work of many tasks. Blocks lie in order in a partition and
    run through one window each; nothing is gathered.
    """
    keys = list(keys)
    rows = sessionize(requests, keys, timeout_s)
    home = F.floor((F.col("session_pos") - 1) / block)
    feeds_next = F.col("session_pos") > (home + 1) * block - (keep - 1)
    blocks = F.when(feeds_next, F.sequence(home, home + 1 + F.floor(F.lit((keep - 2) // block)))).otherwise(F.array(home))
    placed = rows.select(
        *keys, "session_no", "session_pos", "line_no", *item_columns(), F.explode(blocks).alias("block")
    ).where(F.col("session_pos") > F.col("block") * block - (keep - 1))
    group = [*keys, "session_no", "block"]
    ordered = placed.repartition(*group).sortWithinPartitions(*group, "session_pos")

    def walk(batches):
        import pyarrow as pa

        current, window = None, None
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            found, at = [], []
            for i, key in enumerate(zip(*(columns[c] for c in group), strict=True)):
                if key != current:
                    current, window = key, RetainedWindow(keep)
                window.add(*(columns[c][i] for c in ITEM_COLUMNS))
                if columns["session_pos"][i] > key[-1] * block:
                    at.append(i)
                    found.append(window.inputs())
            kept = batch.select([*keys, "session_no", "session_pos", "line_no"]).take(pa.array(at, pa.int64()))
            inputs = zip(*found, strict=True) if found else [[]] * len(INPUT_COLUMNS)
            kinds = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in INPUTS.split(", ")]
            values = [pa.array(c, k) for c, k in zip(inputs, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *values], names=[*kept.schema.names, *INPUT_COLUMNS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields if f.name in (*keys, "session_no", "session_pos", "line_no"))
    names = [*keys, "session_no", "session_pos", "line_no"]
    return completed(ordered.mapInArrow(walk, f"{schema}, {INPUTS}").select(*names, *INPUT_COLUMNS))
