"""Detectors behind one shape: VERDICT (ip, detector, flagged, first_flag, score).

A detector is a function of the request table and the decision table.  Positions are
1-based in the client's own order.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scoring as S
from ..functions import text as X
from .metrics import clearly_above, detection_delay, with_rate
from .sessions import rate_limited, sessionize

#: name -> (what flags a row, score or None), over requests and over decisions. Columns are made
#: when they are used: at import there is no session.
REQUEST_HITS: dict[str, Callable[[], tuple[Column, Column | None]]] = {
    "ua_regex": lambda: (X.is_baseline_bot_agent(F.col("user_agent")), None),
    "path_blocklist": lambda: (X.is_blocked_url(F.col("url")), None),
}
DECISION_HITS: dict[str, Callable[[], tuple[Column, Column | None]]] = {
    "rules": lambda: (F.col("heuristic_label") == "bot", None),
    "blend": lambda: (F.col("score") > P.BLOCK_THRESHOLD, F.col("score")),
    "model": lambda: (F.col("model_score") > 0.5, F.col("model_score")),
}
DETECTORS = (*REQUEST_HITS, "rate_limit", *DECISION_HITS)


def first_hits(rows: DataFrame, hits: dict[str, tuple[Column, Column | None]], also=None) -> DataFrame:
    """VERDICT rows of several detectors over one pass of ``rows`` (ip, pos and more).

    A detector flags a client at the first position where its condition holds; its score is the
    best one. ``also`` is (name, table of ip and first_flag) to be joined to the same clients.
    """
    found = []
    for name, (hit, score) in hits.items():
        found.append(F.min(F.when(hit, F.col("pos"))).cast("long").alias(f"first_{name}"))
        best = F.lit(None) if score is None else F.max(score)
        found.append(best.cast("double").alias(f"score_{name}"))
    table = rows.groupBy("ip").agg(*found)
    names = list(hits)
    if also is not None:
        name, flags = also
        flags = flags.select("ip", F.col("first_flag").cast("long").alias(f"first_{name}"))
        table = table.join(flags, "ip", "left").withColumn(f"score_{name}", F.lit(None).cast("double"))
        names.append(name)
    cells = [
        F.struct(
            F.lit(name).alias("detector"),
            F.col(f"first_{name}").isNotNull().alias("flagged"),
            F.col(f"first_{name}").alias("first_flag"),
            F.col(f"score_{name}").alias("score"),
        )
        for name in names
    ]
    return table.select("ip", F.explode(F.array(*cells)).alias("v")).select("ip", "v.*")


def ordered_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions with ``pos`` in the client's history; needs ts and a tie-breaking line_no."""
    return sessionize(decisions)


def from_ip_set(requests: DataFrame, flagged_ips: DataFrame, name: str) -> DataFrame:
    """Verdicts computed elsewhere: an address is flagged if it is in the set."""
    marked = flagged_ips.select("ip").distinct().withColumn("hit", F.lit(True))
    return (
        requests.select("ip")
        .distinct()
        .join(marked, "ip", "left")
        .select(
            "ip",
            F.lit(name).alias("detector"),
            F.col("hit").isNotNull().alias("flagged"),
            F.lit(None).cast("long").alias("first_flag"),
            F.lit(None).cast("double").alias("score"),
        )
    )


def from_scan(sessions: DataFrame, name="scan") -> DataFrame:
    """Offline scan: flagged if any session is a bot; the best session score."""
    return sessions.groupBy("ip").agg(
        F.bool_or(F.col("label") == "bot").alias("flagged"), F.max("score").alias("score")
    ).select(
        "ip",
        F.lit(name).alias("detector"),
        "flagged",
        F.lit(None).cast("long").alias("first_flag"),
        "score",
    )


def rescored(decisions: DataFrame, predict: Callable[[str], Column], threshold: float,
             name="rescored", blended=True) -> DataFrame:
    """Swap the model under archived decisions: same actors, same requests, same rules."""
    model = predict("features")
    value = model
    if blended:
        confidence = S.recovered_confidence(
            F.col("heuristic_label"), F.col("score"), F.col("model_score"), F.col("heuristic_reason")
        )
        value = F.when(F.col("heuristic_label") == "automated-integration", 0.0).otherwise(
            S.blend(F.col("heuristic_label"), confidence, model)
        )
    rows = ordered_decisions(decisions.filter(F.col("features").isNotNull()))
    return first_hits(rows.withColumn("_value", value), {name: (F.col("_value") > threshold, F.col("_value"))})


def run_detectors(requests: DataFrame, decisions: DataFrame, names=None) -> DataFrame:
    """All verdicts: requests and decisions are put in order once each."""
    names = list(DETECTORS if names is None else names)
    on_requests = {n: REQUEST_HITS[n]() for n in names if n in REQUEST_HITS}
    on_decisions = {n: DECISION_HITS[n]() for n in names if n in DECISION_HITS}
    parts = []
    if "rate_limit" in names:
        over = ("rate_limit", rate_limited(requests))
        parts.append(first_hits(sessionize(requests), on_requests, over))
    elif on_requests:
        parts.append(first_hits(sessionize(requests), on_requests))
    if on_decisions:
        parts.append(first_hits(ordered_decisions(decisions), on_decisions))
    return reduce(DataFrame.unionByName, parts)


def _names(verdicts: DataFrame, names) -> Column:
    """The detectors: those given, else those that occur, which costs a pass over the verdicts."""
    if names is not None:
        return F.array(*[F.lit(n) for n in names])
    return verdicts.agg(F.collect_set("detector")).scalar()


def for_actors(table: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows of the actors under test only."""
    return table.join(truth.select("ip").distinct(), "ip", "left_semi")


def rates_by_class(truth: DataFrame, verdicts: DataFrame, by=(), detectors=None) -> DataFrame:
    """Per detector and class: flagged k of n with interval.

    Every actor counts for every detector, flagged or not, so counts come from the truth
    table and hits from the verdicts.
    """
    names = list(by)
    totals = truth.groupBy(*names, "class").agg(F.count("*").alias("n"))
    hits = (
        truth.join(verdicts.filter("flagged").select("ip", "detector").distinct(), "ip")
        .groupBy(*names, "detector", "class")
        .agg(F.count("*").alias("k"))
    )
    cells = totals.withColumn("detector", F.explode(_names(verdicts, detectors)))
    return with_rate(
        cells.join(hits, [*names, "detector", "class"], "left").withColumn(
            "k", F.coalesce("k", F.lit(0))
        )
    )


def ladder(truth: DataFrame, verdicts: DataFrame, detectors=None) -> DataFrame:
    """Recall per (config, level, detector), pooled over seeds (seed NULL) and per seed.

    ``truth`` is (config, seed, ip, class, level), ``verdicts`` (config, seed, ip,
    detector, flagged).  Humans are one level of their own.
    """
    level = F.when(F.col("class") == "human", "humans").otherwise(F.col("level"))
    rows = (
        truth.withColumn("level", level)
        .withColumn("detector", F.explode(_names(verdicts, detectors)))
        .join(verdicts, ["config", "seed", "ip", "detector"], "left")
        .withColumn("hit", F.coalesce("flagged", F.lit(False)).cast("long"))
    )
    cells = rows.groupingSets(
        [("config", "level", "detector"), ("config", "level", "detector", "seed")],
        "config", "level", "detector", "seed",
    ).agg(F.sum("hit").alias("k"), F.count("*").alias("n"))
    return with_rate(cells)


def beats(cells: DataFrame, subject: str, baselines) -> DataFrame:
    """Per (config, level, baseline): recall clearly above and not more humans flagged.

    The detectors of a cell are put side by side in one aggregate; a config has a few levels.
    """
    of = F.map_from_entries(F.collect_list(F.struct("detector", F.struct("k", "n"))))
    pooled = cells.filter(F.col("seed").isNull() & F.col("detector").isin(subject, *baselines))
    levels = pooled.groupBy("config", "level").agg(of.alias("of"))
    people = F.first(F.when(F.col("level") == "humans", F.col("of")), ignorenulls=True)
    levels = levels.withColumn("humans", people.over(Window.partitionBy("config"))).filter(F.col("level") != "humans")
    rows = levels.withColumn("baseline", F.explode(F.array(*[F.lit(b) for b in baselines])))
    of = lambda column, detector: F.try_element_at(column, detector)
    ours, theirs = of(F.col("of"), F.lit(subject)), of(F.col("of"), F.col("baseline"))
    false_alarms = [of(F.col("humans"), d)["k"] for d in (F.lit(subject), F.col("baseline"))]
    return rows.filter(ours.isNotNull() & theirs.isNotNull()).select(
        "config",
        "level",
        "baseline",
        (clearly_above(ours["k"], ours["n"], theirs["k"], theirs["n"]) & (false_alarms[0] <= false_alarms[1])).alias("beats"),
    )


def delays(truth: DataFrame, verdicts: DataFrame, detectors=None) -> DataFrame:
    """Detection delay of the bots per detector; a bot without verdict is missed."""
    names = F.explode(_names(verdicts, detectors)).alias("detector")
    bots = truth.filter(F.col("class") == "bot").select("ip", names)
    return detection_delay(bots.join(verdicts, ["ip", "detector"], "left"), by=("detector",))


def marginal_catches(scores: DataFrame, rule_flagged: DataFrame, threshold=0.5, min_catches=1) -> DataFrame:
    """One row per level: bots a model catches that the rules miss, humans it adds.

    ``scores`` is (ip, is_bot, level, score); a model earns its place with at least
    ``min_catches`` in all and no added human.
    """
    extra = scores.filter(F.col("score") > threshold).join(rule_flagged, "ip", "left_anti")
    per_level = extra.groupBy("level").agg(
        F.count_if("is_bot").alias("marginal_catches"), F.count_if(~F.col("is_bot")).alias("added_fp")
    )
    total = per_level.agg(
        F.coalesce(F.sum("marginal_catches"), F.lit(0)).alias("marginal_catches"),
        F.coalesce(F.sum("added_fp"), F.lit(0)).alias("added_fp"),
    ).select(F.lit("all").alias("level"), "marginal_catches", "added_fp")
    return per_level.unionByName(total).withColumn(
        "earns_place",
        F.when(
            F.col("level") == "all",
            (F.col("marginal_catches") >= min_catches) & (F.col("added_fp") == 0),
        ),
    )
