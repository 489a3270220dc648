"""Live evaluation: evidence from access logs joined with archived decisions."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.address import mask_ip
from ..functions.scoring import blend

FINGERPRINT_PATH = "/traffic/fp"


def _remote(ip: Column) -> Column:
    return ~ip.isin(*P.LOOPBACK_ADDRESSES)


def evidence(requests: DataFrame, invite_tokens, fingerprint_path=FINGERPRINT_PATH) -> DataFrame:
    """Per address: requests, honeypot, probe, invited, ran the fingerprint script."""
    url, path = F.col("url"), X.split_path(F.col("url"))
    invited = F.arrays_overlap(
        X.query_values(url, P.INVITE_PARAMETER), F.array(*[F.lit(t) for t in invite_tokens])
    )
    ran = (F.col("method") == "POST") & (path == fingerprint_path) & (F.col("status") == 200)
    return (
        requests.filter(_remote(F.col("ip")))
        .groupBy("ip")
        .agg(
            F.count("*").alias("requests"),
            F.bool_or(path.startswith(P.HONEYPOT_PREFIX)).alias("hit_honeypot"),
            F.bool_or(X.is_probe_path(path)).alias("hit_probe"),
            F.bool_or(F.coalesce(invited, F.lit(False))).alias("invited"),
            F.bool_or(ran).alias("ran_fingerprint"),
        )
    )


def verdicts(archive: DataFrame) -> DataFrame:
    """Per address: best scores, any bot rule, the set of rule names (a few dozen at most)."""
    name = X.rule_name(F.col("heuristic_reason"))
    return (
        archive.filter(F.col("ip").isNotNull() & F.col("score").isNotNull() & _remote(F.col("ip")))
        .groupBy("ip")
        .agg(
            F.max("score").alias("max_score"),
            F.max("model_score").alias("max_model_score"),
            F.coalesce(F.bool_or(F.col("heuristic_label") == "bot"), F.lit(False)).alias(
                "heuristic_bot"
            ),
            F.array_sort(F.collect_set(F.when(F.col("heuristic_reason") != "", name))).alias(
                "reasons"
            ),
        )
    )


def actors(seen: DataFrame, judged: DataFrame) -> DataFrame:
    """Full outer join of evidence and verdicts, both one row per address, with truth."""
    no = F.lit(False)
    joined = seen.join(judged, "ip", "full_outer").select(
        "ip",
        F.coalesce("requests", F.lit(0)).alias("requests"),
        *[
            F.coalesce(c, no).alias(c)
            for c in ("hit_honeypot", "hit_probe", "invited", "ran_fingerprint", "heuristic_bot")
        ],
        "max_score",
        "max_model_score",
        F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )
    bot = F.col("hit_honeypot") | F.col("hit_probe")
    human = F.col("invited") & F.col("ran_fingerprint")
    truth = (
        F.when(bot & human, "conflict").when(bot, "bot").when(human, "human").otherwise("unlabeled")
    )
    return joined.withColumn("truth", truth)


def scored(actors_: DataFrame) -> DataFrame:
    return actors_.filter(F.col("max_score").isNotNull())


def coverage(actors_: DataFrame, minimum=P.MIN_ACTORS_PER_CLASS) -> DataFrame:
    """One row: actors per class, invited ones that ran the script, whether conclusive."""
    is_ = lambda t: F.count_if(F.col("truth") == t)
    return scored(actors_).agg(
        is_("bot").alias("bots"),
        is_("human").alias("humans"),
        is_("conflict").alias("conflicts"),
        is_("unlabeled").alias("unlabeled"),
        F.count_if("invited").alias("invited"),
        F.count_if(F.col("invited") & F.col("ran_fingerprint")).alias("invited_ran"),
    ).withColumn("inconclusive", (F.col("bots") < minimum) | (F.col("humans") < minimum))


def threshold_sweep(actors_: DataFrame, thresholds=P.EVALUATION_THRESHOLDS) -> DataFrame:
    """Per flag rule: caught and total for bots, honeypot-only bots and humans.

    One aggregation computes every cell; the wide row is then turned into a table.
    """
    rules = [("heuristic label is bot", F.col("heuristic_bot"))]
    rules += [(f"score > {t:.2f}", F.col("max_score") > t) for t in thresholds]
    rules += [(f"model score > {t:.2f}", F.col("max_model_score") > t) for t in thresholds]
    groups = {
        "bots": F.col("truth") == "bot",
        "honeypot_bots": (F.col("truth") == "bot") & ~F.col("hit_probe"),
        "humans": F.col("truth") == "human",
    }
    cells = [
        F.struct(
            F.lit(name).alias("flag_rule"),
            *[F.count_if(members & flagged).alias(f"{g}_flagged") for g, members in groups.items()],
            *[F.count_if(members).alias(f"{g}_total") for g, members in groups.items()],
        )
        for name, flagged in rules
    ]
    return (
        scored(actors_)
        .agg(F.array(*cells).alias("cells"))
        .select(F.explode("cells").alias("cell"))
        .select("cell.*")
    )


def reasons_by_truth(actors_: DataFrame) -> DataFrame:
    """Reason by truth, most frequent reason first."""
    counts = (
        scored(actors_)
        .select("truth", F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .pivot("truth", ["bot", "human", "conflict", "unlabeled"])
        .count()
        .na.fill(0)
    )
    total = reduce(lambda a, b: a + b, [F.col(c) for c in ("bot", "human", "conflict", "unlabeled")])
    return counts.withColumn("total", total).orderBy(F.col("total").desc(), "reason")


def grey_actors(actors_: DataFrame, threshold=P.BLOCK_THRESHOLD, limit=20, redact=False) -> DataFrame:
    """The top unlabeled actors above the threshold."""
    shown = mask_ip(F.col("ip")) if redact else F.col("ip")
    return (
        scored(actors_)
        .filter((F.col("truth") == "unlabeled") & (F.col("max_score") > threshold))
        .orderBy(F.col("max_score").desc(), "ip")
        .limit(limit)
        .select(shown.alias("ip"), "max_score", "requests")
    )


# --- a lab run with exact truth ------------------------------------------------------------


def _rates(tp: Column, fp: Column, bots: Column, humans: Column) -> list[Column]:
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp, tp + fp), zero)
    recall = F.coalesce(F.try_divide(tp, bots), zero)
    return [
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero).alias("f1"),
        F.coalesce(F.try_divide(fp, humans), zero).alias("fpr"),
    ]


def scorecard(judged: DataFrame, truth: DataFrame, thresholds=P.EVALUATION_THRESHOLDS) -> DataFrame:
    """Per detector and threshold: confusion, precision, recall, F1 and FPR.

    ``truth`` is (ip, is_bot); actors without decisions are left out (see ``unscored``).
    """
    rules = [("heuristic", None, F.col("heuristic_bot"))]
    for name, column in (("model", "max_model_score"), ("blend", "max_score")):
        rules += [(name, t, F.coalesce(F.col(column) > t, F.lit(False))) for t in thresholds]
    bot = F.col("is_bot")
    cells = [
        F.struct(
            F.lit(name).alias("detector"),
            F.lit(t).cast("double").alias("threshold"),
            F.count_if(bot & hit).alias("tp"),
            F.count_if(~bot & hit).alias("fp"),
            F.count_if(bot).alias("bots"),
            F.count_if(~bot).alias("humans"),
        )
        for name, t, hit in rules
    ]
    table = (
        judged.join(truth, "ip")
        .agg(F.array(*cells).alias("cells"))
        .select(F.explode("cells").alias("cell"))
        .select("cell.*")
    )
    return table.select(
        "*", *_rates(F.col("tp"), F.col("fp"), F.col("bots"), F.col("humans"))
    )


def safe_thresholds(card: DataFrame) -> DataFrame:
    """Per detector the lowest threshold that flags no human, and the bots caught there."""
    return (
        card.filter(F.col("threshold").isNotNull() & (F.col("fp") == 0))
        .groupBy("detector")
        .agg(
            F.min("threshold").alias("threshold"),
            F.min_by("tp", "threshold").alias("bots_caught"),
            F.first("bots").alias("bots"),
        )
    )


def unscored(judged: DataFrame, truth: DataFrame) -> DataFrame:
    """Actors of the truth table that never got a decision."""
    return truth.join(judged, "ip", "left_anti").select("ip")


# --- one actor ------------------------------------------------------------------------------


_EXPLAINED = [
    "requests", "duration", "user_agent", "rule_code", "heuristic_label", "heuristic_confidence", "promoted", "resolved", "fp_resolved",
    "tor_exit", "hosting_range", "abuse_score", "fingerprint_hash", "shared_hash_ips",
]


def explain_actors(scored_sessions: DataFrame, requests: DataFrame, block=P.BLOCK_THRESHOLD) -> DataFrame:
    """Per address its latest session: deciding rule, rule-only score, last three urls and
    whether each signal is enforced or only observed.

    ``scored_sessions`` carries SIGNALS columns and verdicts.
    """
    # only what is shown below: other columns of a session would be computed and sorted as well
    latest = scored_sessions.groupBy("ip").agg(F.max_by(F.struct(*_EXPLAINED), "session_no").alias("s"))
    recent = _last_urls(requests)
    state = lambda source: F.when(X.is_promoted(source), "enforced").otherwise("observe-only")
    flat = latest.select("ip", "s.*")
    return (
        flat.join(recent, "ip")
        .select(
            "ip",
            "requests",
            "duration",
            "user_agent",
            "last_urls",
            "rule_code",
            "heuristic_label",
            "heuristic_confidence",
            blend(F.col("heuristic_label"), F.col("heuristic_confidence"), F.lit(0.0)).alias(
                "rule_only_score"
            ),
            F.lit(block).alias("block_threshold"),
            "resolved",
            "tor_exit",
            "hosting_range",
            "abuse_score",
            "fingerprint_hash",
            "shared_hash_ips",
            state("tor").alias("tor_state"),
            state("abuseipdb").alias("abuse_state"),
            F.lit("observe-only").alias("hosting_state"),
            state("fingerprint").alias("fingerprint_state"),
        )
    )


def _last_urls(requests: DataFrame, n=3) -> DataFrame:
    """(ip, last_urls): the latest ``n`` urls in order.

    The rank limit is applied before the shuffle, so a busy client sends ``n`` rows per
    partition.
    """
    back = Window.partitionBy("ip").orderBy(
        F.col("ts_us").desc(), F.col("src_file").desc(), F.col("src_block").desc(), F.col("line_no").desc()
    )
    return (
        requests.select("ip", "ts_us", "src_file", "src_block", "line_no", "url")
        .withColumn("back", F.row_number().over(back))
        .filter(F.col("back") <= n)
        .groupBy("ip")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("k"), "url"))).alias("r"))
        .select("ip", F.transform("r", lambda x: x["url"]).alias("last_urls"))
    )
