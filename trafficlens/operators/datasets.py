"""Labelled feature tables for training, and the checks that keep them honest.

DATASET: 19 feature columns, label (1 bot, 0 human), group_id, provenance, day.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..schema import FEATURES
from .features import session_features
from .groundtruth import label_sessions as forensic_labels
from .ranks import running_totals
from .rules import with_verdict

COLUMNS = [*FEATURES, "label", "group_id", "provenance", "day"]


def arithmetic_hash(value: Column, seed: int = 0) -> Column:
    """A spread of whole numbers any SQL engine can repeat; not for security."""
    return F.pmod((value + seed) * 2654435761, F.lit(1000003))


def cap_per_group(rows: DataFrame, keys, limit: int, order) -> DataFrame:
    """At most ``limit`` rows per group by a deterministic order.

    A rank limit is applied before the shuffle, so a huge group sends ``limit`` rows per
    partition and not itself.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= limit)
        .drop("_rank")
    )


def rule_labelled(requests: DataFrame, keys=("ip",), min_requests=P.MIN_SESSION_REQUESTS) -> DataFrame:
    """Sessions with enough requests; only the verdict bot is a positive."""
    rows = with_verdict(session_features(requests, keys))
    return rows.filter(F.col("requests") >= min_requests).withColumn(
        "label", F.when(F.col("heuristic_label") == "bot", 1.0).otherwise(0.0)
    )


def forensic_bots(requests: DataFrame, rules: DataFrame, keys=("ip", "user_agent"),
                  min_requests=P.MIN_SESSION_REQUESTS, prefix="") -> DataFrame:
    """Bot rows: sessions matched by a forensic rule, else those the rule chain calls bots.

    Sessions neither of them calls a bot are dropped, not taken for humans.
    """
    keys = list(keys)
    truth = forensic_labels(requests, rules, keys).select(*keys, "session_no", "category")
    source = requests
    if "user_agent" in keys:
        source = requests.withColumn("agent_key", F.col("user_agent"))
        truth = truth.withColumnRenamed("user_agent", "agent_key")
        keys = ["agent_key" if k == "user_agent" else k for k in keys]
    rows = with_verdict(session_features(source, keys)).join(truth, [*keys, "session_no"])
    matched = F.col("category").isNotNull()
    return (
        rows.filter((F.col("requests") >= min_requests) & (matched | (F.col("heuristic_label") == "bot")))
        .withColumn("label", F.lit(1.0))
        .withColumn("group_id", F.concat(F.lit(prefix), F.concat_ws("|", *keys)))
        .withColumn(
            "provenance",
            F.when(matched, F.concat(F.lit("ground_truth:"), "category")).otherwise("heuristic"),
        )
        .withColumn("day", F.lit("forensic"))
    )


def external_humans(rows: DataFrame, row_no: Column, name: str) -> DataFrame:
    """Human rows of another source (features, label): a group of its own each, as nothing is known of
    who sent them, and the source as provenance."""
    return rows.filter(F.col("label") <= 0.5).select(
        *FEATURES,
        F.lit(0.0).alias("label"),
        F.concat(F.lit(f"{name}_human_"), row_no.cast("string")).alias("group_id"),
        F.lit(f"{name}_human").alias("provenance"),
        F.lit(name).alias("day"),
    )


def real_dataset(bots: DataFrame, humans: DataFrame, supplement: DataFrame | None = None) -> DataFrame:
    """Observed bots with the humans of another source; made-up bots only top a small class up."""
    whole = combine(bots, humans)
    return whole if supplement is None else top_up(whole, supplement)


def same_site(requests: DataFrame, labels: DataFrame, site: str, min_requests=P.MIN_SESSION_REQUESTS,
              per_actor=P.MAX_SESSIONS_PER_ACTOR) -> DataFrame:
    """Rows of labelled actors of one site, per day: at most ``per_actor`` sessions each.

    ``labels`` is (day, ip, label); sessions do not cross days.
    """
    bots = ("verified_crawler", "unverified_crawler", "probe_bot")
    wanted = labels.filter(F.col("label").isin("human_proxy", *bots)).select(
        F.col("day").alias("local_date"), "ip", F.col("label").alias("actor_label")
    )
    kept = requests.join(wanted.select("local_date", "ip"), ["local_date", "ip"], "left_semi")
    sessions = session_features(kept, keys=("local_date", "ip")).filter(
        F.col("requests") >= min_requests
    )
    capped = cap_per_group(
        sessions,
        ("local_date", "ip"),
        per_actor,
        (arithmetic_hash(F.col("session_no")), F.col("session_no")),
    )
    day = F.col("local_date").cast("string")
    return capped.join(wanted, ["local_date", "ip"]).select(
        *FEATURES,
        F.when(F.col("actor_label").isin(*bots), 1.0).otherwise(0.0).alias("label"),
        F.concat(F.lit(f"{site}_"), day, F.lit("_"), X.actor_hash(day, F.col("ip"))).alias("group_id"),
        F.concat(F.lit(f"{site}_"), "actor_label", F.lit("_"), day).alias("provenance"),
        day.alias("day"),
    )


def combine(*parts: DataFrame) -> DataFrame:
    out = None
    for part in parts:
        rows = part.select(*COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out


def top_up_size(bots: int, humans: int, fraction=P.MAX_TOPUP_FRACTION) -> int:
    """How many supplementary bot rows may join: never more than ``fraction`` of the target."""
    target = max(bots, int(humans * 0.5))
    return min(int(target * fraction), max(0, target - bots))


def top_up(dataset: DataFrame, supplement: DataFrame) -> DataFrame:
    """Union with the first allowed supplementary rows, by group_id, then by a hash of the row."""
    row = dataset.agg(
        F.count_if(F.col("label") > 0.5).alias("bots"),
        F.count_if(F.col("label") <= 0.5).alias("humans"),
    ).first()
    allowed = top_up_size(row.bots, row.humans)
    rows = supplement.select(*COLUMNS)
    place = F.concat_ws("\u0000", F.coalesce("group_id", F.lit("")), F.hex(F.xxhash64(*COLUMNS)))
    same = rows.groupBy(*COLUMNS).agg(F.count("*").alias("same")).withColumn("place", place)
    same = running_totals(same, "place", {"same": "upto"})
    taken = F.least(F.col("same"), allowed - (F.col("upto") - F.col("same")))
    first = same.filter(taken > 0).select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), taken)))
    return combine(dataset, first)


# --- splits ---------------------------------------------------------------------------------


def ranges(dataset: DataFrame) -> DataFrame:
    """One row: minimum and maximum of every feature, in one aggregation."""
    return dataset.agg(
        *[F.min(f).alias(f"min_{f}") for f in FEATURES],
        *[F.max(f).alias(f"max_{f}") for f in FEATURES],
    )


def group_holdout(dataset: DataFrame, row_no: Column, order: Column, fraction=0.2) -> DataFrame:
    """Add ``split``: whole groups go to test, at least one per class, the rest to train.

    The class of a group is that of its first row.  Of each class the first
    ``max(1, int(n * fraction))`` groups by ``order`` (a hash of group_id) are held out.
    Counting groups below a group's hash would need a sort per class; the ranks come from
    running totals over the hash instead, so no class is one task.
    """
    groups = (
        dataset.withColumn("_row", row_no)
        .groupBy("group_id")
        .agg((F.min_by("label", "_row") > 0.5).alias("is_bot"))
        .withColumn("_order", order)
    )
    # Distinct sort keys: the hash first, the name decides between equal hashes.
    per_hash = groups.groupBy("is_bot", "_order").agg(F.count("*").alias("n"))
    upto = running_totals(per_hash, "_order", {"n": "upto"}, partition=("is_bot",))
    sizes = groups.groupBy("is_bot").agg(F.count("*").alias("groups"))
    same_hash = Window.partitionBy("is_bot", "_order").orderBy("group_id")
    placed = (
        groups.join(upto, ["is_bot", "_order"])
        .join(sizes, "is_bot")
        .withColumn("place", F.col("upto") - F.col("n") + F.row_number().over(same_hash))
    )
    held = F.greatest(F.lit(1), F.floor(F.col("groups") * F.lit(fraction)))
    sides = placed.select(
        "group_id", F.when(F.col("place") <= held, "test").otherwise("train").alias("split")
    )
    return dataset.join(sides, "group_id")


def day_holdout(dataset: DataFrame, test_days) -> DataFrame:
    return dataset.withColumn(
        "split", F.when(F.col("day").isin(*test_days), "test").otherwise("train")
    )


def training_rows(rows: DataFrame, seeds, levels, order, per_actor=P.MAX_ROWS_PER_ACTOR) -> DataFrame:
    """Rows of the given runs; bots only of the given levels, humans always; capped."""
    wanted = F.col("seed").isin(*seeds) & ((F.col("label") <= 0.5) | F.col("level").isin(*levels))
    return cap_per_group(rows.filter(wanted), ("seed", "ip"), per_actor, order)


# --- checks ---------------------------------------------------------------------------------


def _class_profile(dataset: DataFrame) -> DataFrame:
    """Per feature: minimum and maximum in each class, from one aggregation."""
    bot = F.col("label") > 0.5
    pick = lambda f, side: F.when(side, F.col(f))
    cells = [
        F.struct(
            F.lit(f).alias("feature"),
            F.min(pick(f, ~bot)).alias("human_min"),
            F.max(pick(f, ~bot)).alias("human_max"),
            F.min(pick(f, bot)).alias("bot_min"),
            F.max(pick(f, bot)).alias("bot_max"),
        )
        for f in FEATURES
    ]
    return (
        dataset.agg(F.array(*cells).alias("cells"))
        .select(F.explode("cells").alias("cell"))
        .select("cell.*")
    )


def leakage(dataset: DataFrame) -> DataFrame:
    """Per feature its class ranges and two findings.

    ``one_sided``   constant in exactly one class: it names the source, not the behaviour
    ``separates``   the classes do not overlap at all: it is the label in disguise
    """
    human_constant = F.col("human_min") == F.col("human_max")
    bot_constant = F.col("bot_min") == F.col("bot_max")
    both = F.col("human_min").isNotNull() & F.col("bot_min").isNotNull()
    apart = (F.col("human_max") < F.col("bot_min")) | (F.col("bot_max") < F.col("human_min"))
    return _class_profile(dataset).withColumns(
        {
            "one_sided": F.coalesce(human_constant, F.lit(False))
            != F.coalesce(bot_constant, F.lit(False)),
            "separates": both & F.coalesce(apart, F.lit(False)),
        }
    )


def human_sources(dataset: DataFrame) -> DataFrame:
    """One row: provenances of the human class, and whether there is more than one."""
    return dataset.agg(
        F.count_distinct(F.when(F.col("label") <= 0.5, F.col("provenance"))).alias("human_sources")
    ).withColumn("diverse", F.col("human_sources") > 1)


def actor_scores(rows: DataFrame, score: Column) -> DataFrame:
    """An actor's score is the highest of its rows."""
    return rows.groupBy("ip").agg(F.max(score).alias("score"), F.first("label").alias("label"))


def masked_changes(dataset: DataFrame, network, masked, threshold=0.5) -> DataFrame:
    """One row: how many decisions change when some features read 0."""
    from ..functions.scoring import network_score

    full = network_score(network)
    blind = network_score(network, ["0D" if f in masked else f for f in FEATURES])
    return dataset.select((full > threshold).alias("full"), (blind > threshold).alias("blind")).agg(
        F.count("*").alias("rows_compared"),
        F.count_if(F.col("full") != F.col("blind")).alias("rows_changed"),
        F.count_if("full").alias("flagged_full"),
        F.count_if("blind").alias("flagged_masked"),
    )


