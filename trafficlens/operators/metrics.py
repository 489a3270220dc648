"""Evaluation statistics as aggregations: rates, confusion, ROC, precision-recall, delay."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import score_bucket
from ..session import cut_lineage
from .ranks import boundaries, running_totals, value_counts

# Two-sided 95% point of the normal distribution.
Z95 = 1.959963984540054


# --- rates -----------------------------------------------------------------------------------


def wilson_low(k: Column, n: Column, z=Z95) -> Column:
    return _wilson(k, n, z, -1)


def wilson_high(k: Column, n: Column, z=Z95) -> Column:
    return _wilson(k, n, z, 1)


def _wilson(k: Column, n: Column, z: float, sign: int) -> Column:
    """A bound of the Wilson score interval; with no trials nothing is ruled out."""
    p = k / n
    z2 = F.lit(z * z)
    denominator = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / denominator
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / denominator
    bound = (
        F.greatest(F.lit(0.0), centre - half) if sign < 0 else F.least(F.lit(1.0), centre + half)
    )
    return F.when(n > 0, bound).otherwise(0.0 if sign < 0 else 1.0)


def clearly_above(k_a: Column, n_a: Column, k_b: Column, n_b: Column) -> Column:
    """Whether rate a lies above rate b with disjoint intervals."""
    return (n_a > 0) & (n_b > 0) & (wilson_low(k_a, n_a) > wilson_high(k_b, n_b))


def with_rate(df: DataFrame, k="k", n="n") -> DataFrame:
    return df.withColumns(
        {
            "rate": F.try_divide(F.col(k), F.col(n)),
            "ci_low": wilson_low(F.col(k), F.col(n)),
            "ci_high": wilson_high(F.col(k), F.col(n)),
        }
    )


# --- confusion --------------------------------------------------------------------------------


def confusion(df: DataFrame, flagged: Column, truth: Column, by=()) -> DataFrame:
    """tp, fp, fn, tn and the rates derived from them (0 where undefined)."""
    zero = F.lit(0.0)
    counts = df.groupBy(*by).agg(
        F.count_if(flagged & truth).alias("tp"),
        F.count_if(flagged & ~truth).alias("fp"),
        F.count_if(~flagged & truth).alias("fn"),
        F.count_if(~flagged & ~truth).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    return (
        counts.withColumn("precision", part(tp, tp + fp))
        .withColumn("recall", part(tp, tp + fn))
        .withColumn(
            "f1",
            part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
        .withColumn("accuracy", part(tp + tn, tp + fp + fn + tn))
    )


def confusion_at(scores: DataFrame, threshold: float, by=()) -> DataFrame:
    """Of (score, label): flagged means score > threshold."""
    return confusion(scores, F.col("score") > threshold, F.col("label") > 0, by)


def confusion_of_verdicts(truth: DataFrame, verdicts: DataFrame, by=()) -> DataFrame:
    """Of truth (ip, is_bot) and verdicts (ip, flagged); no verdict means not flagged."""
    rows = truth.join(verdicts, "ip", "left").withColumn(
        "flagged", F.coalesce("flagged", F.lit(False))
    )
    return confusion(rows, F.col("flagged"), F.col("is_bot"), by)


# --- curves -----------------------------------------------------------------------------------


def _per_score(scores: DataFrame, by=()) -> DataFrame:
    """Bots and humans per distinct score: ties become one row before anything is ordered."""
    bot = (F.col("label") > 0).cast("long")
    return scores.groupBy(*by, "score").agg(F.sum(bot).alias("pos"), F.sum(1 - bot).alias("neg"))


def roc_curve(scores: DataFrame) -> DataFrame:
    """(threshold, tpr, fpr) for every distinct score and -1 and 1, flagged means above."""
    spark = scores.sparkSession
    ends = spark.createDataFrame([(-1.0,), (1.0,)], "score double").select(
        "score", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg")
    )
    points = (
        _per_score(scores.select(F.col("score").cast("double"), "label"))
        .unionByName(ends)
        .groupBy("score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    running = running_totals(points, "score", {"pos": "pos_upto", "neg": "neg_upto"})
    total = points.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).scalar()
    share = lambda done, all_: F.coalesce(F.try_divide(all_ - done, all_), F.lit(0.0))
    return running.withColumn("total", total).select(
        F.col("score").alias("threshold"),
        share(F.col("pos_upto"), F.col("total.pos")).alias("tpr"),
        share(F.col("neg_upto"), F.col("total.neg")).alias("fpr"),
    )


def roc_auc(scores: DataFrame, by=()) -> DataFrame:
    """Exact area by rank sums with average ranks; NULL unless both classes occur.

    A bot outranks all humans with lower scores and half of those with its own.
    """
    grouped = _per_score(scores, by)
    running = running_totals(grouped, "score", {"neg": "neg_upto"}, partition=by)
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    return running.groupBy(*by).agg(
        F.try_divide(
            F.sum(wins), F.sum("pos").cast("double") * F.sum("neg").cast("double")
        ).alias("auc")
    )


def average_precision(scores: DataFrame, by=()) -> DataFrame:
    """Step-wise area under precision-recall; equal scores are one step; NULL without bots."""
    grouped = _per_score(scores, by)
    running = running_totals(
        grouped, "score", {"pos": "tp", "neg": "fp"}, descending=True, partition=by
    )
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return running.groupBy(*by).agg(F.try_divide(F.sum(step), F.sum("pos")).alias("ap"))


def recall_without_false_alarms(scores: DataFrame) -> DataFrame:
    """One row: the lowest threshold no human exceeds, the bots above it, all bots.

    Bots above the highest human score are caught; of the observed scores that flag no
    human the smallest catches most.  Without any catch the threshold is 1.
    """
    human = F.col("label") <= 0
    top_human = scores.agg(F.max(F.when(human, F.col("score")))).scalar()
    safe = F.col("score") >= F.coalesce(F.col("top_human"), F.col("score"))
    marked = scores.withColumn("top_human", top_human)
    lowest = marked.agg(F.min(F.when(safe, F.col("score")))).scalar()
    bots = F.count_if(~human)
    caught = F.count_if(~human & (F.col("score") > F.col("lowest")))
    return scores.withColumn("lowest", lowest).agg(
        caught.alias("caught"),
        bots.alias("bots"),
        F.try_divide(caught, bots).alias("recall"),
        F.when(caught > 0, F.min("lowest")).otherwise(1.0).alias("threshold"),
    )


def score_histogram(scores: DataFrame, bins=20) -> DataFrame:
    return scores.groupBy(score_bucket(F.col("score"), bins).alias("bucket")).agg(
        F.count("*").alias("n")
    )


# --- delay ------------------------------------------------------------------------------------


def grouped_quantiles(table: DataFrame, value: str, by, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation) of ``value`` for many groups at once.

    Equal values are counted first; then one ranking over ranges of values serves all groups, so
    no group, however large, is held anywhere. Null values count in no group.
    """
    names = list(by)
    counts = table.filter(F.col(value).isNotNull()).groupBy(*names, value).agg(F.count("*").alias("m"))
    spans = running_totals(counts, value, {"m": "upto"}, partition=names)
    sizes = counts.groupBy(*names).agg(F.sum("m").alias("n"))
    placed = spans.join(sizes, names) if names else spans.withColumn("n", counts.agg(F.sum("m").alias("n")).scalar())

    def at(position):  # 0-based order statistic
        inside = (F.col("upto") - F.col("m") <= position) & (position < F.col("upto"))
        return F.max(F.when(inside, F.col(value)))

    out = []
    for name, share in shares.items():
        place = (F.col("n") - 1) * F.lit(share)
        low, part = F.floor(place), F.max(place - F.floor(place))
        out.append((at(low) + (at(F.ceil(place)) - at(low)) * part).cast("double").alias(name))
    return placed.groupBy(*names).agg(*out)


def detection_delay(verdicts: DataFrame, by=()) -> DataFrame:
    """Of bot verdicts (flagged, first_flag): caught, missed, median and 90th percentile of
    the position of the first flag (linear interpolation, exact)."""
    names = list(by)
    first = verdicts.withColumn("first_flag", F.when(F.col("flagged"), F.col("first_flag")))
    counts = first.groupBy(*names).agg(
        F.count("first_flag").alias("caught"),
        F.count_if(~F.coalesce("flagged", F.lit(False))).alias("missed"),
    )
    delays = grouped_quantiles(first, "first_flag", names, {"median_request": 0.5, "p90_request": 0.9})
    if names:
        return counts.join(delays, names, "left")
    both = delays.select(F.struct("median_request", "p90_request")).scalar()
    return counts.withColumn("both", both).select("*", "both.*").drop("both")


def model_spread(archive: DataFrame, by=()) -> DataFrame:
    """Median, exclusive interquartile range, extremes and near-constancy of model scores.

    The exclusive quartile sits at position q(n + 1) of the sorted scores.  It is read off
    the exact percentile of the inclusive scale at the same position.
    """
    n = F.count("model_score")
    base = archive.groupBy(*by).agg(
        n.alias("n"),
        F.min("model_score").alias("lo"),
        F.max("model_score").alias("hi"),
    )
    if by:
        counts = archive.groupBy(*by, "model_score").agg(F.count("*").alias("m"))
        spans = running_totals(counts, "model_score", {"m": "upto"}, partition=by)
    else:
        spans = value_counts(archive, "model_score").withColumnRenamed("n", "m")
    keyed = spans.join(base.select(*by, "n"), list(by)) if by else spans.withColumn(
        "n", base.select("n").scalar()
    )

    def at(position):  # 0-based order statistic
        inside = (F.col("upto") - F.col("m") <= position) & (position < F.col("upto"))
        return F.max(F.when(inside, F.col("model_score")))

    def quartile(i):
        # Place i * (n + 1) / 4 in the sorted scores, kept inside them.
        j = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(i * (F.col("n") + 1) / 4)))
        delta = i * (F.col("n") + 1) - j * 4
        return j, delta

    parts = []
    for i in (1, 3):
        j, delta = quartile(i)
        parts += [
            at(j - 1).alias(f"below{i}"),
            at(j).alias(f"above{i}"),
            F.max(delta).alias(f"delta{i}"),
        ]
    last = F.col("n") - 1
    middle = (at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2
    quartiles = keyed.groupBy(*by).agg(*parts, middle.alias("median"))
    value = lambda i: (
        F.col(f"below{i}") * (4 - F.col(f"delta{i}")) + F.col(f"above{i}") * F.col(f"delta{i}")
    ) / 4
    found = quartiles.select(*by, (value(3) - value(1)).alias("iqr"), "median")
    if by:
        joined = base.join(found, list(by))
    else:
        both = found.select(F.struct("iqr", "median")).scalar()
        joined = base.withColumn("both", both).select("*", "both.*").drop("both")
    spread = F.when(F.col("n") > 1, F.col("iqr")).otherwise(0.0)
    return joined.withColumn("iqr", spread).withColumn("near_constant", F.col("iqr") < 0.05)


def spread_by_config(archive: DataFrame, truth: DataFrame) -> DataFrame:
    """Per config, over its seeds: median of the medians, largest interquartile range, whether
    scores hardly vary, and the mean area under the ROC of the actors' highest scores.

    ``archive`` is (ip, model_score), ``truth`` (ip, config, seed, is_bot). Seeds with one class
    only have no area and are left out of its mean.
    """
    runs = ["config", "seed"]
    rows = archive.filter(F.col("model_score").isNotNull()).join(truth.select("ip", *runs, "is_bot"), "ip")
    spread = model_spread(rows, by=runs)
    actors = rows.groupBy(*runs, "ip").agg(F.max("model_score").alias("score"), F.max(F.col("is_bot").cast("int")).alias("label"))
    areas = roc_auc(actors, by=runs)
    medians = grouped_quantiles(spread, "median", ["config"], {"median_of_medians": 0.5})
    found = spread.join(areas, runs, "left").groupBy("config").agg(
        F.count("*").alias("seeds"), F.max("iqr").alias("max_iqr"), F.avg("auc").alias("mean_actor_auc")
    )
    return found.join(medians, "config").withColumn("near_constant", F.col("max_iqr") < 0.05)


# --- bootstrap --------------------------------------------------------------------------------

#: Chances of at most 0, 1, 2, ... in a Poisson law of mean 1, as shares of 2**64.
_POISSON = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(13)])
_DRAWS = (_POISSON * 2.0**64).astype(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _drawn(actors: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often every replicate draws each actor (by its 64-bit hash): the same in every task."""
    with np.errstate(over="ignore"):
        x = actors.view(np.uint64)[:, None] ^ (np.arange(replicates, dtype=np.uint64) + np.uint64(1 + seed * replicates)) * _STEP
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_DRAWS, (x ^ x >> np.uint64(31)).ravel(), side="right").reshape(x.shape).astype(np.float64)


def replicate_statistics(scores: DataFrame, key="ip", replicates=1000, seed=0, ranges=64) -> DataFrame:
    """(replicate, auc, ap) of all resamples at once; NULL where a replicate has one class only.

    ``scores`` is (key, score, label), one row per actor. The draws of an actor follow from its key
    and the replicate (a Poisson count, the distributed form of drawing with replacement), so two
    scorings of the same actors are resampled alike. Scores lie in ranges; a first pass adds up the
    draws per range, which gives every range what lies above it, and a second one the steps of both
    curves inside it. Only ``ranges`` x ``replicates`` sums leave the tasks.
    """
    spark = scores.sparkSession
    rows = scores.select(
        F.xxhash64(F.col(key).cast("string")).alias("actor"), F.col("score").cast("double").alias("score"),
        (F.col("label") > 0).alias("bot"),
    ).filter("score IS NOT NULL AND bot IS NOT NULL")
    rows = cut_lineage(rows)
    cuts = [float(c) for c in boundaries(rows, "score", ranges)]
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("score"))) if cuts else F.lit(0)
    rows = rows.withColumn("range_no", number.cast("long"))
    ordered = rows.repartition("range_no").sortWithinPartitions("range_no", F.desc("score"))

    def runs(batches):
        """Rows of one range, a few hundred at a time, no score cut in two unless it is longer."""
        for pdf in batches:
            for range_no, part in pdf.groupby("range_no", sort=False):
                for at in range(0, len(part), 400):
                    yield int(range_no), part.iloc[at : at + 400]

    def totals(batches):
        sums = {}
        for range_no, part in runs(batches):
            drawn = _drawn(part["actor"].to_numpy(), replicates, seed)
            bot = part["bot"].to_numpy()
            state = sums.setdefault(range_no, np.zeros((2, replicates)))
            state[0] += drawn[bot].sum(axis=0)
            state[1] += drawn[~bot].sum(axis=0)
        for range_no, state in sums.items():
            yield pd.DataFrame({"range_no": [range_no], "pos": [state[0].tolist()], "neg": [state[1].tolist()]})

    found = rows.mapInPandas(totals, "range_no long, pos array<double>, neg array<double>")
    parts = found.groupBy("range_no").applyInPandas(
        lambda pdf: pd.DataFrame(
            {"range_no": pdf["range_no"].iloc[:1], "pos": [np.sum(list(pdf["pos"]), axis=0)], "neg": [np.sum(list(pdf["neg"]), axis=0)]}
        ),
        found.schema,
    ).collect()  # one row per range
    size = 1 + max((r.range_no for r in parts), default=0)
    sums = np.zeros((2, size, replicates))
    for r in parts:
        sums[0, r.range_no] += r.pos
        sums[1, r.range_no] += r.neg
    above = np.cumsum(sums[:, ::-1], axis=1)[:, ::-1] - sums
    known = spark.sparkContext.broadcast((above, sums.sum(axis=1)))

    def steps(batches):
        above, (_, humans) = known.value
        current, state = None, None
        for range_no, part in runs(batches):
            if range_no != current:
                if state is not None:
                    yield done(current, state, humans)
                current, state = range_no, start(range_no, above)
            add(state, part, humans)
        if state is not None:
            yield done(current, state, humans)

    def start(range_no, above):
        zero = np.zeros(replicates)
        return {"tp": above[0, range_no].copy(), "fp": above[1, range_no].copy(), "wins": zero.copy(), "ap": zero.copy(),
                "score": None, "pos": zero.copy(), "neg": zero.copy()}

    def close(state, humans):
        """The score that is open becomes one step of both curves."""
        state["tp"] += state["pos"]
        state["fp"] += state["neg"]
        seen = state["tp"] + state["fp"]
        state["ap"] += state["pos"] * np.divide(state["tp"], seen, out=np.zeros(replicates), where=seen > 0)
        state["wins"] += state["pos"] * (humans - state["fp"] + state["neg"] / 2)
        state["pos"], state["neg"] = np.zeros(replicates), np.zeros(replicates)

    def add(state, part, humans):
        drawn, bot = _drawn(part["actor"].to_numpy(), replicates, seed), part["bot"].to_numpy()
        score = part["score"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(score)) + 1).tolist(), len(score)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if state["score"] is not None and score[i] != state["score"]:
                close(state, humans)
            state["score"] = score[i]
            state["pos"] += drawn[i:j][bot[i:j]].sum(axis=0)
            state["neg"] += drawn[i:j][~bot[i:j]].sum(axis=0)

    def done(range_no, state, humans):
        close(state, humans)
        return pd.DataFrame({"replicate": np.arange(replicates), "wins": state["wins"], "ap": state["ap"]})

    curves = ordered.mapInPandas(steps, "replicate long, wins double, ap double")
    curves = curves.groupBy("replicate").agg(F.sum("wins").alias("wins"), F.sum("ap").alias("ap"))
    bots, humans = sums.sum(axis=1)
    classes = spark.createDataFrame(
        pd.DataFrame({"replicate": np.arange(replicates), "bots": bots, "humans": humans})
    )
    return classes.join(curves, "replicate", "left").select(
        "replicate",
        F.when((F.col("bots") > 0) & (F.col("humans") > 0), F.col("wins") / (F.col("bots") * F.col("humans"))).alias("auc"),
        F.when(F.col("bots") > 0, F.col("ap") / F.col("bots")).alias("ap"),
    )


def interval(statistics: DataFrame, column: str, replicates: int) -> DataFrame:
    """One row (low, high, survivors): the middle 95% of a column over the replicates.

    Replicates without the statistic are dropped; fewer than half left gives NULL.
    """
    alive = F.array_sort(F.array_compact(F.collect_list(column)))
    n = F.size("alive")
    pick = lambda at: F.element_at("alive", (at + 1).cast("int"))
    enough = (n >= replicates // 2) & (n > 0)
    return statistics.agg(alive.alias("alive")).select(
        F.when(enough, pick(F.floor(F.lit(0.025) * (n - 1)))).alias("low"),
        F.when(enough, pick(F.ceil(F.lit(0.975) * (n - 1)))).alias("high"),
        n.alias("survivors"),
    )


def bootstrap_auc(scores: DataFrame, replicates=1000, seed=0, ranges=64, key="ip") -> DataFrame:
    """One row (low, high, survivors): percentile interval of the AUC over actors."""
    return interval(replicate_statistics(scores, key, replicates, seed, ranges), "auc", replicates)


def bootstrap_intervals(scores: DataFrame, other: DataFrame | None = None, replicates=1000, seed=0, key="ip") -> DataFrame:
    """(statistic, point, low, high, survivors) of AUC and average precision; with ``other``, a second
    scoring of the same actors, of the differences (first less second), on paired draws."""
    drawn = cut_lineage(replicate_statistics(scores, key, replicates, seed))
    points = [roc_auc(scores).select("auc").scalar(), average_precision(scores).select("ap").scalar()]
    if other is not None:
        second = replicate_statistics(other, key, replicates, seed).toDF("replicate", "auc_b", "ap_b")
        drawn = cut_lineage(
            drawn.join(second, "replicate").select("replicate", (F.col("auc") - F.col("auc_b")).alias("auc"), (F.col("ap") - F.col("ap_b")).alias("ap"))
        )
        of_other = [roc_auc(other).select("auc").scalar(), average_precision(other).select("ap").scalar()]
        points = [a - b for a, b in zip(points, of_other, strict=True)]
    rows = [
        interval(drawn, name, replicates).select(F.lit(name).alias("statistic"), point.alias("point"), "low", "high", "survivors")
        for name, point in zip(("auc", "ap"), points, strict=True)
    ]
    return rows[0].unionByName(rows[1])
