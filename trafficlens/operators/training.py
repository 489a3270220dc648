"""Training of the small network and of baseline classifiers.

The 85 weights live on the driver.  Each step is one pass over the (cached) rows: every
task sums the gradient of its rows, Spark adds the sums, the driver takes the step.
"""

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scoring import HIDDEN, Network, hidden_sums, network_score, normalised
from ..schema import FEATURES, UA_FEATURES
from ..sources.archive import require_feedback
from .datasets import ranges

WIDTH = len(FEATURES) + 1
SIZE = HIDDEN * WIDTH + HIDDEN + 1


class DegenerateModelError(RuntimeError):
    """The network answers every row the same although both classes were shown."""


def fit_ranges(dataset: DataFrame) -> tuple[tuple, tuple]:
    row = ranges(dataset).first()
    return (
        tuple(float(row[f"min_{f}"]) for f in FEATURES),
        tuple(float(row[f"max_{f}"]) for f in FEATURES),
    )


def random_network(seed: int) -> tuple:
    """Uniform weights, zero biases."""
    rng = np.random.default_rng(seed)
    weights = rng.uniform(-1, 1, SIZE)
    weights[[k * WIDTH + WIDTH - 1 for k in range(HIDDEN)] + [SIZE - 1]] = 0.0
    return tuple(float(w) for w in weights)


def gradient_sums(batches, weights):
    """Sum over rows of the gradient of (output - target)^2, target +1 or -1."""
    hidden = np.asarray(weights[: HIDDEN * WIDTH]).reshape(HIDDEN, WIDTH)
    out = np.asarray(weights[HIDDEN * WIDTH :])
    total, loss, rows = np.zeros(SIZE), 0.0, 0
    for pdf in batches:
        x = np.column_stack([pdf[FEATURES].to_numpy(float), np.ones(len(pdf))])
        target = np.where(pdf["label"].to_numpy() > 0.5, 1.0, -1.0)
        units = np.maximum(x @ hidden.T, 0.0)
        error = units @ out[:-1] + out[-1] - target
        back = (2 * error)[:, None] * out[:-1] * (units > 0)
        total[: HIDDEN * WIDTH] += (back.T @ x).ravel()
        total[HIDDEN * WIDTH : -1] += (2 * error) @ units
        total[-1] += (2 * error).sum()
        loss += float((error**2).sum())
        rows += len(pdf)
    yield pd.DataFrame([[*total, loss, rows]], columns=[*_names(), "loss", "rows"])


def _names():
    return [f"g{i}" for i in range(SIZE)]


_SCHEMA = ", ".join(f"{n} double" for n in [*_names(), "loss", "rows"])


def _step(rows: DataFrame, weights: tuple, rate: float) -> tuple[tuple, float]:
    sums = (
        rows.mapInPandas(lambda it: gradient_sums(it, weights), _SCHEMA)
        .agg(*[F.sum(n).alias(n) for n in [*_names(), "loss", "rows"]])
        .first()
    )
    n = sums["rows"]
    moved = tuple(w - rate * sums[g] / n for w, g in zip(weights, _names()))
    return moved, sums["loss"] / n


def check_not_degenerate(dataset: DataFrame, network: Network) -> None:
    """Given both classes, the answers must be of both kinds too."""
    hit = network_score(network) > 0.5
    row = dataset.agg(
        F.count_if(F.col("label") > 0.5).alias("bots"),
        F.count("*").alias("n"),
        F.count_if(hit).alias("said_bot"),
    ).first()
    if 0 < row.bots < row.n and row.said_bot in (0, row.n):
        raise DegenerateModelError(f"all {row.n} rows get the same answer")


def has_live_unit(dataset: DataFrame, network: Network) -> bool:
    """Whether any hidden unit fires on any row; silent ones have no gradient."""
    fires = F.expr(" OR ".join(f"({total}) > 0" for total in hidden_sums(network)))
    return bool(dataset.agg(F.bool_or(fires)).first()[0])


def train(
    dataset: DataFrame,
    start: Network | None = None,
    epochs=100,
    rate=0.05,
    attempts=5,
    seed=0,
    drop=(),
) -> Network:
    """Full-batch descent; starts over when the result is a constant answer.

    ``start`` fine-tunes a network on its own input ranges; otherwise ranges come from
    the data and weights are drawn.  ``drop`` holds features at the neutral value.
    """
    if start is None:
        mins, maxs = fit_ranges(dataset)
        frame = Network(random_network(seed), mins, maxs, frozenset(drop))
    else:
        frame = start
        if not has_live_unit(dataset, start):
            raise DegenerateModelError("no hidden unit of the base network fires on these rows")
    scaled = dataset.select(
        *[c.alias(f) for f, c in zip(FEATURES, normalised([F.col(f) for f in FEATURES], frame))],
        F.col("label").cast("double").alias("label"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for attempt in range(attempts):
            weights = frame.weights if start or attempt == 0 else random_network(seed + attempt)
            # A constant start stays constant for a full-batch fine-tune; a smaller step helps.
            step = rate / (attempt + 1) if start else rate
            for _ in range(epochs):
                weights, _loss = _step(scaled, weights, step)
            found = replace(frame, weights=weights)
            try:
                check_not_degenerate(dataset, found)
            except DegenerateModelError:
                if attempt + 1 == attempts:
                    raise
                continue
            return found
        raise DegenerateModelError("no attempt was made")
    finally:
        scaled.unpersist()


def fine_tune(corrections: DataFrame, base: Network, min_rows=P.MIN_CORRECTIONS,
              max_share=P.MAX_CLASS_SHARE, epochs=100, rate=0.05) -> Network:
    """A new network from operator corrections (features array, label); ``base`` is kept.

    Both feedback rails are checked before anything is trained.
    """
    require_feedback(corrections, min_rows, max_share)
    rows = corrections.select(
        *[F.col("features")[i].alias(f) for i, f in enumerate(FEATURES)], "label"
    )
    return train(rows, start=base, epochs=epochs, rate=rate)


def train_without_agent(dataset: DataFrame, **options) -> Network:
    """Ablation: the three user-agent features carry no information."""
    return train(dataset, drop=tuple(UA_FEATURES), **options)


def train_baseline(dataset: DataFrame, kind: str, drop=(), trees=200, seed=0):
    """Balanced logistic regression or a random forest over scaled features."""
    kept = [f for f in FEATURES if f not in drop]
    stages = [
        VectorAssembler(inputCols=kept, outputCol="raw"),
        MinMaxScaler(inputCol="raw", outputCol="scaled"),
    ]
    rows = dataset
    if kind == "logistic":
        share = dataset.agg(F.count("*").alias("n"), F.sum("label").alias("bots")).first()
        weight = F.when(F.col("label") > 0.5, share.n / (2 * share.bots)).otherwise(
            share.n / (2 * (share.n - share.bots))
        )
        rows = dataset.withColumn("class_weight", weight)
        model = LogisticRegression(featuresCol="scaled", weightCol="class_weight", maxIter=1000)
    elif kind == "forest":
        model = RandomForestClassifier(featuresCol="scaled", numTrees=trees, seed=seed)
    else:
        raise ValueError(f"unknown baseline {kind!r}")
    return Pipeline(stages=[*stages, model]).fit(rows)


def held_out_baseline(split: DataFrame, kind: str, drop=(), trees=200, seed=0) -> DataFrame:
    """Rows of both sides with the score of a baseline that was fitted on the side ``train`` only."""
    known = split.filter("split = 'train'")
    classes = known.select((F.col("label") > 0.5).alias("bot")).distinct().count()
    if classes < 2:
        raise ValueError("the training side holds one class only")
    return baseline_scores(train_baseline(known, kind, drop, trees, seed), split)


def log_loss(dataset: DataFrame, network: Network) -> float:
    """Mean cross-entropy of the network's answers."""
    p = F.least(F.greatest(network_score(network), F.lit(1e-12)), F.lit(1 - 1e-12))
    return dataset.agg(F.avg(-F.when(F.col("label") > 0.5, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def baseline_scores(fitted, dataset: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return (
        fitted.transform(dataset)
        .withColumn("score", vector_to_array("probability")[1])
        .drop("raw", "scaled", "rawPrediction", "probability", "prediction", "class_weight")
    )


def holdout_metrics(dataset: DataFrame, score: Column, threshold=0.5) -> DataFrame:
    """Confusion and rates per ``split``."""
    from .metrics import confusion

    return confusion(dataset, score > threshold, F.col("label") > 0.5, by=("split",))


def recall_by_provenance(dataset: DataFrame, score: Column, threshold=0.5) -> DataFrame:
    """Of the bot rows: detected of all, per split and provenance."""
    return (
        dataset.filter(F.col("label") > 0.5)
        .groupBy("split", "provenance")
        .agg(F.count_if(score > threshold).alias("detected"), F.count("*").alias("bots"))
        .withColumn("recall", F.col("detected") / F.col("bots"))
    )
