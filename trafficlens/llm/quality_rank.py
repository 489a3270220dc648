"""Quality scores by Bradley-Terry ranking: learned from pairs, cut at a quantile.

A document of label 1 is preferred to one of label 0. The model gives each document a worth, a
linear function of features of its text, such that the log odds of a preference are the difference
of two worths. That is a logistic regression without intercept on feature differences. The share
of label 0 among the labelled documents is the quantile of worths at which documents are split;
the score is the logistic function of the worth beyond that cut, so 0.5 is the cut.
"""

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stored, text_batches, word_hashes

#: Documents of the other label that each one is compared with at least.
RIVALS = 4
#: Ranges of hashes in which labelled documents are numbered, and bins of a round of ``value_at``.
HASH_BITS = 10
BINS = 4096

FEATURES = [
    "log_bytes", "log_words", "word_length", "distinct_words", "short_words", "upper", "digits",
    "symbols", "bars", "commas", "stops", "shouts", "line_length", "repeated_lines", "entropy", "other_bytes",
]
SCHEMA = ", ".join(f"{f} double" for f in FEATURES)

_GROUPS = {
    "upper": range(65, 91),
    "digits": range(48, 58),
    "symbols": b"#$%&*+<>=@\\^_`~/{}[]",
    "bars": b"|",
    "commas": b",;:",
    "stops": b".",
    "shouts": b"!?",
}
_WEIGHTS = np.zeros((len(_GROUPS), 256))
for _i, _bytes in enumerate(_GROUPS.values()):
    _WEIGHTS[_i, list(_bytes)] = 1


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text; all zero for an empty one."""
    words, bounds = word_hashes(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        n = len(text)
        count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        n_words = int(bounds[i + 1] - bounds[i])
        white = int(count[9:14].sum() + count[32])
        groups = _WEIGHTS @ count / n
        share = count[count > 0] / n
        lines = text.split(b"\n")
        short = sum(map(text.count, (b" a ", b" I ", b" of ", b" to ", b" in ", b" de ", b" la ", b" le ", b" zu ", b" y ")))
        out[i] = [
            math.log1p(n),
            math.log1p(n_words),
            math.log1p((n - white) / max(1, n_words)),
            len(np.unique(words[bounds[i] : bounds[i + 1]])) / max(1, n_words),
            short / max(1, n_words),
            *groups,
            math.log1p(n / len(lines)),
            1 - len(set(lines)) / len(lines),
            -float(share @ np.log2(share)),
            count[128:].sum() / n,
        ]
    return out


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and FEATURES."""
    kept = [c for c in docs.columns if c != text]

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, texts in text_batches(batch, text):
                f = text_features(texts)
                part = batch.slice(a, b - a)
                columns = {k: part.column(k) for k in kept} | {k: pa.array(f[:, i]) for i, k in enumerate(FEATURES)}
                yield pa.record_batch(columns)

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(rows, f"{fields}, {SCHEMA}" if fields else SCHEMA)


@dataclass
class Ranking:
    """Weights of FEATURES and the worth at which the labelled documents are split."""

    weights: list[float]
    cut: float

    def score(self) -> Column:
        """0 to 1, from columns named as FEATURES."""
        worth = sum((F.col(f) * w for f, w in zip(FEATURES, self.weights, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), worth - self.cut))))

    def score_rows(self, features: np.ndarray) -> np.ndarray:
        """The same from an array of features."""
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights) - self.cut, -500, 500)))


def with_places(rows: DataFrame) -> DataFrame:
    """Add ``place``, from 0 within each ``quality``, by the hash of doc_id and then by ``f``.

    Numbered within ranges of the hash, each of which counts on from the sizes of those before it.
    """
    bucket = F.shiftright(F.xxhash64("doc_id"), 64 - HASH_BITS)
    ranged = rows.withColumn("bucket", bucket)
    before = Window.partitionBy("quality").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("quality", "bucket").agg(F.count("*").alias("n"))
    sizes = sizes.select("quality", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("quality", "bucket").orderBy(F.xxhash64("doc_id"), "f")) - 1
    placed = ranged.withColumn("inside", inside).join(F.broadcast(sizes), ["quality", "bucket"])
    return placed.withColumn("place", F.col("first") + F.col("inside")).drop("bucket", "inside", "first")


def value_at(values: DataFrame, column: str, at: float) -> float:
    """The exact quantile ``at`` of a column of finite doubles, interpolated as ``percentile`` does.

    Each round counts the values of a range in BINS bins and goes on in the bin that holds the
    rank, so the driver gets BINS rows a round and no task more than its own rows.
    """
    v = F.col(column)
    n, low, high = values.agg(F.count(v), F.min(v), F.max(v)).first()
    position = (n - 1) * at
    rank, skipped = math.floor(position), 0
    while low < high:
        inside = F.floor((v - F.lit(low)) / F.lit(high - low) * BINS)
        bins = values.where((v >= low) & (v <= high)).groupBy(inside.alias("bin"))
        for _, count, low, high in sorted(bins.agg(F.count("*"), F.min(v), F.max(v)).collect()):
            if skipped + count > rank:
                break
            skipped += count
    upto, above = values.agg(F.count_if(v <= low), F.min(F.when(v > low, v))).first()
    after = math.ceil(position)
    if after < upto:
        return low
    return (after - position) * low + (position - rank) * above


def fit_ranking(features: DataFrame, labels: DataFrame) -> Ranking:
    """Learn from ``features`` (doc_id, FEATURES) and ``labels`` (doc_id, quality 0 or 1).

    A doc_id that is null, or whose labels are null or differ, is left out; all other labelled
    documents take part in the preferences and in the cut. Without both labels nothing can be
    ranked: all weights are 0 and all scores 0.5.
    """
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("hi"), F.count("quality").alias("n"), F.count("*").alias("m")
    )
    labels = labels.where("quality = hi and n = m and quality in (0, 1)").select("doc_id", "quality")
    rows = stored(features.join(labels, "doc_id").select("quality", F.array(*FEATURES).alias("f"), "doc_id"), "labelled")
    counts = dict(rows.groupBy("quality").count().collect())
    if len(counts) < 2:
        return Ranking([0.0] * len(FEATURES), 0.0)
    # each document meets RIVALS of the other label: places by hash order, wrapped around
    placed = with_places(rows)
    good, poor = placed.where("quality = 1"), placed.where("quality = 0")
    least, most = min(counts.values()), max(counts.values())
    many, few = (good, poor) if counts[1] == most else (poor, good)
    rival = F.explode(F.sequence(F.lit(0), F.lit(RIVALS - 1)))
    many = many.withColumn("rival", rival)
    many = many.withColumn("place", F.pmod(F.col("place") * RIVALS + F.col("rival"), F.lit(least)))
    met = many.select("place", F.col("f").alias("x")).join(few.select("place", F.col("f").alias("y")), "place")
    sign = 1.0 if counts[1] == most else -1.0
    ahead = F.zip_with("x", "y", lambda x, y: (x - y) * sign)
    behind = F.zip_with("x", "y", lambda x, y: (y - x) * sign)
    pairs = met.select(ahead.alias("d"), F.lit(1.0).alias("label")).union(met.select(behind, F.lit(0.0)))
    pairs = stored(pairs.select(array_to_vector("d").alias("features"), "label"), "preferences")
    model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=40).fit(pairs)
    weights = [float(w) for w in model.coefficients]
    worth = sum((F.col("f")[i] * w for i, w in enumerate(weights)), F.lit(0.0))
    at = counts[0] / (counts[0] + counts[1])
    return Ranking(weights, value_at(stored(rows.select(worth.alias("worth")), "worths"), "worth", at))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Labels of ids with crc32(doc_id as text) mod ``folds`` = ``held_out`` are not learned from. A
    null id is not held out and has no label. Null and empty texts get the score of features that
    are all zero. Repeated rows are scored alike. Other columns are left aside.
    """
    features = stored(with_features(docs.select("doc_id", F.col("text").cast("string").alias("text"))), "features")
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit_ranking(features, labels.where(fold != held_out))
    out = features.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns."""
    features = with_features(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    model = fit_ranking(features, labels)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, texts in text_batches(batch, "text"):
                yield batch.slice(a, b - a).filter(pa.array(model.score_rows(text_features(texts)) >= 0.5))

    return mapped(docs, rows, docs.schema)
