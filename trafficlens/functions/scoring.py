"""Normalisation, the small network, the blend and the labels derived from a score."""

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FEATURES
from . import patterns as P

HIDDEN = 4
DEFAULT_NETWORK = Path(__file__).parent.parent / "data" / "network.json"


@dataclass(frozen=True)
class Network:
    """19 inputs, 4 rectified units, 1 output: 85 numbers plus the input ranges."""

    weights: tuple
    mins: tuple | None = None
    maxs: tuple | None = None
    # Inputs held at the neutral value 0.5, whatever the data says.
    neutral: frozenset = field(default_factory=frozenset)

    def __post_init__(self):
        expected = HIDDEN * (len(FEATURES) + 1) + HIDDEN + 1
        if len(self.weights) != expected:
            raise ValueError(f"need {expected} weights, got {len(self.weights)}")

    def hidden_units(self):
        """(weights, bias) of each hidden unit."""
        width = len(FEATURES) + 1
        for k in range(HIDDEN):
            row = self.weights[k * width : (k + 1) * width]
            yield row[:-1], row[-1]

    def output_unit(self):
        row = self.weights[HIDDEN * (len(FEATURES) + 1) :]
        return row[:-1], row[-1]

    def save(self, path):
        doc = {"weights": list(self.weights), "mins": self.mins, "maxs": self.maxs}
        Path(path).write_text(json.dumps(doc), encoding="utf-8")


def load_network(path=DEFAULT_NETWORK) -> Network:
    """Weights and ranges together; a missing file or half a model is an error."""
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    if not doc.get("mins") or not doc.get("maxs"):
        raise ValueError(f"{path} holds weights without normalisation ranges")
    return Network(tuple(doc["weights"]), tuple(doc["mins"]), tuple(doc["maxs"]))


def min_max(value: Column, lo, hi) -> Column:
    """Scale to 0..1 without clipping; a range of zero gives 0.5.  Bounds are numbers."""
    return (value - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.5)


def normalised(inputs, network: Network):
    if network.mins is None:
        columns = list(inputs)
    else:
        columns = [min_max(x, lo, hi) for x, lo, hi in zip(inputs, network.mins, network.maxs)]
    return [F.lit(0.5) if n in network.neutral else c for n, c in zip(FEATURES, columns)]


def normalise_array(vector: Column, mins: Column, maxs: Column) -> Column:
    """Element-wise min-max of an array column with array bounds."""
    span = F.zip_with(mins, maxs, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    return F.zip_with(
        vector,
        span,
        lambda x, b: F.when(b["hi"] > b["lo"], (x - b["lo"]) / (b["hi"] - b["lo"])).otherwise(0.5),
    )


def _folded(network: Network, weights, bias):
    """Weights and bias acting on raw inputs: the scaling is folded in, which keeps the
    generated code to one multiplication and addition per input."""
    out, shift = [], bias
    for i, (name, w) in enumerate(zip(FEATURES, weights)):
        if name in network.neutral:
            shift += 0.5 * w
            out.append(0.0)
        elif network.mins is None:
            out.append(w)
        elif network.maxs[i] > network.mins[i]:
            span = network.maxs[i] - network.mins[i]
            out.append(w / span)
            shift -= w * network.mins[i] / span
        else:
            shift += 0.5 * w
            out.append(0.0)
    return out, shift


def hidden_sums(network: Network, inputs=None) -> list[str]:
    """SQL text of the weighted sum entering each hidden unit."""
    names = list(inputs or FEATURES)
    sums = []
    for weights, bias in network.hidden_units():
        folded, shift = _folded(network, weights, bias)
        terms = [f"{w!r}D * {x}" for w, x in zip(folded, names) if w != 0.0]
        sums.append(" + ".join([f"{shift!r}D", *terms]))
    return sums


def network_score(network: Network, inputs=None) -> Column:
    """Probability of automation from 19 numbers, given as SQL texts (by default the
    feature columns).  A plain arithmetic expression inside generated code."""
    out_w, out_b = network.output_unit()
    units = [
        f"{w!r}D * greatest(0D, {total})" for w, total in zip(out_w, hidden_sums(network, inputs))
    ]
    logit = " + ".join([f"{out_b!r}D", *units])
    return F.expr(f"1D / (1D + exp(-greatest(-500D, least(500D, {logit}))))")


def array_score(network: Network, vector: str) -> Column:
    """The same over one array column, as archived decisions hold it."""
    return network_score(network, [f"{vector}[{i}]" for i in range(len(FEATURES))])


def once(value: Column) -> Column:
    """Evaluate a large expression exactly once per row.

    Without this the optimizer copies it into every filter on a column derived from it,
    where it may appear dozens of times.  A one-element explode stops the copying.
    """
    return F.explode(F.array(value))


def blend(label: Column, confidence: Column, model_score: Column) -> Column:
    """60% model, 40% rules; a bot rule is a floor, a human rule a ceiling."""
    mixed = F.lit(0.6) * model_score + F.lit(0.4) * confidence
    return (
        F.when(label == "bot", F.greatest(mixed, confidence))
        .when(label == "human", F.least(mixed, F.lit(1.0) - confidence))
        .otherwise(mixed)
    )


def risk(score: Column) -> Column:
    return (
        F.when(score <= 0.30, "SAFE")
        .when(score <= 0.59, "LOW")
        .when(score <= 0.79, "WARNING")
        .otherwise("DANGER")
    )


def traffic_status(bot_rate: Column) -> Column:
    return F.when(bot_rate < 0.1, "HEALTHY").when(bot_rate < 0.3, "WARNING").otherwise("CRITICAL")


def score_bucket(score: Column, bins: int = 20) -> Column:
    return F.least((score * bins).cast("int"), F.lit(bins - 1))


def recovered_confidence(label: Column, score: Column, model_score: Column, reason: Column) -> Column:
    """Which rule confidence reproduces an archived blend; NULL unless exactly one does.

    Where two human confidences fit, the start of the reason decides.
    """

    def fits(value, options):
        known = F.array(*[F.lit(c) for c in options])
        return F.filter(known, lambda c: F.abs(blend(F.lit(value), c, model_score) - score) <= 1e-9)

    named = F.filter(
        F.array(
            *[
                F.struct(F.lit(text).alias("text"), F.lit(conf).alias("conf"))
                for text, conf in P.HUMAN_REASON_PREFIXES
            ]
        ),
        lambda n: reason.startswith(n["text"]),
    )
    options = dict(P.RULE_CONFIDENCES)
    human = fits("human", options["human"])
    settled = F.when(
        F.size(human) > 1, F.array_intersect(human, F.transform(named, lambda n: n["conf"]))
    ).otherwise(human)
    found = F.when(label == "bot", fits("bot", options["bot"])).when(label == "human", settled)
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))
