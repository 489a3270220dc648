"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained on the URLs that a rule decides. Features: length, depth, digit ratio,
entropy, parameter counts, and statistics of suffixes: how often labelled URLs of the same host
suffix, registered domain or opening path segment are blocked. A labelled URL's own label is taken
out of its statistics.
"""

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Labelled URLs that the trees are trained on at most (about; chosen by hash).
MAX_LABELLED = 20_000
LEXICAL = [
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "hyphens",
    "entropy", "parameters", "parameter_length", "has_fragment", "secure",
]
SUFFIXES = ["suffix", "domain", "opening"]
STATISTICS = [f"{s}_{k}" for s in SUFFIXES for k in ("rate", "weight")]


@dataclass(frozen=True)
class Rule:
    """``verdict`` is allow or block; ``site`` is a host and the beginning of a path."""

    verdict: str
    site: str

    @property
    def host(self):
        return self.site.partition("/")[0]

    @property
    def path(self):
        return self.site[len(self.host) :]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A to Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """(site, verdict) of the longest rule that fits, or null; of equally long ones the first."""
    found = F.lit(None).cast("struct<site:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.site)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.site).alias("site"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def lexical_features(url: str) -> list[float]:
    """LEXICAL of one URL; all 0 but for lengths that are there."""
    host_path, _, query = url.partition("?")
    query, _, fragment = query.partition("#")
    match = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url)
    host, path = (match[2], match[3]) if match else ("", "")
    n = len(url)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
    return [
        math.log1p(n),
        math.log1p(len(host)),
        math.log1p(len(path)),
        float(sum(1 for s in path.split("/") if s)),
        float(host.count(".") + 1 if host else 0),
        sum(map(url.count, "0123456789")) / max(1, n),
        float(url.count("-")),
        entropy,
        float(sum(1 for p in query.split("&") if p)),
        math.log1p(len(query)),
        float("#" in url),
        float(url.startswith("https:")),
    ]


def _with_lexical(rows: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, verdict, the SUFFIXES and LEXICAL."""
    kept = rows.columns

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            found = [lexical_features(u or "") for u in batch.column("url").to_pylist()]
            columns = {k: batch.column(k) for k in kept}
            columns |= {k: pa.array([f[i] for f in found], pa.float64()) for i, k in enumerate(LEXICAL)}
            yield pa.record_batch(columns)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(features, f"{fields}, {', '.join(f'{c} double' for c in LEXICAL)}")


def _with_statistics(rows: DataFrame, labelled: DataFrame, base: float) -> DataFrame:
    """STATISTICS from the labelled rows (label 1: block), each row's own label left out."""
    own = F.when(F.col("label").isNull(), 0.0).otherwise(1.0)
    for name in SUFFIXES:
        per = labelled.groupBy(name).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
        rows = rows.join(per, name, "left")
        n = F.coalesce("n", F.lit(0)) - own
        blocked = F.coalesce("blocked", F.lit(0.0)) - F.coalesce("label", F.lit(0.0))
        rows = rows.withColumn(f"{name}_rate", (blocked + 2 * base) / (n + 2)).withColumn(f"{name}_weight", F.log1p(n))
        rows = rows.drop("n", "blocked")
    return rows


def judged_urls(pages: DataFrame, rules: list[Rule], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, and block_score of the trees, for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path and fits no rule. Where no url
    or only one verdict is labelled nothing can be learned: that verdict, or allow, is given to
    all. Equal urls are judged alike. Other columns are left aside. An empty table gives no rows.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fits", rule_of(rules, F.col("host"), F.col("path")))
    rows = rows.select(
        "page_id", "url", "host", "path",
        F.col("fits.site").alias("rule"),
        F.when(F.col("fits.verdict") == "block", 1.0).when(F.col("fits.verdict") == "allow", 0.0).alias("label"),
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
        F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0).alias("domain"),
        F.regexp_extract("path", "^/[^/]*", 0).alias("opening"),
    )
    rows = stored(_with_lexical(rows), "urls")
    labelled = rows.where("label is not null")
    counts = dict(labelled.groupBy("label").count().collect())
    total = sum(counts.values())
    out = ["page_id", "host", "path", "rule"]
    if len(counts) < 2:
        score = F.lit(1.0 if counts.get(1.0) else 0.0)
        return rows.select(*out, _verdict(F.col("label"), score).alias("verdict"), score.alias("block_score"))
    whole = stored(_with_statistics(rows, labelled, counts[1.0] / total), "judged")
    vectors = VectorAssembler(inputCols=LEXICAL + STATISTICS, outputCol="features")
    share = min(1.0, max_labelled / total)
    sample = whole.where("label is not null").where(F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    trees = GBTClassifier(labelCol="label", maxIter=12, maxDepth=4, stepSize=0.3, seed=1, maxBins=32)
    model = trees.fit(vectors.transform(sample).select("features", "label").coalesce(2))
    scored = model.transform(vectors.transform(whole))
    p = vector_to_array("probability")[1]
    return scored.select(*out, _verdict(F.col("label"), p).alias("verdict"), p.alias("block_score"))


def _verdict(label: Column, score: Column) -> Column:
    return F.when(F.coalesce(label, score) >= 0.5, "block").otherwise("allow")
