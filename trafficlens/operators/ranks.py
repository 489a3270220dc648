"""Ranks and running totals over a whole table without a single-task window.

A window without partitions would send everything to one task.  Here the ordering column
is cut into ranges at boundaries taken from the data, totals per range are added up (a
few hundred rows), and each range counts on from what came before it.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

RANGES = 200


def boundaries(df: DataFrame, order: str, ranges: int) -> list:
    """At most ``ranges`` values spread over the distinct values of ``order``.

    They only balance the work: any boundaries give the same result.  They are fixed
    before the plan is built, so every branch and every retry sees the same ranges.
    """
    numeric = df.schema[order].dataType.typeName() in ("double", "float", "long", "integer")
    values = df.select(order).filter(F.col(order).isNotNull())
    if numeric:
        shares = [i / ranges for i in range(1, ranges)]
        found = values.approxQuantile(order, shares, 0.5 / ranges)
    else:
        # Texts: a hash sample of values, at most a few thousand of them.
        sample = values.filter(F.pmod(F.xxhash64(order), F.lit(64)) == 0).limit(8 * ranges)
        picked = sorted(row[0] for row in sample.collect())
        found = picked[:: max(1, len(picked) // ranges)]
    return sorted(set(found))


def running_totals(
    grouped: DataFrame,
    order: str,
    sums: dict[str, str],
    descending=False,
    partition=(),
    ranges=RANGES,
) -> DataFrame:
    """Add inclusive running totals over ``order``; its values must be distinct.

    ``sums`` maps a value column to the name of its running total.  ``partition`` names
    columns (a detector, a replicate) with separate totals.
    """
    # Read three times below; what led to these few rows should run once.
    grouped = cut_lineage(grouped)
    cuts = boundaries(grouped, order, ranges)
    keys = list(partition)
    number = F.lit(0)
    if cuts:
        number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order)))
    ranged = grouped.withColumn("range_no", number)
    by_range = Window.partitionBy(*keys).orderBy(
        F.col("range_no").desc() if descending else F.col("range_no")
    ).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "range_no").agg(
        *[F.sum(c).alias(f"_t_{c}") for c in sums]
    )
    offsets = totals.select(
        *keys,
        "range_no",
        *[F.coalesce(F.sum(f"_t_{c}").over(by_range), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    inside = Window.partitionBy(*keys, "range_no").orderBy(
        F.col(order).desc() if descending else F.col(order)
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(offsets, [*keys, "range_no"])
        .withColumns({out: F.col(f"_o_{c}") + F.sum(c).over(inside) for c, out in sums.items()})
        .drop("range_no", *[f"_o_{c}" for c in sums])
    )


def with_global_rank(distinct_rows: DataFrame, order: str, name: str) -> DataFrame:
    """1-based rank over ``order``, whose values must be distinct."""
    counted = distinct_rows.withColumn("_one", F.lit(1))
    return running_totals(counted, order, {"_one": name}).drop("_one")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n, upto): distinct values, how often, and how many rows up to each."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return running_totals(counts, value, {"n": "upto"})
