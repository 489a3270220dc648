"""Decision archives and operator corrections: JSON lines that may be damaged."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import once
from ..schema import ARCHIVE, CORRECTION, FEATURES

_BAD = "_corrupt_record"


def _with_bad(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])


def archive_rows(decisions: DataFrame) -> DataFrame:
    """Decisions as archive rows; those without a full vector (outages) are left out."""
    full = F.coalesce(F.size("features") == len(FEATURES), F.lit(False))
    return decisions.filter(full).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ARCHIVE.fields]
    )


def append_archive(decisions: DataFrame, path: str, fmt="json") -> None:
    archive_rows(decisions).write.mode("append").format(fmt).save(path)


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    return lines.filter(F.trim("value") != "").withColumn(
        "row", once(F.from_json("value", _with_bad(schema), {"columnNameOfCorruptRecord": _BAD}))
    )


def _usable() -> Column:
    return F.col(f"row.{_BAD}").isNull() & (
        F.coalesce(F.size("row.features"), F.lit(-1)) == len(FEATURES)
    )


def parse_archive(lines: DataFrame) -> DataFrame:
    """Readable rows with a vector of the right length."""
    return _parsed(lines, ARCHIVE).filter(_usable()).select("row.*").drop(_BAD)


def archive_health(lines: DataFrame) -> DataFrame:
    """One row: readable rows and skipped ones."""
    return (
        _parsed(lines, ARCHIVE)
        .agg(
            F.count_if(_usable()).alias("rows_read"),
            F.count_if(~_usable()).alias("rows_skipped"),
        )
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return parse_archive(spark.read.text(path))


def parse_corrections(lines: DataFrame, seq: Column) -> DataFrame:
    """The last correction per decision; ``seq`` orders the appended lines.

    max_by needs no sort and combines before the shuffle, so a decision corrected many
    times costs nothing extra.
    """
    ok = _usable() & F.col("row.label").isNotNull() & F.col("row.decision_id").isNotNull()
    rows = _parsed(lines.withColumn("seq", seq), CORRECTION).filter(ok)
    return rows.groupBy(F.col("row.decision_id").alias("decision_id")).agg(
        F.max_by(F.col("row.features"), "seq").alias("features"),
        F.max_by(F.col("row.label"), "seq").alias("label"),
    )


def feedback_rails(corrections: DataFrame, min_rows: int, max_share: float) -> DataFrame:
    """One row: how many corrections, the larger class share, and whether both rails hold."""
    n = F.count("*")
    bots = F.count_if(F.col("label") > 0.5)
    share = F.try_divide(F.greatest(bots, n - bots), n)
    return corrections.agg(n.alias("corrections"), share.alias("majority_share")).withColumn(
        "trainable",
        (F.col("corrections") >= min_rows)
        & (F.coalesce("majority_share", F.lit(1.0)) <= max_share),
    )


def require_feedback(corrections: DataFrame, min_rows: int, max_share: float) -> None:
    row = feedback_rails(corrections, min_rows, max_share).first()
    if row.corrections < min_rows:
        raise ValueError(f"{row.corrections} corrections, need at least {min_rows}")
    if row.majority_share > max_share:
        raise ValueError(f"corrections are {row.majority_share:.0%} one class")


def match_corrections(corrections: DataFrame, decisions: DataFrame):
    """(matched, unknown): corrections joined to their decision by id, and the ids that
    name no decision.  Decisions without a vector cannot be corrected."""
    known = decisions.filter(F.col("features").isNotNull())
    picked = corrections.select("decision_id", F.col("label").alias("corrected_label"))
    return (
        picked.join(known, "decision_id"),
        picked.join(known, "decision_id", "left_anti").select("decision_id"),
    )
