"""Documents to training sequences: quality, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Its
result is written to the shared folder and read again, so a lost executor never costs more than
the stage that runs.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import named, stored, without_keys
from trafficlens.llm.packing import packed_sequences
from trafficlens.llm.quality_rank import keep_good
from trafficlens.llm.queries import SURROGATE_KEY
from trafficlens.llm.shingle_join import similar_documents
from trafficlens.llm.surrogates import replace_entities

#: Scores, 64-bit set hashes and tokenizers have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking puts below the cut go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts stays: that of the smallest id.

    Texts decide, not ids: different texts that share an id are judged each by itself, and of rows
    that repeat both one stays, the first by its columns in order of their names. Null ids and
    wordless texts have no component and stay. All columns are kept.
    """
    twice = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return without_keys(docs, _copies(similar_documents(docs)), "doc_id")
    # every text of a repeated id gets a key of its own, above all ids and in their order
    above = docs.agg(F.max("doc_id")).first()[0] + 1
    once, again = without_keys(docs, twice, "doc_id"), docs.join(twice, "doc_id", "left_semi")
    texts = again.select("doc_id", "text").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    texts = stored(texts.withColumn("key", F.monotonically_increasing_id() + above), "texts")
    both = once.select("doc_id", "text").unionByName(texts.select(F.col("key").alias("doc_id"), "text"))
    of = similar_documents(both).select(F.col("doc_id").alias("key"), "n_shingles", "component_id")
    of = of.join(texts.select("key", F.col("doc_id").alias("id")), "key", "left").withColumn("id", F.coalesce("id", "key"))
    of = stored(of, "components")
    first = of.groupBy("component_id").agg(F.min(F.struct("id", "key"))["key"].alias("first"))
    stays = stored(of.join(first, "component_id").select("key", "n_shingles", (F.col("key") == F.col("first")).alias("stays")), "stays")
    judged = texts.join(stays.where("stays"), "key")
    judged = judged.select(F.col("doc_id").alias("of"), F.col("text").alias("its"), "n_shingles")
    kept = again.join(judged, (F.col("doc_id") == F.col("of")) & F.col("text").eqNullSafe(F.col("its")))
    whole = F.struct(*named(sorted(docs.columns)))
    first = kept.where("n_shingles > 0").groupBy("of", "its").agg(F.min(whole).alias("kept")).select("kept.*")
    wordless = kept.where("n_shingles = 0").select(named(docs.columns))
    gone = stays.where("NOT stays").select(F.col("key").alias("doc_id"))
    return without_keys(once, gone, "doc_id").unionByName(first.select(named(docs.columns))).unionByName(wordless)


def _copies(components: DataFrame) -> DataFrame:
    """The ids that are not the smallest of their component."""
    return stored(components.where("doc_id <> component_id").select("doc_id").distinct(), "copies")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced; n_chars follows."""
    out = replace_entities(docs, SURROGATE_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    return packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("surrogates", surrogates),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
