"""Run a streaming table to completion over what is there now, and read the result."""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def disk_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which ``state`` needs and which spills."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def drain(stream: DataFrame, base: str | None = None) -> DataFrame:
    """Append the output of a stream to a table in the shared folder and return it.

    With the ``base`` of an earlier run the stream goes on from where that one stopped.
    """
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}"
    with disk_state(spark):
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{base}/rows")
            .option("checkpointLocation", f"{base}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def drain_counters(stream: DataFrame) -> DataFrame:
    """The same for an aggregation: each batch replaces the table of totals."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"

    def replace(totals: DataFrame, batch_id: int) -> None:
        totals.write.mode("overwrite").parquet(f"{base}/rows")

    query = (
        stream.writeStream.foreachBatch(replace)
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
