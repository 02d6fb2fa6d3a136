"""Running a stream over what has arrived so far, batch by batch.

Results of a batch are written below ``batch=<id>``; a batch that is run again
after a failure overwrites its own folder, so each counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def run_available(
    stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    """Process everything available in one or more batches, then stop."""
    query = (
        stream.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def batch_folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(batch_folder(path, batch))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All written batches, with their number in ``batch``."""
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("bigint"))


def previous(spark: SparkSession, path: str, batch: int, schema) -> DataFrame:
    """What the batch before left as state (nothing for the first)."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(batch_folder(path, batch - 1))


COMPACT = 16  # batches between two whole copies of a bucket of a state
BUCKETS = 64


def bucket_of(key: list[str]) -> Column:
    """The bucket of a state row, by its key."""
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def merged_state(
    spark: SparkSession, path: str, upto: int, schema, merge: Callable[[DataFrame], DataFrame],
    key: list[str], touched: DataFrame | list[int] | None = None,
) -> DataFrame:
    """The state after the batches before ``upto``, merged by ``merge``.

    A state is a folder per batch and bucket of ``key``. Every COMPACT-th batch, in
    turn, holds a whole copy of a bucket, the others what they changed, so at most
    COMPACT folders of a bucket are read. With ``touched``, buckets or rows with the
    key, only those buckets are.
    """
    if upto == 0:
        return spark.createDataFrame([], schema)
    folders = [batch_folder(path, n) for n in range(max(0, upto - COMPACT), upto)]
    fields = StructType.fromDDL(schema).fields if isinstance(schema, str) else list(schema.fields)
    parts = [StructField("_bucket", IntegerType()), StructField("batch", LongType())]
    rows = spark.read.schema(StructType([*fields, *parts])).option("basePath", path).parquet(*folders)
    whole = (upto - 1) - F.pmod(F.lit(upto - 1) - F.col("_bucket"), F.lit(COMPACT))
    rows = rows.filter(F.col("batch") >= whole)
    if touched is not None:
        wanted = touched if isinstance(touched, list) else [
            r[0] for r in touched.select(bucket_of(key)).distinct().collect()  # at most BUCKETS
        ]
        rows = rows.filter(F.col("_bucket").isin(wanted) if wanted else F.lit(False))
    return merge(rows.drop("_bucket", "batch"))


def write_changes(
    changed: DataFrame, path: str, batch: int, schema, merge: Callable[[DataFrame], DataFrame], key: list[str]
) -> None:
    """Write what a batch changed of a state, and the whole of the buckets whose turn it is."""
    turn = F.pmod(F.lit(batch) - F.col("_bucket"), F.lit(COMPACT)) == 0
    rows = changed.withColumn("_bucket", bucket_of(key))
    if batch:
        due = [b for b in range(BUCKETS) if (batch - b) % COMPACT == 0]
        before = merged_state(changed.sparkSession, path, batch, schema, merge, key, due)
        whole = merge(before.unionByName(rows.filter(turn).drop("_bucket"))).withColumn("_bucket", bucket_of(key))
        rows = rows.filter(~turn).unionByName(whole)
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(batch_folder(path, batch))
