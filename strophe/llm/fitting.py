"""Bounded samples that models are fitted on, and fitted models kept for later queries."""

import math
import pickle

from pyspark.sql import Column, DataFrame, SparkSession

#: Standard deviations by which the first cut goes beyond the wanted number of rows.
MARGIN = 6


def smallest(df: DataFrame, hashed: Column, n: int) -> DataFrame:
    """The rows of df with the n smallest hashes, all of them if there are no more; equal hashes stay together.

    The sample depends on the rows alone, not on partitioning. Two passes over
    what the hash reads: rows are counted, then the driver gets the hashes under a
    bound that a little more than n of them pass (8 bytes each), whatever the
    number of partitions. The rows themselves stay where they are.
    """
    rows = df.where(hashed.isNotNull())
    total = rows.count()
    if total <= n:
        return rows
    share, cut = (n + MARGIN * math.sqrt(n) + MARGIN) / total, []
    while True:
        bound = int(-(2**63) + min(share, 1.0) * (2**64 - 1))
        passed = rows.select(hashed.alias("h")).where(hashed <= bound).groupBy("h").count().collect()
        cut = sorted(r.h for r in passed for _ in range(min(r["count"], n)))
        if len(cut) >= n:
            return rows.where(hashed <= cut[n - 1])
        share *= 4  # hashes that many rows share


def save(spark: SparkSession, model: object, path: str) -> None:
    """A fitted model as a table of one row at path, on any file system that Spark writes to; what is there is replaced."""
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> object:
    """The model that `save` wrote to path. Load only what you trust: it is a pickle."""
    return pickle.loads(bytes(spark.read.parquet(path).first().model))
