"""Synthetic graphs and rank tables (SRC8-SRC10), made on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _positive(k: int) -> int:
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")
    return k


def chain_graph(spark: SparkSession, k: int) -> DataFrame:
    """k chains of k vertices, v -> v+1; the tail of each chain points to the dummy sink 0."""
    v = F.col("id")
    return spark.range(1, _positive(k) ** 2 + 1).select(v.alias("src"), F.when(v % k == 0, F.lit(0)).otherwise(v + 1).cast("bigint").alias("dst"))


def chain_ranks(spark: SparkSession, k: int) -> DataFrame:
    """Rank 1/k^2 for each vertex of chain_graph(k), 0 for the dummy."""
    n = _positive(k) ** 2
    return spark.range(0, n + 1).select(F.col("id").alias("vertex"), F.when(F.col("id") == 0, F.lit(0.0)).otherwise(F.lit(1.0 / n)).alias("rank"))
