"""Follower counts in four formulations, their extremes, and adjacency (AGG1-AGG6, AGG12, AGG13)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def followers_reduce(edges: DataFrame) -> DataFrame:
    """In-degree by an associative sum; partial counts are made before the shuffle."""
    return edges.groupBy("dst").agg(F.count("*").alias("n"))


def followers_aggregate(edges: DataFrame) -> DataFrame:
    """In-degree by zero, sequence and combine functions: rows are counted, values ignored."""
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def followers_fold(edges: DataFrame) -> DataFrame:
    """In-degree by folding ones into a zero."""
    return edges.groupBy("dst").agg(F.sum(F.lit(1).cast("bigint")).alias("n"))


#: Values that one group of a part holds, about.
GROUP_ROWS = 100_000


def _parts(df: DataFrame, key: str) -> int:
    """So many parts that the heaviest key's values come to about GROUP_ROWS each."""
    top = df.groupBy(key).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    return int(top) // GROUP_ROWS + 1


def followers_group(edges: DataFrame) -> DataFrame:
    """In-degree by grouping first and summing each group.

    Groups are gathered per (dst, salt), with as many salts as the heaviest key needs, so that no task holds a
    hub's whole group; the parts' sums are then added.
    """
    ones = edges.select("dst", F.pmod(F.xxhash64("src"), F.lit(_parts(edges, "dst"))).alias("salt"), F.lit(1).cast("bigint").alias("one"))
    parts = ones.groupBy("dst", "salt").agg(F.collect_list("one").alias("g"))
    summed = parts.select("dst", F.aggregate("g", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("part"))
    return summed.groupBy("dst").agg(F.sum("part").alias("n"))


def aggregate_by_key(df: DataFrame, key: str, value: str, zero: Column, seq: Callable[[Column, Column], Column], comb: Callable[[Column, Column], Column] | None = None, *, out: str = "value") -> DataFrame:
    """Generic aggregate-by-key: seq folds values of a salted part, comb merges the parts."""
    parts = df.groupBy(key, F.pmod(F.xxhash64(value), F.lit(_parts(df, key))).alias("_salt")).agg(F.sort_array(F.collect_list(value)).alias("_g"))
    parts = parts.select(key, F.aggregate("_g", zero, seq).alias("_p"))
    return parts.groupBy(key).agg(F.aggregate(F.collect_list("_p"), zero, comb or seq).alias(out))


def followers_minmax(edges: DataFrame) -> DataFrame:
    """Least and greatest follower count over all vertices that have followers; one row."""
    return followers_reduce(edges).agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"))


def adjacency_list(edges: DataFrame) -> DataFrame:
    """Sorted out-neighbours of each vertex, repeats kept."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("adj"))


def adjacency_blocks(edges: DataFrame, block_rows: int = GROUP_ROWS) -> DataFrame:
    """(src, block, adj): out-neighbours in sorted blocks of about block_rows, repeats kept; a hub is many rows."""
    blocks = edges.groupBy("src").agg(F.expr(f"CAST(ceil(count(*) / {block_rows}) AS INT)").alias("blocks"))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("dst"), F.col("blocks")).cast("int")).otherwise(F.lit(0))
    return edges.join(blocks, "src").groupBy("src", block.alias("block")).agg(F.sort_array(F.collect_list("dst")).alias("adj"))


def adjacency_set(edges: DataFrame) -> DataFrame:
    """Sorted distinct out-neighbours of each vertex."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("adj"))
