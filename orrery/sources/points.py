"""Files of counts and of centroids: tab-separated lines, as jobs hand them to one another (SRC3, SRC6, SRC7, SNK3, SNK5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(lines: DataFrame) -> list:
    part = F.split("value", "\t")
    return [F.get(part, 0), F.get(part, 1)]


def write_counts(counts: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """(key, n) as lines ``key<TAB>n``."""
    key, n = counts.columns[:2]
    counts.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(n).cast("string")).alias("value")).write.mode(mode).text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(key string, n bigint) from lines ``key<TAB>n``; a count that is no number raises."""
    lines = spark.read.text(path)
    key, n = _fields(lines)
    return lines.select(key.alias("key"), n.cast("bigint").alias("n"))


def write_centroids(spark: SparkSession, centroids: list[int], path: str, *, mode: str = "errorifexists") -> None:
    """One centroid a line, in one file; a clustering has as many as it has clusters."""
    rows = spark.createDataFrame([(i, str(c)) for i, c in enumerate(centroids)], "i int, value string")
    rows.coalesce(1).sortWithinPartitions("i").select("value").write.mode(mode).text(path)


def read_centroids(spark: SparkSession, path: str, most: int = 100_000) -> list[int]:
    """The first fields of all lines of the files in a folder; further fields (sizes) are ignored.  Beyond most: an error."""
    lines = spark.read.text(path)
    rows = lines.select(_fields(lines)[0].cast("bigint").alias("c")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centroids in {path}")
    return sorted(r["c"] for r in rows)
