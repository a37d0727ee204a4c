"""One-dimensional k-means over counts (C5: JOIN9, AGG17-AGG19, ITR4, ITR5, SRT3).

Points are kept as (n, w): a value and how often it occurs.  All passes run over that histogram,
whose size is the number of different values, and give what they would over the points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalar import nearest, truncated_mean
from orrery.plans.fixpoint import fixpoint
from orrery.plans.scratch import Scratch


def histogram(points: DataFrame) -> DataFrame:
    return points.groupBy("n").agg(F.count("*").alias("w"))


def seeds(points: DataFrame, k: int, how: str = "even") -> list[int]:
    """even: j * (max div k) for j = 1..k; powers: 10^j for j = 0..k-1."""
    return _spread(points.agg(F.max("n")).first()[0], k, how)


def _spread(top: int | None, k: int, how: str) -> list[int]:
    if top is None:
        return []
    return [j * (int(top) // k) for j in range(1, k + 1)] if how == "even" else [10**j for j in range(k)]


def kmeans_seeds(points: DataFrame, k: int) -> DataFrame:
    return points.agg(F.max("n").alias("m")).filter("m IS NOT NULL").select(F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j"), "m").select("j", F.expr(f"CAST(j * (m div {k}) AS BIGINT)").alias("centroid"))


def assign(points: DataFrame, centres: list[int]) -> DataFrame:
    """points with their nearest centroid; the smaller one wins ties."""
    return points.withColumn("centroid", nearest(F.col("n"), centres)) if centres else points.withColumn("centroid", F.lit(None).cast("bigint"))


def _means(hist: DataFrame, centres: list[int]) -> DataFrame:
    return assign(hist, centres).groupBy("centroid").agg(truncated_mean("sum(n * w)", "sum(w)").alias("mean"), F.sum("w").alias("size"))


def _fit(points: DataFrame, k: int, max_iter: int, start: list[int] | None) -> tuple[DataFrame, list[int], list[tuple[int, int]], int]:
    """The written histogram, the centroids before the last pass, (centroid, size) after it, and the passes.

    The greatest count, of which the seeds are made, is observed while the histogram is written; a pass is one job.
    """
    hist, seen = Scratch(points.sparkSession).counted(histogram(points), F.max("n").alias("top"))

    def move(state: tuple[list[int], list[tuple[int, int]]], _: int) -> tuple[tuple[list[int], list[tuple[int, int]]], bool]:
        _, last = state
        old = [m for m, _ in last]
        rows = [(r["mean"], r["size"]) for r in _means(hist, old).orderBy("centroid").collect()]  # at most k rows
        return (old, rows), [m for m, _ in rows] == old

    first = _spread(seen["top"], k, "even") if start is None else sorted(start)
    (old, rows), i = fixpoint((first, [(c, 0) for c in first]), move, max_iter)
    return hist, old, rows, i


def fit(points: DataFrame, k: int, max_iter: int = 10, start: list[int] | None = None) -> tuple[list[int], list[int], int]:
    """Centroids before and after the last pass, and the passes; an empty cluster disappears.  start: the first centroids."""
    _, old, rows, i = _fit(points, k, max_iter, start)
    return old, [m for m, _ in rows], i


def kmeans_centroids(points: DataFrame, k: int, max_iter: int = 10, start: list[int] | None = None) -> DataFrame:
    """(centroid, size) after the last pass."""
    _, _, rows, _ = _fit(points, k, max_iter, start)
    return points.sparkSession.createDataFrame(rows, "centroid bigint, size bigint")


def kmeans_assign(points: DataFrame, k: int, max_iter: int = 10) -> DataFrame:
    """points with the centroid each went to in the last pass."""
    return assign(points, fit(points, k, max_iter)[0])


def kmeans_sse(points: DataFrame, k: int, max_iter: int = 10) -> DataFrame:
    """Sum of squared errors of the last pass around its new means; one row."""
    hist, old, _, _ = _fit(points, k, max_iter, None)
    err = assign(hist, old).join(F.broadcast(_means(hist, old)), "centroid")  # at most k rows
    return err.agg(F.coalesce(F.sum((F.col("n") - F.col("mean")) * (F.col("n") - F.col("mean")) * F.col("w")), F.lit(0)).cast("bigint").alias("sse"))
