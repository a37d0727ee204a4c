"""Follower counts over an edge stream: the same associative sum, kept as state per key."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orrery.operators.aggregate import followers_reduce


def followers_stream(edges: DataFrame) -> DataFrame:
    """Running in-degree of a streaming edge list; write it in update or complete mode."""
    if not edges.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return followers_reduce(edges)
