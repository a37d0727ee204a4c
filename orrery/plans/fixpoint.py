"""Lineage cutting and the fixpoint driver (ITR1-ITR4)."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; if unset (as in tests), one in the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage replaced by files that all executors share.

    Reliable checkpoints, never local ones: a pass survives the loss of the executor that made it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


T = TypeVar("T")


def fixpoint(state: T, step: Callable[[T, int], tuple[T, bool]], max_iter: int, *, must_settle: bool = False) -> tuple[T, int]:
    """Apply step (state and pass -> state and whether it is the last) up to max_iter times; the state and the passes.

    must_settle: raise rather than return a state that step has not called the last.
    """
    for i in range(1, max_iter + 1):
        state, done = step(state, i)
        if done:
            return state, i
    if must_settle:
        raise RuntimeError(f"not settled in {max_iter} passes")
    return state, max_iter
