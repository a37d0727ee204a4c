"""Writers (SNK1-SNK4); every operator returns a DataFrame, so a sink is one call on top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_delimited(df: DataFrame, path: str, *, sep: str = "\t", mode: str = "errorifexists") -> None:
    """Headerless text with one row a line; sep is the separator override."""
    df.write.mode(mode).option("sep", sep).csv(path)


def write_tuples(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Text lines of the form ``(a,b,...)``."""
    line = F.concat(F.lit("("), F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]), F.lit(")"))
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def preview(df: DataFrame, rows: int = 20) -> list[str]:
    """The first rows as text lines, for a console."""
    return ["(" + ",".join("" if x is None else str(x) for x in r) + ")" for r in df.take(rows)]


def lineage(df: DataFrame) -> str:
    """The plan that df stands for."""
    return df._jdf.queryExecution().toString()
