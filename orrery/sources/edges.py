"""Edge-list sources (SRC1-SRC7), projections of the star schema, and edge rewrites.

An edge list is a DataFrame ``(src, dst)``: src follows dst.  Files are headerless and
comma separated; further fields of a line are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.plans.scratch import Scratch

#: The separator that stands for any run of white space.
WHITESPACE = " \t"
EDGE_SCHEMA = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])


def _checked(edges: DataFrame, drop_malformed: bool) -> DataFrame:
    bad = F.col("dst").isNull() | (F.col("dst") == "")
    if drop_malformed:
        return edges.filter(~bad)
    # A raise inside the projected column: strictness costs no extra pass over the input.
    return edges.withColumn("dst", F.when(bad, F.raise_error(F.lit("edge line without a second field"))).otherwise(F.col("dst")))


def read_edges(spark: SparkSession, path: str, *, sep: str = ",", drop_malformed: bool = False) -> DataFrame:
    """Edge list from text.  A line without a second field raises, or goes if drop_malformed.

    Quotes are characters like others, as in a plain split by the separator.
    """
    # enforceSchema keeps the first two fields whatever the width of the line.
    raw = spark.read.schema(EDGE_SCHEMA).option("sep", sep).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return _checked(raw, drop_malformed)


def parse_edges(lines: DataFrame, *, drop_malformed: bool = False, sep: str = ",") -> DataFrame:
    """Edge list from a DataFrame of text lines in column ``value``; sep is a literal string, or WHITESPACE."""
    part = F.split("value", r"\s+" if sep == WHITESPACE else rf"\Q{sep}\E")
    return _checked(lines.select(F.get(part, 0).alias("src"), F.get(part, 1).alias("dst")), drop_malformed)


def numeric(edges: DataFrame, *, drop_malformed: bool = False) -> DataFrame:
    """Ids as bigint.  Ids that are no numbers raise (ANSI cast), or go if drop_malformed."""
    if drop_malformed:
        cast = edges.select(F.col("src").try_cast("bigint").alias("src"), F.col("dst").try_cast("bigint").alias("dst"))
        return cast.filter("src IS NOT NULL AND dst IS NOT NULL")
    return edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))


def edges_of(df: DataFrame, src: str | Column, dst: str | Column) -> DataFrame:
    """Project two columns of any DataFrame as edges; rows with a null end are no edges."""
    return df.select(F.col(src).alias("src") if isinstance(src, str) else src.alias("src"), F.col(dst).alias("dst") if isinstance(dst, str) else dst.alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as edges part -> supplier."""
    return edges_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_partkey", "l_suppkey")


def cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and lineitem as edges customer -> supplier."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    return edges_of(orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")), "o_custkey", "l_suppkey")


def event_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as edges user -> user of the next event, in the order of ts and event_id.

    The events are dealt out by ranges of that order, so a range is a task's worth whatever a day holds;
    the last event of a range meets the first of the next one that has any, one row a range.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id")
    # Written, so that the ranges are the same for both uses below.
    ev = Scratch(spark).keep(ev.repartitionByRange("ts", "event_id").withColumn("b", F.spark_partition_id()))
    inner = ev.withColumn("nxt", F.lead("user_id").over(Window.partitionBy("b").orderBy("ts", "event_id")))
    inner = inner.withColumn("last", F.lead("event_id").over(Window.partitionBy("b").orderBy("ts", "event_id")).isNull())
    firsts = ev.groupBy("b").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("f"))
    heads = firsts.select("b", F.lead("f.user_id").over(Window.partitionBy(F.lit(0)).orderBy("b")).alias("head"))
    out = inner.join(heads, "b").select("user_id", F.when(F.col("last"), F.col("head")).otherwise(F.col("nxt")).alias("n"))
    return edges_of(out, "user_id", "n")


def cap_ids(edges: DataFrame, max_id: int | None) -> DataFrame:
    """Edges with both ids at most max_id (FLT1); all edges if max_id is None."""
    return edges if max_id is None else edges.filter((F.col("src") <= max_id) & (F.col("dst") <= max_id))


def reverse(edges: DataFrame) -> DataFrame:
    """dst -> src (PRJ4)."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def union_edges(*parts: DataFrame) -> DataFrame:
    """Bag union by column name (SET1)."""
    return reduce(DataFrame.unionByName, parts)


def vertices(edges: DataFrame) -> DataFrame:
    """Every endpoint once, as column ``vertex``."""
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
