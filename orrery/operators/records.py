"""Shortest paths over node records (C4: JOIN8, ITR3, AGG12, AGG13, PRJ13, FLT8).

A record is a vertex with a block of its out-neighbours and what is known of it: distance and predecessor.  A pass sends
candidates along the adjacency of the records reached last, and merges candidates and records by one keyed argmin over
their tagged union.  Records lie by (vertex, block), so only candidates move.  A neighbour is kept with its number of
blocks, to which candidates for it go; so adjacency is bounded per row however large a hub is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.aggregate import GROUP_ROWS
from orrery.operators.sssp import SEP, paths
from orrery.plans.fixpoint import fixpoint
from orrery.plans.scratch import Scratch, parts_for


def node_records(edges: DataFrame, source, scratch: Scratch, block_rows: int = GROUP_ROWS) -> tuple[DataFrame, int]:
    """(vertex, block, adj, best) of every endpoint and the source, placed by (vertex, block), and the parts.

    adj: (v, blocks) of each distinct out-neighbour but the vertex itself, in blocks of about block_rows.  best: (dist, text,
    parent), null where nothing has arrived; the least is the best, so text breaks ties, and is '' once it is written.
    """
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    steps, seen = scratch.counted(edges.filter("src <> dst").distinct(), F.count(F.lit(1)).alias("n"))
    parts = parts_for(spark, seen["n"])
    start = spark.range(1).select(F.lit(source).cast(kind).alias("vertex"))
    every = steps.select(F.explode(F.array("src", "dst")).alias("vertex")).union(edges.filter("src = dst").select("src")).union(start).distinct()
    out = steps.groupBy(F.col("src").alias("vertex")).agg(F.expr(f"CAST(ceil(count(*) / {block_rows}) AS INT)").alias("blocks"))
    blocks = scratch.keep(every.join(out, "vertex", "left").select("vertex", F.coalesce("blocks", F.lit(1)).alias("blocks")))
    to = steps.join(blocks.select(F.col("vertex").alias("dst"), F.col("blocks").alias("to")), "dst")
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("dst"), F.col("blocks")).cast("int")).otherwise(F.lit(0))
    lists = to.join(blocks, to["src"] == blocks["vertex"]).groupBy("vertex", own.alias("block")).agg(F.collect_list(F.struct(F.col("dst").alias("v"), F.col("to").alias("blocks"))).alias("adj"))
    keys = blocks.select("vertex", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    first = F.when(F.col("vertex") == F.lit(source).cast(kind), _best(F.lit(0), F.lit(""), F.lit(None).cast(kind)))
    whole = keys.join(lists, ["vertex", "block"], "left").select("vertex", "block", "adj", first.alias("best"))
    placed, _ = scratch.place(whole.repartition(parts, "vertex", "block"), parts, "vertex", "block")
    scratch.drop(steps, blocks)
    return placed, parts


def _best(dist: Column, text: Column, parent: Column) -> Column:
    return F.struct(dist.cast("bigint").alias("dist"), text.alias("text"), parent.alias("parent"))


def _merged(records: DataFrame, i: int) -> DataFrame:
    """The records after pass i, with ``fresh``: whether the pass has reached them."""
    front = records.filter(F.col("best.dist") == i - 1).select("vertex", F.explode("adj").alias("to"))
    text = F.concat(F.col("vertex").cast("string"), F.lit(SEP))
    cand = front.select(F.col("to.v").alias("v"), F.explode(F.sequence(F.lit(0), F.col("to.blocks") - 1)).alias("block"), _best(F.lit(i), text, F.col("vertex")).alias("best"))
    cand = cand.groupBy("v", "block").agg(F.min("best").alias("best")).select(F.col("v").alias("vertex"), "block", F.lit(None).cast(records.schema["adj"].dataType).alias("adj"), "best")
    got = records.unionByName(cand).groupBy("vertex", "block").agg(F.max("adj").alias("adj"), F.min("best").alias("best"))
    settled = F.when(F.col("best").isNotNull(), _best(F.col("best.dist"), F.lit(""), F.col("best.parent")))
    return got.select("vertex", "block", "adj", settled.alias("best"), (F.col("best.dist") == i).alias("fresh"))


def sssp_records(edges: DataFrame, source, *, max_iter: int = 1_000_000, block_rows: int = GROUP_ROWS) -> DataFrame:
    """(vertex, dist, path) of the reached vertices, as ``sssp_path``; a pass is one job, which counts what it has updated."""
    scratch = Scratch(edges.sparkSession)
    records, parts = node_records(edges, source, scratch, block_rows)

    def merge(state: DataFrame, i: int) -> tuple[DataFrame, bool]:
        new, seen = scratch.place(_merged(state, i), parts, "vertex", "block", what=(F.count_if("fresh").alias("n"),), side=("fresh",))
        scratch.drop(state)
        return new, not seen["n"]

    records, _ = fixpoint(records, merge, max_iter, must_settle=True)
    return paths(records.filter("block = 0 AND best IS NOT NULL").select("vertex", "best.dist", "best.parent"), scratch)
