"""Vertex-cut placement of a static graph for loops (PHY2, JOIN4, ITR2, ITR3).

Edges lie by (src, slot).  A vertex with up to a set number of out-edges has slot 0 only; the edges of a heavier one are
cut by a hash of dst into as many slots as it needs, so a hub is many keys.  What a loop knows of a vertex (its rank, its
distance) is replicated to the vertex's slots only, as ``slots`` tells, and is all that moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.scratch import Scratch, parts_for, piece_rows


@dataclass
class Placed:
    """edges (src, slot, d, ends) by (src, slot); nodes (vertex, slots) by vertex, slots 0 for those without out-edges.

    ends: the slot's (dst, w), a row for all, so that a pass joins a row a slot and not one an edge; d: the w of all slots.
    """

    edges: DataFrame
    nodes: DataFrame
    parts: int
    n_nodes: int

    def reach(self, front: DataFrame) -> DataFrame:
        """front (vertex, slots, ...) joined with its out-edges (src, dst, w, share).  Neither the edges nor their order are moved for it."""
        sent = front.filter("slots > 0").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        on = (self.edges["src"] == sent["vertex"]) & (self.edges["slot"] == sent["_slot"])
        met = self.edges.join(sent.hint("shuffle_hash"), on).select("src", "d", *front.columns, F.inline("ends"))
        return met.withColumn("share", F.col("w") / F.col("d")).drop("d")


def described(graph: Placed, scratch: Scratch) -> dict:
    return {"edges": scratch.described(graph.edges, graph.parts, "src", "slot"), "nodes": scratch.described(graph.nodes, graph.parts, "vertex"), "parts": graph.parts, "n": graph.n_nodes}


def found(what: dict, scratch: Scratch) -> Placed:
    """A graph that another driver has placed and described."""
    return Placed(scratch.found(what["edges"]), scratch.found(what["nodes"]), what["parts"], what["n"])


def place_graph(edges: DataFrame, scratch: Scratch, *, loops: bool = True) -> Placed:
    """edges (src, dst), repeats kept as weight w.  Loops go if asked."""
    spark = edges.sparkSession
    if not loops:
        edges = edges.filter("src <> dst")
    deg = edges.groupBy("src").agg(F.count("*").alias("d"))
    deg, seen = scratch.counted(deg, F.sum("d").alias("n"))
    parts = parts_for(spark, seen["n"] or 0)
    most = piece_rows(seen["n"] or 0, parts)
    slots = F.expr(f"CAST(ceil(d / {most}) AS INT)")
    # Few can be that heavy (PIECES a part): they are broadcast, and the edges are exchanged once, repeats with them.
    heavy = deg.filter(F.col("d") > most).select(F.col("src").alias("_src"), slots.alias("_slots"))
    slot = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("_slots")), F.lit(0)).cast("int")
    cut = edges.join(F.broadcast(heavy), F.col("src") == F.col("_src"), "left").select("src", slot.alias("slot"), "dst")
    w = cut.repartition(parts, "src", "slot").groupBy("src", "slot", "dst").agg(F.count("*").alias("w"))
    packed = w.groupBy("src", "slot").agg(F.collect_list(F.struct("dst", "w")).alias("ends"))
    whole = deg.select(F.col("src").alias("_src"), "d", F.explode(F.sequence(F.lit(0), slots - 1)).alias("_slot"))
    packed = packed.join(whole.hint("shuffle_hash"), (F.col("src") == F.col("_src")) & (F.col("slot") == F.col("_slot")))
    placed, _ = scratch.place(packed.select("src", "slot", "d", "ends"), parts, "src", "slot")
    ends = edges.select("dst").distinct().select(F.col("dst").alias("vertex"), F.lit(0).alias("slots"))
    nodes = deg.select(F.col("src").alias("vertex"), slots.alias("slots")).unionByName(ends)
    nodes = nodes.repartition(parts, "vertex").groupBy("vertex").agg(F.max("slots").alias("slots"))
    nodes, told = scratch.place(nodes, parts, "vertex", what=(F.count(F.lit(1)).alias("n"),))
    scratch.drop(deg)
    return Placed(placed, nodes, parts, told["n"])
