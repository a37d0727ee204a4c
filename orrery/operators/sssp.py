"""Single-source shortest paths over unit weights (C4: JOIN6-JOIN8, AGG10, AGG11, AGG20, ITR2, ITR3).

Semi-naive: a pass expands only the vertices reached in the pass before, and with unit weights a
vertex is final when first reached.

Steps and reached vertices lie where they are, dealt out once by vertex (``placement``); only the frontier moves to its
steps, and what it finds to the vertices.  A pass is one job, which counts what it finds.  A reached vertex keeps one
predecessor; paths are made at the end by pointer doubling, so no pass carries them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalar import INFINITY
from orrery.operators.placement import Placed, place_graph
from orrery.plans.fixpoint import fixpoint
from orrery.plans.scratch import Scratch
from orrery.sources.edges import vertices

SEP = ","
#: Tables of reached vertices that are left apart.
LEVELS = 8


@dataclass
class Reached:
    """table (vertex, slots, dist, parent) of all that is reached, and how many vertices each pass found."""

    table: DataFrame
    found: list[int]
    scratch: Scratch


def _candidates(graph: Placed, front: DataFrame) -> DataFrame:
    """(vertex, parent): where the frontier leads, each with its predecessor.  The one whose text, the separator after it, is
    the least wins ties; as vertices' texts hold no separator, that is the one with the least path."""
    text = F.concat(F.col("vertex").cast("string"), F.lit(SEP))
    best = F.min(F.struct(text.alias("text"), F.col("vertex").alias("v")))
    return graph.reach(front.select("vertex", "slots")).groupBy("dst").agg(best["v"].alias("parent"))


def _next(graph: Placed, front: DataFrame, seen: list[DataFrame], i: int) -> DataFrame:
    """The vertices that pass i is the first to reach."""
    cand = _candidates(graph, front)
    for t in seen:  # one join each: a union would be dealt out anew for its join
        cand = cand.join(t.select(F.col("vertex").alias("dst")), "dst", "left_anti")
    new = cand.join(graph.nodes, cand["dst"] == graph.nodes["vertex"])
    return new.select("vertex", "slots", F.lit(i).cast("bigint").alias("dist"), "parent")


def _reach(edges: DataFrame, source, max_iter: int) -> Reached:
    """Levels are placed by vertex, as the vertices are, so nothing that is reached moves again.

    Beyond LEVELS tables two of about one size become one, so there are few of them, and a row is copied few times.
    """
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    scratch = Scratch(spark)
    graph = place_graph(edges, scratch, loops=False)
    start = spark.range(1).select(F.lit(source).cast(kind).alias("vertex")).join(graph.nodes, "vertex", "left")
    start = start.select("vertex", F.coalesce("slots", F.lit(0)).alias("slots"), F.lit(0).cast("bigint").alias("dist"), F.lit(None).cast(kind).alias("parent"))
    first, _ = scratch.place(start.repartition(graph.parts, "vertex"), graph.parts, "vertex")

    def expand(levels: list[tuple[DataFrame, int]], i: int) -> tuple[list[tuple[DataFrame, int]], bool]:
        new, seen = scratch.place(_next(graph, levels[-1][0], [t for t, _ in levels], i), graph.parts, "vertex", what=(F.count(F.lit(1)).alias("n"),))
        if not seen["n"]:
            scratch.drop(new)
            return levels, True
        found.append(seen["n"])
        while len(levels) > LEVELS and levels[-2][1] <= 2 * levels[-1][1]:
            pair, n = [t for t, _ in levels[-2:]], levels[-2][1] + levels[-1][1]
            levels = [*levels[:-2], (scratch.place(reduce(DataFrame.unionByName, pair), graph.parts, "vertex")[0], n)]
            scratch.drop(*pair)
        return [*levels, (new, seen["n"])], False

    found = [1]
    levels, _ = fixpoint([(first, 1)], expand, max_iter, must_settle=True)
    return Reached(reduce(DataFrame.unionByName, [t for t, _ in levels]), found, scratch)


def paths(pointers: DataFrame, scratch: Scratch, open_ends: int | None = None) -> DataFrame:
    """(vertex, dist, path): the predecessors of each vertex, nearest first, down to the source, which holds itself.

    pointers: (vertex, dist, parent); open_ends: how many are further than one step, if known.  A step appends to each text that of the vertex where it ends, and so doubles what is
    done: as many steps as the depth has binary digits.  A predecessor of many is one row that they are joined with.
    """
    text = F.coalesce(F.col("parent"), F.col("vertex")).cast("string")
    far = F.when(F.col("dist") > 1, F.col("parent"))  # where the text ends; null: at the source
    table, kept = pointers.select("vertex", "dist", far.alias("to"), text.alias("path")), False
    left = table.filter("to IS NOT NULL").count() if open_ends is None else open_ends
    while left:
        on = table.select(F.col("vertex").alias("v2"), F.col("to").alias("to2"), F.col("path").alias("path2"))
        longer = table.filter("to IS NOT NULL").join(on, F.col("to") == F.col("v2")).select("vertex", "dist", F.col("to2").alias("to"), F.concat_ws(SEP, "path", "path2").alias("path"))
        longer, seen = scratch.counted(longer.unionByName(table.filter("to IS NULL")), F.count("to").alias("open"))
        if kept:
            scratch.drop(table)
        table, kept, left = longer, True, seen["open"]
    return table.select("vertex", "dist", "path")


def sssp_distance(edges: DataFrame, source, *, unreachable: str = "inf", max_iter: int = 1_000_000) -> DataFrame:
    """(vertex, distance double) of every endpoint and the source; unreachable: 'inf' or 'null'."""
    seen = _reach(edges, source, max_iter).table
    every = vertices(edges).union(seen.filter("dist = 0").select("vertex")).distinct()
    far = F.lit(INFINITY) if unreachable == "inf" else F.lit(None).cast("double")
    return every.join(seen, "vertex", "left").select("vertex", F.coalesce(F.col("dist").cast("double"), far).alias("distance"))


def sssp_path(edges: DataFrame, source, *, max_iter: int = 1_000_000) -> DataFrame:
    """(vertex, dist, path) of the reached vertices; the least path wins ties, the source holds itself."""
    got = _reach(edges, source, max_iter)
    return paths(got.table, got.scratch, sum(got.found[2:]))


def sssp_levels(edges: DataFrame, source, *, max_iter: int = 1_000_000) -> DataFrame:
    """(dist, n): how many vertices each pass updated, as the passes counted it."""
    return edges.sparkSession.createDataFrame(list(enumerate(_reach(edges, source, max_iter).found)), "dist bigint, n bigint")
