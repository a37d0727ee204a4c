"""PageRank with redistributed dangling mass (C3: JOIN4, JOIN5, JOIN10, AGG7-AGG9, SRT1, SRT2, ITR1, SNK9).

The graph lies cut by vertices (``placement``), the ranks by vertex; a pass moves the ranks to the edges and the
contributions back, and is one job: the lost mass, the sum of all ranks, how many changed and by how much at most are
observed while the job writes the new ranks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.placement import Placed, described, found, place_graph
from orrery.plans.fixpoint import fixpoint
from orrery.plans.manifest import Manifest
from orrery.plans.scratch import Scratch
from orrery.sources.generators import chain_graph, chain_ranks


@dataclass
class Pass:
    """What was counted while a pass was written: mass that reached vertices without out-edges, sum of all ranks, changes."""

    lost: float
    mass: float
    changed: int
    most: float


def _contributions(graph: Placed, ranks: DataFrame) -> DataFrame:
    return graph.reach(ranks).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("s"))


def _observed(seen: dict) -> Pass:
    return Pass(float(seen["lost"] or 0.0), float(seen["mass"] or 0.0), int(seen["changed"] or 0), float(seen["most"] or 0.0))


def passes(edges: DataFrame, *, iterations: int = 10, damping: float = 1.0, tolerance: float | None = None, resume: str | None = None) -> tuple[DataFrame, list[Pass]]:
    """(vertex, rank) of a general graph after the passes, and what each counted, the start as pass 0.

    A vertex gives its rank in equal shares along its edges; repeated edges weigh as often as they occur; the rank of
    sinks is shared by all.  tolerance: the loop ends when no rank changes by more than that.  resume: a shared folder of
    this graph and damping alone; finished passes stay there, and a later call goes on from the last of them.
    """
    spark = edges.sparkSession
    log = Manifest(spark, resume) if resume else None
    scratch = Scratch(spark, resume)
    done = log.last() if log else None
    if done and done[1]["damping"] != damping:
        raise ValueError(f"{resume} holds passes with damping {done[1]['damping']}")
    graph = found(done[1]["graph"], scratch) if done else place_graph(edges, scratch)
    n = graph.n_nodes
    if n == 0:
        return graph.nodes.select("vertex", F.lit(0.0).alias("rank")), [Pass(0.0, 0.0, 0, 0.0)]
    counters = (F.sum(F.when(F.col("slots") == 0, F.col("rank"))).alias("lost"), F.sum("rank").alias("mass"), F.count_if(F.col("delta") > 0).alias("changed"), F.max("delta").alias("most"))

    def write(ranks: DataFrame) -> tuple[DataFrame, Pass]:
        out, seen = scratch.place(ranks, graph.parts, "vertex", what=counters, side=("delta",))
        return out, _observed(seen)

    def spread(state: tuple[DataFrame, list[Pass]], _: int) -> tuple[tuple[DataFrame, list[Pass]], bool]:
        ranks, told = state
        got = _contributions(graph, ranks)
        base = (1.0 - damping) / n + damping * told[-1].lost / n
        rank = F.lit(base) + F.lit(damping) * F.coalesce("s", F.lit(0.0))
        new = ranks.join(got, ranks["vertex"] == got["dst"], "left").select("vertex", "slots", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("delta"))
        new, seen = write(new)
        told = [*told, seen]
        finish(new, told)
        scratch.drop(ranks)
        return (new, told), settled(told)

    def finish(ranks: DataFrame, told: list[Pass]) -> None:
        if log:
            log.finish(len(told) - 1, {"damping": damping, "graph": described(graph, scratch), "ranks": scratch.described(ranks, graph.parts, "vertex"), "told": [vars(p) for p in told]})

    def settled(told: list[Pass]) -> bool:
        return tolerance is not None and len(told) > 1 and told[-1].most <= tolerance

    if done:
        state = scratch.found(done[1]["ranks"]), [Pass(**p) for p in done[1]["told"]]
    else:
        ranks, seen = write(graph.nodes.select("vertex", "slots", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("delta")))
        state = ranks, [seen]
        finish(*state)
    if not settled(state[1]):
        state, _ = fixpoint(state, spread, iterations + 1 - len(state[1]))
    return state[0].select("vertex", "rank"), state[1]


def pagerank(edges: DataFrame, *, iterations: int = 10, damping: float = 1.0, tolerance: float | None = None, resume: str | None = None) -> DataFrame:
    """(vertex, rank) of a general graph."""
    return passes(edges, iterations=iterations, damping=damping, tolerance=tolerance, resume=resume)[0]


def pass_counters(edges: DataFrame, *, iterations: int = 10, damping: float = 1.0) -> DataFrame:
    """(pass, lost, mass): the sinks' rank and the sum of all ranks after each pass, as counted by the passes themselves."""
    rows = [(i, p.lost, p.mass) for i, p in enumerate(passes(edges, iterations=iterations, damping=damping)[1])]
    return edges.sparkSession.createDataFrame(rows, "pass int, lost double, mass double")


def chain_passes(spark: SparkSession, k: int, iterations: int = 10) -> tuple[DataFrame, list[float]]:
    """Ranks of chain_graph(k) after the passes, and the dangling mass of each pass: what reached the dummy 0.

    The dummy has no rank of its own; its mass is shared by the k * k others.
    """
    n, scratch = k * k, Scratch(spark)
    graph = place_graph(chain_graph(spark, k), scratch)
    mass = F.sum(F.when(F.col("vertex") == 0, F.col("s"))).alias("lost")

    def spread(state: tuple[DataFrame, list[float]], _: int) -> tuple[tuple[DataFrame, list[float]], bool]:
        ranks, lost = state
        got = _contributions(graph, ranks)
        got = graph.nodes.join(got, graph.nodes["vertex"] == got["dst"], "left").select("vertex", "slots", F.coalesce("s", F.lit(0.0)).alias("s"))
        got, seen = scratch.place(got, graph.parts, "vertex", what=(mass,))
        lost = [*lost, float(seen["lost"] or 0.0)]
        return (got.select("vertex", "slots", F.when(F.col("vertex") == 0, F.lit(0.0)).otherwise(F.col("s") + F.lit(lost[-1] / n)).alias("rank")), lost), False

    first = graph.nodes.join(chain_ranks(spark, k), "vertex")
    ranks, lost = fixpoint((first, []), spread, iterations)[0]
    return ranks.select("vertex", "rank"), lost


def pagerank_chain(spark: SparkSession, k: int, iterations: int = 10) -> DataFrame:
    """(vertex, rank) of every vertex, the dummy 0 included with rank 0."""
    return chain_passes(spark, k, iterations)[0]


def dangling_mass(spark: SparkSession, k: int, iterations: int = 10) -> DataFrame:
    """(pass, mass): what reached the dummy in each pass."""
    rows = [(i, m) for i, m in enumerate(chain_passes(spark, k, iterations)[1], 1)]
    return spark.createDataFrame(rows, "pass int, mass double")


def pagerank_top(ranks: DataFrame, n: int = 100) -> DataFrame:
    """The n vertices of the highest rank; the smaller id wins ties."""
    return ranks.orderBy(F.desc("rank"), F.asc("vertex")).limit(n)


def pagerank_first(ranks: DataFrame, max_vertex: int = 100) -> DataFrame:
    """The ranks of the vertices up to max_vertex, the dummy 0 included."""
    return ranks.filter(F.col("vertex") <= max_vertex)


def rank_of(ranks: DataFrame, *vertices) -> DataFrame:
    """The ranks of the named vertices; one without a rank is not listed."""
    return ranks.filter(F.col("vertex").isin(*vertices))


def pagerank_mass(ranks: DataFrame) -> DataFrame:
    """The sum of all ranks: 1 after every pass."""
    return ranks.agg(F.sum("rank").alias("mass"))
