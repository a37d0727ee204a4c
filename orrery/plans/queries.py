"""Registered queries of the graph engine and the SQL each is compared with.

Every query runs over whole tables.  Edges are lineitem's part -> supplier pairs unless named otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import aggregate, joins, kmeans, pagerank, records, sssp
from orrery.plans.scratch import Scratch
from orrery.sources import edges as E
from orrery.sources import points, sinks
from orrery.sources.generators import chain_graph, chain_ranks

SOURCE, CLUSTERS, CAP, TOP = 1, 4, 1000, 100

EDGES = "e AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
SIMPLE = f"{EDGES}, s AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst)"
REVERSED = "e AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem)"
TRIANGLES = "FROM s x JOIN s y ON x.dst = y.src JOIN s z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_partkey").agg(F.count("*").alias("n"))


def _chains(spark: SparkSession, d: str) -> int:
    """k for chain graphs: k chains of k parts each, as many as the table part fills."""
    return max(1, isqrt(spark.read.parquet(f"{d}/part.parquet").count()))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of parts and suppliers."""
    return pagerank.pagerank(E.part_supp(spark, d), damping=0.85)


def _top_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ordered by rounded ranks, so that sums in another order give the same rows."""
    return pagerank.pagerank_top(_ranks(spark, d).withColumn("rank", F.round("rank", 9)), TOP)


def _rank_of_last_supplier(spark: SparkSession, d: str) -> DataFrame:
    last = spark.read.parquet(f"{d}/supplier.parquet").agg(F.max("s_suppkey")).first()[0]
    return pagerank.rank_of(_ranks(spark, d), SOURCE, last).select("vertex", F.round("rank", 9).alias("rank"))


def _adjacency_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' and parts' blocks of 8, summed up: what the blocks of a vertex hold together."""
    got = aggregate.adjacency_blocks(E.part_supp(spark, d), 8).select("src", F.explode("adj").alias("dst"))
    return got.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("least"), F.max("dst").alias("greatest"), F.sum("dst").alias("total"))


def _through_file(spark: SparkSession, edges: DataFrame, sep: str, back: Callable[[str], DataFrame]) -> DataFrame:
    """Edges written as lines and read again."""
    path = Scratch(spark).folder()
    sinks.write_delimited(edges, path, sep=sep)
    return E.numeric(back(path))


def _half_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of edges; those of first items lack the second field, in three ways."""
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    line = F.when(F.col("l_linenumber") > 3, F.concat_ws(",", part, supp, F.lit("more"))).when(F.col("l_linenumber") == 1, part).when(F.col("l_linenumber") == 2, F.concat(part, F.lit(","))).otherwise(F.concat_ws(",", part, supp))
    return spark.read.parquet(f"{d}/lineitem.parquet").select(line.alias("value"))


def _tuples(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark).folder()
    sinks.write_tuples(aggregate.followers_reduce(E.part_supp(spark, d)).select("dst", "n"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _kmeans_files(spark: SparkSession, d: str) -> DataFrame:
    """Counts and first centroids go by files, as between jobs."""
    scratch = Scratch(spark)
    counts, centroids = scratch.folder(), scratch.folder()
    points.write_counts(_points(spark, d), counts)
    read = points.read_counts(spark, counts)
    points.write_centroids(spark, kmeans.seeds(read, CLUSTERS), centroids)
    return kmeans.kmeans_centroids(read, CLUSTERS, start=points.read_centroids(spark, centroids))


def _triangles_by_side_file(spark: SparkSession, d: str) -> DataFrame:
    """The replicated edges come from a file of their own."""
    path = Scratch(spark).folder()
    sinks.write_delimited(E.part_supp(spark, d), path, sep=",")
    return joins.triangle_count_replicated(E.part_supp(spark, d), E.numeric(E.read_edges(spark, path)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ps = E.part_supp
    return {
        "followers_reduce": lambda s, d: aggregate.followers_reduce(ps(s, d)),
        "followers_aggregate": lambda s, d: aggregate.followers_aggregate(ps(s, d)),
        "followers_fold": lambda s, d: aggregate.followers_fold(ps(s, d)),
        "followers_group": lambda s, d: aggregate.followers_group(ps(s, d)),
        "followers_minmax": lambda s, d: aggregate.followers_minmax(ps(s, d)),
        "followers_cust_supp": lambda s, d: aggregate.followers_reduce(E.cust_supp(s, d)),
        "followers_event_next": lambda s, d: aggregate.followers_reduce(E.event_next(s, d)),
        "edges_capped": lambda s, d: E.cap_ids(ps(s, d), CAP).groupBy("src", "dst").agg(F.count("*").alias("n")),
        "edges_reversed": lambda s, d: aggregate.followers_reduce(E.reverse(ps(s, d))),
        "edges_union": lambda s, d: aggregate.followers_reduce(E.union_edges(ps(s, d), E.reverse(ps(s, d)))),
        "adjacency_list": lambda s, d: aggregate.adjacency_list(ps(s, d)).select("src", F.array_join(F.col("adj").cast("array<string>"), ",").alias("adj")),
        "adjacency_set": lambda s, d: aggregate.adjacency_set(ps(s, d)).select("src", F.array_join(F.col("adj").cast("array<string>"), ",").alias("adj")),
        "adjacency_blocks": _adjacency_blocks,
        "two_paths": lambda s, d: joins.two_paths(ps(s, d)),
        "closed_walks3": lambda s, d: joins.closed_walks3(ps(s, d)),
        "triangle_count": lambda s, d: joins.triangle_count(ps(s, d)),
        "triangle_count_merge": lambda s, d: joins.triangle_count(ps(s, d), hint="merge"),
        "triangle_count_replicated": lambda s, d: joins.triangle_count_replicated(ps(s, d)),
        "triangle_count_capped": lambda s, d: joins.triangle_count(ps(s, d), max_id=CAP),
        "triangle_list": lambda s, d: joins.triangle_list(ps(s, d)),
        "triangle_count_event_next": lambda s, d: joins.triangle_count(E.event_next(s, d)),
        "chain_graph": lambda s, d: chain_graph(s, _chains(s, d)),
        "chain_ranks": lambda s, d: chain_ranks(s, _chains(s, d)),
        "pagerank_chain": lambda s, d: pagerank.pagerank_chain(s, _chains(s, d)).select("vertex", F.round("rank", 12).alias("rank")),
        "dangling_mass_chain": lambda s, d: pagerank.dangling_mass(s, _chains(s, d)).select("pass", F.round("mass", 12).alias("mass")),
        "pagerank_top": _top_ranks,
        "pagerank_first100": lambda s, d: pagerank.pagerank_first(_ranks(s, d), TOP).select("vertex", F.round("rank", 9).alias("rank")),
        "pagerank_mass": lambda s, d: pagerank.pagerank_mass(_ranks(s, d)).select(F.round("mass", 9).alias("mass")),
        "pagerank_rank_of": _rank_of_last_supplier,
        "dangling_mass": lambda s, d: pagerank.pass_counters(ps(s, d), damping=0.85).select("pass", F.round("lost", 9).alias("lost"), F.round("mass", 9).alias("mass")),
        "pagerank_edges": lambda s, d: pagerank.pagerank(ps(s, d), damping=0.85).select("vertex", F.round("rank", 9).alias("rank")),
        "pagerank_reversed": lambda s, d: pagerank.pagerank(E.reverse(ps(s, d)), damping=0.85).select("vertex", F.round("rank", 9).alias("rank")),
        "sssp_distance": lambda s, d: sssp.sssp_distance(ps(s, d), SOURCE),
        "sssp_distance_reversed": lambda s, d: sssp.sssp_distance(E.reverse(ps(s, d)), SOURCE),
        "sssp_path": lambda s, d: sssp.sssp_path(ps(s, d), SOURCE),
        "sssp_records": lambda s, d: records.sssp_records(ps(s, d), SOURCE),
        "sssp_levels": lambda s, d: sssp.sssp_levels(ps(s, d), SOURCE),
        "kmeans_seeds": lambda s, d: kmeans.kmeans_seeds(_points(s, d), CLUSTERS),
        "kmeans_assign": lambda s, d: kmeans.kmeans_assign(_points(s, d).withColumnRenamed("l_partkey", "p"), CLUSTERS).select("p", "n", "centroid"),
        "kmeans_centroids": lambda s, d: kmeans.kmeans_centroids(_points(s, d), CLUSTERS),
        "kmeans_sse": lambda s, d: kmeans.kmeans_sse(_points(s, d), CLUSTERS),
        "kmeans_powers": lambda s, d: kmeans.kmeans_centroids(_points(s, d), CLUSTERS, start=kmeans.seeds(_points(s, d), CLUSTERS, "powers")),
        "file_text": lambda s, d: aggregate.followers_reduce(_through_file(s, ps(s, d), ",", lambda p: E.parse_edges(s.read.text(p)))),
        "file_csv": lambda s, d: aggregate.followers_reduce(_through_file(s, ps(s, d), ",", lambda p: E.read_edges(s, p))),
        "file_tab": lambda s, d: aggregate.followers_reduce(_through_file(s, ps(s, d), "\t", lambda p: E.parse_edges(s.read.text(p), sep="\t"))),
        "file_whitespace": lambda s, d: aggregate.followers_reduce(_through_file(s, ps(s, d), " ", lambda p: E.parse_edges(s.read.text(p), sep=E.WHITESPACE))),
        "file_tuples": _tuples,
        "file_half_lines": lambda s, d: aggregate.followers_reduce(E.numeric(E.parse_edges(_half_lines(s, d), drop_malformed=True))),
        "kmeans_files": _kmeans_files,
        "triangle_count_side_file": _triangles_by_side_file,
    }


def _chain_sql(out: str, passes: int = 10) -> str:
    ctes = [
        "k AS MATERIALIZED (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS k, greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) ** 2 AS n FROM part)",
        "i AS MATERIALIZED (SELECT i, k, n FROM k, range(0, CAST(n AS BIGINT) + 1) t(i))",
        "g AS MATERIALIZED (SELECT i AS src, CASE WHEN i % k = 0 THEN 0 ELSE i + 1 END AS dst FROM i WHERE i > 0)",
        "r0 AS MATERIALIZED (SELECT i AS vertex, CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / n END AS rank FROM i)",
    ]
    for p in range(1, passes + 1):
        ctes.append(f"c{p} AS MATERIALIZED (SELECT dst, sum(rank) AS s FROM g JOIN r{p - 1} ON src = vertex GROUP BY dst)")
        ctes.append(f"r{p} AS MATERIALIZED (SELECT vertex, CASE WHEN vertex = 0 THEN 0.0::DOUBLE ELSE coalesce(s, 0) + (SELECT coalesce(sum(s), 0) FROM c{p} WHERE dst = 0) / (SELECT n FROM k) END AS rank FROM r0 LEFT JOIN c{p} ON vertex = dst)")
    return f"WITH {', '.join(ctes)} {out.format(r=f'r{passes}')}"


def _pagerank_sql(edges: str, out: str = "SELECT vertex, round(rank, 9) AS rank FROM {r}", passes: int = 10, damping: float = 0.85) -> str:
    ctes = [edges, "d AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY src)", "g AS MATERIALIZED (SELECT e.src, dst, count(*)::DOUBLE / any_value(d) AS share FROM e JOIN d ON e.src = d.src GROUP BY e.src, dst)", "v AS MATERIALIZED (SELECT vertex, d.src IS NOT NULL AS o FROM (SELECT src AS vertex FROM e UNION SELECT dst FROM e) LEFT JOIN d ON vertex = d.src)", "r0 AS MATERIALIZED (SELECT vertex, o, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)"]
    for p in range(1, passes + 1):
        ctes.append(f"c{p} AS MATERIALIZED (SELECT dst, sum(rank * share) AS s FROM g JOIN r{p - 1} ON src = vertex GROUP BY dst)")
        ctes.append(f"r{p} AS MATERIALIZED (SELECT vertex, o, ({1 - damping}::DOUBLE + {damping}::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{p - 1} WHERE NOT o)) / (SELECT count(*) FROM v) + {damping}::DOUBLE * coalesce(s, 0) AS rank FROM v LEFT JOIN c{p} ON vertex = dst)")
    return f"WITH {', '.join(ctes)} {out.format(r=f'r{passes}')}"


def _kmeans_sql(k: int, out: str, passes: int = 10, first: str = "") -> str:
    """Passes beyond convergence change nothing, so the loop is unrolled to its bound."""
    first = first or f"SELECT DISTINCT j * ((SELECT max(n) FROM p) // {k}) AS c FROM range(1, {k + 1}) t(j)"
    ctes = ["p AS MATERIALIZED (SELECT l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1)", f"m0 AS MATERIALIZED ({first})"]
    for i in range(1, passes + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT p, n, (SELECT arg_min(c, (abs(n - c), c)) FROM m{i - 1}) AS centroid FROM p)")
        ctes.append(f"z{i} AS MATERIALIZED (SELECT centroid, CAST(CAST(CAST(sum(n) // count(*) AS BIGINT) AS FLOAT) AS BIGINT) AS c, count(*) AS size FROM a{i} GROUP BY centroid)")
        ctes.append(f"m{i} AS MATERIALIZED (SELECT DISTINCT c FROM z{i})")
    return f"WITH {', '.join(ctes)} {out.format(a=f'a{passes}', z=f'z{passes}')}"


def _bfs_sql(source: int, edges: str, out: str, depth: int = 12) -> str:
    ctes = [edges.replace("e AS (SELECT", "e AS MATERIALIZED (SELECT DISTINCT"), f"s0 AS MATERIALIZED (SELECT {source}::BIGINT AS vertex, 0::BIGINT AS dist, '{source}' AS path)"]
    for i in range(1, depth + 1):
        to = f"'{source}'" if i == 1 else "s.vertex::VARCHAR || ',' || s.path"
        ctes.append(f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT e.dst, {i}, min({to}) FROM s{i - 1} s JOIN e ON s.vertex = e.src WHERE s.dist = {i - 1} AND e.dst NOT IN (SELECT vertex FROM s{i - 1}) GROUP BY e.dst)")
    return f"WITH {', '.join(ctes)} {out.format(s=f's{depth}')}"


def oracle_sql() -> dict[str, str]:
    count = f"WITH {EDGES} SELECT dst, count(*) AS n FROM e GROUP BY dst"
    adj = f"WITH {EDGES} SELECT src, string_agg({{}}dst::VARCHAR, ',' ORDER BY dst) AS adj FROM {{}} GROUP BY src"
    replicated = f"WITH {EDGES}, u AS (SELECT DISTINCT src, dst FROM e) SELECT count(*) // 3 AS n FROM e x JOIN u y ON x.dst = y.src JOIN u z ON y.dst = z.src AND z.dst = x.src WHERE y.dst <> x.src"
    far = f"SELECT v.vertex, coalesce(s.dist::DOUBLE, 'infinity'::DOUBLE) AS distance FROM (SELECT src AS vertex FROM e UNION SELECT dst FROM e UNION SELECT {SOURCE}) v LEFT JOIN {{s}} s ON v.vertex = s.vertex"
    nxt = "ev AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT * FROM ev WHERE dst IS NOT NULL)"
    return {
        "followers_reduce": count,
        "followers_aggregate": count,
        "followers_fold": count,
        "followers_group": count,
        "followers_minmax": f"SELECT min(n) AS min_n, max(n) AS max_n FROM ({count})",
        "followers_cust_supp": "SELECT l_suppkey AS dst, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
        "followers_event_next": f"WITH {nxt} SELECT dst, count(*) AS n FROM e GROUP BY dst",
        "edges_capped": f"WITH {EDGES} SELECT src, dst, count(*) AS n FROM e WHERE src <= {CAP} AND dst <= {CAP} GROUP BY src, dst",
        "edges_reversed": "SELECT l_partkey AS dst, count(*) AS n FROM lineitem GROUP BY 1",
        "edges_union": "SELECT dst, count(*) AS n FROM (SELECT l_suppkey AS dst FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) GROUP BY dst",
        "adjacency_list": adj.format("", "e"),
        "adjacency_set": adj.format("", "(SELECT DISTINCT src, dst FROM e)"),
        "adjacency_blocks": f"WITH {EDGES} SELECT src, count(*) AS n, min(dst) AS least, max(dst) AS greatest, sum(dst)::BIGINT AS total FROM e GROUP BY src",
        "two_paths": f"WITH {EDGES} SELECT x.src AS a, y.dst AS c, count(*) AS n FROM e x JOIN e y ON x.dst = y.src GROUP BY 1, 2",
        "closed_walks3": f"WITH {EDGES} SELECT count(*) AS n FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src",
        "triangle_count": f"WITH {SIMPLE} SELECT count(*) AS n {TRIANGLES}",
        "triangle_count_merge": f"WITH {SIMPLE} SELECT count(*) AS n {TRIANGLES}",
        "triangle_count_replicated": replicated,
        "triangle_count_capped": f"WITH {EDGES}, s AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst AND src <= {CAP} AND dst <= {CAP}) SELECT count(*) AS n {TRIANGLES}",
        "triangle_list": f"WITH {SIMPLE} SELECT x.src AS a, x.dst AS b, y.dst AS c {TRIANGLES}",
        "triangle_count_event_next": f"WITH {nxt}, s AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst) SELECT count(*) AS n {TRIANGLES}",
        "chain_graph": _chain_sql("SELECT src, dst FROM g"),
        "chain_ranks": _chain_sql("SELECT vertex, rank FROM r0"),
        "pagerank_chain": _chain_sql("SELECT vertex, round(rank, 12) AS rank FROM {r}"),
        "dangling_mass_chain": _chain_sql(" UNION ALL ".join(f"SELECT {p}::INTEGER AS pass, round(coalesce(sum(s), 0), 12) AS mass FROM c{p} WHERE dst = 0" for p in range(1, 11))),
        "pagerank_top": _pagerank_sql(EDGES, f"SELECT vertex, round(rank, 9) AS rank FROM {{r}} ORDER BY round({{r}}.rank, 9) DESC, vertex LIMIT {TOP}"),
        "pagerank_first100": _pagerank_sql(EDGES, f"SELECT vertex, round(rank, 9) AS rank FROM {{r}} WHERE vertex <= {TOP}"),
        "pagerank_mass": _pagerank_sql(EDGES, "SELECT round(sum(rank), 9) AS mass FROM {r}"),
        "pagerank_rank_of": _pagerank_sql(EDGES, f"SELECT vertex, round(rank, 9) AS rank FROM {{r}} WHERE vertex = {SOURCE} OR vertex = (SELECT max(s_suppkey) FROM supplier)"),
        "dangling_mass": _pagerank_sql(EDGES, " UNION ALL ".join(f"SELECT {p}::INTEGER AS pass, round(coalesce(sum(rank) FILTER (NOT o), 0), 9) AS lost, round(sum(rank), 9) AS mass FROM r{p}" for p in range(11))),
        "pagerank_edges": _pagerank_sql(EDGES),
        "pagerank_reversed": _pagerank_sql(REVERSED),
        "sssp_distance": _bfs_sql(SOURCE, EDGES, far),
        "sssp_distance_reversed": _bfs_sql(SOURCE, REVERSED, far),
        "sssp_path": _bfs_sql(SOURCE, EDGES, "SELECT vertex, dist, path FROM {s}"),
        "sssp_records": _bfs_sql(SOURCE, EDGES, "SELECT vertex, dist, path FROM {s}"),
        "sssp_levels": _bfs_sql(SOURCE, EDGES, "SELECT dist, count(*) AS n FROM {s} GROUP BY dist"),
        "kmeans_seeds": f"SELECT j::INTEGER AS j, j * ((SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)) // {CLUSTERS}) AS centroid FROM range(1, {CLUSTERS + 1}) t(j)",
        "kmeans_assign": _kmeans_sql(CLUSTERS, "SELECT p, n, centroid FROM {a}"),
        "kmeans_centroids": _kmeans_sql(CLUSTERS, "SELECT c AS centroid, size FROM {z}"),
        "kmeans_powers": _kmeans_sql(CLUSTERS, "SELECT c AS centroid, size FROM {z}", first=f"SELECT CAST(10 ** j AS BIGINT) AS c FROM range(0, {CLUSTERS}) t(j)"),
        "file_text": count,
        "file_csv": count,
        "file_tab": count,
        "file_whitespace": count,
        "file_tuples": f"SELECT '(' || dst || ',' || n || ')' AS line FROM ({count})",
        "file_half_lines": "SELECT l_suppkey AS dst, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1",
        "kmeans_files": _kmeans_sql(CLUSTERS, "SELECT c AS centroid, size FROM {z}"),
        "triangle_count_side_file": replicated,
        "kmeans_sse": _kmeans_sql(CLUSTERS, "SELECT CAST(sum((n - c) * (n - c)) AS BIGINT) AS sse FROM {a} a JOIN {z} z ON a.centroid = z.centroid"),
    }
