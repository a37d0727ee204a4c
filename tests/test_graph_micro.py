import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.functions.scalar import truncated_mean
from orrery.operators import aggregate, joins, kmeans, pagerank, placement, records, sssp
from orrery.plans import scratch as scratch_tables
from orrery.plans.scratch import Scratch
from orrery.sources import edges as E
from orrery.sources import points, sinks
from orrery.sources.generators import chain_graph
from orrery.streaming.followers import followers_stream


def graph(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src bigint, dst bigint")


def plan(df):
    return df._jdf.queryExecution().toString()


CASES = [
    ([(1, 2), (2, 3), (3, 1)], 1, 3, 1),
    ([(1, 2), (1, 2), (2, 3), (3, 1)], 1, 6, 1),
    ([(1, 1), (1, 2), (2, 1)], 0, 4, 0),
    ([(1, 1)], 0, 1, 0),
    ([(1, 2), (2, 1)], 0, 0, 0),
    ([(1, 2), (2, 3), (3, 1), (2, 1), (3, 2), (1, 3)], 2, 6, 2),
]


@pytest.mark.parametrize("pairs,replicated,walks,simple", CASES)
def test_triangles(spark, pairs, replicated, walks, simple):
    e = graph(spark, *pairs)
    assert joins.triangle_count_replicated(e).first()["n"] == replicated
    assert joins.triangle_count_replicated(e, broadcast_rows=0).first()["n"] == replicated
    assert joins.closed_walks3(e).first()["n"] == walks
    for hint in (None, "merge", "broadcast", "shuffle_hash"):
        assert joins.triangle_count(e, hint=hint).first()["n"] == simple


def test_join_strategies(spark, sf_dir):
    e = E.part_supp(spark, sf_dir)
    assert "SortMergeJoin" in plan(joins.triangle_count(e, hint="merge"))
    assert "BroadcastHashJoin" in plan(joins.triangle_count(e, hint="broadcast"))
    assert "partial_count" in plan(aggregate.followers_reduce(e))
    assert "Python" not in plan(aggregate.followers_group(e))


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n,b\na,b,c\n")
    ok = E.read_edges(spark, str(tmp_path / "e.csv"))
    assert sorted(r["dst"] for r in ok.collect()) == ["b", "b", "b"]
    for bad in ("a,", "a"):
        (tmp_path / "bad.csv").write_text(f"x,y\n{bad}\n")
        with pytest.raises(Exception, match="second field"):
            E.read_edges(spark, str(tmp_path / "bad.csv")).collect()
        assert E.read_edges(spark, str(tmp_path / "bad.csv"), drop_malformed=True).count() == 1
        lines = spark.createDataFrame([("x,y",), (bad,)], "value string")
        with pytest.raises(Exception, match="second field"):
            E.parse_edges(lines).collect()
        assert E.parse_edges(lines, drop_malformed=True).count() == 1
    words = spark.createDataFrame([("1", "x"), ("2", "3")], "src string, dst string")
    assert [tuple(r) for r in E.numeric(words, drop_malformed=True).collect()] == [(2, 3)]
    with pytest.raises(Exception):
        E.numeric(words).collect()


DISTANCES = [
    ([(1, 2), (2, 3), (3, 1), (3, 4)], {1: 0, 2: 1, 3: 2, 4: 3}),
    ([(1, 2), (2, 3)], {1: 0, 2: 1, 3: 2}),
    ([(1, 2), (2, 3), (3, 2)], {1: 0, 2: 1, 3: 2}),
    ([(1, 2), (2, 3), (3, 1), (5, 6), (2, 4)], {1: 0, 2: 1, 3: 2, 4: 2, 5: float("inf"), 6: float("inf")}),
    ([(2, 3)], {1: 0, 2: float("inf"), 3: float("inf")}),
]


@pytest.mark.parametrize("pairs,want", DISTANCES)
def test_shortest_paths(spark, pairs, want):
    assert {r["vertex"]: r["distance"] for r in sssp.sssp_distance(graph(spark, *pairs), 1).collect()} == want
    paths = {r["vertex"]: (r["dist"], r["path"]) for r in sssp.sssp_path(graph(spark, *pairs), 1).collect()}
    assert {v: d for v, (d, _) in paths.items()} == {v: d for v, d in want.items() if d != float("inf")}
    if 5 in want:
        assert paths == {1: (0, "1"), 2: (1, "1"), 3: (2, "2,1"), 4: (2, "2,1")}


def test_string_ids_and_ties(spark):
    e = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d")], "src string, dst string")
    assert {r["vertex"]: r["path"] for r in sssp.sssp_path(e, "a").collect()} == {"a": "a", "b": "a", "c": "a", "d": "b,a"}


def test_edge_invariant(spark, sf_dir):
    e = E.part_supp(spark, sf_dir)
    d = sssp.sssp_distance(e, 1)
    far = e.join(d.select(F.col("vertex").alias("src"), F.col("distance").alias("du")), "src").join(d.select(F.col("vertex").alias("dst"), F.col("distance").alias("dv")), "dst")
    assert far.filter("dv > du + 1").isEmpty()


def test_pagerank_chain(spark):
    want = {2: [0.166748046875, 0.333251953125], 4: [0.024954140186309814, 0.049421846866607666, 0.07509952783584595, 0.10052448511123657]}
    for k, ranks in want.items():
        got = {r["vertex"]: r["rank"] for r in pagerank.pagerank_chain(spark, k).collect()}
        assert got[0] == 0 and [got[i] for i in range(1, k + 1)] == ranks and sum(got.values()) == 1
    masses = [r["mass"] for r in pagerank.dangling_mass(spark, 2).orderBy("pass").collect()]
    assert masses == [0.5, 0.75, 0.625, 0.6875, 0.65625, 0.671875, 0.6640625, 0.66796875, 0.666015625, 0.6669921875]
    with pytest.raises(ValueError):
        chain_graph(spark, 0)


def test_pagerank_general(spark):
    ranks = pagerank.pagerank(graph(spark, (1, 2), (1, 2), (1, 3), (3, 1)))
    assert abs(pagerank.pagerank_mass(ranks).first()["mass"] - 1) < 1e-12
    assert pagerank.pagerank(graph(spark)).count() == 0


KMEANS = [
    ([1, 1, 2, 3, 3, 4, 50, 52, 100], 4, [25, 50, 75, 100], [(2, 6), (51, 2), (100, 1)], 10, 2),
    ([1, 1, 1, 10, 11, 40], 3, [13, 26, 39], [(4, 5), (40, 1)], 112, 2),
    ([100, 100], 3, [33, 66, 99], [(100, 2)], 0, 2),
    ([1, 2], 4, [0, 0, 0, 0], [(1, 2)], 1, 2),
]


@pytest.mark.parametrize("counts,k,seeds,final,sse,passes", KMEANS)
def test_kmeans(spark, counts, k, seeds, final, sse, passes):
    p = spark.createDataFrame([(n,) for n in counts], "n bigint")
    assert kmeans.seeds(p, k) == seeds
    assert kmeans.fit(p, k)[2] == passes
    assert sorted(tuple(r) for r in kmeans.kmeans_centroids(p, k).collect()) == final
    assert kmeans.kmeans_sse(p, k).first()["sse"] == sse


def test_single_precision_mean(spark):
    assert spark.range(1).agg(truncated_mean("sum(33554433L)", "count(*)").alias("m")).first()["m"] == 33554432


def test_empty_tables(spark):
    e = graph(spark)
    assert aggregate.followers_reduce(e).count() == aggregate.followers_group(e).count() == aggregate.adjacency_list(e).count() == 0
    assert joins.triangle_count(e).first()["n"] == joins.closed_walks3(e).first()["n"] == joins.triangle_count_replicated(e).first()["n"] == 0
    assert kmeans.kmeans_centroids(spark.createDataFrame([], "n bigint"), 3).count() == 0
    assert {tuple(r) for r in sssp.sssp_distance(e, 1).collect()} == {(1, 0.0)}


def test_generic_aggregate(spark):
    e = graph(spark, (1, 5), (2, 5), (3, 6))
    got = aggregate.aggregate_by_key(e, "dst", "src", F.lit(0).cast("bigint"), lambda a, x: a + x)
    assert {tuple(r) for r in got.collect()} == {(5, 3), (6, 3)}


def test_sinks(spark, tmp_path):
    e = graph(spark, (1, 2))
    sinks.write_delimited(e, str(tmp_path / "t"))
    sinks.write_tuples(e, str(tmp_path / "u"))
    sinks.write_parquet(e, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "1\t2"
    assert spark.read.text(str(tmp_path / "u")).first()[0] == "(1,2)"
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_stream(spark, tmp_path):
    graph(spark, (1, 2), (3, 2)).write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        followers_stream(graph(spark))
    q = followers_stream(spark.readStream.schema("src bigint, dst bigint").parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("fs").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM fs").collect()] == [(2, 2)]


def test_hub_triangles(spark):
    """A hub in the middle of the ids: both forms agree with a plain count."""
    rnd = random.Random(2)
    pairs = [(rnd.randrange(60), 30) for _ in range(200)] + [(30, rnd.randrange(60)) for _ in range(200)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(300)]
    have = set(pairs)
    want = {(a, b, c) for a, b in have for x, c in have if x == b and (c, a) in have and a < b and a < c and b != c}
    assert {tuple(r) for r in joins.triangle_list(graph(spark, *pairs)).collect()} == want
    walks = sum(1 for a, b in pairs for x, c in pairs if x == b for y, z in pairs if y == c and z == a)
    assert joins.closed_walks3(graph(spark, *pairs)).first()["n"] == walks


def test_separators_and_quotes(spark, tmp_path):
    lines = spark.createDataFrame([("a|b|c",), ('"x|y"|z',)], "value string")
    assert [tuple(r) for r in E.parse_edges(lines, sep="|").collect()] == [("a", "b"), ('"x', 'y"')]
    assert tuple(E.parse_edges(spark.createDataFrame([("a \t b",)], "value string"), sep=E.WHITESPACE).first()) == ("a", "b")
    (tmp_path / "q.csv").write_text('"a,b",c\n')
    assert tuple(E.read_edges(spark, str(tmp_path / "q.csv")).first()) == ('"a', 'b"')


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Small tables as large ones are: in several parts, and joined where they lie or by an exchange."""
    monkeypatch.setattr(placement, "parts_for", lambda s, n: 8)
    monkeypatch.setattr(records, "parts_for", lambda s, n: 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_static_graph_stays(spark, no_broadcast):
    """A pass joins the graph where it lies: the ranks are exchanged before that join, their sums after it, and nothing else."""
    scratch = Scratch(spark)
    g = placement.place_graph(graph(spark, (1, 2), (2, 3)), scratch)
    ranks, _ = scratch.place(g.nodes.select("vertex", "slots", F.lit(1.0).alias("rank")), g.parts, "vertex")
    got = pagerank._contributions(g, ranks)
    text = executed(ranks.join(got, ranks["vertex"] == got["dst"], "left"))
    assert text.count("Exchange hashpartitioning") == 2 and "hashpartitioning(src" not in text
    assert text.count("hashpartitioning(vertex#") == 1 and text.count("hashpartitioning(dst#") == 1


def test_edges_are_packed_and_parts_meet(spark, no_broadcast, monkeypatch):
    """A pass joins a row a vertex, not one an edge; also where a graph has other parts than the session it stays where it lies."""
    monkeypatch.setattr(placement, "parts_for", lambda s, n: 3)
    monkeypatch.setattr(placement, "piece_rows", lambda rows, parts: rows)
    scratch, seen = Scratch(spark), []
    g = placement.place_graph(graph(spark, (1, 2), (1, 3), (1, 3), (1, 4), (2, 3)), scratch)
    assert g.edges.count() == 2 and {(r["src"], r["dst"], r["w"], r["share"]) for r in g.reach(g.nodes).collect()} == {(1, 2, 1, 0.25), (1, 3, 2, 0.5), (1, 4, 1, 0.25), (2, 3, 1, 1.0)}
    ranks, _ = scratch.place(g.nodes.select("vertex", "slots", F.lit(1.0).alias("rank")), g.parts, "vertex")
    with scratch_tables.dealt_into(spark, g.parts):
        got = pagerank._contributions(g, ranks)
        text = executed(ranks.join(got, ranks["vertex"] == got["dst"], "left"))
    assert text.count("Exchange hashpartitioning") == 2 and "hashpartitioning(src" not in text
    real = scratch_tables.dealt_into
    monkeypatch.setattr(scratch_tables, "dealt_into", lambda s, n: seen.append(n) or real(s, n))
    dealt = spark.conf.get("spark.sql.shuffle.partitions")
    assert pagerank.pagerank(graph(spark, (1, 2), (2, 1)), iterations=2).count() == 2 and set(seen) == {3}
    assert spark.conf.get("spark.sql.shuffle.partitions") == dealt


def test_reached_vertices_stay(spark, no_broadcast):
    """A pass of the search moves the frontier and what it finds; neither steps nor what was reached before."""
    scratch = Scratch(spark)
    g = placement.place_graph(graph(spark, (1, 2), (2, 3)), scratch)
    level = lambda: scratch.place(g.nodes.select("vertex", "slots"), g.parts, "vertex")[0]
    text = executed(sssp._next(g, level(), [level(), level(), level()], 4))
    assert text.count("Exchange") == 2 and text.count("Bucketed: true") == 6


def root_executions(spark):
    """All queries and writes so far that ran anything; what they run inside counts with them."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    every = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {x.rootExecutionId() for x in (every.apply(i) for i in range(every.size())) if not x.jobs().isEmpty()}


def test_a_pass_is_one_job(spark):
    """Mass, changes and convergence come from the job that writes a pass."""
    e = graph(spark, (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (1, 6))
    before = root_executions(spark)
    pagerank.passes(e, iterations=2)
    middle = root_executions(spark)
    _, told = pagerank.passes(e, iterations=5)
    assert len(root_executions(spark) - middle) - len(middle - before) == 3
    assert len(told) == 6 and all(abs(p.mass - 1) < 1e-12 for p in told) and told[0].changed == 0 and told[1].changed > 0
    jobs = []
    for far in (graph(spark, (1, 2), (2, 3)), graph(spark, (1, 2), (2, 3), (3, 4), (4, 5))):
        before = root_executions(spark)
        assert sssp._reach(far, 1, 99).found == [1] * (far.count() + 1)
        jobs.append(len(root_executions(spark) - before))
    assert jobs[1] - jobs[0] <= 2 + 2  # two more passes, and the merges of small levels


def test_levels_are_merged(spark, monkeypatch):
    """A chain with ways back: merged tables hold all that was reached."""
    monkeypatch.setattr(sssp, "LEVELS", 2)
    e = graph(spark, *[(i, i + 1) for i in range(9)], *[(i, i - 3) for i in range(3, 9)])
    assert {r["vertex"]: r["distance"] for r in sssp.sssp_distance(e, 0).collect()} == {i: float(i) for i in range(10)}


def test_tolerance_ends_the_loop(spark):
    ranks, told = pagerank.passes(graph(spark, (1, 2), (2, 1)), iterations=50, tolerance=1e-9)
    assert len(told) == 2 and told[-1].most == 0 and {r["rank"] for r in ranks.collect()} == {0.5}


def test_hub_is_cut(spark, monkeypatch):
    """One vertex has half of all edges: no part of the placed edges is twice the median, and the ranks are as without a cut."""
    monkeypatch.setattr(scratch_tables, "LEAST_ROWS", 1000)
    e = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 5000).cast("bigint").alias("src"), F.expr("id div 2").alias("dst"))
    g = placement.place_graph(e, Scratch(spark))
    sizes = sorted(r["count"] for r in g.edges.groupBy(F.input_file_name()).count().collect())
    assert len(sizes) == g.parts == 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert g.nodes.filter("vertex = 7").first()["slots"] > g.parts
    cut = {r["vertex"]: r["rank"] for r in pagerank.pagerank(e, iterations=2).collect()}
    monkeypatch.setattr(placement, "piece_rows", lambda rows, parts: rows)
    whole = {r["vertex"]: r["rank"] for r in pagerank.pagerank(e, iterations=2).collect()}
    assert cut.keys() == whole.keys() and all(abs(cut[v] - whole[v]) < 1e-15 for v in cut)


def test_paths_of_a_long_chain(spark):
    """Pointers of a chain of 3000 vertices become paths in 12 steps."""
    n = 3000
    pointers = spark.range(n).select(F.col("id").alias("vertex"), F.col("id").alias("dist"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    before = root_executions(spark)
    got = sssp.paths(pointers, Scratch(spark))
    assert len(root_executions(spark) - before) == 1 + 12
    assert got.count() == n and got.filter(F.col("vertex") == 4).first()["path"] == "3,2,1,0"
    whole = got.filter(F.col("vertex") == n - 1).first()["path"]
    assert whole == ",".join(map(str, range(n - 2, -1, -1))) and {r["path"] for r in got.filter("dist < 2").collect()} == {"0"}


def test_files_and_command_line(spark, tmp_path, capsys):
    from orrery.__main__ import main

    points.write_centroids(spark, [7, 3, 5], str(tmp_path / "c"))
    points.write_counts(spark.createDataFrame([("u", 4)], "k string, n bigint"), str(tmp_path / "n"))
    assert points.read_centroids(spark, str(tmp_path / "c")) == [3, 5, 7] and [tuple(r) for r in points.read_counts(spark, str(tmp_path / "n")).collect()] == [("u", 4)]
    assert main([]) == main(["nothing", "x"]) == 2 and main(["kmeans_seeds", "/root/testdata/sf0.001"]) == 0
    assert len(capsys.readouterr().out.split()) == 4
    assert "Range" in sinks.lineage(spark.range(2)) and sinks.preview(spark.range(30))[:2] == ["(0)", "(1)"]


def test_passes_are_bounded_aloud(spark):
    with pytest.raises(RuntimeError):
        sssp.sssp_path(graph(spark, (1, 2), (2, 3), (3, 4)), 1, max_iter=2)
    assert kmeans.seeds(spark.createDataFrame([(5,)], "n bigint"), 3, "powers") == [1, 10, 100]


def test_hub_of_two_paths(spark):
    """A middle with 20,000 steps in and 20,000 out: no join key has more than a pair of blocks, and every path is there."""
    n, rows = 300, 64
    e = spark.range(n).select(F.col("id").alias("src"), F.lit(-1).cast("bigint").alias("dst")).union(spark.range(n).select(F.lit(-1).cast("bigint"), F.col("id") + 1000))
    e = e.union(graph(spark, (5, 6), (6, 7), (6, 7), (-1, -1)))
    left, right = joins._blocked(e, rows)
    for side in (left, right):
        assert side.groupBy("mid", "i", "j").count().agg(F.max("count")).first()[0] <= 2 * rows
    assert left.select("i", "j").distinct().count() == 25
    got = joins.two_paths(e, block_rows=rows)
    pairs = [(r["src"], r["dst"]) for r in e.collect()]
    by = {}
    for a, b in pairs:
        by.setdefault(a, []).append(b)
    want = Counter((a, c) for a, b in pairs for c in by.get(b, []))
    assert {(r["a"], r["c"]): r["n"] for r in got.collect()} == want


def test_two_paths_are_not_exchanged(spark, monkeypatch):
    """Steps and lists are dealt out, the paths summed where they are made; also over many parts and chunks, with hubs, repeats and names."""
    rnd = random.Random(3)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(900)] + [(7, i) for i in range(60)] + [(i, 7) for i in range(60)] + [(5, 6)] * 40
    by = {}
    for a, b in pairs:
        by.setdefault(a, []).append(b)
    want = Counter((a, c) for a, b in pairs for c in by.get(b, []))
    e = graph(spark, *pairs)
    assert "hashpartitioning(a" not in executed(joins.two_paths(e))
    for name, value in (("PART_PATHS", 500), ("LEAST_PATHS", 500), ("CHUNK_PATHS", 50)):
        monkeypatch.setattr(joins, name, value)
    for rows in (40, 4096):  # the hub's paths are exchanged, no source's are
        got = joins.two_paths(e, block_rows=rows)
        assert ("hashpartitioning(a" in executed(got)) == (rows == 40)
        assert {(r["a"], r["c"]): r["n"] for r in got.collect()} == want and got.count() == len(want)
    named = joins.two_paths(e.select(*[F.concat(F.lit("v"), c).alias(c) for c in ("src", "dst")]))
    assert {(r["a"], r["c"]): r["n"] for r in named.collect()} == {(f"v{a}", f"v{c}"): n for (a, c), n in want.items()}
    assert joins.two_paths(graph(spark, (1, 2), (3, 4))).collect() == []


def test_large_hub_is_never_one_task(spark):
    """10^5 steps in and 10^5 out: the heaviest pair of blocks stays small however large the hub is."""
    n = 100_000
    e = spark.range(n).select(F.col("id").alias("src"), F.lit(-1).cast("bigint").alias("dst")).union(spark.range(n).select(F.lit(-1).cast("bigint"), -F.col("id") - 2))
    left, right = joins._blocked(e, joins.BLOCK_ROWS)
    sizes = [s.groupBy("i", "j").count().agg(F.max("count"), F.count("*")).first() for s in (left, right)]
    assert all(most < 1.2 * joins.BLOCK_ROWS and blocks == 25 * 25 for most, blocks in sizes)


def test_replicated_beyond_the_broadcast(spark):
    """A hub graph with loops and repeats, and a side of its own: the filter and the ordered join count what the broadcast does."""
    rnd = random.Random(4)
    pairs = [(rnd.randrange(40), 20) for _ in range(90)] + [(20, rnd.randrange(40)) for _ in range(90)] + [(rnd.randrange(40), rnd.randrange(40)) for _ in range(250)]
    other = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(500)] + pairs[:100]
    for side in (None, other):
        have = set(other if side else pairs)
        want = sum(1 for a, b in pairs for x, v in have if x == b and v != a and (v, a) in have) // 3
        e, s = graph(spark, *pairs), graph(spark, *side) if side else None
        assert joins.triangle_count_replicated(e, s).first()["n"] == joins.triangle_count_replicated(e, s, broadcast_rows=0).first()["n"] == want
    keys = spark.range(1000)
    f = joins.Filter.of(F.col("id"), keys, 1000)
    assert f.holds(keys, F.col("id")).count() == 1000
    assert f.holds(spark.range(10_000, 30_000), F.col("id")).count() < 20_000 * 0.2


def test_many_centroids(spark):
    """10,000 centroids: the plan is no longer than with 3, and each value goes where a plain search sends it."""
    from orrery.functions.scalar import nearest

    rnd = random.Random(6)
    values = [rnd.randrange(-10, 200_000) for _ in range(400)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    for k in (1, 2, 3, 5, 17, 10_000):
        centres = [rnd.randrange(200_000) for _ in range(k)] * 2
        got = df.select("n", nearest(F.col("n"), centres).alias("c"))
        near = sorted(set(centres))
        assert [(r["n"], r["c"]) for r in got.collect()] == [(v, None if v is None else min(near, key=lambda c, v=v: (abs(v - c), c))) for v in values]
        assert plan(got).count("filter(") < 40


def test_loop_resumes(spark, tmp_path, monkeypatch):
    """A loop whose third pass fails goes on from the second, in another session, and counts and ranks as if it hadn't."""
    e = graph(spark, (1, 2), (2, 3), (3, 1), (3, 4), (1, 4), (5, 1))
    want, told = pagerank.passes(e, iterations=5, damping=0.85)
    home, whole, made = str(tmp_path / "loop"), pagerank._contributions, []

    def fails(g, ranks):
        made.append(1)
        if len(made) == 3:
            raise KeyboardInterrupt
        return whole(g, ranks)

    monkeypatch.setattr(pagerank, "_contributions", fails)
    with pytest.raises(KeyboardInterrupt):
        pagerank.passes(e, iterations=5, damping=0.85, resume=home)
    monkeypatch.setattr(pagerank, "place_graph", None)  # the graph isn't placed again
    got, again = pagerank.passes(spark.newSession().createDataFrame([], "src bigint, dst bigint"), iterations=5, damping=0.85, resume=home)
    assert len(made) == 3 + 3 and [p.mass for p in again] == pytest.approx([p.mass for p in told])
    assert {r["vertex"]: round(r["rank"], 12) for r in got.collect()} == {r["vertex"]: round(r["rank"], 12) for r in want.collect()}
    assert pagerank.passes(e, iterations=5, damping=0.85, resume=home)[0].count() == 5 and len(made) == 6
    with pytest.raises(ValueError, match="damping"):
        pagerank.passes(e, iterations=5, resume=home)


def test_node_records(spark, no_broadcast):
    """Records merge where they lie: only candidates are exchanged; blocks of any size give the same paths."""
    r, _ = records.node_records(graph(spark, (1, 2), (2, 3)), 1, Scratch(spark), 10)
    text = executed(records._merged(r, 1))
    assert text.count("Exchange") == 1 and text.count("Bucketed: true") == 1
    rnd = random.Random(8)
    pairs = [(7, i) for i in range(8, 300)] + [(rnd.randrange(300), rnd.randrange(300)) for _ in range(400)] + [(400, 400)]
    e = graph(spark, *pairs)
    want = {tuple(x) for x in sssp.sssp_path(e, 0).collect()}
    for rows in (16, 100_000):
        assert {tuple(x) for x in records.sssp_records(e, 0, block_rows=rows).collect()} == want
    assert max(len(x["adj"]) for x in aggregate.adjacency_blocks(e, 16).collect()) < 48
    assert [tuple(x) for x in records.sssp_records(e, 999).collect()] == [(999, 0, "999")]


def test_parts_follow_the_rows(spark):
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [scratch_tables.parts_for(spark, n) for n in (0, 60_000, 10_000_000, 2_000_000_000)] == [1, 2, dealt, 1000]
    with scratch_tables.dealt_into(spark, 600):  # the session's many parts don't multiply the sums of each
        assert [scratch_tables.parts_for(spark, n) for n in (1_000_000, 36_000_000, 216_000_000)] == [20, 64, 108]
