"""Two-paths and directed triangles (JOIN1-JOIN3, SRC5, AGG14, AGG15)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.fixpoint import cut
from orrery.plans.scratch import Scratch
from orrery.sources.edges import cap_ids

#: In-edges and out-edges of a block of a heavy middle vertex, at most about: a pair of blocks is a task's share.
BLOCK_ROWS = 4096
#: Two-paths of a part of sources, at most and at least about, and those that are summed up at once.
PART_PATHS, LEAST_PATHS, CHUNK_PATHS = 32_000_000, 1_000_000, 1_000_000


def _weighted(edges: DataFrame) -> DataFrame:
    """Distinct edges with their multiplicity: bag joins run on the distinct ones."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("w"))


def _blocked(edges: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(a, mid, i, j, w1) and (mid, i, j, c, w2): the steps into and out of each middle, a row for each pair of blocks.

    The list into a middle and the one out of it are cut by hashes into blocks of about block_rows; each pair of blocks is a
    join key of its own, so a hub's two-paths are spread over (in / block_rows) x (out / block_rows) keys.  A step is
    repeated only as often as its partner's side has blocks: once wherever that side is no hub's.
    """
    e = cut(_weighted(edges))
    blocks = lambda n: F.greatest(F.ceil(F.coalesce(n, F.lit(0)) / block_rows), F.lit(1)).cast("int")
    into = e.groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("n_in"))
    out = e.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("n_out"))
    # Only middles with a step in and a step out have two-paths.
    mids = cut(into.join(out, "mid").select("mid", blocks(F.col("n_in")).alias("bi"), blocks(F.col("n_out")).alias("bo")))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = e.join(mids, e["dst"] == mids["mid"]).select(F.col("src").alias("a"), "mid", own("src", "bi").alias("i"), every("bo").alias("j"), F.col("w").alias("w1"))
    right = e.join(mids, e["src"] == mids["mid"]).select("mid", every("bi").alias("i"), own("dst", "bo").alias("j"), F.col("dst").alias("c"), F.col("w").alias("w2"))
    return left, right


def _summed(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a part (kind, a, nid, w, cs, ws), first all lists of its middles (kind 0), then its first steps by a (kind 1): (a, c, n).

    About ``chunk`` paths are held at once, and those of the source that ends them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, steps, held, known = [], [], 0, None

        def closed() -> tuple:
            """The lists in the order of nids, targets by their place among the different ones."""
            nid = np.concatenate([x.column("nid").to_numpy() for x in lists]) if lists else np.zeros(0, np.int64)
            size = np.concatenate([x.column("cs").value_lengths().to_numpy() for x in lists]) if lists else np.zeros(0, np.int64)
            by = np.argsort(nid, kind="stable")
            targets = pa.chunked_array([x.column("cs").flatten() for x in lists], type=kind_of_c).combine_chunks().dictionary_encode(null_encoding="encode")
            ws = np.concatenate([x.column("ws").flatten().to_numpy() for x in lists]) if lists else np.zeros(0, np.int64)
            lists.clear()
            # A middle's list comes in blocks: each is a row here, those of a middle lie together.
            start = (np.cumsum(size) - size)[by]
            first = np.flatnonzero(np.concatenate([[True], nid[by][1:] != nid[by][:-1]])) if len(nid) else np.zeros(0, np.int64)
            return nid[by][first], np.append(first, len(nid)), start, size[by].astype(np.int64), targets.indices.to_numpy().astype(np.int64), None if (ws == 1).all() else ws, targets.dictionary

        def spread(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For ranges from starts: the number of the range and the place, of each member."""
            of = np.repeat(np.arange(len(counts)), counts)
            return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of]

        def paths(nid: np.ndarray) -> np.ndarray:
            """How many paths each step begins."""
            nids, first, _, size, *_ = known
            total = np.append(0, np.cumsum(size))
            at = np.minimum(np.searchsorted(nids, nid), len(nids) - 1)
            return np.where(nids[at] == nid, total[first[at + 1]] - total[first[at]], 0) if len(nids) else np.zeros(len(nid), np.int64)

        def ended(whole: bool) -> Iterator[pa.RecordBatch]:
            """Sums of all sources whose steps are there: all but the last one's, or all."""
            x = pa.Table.from_batches(steps).combine_chunks().to_batches()[0]
            sources = x.column("a").dictionary_encode(null_encoding="encode")
            a = sources.indices.to_numpy()
            end = len(a) if whole else int(np.flatnonzero(a != a[-1])[-1:].sum() + 1) if (a != a[-1]).any() else 0
            steps[:] = [x.slice(end)] if end < len(a) else []
            nid, w = x.column("nid").to_numpy()[:end], x.column("w").to_numpy()[:end]
            size = paths(nid)
            a, nid, w, size = (y[size > 0] for y in (a[:end], nid, w, size))
            nids, first, start, sizes, codes, ws, names = known
            # Runs of whole sources of about chunk paths each.
            run_of = (np.cumsum(size) - size) // chunk
            head = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
            run_of = run_of[head][np.cumsum(head) - 1] if len(a) else run_of
            edges = np.append(np.flatnonzero(np.concatenate([[True], run_of[1:] != run_of[:-1]])) if len(a) else [], len(a)).astype(np.int64)
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                at = np.searchsorted(nids, nid[i:j])
                step, block = spread(first[at + 1] - first[at], first[at])
                of, place = spread(sizes[block], start[block])
                of = step[of]
                key = a[i:j][of].astype(np.int64) * len(names) + codes[place]
                n = w[i:j][of] if ws is None else w[i:j][of] * ws[place]
                if n.sum() <= 2 * len(n):  # nearly all once: repeats are written out, so that only keys are sorted
                    key = np.repeat(key, n)
                    key.sort()
                    cut_at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    n = np.diff(np.append(cut_at, len(key)))
                else:
                    by = np.argsort(key, kind="stable")
                    key = key[by]
                    cut_at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    n = np.add.reduceat(n[by], cut_at)
                key = key[cut_at]
                for k in range(0, len(key), 100_000):
                    part = key[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([sources.dictionary.take(pa.array(part // len(names))), names.take(pa.array(part % len(names))), pa.array(n[k : k + 100_000])], names=["a", "c", "n"])

        for b in batches:
            kind_of_c = b.schema.field("cs").type.value_type
            n0 = int((b.column("kind").to_numpy() == 0).sum())
            if n0:
                lists.append(b.slice(0, n0).select(["nid", "cs", "ws"]))
            if n0 < b.num_rows:
                known = closed() if known is None else known
                steps.append(b.slice(n0).select(["a", "nid", "w"]))
                held += int(paths(steps[-1].column("nid").to_numpy()).sum())
                if held >= chunk:
                    yield from ended(False)
                    held = int(sum(paths(x.column("nid").to_numpy()).sum() for x in steps))
        if steps:
            yield from ended(True)

    return run


def two_paths(edges: DataFrame, *, max_id: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Two-paths a -> mid -> c with bag semantics: one row a distinct (a, c), n of them in the bag.

    The sources are dealt into parts of about PART_PATHS paths.  A part gets its sources' steps and, once, the list of
    each middle that they reach, and sums up its paths where they are made: paths aren't exchanged, and what is grows with
    the edges and at most with the lists times the parts.  A source of more than block_rows ** 2 / 8 paths is no part's:
    there blocks of the steps into a middle and out of it meet in pairs, each of at most about block_rows x block_rows
    paths, summed by (a, c) before they are exchanged.
    """
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession)
    e = scratch.keep(_weighted(cap_ids(edges, max_id)))
    out = e.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("o"))
    # Only middles with a step in and a step out have two-paths; they get numbers.
    mids = scratch.keep(e.select(F.col("dst").alias("mid")).distinct().join(out, "mid").withColumn("nid", F.monotonically_increasing_id()))
    left = e.join(mids, e["dst"] == mids["mid"]).select(F.col("src").alias("a"), "nid", "w", "o")
    left, seen = scratch.counted(left, F.sum("o").alias("paths"))
    most = max(1, block_rows * block_rows // 8)
    heavy, hubs = scratch.counted(left.groupBy("a").agg(F.sum("o").alias("paths")).filter(F.col("paths") > most).select("a"), F.count(F.lit(1)).alias("n"))
    if hubs["n"]:
        left = left.join(heavy, "a", "left_anti")
    paths, dealt = int(seen["paths"] or 0), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(dealt, -(-paths // LEAST_PATHS)), -(-paths // PART_PATHS))
    steps = left.select(F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int").alias("part"), "a", "nid", "w")
    blocks = e.join(mids, e["src"] == mids["mid"]).select("nid", F.pmod(F.xxhash64("dst"), F.ceil(F.col("o") / block_rows)).alias("block"), F.struct(F.col("dst").alias("c"), "w").alias("s"))
    blocks = scratch.keep(blocks.groupBy("nid", "block").agg(F.sort_array(F.collect_list("s")).alias("s")).select("nid", F.col("s.c").alias("cs"), F.col("s.w").alias("ws")))
    lists = blocks.join(steps.select("nid", "part").distinct(), "nid")
    kinds = dict(e.dtypes)
    # Something in each column rather than nulls: Spark's Arrow writer goes over a run of null lists or strings for every row.
    none = [F.array().cast(dict(lists.dtypes)[c]).alias(c) for c in ("cs", "ws")]
    both = lists.select("part", F.lit(0).alias("kind"), F.lit("0").try_cast(kinds["src"]).alias("a"), "nid", F.lit(0).cast("bigint").alias("w"), "cs", "ws")
    both = both.unionByName(steps.select("part", F.lit(1).alias("kind"), "a", "nid", "w", *none))
    got = both.repartitionById(parts, F.col("part")).sortWithinPartitions("kind", "a").drop("part").mapInArrow(_summed(CHUNK_PATHS), f"a {kinds['src']}, c {kinds['dst']}, n bigint")
    if hubs["n"]:
        left, right = _blocked(cap_ids(edges, max_id), block_rows)
        got = got.unionByName(left.join(heavy, "a", "left_semi").join(right, ["mid", "i", "j"]).groupBy("a", "c").agg(F.sum(F.col("w1") * F.col("w2")).alias("n")))
    return got


def closed_walks3(edges: DataFrame, *, max_id: int | None = None) -> DataFrame:
    """Closed walks of three edges, each (2-path, closing edge) one; repeats and loops count.  One row n.

    A walk over three vertices is a directed triangle begun at any of them; one over two goes a loop and an edge
    to and fro, begun at any of the three steps; one over a single vertex goes its loop three times.
    """
    e = cut(_weighted(cap_ids(edges, max_id)))
    loops = e.filter("src = dst").select(F.col("src").alias("v"), F.col("w").alias("wl"))
    flat = e.filter("src <> dst")
    there = flat.join(loops, flat["src"] == loops["v"]).select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") * F.col("wl")).alias("w1"))
    back = flat.select(F.col("src").alias("b"), F.col("dst").alias("a"), F.col("w").alias("w2"))
    parts = [_cycles(flat).select(F.expr("3 * w").alias("n")), there.join(back, ["a", "b"]).select(F.expr("3 * w1 * w2").alias("n")), loops.select(F.expr("wl * wl * wl").alias("n"))]
    sums = [p.agg(F.sum("n").alias("n")) for p in parts]
    return sums[0].unionByName(sums[1]).unionByName(sums[2]).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))


def simple_edges(edges: DataFrame, *, max_id: int | None = None) -> DataFrame:
    """Distinct edges without loops."""
    return cap_ids(edges, max_id).filter("src <> dst").distinct()


def _by_degree(e: DataFrame) -> DataFrame:
    """e (src, dst, w, ...) with up: if src comes before dst in the order of (degree, id), degree counting both ways."""
    deg = e.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    x = e.join(deg.select(F.col("v").alias("src"), F.col("d").alias("ds")), "src")
    x = x.join(deg.select(F.col("v").alias("dst"), F.col("d").alias("dd")), "dst")
    return x.select(*e.columns, ((F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))).alias("up"))


def _cycles(e: DataFrame, hint: str | None = None, *, product: str | None = "w1 * w2 * w3") -> DataFrame:
    """(x, y, z, w): each directed cycle x -> y -> z -> x of different edges (src, dst, w) without loops once; w: the product.

    product None: the edges' own w1, w2, w3 instead.

    Each is found at its vertex of the least (degree, id): there the edge in and the edge out both go to greater
    vertices, of which even a hub has few, so its two-paths don't multiply; the third edge closes it.
    """
    e = cut(_by_degree(e))
    out = e.filter("up").select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("w").alias("w1"))
    into = e.filter("NOT up").select(F.col("dst").alias("x"), F.col("src").alias("z"), F.col("w").alias("w3"))
    close = e.select(F.col("src").alias("y"), F.col("dst").alias("z"), F.col("w").alias("w2"))
    if hint:
        into, close = into.hint(hint), close.hint(hint)
    return out.join(into, "x").filter("y <> z").join(close, ["y", "z"]).select("x", "y", "z", *(["w1", "w2", "w3"] if product is None else [F.expr(product).alias("w")]))


def triangle_list(edges: DataFrame, *, max_id: int | None = None, hint: str | None = None) -> DataFrame:
    """Directed 3-cycles a -> b -> c -> a, each once: a is its least vertex.

    hint sets the strategy of the closing joins ('merge', 'shuffle_hash', 'broadcast'); by default Catalyst and AQE choose.
    """
    found = _cycles(simple_edges(edges, max_id=max_id).withColumn("w", F.lit(1)), hint)
    # x -> y -> z -> x, turned until the least vertex comes first.
    a = F.least("x", "y", "z")
    turn = lambda p, q, r: F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(r).alias("c"))
    turned = F.when(a == F.col("x"), turn("x", "y", "z")).when(a == F.col("y"), turn("y", "z", "x")).otherwise(turn("z", "x", "y"))
    return found.select(turned.alias("t")).select("t.a", "t.b", "t.c")


def triangle_count(edges: DataFrame, *, max_id: int | None = None, hint: str | None = None) -> DataFrame:
    """Number of directed 3-cycles of the simple graph; one row n, 0 if there is none."""
    return triangle_list(edges, max_id=max_id, hint=hint).agg(F.count("*").alias("n"))


def triangle_count_replicated(edges: DataFrame, side: DataFrame | None = None, *, max_id: int | None = None, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Map-side form: probe edges keep repeats, the replicated side has none; matches div 3.

    side: the edges that are replicated, read from a file of their own (the probe's if None).  They are broadcast
    only if their counted size is at most broadcast_rows; beyond, ``_replicated_beyond`` ships a filter instead.
    """
    scratch = Scratch(edges.sparkSession)
    probe, own = _weighted(cap_ids(edges, max_id)), side is None
    side = probe.select("src", "dst") if own else cap_ids(side, max_id).select("src", "dst").distinct()
    side, seen = scratch.counted(side, F.count(F.lit(1)).alias("n"))
    if seen["n"] > broadcast_rows:
        return _replicated_beyond(probe, side, seen["n"])
    ab = probe.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w")
    bv = side.select(F.col("src").alias("b"), F.col("dst").alias("v"))
    va = side.select(F.col("src").alias("v"), F.col("dst").alias("a"))
    hits = ab.join(F.broadcast(bv), "b").filter("v <> a").join(F.broadcast(va), ["v", "a"])
    return hits.agg(F.expr("coalesce(sum(w), 0) div 3").alias("n"))


#: Bits a key, and at most, of the filter that is shipped where the side is too large: up to 32 MB, whatever the side holds.
KEY_BITS, MOST_BITS = 8, 1 << 28


@dataclass
class Filter:
    """A set of keys as a bitmap of their hashes in rows (part, bits): it misses no key, and lets few others through."""

    rows: DataFrame
    bits: int

    @staticmethod
    def of(keys: Column, table: DataFrame, n: int) -> Filter:
        """The filter of a column of table, for about n keys."""
        bits = min(MOST_BITS, 1 << max(15, (n * KEY_BITS - 1).bit_length()))
        h = F.pmod(F.xxhash64(keys), F.lit(bits)) + 1
        rows = table.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))
        return Filter(cut(rows), bits)

    def holds(self, df: DataFrame, key: Column) -> DataFrame:
        """The rows of df whose key may be in the set; the bitmap is broadcast, so df isn't moved."""
        h = F.pmod(F.xxhash64(key), F.lit(self.bits)) + 1
        at = df.select("*", F.bitmap_bucket_number(h).alias("_part"), F.bitmap_bit_position(h).alias("_at")).join(F.broadcast(self.rows), "_part")
        byte = "CAST(conv(hex(substring(_bits, CAST(_at div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
        return at.filter(F.expr(f"shiftright({byte}, CAST(_at % 8 AS INT)) & 1 = 1")).select(*df.columns)


def _replicated_beyond(probe: DataFrame, side: DataFrame, n: int) -> DataFrame:
    """The same count where the side can't be replicated: its filter is, and what passes is joined in the order of degrees.

    A match is a directed cycle with one edge of the probe and two of the side.  Over three vertices it is found once, at
    the vertex of the least degree, so a hub's edges don't multiply; each of its edges may be the probe's.  Over two, the
    probe's edge is a loop, or the side has a loop at its end.
    """
    src, dst = F.col("src"), F.col("dst")
    starts, ends = Filter.of(src, side, n), Filter.of(dst, side, n)
    # The side must go on from the probe's end and come back to its start; its own edges must go on or come from somewhere.
    probe = cut(ends.holds(starts.holds(probe, dst), src))
    side = cut(starts.holds(side, dst).unionByName(ends.holds(side, src)).distinct())
    both = probe.select("src", "dst", F.col("w").alias("p"), F.lit(0).cast("bigint").alias("s")).unionByName(side.select("src", "dst", F.lit(0).cast("bigint").alias("p"), F.lit(1).cast("bigint").alias("s")))
    e = cut(both.groupBy("src", "dst").agg(F.sum("p").alias("p"), F.sum("s").alias("s")))
    found = _cycles(e.filter("src <> dst").select("src", "dst", F.struct("p", "s").alias("w")), product=None)
    three = found.select(F.expr("w1.p * w2.s * w3.s + w1.s * w2.p * w3.s + w1.s * w2.s * w3.p").alias("n"))
    loops = e.filter("src = dst").select(F.col("src").alias("v"), F.col("p").alias("lp"), F.col("s").alias("ls"))
    flat = e.filter("src <> dst")
    back = flat.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("p").alias("p2"), F.col("s").alias("s2"))
    # A loop of the probe at a, then a -> v -> a; a -> b of the probe, then the side's loop at b and b -> a.
    two = flat.join(back, ["src", "dst"]).join(loops, F.col("src") == F.col("v")).select(F.expr("lp * s * s2 + p2 * ls * s").alias("n"))
    return three.unionByName(two).agg(F.expr("coalesce(sum(n), 0) div 3").alias("n"))
