"""Near-duplicate documents by Order MinHash and banded alignment.

Texts are words (ASCII letters and digits and all other characters, lower-cased); their k-mers are runs
of five words, labelled with their occurrence number, so a k-mer occurs once.  A sketch takes, under one
hash order, the ``minima`` least labelled k-mers and keeps them in the order of the text: two texts agree
in it with high probability only if they share k-mers in the same order.  Equal sketches make candidates.

A candidate is verified by a banded alignment of both k-mer sequences.  As labelled k-mers occur once,
the longest common subsequence is the longest increasing one over their positions; matches off the
diagonal by more than the threshold allows cannot belong to an alignment that reaches it and are left
out first.  The similarity is common / (n1 + n2 - common) over the aligned k-mers; 0.8 links.  K-mers are
compared by 64-bit hashes of their words and number.

Scale: texts of equal words are one node from the start (a hash aggregate).  A bucket of equal sketches
never gives all pairs: each member is compared with the bucket's leader, the member that shares most
sketches with most texts, found by aggregates.  A member that the alignment parts from its leader is
compared with two more: the bucket's member of the least hash, and the one among its like in the finer
bucket of two equal sketches.  So a bucket of n members gives n pairs a leader.  Texts come to the pairs
that need them: they are found by row keys, broadcast if counted to at most BROADCAST_NODES, and a leader
with many pairs is dealt to as many tasks as it has runs of SPLIT pairs.

What sketches and leaders miss is found by an exact pass.  Two texts that reach the threshold share a k-mer
among the first n - ceil(0.8 n) + 1 of each in any fixed order of k-mers.  The order is by rough frequency
(over all rows, by shortened hashes; it only saves work, no result depends on it), and then by hash.  Buckets of
such k-mers whose members are all of one component are dropped by a window; in the others the members outside the
largest component meet all of other components that can still reach the threshold, by their sizes and the
number of k-mers left from the shared one on.  Pairs whose whole lists then share too little go, and the rest are
aligned.  So no link between two components is lost, and many variants of one text cost no pairs.  The pairs
grow with the square only of texts of different components that share their rarest k-mers.
Classes are the connected components, by minimum labels with pointer jumping.  Each phase's tables are
written to the shared folder and removed when no later phase reads them.

Defined results: null and empty texts have no words and are one class; texts of less than five words are
one k-mer, so they link only to equal words.  A null id belongs to its text's class, whose id is the least
that is not null.  Repeated rows get equal rows.  Empty tables give empty results; other columns, whatever
their names, pass.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import vectors as V
from orrery.plans.scratch import Scratch

K, MINIMA, TABLES, SIMILARITY = 5, 4, 24, 0.8
#: K-mers that a task counts at a time; the bits of a k-mer's hash when it is counted, of the table of counts, of a bucket.
COUNTED, HASH_BITS, COUNT_BITS, BUCKET_BITS = 4_000_000, 40, 22, 12
#: Nodes that are broadcast (a long key and two short columns) to find their texts; more are joined.
BROADCAST_NODES = 500_000
#: Pairs of one leader that one task aligns.
SPLIT = 1000
_SEED = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), np.int64).astype(V.U)


def plain_words(text: Column) -> Column:
    """The words of a text with a space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence numbers mixed in."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    run = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    nth = np.empty(len(h), np.int64)
    nth[order] = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    return V.mix(h + nth.astype(V.U) * V.U(0x9E3779B97F4A7C15))


def sketches(kmers: np.ndarray, minima: int = MINIMA, tables: int = TABLES) -> np.ndarray:
    """One key for each table from labelled k-mers in the order of the text."""
    a, b = (_SEED[:, :tables] | V.U(1))[:, :, None]
    m = min(minima, len(kmers))
    x = (kmers[None, :] ^ b) * a
    x ^= x >> V.U(29)
    at = np.argpartition(x, m - 1, axis=1)[:, :m] if m < len(kmers) else np.tile(np.arange(m), (tables, 1))
    at.sort(axis=1)
    out = np.zeros(tables, V.U)
    for j in range(m):
        out = out * V.U(V._BASE) + kmers[at[:, j]]
    return V.mix(out + V.U(m) + np.arange(tables, dtype=V.U) * V.U(V._INVERSE))


def rarest(kmers: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first labelled k-mers in the fixed order, so many that texts which reach least share one of them."""
    m = len(kmers) - int(np.ceil(least * len(kmers) - 1e-9)) + 1
    order = (counts[(kmers >> V.U(64 - COUNT_BITS)).astype(np.int64)].astype(V.U) << V.U(58)) | (kmers >> V.U(6))
    at = np.argpartition(order, m - 1)[:m] if m < len(kmers) else np.arange(len(kmers))
    return kmers[at[np.lexsort((kmers[at], order[at]))]]


def _texts_mers(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Labelled k-mers of each text of plain words."""
    raw, off = V.batch_texts(column)
    for i, j in V.chunks(off):
        part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, doc = V.words(part, o)
        h = V.span_hash(part, s, e)
        at = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            w = h[at[d] : at[d + 1]]
            yield labelled(V.windows(w, min(k, len(w)))) if len(w) else w


def _packed(batches: Iterator[pa.RecordBatch], k: int, most: int) -> Iterator[pa.RecordBatch]:
    """(bucket, h, c): of about ``most`` k-mers at a time the different ones and how often they occur, by the leading bits of their hashes."""
    held, n = [], 0

    def dealt() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held) >> V.U(64 - HASH_BITS), return_counts=True)
        first = np.searchsorted(h, np.arange((1 << BUCKET_BITS) + 1, dtype=V.U) << V.U(HASH_BITS - BUCKET_BITS))
        there = np.flatnonzero(first[1:] > first[:-1])
        at = pa.py_buffer((np.append(first[there], len(h)) * 4).astype(np.int32))
        low = h & V.U((1 << (HASH_BITS - BUCKET_BITS)) - 1)
        raw = [pa.Array.from_buffers(pa.binary(), len(there), [None, at, pa.py_buffer(x.astype(np.uint32))]) for x in (low, c)]
        return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *raw], names=["bucket", "h", "c"])

    for b in batches:
        for mers in _texts_mers(b.column(0), k):
            held.append(mers)
            n += len(mers)
        if n >= most:
            yield dealt()
            held, n = [], 0
    if n:
        yield dealt()


def _logs(bucket: pa.Table) -> pa.Table:
    """(bucket, logs) of all (bucket, h, c) of a bucket: for each of its spots a byte."""
    h, c = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in bucket.column(name)]) for name in ("h", "c"))
    by = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
    times, spots = np.add.reduceat(c[by].astype(np.int64), first), (h[by][first] >> np.uint32(HASH_BITS - COUNT_BITS)).astype(np.int64)
    out = np.zeros(1 << (COUNT_BITS - BUCKET_BITS), np.uint8)
    np.maximum.at(out, spots, np.log2(times).astype(np.uint8))
    return pa.table({"bucket": bucket.column("bucket").slice(0, 1), "logs": pa.array([out.tobytes()], pa.binary())})


def rough_counts(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """For each spot of the table the logarithm of the greatest count of a k-mer there, over all rows.

    K-mers are counted by HASH_BITS of their hashes, so that one moves four bytes; all of a bucket meet in one group, of which
    a table of bytes comes to the driver: 4 MB in all, whatever the input.
    """
    packed = docs.select(plain_words(F.col(f"`{text_col}`"))).mapInArrow(lambda it: _packed(it, k, COUNTED), "bucket int, h binary, c binary")
    got = packed.groupBy("bucket").applyInArrow(_logs, "bucket int, logs binary").toArrow()
    out = np.zeros((1 << BUCKET_BITS, 1 << (COUNT_BITS - BUCKET_BITS)), np.uint8)
    for bucket, logs in zip(got.column("bucket").to_pylist(), got.column("logs"), strict=True):
        out[bucket] = np.frombuffer(logs.as_buffer(), np.uint8)
    return out.ravel()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)), pa.array(flat))


def _sketch(batches: Iterator[pa.RecordBatch], k: int, minima: int, tables: int, counts: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # Few rows at a time: the lists of long texts add up.
        for i in range(0, b.num_rows, 500):
            x = b.slice(i, 500)
            none = np.zeros(0, V.U)
            mers = list(_texts_mers(x.column(3), k))
            keys = [sketches(m, minima, tables) if len(m) else none for m in mers]
            rare = [rarest(m, counts, least) if len(m) else none for m in mers]
            yield pa.RecordBatch.from_arrays([*x.columns[:3], pa.array([len(m) for m in mers], pa.int32()), _lists(keys), _lists(rare)], names=["id", "row", "sig", "n", "keys", "rare"])


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, by: np.ndarray | None = None) -> float:
    """Aligned k-mers / all k-mers of two labelled sequences; 0 if it can't reach least.  by: what sorts b."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    need = least / (1 + least) * (n + m)  # common k-mers at the threshold
    if min(n, m) < need - 1e-9:
        return 0.0
    by = np.argsort(b, kind="stable") if by is None else by
    at = by[np.minimum(np.searchsorted(b, a, sorter=by), m - 1)]
    # An alignment with that many matches leaves this many of each side out, hence the band.
    off = at - np.arange(n)
    at = at[(b[at] == a) & (off >= -(n - need + 1e-9)) & (off <= m - need + 1e-9)]
    if len(at) < need - 1e-9:
        return 0.0
    common = len(at)
    if not (at[1:] > at[:-1]).all():
        tails: list[int] = []
        for j in at.tolist():
            p = bisect_left(tails, j)
            if p == len(tails):
                tails.append(j)
            else:
                tails[p] = j
        common = len(tails)
    got = common / (n + m - common)
    return got if got >= least - 1e-12 else 0.0


def _verify(batches: Iterator[pa.RecordBatch], k: int, least: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            x = whole.slice(i, 500)
            last, by, ref, sims = None, None, None, []
            # The rows come by leader, whose k-mers are made once a run.
            ids = x.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            refs = _texts_mers(x.column(3).take(pa.array(starts)), k)
            for leader, mers in zip(ids.tolist(), _texts_mers(x.column(2), k), strict=True):
                if leader != last:
                    last, ref = leader, next(refs)
                    by = np.argsort(ref, kind="stable")
                sims.append(similarity(mers, ref, least, by))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])


def _checked(scratch: Scratch, pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, sim) of the different pairs that the alignment links."""
    parts = pairs.groupBy("b").agg(F.expr(f"(count(*) - 1) div {SPLIT} + 1").alias("parts"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    refs = parts.join(texts.select(F.col("nid").alias("b"), F.col("norm").alias("tb")), "b").select("b", "tb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    x = dealt.join(texts.select(F.col("nid").alias("a"), F.col("norm").alias("ta")), "a").join(refs, ["b", "part"]).select("a", "b", "ta", "tb")
    with V.small_batches(pairs.sparkSession):
        return scratch.keep(x.mapInArrow(lambda it: _verify(it, k, least), "a bigint, b bigint, sim double").filter(F.col("sim") >= least))


def _across(scratch: Scratch, nodes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b) of all nodes of different components that may reach least: nodes (nid, n, rare), roots (node, root)."""
    named = roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root")
    of = nodes.join(named, nodes["nid"] == named["node"], "left").select("nid", "n", F.coalesce("root", "nid").alias("root"), F.coalesce("size", F.lit(1)).alias("size"), F.posexplode("rare").alias("i", "h"))
    # A window rather than an aggregate and a join: the rows are dealt out once.
    same = Window.partitionBy("h")
    of = of.withColumns({"lo": F.min("root").over(same), "hi": F.max("root").over(same), "big": F.max(F.struct("size", "root")).over(same)})
    of = scratch.keep(of.filter("lo <> hi").select("nid", "n", "root", "i", "h", (F.col("root") == F.col("big.root")).alias("main")))
    scratch.settle()
    x, y = (of.select("h", *[F.col(c).alias(c + e) for c in ("nid", "n", "root", "i", "main")]) for e in "xy")
    need = F.lit(least / (1 + least)) * (F.col("nx") + F.col("ny")) - 1e-9
    # From the first k-mer that they share on, each still has as many as must be shared.
    may = (F.least("nx", "ny") >= least * F.greatest("nx", "ny")) & (F.col("nx") - F.col("ix") >= need) & (F.col("ny") - F.col("iy") >= need)
    # Members of a bucket's largest component only meet the others, so they are on one side alone.
    pairs = x.filter(~F.col("mainx")).join(y, "h").filter((F.col("mainy") | (F.col("nidx") < F.col("nidy"))) & (F.col("rootx") != F.col("rooty")) & may)
    pairs = scratch.keep(pairs.select(F.col("nidx").alias("a"), F.col("nidy").alias("b")).distinct())
    scratch.drop(of)
    lists = [nodes.select(F.col("nid").alias(c), F.col("n").alias("n" + e), F.col("rare").alias("rare" + e)) for c, e in ("ax", "by")]
    met = pairs.join(lists[0], "a").join(lists[1], "b")
    # Of the list that ends first in the order, all that is shared is shared with the other list; so beyond that,
    # they share at most what this text has outside its list.
    outside = F.greatest(*[F.ceil(least * F.col(n) - 1e-9) - 1 for n in ("nx", "ny")])
    out = scratch.keep(met.filter(F.size(F.array_intersect("rarex", "rarey")) + outside >= need).select("a", "b"))
    scratch.drop(pairs)
    return out


def _nodes(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, k: int, minima: int, tables: int, least: float) -> tuple[DataFrame, DataFrame]:
    """members (id, sig) of all rows; nodes (nid, sig, row, n, keys, rare, least, c): the different word sequences."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("row"), plain_words(text).alias("norm")).select("id", "row", F.unhex(F.md5("norm")).alias("sig"), "norm")
    with V.small_batches(docs.sparkSession):
        counts = docs.sparkSession.sparkContext.broadcast(rough_counts(docs, text_col, k))
    schema = f"id {dict(docs.dtypes)[id_col]}, row bigint, sig binary, n int, keys array<bigint>, rare array<bigint>"
    with V.small_batches(docs.sparkSession):
        sketched = scratch.keep(rows.mapInArrow(lambda it: _sketch(it, k, minima, tables, counts.value, least), schema))
    nodes = sketched.groupBy("sig").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "keys", "rare")], F.min("id").alias("least"), F.count("*").alias("c"))
    nodes = scratch.keep(nodes.withColumn("nid", F.monotonically_increasing_id()))  # fixed once it is written
    members = scratch.keep(sketched.select("id", "sig"))
    scratch.drop(sketched)
    return members, nodes


def _texts(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, part: DataFrame) -> DataFrame:
    """(nid, norm): the plain words of the nodes of part (nid, sig, row)."""
    part = scratch.keep(part)
    wanted = F.broadcast(part) if part.count() <= BROADCAST_NODES else part
    text = F.col(f"`{text_col}`")
    found = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("row"), text.alias("text")).join(wanted, "row")
    found = found.select("nid", "sig", plain_words(F.col("text")).alias("norm"))
    # Row keys may collide; the words must be the node's.  (A filter would be moved below and make the words twice.)
    out = scratch.keep(found.groupBy("nid").agg(F.max(F.when(F.unhex(F.md5("norm")).eqNullSafe(F.col("sig")), F.col("norm"))).alias("norm")))
    scratch.drop(part)
    return out


def links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, minima: int = MINIMA, tables: int = TABLES, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, nodes, links, roots): members (id, sig) of all rows, nodes (nid, sig, least, c), links (a, b, sim) of nids, roots (node, root) of the linked nodes.

    nodes: the different word sequences, with the least id and the number of their rows.
    """
    V.ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    members, nodes = _nodes(scratch, docs, id_col, text_col, k, minima, tables, similarity)
    scratch.settle()
    every = nodes.select("nid", "n", F.posexplode("keys").alias("t", "key"))
    shared = every.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    slots = scratch.keep(every.join(shared, "key"))
    # The leader is the member in the largest buckets over all tables: the text closest to the group's common form.
    weight = slots.groupBy("nid").agg(F.sum(F.log2("size")).alias("w"))
    lead = slots.join(weight, "nid").groupBy("key").agg(F.max(F.struct("w", "nid", "n")).alias("l"))
    near = F.least("n", "bn") >= similarity * F.greatest("n", "bn")  # a shorter text can't reach the threshold
    met = scratch.keep(slots.join(lead, "key").select(F.col("nid").alias("a"), "n", "t", "key", F.col("l.nid").alias("b"), F.col("l.n").alias("bn")).filter("a <> b"))
    first = scratch.keep(met.filter(near).select("a", "b").distinct())
    # Second leaders, for members that the alignment parts from the first.
    other = slots.groupBy("key").agg(F.min(F.struct(F.xxhash64("nid").alias("o"), "nid", "n")).alias("l"))
    other = scratch.keep(other.select("key", F.col("l.nid").alias("b2"), F.col("l.n").alias("bn2")))
    scratch.drop(slots)
    every = shared = slots = weight = lead = None
    scratch.settle()

    def texts_of(ids: DataFrame) -> DataFrame:
        """ids: one column of nids."""
        return _texts(scratch, docs, id_col, text_col, ids.toDF("nid").distinct().join(nodes.select("nid", "sig", "row"), "nid"))

    texts = texts_of(first.select("a").union(first.select("b")))
    ok = _checked(scratch, first, texts, k, similarity)
    scratch.settle()
    left = met.join(ok.select("a", "b"), ["a", "b"], "left_anti").select("a", "n", "t", "key")
    plain = left.join(other, "key").select("a", "n", F.col("b2").alias("b"), F.col("bn2").alias("bn"))
    # And leaders within buckets of two equal sketches, where texts that only share a passage seldom meet.
    keys = left.join(nodes.select(F.col("nid").alias("a"), "keys"), "a").select("a", "n", "key", F.get("keys", (F.col("t") + 1) % tables).alias("key2"))
    finer = keys.groupBy("key", "key2").agg(F.max(F.struct(F.xxhash64("a", F.lit(1)).alias("o"), F.col("a").alias("b"), F.col("n").alias("bn"))).alias("l"), F.count("*").alias("size")).filter("size > 1")
    finer = keys.join(finer.select("key", "key2", "l.b", "l.bn"), ["key", "key2"]).select("a", "n", "b", "bn")
    again = scratch.keep(plain.unionByName(finer).filter(near & (F.col("a") != F.col("b"))).select("a", "b").distinct().join(first, ["a", "b"], "left_anti"))
    scratch.drop(met, other)
    more = again.select("a").union(again.select("b")).toDF("nid").join(texts, "nid", "left_anti")
    texts2 = texts.unionByName(texts_of(more))
    ok2 = _checked(scratch, again, texts2, k, similarity)
    scratch.drop(first, again)
    plain = keys = finer = left = None
    scratch.settle()
    found = ok.unionByName(ok2)
    roots = components(found, scratch)
    # The exact pass: all other pairs between components.
    over = _across(scratch, nodes, roots, similarity)
    if not over.isEmpty():
        more = over.select("a").union(over.select("b")).toDF("nid").join(texts2, "nid", "left_anti")
        ok3 = _checked(scratch, over, texts2.unionByName(texts_of(more)), k, similarity)
        found = found.unionByName(ok3)
        to = [roots.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab"]
        joined = components(ok3.join(to[0], "a", "left").join(to[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), scratch)
        whole = roots.unionByName(joined.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("_r"))
        joined = joined.withColumnRenamed("node", "_n").withColumnRenamed("root", "_to")
        roots = scratch.keep(whole.join(joined, F.col("_r") == F.col("_n"), "left").select("node", F.coalesce("_to", "_r").alias("root")))
    scratch.settle()
    return members, nodes.select("nid", "sig", "least", "c"), found, roots


def components(edges: DataFrame, scratch: Scratch | None = None, max_passes: int = 10_000) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node of its component.

    Passes are about the logarithm of the longest path; the bound on them only ends a loop that a fault keeps going.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(max_passes):
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("m"))
        near = label.join(seen, label["node"] == seen["a"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        # Pointer jump: the label of the label.
        jump = label.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = scratch.keep(near.join(jump, near["root"] == jump["_n"], "left").select("node", "old", F.least("root", F.coalesce("_r", "root")).alias("root")))
        changed = not new.filter("old <> root").isEmpty()
        if not changed:
            scratch.drop(both)
            return new.select("node", "root")
        scratch.drop(label)
        label = new
    raise RuntimeError(f"components did not settle in {max_passes} passes")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, class_id (the least id of its class), class_size, n_texts (different in it)."""
    members, every, _, roots = links(docs, id_col=id_col, text_col=text_col, **how)
    scratch = Scratch(docs.sparkSession)
    linked = scratch.keep(every.join(roots, every["nid"] == roots["node"]).select("sig", "root", "least", "c"))
    # Written, so that the join below deals out both sides anew and one large class can be split.
    classes = scratch.keep(linked.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("c").alias("class_size"), F.count("*").alias("n_texts")))
    named = linked.select("sig", "root").join(classes, "root").select("sig", "class_id", "class_size", "n_texts")
    single = every.join(roots, every["nid"] == roots["node"], "left_anti").select("sig", F.col("least").alias("class_id"), F.col("c").alias("class_size"), F.lit(1).cast("bigint").alias("n_texts"))
    return members.join(named.unionByName(single), "sig").select(F.col("id").alias(id_col), "class_id", "class_size", "n_texts", F.lower(F.hex("sig")).alias("words_md5"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each class: the one with the least id.

    What goes is found by (id, words); a class whose documents repeat that pair keeps the repeats.
    """
    scratch = Scratch(docs.sparkSession)
    got = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    out = got.filter((F.col("class_size") > 1) & ~F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("gone"), F.col("words_md5").alias("sig"))
    out = scratch.keep(out.distinct())
    out = F.broadcast(out) if out.count() <= BROADCAST_NODES else out
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.md5(plain_words(F.col(f"`{text_col}`"))).alias("words"))
    return boxed.join(out, F.col("id").eqNullSafe(F.col("gone")) & (F.col("words") == F.col("sig")), "left_anti").select("row.*")
