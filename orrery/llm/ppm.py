"""Language-model scoring by prediction by partial matching over bytes.

Training counts, for every byte of the training texts and the end of each, the byte with its ORDER bytes
of context (texts begin with zero bytes; so does the end mark).  The counts of all shorter contexts follow
by summing, which gives the context trie.  A byte is predicted from the longest context that was seen:
with n symbols counted there, d of them different, a seen symbol has (c - 1/2) / n, and d / 2n is the
escape to the next shorter context, where the symbols just excluded take no part (full exclusion; symbols
of a context are symbols of all its suffixes, so one exclusion set a level is enough).  Below the empty
context, bytes that were never seen share what is left evenly.  The score is the log10 probability of
the text's bytes and its end; it depends on no other text scored.  ``adaptive_log10`` is the same model
learning as it goes, from an empty trie or none.

The base score is that of a unigram model with add-half smoothing over words.

Scale: training and scoring are passes of Arrow batches in bounded vectors.  Partial counts leave a task
merged, are summed by Spark, and cover all training texts.  The model is the whole trie at every size; where
it lies depends on its size.  The most frequent contexts, whose entries are counted to at most
``max_entries``, are broadcast (a suffix is at least as frequent, so they form a trie).  A gram whose context
is not among them meets the rest by a shuffle on its shortest context that isn't broadcast (in buckets by its
hash, packed): all training grams that end in this context are there, fewer than the least frequent broadcast
context has, and the levels below are broadcast.  That frequency, and so the largest group, grows with the corpus once
the broadcast is full.  Each document sends its distinct ones once.  Words are dealt with likewise: at most the COMMON
most frequent ones are broadcast, all others joined.  Words are counted by 64-bit hashes, which aren't compared: two of
n different words share one with a probability of about n^2 / 2^65.

Defined results: null is the empty text: its only token and symbol is the end.  Texts may hold zero bytes;
they are coded as symbol 0, like the end.  Without training rows every symbol has 1/256.  Repeated rows
get repeated rows; a null id is trained on like any other.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import vectors as V
from orrery.llm.toxicity import held_out
from orrery.plans.scratch import Scratch

ORDER, MAX_ENTRIES, COMMON, SYMBOLS = 5, 4_000_000, 65_536, 256
MERGE, BUCKET, RUN = 2_000_000, 200_000, 1 << 17
END_WORD = V.U(0xE0F)  # the hash that stands for the end token
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
GRAM, WORD = 0, 1


@dataclass(frozen=True)
class Trie:
    """Levels 0..order: for each, sorted (context, symbol) keys with counts, and sorted contexts.

    Of a context of level k: n and d, and n and d of its suffix at level k - 1 without its own symbols.
    """

    order: int
    keys: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    n: list[np.ndarray]
    d: list[np.ndarray]
    rest_n: list[np.ndarray]
    rest_d: list[np.ndarray]

    def values(self, k: int) -> tuple[np.ndarray, ...]:
        return self.n[k], self.d[k], self.rest_n[k], self.rest_d[k]


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    at = np.argsort(keys, kind="stable")
    k, c = keys[at], counts[at]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def _find(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_keys, x)
    if not len(sorted_keys):
        return at, np.zeros(len(x), bool)
    hit = at < len(sorted_keys)
    hit[hit] = sorted_keys[at[hit]] == x[hit]
    return at, hit


def _counts(tries: tuple[Trie, ...], k: int, keys: np.ndarray) -> np.ndarray:
    """The counts of keys of level k, 0 where none of the tries has one."""
    out = np.zeros(len(keys), np.int64)
    for t in tries:
        at, hit = _find(t.keys[k], keys)
        out[hit] = t.counts[k][at[hit]]
    return out


def _contexts(tries: tuple[Trie, ...], k: int, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, rows n, d, rest_n, rest_d) of contexts of level k; no two tries have the same context."""
    known, out = np.zeros(len(ctx), bool), np.zeros((4, len(ctx)), np.int64)
    for t in tries:
        at, hit = _find(t.contexts[k], ctx)
        known |= hit
        for row, values in zip(out, t.values(k), strict=True):
            row[hit] = values[at[hit]]
    return known, out


def low_bytes(x: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    return x & ((np.int64(1) << (8 * np.asarray(k, np.int64))) - 1)


def assemble(levels: list[tuple[np.ndarray, np.ndarray]], *base: Trie) -> Trie:
    """The trie of (sorted keys, counts) for each level; base holds the suffixes that levels lack."""
    t = Trie(len(levels) - 1, [], [], [], [], [], [], [])
    for k, (key, c) in enumerate(levels):
        ctx = key >> 8
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
        n = np.add.reduceat(c, first) if len(first) else c
        d = np.diff(np.append(first, len(ctx)))
        rest_n, rest_d = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        if k and len(first):
            _, up = _contexts((t, *base), k - 1, low_bytes(ctx[first], k - 1))
            rest_n = up[0] - np.add.reduceat(_counts((t, *base), k - 1, low_bytes(key, k)), first)
            rest_d = up[1] - d
        t.keys.append(key), t.contexts.append(ctx[first]), t.n.append(n), t.d.append(d), t.rest_n.append(rest_n), t.rest_d.append(rest_d)
        t.counts.append(c.astype(np.int32) if c.max(initial=0) < 2**31 else c)
    return t


def build(grams: np.ndarray, counts: np.ndarray, order: int) -> Trie:
    """The trie of the counted grams of order + 1 bytes (the symbol in the low byte)."""
    return assemble([_merge(low_bytes(grams, k + 1), counts) for k in range(order + 1)])


def log10_of(trie: Trie, grams: np.ndarray, *more: Trie) -> np.ndarray:
    """log10 probability of the last byte of each gram after the bytes before it; more: parts of the trie."""
    out = np.zeros(len(grams))
    live = np.arange(len(grams))
    # What the level above leaves of this one: all of it at first (-1), else the rest without exclusions.
    n_left, d_left = np.full(len(grams), -1, np.int64), np.zeros(len(grams), np.int64)
    for k in range(trie.order, -1, -1):
        if not len(live):
            return out
        g = low_bytes(grams[live], k + 1)
        known, (full_n, full_d, rest_n, rest_d) = _contexts((trie, *more), k, g >> 8)
        count = _counts((trie, *more), k, g)
        fresh = n_left[live] < 0
        n, d = np.where(fresh, full_n, n_left[live]), np.where(fresh, full_d, d_left[live])
        hit = known & (count > 0)
        out[live[hit]] += np.log10((2 * count[hit] - 1) / (2 * n[hit]))
        miss = known & ~hit & (d > 0)
        out[live[miss]] += np.log10(d[miss] / (2 * n[miss]))
        n_left[live[known]], d_left[live[known]] = rest_n[known], rest_d[known]
        live = live[~hit]
    seen = len(trie.keys[0])
    out[live] += -np.log10(max(SYMBOLS - seen, 1))
    return out


def open_at(trie: Trie, grams: np.ndarray) -> np.ndarray:
    """For each gram the key of its shortest context that trie lacks (length in the high byte), -1 if it has all."""
    level = np.zeros(len(grams), np.int64)
    live = np.arange(len(grams))
    for k in range(trie.order, -1, -1):
        _, known = _find(trie.contexts[k], low_bytes(grams[live] >> 8, k))
        level[live[known]] = k + 1
        live = live[~known]
    return np.where(level > trie.order, -1, low_bytes(grams >> 8, level) | level << 56)


def _grams(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, first position of each text): one gram a byte and one for the end of each text."""
    rows = len(off) - 1
    start = off[:-1] + np.arange(rows)
    text = np.zeros(len(raw) + rows, np.uint8)
    at = np.ones(len(text), bool)
    at[off[1:] + np.arange(rows)] = False
    text[at] = V.LOWER[raw]
    g = text.astype(np.int64)
    place = np.arange(len(text)) - np.repeat(start, np.diff(np.append(start, len(text))))
    for k in range(1, order + 1):
        prev = np.zeros(len(text), np.int64)
        prev[k:] = text[:-k]
        prev[place < k] = 0
        g |= prev << (8 * k)
    return g, start


def _tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the words, in order; the ends are not among them."""
    m = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1] | edge[1:-1]
    e[:-1] &= ~m[1:] | edge[1:-1]
    s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
    return V.span_hash(V.LOWER[raw], s, e).view(np.int64), np.searchsorted(off, s, "right") - 1


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Merged (kind, key, n) of a partition: memory is bounded by MERGE new keys, then they leave."""
    held: dict[int, list] = {GRAM: [], WORD: []}
    sizes = {GRAM: 0, WORD: 0}

    def give(kind: int) -> Iterator[pa.RecordBatch]:
        if held[kind]:
            k, c = _merge(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))
            held[kind], sizes[kind] = [], 0
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[i : i + 100_000]), kind, np.int8)), pa.array(k[i : i + 100_000]), pa.array(c[i : i + 100_000])], names=["kind", "key", "n"])

    for b in batches:
        raw, off = V.batch_texts(b.column(0))
        for i, j in V.chunks(off):
            part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
            ends = np.array([END_WORD], V.U).view(np.int64), np.array([j - i])
            words = np.unique(_tokens(part, o)[0], return_counts=True)
            for kind, got in ((GRAM, np.unique(_grams(part, o, order)[0], return_counts=True)), (WORD, words), (WORD, ends)):
                held[kind].append(got)
                sizes[kind] += len(got[0])
                if sizes[kind] > MERGE:
                    yield from give(kind)
    yield from give(GRAM)
    yield from give(WORD)


def count(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n): counts of all grams and words of a one-column DataFrame of texts."""
    V.ship(texts.sparkSession)
    part = texts.mapInArrow(lambda it: _count(it, order), "kind tinyint, key bigint, n bigint")
    return part.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def load(counts: DataFrame, order: int = ORDER, max_entries: int = MAX_ENTRIES, scratch: Scratch | None = None) -> tuple[Trie, int]:
    """The trie of the most frequent contexts on the driver (order 6 at most, by the width of the keys), and how many entries it lacks.

    A context comes with all its symbols.  Contexts are taken by classes of frequency (16 a doubling), of which
    a suffix has the same or a higher one, as long as their entries are at most max_entries; the empty one always is.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("tinyint").alias("k"), F.expr(f"key & {(1 << (8 * (k + 1))) - 1}L").alias("key")) for k in range(order + 1)]))
    rows = counts.filter(F.col("kind") == GRAM).select(each.alias("x"), "n").groupBy("x.k", "x.key").agg(F.sum("n").alias("n"))
    # A context has at most 256 symbols, so is what is gathered here.
    ctx = rows.groupBy("k", F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("key", "n")).alias("e"))
    scratch = scratch or Scratch(counts.sparkSession)
    ctx = scratch.keep(ctx.withColumn("band", F.when(F.col("k") == 0, 1 << 30).otherwise(F.floor(F.log2("total") * 16)).cast("int")))
    sizes = {r["band"]: r["n"] for r in ctx.groupBy("band").agg(F.sum(F.size("e")).alias("n")).collect()}
    first, held = 1 << 30, 0
    for band in sorted(sizes, reverse=True):
        if held + sizes[band] > max_entries and band < 1 << 30:
            break
        first, held = band, held + sizes[band]
    t = ctx.filter(F.col("band") >= first).select("k", F.explode("e").alias("x")).select("k", "x.key", "x.n").toArrow()
    scratch.drop(ctx)
    k, key, n = (t.column(c).to_numpy() for c in ("k", "key", "n"))
    return assemble([_merge(key[k == i], n[k == i]) for i in range(order + 1)]), sum(sizes.values()) - held


PACKED = "bucket bigint, rid array<bigint>, g array<bigint>, n array<bigint>"


def _pack(trie: Trie, buckets: int, g: np.ndarray, n: np.ndarray, rid: np.ndarray | None) -> pa.RecordBatch:
    """One row a bucket of PACKED of the grams whose contexts trie lacks; rid is null for training grams."""
    q = open_at(trie, g)
    bucket = (V.mix(q.view(V.U)) % V.U(buckets)).astype(np.int64)
    bucket[q < 0] = -1
    by = np.lexsort((g, bucket))
    by = by[np.searchsorted(bucket[by], 0) :]
    at = bucket[by]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    ends = pa.array(np.append(first, len(at)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[by])) for x in (g, n)]
    who = pa.nulls(len(first), pa.list_(pa.int64())) if rid is None else pa.ListArray.from_arrays(ends, pa.array(rid[by]))
    return pa.RecordBatch.from_arrays([pa.array(at[first]), who, *lists], names=["bucket", "rid", "g", "n"])


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Batches of narrow rows, put together up to about so many rows."""
    part: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        part.append(b)
        size += b.num_rows
        if size >= rows:
            yield pa.concat_batches(part)
            part, size = [], 0
    if part:
        yield pa.concat_batches(part)


def _rare(batches: Iterator[pa.RecordBatch], trie: Trie, buckets: int) -> Iterator[pa.RecordBatch]:
    """PACKED rows of counted grams (key, n)."""
    for b in _larger(batches):
        yield _pack(trie, buckets, b.column(0).to_numpy(), b.column(1).to_numpy(), None)


def _asks(batches: Iterator[pa.RecordBatch], trie: Trie, buckets: int) -> Iterator[pa.RecordBatch]:
    """PACKED rows of the open grams of documents (rid, grams, gtimes)."""
    for b in batches:
        many = np.diff(b.column(1).offsets.to_numpy())
        yield _pack(trie, buckets, b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy().astype(np.int64), np.repeat(b.column(0).to_numpy(), many))


def _resolve(batches: Iterator[pa.RecordBatch], trie: Trie, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """(rid, s) from PACKED rows sorted by bucket, each bucket's training grams first.

    What is held is the training grams of one bucket and about ``most`` grams to be scored.
    """
    bucket, part, size = -1, None, 0
    known: list[tuple] = []
    asked: list[tuple] = []

    def give() -> Iterator[pa.RecordBatch]:
        nonlocal part, size
        if asked:
            if part is None:
                g, n = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.int64),) * 2
                lowest = open_at(trie, g) >> 56
                part = assemble([_merge(low_bytes(g[lowest <= k], k + 1), n[lowest <= k]) for k in range(trie.order + 1)], trie)
            rid, g, n = (np.concatenate(x) for x in zip(*asked, strict=True))
            uniq, inv = np.unique(g, return_inverse=True)
            ids, at = np.unique(rid, return_inverse=True)
            s = np.bincount(at, n * log10_of(trie, uniq, part)[inv], len(ids))
            asked.clear()
            size = 0
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s)], names=["rid", "s"])

    for b in batches:
        for i, at in enumerate(b.column(0).to_pylist()):
            if at != bucket:
                yield from give()
                bucket, part = at, None
                known.clear()
            g, n = (b.column(c)[i].values.to_numpy() for c in (2, 3))
            if b.column(1)[i].is_valid:
                asked.append((b.column(1)[i].values.to_numpy(), g, n))
                size += len(g)
                if size >= most:
                    yield from give()
            else:
                known.append((g, n))
    yield from give()


def _of_each(values: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, times, how many of a text) of the distinct values of each text."""
    by = np.lexsort((values, doc))
    v, d = values[by], doc[by]
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])])) if len(v) else np.zeros(0, np.int64)
    return v[first], np.diff(np.append(first, len(v))), np.bincount(d[first], minlength=rows)


def _lists(parts: list[list[np.ndarray]]) -> tuple[pa.Array, pa.Array]:
    """Arrays of lists (value, times) from the results of _of_each for runs of texts."""
    v, times, many = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    ends = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(v)), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))


SCORED = "n_tokens bigint, known bigint, base double, score double, rest array<bigint>, times array<int>, grams array<bigint>, gtimes array<int>"


def _score(batches: Iterator[pa.RecordBatch], trie: Trie, whole: bool, common: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """id, flag, n_tokens, n_known, base (sum of log10(c + 0.5)) by common words; the other words; score; the open grams."""
    words, logs = common
    for b in batches:
        raw, off = V.batch_texts(b.column(2))
        n = len(off) - 1
        tokens, known, base, total = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        rest, grams = [], []
        for i, j in V.chunks(off):
            part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
            g, start = _grams(part, o, trie.order)
            uniq, inv = np.unique(g, return_inverse=True)
            logp = np.concatenate([log10_of(trie, uniq[x : x + RUN]) for x in range(0, len(uniq), RUN)])
            left = np.zeros(len(uniq), bool) if whole else open_at(trie, uniq) >= 0
            logp[left] = 0
            total[i:j] = np.add.reduceat(logp[inv], start)
            at = np.flatnonzero(left[inv])
            grams.append(_of_each(g[at], np.searchsorted(start, at, "right") - 1, j - i))
            h, doc = _tokens(part, o)
            tokens[i:j] += np.bincount(doc, minlength=j - i)
            at, hit = _find(words, h)
            known[i:j] += np.bincount(doc[hit], minlength=j - i)
            base[i:j] += np.bincount(doc[hit], logs[at[hit]], minlength=j - i)
            rest.append(_of_each(h[~hit], doc[~hit], j - i))
        columns = [b.column(0), b.column(1), *(pa.array(x) for x in (tokens, known, base, total)), *_lists(rest), *_lists(grams)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", *(c.split()[0] for c in SCORED.split(", "))])


def _open_scores(got: DataFrame, counts: DataFrame, shared, rare: int) -> DataFrame:
    """(rid, s): summed log10 probabilities of the grams that the broadcast trie leaves open.

    rare: the entries that are not broadcast, dealt to buckets of about BUCKET.
    """
    buckets = max(256, rare // BUCKET)
    known = counts.filter(F.col("kind") == GRAM).select("key", "n").mapInArrow(lambda it: _rare(it, shared.value[0], buckets), PACKED)
    asks = got.select("rid", "grams", "gtimes").mapInArrow(lambda it: _asks(it, shared.value[0], buckets), PACKED)
    rows = known.unionByName(asks).repartition("bucket").sortWithinPartitions("bucket", F.col("rid").isNotNull())
    return rows.mapInArrow(lambda it: _resolve(it, shared.value[0]), "rid bigint, s double")


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, max_entries: int = MAX_ENTRIES, common: int = COMMON) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the rows that are not held out (crc32 of the id as text modulo 5 is 1).
    """
    spark = docs.sparkSession
    out = held_out(id_col, 5)
    scratch = Scratch(spark)
    with V.small_batches(spark):
        counts = scratch.keep(count(docs.filter(~out).select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), order))
    trie, rare = load(counts, order, max_entries, scratch)
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = int(sums[0]), int(sums[1])
    end = int(np.array([END_WORD], V.U).view(np.int64)[0])
    # The common words are those of the highest classes of frequency (16 a doubling) that hold at most
    # ``common`` words together; a sort would bring that many from each task together.
    words = words.withColumn("band", F.floor(F.log2("n") * 16))
    first, held = 1 << 30, 0
    for r in sorted(words.filter(F.col("key") != end).groupBy("band").count().collect(), key=lambda r: -r["band"]):
        held += r["count"]
        if held > common:
            break
        first = r["band"]
    top = words.filter((F.col("key") != end) & (F.col("band") >= first)).select("key", "n").toArrow()
    by = np.argsort(top.column("key").to_numpy())
    keys, logs = top.column("key").to_numpy()[by], np.log10(top.column("n").to_numpy()[by] + 0.5)
    ends = words.filter(F.col("key") == end).first()
    shared = spark.sparkContext.broadcast((trie, not rare, (keys, logs)))
    name = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), out.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    got = rows.mapInArrow(lambda it: _score(it, *shared.value), f"id {name}, held_out boolean, {SCORED}")
    with V.small_batches(spark):
        got = scratch.keep(got.withColumn("rid", F.monotonically_increasing_id()))  # fixed once it is written
    tail = got.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("rid", F.col("x.rest").alias("key"), F.col("x.times").alias("m"))
    seen = words.filter(F.col("band") < first).select("key", "n")
    found = tail.join(seen, "key", "left").select("rid", F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0).alias("k2"), (F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("b2"), F.lit(0.0).alias("s2"))
    if rare:
        found = found.unionByName(_open_scores(got, counts, shared, rare).select("rid", F.lit(0).alias("k2"), F.lit(0.0).alias("b2"), F.col("s").alias("s2")))
    found = found.groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("k2", "b2", "s2")])
    end_n = int(ends["n"]) if ends else 0
    all_ = got.select("rid", "id", "held_out", "n_tokens", "known", "base", "score").join(found, "rid", "left")
    total = F.col("base") + F.coalesce("b2", F.lit(0.0)) + F.lit(float(np.log10(end_n + 0.5)))
    norm = float(np.log10(n + 0.5 * (v + 1)))
    return all_.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("k2", F.lit(0)) + F.lit(int(end_n > 0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), (total - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"))


def adaptive_log10(texts: list[bytes], order: int = ORDER, trained: list[bytes] = ()) -> list[float]:
    """log10 probability of each text by the same model, learning each byte after coding it.

    A plain trie of dictionaries: for single streams, and the check of the vectors above.
    """
    trie: dict[bytes, dict[int, int]] = {}

    def learn(ctx: bytes, s: int) -> None:
        for k in range(order + 1):
            node = trie.setdefault(ctx[len(ctx) - k :], {})
            node[s] = node.get(s, 0) + 1

    def code(ctx: bytes, s: int) -> float:
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            node = trie.get(ctx[len(ctx) - k :])
            if not node:
                continue
            left = {x: c for x, c in node.items() if x not in gone}
            n, d = sum(left.values()), len(left)
            if s in left:
                return out + float(np.log10((2 * left[s] - 1) / (2 * n)))
            if d:
                out += float(np.log10(d / (2 * n)))
            gone = set(node)
        return out - float(np.log10(max(SYMBOLS - len(gone), 1)))

    def run(text: bytes, coding: bool, learning: bool) -> float:
        total, data = 0.0, bytes(order) + text + b"\0"
        for i in range(order, len(data)):
            ctx = data[i - order : i]
            if coding:
                total += code(ctx, data[i])
            if learning:
                learn(ctx, data[i])
        return total

    for t in trained:
        run(t, False, True)
    return [run(t, True, not trained) for t in texts]
