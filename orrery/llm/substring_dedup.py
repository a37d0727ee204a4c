"""Repeated substrings: bytes covered by a string of MIN_BYTES bytes that also starts in a document with a smaller id.

Method: threshold-bounded interval expansion on Burrows-Wheeler transforms.  Intervals of suffixes with a common
prefix are extended backward, all of one length before any of the next, so boundaries between neighbouring suffixes
come by rising common-prefix length; expansion stops at the least length that counts.  What lies between two
boundaries then is one string of that length with all its places, and the least id there decides for each of them.

Spark's part is that every transform stays small.  Each window of MIN_BYTES bytes is filed under the least hash of its
k-mers, so equal windows meet under one key wherever they are; neighbouring windows under one key make a segment.

1. ``chunks``: documents in rows of about CHUNK bytes, written once.
2. Keys of a chunk, once each, go to buckets of keys; keys of one document only are dropped there (a segment none of
   whose windows can be elsewhere), and the others are sent back to the chunks that asked.
3. A chunk's segments under such keys, equal ones once with the least and greatest id, go to buckets of segments; their
   places go past these, under a key of the chunk's own.
   A key with more than HEAVY segments is cut into single windows, filed by their own hash, so that a passage that
   very many documents continue differently isn't one bucket.
4. Each bucket builds transforms of some TRANSFORM bytes and sends the least ids of its windows back.
5. A chunk unites the covered bytes and gives out its documents.

Nothing is collected; a key or segment reaches a bucket once per chunk at most, however many documents hold it.  Keys
with chance collisions only cost work: equality is decided by the transform over the bytes.

Defined results: a null text is empty; texts under MIN_BYTES lose nothing; ids are integers (cast to bigint), a null id
counts as the greatest bigint; rows of equal ids are never smaller than one another, so repeated rows lose the same
bytes; a string repeated within one document only stays; an empty table gives an empty one; other columns aren't read.
A document is one row and is held whole in one task with its chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.vectors import batch_texts, ship, small_batches
from orrery.plans.scratch import Scratch

U = np.uint64
MIN_BYTES = 50
#: Bytes of documents in a chunk, of a bucket's share of the input, and of one transform, about.
CHUNK, BUCKET, TRANSFORM = 8 << 20, 8 << 20, 1 << 20
#: Segments of one key, beyond which it is cut into windows.
HEAVY = 10_000
#: Windows of a segment at most: longer runs under one key (periodic texts) are cut.
MOST_WINDOWS = 512
#: The id of rows without one.
LAST = np.iinfo(np.int64).max

_SLICE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, U)

CHUNKS = "c bigint, size bigint, ids binary, nulls binary, off binary, body binary"
ASKS = "a bigint, c bigint, keys binary, counts binary"
SHARED = "c bigint, keys binary, heavy binary"
PLACES = "doc binary, start binary, seg binary, h_seg binary, h_at binary, h_entry binary"
PIECES = f"b bigint, c bigint, entry binary, key binary, size binary, low binary, more binary, body binary, {PLACES}"
LEAST = f"c bigint, entry binary, first binary, last binary, low binary, {PLACES}"
OUT = "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _arr(x, kind) -> np.ndarray:
    return np.frombuffer(x, kind)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    """The blobs of a column, one after the other."""
    return np.concatenate([np.zeros(0, kind), *(_arr(x, kind) for x in table[name].to_pylist() if x)])


_ZSTD = pa.Codec("zstd", compression_level=3)


def _zip(body: bytes) -> bytes:
    """Texts are moved compressed; what they were in bytes is known from their sizes."""
    return _ZSTD.compress(body, asbytes=True)


def _unzip(body: bytes, size: int) -> bytes:
    return _ZSTD.decompress(body, decompressed_size=size, asbytes=True) if size else b""


def _steps(x: np.ndarray, kind) -> bytes:
    """x as differences, which compress well where it rises slowly."""
    return np.diff(x, prepend=x.dtype.type(0)).astype(kind).tobytes()


def _rows(schema: str, rows: list[dict]) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.endswith("bigint") else pa.binary() for x in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)})


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(first, after last) of each run of equal values."""
    cut = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist() if len(x) else []
    return list(zip(cut, [*cut[1:], len(x)] if cut else [], strict=True))


# --- windows and their keys --------------------------------------------------------------------


def _least(raw: np.ndarray, size: int, k: int) -> np.ndarray:
    """The least hash of the k-mers in each window of size bytes."""
    with np.errstate(over="ignore"):
        part, width, out, done = _BYTES[raw], 1, None, 0
        while True:  # hashes of 1, 2, 4, ... bytes; those of k's binary digits are put together
            if k & width:
                if out is None:
                    out = part
                else:
                    rest = part[done : done + len(out)]
                    out = out[: len(rest)] * U(pow(_BASE, width, 1 << 64)) + rest
                done += width
            if width * 2 > k:
                break
            part = part[:-width] * U(pow(_BASE, width, 1 << 64)) + part[width:]
            width *= 2
    span, low, reach = size - k + 1, out, 1
    n = len(raw) - size + 1
    while reach * 2 <= span:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    return np.minimum(low[:n], low[span - reach : span - reach + n])


def _segments(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, windows, document) of each run of windows under one key; no window crosses documents."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = max(1, size * 2 // 5)
    key = np.empty(n, U)
    for s in range(0, n, _SLICE):
        key[s : s + _SLICE] = _least(raw[s : min(len(raw), s + _SLICE + size - 1)], size, k)
    fresh, whole = np.ones(n, bool), np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    fresh[off[off < n]] = True
    for a, b in zip(np.maximum(off[:-1], off[1:] - size + 1).tolist(), off[1:].tolist(), strict=True):
        whole[a:b] = False
        fresh[a : a + 1] = True
    start = np.flatnonzero(fresh)
    count = np.diff(np.append(start, n))
    start, count = start[whole[start]], count[whole[start]]
    if len(count) and count.max() > MOST_WINDOWS:
        pieces = -(-count // MOST_WINDOWS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, count = np.repeat(start, pieces) + nth * MOST_WINDOWS, np.minimum(np.repeat(count, pieces) - nth * MOST_WINDOWS, MOST_WINDOWS)
    return key[start], start, count, np.searchsorted(off, start, "right") - 1


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to chunks, numbered by task and place in it."""
    first, held, size = TaskContext.get().partitionId() << 32, [], 0

    def chunk() -> pa.RecordBatch:
        nonlocal first, held, size
        ids, nulls, lens, raws = zip(*held, strict=True)
        off = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int64)
        row = {"c": first, "size": int(off[-1]), "ids": np.concatenate(ids).tobytes(), "nulls": np.concatenate(nulls).tobytes(), "off": off.tobytes(), "body": _zip(b"".join(raws))}
        first, held, size = first + 1, [], 0
        return _rows(CHUNKS, [row]).to_batches()[0]

    for batch in batches:
        raw, off = batch_texts(batch.column("text"))
        ids = batch.column("id")
        nulls = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
        ids = ids.fill_null(int(LAST)).to_numpy(zero_copy_only=False)
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK - size, "right")) - 1)
            held.append((ids[i:j], nulls[i:j], np.diff(off[i : j + 1]), raw[off[i] : off[j]].tobytes()))
            size += int(off[j] - off[i])
            i = j
            if size >= CHUNK or i < len(ids):
                yield chunk()
    if held:
        yield chunk()


def _ask(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's keys, each with its segments' number if two documents share it here, else 1."""
    for batch in batches:
        for r in batch.to_pylist():
            key, _, _, doc = _segments(_arr(_unzip(r["body"], r["size"]), np.uint8), _arr(r["off"], np.int64), size)
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            if not len(at):
                continue
            several = np.maximum.reduceat(doc, at) != np.minimum.reduceat(doc, at)
            counts = np.where(several, np.minimum(np.diff(np.append(at, len(key))), 65535), 1).astype(np.uint16)
            key = key[at]
            bucket = (key % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, counts, bucket = key[order], counts[order], bucket[order]
            yield from _rows(ASKS, [{"a": int(bucket[i]), "c": r["c"], "keys": key[i:j].tobytes(), "counts": counts[i:j].tobytes()} for i, j in _runs(bucket)]).to_batches()


def _answer(table: pa.Table) -> pa.Table:
    """The keys of a bucket that two documents share, to each chunk that asked; whether they are heavy."""
    key, counts = _column(table, "keys", U), _column(table, "counts", np.uint16).astype(np.int64)
    sizes = [len(x) // 8 for x in table["keys"].to_pylist()]
    order = np.argsort(key)
    fresh = np.append(True, key[order][1:] != key[order][:-1])
    total = np.add.reduceat(counts[order], np.flatnonzero(fresh))
    seen = np.empty(len(key), np.int64)
    seen[order] = total[np.cumsum(fresh) - 1]
    rows, at = [], 0
    for c, n in zip(table["c"].to_pylist(), sizes, strict=True):
        k, s = key[at : at + n], seen[at : at + n]
        at += n
        if (hit := s > 1).any():
            rows.append({"c": c, "keys": k[hit].tobytes(), "heavy": (s[hit] > HEAVY).tobytes()})
    return _rows(SHARED, rows)


def _cut(chunk: pa.Table, shared: pa.Table, size: int, buckets: int) -> pa.Table:
    """A chunk's segments under shared keys: the texts, once each, to their buckets; their places past these to the chunk itself."""
    if not chunk.num_rows or not shared.num_rows:
        return _rows(PIECES, [])
    r = chunk.to_pylist()[0]
    ids, body = _arr(r["ids"], np.int64), _unzip(r["body"], r["size"])
    key, start, count, doc = _segments(_arr(body, np.uint8), _arr(r["off"], np.int64), size)
    known, heavy = _column(shared, "keys", U), _column(shared, "heavy", bool)
    order = np.argsort(known)
    known, heavy = known[order], heavy[order]
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    hit = known[at] == key
    key, start, count, doc, heavy = key[hit], start[hit], count[hit], doc[hit], heavy[at[hit]]
    texts: dict[bytes, int] = {}
    seg = np.fromiter((texts.setdefault(body[s : s + w + size - 1], len(texts)) for s, w in zip(start.tolist(), count.tolist(), strict=True)), np.int64, len(start))
    n = len(texts)
    low, high, keys, cut = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min), np.zeros(n, U), np.zeros(n, bool)
    np.minimum.at(low, seg, ids[doc])
    np.maximum.at(high, seg, ids[doc])
    keys[seg], cut[seg] = key, heavy
    texts = list(texts)
    # Windows of heavy keys: pieces of their own.
    windows, h_seg, h_at, h_entry = {}, [], [], []
    for i in np.flatnonzero(cut).tolist():
        t = texts[i]
        for j in range(len(t) - size + 1):
            h_seg.append(i)
            h_at.append(j)
            h_entry.append(n + windows.setdefault(t[j : j + size], len(windows)))
    if windows:
        own, of = np.array(h_entry) - n, np.array(h_seg)
        l2, h2 = np.full(len(windows), LAST), np.full(len(windows), np.iinfo(np.int64).min)
        np.minimum.at(l2, own, low[of])
        np.maximum.at(h2, own, high[of])
        low, high, cut = np.concatenate([low, l2]), np.concatenate([high, h2]), np.concatenate([cut, np.zeros(len(windows), bool)])
        keys = np.concatenate([keys, np.fromiter(((crc32(w) << 32) | crc32(w, 7) for w in windows), U, len(windows))])
        texts += windows
    sent = np.flatnonzero(~cut)
    bucket = ((keys[sent] >> U(20)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sent, bucket = sent[order], bucket[order]
    rows = [{"b": -1 - r["c"], "c": r["c"], "doc": doc.astype(np.int32).tobytes(), "start": _steps(start, np.int32), "seg": _steps(seg, np.int32), "h_seg": np.array(h_seg, np.int32).tobytes(), "h_at": np.array(h_at, np.int32).tobytes(), "h_entry": np.array(h_entry, np.int32).tobytes()}] if len(seg) else []
    for i, j in _runs(bucket):
        e = sent[i:j]
        t = [texts[x] for x in e.tolist()]
        lens = np.fromiter(map(len, t), np.int32, len(t))
        rows.append({"b": int(bucket[i]), "c": r["c"], "entry": _steps(e, np.int32), "key": (keys[e] >> U(32)).astype(np.uint32).tobytes(), "size": lens.tobytes(), "low": _steps(low[e], np.int64), "more": (high[e] - low[e]).tobytes(), "body": _zip(b"".join(t))})
    return _rows(PIECES, rows)


# --- the transform ------------------------------------------------------------------------------


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, keys in it) of keys of so many bits; the place rides in the low bits where it fits, as plain sorts are faster."""
    n, low = len(key), max(1, int(len(key) - 1).bit_length())
    if bits + low > 63:
        order = np.argsort(key)
        return order, key[order]
    both = np.sort((key << low) | np.arange(n))
    return both & ((1 << low) - 1), both >> low


def _suffix_order(t: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Places of t in the order of what follows, compared over depth symbols at least; what is equal that far is in any order.

    Places beyond the end count as 0.  Packed symbols come first; then doubling, of ties only.
    """
    n, bits = len(t), max(1, int(symbols - 1).bit_length())
    take = max(1, min((63 - n.bit_length()) // bits, depth))
    ahead = np.concatenate([t, np.zeros(take, t.dtype)])
    key = np.zeros(n, np.int64)
    for j in range(take):
        key <<= bits
        key |= ahead[j : j + n]
    order, key = _sorted(key, take * bits)
    fresh = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    rank = np.zeros(n + 1, np.int64)  # the number of the first place of one's group; 0 beyond the end
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
    wide = int(n + 1).bit_length()
    while take < depth:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        suffix = order[at]
        o, key = _sorted((rank[suffix] << wide) | rank[np.minimum(suffix + take, n)], 2 * wide)
        suffix = suffix[o]
        order[at] = suffix
        fresh[at[1:]] |= key[1:] != key[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(fresh[at], at, 0)) + 1
        take *= 2
    return order


def _expand(bwt: np.ndarray, least: int) -> np.ndarray:
    """Boundaries (n + 1 flags) between neighbouring suffixes whose common prefix is shorter than least.

    Level by level: an interval of suffixes that begin with w goes to those that begin with cw for each c before it.  While
    most boundaries are still open, a level takes all intervals in one sweep; then only those whose right boundary is
    new, as an old one can't give a new one again.
    """
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)
    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    f = bwt[by_symbol]
    other = f[1:] != f[:-1]
    level, queue = 0, None
    while level < least:
        if queue is None:
            inside = np.cumsum(bound[:n], dtype=np.int32)[by_symbol]
            new = ((inside[1:] != inside[:-1]) | other) & ~bound[1:n]
            bound[1:n] |= new
            level += 1
            found = np.count_nonzero(new)
            if not found:
                break
            if found * 8 < n:
                right, every = np.flatnonzero(new) + 1, np.flatnonzero(bound)
                left = every[np.searchsorted(every, right) - 1]
                if (right - left).sum() * 16 < n:
                    queue = left, right
            continue
        left, right = queue
        if not len(left):
            break
        sizes = right - left
        owner = np.repeat(np.arange(len(left)), sizes)
        row = np.arange(sizes.sum()) + np.repeat(left - (np.cumsum(sizes) - sizes), sizes)
        key = owner * 512 + bwt[row]
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        fresh = np.append(True, key[1:] != key[:-1])
        first, last = row[fresh], row[np.append(fresh[1:], True)]
        kept = bwt[first] != 0  # nothing is extended across the mark between texts
        left, right = to[first[kept]], to[last[kept]] + 1
        new = ~bound[right]
        left, right = left[new], right[new]  # intervals of one length are apart, so no boundary comes twice
        bound[right] = True
        queue = left, right
        level += 1
    return bound


def least_ids(texts: list[bytes], low: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(least id for each window of size bytes, one text's after the other's; where each text's windows begin).

    low: an id for each text.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    used = np.zeros(256, np.int64)
    used[raw] = 1
    code = np.cumsum(used).astype(np.uint16)
    end = np.cumsum(lens + 1) - 1  # the mark, 0, after each text
    t = np.zeros(len(raw) + len(texts), np.uint16)
    inside = np.ones(len(t), bool)
    inside[end] = False
    t[inside] = code[raw]
    order = _suffix_order(t, int(code[-1]) + 1, size)
    bwt = t[order - 1]
    bound = _expand(bwt.astype(np.uint8) if code[-1] < 256 else bwt, size)
    of = np.repeat(np.arange(len(texts)), lens + 1)
    left = np.repeat(end, lens + 1) - np.arange(len(t))  # bytes from here to the mark
    own = np.where(left >= size, low[of], LAST)
    got = np.minimum.reduceat(own[order], np.flatnonzero(bound[:-1]))
    out = np.empty(len(t), np.int64)
    out[order] = got[np.cumsum(bound[:-1]) - 1]
    count = np.maximum(lens - size + 1, 0)
    return out[left >= size], np.cumsum(count) - count


def _search(table: pa.Table, size: int) -> pa.Table:
    """Least ids of the windows of a bucket's segments, in runs, to the chunks that hold some of a greater id."""
    if table["b"][0].as_py() < 0:  # a chunk's own places
        return _rows(LEAST, table.select([x.split()[0] for x in f"c bigint, {PLACES}".split(", ")]).to_pylist())
    key, more, lens = (_column(table, n, k) for n, k in (("key", np.uint32), ("more", np.int64), ("size", np.int32)))
    entry, low = (np.concatenate([np.cumsum(_arr(x, k), dtype=k) for x in table[n].to_pylist()]) for n, k in (("entry", np.int32), ("low", np.int64)))
    high, c = low + more, np.repeat(table["c"].to_numpy(), [len(x) // 4 for x in table["key"].to_pylist()])
    body, ends = b"".join(_unzip(x, int(_arr(z, np.int32).sum())) for x, z in zip(table["body"].to_pylist(), table["size"].to_pylist(), strict=True)), np.cumsum(lens, dtype=np.int64)
    starts = ends - lens
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, key[order][1:] != key[order][:-1])
    volume = np.cumsum(lens[order], dtype=np.int64)
    # A transform ends with the key that fills it.
    part = (volume - lens[order]) // TRANSFORM
    part = np.maximum.accumulate(np.where(fresh, part, 0))
    found = []
    for i, j in _runs(part):
        rows = order[i:j]
        texts: dict[bytes, int] = {}
        text = np.fromiter((texts.setdefault(body[a:b], len(texts)) for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)), np.int64, len(rows))
        ids = np.full(len(texts), LAST)
        np.minimum.at(ids, text, low[rows])
        least, begin = least_ids(list(texts), ids, size)
        fresh_run = np.append(True, least[1:] != least[:-1])
        fresh_run[begin] = True
        first = np.flatnonzero(fresh_run)
        last = np.append(first[1:], len(least)) - 1
        of = np.searchsorted(begin, first, "right") - 1
        per = np.bincount(of, minlength=len(texts))
        at = np.cumsum(per) - per
        many = per[text]
        run = np.arange(many.sum()) + np.repeat(at[text] - (np.cumsum(many) - many), many)
        rows = np.repeat(rows, many)
        wins = least[first[run]] < high[rows]
        run, rows = run[wins], rows[wins]
        found.append((c[rows], entry[rows], (first - begin[of])[run].astype(np.int32), (last - begin[of])[run].astype(np.int32), least[first[run]]))
    c, entry, first, last, low = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(c, kind="stable")
    c, entry, first, last, low = c[order], entry[order], first[order], last[order], low[order]
    return _rows(LEAST, [{"c": int(c[i]), "entry": entry[i:j].tobytes(), "first": first[i:j].tobytes(), "last": last[i:j].tobytes(), "low": low[i:j].tobytes()} for i, j in _runs(c)])


def _unite(chunk: pa.Table, more: pa.Table, size: int) -> pa.Table:
    """A chunk's documents with their covered bytes removed."""
    r = chunk.to_pylist()[0]
    ids, nulls, off, raw = _arr(r["ids"], np.int64), _arr(r["nulls"], bool), _arr(r["off"], np.int64), _arr(_unzip(r["body"], r["size"]), np.uint8)
    doc, start, seg, h_seg, h_at, h_entry = (_column(more, n, np.int32).astype(np.int64) for n in ("doc", "start", "seg", "h_seg", "h_at", "h_entry"))
    start, seg = np.cumsum(start), np.cumsum(seg)
    entry, first, last = (_column(more, n, np.int32).astype(np.int64) for n in ("entry", "first", "last"))
    low = _column(more, "low", np.int64)
    if len(h_seg) and len(entry):  # windows sent on their own, back to their segments
        order = np.argsort(h_entry, kind="stable")
        a, b = np.searchsorted(h_entry[order], entry), np.searchsorted(h_entry[order], entry, "right")
        many = b - a
        place = order[np.arange(many.sum()) + np.repeat(a - (np.cumsum(many) - many), many)]
        direct = many == 0
        entry, first, last, low = (np.concatenate(x) for x in ((entry[direct], h_seg[place]), (first[direct], h_at[place]), (last[direct], h_at[place]), (low[direct], np.repeat(low, many))))
    order = np.argsort(entry, kind="stable")
    entry, first, last, low = entry[order], first[order], last[order], low[order]
    a, b = np.searchsorted(entry, seg), np.searchsorted(entry, seg, "right")
    many = b - a
    run = np.arange(many.sum()) + np.repeat(a - (np.cumsum(many) - many), many)
    start, own = np.repeat(start, many), ids[np.repeat(doc, many)]
    wins = own > low[run]
    start, run = start[wins], run[wins]
    step = np.bincount(start + first[run], minlength=len(raw) + 1) - np.bincount(start + last[run] + size, minlength=len(raw) + 1)
    gone = np.cumsum(step[: len(raw)]) > 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.append(False, gone[:-1]) if len(raw) else gone
    after = np.append(gone[1:], False) if len(raw) else gone
    s, e = np.flatnonzero(gone & (~before | edge[:-1])), np.flatnonzero(gone & (~after | edge[1:])) + 1
    of = np.searchsorted(off, s, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(s - off[of]), pa.array(e - off[of])], ["start", "end"])
    per = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(ids)))]).astype(np.int32)
    left = np.concatenate([[0], np.cumsum(~gone)])[off]
    kept = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(raw[~gone])])
    return pa.table({
        "id": pa.array(ids, mask=nulls), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(off) - np.diff(left)),
        "spans": pa.ListArray.from_arrays(pa.array(per), spans), "kept": kept.cast(pa.binary()),
    })


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id_col, n_bytes, n_removed, spans, kept) of each row of docs.

    spans: the maximal runs of removed bytes, first and after last; kept: the remaining bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    table = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        chunks = scratch.keep(table.mapInArrow(_pack, CHUNKS))
    total = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = int(total) // BUCKET + 1
    with small_batches(spark, 1):
        asks = chunks.select("c", "size", "off", "body").mapInArrow(lambda it: _ask(it, min_bytes, buckets), ASKS)
        shared = scratch.keep(asks.groupBy("a").applyInArrow(_answer, SHARED))
        scratch.settle()
        pieces = chunks.drop("nulls").groupBy("c").cogroup(shared.groupBy("c")).applyInArrow(lambda a, b: _cut(a, b, min_bytes, buckets), PIECES)
        least = scratch.keep(pieces.groupBy("b").applyInArrow(lambda t: _search(t, min_bytes), LEAST))
        scratch.drop(shared)
        scratch.settle()
    out = chunks.groupBy("c").cogroup(least.groupBy("c")).applyInArrow(lambda a, b: _unite(a, b, min_bytes), OUT)
    return out.withColumnRenamed("id", id_col)
