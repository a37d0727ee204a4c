"""Vector code compression: each of PARTS parts of an integer vector becomes the index of its nearest codebook entry.

Method: vectors lie in columnar blocks (one row of numbers per dimension).  A round is one ``treeAggregate`` over the
blocks: distances accumulate dimension by dimension, ``np.add.at`` adds the blocks' parts to int64 tensors of sums and
counts, and these merge through a reduction tree, whose depth follows the number of partitions.  Only tensors of
parts x entries x (dimensions + 1) numbers reach the driver, whatever the table holds.  All arithmetic is exact.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, and so are rows of no
components, of a number that the parts don't divide, or of another number than the valid row that comes first; rows
are ordered by id (nulls last), then by vector, then by label, so ties and repeated ids start the same codebooks in any
order of the table.  With fewer kept rows than entries the codebooks have that many.  Squared distances must fit in 64
bits: larger components raise.  An empty table gives an empty one.  Labels are compared null-safe; columns other than
the three named ones aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.vectors import ship, small_batches
from orrery.plans.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block at most, and partitions whose tensors one task of the reduction tree merges.
BLOCK, FAN = 2048, 32

Tensors = tuple[np.ndarray, np.ndarray]


def _whole(x: np.ndarray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x), for vectors of width components."""
    x = np.floor(x * float(scale))
    if x.size and np.abs(x).max() >= (most := int((2**63 // width) ** 0.5) // 2):
        raise ValueError(f"components of {most / scale:.3g} or more: their squared distances don't fit in 64 bits")
    return x.astype(np.int64)


def _integers(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, v) to blocks: ids and labels as lists, floor(scale * v) as one row of int64 per dimension."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, width)
        x = np.ascontiguousarray(_whole(v.T, width, scale))
        whole = pa.array([0, n], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(whole, batch.column("id")), pa.ListArray.from_arrays(whole, batch.column("label")), pa.array([x.tobytes()], pa.binary())],
            ["ids", "labels", "body"],
        )


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each column of x (dimensions, vectors); the lower entry wins ties."""
    far = np.zeros((len(book), x.shape[1]), np.int64)
    for d in range(len(x)):
        step = x[d] - book[:, d, None]
        far += step * step
    code = far.argmin(axis=0)
    return code, far[code, np.arange(len(code))]


def _add(into: Tensors, body: bytes, books: np.ndarray) -> Tensors:
    """Adds a block's parts to the sums (part, entry, dimension) and counts (part, entry) of their nearest entries."""
    sums, counts = into
    parts, _, width = books.shape
    x = np.frombuffer(body, np.int64).reshape(parts, width, -1)
    for p in range(parts):
        code, _ = _nearest(x[p], books[p])
        np.add.at(counts[p], code, 1)
        for d in range(width):
            np.add.at(sums[p, :, d], code, x[p, d])
    return sums, counts


def _merge(a: Tensors, b: Tensors) -> Tensors:
    return a[0] + b[0], a[1] + b[1]


def learn(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, dimension) after the rounds; entries that no part is nearest to stay."""
    bodies = blocks.select("body").rdd.map(lambda r: bytes(r["body"]))
    depth = max(2, ceil(log(max(bodies.getNumPartitions(), 2), FAN)))
    for _ in range(rounds):
        zero = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        sums, counts = bodies.treeAggregate(zero, lambda acc, body, b=books: _add(acc, body, b), _merge, depth)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def _encode(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column("body")[i].as_py(), np.int64).reshape(parts, width, -1)
            codes, errors = zip(*(_nearest(x[p], books[p]) for p in range(parts)), strict=True)
            flat = pa.array([c.tobytes() for c in np.stack(codes, axis=1).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, flat, pa.array(np.sum(errors, axis=0))], ["id", "label", "codes", "error"])


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((id_col, label_col, codes binary: a byte per part, error, label_error) of each kept row, the codebooks)."""
    if not 0 < entries <= 256:
        raise ValueError("codes are bytes: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0) & F.forall("v", fine))
    order = [F.asc_nulls_last("id"), F.asc("v"), F.asc_nulls_last("label")]
    # Width and first entries: as many rows as there are entries.
    head = rows.orderBy(*order).limit(1).collect()
    if not head:
        return rows.limit(0).select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.lit(b"").alias("codes"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error")), np.zeros((parts, 0, 0), np.int64)
    width = len(head[0]["v"])
    rows = rows.filter(F.size("v") == width)
    first = _whole(np.array([r["v"] for r in rows.orderBy(*order).limit(entries).collect()], np.float64), width, scale)
    books = np.ascontiguousarray(first.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    kinds = dict(rows.dtypes)
    with small_batches(spark, BLOCK):
        blocks = scratch.keep(rows.mapInArrow(lambda it: _integers(it, width, scale), f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, body binary"))
    books = learn(blocks, books, rounds)
    with small_batches(spark, 64):  # rows of blocks here
        coded = scratch.keep(blocks.mapInArrow(lambda it, b=books: _encode(it, b), f"id {kinds['id']}, label {kinds['label']}, codes binary, error bigint"))
    scratch.drop(blocks)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = coded.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error", "label_error"), books


def codebooks_text(books: np.ndarray) -> str:
    """All components in decimal by part, entry and place, comma-joined."""
    return ",".join(map(str, books.ravel().tolist()))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The query's rows in DuckDB SQL: components as rows, the rounds unrolled."""
    down = "(({s}) - ((({s}) % ({c})) + ({c})) % ({c})) // ({c})"
    ctes = [
        "r AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS n, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND (SELECT count(*) FROM unnest(embedding) u(y) WHERE y IS NULL OR NOT isfinite(y)) = 0)",
        f"x AS MATERIALIZED (SELECT n, (i - 1) // (len(v) // {parts}) AS p, (i - 1) % (len(v) // {parts}) AS d, CAST(floor({scale} * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x FROM r, unnest(range(1, len(v) + 1)) u(i))",
        f"b0 AS MATERIALIZED (SELECT p, n AS k, d, x AS y FROM x WHERE n < {entries})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"f{i} AS (SELECT n, x.p, k, sum((x - y) * (x - y)) AS f FROM x JOIN b{i} b ON x.p = b.p AND x.d = b.d GROUP BY n, x.p, k)")
        ctes.append(f"a{i} AS MATERIALIZED (SELECT n, p, arg_min(k, (f, k)) AS k, min(f) AS f FROM f{i} GROUP BY n, p)")
        if i < rounds:
            ctes.append(f"s{i} AS (SELECT a.p, a.k, d, sum(x)::BIGINT AS s, count(*) AS c FROM a{i} a JOIN x ON a.n = x.n AND a.p = x.p GROUP BY a.p, a.k, d)")
            ctes.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.k, b.d, coalesce({down.format(s='s', c='c')}, y) AS y FROM b{i} b LEFT JOIN s{i} s ON b.p = s.p AND b.k = s.k AND b.d = s.d)")
    return f"""WITH {', '.join(ctes)},
c AS (SELECT n, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(f) AS BIGINT) AS error FROM a{rounds} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, k, d)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN r ON c.n = r.n"""
