"""Mixing sources to target weights by Pfair scheduling.

Each source is dealt in blocks of rows.  A round has as many slots as the weights of the sources that
still have blocks; block i of a source with m of a round's M slots is released at floor(i*M/m) and due
at ceil((i+1)*M/m), and each slot goes to the released block with the earliest deadline (the first
source in name order wins ties).  Rounds repeat, so one round's schedule places all blocks by
arithmetic, and at every slot each source is within one block of its share of the round.

A source that runs out spreads its last blocks over one shorter round; the others then share its slots
in proportion to their weights.  No row is dropped or repeated.

Scale: rows get their number within a source from counts per (source, bucket of the key's hash) and a
row number within the bucket, so a source with a third of all rows is sorted by as many tasks as it
has buckets; their number grows with the table, their size doesn't.  The schedule is folded from one row that holds a count per source; it has at most
2 * sources * (sum of weights) numbers and is refused beyond ``max_sources``, hence its broadcast.

Defined results: a null source is a source of its own, after all others.  Rows are ordered within a
source by the MD5 of the id, then the id; repeated ids take neighbouring places in any order.  Null ids
come as the empty id.  Empty tables give empty results; columns keep their names, the added ones
(block, slot, mix_pos) replace equal names.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Production weights: blocks a round; sources that are not named get DEFAULT_WEIGHT.
WEIGHTS = {"src0": 8, "src1": 4, "src2": 4, "src3": 2, "src4": 2}
DEFAULT_WEIGHT, BLOCK_ROWS, MAX_SOURCES, BUCKET_ROWS = 1, 16, 256, 4096

_ROUND = "struct<lo:array<bigint>,m:array<bigint>,reps:bigint,slot:bigint,total:bigint>"
#: One step: whole rounds while every live source can fill its part, else a round of what is left.
_ROUNDS = f"""aggregate(sequence(1, 2 * size(w)),
  named_struct('rem', b, 'lo', transform(w, x -> 0L), 'slot', 0L, 'out', cast(array() as array<{_ROUND}>)),
  (a, step) -> transform(array(array_min(filter(transform(a.rem, (r, j) -> if(r > 0, r div w[j], null)), x -> x is not null))), q ->
    if(q is null, a, transform(array(transform(a.rem, (r, j) -> if(q > 0, if(r > 0, w[j], 0L), least(r, w[j])))), m -> named_struct(
      'rem', transform(a.rem, (r, j) -> r - m[j] * greatest(q, 1L)),
      'lo', transform(a.lo, (l, j) -> l + m[j] * greatest(q, 1L)),
      'slot', a.slot + aggregate(m, 0L, (s, x) -> s + x) * greatest(q, 1L),
      'out', array_append(a.out, named_struct('lo', a.lo, 'm', m, 'reps', greatest(q, 1L), 'slot', a.slot, 'total', aggregate(m, 0L, (s, x) -> s + x)))))[0]))[0],
  a -> a.out)"""
#: Earliest deadline first over the slots of one round r: the array of (source, its block, slot).
_EDF = """aggregate(sequence(0L, r.total - 1),
  named_struct('n', transform(r.m, x -> 0L), 'out', cast(array() as array<struct<j:int,i:bigint,t:bigint>>)),
  (a, t) -> transform(array(array_min(filter(transform(r.m, (m, j) -> if(a.n[j] < m and (a.n[j] * r.total) div m <= t,
      named_struct('d', ((a.n[j] + 1) * r.total + m - 1) div m, 'j', j), null)), x -> x is not null)).j), k -> named_struct(
    'n', transform(a.n, (n, j) -> if(j = k, n + 1, n)),
    'out', array_append(a.out, named_struct('j', k, 'i', a.n[k], 't', t))))[0],
  a -> a.out)"""


def schedule(counts: DataFrame, weights: dict[str, int], default_weight: int, block_rows: int, max_sources: int) -> DataFrame:
    """(_s, phases) from counts (_s, n): for each source where each of its blocks goes."""
    if default_weight < 1 or any(w < 1 or w != int(w) for w in weights.values()):
        raise ValueError("weights are whole numbers of blocks a round, 1 at least")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,int>")
    per = counts.select(F.struct("_s", F.coalesce(F.try_element_at(table, F.col("_s")), F.lit(default_weight)).cast("bigint").alias("w"), F.expr(f"(n + {block_rows - 1}) div {block_rows}").alias("b")).alias("e"))
    # collect_list gathers one entry a source; beyond max_sources the query stops with this message.
    one = per.agg(F.array_sort(F.collect_list("e")).alias("e")).filter(F.size("e") > 0)
    one = one.withColumn("e", F.when(F.size("e") > max_sources, F.raise_error(F.lit(f"more than {max_sources} sources; raise max_sources or merge sources"))).otherwise(F.col("e")))
    one = one.selectExpr("transform(e, x -> x._s) as s", "transform(e, x -> x.w) as w", "transform(e, x -> x.b) as b")
    rounds = one.withColumn("rounds", F.expr(_ROUNDS)).withColumn("rounds", F.expr(f"transform(rounds, r -> named_struct('r', r, 'o', {_EDF}))"))
    each = rounds.select(F.posexplode("s").alias("j", "_s"), "rounds")
    return each.select("_s", F.expr("transform(filter(rounds, x -> x.r.m[j] > 0), x -> named_struct('lo', x.r.lo[j], 'm', x.r.m[j], 'reps', x.r.reps, 'slot', x.r.slot, 'total', x.r.total, 'pos', transform(filter(x.o, o -> o.j = j), o -> o.t)))").alias("phases"))


def mix(docs: DataFrame, *, weights: dict[str, int] = WEIGHTS, default_weight: int = DEFAULT_WEIGHT, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", max_sources: int = MAX_SOURCES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with block (number of its block within its source), slot (of that block in the mix) and mix_pos.

    mix_pos orders the rows of the mix; it is slot * block_rows + place in the block, so a source's short
    last block leaves a gap.  mix_pos // block_rows is the slot.
    """
    names = [c for c in docs.columns if c not in ("block", "slot", "mix_pos")]
    last = F.lit("￿")  # after all names, for the null source
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(source_col), last).alias("_s"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_k"), F.col(id_col).alias("_id"))
    # So many digits that a bucket of the hashes has about bucket_rows rows at every size.
    digits = max(1, ceil(log(max(docs.count(), 1) / bucket_rows, 16)))
    rows = rows.withColumn("_b", F.substring("_k", 1, digits))
    sizes = rows.groupBy("_s", "_b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket, of about bucket_rows / 16 or more
    offsets = sizes.select("_s", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o"))
    plan = schedule(sizes.groupBy("_s").agg(F.sum("n").alias("n")), weights, default_weight, block_rows, max_sources)
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_k", "_id")))
    numbered = numbered.join(offsets, ["_s", "_b"]).withColumn("_i", F.col("_o") + F.col("_n") - 1)
    at = numbered.join(F.broadcast(plan), "_s").withColumn("block", F.expr(f"_i div {block_rows}"))
    at = at.withColumn("_p", F.expr("filter(phases, p -> block >= p.lo and block < p.lo + p.m * p.reps)[0]"))
    at = at.withColumn("slot", F.expr("_p.slot + ((block - _p.lo) div _p.m) * _p.total + element_at(_p.pos, cast((block - _p.lo) % _p.m as int) + 1)"))
    return at.select("_row.*", "block", "slot", F.expr(f"slot * {block_rows} + _i % {block_rows}").alias("mix_pos"))


def oracle() -> str:
    """DuckDB SQL for mix(documents) with the production weights: a recursion that takes one slot a step."""
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
    pick = "list_sort(list_filter(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN cnt[i] < m[i] AND cnt[i] * total // m[i] <= t THEN {'d': ((cnt[i] + 1) * total + m[i] - 1) // m[i], 'i': i} END), lambda x: x IS NOT NULL))[1].i"
    part = "list_transform(range(1, len(rem) + 1), lambda i: least(rem[i], ws[i]))"
    zero = "list_transform(rem, lambda x: 0)"
    return f"""WITH RECURSIVE k AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h, coalesce(source, '￿') AS s FROM documents),
n AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST) - 1 AS i FROM k),
b AS (SELECT s, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS b, CASE s {case} ELSE {DEFAULT_WEIGHT} END AS w FROM k GROUP BY s),
a AS (SELECT list(s ORDER BY s) AS ss, list(b ORDER BY s) AS bs, list(w ORDER BY s) AS ws FROM b),
sim AS (
  SELECT slot, t, total, m, cnt, rem, ws, {pick} AS j FROM (SELECT 0::BIGINT AS slot, 0 AS t, list_sum(m) AS total, m, cnt, rem, ws FROM (SELECT bs AS rem, ws, {part.replace("rem", "bs")} AS m, {zero.replace("rem", "bs")} AS cnt FROM a) WHERE len(m) > 0)
  UNION ALL
  SELECT slot, t, total, m, cnt, rem, ws, {pick} AS j FROM (
    SELECT slot, CASE WHEN fresh THEN 0 ELSE t END AS t, CASE WHEN fresh THEN list_sum({part}) ELSE total END AS total, CASE WHEN fresh THEN {part} ELSE m END AS m, CASE WHEN fresh THEN {zero} ELSE cnt END AS cnt, rem, ws FROM (
      SELECT slot + 1 AS slot, t + 1 AS t, total, m, list_transform(range(1, len(m) + 1), lambda i: cnt[i] + (i = j)::INT) AS cnt, list_transform(range(1, len(m) + 1), lambda i: rem[i] - (i = j)::INT) AS rem, ws, t + 1 = total AS fresh FROM sim)
    WHERE list_sum(rem) > 0))
SELECT n.doc_id, n.source, n.i // {BLOCK_ROWS} AS block, slot, slot * {BLOCK_ROWS} + n.i % {BLOCK_ROWS} AS mix_pos
FROM n JOIN (SELECT slot, ss[j] AS s, bs[j] - rem[j] AS block FROM sim, a) z ON n.s = z.s AND n.i // {BLOCK_ROWS} = z.block"""
