"""Source divergence audit: how far each source's use of terms lies from other sources', and which terms make it up.

For each language: the terms in MIN_DOCS documents at least; a smoothed share p for each of them in each source (a
group) and in the language as a whole; the divergence of a group p from q is the sum of floor((p - q)^2 / q).

Method: terms with the same counts in all sources have the same shares everywhere, so the sparse source-count vectors
are deduplicated first.  Each pair of sources is evaluated once per distinct vector, in numpy blocks, and multiplied by
the number of terms that have it.  Ranks are of terms again: of equal terms only the least TOP can be ranked, so a
vector carries no more than these.

Spark's part: a task counts its documents' terms before anything is shuffled; sums go by (language, source, term), so a
source with a third of all documents is many keys; a vector has at most as many numbers as the language has sources.
The pairs of sources are the result itself; each task adds up its vectors' pairs before they are summed.

Defined results: null texts, languages and sources are ''; of letters only A-Z are lower-cased; repeated rows are
documents of their own; a language without kept terms has pairs of value 0; a source alone in its language has no pair;
equal values are ranked by the item's bytes.  Texts are cut into pieces of PIECE bytes between terms, so very long ones
are counted in bounded memory; one term is held whole.  An empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.vectors import ship, small_batches
from orrery.plans.scratch import Scratch

MIN_DOCS, TOP, SHARE = 3, 200, 1_000_000_000
#: Bytes of text counted at once; terms that a task holds before it gives out their counts; vectors of a block.
PIECE, HELD, BLOCK = 1 << 20, 300_000, 4096

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


def _pieces(body: bytes) -> Iterator[bytes]:
    """body, cut between terms."""
    i = 0
    while i < len(body):
        gap = _GAP.search(body, i + PIECE)
        j = gap.start() if gap else len(body)
        yield body[i:j]
        i = j


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents, added up over what a task has read, in bounded parts."""
    total: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), c in total.items():
            d = docs[lang, source]
            whole = [pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(c.values(), pa.int64()), pa.array([d[t] for t in c], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(c)), pa.repeat(source, len(c)), *whole], ["lang", "source", "term", "n", "docs"])
        total.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            group, seen = (lang, source), set()
            own = total.setdefault(group, Counter())
            before = len(own)
            for piece in _pieces(text.encode().lower()):
                terms = _TERM.findall(piece)
                own.update(terms)
                seen.update(terms)
            docs.setdefault(group, Counter()).update(seen)
            held += len(own) - before
            if held > HELD:
                yield from out()
                held = 0
    yield from out()


def shares(count: np.ndarray, total: np.ndarray, terms: int, scale: int = SHARE) -> np.ndarray:
    """1 + floor(scale * (count + 1) / (total + terms)), by digits to the base 1000, so that nothing overflows."""
    rest, whole, base = count + 1, np.zeros_like(count + total), total + terms
    while scale > 1:
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // base, rest % base
        scale //= 1000
    return whole + 1


def _evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): each pair's sum over a task's blocks of vectors."""
    sums: dict[str, tuple[list, np.ndarray]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in ("lang", "sources", "totals", "terms")} | {c: batch.column(c)[i].values.to_numpy() for c in ("at", "of", "n", "times")}
            total = np.array(r["totals"], np.int64)
            at, of, n, times = r["at"], r["of"], r["n"], r["times"]
            count = np.zeros((len(times), len(total)), np.int64)
            count[at, of] = n
            p = shares(count, total, r["terms"])
            _, acc = sums.setdefault(r["lang"], (r["sources"], np.zeros((len(total), len(total)), np.int64)))
            for g in range(len(total)):
                step = p[:, g, None] - p
                acc[g] += times @ (step * step // p)
    for lang, (names, acc) in sums.items():
        for g, name in enumerate(names):
            others = [h for h in range(len(names)) if h != g]
            if others:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(others)), pa.array([name] * len(others)), pa.array([names[h] for h in others]), pa.array(acc[g][others])], ["lang", "source", "item", "value"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, sources, counts, times) to blocks of one language: vectors as (row, source, count) lists."""
    for batch in batches:
        for lang in batch.column("lang").unique():
            own = batch.filter(pc.equal(batch.column("lang"), lang))
            per = pc.list_value_length(own.column("sources")).to_numpy()
            lists = [pa.array(np.repeat(np.arange(len(per)), per)), own.column("sources").flatten(), own.column("counts").flatten(), own.column("times")]
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], ["lang", "at", "source", "n", "times"])


def _divergence(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def _share_sql(count: str, total: str, terms: str) -> str:
    """As ``shares``: three digits to the base 1000."""
    base = f"({total} + {terms})"
    first = f"({count} + 1) * 1000"
    second = f"({first} % {base}) * 1000"
    third = f"({second} % {base}) * 1000"
    return f"(1 + ({first} div {base}) * 1000000 + ({second} div {base}) * 1000 + ({third} div {base}))"


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs with all other sources of the language, and a group's top terms."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    table = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    with small_batches(spark):
        parts = table.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
        # What a task gives out is added up already: dealt out once by term, it serves both groupings.
        counts = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        vectors = counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("docs").alias("docs"))
        kept = scratch.keep(vectors.filter(F.col("docs") >= min_docs).select("lang", "term", "vector"))
    by_vector = Window.partitionBy("lang", "vector").orderBy("term")
    # One row a distinct vector: how many terms have it, and the least of them.
    times = kept.groupBy("lang", "vector").agg(F.count("*").alias("times"))
    least = kept.withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= top).groupBy("lang", "vector").agg(F.sort_array(F.collect_list("term")).alias("items"))
    distinct = scratch.keep(times.join(least, ["lang", "vector"]))
    flat = distinct.select("lang", "times", F.explode("vector").alias("v")).select("lang", "v.source", (F.col("times") * F.col("v.n")).alias("n"))
    groups = table.select("lang", "source").distinct().join(flat.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    kinds = distinct.groupBy("lang").agg(F.sum("times").alias("terms"))
    groups = scratch.keep(groups.join(kinds, "lang", "left").select("lang", "source", "total", F.coalesce("terms", F.lit(0)).alias("terms")))
    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g"), F.first("terms").alias("terms"), F.sum("total").alias("whole"))
    by_lang = by_lang.select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), "terms", "whole")

    # Pairs: blocks of distinct vectors meet their language's sources; every pair starts from 0.
    with small_batches(spark, BLOCK):
        blocks = distinct.select("lang", F.col("vector.source").alias("sources"), F.col("vector.n").alias("counts"), "times")
        blocks = scratch.keep(blocks.mapInArrow(_blocks, "lang string, at array<bigint>, source array<string>, n array<bigint>, times array<bigint>"))
    with_sources = blocks.join(by_lang, "lang").select("lang", "at", F.transform("source", lambda s: (F.array_position("sources", s) - 1).cast("bigint")).alias("of"), "n", "times", "sources", "totals", "terms")
    with small_batches(spark, 16):
        pairs = scratch.keep(with_sources.mapInArrow(_evaluate, "lang string, source string, item string, value bigint"))
    nothing = by_lang.filter("terms = 0").select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode("sources").alias("item")).filter("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    pairs = pairs.unionByName(nothing).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    down = [F.desc("value"), F.asc("item")]
    by_group = Window.partitionBy("lang", "source").orderBy(*down)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_group).alias("rank"))

    # Terms: a value per distinct vector and source, then of its least terms.
    flat = distinct.select("lang", "items", F.explode("vector").alias("v"), F.aggregate("vector", F.lit(0).cast("bigint"), lambda a, v: a + v["n"]).alias("all"))
    flat = flat.select("lang", "items", "all", "v.source", "v.n").join(groups, ["lang", "source"]).join(by_lang.select("lang", "whole"), "lang")
    flat = flat.select("lang", "source", "items", F.expr(_share_sql("n", "total", "terms")).alias("p"), F.expr(_share_sql("all", "whole", "terms")).alias("q")).filter("p > q")
    terms = flat.select("lang", "source", F.expr(_divergence("p", "q")).alias("value"), F.explode("items").alias("item"))
    terms = terms.withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def oracle(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    share = "1 + (1000000000::HUGEINT * (coalesce({n}, 0) + 1)) // ({total} + v)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT lang, source, i, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {min_docs}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS total, coalesce(any_value(v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) USING (lang) GROUP BY lang, source),
p AS MATERIALIZED (SELECT g.lang, g.source, term, c.n, k.n AS whole, {share.format(n='c.n', total='total')} AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, {share.format(n='k.n', total='total')} AS q FROM k JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= {top}"""
