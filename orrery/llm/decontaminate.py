"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and become tokens: a run of numbers (digits or number words), a run of names (words
with a capital, at the start of a sentence too) and a unit after a number are one typed placeholder each;
every other word is itself.  Windows of tokens are hash-joined between documents and benchmark items, and
so are windows of the words as they are.  Hits of a document and an item whose places differ by nearly the
same distance belong to one alignment.  There the values under the placeholders must be consistent: one
value of the item stands for one value of the document and the other way round, by the majority of the
windows; windows that say otherwise don't count.  So an item is caught verbatim, and with other numbers,
names or units put in throughout, however many words these take.

A pair is reported if the windows that count cover at least ``coverage`` of the item's words.

Scale: document windows pass a bit filter of fixed size made from the benchmark's windows before they
leave the worker, so what is joined is hits and a few false ones.  Hits are grouped by document, item and
band of distances; a group holds at most 2 * BAND hits a window of the item.  The benchmark's windows are
broadcast only if counted to at most ``broadcast_windows``; beyond, the join shuffles, with each window of the
benchmark dealt to SALTS tasks, so that one which many documents hold is met by them all.

Defined results: null and empty texts match nothing; so do items of fewer than MIN_WORDS words.  Items
shorter than a window are one window of their own length.  A window is a template if it has a placeholder
and at least two words that are none.  Repeated rows repeat no result: a document is (id, text).  Ids keep
their types; a null id is an id like others.  Other columns, whatever their names, are not read, and pass
through ``decontaminate``.  Ties of alignments go to the greater coverage.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import vectors as V

WINDOW, COVERAGE, MIN_WORDS, BAND, SALTS, FILTER_BITS, BROADCAST_WINDOWS = 6, 0.5, 3, 8, 16, 24, 2_000_000
NUMBER, NAME, UNIT = (V.U(x) for x in (0x11, 0x22, 0x33))
# Units that may follow a number.
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months year years ml cl l litre litres liter liters gallon gallons percent degrees degree c f k celsius fahrenheit kelvin j kj cal kcal w kw mw v volt volts watt watts joule joules n newton newtons pa kpa bar hz khz mhz ghz b kb mb gb tb bytes dollars dollar cents cent euros euro pounds usd eur gbp mph kmh kph".split()
# Words that are numbers.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = V.words(raw, np.array([0, len(raw)]))
    return np.unique(V.span_hash(raw, s, e))


UNIT_HASHES, NUMBER_HASHES = _word_hashes(UNITS), _word_hashes(NUMBER_WORDS)


def canonical(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number) of each word; (first word, canonical hash, value of a placeholder or 0) of each token."""
    s, e, doc = V.words(raw, off, numbers=True)
    plain = V.span_hash(V.LOWER[raw], s, e)
    if not len(s):
        return plain, doc, np.zeros(0, np.int64), plain, plain
    letters = np.concatenate([[0], np.cumsum(~(V.DIGIT[raw] | (raw == 46) | (raw == 44)))])
    number = (letters[e] == letters[s]) | np.isin(plain, NUMBER_HASHES)
    # Capitals of ASCII and, in two bytes, of Latin-1.
    wide = (raw[s] == 0xC3) & (raw[np.minimum(s + 1, len(raw) - 1)] >= 0x80) & (raw[np.minimum(s + 1, len(raw) - 1)] <= 0x9E)
    name = (((raw[s] >= 65) & (raw[s] <= 90)) | wide) & ~number
    same = np.concatenate([[False], doc[1:] == doc[:-1]])
    run = np.where(number, NUMBER, np.where(name, NAME, V.U(0)))
    goes_on = same & (run != 0) & np.concatenate([[False], run[1:] == run[:-1]])
    first = np.flatnonzero(~goes_on)
    unit = np.zeros(len(first), bool)
    unit[1:] = (run[first[1:]] == 0) & same[first[1:]] & (run[first[1:] - 1] == NUMBER) & np.isin(plain[first[1:]], UNIT_HASHES)
    kind = np.where(unit, UNIT, run[first])
    # The value of a run: its words' hashes by place.
    place = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    value = V.mix(np.add.reduceat(plain * V.powers(int(place.max()) + 1)[0][place], first) + kind)
    return plain, doc, first, np.where(kind == 0, plain[first], kind), np.where(kind == 0, V.U(0), value | V.U(1))


def _lists(flat: np.ndarray, many: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def schema_of(id_type: str) -> str:
    return f"id {id_type}, h bigint, n_words int, pos int, `from` int, `to` int, size int, literal boolean, bare boolean, wh bigint, slots array<bigint>"


def _windows(batches: Iterator[pa.RecordBatch], sizes: list[int], bits: np.ndarray | None, window: int) -> Iterator[pa.RecordBatch]:
    """Rows of schema_of for the windows of (id, h, text) rows that pass the filter (all, if there is none).

    pos is the token a window starts at, from and to the words it covers; a literal one is bare if no
    placeholder touches it.  window: texts of fewer words give
    one window of their own length (items only; 0: none).
    """
    for b in batches:
        raw, off = V.batch_texts(b.column(2))
        for i, j in V.chunks(off):
            part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
            plain, doc, first, kind, value = canonical(part, o)
            if not len(plain):
                continue
            n_words = np.bincount(doc, minlength=j - i)
            base = np.concatenate([[0], np.cumsum(n_words)])  # first word of each text
            token_of = np.searchsorted(first, np.arange(len(plain)), "right") - 1
            tdoc = doc[first]
            tbase = np.searchsorted(tdoc, np.arange(j - i + 1))
            n_tokens = np.diff(tbase)
            ends = np.append(first, len(plain))
            filled = np.concatenate([[0], np.cumsum(value != 0)])
            spots = np.flatnonzero(value != 0)
            for size in sizes:
                for literal in (True, False):
                    h, of, many = (plain, doc, n_words) if literal else (kind, tdoc, n_tokens)
                    n = len(h) - size + 1
                    if n <= 0:
                        continue
                    ok = of[:n] == of[size - 1 :]
                    if window:
                        ok &= (many[of[:n]] == size) if size < window else (many[of[:n]] >= size)
                        ok &= n_words[of[:n]] >= MIN_WORDS
                    if not literal:  # a template needs a placeholder to say anything new, and words to be one at all
                        holes = filled[size:] - filled[:n]
                        ok &= (holes > 0) & (size - holes >= 2)
                    wh = V.windows(h, size) ^ V.U(size * 2 + literal)
                    if bits is not None:
                        ok &= ((bits[(wh >> V.U(67 - FILTER_BITS)).astype(np.int64)] >> ((wh >> V.U(64 - FILTER_BITS)) & V.U(7)).astype(np.uint8)) & 1).astype(bool)
                    k = np.flatnonzero(ok)
                    if not len(k):
                        continue
                    d = of[k]
                    row = pa.array(i + d)
                    start, stop = (k, k + size) if literal else (first[k], ends[k + size])
                    pos = (token_of[k] if literal else k) - tbase[d]
                    held = np.zeros(len(k), np.int64) if literal else filled[k + size] - filled[k]
                    bare = filled[token_of[k + size - 1] + 1] == filled[token_of[k]] if literal else np.zeros(len(k), bool)
                    flat = np.repeat(filled[k] - np.cumsum(held) + held, held) + np.arange(held.sum()) if held.sum() else np.zeros(0, np.int64)
                    slots = value[spots[flat]] if len(flat) else np.zeros(0, V.U)
                    ints = [pa.array(x.astype(np.int32)) for x in (n_words[d], pos, start - base[d], stop - base[d], np.full(len(k), size))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), *ints, pa.array(np.full(len(k), literal)), pa.array(bare), pa.array(wh[k].view(np.int64)), _lists(slots, held)], names=["id", "h", "n_words", "pos", "from", "to", "size", "literal", "bare", "wh", "slots"])


def covered(spans: list[tuple[int, int]]) -> int:
    """How many places the spans cover."""
    out, end = 0, 0
    for a, b in sorted(spans):
        out += max(0, b - max(a, end))
        end = max(end, b)
    return out


def consistent(hits: list[dict]) -> tuple[int, int, int]:
    """(words covered, windows, words covered verbatim) of an alignment's hits.

    hits: from and to (words of the item), dfrom and dto (of the document), literal, bare, a and b (values of item
    and document under the placeholders).  Two readings are made, and the one that covers more counts: all literal
    windows; or the templates that fit one mapping of the values, with the literal windows that no placeholder
    touches.  The mapping takes the pairs of values by how many windows hold them; a pair that contradicts one
    taken before goes.  A repeated passage counts once on either side, so the lesser side counts.
    """
    votes = Counter(p for x in hits if not x["literal"] for p in set(zip(x["a"], x["b"], strict=True)))
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    for (a, b), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
        if a not in there and b not in back:
            there[a], back[b] = b, a
    verbatim = [x for x in hits if x["literal"]]
    fits = [x for x in hits if x["bare"] or (not x["literal"] and all(there.get(a) == b for a, b in zip(x["a"], x["b"], strict=True)))]
    words = [min(covered([(x["from"], x["to"]) for x in part]), covered([(x["dfrom"], x["dto"]) for x in part])) for part in (verbatim, fits)]
    return max(words), len({(x["from"], x["to"]) for x in (verbatim if words[0] >= words[1] else fits)}), words[0]


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [consistent(x) for x in b.column(4).to_pylist()]
        columns = [pa.array([g[i] for g in got], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], *columns], names=["id", "h", "item", "n_words", "words", "windows", "verbatim"])


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("h"), F.col(f"`{text_col}`").alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id_col, text_hash, item_col, coverage, n_windows, verbatim): the pairs of documents and items.

    verbatim: the words alone reach the coverage; else it takes the template.
    """
    spark = docs.sparkSession
    V.ship(spark)
    id_type, item_type = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    sizes = list(range(2, window + 1))
    # An item's whole table of windows; its distinct texts only.
    items = _texts(benchmark, item_col, item_text).dropDuplicates(["id", "h"])
    bench = items.mapInArrow(lambda it: _windows(it, sizes, None, window), schema_of(item_type))
    bench = bench.select(F.col("id").alias("item"), F.col("h").alias("ih"), F.col("n_words").alias("total"), F.col("pos").alias("ipos"), "from", "to", F.col("size").alias("isize"), "literal", "bare", "wh", F.col("slots").alias("islots"))
    # The filter has a fixed number of bytes, so what comes to the driver is bounded by it.
    bit = F.shiftrightunsigned("wh", 64 - FILTER_BITS)
    spots = bench.groupBy(F.shiftright(bit, 3).alias("p")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(wh, {64 - FILTER_BITS}) & 7 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bits[spots.column("p").to_numpy()] = spots.column("bits").to_numpy().astype(np.uint8)
    count = {r["isize"]: r["count"] for r in bench.groupBy("isize").count().collect()}  # a row a size
    used, small = sorted(count), sum(count.values()) <= broadcast_windows
    shared = spark.sparkContext.broadcast(bits)
    hits = _texts(docs, id_col, text_col).mapInArrow(lambda it: _windows(it, used, shared.value, 0), schema_of(id_type)).withColumnsRenamed({"from": "dfrom", "to": "dto"}).drop("n_words", "bare")
    if small:
        met = hits.join(F.broadcast(bench), ["wh", "literal"])
    else:
        met = hits.withColumn("salt", F.pmod(F.xxhash64("id", "h"), F.lit(SALTS))).join(bench.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["wh", "literal", "salt"])
    met = met.filter("size = isize").withColumn("diag", F.col("pos") - F.col("ipos"))
    # Each distance lies in two bands, so that no alignment is cut at an edge.
    bands = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.floor((F.col("diag") + g * BAND // 2) / BAND).alias("band")) for g in (0, 1)])).alias("at")
    hit = F.struct("from", "to", "dfrom", "dto", "literal", "bare", F.when(F.col("literal"), F.array().cast("array<bigint>")).otherwise(F.col("islots")).alias("a"), F.when(F.col("literal"), F.array().cast("array<bigint>")).otherwise(F.col("slots")).alias("b"))
    groups = met.select("id", "h", "item", "ih", "total", bands, hit.alias("hit")).groupBy("id", "h", "item", "ih", "total", "at").agg(F.collect_set("hit").alias("hits"))
    # What can't reach the coverage even if every window counts goes first.
    groups = groups.filter(F.aggregate("hits", F.lit(0), lambda acc, x: acc + x["to"] - x["from"]) >= coverage * F.col("total"))
    one = groups.select("id", "h", "item", F.col("total").alias("n_words"), "hits").mapInArrow(_align, f"id {id_type}, h bigint, item {item_type}, n_words int, words bigint, windows bigint, verbatim bigint")
    best = one.groupBy("id", "h", "item").agg(F.max(F.struct((F.col("words") / F.col("n_words")).alias("c"), F.col("windows").alias("k"), (F.col("verbatim") / F.col("n_words") >= coverage).alias("v"))).alias("x"))
    return best.filter(F.col("x.c") >= coverage).select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), F.col("item").alias(item_col), F.col("x.c").alias("coverage"), F.col("x.k").alias("n_windows"), F.col("x.v").alias("verbatim"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the contaminated ones."""
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **how).select(F.col(id_col).alias("bad"), F.col("text_hash").alias("bh")).distinct()
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("h"))
    return boxed.join(bad, F.col("id").eqNullSafe(F.col("bad")) & (F.col("h") == F.col("bh")), "left_anti").select("row.*")
