"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of ORDERS characters of the lower-cased text (all but letters and digits of
ASCII count as a space), hashed to 2^HASH_BITS slots.  From document counts in both classes each slot
gets its smoothed log-count ratio r; the slots with the most significant ratios are kept.  A document's
value for a slot is r * log(1 + count), and a logistic regression with an L2 penalty is fitted on these.

Training uses a bounded sample of labelled rows: of a class of at most ``max_train`` all, of a larger one those
of a range of hashes of their id that holds about nine tenths of ``max_train``.  So the fit, on the driver, costs
the same at every size and holds the whole texts of at most 2 * ``max_train`` rows; the scores are calibrated to
the classes' shares among all labelled rows.  Of the 2^HASH_BITS slots the MAX_FEATURES most significant are
features: a choice of the model, like its orders.  Scoring reads every whole text once, in vectors of bounded
size; the model that goes to the workers has at most MAX_FEATURES weights.

Defined results: null and empty texts get the score of a text without features.  Without labelled rows
of both classes the score is the share of label 1 (0 if there are none).  Labels that repeat an id count
once, toxic if any is.  Repeated rows get equal scores; other columns pass and are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import vectors as V
from orrery.plans.scratch import release

ORDERS, HASH_BITS, MAX_FEATURES, MAX_TRAIN, THRESHOLD = (4, 5, 6), 22, 20_000, 2000, 0.7
CHARS = 1 << 20
_FOLD = np.array([c if chr(c).isalnum() else 32 for c in range(128)], np.uint32)
_slots: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Model:
    slots: np.ndarray  # sorted hash slots, int32
    weights: np.ndarray  # float64, ratio and regression weight multiplied
    bias: float

    def lookup(self) -> np.ndarray:
        """slot -> 1 + number of the feature, 0 if it is none; made once a worker."""
        key = hash((self.slots.tobytes(), self.bias))
        if key not in _slots:
            _slots.clear()
            table = np.zeros(1 << HASH_BITS, np.uint16)
            table[self.slots] = np.arange(1, len(self.slots) + 1)
            _slots[key] = table
        return _slots[key]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, code points with a space around each text, text number of each) of bounded runs."""
    i = 0
    while i < len(texts):
        part, size, first = [], 0, i
        while i < len(texts) and (not part or size < CHARS):
            part.append(f" {(texts[i] or '').lower()} ")
            size += len(part[-1])
            i += 1
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 128, _FOLD[codes & 127], codes)
        yield first, codes, np.repeat(np.arange(len(part)), [len(x) for x in part])


def _grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, slot of each n-gram): the hashes grow by one character at a time."""
    h = np.zeros(len(codes), V.U)
    c = codes.astype(V.U)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = h[:m] * V.U(V._BASE) + c[n - 1 :] + V.U(1)
        if n in ORDERS:
            x = (h ^ (h >> V.U(31))) * V.U(0xD6E8FEB86659FD93)
            yield n, (x >> V.U(64 - HASH_BITS)).astype(np.int32)


def _document_slots(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The different slots of each text."""
    for _, codes, doc in _chunks(texts):
        got = [(s, n) for n, s in _grams(codes)]
        at = np.searchsorted(doc, np.arange(doc[-1] + 2))
        for d in range(doc[-1] + 1):
            yield np.unique(np.concatenate([s[at[d] : max(at[d], at[d + 1] - n + 1)] for s, n in got] or [np.zeros(0, np.int32)]))


def _values(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, log(1 + count)) of the features that occur."""
    rows, cols, vals = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for first, codes, doc in _chunks(texts):
        out = []
        for n, slot in _grams(codes):
            f = table[slot]
            at = np.flatnonzero(f)
            at = at[doc[at] == doc[at + n - 1]]
            out.append(doc[at] << 16 | f[at])
        if out:  # a text lies in one run, so its counts are whole
            key, count = np.unique(np.concatenate(out), return_counts=True)
            rows.append((key >> 16).astype(np.int32) + np.int32(first))
            cols.append((key & 0xFFFF).astype(np.int32) - np.int32(1))
            vals.append(np.log1p(count).astype(np.float32))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def fit(texts: list[str | None], labels: np.ndarray, share: float, **how) -> Model:
    """share: that of label 1 among all labelled rows, to which the scores are calibrated.

    A model without every fourth row of each class (the second of it at least) scores these, and a logistic curve
    over the scores becomes the scale and the intercept of the model of all rows.  The curve is held to the plain
    one (scale 1, no shift) the more, the fewer rows of the smaller class it is fitted on.
    """
    y = np.asarray(labels)
    model = _fit(texts, y, share, **how)
    if not y.sum() or y.all():
        return model
    nth = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) - 1
    test = nth % 4 == 1
    part = _fit([t for t, x in zip(texts, test, strict=True) if not x], y[~test], 0.5, **how)
    row, col, val = _values(rest := [t for t, x in zip(texts, test, strict=True) if x], part.lookup())
    z, t = np.bincount(row, val * part.weights[col], len(rest)) + part.bias, y[test]
    weigh = np.where(t == 1, share / max(t.sum(), 1), (1 - share) / max(len(t) - t.sum(), 1))
    held = 10 / max(1, min(t.sum(), len(t) - t.sum())) ** 2
    start = b = float(np.log(share / (1 - share)))  # the plain curve: part's scores are for even shares
    a = 1.0
    for _ in range(50):  # Newton steps
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        e, h = weigh * (q - t), weigh * q * (1 - q) + 1e-9
        g = np.array([(e * z).sum() + held * (a - 1), e.sum() + held * (b - start)])
        step = np.linalg.solve(np.array([[(h * z * z).sum() + held, (h * z).sum()], [(h * z).sum(), h.sum() + held]]), g)
        a, b = max(0.05, a - step[0]), b - step[1]
    even = model.bias - start
    return Model(model.slots, model.weights * a, float(a * even + b))


def _fit(texts: list[str | None], labels: np.ndarray, share: float, *, steps: int = 150, penalty: float = 1e-3) -> Model:
    y = np.asarray(labels, np.float64)
    n1, n0 = y.sum(), len(y) - y.sum()
    none = np.zeros(0, np.int32)
    if not n1 or not n0:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(none, np.zeros(0), float(np.log(p / (1 - p))))
    df = np.zeros((2, 1 << HASH_BITS), np.uint16 if len(y) < 1 << 16 else np.int32)
    for slots, label in zip(_document_slots(texts), labels, strict=True):
        df[int(label), slots] += 1
    kept = np.flatnonzero(df[0] + df[1] >= min(3, len(y)))
    a, b = df[1, kept] + 1.0, df[0, kept] + 1.0
    del df
    ratio = np.log(a / (n1 + 2)) - np.log(b / (n0 + 2))
    strong = np.argsort(-np.abs(ratio) / np.sqrt(1 / a + 1 / b), kind="stable")[:MAX_FEATURES]
    strong.sort()
    slots, ratio = kept[strong].astype(np.int32), ratio[strong]
    del kept, a, b
    table = np.zeros(1 << HASH_BITS, np.uint16)
    table[slots] = np.arange(1, len(slots) + 1)
    row, col, val = _values(texts, table)
    val *= ratio.astype(np.float32)[col]
    # Both classes weigh the same in the fit; Adam on the whole sample.
    weigh = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, bias = np.zeros(len(slots)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[col], len(y)) + bias
        err = weigh * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(col, val * err[row], len(w)) + penalty * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 + t / 100)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Model(slots, w * ratio, float(bias + np.log(p / (1 - p))))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    table = model.lookup()
    for whole in batches:
        for i in range(0, whole.num_rows, 1000):  # what is made of a batch adds up
            b = whole.slice(i, 1000)
            texts = b.column(b.num_columns - 1).to_pylist()
            row, col, val = _values(texts, table)
            z = np.bincount(row, val * model.weights[col], len(texts)) + model.bias
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=[*b.schema.names[:-1], "score"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """labels: the rows that may be learned from."""
    marks = labels.filter(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("_y"))
    n = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    # A share of the hashes that gives somewhat fewer rows than may be used: no sort, no task that gathers
    # candidates of all others.  The limit is a guard that doesn't bind.
    parts = []
    for y in (0, 1):
        few = n.get(y, 0) <= max_train
        share = 1 << 30 if few else int(0.9 * max_train / n[y] * (1 << 30))
        parts.append(marks.filter((F.col("_y") == y) & (F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share)).limit(max_train))
    sample = parts[0].unionByName(parts[1])  # at most 2 * max_train rows, hence the broadcast
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t")).join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.max("_t").alias("_t")).orderBy("_id").select("_y", "_t").toArrow()
    total = sum(n.values())
    model = fit(rows.column("_t").to_pylist(), rows.column("_y").to_numpy(), n.get(1, 0) / total if total else 0.0)
    del rows
    release(docs.sparkSession)  # of the texts and the vectors of the fit
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: toxic) in place of a column of that name."""
    V.ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != "score"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([rows.schema["row"], StructField("score", DoubleType())])
    return rows.mapInArrow(lambda it: _score(it, shared.value), schema).select("row.*", "score")


def held_out(id_col: str = "doc_id", mod: int = 3):
    """Rows that nothing is learned from: crc32 of the id as text leaves the remainder 1."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % mod == 1


def reject(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the toxic ones; learned from the labels that aren't held out."""
    model = train(docs, labels.filter(~held_out(id_col)), id_col=id_col, text_col=text_col, **how)
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("text"))
    return score(boxed, model).filter(F.col("score") < threshold).select("_row.*")
