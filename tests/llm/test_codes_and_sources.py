"""Vector codes and the source divergence audit against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import source_divergence, vector_codes

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain_codes(rows, parts, entries, rounds):
    """{row number: (codes, error)} and the codebooks, by loops over integers."""
    good = [(i, v, y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0))
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v, _ in good]
    w = len(ints[0]) // parts
    cut = [[x[p * w : p * w + w] for p in range(parts)] for x in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(p, c[p])[1] for c in cut]
            books[p] = [[sum(col) // len(col) for col in zip(*[c[p] for c, o in zip(cut, of, strict=True) if o == k], strict=True)] or e for k, e in enumerate(books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    label = Counter()
    for (_, _, y), f in zip(good, found, strict=True):
        label[y] += sum(d for d, _ in f)
    out = [(i, y, bytes(k for _, k in f), sum(d for d, _ in f), label[y]) for (i, _, y), f in zip(good, found, strict=True)]
    return sorted(out, key=repr), books


@pytest.mark.parametrize("parts,entries,rounds", [(2, 4, 6), (4, 16, 2), (1, 3, 0)])
def test_codes_against_loops(spark, monkeypatch, parts, entries, rounds):
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([rnd.gauss(0, 1), 0.25, -0.25]) for _ in range(8)], rnd.choice([None, 0, 1])) for i in rnd.sample(range(1000), 90)]
    rows += [rows[3], rows[3], (None, [0.5] * 8, None), (2000, None, 1), (2001, [0.1] * 7 + [None], 1), (2002, [0.1] * 7 + [float("nan")], 1), (2003, [float("-inf")] + [0.1] * 7, 1), (2004, [], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"id": F.lit("x"), "codes": F.lit(1), "v": F.lit(2)}).repartition(5)
    got, books = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    want, want_books = plain_codes(rows, parts, entries, rounds)
    assert sorted(((r["vec_id"], r["label"], bytes(r["codes"]), r["error"], r["label_error"]) for r in got.collect()), key=repr) == want
    assert books.tolist() == want_books


def test_codes_of_odd_tables(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0], None), (1, [1.0, 2.0], None), (2, [1.0, 2.0, 3.0, 4.0], 3), (3, [1.0], 3)], VECTORS)
    got, books = vector_codes.compress(few, parts=2)
    assert [(r["vec_id"], bytes(r["codes"]), r["error"], r["label_error"]) for r in got.collect()] == [(1, b"\0\0", 0, 0)] * 2 and books.shape == (2, 2, 1)
    for empty in (few.limit(0), few.filter("vec_id = 3")):
        got, _ = vector_codes.compress(empty, parts=2)
        assert got.count() == 0 and got.columns == ["vec_id", "label", "codes", "error", "label_error"]
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30, 0.0], 1)], VECTORS), parts=2)[0].count()


def plain_audit(rows, min_docs, top):
    docs = [(x or "", s or "", re.findall(source_divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for x, s, t in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        df, count = Counter(), {}
        for x, s, terms in docs:
            if x == lang:
                df.update(set(terms))
                count.setdefault(s, Counter()).update(terms)
        kept = [t for t in df if df[t] >= min_docs]

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in count:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in count if o != s]
            own = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                out += [(lang, s, part, t, -v, k) for k, (v, _, t) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs,top,block,held", [(3, 200, 4096, 300_000), (2, 4, 4, 5), (1, 3, 1, 1), (99, 5, 8, 9)])
def test_audit_against_loops(spark, monkeypatch, min_docs, top, block, held):
    for name, x in (("BLOCK", block), ("HELD", held), ("PIECE", 11)):
        monkeypatch.setattr(source_divergence, name, x)
    rnd = random.Random(9)
    words = ["Été", "été", "a", "B", "b", "cc3dd", "日本", "x_y", "ÀB", "q\x00r", "same", "Z"] + [f"t{chr(97 + i)}" for i in range(26)]
    rows = [(rnd.choice(["en", "fr", None, ""]), rnd.choice(["s0", "s0", "s0", "s1", "é", None, "S0"]), " ".join(rnd.choice(words) for _ in range(rnd.randrange(12)))) for _ in range(90)]
    rows += [("de", "alone", "a b a b"), ("xx", "u", None), ("xx", "v", ""), ("xx", "w", "12 !"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit(1), "term": F.lit("x"), "docs": F.lit(None).cast("int"), "vector": F.lit(0)})
    got = sorted(map(tuple, source_divergence.audit(df.repartition(4), min_docs=min_docs, top=top).collect()))
    assert got == plain_audit(rows, min_docs, top)


def test_audit_of_long_and_empty(spark):
    rows = [("en", s, "long text of words " * 60_000 + s) for s in ("a", "b")] + [("en", "a", "long " * 3), ("en", "c", "words")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, source_divergence.audit(df, min_docs=2).collect())) == plain_audit(rows, 2, 200)
    assert source_divergence.audit(df.limit(0)).count() == 0


def test_shares_do_not_overflow():
    c, n = np.array([10**12, 0, 5 * 10**12]), np.array([6 * 10**12, 1, 6 * 10**12])
    assert source_divergence.shares(c, n, 1000).tolist() == [1 + 10**9 * (a + 1) // (b + 1000) for a, b in zip(c.tolist(), n.tolist(), strict=True)]
