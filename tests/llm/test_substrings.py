"""Repeated substrings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import queries, substring_dedup

LAST = substring_dedup.LAST


def brute(rows, size):
    """(id, bytes, removed, spans, kept) of each row, window by window."""
    least, texts = {}, [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for j in range(len(t) - size + 1):
            w = t[j : j + size]
            least[w] = min(least.get(w, LAST), i)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for j in range(len(t) - size + 1):
            if least[t[j : j + size]] < i:
                gone[j : j + size] = [True] * size
        spans = [j for j, g in enumerate(gone) if g and not (j and gone[j - 1])]
        out.append((i, len(t), sum(gone), len(spans), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


def found(df, size):
    got = substring_dedup.remove_repeats(df, min_bytes=size).collect()
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] == r["n_bytes"] - len(r["kept"])
    return sorted((LAST if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got)


def test_least_ids_of_windows():
    rnd = random.Random(1)
    for trial in range(150):
        size = rnd.choice([1, 2, 3, 5, 8])
        texts = [bytes(rnd.choice(b"ab" if trial % 2 else b"abc\xff\x00") for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(1, 20))] + [b"ab"]
        low = np.array([rnd.randrange(10) for _ in texts])
        want = {}
        for t, i in zip(texts, low.tolist(), strict=True):
            for j in range(len(t) - size + 1):
                want[t[j : j + size]] = min(want.get(t[j : j + size], LAST), i)
        got, _ = substring_dedup.least_ids(texts, low, size)
        assert got.tolist() == [want[t[j : j + size]] for t in texts for j in range(len(t) - size + 1)]


def made_up():
    rnd, rows = random.Random(3), []
    for i in range(120):
        t = " ".join(rnd.choice(["alpha", "béta", "gam", "del ta", "x"]) + str(rnd.randrange(3)) for _ in range(rnd.randrange(60)))
        if rows and rnd.random() < 0.5:
            t = (rnd.choice(rows)[1] or "")[rnd.randrange(30) :] + t
        rows.append((i if rnd.random() < 0.9 else None, t if rnd.random() < 0.95 else None))
    return [*rows, (5, rows[7][1]), (5, rows[7][1]), (900, "ab" * 3000), (901, "ab" * 2000 + "c"), (902, ""), (903, "q" * 49), (904, "q" * 49)]


@pytest.mark.parametrize("size,heavy,bucket", [(50, None, None), (7, None, 1000), (50, 3, 5000), (9, 2, 1000)])
def test_against_brute_force(spark, monkeypatch, size, heavy, bucket):
    """Also with keys cut into windows, and with many small chunks, buckets and transforms."""
    if heavy:
        monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    if bucket:
        for name in ("CHUNK", "BUCKET", "TRANSFORM"):
            monkeypatch.setattr(substring_dedup, name, bucket)
    rows = made_up()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("body", F.lit(1)).repartition(3)
    assert found(df, size) == brute(rows, size)


def test_common_passage(spark):
    """A passage that most documents hold, each between words of its own; the first of them keeps it."""
    passage = "a passage that is longer than fifty bytes and stands in very many documents"
    rows = [(i, f"{i * 7919} before {passage} after {i * 104729}" if i % 3 else f"only {i * 31337}") for i in range(600)]
    got = found(spark.createDataFrame(rows, "doc_id bigint, text string"), 50)
    assert got == brute(rows, 50) and sum(r[2] > 0 for r in got) == 399


def test_query_and_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [(i, n, m, k, hashlib.sha256(b).hexdigest()) for i, n, m, k, b in brute([(r["doc_id"], r["text"]) for r in docs.collect()], 50)]
    got = queries.op11_substring_dedup(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == want
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
