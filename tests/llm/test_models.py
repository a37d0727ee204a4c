import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import ppm, queries, toxicity
from orrery.llm import vectors as V


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def remainder(i, mod):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod


# --- language model -----------------------------------------------------------------------------

TEXTS = ["the cat sat on the mat", "The cat ate.", None, "", "zebra\tquux", "éléphant \U0001f600 the", "a" * 300, "the\x0bcat\x0c\r\nsat", "ab" * 20_000]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_rows(rows, order):
    train = [low(t) for i, t in rows if remainder(i, 5) != 1]
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t) + ["\0end"]
    c = {}
    for t in train:
        for w in tok(t):
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    model = ppm.adaptive_log10([low(t).encode() for _, t in rows], order, [t.encode() for t in train] or [])
    out = []
    for (i, t), s in zip(rows, model, strict=True):
        w = tok(low(t))
        out.append((i, remainder(i, 5) == 1, len(w), sum(x in c for x in w), n, sum(math.log10((c.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), s))
    return out


@pytest.mark.parametrize("common,entries", [(65_536, 10**6), (3, 10**6), (2, 10), (5, 600), (5, 1000)])
def test_scores_against_plain_trie(spark, common, entries):
    rnd = random.Random(1)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rnd.choices(["the", "cat", "Sat", "dog", "ñu", "x"], k=12))) for i in range(30)] + [(None, "the end")]
    got = {r["doc_id"]: tuple(r) for r in ppm.score(table(spark, rows), common=common, max_entries=entries).collect()}
    want = brute_rows(rows, ppm.ORDER)
    assert len(got) == len(rows)
    for w in want:
        g = got[w[0]]
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_model_is_the_same_at_every_broadcast_size(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: tuple(r) for r in ppm.score(docs).collect()}
    counts = ppm.count(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    assert ppm.load(counts)[1] == 0 and ppm.load(counts, max_entries=20_000)[1] > 0
    assert sum(len(k) for k in ppm.load(counts, max_entries=20_000)[0].keys) <= 20_000
    monkeypatch.setattr(ppm, "_larger", lambda it: it)
    for entries, batch in ((20_000, 97), (256, 10_000)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r["doc_id"]: tuple(r) for r in ppm.score(docs, max_entries=entries).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got.keys() == want.keys()
        for i, w in want.items():
            assert got[i][:5] == w[:5] and got[i][5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_sum_to_one():
    raw, off = V.batch_texts(pa.array(["abracadabra", "cadabra", "abc"]))
    g, n = np.unique(ppm._grams(raw, off, 3)[0], return_counts=True)
    trie = ppm.build(g, n, 3)
    for ctx in (b"\0\0\0", b"bra", b"xab", b"zzz", b"cad"):
        base = int.from_bytes(ctx, "big") << 8
        assert (10 ** ppm.log10_of(trie, base + np.arange(256))).sum() == pytest.approx(1)


def test_lm_edges(spark):
    assert ppm.score(table(spark, [])).count() == 0
    held = next(i for i in range(100) if remainder(i, 5) == 1)
    row = ppm.score(table(spark, [(held, "ab")])).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["score"] == pytest.approx(-3 * math.log10(256)) and row["base_score"] == pytest.approx(0)
    assert ppm.score(table(spark, [(1, "a"), (1, "a")]).withColumn("rest", F.lit(1))).count() == 2
    assert ppm.adaptive_log10([b"aaaaaaaaaa" * 5])[0] > -50 * math.log10(256) * 0.2


def test_lm_whole_table(spark, sf_dir):
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op8_ppm(spark, sf_dir).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(size) and held and all(r["score"] < 0 for r in got)
    # Under 2.9 bits a byte on texts it has not seen, learned from 160 texts.
    assert -sum(r["score"] for r in held) * math.log2(10) / sum(size[r["doc_id"]] for r in held) < 2.9


# --- toxicity -----------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op4_toxicity(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    rows = [(r["score"], r["toxic"], r["predicted"]) for r in got.join(labels, "doc_id").filter("held_out").collect()]
    pos, neg = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert auc > 0.9
    flagged = [y for _, y, p in rows if p]
    assert sum(flagged) >= 0.9 * len(flagged) and sum(flagged) >= 0.4 * len(pos)
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    assert got.filter("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.7 AS INT)").isEmpty()


def test_toxicity_learns_only_what_it_may(spark):
    rows = [(i, f"word{i % 7} awful" if i % 2 else f"word{i % 7} lovely") for i in range(60)] + [(None, None), (900, ""), (901, "awful " * 40_000), (901, "awful " * 40_000)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60) if remainder(i, 3) != 1] + [(i, 1 - i % 2) for i in range(60) if remainder(i, 3) == 1], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in range(60)) and got[901] > 0.5 and got[900] == got[None]
    kept = toxicity.reject(docs.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r["score"] for r in kept.collect()} == {"mine"}
    plain = toxicity.train(docs, labels.limit(0))
    assert all(r["score"] == pytest.approx(1e-6) for r in toxicity.score(docs, plain).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def plain_slots(text):
    """Slot -> count of a text's n-grams, one at a time."""
    chars = [ord(c) if ord(c) >= 128 or c.isalnum() else 32 for c in f" {(text or '').lower()} "]
    out = {}
    for n in toxicity.ORDERS:
        for i in range(len(chars) - n + 1):
            h = 0
            for c in chars[i : i + n]:
                h = (h * V._BASE + c + 1) % 2**64
            s = ((h ^ (h >> 31)) * 0xD6E8FEB86659FD93 % 2**64) >> (64 - toxicity.HASH_BITS)
            out[s] = out.get(s, 0) + 1
    return out


def test_toxicity_against_plain_ngrams(spark, sf_dir):
    """The features by plain document counts, and every document's score by a plain sum over its n-grams."""
    docs = {r["doc_id"]: plain_slots(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if remainder(r["doc_id"], 3) != 1}
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out()))
    df = ({}, {})
    for i, y in labels.items():
        for s in docs[i]:
            df[y][s] = df[y].get(s, 0) + 1
    n = [sum(y == k for y in labels.values()) for k in (0, 1)]
    strength = {}
    for s in df[0].keys() | df[1].keys():
        a, b = df[1].get(s, 0) + 1, df[0].get(s, 0) + 1
        if a + b - 2 >= 3:
            strength[s] = abs(math.log(a / (n[1] + 2)) - math.log(b / (n[0] + 2))) / math.sqrt(1 / a + 1 / b)
    least = min(strength[s] for s in model.slots.tolist())
    assert len(model.slots) == min(toxicity.MAX_FEATURES, len(strength))
    assert {s for s, v in strength.items() if v > least + 1e-9} <= set(model.slots.tolist())
    weight = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    got = queries.op4_toxicity(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        z = model.bias + sum(weight.get(s, 0.0) * math.log1p(c) for s, c in docs[r["doc_id"]].items())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4, abs=1e-9)
        assert r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (remainder(r["doc_id"], 3) == 1)


@pytest.mark.parametrize("rows", [1, 2, 3, 8, 40, 400])
def test_calibration_at_every_size(rows):
    """Few rows or many, scores are ordered and lie around the share; there is no size at which they jump."""
    rnd = random.Random(rows)
    made = lambda y: " ".join(rnd.choices(["awful", "hate", "stupid", "idiot"] if y else ["kind", "fine", "gentle", "calm"], k=6) + rnd.choices(["the", "of", "and", "day"], k=10))
    labels = np.array([0, 1] * rows)
    model = toxicity.fit([made(y) for y in labels], labels, 0.3)
    row, col, val = toxicity._values(["awful hate stupid", "kind fine gentle", ""], model.lookup())
    bad, good, none = 1 / (1 + np.exp(-(np.bincount(row, val * model.weights[col], 3) + model.bias)))
    assert good <= none <= bad and (rows < 3 or good < 0.3 < bad) and 0 < none < 1


def test_reject_with_other_names(spark):
    rows = [(f"d{i}", ("awful hate stupid idiot " if i % 2 else "kind fine gentle calm ") * 5, i) for i in range(60)]
    df = spark.createDataFrame(rows, "`my id` string, body string, score int").withColumn("text", F.lit("x")).withColumn("_row", F.lit(1))
    labels = df.select("my id", (F.col("score") % 2).alias("toxic"))
    left = toxicity.reject(df, labels, id_col="my id", text_col="body")
    assert left.columns == df.columns and {r["score"] % 2 for r in left.collect()} == {0} and left.count() == 30
