import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import decontaminate as D
from orrery.llm import near_dedup as N
from orrery.llm import queries


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def plain(text):
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" or ord(c) >= 128 else " " for c in (text or "").lower()).split())


def kmers_of(text, k=5):
    """Labelled k-mers of plain words."""
    w = text.split(" ") if text else []
    k, seen, out = min(k, len(w)), defaultdict(int), []
    for i in range(len(w) - k + 1 if w else 0):
        g = tuple(w[i : i + k])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def brute_classes(rows, least=0.8):
    """Classes of all pairs that share a k-mer, linked by the full (not banded) common subsequence."""
    mers = {i: kmers_of(plain(t)) for i, t in rows}
    by = defaultdict(set)
    for i, m in mers.items():
        for x in m or ["empty"]:
            by[x].add(i)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for g in by.values() for a in g for b in g if a < b}:
        if find(a) == find(b):
            continue
        x, y = mers[a], mers[b]
        if x == y or (min(len(x), len(y)) >= least * max(len(x), len(y)) and full_similarity(x, y) >= least - 1e-12):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in root}


def full_similarity(x, y):
    prev = [0] * (len(y) + 1)
    for u in x:
        cur = [0]
        for j, v in enumerate(y):
            cur.append(prev[j] + 1 if u == v else max(prev[j + 1], cur[-1]))
        prev = cur
    return prev[-1] / (len(x) + len(y) - prev[-1])


def test_alignment_against_full_table():
    rnd = random.Random(3)
    for _ in range(150):
        a = [rnd.choice("abcdef") + rnd.choice("xyz") for _ in range(rnd.randint(1, 60))]
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            p = rnd.randrange(len(b) + 1)
            b[p : p + rnd.randint(0, 2)] = [rnd.choice("qrst")] * rnd.randint(0, 2)
        x, y = kmers_of(" ".join(a)), kmers_of(" ".join(b))
        want = full_similarity(x, y) if x and y else 0
        number = {g: i for i, g in enumerate(dict.fromkeys(x + y))}
        assert N.similarity(*(np.array([number[g] for g in z], np.uint64) for z in (x, y))) == pytest.approx(want if want >= 0.8 - 1e-12 else 0)


def near_rows():
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    passage = rnd.choices(vocab, k=60)
    for _ in range(40):
        base = rnd.choices(vocab, k=rnd.randint(30, 250))
        for _ in range(rnd.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 1
    for _ in range(60):  # clean texts that share a passage
        rows.append((n, " ".join(rnd.choices(vocab, k=60) + passage + rnd.choices(vocab, k=40))))
        n += 1
    hot = rnd.choices(vocab, k=120)
    for _ in range(80):
        w = list(hot)
        w[rnd.randrange(120)] = rnd.choice(vocab)
        rows.append((n, " ".join(w)))
        n += 1
    extra = [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "a b"), (n + 4, "A, b!"), (n + 5, "a b c"), (n + 6, "ab " * 60_000), (n + 7, "ab " * 60_001)]
    rnd.shuffle(rows)
    return rows + extra


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    small = rows[:-2]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(table(spark, small)).collect()}
    assert got == brute_classes(small)
    full = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(table(spark, rows[-8:])).collect()}
    assert full[rows[-1][0]] == full[rows[-2][0]] and full[rows[-8][0]] == full[rows[-6][0]]


def test_near_duplicates_missed_by_sketches(spark):
    """With one table of sketches most links come from the exact pass alone."""
    rows = near_rows()[:-2]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(table(spark, rows), tables=1).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op6_near_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


def test_kmers_of_all_rows_are_counted(spark, monkeypatch):
    """Every row counts, whatever its hash and wherever a task cuts what it holds."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 40))) for _ in range(300)] + ["one two three four five six seven"] * 21 + [None]
    docs = table(spark, list(enumerate(texts)))
    mers = np.concatenate(list(N._texts_mers(pa.array([plain(t) for t in texts]), 5)))
    want = np.zeros(1 << N.COUNT_BITS, np.uint8)
    for h, c in zip(*np.unique(mers, return_counts=True), strict=True):
        spot = int(h) >> (64 - N.COUNT_BITS)
        want[spot] = max(want[spot], int(np.log2(c)))
    assert want.max() == 4
    for most in (N.COUNTED, 7):
        monkeypatch.setattr(N, "COUNTED", most)
        assert (N.rough_counts(docs, "text", 5) == want).all()
    assert not N.rough_counts(table(spark, []), "text", 5).any()


def test_near_edges(spark):
    assert N.near_duplicates(table(spark, [])).count() == 0
    rows = [(None, "x y z"), (4, "x y z"), (4, "x y z"), (5, "other words here are some more")]
    df = table(spark, rows).withColumn("sig", F.lit(1)).withColumn("keys", F.lit("k")).withColumn("_gone", F.lit(1)).withColumn("row", F.lit("r")).withColumn("words", F.lit(2))
    got = N.near_duplicates(df).collect()
    assert len(got) == 4 and {(r["doc_id"], r["class_id"], r["class_size"]) for r in got} == {(None, 4, 3), (4, 4, 3), (5, 5, 1)}
    kept = N.deduplicate(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 4, 5]


def test_components(spark):
    e = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["root"] for r in N.components(e).collect()}
    assert got == {**{f"{i:03d}": "000" for i in range(41)}, "x": "x", "y": "x"}


ITEM = "A train leaves Paris at 9 with 120 people and after 45 km it meets another train from Lyon with 30 people; how many people does Anna count in both trains together?"
OTHER = "Compute the sum of the first hundred odd integers and then divide the result by the number of primes below thirty."
SHORT = "Seven brave foxes chased butterflies"


def test_decontamination(spark):
    swap = ITEM.replace("Paris", "Rome").replace("Lyon", "Milan").replace("120", "77").replace("30", "12").replace("45 km", "60 miles").replace("9", "5").replace("Anna", "Otto")
    broken = ITEM.replace("train from Lyon", "train from Paris").replace("30 people", "120 people")
    pad = "some filler words stand here before. "
    docs = [
        (1, pad + ITEM), (2, pad + swap + " and after"), (3, pad * 20), (4, None), (5, ""), (6, OTHER.upper()), (7, pad + SHORT.lower() + " today"), (8, "x " * 50_000 + ITEM + " y" * 50_000), (9, ITEM[:40]),
        (10, ("1 2 3 4 5 6 7 8 9 " * 20)), (1, pad + ITEM), (1, "another text of the same id"), (None, swap), (11, broken),
    ]
    bench = spark.createDataFrame([(100, ITEM), (101, OTHER), (102, SHORT), (103, None), (104, "two words"), (100, ITEM)], "item_id bigint, text string")
    df = table(spark, docs).withColumn("h", F.lit(1)).withColumn("size", F.lit(2))
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in D.contaminated(df, bench).collect()}
    assert {k: v for k, v in got.items() if k[0] != 11} == {(1, 100): True, (2, 100): False, (6, 101): True, (7, 102): True, (8, 100): True, (None, 100): False}
    shuffled = {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench, broadcast_windows=0).collect()}
    assert shuffled == set(got)
    left = D.decontaminate(df, bench)
    assert left.columns == df.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:7]) for r in left.filter("doc_id <> 11").collect()) == [(1, "another"), (3, "some fi"), (4, ""), (5, ""), (9, ITEM[:7]), (10, "1 2 3 4")]
    for a, b in ((table(spark, []), bench), (df, bench.limit(0))):
        assert D.contaminated(a, b).count() == 0
    assert D.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_inconsistent_slots(spark):
    item = "then Paris sent 12 wagons to Lyon and then Paris sent 12 wagons to Lyon and then Paris sent 12 wagons to Lyon"
    ok, bad = item.replace("Paris", "Rome").replace("12", "55"), item.replace("Paris", "Rome", 1).replace("12", "55", 1).replace("Lyon", "Nice", 1).replace("Paris", "Bonn", 1).replace("12", "66", 1)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r["doc_id"] for r in D.contaminated(table(spark, [(1, ok), (2, bad)]), bench).collect()}
    assert got == {1}


WORD = re.compile(r"[0-9](?:[.,](?=[0-9])|[0-9a-zA-Z\x80-\U0010ffff])*|[a-zA-Z\x80-\U0010ffff](?:[0-9](?:[.,](?=[0-9]))?|[a-zA-Z\x80-\U0010ffff])*")


def brute_tokens(text):
    """(words, tokens): a token is (first word, end, what it is looked up by, its value or None)."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    raw = WORD.findall(text or "")
    words, out, i = [low(w) for w in raw], [], 0
    kind = lambda w: "#" if low(w) in D.NUMBER_WORDS or re.fullmatch("[0-9.,]+", w) else "@" if "A" <= w[0] <= "Z" or "\xc0" <= w[0] <= "\xde" else ""
    while i < len(raw):
        k, j = kind(raw[i]), i + 1
        while k and j < len(raw) and kind(raw[j]) == k:
            j += 1
        if not k and out and out[-1][2] == "<#>" and words[i] in D.UNITS:
            out.append((i, j, "<unit>", ("unit", words[i])))
        else:
            out.append((i, j, f"<{k}>" if k else words[i], (k, *words[i:j]) if k else None))
        i = j
    return words, out


def brute_windows(text, sizes, window=0):
    words, tokens = brute_tokens(text)
    token_of = [n for n, t in enumerate(tokens) for _ in range(t[0], t[1])]
    for size in sizes:
        if not window or (len(words) >= D.MIN_WORDS and (len(words) == size if size < window else len(words) >= size)):
            for k in range(len(words) - size + 1):
                yield True, size, token_of[k], k, k + size, tuple(words[k : k + size]), (), not any(t[3] for t in tokens[token_of[k] : token_of[k + size - 1] + 1])
        if not window or (len(words) >= D.MIN_WORDS and (len(tokens) == size if size < window else len(tokens) >= size)):
            for k in range(len(tokens) - size + 1):
                part = tokens[k : k + size]
                values = tuple(t[3] for t in part if t[3])
                if values and size - len(values) >= 2:
                    yield False, size, k, part[0][0], part[-1][1], tuple(t[2] for t in part), values


def brute_contaminated(docs, items):
    index, total = defaultdict(list), {}
    for item, text in items:
        total[item] = len(brute_tokens(text)[0])
        for w in brute_windows(text, range(2, D.WINDOW + 1), D.WINDOW):
            index[w[0], w[1], w[5]].append((item, w))
    out = {}
    for doc, text in docs:
        groups = defaultdict(list)
        for d in brute_windows(text, {k[1] for k in index}):
            for item, w in index.get((d[0], d[1], d[5]), ()):
                for g in (0, 1):
                    groups[item, g, (d[2] - w[2] + g * D.BAND // 2) // D.BAND].append((w, d))
        for (item, _, _), hits in groups.items():
            votes = Counter(p for p in {(w[3], w[4], d[3], d[4], a, b) for w, d in hits for a, b in zip(w[6], d[6], strict=True)} for p in [p[4:]])
            there, back = {}, {}
            # Ties fall as they may: the operator breaks them by hashes.
            for a, b in sorted(votes, key=lambda v: -votes[v]):
                if a not in there and b not in back:
                    there[a], back[b] = b, a
            for literal in (False, True):
                ok = [(w, d) for w, d in hits if (w[0] and (literal or w[7])) or (not w[0] and not literal and all(there.get(a) == b for a, b in zip(w[6], d[6], strict=True)))]
                n = min(len({x for h in ok for x in range(h[side][3], h[side][4])}) for side in (0, 1)) if ok else 0
                if n >= D.COVERAGE * total[item]:
                    out[doc, item] = out.get((doc, item), False) or literal
    return out


def test_decontamination_whole_table(spark, sf_dir):
    rows = {t: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))}
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in queries.op2_decontaminate(spark, sf_dir).collect()}
    want = brute_contaminated(rows["documents"], rows["benchmark"])
    # An item that stands twice in a text may reach the coverage verbatim in one place and not in another.
    assert got.keys() == want.keys() and want and all(want[k] for k, v in got.items() if v)


NAMES = "Alice Bob Carol David Emma Frank Grace Henry Ivy Jack Karen Leo Mona Nick Olga Paul Rosa Sam Tina Victor".split()
PLACES = ["Paris", "New York", "Rome", "San Francisco", "Lyon", "Rio de Janeiro", "Oslo", "Buenos Aires"]
SHAPES = [
    "{A} has {n} apples. {B} gives {A2} {m} more. {A} eats {k} of them. How many apples does {A} have left?",
    "A train leaves {P} at {n} with {m} people and after {k} {u} it meets another train from {Q}; how many people does {B} count in both trains together?",
    "A class has {x} boys and {y} girls. If {z} of them leave for lunch, how many children are still in the room with {A}?",
    "{A} buys {n} {u} of rice for {m} dollars and {B} buys {k} {u} of beans. What does {A} pay for each of the bags?",
    "Compute {n} + {m} * {k} and then divide the result by {m} plus {n}; round down.",
    "{A} and {B} travel from {P} to {Q}. {A} drives {n} {u} in {m} hours, while {B} needs {k} hours. Who is faster?",
    "In {P} there are {n} houses with {m} windows each, painted by {A}.",
]


def made(rnd, shape):
    a, b = rnd.sample(NAMES, 2)
    p, q = rnd.sample(PLACES, 2)
    n, m, k = rnd.sample(range(2, 4000), 3)
    x, y, z = rnd.sample([w for w in D.NUMBER_WORDS if w not in ("zero", "one")], 3)
    return shape.format(A=a, A2=a, B=b, P=p, Q=q, n=n, m=m, k=k, x=x, y=y, z=z, u=rnd.choice(["km", "miles", "kg", "pounds", "litres"]))


def test_recall_of_reparameterised_items(spark):
    """Other names, numbers and units, with words around them: nearly all are caught, and nothing else."""
    rnd = random.Random(5)
    items = [(i, made(rnd, s)) for i, s in enumerate(SHAPES)]
    vocab = [f"word{i}" for i in range(400)] + NAMES + [str(i) for i in range(50)]
    docs, want = [], set()
    for i in range(300):
        j = i % len(SHAPES)
        docs.append((i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 60))) + ". " + made(rnd, SHAPES[j]) + " Then " + " ".join(rnd.choices(vocab, k=rnd.randint(0, 60)))))
        want.add((i, j))
    docs += [(1000 + i, " ".join(rnd.choices(vocab, k=200))) for i in range(300)]
    got = D.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found == set(brute_contaminated(docs, items))
    assert len(found & want) >= 0.9 * len(want) and not found - want
