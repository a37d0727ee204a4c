import heapq
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from orrery.llm import chat_format, exact_dedup, license_scan, mix_sources, queries, secret_scan

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOC)


def plan(df):
    return df._jdf.queryExecution().toString()


# --- mixing -------------------------------------------------------------------------------------


def brute_mix(rows, weights, default, block_rows):
    """The schedule slot by slot, each block with its own release and deadline."""
    by = {}
    for i, s in rows:
        by.setdefault(s, []).append(i)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    key = lambda i: (hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0)
    blocks = {s: [sorted(by[s], key=key)[j : j + block_rows] for j in range(0, len(by[s]), block_rows)] for s in names}
    left = {s: len(blocks[s]) for s in names}
    w = {s: weights.get(s, default) for s in names}
    out, slot = {}, 0
    while any(left.values()):
        live = [s for s in names if left[s]]
        m = {s: min(w[s], left[s]) for s in live}
        total = sum(m.values())
        done = dict.fromkeys(live, 0)
        for t in range(total):
            ready = [(-((-(done[s] + 1) * total) // m[s]), names.index(s), s) for s in live if done[s] < m[s] and done[s] * total // m[s] <= t]
            due, _, s = heapq.nsmallest(1, ready)[0]
            assert t < due
            block = len(blocks[s]) - left[s]
            for j, i in enumerate(blocks[s][block]):
                out.setdefault((i, s), []).append((block, slot, slot * block_rows + j))
            left[s] -= 1
            done[s] += 1
            slot += 1
            assert all(abs(done[x] - (t + 1) * m[x] / total) < 1 for x in live)
    return out


MIXES = [
    ([(i, "ab c"[i % 3 if i % 7 else 0]) for i in range(200)], {"a": 5, "b": 3}, 1, 4),
    ([(i, None if i % 5 == 0 else "x") for i in range(57)], {"x": 2}, 1, 3),
    ([(1, "a"), (1, "a"), (None, "b"), (2, "b")], {}, 2, 1),
    ([(i, "hot" if i % 3 else f"s{i % 11}") for i in range(500)], {"hot": 7, "s1": 2}, 1, 2),
]


@pytest.mark.parametrize("rows,weights,default,block", MIXES)
def test_mix_against_simulation(spark, rows, weights, default, block):
    df = docs(spark, [(i, f"t{i}", s) for i, s in rows])
    got = mix_sources.mix(df, weights=weights, default_weight=default, block_rows=block).collect()
    found = {}
    for r in got:
        found.setdefault((r["doc_id"], r["source"]), []).append((r["block"], r["slot"], r["mix_pos"]))
    want = brute_mix(rows, weights, default, block)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({r["mix_pos"] for r in got}) == len(rows)


def test_mix_edges(spark):
    assert mix_sources.mix(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "a", "s")]).withColumn("slot", F.lit("x")).withColumn("_s", F.lit("y"))
    row = mix_sources.mix(clash).first()
    assert row["slot"] == 0 and row["_s"] == "y"
    many = docs(spark, [(i, "t", f"s{i}") for i in range(5)])
    with pytest.raises(Exception, match="max_sources"):
        mix_sources.mix(many, max_sources=4).collect()
    with pytest.raises(ValueError):
        mix_sources.mix(many, weights={"a": 0})


def test_mix_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {(r["doc_id"], r["source"]): [(r["block"], r["slot"], r["mix_pos"])] for r in queries.op1_mix_sources(spark, sf_dir).collect()}
    assert got == brute_mix(rows, mix_sources.WEIGHTS, mix_sources.DEFAULT_WEIGHT, mix_sources.BLOCK_ROWS)


def test_every_source_is_within_a_block_of_its_share(spark):
    """Read from the result alone: while all sources have blocks, at each slot |blocks placed - share| < 1."""
    weights = {"a": 7, "b": 5, "c": 3, "d": 2, "e": 1, "f": 1}
    rows = [(i, s) for s, w in weights.items() for i in range(w * 40)]
    got = mix_sources.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), weights=weights, block_rows=2, bucket_rows=16).collect()
    slots = sorted({(r["slot"], r["source"]) for r in got})
    total = sum(weights.values())
    assert [s for s, _ in slots] == list(range(20 * total)) and len(got) == len(rows) == len({r["mix_pos"] for r in got})
    placed = dict.fromkeys(weights, 0)
    for t, s in slots:
        placed[s] += 1
        assert all(abs(placed[x] - (t + 1) * w / total) < 1 for x, w in weights.items())


# --- chat ---------------------------------------------------------------------------------------

LOG = "conv_id bigint, seq bigint, kind string, msg_id string, role string, text string"


def formatted(spark, rows):
    return chat_format.render(chat_format.reconstruct(spark.createDataFrame(rows, LOG)))


def test_fold_of_events(spark):
    rows = [
        (1, 0, "message", "u", "user", "hi"), (1, 1, "delta", "a", "assistant", "wro"), (1, 2, "delta", "a", None, "ng"),
        (1, 3, "regenerate", "a", None, "ignored"), (1, 4, "delta", "a", None, "ri"), (1, 5, "delta", "a", None, "ght"),
        (1, 6, "edit", "u", None, "hello"), (1, 7, "delta", "b", "assistant", "x"), (1, 8, "edit", "b", None, "y"), (1, 9, "delta", "b", None, "z"),
    ]
    import random

    random.Random(5).shuffle(rows)
    out = formatted(spark, rows).first()
    assert out["formatted"] == "### user: hello</turn>\n### assistant: right</turn>\n### assistant: yz</turn>\n"
    assert "".join(out["formatted"][s["start"] : s["end"]] for s in out["loss_mask"]) == "rightyz"


NASTY = ["", "### ", "</turn>", "</turn>\n", "\\", "\\b\\h\\t\\c", "### Assistant: </turn> ok", "#### x", "a: b", "é\U0001f600</turn>", "\\</turn>", "x" * 50_000]


def test_round_trip(spark):
    rows = [(1, i, "message", None, "assistant" if i % 2 else "a: ### b", t) for i, t in enumerate(NASTY)] + [(2, 0, "message", None, None, None), (None, 0, "message", None, "user", "q"), (2, 0, "message", None, None, None)]
    out = {r["conv_id"]: r for r in chat_format.digest(formatted(spark, rows)).collect()}
    turns = "".join(f"{'assistant' if i % 2 else 'a: ### b'}\n{t}\n" for i, t in enumerate(NASTY))
    assert out[1]["n_turns"] == len(NASTY) and out[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    loss = "".join(NASTY[1::2])
    assert out[1]["loss_chars"] == len(loss) and out[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert out[2]["n_turns"] == 2 and out[2]["loss_chars"] == 0 and out[None]["n_turns"] == 1
    assert formatted(spark, []).count() == 0


def test_whole_messages_through_the_fold(spark):
    """A table of messages, told as streamed, given up, typed and edited events, gives its texts back."""
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(2, 0, None, None), (2, 0, "assistant", "abc"), (2, 0, "assistant", "abc"), (2, None, "assistant", "x"), (None, 0, "user", "q")]
    events = chat_format.as_events(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("kind", F.lit("k")).withColumn("at", F.lit(0)))
    assert {r["kind"] for r in events.select("kind").distinct().collect()} == set(chat_format.KINDS)
    events = events.unionByName(events.limit(1).withColumn("kind", F.lit("reaction")))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.reconstruct(events).collect()}
    assert got[1] == [("assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] and got[None] == [("user", "q")]
    assert got[2] == [("assistant", "x"), ("", ""), ("assistant", "abc"), ("assistant", "abc")]


# --- exact dedup --------------------------------------------------------------------------------

COPIES = [(1, "A b", "s"), (2, "a B", "s"), (3, "É", "s"), (4, "é", "s"), (5, None, "s"), (6, "", "s"), (7, "x" * 100_000, "s"), (8, "X" * 100_000, "s"), (9, "one", "s"), (9, "one", "s")]


@pytest.mark.parametrize("hashing", [F.md5, lambda t: F.lit("same"), lambda t: F.char_length(t).cast("string")])
def test_groups_whatever_the_hash(spark, hashing):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    want = {}
    for i, t, _ in COPIES:
        same = [j for j, u, _ in COPIES if low(u) == low(t)]
        want[i] = (max(same), len(same), i == max(same), hashlib.sha256(low(t).encode()).hexdigest())
    got = exact_dedup.exact_groups(docs(spark, COPIES), keep="max", content_hash=hashing).collect()
    assert len(got) == len(COPIES)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want


def test_deduplicate(spark):
    df = docs(spark, COPIES).withColumn("_id", F.lit(1)).withColumn("kept", F.lit("z"))
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5, 7, 9]
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0


# --- secrets ------------------------------------------------------------------------------------

TEXTS = [
    None, "", "password: token: abcdef", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIA0000", "api_key='abc' APIKEY:abcdefg ſecret=abcdef",
    "é\U0001f600 secret = zzzzzzzz; " + "0123456789abcdef" * 3 + "g" + "f" * 23, "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "x" * 30_000 + " passwd=secretsecret " + "y" * 30_000,
    "token=abc=password=xyz123456 tokentoken=qqqqqqq", "passwd=\"\" secret: 'aaaaaa", "eyJabcdefghi.eyJabcdefghi.abcdefghi xoxb-123456789012", "AIza" + "b" * 35 + " sk_live_" + "c" * 16, "kfcpassword", "Token  :  a/b+c==",
]
BASE = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]


def brute_spans(text, rules):
    return [(m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(rules) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]


def test_spans_against_scan(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)] + [(3, TEXTS[4], "s"), (None, TEXTS[3], "s")])
    rules = BASE + [(r.kind, r.pattern, r.group, r.least) for r in secret_scan.MORE]
    got = secret_scan.digest(secret_scan.scan(df)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] not in (3, None):
            spans = sorted(brute_spans(TEXTS[r["doc_id"]], rules))
            name = lambda xs: ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in xs)
            assert r["spans"] == name(spans)
            assert r["base_sha256"] == hashlib.sha256(name([x for x in spans if x[1] < 3]).encode()).hexdigest()
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in spans) for k in range(3)]
    assert [r["n_assign"] for r in got if r["doc_id"] is None] == [1]
    assert secret_scan.scan(docs(spark, [])).count() == 0


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q(r"[0-9a-f]{24,}") == [] and q("ab") == []
    assert q("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert q("(abc|xyz)[0-9]+def") == [[frozenset({"abc"}), frozenset({"xyz"})], [frozenset({"def"})]]
    assert [frozenset({"api", "pik", "ike", "key"}), frozenset({"api", "pi_", "i_k", "_ke", "key"})] == sorted(q("api_?key")[0], key=len)
    for rule in secret_scan.MORE:
        assert q(rule.pattern), rule


# --- licences -----------------------------------------------------------------------------------


def brute_licences(text):
    """Sentences as lists of pieces, found piece by piece; a licence's matches less those of longer rules around it."""
    flat = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    known = {n: [flat(x) for x in re.split(r"[.!?;]+(?=\s|\Z)", s) if flat(x)] for n, s in license_scan.SENTENCES.items()}
    best = {}
    for ends in (r"[.!?;]+(?=\s|\Z)|[\r\n]+", r"[.!?;]+(?=\s|\Z)|[\r\n][\s!-/:-@\[-`{-~]*[\r\n]"):
        pieces = [x for x in map(flat, re.split(ends, text or "")) if x]
        ids, i = [], 0
        while i < len(pieces):
            hit = max((n for n, ps in known.items() if pieces[i : i + len(ps)] == ps), key=lambda n: len(known[n]), default=None)
            ids += [hit] if hit else []
            i += len(known[hit]) if hit else 1

        def times(rule, ids=ids):
            at = 0
            for x in ids:
                at += x == rule[at % len(rule)]
            return at // len(rule)

        for lic, rules in license_scan.RULES.items():
            n = 0
            for rule in rules:
                longer = [r for other, rs in license_scan.RULES.items() if other != lic for r in rs if len(r) > len(rule) and [x for x in r if x in rule] == rule]
                n += max(0, times(rule) - sum(times(r) for r in longer))
            if n:
                best[lic] = max(best.get(lic, 0), n)
    return best


def full(*names):
    return ". ".join(license_scan.SENTENCES[n] for n in names) + "."


LICENCES = [
    None, "", "prose.\nReleased under the MIT License.\nMore", "Licensed under the Apache License, Version 2.0.", full("mit-1", "mit-2", "mit-3"), full("mit-2", "mit-1", "mit-3"), full("mit-1", "mit-2", "mit-3") + " " + full("mit-1", "mit-2", "mit-3"),
    "Permission is hereby granted,\nfree of charge, to", full("bsd-intro", "bsd-1", "bsd-2"), full("bsd-intro", "bsd-1", "bsd-2", "bsd-3"), "x. " * 20_000 + "Licensed under CC BY-NC 4.0.", full("gpl-1", "gpl-2").replace(" any ", "\nany "), "not Released under the MIT License.",
    full("gpl2-1", "gpl-2"), full("lgpl21-1", "lgpl21-2"), full("bsd-intro", "bsd-1", "bsd-2", "bsd-3", "bsd-intro", "bsd-1", "bsd-2"), "x = 1  # SPDX\n# SPDX-License-Identifier: EPL-2.0\n", full("mpl-1").replace("v. 2", "v.\n2"), full("agpl3-1"), full("lgpl3-1"),
]


def test_licences_against_scan(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(LICENCES)]).withColumn("licenses", F.lit(1)).withColumn("_a", F.lit(2)).withColumn("ids", F.lit(3)).withColumn("row", F.lit(4))
    assert {"_a", "ids", "row"} < set(license_scan.scan(df).columns)
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(df).collect()}
    for i, t in enumerate(LICENCES):
        assert got[i] == brute_licences(t), t
    assert got[4] == {"MIT": 1} and got[5] == {} and got[6] == {"MIT": 2} and got[11] == {"GPL-3.0": 1}
    assert license_scan.report(license_scan.scan(docs(spark, []))).count() == 0


def test_native_plans(spark, sf_dir):
    for name, q in queries.queries().items():
        if name.split("_")[0] in ("op1", "op3", "op5", "op9", "op10"):
            assert not re.search("Python|Pandas|Arrow|Cartesian", plan(q(spark, sf_dir))), name


def test_many_secrets_in_one_text(spark):
    """40,000 matches in one text: as many spans, each where its match is, in time that goes with their number."""
    import time

    n, one = 40_000, "token=abcdef "
    df = docs(spark, [(1, "ü" + one * n, "s"), (2, one * 257, "s"), (3, one * 256 + "x", "s")])
    began = time.time()
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(df).collect()}
    assert [(x["start"], x["end"]) for x in got[1]] == [(1 + 13 * i, 13 + 13 * i) for i in range(n)] and time.time() - began < 60
    assert [len(got[i]) for i in (2, 3)] == [257, 256] and got[2][256]["start"] == 256 * 13
