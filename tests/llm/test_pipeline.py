import ctypes
import gc
import pathlib
import time

import corpus_pipeline
from test_native import brute_mix
from test_pairs import brute_classes, plain

from orrery.llm import mix_sources, queries
from orrery.plans.scratch import Scratch


def test_run_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    toxic = {r["doc_id"] for r in queries.op4_toxicity(spark, sf_dir).filter("predicted = 1").collect()}
    kept = {i: r["text"] for i, r in rows.items() if i not in toxic}
    last = {}
    for i, t in kept.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        last[low] = max(i, last.get(low, i))
    kept = {i: kept[i] for i in last.values()}
    classes = brute_classes(list(kept.items()))
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    bench = [plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i: t for i, t in kept.items() if not any(b in plain(t) for b in bench)}
    want = brute_mix([(i, rows[i]["source"]) for i in clean], mix_sources.WEIGHTS, mix_sources.DEFAULT_WEIGHT, mix_sources.BLOCK_ROWS)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == docs.columns + ["block", "slot", "mix_pos"]
    got = out.collect()
    assert {(r["doc_id"], r["source"]): [(r["block"], r["slot"], r["mix_pos"])] for r in got} == want
    assert all(r["text"] == rows[r["doc_id"]]["text"] for r in got)
    assert len(clean) < len(kept) < len(rows) and toxic


def test_stages_on_odd_rows(spark, sf_dir):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, block int"
    rows = [(None, None, None, None, None, "a", 1), (1, "", "en", "s", 0, "b", 2), (2, "", "en", "s", 0, None, 3), (2, "", "en", "s", 0, None, 3), (3, "word " * 20_000, "en", None, 1, "c", 4)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            n = out.count()
            assert n <= len(given)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                docs = out
        assert sorted(r["doc_id"] for r in out.collect()) == ([2, 3] if given else [])


def test_freed_memory_of_the_driver_goes_back(spark, sf_dir):
    """What the C allocator still holds of freed memory goes to the system when tables settle and as a stage begins."""

    def held(pid="self"):
        return sum(int(x.split()[1]) for x in pathlib.Path(f"/proc/{pid}/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon")) / 1024

    jvm, libc = spark._jvm, ctypes.CDLL(None)
    java = jvm.java.lang.ProcessHandle.current().pid()
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(60_000) for _ in range(2000)]
    buffers = buffers[49::50]  # some stay, so the allocator can't just shorten its heap
    gc.collect()
    jvm.System.gc()
    time.sleep(1)
    before = held(java)
    Scratch(spark).settle()
    assert before - held(java) > 60
    assert len(buffers) == 40

    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        blocks = [libc.malloc(60_000) for _ in range(2000)]
        for b in blocks:
            ctypes.memset(b, 1, 60_000)
        for i, b in enumerate(blocks):
            if i % 50 != 49:
                libc.free(b)
        before = held()
        stage(spark, docs, sf_dir)
        assert before - held() > 60
        for b in blocks[49::50]:
            libc.free(b)
