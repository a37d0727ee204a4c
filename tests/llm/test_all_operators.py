"""Every operator on nulls in all columns, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from orrery.llm import chat_format, decontaminate, exact_dedup, html_text, license_scan, mix_sources, near_dedup, ppm, secret_scan, source_divergence, substring_dedup, toxicity, vector_codes

LONG = "word salad " * 100_000
ROWS = [
    (1, "a plain text of some words that is here twice", "x", 0), (1, "a plain text of some words that is here twice", "x", 0), (2, "A plain text of some words that is here twice", None, 1),
    (None, None, None, None), (3, "", "y", 1), (4, LONG, "y", 0), (5, LONG + "end", "y", 0), (6, "Is 7 a prime number, and how many apples does Tom have?", "x", None), (7, "</turn> \\ ### a: <p", "x", 0),
]
CLASH = "_id _t _h _s _k _b _p _o _n _i _a _b2 _row _text row id h wh item sig keys words norm gone bad n c a b t at key sim root size spans tail log _".split()
BENCH = [(1, "Is 9 a prime number, and how many apples does Ann have?"), (1, "Is 9 a prime number, and how many apples does Ann have?"), (None, None), (2, "")]


def odd(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, toxic int")
    return df.withColumns({c: F.lit(None).cast("string") if i % 3 else F.lit(i) for i, c in enumerate(CLASH)})


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id bigint, text string").withColumn("id", F.lit(1)).withColumn("to", F.lit("x"))


# Operator -> (what it is called with, the columns that it keeps are those of the table, rows from the table above)
OPERATORS = {
    "mix": (lambda s, d: mix_sources.mix(d), True, 9),
    "decontaminate": (lambda s, d: decontaminate.decontaminate(d, bench(s)), True, 8),
    "chat": (lambda s, d: chat_format.digest(chat_format.render(chat_format.reconstruct(chat_format.as_events(d, "doc_id", "toxic", "source", "text")))), False, 8),
    "toxicity": (lambda s, d: toxicity.reject(d, d.select("doc_id", "toxic"), threshold=1.1), True, 9),
    "exact dedup": (lambda s, d: exact_dedup.deduplicate(d), True, 6),
    "near dedup": (lambda s, d: near_dedup.deduplicate(d), True, 6),
    "html": (lambda s, d: html_text.extract(d, html_col="text", out_col="main"), False, 9),
    "ppm": (lambda s, d: ppm.score(d), False, 9),
    "secrets": (lambda s, d: secret_scan.scan(d), False, 9),
    "licences": (lambda s, d: license_scan.scan(d), True, 9),
    "substrings": (lambda s, d: substring_dedup.remove_repeats(d), False, 9),
    "codes": (lambda s, d: vector_codes.compress(d.withColumn("v", F.expr("array(toxic, doc_id)").cast("array<double>")), id_col="doc_id", vector_col="v", label_col="source", parts=2)[0], False, 7),
    "divergence": (lambda s, d: source_divergence.audit(d.withColumn("lang", F.lit(None).cast("string")), min_docs=2), False, 28),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    run, keeps, rows = OPERATORS[name]
    df = odd(spark, ROWS)
    out = run(spark, df)
    assert out.count() == len(out.collect()) == rows
    if keeps:
        assert set(df.columns) <= set(out.columns)
    assert run(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["mix", "decontaminate", "exact dedup", "near dedup", "licences"])
def test_ids_keep_their_type(spark, name):
    """Ids of strings, as other corpora have them."""
    df = odd(spark, [(i, t, s, y) for i, t, s, y in ROWS if t != LONG]).withColumn("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    out = OPERATORS[name][0](spark, df)
    assert dict(out.dtypes)["doc_id"] == "string" and out.filter("doc_id = 'doc/3'").count() == 1
