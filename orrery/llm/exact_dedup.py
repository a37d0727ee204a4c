"""Exact deduplication: group by a 128-bit content hash, compare bytes inside the groups.

The aggregation key is (hash, text): rows meet by hash, and a group forms only of rows whose bytes
are equal, so a collision of the hash parts into its texts.  Partial aggregation folds the copies
within each map task before the shuffle; a text held by a third of all rows arrives as one row a
task.  Each row then finds its group by the pair (128-bit hash, SHA-256); that join is on narrow rows,
and skew in it is split by AQE (neither side is aggregated above it).

Defined results: null text is the empty text; empty texts are equal to each other.  A null id is less
than any other.  Rows that repeat both id and text are one document: all have kept = true in
``exact_groups``, and ``deduplicate`` returns one of them.  Empty tables give empty results; other
columns, whatever their names, pass through ``deduplicate`` unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else changed; null is the empty text."""
    t = F.coalesce(text, F.lit(""))
    # lower() agrees with this on texts of single-byte characters, and is far cheaper there.
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _groups(docs: DataFrame, id_col: str, text_col: str, keep: str, content_hash: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.col(text_col)).alias("_t")).withColumn("_h", content_hash(F.col("_t")))
    best = {"min": F.min, "max": F.max}[keep]("_id")
    groups = rows.groupBy("_h", "_t").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    return groups.select("_h", F.sha2("_t", 256).alias("_s"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), keep: str = "min", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, and the carried columns.

    keep: 'min' or 'max', which id of a group stays.
    """
    rows = docs.select(F.col(id_col), *[F.col(c) for c in carry if c != id_col], ascii_lower(F.col(text_col)).alias("_t"))
    rows = rows.withColumns({"_h": content_hash(F.col("_t")), "text_sha256": F.sha2("_t", 256)}).drop("_t")
    g = _groups(docs, id_col, text_col, keep, content_hash).withColumnRenamed("_h", "_gh")
    out = rows.join(g, (F.col("_h") == F.col("_gh")) & (F.col("text_sha256") == F.col("_s")))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))).drop("_h", "_gh", "_s")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    boxed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    got = exact_groups(boxed, id_col="_id", text_col="_text", carry=("_row",), keep=keep).filter("kept")
    once = got.filter("group_size = 1").select("_row").unionByName(got.filter("group_size > 1").dropDuplicates(["_id", "text_sha256"]).select("_row"))
    return once.select("_row.*")
