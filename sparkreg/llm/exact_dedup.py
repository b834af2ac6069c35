"""Exact deduplication by content sort.

Rows are range-partitioned on the normalised bytes: Spark samples splitters
from a bounded sort key (the first characters of the text, then a 64-bit
hash of its length and beginning), each task sorts its range externally, and rows that the sort places
next to each other are compared over the whole text.  Everything runs in
Spark's own operators.

A sort key that more than a given share of the rows hold would make one
range too large, so such hot keys (at most ``1 / hot_share`` of them, found by
counting) get a salt from the doc_id; the sub-runs of their texts, one for
each salt at most, are merged by a second comparison.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.llm.common import as_row, ascii_lower, text_or_empty

#: Characters of the text that take part in the splitters.
KEY_CHARS = 64
#: A sort key is hot when it holds more than this share of all rows and more
#: than HOT_ROWS rows, or more than HOT_MOST rows whatever the share (so there
#: are at most 1 / HOT_SHARE or rows / HOT_MOST hot keys).
HOT_SHARE = 1e-3
HOT_ROWS, HOT_MOST = 50, 100_000
#: Parts of a hot key at least; about HOT_MOST rows fall to a part.
SALTS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = HOT_SHARE,
                hot_rows: int = HOT_ROWS, salts: int = SALTS, rows: bool = False) -> DataFrame:
    """One output row per input row: (doc_id, keep_id, group_size, kept,
    text_sha256), and with ``rows`` also ``row``, the input row as a struct.

    Texts are equal when identical after lower-casing A-Z; a null text is the
    empty text.  Of equal texts the row with the largest doc_id is kept; a
    null doc_id ranks below every other, and of rows that repeat both text
    and doc_id exactly one is kept.  An empty table gives an empty result.
    """
    raw = text_or_empty(F.col(f"`{text_col}`"))
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), raw.alias("raw"),
                      *([as_row(docs, [c for c in docs.columns if c != text_col]).alias("row"),
                         F.col(f"`{text_col}`").isNull().alias("no_text")] if rows else []))
    # the keys need a bounded part of the text only; equal texts have equal keys
    src = (src.withColumn("k", ascii_lower(F.substring("raw", 1, KEY_CHARS)))
           .withColumn("hk", F.xxhash64(F.octet_length("raw"), ascii_lower(F.substring("raw", 1, 4 * KEY_CHARS)))))
    bound = max(hot_rows, min(math.ceil(docs.count() * hot_share), HOT_MOST))
    hot = (src.groupBy("hk").agg(F.count("*").alias("c")).where(F.col("c") > bound)
           .select("hk", F.lit(True).alias("hot"), F.greatest(F.lit(salts), F.ceil(F.col("c") / HOT_MOST)).alias("parts")))
    src = src.join(F.broadcast(hot), "hk", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # rows without an id are told apart by their place
    some = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    src = src.withColumn("salt", F.when(F.col("hot"), F.pmod(some, F.col("parts"))).otherwise(0).cast("int")).drop("parts")

    ranged = src.repartitionByRange("k", "hk", "salt").withColumn("t", ascii_lower(F.col("raw")))
    run = Window.partitionBy("hot", "k", "hk", "salt", "t")   # equals are neighbours in the sorted range
    ordered = run.orderBy(F.col("doc_id").desc_nulls_last())
    local = (ranged.withColumn("rn", F.row_number().over(ordered))
             .withColumn("keep_id", F.max("doc_id").over(run))
             .withColumn("group_size", F.count("*").over(run))
             .withColumn("text_sha256", F.sha2(F.col("t").cast("binary"), 256)))

    keep = [F.col("row"), F.when(~F.col("no_text"), F.col("raw")).alias("raw")] if rows else []
    # sub-runs of the hot texts: one row per salt and text
    sub = local.where("hot").where("rn = 1").select("text_sha256", "t", F.col("keep_id").alias("kid"),
                                               F.col("group_size").alias("n"))
    whole = Window.partitionBy("text_sha256", "t")
    merged = (sub.select("text_sha256", F.max("kid").over(whole).alias("kid"), F.sum("n").over(whole).alias("n"))
              .groupBy("text_sha256").agg(F.max("kid").alias("kid"), F.max("n").alias("n")))
    out = local.drop("t", "k", "hk").join(merged, "text_sha256", "left")
    keep_id = F.when(F.col("hot"), F.col("kid")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep_id.alias("keep_id"),
                      F.coalesce(F.col("n"), F.col("group_size")).cast("long").alias("group_size"),
                      ((F.col("rn") == 1) & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
                      "text_sha256", *keep)


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all their
    columns as they were."""
    out = exact_dedup(docs, id_col, text_col, rows=True).where("kept")
    return out.select(*[F.col("raw").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)
                        for c in docs.columns])
