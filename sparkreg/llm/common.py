"""Helpers shared by the training-data operators: text normalisation,
tables in the shared folder, and connected components over edge tables."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreg.session import ensure_checkpoint_dir, ship_package

#: A word is a run of characters other than the space and U+0009..U+000D.
WORD_RE = r"[^\x20\x09-\x0D]+"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character is left as it is."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


#: Rows of an Arrow batch: rows that hold whole documents are large.
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    """Shared folder known, package importable by the executors' Python, and
    smaller Arrow batches where the session has Spark's default."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the
    lineage is cut, and the rows survive the loss of any executor."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_row(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """All columns of ``df`` in one struct, so that columns an operator adds
    cannot clash with those of its input."""
    return F.struct(*[F.col(f"`{c}`") for c in (columns or df.columns)])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (u, v); root is the
    smallest node that is reachable.

    Alternates large-star and small-star rounds.  A round is two joins on
    the node, whose hot keys the skew join splits; nothing is gathered per
    node, and each round's edges are written to the shared folder.
    """
    e = (edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = write_table(e, "cc-edges")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select("u", "v", "m")
        e = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
             small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = write_table(e, "cc-edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == seen:
            return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
        seen = (now["n"], now["s"])
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
