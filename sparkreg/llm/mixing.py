"""Mixing sources to target weights.

Tokens are summed per source, the weights are turned into targets by water
filling under a cap on repetition, and each document is emitted
``floor(rate)`` times plus one copy drawn with probability ``rate -
floor(rate)`` from a hash of its id and its source's seed.  The draws of a
source are independent, so one long document can carry it far from its
target: of ``SEEDS`` seeds each source takes the one whose total comes
nearest, found by one aggregate over (id, source, size).  Only the per-source
table (one row per source) is ever joined back; documents are neither moved
nor gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.llm.common import WORD_RE, as_row, text_or_empty, write_table

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2.0
SEED = "mix-1"
SEEDS = 64
STEPS = 1 << 24                # resolution of a draw
#: Up to this many sources the rate table is broadcast, beyond it joined.
BROADCAST_SOURCES = 100_000


def word_count(col: Column) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD_RE)).cast("long")


def hashes(key: Column, seed: str) -> tuple[Column, Column]:
    """Two numbers below ``STEPS`` from the md5 of the seed and a key; SQL
    engines agree on them."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 6), 16, 10).cast("long") for at in (1, 7))


def drawn(a: Column, b: Column, k: Column, rate: Column) -> Column:
    """Copies of a document by its source's seed ``k``."""
    whole = F.floor(rate)
    return whole + F.when(F.pmod(a + k * b, F.lit(STEPS)) < (rate - whole) * STEPS, 1).otherwise(0)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE,
            max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(src, source_size, target, rate) from per-source sizes (src,
    source_size).  Sources by code point, null last, take the weights in
    turn.  A target stops at ``max_repeat`` times the source; what is left
    over goes to the others by weight: the target is min(cap, level x
    weight) for one common level.

    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    sizes = sizes.withColumn("nr", F.row_number().over(by_name))
    pos = F.pmod(F.col("nr") - 1, F.lit(len(weights))) + 1
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), pos.cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))).withColumn("r", F.col("cap") / F.col("w"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy("r", "nr")
    s = s.withColumn("goal", F.sum("source_size").over(whole) * F.lit(float(total_share)))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
                                        F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("lvl", (F.col("goal") - F.col("full")) / F.col("open"))
    # the level is that of the first source, by rising ratio, which it does not fill
    s = s.withColumn("level", F.min(F.when(F.col("lvl") <= F.col("r"), F.struct("r", "nr", "lvl"))).over(whole)["lvl"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    s = s.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat))))
    return s.select("src", "source_size", "target", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: float = MAX_REPEAT,
        seed: str = SEED) -> DataFrame:
    """One row per input row: ``row`` (the input as a struct), doc_id, size,
    source_size, target, copies (how often the mix takes the document), taken.

    A null text has size 0; a null source is a source of its own, after all
    others.  A null doc_id draws like the empty id; rows that repeat a
    doc_id draw alike.  Sources without words get target 0 and no copies.
    The same table always gives the same mix.
    """
    key, src = F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string")
    size, (a, b) = word_count(F.col(f"`{text_col}`")), hashes(key, seed)
    sized = write_table(docs.select(src.alias("src"), size.alias("size"), a.alias("a"), b.alias("b")), "mix-sizes")
    per = sized.groupBy("src").agg(F.sum("size").cast("long").alias("source_size"))
    t = write_table(targets(per, weights, total_share, max_repeat).withColumnRenamed("src", "tsrc"), "mix-rates")

    def hinted(table):
        return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table

    same = F.col("src").eqNullSafe(F.col("tsrc"))
    totals = (sized.join(hinted(t), same).groupBy("tsrc", "target")
              .agg(*[F.sum(drawn(F.col("a"), F.col("b"), F.lit(k), F.col("rate")) * F.col("size")).alias(f"s{k}")
                     for k in range(SEEDS)]))
    near = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{k}") - F.col("target")).alias("gap"), F.lit(k).alias("k"))
                                 for k in range(SEEDS)]))
    best = write_table(totals.select("tsrc", near["k"].alias("k")), "mix-seeds")
    t = t.join(best.withColumnRenamed("tsrc", "bsrc"), F.col("tsrc").eqNullSafe(F.col("bsrc"))).drop("bsrc")
    d = docs.select(as_row(docs).alias("row"), key.alias("doc_id"), src.alias("src"), size.alias("size"), a.alias("a"),
                    b.alias("b"))
    j = d.join(hinted(t), same, "left")
    copies = drawn(F.col("a"), F.col("b"), F.col("k"), F.col("rate"))
    return j.select("row", "doc_id", "size", "source_size", "target", copies.cast("int").alias("copies"),
                    (copies * F.col("size")).cast("long").alias("taken"))


def emit_copies(docs: DataFrame, **kw) -> DataFrame:
    """The mixed table: every document as often as the mix takes it."""
    m = mix(docs, **kw).where("copies > 0")
    m = m.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return m.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
