"""Fold construction and splits.

Row order is defined by ``md5('<seed>|' || key)``, which every engine
computes the same way, so a row's fold never depends on partitioning.

Ranks are never computed with a global window.  ``md5_rank`` splits each
group into sub-buckets by the first hex digits of the hash (uniform by
construction), ranks inside a sub-bucket with a bounded window, and adds the
running count of the earlier sub-buckets (a tiny table).  The result equals
``row_number() over (partition by group order by hash) - 1`` exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.operators.profile import quantiles

DEFAULT_SEED = 42
ES_SEED = 7                  # seed of the early-stopping holdout order
ES_VAL_FRAC = 0.10
ES_MIN_TRAIN_ROWS = 20
MAX_ROWS_PER_RANK_TASK = 2_000_000
MAX_PREFIX = 4               # hex digits: at most 65,536 sub-bucket counts per group are ever ordered together
BROADCAST_MAX_ROWS = 1_000_000


def row_hash(key, seed: int | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def _prefix_len(n_rows: int, n_groups: int) -> int:
    per = max(1, n_rows) / max(1, n_groups)
    if per <= MAX_ROWS_PER_RANK_TASK:
        return 1
    return min(MAX_PREFIX, 1 + math.ceil(math.log(per / MAX_ROWS_PER_RANK_TASK, 16)))


def md5_rank(df: DataFrame, key: str, seed, groups: Sequence[str] = (), out: str = "rank",
             n_rows: int | None = None, n_groups: int = 1, counts: DataFrame | None = None) -> DataFrame:
    """0-based rank of each row inside ``groups`` in md5(seed|key) order.
    ``counts`` may pass the (groups, __b, __n) table if already computed."""
    if n_rows is None:
        n_rows = df.count()
    p = _prefix_len(n_rows, n_groups)
    h = "__h"
    b = "__b"
    d = df.withColumn(h, row_hash(key, seed)).withColumn(b, F.substring(F.col(h), 1, p))
    part = list(groups) + [b]
    if counts is None:
        counts = d.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    wo = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1) if groups \
        else Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, F.coalesce(F.sum("__n").over(wo), F.lit(0)).alias("__off"))
    n_off = (16 ** p) * max(1, n_groups)
    if n_off <= BROADCAST_MAX_ROWS:
        offsets = F.broadcast(offsets)
    wr = Window.partitionBy(*part).orderBy(h)
    ranked = d.withColumn("__r", F.row_number().over(wr) - 1)
    return (ranked.join(offsets, on=part, how="inner")
            .withColumn(out, (F.col("__off") + F.col("__r")).cast("bigint"))
            .drop(h, b, "__r", "__off"))


# ---------------------------------------------------------------- W01
def quantile_edges(df: DataFrame, y: str, n_bins: int) -> list[float]:
    probs = [i / n_bins for i in range(n_bins + 1)]
    return sorted({v for v in quantiles(df, {y: (F.col(f"`{y}`"), probs)})[y] if v is not None})


def bin_expr(y: str, edges: Sequence[float]) -> Column:
    """Right-closed bins on unique edges; the minimum falls in bin 0."""
    cnt = sum((F.col(y) > F.lit(float(e))).cast("int") for e in edges[:-1])
    if not isinstance(cnt, Column):
        return F.lit(0)
    return F.greatest(cnt - 1, F.lit(0)) if len(edges) > 1 else F.lit(0)


def quantile_bins(df: DataFrame, y: str, n_bins: int, out: str = "bin") -> DataFrame:
    """``qcut`` with duplicate edges merged."""
    edges = quantile_edges(df, y, n_bins)
    if len(edges) < 2:
        lo_hi = df.agg(F.min(y).alias("a"), F.max(y).alias("b")).first()
        a, b = float(lo_hi["a"]), float(lo_hi["b"])
        if b <= a:
            return df.withColumn(out, F.lit(0))
        edges = [a + (b - a) * i / n_bins for i in range(n_bins + 1)]
    return df.withColumn(out, bin_expr(y, edges))


def fold_plan(n: int, oof: bool = True) -> tuple[int, int]:
    """(k, n_bins): k = 10 if n < 100 else 5 under OOF; k <= n/2; bins =
    min(k, max(2, n/10))."""
    k = 10 if (oof and n < 100) else 5
    k = max(2, min(k, n // 2))
    return k, min(k, max(2, n // 10))


# ---------------------------------------------------------------- W02 / W03
def stratified_folds(df: DataFrame, key: str, y: str, k: int | None = None, seed: int = DEFAULT_SEED,
                     out: str = "fold", oof: bool = True) -> DataFrame:
    """Round-robin inside each target bin in md5 order.  The fold count
    is capped by the smallest bin; below 2 it falls back to plain k-fold."""
    return stratified_folds_k(df, key, y, k, seed, out, oof)[0]


def stratified_folds_k(df: DataFrame, key: str, y: str, k: int | None = None, seed: int = DEFAULT_SEED,
                       out: str = "fold", oof: bool = True) -> tuple[DataFrame, int]:
    """``stratified_folds`` plus the effective fold count.  Before the ranking
    itself come the quantile edges and the (bin, hash prefix) counts, which
    also give the smallest bin."""
    n = df.count()
    kk, n_bins = fold_plan(n, oof)
    if k is not None:
        kk = max(2, min(k, n // 2))
        n_bins = min(kk, max(2, n // 10))
    edges = quantile_edges(df, y, n_bins)
    if len(edges) < 2:
        binned = quantile_bins(df, y, n_bins, out="__bin")
    else:
        binned = df.withColumn("__bin", bin_expr(y, edges))
    p = _prefix_len(n, n_bins)
    counts = (binned.withColumn("__b", F.substring(row_hash(key, seed), 1, p))
              .groupBy("__bin", "__b").agg(F.count(F.lit(1)).alias("__n")))
    smallest = counts.groupBy("__bin").agg(F.sum("__n").alias("c")).agg(F.min("c")).first()[0] or 0
    eff = min(kk, smallest)
    if eff < 2:
        kf = max(2, min(kk, n))
        return kfold(df, key, kf, seed, out=out, n_rows=n), kf
    ranked = md5_rank(binned, key, seed, groups=["__bin"], out="__rk", n_rows=n, n_groups=n_bins, counts=counts)
    return ranked.withColumn(out, (F.col("__rk") % eff).cast("int")).drop("__rk", "__bin"), eff


def kfold_of_rank(rank: Column, n: int, k: int) -> Column:
    """``array_split`` chunking: the first n % k folds hold one row more."""
    q, r = divmod(n, k)
    big = r * (q + 1)
    return F.when(rank < big, (rank / (q + 1)).cast("int")) \
        .otherwise((F.lit(r) + ((rank - big) / max(q, 1)).cast("int"))).cast("int")


def kfold(df: DataFrame, key: str, k: int, seed: int = DEFAULT_SEED, out: str = "fold",
          n_rows: int | None = None) -> DataFrame:
    """Shuffled k-fold of near-equal, contiguous chunks."""
    n = df.count() if n_rows is None else n_rows
    ranked = md5_rank(df, key, seed, out="__rk", n_rows=n)
    return ranked.withColumn(out, kfold_of_rank(F.col("__rk"), n, k)).drop("__rk")


# ---------------------------------------------------------------- W04
def es_holdout(df: DataFrame, key: str, seed: int = ES_SEED, out: str = "is_es") -> DataFrame:
    """10 % (rounded, >= 1) of the training rows flagged for early
    stopping; none when fewer than 20 rows or fewer than 10 would remain."""
    n = df.count()
    n_es = max(1, int(round(n * ES_VAL_FRAC)))
    if n < ES_MIN_TRAIN_ROWS or n - n_es < 10:
        return df.withColumn(out, F.lit(False))
    ranked = md5_rank(df, key, seed, out="__rk", n_rows=n)
    return ranked.withColumn(out, F.col("__rk") < n_es).drop("__rk")


# ---------------------------------------------------------------- W05 / U01
def validation_rows(df: DataFrame, fold: str = "fold", f: int = 0) -> DataFrame:
    return df.filter(F.col(fold) == f)


def training_rows(df: DataFrame, fold: str = "fold", f: int = 0) -> DataFrame:
    """The complement of fold ``f``."""
    return df.filter(F.col(fold) != f)


# ---------------------------------------------------------------- W06
def permute_column(df: DataFrame, key: str, col: str, seed: int, out: str | None = None,
                   n_rows: int | None = None) -> DataFrame:
    """A seeded permutation of ``col`` across rows.  Rows are ordered by
    two hashes; row at rank r of order A receives the value at rank r of
    order B.  Both ranks are bucketed (``md5_rank``), and the value moves
    with an equi-join on rank, so nothing is global."""
    out = out or col
    n = df.count() if n_rows is None else n_rows
    a = md5_rank(df, key, f"{seed}a", out="__ra", n_rows=n)
    b = md5_rank(df.select(key, col), key, f"{seed}b", out="__ra", n_rows=n) \
        .select("__ra", F.col(col).alias("__pv"))
    joined = a.join(b, on="__ra", how="inner").drop("__ra")
    if out == col:
        return joined.drop(col).withColumnRenamed("__pv", col)
    return joined.withColumnRenamed("__pv", out)


# ---------------------------------------------------------------- T04 / T05
def sample_rows(df: DataFrame, key: str, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """Fixed-size seeded sample: the ``n`` smallest hashes
    (TakeOrderedAndProject keeps at most n rows per task)."""
    return df.withColumn("__h", row_hash(key, seed)).orderBy("__h").limit(n).drop("__h")


def preview(df: DataFrame, key: str, n: int = 500) -> DataFrame:
    """The first ``n`` rows by key."""
    return df.orderBy(key).limit(n)
