"""Categorical encoders (F07 specs, A07, J01, J04, M19).

Encoder maps are DataFrames ``(class, value)``.  They join back with a
broadcast only when their row count is known and below a bound; otherwise
the join shuffles (AQE splits a hot class on the big side).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.functions.scalar import NAN_CLASS, null_to_sentinel, safe_name

TE_SMOOTHING = 20.0            # fixed: pseudo-count of the smoothed mean
BROADCAST_MAX_BYTES = 64 << 20 # estimated size of a lookup that is shipped to every task
CLASS_BYTES = 64               # of that, for the class of a row (see category_count)


def join_lookup(df: DataFrame, lookup: DataFrame, on, n_lookup: int | None, how: str = "left") -> DataFrame:
    """Equi-join a small lookup; broadcast only behind a check of its size in
    bytes: rows times the class and eight bytes for every other column."""
    if n_lookup is not None and n_lookup * (CLASS_BYTES + 8 * len(lookup.columns)) <= BROADCAST_MAX_BYTES:
        lookup = F.broadcast(lookup)
    return df.join(lookup, on=on, how=how)


def onehot_classes(df: DataFrame, col: str) -> list[str]:
    """Sorted class list of a (<= 10 class) column, ``__NaN__`` included."""
    rows = df.select(null_to_sentinel(F.col(col)).alias("c")).distinct().collect()
    return sorted(r["c"] for r in rows)


def onehot_name(col: str, cls: str) -> str:
    return safe_name(f"{col}=={cls}")


def onehot_columns(col: str, classes: Sequence[str]):
    s = null_to_sentinel(F.col(f"`{col}`"))
    return [(s == F.lit(k)).cast("double").alias(onehot_name(col, k)) for k in classes]


# ---------------------------------------------------------------- A07 / J01
def target_encoder_fit(df: DataFrame, col: str, y: str, smoothing: float = TE_SMOOTHING
                       ) -> tuple[DataFrame, float]:
    """Smoothed class mean (n*mean + s*g)/(n + s); default g = global
    mean.  Returns the (class, value) map lazily and the default."""
    g = df.agg(F.avg(y).alias("g")).first()["g"]
    g = 0.0 if g is None else float(g)
    m = (df.groupBy(null_to_sentinel(F.col(col)).alias("class"))
         .agg(F.count(F.col(y)).alias("n"), F.sum(y).alias("s"))
         .select("class", ((F.col("s") + F.lit(smoothing * g)) / (F.col("n") + F.lit(smoothing))).alias("value")))
    return m, g


def target_encode_apply(df: DataFrame, col: str, mapping: DataFrame, default: float,
                        out: str | None = None, n_classes: int | None = None) -> DataFrame:
    """Class -> value lookup; unseen class -> default."""
    out = out or col
    keyed = df.withColumn("__cls", null_to_sentinel(F.col(col)))
    m = mapping.select(F.col("class").alias("__cls"), F.col("value").alias("__te"))
    j = join_lookup(keyed, m, "__cls", n_classes)
    j = j.withColumn("__te", F.coalesce(F.col("__te"), F.lit(float(default))))
    if out == col:
        j = j.drop(col)
    return j.withColumnRenamed("__te", out).drop("__cls")


# ---------------------------------------------------------------- J04 / M19
def fold_class_stats(df: DataFrame, col: str, y: str, fold: str = "fold") -> DataFrame:
    """(class, fold, n_cf, s_cf, n_c, s_c): per-fold and total class sums.
    One map-side-combined aggregate; the per-class window spans <= k rows."""
    g = (df.groupBy(null_to_sentinel(F.col(col)).alias("class"), F.col(fold).alias("fold"))
         .agg(F.count(F.col(y)).alias("n_cf"), F.sum(y).alias("s_cf")))
    w = Window.partitionBy("class")
    return g.withColumn("n_c", F.sum("n_cf").over(w)).withColumn("s_c", F.sum("s_cf").over(w))


def fold_global_stats(df: DataFrame, y: str, fold: str = "fold") -> DataFrame:
    """(fold, g_out): target mean of all rows outside each fold (k rows)."""
    g = df.groupBy(F.col(fold).alias("fold")).agg(F.count(F.col(y)).alias("n_f"), F.sum(y).alias("s_f"))
    w = Window.partitionBy()
    g = g.withColumn("n", F.sum("n_f").over(w)).withColumn("s", F.sum("s_f").over(w))
    return g.select("fold", ((F.col("s") - F.col("s_f")) / (F.col("n") - F.col("n_f"))).alias("g_out"))


def oof_target_encode(df: DataFrame, col: str, y: str, fold: str = "fold", out: str | None = None,
                      smoothing: float = TE_SMOOTHING, n_classes: int | None = None) -> DataFrame:
    """Each row gets the smoothed encoding fitted on the other
    folds only: (S_c - S_cf + s g_f) / (N_c - N_cf + s), where g_f is the
    mean outside fold f.  A class absent outside f gets g_f."""
    out = out or f"{col}__te"
    stats = fold_class_stats(df, col, y, fold)
    gl = F.broadcast(fold_global_stats(df, y, fold))   # k rows
    enc = (stats.join(gl, on="fold")
           .select(F.col("class").alias("__cls"), F.col("fold").alias(fold),
                   ((F.col("s_c") - F.col("s_cf") + F.col("g_out") * smoothing)
                    / (F.col("n_c") - F.col("n_cf") + smoothing)).alias(out)))
    keyed = df.withColumn("__cls", null_to_sentinel(F.col(col)))
    n_lookup = None if n_classes is None else n_classes * 16
    return join_lookup(keyed, enc, ["__cls", fold], n_lookup).drop("__cls")


def category_count(df: DataFrame, col: str) -> int:
    """Classes of a column, counted as several when they are long, so that
    the count times ``CLASS_BYTES`` bounds their bytes."""
    c = df.select(null_to_sentinel(F.col(f"`{col}`")).alias("c")).groupBy("c").agg(F.lit(1).alias("one"))
    r = c.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("c")).alias("b")).first()
    return max(int(r["n"]), -(-int(r["b"] or 0) // CLASS_BYTES))


NAN = NAN_CLASS


def fold_target_encodings(df: DataFrame, col: str, y: str, fold: str | None, folds, prefix: str | None = None,
                          smoothing: float = TE_SMOOTHING, n_classes: int | None = None) -> DataFrame:
    """Leak-safe encodings for training: column ``<prefix>__all`` fitted on
    all rows (the deployed encoder) and ``<prefix>__f<f>`` fitted on the
    complement of fold f (what the fold-f model trains and scores with).
    One grouped aggregate per class with 2 + 2k sums, one lookup join."""
    prefix = prefix or col
    cls = null_to_sentinel(F.col(col))
    aggs = [F.count(F.col(y)).alias("n_c"), F.sum(y).alias("s_c")]
    gaggs = [F.count(F.col(y)).alias("n"), F.sum(y).alias("s")]
    for f in folds:
        inf = F.col(fold) == f
        aggs += [F.count(F.when(inf, F.col(y))).alias(f"n_{f}"), F.sum(F.when(inf, F.col(y))).alias(f"s_{f}")]
        gaggs += [F.count(F.when(inf, F.col(y))).alias(f"n_{f}"), F.sum(F.when(inf, F.col(y))).alias(f"s_{f}")]
    g = df.agg(*gaggs).first()
    stats = df.groupBy(cls.alias("__cls")).agg(*aggs).fillna(0.0)
    n, s = float(g["n"]), float(g["s"] or 0.0)
    g_all = s / n if n else 0.0
    outs = [((F.col("s_c") + smoothing * g_all) / (F.col("n_c") + smoothing)).alias(f"{prefix}__all")]
    for f in folds:
        nf, sf = float(g[f"n_{f}"]), float(g[f"s_{f}"] or 0.0)
        gf = (s - sf) / (n - nf) if n - nf > 0 else g_all
        outs.append(((F.col("s_c") - F.col(f"s_{f}") + smoothing * gf)
                     / (F.col("n_c") - F.col(f"n_{f}") + smoothing)).alias(f"{prefix}__f{f}"))
    table = stats.select("__cls", *outs)
    keyed = df.withColumn("__cls", cls)
    return join_lookup(keyed, table, "__cls", n_classes).drop("__cls")
