"""Evaluation metrics and model choice.

Metrics are aggregates over ``(y, pred)`` columns: SSE and SST come from one
pass (SST = n * var_pop(y)), so no second scan for the mean is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLEND_MARGIN = 0.005           # fixed: a blend must beat the best single by this
SMALL_N_OOF = 50
MIN_ROWS_FOR_SPLIT = 10
SMALL_VAL_ROWS = 20


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r2_aggs(y, pred, prefix: str = "") -> list[Column]:
    y, p = _c(y), _c(pred)
    return [F.sum((y - p) * (y - p)).alias(f"{prefix}sse"),
            (F.var_pop(y) * F.count(y)).alias(f"{prefix}sst"),
            F.count(y).alias(f"{prefix}n")]


def r2_from(sse: Column, sst: Column) -> Column:
    """A10: 1 - SSE/SST; constant y: 1 if SSE == 0 else 0."""
    return F.when(sst > 0, 1.0 - sse / sst).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def r2_frame(df: DataFrame, y: str, pred: str) -> DataFrame:
    """A10 as a one-row frame."""
    one = df.agg(*r2_aggs(y, pred))
    return one.select(r2_from(F.col("sse"), F.col("sst")).alias("r2"), F.col("n"))


def error_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """RMSE and MAE (on the raw target), NULL when nothing evaluable."""
    e = F.col(y) - F.col(pred)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                  F.count(e).alias("eval_rows"))


def fold_r2(df: DataFrame, y: str, pred: str, fold: str = "fold") -> DataFrame:
    """Per-fold R2 (folds with >= 2 rows)."""
    g = df.groupBy(fold).agg(*r2_aggs(y, pred))
    return g.filter(F.col("n") >= 2).select(fold, r2_from(F.col("sse"), F.col("sst")).alias("r2"), "n")


def r2_by_fold(df: DataFrame, y: str, pred: str, fold: str = "fold") -> DataFrame:
    """Population std of per-fold R2; fewer than 2 folds -> 0."""
    per = fold_r2(df, y, pred, fold)
    return per.agg(F.when(F.count(F.lit(1)) >= 2, F.stddev_pop("r2")).otherwise(F.lit(0.0)).alias("r2_std"),
                   F.count(F.lit(1)).alias("n_folds"))


# ---------------------------------------------------------------- T01 / M14
def top_importance(imp: DataFrame, name: str = "feature", value: str = "importance", k: int = 10) -> DataFrame:
    """Share of total in percent (1 dp), top k by share, ties by name.
    The importance table is feature-sized, so its total is a tiny window."""
    tot = F.sum(value).over(Window.partitionBy())
    j = imp.select(F.col(name).alias("feature"), F.col(value).alias("__v"), tot.alias("__t"))
    pct = F.when(F.col("__t") > 0, F.col("__v") / F.col("__t") * 100.0).otherwise(F.lit(0.0))
    ranked = j.select("feature", F.round(pct, 1).alias("pct"), pct.alias("__p"))
    return ranked.orderBy(F.desc("__p"), F.asc("feature")).limit(k).drop("__p")


def coef_importance(names: Sequence[str], coefs: Sequence[float], spark) -> DataFrame:
    """|coef| / sum |coef| (a spec-sized frame)."""
    tot = sum(abs(c) for c in coefs) or 1.0
    rows = [(n, abs(float(c)) / tot) for n, c in zip(names, coefs)]
    return spark.createDataFrame(rows, "feature string, importance double")


# ---------------------------------------------------------------- A21 / T03 / T06
def leaderboard(cands: DataFrame) -> DataFrame:
    """Candidates (name, r2, r2_std, train_r2) by R2 descending, with
    ``is_best`` on the first finite one."""
    finite = F.col("r2").isNotNull() & ~F.isnan("r2")
    w = Window.orderBy(F.desc_nulls_last(F.when(finite, F.col("r2"))), F.asc("name"))
    return cands.withColumn("rank", F.row_number().over(w)) \
        .withColumn("is_best", (F.col("rank") == 1) & finite).drop("rank")


def pick_best(cands: DataFrame, blend_name: str = "blend") -> DataFrame:
    """Argmax R2 over finite singles (ties by name); the blend wins only
    when it beats the best single by >= 0.005.  One aggregate, no join."""
    finite = F.col("r2").isNotNull() & ~F.isnan("r2")
    single = finite & (F.col("name") != blend_name)
    one = cands.agg(
        F.min_by(F.col("name"), F.when(single, F.struct((-F.col("r2")).alias("a"), F.col("name").alias("b"))))
        .alias("best_single"),
        F.max(F.when(single, F.col("r2"))).alias("best_single_r2"),
        F.max(F.when(finite & (F.col("name") == blend_name), F.col("r2"))).alias("blend_r2"))
    wins = F.coalesce(F.col("blend_r2") - F.col("best_single_r2") >= BLEND_MARGIN, F.lit(False))
    return one.select(F.when(wins, F.lit(blend_name)).otherwise(F.col("best_single")).alias("chosen"),
                      F.when(wins, F.col("blend_r2")).otherwise(F.col("best_single_r2")).alias("chosen_r2"),
                      "best_single", "best_single_r2", "blend_r2")


def halving_select(trials: DataFrame, keep: int) -> DataFrame:
    """Keep the ``keep`` best trials by R2 (ties by trial id)."""
    return trials.filter(F.col("r2").isNotNull()).orderBy(F.desc("r2"), F.asc("trial")).limit(keep)


# ---------------------------------------------------------------- A20
def importance_merge(member_imp: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight-averaged member importances, renormalised to percent.
    member_imp(member, feature, pct), weights(member, weight)."""
    j = member_imp.join(F.broadcast(weights), "member")
    g = j.groupBy("feature").agg(F.sum(F.col("weight") * F.col("pct")).alias("w"))
    g = g.withColumn("__t", F.sum("w").over(Window.partitionBy()))    # feature-sized
    return g.select("feature", F.when(F.col("__t") > 0, F.col("w") / F.col("__t") * 100.0)
                    .otherwise(F.lit(0.0)).alias("pct"))


# ---------------------------------------------------------------- A22
def quality_warnings(spark, n_rows: int, eval_on: str, n_val: int, n_target_na: int, n_outliers: int,
                     iqr_mult: float, n_dup_rows: int, dropped_cols: Sequence[str],
                     dropped_dates: Sequence[str] = ()) -> DataFrame:
    """Keyed warnings (key, param) in a fixed order; inputs are the
    counts produced by A01, P02, F02 and P08."""
    rows = []
    if n_rows < MIN_ROWS_FOR_SPLIT:
        rows.append(("small_full_data", f"n_rows={n_rows}"))
    elif eval_on == "oof":
        rows.append(("oof_eval_small_n", f"n_rows={n_rows}") if n_rows < SMALL_N_OOF else ("oof_eval", ""))
    elif n_val < SMALL_VAL_ROWS:
        rows.append(("small_val_set", f"n_val={n_val}"))
    if n_target_na > 0:
        rows.append(("target_na_excluded", f"n={n_target_na}"))
    if n_outliers > 0:
        rows.append(("outliers_corrected", f"n={n_outliers};iqr_mult={iqr_mult}"))
    if n_dup_rows > 0:
        rows.append(("duplicate_rows", f"n={n_dup_rows}"))
    if dropped_cols:
        rows.append(("cat_cols_dropped", "cols=" + ",".join(dropped_cols)))
    if dropped_dates:
        rows.append(("date_cols_dropped", "cols=" + ",".join(dropped_dates)))
    return spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(rows)], "pos int, key string, params string")
