"""Scalers and target transforms.

Scaler fits are one aggregation pass per table; the Yeo-Johnson lambda
search evaluates a whole grid of lambdas in each pass (the
``sum(sign(x) log1p|x|)`` term does not depend on lambda and is shared).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.scalar import SCALE_FLOOR, clip, yeo_johnson
from sparkreg.operators.profile import CONST_STD_EPS, SKEW_THRESH, _long, quantiles

YJ_SEARCH = (-5.0, 5.0)        # fixed: lambda search interval
YJ_GRID_POINTS = 21
YJ_PASSES = 3


def standard_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, population std, scale = max(std, 1e-8)."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(c)).alias(f"m{i}"), F.stddev_pop(F.col(c)).alias(f"s{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("center"), F.col(f"s{i}").alias("std"),
                     F.greatest(F.col(f"s{i}"), F.lit(SCALE_FLOOR)).alias("scale"))
            for i, c in enumerate(cols)]
    return _long(one, rows)


def robust_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median, IQR, scale = max(IQR, 1e-8) (exact linear quantiles)."""
    got = quantiles(df, {c: (F.col(f"`{c}`"), [0.25, 0.5, 0.75]) for c in cols})
    rows = [(c, m, None if m is None else b - a, None if m is None else max(b - a, SCALE_FLOOR))
            for c, (a, m, b) in got.items()]
    return df.sparkSession.createDataFrame(rows, "column string, center double, iqr double, scale double")


def winsorize(df: DataFrame, y: str, lo: float | None, hi: float | None, flag: str | None = None) -> DataFrame:
    """clamp y to the fences, keep every row; optionally flag clipped rows."""
    if lo is None or hi is None:
        out = df
        if flag:
            out = out.withColumn(flag, F.lit(False))
        return out
    if flag:
        df = df.withColumn(flag, (F.col(y) < lo) | (F.col(y) > hi))
    return df.withColumn(y, clip(y, lo, hi))


# ---------------------------------------------------------------- A18 / M12
def yj_loglik_grid(df: DataFrame, y: str, lambdas: Sequence[float]) -> DataFrame:
    """Yeo-Johnson profile log-likelihood at each lambda, one pass:
    -n/2 ln var_pop(t) + (lambda - 1) sum(sign(x) log1p|x|)."""
    aggs = [F.count(F.col(y)).alias("n"),
            F.sum(F.signum(F.col(y)) * F.log1p(F.abs(F.col(y)))).alias("slog")]
    aggs += [F.var_pop(yeo_johnson(y, lam)).alias(f"v{i}") for i, lam in enumerate(lambdas)]
    one = df.agg(*aggs)
    rows = []
    for i, lam in enumerate(lambdas):
        v = F.col(f"v{i}")
        ll = F.when(v < CONST_STD_EPS, F.lit(None).cast("double")).otherwise(
            F.col("n") * F.log(v) * -0.5 + F.col("slog") * (lam - 1.0))
        rows.append(F.struct(F.lit(float(lam)).alias("lam"), ll.alias("loglik")))
    return _long(one, rows)


def fit_yj_lambda(df: DataFrame, y: str) -> float:
    """Maximise the profile likelihood on [-5, 5] by a shrinking grid: each
    pass scores 21 lambdas in one Spark job, then zooms in around the best."""
    lo, hi = YJ_SEARCH
    best = 1.0
    for _ in range(YJ_PASSES):
        grid = [lo + (hi - lo) * i / (YJ_GRID_POINTS - 1) for i in range(YJ_GRID_POINTS)]
        rows = yj_loglik_grid(df, y, grid).collect()
        scored = [(r["loglik"], r["lam"]) for r in rows if r["loglik"] is not None]
        if not scored:
            return 1.0
        best = max(scored)[1]
        step = (hi - lo) / (YJ_GRID_POINTS - 1)
        lo, hi = max(YJ_SEARCH[0], best - step), min(YJ_SEARCH[1], best + step)
    return float(best)


def quick_transform_rule(df_train: DataFrame, y: str, y_min_all: float) -> DataFrame:
    """M12 quick rule as a one-row frame: skew > .75 and min(all y) >= 0 ->
    log1p; |skew| > .75 -> yeo_johnson; else none."""
    m = df_train.agg(F.stddev_pop(y).alias("sd"), F.skewness(y).alias("sk"))
    sk = F.when(F.col("sd") < CONST_STD_EPS, F.lit(0.0)).otherwise(F.col("sk"))
    choice = (F.when((sk > SKEW_THRESH) & F.lit(y_min_all >= 0), F.lit("log1p"))
              .when(F.abs(sk) > SKEW_THRESH, F.lit("yeo_johnson")).otherwise(F.lit("none")))
    return m.select(sk.alias("skew"), choice.alias("transform"))
