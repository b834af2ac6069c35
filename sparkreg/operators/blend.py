"""Out-of-fold assembly and non-negative blending.

A blend needs only AtA and Atb over the member OOF columns: one
aggregation of m(m+1)/2 + m sums.  The m <= 6 active-set solve is
spec-sized and runs on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLEND_R2_THRESH = 0.30         # fixed: members need OOF R2 >= 0.30
MIN_MEMBERS = 2


def oof_assemble(df: DataFrame, fold: str, fit: Callable[[DataFrame], object],
                 score: Callable[[DataFrame, object], DataFrame], folds: Sequence[int] | None = None) -> DataFrame:
    """Fit on each fold's complement, score the fold, union the parts.
    Scored parts are disjoint, so the union IS the aligned OOF column."""
    if folds is None:
        folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    parts = []
    for f in folds:
        spec = fit(df.filter(F.col(fold) != f))
        parts.append(score(df.filter(F.col(fold) == f), spec))
    return reduce(lambda a, b: a.unionByName(b), parts)


def stack_members(long: DataFrame, key: str, members: Sequence[str]) -> DataFrame:
    """(key, model, pred) -> one column per member, aligned by key.
    Pivot with a fixed member list (no extra pass for distinct values)."""
    return long.groupBy(key).pivot("model", list(members)).agg(F.first("pred"))


def gram_of_members(df: DataFrame, members: Sequence[str], y: str) -> tuple[np.ndarray, np.ndarray, float, float]:
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy")]
    for i, a in enumerate(members):
        aggs.append(F.sum(F.col(a) * F.col(y)).alias(f"b{i}"))
        for j in range(i, len(members)):
            aggs.append(F.sum(F.col(a) * F.col(members[j])).alias(f"a{i}_{j}"))
    r = df.agg(*aggs).first()
    m = len(members)
    A = np.zeros((m, m))
    for i in range(m):
        for j in range(i, m):
            A[i, j] = A[j, i] = r[f"a{i}_{j}"] or 0.0
    b = np.array([r[f"b{i}"] or 0.0 for i in range(m)])
    return A, b, float(r["yy"] or 0.0), float(r["n"])


def nnls_gram(A: np.ndarray, b: np.ndarray, max_iter: int = 100) -> np.ndarray:
    """min |Xw - y|^2, w >= 0, given A = X'X and b = X'y (Lawson-Hanson
    active set on the m x m normal equations)."""
    m = len(b)
    w = np.zeros(m)
    passive = np.zeros(m, dtype=bool)
    for _ in range(max_iter):
        grad = b - A @ w
        cand = (~passive) & (grad > 1e-12)
        if not cand.any():
            break
        passive[np.argmax(np.where(cand, grad, -np.inf))] = True
        while True:
            idx = np.where(passive)[0]
            z = np.zeros(m)
            z[idx] = np.linalg.lstsq(A[np.ix_(idx, idx)], b[idx], rcond=None)[0]
            if (z[idx] > 0).all():
                w = z
                break
            neg = idx[z[idx] <= 0]
            alpha = np.min(w[neg] / (w[neg] - z[neg] + 1e-300))
            w = w + alpha * (z - w)
            passive &= w > 1e-12
            w[~passive] = 0.0
    return w


def blend_weights(df: DataFrame, members: Sequence[str], y: str, r2: dict[str, float]) -> dict[str, float]:
    """Raw (not normalised) non-negative weights over eligible members;
    all-zero solution -> weights proportional to R2, summing to 1."""
    A, b, _, _ = gram_of_members(df, members, y)
    w = nnls_gram(A, b)
    if not np.any(w > 0):
        tot = sum(max(r2[m], 0.0) for m in members) or 1.0
        return {m: max(r2[m], 0.0) / tot for m in members}
    return {m: float(v) for m, v in zip(members, w)}


def eligible_members(r2: dict[str, float]) -> list[str]:
    ok = [m for m, v in r2.items() if v is not None and np.isfinite(v) and v >= BLEND_R2_THRESH]
    return ok if len(ok) >= MIN_MEMBERS else []


def blend_column(weights: dict[str, float]):
    """Raw weighted sum of members already on the original scale."""
    return reduce(lambda a, b: a + b, [F.col(m) * F.lit(w) for m, w in weights.items()])
