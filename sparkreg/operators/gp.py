"""Inducing-point Gaussian process regression.

Kernel v * exp(-1/2 sum(((a - b) / l)^2)) plus white noise.  With m <= 300
inducing points Z (a seeded sample of the training rows), the predictive
mean is K_*m alpha with

    alpha = (K_mn K_nm + (nv + 1e-4) K_mm)^-1 K_mn y

K_mn K_nm and K_mn y are accumulated over ALL training rows by
``mapInPandas`` (one m x m block per partition, summed by Spark's vector
aggregate); only the m x m solve happens on the driver.  With every row an
inducing point this equals the exact GP posterior mean.

Hyper-parameters (ARD length scales, signal and noise variance) maximise the
variational lower bound of the marginal likelihood (Titsias, 2009) of ALL
training rows, which is the likelihood itself when every row is a point.
The bound and its gradient need K_mn K_nm, K_mn y and a sum over the rows'
distances to the points: two passes a trial, shared by all training sets and
restarts; quasi-Newton steps on the log parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.operators.folds import sample_rows
from sparkreg.operators.mlp import Descent, add_up, block_bytes, float_blocks, like_rows
from sparkreg.session import spread_rows

GP_MAX_POINTS = 300            # fixed: inducing points
SEARCH_POINTS = 100            # of them, those that the bound of a search uses
SEARCH_PASSES = 40             # trials of a search
RESTARTS_THOROUGH = 3
THETA_RANGE = (-6.0, 6.0)      # of the logarithms of the hyper-parameters
NOISE_JITTER, POINT_JITTER = 1e-4, 1e-6
KERNEL_ROWS = 512              # rows whose kernel is made at once
LOCAL_BYTES = 4 << 20          # prepared bytes up to which a table goes to each search whole


def rbf(A: np.ndarray, B: np.ndarray, ls: np.ndarray, sv: float) -> np.ndarray:
    """The kernel of all pairs, made in place a cache of rows at a time."""
    a, b = A / ls, B / ls
    aa, bb = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), KERNEL_ROWS):
        some = slice(i, i + KERNEL_ROWS)
        k = np.add(aa[some], bb, out=out[some])
        k -= 2 * a[some] @ b.T
        np.maximum(k, 0.0, out=k)
        k *= -0.5
        np.exp(k, out=k)
        k *= sv
    return out


def bound(theta: np.ndarray, Z: np.ndarray, n: float, yy: float, b: np.ndarray, Phi: np.ndarray):
    """(lower bound of the log marginal likelihood, its slope in K_mn K_nm and
    in K_mn y, its slope in ``theta`` apart from those two).  ``theta`` holds
    the logarithms of the length scales, the signal and the noise variance."""
    d = Z.shape[1]
    ls, sv, s2 = np.exp(theta[:d]), np.exp(theta[d]), np.exp(theta[d + 1]) + NOISE_JITTER
    plain = rbf(Z, Z, ls, sv)
    Kmm = plain + POINT_JITTER * sv * np.eye(len(Z))
    A = Kmm + Phi / s2
    La, Lk = np.linalg.cholesky(A), np.linalg.cholesky(Kmm)
    Ai, Ki = np.linalg.inv(A), np.linalg.inv(Kmm)
    a, inside = Ai @ b, float((Ki * Phi).sum())
    value = -0.5 * (n * np.log(2 * np.pi * s2) + 2 * np.log(np.diag(La)).sum() - 2 * np.log(np.diag(Lk)).sum()
                    + yy / s2 - b @ a / s2 ** 2 + (n * sv - inside) / s2)
    gA = -0.5 * (Ai + np.outer(a, a) / s2 ** 2)
    gPhi, gb = gA / s2 + 0.5 * Ki / s2, a / s2 ** 2
    gK = gA + 0.5 * Ki - 0.5 * Ki @ Phi @ Ki / s2
    slope = np.empty(d + 2)
    for j in range(d):
        slope[j] = (gK * plain * ((Z[:, j][:, None] - Z[:, j][None, :]) / ls[j]) ** 2).sum()
    slope[d] = (gK * Kmm).sum() + 2 * (gPhi * Phi).sum() + gb @ b - 0.5 * n * sv / s2
    by_noise = -(gA * Phi).sum() / s2 ** 2 - 0.5 * (n / s2 - yy / s2 ** 2 + 2 * (b @ a) / s2 ** 3 - (n * sv - inside) / s2 ** 2)
    slope[d + 1] = by_noise * np.exp(theta[d + 1])
    return float(value), gPhi, gb, slope


def _spans(n: int) -> list[slice]:
    return [slice(a, a + KERNEL_ROWS) for a in range(0, max(n, 1), KERNEL_ROWS)]


class _Search:
    """The searches of one call by number: a training set from one start."""

    def __init__(self, specs: list, folds: list, points: int, columns: list[str]):
        at = {c: i for i, c in enumerate(columns)}
        self.specs, self.folds, self.d = specs, folds, len(columns)
        self.spots = [np.array([at[c] for c in s.feats], dtype=np.int64) for s in specs]
        self.fills = [np.array([s.medians[c] for c in s.feats]) for s in specs]
        self.Z = [s.Z[:points] for s in specs]

    def read(self, x: bytes, y: bytes, fold: bytes, n: bytes | None = None, rest: bytes | None = None):
        return (np.frombuffer(x).reshape(-1, self.d), np.frombuffer(y), np.frombuffer(fold, dtype=np.int32),
                *([] if n is None else [np.frombuffer(n), np.frombuffer(rest)]))

    def _rows(self, i: int, x, y, folds):
        s, mine = self.specs[i], slice(None) if self.folds[i] is None else folds != self.folds[i]
        v = x[mine][:, self.spots[i]]
        return (np.where(np.isnan(v), self.fills[i], v) - s.x_mean) / s.x_std, (y[mine] - s.y_mean) / s.y_std

    def _like(self, i: int, folds, n, rest):
        """How many rows each one stands for (None: itself), and the squares
        of their targets about its own."""
        if n is None:
            return None, 0.0
        mine = slice(None) if self.folds[i] is None else folds != self.folds[i]
        return n[mine], rest[mine].sum() / self.specs[i].y_std ** 2

    def sums(self, at: dict[int, np.ndarray], x, y, folds, n=None, rest=None):
        """(number, [rows, y y, K_mn y, K_mn K_nm])."""
        for i, theta in at.items():
            rows, t = self._rows(i, x, y, folds)
            like, more = self._like(i, folds, n, rest)
            many = t if like is None else like * t
            by_y, by_k = 0.0, 0.0
            for some in _spans(len(t)):              # kernel and products of a few rows, while they are in the cache
                K = rbf(rows[some], self.Z[i], np.exp(theta[:-2]), np.exp(theta[-2]))
                by_y = by_y + K.T @ many[some]
                by_k = by_k + K.T @ (K if like is None else like[some][:, None] * K)
            yield i, np.concatenate([[len(t) if like is None else like.sum(), many @ t + more], by_y, by_k.ravel()])

    def slopes(self, at: dict[int, tuple], x, y, folds, n=None, rest=None):
        """(number, what the rows add to the slope in the log length scales)."""
        for i, (theta, gPhi, gb) in at.items():
            rows, t = self._rows(i, x, y, folds)
            like, _ = self._like(i, folds, n, rest)
            ls, Z, total = np.exp(theta[:-2]), self.Z[i], 0.0
            for some in _spans(len(t)):
                r = rows[some]
                K = rbf(r, Z, ls, np.exp(theta[-2]))
                M = K @ (2 * gPhi)
                M += t[some][:, None] * gb
                M *= K
                if like is not None:
                    M *= like[some][:, None]
                total = total + ((r ** 2).T @ M.sum(1) - 2 * ((r.T @ M) * Z.T).sum(1) + (Z ** 2).T @ M.sum(0)) / ls ** 2
            yield i, total

    def run(self, starts: dict[int, np.ndarray], added, passes: int) -> dict[int, tuple[float, np.ndarray]]:
        """{number: (loss a row, theta)}; ``added`` adds up over all rows."""
        walk = {i: Descent(v.copy()) for i, v in starts.items()}
        for _ in range(passes):
            at = {i: np.clip(w.trial(), *THETA_RANGE) for i, w in walk.items() if not w.done}
            if not at:
                break
            total, judged = added(lambda *r, at=at: self.sums(at, *r)), {}
            for i, theta in at.items():
                m, v = len(self.Z[i]), total.get(i)
                try:
                    judged[i] = (bound(theta, self.Z[i], v[0], v[1], v[2:2 + m], v[2 + m:].reshape(m, m)), v[0])
                except (np.linalg.LinAlgError, TypeError):
                    walk[i].told(np.inf, np.zeros(len(theta)))
            kept = {i: (at[i], gPhi, gb) for i, ((value, gPhi, gb, _), n) in judged.items() if walk[i].accepts(-value / n)}
            far = added(lambda *r: self.slopes(kept, *r)) if kept else {}      # a refused trial needs no slope
            for i, ((value, _, _, slope), n) in judged.items():
                slope = slope.copy()
                slope[:-2] += far.get(i, 0.0)
                walk[i].told(-value / n, -slope / n)
        return {i: (np.inf if w.loss is None else w.loss, np.clip(w.here, *THETA_RANGE)) for i, w in walk.items()}


def fit_hyper(df: DataFrame, specs: dict, y: str, fold: str | None, restarts: int = 1, points: int = SEARCH_POINTS,
              passes: int = SEARCH_PASSES, local_bytes: int = LOCAL_BYTES, seed: int = 42) -> dict:
    """{training set: (length scales, signal, noise)} of the best restart, by
    the bound over all its rows."""
    names = [(s, r) for s in specs for r in range(restarts)]
    union = sorted({c for sp in specs.values() for c in sp.feats})
    base = df.select(F.col(f"`{y}`").cast("double").alias("__y"), *[F.col(f"`{c}`").cast("double").alias(c) for c in union],
                     (F.col(f"`{fold}`") if fold else F.lit(-1)).cast("int").alias("__fold"))
    work = _Search([specs[s] for s, _ in names], [None if s == "all" else s for s, _ in names], points, union)
    rng = np.random.RandomState(seed)
    starts = {i: np.concatenate([np.zeros(len(specs[s].feats)) if r == 0 else rng.uniform(-1, 2, len(specs[s].feats)),
                                 [0.0, np.log(0.1)]]) for i, (s, r) in enumerate(names)}
    blocks = float_blocks(base, union)
    if (size := block_bytes(blocks)) > local_bytes:  # rows that agree in every column are passed as one
        blocks = float_blocks(like_rows(base, union, [s for s in specs if s != "all"]), union)
        size = block_bytes(blocks)
    if size <= local_bytes:                          # a group a search, each with all blocks
        def search(group: pa.Table) -> pa.Table:
            i = group["name"][0].as_py()
            rows = [work.read(**r) for r in group.sort_by("id").drop_columns(["id", "name"]).to_pylist()]

            def added(part):
                total: dict = {}
                for r in rows:
                    add_up(total, part(*r))
                return total

            loss, theta = work.run({i: starts[i]}, added, passes)[i]
            return pa.table({"name": pa.array([i], pa.int32()), "loss": [loss], "theta": [theta.tobytes()]})

        each = blocks.withColumn("name", F.explode(F.array(*[F.lit(i) for i in starts])))
        got = (each.repartition(4 * len(starts), "name").groupBy("name")
               .applyInArrow(search, "name int, loss double, theta binary").collect())
        found = {r["name"]: (r["loss"], np.frombuffer(r["theta"])) for r in got}
    else:
        blocks = spread_rows(blocks.drop("id")).persist(StorageLevel.MEMORY_AND_DISK)

        def added(part) -> dict:
            def sums(batches):
                total: dict = {}
                for batch in batches:
                    for r in batch.to_pylist():
                        add_up(total, part(*work.read(**r)))
                if total:
                    yield pa.RecordBatch.from_pydict({
                        "name": pa.array(list(total), pa.int32()),
                        "v": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})
            rows = (blocks.mapInArrow(sums, "name int, v array<double>").groupBy("name")
                    .agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect())
            return {r["name"]: r["v"].toArray() for r in rows}

        try:
            found = work.run(starts, added, passes)
        finally:
            blocks.unpersist()
    out = {}
    for s in specs:
        theta = min((found.get(i, (np.inf, starts[i])) for i, (t, _) in enumerate(names) if t == s), key=lambda v: v[0])[1]
        out[s] = (np.exp(theta[:-2]), float(np.exp(theta[-2])), float(np.exp(theta[-1])))
    return out


@dataclass
class GPSpec:
    feats: list[str]
    medians: dict[str, float]
    x_mean: np.ndarray
    x_std: np.ndarray
    y_mean: float
    y_std: float
    ls: np.ndarray
    sv: float
    nv: float
    Z: np.ndarray
    alpha: np.ndarray | None = None

    def importance(self) -> dict[str, float]:
        """1 / length scale, normalised to sum 1."""
        inv = 1.0 / self.ls
        return {c: float(v / inv.sum()) for c, v in zip(self.feats, inv)}

    def predict_column(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """Kernel to the broadcast points, Arrow batch at a time."""
        spec = self
        cols = [F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c, 0.0))) for c in self.feats]

        @F.pandas_udf("double")
        def _gp(*xs: pd.Series) -> pd.Series:
            X = (np.column_stack([x.to_numpy(dtype=float) for x in xs]) - spec.x_mean) / spec.x_std
            K = rbf(X, spec.Z, spec.ls, spec.sv)
            return pd.Series(K @ spec.alpha * spec.y_std + spec.y_mean)

        return df.withColumn(out, _gp(*cols))


def prepare_specs(df: DataFrame, y: str, key: str, medians_by_set: dict, fold: str | None,
                  cols_by_set: dict, points: int = GP_MAX_POINTS) -> dict:
    """Per training set (fold complement or all): standardisation (all sets
    from ONE FILTERed aggregate) and the seeded points."""
    sets = list(cols_by_set)
    aggs = []
    for si, s in enumerate(sets):
        med = medians_by_set[s]

        def tr(c, s=s):
            return c if s == "all" else F.when(F.col(fold) != s, c)
        xs_ = [F.coalesce(F.col(c).cast("double"), F.lit(float(med.get(c, 0.0)))) for c in cols_by_set[s]]
        aggs += [F.avg(tr(x)).alias(f"m{si}_{i}") for i, x in enumerate(xs_)]
        aggs += [F.stddev_pop(tr(x)).alias(f"s{si}_{i}") for i, x in enumerate(xs_)]
        aggs += [F.avg(tr(F.col(y))).alias(f"my{si}"), F.stddev_pop(tr(F.col(y))).alias(f"sy{si}")]
    st = df.agg(*aggs).first()
    specs = {}
    for si, s in enumerate(sets):
        cols = cols_by_set[s]
        med = medians_by_set[s]
        d = len(cols)
        xm = np.array([st[f"m{si}_{i}"] or 0.0 for i in range(d)])
        xsd = np.array([max(st[f"s{si}_{i}"] or 0.0, 1e-8) for i in range(d)])
        ym, ysd = float(st[f"my{si}"] or 0.0), max(float(st[f"sy{si}"] or 0.0), 1e-8)
        tr_rows = df if s == "all" else df.filter(F.col(fold) != s)
        base = tr_rows.select(key,
                              *[F.coalesce(F.col(c).cast("double"), F.lit(float(med.get(c, 0.0)))).alias(f"__x{i}")
                                for i, c in enumerate(cols)])
        sub = sample_rows(base, key, points).toPandas()     # <= 300 rows: spec-sized
        Z = (sub[[f"__x{i}" for i in range(d)]].to_numpy(dtype=float) - xm) / xsd
        specs[s] = GPSpec(list(cols), {c: float(med.get(c, 0.0)) for c in cols}, xm, xsd, ym, ysd, np.ones(d), 1.0, 0.1, Z)
    return specs


def accumulate(df: DataFrame, specs: dict, y: str, fold: str | None) -> dict:
    """One pass over the rows: K_mn K_nm and K_mn y for every training set."""
    keys = list(specs)
    union = sorted({c for sp in specs.values() for c in sp.feats})

    def part(it):
        acc = {s: None for s in keys}
        for pdf in it:
            yv = pdf["__y"].to_numpy(dtype=float)
            fv = pdf["__fold"].to_numpy() if "__fold" in pdf else None
            for s in keys:
                sp = specs[s]
                mask = np.ones(len(yv), bool) if (s == "all" or fv is None) else (fv != s)
                if not mask.any():
                    continue
                X = np.column_stack([pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in sp.feats])[mask]
                X = np.where(np.isnan(X), np.array([sp.medians[c] for c in sp.feats])[None, :], X)
                Xs = (X - sp.x_mean) / sp.x_std
                ys = (yv[mask] - sp.y_mean) / sp.y_std
                K = rbf(Xs, sp.Z, sp.ls, sp.sv)
                blk = np.concatenate([(K.T @ K).ravel(), K.T @ ys])
                acc[s] = blk if acc[s] is None else acc[s] + blk
        rows = [(str(s), acc[s].tolist()) for s in keys if acc[s] is not None]
        if rows:
            yield pd.DataFrame(rows, columns=["set", "v"])

    cols = [F.col(y).alias("__y"), *[F.col(c).cast("double").alias(c) for c in union]]
    if fold:
        cols.append(F.col(fold).alias("__fold"))
    parts = df.select(*cols).mapInPandas(part, "set string, v array<double>")
    summed = parts.groupBy("set").agg(Summarizer.sum(array_to_vector("v")).alias("s")).collect()
    out = {}
    for r in summed:
        key_ = next(k for k in keys if str(k) == r["set"])
        m = len(specs[key_].Z)
        v = r["s"].toArray()
        out[key_] = (v[: m * m].reshape(m, m), v[m * m:])
    return out


def solve_alpha(spec: GPSpec, KK: np.ndarray, Ky: np.ndarray) -> np.ndarray:
    Kmm = rbf(spec.Z, spec.Z, spec.ls, spec.sv)
    A = KK + (spec.nv + NOISE_JITTER) * Kmm
    try:
        return np.linalg.solve(A + 1e-10 * np.eye(len(A)), Ky)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(A, Ky, rcond=None)[0]


def fit_gp(df: DataFrame, feats: Sequence[str], y: str, key: str, medians_by_set: dict,
           fold: str | None = None, folds: Sequence[int] = (), cols_by_set: dict | None = None, restarts: int = 1) -> dict:
    """GP specs for each evaluated fold's complement and for all rows."""
    if cols_by_set is None:
        cols_by_set = {s: list(feats) for s in list(folds) + ["all"]}
    specs = prepare_specs(df, y, key, medians_by_set, fold, cols_by_set)
    for s, (ls, sv, nv) in fit_hyper(df, specs, y, fold, restarts).items():
        specs[s].ls, specs[s].sv, specs[s].nv = ls, sv, nv
    acc = accumulate(df, specs, y, fold)
    for s, sp in specs.items():
        KK, Ky = acc[s]
        sp.alpha = solve_alpha(sp, KK, Ky)
    return specs


def kernel_sum(df: DataFrame, feats: Sequence[str], points: np.ndarray, ls: np.ndarray, sv: float = 1.0,
               weights: np.ndarray | None = None, out: str = "ksum") -> DataFrame:
    """sum_j w_j k(x, p_j) of every row against <= 300 broadcast points
    (an Arrow-batched kernel block per batch; the point set is spec-sized)."""
    P_ = np.asarray(points, dtype=float)
    L = np.asarray(ls, dtype=float)
    w = np.ones(len(P_)) if weights is None else np.asarray(weights, dtype=float)

    @F.pandas_udf("double")
    def _ks(*xs: pd.Series) -> pd.Series:
        X = np.column_stack([x.to_numpy(dtype=float) for x in xs])
        return pd.Series(rbf(X, P_, L, sv) @ w)

    return df.withColumn(out, _ks(*[F.col(c).cast("double") for c in feats]))
