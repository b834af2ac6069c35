"""Ridge regression from per-fold sufficient statistics.

The row-sized work is ONE grouped aggregation: for every cell
``(fold, inner)`` the sums of a null-aware Gram system.  With Z = x where
present else 0 and M = 1[x missing]:

    G = Z'Z   H = Z'M   Q = M'M   zy = Z'y   my = M'y   z1 = sum Z   m1 = sum M

For any training set (a union of cells) and any fill vector phi (the
training medians), the imputed sums follow exactly:

    sum x~i x~j = G_ij + phi_j H_ij + phi_i H_ji + phi_i phi_j Q_ij
    sum x~i y   = zy_i + phi_i my_i      sum x~i = z1_i + phi_i m1_i

so every outer fold, inner fold and alpha is solved on the driver from
d x d matrices.  Robust scaling only rescales the centred Gram (the centre
cancels), so only the training IQR enters.  Columns are shifted by a
global centre before summing to avoid cancellation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.scalar import SCALE_FLOOR
from sparkreg.operators.profile import quantiles

# Fixed alpha grids of the reference.
ALPHAS_STD = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]
ALPHAS_POLY = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 1e4, 1e5]
INNER_FOLDS = 5
INNER_SEED = 42


# ---------------------------------------------------------------- A17
def gram_by_fold(df: DataFrame, feats: Sequence[str], y: str, fold: str = "fold") -> DataFrame:
    """N, sums, cross products and y products per fold (plain, for
    complete rows).  Column names ``s_x``, ``s_x_z``, ``s_x_y``, ``s_y_y``."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(c).alias(f"s_{c}") for c in feats] + [F.sum(y).alias("s_y")]
    for i, a in enumerate(feats):
        for b in feats[i:]:
            aggs.append(F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}"))
    aggs += [F.sum(F.col(c) * F.col(y)).alias(f"s_{c}_y") for c in feats]
    aggs.append(F.sum(F.col(y) * F.col(y)).alias("s_y_y"))
    return df.groupBy(fold).agg(*aggs)


def inner_fold(key: str, k: int = INNER_FOLDS, seed: int = INNER_SEED) -> Column:
    """Inner CV assignment of a row: the first 32 bits of md5('<seed>i|key')
    modulo k -- the same value in any SQL engine."""
    h = F.md5(F.concat(F.lit(f"{seed}i|"), F.col(key).cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % k).cast("int")


def cells_of(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, list[tuple]]:
    """(number of every row's cell, the cells), the cells in order of their
    first rows."""
    import pandas as pd
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        own, values = pd.factorize(c, use_na_sentinel=False)
        code = code * max(len(values), 1) + own
    codes, some = pd.factorize(code)
    first = np.full(len(some), len(code))
    np.minimum.at(first, codes, np.arange(len(code)))
    return codes, [tuple(c[i] for c in columns) for i in first]


def null_aware_gram(df: DataFrame, feats: Sequence[str], y: str, cell_cols: Sequence[str],
                    shift: dict[str, float]) -> dict[tuple, dict[str, np.ndarray]]:
    """One aggregation pass: the null-aware Gram system per cell.  Each task
    folds its Arrow batches into one (n, sy, yy, z1, m1, zy, my, G, H, Q)
    vector per cell, and Spark's vector aggregate sums the task vectors
    (map-side partial aggregation, so a hot cell costs nothing extra)."""
    import pandas as pd
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    d = len(feats)
    sh = np.array([shift[c] for c in feats])
    ncell = len(cell_cols)

    def part(it):
        acc: dict = {}
        for pdf in it:
            X = np.column_stack([pdf[f"__x{i}"].to_numpy(dtype=float, na_value=np.nan) for i in range(d)]) - sh
            yv = pdf["__y"].to_numpy(dtype=float)
            codes, uniq = cells_of([pdf[f"__c{j}"].to_numpy() for j in range(ncell)])
            for ci, key in enumerate(uniq):
                m = codes == ci
                Xm, ym = X[m], yv[m]
                gap = np.isnan(Xm)
                if gap.any():
                    M_, Z = gap.astype(float), np.where(gap, 0.0, Xm)
                    of_gaps = M_.sum(0), M_.T @ ym, (Z.T @ M_).ravel(), (M_.T @ M_).ravel()
                else:                                # nothing is missing: what M adds up to is zero
                    Z, of_gaps = Xm, (np.zeros(d), np.zeros(d), np.zeros(d * d), np.zeros(d * d))
                v = np.concatenate([[m.sum(), ym.sum(), ym @ ym], Z.sum(0), of_gaps[0], Z.T @ ym, of_gaps[1],
                                    (Z.T @ Z).ravel(), *of_gaps[2:]])
                acc[key] = v if key not in acc else acc[key] + v
        if acc:
            yield pd.DataFrame({**{f"__c{j}": [k[j] for k in acc] for j in range(ncell)},
                                "v": [v.tolist() for v in acc.values()]})

    base = df.select(*[F.col(c).alias(f"__c{j}") for j, c in enumerate(cell_cols)], F.col(y).alias("__y"),
                     *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(feats)])
    schema = ", ".join(f"__c{j} {t}" for j, (_, t) in enumerate(base.select(*[f"__c{j}" for j in range(ncell)]).dtypes))
    parts = base.mapInPandas(part, f"{schema}, v array<double>")
    rows = parts.groupBy(*[f"__c{j}" for j in range(ncell)]).agg(
        Summarizer.sum(array_to_vector("v")).alias("s")).collect()        # cells x O(d^2)
    out = {}
    for r in rows:
        v = r["s"].toArray()
        p = 0

        def take(k):
            nonlocal p
            seg = v[p:p + k]
            p += k
            return seg
        n_, sy_, yy_ = take(3)
        z1, m1, zy, my = take(d), take(d), take(d), take(d)
        G, H, Q = take(d * d).reshape(d, d), take(d * d).reshape(d, d), take(d * d).reshape(d, d)
        out[tuple(r[f"__c{j}"] for j in range(ncell))] = {"n": float(n_), "sy": float(sy_), "yy": float(yy_),
                                                          "z1": z1, "m1": m1, "zy": zy, "my": my,
                                                          "G": G, "H": H, "Q": Q}
    return out


def _sum_cells(cells: dict, keys) -> dict | None:
    acc = None
    for k in keys:
        c = cells.get(k)
        if c is None:
            continue
        if acc is None:
            acc = {n: (v.copy() if isinstance(v, np.ndarray) else v) for n, v in c.items()}
        else:
            for n, v in c.items():
                acc[n] = acc[n] + v
    return acc


def imputed_moments(s: dict, phi: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, float]:
    """(n, Sx, Sy, Sxx, Sxy, Syy) of the median-filled, shifted columns."""
    Sx = s["z1"] + phi * s["m1"]
    Sxx = s["G"] + s["H"] * phi[None, :] + (s["H"] * phi[None, :]).T + np.outer(phi, phi) * s["Q"]
    Sxy = s["zy"] + phi * s["my"]
    return s["n"], Sx, s["sy"], Sxx, Sxy, s["yy"]


def _solve(M: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system, after its diagonal is brought to one.
    Directions that the system does not determine (all classes of a one-hot
    column, whose scale leaves next to no penalty) get no weight."""
    t = 1.0 / np.sqrt(np.maximum(np.diag(M), 1e-300))
    B = M * np.outer(t, t)
    try:
        if np.diag(np.linalg.cholesky(B)).min() > 1e-5:
            return t * np.linalg.solve(B, t * b)
    except np.linalg.LinAlgError:
        pass
    value, vector = np.linalg.eigh(B)
    keep = value > 1e-10 * max(value.max(), 1e-300)
    return t * (vector[:, keep] @ ((vector[:, keep].T @ (t * b)) / value[keep]))


def ridge_solve(mom, scale: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Centred ridge on x/scale with an unpenalised intercept.  Returns
    (beta in shifted units, intercept in shifted units)."""
    n, Sx, Sy, Sxx, Sxy, _ = mom
    mx, my = Sx / n, Sy / n
    C = (Sxx - n * np.outer(mx, mx)) / np.outer(scale, scale)
    b = (Sxy - n * mx * my) / scale
    w = _solve(C + alpha * np.eye(len(scale)), b)
    beta = w / scale
    return beta, float(my - mx @ beta)


def sse_of(mom, beta: np.ndarray, a: float) -> float:
    """Held-out SSE of y - a - beta.x from that set's moments."""
    n, Sx, Sy, Sxx, Sxy, Syy = mom
    return float(Syy - 2 * a * Sy - 2 * beta @ Sxy + n * a * a + 2 * a * beta @ Sx + beta @ Sxx @ beta)


@dataclass
class LinearSpec:
    """A fitted linear model in raw units: pred = intercept + sum coef_i * fill(x_i)."""
    feats: list[str]
    coef: list[float]
    intercept: float
    medians: dict[str, float]
    alpha: float
    scale: dict[str, float] = field(default_factory=dict)

    def scaled(self) -> list[float]:
        """The coefficients of the scaled columns, which can be compared."""
        return [w * self.scale.get(c, 1.0) for c, w in zip(self.feats, self.coef)]

    def predict(self) -> Column:
        e = F.lit(self.intercept)
        for c, w in zip(self.feats, self.coef):
            e = e + F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c, 0.0)))
        return e


def _choose_alpha(cells: dict, train_keys: list, inner_ids: Sequence[int], phi, scale, alphas) -> float:
    """RidgeCV: total inner-fold SSE per alpha; strict < so the first wins."""
    best_a, best = alphas[0], np.inf
    tr = {k: cells[k] for k in train_keys if k in cells}
    for a in alphas:
        tot = 0.0
        ok = True
        for i in inner_ids:
            fit_keys = [k for k in tr if k[-1] != i]
            te_keys = [k for k in tr if k[-1] == i]
            fs, ts = _sum_cells(tr, fit_keys), _sum_cells(tr, te_keys)
            if fs is None or ts is None or fs["n"] < 2:
                ok = False
                break
            beta, icp = ridge_solve(imputed_moments(fs, phi), scale, a)
            tot += sse_of(imputed_moments(ts, phi), beta, icp)
        if ok and tot < best:
            best, best_a = tot, a
    return best_a


def _set_filter(fold: str | None, f):
    return (lambda c: c) if f == "all" else (lambda c: F.when(F.col(fold) != f, c))


def fill_and_scale(df: DataFrame, cols_by_set: dict, fold: str | None) -> tuple[dict, dict, dict]:
    """Per training set (each fold complement, and "all"): medians of its
    columns, then the IQR of the median-filled columns, by exact quantiles of
    all sets at once.  Also returns the all-row median of every column as the
    summation shift."""
    union = sorted({c for cols in cols_by_set.values() for c in cols})
    val = {c: F.col(f"`{c}`").cast("double") for c in union}
    sets = list(cols_by_set)
    want = {("g", c): (val[c], [0.5]) for c in union}
    want |= {(si, c): (_set_filter(fold, s)(val[c]), [0.5]) for si, s in enumerate(sets) for c in cols_by_set[s]}
    got = {k: v[0] if v[0] is not None else 0.0 for k, v in quantiles(df, want).items()}
    shift = {c: got["g", c] for c in union}
    med = {s: np.array([got[si, c] for c in cols_by_set[s]]) for si, s in enumerate(sets)}
    iqr = quantiles(df, {(si, c): (_set_filter(fold, s)(F.coalesce(val[c], F.lit(got[si, c]))), [0.25, 0.75])
                         for si, s in enumerate(sets) for c in cols_by_set[s]})
    scale = {s: np.array([max((iqr[si, c][1] - iqr[si, c][0]) if iqr[si, c][0] is not None else 0.0, SCALE_FLOOR)
                          for c in cols_by_set[s]]) for si, s in enumerate(sets)}
    return med, scale, shift


def _sub(cell: dict, idx: list[int]) -> dict:
    ix = np.ix_(idx, idx)
    return {"n": cell["n"], "sy": cell["sy"], "yy": cell["yy"], "z1": cell["z1"][idx], "m1": cell["m1"][idx],
            "zy": cell["zy"][idx], "my": cell["my"][idx], "G": cell["G"][ix], "H": cell["H"][ix], "Q": cell["Q"][ix]}


@dataclass
class RidgeResult:
    final: LinearSpec
    per_fold: dict[int, LinearSpec]
    alphas: dict


def ridge_cv(df: DataFrame, feats: Sequence[str], y: str, key: str, fold: str | None = "fold",
             alphas: Sequence[float] = ALPHAS_STD, folds: Sequence[int] | None = None,
             cols_by_set: dict | None = None, robust: bool = True) -> RidgeResult:
    """Median impute -> robust scale -> RidgeCV for every evaluated
    fold and for the final all-row model, from three aggregation passes.

    ``cols_by_set`` lets a training set read its own version of a column
    (e.g. a target encoding fitted on that fold's complement); by default
    every set reads ``feats``."""
    feats = list(feats)
    if folds is None:
        folds = sorted(r[0] for r in df.select(fold).distinct().collect()) if fold else []
    if cols_by_set is None:
        cols_by_set = {s: feats for s in list(folds) + ["all"]}
    if robust:
        med, scale, shift = fill_and_scale(df, cols_by_set, fold)
    else:   # inputs already complete and scaled (poly terms): no fill, unit scale
        med = {s: np.zeros(len(c)) for s, c in cols_by_set.items()}
        scale = {s: np.ones(len(c)) for s, c in cols_by_set.items()}
        shift = {c: 0.0 for cols in cols_by_set.values() for c in cols}
    union = sorted(shift)
    pos = {c: j for j, c in enumerate(union)}
    cell_df = df.withColumn("__inner", inner_fold(key))
    cell_cols = ([fold] if fold else []) + ["__inner"]
    cells = null_aware_gram(cell_df, union, y, cell_cols, shift)
    inner_ids = list(range(INNER_FOLDS))

    def fit(train_keys, s):
        cols = cols_by_set[s]
        idx = [pos[c] for c in cols]
        sub = {k: _sub(v, idx) for k, v in cells.items()}
        sh = np.array([shift[c] for c in cols])
        phi = med[s] - sh
        a = _choose_alpha(sub, train_keys, inner_ids, phi, scale[s], alphas)
        tot = _sum_cells(sub, train_keys)
        beta, icp = ridge_solve(imputed_moments(tot, phi), scale[s], a)
        icp_raw = icp - float(beta @ sh)
        return LinearSpec(list(cols), [float(b) for b in beta], icp_raw,
                          {c: float(med[s][i]) for i, c in enumerate(cols)}, a,
                          {c: float(scale[s][i]) for i, c in enumerate(cols)})

    all_keys = list(cells)
    per_fold = {f: fit([k for k in all_keys if k[0] != f], f) for f in folds}
    final = fit(all_keys, "all")
    return RidgeResult(final, per_fold, {f: sp.alpha for f, sp in per_fold.items()} | {"all": final.alpha})


def oof_predict(df: DataFrame, res: RidgeResult, fold: str = "fold", out: str = "pred") -> DataFrame:
    """J02 for ridge: each row scored by the model of its own fold's
    complement -- one CASE projection, no join."""
    e = None
    for f, spec in res.per_fold.items():
        e = F.when(F.col(fold) == f, spec.predict()) if e is None else e.when(F.col(fold) == f, spec.predict())
    return df.withColumn(out, e if e is not None else res.final.predict())


# ---------------------------------------------------------------- M02 / D03
def poly_columns(feats: Sequence[str], center: dict, scl: dict, interaction_only: bool = False) -> list[Column]:
    """Robust-scaled singles and pair products (F12 order), imputed first."""
    from sparkreg.functions.scalar import poly2_terms
    sc = [(F.col(c).cast("double") - F.lit(center[c])) / F.lit(max(scl[c], SCALE_FLOOR)) for c in feats]
    out = []
    for nm, idx in poly2_terms(list(feats), interaction_only):
        v = sc[idx[0]] if len(idx) == 1 else sc[idx[0]] * sc[idx[1]]
        out.append(v.alias(nm))
    return out
