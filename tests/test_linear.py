"""Ridge from per-cell Gram statistics against a direct numpy solve on the
same rows, fills, scales and inner folds."""

import numpy as np
from pyspark.sql import functions as F

from sparkreg.operators.folds import stratified_folds
from sparkreg.operators.linear import ALPHAS_STD, INNER_FOLDS, inner_fold, ridge_cv


def _poly_mixed(spark, n=150, seed=0):
    rng = np.random.RandomState(seed)
    x1, x2 = rng.uniform(0, 5, n), rng.uniform(0, 5, n)
    x3, x4 = rng.uniform(-3, 3, n), rng.uniform(-3, 3, n)
    y = np.maximum(x1 * x2 + 0.5 * x3 ** 2 - x4 + 10 + rng.normal(0, 0.5, n), 0.01)
    rows = []
    for i in range(n):
        v = [float(x1[i]), float(x2[i]), float(x3[i]), float(x4[i])]
        if i % 7 == 0:
            v[2] = None          # missing values exercise the null-aware Gram
        rows.append((i, *v, float(y[i])))
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, x4 double, y double")


def _np_fit(X, y, alpha, med, scale):
    Xf = np.where(np.isnan(X), med[None, :], X) / scale[None, :]
    mx, my = Xf.mean(0), y.mean()
    W = np.linalg.solve((Xf - mx).T @ (Xf - mx) + alpha * np.eye(X.shape[1]), (Xf - mx).T @ (y - my))
    beta = W / scale
    return beta, my - (mx * scale) @ beta


def test_ridge_matches_numpy(spark):
    df = stratified_folds(_poly_mixed(spark), "id", "y").withColumn("inner", inner_fold("id"))
    feats = ["x1", "x2", "x3", "x4"]
    res = ridge_cv(df, feats, "y", "id", "fold", ALPHAS_STD)
    pdf = df.toPandas()
    for f, spec in res.per_fold.items():
        tr = pdf[pdf.fold != f]
        X = tr[feats].to_numpy(dtype=float)
        y = tr["y"].to_numpy()
        med = np.nanmedian(X, axis=0)
        Xf = np.where(np.isnan(X), med[None, :], X)
        q = np.percentile(Xf, [25, 75], axis=0)
        scale = np.maximum(q[1] - q[0], 1e-8)
        # alpha by inner-fold SSE (strict <, first wins)
        best, best_a = np.inf, ALPHAS_STD[0]
        for a in ALPHAS_STD:
            sse = 0.0
            for i in range(INNER_FOLDS):
                fit, te = tr[tr.inner != i], tr[tr.inner == i]
                b, c = _np_fit(fit[feats].to_numpy(dtype=float), fit["y"].to_numpy(), a, med, scale)
                Xt = np.where(np.isnan(te[feats].to_numpy(dtype=float)), med[None, :], te[feats].to_numpy(dtype=float))
                sse += float(((te["y"].to_numpy() - Xt @ b - c) ** 2).sum())
            if sse < best:
                best, best_a = sse, a
        assert spec.alpha == best_a
        beta, icp = _np_fit(X, y, best_a, med, scale)
        assert np.allclose(spec.coef, beta, rtol=1e-7, atol=1e-9)
        assert abs(spec.intercept - icp) < 1e-7 * max(1.0, abs(icp))


def test_ridge_recovers_signal(spark):
    rng = np.random.RandomState(1)
    n = 300
    x = rng.uniform(-3, 3, (n, 3))
    y = 1.5 * x[:, 0] - 0.8 * x[:, 1] + 0.1 * rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)],
                               "id long, a double, b double, c double, y double")
    res = ridge_cv(df, ["a", "b", "c"], "y", "id", None, ALPHAS_STD)
    assert abs(res.final.coef[0] - 1.5) < 0.05 and abs(res.final.coef[1] + 0.8) < 0.05
    assert abs(res.final.coef[2]) < 0.05


def test_one_hot_classes_that_sum_to_one():
    """The null direction of a full one-hot set gets no weight, whatever the
    scale of the target."""
    import numpy as np

    from sparkreg.operators.linear import ridge_solve
    rng = np.random.RandomState(0)
    for _ in range(20):
        k = rng.randint(0, 6, 160)
        x = np.column_stack([rng.rand(160) * 50, *[(k == j).astype(float) for j in range(6)]])
        y = 6.8 + 0.01 * x[:, 0] / 50 + 0.02 * (k == 2) + 0.001 * rng.randn(160)
        mom = (160.0, x.sum(0), y.sum(), x.T @ x, x.T @ y, y @ y)
        beta, icp = ridge_solve(mom, np.array([25.0] + [1e-8] * 6), 0.1)
        assert np.abs(beta).max() < 10 and np.abs(icp + x @ beta - y).max() < 0.02


def test_cells_are_numbered_in_the_order_of_their_rows():
    from sparkreg.operators.linear import cells_of
    fold, inner = np.array([3, 1, 3, 1, 0]), np.array([2, 4, 2, 0, 2])
    codes, cells = cells_of([fold, inner])
    assert codes.tolist() == [0, 1, 0, 2, 3] and cells == [(3, 2), (1, 4), (1, 0), (0, 2)]
    codes, cells = cells_of([np.array([1.0, np.nan, 1.0, np.nan])])
    assert codes.tolist() == [0, 1, 0, 1] and len(cells) == 2


def test_gram_of_cells_with_and_without_missing_values(spark):
    from sparkreg.operators.linear import null_aware_gram
    rows = [(i % 2, float(i), None if i % 6 == 1 else float(i * i % 7), float(3 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "cell int, a double, b double, y double")
    got = null_aware_gram(df, ["a", "b"], "y", ["cell"], {"a": 1.0, "b": 2.0})
    for cell in (0, 1):
        x = np.array([[r[1] - 1.0, np.nan if r[2] is None else r[2] - 2.0] for r in rows if r[0] == cell])
        y = np.array([r[3] for r in rows if r[0] == cell])
        z, m = np.nan_to_num(x), np.isnan(x).astype(float)
        want = {"n": len(y), "sy": y.sum(), "yy": y @ y, "z1": z.sum(0), "m1": m.sum(0), "zy": z.T @ y, "my": m.T @ y,
                "G": z.T @ z, "H": z.T @ m, "Q": m.T @ m}
        for k, v in want.items():
            np.testing.assert_allclose(got[cell,][k], v, rtol=1e-12)
