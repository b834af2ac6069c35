"""The inducing-point GP equals the exact GP posterior mean when every
training row is an inducing point."""

import numpy as np
from pyspark.sql import functions as F

from sparkreg.operators.gp import NOISE_JITTER, bound, fit_gp, fit_hyper, prepare_specs, rbf


def test_inducing_equals_exact(spark):
    rng = np.random.RandomState(0)
    n = 120
    X = rng.uniform(-2, 2, (n, 2))
    y = np.sin(X[:, 0]) + 0.3 * X[:, 1] + 0.05 * rng.normal(size=n)
    df = spark.createDataFrame([(i, float(X[i, 0]), float(X[i, 1]), float(y[i])) for i in range(n)],
                               "id long, a double, b double, y double")
    specs = fit_gp(df, ["a", "b"], "y", "id", {"all": {"a": 0.0, "b": 0.0}})
    sp = specs["all"]
    Xs = (X - sp.x_mean) / sp.x_std
    ys = (y - sp.y_mean) / sp.y_std
    K = rbf(Xs, Xs, sp.ls, sp.sv) + (sp.nv + NOISE_JITTER) * np.eye(n)
    exact = rbf(Xs, Xs, sp.ls, sp.sv) @ np.linalg.solve(K, ys) * sp.y_std + sp.y_mean
    got = sp.predict_column(df, "p").orderBy("id").select("p").toPandas()["p"].to_numpy()
    assert np.max(np.abs(got - exact)) < 1e-5 * max(1.0, np.abs(exact).max())


def test_bound_is_the_likelihood_when_every_row_is_a_point():
    rng = np.random.RandomState(1)
    X = rng.randn(50, 2)
    y = np.sin(X[:, 0]) + 0.1 * rng.randn(50)
    theta = np.array([0.2, -0.3, 0.1, -2.0])

    def value(t, Z):
        K = rbf(X, Z, np.exp(t[:-2]), np.exp(t[-2]))
        return bound(t, Z, len(y), y @ y, K.T @ y, K.T @ K)

    K = rbf(X, X, np.exp(theta[:2]), np.exp(theta[2])) + (np.exp(theta[3]) + NOISE_JITTER) * np.eye(50)
    exact = -0.5 * y @ np.linalg.solve(K, y) - 0.5 * np.linalg.slogdet(K)[1] - 25 * np.log(2 * np.pi)
    assert abs(value(theta, X)[0] - exact) < 1e-3 and value(theta, X[:15])[0] < exact
    Z = X[:15]
    _, gPhi, gb, slope = value(theta, Z)
    Kx = rbf(X, Z, np.exp(theta[:-2]), np.exp(theta[-2]))
    M = (2 * Kx @ gPhi + y[:, None] * gb) * Kx
    slope[:-2] += [(M * ((X[:, j][:, None] - Z[:, j][None, :]) / np.exp(theta[j])) ** 2).sum() for j in range(2)]
    near = [(value(theta + 1e-5 * e, Z)[0] - value(theta - 1e-5 * e, Z)[0]) / 2e-5 for e in np.eye(4)]
    assert np.allclose(slope, near, rtol=1e-3, atol=1e-2)


def test_search_reads_all_rows_whatever_the_partitions(spark):
    rng = np.random.RandomState(2)
    X = rng.uniform(-2, 2, (400, 3))
    y = np.sin(2 * X[:, 0]) + 0.4 * X[:, 1] + 0.05 * rng.normal(size=400)
    df = spark.createDataFrame([(i, i % 4, *map(float, X[i]), float(y[i])) for i in range(400)],
                               "id long, fold int, a double, b double, c double, y double")
    meds = {s: {} for s in (0, "all")}
    specs = prepare_specs(df, "y", "id", meds, "fold", {s: ["a", "b", "c"] for s in meds})
    one = fit_hyper(df, specs, "y", "fold", restarts=2, points=30, passes=12)
    two = fit_hyper(df.repartition(5), specs, "y", "fold", restarts=2, points=30, passes=12, local_bytes=0)

    def reached(s, hyper):
        mine = np.arange(400) % 4 != s if s != "all" else slice(None)
        rows, t = (X[mine] - specs[s].x_mean) / specs[s].x_std, (y[mine] - specs[s].y_mean) / specs[s].y_std
        Z, (ls, sv, nv) = specs[s].Z[:30], hyper[s]
        K = rbf(rows, Z, ls, sv)
        return bound(np.log([*ls, sv, nv]), Z, len(t), t @ t, K.T @ t, K.T @ K)[0] / len(t)

    for s in meds:                                   # flat directions aside, the same optimum
        assert abs(reached(s, one) - reached(s, two)) < 0.01
        start = {s: (np.ones(3), 1.0, 0.1)}
        assert reached(s, one) > reached(s, start) + 0.3
        assert one[s][0][2] > 3 * one[s][0][0]       # the column that plays no part has the longest scale


def test_a_search_makes_the_kernel_a_few_rows_at_a_time(monkeypatch):
    from sparkreg.operators import gp
    rng, d, n = np.random.RandomState(5), 3, 2 * gp.KERNEL_ROWS + 77
    x, y, fold = rng.randn(n, d), rng.randn(n), np.arange(n, dtype=np.int32) % 5
    cols = list("abc")
    spec = gp.GPSpec(cols, dict.fromkeys(cols, 0.0), np.zeros(d), np.ones(d), 0.0, 1.0, np.ones(d), 1.0, 0.1, x[:9].copy())
    work, theta = gp._Search([spec], [2], 9, cols), np.array([0.1, -0.2, 0.3, 0.2, -2.0])
    plain, sizes = gp.rbf, []
    monkeypatch.setattr(gp, "rbf", lambda a, *rest: sizes.append(len(a)) or plain(a, *rest))
    (_, v), = work.sums({0: theta}, x, y, fold)
    r, t = x[fold != 2], y[fold != 2]
    K = plain(r, spec.Z, np.exp(theta[:3]), np.exp(theta[3]))
    np.testing.assert_allclose(v, np.concatenate([[len(t), t @ t], K.T @ t, (K.T @ K).ravel()]), rtol=1e-10)
    G, g = rng.randn(9, 9), rng.randn(9)
    (_, s), = work.slopes({0: (theta, G, g)}, x, y, fold)
    M = (K @ (2 * G) + np.outer(t, g)) * K
    want = [(M * (r[:, [j]] - spec.Z[:, j]) ** 2).sum() / np.exp(2 * theta[j]) for j in range(d)]
    np.testing.assert_allclose(s, want, rtol=1e-8)
    assert max(sizes) <= gp.KERNEL_ROWS
    (_, none), = work.sums({0: theta}, x[:0], y[:0], fold[:0])
    assert none.tolist() == [0.0] * len(v)
    (_, none), = work.slopes({0: (theta, G, g)}, x[:0], y[:0], fold[:0])
    assert none.tolist() == [0.0] * d
