"""Rows that agree in all columns, passed as one by networks and processes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreg.operators import gp as G
from sparkreg.operators import mlp as N


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(5)
    n = 4_000
    a, b = rng.randint(0, 6, n).astype(float), rng.randint(0, 5, n).astype(float)
    y = np.sin(a) + 0.3 * b + 0.2 * rng.randn(n)
    return spark.createDataFrame([(i, None if i % 11 == 0 else float(p), float(q), float(t), i % 3) for i, (p, q, t)
                                  in enumerate(zip(a, b, y))], "k long, a double, b double, y double, fold int").cache()


def test_like_rows_keep_count_mean_and_squares(rows):
    got = N.like_rows(rows.select(F.col("y").alias("__y"), "a", "b", F.col("fold").alias("__fold")), ["a", "b"], [0])
    assert got.count() == 2 * 7 * 5
    one = got.agg(F.sum("__n"), F.sum(F.col("__n") * F.col("__y")), F.sum("__rest") + F.sum(F.col("__n") * F.col("__y") ** 2)).first()
    want = rows.agg(F.count("y"), F.sum("y"), F.sum(F.col("y") ** 2)).first()
    assert np.allclose(list(one), list(want), rtol=1e-12)


def test_networks_of_like_rows(rows, monkeypatch):
    sizes = []
    made = N.float_blocks
    monkeypatch.setattr(N, "float_blocks", lambda d, c: sizes.append(d.count()) or made(d, c))
    want = {s: N.NetWant(["a", "b"], {"a": 2.0, "b": 2.0}, s) for s in (0, None)}
    whole, jobs, group = (N.fit_networks(rows, "y", want, "fold", passes=8, local_bytes=size) for size in (1 << 30, 0, 10_000))
    assert sizes == [4_000] + 2 * [4_000, 2 * 7 * 5]
    for s in want:
        assert np.allclose(whole[s].w, jobs[s].w, rtol=1e-6, atol=1e-9)
        assert np.allclose(whole[s].w, group[s].w, rtol=1e-6, atol=1e-9)


def test_process_sums_and_slopes_of_like_rows(rows):
    cols = {s: ["a", "b"] for s in (0, "all")}
    specs = G.prepare_specs(rows, "y", "k", {s: {"a": 2.0, "b": 2.0} for s in cols}, "fold", cols, points=20)
    work = G._Search([specs[0], specs["all"]], [0, None], 20, ["a", "b"])
    base = rows.select(F.col("y").alias("__y"), "a", "b", F.col("fold").alias("__fold"))
    theta, m = np.array([0.3, -0.2, 0.1, -2.0]), 20
    rng = np.random.RandomState(1)
    at, slope_at = {i: theta for i in (0, 1)}, {i: (theta, rng.randn(m, m), rng.randn(m)) for i in (0, 1)}
    got = []
    for d in (base, N.like_rows(base, ["a", "b"], [0])):
        sums, slopes = {}, {}
        for r in N.float_blocks(d, ["a", "b"]).drop("id").collect():
            block = work.read(**r.asDict())
            N.add_up(sums, work.sums(at, *block))
            N.add_up(slopes, work.slopes(slope_at, *block))
        got.append((sums, slopes))
    for whole, like in zip(*got):
        assert all(np.allclose(whole[i], like[i], rtol=1e-9) for i in (0, 1))


def test_process_search_passes_like_rows_once(rows, monkeypatch):
    sizes = []
    made = G.float_blocks
    monkeypatch.setattr(G, "float_blocks", lambda d, c: sizes.append(d.count()) or made(d, c))
    cols = {"all": ["a", "b"]}
    specs = G.prepare_specs(rows, "y", "k", {"all": {"a": 2.0, "b": 2.0}}, None, cols, points=20)
    for size in (0, 10_000):
        G.fit_hyper(rows, specs, "y", None, points=20, passes=1, local_bytes=size)
    assert sizes == 2 * [4_000, 7 * 5]
