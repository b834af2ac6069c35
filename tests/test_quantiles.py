"""Exact quantiles and distinct counts against numpy and Python, with coarse
sketches so that brackets, ties and widening are exercised."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreg.operators import profile as P


@pytest.mark.parametrize("accuracy", [10_000, 25])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(P, "SKETCH_ACCURACY", accuracy)
    rng = np.random.RandomState(5)
    n = 3000
    cols = {"flat": rng.uniform(-5, 5, n), "hot": np.where(rng.rand(n) < 0.4, 7.0, rng.exponential(3, n)),
            "few": rng.randint(0, 3, n).astype(float), "one": np.full(n, 2.5), "gaps": rng.normal(size=n),
            "none": np.zeros(n)}
    keep = {c: np.ones(n, bool) for c in cols}
    keep["gaps"] = rng.rand(n) < 0.3
    keep["none"][:] = False
    rows = [(i, *[float(cols[c][i]) if keep[c][i] else None for c in cols]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = P.quantiles(df, {c: (F.col(c), probs) for c in cols})
    for c in cols:
        if keep[c].any():
            assert np.allclose(got[c], np.quantile(cols[c][keep[c]], probs), rtol=0, atol=1e-12)
        else:
            assert got[c] == [None] * len(probs)
    part = P.quantiles(df, {"half": (F.when(F.col("id") % 2 == 0, F.col("flat")), [0.5])})
    assert part["half"][0] == pytest.approx(np.median(cols["flat"][::2]), abs=1e-12)
    assert P.quantiles(df, {}) == {}


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (None, "b")], "a int, b string")
    assert P.distinct_counts(df, {"a": F.col("a"), "b": F.col("b")}) == {"a": 2, "b": 2}
    assert P.distinct_counts(df.where("false"), {"a": F.col("a")}) == {"a": 0}
