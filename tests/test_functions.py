"""Hand-checkable scalar cases (encoding matrix, rounding, transforms)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreg.functions import scalar as S
from sparkreg.operators.linear import LinearSpec


def test_round_half_away(spark):
    df = spark.createDataFrame([(0.5,), (-0.5,), (1.5,), (2.5,), (-2.5,), (0.49999999999999994,), (None,)], "x double")
    got = [r[0] for r in df.select(S.round_half_away("x")).collect()]
    assert got[:5] == [1.0, -1.0, 2.0, 3.0, -3.0]
    assert got[5] == 0.0 or got[5] == 1.0   # floor(abs+0.5) in float64
    assert got[6] is None


@pytest.mark.parametrize("lam", [0.7, 0.0, 2.0, -1.3])
def test_yeo_johnson_roundtrip(spark, lam):
    xs = [-5.0, -1.0, -0.1, 0.0, 0.1, 1.0, 7.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(S.yeo_johnson_inverse(S.yeo_johnson("x", lam), lam)).collect()]
    assert np.allclose(got, xs, atol=1e-9)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (5.0,), (10.0,)], "x double")
    got = [r[0] for r in df.select(S.clip("x", 0.0, 6.0)).collect()]
    assert got == [None, 0.0, 5.0, 6.0]


def test_coerce_numeric_whole_cell(spark):
    vals = ["12", " 1.5e3 ", "12abc", "1d", "inf", "NaN", ".5", "-3.", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(S.coerce_numeric("s")).collect()]
    assert got == [12.0, 1500.0, None, None, None, None, 0.5, -3.0, None]


def test_finite_or_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(S.finite_or_null("x")).collect()] == [None, None, None, 1.0]


def test_bool_labels_and_sentinel(spark):
    df = spark.createDataFrame([(True, "a"), (False, ""), (None, None)], "b boolean, s string")
    got = df.select(S.bool_label("b"), S.null_to_sentinel("s")).collect()
    assert [tuple(r) for r in got] == [("True", "a"), ("False", "__NaN__"), (None, "__NaN__")]


# Encoding-matrix linear cases (identity scaler), tolerance rel 1e-4.
CASES = [
    ({"big_x1": 2.0, "big_x2": 3.0}, 1000.0,
     [(1e6, 2e6), (-1234567.891, 500000.5), (999999.999, -999999.999)], [8001000.0, -968134.282, -998999.999]),
    ({"c1": 2.0, "c2": 5.0}, 0.0, [(1, 3), (2, 4)], [17.0, 24.0]),
    ({"a": 10.0, "b": 1.0}, 0.0, [(1, 2), (3, 4)], [12.0, 34.0]),
    ({"c1": 2.0, "c2": 3.0}, 0.0, [(1, 5), (2, 1)], [17.0, 7.0]),
]


@pytest.mark.parametrize("coef,icp,rows,expected", CASES)
def test_linear_encoding_cases(spark, coef, icp, rows, expected):
    names = list(coef)
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in rows], ", ".join(f"{n} double" for n in names))
    spec = LinearSpec(names, [coef[n] for n in names], icp, {n: 0.0 for n in names}, 1.0)
    got = [r[0] for r in df.select(spec.predict()).collect()]
    for g, e in zip(got, expected):
        assert abs(g - e) <= max(1e-6, 1e-4 * abs(e))


@pytest.mark.parametrize("transform", ["none", "log1p", "yj07", "yj00", "yj20"])
@pytest.mark.parametrize("rounding", [False, True])
def test_postprocess_chain(spark, transform, rounding):
    """Inverse transform -> smear -> clip -> optional rounding, vs numpy."""
    raw = np.array([-0.7, 0.0, 0.3, 1.2, 2.5, 4.9])
    df = spark.createDataFrame([(float(v),) for v in raw], "p double")
    lam = {"yj07": 0.7, "yj00": 0.0, "yj20": 2.0}.get(transform)
    col = F.col("p")
    if transform == "log1p":
        col, ref = S.expm1_inv(col), np.expm1(raw)
    elif lam is not None:
        col = S.yeo_johnson_inverse(col, lam)
        ref = np.array([_yj_inv(v, lam) for v in raw])
    else:
        ref = raw.copy()
    smear = 1.08 if transform == "log1p" else 1.0
    out = [r[0] for r in df.select(S.postprocess(col, smear, -0.5, 20.0, rounding)).collect()]
    exp = np.clip(ref * smear, -0.5, 20.0)
    if rounding:
        exp = np.copysign(np.floor(np.abs(exp) + 0.5), exp)
    assert np.allclose(out, exp, rtol=1e-9, atol=1e-12)


def _yj_inv(y, lam):
    if y >= 0:
        return math.expm1(y) if abs(lam) < 1e-6 else max(lam * y + 1, 1e-12) ** (1 / lam) - 1
    return 1 - math.exp(-y) if abs(lam - 2) < 1e-6 else 1 - max(-(2 - lam) * y + 1, 1e-12) ** (1 / (2 - lam))
