"""Per-fold target encodings (the training-time M19 variant) against a
brute-force pandas computation, with one class holding a third of the rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkreg.operators.encode import fold_target_encodings


def test_fold_encodings_with_hot_class(spark):
    rng = np.random.RandomState(4)
    n = 600
    cls = np.where(np.arange(n) % 3 == 0, "HOT", np.array([f"c{i % 37}" for i in range(n)]))
    cls = np.where(np.arange(n) % 97 == 5, None, cls)
    y = rng.normal(size=n) + (cls == "HOT") * 2.0
    fold = rng.randint(0, 5, n)
    pdf = pd.DataFrame({"id": np.arange(n), "c": cls, "y": y, "fold": fold})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, c string, y double, fold int")
    out = fold_target_encodings(df, "c", "y", "fold", [0, 1, 2, 3, 4], n_classes=40).toPandas().set_index("id")
    key = pdf["c"].fillna("__NaN__")
    for f in [0, 1, 2, 3, 4]:
        tr = pdf[pdf.fold != f]
        g = tr["y"].mean()
        st = tr.groupby(key[pdf.fold != f])["y"].agg(["count", "sum"])
        exp = key.map(lambda k: (st.loc[k, "sum"] + 20 * g) / (st.loc[k, "count"] + 20) if k in st.index else g)
        got = out.loc[pdf["id"], f"c__f{f}"].to_numpy()
        assert np.allclose(got, exp.to_numpy(), rtol=1e-10, atol=1e-12)
    g = pdf["y"].mean()
    st = pdf.groupby(key)["y"].agg(["count", "sum"])
    exp = key.map(lambda k: (st.loc[k, "sum"] + 20 * g) / (st.loc[k, "count"] + 20))
    assert np.allclose(out.loc[pdf["id"], "c__all"].to_numpy(), exp.to_numpy(), rtol=1e-10)
