"""CSV charset fallback, BOM, NA tokens, duplicate headers; streaming
scoring equals batch scoring."""

import os

import pytest
from pyspark.sql import functions as F

from sparkreg.session import scratch_path
from sparkreg.sources.csv import read_csv, write_scored_csv


def _write(path, data: bytes):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.csv"), "wb") as fh:
        fh.write(data)


def test_bom_utf8(spark):
    p = scratch_path(spark, "bom")
    _write(p, b"\xef\xbb\xbfa,b\n1,2\n3,4\n")
    rows = read_csv(spark, p).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.0), (3.0, 4.0)]


def test_cp932_fallback(spark):
    p = scratch_path(spark, "cp932")
    _write(p, "面積,築年数\n1,3\n2,4\n".encode("cp932"))
    df = read_csv(spark, p)
    assert df.columns == ["面積", "築年数"]
    assert sorted(tuple(r) for r in df.collect()) == [(1.0, 3.0), (2.0, 4.0)]


def test_na_tokens_and_numeric_rule(spark):
    p = scratch_path(spark, "na")
    body = "x,s\n" + "".join(f"{i},{'NA' if i % 5 == 0 else i}\n" for i in range(20))
    _write(p, body.encode())
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"x": "double", "s": "string"}    # 80 % parse < 90 %


def test_duplicate_header_refused(spark):
    p = scratch_path(spark, "dup")
    _write(p, b"a, a\n1,2\n")
    with pytest.raises(ValueError):
        read_csv(spark, p)


def test_scored_csv_has_bom(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, y double")
    p = scratch_path(spark, "out")
    write_scored_csv(df, p)
    f = [x for x in os.listdir(p) if x.endswith(".csv")][0]
    with open(os.path.join(p, f), "rb") as fh:
        assert fh.read(3) == b"\xef\xbb\xbf"


def test_stream_scoring_equals_batch(spark):
    """The scoring plan on a file stream gives the batch result."""
    import numpy as np

    from sparkreg.plans.score import score
    from sparkreg.plans.train import save, train
    from sparkreg.sources.model_io import load_bundle
    from sparkreg.streaming.score_stream import score_stream

    rng = np.random.RandomState(2)
    rows = [(i, float(rng.uniform(-2, 2)), ["A", "B", "C"][i % 3], float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y double")
    res = train(df, "y", key="id", families=("linear",))
    root = scratch_path(spark, "s-bundle")
    save(res, root)
    b = load_bundle(spark, root)
    src = scratch_path(spark, "s-src")
    df.drop("y").repartition(3).write.parquet(src)
    out, ck = scratch_path(spark, "s-out"), scratch_path(spark, "s-ck")
    score_stream(spark, src, df.drop("y").schema, b, out, ck)
    streamed = spark.read.parquet(out).select("id", F.round("y", 9).alias("p"))
    batch = score(df.drop("y"), b).select("id", F.round("y", 9).alias("p"))
    assert streamed.count() == 120
    assert streamed.exceptAll(batch).count() == 0


def test_quotes_and_line_breaks_round_trip(spark):
    from sparkreg.session import write_text
    from sparkreg.sources.csv import read_csv, write_scored_csv
    path = scratch_path(spark, "quotes.csv")
    write_text(spark, path, 'k,s,y\n1,"he said ""hi"", ok",2\n2,"two\nlines",3\n')
    df = read_csv(spark, path)
    assert [tuple(r) for r in df.collect()] == [(1.0, 'he said "hi", ok', 2.0), (2.0, "two\nlines", 3.0)]
    out = scratch_path(spark, "quotes-out")
    write_scored_csv(df, out)
    assert read_csv(spark, out).collect() == df.collect()
    assert any('""hi""' in r["value"] for r in spark.read.text(out).collect())


def test_duplicate_rows_with_nulls(spark):
    from sparkreg.operators.profile import count_duplicate_rows
    df = spark.createDataFrame([(1, None), (None, 1), (None, 1), (1, 1)], "a int, b int")
    assert count_duplicate_rows(df).first()[0] == 1


def test_pointer_swap_replaces(spark):
    from sparkreg.session import read_text, rename, write_text
    root = scratch_path(spark, "swap")
    for v in ("1", "2"):
        write_text(spark, f"{root}/new", v)
        rename(spark, f"{root}/new", f"{root}/CURRENT")
        assert read_text(spark, f"{root}/CURRENT") == v
