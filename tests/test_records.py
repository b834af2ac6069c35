"""CSV with line breaks in quoted fields, split at every possible place,
against Python's csv module."""

import csv
import io
import random

import pytest

from sparkreg.session import scratch_path
from sparkreg.sources.csv import read_csv
from sparkreg.sources.records import ends_inside, inside_splits


def write(spark, name, files):
    import os
    root = scratch_path(spark, name).removeprefix("file:")
    os.makedirs(root)
    for i, data in enumerate(files):
        with open(f"{root}/part-{i}.csv", "wb") as f:
            f.write(data)
    return root


def table(rng, n, eol="\n"):
    odd = ["plain", "a,b", 'say "hi"', "two\nlines", "three\n\n\"lines\",\n", "", '5" pipe', "é漢", "x" * 90, "\n", '"', "end\n"]
    rows = [[str(i), rng.choice(odd), rng.choice(odd), f"v{i}"] for i in range(n)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=eol)
    w.writerow(["id", " text ", "more,\nof it", "last"])
    w.writerows(rows)
    return rows, out.getvalue()


def read(df):
    return sorted(([None if v is None else v for v in r] for r in df.collect()), key=lambda r: int(float(r[0])))


@pytest.mark.parametrize("split", [64, 333, 1 << 20])
def test_any_split_gives_the_same_records(spark, split):
    rng = random.Random(split)
    rows, text = table(rng, 120)
    path = write(spark, "csv-split", [text.encode()])
    old = [(k, spark.conf.get(k)) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    try:
        for k, _ in old:
            spark.conf.set(k, split)
        assert inside_splits(spark, path)[1]
        df = read_csv(spark, path, infer=False)
        assert df.columns == ["id", "text", "more,\nof it", "last"]
        if split < 1000:
            assert df.rdd.getNumPartitions() > 3
        got = read(df)
    finally:
        for k, v in old:
            spark.conf.set(k, v)
    assert [[v or "" for v in r] for r in got] == rows


def test_charsets_marks_and_several_files(spark):
    rng = random.Random(1)
    one, text = table(rng, 20, "\r\n")
    two, more = table(rng, 15, "\r\n")
    two = [[str(100 + i), *r[1:]] for i, r in enumerate(two)]
    out = io.StringIO()
    csv.writer(out).writerows([["id", "text", "more,\nof it", "last"], *two])
    path = write(spark, "csv-files", [b"\xef\xbb\xbf" + text.encode(), out.getvalue().encode(), b""])
    got = read(read_csv(spark, path, infer=False))
    assert [[v or "" for v in r] for r in got] == one + two
    rows = [["1", "カナ\n改行", "表"], ["2", 'ソ"能', "x"]]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "名", "値"], *rows])
    path = write(spark, "csv-932", [out.getvalue().encode("cp932")])
    df = read_csv(spark, path, infer=False)
    assert df.columns == ["id", "名", "値"] and read(df) == rows
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_plain_files_keep_the_plain_reader(spark):
    path = write(spark, "csv-plain", [b'a,b\n1,"x, y"\n2,5" pipe\n\n3,""\n'])
    assert not inside_splits(spark, path)[1]
    df = read_csv(spark, path)
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1.0, "x, y"), (2.0, '5" pipe'), (3.0, None)]


def test_a_field_that_never_ends(spark):
    path = write(spark, "csv-open", [b'a,b\n1,x\n2,"never\nends\n'])
    assert [r["a"] for r in read_csv(spark, path, infer=False).collect()] == ["1", "2"]


def test_state_of_a_line():
    outside = {b"a,b": False, b'a,"b': True, b'"a""': True, b'x"y,"': True, b'"a","b"': False, b'",': True, b"": False, b'""': False}
    inside = {b"a,b": True, b'a,"b': False, b'",': False, b"": True, b'""': True, b'x",y,"z': True}
    assert {k: ends_inside(k, False) for k in outside} == outside
    assert {k: ends_inside(k, True) for k in inside} == inside
