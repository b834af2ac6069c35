"""CSV sources and sinks.

The charset is chosen by one distributed pass (``is_valid_utf8`` over the
raw lines): UTF-8 when every line is valid, else cp932 (``windows-31j``).
Every column is read as a string; numeric inference is the P03 rule.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreg.operators.profile import apply_numeric_like, numeric_like_profile
from sparkreg.sources.records import ends_inside, file_lines, inside_splits, records

# The default missing-value tokens of the reference's CSV reader.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BOM = "\ufeff"
CP932 = "windows-31j"
PYTHON_CHARSET = {"UTF-8": "utf-8", CP932: "cp932"}
HEADER_LINES = 50              # lines that a header may span
#: Quotes inside a quoted field are doubled, on reading and on writing.
QUOTING = {"quote": '"', "escape": '"'}


def detect_charset(spark: SparkSession, path: str) -> str:
    """UTF-8 if every raw line is valid UTF-8, else cp932."""
    ok = spark.read.text(path).agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True))).first()[0]
    return "UTF-8" if ok else CP932


def parse_line(record: str) -> list[str]:
    """The fields of one record."""
    return next(iter(csv.reader(io.StringIO(record, newline=""), doublequote=True)), [])


def header_columns(spark: SparkSession, path: str, charset: str = "UTF-8") -> list[str]:
    """The raw header record (of the first file), names trimmed, BOM
    removed."""
    text = b""
    for file in sorted(spark.read.text(path).inputFiles()):
        for r in file_lines(spark, file).where("start = 0").take(HEADER_LINES):
            text += (b"\n" if text else b"") + r["line"]
            if not ends_inside(text.replace(b"\n", b" "), False):
                break
        if text:
            break
    names = parse_line(text.rstrip(b"\r").decode(PYTHON_CHARSET[charset], "replace").lstrip(BOM))
    return [n.strip() for n in names]


def header_report(spark: SparkSession, path: str) -> DataFrame:
    """S02 as a table: (position, column, duplicate)."""
    names = header_columns(spark, path, detect_charset(spark, path))
    seen: dict = {}
    rows = []
    for i, n in enumerate(names):
        rows.append((i, n, n in seen))
        seen[n] = True
    return spark.createDataFrame(rows, "position int, column string, duplicate boolean")


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool = True) -> DataFrame:
    """Charset fallback, header trimmed (duplicates refused), pandas NA
    tokens -> NULL, then the >= 90 % numeric rule per column.

    Quoted fields may hold line breaks; files are read in splits all the same
    (``records``).  Where no field does, and with ``multi_line=False``, which
    says so without looking, Spark's own reader splits the files.  A header
    of at most ``HEADER_LINES`` lines is expected in every file.
    """
    charset = detect_charset(spark, path)
    names = header_columns(spark, path, charset)
    if len(set(names)) != len(names):
        dup = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"duplicate_columns: {dup}")
    if charset == "UTF-8" and not (multi_line and inside_splits(spark, path)[1]):
        raw = spark.read.options(**QUOTING).option("header", True).option("inferSchema", False).csv(path)
        df = raw.toDF(*names)
    else:
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        parsed = F.from_csv("value", schema, {**QUOTING, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
        rows = records(spark, path, PYTHON_CHARSET[charset]).where("not header").select(parsed.alias("r"))
        df = rows.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)])
    df = df.select(*[F.when(F.col(f"`{c}`").isin(NA_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c)
                     for c in names])
    if not infer:
        return df
    prof = {r["column"]: r["to_numeric"] for r in numeric_like_profile(df, names).collect()}
    return apply_numeric_like(df, [c for c in names if prof.get(c)])


def write_scored_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """Input columns plus the prediction, UTF-8 with a BOM (the first
    header name carries U+FEFF, so the file starts EF BB BF)."""
    cols = df.columns
    out = df.select(*[F.col(f"`{c}`").alias(BOM + c if (bom and i == 0) else c) for i, c in enumerate(cols)])
    out.write.mode("overwrite").options(**QUOTING).option("header", True).option("encoding", "UTF-8").csv(path)
