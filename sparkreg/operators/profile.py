"""Profiling and statistics operators.

Every profile is ONE aggregation pass over the table producing a handful of
values per column, then unpivoted into a small long-format DataFrame with
``inline(array(struct ...))``.  Nothing row-sized reaches the driver; the
``fit_*`` helpers collect only those spec-sized results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.functions.scalar import NAN_CLASS, coerce_numeric, null_to_sentinel

# Fixed values that define the reference semantics.
MAX_MISS_RATE = 0.70          # numeric feature kept when missing rate < 0.70
CONST_STD_EPS = 1e-12         # constant when sample std below this
DUP_CORR_THRESH = 0.999       # duplicate when |corr| above this
NUMERIC_COERCE_MIN = 0.90     # string column becomes numeric at >= 90 % parsed
DROP_CARD_FRAC = 0.50         # category dropped when classes > 50 % of rows
ONEHOT_MAX_CARD = 10          # one-hot up to 10 classes, else target encoding
SKEW_THRESH = 0.75
Y_CLIP_MARGIN_FRAC = 0.05
SMEAR_RANGE = (0.5, 2.0)
MIN_ROWS_FOR_FENCE = 20
SKETCH_ACCURACY = 10_000       # rank error of the bracketing sketch: rows / 10,000

NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    out = []
    for name, typ in df.dtypes:
        if name in exclude:
            continue
        if typ.startswith(NUMERIC_TYPES) and typ != "boolean":
            out.append(name)
    return out


def category_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [n for n, t in df.dtypes if n not in exclude and (t == "string" or t == "boolean")]


def _long(one_row: DataFrame, rows: list[Column]) -> DataFrame:
    """Unpivot a one-row aggregate into one row per struct in ``rows``."""
    return one_row.select(F.inline(F.array(*rows)))


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, Sequence[float]]]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles (``quantile_cont``), exact for any number
    of rows and all columns at once.

    A sketch of every column brackets each quantile; the rows below each
    bracket are counted and only the values inside it (a few in 10,000) are
    grouped and ranked, so no task ever holds a column.  A bracket that the
    counts prove wrong is widened to the whole column.  All-null columns give
    None.
    """
    spots = [(name, c.cast("double"), float(p)) for name, (c, probs) in wanted.items() for p in probs]
    if not spots:
        return {name: [] for name in wanted}
    eps = 2.0 / SKETCH_ACCURACY
    aggs = []
    for i, (name, (c, probs)) in enumerate(wanted.items()):
        c = c.cast("double")
        around = [q for p in probs for q in (max(0.0, p - eps), min(1.0, p + eps))]
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"),
                 F.percentile_approx(c, around, SKETCH_ACCURACY).alias(f"q{i}")]
    one = df.agg(*aggs).first()
    state = []                                    # per quantile: column, low rank, high rank, place, bracket
    for i, (name, (c, probs)) in enumerate(wanted.items()):
        n = one[f"n{i}"]
        for j, p in enumerate(probs):
            if not n:
                state.append(None)
                continue
            h = p * (n - 1)
            lo, hi = one[f"q{i}"][2 * j], one[f"q{i}"][2 * j + 1]
            state.append({"c": c.cast("double"), "r0": math.floor(h), "r1": math.ceil(h), "h": h, "lo": lo, "hi": hi,
                          "ends": (one[f"a{i}"], one[f"b{i}"])})
    out: list[float | None] = [None] * len(state)
    todo = [i for i, s in enumerate(state) if s]
    while todo:
        row = df.agg(*[a for i in todo for a in (
            F.count_if(state[i]["c"] < F.lit(state[i]["lo"])).alias(f"u{i}"),
            F.count_if((state[i]["c"] >= F.lit(state[i]["lo"])) & (state[i]["c"] <= F.lit(state[i]["hi"])))
            .alias(f"v{i}"))]).first()
        again, rank = [], []
        for i in todo:
            s = state[i]
            s["below"] = row[f"u{i}"]
            if not (s["below"] <= s["r0"] and s["r1"] < s["below"] + row[f"v{i}"]):
                s["lo"], s["hi"] = s["ends"]
                again.append(i)
            elif s["lo"] == s["hi"]:
                out[i] = float(s["lo"])
            else:
                rank.append(i)
        if rank:
            inside = F.array(*[F.when((state[i]["c"] >= F.lit(state[i]["lo"])) & (state[i]["c"] <= F.lit(state[i]["hi"])),
                                      F.struct(F.lit(i).alias("i"), state[i]["c"].alias("v"))) for i in rank])
            vals = (df.select(F.explode(F.array_compact(inside)).alias("x")).groupBy("x.i", "x.v")
                    .agg(F.count(F.lit(1)).alias("n")))
            upto = vals.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v")))
            first = lambda r: F.min(F.when(F.col("upto") > F.element_at(r, F.col("i")), F.col("v")))
            table = lambda k: F.create_map(*[F.lit(x) for i in rank for x in (i, state[i][k] - state[i]["below"])])
            for r in upto.groupBy("i").agg(first(table("r0")).alias("x0"), first(table("r1")).alias("x1")).collect():
                s = state[r["i"]]
                out[r["i"]] = float(r["x0"]) if s["r0"] == s["r1"] else \
                    (s["r1"] - s["h"]) * r["x0"] + (s["h"] - s["r0"]) * r["x1"]
        todo = again
    it = iter(out)
    return {name: [next(it) for _ in probs] for name, (_, probs) in wanted.items()}


def distinct_counts(df: DataFrame, cols: dict[str, Column]) -> dict[str, int]:
    """Exact numbers of different non-null values, all columns by one grouped
    job: (column, value) pairs collapse map-side, so a hot value costs one row
    per task and no row is copied beyond the pairs themselves."""
    if not cols:
        return {}
    names = list(cols)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), cols[c].cast("string").alias("v")) for i, c in enumerate(names)])
    got = (df.select(F.explode(pairs).alias("x")).select("x.i", "x.v").where("v is not null").groupBy("i", "v")
           .agg(F.lit(1).alias("one")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect())
    found = {r["i"]: int(r["n"]) for r in got}
    return {c: found.get(i, 0) for i, c in enumerate(names)}


# ---------------------------------------------------------------- P01 / P02
def target_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """Resolve the target (named, else last column) and validate it.
    One row: target, n_rows, n_null, n_not_numeric, example, status."""
    name = target if target is not None else df.columns[-1]
    if name not in df.columns:
        return df.sparkSession.createDataFrame(
            [(name, None, None, None, None, "target_col_not_found")],
            "target string, n_rows bigint, n_null bigint, n_not_numeric bigint, example string, status string")
    raw = F.col(name)
    num = raw.cast("string").try_cast("double") if dict(df.dtypes)[name] == "string" else raw.cast("double")
    bad = num.isNull() & raw.isNotNull()
    agg = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(raw.isNull()).alias("n_null"),
        F.count_if(bad).alias("n_not_numeric"),
        F.min(F.when(bad, raw.cast("string"))).alias("example"),
    )
    status = (F.when(F.col("n_not_numeric") > 0, F.lit("target_col_not_numeric"))
              .when(F.col("n_null") == F.col("n_rows"), F.lit("target_all_na"))
              .otherwise(F.lit("ok")))
    return agg.select(F.lit(name).alias("target"), "n_rows", "n_null", "n_not_numeric", "example",
                      status.alias("status"))


def drop_null_target(df: DataFrame, y: str) -> DataFrame:
    """Rows whose target is NULL are removed."""
    return df.filter(F.col(y).isNotNull())


# ---------------------------------------------------------------- P03 / P04
def numeric_like_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of rows parseable as numbers (nulls count as failures);
    ``to_numeric`` when >= 90 %."""
    aggs = [F.avg(coerce_numeric(F.col(c)).isNotNull().cast("double")).alias(f"r{i}")
            for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("parse_rate"),
                     (F.col(f"r{i}") >= NUMERIC_COERCE_MIN).alias("to_numeric"))
            for i, c in enumerate(cols)]
    return _long(one, rows)


def apply_numeric_like(df: DataFrame, to_numeric: Sequence[str]) -> DataFrame:
    """P04 applied to the columns P03 chose."""
    return df.select(*[coerce_numeric(F.col(c)).alias(c) if c in to_numeric else F.col(c)
                       for c in df.columns])


# ---------------------------------------------------------------- P05
def missing_profile(df: DataFrame, target: str) -> DataFrame:
    """Numeric columns other than the target with missing rate < 0.70."""
    cols = numeric_columns(df, exclude=[target])
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_rate"),
                     (F.col(f"m{i}") < MAX_MISS_RATE).alias("selected"))
            for i, c in enumerate(cols)]
    return _long(one, rows)


def fit_feature_columns(df: DataFrame, target: str) -> list[str]:
    return [r["column"] for r in missing_profile(df, target).collect() if r["selected"]]


# ---------------------------------------------------------------- P06
def constant_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Constant when at most one distinct non-null value or sample std
    below 1e-12 (a single row has no std, treated as 0)."""
    one = df.agg(*[F.coalesce(F.stddev_samp(F.col(f"`{c}`").cast("double")), F.lit(0.0)).alias(f"s{i}")
                   for i, c in enumerate(cols)]).first() if cols else None
    plain = lambda c: F.col(f"`{c}`") + 0.0 if dict(df.dtypes)[c] in ("double", "float") else F.col(f"`{c}`")
    nd = distinct_counts(df, {c: plain(c) for c in cols})
    rows = [(c, nd[c], float(one[f"s{i}"]), nd[c] <= 1 or one[f"s{i}"] < CONST_STD_EPS) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, n_distinct bigint, std double, is_constant boolean")


# ---------------------------------------------------------------- P07
def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair after median fill: medians,
    then one pass that adds up the outer products of the median-centred rows
    (a p x p matrix per task, not p * p expressions)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation
    cols = list(cols)
    schema = "column string, pos int, other string, other_pos int, corr double"
    if len(cols) < 2 or df.isEmpty():
        return df.sparkSession.createDataFrame(
            [(a, i, b, j, None) for i, a in enumerate(cols) for j, b in enumerate(cols[:i])], schema)
    med = fit_medians(df, cols)
    z = [F.coalesce(F.col(f"`{c}`").cast("double") - F.lit(float(med[c])), F.lit(0.0)) for c in cols]
    m = Correlation.corr(df.select(array_to_vector(F.array(*z)).alias("v")), "v").first()[0].toArray()
    rows = [(a, i, b, j, float(m[i, j]) if math.isfinite(m[i, j]) else None)
            for i, a in enumerate(cols) for j, b in enumerate(cols[:i])]
    return df.sparkSession.createDataFrame(rows, schema)


def duplicate_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Greedy left-to-right; a column is dropped when |corr| > 0.999
    with an already kept column.  The p x p matrix is spec-sized."""
    pairs = correlation_pairs(df, cols).collect()
    dup = {(r["pos"], r["other_pos"]) for r in pairs
           if r["corr"] is not None and abs(r["corr"]) > DUP_CORR_THRESH}
    kept: list[int] = []
    out = []
    for i, c in enumerate(cols):
        hit = next((k for k in kept if (i, k) in dup), None)
        if hit is None:
            kept.append(i)
        out.append((c, i, hit is None, cols[hit] if hit is not None else None))
    return df.sparkSession.createDataFrame(out, "column string, pos int, kept boolean, duplicate_of string")


# ---------------------------------------------------------------- A06 / P08
def category_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, class, n) for every class, nulls as ``__NaN__``, from one
    scan of the table.  The grouping aggregates map-side first, so a hot class costs nothing extra."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), null_to_sentinel(F.col(f"`{c}`")).alias("class")) for c in cols])
    return (df.select(F.explode(pairs).alias("x")).groupBy(F.col("x.column").alias("column"), F.col("x.class").alias("class"))
            .agg(F.count(F.lit(1)).alias("n")))


def high_card_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop a category column when classes > max(1, int(0.5 * rows));
    one-hot when <= 10 classes; otherwise target encoding."""
    k = distinct_counts(df, {c: null_to_sentinel(F.col(f"`{c}`")) for c in cols})
    n = df.count()
    limit = max(1, math.floor(n * DROP_CARD_FRAC))
    rows = [(c, k[c], n, k[c] > limit, "drop" if k[c] > limit else "onehot" if k[c] <= ONEHOT_MAX_CARD else "target")
            for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column string, n_classes bigint, n_rows bigint, dropped boolean, method string")


# ---------------------------------------------------------------- A01
def count_duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group (warning only).
    Rows are grouped by a 96-bit fingerprint (xxhash64 + murmur3 of every
    column and of which columns are NULL, since a hash skips NULLs) so the
    shuffle moves 12 bytes per distinct row, not whole rows; map-side partial
    counts collapse repeated rows before the shuffle."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    cols += [c.isNull() for c in cols]
    g = df.groupBy(F.xxhash64(*cols).alias("__h1"), F.hash(*cols).alias("__h2")).agg(
        F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicate_rows"))


# ---------------------------------------------------------------- A02 / A03
def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    got = quantiles(df, {c: (F.col(f"`{c}`"), [0.5]) for c in cols})
    return {c: v if v is not None else 0.0 for c, (v,) in got.items()}


def median_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per-column median, all-null column -> 0.0."""
    return df.sparkSession.createDataFrame(list(fit_medians(df, cols).items()), "column string, median double")


def x_clip_profile(df: DataFrame, cols: Sequence[str], lo_q: float = 0.01, hi_q: float = 0.99) -> DataFrame:
    """1 % / 99 % quantiles per column, kept only when lo < hi."""
    got = quantiles(df, {c: (F.col(f"`{c}`"), [lo_q, hi_q]) for c in cols})
    rows = [(c, lo, hi, lo is not None and lo < hi) for c, (lo, hi) in got.items()]
    return df.sparkSession.createDataFrame(rows, "column string, lo double, hi double, kept boolean")


def fit_x_clip(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    if not cols:
        return {}
    return {r["column"]: (r["lo"], r["hi"]) for r in x_clip_profile(df, cols).collect() if r["kept"]}


# ---------------------------------------------------------------- A04 / A05
def y_fence_profile(df: DataFrame, y: str, mult: float) -> DataFrame:
    """[q1 - m*IQR, q3 + m*IQR]; only fitted from >= 20 rows."""
    n = df.agg(F.count(F.col(f"`{y}`"))).first()[0]
    lo = hi = None
    if n >= MIN_ROWS_FOR_FENCE:
        q1, q3 = quantiles(df, {y: (F.col(f"`{y}`"), [0.25, 0.75])})[y]
        lo, hi = q1 - (q3 - q1) * mult, q3 + (q3 - q1) * mult
    return df.sparkSession.createDataFrame([(n, lo, hi)], "n bigint, lo double, hi double")


def skew_profile(df: DataFrame, y: str) -> DataFrame:
    """Population skewness, 0 when population std < 1e-12.  Written as
    central moments (m3 / m2^1.5) -- Spark's ``skewness`` is exactly that."""
    m = df.agg(F.avg(F.col(y)).alias("mu"), F.stddev_pop(F.col(y)).alias("sd"),
               F.skewness(F.col(y)).alias("sk"), F.count(F.col(y)).alias("n"))
    return m.select("n", F.when(F.col("sd") < CONST_STD_EPS, F.lit(0.0)).otherwise(F.col("sk")).alias("skew"))


# ---------------------------------------------------------------- A13 / A14 / A15
def is_integer_expr(y: str) -> Column:
    return F.coalesce(F.bool_and(F.col(y) % 1 == 0), F.lit(True))


def target_is_integer(df: DataFrame, y: str) -> DataFrame:
    """Every y is integral."""
    return df.agg(is_integer_expr(y).alias("is_integer"))


def y_range_profile(df: DataFrame, y: str) -> DataFrame:
    """[min - 5 % span, max + 5 % span]; span 0 -> margin max(|max|, 1)."""
    one = df.agg(F.min(y).alias("y_min"), F.max(y).alias("y_max"))
    span = F.col("y_max") - F.col("y_min")
    margin = F.when(span > 0, span * Y_CLIP_MARGIN_FRAC).otherwise(F.greatest(F.abs(F.col("y_max")), F.lit(1.0)))
    return one.select("y_min", "y_max", (F.col("y_min") - margin).alias("lo"), (F.col("y_max") + margin).alias("hi"))


def smear_profile(df: DataFrame, y: str, pred: str) -> DataFrame:
    """median(y / max(pred, 1e-6)) limited to [0.5, 2] (log1p only)."""
    m = quantiles(df, {"m": (F.col(y) / F.greatest(F.col(pred), F.lit(1e-6)), [0.5])})["m"][0]
    smear = 1.0 if m is None else min(max(m, SMEAR_RANGE[0]), SMEAR_RANGE[1])
    return df.sparkSession.createDataFrame([(smear,)], "smear double")


# ---------------------------------------------------------------- A16 / T02
def corr_profile(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """|Pearson| of each feature with y over pairwise non-null rows;
    needs >= 2 pairs and both std >= 1e-12."""
    aggs = []
    for i, c in enumerate(cols):
        both = F.col(c).isNotNull() & F.col(y).isNotNull()
        xc, yc = F.when(both, F.col(c).cast("double")), F.when(both, F.col(y))
        aggs += [F.corr(xc, yc).alias(f"r{i}"), F.count_if(both).alias(f"n{i}"),
                 F.stddev_pop(xc).alias(f"sx{i}"), F.stddev_pop(yc).alias(f"sy{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        ok = (F.col(f"n{i}") >= 2) & (F.col(f"sx{i}") >= CONST_STD_EPS) & (F.col(f"sy{i}") >= CONST_STD_EPS)
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"),
                             F.when(ok, F.abs(F.col(f"r{i}"))).alias("abs_corr")))
    return _long(one, rows)


def top_by_corr(df: DataFrame, cols: Sequence[str], y: str, k: int) -> DataFrame:
    """Top-k columns by |corr| (ties by position), output in original
    column order.  With no rankable column the first k are used."""
    prof = corr_profile(df, cols, y).filter(F.col("abs_corr").isNotNull())
    top = prof.orderBy(F.desc("abs_corr"), F.asc("pos")).limit(k)
    return top.orderBy("pos").select("column", "pos", "abs_corr")


# ---------------------------------------------------------------- A19
def prediction_summary(df: DataFrame, pred: str) -> DataFrame:
    """Rows, mean, sample std of the predictions (2 dp)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(pred), 2).alias("pred_mean"),
                  F.round(F.stddev_samp(pred), 2).alias("pred_std"))
