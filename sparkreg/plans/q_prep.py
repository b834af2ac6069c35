"""Registered queries: row-wise functions, cleaning and profiling
(S03, P01-P10, A01-A09, A13-A16, A18-A19, F01-F15).

Input columns that need nulls, NaN or negatives are made with the same
expression in the query and its oracle (e.g. ``nullif(l_quantity, 1)``).
Floats are rounded to 6 decimals on both sides; summation order differs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreg.functions import scalar as S
from sparkreg.operators import profile as P
from sparkreg.operators import transform as TR
from sparkreg.plans.catalog import query
from sparkreg.sources.tables import table

R = 6


def rnd(c, n=R):
    return F.round(c, n)


LI_KEY = ["l_orderkey", "l_linenumber"]


# ---------------------------------------------------------------- S03
NONFINITE_SRC = ("CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) "
                 "WHEN l_linenumber = 2 THEN CAST('Infinity' AS DOUBLE) "
                 "WHEN l_linenumber = 3 THEN CAST('-Infinity' AS DOUBLE) ELSE l_tax END")


@query("src_nonfinite_to_null", f"""
SELECT l_orderkey, l_linenumber,
       CASE WHEN isnan(x) OR abs(x) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE x END AS x
FROM (SELECT l_orderkey, l_linenumber, {NONFINITE_SRC} AS x FROM lineitem)
""")
def q_src_nonfinite_to_null(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_KEY, F.expr(NONFINITE_SRC).alias("x"))
    return li.select(*LI_KEY, S.finite_or_null("x").alias("x"))


# ---------------------------------------------------------------- P01 / P02
@query("target_resolve", """
SELECT 'value' AS target, count(*) AS n_rows, CAST(count_if(value IS NULL) AS BIGINT) AS n_null,
       CAST(0 AS BIGINT) AS n_not_numeric, CAST(NULL AS VARCHAR) AS example,
       CASE WHEN count_if(value IS NULL) = count(*) THEN 'target_all_na' ELSE 'ok' END AS status
FROM events
""")
def q_target_resolve(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return P.target_report(ev)          # last column is the target


@query("target_drop_null", """
SELECT l_orderkey, l_linenumber, y FROM (
  SELECT l_orderkey, l_linenumber, nullif(l_quantity, 1) AS y FROM lineitem) WHERE y IS NOT NULL
""")
def q_target_drop_null(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_KEY, F.nullif("l_quantity", F.lit(1.0)).alias("y"))
    return P.drop_null_target(li, "y")


# ---------------------------------------------------------------- P03 / P04
NUM_RE = S.NUMERIC_PATTERN
STR_COLS_SQL = {
    "s_value": "CAST(value AS VARCHAR)",
    "s_user": "CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END",
    "s_type": "event_type",
    "s_mixed": "CASE WHEN event_type = 'view' THEN concat(CAST(user_id AS VARCHAR), 'x') ELSE CAST(user_id AS VARCHAR) END",
}


def _coerce_sql(c):
    return f"CASE WHEN regexp_matches({c}, '{NUM_RE}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


@query("infer_numeric_like", " UNION ALL ".join(
    f"SELECT '{k}' AS column, avg(CAST(({_coerce_sql(v)}) IS NOT NULL AS DOUBLE)) AS parse_rate, "
    f"avg(CAST(({_coerce_sql(v)}) IS NOT NULL AS DOUBLE)) >= 0.9 AS to_numeric FROM events"
    for k, v in STR_COLS_SQL.items()))
def q_infer_numeric_like(spark, sf):
    ev = table(spark, sf, "events")
    s = ev.select(*[F.expr(v.replace("VARCHAR", "STRING")).alias(k) for k, v in STR_COLS_SQL.items()])
    return P.numeric_like_profile(s, list(STR_COLS_SQL))


COERCE_SRC = {
    "c_plain": "CAST(l_quantity AS VARCHAR)",
    "c_suffix": "concat(CAST(l_linenumber AS VARCHAR), CASE WHEN l_returnflag = 'R' THEN 'abc' ELSE '' END)",
    "c_exp": "concat(' ', CAST(l_linenumber AS VARCHAR), 'e1 ')",
    "c_javasuffix": "concat(CAST(l_linenumber AS VARCHAR), 'd')",
    "c_words": "CASE WHEN l_linestatus = 'O' THEN 'inf' ELSE concat('.', CAST(l_linenumber AS VARCHAR)) END",
}


@query("coerce_numeric", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{_coerce_sql(v)} AS {k}" for k, v in COERCE_SRC.items()) + " FROM lineitem")
def q_coerce_numeric(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*LI_KEY, *[S.coerce_numeric(F.expr(v.replace("VARCHAR", "STRING"))).alias(k)
                                for k, v in COERCE_SRC.items()])


# ---------------------------------------------------------------- P05 / P06 / P07
FEAT_SRC = {
    "f_qty": "l_quantity",
    "f_disc": "l_discount",
    "f_tax_n": "CASE WHEN l_returnflag = 'N' THEN l_tax END",
    "f_tax_r": "CASE WHEN l_returnflag = 'R' THEN l_tax END",
    "f_price": "l_extendedprice",
}


@query("select_features", " UNION ALL ".join(
    f"SELECT '{k}' AS column, avg(CAST(({v}) IS NULL AS DOUBLE)) AS missing_rate, "
    f"avg(CAST(({v}) IS NULL AS DOUBLE)) < 0.7 AS selected FROM lineitem" for k, v in FEAT_SRC.items()))
def q_select_features(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select(*[F.expr(v).alias(k) for k, v in FEAT_SRC.items()], F.col("l_extendedprice").alias("y"))
    return P.missing_profile(df, "y")


CONST_SRC = {
    "k_qty": "l_quantity",
    "k_zero": "l_tax * 0",
    "k_one": "CASE WHEN l_quantity > 0 THEN 1.0 END",
    "k_flag": "CASE WHEN l_returnflag = 'A' THEN 2.0 ELSE 2.0 END",
    "k_disc": "l_discount",
}


@query("drop_constant", " UNION ALL ".join(
    f"SELECT '{k}' AS column, count(DISTINCT ({v})) AS n_distinct, "
    f"round(coalesce(stddev_samp({v}), 0.0), 6) AS std, "
    f"(count(DISTINCT ({v})) <= 1 OR coalesce(stddev_samp({v}), 0.0) < 1e-12) AS is_constant FROM lineitem"
    for k, v in CONST_SRC.items()))
def q_drop_constant(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select(*[F.expr(v).alias(k) for k, v in CONST_SRC.items()])
    return P.constant_profile(df, list(CONST_SRC)).withColumn("std", rnd(F.col("std")))


DUP_SRC = {
    "d_qty": "l_quantity",
    "d_qty2": "l_quantity * 2 + 1",
    "d_price": "l_extendedprice",
    "d_neg": "CASE WHEN l_quantity = 1 THEN NULL ELSE -3 * l_quantity END",
    "d_disc": "l_discount",
}


def _dup_sql() -> str:
    names = list(DUP_SRC)
    fill = ", ".join(f"coalesce({v}, (SELECT quantile_cont({v}, 0.5) FROM lineitem)) AS {k}"
                     for k, v in DUP_SRC.items())
    pairs = ", ".join(f"corr({names[i]}, {names[j]}) AS c{i}_{j}" for i in range(len(names)) for j in range(i))
    # greedy keep: column i kept when no kept j < i has |corr| > 0.999
    kept = {}
    dup_of = {}
    parts = []
    for i, n in enumerate(names):
        conds = []
        first = []
        for j in range(i):
            hit = f"(abs(c{i}_{j}) > 0.999 AND {kept[j]})"
            conds.append(hit)
            first.append(f"WHEN {hit} THEN '{names[j]}'")
        kept[i] = "(NOT (" + " OR ".join(conds) + "))" if conds else "TRUE"
        dup_of[i] = ("CASE " + " ".join(first) + " END") if first else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT '{n}' AS column, {i} AS pos, {kept[i]} AS kept, {dup_of[i]} AS duplicate_of FROM c")
    return (f"WITH f AS (SELECT {fill} FROM lineitem), c AS (SELECT {pairs} FROM f) "
            + " UNION ALL ".join(parts))


@query("drop_duplicate_cols", _dup_sql())
def q_drop_duplicate_cols(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select(*[F.expr(v).alias(k) for k, v in DUP_SRC.items()])
    return P.duplicate_profile(df, list(DUP_SRC))


# ---------------------------------------------------------------- P08 / A06
CAT_SRC = {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size_s": "CAST(p_size AS VARCHAR)"}


@query("drop_high_card", " UNION ALL ".join(
    f"SELECT '{k}' AS column, count(DISTINCT coalesce(nullif({v}, ''), '__NaN__')) AS n_classes, "
    f"count(*) AS n_rows, count(DISTINCT coalesce(nullif({v}, ''), '__NaN__')) > greatest(1, floor(count(*) * 0.5)) AS dropped, "
    f"CASE WHEN count(DISTINCT coalesce(nullif({v}, ''), '__NaN__')) > greatest(1, floor(count(*) * 0.5)) THEN 'drop' "
    f"WHEN count(DISTINCT coalesce(nullif({v}, ''), '__NaN__')) <= 10 THEN 'onehot' ELSE 'target' END AS method FROM part"
    for k, v in CAT_SRC.items()))
def q_drop_high_card(spark, sf):
    pt = table(spark, sf, "part")
    df = pt.select(*[F.expr(v.replace("VARCHAR", "STRING")).alias(k) for k, v in CAT_SRC.items()])
    return P.high_card_profile(df, list(CAT_SRC))


@query("category_profile", """
SELECT 'p_type' AS column, coalesce(nullif(p_type, ''), '__NaN__') AS class, count(*) AS n FROM part GROUP BY 2
UNION ALL
SELECT 'p_brand', coalesce(nullif(p_brand, ''), '__NaN__'), count(*) FROM part GROUP BY 2
UNION ALL
SELECT 'segment', coalesce(nullif(CASE WHEN p_size > 45 THEN NULL ELSE p_type END, ''), '__NaN__'), count(*)
FROM part GROUP BY 2
""")
def q_category_profile(spark, sf):
    pt = table(spark, sf, "part")
    df = pt.select("p_type", "p_brand", F.expr("CASE WHEN p_size > 45 THEN NULL ELSE p_type END").alias("segment"))
    return P.category_profile(df, ["p_type", "p_brand", "segment"])


# ---------------------------------------------------------------- P09 / P10
@query("align_to_model", """
WITH m AS (SELECT quantile_cont(nullif(l_quantity, 1), 0.5) AS mq, quantile_cont(l_discount, 0.5) AS md,
                  quantile_cont(l_tax, 0.5) AS mt FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce(nullif(l_quantity, 1), mq), 6) AS l_quantity,
       round(coalesce(l_discount, md), 6) AS l_discount, round(mt, 6) AS l_tax
FROM lineitem, m
""")
def q_align_to_model(spark, sf):
    from sparkreg.plans.score import align_to_model
    li = table(spark, sf, "lineitem").withColumn("l_quantity", F.nullif("l_quantity", F.lit(1.0)))
    feats = ["l_quantity", "l_discount", "l_tax"]
    medians = P.fit_medians(li, feats)
    incoming = li.select(*LI_KEY, "l_quantity", "l_discount", "l_extendedprice")   # l_tax absent
    out, missing = align_to_model(incoming, feats, medians, keep=LI_KEY)
    return out.select(*LI_KEY, *[rnd(F.col(c)).alias(c) for c in feats])


@query("attach_prediction", """
WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS p FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderstatus, round(m.p, 6) AS o_totalprice
FROM orders JOIN m USING (o_orderpriority)
""")
def q_attach_prediction(spark, sf):
    from sparkreg.plans.score import attach_prediction
    od = table(spark, sf, "orders")
    means = od.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("p"))
    scored = od.join(F.broadcast(means), "o_orderpriority").withColumn("__pred", rnd(F.col("p")))
    out = attach_prediction(scored.select("o_orderkey", "o_orderstatus", "o_totalprice", "__pred"),
                            "o_totalprice", "__pred")
    return out


# ---------------------------------------------------------------- A01 / A02 / A03
@query("count_duplicate_rows", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicate_rows FROM (
  SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount)
""")
def q_count_duplicate_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return P.count_duplicate_rows(li)


NUM_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("median_table", " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(coalesce(quantile_cont({c}, 0.5), 0.0), 6) AS median FROM lineitem"
    for c in NUM_LI))
def q_median_table(spark, sf):
    li = table(spark, sf, "lineitem")
    return P.median_profile(li, NUM_LI).withColumn("median", rnd(F.col("median")))


@query("x_clip_fit", " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(quantile_cont({c}, 0.01), 6) AS lo, round(quantile_cont({c}, 0.99), 6) AS hi, "
    f"coalesce(quantile_cont({c}, 0.01) < quantile_cont({c}, 0.99), FALSE) AS kept FROM lineitem" for c in NUM_LI))
def q_x_clip_fit(spark, sf):
    li = table(spark, sf, "lineitem")
    return P.x_clip_profile(li, NUM_LI).select("column", rnd(F.col("lo")).alias("lo"),
                                               rnd(F.col("hi")).alias("hi"), "kept")


# ---------------------------------------------------------------- F01 / F02
def _clip_sql(c):
    return (f"round(CASE WHEN {c} IS NULL THEN NULL WHEN b_{c}.lo < b_{c}.hi "
            f"THEN least(greatest({c}, b_{c}.lo), b_{c}.hi) ELSE {c} END, 6) AS {c}")


@query("x_clip_apply", "SELECT l_orderkey, l_linenumber, " + ", ".join(_clip_sql(c) for c in ["l_extendedprice", "l_quantity"])
       + " FROM lineitem, " + ", ".join(
           f"(SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi FROM lineitem) b_{c}"
           for c in ["l_extendedprice", "l_quantity"]))
def q_x_clip_apply(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = ["l_extendedprice", "l_quantity"]
    bounds = P.fit_x_clip(li, cols)
    return li.select(*LI_KEY, *[rnd(S.clip(c, *bounds[c]) if c in bounds else F.col(c)).alias(c) for c in cols])


@query("y_winsorize", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
     b AS (SELECT q1 - 3.0 * (q3 - q1) AS lo, q3 + 3.0 * (q3 - q1) AS hi FROM q)
SELECT event_id, round(least(greatest(value, lo), hi), 6) AS y, (value < lo OR value > hi) AS clipped
FROM events, b
""")
def q_y_winsorize(spark, sf):
    from sparkreg.operators.transform import winsorize
    ev = table(spark, sf, "events")
    fence = P.y_fence_profile(ev, "value", 3.0).first()
    out = winsorize(ev, "value", fence["lo"], fence["hi"], flag="clipped")
    return out.select("event_id", rnd(F.col("value")).alias("y"), "clipped")


# ---------------------------------------------------------------- A04 / A05 / A13 / A14 / A15
@query("y_fence_fit", """
SELECT m AS mult, count(value) AS n,
       round(quantile_cont(value, 0.25) - m * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) AS lo,
       round(quantile_cont(value, 0.75) + m * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) AS hi
FROM events, (SELECT CAST(3.0 AS DOUBLE) AS m UNION ALL SELECT CAST(4.5 AS DOUBLE)) GROUP BY m
""")
def q_y_fence_fit(spark, sf):
    ev = table(spark, sf, "events")
    parts = [P.y_fence_profile(ev, "value", m).select(F.lit(m).alias("mult"), "n", rnd(F.col("lo")).alias("lo"),
                                                      rnd(F.col("hi")).alias("hi")) for m in (3.0, 4.5)]
    return parts[0].unionByName(parts[1])


@query("y_skew", """
WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd, count(value) AS n FROM events)
SELECT n, round(CASE WHEN sd < 1e-12 THEN 0.0
              ELSE (SELECT avg(power(value - mu, 3)) FROM events) / power(sd, 3) END, 6) AS skew FROM s
""")
def q_y_skew(spark, sf):
    return P.skew_profile(table(spark, sf, "events"), "value").withColumn("skew", rnd(F.col("skew")))


@query("target_is_integer", """
SELECT coalesce(bool_and(l_quantity % 1 = 0), TRUE) AS qty_integer,
       coalesce(bool_and(l_extendedprice % 1 = 0), TRUE) AS price_integer FROM lineitem
""")
def q_target_is_integer(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.agg(P.is_integer_expr("l_quantity").alias("qty_integer"),
                  P.is_integer_expr("l_extendedprice").alias("price_integer"))


@query("y_range_clip", """
SELECT round(min(o_totalprice), 6) AS y_min, round(max(o_totalprice), 6) AS y_max,
       round(min(o_totalprice) - CASE WHEN max(o_totalprice) > min(o_totalprice) THEN (max(o_totalprice) - min(o_totalprice)) * 0.05
             ELSE greatest(abs(max(o_totalprice)), 1.0) END, 6) AS lo,
       round(max(o_totalprice) + CASE WHEN max(o_totalprice) > min(o_totalprice) THEN (max(o_totalprice) - min(o_totalprice)) * 0.05
             ELSE greatest(abs(max(o_totalprice)), 1.0) END, 6) AS hi
FROM orders
""")
def q_y_range_clip(spark, sf):
    r = P.y_range_profile(table(spark, sf, "orders"), "o_totalprice")
    return r.select(*[rnd(F.col(c)).alias(c) for c in r.columns])


SMEAR_PRED = "exp(ln(1 + o_totalprice) * 0.98) - 1"


@query("smear_factor", f"""
SELECT round(coalesce(least(greatest(quantile_cont(o_totalprice / greatest({SMEAR_PRED}, 1e-6), 0.5), 0.5), 2.0), 1.0), 6)
       AS smear FROM orders
""")
def q_smear_factor(spark, sf):
    od = table(spark, sf, "orders").withColumn("pred", F.expr(SMEAR_PRED))
    return P.smear_profile(od, "o_totalprice", "pred").withColumn("smear", rnd(F.col("smear")))


# ---------------------------------------------------------------- A08 / A09 / F11
@query("standard_fit", " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(avg({c}), 6) AS center, round(stddev_pop({c}), 6) AS std, "
    f"round(greatest(stddev_pop({c}), 1e-8), 6) AS scale FROM lineitem" for c in NUM_LI))
def q_standard_fit(spark, sf):
    r = TR.standard_fit(table(spark, sf, "lineitem"), NUM_LI)
    return r.select("column", rnd(F.col("center")).alias("center"), rnd(F.col("std")).alias("std"),
                    rnd(F.col("scale")).alias("scale"))


@query("robust_fit", " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(quantile_cont({c}, 0.5), 6) AS center, "
    f"round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, "
    f"round(greatest(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 1e-8), 6) AS scale FROM lineitem"
    for c in NUM_LI))
def q_robust_fit(spark, sf):
    r = TR.robust_fit(table(spark, sf, "lineitem"), NUM_LI)
    return r.select("column", rnd(F.col("center")).alias("center"), rnd(F.col("iqr")).alias("iqr"),
                    rnd(F.col("scale")).alias("scale"))


@query("scale_apply", """
WITH s AS (SELECT avg(l_extendedprice) AS mu, greatest(stddev_pop(l_extendedprice), 1e-8) AS sd,
                  quantile_cont(l_quantity, 0.5) AS med,
                  greatest(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 1e-8) AS iqr FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - mu) / sd, 6) AS price_std,
       round((l_quantity - med) / iqr, 6) AS qty_robust FROM lineitem, s
""")
def q_scale_apply(spark, sf):
    li = table(spark, sf, "lineitem")
    st = {r["column"]: r for r in TR.standard_fit(li, ["l_extendedprice"]).collect()}["l_extendedprice"]
    rb = {r["column"]: r for r in TR.robust_fit(li, ["l_quantity"]).collect()}["l_quantity"]
    return li.select(*LI_KEY, rnd(S.scale("l_extendedprice", st["center"], st["scale"])).alias("price_std"),
                     rnd(S.scale("l_quantity", rb["center"], rb["scale"])).alias("qty_robust"))


# ---------------------------------------------------------------- F03 - F06
@query("log1p_transform", """
SELECT event_id, round(ln(1 + value), 6) AS y_t, round(exp(ln(1 + value)) - 1, 6) AS y_back FROM events
""")
def q_log1p_transform(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", rnd(S.log1p_fwd("value")).alias("y_t"),
                     rnd(S.expm1_inv(S.log1p_fwd("value"))).alias("y_back"))


YJ_X = "(l_quantity - 25.5) / 5"
YJ_LAMBDAS = {"l07": 0.7, "l00": 0.0, "l20": 2.0, "lneg": -1.3}


def _yj_sql(x, lam):
    pos = f"ln(1 + {x})" if abs(lam) < 1e-6 else f"(power({x} + 1.0, {lam}) - 1.0) / {lam}"
    neg = f"-ln(1 - ({x}))" if abs(lam - 2) < 1e-6 else f"-(power(1.0 - ({x}), {2.0 - lam}) - 1.0) / {2.0 - lam}"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 0 THEN {pos} ELSE {neg} END"


def _yj_inv_sql(y, lam):
    pos = f"(exp({y}) - 1)" if abs(lam) < 1e-6 else f"power(greatest({y} * {lam} + 1.0, 1e-12), {1.0 / lam}) - 1.0"
    neg = (f"1.0 - exp(-({y}))" if abs(lam - 2) < 1e-6
           else f"1.0 - power(greatest({y} * {lam - 2.0} + 1.0, 1e-12), {1.0 / (2.0 - lam)})")
    return f"CASE WHEN {y} IS NULL THEN NULL WHEN {y} >= 0 THEN {pos} ELSE {neg} END"


@query("yeo_johnson", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({_yj_sql(YJ_X, lam)}, 6) AS {k}" for k, lam in YJ_LAMBDAS.items()) + " FROM lineitem")
def q_yeo_johnson(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*LI_KEY, *[rnd(S.yeo_johnson(F.expr(YJ_X), lam)).alias(k) for k, lam in YJ_LAMBDAS.items()])


@query("yeo_johnson_inverse", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({_yj_inv_sql(_yj_sql(YJ_X, lam), lam)}, 6) AS rt_{k}, round({_yj_inv_sql(YJ_X, lam)}, 6) AS inv_{k}"
    for k, lam in YJ_LAMBDAS.items()) + " FROM lineitem")
def q_yeo_johnson_inverse(spark, sf):
    li = table(spark, sf, "lineitem")
    x = F.expr(YJ_X)
    cols = []
    for k, lam in YJ_LAMBDAS.items():
        cols += [rnd(S.yeo_johnson_inverse(S.yeo_johnson(x, lam), lam)).alias(f"rt_{k}"),
                 rnd(S.yeo_johnson_inverse(x, lam)).alias(f"inv_{k}")]
    return li.select(*LI_KEY, *cols)


RHA_SRC = {"r_half": "l_quantity / 2 - 12.5", "r_price": "l_extendedprice / 7", "r_neg": "-(l_quantity) / 4"}


@query("round_half_away", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"sign({v}) * floor(abs({v}) + 0.5) AS {k}" for k, v in RHA_SRC.items()) + " FROM lineitem")
def q_round_half_away(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*LI_KEY, *[S.round_half_away(F.expr(v)).alias(k) for k, v in RHA_SRC.items()])


# ---------------------------------------------------------------- F07 / F08 / F09
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("one_hot", "SELECT p_partkey, " + ", ".join(
    f"CAST(coalesce(nullif(p_type, ''), '__NaN__') = '{k}' AS DOUBLE) AS \"p_type=={k}\"" for k in P_TYPES)
    + " FROM part")
def q_one_hot(spark, sf):
    from sparkreg.operators.encode import onehot_classes, onehot_columns
    pt = table(spark, sf, "part")
    return pt.select("p_partkey", *onehot_columns("p_type", onehot_classes(pt, "p_type")))


SENT_SRC = "CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE nullif(c_mktsegment, 'BUILDING') END"


@query("null_to_sentinel", f"""
SELECT c_custkey, coalesce(nullif({SENT_SRC}, ''), '__NaN__') AS segment FROM customer
""")
def q_null_to_sentinel(spark, sf):
    cu = table(spark, sf, "customer")
    return cu.select("c_custkey", S.null_to_sentinel(F.expr(SENT_SRC)).alias("segment"))


@query("impute_median", """
SELECT l_orderkey, l_linenumber,
       round(coalesce(nullif(l_quantity, 1), (SELECT quantile_cont(nullif(l_quantity, 1), 0.5) FROM lineitem)), 6) AS qty,
       round(coalesce(CASE WHEN l_tax < 0 THEN l_tax END, 0.0), 6) AS tax_neg
FROM lineitem
""")
def q_impute_median(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_KEY, F.nullif("l_quantity", F.lit(1.0)).alias("qty"),
                                             F.expr("CASE WHEN l_tax < 0 THEN l_tax END").alias("tax_neg"))
    med = P.fit_medians(li, ["qty", "tax_neg"])          # all-null column -> 0.0
    return li.select(*LI_KEY, rnd(S.impute("qty", med["qty"])).alias("qty"),
                     rnd(S.impute("tax_neg", med["tax_neg"])).alias("tax_neg"))


# ---------------------------------------------------------------- F10 / F12
DER_A = "l_quantity - 25"
DER_B = "l_discount * 10"


@query("derived_features", f"""
WITH b AS (SELECT quantile_cont({DER_A}, 0.01) AS alo, quantile_cont({DER_A}, 0.99) AS ahi,
                  quantile_cont({DER_B}, 0.01) AS blo, quantile_cont({DER_B}, 0.99) AS bhi FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, least(greatest({DER_A}, alo), ahi) AS a,
             least(greatest({DER_B}, blo), bhi) AS b FROM lineitem, b)
SELECT l_orderkey, l_linenumber, round(a * b, 6) AS "a*b", round(a * a, 6) AS "a^2", CAST(sign(a) AS DOUBLE) AS "sign(a)" FROM c
""")
def q_derived_features(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_KEY, F.expr(DER_A).alias("a"), F.expr(DER_B).alias("b"))
    bounds = P.fit_x_clip(li, ["a", "b"])
    c = li.select(*LI_KEY, S.clip("a", *bounds["a"]).alias("a"), S.clip("b", *bounds["b"]).alias("b"))
    return c.select(*LI_KEY, rnd(S.derived("mul", ["a", "b"])).alias("a*b"),
                    rnd(S.derived("sq", ["a"])).alias("a^2"), S.derived("sign", ["a"]).alias("sign(a)"))


@query("poly2_expand", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(p_size AS DOUBLE) * p_size AS "p_size^2",
       round(p_size * p_retailprice, 6) AS "p_size p_retailprice", round(p_retailprice * p_retailprice, 6) AS "p_retailprice^2"
FROM part
""")
def q_poly2_expand(spark, sf):
    pt = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    cols = S.poly2_expand(["p_size", "p_retailprice"], ["p_size", "p_retailprice"])
    out = pt.select("p_partkey", *cols)
    return out.select("p_partkey", *[rnd(F.col(f"`{c}`")).alias(c) if c not in ("p_size", "p_retailprice", "p_size^2")
                                     else F.col(f"`{c}`") for c in out.columns[1:]])


# ---------------------------------------------------------------- F13 / F14 / F15
@query("r2_bucket", """
SELECT l_orderkey, l_linenumber, CASE WHEN x >= 0.95 THEN 'very_high' WHEN x >= 0.85 THEN 'high'
  WHEN x >= 0.70 THEN 'practical' WHEN x >= 0.50 THEN 'moderate' WHEN x >= 0.0 THEN 'insufficient'
  ELSE 'nonfunctional' END AS bucket
FROM (SELECT l_orderkey, l_linenumber, l_discount * 20 - 1 AS x FROM lineitem)
""")
def q_r2_bucket(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*LI_KEY, S.r2_bucket(F.col("l_discount") * 20 - 1).alias("bucket"))


PP_PRED = "o_totalprice * 1.1 - 20000"


@query("postprocess", f"""
WITH r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders),
     p AS (SELECT a - (b - a) * 0.05 AS lo, b + (b - a) * 0.05 AS hi, bool_and(o_totalprice % 1 = 0) AS isint
           FROM r, orders GROUP BY a, b),
     s AS (SELECT least(greatest(quantile_cont(o_totalprice / greatest({PP_PRED}, 1e-6), 0.5), 0.5), 2.0) AS smear FROM orders)
SELECT o_orderkey, round(CASE WHEN isint THEN sign(v) * floor(abs(v) + 0.5) ELSE v END, 6) AS pred FROM (
  SELECT o_orderkey, isint, least(greatest(({PP_PRED}) * smear, lo), hi) AS v FROM orders, p, s)
""")
def q_postprocess(spark, sf):
    od = table(spark, sf, "orders").withColumn("pred", F.expr(PP_PRED))
    rng = P.y_range_profile(od, "o_totalprice").first()
    smear = P.smear_profile(od, "o_totalprice", "pred").first()["smear"]
    isint = P.target_is_integer(od, "o_totalprice").first()["is_integer"]
    return od.select("o_orderkey", rnd(S.postprocess("pred", smear, rng["lo"], rng["hi"], isint)).alias("pred"))


@query("report_json", """
SELECT l_returnflag, CAST(to_json({'flag': l_returnflag, 'n': count(*), 'mean_qty': round(avg(l_quantity), 2),
  'ratio': CASE WHEN isnan(sum(l_discount) / count(*)) THEN NULL ELSE round(sum(l_discount) / count(*), 4) END,
  'bad': CAST(NULL AS DOUBLE)}) AS VARCHAR) AS report
FROM lineitem GROUP BY l_returnflag
""")
def q_report_json(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 2).alias("mean_qty"),
                                       F.round(F.sum("l_discount") / F.count(F.lit(1)), 4).alias("ratio"),
                                       F.lit(float("nan")).alias("bad"))
    return g.select("l_returnflag", S.report_json({
        "flag": F.col("l_returnflag"), "n": F.col("n"), "mean_qty": S.finite_or_null("mean_qty"),
        "ratio": S.finite_or_null("ratio"), "bad": S.finite_or_null("bad")}).alias("report"))


# ---------------------------------------------------------------- A16 / T02 / A18 / A19
CORR_FEATS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
CORR_Y = "l_extendedprice / l_quantity + l_discount * 100"


@query("corr_rank", " UNION ALL ".join(
    f"SELECT '{c}' AS column, {i} AS pos, round(abs(corr({c}, {CORR_Y})), 6) AS abs_corr FROM lineitem"
    for i, c in enumerate(CORR_FEATS)))
def q_corr_rank(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("y", F.expr(CORR_Y))
    return P.corr_profile(li, CORR_FEATS, "y").withColumn("abs_corr", rnd(F.col("abs_corr")))


@query("topk_corr", f"""
SELECT "column", pos, abs_corr FROM (
  SELECT * FROM ({" UNION ALL ".join(
    f"SELECT '{c}' AS column, {i} AS pos, round(abs(corr({c}, {CORR_Y})), 6) AS abs_corr FROM lineitem"
    for i, c in enumerate(CORR_FEATS))}) ORDER BY abs_corr DESC, pos LIMIT 2)
""")
def q_topk_corr(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("y", F.expr(CORR_Y))
    return P.top_by_corr(li, CORR_FEATS, "y", 2).withColumn("abs_corr", rnd(F.col("abs_corr")))


YJ_GRID = [-1.0, 0.0, 0.5, 1.0, 2.0]


def _yj_llf_sql():
    parts = []
    for lam in YJ_GRID:
        t = _yj_sql("value", lam)
        parts.append(f"SELECT CAST({lam} AS DOUBLE) AS lam, round(-0.5 * count(*) * ln(var_pop({t})) + ({lam} - 1.0) * "
                     f"sum(sign(value) * ln(1 + abs(value))), 4) AS loglik FROM events")
    return " UNION ALL ".join(parts)


@query("yj_profile_loglik", _yj_llf_sql())
def q_yj_profile_loglik(spark, sf):
    ev = table(spark, sf, "events")
    return TR.yj_loglik_grid(ev, "value", YJ_GRID).withColumn("loglik", F.round("loglik", 4))


@query("prediction_summary", """
SELECT count(*) AS n_rows, round(avg(o_totalprice * 0.9), 2) AS pred_mean,
       round(stddev_samp(o_totalprice * 0.9), 2) AS pred_std FROM orders
""")
def q_prediction_summary(spark, sf):
    od = table(spark, sf, "orders").withColumn("pred", F.col("o_totalprice") * 0.9)
    return P.prediction_summary(od, "pred")
