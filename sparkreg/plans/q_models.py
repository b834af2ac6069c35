"""Registered queries: sources and sinks, estimators, search, blending,
importance, scoring and streaming (S01-S07, P11, M01-M22, D01-D08, J05,
A20, A22, T03, U02, X01).

Model queries train on ``part`` (p_retailprice from size, name length,
type and brand) or ``events`` and return prediction / spec tables; most are
rows-checked (the fits are iterative), and the closed-form ones carry SQL.
"""

from __future__ import annotations

import os
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from sparkreg.operators import metrics as M
from sparkreg.operators import profile as P
from sparkreg.operators.blend import blend_weights, gram_of_members, nnls_gram, stack_members
from sparkreg.operators.folds import sample_rows, stratified_folds
from sparkreg.operators.gp import fit_gp, kernel_sum
from sparkreg.operators.linear import ALPHAS_STD, ridge_cv
from sparkreg.operators.mlp import NetWant, fit_mlp, fit_networks
from sparkreg.operators.histogram import Params
from sparkreg.operators.trees import (BOOST_QUICK, BOOST_THOROUGH, PROBE, TreeTable, fit_trees, node_table,
                                      screen_features, spec_from_nodes, split_counts, split_importance)
from sparkreg.plans.catalog import query
from sparkreg.plans.q_folds import R2_SQL, _candidates, _cand_sql, _oof_events, folds_cte, oof_te_sql
from sparkreg.session import cut_lineage, scratch_path
from sparkreg.sources.tables import table

R = 6
FOLDS = [0, 1, 2, 3, 4]


def rnd(c, n=R):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def part_frame(spark, sf):
    """part with plain features: size, name length, one-hot type, brand."""
    pt = table(spark, sf, "part")
    return pt.select("p_partkey", F.col("p_size").cast("double").alias("p_size"),
                     F.length("p_name").cast("double").alias("name_len"), "p_type", "p_brand",
                     F.col("p_retailprice").alias("y"))


def part_numeric(spark, sf):
    """part with folds and numeric features only (one-hot type inline)."""
    from sparkreg.operators.encode import onehot_classes, onehot_columns
    pf = part_frame(spark, sf)
    classes = onehot_classes(pf, "p_type")
    d = pf.select("p_partkey", "p_size", "name_len", *onehot_columns("p_type", classes), "y")
    d = cut_lineage(stratified_folds(d, "p_partkey", "y"))
    return d, ["p_size", "name_len"] + [f"p_type=={k}" for k in classes]


def by_fold(d, specs, add):
    """The rows of every fold with the prediction of the model that has not
    seen them."""
    out = None
    for f in FOLDS:
        part = add(d.filter(F.col("fold") == f), specs[f]).select("p_partkey", "fold", rnd("pred").alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


def trained(spark, sf, strategy="quick", families=None):
    from sparkreg.plans.train import train
    # derived recipes only feed the non-poly members; a poly-only run skips them
    derive = None if families != ("poly",) else False
    return train(part_frame(spark, sf), "y", key="p_partkey", strategy=strategy, families=families, derive=derive)


def bundle_of(spark, sf, strategy="quick", families=None):
    from sparkreg.plans.train import save
    from sparkreg.sources.model_io import load_bundle
    root = scratch_path(spark, "bundle")
    save(trained(spark, sf, strategy, families), root)
    return load_bundle(spark, root), root


ALPHA_VALUES = ", ".join(f"({i}, {a})" for i, a in enumerate(ALPHAS_STD))

# The whole chain of a quick linear training on one nullable feature of part, in SQL: folds, y fences and
# x clip from the rows outside fold 0, median fill, robust scale, alpha by the inner folds, ridge, and the
# post-processing bounds.  f = -1 is the final model on all rows, f = 0 the one that fold 0 is judged by.
LINEAR_ONE = f"""
{folds_cte('part', 'p_partkey', 'p_retailprice')},
qt AS (SELECT quantile_cont(CAST(nullif(p_size, 1) AS DOUBLE), 0.01) AS xl,
              quantile_cont(CAST(nullif(p_size, 1) AS DOUBLE), 0.99) AS xh,
              quantile_cont(__y, 0.25) AS q1, quantile_cont(__y, 0.75) AS q3 FROM folded WHERE fold <> 0),
b AS (SELECT p_partkey, fold, CASE WHEN p_size <> 1 THEN least(greatest(CAST(p_size AS DOUBLE), xl), xh) END AS x,
             __y AS y_raw,
             least(greatest(__y, q1 - 4.5 * (q3 - q1)), q3 + 4.5 * (q3 - q1)) AS y,
             CAST(('0x' || substr(md5(concat('42i|', CAST(p_partkey AS VARCHAR))), 1, 8))::BIGINT % 5 AS INTEGER) AS inn
      FROM folded, qt),
fs AS (SELECT 0 AS f UNION ALL SELECT -1),
med AS (SELECT f, quantile_cont(x, 0.5) AS m FROM b, fs WHERE b.fold <> fs.f GROUP BY f),
tr AS (SELECT med.f, b.inn, coalesce(b.x, med.m) AS xf, b.y FROM b JOIN med ON b.fold <> med.f),
sc AS (SELECT f, greatest(quantile_cont(xf, 0.75) - quantile_cont(xf, 0.25), 1e-8) AS s FROM tr GROUP BY f),
al AS (SELECT * FROM (VALUES {ALPHA_VALUES}) v(ai, a)),
ins AS (SELECT DISTINCT inn AS i FROM b),
fit AS (SELECT t.f, al.ai, al.a, ins.i, avg(t.xf) AS mx, avg(t.y) AS my,
               var_pop(t.xf) * count(*) AS sxx, covar_pop(t.xf, t.y) * count(*) AS sxy
        FROM tr t, al, ins WHERE t.inn <> ins.i GROUP BY t.f, al.ai, al.a, ins.i),
coef AS (SELECT fit.*, sxy / (sxx + a * s * s) AS beta FROM fit JOIN sc USING (f)),
sse AS (SELECT c.f, c.ai, c.a, sum(power(t.y - (c.my - c.beta * c.mx) - c.beta * t.xf, 2)) AS e
        FROM coef c JOIN tr t ON t.f = c.f AND t.inn = c.i GROUP BY c.f, c.ai, c.a),
best AS (SELECT f, a FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY e, ai) AS r FROM sse) WHERE r = 1),
fin AS (SELECT t.f, avg(t.xf) AS mx, avg(t.y) AS my, var_pop(t.xf) * count(*) AS sxx,
               covar_pop(t.xf, t.y) * count(*) AS sxy FROM tr t GROUP BY t.f),
cf AS (SELECT fin.f, fin.sxy / (fin.sxx + best.a * sc.s * sc.s) AS beta, fin.my, fin.mx, med.m
       FROM fin JOIN best USING (f) JOIN sc USING (f) JOIN med USING (f)),
rg AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
pr AS (SELECT cf.f, b.p_partkey, b.fold, b.x, b.y, b.y_raw, cf.my - cf.beta * cf.mx + cf.beta * coalesce(b.x, cf.m) AS lin,
              least(greatest(cf.my - cf.beta * cf.mx + cf.beta * coalesce(b.x, cf.m), rg.lo - (rg.hi - rg.lo) * 0.05),
                    rg.hi + (rg.hi - rg.lo) * 0.05) AS pred
       FROM b, cf, rg)"""


# the same with the wider fences of a quick run replaced and every fold evaluated
LINEAR_ALL = LINEAR_ONE.replace("4.5 *", "3.0 *").replace(
    "fs AS (SELECT 0 AS f UNION ALL SELECT -1)", "fs AS (SELECT DISTINCT fold AS f FROM b UNION ALL SELECT -1)")


def one_feature(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).cast("double").alias("x"),
                                           F.col("p_retailprice").alias("y"))


def linear_one(spark, sf):
    """The trained result and the saved bundle of the one-feature model."""
    from sparkreg.plans.train import save, train
    from sparkreg.sources.model_io import load_bundle
    res = train(one_feature(spark, sf), "y", key="p_partkey", families=("linear",))
    root = scratch_path(spark, "bundle")
    save(res, root)
    return res, load_bundle(spark, root)


# ---------------------------------------------------------------- S01 / S02 / S04
@query("src_csv_fallback", """
SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size,
       p_retailprice FROM part
""")
def q_src_csv_fallback(spark, sf):
    from sparkreg.sources.csv import read_csv
    path = scratch_path(spark, "csv")
    table(spark, sf, "part").write.mode("overwrite").option("header", True).csv(path)
    return read_csv(spark, path)


@query("src_header_check", """
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS "column", FALSE AS duplicate
FROM (DESCRIBE part)
""")
def q_src_header_check(spark, sf):
    from sparkreg.sources.csv import header_report
    path = scratch_path(spark, "csv")
    pt = table(spark, sf, "part")
    pt.select(*[F.col(c).alias(f" {c} ") for c in pt.columns]).write.mode("overwrite").option("header", True).csv(path)
    return header_report(spark, path)


@query("sink_scored_csv", f"""
WITH {LINEAR_ONE}
SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(nullif(p_size, 1) AS DOUBLE) AS x, round(pred, 6) AS y
FROM pr JOIN part USING (p_partkey) WHERE f = -1
""")
def q_sink_scored_csv(spark, sf):
    """Scored rows written as CSV and read back."""
    from sparkreg.plans.score import score
    from sparkreg.sources.csv import read_csv, write_scored_csv
    _, b = linear_one(spark, sf)
    path = scratch_path(spark, "scored")
    write_scored_csv(score(one_feature(spark, sf), b), path)
    return read_csv(spark, path).withColumn("y", rnd("y"))


# ---------------------------------------------------------------- S05 / S06 / S07
@query("sink_model_bundle")
def q_sink_model_bundle(spark, sf):
    from sparkreg.session import list_files
    _, root = bundle_of(spark, sf, families=("linear", "gbt"))
    return spark.createDataFrame(list_files(spark, root), "file string, bytes long")


@query("src_model_bundle")
def q_src_model_bundle(spark, sf):
    b, _ = bundle_of(spark, sf, families=("linear", "gbt"))
    m = b.meta
    rows = [(k, v.get("type"), len(v.get("feats", []))) for k, v in m["members"].items()]
    return spark.createDataFrame(rows, "member string, type string, n_features int").withColumn(
        "best", F.lit(m["best"]))


@query("model_tables", f"""
WITH {folds_cte('part', 'p_partkey', 'p_retailprice')},
t AS (SELECT CAST(p_size AS DOUBLE) AS p_size, CAST(length(p_name) AS DOUBLE) AS name_len, p_type
      FROM folded WHERE fold <> 0),
v AS (SELECT 'p_size' AS item, p_size AS x FROM t UNION ALL SELECT 'name_len', name_len FROM t
      UNION ALL SELECT 'p_type==' || c, CAST(p_type = c AS DOUBLE) FROM t, (SELECT DISTINCT p_type AS c FROM part)),
c AS (SELECT item, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM v GROUP BY item),
r AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part)
SELECT 'clip_bounds' AS "table", item, round(lo, 6) AS lo, round(hi, 6) AS hi FROM c WHERE lo < hi
UNION ALL SELECT 'postprocess', 'linear', round(a - (b - a) * 0.05, 6), round(b + (b - a) * 0.05, 6) FROM r
""")
def q_model_tables(spark, sf):
    """The bounds that the saved model holds, read back as tables."""
    from sparkreg.sources.model_io import model_tables
    b, _ = bundle_of(spark, sf, families=("linear",))
    tabs = model_tables(spark, b)
    clip = tabs["clip_bounds"].select(F.lit("clip_bounds").alias("table"), F.col("feature").alias("item"), "lo", "hi")
    post = tabs["postprocess"].select(F.lit("postprocess").alias("table"), F.col("model").alias("item"), "lo", "hi")
    return clip.unionByName(post).select("table", "item", rnd("lo").alias("lo"), rnd("hi").alias("hi"))


# ---------------------------------------------------------------- P11 / M13 / M17
IMP_EXPR = {
    "qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax",
    "line": "CAST(l_linenumber AS DOUBLE)", "qty_sq": "l_quantity * l_quantity", "disc_tax": "l_discount * l_tax",
    "net": "l_extendedprice * (1 - l_discount)", "gross": "l_extendedprice * (1 + l_tax)",
    "qty_disc": "l_quantity * l_discount", "tax_sq": "l_tax * l_tax", "ship_day": "CAST(dayofmonth(l_shipdate) AS DOUBLE)",
}
IMP_Y = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


@query("screen_features")
def q_screen_features(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select(*[F.expr(v).alias(k) for k, v in IMP_EXPR.items()], F.expr(IMP_Y).alias("y"))
    kept = set(screen_features(df, list(IMP_EXPR), "y"))
    return spark.createDataFrame([(i, c, c in kept) for i, c in enumerate(IMP_EXPR)],
                                 "pos int, feature string, kept boolean")


@query("split_importance")
def q_split_importance(spark, sf):
    d, feats = part_numeric(spark, sf)
    spec = fit_trees(d, feats, "y", "gbt", params=replace(BOOST_QUICK, patience=0), key="p_partkey")
    return split_importance(spec, spark).select("feature", "importance", rnd("pct", 4).alias("pct"))


@query("derived_recipe_fit")
def q_derived_recipe_fit(spark, sf):
    from sparkreg.operators.search import fit_recipe

    d, _ = part_numeric(spark, sf)

    def probe(cand, names, rounds):
        return split_counts(fit_trees(cand, names, "y", "gbt", params=replace(PROBE, rounds=rounds)))

    recipe = fit_recipe(d, ["p_size", "name_len"], "y", probe)
    return spark.createDataFrame([(i, r["name"], r["op"], ",".join(r["cols"])) for i, r in enumerate(recipe)],
                                 "pos int, name string, op string, cols string")


# ---------------------------------------------------------------- M01 / M02 / M14 / D02 / D03
@query("ridge_cv", f"""
WITH {folds_cte('part', 'p_partkey', 'p_retailprice')},
b AS (SELECT p_partkey, fold, CAST(nullif(p_size, 1) AS DOUBLE) AS x, __y AS y,
             CAST(('0x' || substr(md5(concat('42i|', CAST(p_partkey AS VARCHAR))), 1, 8))::BIGINT % 5 AS INTEGER) AS inn
      FROM folded),
fs AS (SELECT DISTINCT fold AS f FROM b),
med AS (SELECT f, quantile_cont(x, 0.5) AS m FROM b, fs WHERE b.fold <> fs.f GROUP BY f),
tr AS (SELECT med.f, b.inn, coalesce(b.x, med.m) AS xf, b.y FROM b JOIN med ON b.fold <> med.f),
sc AS (SELECT f, greatest(quantile_cont(xf, 0.75) - quantile_cont(xf, 0.25), 1e-8) AS s FROM tr GROUP BY f),
al AS (SELECT * FROM (VALUES {ALPHA_VALUES}) v(ai, a)),
ins AS (SELECT DISTINCT inn AS i FROM b),
fit AS (SELECT t.f, al.ai, al.a, ins.i, avg(t.xf) AS mx, avg(t.y) AS my,
               var_pop(t.xf) * count(*) AS sxx, covar_pop(t.xf, t.y) * count(*) AS sxy
        FROM tr t, al, ins WHERE t.inn <> ins.i GROUP BY t.f, al.ai, al.a, ins.i),
coef AS (SELECT fit.*, sxy / (sxx + a * s * s) AS beta FROM fit JOIN sc USING (f)),
sse AS (SELECT c.f, c.ai, c.a, sum(power(t.y - (c.my - c.beta * c.mx) - c.beta * t.xf, 2)) AS e
        FROM coef c JOIN tr t ON t.f = c.f AND t.inn = c.i GROUP BY c.f, c.ai, c.a),
best AS (SELECT f, a FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY e, ai) AS r FROM sse) WHERE r = 1),
fin AS (SELECT t.f, avg(t.xf) AS mx, avg(t.y) AS my, var_pop(t.xf) * count(*) AS sxx,
               covar_pop(t.xf, t.y) * count(*) AS sxy FROM tr t GROUP BY t.f),
cf AS (SELECT fin.f, fin.sxy / (fin.sxx + best.a * sc.s * sc.s) AS beta, fin.my, fin.mx, med.m
       FROM fin JOIN best USING (f) JOIN sc USING (f) JOIN med USING (f))
SELECT b.p_partkey, b.fold, round(cf.my - cf.beta * cf.mx + cf.beta * coalesce(b.x, cf.m), 6) AS pred
FROM b JOIN cf ON cf.f = b.fold
""")
def q_ridge_cv(spark, sf):
    """M01 with one nullable feature: per-fold median fill, robust scale,
    alpha by inner 5-fold SSE, OOF prediction per row."""
    pt = table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).cast("double").alias("x"),
                                         "p_retailprice")
    d = stratified_folds(pt, "p_partkey", "p_retailprice")
    res = ridge_cv(d, ["x"], "p_retailprice", "p_partkey", "fold", ALPHAS_STD)
    e = None
    for f, sp in res.per_fold.items():
        e = F.when(F.col("fold") == f, sp.predict()) if e is None else e.when(F.col("fold") == f, sp.predict())
    return d.select("p_partkey", "fold", rnd(e).alias("pred"))


@query("ridge_cv_wide")
def q_ridge_cv_wide(spark, sf):
    """M01 on eight features (size, name length, one-hot type)."""
    d, feats = part_numeric(spark, sf)
    res = ridge_cv(d, feats, "y", "p_partkey", "fold", ALPHAS_STD)
    e = None
    for f, sp in res.per_fold.items():
        e = F.when(F.col("fold") == f, sp.predict()) if e is None else e.when(F.col("fold") == f, sp.predict())
    return d.select("p_partkey", "fold", rnd(e).alias("pred"))


@query("poly_ridge_cv")
def q_poly_ridge_cv(spark, sf):
    """Every fold is scored by a model whose columns, fills, scales and
    coefficients come from the other folds."""
    from sparkreg.plans.score import add_poly
    from sparkreg.plans.train import fit_poly
    d, feats = part_numeric(spark, sf)
    out = None
    for f in range(5):
        spec = fit_poly(d.filter(F.col("fold") != f), feats, "y", "p_partkey")
        part = add_poly(d.filter(F.col("fold") == f), spec, "pred").select("p_partkey", "fold", rnd("pred").alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


@query("coef_importance")
def q_coef_importance(spark, sf):
    d, feats = part_numeric(spark, sf)
    res = ridge_cv(d, feats, "y", "p_partkey", None, ALPHAS_STD)
    imp = M.coef_importance(res.final.feats, res.final.scaled(), spark)
    return M.top_importance(imp)


# Ridge on two columns u, v of ``two`` (k, u, v, y) in closed form; s is what the penalty is scaled by.
TWO_SQL = """
m AS (SELECT avg(u) AS mu, avg(v) AS mv, avg(y) AS my, count(*) AS n FROM two),
g AS (SELECT var_pop(u) * n + pu AS uu, var_pop(v) * n + pv AS vv, covar_pop(u, v) * n AS uv, covar_pop(u, y) * n AS uy,
             covar_pop(v, y) * n AS vy FROM two, m, pen GROUP BY n, pu, pv),
w AS (SELECT (vv * uy - uv * vy) / (uu * vv - uv * uv) AS wu, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS wv FROM g)"""
IQR = "greatest(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25), 1e-8)"


@query("coef_importance_exact", f"""
WITH two AS (SELECT p_size AS u, length(p_name) AS v, p_retailprice AS y FROM part),
pen AS (SELECT power({IQR.format('u')}, 2) AS pu, power({IQR.format('v')}, 2) AS pv FROM two), {TWO_SQL},
c AS (SELECT 'p_size' AS feature, abs(wu * sqrt(pu)) AS a FROM w, pen UNION ALL SELECT 'name_len', abs(wv * sqrt(pv)) FROM w, pen)
SELECT feature, round(a * 100 / sum(a) OVER (), 1) AS pct FROM c""")
def q_coef_importance_exact(spark, sf):
    """M14 of a ridge on two columns with one penalty: shares of the
    coefficients of the scaled columns."""
    pt = part_frame(spark, sf).select("p_partkey", "p_size", "name_len", "y")
    spec = ridge_cv(pt, ["p_size", "name_len"], "y", "p_partkey", None, [1.0]).final
    return M.top_importance(M.coef_importance(spec.feats, spec.scaled(), spark))


@query("score_poly_exact", f"""
WITH q AS (SELECT quantile_cont(p_size, 0.5) AS c, {IQR.format('p_size')} AS s FROM part),
two AS (SELECT p_partkey AS k, (p_size - c) / s AS u, power((p_size - c) / s, 2) AS v, p_retailprice AS y FROM part, q),
pen AS (SELECT 1.0 AS pu, 1.0 AS pv), {TWO_SQL}
SELECT k AS p_partkey, round(my + wu * (u - mu) + wv * (v - mv), 6) AS pred FROM two, m, w""")
def q_score_poly_exact(spark, sf):
    """One column, its square, one penalty."""
    from sparkreg.plans.score import add_poly
    from sparkreg.plans.train import fit_poly
    pt = part_frame(spark, sf).select("p_partkey", "p_size", "y")
    return add_poly(pt, fit_poly(pt, ["p_size"], "y", "p_partkey", alphas=[1.0]), "pred").select(
        "p_partkey", rnd("pred").alias("pred"))


@query("score_linear", """
WITH b AS (SELECT p_partkey, CAST(nullif(p_size, 1) AS DOUBLE) AS x, p_retailprice AS y FROM part),
m AS (SELECT quantile_cont(x, 0.5) AS med FROM b),
f AS (SELECT p_partkey, coalesce(x, med) AS xf, y FROM b, m),
s AS (SELECT greatest(quantile_cont(xf, 0.75) - quantile_cont(xf, 0.25), 1e-8) AS sc,
             covar_pop(xf, y) * count(*) AS sxy, var_pop(xf) * count(*) AS sxx, avg(xf) AS mx, avg(y) AS my FROM f),
c AS (SELECT sxy / (sxx + 1.0 * sc * sc) AS beta, my - sxy / (sxx + 1.0 * sc * sc) * mx AS icp FROM s)
SELECT p_partkey, round(icp + beta * xf, 6) AS pred FROM f, c
""")
def q_score_linear(spark, sf):
    pt = table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).cast("double").alias("x"),
                                         F.col("p_retailprice").alias("y"))
    res = ridge_cv(pt, ["x"], "y", "p_partkey", None, [1.0])
    return pt.select("p_partkey", rnd(res.final.predict()).alias("pred"))


@query("score_linear_poly")
def q_score_linear_poly(spark, sf):
    from sparkreg.plans.score import score
    b, _ = bundle_of(spark, sf, "thorough", ("poly",))
    return score(part_frame(spark, sf), b).select("p_partkey", rnd("y").alias("pred"))


# ---------------------------------------------------------------- M03 - M06 / D04
def _tree_oof(spark, sf, kind):
    d, feats = part_numeric(spark, sf)
    specs = fit_trees(d, feats, "y", kind, fold="fold", folds=FOLDS, key="p_partkey")
    return by_fold(d, specs, lambda rows, spec: spec.transform(rows, "pred"))


# Two boosted trees of three leaves on two columns, in SQL: cumulated rows and gradients by value, the split of
# largest gain, then that of the better child, leaves shrunk by the two penalties.
EXACT = Params(rounds=2, leaves=3, rate=0.5, min_leaf=20, rows=1.0, cols=1.0)


def _split_sql(name, rows):
    """Best split (node, j, x, gain) of every node of ``rows`` (node, x0, x1, y, f)."""
    gain = " ".join(f"{sign} power(greatest(abs({g}) - 0.1, 0), 2) / ({c} + 1.0)"
                    for sign, g, c in (("", "gl", "cl"), ("+", "gt - gl", "ct - cl"), ("-", "gt", "ct")))
    return f"""{name}_h AS (SELECT node, j, x, count(*) AS c, sum(f - y) AS g
  FROM (SELECT node, unnest([0, 1]) AS j, unnest([x0, x1]) AS x, f, y FROM {rows}) GROUP BY node, j, x),
{name}_c AS (SELECT node, j, x, sum(c) OVER w AS cl, sum(g) OVER w AS gl, sum(c) OVER v AS ct, sum(g) OVER v AS gt
  FROM {name}_h WINDOW w AS (PARTITION BY node, j ORDER BY x), v AS (PARTITION BY node, j)),
{name} AS (SELECT node, j, x, {gain} AS gain FROM {name}_c WHERE cl >= 20 AND ct - cl >= 20
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, x) = 1)"""


def _tree_sql(t, rows):
    return f"""t{t}_r AS (SELECT *, 1 AS node FROM {rows}), {_split_sql(f't{t}_a', f't{t}_r')},
t{t}_s AS (SELECT r.* EXCLUDE (node), CASE WHEN (CASE j WHEN 0 THEN x0 ELSE x1 END) <= x THEN 2 ELSE 3 END AS node
  FROM t{t}_r r, t{t}_a), {_split_sql(f't{t}_b', f't{t}_s')},
t{t}_p AS (SELECT * FROM t{t}_b ORDER BY gain DESC LIMIT 1),
t{t}_l AS (SELECT s.* EXCLUDE (node), CASE WHEN s.node <> p.node THEN s.node
  WHEN (CASE j WHEN 0 THEN x0 ELSE x1 END) <= x THEN 4 ELSE 5 END AS node FROM t{t}_s s, t{t}_p p),
t{t}_v AS (SELECT node, count(*) AS n, -0.5 * sign(sum(f - y)) * greatest(abs(sum(f - y)) - 0.1, 0) / (count(*) + 1.0) AS value
  FROM t{t}_l GROUP BY node),
t{t} AS (SELECT k, x0, x1, y, f + value AS f FROM t{t}_l JOIN t{t}_v USING (node))"""


TREES_SQL = f"""WITH t_in AS (SELECT p_partkey AS k, p_size AS x0, length(p_type) AS x1, p_retailprice AS y,
  avg(p_retailprice) OVER () AS f FROM part),
{_tree_sql(1, 't_in')},
{_tree_sql(2, 't1')}"""


def _exact_trees(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x0"),
                                        F.length("p_type").cast("double").alias("x1"), F.col("p_retailprice").alias("y"))
    return d, fit_trees(d, ["x0", "x1"], "y", params=EXACT, key="p_partkey")


@query("score_trees_exact", f"{TREES_SQL} SELECT k AS p_partkey, round(f, 6) AS pred FROM t2")
def q_score_trees_exact(spark, sf):
    """Two trees, written as a node table and read back."""
    d, spec = _exact_trees(spark, sf)
    nodes = cut_lineage(node_table(spec, spark)).toPandas()
    back = spec_from_nodes(nodes, kind="gbt", feats=spec.feats, medians=spec.medians, init=spec.init)
    return back.transform(d, "pred").select("p_partkey", rnd("pred").alias("pred"))


@query("tree_leaves_exact", f"""{TREES_SQL}
SELECT 0 AS tree, n AS n_rows, round(value, 6) AS value FROM t1_v
UNION ALL SELECT 1, n, round(value, 6) FROM t2_v""")
def q_tree_leaves_exact(spark, sf):
    """The leaves of the node table."""
    _, spec = _exact_trees(spark, sf)
    return node_table(spec, spark).where("feature IS NULL").select(
        "tree", F.col("rows").cast("bigint").alias("n_rows"), rnd("value").alias("value"))


@query("split_importance_exact", f"""{TREES_SQL},
s AS (SELECT j FROM t1_a UNION ALL SELECT j FROM t1_p UNION ALL SELECT j FROM t2_a UNION ALL SELECT j FROM t2_p)
SELECT 'x' || i AS feature, count(j)::DOUBLE AS importance, round(count(j) * 100.0 / 4, 4) AS pct
FROM (SELECT unnest([0, 1]) AS i) LEFT JOIN s ON j = i GROUP BY i""")
def q_split_importance_exact(spark, sf):
    """M13 of the two trees."""
    _, spec = _exact_trees(spark, sf)
    return split_importance(spec, spark).select("feature", "importance", rnd("pct", 4).alias("pct"))


@query("gbt_fit")
def q_gbt_fit(spark, sf):
    """500 rounds of up to 31 leaves, stopped by a holdout, one ensemble
    per fold, all folds in one job."""
    return _tree_oof(spark, sf, "gbt")


@query("gbt_early_stop")
def q_gbt_early_stop(spark, sf):
    """The loss on the holdout after every round, and the round chosen."""
    d, feats = part_numeric(spark, sf)
    spec = fit_trees(d, feats, "y", "gbt", params=BOOST_THOROUGH, fold="fold", folds=FOLDS, key="p_partkey")
    rows = [(f, i, float(v), i == spec[f].n_trees) for f in FOLDS for i, v in enumerate(spec[f].curve)]
    return spark.createDataFrame(rows, "fold int, round int, loss double, chosen boolean").select(
        "fold", "round", rnd("loss").alias("loss"), "chosen")


@query("rf_bag_fit")
def q_rf_bag_fit(spark, sf):
    return _tree_oof(spark, sf, "rf")


@query("xt_bag_fit")
def q_xt_bag_fit(spark, sf):
    return _tree_oof(spark, sf, "xt")


@query("score_trees")
def q_score_trees(spark, sf):
    from sparkreg.plans.score import score
    b, _ = bundle_of(spark, sf, "quick", ("gbt",))
    return score(part_frame(spark, sf), b).select("p_partkey", rnd("y").alias("pred"))


# ---------------------------------------------------------------- M07 / M15 / J05 / D05
def _medians(d, feats):
    from sparkreg.plans.train import medians_by_set
    return medians_by_set(d, {s: feats for s in [*FOLDS, "all"]}, "fold")


def _gp_specs(d, feats):
    return fit_gp(d, feats, "y", "p_partkey", _medians(d, feats), "fold", FOLDS)


@query("gp_fit")
def q_gp_fit(spark, sf):
    d, feats = part_numeric(spark, sf)
    return by_fold(d, _gp_specs(d, feats), lambda rows, spec: spec.predict_column(rows, "pred"))


@query("ard_importance")
def q_ard_importance(spark, sf):
    spec = _gp_specs(*part_numeric(spark, sf))["all"]
    imp = spark.createDataFrame(list(spec.importance().items()), "feature string, importance double")
    return M.top_importance(imp)


@query("rbf_cross", """
WITH pts AS (SELECT p_size AS a, p_retailprice AS b FROM part
             ORDER BY md5(concat('42|', CAST(p_partkey AS VARCHAR))) LIMIT 300),
l AS (SELECT stddev_pop(p_size) AS la, stddev_pop(p_retailprice) AS lb FROM part)
SELECT p_partkey, round(sum(exp(-0.5 * (power((p_size - a) / la, 2) + power((p_retailprice - b) / lb, 2)))), 6) AS ksum
FROM part, pts, l GROUP BY p_partkey
""")
def q_rbf_cross(spark, sf):
    pt = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    pts = sample_rows(pt, "p_partkey", 300).select("p_size", "p_retailprice").toPandas().to_numpy(dtype=float)
    ls = pt.agg(F.stddev_pop("p_size"), F.stddev_pop("p_retailprice")).first()
    out = kernel_sum(pt, ["p_size", "p_retailprice"], pts, np.array([ls[0], ls[1]]))
    return out.select("p_partkey", rnd("ksum").alias("ksum"))


@query("score_gp_exact", """
WITH st AS (SELECT avg(p_size) AS xm, stddev_pop(p_size) AS xs, avg(p_retailprice) AS ym, stddev_pop(p_retailprice) AS ys FROM part),
r AS (SELECT p_partkey, (p_size - xm) / xs AS x, (p_retailprice - ym) / ys AS y,
             row_number() OVER (ORDER BY md5(concat('42|', CAST(p_partkey AS VARCHAR)))) AS nr FROM part, st),
z AS (SELECT max(CASE WHEN nr = 1 THEN x END) AS z1, max(CASE WHEN nr = 2 THEN x END) AS z2 FROM r),
k AS (SELECT p_partkey, y, 1.5 * exp(-0.5 * power((x - z1) / 0.7, 2)) AS k1, 1.5 * exp(-0.5 * power((x - z2) / 0.7, 2)) AS k2 FROM r, z),
a AS (SELECT sum(k1 * k1) + 0.2001 * 1.5 AS a11, sum(k1 * k2) + 0.2001 * 1.5 * exp(-0.5 * power((z1 - z2) / 0.7, 2)) AS a12,
             sum(k2 * k2) + 0.2001 * 1.5 AS a22, sum(k1 * y) AS b1, sum(k2 * y) AS b2 FROM k, z GROUP BY z1, z2)
SELECT p_partkey, round(((a22 * b1 - a12 * b2) * k1 + (a11 * b2 - a12 * b1) * k2) / (a11 * a22 - a12 * a12) * ys + ym, 4) AS pred
FROM k, a, st""")
def q_score_gp_exact(spark, sf):
    """D05 and the posterior of M07 with two points and given
    hyper-parameters."""
    from sparkreg.operators.gp import accumulate, prepare_specs, solve_alpha
    pt = part_frame(spark, sf).select("p_partkey", "p_size", "y")
    spec = prepare_specs(pt, "y", "p_partkey", {"all": {}}, None, {"all": ["p_size"]}, points=2)["all"]
    spec.ls, spec.sv, spec.nv = np.array([0.7]), 1.5, 0.2
    spec.alpha = solve_alpha(spec, *accumulate(pt, {"all": spec}, "y", None)["all"])
    return spec.predict_column(pt, "pred").select("p_partkey", rnd("pred", 4).alias("pred"))


@query("score_gp")
def q_score_gp(spark, sf):
    from sparkreg.plans.score import score
    b, _ = bundle_of(spark, sf, "quick", ("gp",))
    return score(part_frame(spark, sf), b).select("p_partkey", rnd("y").alias("pred"))


# ---------------------------------------------------------------- M08 / M11 / M16 / D06
@query("mlp_fit")
def q_mlp_fit(spark, sf):
    d, feats = part_numeric(spark, sf)
    specs = fit_mlp(d, feats, "y", _medians(d, feats), "fold", FOLDS)
    return by_fold(d, specs, lambda rows, spec: spec.predict_column(rows, "pred"))


@query("score_mlp")
def q_score_mlp(spark, sf):
    from sparkreg.plans.score import score
    b, _ = bundle_of(spark, sf, "quick", ("mlp",))
    return score(part_frame(spark, sf), b).select("p_partkey", rnd("y").alias("pred"))


@query("permutation_importance")
def q_permutation_importance(spark, sf):
    from sparkreg.operators.search import permutation_importance
    d, feats = part_numeric(spark, sf)
    spec = fit_mlp(d, feats, "y", _medians(d, feats), cols_by_set={"all": feats})["all"]
    imp = permutation_importance(d.select("p_partkey", "y", *feats), "p_partkey", "y", feats,
                                 lambda x: spec.predict_column(x, "pred"))
    return imp.select("feature", rnd("mean_drop").alias("mean_drop"), rnd("importance").alias("importance"))


@query("gbt_search")
def q_gbt_search(spark, sf):
    """Every candidate at full rounds with its own stop."""
    from sparkreg.operators.search import GBT_CHOICES, gbt_candidates, search_trees
    d, feats = part_numeric(spark, sf)
    table = TreeTable(d, feats, "y", "fold", "p_partkey", max(GBT_CHOICES["bins"]))
    trials = search_trees(table, gbt_candidates(d.count()), FOLDS, dict.fromkeys(FOLDS, feats), _medians(d, feats))
    return trials.select("trial", "params", "stage", rnd("r2").alias("r2"))


@query("mlp_search")
def q_mlp_search(spark, sf):
    """All networks of a stage in the same passes."""
    from sparkreg.operators.search import MLP_FINALISTS, halving_search, mlp_candidates
    d, feats = part_numeric(spark, sf)
    meds, cands = _medians(d, feats), mlp_candidates()

    def run(pairs):
        got = fit_networks(d, "y", {(i, f): NetWant(feats, meds[f], f, **cands[i]) for i, f in pairs}, "fold", held=True)
        return {k: held for k, (_, held) in got.items()}

    return halving_search(spark, cands, FOLDS, run, MLP_FINALISTS).select(
        "trial", "params", "stage", rnd("r2").alias("r2"))


# ---------------------------------------------------------------- M09 / D07 / T03 / A20
TE2 = f"""WITH {folds_cte('events', 'event_id', 'value')}, {oof_te_sql('user_id', 20.0, 'a')}, {oof_te_sql('event_type', 20.0, 'b')},
j AS (SELECT a_t.event_id, a_t.__y AS y, a_t.a, b_t.b FROM a_t JOIN b_t USING (event_id)),
s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS say, sum(b * y) AS sby FROM j),
u AS (SELECT *, (bb * say - ab * sby) / (aa * bb - ab * ab) AS w1u, (aa * sby - ab * say) / (aa * bb - ab * ab) AS w2u,
             greatest(say / aa, 0) AS wa, greatest(sby / bb, 0) AS wb FROM s),
w AS (SELECT CASE WHEN w1u > 0 AND w2u > 0 THEN w1u
                  WHEN -2 * wa * say + wa * wa * aa <= -2 * wb * sby + wb * wb * bb THEN wa ELSE 0.0 END AS w_user,
             CASE WHEN w1u > 0 AND w2u > 0 THEN w2u
                  WHEN -2 * wa * say + wa * wa * aa <= -2 * wb * sby + wb * wb * bb THEN 0.0 ELSE wb END AS w_type FROM u)"""


def _two_members(spark, sf):
    a = _oof_events(spark, sf, "user_id").select("event_id", F.col("value").alias("y"), F.col("te").alias("te_user"))
    b = _oof_events(spark, sf, "event_type").select("event_id", F.col("te").alias("te_type"))
    return a.join(b, "event_id")


@query("nnls_blend", f"{TE2} SELECT 'te_user' AS member, round(w_user, 6) AS weight FROM w "
       "UNION ALL SELECT 'te_type', round(w_type, 6) FROM w")
def q_nnls_blend(spark, sf):
    j = _two_members(spark, sf)
    A, b, _, _ = gram_of_members(j, ["te_user", "te_type"], "y")
    w = nnls_gram(A, b)
    return spark.createDataFrame([("te_user", float(w[0])), ("te_type", float(w[1]))],
                                 "member string, weight double").select("member", rnd("weight").alias("weight"))


@query("score_blend", f"{TE2} SELECT event_id, round(a * w_user + b * w_type, 6) AS pred FROM j, w")
def q_score_blend(spark, sf):
    from sparkreg.operators.blend import blend_column
    j = _two_members(spark, sf)
    A, b, _, _ = gram_of_members(j, ["te_user", "te_type"], "y")
    w = nnls_gram(A, b)
    return j.select("event_id", rnd(blend_column({"te_user": float(w[0]), "te_type": float(w[1])})).alias("pred"))


@query("pick_best", f"""
WITH {_cand_sql()}, u AS (SELECT * FROM te_user_c UNION ALL SELECT * FROM te_type_c UNION ALL SELECT * FROM te_user_s5_c),
b AS (SELECT name, r2 FROM u ORDER BY r2 DESC, name LIMIT 1)
SELECT name AS chosen, round(r2, 6) AS chosen_r2, name AS best_single, round(r2, 6) AS best_single_r2,
       CAST(NULL AS DOUBLE) AS blend_r2 FROM b
""")
def q_pick_best(spark, sf):
    c = M.pick_best(_candidates(spark, sf))
    return c.select("chosen", rnd("chosen_r2").alias("chosen_r2"), "best_single",
                    rnd("best_single_r2").alias("best_single_r2"), "blend_r2")


@query("importance_merge")
def q_importance_merge(spark, sf):
    d, feats = part_numeric(spark, sf)
    lin = ridge_cv(d, feats, "y", "p_partkey", None, ALPHAS_STD).final
    tree = fit_trees(d, feats, "y", "gbt", key="p_partkey")
    tot = sum(abs(c) for c in lin.scaled()) or 1.0
    li = spark.createDataFrame([("linear", f, abs(c) / tot * 100.0) for f, c in zip(lin.feats, lin.scaled())],
                               "member string, feature string, pct double")
    tr = split_importance(tree, spark).select(F.lit("gbt").alias("member"), "feature", "pct")
    wide = d.select("p_partkey", "y", lin.predict().alias("linear"))
    wide = tree.transform(wide.join(d.select("p_partkey", *feats), "p_partkey"), "gbt")
    w = blend_weights(wide, ["linear", "gbt"], "y", {"linear": 0.5, "gbt": 0.5})
    weights = spark.createDataFrame(list(w.items()), "member string, weight double")
    return M.importance_merge(li.unionByName(tr), weights).select("feature", rnd("pct", 4).alias("pct"))


@query("importance_merge_exact", f"""{TREES_SQL},
s AS (SELECT j FROM t1_a UNION ALL SELECT j FROM t1_p UNION ALL SELECT j FROM t2_a UNION ALL SELECT j FROM t2_p),
ti AS (SELECT 'x' || i AS feature, count(j) / 4.0 AS p FROM (SELECT unnest([0, 1]) AS i) LEFT JOIN s ON j = i GROUP BY i),
two AS (SELECT x0 AS u, x1 AS v, y FROM t_in),
pen AS (SELECT power({IQR.format('u')}, 2) AS pu, power({IQR.format('v')}, 2) AS pv FROM two), {TWO_SQL},
li AS (SELECT 'x0' AS feature, abs(wu * sqrt(pu)) / (abs(wu * sqrt(pu)) + abs(wv * sqrt(pv))) AS p FROM w, pen
       UNION ALL SELECT 'x1', abs(wv * sqrt(pv)) / (abs(wu * sqrt(pu)) + abs(wv * sqrt(pv))) FROM w, pen),
a AS (SELECT ti.feature, 0.7 * ti.p + 0.3 * li.p AS v FROM ti JOIN li USING (feature))
SELECT feature, round(v * 100 / sum(v) OVER (), 4) AS pct FROM a""")
def q_importance_merge_exact(spark, sf):
    """A20 of a ridge and a boosted model with weights 0.3 and 0.7."""
    d, spec = _exact_trees(spark, sf)
    lin = ridge_cv(d, ["x0", "x1"], "y", "p_partkey", None, [1.0]).final
    li = M.coef_importance(lin.feats, lin.scaled(), spark).select(
        F.lit("linear").alias("member"), "feature", (F.col("importance") * 100).alias("pct"))
    tr = split_importance(spec, spark).select(F.lit("gbt").alias("member"), "feature", "pct")
    weights = spark.createDataFrame([("linear", 0.3), ("gbt", 0.7)], "member string, weight double")
    return M.importance_merge(li.unionByName(tr), weights).select("feature", rnd("pct", 4).alias("pct"))


# ---------------------------------------------------------------- M12
@query("y_transform_select", f"""
WITH {folds_cte('events', 'event_id', 'value')},
tr AS (SELECT value FROM folded WHERE fold <> 0),
s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM tr),
k AS (SELECT CASE WHEN sd < 1e-12 THEN 0.0 ELSE (SELECT avg(power(value - mu, 3)) FROM tr) / power(sd, 3) END AS skew FROM s)
SELECT round(skew, 6) AS skew, CASE WHEN skew > 0.75 AND (SELECT min(value) FROM events) >= 0 THEN 'log1p'
       WHEN abs(skew) > 0.75 THEN 'yeo_johnson' ELSE 'none' END AS transform FROM k
""")
def q_y_transform_select(spark, sf):
    from sparkreg.operators.transform import quick_transform_rule
    ev = table(spark, sf, "events")
    f = stratified_folds(ev, "event_id", "value")
    ymin = ev.agg(F.min("value")).first()[0]
    r = quick_transform_rule(f.filter(F.col("fold") != 0), "value", ymin)
    return r.select(rnd("skew").alias("skew"), "transform")


@query("y_transform_probe")
def q_y_transform_probe(spark, sf):
    """M12 of a thorough run: R2 of each transform's boosted probes on two
    folds, on the target's own scale, and the choice."""
    from sparkreg.plans.train import select_transform_cv
    ev = table(spark, sf, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"),
                                           (F.col("event_type") == "purchase").cast("double").alias("bought"),
                                           F.length("event_type").cast("double").alias("kind"))
    d = cut_lineage(stratified_folds(ev, "event_id", "value"))
    ymin = d.agg(F.min("value")).first()[0]
    best, lam, scores = select_transform_cv(d, "value", ["hour", "bought", "kind"], ymin, [0, 1], key="event_id")
    return spark.createDataFrame([(t, float(v), t == best) for t, v in scores.items()],
                                 "transform string, r2 double, chosen boolean").withColumn("r2", rnd("r2"))


# ---------------------------------------------------------------- M18 / M20 / M21 / M22 / A22
RIDGE_ONE = f"""
{folds_cte('part', 'p_partkey', 'p_retailprice')},
b AS (SELECT p_partkey, fold, CAST(nullif(p_size, 1) AS DOUBLE) AS x, __y AS y,
             CAST(('0x' || substr(md5(concat('42i|', CAST(p_partkey AS VARCHAR))), 1, 8))::BIGINT % 5 AS INTEGER) AS inn
      FROM folded),
fs AS (SELECT DISTINCT fold AS f FROM b UNION ALL SELECT -1),
med AS (SELECT f, quantile_cont(x, 0.5) AS m FROM b, fs WHERE b.fold <> fs.f GROUP BY f),
tr AS (SELECT med.f, b.inn, coalesce(b.x, med.m) AS xf, b.y FROM b JOIN med ON b.fold <> med.f),
sc AS (SELECT f, greatest(quantile_cont(xf, 0.75) - quantile_cont(xf, 0.25), 1e-8) AS s FROM tr GROUP BY f),
al AS (SELECT * FROM (VALUES {ALPHA_VALUES}) v(ai, a)),
ins AS (SELECT DISTINCT inn AS i FROM b),
fit AS (SELECT t.f, al.ai, al.a, ins.i, avg(t.xf) AS mx, avg(t.y) AS my,
               var_pop(t.xf) * count(*) AS sxx, covar_pop(t.xf, t.y) * count(*) AS sxy
        FROM tr t, al, ins WHERE t.inn <> ins.i GROUP BY t.f, al.ai, al.a, ins.i),
coef AS (SELECT fit.*, sxy / (sxx + a * s * s) AS beta FROM fit JOIN sc USING (f)),
sse AS (SELECT c.f, c.ai, c.a, sum(power(t.y - (c.my - c.beta * c.mx) - c.beta * t.xf, 2)) AS e
        FROM coef c JOIN tr t ON t.f = c.f AND t.inn = c.i GROUP BY c.f, c.ai, c.a),
best AS (SELECT f, a FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY e, ai) AS r FROM sse) WHERE r = 1),
fin AS (SELECT t.f, avg(t.xf) AS mx, avg(t.y) AS my, var_pop(t.xf) * count(*) AS sxx,
               covar_pop(t.xf, t.y) * count(*) AS sxy FROM tr t GROUP BY t.f),
cf AS (SELECT fin.f, fin.sxy / (fin.sxx + best.a * sc.s * sc.s) AS beta, fin.my, fin.mx, med.m
       FROM fin JOIN best USING (f) JOIN sc USING (f) JOIN med USING (f)),
pr AS (SELECT b.y, o.my - o.beta * o.mx + o.beta * coalesce(b.x, o.m) AS oof,
              a.my - a.beta * a.mx + a.beta * coalesce(b.x, a.m) AS ins
       FROM b JOIN cf o ON o.f = b.fold JOIN cf a ON a.f = -1)"""


def _ridge_one(spark, sf):
    """Ridge on one nullable feature of part: out-of-fold and in-sample
    predictions per row."""
    pt = table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).cast("double").alias("x"),
                                         "p_retailprice")
    d = stratified_folds(pt, "p_partkey", "p_retailprice")
    res = ridge_cv(d, ["x"], "p_retailprice", "p_partkey", "fold", ALPHAS_STD)
    e = None
    for f, sp in res.per_fold.items():
        e = F.when(F.col("fold") == f, sp.predict()) if e is None else e.when(F.col("fold") == f, sp.predict())
    return d.select(F.col("p_retailprice").alias("y"), e.alias("oof"), res.final.predict().alias("fit"))


@query("overfit_gap", f"""
WITH {RIDGE_ONE},
m AS (SELECT 1 - sum(power(y - oof, 2)) / (var_pop(y) * count(*)) AS o,
             1 - sum(power(y - ins, 2)) / (var_pop(y) * count(*)) AS t FROM pr)
SELECT round(o, 6) AS oof_r2, round(t, 6) AS train_r2, round(t - o, 6) AS gap FROM m
""")
def q_overfit_gap(spark, sf):
    a = _ridge_one(spark, sf).agg(*M.r2_aggs("y", "oof", "o_"), *M.r2_aggs("y", "fit", "t_"))
    o, t = M.r2_from(F.col("o_sse"), F.col("o_sst")), M.r2_from(F.col("t_sse"), F.col("t_sst"))
    return a.select(rnd(o).alias("oof_r2"), rnd(t).alias("train_r2"), rnd(t - o).alias("gap"))


@query("train")
def q_train(spark, sf):
    return trained(spark, sf).report


@query("train_thorough")
def q_train_thorough(spark, sf):
    """M21 in full: out-of-fold evaluation of all seven families, with the
    searches, the forests of 300 trees, the recipes and the blend."""
    return trained(spark, sf, "thorough").leaderboard


@query("choose_deployed")
def q_choose_deployed(spark, sf):
    """The chosen model, else the next by R2 that can be saved."""
    from sparkreg.plans.train import deploy
    chosen, deployed, failures = deploy(trained(spark, sf), scratch_path(spark, "deploy"))
    return spark.createDataFrame([(chosen, deployed, deployed != chosen, ";".join(failures))],
                                 "best string, deployed string, deploy_substituted boolean, failures string")


@query("quality_warnings", f"""
WITH {folds_cte('events', 'event_id', 'value')},
q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM folded WHERE fold <> 0),
o AS (SELECT count(*) AS n FROM events, q WHERE value < a - 4.5 * (b - a) OR value > b + 4.5 * (b - a)),
w AS (SELECT 1 AS p, 'outliers_corrected' AS key, 'n=' || n || ';iqr_mult=4.5' AS params FROM o WHERE n > 0
      UNION ALL SELECT 2, 'date_cols_dropped', 'cols=ts')
SELECT row_number() OVER (ORDER BY p) - 1 AS pos, key, params FROM w
""")
def q_quality_warnings(spark, sf):
    """A22 of a training run on events, time column included."""
    from sparkreg.plans.train import train
    ev = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("user"), "ts", "value")
    return train(ev, "value", key="event_id", families=("linear",)).warnings.select(
        F.col("pos").cast("bigint").alias("pos"), "key", "params")


# ---------------------------------------------------------------- D01 / D08 / U02 / X01
@query("train_linear", f"""
WITH {LINEAR_ONE}, v AS (SELECT * FROM pr WHERE f = 0 AND fold = 0),
t AS (SELECT 1 - sum(power(y - lin, 2)) / (var_pop(y) * count(*)) AS r FROM pr WHERE f = -1)
SELECT 'y' AS target, (SELECT count(*) FROM part) AS n_rows, 'val' AS eval_on, 'linear' AS best_model,
       round(1 - sum(power(y - lin, 2)) / (var_pop(y) * count(*)), 6) AS r2,
       round(1 - sum(power(y_raw - pred, 2)) / (var_pop(y_raw) * count(*)), 6) AS r2_raw,
       round(sqrt(avg(power(y_raw - pred, 2))), 6) AS rmse, round(avg(abs(y_raw - pred)), 6) AS mae,
       round(any_value(t.r), 6) AS train_r2 FROM v, t
""")
def q_train_linear(spark, sf):
    """M21 with one family and one feature: the report, checked in SQL."""
    res, _ = linear_one(spark, sf)
    lb = res.leaderboard.select(F.col("name").alias("best_model"), "train_r2")
    return res.report.join(F.broadcast(lb), "best_model").select(
        "target", "n_rows", "eval_on", "best_model", rnd("r2").alias("r2"), rnd("r2_raw").alias("r2_raw"),
        rnd("rmse").alias("rmse"), rnd("mae").alias("mae"), rnd("train_r2").alias("train_r2"))


@query("oof_evaluate", f"WITH {LINEAR_ONE} SELECT p_partkey, fold, round(lin, 6) AS linear FROM pr WHERE f = 0 AND fold = 0")
def q_oof_evaluate(spark, sf):
    """The rows of the evaluated fold, predicted by the model that has
    not seen them."""
    res, _ = linear_one(spark, sf)
    return res.oof.select("p_partkey", "fold", rnd("linear").alias("linear"))


@query("oof_evaluate_linear", f"WITH {LINEAR_ALL} SELECT p_partkey, fold, round(lin, 6) AS linear FROM pr WHERE f = fold")
def q_oof_evaluate_linear(spark, sf):
    """M18 over all folds: every row predicted by the model of its fold."""
    from sparkreg.plans.train import train
    res = train(one_feature(spark, sf), "y", key="p_partkey", strategy="thorough", families=("linear",), transform="none")
    return res.oof.select("p_partkey", "fold", rnd("linear").alias("linear"))


@query("oof_evaluate_all_folds")
def q_oof_evaluate_all_folds(spark, sf):
    res = trained(spark, sf, "thorough", ("linear", "gbt"))
    cols = [c for c in res.oof.columns if c in ("linear", "gbt")]
    return res.oof.select("p_partkey", "fold", *[rnd(c).alias(c) for c in cols])


SCORED_SQL = f"WITH {LINEAR_ONE} SELECT p_partkey, round(pred, 6) AS pred FROM pr WHERE f = -1"


@query("score", SCORED_SQL)
def q_score(spark, sf):
    """The saved bundle applied to the raw columns."""
    from sparkreg.plans.score import score
    _, b = linear_one(spark, sf)
    return score(one_feature(spark, sf), b).select("p_partkey", rnd("y").alias("pred"))


@query("score_best")
def q_score_best(spark, sf):
    from sparkreg.plans.score import score
    b, _ = bundle_of(spark, sf)
    return score(part_frame(spark, sf), b).select("p_partkey", rnd("y").alias("pred"))


@query("score_dispatch")
def q_score_dispatch(spark, sf):
    """D01 by each type of model, trained on one prepared table side by side."""
    from sparkreg.plans.score import score
    from sparkreg.plans.train import _each, prepare, save, train
    from sparkreg.session import tune_session
    from sparkreg.sources.model_io import load_bundle
    tune_session(spark)
    ready = prepare(part_frame(spark, sf), "y", "p_partkey", "quick")

    def bundle(fam):
        root = scratch_path(spark, "bundle")
        save(train(part_frame(spark, sf), "y", key="p_partkey", strategy="quick", families=(fam,), ready=ready), root)
        return load_bundle(spark, root)

    rows = None
    for fam, b in _each(bundle, ("linear", "gbt", "gp", "mlp")).items():
        s = score(part_frame(spark, sf), b).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("y")).alias("mean_pred"))
        s = s.select(F.lit(fam).alias("type"), "n", "mean_pred")
        rows = s if rows is None else rows.unionByName(s)
    return rows


@query("required_columns", """
SELECT * FROM (VALUES (0::BIGINT, 'p_size'), (1::BIGINT, 'name_len'), (2::BIGINT, 'p_type'), (3::BIGINT, 'p_brand'))
v(pos, "column")
""")
def q_required_columns(spark, sf):
    from sparkreg.plans.score import required_columns
    b, _ = bundle_of(spark, sf, families=("linear",))
    return spark.createDataFrame(list(enumerate(required_columns(b.meta))), "pos bigint, column string")


@query("score_stream", SCORED_SQL)
def q_score_stream(spark, sf):
    """The scoring plan over a file stream."""
    from sparkreg.streaming.score_stream import score_stream
    _, b = linear_one(spark, sf)
    src = scratch_path(spark, "stream-src")
    rows = one_feature(spark, sf)
    rows.repartition(4).write.mode("overwrite").parquet(src)
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    score_stream(spark, src, rows.schema, b, out, ck)
    return spark.read.parquet(out).select("p_partkey", rnd("y").alias("pred"))
