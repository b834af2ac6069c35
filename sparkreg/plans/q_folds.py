"""Registered queries: folds, splits, encoders, metrics and model choice
(W01-W06, U01, T01, T03-T06, J01-J04, M19, A07, A10-A12, A17, A21, A22).

The oracle SQL states the fold rule directly with a global
``row_number() over (partition by bin order by md5(...))``; the Spark side
computes the same ranks with bounded windows (``folds.md5_rank``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreg.operators import encode as E
from sparkreg.operators import folds as W
from sparkreg.operators import metrics as M
from sparkreg.operators import profile as P
from sparkreg.operators.linear import gram_by_fold
from sparkreg.plans.catalog import query
from sparkreg.sources.tables import table

R = 6


def rnd(c, n=R):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---------------------------------------------------------------- SQL helpers
def folds_cte(tbl: str, key: str, y: str, k: int = 5, nb: int = 5, seed: int = 42) -> str:
    """CTEs ``base``, ``binned``, ``folded`` (adds __bin, fold) for a table
    of >= 100 rows (k = 5, 5 bins)."""
    probs = ", ".join(f"quantile_cont(__y, {i / nb})" for i in range(nb + 1))
    return f"""
base AS (SELECT *, {key} AS __k, {y} AS __y FROM {tbl}),
edges AS (SELECT list_sort(list_distinct([{probs}])) AS ue FROM base),
binned AS (SELECT base.*, greatest(0, len(list_filter(ue[1:len(ue)-1], lambda v: v < __y)) - 1) AS __bin
           FROM base, edges),
kmin AS (SELECT least({k}, min(c)) AS keff FROM (SELECT count(*) AS c FROM binned GROUP BY __bin)),
folded AS (SELECT binned.*, CAST((row_number() OVER (PARTITION BY __bin
             ORDER BY md5(concat('{seed}|', CAST(__k AS VARCHAR)))) - 1) % keff AS INTEGER) AS fold
           FROM binned, kmin)"""


def spark_folds(spark, sf, tbl, key, y):
    df = table(spark, sf, tbl)
    if y not in df.columns:
        df = df.withColumn(y, F.expr(y))
    return W.stratified_folds(df, key, y)


def oof_te_sql(col: str, s: float = 20.0, out: str = "te") -> str:
    """SQL of M19 over ``folded`` (y = __y): encoding fitted outside the
    fold.  Adds CTE ``{out}_t`` with column ``{out}``."""
    cls = f"coalesce(nullif(CAST({col} AS VARCHAR), ''), '__NaN__')"
    fcls = f"coalesce(nullif(CAST(f.{col} AS VARCHAR), ''), '__NaN__')"
    return f"""
{out}_cf AS (SELECT {cls} AS cls, fold, count(__y) AS n_cf, sum(__y) AS s_cf FROM folded GROUP BY 1, 2),
{out}_ct AS (SELECT cls, sum(n_cf) AS n_c, sum(s_cf) AS s_c FROM {out}_cf GROUP BY 1),
{out}_gf AS (SELECT fold, (sum(sum(__y)) OVER () - sum(__y)) / (sum(count(__y)) OVER () - count(__y)) AS g_out
       FROM folded GROUP BY fold),
{out}_t AS (SELECT f.*, (ct.s_c - coalesce(cf.s_cf, 0) + gf.g_out * {s}) / (ct.n_c - coalesce(cf.n_cf, 0) + {s}) AS {out}
       FROM folded f JOIN {out}_gf gf USING (fold) JOIN {out}_ct ct ON ct.cls = {fcls}
       LEFT JOIN {out}_cf cf ON cf.cls = ct.cls AND cf.fold = f.fold)"""


# ---------------------------------------------------------------- W01 / W02 / W03
@query("quantile_bins", f"WITH {folds_cte('part', 'p_partkey', 'p_retailprice')} "
       "SELECT p_partkey, CAST(__bin AS INTEGER) AS bin FROM binned")
def q_quantile_bins(spark, sf):
    pt = table(spark, sf, "part")
    _, nb = W.fold_plan(pt.count())
    return W.quantile_bins(pt, "p_retailprice", nb).select("p_partkey", "bin")


@query("stratified_folds", f"WITH {folds_cte('events', 'event_id', 'value')} SELECT event_id, fold FROM folded")
def q_stratified_folds(spark, sf):
    return spark_folds(spark, sf, "events", "event_id", "value").select("event_id", "fold")


@query("kfold", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('42|', CAST(o_orderkey AS VARCHAR)))) - 1 AS rk,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(CASE WHEN rk < (n % 5) * (n // 5 + 1) THEN rk // (n // 5 + 1)
       ELSE (n % 5) + (rk - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM r
""")
def q_kfold(spark, sf):
    od = table(spark, sf, "orders").select("o_orderkey")
    return W.kfold(od, "o_orderkey", 5).select("o_orderkey", "fold")


# ---------------------------------------------------------------- W04 / W05 / U01
@query("es_holdout", f"""
WITH {folds_cte('part', 'p_partkey', 'p_retailprice')},
tr AS (SELECT p_partkey FROM folded WHERE fold <> 0),
r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5(concat('7|', CAST(p_partkey AS VARCHAR)))) - 1 AS rk,
             count(*) OVER () AS n FROM tr)
SELECT p_partkey, rk < greatest(1, round_even(n * 0.1, 0)) AS is_es FROM r
""")
def q_es_holdout(spark, sf):
    f = spark_folds(spark, sf, "part", "p_partkey", "p_retailprice")
    tr = W.training_rows(f, "fold", 0).select("p_partkey")
    return W.es_holdout(tr, "p_partkey").select("p_partkey", "is_es")


@query("train_val_split", f"""
WITH {folds_cte('part', 'p_partkey', 'p_retailprice')}
SELECT p_partkey, CASE WHEN fold = 0 THEN 'val' ELSE 'train' END AS split FROM folded
""")
def q_train_val_split(spark, sf):
    f = spark_folds(spark, sf, "part", "p_partkey", "p_retailprice")
    val = W.validation_rows(f).select("p_partkey", F.lit("val").alias("split"))
    tr = W.training_rows(f).select("p_partkey", F.lit("train").alias("split"))
    return val.unionByName(tr)


@query("fold_complement", f"""
WITH {folds_cte('events', 'event_id', 'value')}
SELECT event_id, fold FROM folded EXCEPT SELECT event_id, fold FROM folded WHERE fold = 2
""")
def q_fold_complement(spark, sf):
    f = spark_folds(spark, sf, "events", "event_id", "value")
    return W.training_rows(f, "fold", 2).select("event_id", "fold")


# ---------------------------------------------------------------- W06 / T04 / T05
@query("permute_column", """
WITH a AS (SELECT event_id, row_number() OVER (ORDER BY md5(concat('42a|', CAST(event_id AS VARCHAR)))) AS r FROM events),
     b AS (SELECT value, row_number() OVER (ORDER BY md5(concat('42b|', CAST(event_id AS VARCHAR)))) AS r FROM events)
SELECT a.event_id, b.value FROM a JOIN b USING (r)
""")
def q_permute_column(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return W.permute_column(ev, "event_id", "value", 42).select("event_id", "value")


@query("sample_rows", """
SELECT event_id, value FROM events ORDER BY md5(concat('42|', CAST(event_id AS VARCHAR))) LIMIT 300
""")
def q_sample_rows(spark, sf):
    return W.sample_rows(table(spark, sf, "events"), "event_id", 300).select("event_id", "value")


@query("preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def q_preview(spark, sf):
    return W.preview(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


# ---------------------------------------------------------------- A07 / J01
TE_COL = "CAST(user_id AS VARCHAR)"


@query("target_encode_fit", f"""
WITH g AS (SELECT avg(value) AS gm FROM events)
SELECT coalesce(nullif({TE_COL}, ''), '__NaN__') AS class,
       round((sum(value) + 20 * gm) / (count(value) + 20), 6) AS value, round(gm, 6) AS default_value
FROM events, g GROUP BY 1, gm
""")
def q_target_encode_fit(spark, sf):
    ev = table(spark, sf, "events").withColumn("u", F.col("user_id").cast("string"))
    m, g = E.target_encoder_fit(ev, "u", "value")
    return m.select("class", rnd("value").alias("value"), F.lit(round(g, R)).alias("default_value"))


@query("target_encode_apply", f"""
WITH g AS (SELECT avg(value) AS gm FROM events WHERE event_type <> 'error'),
m AS (SELECT coalesce(nullif({TE_COL}, ''), '__NaN__') AS class, (sum(value) + 20 * gm) / (count(value) + 20) AS v
      FROM events, g WHERE event_type <> 'error' GROUP BY 1, gm)
SELECT event_id, round(coalesce(m.v, (SELECT gm FROM g)), 6) AS te
FROM events LEFT JOIN m ON m.class = coalesce(nullif({TE_COL}, ''), '__NaN__')
""")
def q_target_encode_apply(spark, sf):
    """Fit on non-error events, apply to all (unseen classes -> default)."""
    ev = table(spark, sf, "events").withColumn("u", F.col("user_id").cast("string"))
    m, g = E.target_encoder_fit(ev.filter(F.col("event_type") != "error"), "u", "value")
    n = E.category_count(ev, "u")
    out = E.target_encode_apply(ev, "u", m, g, out="te", n_classes=n)
    return out.select("event_id", rnd("te").alias("te"))


# ---------------------------------------------------------------- J04 / M19 / J02
@query("fold_stats_join", f"""
WITH {folds_cte('events', 'event_id', 'value')},
s AS (SELECT event_type, fold, count(*) AS n, sum(value) AS sv FROM folded GROUP BY 1, 2),
t AS (SELECT event_type, sum(n) AS nt, sum(sv) AS st FROM s GROUP BY 1)
SELECT f.event_id, f.fold, CAST(t.nt - s.n AS BIGINT) AS n_other, round((t.st - s.sv) / (t.nt - s.n), 6) AS mean_other
FROM folded f JOIN s USING (event_type, fold) JOIN t USING (event_type)
""")
def q_fold_stats_join(spark, sf):
    f = spark_folds(spark, sf, "events", "event_id", "value")
    st = E.fold_class_stats(f, "event_type", "value").select(
        F.col("class").alias("event_type"), "fold", (F.col("n_c") - F.col("n_cf")).alias("n_other"),
        ((F.col("s_c") - F.col("s_cf")) / (F.col("n_c") - F.col("n_cf"))).alias("mean_other"))
    j = E.join_lookup(f.select("event_id", "fold", "event_type"), st, ["event_type", "fold"], 5 * 16)
    return j.select("event_id", "fold", "n_other", rnd("mean_other").alias("mean_other"))


@query("oof_target_encode", f"""
WITH {folds_cte('events', 'event_id', 'value')}, {oof_te_sql('user_id')}
SELECT event_id, fold, round(te, 6) AS te FROM te_t
""")
def q_oof_target_encode(spark, sf):
    f = spark_folds(spark, sf, "events", "event_id", "value").withColumn("u", F.col("user_id").cast("string"))
    n = E.category_count(f, "u")
    out = E.oof_target_encode(f, "u", "value", out="te", n_classes=n)
    return out.select("event_id", "fold", rnd("te").alias("te"))


@query("oof_assemble", f"""
WITH {folds_cte('part', 'p_partkey', 'p_retailprice')},
m AS (SELECT f.fold AS fold, p.p_type, avg(p.__y) AS pred FROM folded p, (SELECT DISTINCT fold FROM folded) f
      WHERE p.fold <> f.fold GROUP BY 1, 2)
SELECT p_partkey, fold, round(pred, 6) AS pred FROM folded JOIN m USING (fold, p_type)
""")
def q_oof_assemble(spark, sf):
    from sparkreg.operators.blend import oof_assemble
    f = spark_folds(spark, sf, "part", "p_partkey", "p_retailprice")

    def fit(train):        # per-type mean on the complement, as a table
        return train.groupBy("p_type").agg(F.avg("p_retailprice").alias("pred"))

    def score(rows, means):
        return rows.join(means, "p_type", "left").select("p_partkey", "fold", "pred")

    out = oof_assemble(f, "fold", fit, score)
    return out.select("p_partkey", "fold", rnd("pred").alias("pred"))


# ---------------------------------------------------------------- A10 / A11 / A12
OOF_EV = f"WITH {folds_cte('events', 'event_id', 'value')}, {oof_te_sql('user_id')}"


def _oof_events(spark, sf, col="user_id", smoothing=20.0):
    f = spark_folds(spark, sf, "events", "event_id", "value").withColumn("__c", F.col(col).cast("string"))
    return E.oof_target_encode(f, "__c", "value", out="te", smoothing=smoothing,
                               n_classes=E.category_count(f, "__c")).drop("__c")


R2_SQL = ("CASE WHEN var_pop(__y) * count(__y) > 0 THEN 1 - sum((__y - te) * (__y - te)) / (var_pop(__y) * count(__y)) "
          "WHEN sum((__y - te) * (__y - te)) = 0 THEN 1.0 ELSE 0.0 END")


@query("metric_r2", f"{OOF_EV} SELECT round({R2_SQL}, 6) AS r2, count(__y) AS n FROM te_t")
def q_metric_r2(spark, sf):
    r = M.r2_frame(_oof_events(spark, sf), "value", "te")
    return r.select(rnd("r2").alias("r2"), "n")


@query("metric_rmse_mae", f"""{OOF_EV}
SELECT round(sqrt(avg((__y - te) * (__y - te))), 6) AS rmse, round(avg(abs(__y - te)), 6) AS mae,
       count(__y - te) AS eval_rows FROM te_t
""")
def q_metric_rmse_mae(spark, sf):
    r = M.error_metrics(_oof_events(spark, sf), "value", "te")
    return r.select(rnd("rmse").alias("rmse"), rnd("mae").alias("mae"), "eval_rows")


@query("metric_r2_by_fold", f"""{OOF_EV},
pf AS (SELECT fold, {R2_SQL} AS r2 FROM te_t GROUP BY fold HAVING count(__y) >= 2)
SELECT round(CASE WHEN count(*) >= 2 THEN stddev_pop(r2) ELSE 0.0 END, 6) AS r2_std, count(*) AS n_folds FROM pf
""")
def q_metric_r2_by_fold(spark, sf):
    r = M.r2_by_fold(_oof_events(spark, sf), "value", "te")
    return r.select(rnd("r2_std").alias("r2_std"), "n_folds")


# ---------------------------------------------------------------- A17
GRAM_X = {"x1": "CAST(p_size AS DOUBLE)", "x2": "CAST(length(p_name) AS DOUBLE)"}


@query("gram_by_fold", f"""
WITH {folds_cte('part', 'p_partkey', 'p_retailprice')},
g AS (SELECT fold, {GRAM_X['x1']} AS x1, {GRAM_X['x2']} AS x2, __y AS y FROM folded)
SELECT fold, count(*) AS n, round(sum(x1), 4) AS s_x1, round(sum(x2), 4) AS s_x2, round(sum(y), 4) AS s_y,
       round(sum(x1 * x1), 4) AS s_x1_x1, round(sum(x1 * x2), 4) AS s_x1_x2, round(sum(x2 * x2), 4) AS s_x2_x2,
       round(sum(x1 * y), 4) AS s_x1_y, round(sum(x2 * y), 4) AS s_x2_y, round(sum(y * y), 4) AS s_y_y
FROM g GROUP BY fold
""")
def q_gram_by_fold(spark, sf):
    f = spark_folds(spark, sf, "part", "p_partkey", "p_retailprice")
    f = f.select("fold", *[F.expr(v.replace("VARCHAR", "STRING")).alias(k) for k, v in GRAM_X.items()],
                 F.col("p_retailprice").alias("y"))
    g = gram_by_fold(f, ["x1", "x2"], "y", "fold")
    return g.select("fold", "n", *[F.round(c, 4).alias(c) for c in g.columns if c.startswith("s_")])


# ---------------------------------------------------------------- A21 / T03 / T06 / J03
CANDS = {"te_user": ("user_id", 20.0), "te_type": ("event_type", 20.0), "te_user_s5": ("user_id", 5.0)}


def _cand_sql():
    parts = []
    for name, (col, s) in CANDS.items():
        parts.append(f"""
{name}_c AS (WITH {folds_cte('events', 'event_id', 'value')}, {oof_te_sql(col, s)},
  pf AS (SELECT fold, {R2_SQL} AS r2 FROM te_t GROUP BY fold HAVING count(__y) >= 2),
  tr AS (SELECT {cls_sql(col)} AS cls, (sum(value) + {s} * (SELECT avg(value) FROM events)) / (count(value) + {s}) AS v
         FROM events GROUP BY 1),
  ins AS (SELECT value AS __y, v AS te FROM events JOIN tr ON tr.cls = {cls_sql(col)})
  SELECT '{name}' AS name, (SELECT {R2_SQL} FROM te_t) AS r2,
         (SELECT CASE WHEN count(*) >= 2 THEN stddev_pop(r2) ELSE 0.0 END FROM pf) AS r2_std,
         (SELECT {R2_SQL} FROM ins) AS train_r2)""")
    return ",".join(parts)


def cls_sql(col):
    return f"coalesce(nullif(CAST({col} AS VARCHAR), ''), '__NaN__')"


def _candidates(spark, sf):
    """Leaderboard inputs: OOF target-encoding predictors of events.value."""
    from functools import reduce
    rows = []
    for name, (col, s) in CANDS.items():
        oof = _oof_events(spark, sf, col, s)
        ev = table(spark, sf, "events").withColumn("__c", F.col(col).cast("string"))
        m, g = E.target_encoder_fit(ev, "__c", "value", smoothing=s)
        ins = E.target_encode_apply(ev, "__c", m, g, out="te", n_classes=E.category_count(ev, "__c"))
        r2 = M.r2_frame(oof, "value", "te").select("r2")
        std = M.r2_by_fold(oof, "value", "te").select("r2_std")
        tr2 = M.r2_frame(ins, "value", "te").select(F.col("r2").alias("train_r2"))
        one = r2.first()["r2"], std.first()["r2_std"], tr2.first()["train_r2"]
        rows.append((name,) + tuple(float(x) for x in one))
    return spark.createDataFrame(rows, "name string, r2 double, r2_std double, train_r2 double")


@query("leaderboard", f"""
WITH {_cand_sql()}, u AS (SELECT * FROM te_user_c UNION ALL SELECT * FROM te_type_c UNION ALL SELECT * FROM te_user_s5_c)
SELECT name, round(r2, 6) AS r2, round(r2_std, 6) AS r2_std, round(train_r2, 6) AS train_r2,
       row_number() OVER (ORDER BY r2 DESC, name) = 1 AS is_best FROM u
""")
def q_leaderboard(spark, sf):
    lb = M.leaderboard(_candidates(spark, sf))
    return lb.select("name", rnd("r2").alias("r2"), rnd("r2_std").alias("r2_std"),
                     rnd("train_r2").alias("train_r2"), "is_best")


@query("halving_select", f"""
WITH {_cand_sql()}, u AS (SELECT * FROM te_user_c UNION ALL SELECT * FROM te_type_c UNION ALL SELECT * FROM te_user_s5_c)
SELECT name AS trial, round(r2, 6) AS r2 FROM u ORDER BY r2 DESC, name LIMIT 2
""")
def q_halving_select(spark, sf):
    c = _candidates(spark, sf).select(F.col("name").alias("trial"), "r2")
    return M.halving_select(c, 2).select("trial", rnd("r2").alias("r2"))


@query("blend_stack", f"""
WITH {folds_cte('events', 'event_id', 'value')}, {oof_te_sql('user_id', 20.0, 'a')}, {oof_te_sql('event_type', 20.0, 'b')}
SELECT a_t.event_id, round(a_t.a, 6) AS te_user, round(b_t.b, 6) AS te_type
FROM a_t JOIN b_t USING (event_id)
""")
def q_blend_stack(spark, sf):
    from sparkreg.operators.blend import stack_members
    a = _oof_events(spark, sf, "user_id").select("event_id", F.lit("te_user").alias("model"), F.col("te").alias("pred"))
    b = _oof_events(spark, sf, "event_type").select("event_id", F.lit("te_type").alias("model"), F.col("te").alias("pred"))
    wide = stack_members(a.unionByName(b), "event_id", ["te_user", "te_type"])
    return wide.select("event_id", rnd("te_user").alias("te_user"), rnd("te_type").alias("te_type"))


# ---------------------------------------------------------------- T01
IMP_EXPR = {
    "qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax",
    "line": "CAST(l_linenumber AS DOUBLE)", "qty_sq": "l_quantity * l_quantity", "disc_tax": "l_discount * l_tax",
    "price_per": "l_extendedprice / l_quantity", "net": "l_extendedprice * (1 - l_discount)",
    "gross": "l_extendedprice * (1 + l_tax)", "qty_disc": "l_quantity * l_discount", "tax_sq": "l_tax * l_tax",
}
IMP_Y = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


@query("topk_importance", f"""
WITH c AS ({" UNION ALL ".join(f"SELECT '{k}' AS feature, abs(corr({v}, {IMP_Y})) AS importance FROM lineitem"
                            for k, v in IMP_EXPR.items())}),
p AS (SELECT feature, importance / sum(importance) OVER () * 100 AS raw FROM c)
SELECT feature, round(raw, 1) AS pct FROM p ORDER BY raw DESC, feature LIMIT 10
""")
def q_topk_importance(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select(*[F.expr(v).alias(k) for k, v in IMP_EXPR.items()], F.expr(IMP_Y).alias("y"))
    imp = P.corr_profile(df, list(IMP_EXPR), "y").select(F.col("column").alias("feature"),
                                                         F.col("abs_corr").alias("importance"))
    return M.top_importance(imp)
