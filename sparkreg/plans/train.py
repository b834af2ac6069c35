"""Training plan (M12, M18, M20, M21, M22, A22): table in, model out.

Every step is a DataFrame job whose result is spec-sized:

  resolve target -> drop null targets -> coerce / encode categoricals ->
  select, constant and duplicate pruning -> stratified folds (bounded
  windows) -> y fences and transform (fold-0 train) -> x clip -> leak-safe
  target encodings per fold -> candidate families (ridge from Grams,
  histogram trees, inducing-point GP, MLP) scored out of fold -> blend ->
  choice -> post-process -> report + bundle.

The prepared table is written once to the shared checkpoint folder, so
every later pass reads it instead of recomputing the lineage, and a lost
executor only re-reads its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from threading import Lock

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.functions import scalar as S
from sparkreg.operators import encode as E
from sparkreg.operators import folds as W
from sparkreg.operators import metrics as M
from sparkreg.operators import profile as P
from sparkreg.operators import transform as TR
from sparkreg.operators.blend import blend_weights, eligible_members
from sparkreg.operators.gp import RESTARTS_THOROUGH, fit_gp
from sparkreg.operators.linear import ALPHAS_POLY, ALPHAS_STD, poly_columns, ridge_cv
from sparkreg.operators.histogram import pooled_r2
from sparkreg.operators.mlp import MLP_MIN_ROWS, NetWant, fit_networks
from sparkreg.operators.search import GBT_CHOICES
from sparkreg.operators.trees import (BOOST_QUICK, BOOST_THOROUGH, KINDS, PROBE, PROBE_ITER, PROBE_ITER_RANK,
                                     SCREEN_MIN_FEATURES, TreeTable, Want, split_counts, used_columns)
from sparkreg.plans.score import add_prediction
from sparkreg.session import cut_lineage, remove

# Fixed values of the reference's training rules.
OUTLIER_IQR_MULT = 3.0         # thorough
OUTLIER_IQR_QUICK = 4.5        # quick
POLY_MAX_ROWS = 200
POLY_MAX_FEATS = 8
GP_MIN_ROWS = 10
FAMILY_THREADS = 4             # concurrent family fits (the reference runs 4 threads in quick mode)
GBT_FINAL_FACTOR = 1.15        # the final booster: rounds the folds used, times this,
GBT_FINAL_MIN = 50             # and at least so many
QUICK_FAMILIES = ("linear", "gbt", "gp", "mlp")
THOROUGH_FAMILIES = ("linear", "poly", "gbt", "gp", "mlp", "rf", "xt")


@dataclass
class TrainResult:
    report: DataFrame
    leaderboard: DataFrame
    importance: DataFrame
    oof: DataFrame
    bundle: dict
    models: dict = field(default_factory=dict)
    warnings: DataFrame | None = None


def _cols_by_set(base: list[str], te_cols: list[str], sets) -> dict:
    out = {}
    for s in sets:
        suffix = "__all" if s == "all" else f"__f{s}"
        out[s] = list(base) + [f"{c}{suffix}" for c in te_cols]
    return out


def _invert(col, transform: str, lam: float | None):
    if transform == "log1p":
        return S.expm1_inv(col)
    if transform == "yeo_johnson":
        return S.yeo_johnson_inverse(col, lam)
    return col


def _forward(col, transform: str, lam: float | None):
    if transform == "log1p":
        return S.log1p_fwd(col)
    if transform == "yeo_johnson":
        return S.yeo_johnson(col, lam)
    return col


def attach_row_id(df: DataFrame, key: str = "row_id", written: list | None = None) -> DataFrame:
    """Row identity for tables without a unique key: a generated id, made
    stable by writing the table (re-evaluation could renumber rows)."""
    return cut_lineage(df.withColumn(key, F.monotonically_increasing_id()), written)


def select_transform_cv(df: DataFrame, y: str, feats: list[str], y_min_all: float, folds, probe_rounds: int = PROBE_ITER,
                        key: str | None = None, written: list | None = None) -> tuple:
    """M12 (thorough): none / log1p (only when every y >= 0) / Yeo-Johnson
    (lambda from fold-0 training rows), scored by a boosted model on two
    folds, R2 measured on the original scale.  All probes are trained
    together."""
    cands = ["none"] + (["log1p"] if y_min_all is not None and y_min_all >= 0 else []) + ["yeo_johnson"]
    lam = TR.fit_yj_lambda(df.filter(F.col("fold") != folds[0]), y)
    meds = medians_by_set(df, {f: feats for f in folds}, "fold")
    params = replace(PROBE, rounds=probe_rounds)
    got = TreeTable(df, feats, y, "fold", key, written=written).fit(
        {(t, f): Want(feats, params, meds[f], f, t, lam if t == "yeo_johnson" else None) for t in cands for f in folds})
    scores = {t: pooled_r2([got[t, f].held for f in folds]) for t in cands}
    best = max((t for t in cands if np.isfinite(scores[t])), key=lambda t: (scores[t], -cands.index(t)), default="none")
    return best, (lam if best == "yeo_johnson" else None), scores


def recipes_and_screening(prepared: DataFrame, st: dict, sets, cols_by_set: dict, medians,
                          probe_rounds: int = PROBE_ITER) -> tuple[DataFrame, dict, dict]:
    """M17 + P11 per training set (thorough): each set proposes derived
    features from its own rows, keeps those a boosted probe splits on, then
    screens when more than 10 features remain.  Derived values are row-local,
    so the union of all sets' recipes is added once as a projection.  The
    probes of all sets are trained together.  Returns the table, the columns
    and the medians of every set."""
    from sparkreg.operators.search import apply_recipe, fit_recipes
    base, y, how = list(st["numeric"]), st["target"], {"transform": st["transform"], "lam": st["lambda"]}
    recipes = fit_recipes(prepared, base, y, "fold", sets, st["key"], rounds=probe_rounds,
                          rank_rounds=min(probe_rounds, PROBE_ITER_RANK), medians=medians(), written=st["written"], **how)
    union = {}
    for rs in recipes.values():
        for r in rs:
            union.setdefault(r["name"], r)
    if union:
        prepared = apply_recipe(prepared, list(union.values()))
    out = {s: list(cols_by_set[s]) + [r["name"] for r in recipes[s]] for s in sets}
    meds = medians_by_set(prepared, out, "fold")
    long = [s for s in sets if len(out[s]) > SCREEN_MIN_FEATURES]
    if long:
        table = TreeTable(prepared, sorted({c for s in long for c in out[s]}), y, "fold", st["key"], written=st["written"])
        got = table.fit({s: Want(out[s], replace(PROBE, rounds=probe_rounds), meds[s],
                                 None if s == "all" else s, **how) for s in long})
        out |= {s: used_columns(out[s], split_counts(got[s])) for s in long}
    st["recipes"] = {str(k): v for k, v in recipes.items()}
    return prepared, out, meds


def check_key(df: DataFrame, key: str) -> None:
    """Refuse a key that is NULL somewhere or names several rows; folds and
    permutations are functions of it."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"key_not_unique: {S.shown_name(key)}")


def prepare(df: DataFrame, target: str | None, key: str | None, strategy: str = "quick",
            probe_rounds: int = PROBE_ITER, transform: str | None = None) -> tuple[DataFrame, dict]:
    """Cleaning, encoding plan, folds, fences, transform and clip.  Returns
    the prepared frame (written as Parquet) and the spec-sized preparation
    state."""
    import time
    laps: dict = {}
    t_last = [time.time()]

    def lap(name):
        now = time.time()
        laps[name] = now - t_last[0]
        t_last[0] = now

    written: list = []
    df = df.toDF(*[S.safe_name(c) for c in df.columns])
    target = S.safe_name(target) if target is not None else None
    if key is None:
        key = "row_id"
        df = attach_row_id(df, key, written)
    else:
        key = S.safe_name(key)
        check_key(df, key)
    rep = P.target_report(df, target).first()
    if rep["status"] not in ("ok",):
        raise ValueError(rep["status"])
    y = rep["target"]
    st: dict = {"target": y, "key": key, "strategy": strategy, "n_target_na": int(rep["n_null"]),
                "written": written}
    df = df.withColumn(y, F.col(y).cast("string").try_cast("double") if dict(df.dtypes)[y] == "string"
                       else F.col(y).cast("double"))
    df = P.drop_null_target(df, y)
    dbl = [c for c, t in df.dtypes if t in ("double", "float") and c != key]
    df = df.select(*[S.finite_or_null(c).alias(c) if c in dbl else F.col(c) for c in df.columns])
    df = P.drop_null_target(df, y)
    st["n_dup_rows"] = int(P.count_duplicate_rows(df.drop(key)).first()[0])
    lap("target_dups")

    # ONE pass profiles every column: string columns both as categories and
    # as coerced numbers, numeric columns for missing / distinct / std.
    st["dropped_dates"] = [c for c, t in df.dtypes if t in ("timestamp", "date", "timestamp_ntz") and c != key]
    df = df.drop(*st["dropped_dates"])
    cats = P.category_columns(df, exclude=[y, key])
    bools = [c for c, t in df.dtypes if t == "boolean" and c in cats]
    if bools:
        df = df.select(*[S.bool_label(c).alias(c) if c in bools else F.col(c) for c in df.columns])
    strs = [c for c in cats if c not in bools]
    nums0 = P.numeric_columns(df, exclude=[y, key])

    def num_stats(c, e):
        # constant = at most one distinct non-null value, i.e. min == max (exact, no distinct shuffle)
        return [F.avg(e.isNull().cast("double")).alias(f"miss_{c}"),
                F.coalesce((F.min(e) == F.max(e)) | F.max(e).isNull(), F.lit(True)).alias(f"one_{c}"),
                F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias(f"sd_{c}")]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in strs:
        e = S.coerce_numeric(F.col(c))
        aggs += [F.avg(e.isNotNull().cast("double")).alias(f"parse_{c}")] + num_stats(c, e)
    for c in nums0:
        aggs += num_stats(c, F.col(c).cast("double"))
    lap("pre_profile")
    one = df.agg(*aggs).first()
    lap("profile_pass")
    n_all = one["__n"]
    to_num = [c for c in strs if one[f"parse_{c}"] >= P.NUMERIC_COERCE_MIN]
    if to_num:
        df = P.apply_numeric_like(df, to_num)
    cats = [c for c in cats if c not in to_num]
    st["onehot"], st["target_cols"], st["dropped_cats"] = {}, [], []
    limit = max(1, int(n_all * P.DROP_CARD_FRAC))
    kcount = P.distinct_counts(df, {c: S.null_to_sentinel(F.col(f"`{c}`")) for c in cats})
    oh_cols = []
    for c in cats:
        k = kcount[c]
        if k > limit:
            st["dropped_cats"].append(c)
        elif k <= P.ONEHOT_MAX_CARD:
            oh_cols.append(c)
        else:
            st["target_cols"].append(c)
    if oh_cols:   # class lists of every one-hot column from one grouped job
        for r in P.category_profile(df, oh_cols).collect():
            st["onehot"].setdefault(r["column"], []).append(r["class"])
        st["onehot"] = {c: sorted(st["onehot"][c]) for c in oh_cols}
    for c, classes in st["onehot"].items():
        df = df.select("*", *E.onehot_columns(c, classes)).drop(c)
    df = df.drop(*st["dropped_cats"])
    lap("classes")

    num = [c for c in df.columns if c in set(nums0) | set(to_num)
           and one[f"miss_{c}"] < P.MAX_MISS_RATE
           and not (one[f"one_{c}"] or one[f"sd_{c}"] < P.CONST_STD_EPS)]
    num += [E.onehot_name(c, k) for c, ks in st["onehot"].items() for k in ks if len(ks) > 1]
    if len(num) > 1:
        # the fill medians only place the NULL rows before |corr| > 0.999 is tested
        kept = {r["column"] for r in P.duplicate_profile(df, num).collect() if r["kept"]}
        num = [c for c in num if c in kept]
    oh_all = {E.onehot_name(c, k) for c, ks in st["onehot"].items() for k in ks}
    st["numeric"] = [c for c in num if c not in oh_all]
    lap("columns")

    df = cut_lineage(df, written)                          # cleaned table, read by every later pass
    n = df.count()
    st["n_rows"] = n
    oof = strategy == "thorough" or n < 50
    st["eval_on"] = "train" if n < 10 else ("oof" if oof else "val")
    if n < 10:
        df = df.withColumn("fold", F.lit(-1))
        st["folds"] = []
    else:
        folded, k = W.stratified_folds_k(df, key, y, oof=oof)
        df = cut_lineage(folded, written)
        st["folds"] = list(range(k)) if oof else [0]
    tr0 = df.filter(F.col("fold") != 0) if st["folds"] else df
    lap("folds")

    # y fences, transform rule and x clip from fold-0 training rows: one pass
    mult = OUTLIER_IQR_MULT if strategy == "thorough" else OUTLIER_IQR_QUICK
    n_tr = tr0.agg(F.count(F.col(y))).first()[0]
    got = P.quantiles(tr0, {("y",): (F.col(y), [0.25, 0.75])} | {c: (F.col(c), [0.01, 0.99]) for c in num})
    q1, q3 = got.pop(("y",))
    lo = hi = None
    if n_tr >= P.MIN_ROWS_FOR_FENCE:
        lo, hi = q1 - mult * (q3 - q1), q3 + mult * (q3 - q1)
    st["fence"] = (lo, hi, mult)
    st["clip"] = {c: (a, b) for c, (a, b) in got.items() if a is not None and a < b}
    df = df.withColumn("__y_raw", F.col(y))
    df = TR.winsorize(df, y, lo, hi, flag="__clipped")
    tr_w = df.filter(F.col("fold") != 0) if st["folds"] else df
    y_min_all = df.agg(F.min(y)).first()[0]
    df = df.select(*[S.clip(c, *st["clip"][c]).alias(c) if c in st["clip"] else F.col(c) for c in df.columns])
    rule = TR.quick_transform_rule(tr_w, y, y_min_all).first()
    st["transform"], st["lambda"] = rule["transform"], None
    if transform is not None:
        st["transform"] = transform
        st["lambda"] = TR.fit_yj_lambda(tr_w, y) if transform == "yeo_johnson" else None
    elif strategy == "thorough" and len(st["folds"]) >= 2 and num:
        st["transform"], st["lambda"], st["transform_scores"] = select_transform_cv(
            df, y, num, y_min_all, st["folds"][:2], probe_rounds, key, written)
    elif st["transform"] == "yeo_johnson":
        st["lambda"] = TR.fit_yj_lambda(tr_w, y)
    df = df.withColumn("__y_t", _forward(F.col(y), st["transform"], st["lambda"]))

    lap("fences_transform_clip")
    # leak-safe target encodings (deployed + one per evaluated fold)
    st["te_frames"] = {}
    for c in st["target_cols"]:
        ncls = E.category_count(df, c)
        m, g = E.target_encoder_fit(df, c, "__y_t")          # deployed encoder (lazy table)
        st["te_frames"][c] = (m, g, ncls)
        df = E.fold_target_encodings(df, c, "__y_t", "fold", st["folds"], n_classes=ncls)
    df = df.drop(*st["target_cols"])
    st["onehot_cols"] = [c for c in num if c in oh_all]
    st["base_feats"] = list(num)
    st["n_outliers"] = int(df.agg(F.count_if("__clipped")).first()[0])
    lap("encoders")
    prepared = cut_lineage(df, written)
    lap("write")
    st["prepare_laps"] = laps
    return prepared, st


def medians_by_set(df: DataFrame, cols_by_set: dict, fold: str) -> dict:
    """Training medians of every set's columns, all sets at once."""
    want = {}
    for s, cols in cols_by_set.items():
        for c in cols:
            v = F.col(f"`{c}`").cast("double")
            want[s, c] = (v if s == "all" else F.when(F.col(fold) != s, v), [0.5])
    got = P.quantiles(df, want)
    return {s: {c: got[s, c][0] if got[s, c][0] is not None else 0.0 for c in cols} for s, cols in cols_by_set.items()}


def _training_rows(df: DataFrame, s) -> DataFrame:
    return df if s == "all" else df.filter(F.col("fold") != s)


def _each(fn, items, threads: int = FAMILY_THREADS) -> dict:
    """{item: fn(item)}; independent Spark jobs, submitted from a bounded pool
    so that the scheduler can overlap them."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(items)))) as pool:
        return dict(zip(items, pool.map(fn, items)))


def fit_poly(df: DataFrame, feats: list[str], y: str, key: str, max_feats: int = POLY_MAX_FEATS, alphas=ALPHAS_POLY) -> dict:
    """M02 on one training set: its own medians, robust scales and most
    correlated columns, then ridge on their squares and products."""
    med = P.fit_medians(df, feats)
    rob = {r["column"]: r for r in TR.robust_fit(df, feats).collect()}
    top = [r["column"] for r in P.top_by_corr(df, feats, y, max_feats).collect()]
    center, scl = {c: rob[c]["center"] or 0.0 for c in top}, {c: rob[c]["scale"] or 1.0 for c in top}
    src = df.select(key, y, *[F.coalesce(F.col(c).cast("double"), F.lit(med[c])).alias(c) for c in top])
    src = src.select(key, y, *poly_columns(top, center, scl))
    res = ridge_cv(src, [c for c in src.columns if c not in (key, y)], y, key, None, alphas, robust=False)
    return {"type": "poly", "top": top, "center": center, "scale": scl, "medians": {c: med[c] for c in top},
            "feats": res.final.feats, "coef": res.final.coef, "intercept": res.final.intercept,
            "alpha": res.final.alpha}


def fit_family(kind: str, df: DataFrame, st: dict, sets, cols_by_set: dict, key: str, medians, table,
               boost, trees: int | None, settings: dict) -> dict:
    """{training set: fitted model} of one family; every set (the complement of
    an evaluated fold, or all rows) is fitted on its own rows only, and all
    sets share their jobs."""
    y, folds = "__y_t", st["folds"]
    if kind == "linear":
        res = ridge_cv(df, cols_by_set["all"], y, key, "fold" if folds else None, ALPHAS_STD, folds=folds,
                       cols_by_set=cols_by_set)
        return {**res.per_fold, "all": res.final}
    if kind == "poly":
        return _each(lambda s: fit_poly(_training_rows(df, s), st["base_feats"], y, key), sets)
    if kind == "gp":
        return fit_gp(df, cols_by_set["all"], y, key, medians(), "fold" if folds else None, folds, cols_by_set,
                      RESTARTS_THOROUGH if st["strategy"] == "thorough" else 1)
    if kind == "mlp":
        return fit_networks(df, y, {s: NetWant(cols_by_set[s], medians()[s], None if s == "all" else s,
                                               **settings.get("mlp", {})) for s in sets}, "fold" if folds else None)

    def want(s, params):
        return Want(cols_by_set[s], params, medians()[s], None if s == "all" else s, st["transform"], st["lambda"], kind=kind)

    if kind != "gbt":
        params = replace(KINDS[kind], rounds=trees or KINDS[kind].rounds)
        return table().fit({s: want(s, params) for s in sets})
    params = replace(boost, **settings.get("gbt", {}))

    def longer(rounds):               # all rows: a little longer than the folds needed before they stopped
        return max(GBT_FINAL_MIN, int(GBT_FINAL_FACTOR * rounds))

    wants = {s: want(s, params) for s in sets if s != "all"}
    if len(wants) == 1 and table().local:
        # the only other fit: grown beside it for as long as it may need, cut when that is known
        got = table().fit(wants | {"all": want("all", replace(params, rounds=longer(params.rounds), patience=0))})
        return got | {"all": got["all"].first(longer(got[next(iter(wants))].n_trees))}
    got = table().fit(wants)
    last = longer(sum(m.n_trees for m in got.values()) / len(got)) if got else params.rounds
    return got | table().fit({"all": want("all", replace(params, rounds=last, patience=0))})


def search_settings(df: DataFrame, st: dict, cols_by_set: dict, medians, table, boost, size: int | None, kinds) -> dict:
    """The best settings of a halving search per family."""
    from sparkreg.operators.search import (MLP_CANDIDATES, MLP_FINALISTS, best_trial, gbt_candidates, halving_search,
                                           mlp_candidates, search_trees)
    folds, how, out = st["folds"], (st["transform"], st["lambda"]), {}
    if "gbt" in kinds:
        cands = gbt_candidates(st["n_rows"], size=size)
        out["gbt"] = cands[best_trial(search_trees(table(), cands, folds, cols_by_set, medians(), boost, *how))]
    if "mlp" in kinds:
        cands = mlp_candidates(size=size or MLP_CANDIDATES)

        def run(pairs):
            got = fit_networks(df, "__y_t", {(i, f): NetWant(cols_by_set[f], medians()[f], f, **cands[i]) for i, f in pairs},
                               "fold", transform=how[0], lam=how[1], held=True) if pairs else {}
            return {k: held for k, (_, held) in got.items()}

        out["mlp"] = cands[best_trial(halving_search(df.sparkSession, cands, folds, run, MLP_FINALISTS))]
    return out


def train(df: DataFrame, target: str | None = None, key: str | None = None, strategy: str = "quick",
          families=None, derive: bool | None = None, rounds: int | None = None, trees: int | None = None,
          search: int | None = None, probe_rounds: int = PROBE_ITER, transform: str | None = None,
          ready: tuple[DataFrame, dict] | None = None) -> TrainResult:
    """quick = one validation fold (OOF below 50 rows); thorough = full
    OOF with more families and a non-negative blend.  Without ``key`` a
    stable row id is attached; a key that is not unique is refused.

    ``rounds`` bounds the boosting rounds (500 quick, 3,000 thorough; a
    holdout stops them) and ``trees`` sizes the forests (300).  A thorough run
    chooses the settings of the boosted trees and the network among
    ``search`` candidates each (24 and 8 when None, none when 0).
    ``probe_rounds`` bounds the boosted probes of a thorough run (screening,
    derived features, target transform).  ``transform`` (none, log1p,
    yeo_johnson) fixes that of the target instead of choosing it.  ``ready`` is
    what ``prepare`` gave for the same table and settings, shared by several
    runs."""
    spark = df.sparkSession
    from sparkreg.session import tune_session
    tune_session(spark)
    import time
    t0 = time.time()
    timings: dict = {}
    prepared, st = ready or prepare(df, target, key, strategy, probe_rounds, transform)
    st = dict(st)                     # a run adds to it
    timings["prepare"] = time.time() - t0
    key = st["key"]
    y = st["target"]
    folds = st["folds"]
    sets = list(folds) + ["all"]
    cols_by_set = _cols_by_set(st["base_feats"], st["target_cols"], sets)
    if derive is None:
        derive = strategy == "thorough"
    shared: dict = {}
    guard = Lock()

    def medians():                    # one pass for all families that fill by median
        with guard:
            if "medians" not in shared:
                shared["medians"] = medians_by_set(prepared, cols_by_set, "fold")
        return shared["medians"]

    if derive and st["n_rows"] >= 50 and folds:
        t1 = time.time()
        prepared, cols_by_set, shared["medians"] = recipes_and_screening(prepared, st, sets, cols_by_set, medians,
                                                                         probe_rounds)
        timings["recipes_screening"] = time.time() - t1
    families = families or (THOROUGH_FAMILIES if strategy == "thorough" else QUICK_FAMILIES)
    n = st["n_rows"]
    runnable = []
    for kind in families:
        if kind == "gp" and n < GP_MIN_ROWS:
            continue
        if kind == "mlp" and n < MLP_MIN_ROWS:
            continue
        if kind == "poly" and (n > POLY_MAX_ROWS or len(cols_by_set["all"]) > POLY_MAX_FEATS) and strategy != "thorough":
            continue
        if cols_by_set["all"]:
            runnable.append(kind)

    boost = BOOST_THOROUGH if strategy == "thorough" else BOOST_QUICK
    boost = replace(boost, rounds=rounds or boost.rounds)
    searched = strategy == "thorough" and len(folds) > 1 and search != 0
    table_guard = Lock()

    def table():                      # the binned table of all tree models and candidates
        with table_guard:
            if "table" not in shared:
                bins = max(GBT_CHOICES["bins"]) if searched else boost.bins
                shared["table"] = TreeTable(prepared, sorted({c for cs in cols_by_set.values() for c in cs}), y, "fold", key,
                                            bins, st["written"])
        return shared["table"]

    settings = {}
    if searched:
        t1 = time.time()
        settings = search_settings(prepared, st, cols_by_set, medians, table, boost, search, runnable)
        timings["search"] = time.time() - t1
    models = _each(lambda k: fit_family(k, prepared, st, sets, cols_by_set, key, medians, table, boost, trees,
                                        settings),
                   runnable)
    finals = {k: m["all"] for k, m in models.items()}
    timings["fit_all_families"] = time.time() - t0 - sum(timings.values())

    # A fold's rows get the prediction of every family's model for
    # that fold as columns, so the members are aligned without a shuffle
    t1 = time.time()

    def with_members(rows: DataFrame, s) -> DataFrame:
        for k in runnable:
            rows = add_prediction(rows, models[k][s], "__p")
            rows = rows.withColumn(k, _invert(F.col("__p"), st["transform"], st["lambda"])).drop("__p")
        return rows.select(key, F.col(y).alias("y_w"), F.col("__y_raw").alias("y_raw"), "fold", *runnable)

    parts = [with_members(prepared.filter(F.col("fold") == f), f) for f in folds] or [with_members(prepared, "all")]
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    oof = cut_lineage(oof)
    fitted = with_members(prepared, "all")                # the final models on their own rows
    timings["oof_assemble"] = time.time() - t1
    t1 = time.time()

    def r2_row(frame: DataFrame, names) -> dict:
        one = frame.agg(*[a for k in names for a in M.r2_aggs("y_w", k, f"{k}_")]).first()
        out = {}
        for k in names:
            sse, sst = one[f"{k}_sse"], one[f"{k}_sst"]
            if sse is None or not np.isfinite(sse):
                out[k] = float("nan")
            else:
                out[k] = (1 - sse / sst) if sst and sst > 0 else (1.0 if sse == 0 else 0.0)
        return out

    r2 = r2_row(oof, runnable) if runnable else {}
    std: dict = {}
    if st["eval_on"] == "oof" and runnable:
        for r in oof.groupBy("fold").agg(*[a for k in runnable for a in M.r2_aggs("y_w", k, f"{k}_")]).collect():
            for k in runnable:
                std.setdefault(k, [])
                if r[f"{k}_n"] >= 2 and r[f"{k}_sst"]:
                    std[k].append(1 - r[f"{k}_sse"] / r[f"{k}_sst"])
    r2_std = {k: (float(np.std(v)) if len(v) >= 2 else 0.0) for k, v in std.items()}

    # blend (thorough, OOF only)
    members = eligible_members(r2) if (strategy == "thorough" and st["eval_on"] == "oof") else []
    weights = {}
    if members:
        weights = blend_weights(oof.dropna(subset=members), members, "y_w", r2)
        expr = sum((F.col(m) * F.lit(w) for m, w in weights.items()), F.lit(0.0))
        oof, fitted = oof.withColumn("blend", expr), fitted.withColumn("blend", expr)
        r2["blend"] = r2_row(oof, ["blend"])["blend"]
    train_r2 = r2_row(fitted, list(r2)) if r2 else {}
    cand_df = spark.createDataFrame(
        [(k, float(v), float(r2_std.get(k, 0.0)), float(train_r2[k])) for k, v in r2.items()],
        "name string, r2 double, r2_std double, train_r2 double")
    choice = M.pick_best(cand_df).first()
    best = choice["chosen"]

    # post-process (A14, A15, F14) of every candidate, report metrics on raw y
    yr = prepared.agg(F.min("__y_raw").alias("a"), F.max("__y_raw").alias("b"),
                      P.is_integer_expr("__y_raw").alias("isint")).first()
    span = yr["b"] - yr["a"]
    margin = span * P.Y_CLIP_MARGIN_FRAC if span > 0 else max(abs(yr["b"]), 1.0)
    posts = {}
    for k in r2:
        smear = 1.0
        if st["transform"] == "log1p":
            smear = P.smear_profile(oof.dropna(subset=[k]), "y_w", k).first()["smear"]
        posts[k] = {"smear": float(smear), "lo": yr["a"] - margin, "hi": yr["b"] + margin, "round": bool(yr["isint"])}
    post = posts[best]
    final_pred = S.postprocess(best, post["smear"], post["lo"], post["hi"], post["round"])
    ev = oof.withColumn("final", final_pred)
    mt = ev.agg(*M.r2_aggs("y_raw", "final"), F.sqrt(F.avg((F.col("y_raw") - F.col("final")) ** 2)).alias("rmse"),
                F.avg(F.abs(F.col("y_raw") - F.col("final"))).alias("mae"), F.count(F.lit(1)).alias("rows")).first()
    r2_raw = (1 - mt["sse"] / mt["sst"]) if mt["sst"] else 0.0

    timings["evaluate"] = time.time() - t1
    lb = M.leaderboard(cand_df)
    imp = _importance(spark, best, finals, weights, prepared, key)
    st["n_val"] = int(mt["rows"]) if st["eval_on"] == "val" else 0
    warn = M.quality_warnings(spark, n, st["eval_on"], st["n_val"], st["n_target_na"], st["n_outliers"],
                              st["fence"][2], st["n_dup_rows"], [S.shown_name(c) for c in st["dropped_cats"]],
                              [S.shown_name(c) for c in st["dropped_dates"]])
    report = spark.createDataFrame([(
        S.shown_name(y), n, st["eval_on"], best,
        float(choice["chosen_r2"]) if choice["chosen_r2"] is not None else None,
        float(r2_raw), float(mt["rmse"]) if mt["rmse"] is not None else None,
        float(mt["mae"]) if mt["mae"] is not None else None, st["transform"], len(cols_by_set["all"]),
        st["n_outliers"], st["n_dup_rows"])],
        "target string, n_rows bigint, eval_on string, best_model string, r2 double, r2_raw double, "
        "rmse double, mae double, y_transform string, n_features int, n_outliers bigint, n_duplicate_rows bigint")
    report = report.withColumn("r2_bucket", S.r2_bucket("r2_raw"))
    timings["total"] = time.time() - t0
    st["timings"] = timings
    bundle = {"prep": st, "best": best, "post": post, "posts": posts, "weights": weights,
              "feats": cols_by_set["all"], "settings": settings}
    oof = oof.withColumnRenamed(key, S.shown_name(key))
    return TrainResult(report, lb, imp, oof, bundle, finals, warnings=warn)


def _importance(spark, best: str, finals: dict, weights: dict, prepared: DataFrame, key: str) -> DataFrame:
    """M13 - M16 importances of the chosen model (A20 for a blend): split
    counts, coefficients, length scales, or for a network the drop of R2 when
    a column is permuted."""
    def shares(values: dict) -> dict:
        total = sum(values.values())
        return {S.shown_name(c.removesuffix("__all")): v / total if total else 1.0 / len(values)
                for c, v in values.items()}

    def one(kind):
        m = finals[kind]
        if kind in ("linear", "poly"):
            feats, coef = (m["feats"], m["coef"]) if kind == "poly" else (m.feats, m.scaled())
            return shares({c: abs(v) for c, v in zip(feats, coef)})
        if kind in ("gbt", "rf", "xt"):
            return shares(split_counts(m))
        if kind == "gp":
            return shares(m.importance())
        from sparkreg.operators.search import permutation_importance
        rows = prepared.select(key, F.col("__y_t").alias("__y"), *m.feats)
        drop = permutation_importance(rows, key, "__y", m.feats, lambda d: m.predict_column(d, "pred"))
        return shares({r["feature"]: r["importance"] for r in drop.collect()})
    acc: dict = {}
    for m, w in (weights if best == "blend" else {best: 1.0}).items():
        for f, v in one(m).items() if w else ():
            acc[f] = acc.get(f, 0.0) + w * v
    rows = [(f, float(v)) for f, v in acc.items()]
    imp = spark.createDataFrame(rows, "feature string, importance double")
    return M.top_importance(imp)


def deploy(result: TrainResult, root: str, save_as=None) -> tuple[str, str, list[str]]:
    """(chosen, deployed, failures).  The chosen model is saved first;
    if that fails, the other candidates follow by R2, each with its own
    post-processing.  The result is left as it was."""
    chosen = result.bundle["best"]
    others = [r["name"] for r in result.leaderboard.orderBy(F.desc_nulls_last("r2"), "name").collect()]
    failures = []
    for name in [chosen, *[k for k in others if k != chosen]]:
        try:
            (save_as or save)(result, root, name)
        except Exception as e:  # noqa: BLE001 -- a model that cannot be saved is skipped
            failures.append(f"{name}: {type(e).__name__}")
            continue
        return chosen, name, failures
    raise RuntimeError(f"no model could be saved: {failures}")


def clean(result: TrainResult) -> None:
    """Delete the tables of the training run; the report, the out-of-fold
    predictions and saved bundles stay."""
    remove(result.report.sparkSession, result.bundle["prep"]["written"])


def save(result: TrainResult, root: str, best: str | None = None) -> str:
    """S05 for a training result: the chosen model (or the blend members), or
    the candidate ``best``."""
    from sparkreg.sources.model_io import save_bundle
    b = result.bundle
    st = b["prep"]
    best = best or b["best"]
    members = {m: result.models[m] for m in (b["weights"] if best == "blend" else [best])}
    prep = {k: st[k] for k in ("target", "key", "strategy", "onehot", "target_cols", "dropped_cats", "numeric",
                               "clip", "transform", "lambda", "base_feats", "n_rows", "eval_on")}
    prep["recipe"] = st.get("recipes", {}).get("all", [])
    meta = {"best": best, "post": b["posts"][best], "weights": b["weights"], "feats": b["feats"], "prep": prep}
    enc = {c: (frame, g, n) for c, (frame, g, n) in st["te_frames"].items()}
    spark = result.report.sparkSession
    return save_bundle(spark, root, meta, members, enc)
