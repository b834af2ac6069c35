"""Candidate search with halving (M10, M11, T06) and feature recipes
(M16, M17).

Candidates are seeded, so a search is reproducible.  All fits of a stage
share their jobs: every candidate on the first two folds, then the best few
(T06) on the other folds too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.scalar import derived
from sparkreg.operators import metrics as M
from sparkreg.operators.folds import permute_column
from sparkreg.operators.profile import CONST_STD_EPS
from sparkreg.operators.histogram import Params, pooled_r2
from sparkreg.operators.trees import BOOST_THOROUGH, PROBE_ITER, PROBE_ITER_RANK, TreeTable, Want

GBT_FINALISTS = 3
MLP_FINALISTS = 2
GBT_CANDIDATES = 24
MLP_CANDIDATES = 8
PRELIM_FOLDS = 2
RECIPE_MAX_BASE = 12
RECIPE_MAX_KEEP = 15
RECIPE_MIN_ROWS = 50


#: The settings a search may try.  A tuple under CHOICES is a
#: list of choices, a pair under RANGES a closed interval, under POWERS one of
#: exponents of ten.
GBT_CHOICES = {"leaves": (7, 15, 31, 63, 127), "rate": (0.01, 0.02, 0.03, 0.05, 0.1), "min_leaf": (5, 10, 20, 40),
               "bins": (63, 127, 255, 511), "random_cuts": (False, True)}
GBT_RANGES = {"rows": (0.6, 1.0), "cols": (0.5, 1.0)}
GBT_POWERS = {"l1": (-3.0, 0.5), "l2": (-2.0, 1.5)}
MLP_WIDTHS = (0.5, 1.0, 2.0)
MLP_LAYERS = ({"single": True, "extra": False}, {"single": False, "extra": False}, {"single": False, "extra": True})
MLP_LOG10_L2 = (-6.0, -1.0)
MLP_FIXED = ({"alpha_l2": 1e-4}, {"alpha_l2": 1e-2, "single": True}, {"alpha_l2": 1e-5, "extra": True})


def _unit(*what) -> float:
    """A number in [0, 1) that depends on its arguments only."""
    return int(hashlib.md5("|".join(map(str, what)).encode()).hexdigest()[:12], 16) / 16.0 ** 12


def _choice(options, *what):
    return options[int(_unit(*what) * len(options))]


def _between(bounds, *what) -> float:
    return bounds[0] + (bounds[1] - bounds[0]) * _unit(*what)


def gbt_candidates(n_rows: int, seed: int = 42, size: int | None = None) -> list[dict]:
    """The default settings and ``size - 1`` drawn ones (24 in all by
    default, however many rows the table has).  Trial t draws each setting by
    itself from a hash, so more trials only append to the list."""
    size = GBT_CANDIDATES if size is None else size
    return [{}] + [{**{k: _choice(v, seed, t, k) for k, v in GBT_CHOICES.items()},
                    **{k: round(_between(v, seed, t, k), 2) for k, v in GBT_RANGES.items()},
                    **{k: round(10 ** _between(v, seed, t, k), 4) for k, v in GBT_POWERS.items()}} for t in range(1, size)]


def mlp_candidates(seed: int = 42, size: int = MLP_CANDIDATES) -> list[dict]:
    """Three fixed networks, the others drawn."""
    drawn = [{"alpha_l2": 10 ** _between(MLP_LOG10_L2, seed, t, "l2"), "width": _choice(MLP_WIDTHS, seed, t, "width"),
              **_choice(MLP_LAYERS, seed, t, "layers")} for t in range(len(MLP_FIXED), size)]
    return [dict(c) for c in MLP_FIXED[:size]] + drawn


def halving_search(spark, candidates: Sequence[dict], folds: Sequence[int], run: Callable, keep: int) -> DataFrame:
    """Trial table (trial, params, stage, r2): every candidate on the first
    two folds, the ``keep`` best (T06) on all folds.

    ``run`` is given all (trial, fold) pairs of a stage at once and returns
    what each of them did on its unseen fold: (rows, mean, squares about the
    mean, squared error).
    """
    prelim = list(folds)[:PRELIM_FOLDS]
    held = run([(i, f) for i in range(len(candidates)) for f in prelim])

    def r2(i: int, some) -> float:
        v = pooled_r2([held[i, f] for f in some])
        return v if math.isfinite(v) else None

    rows = [(i, str(c), "prelim", r2(i, prelim)) for i, c in enumerate(candidates)]
    schema = "trial int, params string, stage string, r2 double"
    finalists = [r["trial"] for r in M.halving_select(spark.createDataFrame(rows, schema), keep).collect()]
    held |= run([(i, f) for i in finalists for f in folds if f not in prelim])
    rows += [(i, str(candidates[i]), "final", r2(i, folds)) for i in finalists]
    return spark.createDataFrame(rows, schema)


def search_trees(table: TreeTable, candidates: Sequence[dict], folds: Sequence[int], feats: Mapping, medians: Mapping,
                 base: Params = BOOST_THOROUGH, transform: str = "none", lam: float | None = None) -> DataFrame:
    """The trial table of boosted candidates.  The fits of a stage, each
    with its own stop, are trained together."""
    def run(pairs):
        got = table.fit({(i, f): Want(list(feats[f]), replace(base, **candidates[i]), medians[f], f, transform, lam)
                         for i, f in pairs})
        return {k: s.held for k, s in got.items()}

    return halving_search(table.spark, candidates, folds, run, GBT_FINALISTS)


def best_trial(trials: DataFrame) -> int:
    """The finalist with the largest R2, the earliest of equals."""
    return trials.filter("stage = 'final'").orderBy(F.desc_nulls_last("r2"), "trial").first()["trial"]


# ---------------------------------------------------------------- M16
def permutation_importance(df: DataFrame, key: str, y: str, feats: Sequence[str],
                           predict: Callable[[DataFrame], DataFrame], repeats: int = 5, seed: int = 42) -> DataFrame:
    """Mean R2 drop over ``repeats`` seeded permutations per feature.
    A repeat permutes the rows once (two ranks and one join) and brings all
    permuted values next to the true ones; a feature is then tried by a
    projection that swaps its column alone.  Negative drops show as 0."""
    n = df.count()
    base = predict(df).agg(*M.r2_aggs(y, "pred")).first()
    r2_base = 1 - base["sse"] / base["sst"] if base["sst"] else 0.0
    feats = list(feats)
    q = [f"`{c}`" for c in feats]
    parts = []
    for r in range(repeats):
        packed = df.withColumn("__other", F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(q)]))
        moved = permute_column(packed, key, "__other", seed * 1000 + r, n_rows=n)
        tries = F.array(*[F.struct(F.lit(c).alias("f"), *[
            (F.col(f"__other.c{i}") if i == j else F.col(q[i])).alias(f"c{i}") for i in range(len(feats))])
            for j, c in enumerate(feats)])
        parts.append(moved.select(F.col(y), F.lit(r).alias("__repeat"), F.explode(tries).alias("__t")))
    tried = parts[0]
    for p in parts[1:]:
        tried = tried.unionByName(p)
    tried = tried.select(y, "__repeat", F.col("__t.f").alias("__feature"),
                         *[F.col(f"__t.c{i}").alias(c) for i, c in enumerate(feats)])
    g = predict(tried).groupBy("__feature", "__repeat").agg(*M.r2_aggs(y, "pred"))
    drops = g.select(F.col("__feature").alias("feature"),
                     (F.lit(r2_base) - M.r2_from(F.col("sse"), F.col("sst"))).alias("drop"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("mean_drop")) \
        .withColumn("importance", F.greatest(F.col("mean_drop"), F.lit(0.0)))


# ---------------------------------------------------------------- M17
def propose(base: Sequence[str], ends: Mapping[str, tuple]) -> list[dict]:
    """Products of pairs, squares, and sign (only for columns with both
    signs) of the base features, in proposal order."""
    base = list(base)
    out = [{"name": f"{a}*{b}", "op": "mul", "cols": [a, b]} for i, a in enumerate(base) for b in base[i + 1:]]
    out += [{"name": f"{a}^2", "op": "sq", "cols": [a]} for a in base]
    return out + [{"name": f"sign({a})", "op": "sign", "cols": [a]} for a in base
                  if ends[a][0] is not None and ends[a][0] < 0 < ends[a][1]]


def propose_recipe(df: DataFrame, feats: Sequence[str], max_base: int = RECIPE_MAX_BASE) -> list[dict]:
    """``propose`` for the first ``max_base`` features (the caller orders them
    by importance)."""
    base = list(feats)[:max_base]
    mm = df.agg(*[F.min(f"`{c}`").alias(f"a{i}") for i, c in enumerate(base)],
                *[F.max(f"`{c}`").alias(f"b{i}") for i, c in enumerate(base)]).first()
    return propose(base, {c: (mm[f"a{i}"], mm[f"b{i}"]) for i, c in enumerate(base)})


def rank_base(feats: Sequence[str], counts: Mapping[str, float] | None) -> list[str]:
    """Features by the importance of a probe, in their order where equal."""
    feats = list(feats)
    return feats if counts is None else sorted(feats, key=lambda c: (-counts.get(c, 0.0), feats.index(c)))


def keep_recipe(props: Sequence[dict], counts: Mapping[str, float], max_keep: int = RECIPE_MAX_KEEP) -> list[dict]:
    """The most important proposals that a probe splits on."""
    props = list(props)
    some = sorted((p for p in props if counts.get(p["name"], 0.0) > 0), key=lambda p: (-counts[p["name"]], props.index(p)))
    return some[:max_keep]


def fit_recipe(df: DataFrame, feats: Sequence[str], y: str, probe: Callable[[DataFrame, list[str], int], dict],
               max_base: int = RECIPE_MAX_BASE, max_keep: int = RECIPE_MAX_KEEP, rounds: int = PROBE_ITER,
               rank_rounds: int = PROBE_ITER_RANK) -> list[dict]:
    """Base features by the importance a boosted probe gives them; their
    derived candidates that are finite with std >= 1e-12 (one aggregate) are
    probed beside the base features, and the ``max_keep`` most important with
    importance > 0 stay.  Needs >= 2 features and >= 50 rows.  The probes boost
    for ``rank_rounds`` and ``rounds`` rounds."""
    feats = list(feats)
    if len(feats) < 2 or df.count() < RECIPE_MIN_ROWS:
        return []
    ranked = feats
    if len(feats) > max_base:
        ranked = rank_base(feats, probe(df.select(y, *[f"`{c}`" for c in feats]), feats, rank_rounds))
    props = propose_recipe(df, ranked, max_base)
    cand = df.select(y, *[f"`{c}`" for c in feats], *[derived(p["op"], p["cols"]).alias(p["name"]) for p in props])
    st = cand.agg(*[F.stddev_samp(F.col(f"`{p['name']}`")).alias(f"s{i}") for i, p in enumerate(props)]).first()
    ok = [p for i, p in enumerate(props) if st[f"s{i}"] is not None and st[f"s{i}"] >= CONST_STD_EPS]
    return keep_recipe(ok, probe(cand, feats + [p["name"] for p in ok], rounds), max_keep) if ok else []


def fit_recipes(df: DataFrame, feats: Sequence[str], y: str, fold: str, sets: Sequence, key: str | None = None,
                max_base: int = RECIPE_MAX_BASE, max_keep: int = RECIPE_MAX_KEEP, rounds: int = PROBE_ITER,
                rank_rounds: int = PROBE_ITER_RANK, transform: str = "none", lam: float | None = None,
                medians: Mapping | None = None, written: list | None = None) -> dict:
    """``fit_recipe`` of every training set (a fold that it must not see, or
    ``all``) at once: a probe job for all sets, and one aggregate for what
    their candidates look like."""
    from sparkreg.operators.trees import PROBE, split_counts
    feats, meds = list(feats), medians or {}

    def rows_of(s, c):
        return c if s == "all" else F.when(F.col(fold) != s, c)

    def probes(table, cols_by_set, k):
        got = table.fit({s: Want(cols, replace(PROBE, rounds=k), meds.get(s, {}), None if s == "all" else s, transform, lam)
                         for s, cols in cols_by_set.items()})
        return {s: split_counts(m) for s, m in got.items()}

    n = df.agg(*[F.count(rows_of(s, F.lit(1))).alias(f"n{i}") for i, s in enumerate(sets)]).first()
    usable = [s for i, s in enumerate(sets) if n[f"n{i}"] >= RECIPE_MIN_ROWS and len(feats) >= 2]
    out = {s: [] for s in sets}
    if not usable:
        return out
    ranked = dict.fromkeys(usable, feats)
    if len(feats) > max_base:
        counts = probes(TreeTable(df, feats, y, fold, key, written=written), dict.fromkeys(usable, feats), rank_rounds)
        ranked = {s: rank_base(feats, counts[s]) for s in usable}
    base = {c for s in usable for c in ranked[s][:max_base]}
    ends = df.agg(*[a for i, s in enumerate(usable) for j, c in enumerate(sorted(base)) for a in (
        F.min(rows_of(s, F.col(f"`{c}`"))).alias(f"a{i}_{j}"), F.max(rows_of(s, F.col(f"`{c}`"))).alias(f"b{i}_{j}"))]).first()
    at = {c: j for j, c in enumerate(sorted(base))}
    props = {s: propose(ranked[s][:max_base], {c: (ends[f"a{i}_{at[c]}"], ends[f"b{i}_{at[c]}"]) for c in ranked[s][:max_base]})
             for i, s in enumerate(usable)}
    union = {p["name"]: p for s in usable for p in props[s]}
    cand = df.select("*", *[derived(p["op"], p["cols"]).alias(name) for name, p in union.items()])
    st = cand.agg(*[F.stddev_samp(rows_of(s, F.col(f"`{p['name']}`"))).alias(f"s{i}_{j}") for i, s in enumerate(usable)
                    for j, p in enumerate(props[s])]).first()
    ok = {s: [p for j, p in enumerate(props[s]) if (st[f"s{i}_{j}"] or 0.0) >= CONST_STD_EPS] for i, s in enumerate(usable)}
    names = {p["name"] for s in usable for p in ok[s]}
    if names:
        table = TreeTable(cand, feats + sorted(names), y, fold, key, written=written)
        counts = probes(table, {s: feats + [p["name"] for p in ok[s]] for s in usable if ok[s]}, rounds)
        out |= {s: keep_recipe(ok[s], counts[s], max_keep) for s in counts}
    return out


def apply_recipe(df: DataFrame, recipe: Sequence[dict]) -> DataFrame:
    """F10 over a fitted recipe."""
    return df.select("*", *[derived(p["op"], p["cols"]).alias(p["name"]) for p in recipe])


def r2_of(df: DataFrame, y: str, pred: str) -> float:
    r = df.agg(*M.r2_aggs(y, pred)).first()
    if r["sst"] and r["sst"] > 0:
        return float(1 - r["sse"] / r["sst"])
    return 1.0 if r["sse"] == 0 else 0.0


NAN = float(np.nan)
