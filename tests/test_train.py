"""Training on generated data with known structure (FIXTURES formulas),
train/score parity, and a leakage check."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreg.plans.score import score
from sparkreg.plans.train import save, train
from sparkreg.session import scratch_path
from sparkreg.sources.model_io import load_bundle


def _parcels(spark, n=240):
    """Parcels: a fee by weight and by service, with a small regular error."""
    fee = {"van": 3.5, "bike": 0.0, "air": 11.0}
    rows = []
    for i in range(n):
        service = list(fee)[(i * 7 + i // 11) % 3]
        weight = ((i * 37) % 101) / 10.0
        rows.append((i, weight, service, 1.2 * weight + fee[service] + ((i * 53) % 17 - 8) / 40.0))
    return spark.createDataFrame(rows, "id long, weight double, service string, y double")


def _depots(spark, n=330):
    """Fifteen depots with a level each, plus a slope."""
    rows = [(i, (i * 29 % 83) / 9.0, f"D{i * 4 % 15}", (i * 4 % 15) ** 1.3 + 0.7 * (i * 29 % 83) / 9.0
             + (i * 31 % 13 - 6) / 20.0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, km double, depot string, y double")


def test_onehot_linear_quality_and_parity(spark):
    df = _parcels(spark)
    res = train(df, "y", key="id", strategy="quick", families=("linear",))
    rep = res.report.first()
    assert rep["best_model"] == "linear" and rep["r2"] > 0.95
    root = scratch_path(spark, "t-bundle")
    save(res, root)
    b = load_bundle(spark, root)
    sc = score(df.drop("y"), b).select("id", F.col("y").alias("pred"))
    # parity: the bundle's score equals the in-memory final model on the same rows
    spec = res.models["linear"]
    assert sc.count() == df.count()
    j = sc.join(df, "id")
    r2 = j.agg(1 - F.sum((F.col("y") - F.col("pred")) ** 2) / (F.var_pop("y") * F.count("y"))).first()[0]
    assert r2 > 0.95
    assert spec.alpha in (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)


def test_target_encoding_family_quality(spark):
    res = train(_depots(spark), "y", key="id", strategy="thorough", families=("linear", "gbt"))
    rep = res.report.first()
    assert rep["eval_on"] == "oof" and rep["r2"] > 0.9


def test_leakage_random_high_card(spark):
    """A random label per row-group of 2 carries no signal: OOF R2 <= ~0."""
    rng = np.random.RandomState(11)
    n = 400
    rows = [(i, f"g{i // 2}", float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, grp string, y double")
    res = train(df, "y", key="id", strategy="thorough", families=("linear",))
    assert res.report.first()["r2"] < 0.1


def test_small_table_trains_on_all(spark):
    df = spark.createDataFrame([(i, float(i), float(2 * i + 1)) for i in range(8)], "id long, x double, y double")
    res = train(df, "y", key="id", families=("linear",))
    assert res.report.first()["eval_on"] == "train"


def test_thorough_finds_derived_product(spark):
    """poly_derived: y = round(x1 x2 + x3 + noise); the recipe must propose
    and keep x1*x2, and the linear model on it must fit well.  Scoring the
    saved bundle rebuilds the derived column."""
    rng = np.random.RandomState(7)
    n = 100
    x = rng.uniform(0, 4, (n, 3))
    y = np.round(x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(0, 0.2, n))
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)],
                               "id long, x1 double, x2 double, x3 double, y double")
    res = train(df, "y", key="id", strategy="thorough", families=("linear",))
    names = [r["name"] for r in res.bundle["prep"]["recipes"]["all"]]
    assert "x1*x2" in names
    assert res.report.first()["r2"] > 0.9
    root = scratch_path(spark, "t-derived")
    save(res, root)
    sc = score(df.drop("y"), load_bundle(spark, root))
    assert sc.filter(F.col("y") != F.round("y")).count() == 0      # integral target -> rounded output


def _noise(spark, n, d, seed):
    rng = np.random.RandomState(seed)
    rows = [(i, *map(float, rng.normal(size=d)), float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"x{j} double" for j in range(d)) + ", y double")


def test_poly_finds_nothing_in_noise(spark):
    """Columns chosen on held-out labels would show R2 above 0."""
    got = [train(_noise(spark, 120, 40, s), "y", key="id", strategy="thorough", families=("poly",), derive=False)
           .report.first()["r2"] for s in (1, 2, 3)]
    assert np.mean(got) < 0.0


@pytest.mark.parametrize("family", ["poly", "gp", "mlp", "rf", "xt"])
def test_every_family_reports(spark, family):
    res = train(_parcels(spark, 120), "y", key="id", strategy="thorough", families=(family,), derive=False, trees=8)
    root = scratch_path(spark, f"t-{family}")
    save(res, root)
    from sparkreg.sources.model_io import model_tables
    tabs = model_tables(spark, load_bundle(spark, root))
    own = {"poly": "coefficients", "gp": "kernel_points", "mlp": "layers"}.get(family, "tree_nodes")
    assert tabs[own].count() > 0 and tabs["medians"].count() > 0
    lb = res.leaderboard.filter(F.col("name") == family).first()
    assert lb["train_r2"] is not None and lb["r2"] > 0.5 and lb["train_r2"] > 0.5
    assert res.importance.count() > 0


def test_mlp_with_different_columns_and_partitions(spark):
    from sparkreg.operators.mlp import fit_mlp
    df = _noise(spark, 200, 3, 4).withColumn("y", F.col("x0") * 2 + F.sin("x1")).withColumn("fold", F.col("id") % 5)
    cols = {0: ["x0", "x1"], "all": ["x0", "x1", "x2"]}
    w = [fit_mlp(df.repartition(p, "id"), cols["all"], "y", {0: {}, "all": {}}, "fold", [0], cols_by_set=cols, passes=8)
         for p in (1, 4)]
    for s in cols:
        assert np.allclose(w[0][s].w, w[1][s].w, atol=1e-7)
    assert len(w[0][0].w) < len(w[0]["all"].w)


def test_names_with_dots(spark):
    df = _parcels(spark, 90).select("id", F.col("weight").alias("weight.kg"),
                                    F.when(F.col("service") == "air", "U.S. AIR").otherwise(F.col("service"))
                                    .alias("service"), F.col("y").alias("fee.total"))
    res = train(df, "fee.total", key="id", families=("linear",))
    assert res.report.first()["target"] == "fee.total" and res.report.first()["r2"] > 0.9
    assert "weight.kg" in {r["feature"] for r in res.importance.collect()}
    root = scratch_path(spark, "t-dots")
    save(res, root)
    sc = score(df, load_bundle(spark, root))
    assert sc.columns == df.columns and sc.filter(F.col("`fee.total`").isNull()).count() == 0


def test_repeated_key_is_refused(spark):
    df = _parcels(spark, 60).withColumn("id", F.col("id") % 20)
    with pytest.raises(ValueError, match="key_not_unique"):
        train(df, "y", key="id", families=("linear",))


def test_deploy_order(spark):
    from sparkreg.plans.train import clean, deploy
    res = train(_parcels(spark, 90), "y", key="id", families=("linear", "gp"))
    root = scratch_path(spark, "t-deploy")
    assert deploy(res, root)[:2] == (res.bundle["best"], res.bundle["best"])

    def refuses(result, path, name):
        if name == res.bundle["best"]:
            raise OSError("no space")
        return save(result, path, name)

    chosen, deployed, failures = deploy(res, root, refuses)
    assert deployed != chosen == res.bundle["best"] and failures == [f"{chosen}: OSError"]
    assert load_bundle(spark, root).meta["best"] == deployed
    assert res.oof.count() > 0
    clean(res)
    assert res.oof.count() > 0 and res.report.count() == 1


def test_search_chooses_settings(spark):
    res = train(_parcels(spark, 80), "y", key="id", strategy="thorough", families=("mlp",), derive=False, search=2)
    assert res.bundle["settings"]["mlp"]["alpha_l2"] in (1e-4, 1e-2)


def test_search_trials_are_full_fits(spark, sf_small):
    """Trials of a search keep the rounds, the stop and the passes of a
    training run; finalists are judged on every fold."""
    from sparkreg.operators import search as so
    from sparkreg.operators.trees import BOOST_THOROUGH
    asked = []

    class Table:
        spark = None

        def fit(self, wanted):
            asked.append(dict(wanted))
            return {k: type("Fitted", (), {"held": (10.0, 0.0, 10.0, 5.0 + k[0])}) for k in wanted}

    table = Table()
    table.spark = spark
    cands = so.gbt_candidates(100, size=6)
    assert cands == so.gbt_candidates(100)[:6] and len(so.gbt_candidates(100)) == 24
    folds = [0, 1, 2, 3, 4]
    trials = so.search_trees(table, cands, folds, dict.fromkeys(folds, ["a"]), dict.fromkeys(folds, {}))
    assert all(w.params.rounds == BOOST_THOROUGH.rounds and w.params.patience == BOOST_THOROUGH.patience
               for some in asked for w in some.values())
    assert {f for _, f in asked[0]} == {0, 1} and len(asked[0]) == 12
    assert sorted({i for i, _ in asked[1]}) == [0, 1, 2] and {f for _, f in asked[1]} == {2, 3, 4}
    assert so.best_trial(trials) == 0
    rows = trials.collect()
    assert [r["r2"] for r in rows if r["stage"] == "final"] == [pytest.approx(0.5 - 0.1 * i) for i in range(3)]


def test_a_search_tries_as_many_candidates_on_large_tables():
    from sparkreg.operators import search as so
    whole = so.gbt_candidates(5_000)
    assert len(whole) == 24
    assert all(so.gbt_candidates(n) == whole for n in (0, 5_001, 20_000, 20_001, 10 ** 9))
    assert so.gbt_candidates(10 ** 9, size=6) == whole[:6]


def test_screening_keeps_weak_columns(spark):
    """Binary columns of small but exact effect beside strong ones survive;
    ten rounds of a probe do not reach all of them."""
    from sparkreg.operators.trees import screen_features
    rng = np.random.default_rng(8)
    strong, weak = rng.uniform(-1, 1, (600, 6)), rng.integers(0, 2, (600, 6))
    y = strong @ [9.0, 8.0, 7.0, 6.0, 5.0, 4.0] + 0.6 * weak.sum(axis=1)
    feats = [f"s{i}" for i in range(6)] + [f"w{i}" for i in range(6)]
    df = spark.createDataFrame(np.column_stack([strong, weak, y]).tolist(), [*feats, "y"]).coalesce(1).cache()
    assert screen_features(df, feats, "y") == feats
    assert screen_features(df, feats, "y", rounds=10) != feats


def test_probe_rounds_reach_all_probes(spark, monkeypatch):
    from sparkreg.operators import trees
    from sparkreg.operators.search import fit_recipe
    asked = []
    real = trees.TreeTable.fit

    def fit(self, wanted):
        asked.extend(w.params.rounds for w in wanted.values() if not w.params.patience)
        return real(self, wanted)

    monkeypatch.setattr(trees.TreeTable, "fit", fit)
    train(_parcels(spark, 80), "y", key="id", strategy="thorough", families=("linear",), probe_rounds=7)
    assert set(asked) == {7}
    assert (trees.PROBE_ITER, trees.PROBE_ITER_RANK) == (200, 150)
    seen = []
    feats = [f"x{i}" for i in range(13)]
    df = spark.range(60).select(*[((F.col("id") * (i + 3)) % 11).cast("double").alias(c) for i, c in enumerate(feats)],
                                F.col("id").cast("double").alias("y"))
    fit_recipe(df, feats, "y", lambda d, names, rounds: seen.append(rounds) or {})
    assert seen == [150, 200]


def test_recipes_of_all_sets_equal_those_of_each(spark):
    """The shared probes choose what a probe of one set alone chooses."""
    from dataclasses import replace

    from sparkreg.operators.search import fit_recipe, fit_recipes
    from sparkreg.operators.trees import PROBE, fit_trees, split_counts
    rng = np.random.RandomState(3)
    x = rng.uniform(-2, 3, (150, 3)).round(1)
    y = x[:, 0] * x[:, 1] + x[:, 2]
    df = spark.createDataFrame([(i, i % 3, *map(float, x[i]), float(y[i])) for i in range(150)],
                               "id long, fold int, a double, b double, c double, y double")
    both = fit_recipes(df, ["a", "b", "c"], "y", "fold", [0, "all"], "id", rounds=30)

    def probe(d, names, rounds):
        return split_counts(fit_trees(d, names, "y", params=replace(PROBE, rounds=30)))

    one = fit_recipe(df.select("a", "b", "c", "y"), ["a", "b", "c"], "y", probe)
    assert [r["name"] for r in both["all"]] == [r["name"] for r in one] and one[0]["name"] == "a*b"
    assert both[0][0]["name"] == "a*b"


def test_transform_is_chosen_by_held_out_rows(spark):
    """The transform of largest held-out R2 is taken; scores are those of
    plain probes."""
    from dataclasses import replace

    from sparkreg.operators.trees import PROBE, fit_trees
    from sparkreg.plans.train import select_transform_cv
    rng = np.random.RandomState(4)
    x = rng.uniform(0, 5, (900, 2))
    wide = np.exp(1.3 * x[:, 0] + 0.8 * rng.randn(900))
    flat = 40 + 3 * x[:, 0] - 2 * x[:, 1] + 0.3 * rng.randn(900)
    df = spark.createDataFrame([(i, i % 3, *map(float, x[i]), float(wide[i]), float(flat[i])) for i in range(900)],
                               "id long, fold int, a double, b double, wide double, flat double")
    best, lam, scores = select_transform_cv(df, "wide", ["a", "b"], float(wide.min()), [0, 1], 60, "id")
    assert set(scores) == {"none", "log1p", "yeo_johnson"} and scores[best] == max(scores.values())
    assert (lam is not None) == (best == "yeo_johnson")
    _, _, scores = select_transform_cv(df, "flat", ["a", "b"], float(flat.min()), [0, 1], 60, "id")
    plain = fit_trees(df, ["a", "b"], "flat", params=replace(PROBE, rounds=60), fold="fold", folds=[0, 1], key="id")
    rows = None
    for f in (0, 1):
        part = plain[f].transform(df.where(F.col("fold") == f), "p")
        rows = part if rows is None else rows.unionByName(part)
    want = rows.agg(1 - F.sum((F.col("flat") - F.col("p")) ** 2) / (F.var_pop("flat") * F.count("flat"))).first()[0]
    assert scores["none"] == pytest.approx(want)


def test_a_given_transform_is_kept(spark):
    res = train(_parcels(spark, 90), "y", key="id", families=("linear",), transform="log1p")
    assert res.report.first()["y_transform"] == "log1p" and res.report.first()["r2"] > 0.5
