"""Histogram trees against plain leaf-by-leaf growth, and the two ways of
training against each other."""

import heapq
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkreg.operators import trees as T
from sparkreg.operators.histogram import Block, BlockWork, Ensemble, Fit, Params, local_ask, pooled_r2, run

WIDTH = 64


def binned(n=900, d=4, seed=0):
    rng = np.random.RandomState(seed)
    x = rng.rand(n, d)
    y = np.sin(6 * x[:, 0]) + 3 * x[:, 1] * x[:, 2] + 0.1 * rng.randn(n)
    cuts = [np.quantile(x[:, j], np.arange(1, WIDTH - 1) / (WIDTH - 1)) for j in range(d)]
    codes = np.asfortranarray(np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8))
    return codes, y, [len(c) for c in cuts]


def blocks_of(codes, y, size):
    n = np.arange(len(y))
    return [Block(codes[a:a + size], y[a:a + size], n[a:a + size] % 5, n[a:a + size].astype(np.uint64), 255)
            for a in range(0, len(y), size)]


def plain_tree(codes, y, leaves, min_leaf, l1, l2):
    """Split the leaf of largest gain until there are enough leaves."""
    def best(rows):
        g, found, top = -y[rows], None, 1e-9
        whole = max(abs(g.sum()) - l1, 0) ** 2 / (len(rows) + l2)
        for f in range(codes.shape[1]):
            for cut in range(WIDTH - 1):
                low = codes[rows, f] <= cut
                k = low.sum()
                if min(k, len(rows) - k) >= min_leaf:
                    a, b = g[low].sum(), g[~low].sum()
                    gain = (max(abs(a) - l1, 0) ** 2 / (k + l2) + max(abs(b) - l1, 0) ** 2 / (len(rows) - k + l2) - whole)
                    if gain > top:
                        top, found = gain, low
        return (-top, random.random(), rows, found)

    heap, done = [best(np.arange(len(y)))], []
    while heap and len(heap) + len(done) < leaves:
        item = heapq.heappop(heap)
        if item[3] is None:
            done.append(item)
            continue
        heapq.heappush(heap, best(item[2][item[3]]))
        heapq.heappush(heap, best(item[2][~item[3]]))
    out = np.zeros(len(y))
    for _, _, rows, _ in heap + done:
        g = -y[rows].sum()
        out[rows] = -np.sign(g) * max(abs(g) - l1, 0) / (len(rows) + l2)
    return out, len(heap) + len(done)


@pytest.mark.parametrize("leaves,min_leaf,l1,l2", [(2, 3, 0.1, 1.0), (5, 20, 0.0, 0.0), (9, 5, 2.0, 10.0), (31, 40, 0.1, 1.0)])
def test_a_tree_is_grown_best_leaf_first(leaves, min_leaf, l1, l2):
    codes, y, cuts = binned()
    fit = Fit(tuple(range(4)), (0,) * 4, Params(rounds=1, leaves=leaves, rate=1.0, min_leaf=min_leaf, rows=1.0, cols=1.0, l1=l1, l2=l2))
    e = Ensemble(0, fit, np.array(cuts), WIDTH)
    run([e], local_ask({0: [BlockWork(b, fit) for b in blocks_of(codes, y, 250)]}, WIDTH))
    tree = e.trees[0]
    whole = BlockWork(blocks_of(codes, y, len(y))[0], fit)
    want, k = plain_tree(codes, y - e.init, leaves, min_leaf, l1, l2)
    assert (tree.feature < 0).sum() == k and np.allclose(tree.value[whole._walk(tree)], want, atol=1e-9)


def test_lost_memory_changes_nothing():
    """Blocks whose memory is lost at any moment give the same ensemble."""
    codes, y, cuts = binned()
    fit = Fit((0, 1, 2, 3), (0,) * 4, Params(rounds=60, patience=10, min_leaf=5), fold=1)
    blocks, rng = blocks_of(codes, y, 200), random.Random(1)
    sure = Ensemble(0, fit, np.array(cuts), WIDTH)
    run([sure], local_ask({0: [BlockWork(b, fit) for b in blocks]}, WIDTH))
    works = [BlockWork(b, fit) for b in blocks]

    def forgetful(asks):
        for i, b in enumerate(blocks):
            if rng.random() < 0.3:
                works[i] = BlockWork(b, fit)
        return local_ask({0: works}, WIDTH)(asks)

    e = Ensemble(0, fit, np.array(cuts), WIDTH)
    run([e], forgetful)
    assert np.allclose(e.curve, sure.curve, rtol=1e-12) and len(e.trees) == len(sure.trees)
    assert all(np.array_equal(a.cut, b.cut) for a, b in zip(e.trees, sure.trees))


def test_the_holdout_stops_the_rounds():
    rng = np.random.RandomState(3)
    codes, _, cuts = binned()
    noise = rng.randn(len(codes))
    fit = Fit((0, 1, 2, 3), (0,) * 4, Params(rounds=500, patience=12, min_leaf=5), fold=0)
    e = Ensemble(0, fit, np.array(cuts), WIDTH)
    run([e], local_ask({0: [BlockWork(b, fit) for b in blocks_of(codes, noise, 300)]}, WIDTH))
    assert len(e.curve) - 1 == len(e.kept()) + 12 < 500
    assert e.curve[len(e.kept())] == min(e.curve[1:])
    n, mean, sst, _ = e.held_sums()
    unseen = noise[np.arange(len(noise)) % 5 == 0]
    assert n == len(unseen) and np.allclose([mean, sst], [unseen.mean(), ((unseen - unseen.mean()) ** 2).sum()])


def frame(spark, n=600):
    rng = np.random.RandomState(5)
    x = rng.rand(n, 3)
    y = 20 + np.sin(6 * x[:, 0]) + 3 * x[:, 1] * (x[:, 2] > 0.4) + 0.05 * rng.randn(n)
    rows = [(i, i % 3, float(x[i, 0]) if i % 11 else None, float(x[i, 1]), float("nan") if i % 13 == 0 else float(x[i, 2]),
             float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, fold int, a double, `b.c` double, d double, y double").repartition(3)


def same(a, b):
    return (np.array_equal(a.feature, b.feature) and np.array_equal(a.threshold, b.threshold)
            and np.allclose(a.value, b.value, rtol=1e-9) and np.array_equal(a.rows, b.rows))


def test_large_and_small_tables_train_alike(spark, monkeypatch):
    monkeypatch.setattr(T, "DIRECT_TASKS", 2)
    monkeypatch.setattr(T, "SHIPPED_TREES", 4)
    df = frame(spark)
    feats, meds = ["a", "b.c", "d"], {"a": 0.5, "b.c": 0.4}
    table = T.TreeTable(df, feats, "y", "fold", "id", bins=40)
    want = {f: T.Want(feats, replace(T.BOOST_QUICK, rounds=12), meds, f) for f in (0, 1, None)}
    want["log"] = T.Want(["a", "d"], replace(T.BOOST_QUICK, rounds=5, bins=9, random_cuts=True), meds, 2, "log1p")
    want["rf"] = T.Want(feats, replace(T.FOREST, rounds=40), meds, 0, kind="rf")
    small = table.fit(want)
    table.local_bytes = 0
    monkeypatch.setattr(T, "PART_TREES", 40)
    monkeypatch.setattr(T, "WAVE_BYTES", 1 << 20)
    large = table.fit({k: w for k, w in want.items() if k != "rf"} | {"rf": replace(want["rf"], params=replace(T.FOREST, rounds=3))})
    for k in (0, 1, None, "log"):
        assert same(small[k], large[k]) and np.allclose(small[k].curve, large[k].curve)
    assert small["rf"].n_trees == 40 and large["rf"].n_trees == 3
    assert np.array_equal(large["rf"].threshold, small["rf"].threshold[:len(large["rf"].threshold)])
    other = T.TreeTable(df.repartition(11), feats, "y", "fold", "id", bins=40).fit({0: want[0]})
    assert same(other[0], small[0])
    got = small[0].transform(df.where("fold = 0"), "p").agg(F.sum((F.col("y") - F.col("p")) ** 2)).first()[0]
    assert got == pytest.approx(small[0].held[3]) and pooled_r2([small[0].held]) > 0.4


def test_a_group_reads_its_blocks_in_place():
    """By id over all batches, and as views: no copy of a table that may be
    large."""
    rows = [(7, b"g"), (2, b"b"), (9, b"i"), (1, b"a")]
    group = pa.Table.from_batches([pa.RecordBatch.from_pydict({
        "id": [i for i, _ in part], **{c: [v * 3 for _, v in part] for c in ("codes", "y", "fold", "hash")},
        "fit": pa.array([0] * len(part), pa.int32())}) for part in (rows[:2], rows[2:])])
    got = list(T._at_hand(group))
    assert [bytes(r[0]) for r in got] == [b"aaa", b"bbb", b"ggg", b"iii"]
    base = group["codes"].chunk(1).buffers()[2].address
    assert got[0][0].address == base + 3


def test_scores_follow_the_node_table(spark):
    df = frame(spark)
    feats = ["a", "b.c", "d"]
    for kind, params in (("gbt", replace(T.BOOST_QUICK, rounds=25)), ("xt", replace(T.EXTRA, rounds=12)),
                         ("gbt", Params(rounds=3, leaves=200, min_leaf=1))):
        spec = T.fit_trees(df, feats, "y", kind, params=params, key="id")
        nodes = T.node_table(spec, spark).toPandas()
        back = T.spec_from_nodes(nodes, kind=kind, feats=feats, medians=spec.medians, init=spec.init, mean=spec.mean)
        rows = spec.transform(df, "p").collect()
        again = [r["p"] for r in back.transform(df, "p").collect()]
        table = {(r.tree, r.node): r for r in nodes.itertuples()}
        for r, p in list(zip(rows, again))[:60]:
            total = 0.0
            for t in range(spec.n_trees):
                n = table[t, 0]
                while isinstance(n.feature, str):
                    v = r[n.feature]
                    v = spec.medians[n.feature] if v is None or v != v else v
                    n = table[t, n.left if v <= n.threshold else n.right]
                total += n.value
            want = total / spec.n_trees if spec.mean else spec.init + total
            assert r["p"] == pytest.approx(want) and p == pytest.approx(want)
        share = {r["feature"]: r["pct"] for r in T.split_importance(spec, spark).collect()}
        assert sum(share.values()) == pytest.approx(100.0)


def test_forests_have_their_trees_and_draw_their_cuts(spark):
    df = frame(spark)
    feats = ["a", "b.c", "d"]
    rf, xt = (T.fit_trees(df, feats, "y", k, key="id") for k in ("rf", "xt"))
    assert rf.n_trees == xt.n_trees == 300
    roots = [xt.threshold[s] for s in xt.starts[:-1]]
    assert len(set(roots)) > 100                      # drawn anew for every tree
    for spec in (rf, xt):
        r = spec.transform(df, "p").agg((1 - F.sum((F.col("y") - F.col("p")) ** 2) / (F.var_pop("y") * F.count("y")))).first()[0]
        assert r > 0.7


@pytest.mark.parametrize("rows", [0, 1, 2, 5])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame([(i, float(i), None, 4.0) for i in range(rows)], "id long, a double, b double, y double")
    for kind in ("gbt", "rf", "xt"):
        spec = T.fit_trees(df, ["a", "b"], "y", kind, key="id")
        assert all(r["p"] == pytest.approx(4.0) for r in spec.transform(df, "p").collect())


def test_networks_train_alike(spark):
    from sparkreg.operators.mlp import NetWant, fit_networks
    df = frame(spark, 200).select("id", "fold", "a", F.col("`b.c`").alias("b"), "y")
    want = {"x": NetWant(["a", "b"], {"a": 0.5, "b": 0.4}, 1), "z": NetWant(["b"], {}, None, 1e-2, single=True)}
    one, two = (fit_networks(df, "y", want, "fold", passes=9, held=True, local_bytes=b) for b in (1 << 30, 0))
    for k in want:
        assert np.allclose(one[k][0].w, two[k][0].w, atol=1e-6) and np.allclose(one[k][1], two[k][1], rtol=1e-6)
    gap = one["x"][0].predict_column(df.where("fold = 1"), "p").agg(F.sum((F.col("y") - F.col("p")) ** 2)).first()[0]
    assert gap == pytest.approx(one["x"][1][3], rel=1e-6)


def test_an_ensemble_is_its_first_trees_and_more(spark):
    df, feats = frame(spark), ["a", "b.c", "d"]
    long, short = (T.fit_trees(df, feats, "y", params=replace(T.BOOST_QUICK, rounds=k, patience=0), key="id") for k in (9, 4))
    assert same(long.first(4), short) and long.first(99).n_trees == 9


def test_columns_of_few_codes_are_counted_together_with_the_same_sums():
    rng = np.random.RandomState(3)
    n, kinds = 6000, (2, 40, 2, 6, 2, 2, 3, 2, 2)
    for dtype in (np.uint8, np.uint16):
        codes = np.asfortranarray(np.column_stack([rng.randint(0, k, n) for k in kinds]).astype(dtype))
        y = rng.randn(n)
        block = Block(codes, y, np.arange(n) % 5, np.arange(n).astype(np.uint64), np.iinfo(dtype).max)
        fit = Fit(tuple(range(len(kinds))), (0,) * len(kinds), Params(rounds=2, min_leaf=20), fold=1)
        work = BlockWork(block, fit)
        assert [list(first) for first, _, _ in work.joint] == [[0, 2, 4, 5, 7, 8, 6], [3, 1]]
        ensemble, asks = Ensemble(0, fit, np.array([k - 1 for k in kinds]), WIDTH), []

        def ask(some):
            asks.append(some[0])
            told = work.answer(some[0], WIDTH)
            if told.hist is not None:
                for i, node in enumerate(some[0].nodes):
                    rows = work.rows[node][0]
                    for j, c in enumerate(some[0].columns):
                        assert (told.hist[i, j, :, 0] == np.bincount(codes[rows, c], minlength=WIDTH)).all()
                        assert (told.hist[i, j, :, 1] == np.bincount(codes[rows, c], weights=work.miss[rows],
                                                                     minlength=WIDTH)).all()
            return {0: told}

        run([ensemble], ask)
        assert len(ensemble.trees) == 2 and any(len(a.nodes) > 1 for a in asks)


@pytest.mark.parametrize("fold,how", [(0, {"params": Params(rounds=12, patience=30)}), (1, {
    "params": replace(T.PROBE, rounds=12), "transform": "yeo_johnson", "lam": 0.4}), (None, {"params": replace(T.FOREST, rounds=4)})])
def test_rows_that_share_their_codes_are_summed_by_cell(fold, how, monkeypatch):
    """Rows of equal codes enter a tree as one; the trees are those of all rows, missing values included."""
    from sparkreg.operators import histogram as H
    rng = np.random.default_rng(3)
    n, cuts = 40_000, np.array([39, 7, 1, 3])
    codes = np.stack([rng.integers(0, k + 1, n) for k in cuts] + [rng.integers(0, 4, n)]).astype(np.uint8)
    codes[0][rng.random(n) < 0.05] = 255
    y = np.abs(codes[0] * 0.3 + codes[1] * codes[2] + rng.normal(0, 3, n)) + 1
    folds, hashes = rng.integers(0, 5, n).astype(np.int32), rng.integers(0, 2 ** 62, n).astype(np.uint64)
    blocks = [H.Block(codes[:, a:a + 8_192].T, y[a:a + 8_192], folds[a:a + 8_192], hashes[a:a + 8_192], 255)
              for a in range(0, n, 8_192)]
    fit = H.Fit((0, 1, 2, 3), (20, 0, 0, 0), fold=fold, **how)
    assert len(H.works_of(blocks, fit)) == len(blocks)             # few rows are summed row by row
    monkeypatch.setattr(H, "CELL_ROWS", 1)
    cells = H.works_of(blocks, fit)
    assert len(cells) == 1 and len(cells[0].codes) <= 40 * 8 * 2 * 4 + 64
    got = []
    for works in ([H.BlockWork(b, fit) for b in blocks], cells):
        e = H.Ensemble(0, fit, cuts, 41)
        H.run([e], H.local_ask({0: works}, 41))
        got.append(e)
    a, b = got
    assert len(a.trees) == len(b.trees) and np.allclose(a.curve, b.curve, rtol=1e-9)
    assert np.allclose(a.held_sums(), b.held_sums(), rtol=1e-9)
    assert all(np.allclose(np.sort(s.value), np.sort(t.value)) for s, t in zip(a.trees, b.trees))
    wide = H.Block(rng.integers(0, 250, (n, 4)).astype(np.uint8), y, folds, hashes, 255)
    assert type(H.works_of([wide], replace(fit, params=Params()))[0]) is H.BlockWork      # no rows in common


def test_a_cell_may_hold_more_rows_than_a_chunk(monkeypatch):
    """The last cell spans several chunks, so the later ones begin no cell."""
    from sparkreg.operators import histogram as H
    n = 5_000
    rng = np.random.default_rng(4)
    code = np.where(np.arange(n) < 600, np.arange(n) % 2, 2).astype(np.uint8)
    y = code * 2.0 + rng.normal(0, 1, n)
    block = H.Block(code[:, None], y, np.zeros(n, np.int32), rng.integers(0, 2 ** 62, n).astype(np.uint64), 255)
    fit = H.Fit((0,), (0,), Params(rounds=3))
    monkeypatch.setattr(H, "CELL_ROWS", 1)
    monkeypatch.setattr(H, "CHUNK_ROWS", 500)
    work, = H.works_of([block], fit)
    assert type(work) is H.CellWork
    assert np.array_equal(work.every[0], np.bincount(code)) and np.allclose(work.every[1], np.bincount(code, weights=y))
    got = []
    for works in ([H.BlockWork(block, fit)], [work]):
        e = H.Ensemble(0, fit, np.array([2]), 3)
        H.run([e], H.local_ask({0: works}, 3))
        got.append(e)
    assert len(got[0].trees) == len(got[1].trees) == 3
    assert all(np.allclose(a.value, b.value) and np.array_equal(a.rows, b.rows) for a, b in zip(got[0].trees, got[1].trees))


@pytest.mark.parametrize("how", [{}, {"bag": True, "rate": 1.0}])
def test_works_are_taken_up_from_files(tmp_path, monkeypatch, how):
    """Any worker goes on where another left a part, also from older files."""
    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"{tmp_path}/a,{tmp_path}/b")
    codes, y, cuts = binned()
    fit = Fit((0, 1, 2, 3), (0,) * 4, Params(rounds=8, leaves=12, min_leaf=5, **how), fold=1)
    sure = Ensemble(0, fit, np.array(cuts), WIDTH)
    run([sure], local_ask({0: [BlockWork(b, fit) for b in blocks_of(codes, y, 300)]}, WIDTH))
    parts = {"p": blocks_of(codes[:600], y[:600], 300), "q": blocks_of(codes[600:], y[600:], 300)}
    folds = {"p": np.arange(600) % 5, "q": np.arange(600, 900) % 5}
    for part, blocks in parts.items():
        for b, f, a in zip(blocks, np.split(folds[part], len(blocks)), range(0, 900, 300)):
            b.fold, b.hash = f, (np.arange(300) + a + (600 if part == "q" else 0)).astype(np.uint64)
        T._remember("run", part, 0, [BlockWork(b, fit) for b in blocks])
    rng, jobs, lost = random.Random(2), [], 0

    def ask(asks):
        nonlocal lost
        jobs.append(1)
        for part in parts:
            if rng.random() < 0.3:
                path = T.kept.place("run", f"{part}-0.{rng.choice(['rows', 'trees'])}")
                lost += T.os.path.exists(path)
                T.os.path.exists(path) and T.os.remove(path)
        return {0: T._recall("run", "p", asks[0], WIDTH) + T._recall("run", "q", asks[0], WIDTH)}

    e = Ensemble(0, fit, np.array(cuts), WIDTH)
    run([e], ask)
    assert lost > 3 and len(e.trees) == len(sure.trees) == 8
    assert all(np.array_equal(a.cut, b.cut) and np.allclose(a.value, b.value, rtol=1e-9) for a, b in zip(e.trees, sure.trees))
    T.kept.drop("run")
    assert T._recall("run", "p", e.ask(), WIDTH) is None and not list(tmp_path.glob("*/*"))


def test_a_job_sends_no_blocks_again_unless_works_are_lost(spark, monkeypatch):
    df = frame(spark)
    want = {0: T.Want(["a", "b.c"], replace(T.BOOST_QUICK, rounds=4), {}, 0)}
    table = T.TreeTable(df, ["a", "b.c"], "y", "fold", "id", bins=20, local_bytes=0)
    call, collect, asked, lose = T._Jobs.__call__, T._Jobs._collect, [], [None]

    def traced(self, asks):
        asked.append([])
        got = call(self, asks)
        if len(asked) == lose[0]:                    # as if the executor had lost its folder
            self.parts.mapInArrow(lambda batches, name=self.run: (T.kept.drop(name), iter(()))[1], "part string").collect()
        return got

    def plan(self, sums):                            # does the job read the blocks, or only the names of what is kept
        asked[-1].append("InMemoryRelation" not in sums._jdf.queryExecution().withCachedData().toString())
        return collect(self, sums)

    monkeypatch.setattr(T._Jobs, "__call__", traced)
    monkeypatch.setattr(T._Jobs, "_collect", plan)
    whole = table.fit(want)[0]
    assert len(asked) > 8 and all(a == [False] for a in asked)
    asked.clear()
    lose[0] = 5
    assert same(whole, table.fit(want)[0])
    assert asked[:5] == 5 * [[False]] and len(asked) > 8 and all(a == [False, True] for a in asked[5:])

    def left(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(d.startswith("kept-") for r in T.kept._roots() for d in T.os.listdir(r))]})

    assert spark.range(1).mapInArrow(left, "n bigint").collect()[0]["n"] == 0
