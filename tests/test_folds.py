"""Fold construction: exact ranks without a global window, balance, and
independence from partitioning."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkreg.operators import folds as W


def test_md5_rank_matches_global_window(spark, sf_small, monkeypatch):
    ev = spark.read.parquet(f"{sf_small}/events.parquet").select("event_id", "event_type")
    monkeypatch.setattr(W, "MAX_ROWS_PER_RANK_TASK", 5)      # force 2+ hex digits of bucketing
    got = W.md5_rank(ev, "event_id", 42, groups=["event_type"], out="r", n_groups=5)
    ref = ev.withColumn("r", (F.row_number().over(
        Window.partitionBy("event_type").orderBy(W.row_hash("event_id", 42))) - 1).cast("bigint"))
    assert got.select("event_id", "r").exceptAll(ref.select("event_id", "r")).count() == 0
    assert got.count() == ev.count()


def test_folds_stable_under_repartition(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    a = W.stratified_folds(ev.repartition(1), "event_id", "value").select("event_id", "fold")
    b = W.stratified_folds(ev.repartition(16), "event_id", "value").select("event_id", "fold")
    assert a.exceptAll(b).count() == 0


def test_fold_balance(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    f = W.stratified_folds(ev, "event_id", "value")
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 5


def test_kfold_chunks(spark, sf_small):
    od = spark.read.parquet(f"{sf_small}/orders.parquet").select("o_orderkey")
    n = od.count()
    sizes = sorted(r["count"] for r in W.kfold(od, "o_orderkey", 7).groupBy("fold").count().collect())
    assert sum(sizes) == n and sizes[-1] - sizes[0] <= 1


def test_permutation_is_a_permutation(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet").select("event_id", "value")
    p = W.permute_column(ev, "event_id", "value", 3)
    assert p.count() == ev.count()
    assert p.select("value").exceptAll(ev.select("value")).count() == 0
    assert p.join(ev, ["event_id", "value"]).count() < ev.count()
