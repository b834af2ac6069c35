"""Approximate nearest neighbours with a forest of hash-prefix trees.

A tree gives each vector a long bit string (signs of random projections of
the centred vector) and keeps the strings in a sorted array.  A query
descends each tree to the longest prefix that its own string shares with
stored ones, which a binary search in the sorted array finds; then all trees
ascend together, one bit at a time, and widen their ranges until enough
different candidates are found.  Candidates are ranked by exact distance.

Spark deals the vectors into shards of bounded size by a hash of the id, and
the queries into blocks; each (block, shard) pair is one group.  Every shard
returns its ten best per query and a window takes the best of those.
Identical vectors are collapsed before the index is built: of a class only
as many ids as a result can show are kept next to it, so a vector that a
third of the rows share is one entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.llm.common import write_table

K = 10
TREES = 48
BITS = 32
#: Share of a shard's vectors that a query looks at, at least.
PROBE_SHARE = 0.45
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
SEED = 7


def _planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(trees, dim, BITS))


class Forest:
    """The sorted arrays of one shard."""

    def __init__(self, x: np.ndarray, trees: int = TREES):
        self.center = x.mean(axis=0)
        self.planes = _planes(x.shape[1], trees)
        self.order, self.keys = [], []
        for p in self.planes:
            k = self.hash(x, p)
            o = np.argsort(k, kind="stable")
            self.order.append(o)
            self.keys.append(k[o])

    def hash(self, x: np.ndarray, plane: np.ndarray) -> np.ndarray:
        bits = (x - self.center) @ plane > 0
        return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(level, tree, query) bounds of the stored strings that share the
        first ``level`` bits with the query's string."""
        lo = np.empty((BITS + 1, len(self.keys), len(q)), dtype=np.int64)
        hi = np.empty_like(lo)
        for t, (plane, keys) in enumerate(zip(self.planes, self.keys)):
            h = self.hash(q, plane)
            for level in range(BITS + 1):
                low = (h >> (BITS - level)) << (BITS - level)
                lo[level, t] = np.searchsorted(keys, low)
                hi[level, t] = np.searchsorted(keys, low + (np.int64(1) << (BITS - level)))
        return lo, hi

    def candidates(self, q: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the candidates of the synchronous ascent."""
        lo, hi = self.ranges(q)
        n = len(self.order[0])
        longest = BITS - np.argmax((hi > lo)[::-1], axis=0)          # (tree, query): where the descent ends
        seen = np.zeros(n, dtype=bool)
        for i in range(len(q)):
            seen[:] = False
            for level in range(int(longest[:, i].max()), -1, -1):
                for t in np.flatnonzero(longest[:, i] >= level):
                    seen[self.order[t][lo[level, t, i]:hi[level, t, i]]] = True
                if seen.sum() >= least:
                    break
            yield np.flatnonzero(seen)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite components that is
    not zero; the others take no part."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                       F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where("vec_id is not null and v is not null").where(fine & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_mod: int = 100,
            k: int = K, trees: int = TREES, probe_share: float = PROBE_SHARE, shard_rows: int = SHARD_ROWS,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible
    by ``query_mod`` its ``k`` nearest others by Euclidean distance, nearest
    first, ties to the smaller id; all others if there are fewer.

    Vectors that are null, zero, or hold null or non-finite components take
    no part, neither do rows without an id.  Vectors of different lengths are
    not compared.  A repeated id counts once, with the row whose vector sorts
    first.  No usable rows give an empty result.
    """
    rows = usable(vectors, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = write_table(rows, "ann-rows")
    # a class of identical vectors keeps its k + 1 smallest ids
    cls = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = Window.partitionBy("v", "salt").orderBy("vec_id")
    again = Window.partitionBy("v").orderBy("vec_id")
    cls = (cls.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
           .withColumn("rn", F.row_number().over(again)).where(F.col("rn") <= k + 1)
           .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    cls = write_table(cls.withColumn("dim", F.size("v")), "ann-classes")
    queries = rows.where(F.col("vec_id") % query_mod == 0).withColumn("dim", F.size("v"))
    shards = max(1, math.ceil(cls.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    index = (cls.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, q = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            ids, qid = left["ids"].tolist(), right["vec_id"].to_numpy()
            for s in range(0, len(q), 256):
                forest = Forest(x, trees) if s == 0 else forest
                found = forest.candidates(q[s:s + 256], min(len(x), max(4 * k, math.ceil(probe_share * len(x)))))
                for i, c in enumerate(found):
                    d = np.sqrt(((x[c] - q[s + i]) ** 2).sum(axis=1))
                    if len(c) > k + 1:
                        near = d <= np.partition(d, k)[k]
                        c, d = c[near], d[near]
                    got = sorted((float(b), int(v)) for a, b in zip(c, d) for v in ids[a] if v != qid[s + i])[:k]
                    out += [(int(qid[s + i]), v, b) for b, v in got]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = index.groupBy("block", "shard", "dim").cogroup(asked.groupBy("block", "shard", "dim")) \
        .applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
