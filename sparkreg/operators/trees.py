"""Boosted and bagged trees on binned tables.

A table is binned once, into blocks of rows that every fit shares: all
training sets, all parts of a forest and all candidates of a search.  Two
ways lead from there to the same trees:

* a table whose blocks are large is trained by one job a level.  A job
  brings every fit the histograms it asks for, added up over the blocks in
  the tasks and then over the tasks;
* a table whose blocks together stay below ``LOCAL_BYTES`` is sent whole to
  each fit's group, and the groups are trained side by side, a job for all of
  them: its size is checked as that of a broadcast side would be.

What tasks remember of a block between jobs (scores, the leaf a row is in)
follows from the block and the trees and is made anew where it is missing; it
lies in files that the workers of an executor share.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import math
import os
import pickle
import uuid
from collections.abc import Hashable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.operators import kept
from sparkreg.operators.histogram import (Ask, Block, BlockWork, Ensemble, Fit, Params, Told, Tree, local_ask, run,
                                           works_of)
from sparkreg.session import cut_lineage, ship_package

# The settings of each kind of model.
BOOST_QUICK = Params(rounds=500, patience=30)
BOOST_THOROUGH = Params(rounds=3000, patience=50)
PROBE = Params(rounds=200, rate=0.1, rows=1.0, cols=1.0, l1=0.0, l2=0.0)
FOREST = Params(rounds=300, leaves=63, rate=1.0, min_leaf=10, rows=0.7, cols=0.7, l1=0.0, l2=0.0, bag=True)
EXTRA = replace(FOREST, min_leaf=5, rows=0.8, cols=0.6, random_cuts=True)
KINDS = {"gbt": BOOST_QUICK, "rf": FOREST, "xt": EXTRA}
SCREEN_MIN_FEATURES = 10
PROBE_ITER = PROBE.rounds      # boosting rounds of a probe model (screening, recipes, transform choice)
PROBE_ITER_RANK = 150          # of the probe that ranks a recipe's base features

#: Rows of a block; binned bytes up to which a table goes to each fit whole
#: (a task then holds about three times as much, see ``_at_hand``); trees that
#: a forest grows in one sequence.
BLOCK_ROWS, LOCAL_BYTES, PART_TREES = 32_768, 256 << 20, 38
#: Bytes of histograms that one task holds for all fits it serves at once,
#: tasks whose sums are collected without a second step, and finished trees
#: that are shipped together.
WAVE_BYTES, DIRECT_TASKS, SHIPPED_TREES = 64 << 20, 32, 64
#: Blocks whose works are remembered together, how many times the table's
#: bytes what is remembered may take, and the bytes of a row beside its codes
#: in a block and in what a fit remembers; where less than a ``MOVED_SHARE``th of
#: the rows has moved, places are not written again.  ``MISSING`` stands for a
#: fit where works are not found.
KEPT_BLOCKS, KEPT_SHARE, BLOCK_EXTRA, KEPT_EXTRA, MOVED_SHARE, MISSING = 8, 12, 20, 60, 4, -1
BIN_ACCURACY = 20_000


# ---------------------------------------------------------------- models
@dataclass
class TreeSpec:
    """A fitted ensemble: node tables one after another, ``starts`` telling
    where each tree begins.  A prediction is ``init`` plus the sum of the
    leaves, or their mean."""
    kind: str
    feats: list[str]
    medians: dict[str, float]
    init: float = 0.0
    mean: bool = False
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: list[float] = field(default_factory=list)     # holdout loss by round, round 0 first
    held: tuple = (0.0, 0.0, 0.0, 0.0)                   # unseen fold: rows, mean, squares about it, squared error

    @property
    def n_trees(self) -> int:
        return len(self.starts) - 1

    def first(self, k: int) -> TreeSpec:
        """The ensemble as it was after ``k`` trees."""
        k = min(k, self.n_trees)
        end = self.starts[k]
        return replace(self, starts=self.starts[:k + 1], **{c: getattr(self, c)[:end] for c in (
            "feature", "threshold", "left", "right", "value", "rows")})

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """The prediction as one more column."""
        spec = self
        cols = [(F.col(f"`{c}`").cast("double"), F.lit(float(self.medians.get(c, 0.0)))) for c in self.feats]
        cols = [F.when(c.isNull() | F.isnan(c), m).otherwise(c) for c, m in cols]          # NULL and NaN are missing

        @F.pandas_udf("double")
        def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            scorer = Scorer(spec)
            for columns in batches:
                yield pd.Series(scorer.predict([c.to_numpy(dtype=float) for c in columns]))

        return df.withColumn(out, walk(*cols))


class Scorer:
    """Leaf masks: a tree's leaves are bits, and every split that a row fails
    clears the leaves on its left; the lowest bit left is the row's leaf.  The
    masks of one column's splits are tabulated by the column's bin."""

    ROWS = 8_192
    #: B(2, 6): the top six bits of a lone bit times this number name it.
    SEQUENCE = 0x07EDD5E59A4E28C2

    def __init__(self, spec: TreeSpec):
        self.spec = spec
        d = len(spec.feats)
        inner = spec.feature >= 0
        self.edges = [np.unique(spec.threshold[inner & (spec.feature == f)]) for f in range(d)]
        self.small = [np.uint8 if len(e) < 255 else np.uint16 if len(e) < 65_535 else np.int64 for e in self.edges]
        self.steps = [self._tabulate(t) for t in range(spec.n_trees)]

    def _tabulate(self, t: int):
        s = self.spec
        a, b = s.starts[t], s.starts[t + 1]
        feature, threshold, left, right, value = (x[a:b] for x in (s.feature, s.threshold, s.left, s.right, s.value))
        below, order, open_ = {}, [], [(0, False)]
        while open_:                                 # leaves from left to right, leaves below every node
            i, done = open_.pop()
            if feature[i] < 0:
                below[i] = (len(order), len(order) + 1)
                order.append(value[i])
            elif done:
                below[i] = (below[left[i]][0], below[right[i]][1])
            else:
                open_ += [(i, True), (right[i], False), (left[i], False)]
        if len(order) > 64:
            return None, (feature, threshold, left, right, value)
        tables = {}
        for i in np.flatnonzero(feature >= 0):
            lo, hi = below[left[i]]
            cleared = np.uint64(~(((1 << (hi - lo)) - 1) << lo) & (2 ** 64 - 1))
            table = tables.setdefault(int(feature[i]), np.full(len(self.edges[feature[i]]) + 1, 2 ** 64 - 1, np.uint64))
            table[np.searchsorted(self.edges[feature[i]], threshold[i]) + 1:] &= cleared
        values = np.zeros(64)
        for bit, v in enumerate(order):
            values[(self.SEQUENCE << bit & (2 ** 64 - 1)) >> 58] = v
        return tables, values

    def predict(self, columns: list[np.ndarray]) -> np.ndarray:
        n = len(columns[0]) if columns else 0
        out = np.empty(n)
        for a in range(0, n, self.ROWS):
            out[a:a + self.ROWS] = self._some([c[a:a + self.ROWS] for c in columns])
        return out

    def _some(self, columns: list[np.ndarray]) -> np.ndarray:
        s, n = self.spec, len(columns[0])
        codes = [np.searchsorted(e, c, side="left").astype(k) for e, c, k in zip(self.edges, columns, self.small)]
        total, mask, one = np.zeros(n), np.empty(n, np.uint64), np.empty(n, np.uint64)
        for tables, rest in self.steps:
            if tables is None:
                total += self._walk(rest, columns)
                continue
            if not tables:
                total += rest[(self.SEQUENCE & (2 ** 64 - 1)) >> 58]
                continue
            for k, (f, table) in enumerate(tables.items()):
                if k:
                    np.bitwise_and(mask, table[codes[f]], out=mask)
                else:
                    np.take(table, codes[f], out=mask, mode="clip")
            np.negative(mask, out=one)
            np.bitwise_and(mask, one, out=mask)      # the lowest bit alone
            np.multiply(mask, np.uint64(self.SEQUENCE), out=mask)
            np.right_shift(mask, np.uint64(58), out=mask)
            total += rest[mask.astype(np.intp)]
        if s.mean:
            return total / max(s.n_trees, 1) if s.n_trees else np.full(n, s.init)
        return s.init + total

    @staticmethod
    def _walk(tree, columns: list[np.ndarray]) -> np.ndarray:
        feature, threshold, left, right, value = tree
        x, at = np.column_stack(columns), np.zeros(len(columns[0]), dtype=np.int32)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return value[at]
            here = at[inner]
            at[inner] = np.where(x[inner, feature[here]] <= threshold[here], left[here], right[here])


# ---------------------------------------------------------------- binned tables
@dataclass
class Want:
    """What a fit is asked for, in terms of columns."""
    feats: list[str]
    params: Params
    medians: Mapping[str, float] = field(default_factory=dict)
    fold: int | None = None
    transform: str = "none"
    lam: float | None = None
    seed: int = 42
    kind: str = "gbt"


class _Done:
    """Finished trees, the older ones in broadcast pieces that a task reads
    only when it has to catch up with them."""

    def __init__(self, pieces: list, size: int, tail: list[Tree]):
        self.pieces, self.size, self.tail = pieces, size, tail

    def __len__(self) -> int:
        return len(self.pieces) * self.size + len(self.tail)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[j] for j in range(*i.indices(len(self)))]
        i = i + len(self) if i < 0 else i
        piece, at = divmod(i, self.size)
        return self.pieces[piece].value[at] if piece < len(self.pieces) else self.tail[i - len(self.pieces) * self.size]


class TreeTable:
    """A binned table: blocks of codes with target, fold and row hash.

    Cut points are quantiles of a column over all rows (the target has no
    part in them), at most ``bins`` codes a column; a missing value keeps a
    code of its own until a fit fills it with its median.
    """

    def __init__(self, df: DataFrame, feats: Sequence[str], y: str, fold: str | None = None, key: str | None = None,
                 bins: int = 255, written: list | None = None, local_bytes: int = LOCAL_BYTES):
        self.spark, self.feats, self.local_bytes = df.sparkSession, list(feats), local_bytes
        ship_package(self.spark)
        cols = [F.col(f"`{c}`").cast("double") for c in self.feats]
        x = [F.when(~F.isnan(c), c) for c in cols]
        probs = [*[i / bins for i in range(1, bins)], 0.5]
        one = df.agg(*[a for i, c in enumerate(x) for a in (F.max(c).alias(f"m{i}"), F.percentile_approx(
            c, probs, BIN_ACCURACY).alias(f"q{i}"))]).first() if x else {}
        self.cuts = [np.unique([v for v in (one[f"q{i}"] or [])[:-1] if v < one[f"m{i}"]]) for i in range(len(x))]
        self.middle = {c: float(one[f"q{i}"][-1]) if one[f"q{i}"] else 0.0 for i, c in enumerate(self.feats)}
        self.width = max([len(c) + 1 for c in self.cuts], default=1)
        kind = np.uint8 if self.width <= 255 else np.uint16
        missing = int(np.iinfo(kind).max)
        cuts = self.cuts

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, n = [], 0
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                code = np.empty((len(cuts), batch.num_rows), dtype=kind)
                for i, (v, cut) in enumerate(zip(columns[3:], cuts)):
                    v = v.astype(float)
                    code[i] = np.where(np.isnan(v), missing, np.searchsorted(cut, v, side="left"))
                waiting.append((code, columns[0].astype(float), columns[1].astype(np.int32), columns[2].astype(np.int64)))
                n += batch.num_rows
                if n >= BLOCK_ROWS:
                    yield pack(waiting)
                    waiting, n = [], 0
            if waiting:
                yield pack(waiting)

        def pack(waiting) -> pa.RecordBatch:
            code, target, folds, hashes = (np.concatenate(p, axis=-1) for p in zip(*waiting))
            return pa.RecordBatch.from_pydict({
                "codes": [code.tobytes()], "y": [target.tobytes()], "fold": [folds.tobytes()], "hash": [hashes.tobytes()]})

        row = F.xxhash64(F.col(f"`{key}`")) if key else F.xxhash64(F.col(f"`{y}`"), *cols)
        rows = df.where(F.col(f"`{y}`").isNotNull()).select(
            F.col(f"`{y}`").cast("double").alias("y"), (F.col(f"`{fold}`") if fold else F.lit(-1)).cast("int").alias("f"),
            row.alias("h"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
        blocks = rows.mapInArrow(binned, "codes binary, y binary, fold binary, hash binary")
        self.blocks = cut_lineage(blocks.withColumn("id", F.monotonically_increasing_id()), written)
        size = self.blocks.agg(F.sum(F.octet_length("codes") + F.octet_length("y") + F.octet_length("fold")
                                     + F.octet_length("hash")).alias("b")).first()["b"]
        self.bytes = int(size or 0)
        self.kind, self.missing = kind, missing

    def _fits(self, wanted: Mapping[Hashable, Want]) -> tuple[list[Fit], list[Hashable]]:
        """Forests are cut into parts that grow by themselves."""
        fits, names = [], []
        for name, w in wanted.items():
            cols = tuple(self.feats.index(c) for c in w.feats)
            fill = tuple(int(np.searchsorted(self.cuts[i], self._fill(w, c), side="left")) for i, c in zip(cols, w.feats))
            fit = Fit(cols, fill, w.params, w.fold, w.transform, w.lam, w.seed)
            step = PART_TREES if w.params.bag else w.params.rounds
            for a in range(0, max(w.params.rounds, 1), max(step, 1)):
                fits.append(replace(fit, first=a, params=replace(w.params, rounds=min(step, w.params.rounds - a))))
                names.append(name)
        return fits, names

    @property
    def local(self) -> bool:
        """Small enough that fits run side by side, each in a group."""
        return self.bytes <= self.local_bytes

    def _fill(self, w: Want, c: str) -> float:
        """What stands for a missing value: the training set's median, or that
        of all rows where the fit names none."""
        v = w.medians.get(c)
        return self.middle[c] if v is None else float(v)

    def fit(self, wanted: Mapping[Hashable, Want]) -> dict[Hashable, TreeSpec]:
        """{name: fitted ensemble} of all ``wanted``, trained together."""
        fits, names = self._fits(wanted)
        usable = [i for i, f in enumerate(fits) if f.cols]
        done = (self._fit_local if self.local else self._fit_spread)({i: fits[i] for i in usable})
        out = {}
        for name, w in wanted.items():
            parts = [done[i] for i in usable if names[i] == name]
            out[name] = self._spec(w, parts)
        return out

    def _spec(self, w: Want, parts: list[dict]) -> TreeSpec:
        spec = TreeSpec(w.kind, list(w.feats), {c: self._fill(w, c) for c in w.feats}, mean=w.params.bag)
        if not parts:
            return spec
        trees = [t for p in parts for t in p["trees"]]
        cols = [self.feats.index(c) for c in w.feats]
        spec.init, spec.curve, spec.held = parts[0]["init"], parts[0]["curve"], parts[0]["held"]
        spec.starts = np.cumsum([0, *[len(t.value) for t in trees]]).astype(np.int64)
        if trees:
            spec.feature, spec.left, spec.right, spec.value, spec.rows = (
                np.concatenate([getattr(t, k) for t in trees]) for k in ("feature", "left", "right", "value", "rows"))
            spec.threshold = np.concatenate([np.array([self.cuts[cols[f]][c] if f >= 0 else 0.0
                                                       for f, c in zip(t.feature, t.cut)]) for t in trees])
        return spec

    def _reader(self):
        kind, d, missing = self.kind, len(self.feats), self.missing

        def read(codes: bytes, y: bytes, fold: bytes, hash: bytes) -> Block:  # noqa: A002
            target = np.frombuffer(y)
            return Block(np.frombuffer(codes, dtype=kind).reshape(d, len(target)).T, target,
                         np.frombuffer(fold, dtype=np.int32), np.frombuffer(hash, dtype=np.int64).view(np.uint64), missing)

        return read

    def _ensembles(self, fits: dict[int, Fit]) -> dict[int, Ensemble]:
        counts = np.array([len(c) for c in self.cuts])
        return {i: Ensemble(i, f, counts, self.width) for i, f in fits.items()}

    @staticmethod
    def _result(e: Ensemble) -> dict:
        trees = [replace(t, splits=None, reached=None) for t in e.kept()]
        return {"trees": trees, "init": e.init or 0.0, "curve": e.curve, "held": e.held_sums()}

    def _fit_local(self, fits: dict[int, Fit]) -> dict[int, dict]:
        """A group a fit, each with all blocks."""
        if not fits:
            return {}
        ensembles, read, width, result = self._ensembles(fits), self._reader(), self.width, self._result

        def train(group: pa.Table) -> pa.Table:
            i = group["fit"][0].as_py()
            e = ensembles[i]
            run([e], local_ask({i: works_of((read(*r) for r in _at_hand(group)), e.fit)}, width))
            return pa.table({"fit": pa.array([i], pa.int32()), "model": [pickle.dumps(result(e))]})

        each = self.blocks.withColumn("fit", F.explode(F.array(*[F.lit(i) for i in fits])))
        got = (each.repartition(4 * len(fits), "fit").groupBy("fit")
               .applyInArrow(train, "fit int, model binary").collect())
        found = {r["fit"]: pickle.loads(r["model"]) for r in got}
        empty = {"trees": [], "init": 0.0, "curve": [], "held": (0.0, 0.0, 0.0, 0.0)}
        return {i: found.get(i, empty) for i in fits}

    def _fit_spread(self, fits: dict[int, Fit]) -> dict[int, dict]:
        """One job a level for as many fits as a task may hold histograms of
        and as the executors have room to remember."""
        if not fits:
            return {}
        most = max(len(f.cols) * min(f.params.leaves, 64) for f in fits.values()) * self.width * 16
        row = len(self.feats) * np.dtype(self.kind).itemsize
        wave = max(1, min(WAVE_BYTES // most, KEPT_SHARE * (row + BLOCK_EXTRA) // (2 * row + KEPT_EXTRA)))
        ids, out = list(fits), {}
        for a in range(0, len(ids), wave):
            some = self._ensembles({i: fits[i] for i in ids[a:a + wave]})
            jobs = _Jobs(self.blocks, self._reader(), {i: fits[i] for i in some}, self.width)
            try:
                run(some.values(), jobs)
            finally:
                jobs.close()
            out |= {i: self._result(e) for i, e in some.items()}
        return out


class _Jobs:
    """``ask`` by a Spark job over the blocks.  The blocks are dealt once to as
    many tasks as there are cores; what the fits know of them stays in files
    of the executor (``kept``), and ``parts`` names these: a job reads a name
    where Spark remembers it, which is where its files are."""

    def __init__(self, blocks: DataFrame, read, fits: dict[int, Fit], width: int):
        self.blocks, self.read, self.fits, self.width = blocks, read, fits, width
        self.run = uuid.uuid4().hex
        self.tasks = blocks.sparkSession.sparkContext.defaultParallelism
        self.shipped: dict[int, list] = {i: [] for i in fits}
        name = self.run

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, works in _grouped(_works(batches, read, fits)):
                part = hashlib.md5(str(sorted(ids)).encode()).hexdigest()
                for i in fits:
                    _remember(name, part, i, [w[i] for w in works])
                yield pa.RecordBatch.from_pydict({"part": [part], "ids": pa.array([ids], pa.list_(pa.int64()))})

        self.parts = (blocks.repartition(self.tasks).mapInArrow(keep, "part string, ids array<bigint>")
                      .persist(StorageLevel.MEMORY_AND_DISK))

    def close(self) -> None:
        """Remove what was kept, as far as the executors are still there."""
        name = self.run

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept.drop(name)
            yield from ()

        with contextlib.suppress(Exception):
            self.parts.mapInArrow(drop, "part string").collect()
        self.parts.unpersist()

    def _ship(self, a: Ask) -> Ask:
        pieces = self.shipped[a.fit]
        while (len(pieces) + 1) * SHIPPED_TREES < len(a.done):         # the last tree always travels with the job
            some = a.done[len(pieces) * SHIPPED_TREES:(len(pieces) + 1) * SHIPPED_TREES]
            pieces.append(self.blocks.sparkSession.sparkContext.broadcast([replace(t, splits=None, reached=None) for t in some]))
        return replace(a, done=_Done(list(pieces), SHIPPED_TREES, list(a.done[len(pieces) * SHIPPED_TREES:])))

    def __call__(self, asks: list[Ask]) -> dict[int, Told]:
        asks = [self._ship(a) for a in asks]
        read, fits, width, name = self.read, self.fits, self.width, self.run

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for row in (r for batch in batches for r in batch.to_pylist()):
                told = {a.fit: _recall(name, row["part"], a, width) for a in asks}
                if None in told.values():
                    told = {MISSING: row["ids"]}
                _add(total, told)
            yield from _packed(total)

        def answer_anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for _, works in _works(batches, read, {a.fit: fits[a.fit] for a in asks}):
                for a in asks:
                    _add(total, {a.fit: works[a.fit].answer(a, width)})
            yield from _packed(total)

        total = self._collect(self.parts.mapInArrow(answer, "fit int, told binary"))
        if missed := total.pop(MISSING, None):           # run elsewhere than where its files are
            rest = self.blocks.where(F.col("id").isin(missed))
            _add(total, self._collect(rest.mapInArrow(answer_anew, "fit int, told binary")))
        return {i: total.get(i, Told(None)) for i in fits}

    def _collect(self, sums: DataFrame) -> dict:
        if self.tasks > DIRECT_TASKS:                # as a tree: the square root of the tasks adds up first
            sums = sums.repartition(math.isqrt(self.tasks)).mapInArrow(_added, "fit int, told binary")
        total: dict = {}
        for r in sums.collect():
            _add(total, {r["fit"]: pickle.loads(r["told"])})
        return total


def _works(batches: Iterator[pa.RecordBatch], read, fits: Mapping[int, Fit]) -> Iterator[tuple[int, dict[int, BlockWork]]]:
    """(id, work of every fit) of each block."""
    for batch in batches:
        for i, number in enumerate(batch.column("id").to_pylist()):
            block = read(*[batch.column(c)[i].as_py() for c in ("codes", "y", "fold", "hash")])
            yield number, {k: BlockWork(block, fit) for k, fit in fits.items()}


def _grouped(works: Iterator[tuple]) -> Iterator[tuple[list, list]]:
    """``KEPT_BLOCKS`` blocks at a time."""
    while some := list(itertools.islice(works, KEPT_BLOCKS)):
        ids, each = zip(*some)
        yield list(ids), list(each)


def _remember(run: str, part: str, fit: int, works: list[BlockWork]) -> None:
    """A new part: its works, without what another attempt left of them."""
    for kind in ("trees", "rows"):
        with contextlib.suppress(FileNotFoundError):
            os.remove(kept.place(run, f"{part}-{fit}.{kind}"))
    kept.write(kept.place(run, f"{part}-{fit}.works"), works)


def _recall(run: str, part: str, ask: Ask, width: int) -> Told | None:
    """What the works of a part answer, None where they are not found."""
    at = {kind: kept.place(run, f"{part}-{ask.fit}.{kind}") for kind in ("works", "trees", "rows")}
    works = kept.read(at["works"])
    if works is None:
        return None
    before = None
    if scores := kept.read(at["trees"]):
        before = scores[0][0]
        for work, s, p in zip(works, scores, kept.read(at["rows"]) or itertools.repeat(None)):
            work.resume(s, p)
    total = None
    for work in works:
        t = work.answer(ask, width)
        total = t if total is None else total + t
    begun = works[0].number is not None and works[0].number != before
    if begun:
        kept.write(at["trees"], [w.scores() for w in works])
    if begun or sum(w.moved for w in works) > sum(len(w.y) for w in works) // MOVED_SHARE:
        kept.write(at["rows"], [w.places() for w in works])        # few moved rows follow their splits again instead
    return total


def _add(total: dict, more: Mapping) -> None:
    for i, t in more.items():
        total[i] = total[i] + t if i in total else t


def _at_hand(group: pa.Table) -> Iterator[tuple]:
    """(codes, y, fold, hash) of every block by id, as views of the group."""
    parts = [b.columns for b in group.select(["id", "codes", "y", "fold", "hash"]).to_batches()]
    spots = sorted((v, p, i) for p, part in enumerate(parts) for i, v in enumerate(part[0].to_pylist()))
    for _, p, i in spots:
        yield tuple(_view(c, i) for c in parts[p][1:])


def _view(column: pa.Array, i: int) -> pa.Buffer:
    """A binary value without a copy."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    a, b = np.frombuffer(offsets, dtype=kind)[column.offset + i:column.offset + i + 2]
    return data.slice(int(a), int(b - a))


def _packed(total: dict) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_pydict({"fit": pa.array(list(total), pa.int32()),
                                          "told": [pickle.dumps(t) for t in total.values()]})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict = {}
    for row in (r for batch in batches for r in batch.to_pylist()):
        _add(total, {row["fit"]: pickle.loads(row["told"])})
    yield from _packed(total)


def fit_trees(df: DataFrame, feats: Sequence[str], y: str, kind: str = "gbt", medians: dict | None = None,
              params: Params | None = None, fold: str | None = None, folds: Sequence[int | None] = (None,),
              key: str | None = None, seed: int = 42) -> TreeSpec | dict:
    """M03-M06.  One ensemble over all rows, or with ``folds`` a dict of one
    per fold that it must not see (None: all rows)."""
    params = params or KINDS[kind]
    table = TreeTable(df, feats, y, fold, key, bins=params.bins)
    got = table.fit({f: Want(list(feats), params, medians or {}, f, seed=seed, kind=kind) for f in folds})
    return got[None] if tuple(folds) == (None,) else got


# ---------------------------------------------------------------- S07 / M13
NODE_SCHEMA = ("tree int, node int, feature string, threshold double, `left` int, `right` int, value double, rows double")


def node_rows(spec: TreeSpec) -> pd.DataFrame:
    """The node table: inner nodes name a column, leaves do not."""
    tree = np.repeat(np.arange(spec.n_trees), np.diff(spec.starts))
    inner = spec.feature >= 0
    names = np.array([*spec.feats, None], dtype=object)[np.where(inner, spec.feature, -1)]
    return pd.DataFrame({"tree": tree, "node": np.arange(len(tree)) - spec.starts[tree] if len(tree) else tree,
                         "feature": names, "threshold": np.where(inner, spec.threshold, np.nan), "left": spec.left,
                         "right": spec.right, "value": spec.value, "rows": spec.rows})


def node_table(spec: TreeSpec, spark) -> DataFrame:
    """The nodes as a DataFrame."""
    nodes = node_rows(spec)
    if not len(nodes):
        return spark.createDataFrame([], NODE_SCHEMA)
    rows = nodes.astype(object).where(nodes.notna(), None)
    return spark.createDataFrame([tuple(r) for r in rows.itertuples(index=False)], NODE_SCHEMA)


def spec_from_nodes(nodes: pd.DataFrame, **of) -> TreeSpec:
    """The ensemble that a node table holds."""
    nodes = nodes.sort_values(["tree", "node"])
    spec = TreeSpec(**of)
    at = {c: i for i, c in enumerate(spec.feats)}
    spec.starts = np.concatenate([[0], np.cumsum(nodes.groupby("tree").size())]).astype(np.int64)
    spec.feature = np.array([at.get(c, -1) for c in nodes["feature"]], dtype=np.int32)
    spec.threshold = nodes["threshold"].fillna(0.0).to_numpy(dtype=float)
    spec.left, spec.right = (nodes[c].to_numpy(dtype=np.int32) for c in ("left", "right"))
    spec.value, spec.rows = (nodes[c].to_numpy(dtype=float) for c in ("value", "rows"))
    return spec


def split_counts(spec: TreeSpec) -> dict[str, float]:
    """Number of splits by column, in column order."""
    n = np.bincount(spec.feature[spec.feature >= 0], minlength=len(spec.feats))
    return {c: float(k) for c, k in zip(spec.feats, n)}


def split_importance(spec: TreeSpec, spark) -> DataFrame:
    """Number of splits per feature as a percent of all splits."""
    n = split_counts(spec)
    total = max(sum(n.values()), 1.0)
    return spark.createDataFrame([(c, v, v / total * 100.0) for c, v in n.items()],
                                 "feature string, importance double, pct double")


def used_columns(feats: Sequence[str], counts: Mapping[str, float]) -> list[str]:
    """The columns that a probe splits on; all when fewer than two."""
    kept = [c for c in feats if counts.get(c, 0) > 0]
    return kept if len(kept) >= 2 else list(feats)


def screen_features(df: DataFrame, feats: Sequence[str], y: str, medians: dict | None = None,
                    rounds: int = PROBE_ITER, key: str | None = None) -> list[str]:
    """Keep features with split importance > 0 from a boosted probe
    of ``rounds`` rounds; skipped at <= 10 features; keep all when fewer than 2 survive."""
    if len(feats) <= SCREEN_MIN_FEATURES:
        return list(feats)
    return used_columns(feats, split_counts(fit_trees(df, feats, y, "gbt", medians, replace(PROBE, rounds=rounds), key=key)))
