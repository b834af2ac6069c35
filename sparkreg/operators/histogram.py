"""Histogram tree growing: the numeric core of boosted and bagged trees.

``Ensemble`` decides (which tree, which nodes, which splits) and is only told
sums over rows; ``BlockWork`` makes those sums for one block of binned rows.
The two meet through ``ask``: a Spark job that adds up the blocks of a large
table, or a plain loop over the blocks of a small one inside a task.

A tree grows leaf by leaf, best gain first.  To find that order in few
passes, every leaf that the order could still split is examined at once; the
order is then replayed on what is known, until it needs nothing new.  What
was examined in vain is dropped, so the tree is the one that splitting leaf
by leaf would give.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd

ES_SHARE = 0.1                 # training rows held out for the stop
ES_MIN_ROWS = 20               # below this all rows train and nothing stops the rounds
MIN_LEAF_SHARE = 30            # a leaf holds at least max(3, rows / 30) unless told otherwise
NO_GAIN = -np.inf
JOINT_CODES = 512              # combinations of codes up to which columns are counted together
CELL_ROWS, CELL_SHARE = 1 << 18, 8     # from so many rows on, if there are so many a combination of codes, one stands for all
CHUNK_ROWS = 1 << 16           # rows summed at once


@dataclass(frozen=True)
class Params:
    """Settings of an ensemble.  Fixed values: the defaults of a boosted
    model."""
    rounds: int = 500
    leaves: int = 31
    rate: float = 0.05
    min_leaf: int | None = None
    rows: float = 0.8              # share of the rows a tree sees
    cols: float = 0.8              # share of the columns
    l1: float = 0.1
    l2: float = 1.0
    bins: int = 255
    random_cuts: bool = False      # one drawn threshold a node and column
    patience: int = 0              # rounds without gain on the holdout; 0: all rounds
    bag: bool = False              # independent trees, averaged


@dataclass(frozen=True)
class Fit:
    """One training set and its settings.  ``fold`` is the fold it must not
    see (None: all rows train); ``cols`` index the columns of the table."""
    cols: tuple[int, ...]
    fill: tuple[int, ...]          # the code a missing value gets, per column
    params: Params = Params()
    fold: int | None = None
    transform: str = "none"        # of the target
    lam: float | None = None
    seed: int = 42
    first: int = 0                 # number of the first tree (parts of a forest)


@dataclass
class Tree:
    """Nodes by number; an inner node sends codes up to ``cut`` left."""
    feature: np.ndarray            # index into the fit's columns, -1 at leaves
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    splits: list | None = None     # while it grew: all splits that were examined,
    reached: np.ndarray | None = None      # and the value of the leaf that each examined node lies in


@dataclass
class Ask:
    """What an ensemble wants to know: histograms of ``nodes`` of the tree
    ``number``, whose splits so far are ``splits``."""
    fit: int
    number: int
    splits: list                   # (node, feature, cut, left, right)
    nodes: list[int]
    columns: np.ndarray            # the tree's columns, as indices into the fit's
    done: list = field(default_factory=list)       # finished trees (None where they do not matter)
    init: float | None = None      # the constant the ensemble starts from; None: only row and target sums
    holdout: bool = True


@dataclass
class Told:
    """Sums over rows.  ``hist`` is (nodes, columns, codes, 2): rows and
    gradients."""
    hist: np.ndarray | None
    n: float = 0.0                 # training rows, and the sum of their targets
    total: float = 0.0
    es: tuple[float, float] = (0.0, 0.0)           # holdout rows, squared error
    held: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)   # unseen rows: n, y - c, its square, squared error

    def __add__(self, o: "Told") -> "Told":
        both = self.hist if o.hist is None else o.hist if self.hist is None else self.hist + o.hist
        return Told(both, self.n + o.n, self.total + o.total, tuple(a + b for a, b in zip(self.es, o.es)),
                    tuple(a + b for a, b in zip(self.held, o.held)))


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for every 64-bit value (splitmix64)."""
    return (spread(x, salt) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def draw(mixed: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for every value that ``spread`` has mixed already:
    one odd multiplier a salt."""
    odd = (salt * 0x9E3779B97F4A7C15 | 1) & (2 ** 64 - 1)
    with np.errstate(over="ignore"):
        return ((mixed * np.uint64(odd)) >> np.uint64(32)).astype(np.float32) * np.float32(2.0 ** -32)


def spread(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of every value."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2 ** 64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _salt(*what: int) -> int:
    out = 0
    for w in what:
        out = (out * 1_000_003 + int(w) + 1) & (2 ** 62 - 1)
    return out


def forward_target(y: np.ndarray, how: str, lam: float | None) -> np.ndarray:
    if how == "log1p":
        return np.log1p(y)
    if how != "yeo_johnson":
        return y
    up, down = y >= 0, y < 0
    out = np.empty_like(y, dtype=float)
    out[up] = np.log1p(y[up]) if abs(lam) < 1e-6 else (np.power(y[up] + 1, lam) - 1) / lam
    out[down] = -np.log1p(-y[down]) if abs(lam - 2) < 1e-6 else -(np.power(1 - y[down], 2 - lam) - 1) / (2 - lam)
    return out


def inverse_target(t: np.ndarray, how: str, lam: float | None) -> np.ndarray:
    if how == "log1p":
        return np.expm1(t)
    if how != "yeo_johnson":
        return t
    up, down = t >= 0, t < 0
    out = np.empty_like(t, dtype=float)
    out[up] = np.expm1(t[up]) if abs(lam) < 1e-6 else np.power(np.maximum(lam * t[up] + 1, 1e-12), 1 / lam) - 1
    out[down] = -np.expm1(-t[down]) if abs(lam - 2) < 1e-6 else \
        1 - np.power(np.maximum(1 - (2 - lam) * t[down], 1e-12), 1 / (2 - lam))
    return out


def centre(fit: Fit, init: float) -> float:
    """What the targets of the unseen rows are summed about."""
    c = float(inverse_target(np.array([init]), fit.transform, fit.lam)[0])
    return c if np.isfinite(c) else 0.0


def pooled_r2(held: Iterable[tuple]) -> float:
    """R2 over the union of unseen folds, each (rows, mean, squares about the
    mean, squared error)."""
    held = [h for h in held if h[0]]
    n = sum(h[0] for h in held)
    if not n:
        return float("nan")
    mean = sum(h[0] * h[1] for h in held) / n
    sst = sum(h[2] + h[0] * (h[1] - mean) ** 2 for h in held)
    sse = sum(h[3] for h in held)
    return float(1 - sse / sst) if sst > 0 else (1.0 if sse == 0 else 0.0)


# ---------------------------------------------------------------- rows
@dataclass
class Block:
    """Binned rows: codes (rows x columns), target, fold, row hash."""
    codes: np.ndarray              # a column's codes lie together
    y: np.ndarray
    fold: np.ndarray
    hash: np.ndarray
    missing: int


@lru_cache(maxsize=256)
def _parts(sizes: tuple[int, ...]) -> np.ndarray:
    """1 where a combination of codes (rows) holds a column's code (the
    columns' codes one after another): counts of combinations times this are
    the counts of every column."""
    spots = np.indices(sizes).reshape(len(sizes), -1)
    return np.concatenate([(spot[:, None] == np.arange(k)) for spot, k in zip(spots, sizes)], axis=1).astype(float)


class BlockWork:
    """What one fit knows of one block.  Everything here follows from the
    block and the trees, so it can be made anew at any time."""

    def __init__(self, block: Block, fit: Fit):
        self.fit, p = fit, fit.params
        self.codes, self.cols = block.codes, np.asarray(fit.cols, dtype=np.int64)
        if (gap := block.codes[:, self.cols] == block.missing).any():
            self.codes = np.asfortranarray(
                np.where(gap, np.asarray(fit.fill, dtype=block.codes.dtype)[None, :], block.codes[:, self.cols]))
            self.cols = np.arange(len(self.cols))
        self.raw, self.hash = block.y, spread(block.hash, _salt(fit.seed, 5)) if p.rows < 1 else None
        self.y = forward_target(block.y, fit.transform, fit.lam)
        seen = np.ones(len(self.y), bool) if fit.fold is None else block.fold != fit.fold
        self.es = seen & (mix(block.hash, _salt(fit.seed, 7, -1 if fit.fold is None else fit.fold)) < ES_SHARE) \
            if p.patience else np.zeros(len(self.y), bool)
        self.train, self.held = seen & ~self.es, np.flatnonzero(~seen)
        self.score, self.trees = None, 0
        self.number, self.rows = None, {}
        self.known = 0                               # splits of the tree that the rows have followed
        self.moved = 0                               # rows that have followed one since the work was made or taken up
        self.joint, self.packed = self._joint(), self._pack()

    def scores(self) -> tuple:
        """What changes with every tree."""
        return self.number, self.score, self.trees

    def places(self) -> tuple:
        """What changes with every level."""
        return self.number, self.rows, self.known

    def resume(self, scores: tuple, places: tuple | None) -> None:
        """Go on from what ``scores`` and ``places`` gave; without places of
        the same tree the rows start at its root again."""
        number, self.score, self.trees = scores
        if places and places[0] == number:
            self.number, self.rows, self.known = places
            self.miss = None

    def _gap(self, rows: np.ndarray) -> np.ndarray:
        """Score less target of some rows."""
        return self.score[rows] - self.y[rows] if self.miss is None else self.miss[rows]

    def _joint(self) -> list[tuple]:
        """Columns of few codes whose combinations are counted instead of each
        column: ({column of the fit: its first place among the parts}, codes
        of each, combination of every row).  Counts are whole numbers, so they
        come out the same; sums of gradients keep their order of rows."""
        out, group, sizes = [], [], []

        def close():
            if len(group) > 1:
                spot = np.zeros(len(self.y), np.uint16)
                for j, k in zip(group, sizes):
                    spot *= np.uint16(k)
                    spot += self.codes[:, self.cols[j]]
                out.append((dict(zip(group, np.cumsum([0, *sizes]).tolist())), tuple(sizes), spot))

        most = [int(self.codes[:, c].max(initial=0)) + 1 for c in self.cols]
        for j in sorted(range(len(most)), key=lambda j: most[j]):
            if most[j] * math.prod(sizes) > JOINT_CODES:
                close()
                group, sizes = [], []
            group.append(j)
            sizes.append(most[j])
        close()
        return out

    def _pack(self) -> list[np.ndarray]:
        """The fit's codes, eight bytes of a row in one number: one look-up
        then brings the codes of several columns."""
        per = 8 // self.codes.itemsize
        out = []
        for a in range(0, len(self.cols), per):
            some = np.zeros((len(self.y), per), self.codes.dtype)
            for i, c in enumerate(self.cols[a:a + per]):
                some[:, i] = self.codes[:, c]
            out.append(some.view(np.uint64).ravel())
        return out

    def _follow(self, splits: list) -> None:
        for node, f, cut, left, right in splits:
            code, kids = self.codes[:, self.cols[f]], []
            for mine in self.rows.pop(node):
                self.moved += len(mine)
                low = code[mine] <= cut
                kids.append((mine.compress(low), mine.compress(~low)))
            self.rows[left], self.rows[right] = zip(*kids)

    def _begin(self, ask: Ask) -> None:
        """The rows at the root of the next tree, with the scores so far."""
        p = self.fit.params
        self._advance(ask)
        self.miss = self.score - self.y
        drawn = self.train
        if p.rows < 1:
            drawn = self.train & (draw(self.hash, self._draw_salt(ask)) < p.rows)
        # of every node: the rows that the tree sees, and the others
        self.number, self.known, self.rows = ask.number, 0, {0: (np.flatnonzero(drawn), np.flatnonzero(~drawn))}

    def _draw_salt(self, ask: Ask) -> int:
        return _salt(self.fit.seed, 11, self.fit.first + ask.number)

    def _advance(self, ask: Ask) -> None:
        """The scores after all finished trees."""
        if self.score is None:
            self.score = np.full(len(self.codes), ask.init)
        if not self.fit.params.bag:
            if self.trees == len(ask.done) - 1 == self.number:          # the rows are still in the last tree
                last, step = ask.done[-1], np.zeros(len(self.codes))
                self._follow(last.splits[self.known:])
                for node, parts in self.rows.items():
                    for mine in parts:
                        step[mine] = last.reached[node]
                self.score += step
            else:
                for tree in ask.done[self.trees:]:
                    self.score += tree.value[self._walk(tree)]
            self.trees = len(ask.done)

    def _walk(self, tree: Tree) -> np.ndarray:
        at = np.zeros(len(self.codes), dtype=np.int32)
        while True:
            f = tree.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            here = at[inner]
            left = self.codes[inner, self.cols[f[inner]]] <= tree.cut[here]
            at[inner] = np.where(left, tree.left[here], tree.right[here])

    def answer(self, ask: Ask, width: int) -> Told:
        if ask.init is None:
            t, e = self.y[self.train], self.y[self.es]
            return Told(None, float(len(t)), float(t.sum()), (float(len(e)), float(e.sum())))
        if not ask.holdout and self.es.any():        # too few rows to hold any out
            self.train, self.es = self.train | self.es, np.zeros(len(self.y), bool)
        told = Told(None)
        if self.number != ask.number:
            self._begin(ask)
        self._follow(ask.splits[self.known:])
        self.known = len(ask.splits)
        if ask.nodes == [0]:                         # a new tree: how good are the last ones
            miss = self._gap(self.es)
            told.es = (float(len(miss)), float(miss @ miss))
            if len(self.held):
                y = self.raw[self.held]
                gap = inverse_target(self.score[self.held], self.fit.transform, self.fit.lam) - y
                y = y - centre(self.fit, ask.init)
                told.held = (float(len(y)), float(y.sum()), float(y @ y), float(gap @ gap))
        parts = [self.rows[node][0] for node in ask.nodes]
        rows = np.concatenate(parts) if len(parts) > 1 else parts[0]
        k, miss = len(ask.nodes), self._gap(rows)
        node = np.repeat(np.arange(k), [len(x) for x in parts]) if k > 1 else None
        told.hist = np.empty((k, len(ask.columns), width, 2))
        counted = self._counts(ask.columns, rows, node, k, told.hist)
        place = node * width if k > 1 else None
        per, group, codes = 8 // self.codes.itemsize, -1, None
        for j, c in enumerate(ask.columns.tolist()):
            if c // per != group:
                group = c // per
                codes = self.packed[group][rows].view(self.codes.dtype).reshape(-1, per)
            spot = codes[:, c % per].astype(np.intp)
            if k > 1:
                spot += place
            if j not in counted:
                told.hist[:, j, :, 0] = np.bincount(spot, minlength=k * width).reshape(k, width)
            told.hist[:, j, :, 1] = np.bincount(spot, weights=miss, minlength=k * width).reshape(k, width)
        return told

    def _counts(self, columns: np.ndarray, rows: np.ndarray, node: np.ndarray | None, k: int, hist: np.ndarray) -> set[int]:
        """Rows by code of the columns that are counted together, written into
        ``hist``; returns their places."""
        done: set[int] = set()
        for first, sizes, joint in self.joint:
            mine = [(j, first[c], sizes[list(first).index(c)]) for j, c in enumerate(columns.tolist()) if c in first]
            some = math.prod(sizes)
            if (len(mine) - 1) * len(rows) < 4 * k * some + 10_000:      # counting them one by one is as fast
                continue
            spot = joint[rows].astype(np.intp)
            if node is not None:
                spot += node * some
            each = np.bincount(spot, minlength=k * some).reshape(k, some) @ _parts(sizes)
            for j, a, n in mine:
                hist[:, j, :n, 0], hist[:, j, n:, 0] = each[:, a:a + n], 0.0
            done |= {j for j, _, _ in mine}
        return done


@dataclass
class _Sums:
    """Rows, mean and squares about the mean of a value, by cell."""
    n: np.ndarray
    mean: np.ndarray
    rest: float                    # squares about the means of the cells, all cells together

    @classmethod
    def of(cls, spot: np.ndarray, v: np.ndarray, cells: int) -> "_Sums":
        n = np.bincount(spot, minlength=cells).astype(float)
        mean = np.bincount(spot, weights=v, minlength=cells) / np.maximum(n, 1.0)
        gap = v - mean[spot]
        return cls(n, mean, float(gap @ gap))

    def total(self, about=0.0) -> float:
        return float(self.n @ (self.mean - about))

    def squares(self, about) -> float:
        """Squares about one value, or about one a cell."""
        gap = self.mean - about
        return float(self.n @ (gap * gap)) + self.rest


class CellWork(BlockWork):
    """What one fit knows of blocks in which many rows share all codes (a
    cell).  Such rows have one score and one leaf, so a tree needs of a cell
    only its rows and the sum of their targets: these are summed once a tree
    over the rows that it sees, and all else is done by cell.  The sums are
    those of ``BlockWork`` up to the order of adding."""

    def __init__(self, blocks: list[Block], fit: Fit, codes: np.ndarray, spot: np.ndarray):
        self.fit, p, m = fit, fit.params, len(codes)
        self.codes, self.cols = codes, np.arange(len(fit.cols))
        raw, folds, hashes = (np.concatenate([getattr(b, k) for b in blocks]) for k in ("y", "fold", "hash"))
        y = forward_target(raw, fit.transform, fit.lam)
        seen = np.ones(len(y), bool) if fit.fold is None else folds != fit.fold
        es = np.zeros(len(y), bool)
        if p.patience:
            es = seen & (mix(hashes, _salt(fit.seed, 7, -1 if fit.fold is None else fit.fold)) < ES_SHARE)
        self.es, self.held = _Sums.of(spot[es], y[es], m), _Sums.of(spot[~seen], raw[~seen], m)
        train = np.flatnonzero(seen & ~es)
        train = train[np.argsort(spot[train], kind="stable")]           # rows of a cell lie together
        self.y = y[train]
        self.hash = spread(hashes[train], _salt(fit.seed, 5)) if p.rows < 1 else None
        self.have, self.first = np.unique(spot[train], return_index=True)
        cuts = np.unique(np.searchsorted(self.first, np.arange(0, len(train), CHUNK_ROWS)))
        cuts = cuts[cuts < len(self.have)]           # no cell begins after a chunk's start in the last one
        self.chunks = list(zip(cuts, [*cuts[1:], len(self.have)]))
        self.every = self._summed(None)
        self.score, self.trees, self.number, self.rows, self.known, self.moved = None, 0, None, {}, 0, 0

    def _summed(self, salt: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sum of targets of every cell, over the training rows that
        a draw takes (None: all)."""
        n, total = np.zeros(len(self.codes)), np.zeros(len(self.codes))
        for a, b in self.chunks:
            lo, hi = self.first[a], self.first[b] if b < len(self.first) else len(self.y)
            if lo == hi:
                continue
            y, at, cells = self.y[lo:hi], self.first[a:b] - lo, self.have[a:b]
            drawn = np.ones(hi - lo) if salt is None else (draw(self.hash[lo:hi], salt) < self.fit.params.rows).astype(float)
            n[cells] = np.add.reduceat(drawn, at)
            drawn *= y
            total[cells] = np.add.reduceat(drawn, at)
        return n, total

    def _begin(self, ask: Ask) -> None:
        self._advance(ask)
        self.n, total = self.every if self.fit.params.rows >= 1 else self._summed(self._draw_salt(ask))
        self.miss = self.n * self.score - total
        self.number, self.known, self.rows = ask.number, 0, {0: (np.arange(len(self.codes)),)}

    def answer(self, ask: Ask, width: int) -> Told:
        if ask.init is None:
            return Told(None, float(self.every[0].sum()), float(self.every[1].sum()),
                        (float(self.es.n.sum()), self.es.total()))
        told = Told(None)
        if self.number != ask.number:
            self._begin(ask)
        self._follow(ask.splits[self.known:])
        self.known = len(ask.splits)
        if ask.nodes == [0]:
            told.es = (float(self.es.n.sum()), self.es.squares(self.score))
            if n := float(self.held.n.sum()):
                c = centre(self.fit, ask.init)
                guess = inverse_target(self.score, self.fit.transform, self.fit.lam)
                told.held = (n, self.held.total(c), self.held.squares(c), self.held.squares(guess))
        parts, k = [self.rows[node][0] for node in ask.nodes], len(ask.nodes)
        cells = np.concatenate(parts)
        place = np.repeat(np.arange(k) * width, [len(x) for x in parts])
        n, miss = self.n[cells], self.miss[cells]
        told.hist = np.empty((k, len(ask.columns), width, 2))
        for j, c in enumerate(ask.columns.tolist()):
            spot = place + self.codes[cells, c]
            told.hist[:, j, :, 0] = np.bincount(spot, weights=n, minlength=k * width).reshape(k, width)
            told.hist[:, j, :, 1] = np.bincount(spot, weights=miss, minlength=k * width).reshape(k, width)
        return told


def works_of(blocks: Iterable[Block], fit: Fit) -> list[BlockWork]:
    """The works of a fit that has all its blocks at hand: by cell where rows
    are many and share their codes, else by row."""
    blocks = list(blocks)
    rows = sum(len(b.y) for b in blocks)
    if rows >= CELL_ROWS and (found := _cells(blocks, fit, rows // CELL_SHARE)):
        return [CellWork(blocks, fit, *found)]
    return [BlockWork(b, fit) for b in blocks]


def _cells(blocks: list[Block], fit: Fit, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(codes of every cell, the cell of every row); None above ``most``
    cells, or where a fit sees so few rows that none are held out."""
    if fit.fold is not None and sum(int((b.fold != fit.fold).sum()) for b in blocks) < ES_MIN_ROWS:
        return None
    spot, filled = np.zeros(sum(len(b.y) for b in blocks), np.int64), []
    per = 8 // blocks[0].codes.itemsize
    for a in range(0, len(fit.cols), per):
        packed = []
        for b in blocks:
            some = np.zeros((len(b.y), per), b.codes.dtype)
            for i, (c, v) in enumerate(zip(fit.cols[a:a + per], fit.fill[a:a + per])):
                code = b.codes[:, c]
                some[:, i] = np.where(code == b.missing, np.asarray(v, code.dtype), code)
            packed.append(some.view(np.uint64).ravel())
        own, values = pd.factorize(np.concatenate(packed))
        spot, both = pd.factorize(spot * len(values) + own)
        if len(both) > most:
            return None
        filled = [f[both // len(values)] for f in filled] + [values[both % len(values)]]
    codes = np.concatenate([f.view(blocks[0].codes.dtype).reshape(-1, per) for f in filled], axis=1)
    return np.asfortranarray(codes[:, :len(fit.cols)]), spot


# ---------------------------------------------------------------- decisions
@dataclass
class _Node:
    rows: float
    grad: float
    hist: np.ndarray | None = None
    gain: float | None = None      # None: not examined yet
    feature: int = -1
    cut: int = -1
    kids: tuple[int, int] | None = None
    sums: tuple | None = None      # (rows, grad) of the left part


def _soft(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


class _Growth:
    """One tree from its first histogram to its last split."""

    def __init__(self, fit: Fit, number: int, min_leaf: float, allowed: np.ndarray, seed: int):
        self.p, self.fit, self.min_leaf, self.allowed = fit.params, fit, max(1.0, min_leaf), allowed
        d = len(fit.cols)
        take = max(1, int(round(self.p.cols * d)))
        order = np.argsort(mix(np.arange(d), _salt(seed, 13, number)), kind="stable")
        self.columns = np.sort(order[:take])
        self.salt = _salt(seed, 17, number)
        self.nodes: list[_Node] = []
        self.splits: list = []
        self.wanted: list[int] = []      # nodes asked for; their siblings come by subtraction

    def begin(self) -> list[int]:
        self.wanted = [0]
        return [0]

    def receive(self, hist: np.ndarray) -> list[int] | None:
        """Take the histograms asked for; the next ones to ask for, or None
        when the tree is complete."""
        if not self.nodes:
            rows, grad = hist[0, 0].sum(axis=0)
            self.nodes.append(_Node(rows, grad))
            found = {0: hist[0]}
        else:
            found = {}
            for node, h in zip(self.wanted, hist):
                mother, other = self.families[node]
                found[node], found[other] = h, self.nodes[mother].hist - h
                found[other][..., 1][found[other][..., 0] == 0] = 0.0      # no rows, no rest of a subtraction
                self.nodes[mother].hist = None
        self._examine(found)
        return self._next()

    def _examine(self, found: dict[int, np.ndarray]) -> None:
        """The best split of every node, all of them at once."""
        ids = list(found)
        for i in ids:
            self.nodes[i].gain = NO_GAIN
        ids = [i for i in ids if self.nodes[i].rows >= 2 * self.min_leaf]
        if not ids:
            return
        h = np.stack([found[i] for i in ids])
        up = np.cumsum(h, axis=2)
        rows, grad = up[..., 0], up[..., 1]
        all_rows, all_grad = rows[:, :1, -1:], grad[:, :1, -1:]
        l1, l2 = self.p.l1, self.p.l2
        right = all_rows - rows
        ok = (rows >= self.min_leaf) & (right >= self.min_leaf) & self.allowed[self.columns][None]
        if self.p.random_cuts:
            ok &= self._drawn_cuts(ids, h[..., 0])
        gain = (_soft(grad, l1) ** 2 / (rows + l2 + 1e-300) + _soft(all_grad - grad, l1) ** 2 / (right + l2 + 1e-300)
                - _soft(all_grad, l1) ** 2 / (all_rows + l2 + 1e-300))
        gain = np.where(ok, gain, NO_GAIN).reshape(len(ids), -1)
        best = gain.argmax(axis=1)
        width = h.shape[2]
        for j, i in enumerate(ids):
            g = gain[j, best[j]]
            c, cut = divmod(int(best[j]), width)
            node = self.nodes[i]
            if g > 1e-12 * (1.0 + abs(node.grad)):
                node.gain, node.feature, node.cut = float(g), int(self.columns[c]), cut
                node.sums, node.hist = (float(rows[j, c, cut]), float(grad[j, c, cut])), found[i]

    def _drawn_cuts(self, ids: list[int], rows: np.ndarray) -> np.ndarray:
        """One cut a node and column, drawn between its lowest and highest
        code."""
        some = rows > 0
        width = rows.shape[2]
        lo = some.argmax(axis=2)
        hi = width - 1 - some[:, :, ::-1].argmax(axis=2)
        key = np.array(ids)[:, None] * 65_536 + self.columns[None, :]
        cut = lo + np.floor(mix(key, self.salt) * (hi - lo)).astype(np.int64)
        return np.arange(width)[None, None, :] == cut[:, :, None]

    def _order(self) -> tuple[list[int], list[int]]:
        """Best-first on what is known: (nodes split, those among them that
        have no children yet)."""
        heap = [(-self.nodes[0].gain, 0)]
        taken, new = [], []
        while heap and len(taken) < self.p.leaves - 1:
            gain, i = heapq.heappop(heap)
            if gain == -NO_GAIN:
                break
            taken.append(i)
            if self.nodes[i].kids is None:
                new.append(i)
            else:
                for c in self.nodes[i].kids:
                    heapq.heappush(heap, (-self.nodes[c].gain, c))
        return taken, new

    def _next(self) -> list[int] | None:
        while True:
            taken, new = self._order()
            last = len(taken) == self.p.leaves - 1 and new == taken[-1:]      # its children change nothing
            self.families, self.wanted = {}, []
            for i in new:
                node = self.nodes[i]
                rows, grad = node.sums
                a, b = len(self.nodes), len(self.nodes) + 1
                self.nodes += [_Node(rows, grad), _Node(node.rows - rows, node.grad - grad)]
                node.kids = (a, b)
                self.splits.append((i, node.feature, node.cut, a, b))
                if last or max(rows, node.rows - rows) < 2 * self.min_leaf:   # or neither can be split
                    self.nodes[a].gain = self.nodes[b].gain = NO_GAIN
                    node.hist = None
                    continue
                small, big = (a, b) if rows <= node.rows - rows else (b, a)
                self.families[small] = (i, big)
                self.wanted.append(small)
            if self.wanted:
                return self.wanted
            if not new or last:
                self.taken = taken
                return None

    def tree(self, scale: float, shift: float = 0.0) -> Tree:
        """The tree of the chosen splits, nodes renumbered from the root."""
        chosen, spots, order = set(self.taken), {}, []
        open_ = [0]
        while open_:
            i = open_.pop()
            spots[i] = len(order)
            order.append(i)
            if i in chosen:
                open_ += [self.nodes[i].kids[1], self.nodes[i].kids[0]]
        pick = [self.nodes[i] for i in order]
        inner = [i in chosen for i in order]
        value = np.array([-_soft(n.grad, self.p.l1) / (n.rows + self.p.l2 + 1e-300) for n in pick]) * scale + shift
        out = Tree(np.array([n.feature if s else -1 for n, s in zip(pick, inner)], dtype=np.int32),
                   np.array([n.cut if s else -1 for n, s in zip(pick, inner)], dtype=np.int32),
                   np.array([spots[n.kids[0]] if s else -1 for n, s in zip(pick, inner)], dtype=np.int32),
                   np.array([spots[n.kids[1]] if s else -1 for n, s in zip(pick, inner)], dtype=np.int32),
                   value, np.array([n.rows for n in pick]))
        reached = np.zeros(len(self.nodes))           # value by examined node: that of the leaf it lies in
        open_ = [(0, None)]
        while open_:
            i, v = open_.pop()
            if v is None and i not in chosen:
                v = value[spots[i]]
            if v is not None:
                reached[i] = v
            if self.nodes[i].kids:
                open_ += [(c, v) for c in self.nodes[i].kids]
        out.reached, out.splits = reached, self.splits
        return out


class Ensemble:
    """All trees of one fit."""

    def __init__(self, number: int, fit: Fit, cut_counts: np.ndarray, width: int):
        self.id, self.fit, self.p = number, fit, fit.params
        mine = np.asarray(cut_counts)[list(fit.cols)]
        self.allowed = np.zeros((len(mine), width), bool)
        for row, m in zip(self.allowed, mine):
            k = m if self.p.random_cuts else min(m, self.p.bins - 1)
            row[np.linspace(0, m - 1, k).round().astype(int)] = True
        self.init, self.growth = None, None
        self.trees: list[Tree] = []
        self.curve: list[float] = []
        self.held: list[tuple] = []
        self.holdout = bool(self.p.patience)
        self.best, self.over, self.pending = 0, False, None      # best: trees kept by the holdout

    def ask(self) -> Ask:
        if self.init is None:
            return Ask(self.id, 0, [], [], np.arange(0))
        if self.growth is None:
            self.growth = _Growth(self.fit, self.fit.first + len(self.trees), self.min_leaf, self.allowed, self.fit.seed)
            self.pending = self.growth.begin()
        return Ask(self.id, len(self.trees), self.growth.splits, self.pending, self.growth.columns,
                   [] if self.p.bag else self.trees, self.init, self.holdout)

    def told(self, t: Told) -> None:
        if self.init is None:
            n, total = t.n, t.total
            if self.holdout and n + t.es[0] < ES_MIN_ROWS:
                self.holdout, n, total = False, n + t.es[0], total + t.es[1]
            self.init = total / n if n else 0.0
            every = int(n + (t.es[0] if self.holdout else 0))
            self.min_leaf = self.p.min_leaf if self.p.min_leaf is not None else max(3, every // MIN_LEAF_SHARE)
            self.over = not n
            return
        if self.pending == [0]:
            self.held.append(t.held)
            if self.holdout and t.es[0]:
                self.curve.append(t.es[1] / t.es[0])
                if len(self.curve) > 1:
                    self.best = 1 + int(np.argmin(self.curve[1:]))
                self.over = len(self.curve) - 1 - self.best >= self.p.patience
            self.over |= len(self.trees) >= self.p.rounds
            if self.over:
                return
        self.pending = self.growth.receive(t.hist)
        if self.pending is None:
            tree = self.growth.tree(1.0 if self.p.bag else self.p.rate, self.init if self.p.bag else 0.0)
            if self.trees:                           # only the last tree's growth is still needed
                self.trees[-1].splits = self.trees[-1].reached = None
            self.growth = None
            if len(tree.value) == 1 and not self.p.bag:        # nothing left to split
                self.over = True
                return
            self.trees.append(tree)
            self.over = self.p.bag and len(self.trees) >= self.p.rounds

    def kept(self) -> list[Tree]:
        """The trees up to the best round."""
        return self.trees[:self.best] if self.holdout and self.curve else self.trees

    def held_sums(self) -> tuple[float, float, float, float]:
        """(rows, mean, squares about the mean, squared error) of the unseen
        fold at the kept round."""
        n, y, yy, sse = self.held[len(self.kept())] if len(self.held) > len(self.kept()) else (0.0,) * 4
        if not n:
            return (0.0,) * 4
        return n, y / n + centre(self.fit, self.init), max(yy - y * y / n, 0.0), sse


def run(ensembles: Iterable[Ensemble], ask: Callable[[list[Ask]], dict[int, Told]]) -> None:
    """Ask and tell until every ensemble is complete."""
    active = [e for e in ensembles if not e.over]
    while active:
        told = ask([e.ask() for e in active])
        for e in active:
            e.told(told[e.id])
        active = [e for e in active if not e.over]


def local_ask(works: dict[int, list[BlockWork]], width: int) -> Callable[[list[Ask]], dict[int, Told]]:
    """``ask`` over blocks that are at hand."""
    def ask(asks: list[Ask]) -> dict[int, Told]:
        out = {}
        for a in asks:
            total = None
            for w in works[a.fit]:
                t = w.answer(a, width)
                total = t if total is None else total + t
            out[a.fit] = total
        return out
    return ask
