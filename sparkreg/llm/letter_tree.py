"""K-d trees over letter-count vectors.

A word becomes the number of times each letter stands in it.  Replacing a
letter lowers one count by one and raises another, inserting one raises a
single count: words one edit apart lie within L1 distance two, or one.  A
search descends only into boxes that such a step can reach, and compares the
letter order of what it finds there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: a-z have a count each; any other code point shares one of 64, which
#: U+00C0..U+00FF fill one by one.  Shared counts only bring vectors closer.
DIMS = 26 + 64
#: Larger counts are cut to this, which also only brings vectors closer.
TOP = 30_000
BLOCK_CELLS = 4_000_000        # numbers held by one comparison step


def code_points(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row a word."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return flat.reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    dim = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % 64)
    flat = (np.arange(len(codes))[:, None] * DIMS + dim).ravel()
    return np.minimum(np.bincount(flat, minlength=len(codes) * DIMS), TOP).astype(np.int16).reshape(-1, DIMS)


@dataclass
class Node:
    lo: np.ndarray             # the box
    hi: np.ndarray
    rows: np.ndarray | None    # of a leaf: its points
    dim: int = -1              # of an inner node: points with a count of at most ``at`` lie left
    at: int = 0
    left: int = -1
    right: int = -1
    leaf: int = -1


class Tree:
    """``tight``: boxes hug the points they were built from.  Otherwise they
    are bounded by the splits alone, so that they also hold points that come
    later."""

    def __init__(self, points: np.ndarray, leaf_rows: int, tight: bool):
        d = points.shape[1]
        self.points, self.tight, self.nodes, self.leaves = points, tight, [], 0
        whole = (np.zeros(d, np.int16), np.full(d, TOP, np.int16))
        open_ = [(np.arange(len(points)), whole, -1, "")]
        while open_:
            rows, box, parent, side = open_.pop()
            mine = points[rows]
            if tight and len(rows):
                box = (mine.min(axis=0), mine.max(axis=0))
            split = self._split(mine) if len(rows) > leaf_rows else None
            node = Node(*box, rows=rows if split is None else None)
            self.nodes.append(node)
            if parent >= 0:
                setattr(self.nodes[parent], side, len(self.nodes) - 1)
            if split is None:
                node.leaf = self.leaves
                self.leaves += 1
                continue
            node.dim, node.at = split
            goes_right = mine[:, node.dim] > node.at
            lo, hi = box[0].copy(), box[1].copy()
            hi[node.dim], lo[node.dim] = node.at, node.at + 1
            me = len(self.nodes) - 1
            open_ += [(rows[goes_right], (lo, box[1]), me, "right"), (rows[~goes_right], (box[0], hi), me, "left")]

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, int] | None:
        """The count and the bound that divide the points most evenly."""
        best, split = 0, None
        for at in range(int(points.max(initial=0))):
            above = (points > at).sum(axis=0)
            even = np.minimum(above, len(points) - above)
            dim = int(even.argmax())
            if even[dim] > best:
                best, split = int(even[dim]), (dim, at)
            if not above.any() or at > 64:
                break
        return split

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf whose box each point lies in."""
        out = np.zeros(len(points), dtype=np.int64)
        open_ = [(0, np.arange(len(points)))]
        while open_:
            at, rows = open_.pop()
            node = self.nodes[at]
            if node.dim < 0:
                out[rows] = node.leaf
            elif len(rows):
                right = points[rows, node.dim] > node.at
                open_ += [(node.left, rows[~right]), (node.right, rows[right])]
        return out

    def reach(self, queries: np.ndarray, up: int, down: int):
        """(leaf node, queries) for every leaf whose box holds a vector that
        raises counts of the query by at most ``up`` in all and lowers them by
        at most ``down``."""
        open_ = [(0, np.arange(len(queries)))]
        while open_:
            at, rows = open_.pop()
            node = self.nodes[at]
            q = queries[rows]
            near = ((np.maximum(node.lo - q, 0).sum(axis=1) <= up)
                    & (np.maximum(q - node.hi, 0).sum(axis=1) <= down))
            rows = rows[near]
            if not len(rows):
                continue
            if node.dim < 0:
                yield node, rows
            else:
                open_ += [(node.left, rows), (node.right, rows)]


class WordIndex:
    """The words of one length, searched for those one edit from a query."""

    def __init__(self, words: list[str], leaf_rows: int = 48):
        self.codes = code_points(words)
        counts = letter_counts(self.codes)
        self.used = np.flatnonzero(counts.any(axis=0))       # counts of the other letters share one more place
        self.tree = Tree(self._project(counts), leaf_rows, tight=True)

    def _project(self, counts: np.ndarray) -> np.ndarray:
        rest = np.delete(counts, self.used, axis=1).sum(axis=1, dtype=np.int64)
        return np.column_stack([counts[:, self.used], np.minimum(rest, TOP).astype(np.int16)])

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word of the index) for all pairs exactly one edit apart.
        The queries are of the index's length or one code point shorter."""
        codes = code_points(words)
        longer = self.codes.shape[1] - codes.shape[1]
        queries, points = self._project(letter_counts(codes)), self.tree.points
        limit = 1 if longer else 2
        qs, ts = [], []
        for leaf, rows in self.tree.reach(queries, 1, 0 if longer else 1):
            block = max(1, BLOCK_CELLS // (len(leaf.rows) * points.shape[1] + 1))
            for a in range(0, len(rows), block):
                some = rows[a:a + block]
                apart = np.abs(queries[some][:, None, :] - points[leaf.rows][None, :, :]).sum(axis=2)
                i, j = np.nonzero(apart <= limit)
                q, t = some[i], leaf.rows[j]
                same = self._one_edit(codes, q, t, longer)
                qs.append(q[same])
                ts.append(t[same])
        none = np.empty(0, dtype=np.int64)
        return (np.concatenate(qs), np.concatenate(ts)) if qs else (none, none)

    def _one_edit(self, codes: np.ndarray, q: np.ndarray, t: np.ndarray, longer: int) -> np.ndarray:
        out = np.zeros(len(q), dtype=bool)
        n = codes.shape[1]
        block = max(1, BLOCK_CELLS // (n + 1))
        for a in range(0, len(q), block):
            x, y = codes[q[a:a + block]], self.codes[t[a:a + block]]
            if not longer:
                out[a:a + block] = (x != y).sum(axis=1) == 1
            else:                                    # what stands before and after the inserted one is equal
                head = np.cumprod(x == y[:, :-1], axis=1).sum(axis=1)
                tail = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                out[a:a + block] = head + tail >= n
        return out
