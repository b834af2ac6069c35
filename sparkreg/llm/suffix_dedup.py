"""Repeated byte strings across documents, by suffix arrays and their
common-prefix interval trees.

A suffix array of all text cannot be sorted at scale, so it is cut into
buckets that never need each other.  Every window of ``min_len`` bytes has an
anchor: the k-gram in it with the smallest hash.  Equal windows have equal
anchors, wherever they stand, so windows are dealt by the hash of their
anchor's k-gram, as runs of neighbouring windows with the same anchor.

1. Anchors: each group of documents tells the buckets which k-grams it
   holds, and the buckets return the runs whose k-gram another document
   holds too (about a quarter of all in ordinary text).
2. Suffix arrays: the text of those runs goes to its bucket.  Equal runs
   collapse to their smallest document.  Of the rest the suffixes that start
   a window are sorted, neighbours' common prefixes are measured, and a stack
   scan lists the intervals of ``min_len`` or more common bytes.  Intervals
   whose occurrences all have the same byte before them are repeats of a
   longer string and skipped; the others are the maximal repeats, with all
   their occurrences.  An occurrence is removed when its interval, or one
   above it, reaches into a document with a smaller id.
3. The removed stretches return to the documents.

A k-gram with more than ``HOT_RUNS`` runs, as of a short phrase that many
documents hold in different contexts, would make one bucket grow with the
input.  The buckets of step 1 count the runs and tell the groups, which then
send the windows of such runs one by one, dealt by the hash of all their
bytes.  Equal windows still meet, and different ones need not.

Runs travel packed, some thousand in a binary value, at first only as the
hash of their k-gram and their number in the group, which finds its runs anew
in the next step.  A group of documents
collapses its own repeats first, so a passage that a third of all documents
share reaches its bucket once per group of documents.  The documents are
shuffled once; the three steps use the same exchange.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.llm.common import text_or_empty

MIN_LEN = 50
K = 16
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Bytes that are hashed at once; longer documents are cut with an overlap.
SEGMENT = 2 << 20
#: Runs, and about as many suffixes, that are sorted at once.
SORT_ROWS = 64_000
#: Runs of one k-gram from which its windows are dealt by all their bytes.
HOT_RUNS = 16_000
#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 28) - 1)
RUN = np.dtype([("kh", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("at", "u1"), ("more", "u1")])
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        for name, b in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            a = np.full(n, b, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each position."""
    n = len(data)
    p, q = _powers(n + 1)
    c = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=c[1:], dtype=np.uint64)
    h = (c[k:] - c[:-k]) * q[:n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_runs(data: np.ndarray, offsets: np.ndarray, min_len: int, k: int) -> np.ndarray:
    """RUN records of all windows of the documents that ``offsets`` cut
    ``data`` into: windows start ... start + more share the anchor at start +
    at."""
    out = []
    ends = offsets[1:]
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + SEGMENT)
        if hi < len(data):                               # cut between documents if one ends in the segment
            j = np.searchsorted(ends, hi, side="right") - 1
            hi = int(ends[j]) if j >= 0 and ends[j] > lo else hi
        stop = min(len(data), hi + min_len - 1)          # windows that start before hi
        x = data[lo:stop]
        if len(x) >= min_len:
            h = gram_hashes(x, k)
            m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
            n, w = 1, min_len - k + 1
            while 2 * n <= w:
                m = np.minimum(m[:-n], m[n:])
                n *= 2
            if n < w:
                m = np.minimum(m[:len(m) - (w - n)], m[w - n:])
            first = np.searchsorted(offsets, lo, side="right") - 1
            last = np.searchsorted(offsets, hi, side="left")
            mark = np.zeros(len(x) + 2, dtype=np.int32)
            a = np.maximum(offsets[first:last], lo) - lo
            b = np.minimum(ends[first:last], stop) - lo - min_len + 1
            ok = b > a
            np.add.at(mark, a[ok], 1)
            np.add.at(mark, b[ok], -1)
            p = np.flatnonzero(np.cumsum(mark[:len(m)]))
            if len(p):
                anchor = (m[p] & _LOW).astype(np.int64)
                new = np.ones(len(p), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
                i = np.flatnonzero(new)
                r = np.zeros(len(i), dtype=RUN)
                doc = np.searchsorted(offsets, p[i] + lo, side="right") - 1
                r["kh"], r["doc"], r["start"] = h[anchor[i]], doc, p[i] + lo - offsets[doc]
                r["at"], r["more"] = anchor[i] - p[i], np.append(p[i[1:] - 1], p[-1]) - p[i]
                out.append(r)
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, dtype=RUN)


def _group(docs: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A group's rows in a fixed order, with ids, bytes and offsets."""
    docs = docs.sort_values(["doc_id", "body"]).reset_index(drop=True)
    ids = docs["doc_id"].to_numpy()
    sizes = np.fromiter(map(len, docs["body"]), np.int64, len(docs))
    data = np.frombuffer(b"".join(docs["body"]), dtype=np.uint8)
    return docs, ids, data, np.concatenate([[0], np.cumsum(sizes)])


def _split(keys: np.ndarray):
    """(value, positions) for each value of ``keys``."""
    o = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.diff(keys[o])) + 1
    for part in np.split(o, cut) if len(o) else ():
        yield int(keys[part[0]]), part


def _bounds(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns in one compressed value, each with its type's bytes together."""
    head = np.array([len(columns), *[c.nbytes for c in columns]], dtype="<i8")
    return zstandard.ZstdCompressor(1).compress(head.tobytes() + b"".join(c.tobytes() for c in columns))


def _unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes = np.frombuffer(blob, "<i8", n, 8)
    out, at = [], 8 * (n + 1)
    for s, d in zip(sizes.tolist(), dtypes, strict=True):
        d = np.dtype(d)
        out.append(np.frombuffer(blob, d, s // d.itemsize, at))
        at += s
    return out


def _steps(rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising integers as steps of one byte, with the large steps apart."""
    step = np.diff(rising, prepend=0)
    return np.minimum(step, 255).astype(np.uint8), step[step >= 255].astype("<i8")


def _from_steps(step: np.ndarray, large: np.ndarray) -> np.ndarray:
    step = step.astype(np.int64)
    step[step == 255] = large
    return np.cumsum(step)


def _short(kh: np.ndarray, buckets: int) -> np.ndarray:
    """Five bytes of a k-gram's hash; with the bucket they tell its k-grams
    apart but for a few, which later steps compare byte by byte."""
    return np.ascontiguousarray((kh // np.uint64(buckets)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def _long(short: np.ndarray) -> np.ndarray:
    out = np.zeros((len(short) // 5, 8), dtype=np.uint8)
    out[:, :5] = short.reshape(-1, 5)
    return out.view("<u8").ravel()


def _counts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of one byte, with the large ones apart."""
    return np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype("<i8")


def _from_counts(n: np.ndarray, large: np.ndarray) -> np.ndarray:
    n = n.astype(np.int64)
    n[n == 255] = large
    return n


def _rows(pairs, name: str) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=[name, "src", "blob"]).astype({name: "int32", "src": "int32"})


def _own_repeats(runs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-gram hashes that several documents of a group hold, the number of
    runs of each, which runs have one of them)."""
    if not len(runs):
        return runs["kh"], np.zeros(0, np.int64), np.zeros(0, dtype=bool)
    o = np.argsort(runs["kh"], kind="stable")
    g = _bounds(runs["kh"][o])
    who = ids[runs["doc"][o]]
    several = np.minimum.reduceat(who, g) < np.maximum.reduceat(who, g)
    mine = np.zeros(len(runs), dtype=bool)
    n = np.diff(np.append(g, len(runs)))
    mine[o] = np.repeat(several, n)
    return runs["kh"][o][g[several]], n[several], mine


def tell_anchors(docs: pd.DataFrame, min_len: int, k: int, buckets: int) -> pd.DataFrame:
    """Step 1, documents: to each bucket its k-grams, with the number of the
    run and the document, and once those that several documents of the group
    hold, which are known to be shared, with the number of their runs."""
    q = int(docs["q"].iloc[0])
    _, ids, data, offsets = _group(docs)
    runs = window_runs(data, offsets, min_len, k)
    marked, times, mine = _own_repeats(runs, ids)
    open_ = np.flatnonzero(~mine)
    none = np.zeros(0, np.int64)
    of = {b: [open_[p], none] for b, p in _split((runs["kh"][open_] % np.uint64(buckets)).astype(np.int64))}
    for b, p in _split((marked % np.uint64(buckets)).astype(np.int64)):
        of.setdefault(b, [none, none])[1] = p
    out = []
    for b, (nr, m) in of.items():
        d, n = np.unique(runs["doc"][nr], return_counts=True)     # runs are in the order of the documents
        out.append((b, q, _pack(ids[d], n.astype("<u4"), *_steps(nr), _short(runs["kh"][nr], buckets),
                                _short(marked[m], buckets), *_counts(times[m]))))
    return _rows(out, "bucket")


def shared_runs(parts: pd.DataFrame, hot_runs: int = HOT_RUNS) -> pd.DataFrame:
    """Step 1, buckets: the numbers of the runs whose k-gram stands in several
    documents, back to their groups, with those of a group's k-grams that have
    more than ``hot_runs`` runs in all groups."""
    cols, marked, times, told = [[], [], [], []], [], [], {}
    for q, blob in zip(parts["src"], parts["blob"]):
        i, n, step, large, kh, m, t, far = _unpack(blob, "<i8", "<u4", "u1", "<i8", "u1", "u1", "u1", "<i8")
        told[q] = _long(kh), _long(m)
        marked.append(told[q][1])
        times.append(_from_counts(t, far))
        for c, v in zip(cols, (_from_steps(step, large), np.repeat(i, n), told[q][0],
                               np.full(len(step), q, dtype=np.int32))):
            c.append(v)
    nr, who, kh, src = map(np.concatenate, cols)
    o = np.argsort(kh, kind="stable")
    g = _bounds(kh[o]) if len(o) else o
    grams, n = kh[o][g], np.diff(np.append(g, len(o)))
    several, back = np.unique(np.concatenate(marked), return_inverse=True)
    total = np.zeros(len(several), np.int64)
    np.add.at(total, back.ravel(), np.concatenate(times))
    both = np.isin(several, grams)
    total[both] += n[np.searchsorted(grams, several[both])]
    hot = np.union1d(several[total > hot_runs], grams[n > hot_runs])
    of = {}
    if len(nr):
        low, high = np.minimum.reduceat(who[o], g), np.maximum.reduceat(who[o], g)
        keep = o[np.repeat((low < high) | np.isin(grams, several), n)]
        of = {q: [np.sort(nr[keep[p]]), hot[:0]] for q, p in _split(src[keep])}
    for q, grams_of in told.items() if len(hot) else ():
        mine = hot[np.isin(hot, np.concatenate(grams_of))]
        if len(mine):
            of.setdefault(q, [nr[:0], mine])[1] = mine
    bucket = int(parts["bucket"].iloc[0])
    return _rows([(q, bucket, _pack(*_steps(r), h)) for q, (r, h) in of.items()], "q")


def _hot_windows(data: np.ndarray, start: np.ndarray, who: np.ndarray,
                 min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a smaller document has the same window, the window's hash) of
    the windows at each start."""
    h = np.concatenate([_hashes_at(data, start[i:i + SORT_ROWS], min_len) for i in range(0, len(start), SORT_ROWS)])
    o = np.argsort(h, kind="stable")
    text = np.lib.stride_tricks.sliding_window_view(data, min_len)
    hit = np.zeros(len(o), dtype=bool)
    g = np.append(_bounds(h[o]), len(o))
    a = 0
    while a < len(g) - 1:                                  # equal windows are together
        b = max(a + 1, int(np.searchsorted(g, g[a] + SORT_ROWS, side="right")) - 1)
        p = o[g[a]:g[b]]
        first, cls = _classes(text[start[p]], np.full(len(p), min_len), np.zeros(len(p), np.int64))
        low = np.full(len(first), NO_ID, dtype=np.int64)
        np.minimum.at(low, cls, who[p])
        hit[p] = who[p] > low[cls]
        a = b
    return hit, h


def _matrix(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """(n, width) bytes from each start, zero after its size."""
    tail = np.zeros(width, dtype=np.uint8)
    m = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, tail]), width)[start]
    m[np.arange(width) >= size[:, None]] = 0
    return m


def _classes(m: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first member, class of each row) of equal rows, sizes and anchors."""
    key = np.ascontiguousarray(np.concatenate([size[:, None].astype(np.uint8), at[:, None].astype(np.uint8) + 1, m],
                                              axis=1)).view(f"S{m.shape[1] + 2}").ravel()
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    return first, back.ravel()


def _hashes_at(data: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k bytes at each start."""
    return gram_hashes(data[start[:, None] + np.arange(k)].ravel(), k)[::k] if len(start) else np.zeros(0, np.uint64)


def send_runs(docs: pd.DataFrame, numbers: pd.DataFrame, min_len: int, k: int, buckets: int) -> pd.DataFrame:
    """Step 2, documents: the text of the shared runs to their buckets, equal
    runs of the group collapsed to their smallest document.  Runs of the
    k-grams that step 1 found hot go as single windows, collapsed as well, to
    the buckets of the windows' hashes."""
    if not len(docs):
        return _rows([], "bucket")
    q = int(docs["q"].iloc[0])
    _, ids, data, offsets = _group(docs)
    runs = window_runs(data, offsets, min_len, k)
    *_, shared = _own_repeats(runs, ids)
    hot = [np.zeros(0, "<u8")]
    for b, blob in zip(numbers["src"], numbers["blob"]):
        step, large, h = _unpack(blob, "u1", "<i8", "<u8")
        shared[_from_steps(step, large)] = True
        hot.append(h * np.uint64(buckets) + np.uint64(b))
    hot = np.concatenate(hot)
    pl = runs[shared]
    if not len(pl):
        return _rows([], "bucket")
    start, size = offsets[pl["doc"]] + pl["start"], pl["more"].astype(np.int64) + min_len
    m = _matrix(data, start, size, 2 * min_len)
    first, cls = _classes(m, size, pl["at"])
    who = ids[pl["doc"]]
    low = np.full(len(first), NO_ID, dtype=np.int64)
    np.minimum.at(low, cls, who)
    hit = who > low[cls]                                  # the same run in a smaller document of this group
    gone = [np.stack([pl["doc"][hit], pl["start"][hit], pl["start"][hit] + size[hit]], axis=1).astype("<u4")]
    rest = ~hit
    none = np.zeros(0, np.int64)
    of = {q % buckets: [none, none]}
    w_run = w_start = none
    if len(hot):
        n = np.uint64(buckets)
        single = np.flatnonzero(rest & np.isin(_long(_short(pl["kh"], buckets).ravel()) * n + pl["kh"] % n, hot))
        rest[single] = False
        w_run = np.repeat(single, pl["more"][single].astype(np.int64) + 1)
        w_start = pl["start"][w_run].astype(np.int64) + np.arange(len(w_run))
        w_start -= np.searchsorted(w_run, w_run)
        if len(w_run):
            dup, h = _hot_windows(data, offsets[pl["doc"][w_run]] + w_start, who[w_run], min_len)
            gone.append(np.stack([pl["doc"][w_run], w_start, w_start + min_len], axis=1)[dup].astype("<u4"))
            w_run, w_start, h = w_run[~dup], w_start[~dup], h[~dup]
            for b, p in _split((h % n).astype(np.int64)):
                of.setdefault(b, [none, none])[1] = p
    rest = np.flatnonzero(rest)
    for b, p in _split((pl["kh"][rest] % np.uint64(buckets)).astype(np.int64)):
        of.setdefault(b, [none, none])[0] = rest[p]
    gone = np.concatenate(gone)
    out = []
    for b, (r, w) in of.items():
        body = m[r][np.arange(m.shape[1]) < size[r][:, None]] if len(r) else m[:0].ravel()
        s = gone if b == q % buckets else gone[:0]
        at, doc = w_start[w], pl["doc"][w_run[w]]
        text = data[(offsets[doc] + at)[:, None] + np.arange(min_len)]
        out.append((b, q, _pack(who[r], *[pl[f][r] for f in ("doc", "start", "at", "more")], body,
                                *[np.ascontiguousarray(c) for c in s.T],
                                who[w_run[w]], doc, at.astype("<u4"), text)))
    return _rows(out, "bucket")


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, min_len: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of the common-prefix intervals of a suffix array
    that are maximal repeats of ``min_len`` or more bytes.

    ``lcp[i]`` is the common prefix of the suffixes i - 1 and i, ``left[i]``
    the byte before suffix i, negative where there is none to compare.  A
    stack scan closes an interval when the common prefix falls below its
    length; the interval is reported when the bytes before its suffixes
    differ.
    """
    out, stack = [], []                                   # stack: [length, first, byte before, or None: they differ]
    left = left.tolist()
    for i, h in enumerate([*lcp.tolist()[1:], 0], start=1):
        h = h if h >= min_len else 0
        first, seen = i - 1, left[i - 1] if left[i - 1] >= 0 else None
        while stack and stack[-1][0] > h:
            length, first, byte = stack.pop()
            byte = byte if byte == seen else None
            if byte is None:
                out.append((first, i - 1, length))
            seen = byte
        if stack and stack[-1][0] == h:
            if stack[-1][2] != seen:
                stack[-1][2] = None
        elif h:
            stack.append([h, first, seen])
    return out


def _window_hits(m: np.ndarray, size: np.ndarray, low: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """(row, start, end) stretches of the distinct texts ``m`` that also stand
    in a text with a smaller id; texts share a k-gram hash in groups that are
    wholly in ``m``."""
    more = size - min_len + 1
    row = np.repeat(np.arange(len(m)), more)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more)
    suffix = _matrix(m.ravel(), row * m.shape[1] + pos, size[row] - pos, m.shape[1])
    key = np.ascontiguousarray(suffix).view(f"S{m.shape[1]}").ravel()
    o = np.argsort(key, kind="stable")                     # the suffix array
    s = suffix[o]
    room = (size[row] - pos)[o]
    differ = s[1:] != s[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), s.shape[1])
    lcp = np.concatenate([[0], np.minimum(same, np.minimum(room[1:], room[:-1]))])
    left = np.where(pos > 0, m[row, np.maximum(pos - 1, 0)].astype(np.int64), -1)[o]
    deep = lcp >= min_len
    near = deep.copy()
    near[:-1] |= deep[1:]                                  # suffixes that are in some interval
    idx = np.flatnonzero(near)
    who = low[row[o]]
    rows, starts, ends = [], [], []
    for a, b, length in maximal_repeats(np.where(np.concatenate([[True], np.diff(idx) == 1]), lcp[idx], 0),
                                        left[idx], min_len) if len(idx) else ():
        members = idx[a:b + 1]
        w = who[members]
        gone = members[w > w.min()]
        if len(gone):
            rows.append(row[o[gone]])
            starts.append(pos[o[gone]])
            ends.append(pos[o[gone]] + length)
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)


def resolve_runs(parts: pd.DataFrame, min_len: int, k: int) -> pd.DataFrame:
    """Step 2, buckets: removed stretches, back to their groups."""
    cols, single = [[] for _ in range(7)], [[] for _ in range(5)]
    out = []
    for q, blob in zip(parts["src"], parts["blob"]):
        *run, d, s, e, w, w_doc, w_start, text = _unpack(blob, "<i8", "<u4", "<u4", "u1", "u1", "u1",
                                                         "<u4", "<u4", "<u4", "<i8", "<u4", "<u4", "u1")
        for c, v in zip(cols, (*run, np.full(len(run[0]), q, dtype=np.int32))):
            c.append(v)
        for c, v in zip(single, (w, w_doc, w_start, text, np.full(len(w), q, dtype=np.int32))):
            c.append(v)
        if len(d):
            out.append((q, 0, _pack(d, s, e)))
    who, doc, at, text, src = map(np.concatenate, single)
    if len(who):
        hit, _ = _hot_windows(text, np.arange(len(who)) * min_len, who, min_len)
        hit = np.flatnonzero(hit)
        for q, p in _split(src[hit]):
            p = hit[p]
            out.append((q, 0, _pack(doc[p], at[p], at[p] + np.uint32(min_len))))
    who, doc, begin_at, at_, more, body, src = map(np.concatenate, cols)
    if len(who):
        size = more.astype(np.int64) + min_len
        start = np.cumsum(size) - size
        kh = _hashes_at(body, start + at_, k)
        o = np.argsort(kh, kind="stable")
        g = np.append(_bounds(kh[o]), len(o))
        found_i, found_s, found_e = [], [], []
        a = 0
        while a < len(g) - 1:                              # some k-grams at a time, each wholly
            b = max(a + 1, int(np.searchsorted(g, g[a] + SORT_ROWS, side="right")) - 1)
            at = o[g[a]:g[b]]
            m = _matrix(body, start[at], size[at], 2 * min_len)
            first, cls = _classes(m, size[at], at_[at])
            low = np.full(len(first), NO_ID, dtype=np.int64)
            np.minimum.at(low, cls, who[at])
            whole = who[at] > low[cls]
            found_i.append(at[whole])
            found_s.append(np.zeros(int(whole.sum()), np.int64))
            found_e.append(size[at][whole])
            # k-grams with several different texts
            order = np.argsort(kh[at][first], kind="stable")
            h = kh[at][first][order]
            n = np.diff(np.append(_bounds(h), len(h)))
            many = order[np.repeat(n > 1, n)]
            cut = np.append(_bounds(h[np.repeat(n > 1, n)]), len(many)) if len(many) else [0]
            members = np.argsort(cls, kind="stable")
            begin = np.searchsorted(cls[members], np.arange(len(first) + 1))
            c = 0
            while c < len(cut) - 1:
                d = max(c + 1, int(np.searchsorted(cut, cut[c] + SORT_ROWS // 16, side="right")) - 1)
                some = many[cut[c]:cut[d]]
                r, s, e = _window_hits(m[first[some]], size[at][first[some]], low[some], min_len)
                j = some[r]                                # class of each stretch; its members in the smallest document
                reps = begin[j + 1] - begin[j]
                mem = members[np.repeat(begin[j], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
                mine = who[at][mem] == np.repeat(low[j], reps)
                found_i.append(at[mem[mine]])
                found_s.append(np.repeat(s, reps)[mine])
                found_e.append(np.repeat(e, reps)[mine])
                c = d
            a = b
        i, s, e = map(np.concatenate, (found_i, found_s, found_e))
        for q, p in _split(src[i]):
            p = p[np.lexsort((s[p], i[p]))]
            lo = begin_at[i[p]]
            out.append((q, 0, _pack(doc[i[p]], (lo + s[p]).astype("<u4"), (lo + e[p]).astype("<u4"))))
    return _rows(out, "q")


def cut_spans(docs: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """Step 3: what is left of each document."""
    if not len(docs):
        return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    docs, _, _, offsets = _group(docs)
    none = np.zeros(0, dtype="<u4")
    of, lo, hi = map(np.concatenate, zip(*[_unpack(b, "<u4", "<u4", "<u4") for b in spans["blob"]], (none,) * 3))
    lo, hi = offsets[of] + lo, offsets[of] + hi
    o = np.argsort(lo, kind="stable")
    lo, hi, of = lo[o], hi[o], of[o]
    removed, runs, kept = [], [], []
    begin = np.searchsorted(of, np.arange(len(docs) + 1))
    for i, body in enumerate(docs["body"]):
        a, b = begin[i], begin[i + 1]
        if a == b:
            removed.append(0)
            runs.append(0)
            kept.append(body)
            continue
        far = np.maximum.accumulate(hi[a:b])
        new = np.concatenate([[True], lo[a + 1:b] > far[:-1]])   # touching stretches are one
        s = lo[a:b][new] - offsets[i]
        e = far[np.append(np.flatnonzero(new)[1:] - 1, b - a - 1)] - offsets[i]
        removed.append(int((e - s).sum()))
        runs.append(len(s))
        kept.append(b"".join(body[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(body)])))
    return pd.DataFrame({"doc_id": docs["doc_id"], "n_bytes": [len(b) for b in docs["body"]],
                         "n_removed": removed, "n_spans": runs, "kept": kept})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN,
                   k: int = K, digest: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept (binary: the remaining bytes; with ``digest``
    kept_sha256 instead).

    Removed is each byte covered by a string of ``min_len`` bytes that also
    starts in a document with a smaller doc_id.  Matches never cross
    documents, overlaps count, and strings are judged on the input.  A null
    text is empty; shorter texts than ``min_len`` lose nothing.  Rows that
    repeat a doc_id do not remove from each other; a null doc_id counts as
    larger than all others.  ``hot_runs`` only decides how the work is dealt.
    """
    if not k <= min_len <= 127:
        raise ValueError("min_len must lie between k and 127")
    body = text_or_empty(F.col(f"`{text_col}`"))
    total = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    groups, buckets = max(8, math.ceil(total / GROUP_BYTES)), max(8, math.ceil(total / BUCKET_BYTES))
    t = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), body.cast("binary").alias("body"))
    t = t.select(F.pmod(F.xxhash64("doc_id", F.octet_length("body"), F.substring("body", 1, 32)), F.lit(groups))
                 .cast("int").alias("q"), "doc_id", "body")
    to_bucket, to_group = "bucket int, src int, blob binary", "q int, src int, blob binary"
    told = t.groupBy("q").applyInPandas(lambda d: tell_anchors(d, min_len, k, buckets), to_bucket)
    shared = told.groupBy("bucket").applyInPandas(lambda p: shared_runs(p, hot_runs), to_group)
    sent = t.groupBy("q").cogroup(shared.groupBy("q")).applyInPandas(
        lambda d, p: send_runs(d, p, min_len, k, buckets), to_bucket)
    spans = sent.groupBy("bucket").applyInPandas(lambda p: resolve_runs(p, min_len, k), to_group)

    def finish(d: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = cut_spans(d, s)
        if digest:
            out["kept"] = [hashlib.sha256(b).hexdigest() for b in out["kept"]]
        return out

    out = t.groupBy("q").cogroup(spans.groupBy("q")).applyInPandas(
        finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out
