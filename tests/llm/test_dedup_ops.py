"""Exact dedup, SimHash near-dedup, repeated byte strings and line dedup
against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from edge_tables import ascii_lower, documents, empty

from sparkreg.llm import line_dedup, simhash, suffix_dedup
from sparkreg.llm.common import connected_components
from sparkreg.llm.exact_dedup import exact_dedup, keep_rows


def components(n, edges):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        par[b] = a
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = components(200, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("hot_rows", [50, 1])
def test_exact_dedup(spark, hot_rows):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    got = exact_dedup(docs, hot_rows=hot_rows, hot_share=0.0, salts=4).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(ascii_lower(r.text or ""), []).append(r.doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids))
        assert not r.kept or r.doc_id == best
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(by_sha)                       # exactly one row of each group
    stay = keep_rows(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert {r.text for r in stay.collect()} <= {r.text for r in rows}
    assert exact_dedup(empty(spark)).count() == 0 and keep_rows(empty(spark)).count() == 0


def reference_fingerprint(text, k=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", ascii_lower(text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    rng = random.Random(1)
    for t in ["", " ", "a", "A b", "É É é", "a b c", "x y z x y z x y z", "a\x0bb\x1cc\xa0d e",
              " ".join(rng.choice("abcde") for _ in range(70_000))]:
        assert simhash.fingerprint(t) == reference_fingerprint(t)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 400)
    codes = [set(r) for r in simhash.fuzzy_codewords(x).tolist()]
    assert {len(c) for c in codes} <= {1, 6}
    i, j = rng.integers(0, 23, 400), rng.integers(0, 23, 400)
    y = x ^ (1 << i) ^ np.where(i != j, 1 << j, 0)
    assert all(a & set(b) for a, b in zip(codes, simhash.fuzzy_codewords(y).tolist()))


@pytest.mark.parametrize("bucket", [32, 1])
def test_links_lose_no_component(spark, bucket):
    rng = random.Random(5)
    fps = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            fps.append(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = components(len(fps), edges)
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket).collect()
    at = {s: i for i, s in enumerate(signed)}
    assert all((fps[at[r.u]] ^ fps[at[r.v]]).bit_count() <= 2 for r in got)
    assert components(len(fps), [(at[r.u], at[r.v]) for r in got]) == want


def test_near_duplicates(spark):
    docs = documents(spark, n=90)
    rows = docs.select("doc_id", "text").collect()
    fp = [reference_fingerprint(r.text or "") for r in rows]
    want = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i)
                                  if (fp[i] ^ fp[j]).bit_count() <= 2])
    ids = {}
    for c, r in zip(want, rows):
        ids.setdefault(c, []).append(r.doc_id)
    name = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    expect = sorted(((r.doc_id, f"{f:016x}", name[c]) for r, f, c in zip(rows, fp, want)), key=str)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).select(
        "doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == expect
    best = {}                                         # by component: the smallest id, of its texts the smallest fingerprint
    for c, r, f in zip(want, rows, fp):
        if r.doc_id is not None:
            best[c] = min(best.get(c, (r.doc_id, f)), (r.doc_id, f if f < 2 ** 63 else f - 2 ** 64))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    stay = {}
    for c, r, f in zip(want, rows, fp):
        if r.doc_id is None:
            stay[None, r.text] = c
        elif (r.doc_id, f if f < 2 ** 63 else f - 2 ** 64) == best[c]:
            stay.setdefault((r.doc_id, r.text), c)
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert got <= set(stay) and {stay[k] for k in got} == set(want)
    assert (8, "another text under a repeated id") in got
    assert simhash.near_duplicates(empty(spark)).count() == 0


def removed_by_hand(rows, size):
    first = {}
    for i, b in rows:
        for p in range(len(b) - size + 1):
            w = b[p:p + size]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p:p + size]] < i:
                gone[p:p + size] = b"\x01" * size
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((None if i == suffix_dedup.NO_ID else i, len(b), sum(gone), spans,
                    bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings(spark, seed, monkeypatch):
    docs = documents(spark, seed=seed)
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdefgh \n\x00") for _ in range(400))
    extra = [(2000 + i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(90)))
              + passage[rng.randrange(200):200 + rng.randrange(200)] + "ab" * rng.randrange(60)) for i in range(40)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(suffix_dedup.NO_ID if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in both.collect()]
    for small in (False, True):
        if small:                                              # long documents are cut, sorts are split
            monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
            monkeypatch.setattr(suffix_dedup, "SORT_ROWS", 40)
        got = sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r)
                      for r in suffix_dedup.remove_repeats(both).collect()), key=str)
        assert got == removed_by_hand(rows, suffix_dedup.MIN_LEN)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_hot_runs(spark):
    """Windows of hot k-grams dealt one by one: the same result."""
    both = documents(spark)
    rows = [(suffix_dedup.NO_ID if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in both.collect()]
    for hot_runs in (0, 3):
        got = sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r)
                      for r in suffix_dedup.remove_repeats(both, hot_runs=hot_runs).collect()), key=str)
        assert got == removed_by_hand(rows, suffix_dedup.MIN_LEN)


def test_one_phrase_in_many_contexts():
    """A short phrase between different texts does not fill one bucket."""
    import pandas as pd
    rng = np.random.default_rng(5)
    n, groups, buckets, size = 24_000, 4, 8, suffix_dedup.MIN_LEN
    letters = rng.integers(97, 123, (n, 2, 16), dtype=np.uint8)
    letters[n // 2:n // 2 + 500] = letters[:500]                 # these share their contexts
    phrase = b"is one of the most famous of the"
    bodies = [a.tobytes() + phrase + b.tobytes() for a, b in letters]
    docs = pd.DataFrame({"doc_id": np.arange(n), "body": bodies, "q": rng.integers(0, groups, n)})
    of = dict(list(docs.groupby("q")))
    told = pd.concat([suffix_dedup.tell_anchors(d, size, suffix_dedup.K, buckets) for d in of.values()])
    shared = pd.concat([suffix_dedup.shared_runs(p) for _, p in told.groupby("bucket")])
    sent = pd.concat([suffix_dedup.send_runs(d, shared[shared["q"] == q], size, suffix_dedup.K, buckets)
                      for q, d in of.items()])
    weight = sent["blob"].map(len).groupby(sent["bucket"]).sum()
    assert weight.max() < 0.3 * weight.sum()
    spans = pd.concat([suffix_dedup.resolve_runs(p, size, suffix_dedup.K) for _, p in sent.groupby("bucket")])
    got = pd.concat([suffix_dedup.cut_spans(d, spans[spans["q"] == q]) for q, d in of.items()])
    lost = got.set_index("doc_id")["n_removed"]
    first, want = {}, np.zeros(n, np.int64)
    for i, body in enumerate(bodies):
        gone = np.zeros(len(body), dtype=bool)
        for j in range(len(body) - size + 1):
            if first.setdefault(body[j:j + size], i) < i:
                gone[j:j + size] = True
        want[i] = gone.sum()
    assert (lost.sort_index().to_numpy() == want).all() and (want > 0).sum() >= 500


def test_maximal_repeats():
    """All strings that occur twice and cannot be extended to the left or the
    right, with all their occurrences."""
    rng = random.Random(9)
    for _ in range(60):
        s = "".join(rng.choice("ab") for _ in range(rng.randrange(2, 40)))
        sa = sorted(range(len(s)), key=lambda i: s[i:])
        lcp = [0] + [next((k for k in range(len(s)) if k >= len(s) - max(a, b) or s[a + k] != s[b + k]))
                     for a, b in zip(sa, sa[1:])]
        left = np.array([ord(s[i - 1]) if i else -1 for i in sa])
        got = {(s[sa[a]:sa[a] + n], tuple(sorted(sa[a:b + 1])))
               for a, b, n in suffix_dedup.maximal_repeats(np.array(lcp), left, 2)}
        want = set()
        for n in range(2, len(s)):
            for w in {s[i:i + n] for i in range(len(s) - n + 1)}:
                at = [i for i in range(len(s) - n + 1) if s.startswith(w, i)]
                lefts, rights = [s[i - 1:i] for i in at], [s[i + n:i + n + 1] for i in at]
                if len(at) > 1 and (len(set(lefts)) > 1 or "" in lefts) and (len(set(rights)) > 1 or "" in rights):
                    want.add((w, tuple(at)))
        assert got == want


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a):
        cur = [i + 1]
        for j, y in enumerate(b):
            cur.append(min(prev[j] + (x != y), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return prev[-1]


def test_banded_distance_and_segments():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(2))
        for k in (1, 2, 3):
            near = distance(a, b) <= k
            assert line_dedup.within(a, b, k) == near
            if near and min(len(a), len(b)) > k:
                s, t = sorted((a, b), key=len)
                index = {(len(s), i, s[p:p + n]) for i, (p, n) in enumerate(line_dedup.segments(len(s), k))}
                assert index & {(m, i, t[p:p + n]) for m, i, p, n in line_dedup.probes(len(t), k)}


@pytest.mark.parametrize("edits,bucket", [(1, 64), (1, 2), (2, 64)])
def test_line_dedup(spark, edits, bucket):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(3, 30))) for _ in range(12)]
    rows = [(9, None), (10, ""), (11, "\n\n"), (12, base[0] + "\n" + base[0]), (None, base[0] + "\nanother line here")]
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            s = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                p = rng.randrange(len(s))
                s[p:p + rng.randrange(2)] = rng.choice(["", "x", "yé"])
            lines.append(rng.choice(["", " ", "\t"]) + "".join(s) + rng.choice(["", "\r", "\xa0"]))
        rows.append((100 + i, "\n".join(lines)))
    occ = [((line_dedup.NO_ID if i is None else i), n, x.strip()) for i, t in rows
           for n, x in enumerate((t or "").split("\n"))]
    texts = sorted({x for _, _, x in occ if x}, key=lambda x: min(o[:2] for o in occ if o[2] == x))
    near = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i])
            if min(len(a), len(b)) >= line_dedup.MIN_CHARS and distance(a, b) <= edits]
    root = components(len(texts), near)
    first = {x: min(o[:2] for o in occ if o[2] == x) for x in texts}
    keep = {x: first[texts[root[i]]] for i, x in enumerate(texts)}
    want = sorted((d, n, *(keep[x] if x else (d, n)), (keep[x] if x else (d, n)) == (d, n)) for d, n, x in occ)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), edits=edits, bucket=bucket)
    no = line_dedup.NO_ID
    assert sorted(((no if r.doc_id is None else r.doc_id), r.line_no, (no if r.keep_doc_id is None else r.keep_doc_id),
                   r.keep_line_no, r.kept) for r in got.collect()) == want
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_edge_table(spark):
    docs = documents(spark)
    n = sum(len((r.text or "").split("\n")) for r in docs.collect())
    assert line_dedup.dedup_lines(docs).count() == n


def test_another_text_under_a_repeated_id_is_kept(spark):
    text, other = "one two three four five six", "alder birch cedar elm fir hazel larch maple"
    docs = spark.createDataFrame([(5, text), (9, text), (9, other), (12, other + "!"), (3, None), (4, "")],
                                 "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()}
    linked = (reference_fingerprint(other) ^ reference_fingerprint(other + "!")).bit_count() <= 2
    assert kept == {(5, text), (9, other), (3, None)} | (set() if linked else {(12, other + "!")})
    two = spark.createDataFrame([(5, text), (5, text.upper()), (6, text)], "doc_id long, text string")
    assert simhash.keep_one(two).count() == 1
