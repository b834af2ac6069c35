"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from edge_tables import ascii_lower, documents, empty

from sparkreg.llm import letter_tree, queries, spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    return groups(n)


def groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v)) if vs else None
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def shown(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def variants(rng, k):
    letters = "abcdeéßÿ×"
    out = []
    for _ in range(k):
        w = list(rng.choice(["birches", "willow", "Größe", "abcde", "aaaaa", "edcba", "été" * 3, "larches" * 2]))
        for _ in range(rng.randrange(3)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at:at + (kind > 0)] = [rng.choice(letters)] if kind < 2 else []
        out.append("".join(w))
    return out


def noisy_documents(spark):
    rng = random.Random(5)
    base = documents(spark, n=120)
    long = "longest" * 300
    rows = [(2000 + i, " ".join(variants(rng, 150))) for i in range(40)]
    rows += [(3000, f"{long} {long} {long} {long[:-1]} {long[1:]} {long[1:]} {long[1:]} x{long} " * 2),
             (3001, "1birch2birch3birch birch_birch-birch BIRCH Birch"), (3002, "ÀÀÀÀÀ ààààà ÀÀÀÀÀ ÀÀÀÀÀ ÀÀÀÀÁ " * 3)]
    return base.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


def test_equals_brute_force(spark):
    docs = noisy_documents(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(f is not None for f, *_ in want.values()) > 50 and any(v[1] != v[0] and v[0] for v in want.values())
    assert shown(spelling.spelling_variants(docs)) == want


@pytest.mark.parametrize("cells,sample", [(4, 60_000), (30, 25), (1, 8), (3, 0)])
def test_small_cells_change_nothing(spark, cells, sample):
    rng = random.Random(7)
    n = {w: rng.randrange(3, 60) for w in map(ascii_lower, variants(rng, 500))}
    n |= {"".join(rng.sample("abcdefg", 7)): 3 for _ in range(60)}       # equal letters, many orders
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    assert shown(spelling.group_variants(words, cell_words=cells, sample_words=sample)) == groups(n)


def test_tree_finds_all_pairs():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(6)) for _ in range(400)})
    shorter = sorted({"".join(rng.choice("abcd") for _ in range(5)) for _ in range(200)})
    index = letter_tree.WordIndex(words, leaf_rows=5)
    for asked in (words, shorter):
        q, t = index.near(asked)
        got = {(asked[a], words[b]) for a, b in zip(q, t)}
        assert len(got) == len(q) and got == {(a, b) for a in asked for b in words if one_edit(a, b)}


def test_nothing_to_group(spark):
    assert spelling.spelling_variants(empty(spark)).count() == 0
    lone = spark.createDataFrame([(1, "alder alder alder 12 \n oak"), (2, None), (3, "")], "doc_id long, text string")
    assert shown(spelling.spelling_variants(lone)) == brute([(1, "alder alder alder 12 \n oak")])


def test_query_on_whole_table(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    assert shown(queries.QUERIES["op12_spelling_variants"](spark, sf_small)) == brute([(r.doc_id, r.text) for r in rows])
