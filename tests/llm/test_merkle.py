"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest
from edge_tables import documents, empty

from sparkreg.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = None if r.n_chars is None else r.n_chars + more
    return sha("".join(map(field, (r.doc_id, r.source, r.lang, n, r.text))))


def tree(digests):
    """(root, [proof and path of every leaf])."""
    ways = [[] for _ in digests]
    spots = list(range(len(digests)))
    while len(digests) > 1:
        for way, s in zip(ways, spots):
            way.append((s & 1, digests[s ^ 1] if s ^ 1 < len(digests) else None))
        digests = [sha("".join(digests[i:i + 2])) for i in range(0, len(digests), 2)]
        spots = [s // 2 for s in spots]
    return digests[0], ways


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    subs, parts = [], []
    for lang in langs:
        mine = sorted(by_lang[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        root, ways = tree([leaf(r) for r in mine])
        subs.append(root)
        parts.append((mine, ways))
    root, tops = tree(subs)
    out = []
    for sub, top, (mine, ways) in zip(subs, tops, parts):
        for r, way in zip(mine, ways):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            d = leaf(r, int(hit))
            for right, other in way + top:
                d = sha(d) if other is None else sha(other + d if right else d + other)
            proof = "".join(o for _, o in way + top if o)
            out.append((r.doc_id, leaf(r), sub, root, sha(proof), d, d == root))
    return out


def key(t):
    return tuple("" if v is None else str(v) for v in t)


def same(df, rows):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("height", [1, 2, 12])
def test_equals_a_plain_tree(spark, height):
    docs = documents(spark, n=90).drop("fp")
    more = spark.createDataFrame([(10_000 + i, "t", lang, "s", i) for i, lang in enumerate(
        ["de", "", "-", "é", "\U0001f642", "￿", "zz", "de", "de"])], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more, allowMissingColumns=True)
    rows = docs.collect()
    out = merkle.checked(docs.repartition(7), height=height)
    same(out, rows)
    got = out.collect()
    assert {r.verified for r in got} == {True, False}


def test_many_equal_rows_and_long_runs(spark):
    rng = random.Random(4)
    rows = [(5, "copy", "en", "a", 4)] * 300 + [(rng.randrange(10 ** 6), "x" * rng.randrange(9), "en", None, None) for _ in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(merkle.checked(docs.repartition(9), height=3), docs.collect())


def test_proofs_fold_to_the_root(spark):
    docs = documents(spark)
    m = merkle.manifest(docs).collect()
    assert len({r.root for r in m}) == 1 and len(m) == docs.count()
    for r in m:
        assert merkle.fold(r.leaf, r.proof, r.pos, r.n, r.tree_pos, r.n_trees) == r.root
        if r.proof:
            assert merkle.fold(r.leaf, r.proof[::-1], r.pos, r.n, r.tree_pos, r.n_trees) != r.root


@pytest.mark.parametrize("langs", [["en"], ["en", "de", None], ["en", "en"]])
def test_lone_leaves(spark, langs):
    docs = spark.createDataFrame([(i, "t", v, None, 2 ** 63 - 1) for i, v in enumerate(langs)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    same(merkle.checked(docs), docs.collect())


def test_empty_table(spark):
    assert merkle.checked(empty(spark)).count() == 0
