"""Extraction, mixing, tokenising, toxicity, license scan and nearest
neighbours against brute force, plus the pipeline and oracle queries."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from edge_tables import ascii_lower, documents, empty

import corpus_pipeline
from oracle_check import compare, duck
from sparkreg.llm import ann, bpe, html_blocks, html_extract, license_scan, mixing, queries, toxicity

VOCAB = public_tokenizers.path(queries.VOCABULARY)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, sf_small, name):
    got = queries.QUERIES[name](spark, sf_small).toPandas()
    ok, msg = compare(got, duck(sf_small).execute(queries.ORACLES[name]).df())
    assert ok, msg


def fill_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (goal - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in open_})
            break
        target.update({s: most * sizes[s] for s in over})
        open_ -= over
    return target


def test_mixing(spark):
    docs = documents(spark, n=120)
    rows = docs.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
    want = fill_targets(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)

    def copies(doc_id, rate, k):
        h = hashlib.md5(f"mix-1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        u = (int(h[:6], 16) + k * int(h[6:12], 16)) % 2 ** 24
        return int(rate) + (u < (rate - int(rate)) * 2 ** 24)

    seeds = {}
    for s in sizes:
        rate = want[s] / sizes[s] if sizes[s] else 0
        gap = lambda k: abs(sum(copies(r.doc_id, rate, k) * count(r.text) for r in rows if r.source == s) - want[s])  # noqa: E731,B023
        seeds[s] = min(range(64), key=lambda k: (gap(k), k))
    for r in got:
        s = r.row.source
        assert (r.size, r.source_size) == (count(r.row.text), sizes[s])
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies == copies(r.doc_id, rate, seeds[s]) and r.taken == r.copies * r.size <= 2 * r.size
    out = mixing.emit_copies(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_comes_near_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 40), f"s{min(rng.randrange(9), 4)}") for i in range(6000)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in m.groupBy("row.source").agg({"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.01)
    # a source with one very long document still comes near
    rows = [(i, "w " * (9_000 if i % 50 == 0 else rng.randrange(100, 400)), f"s{i % 4}") for i in range(200)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in m.groupBy("row.source").agg({"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.03)


def test_bpe_equals_the_library(spark):
    ranks = bpe.load_ranks(VOCAB)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark)
    rng = random.Random(1)
    odd = "ab  '\t\n\r\x0b\x1c\x85\xa0 　é漢字🙂\U0001f1e9'll 12½!?<|endoftext|>"
    more = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(300)]
    more += ["".join(rng.choice("abcé") for _ in range(n)) for n in (95, 97, 300, 20_000)] + ["a" * 700, " " * 700]
    docs = docs.unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(more)],
                                                  "doc_id long, text string"), allowMissingColumns=True)
    got = bpe.encode_decode(docs, VOCAB, public_tokenizers.PATTERN)
    for r in got.collect():
        ids = enc.encode_ordinary(r.row.text or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == (r.row.text or "").encode()
    codec = bpe.Codec(spark, VOCAB, public_tokenizers.PATTERN)
    trip = docs.select("text", codec.encode(docs["text"]).alias("ids"))
    assert trip.where(codec.decode(trip["ids"]) != trip["text"].cast("binary")).count() == 0
    assert bpe.digests(bpe.encode_decode(empty(spark), VOCAB, public_tokenizers.PATTERN)).count() == 0


def test_merges_with_and_without_heap():
    ranks = bpe.load_ranks(VOCAB)
    rng = random.Random(7)
    for _ in range(300):
        w = "".join(rng.choice("aabcdetion é") for _ in range(rng.randrange(2, 60))).encode()
        if w not in ranks:
            assert bpe._merge_long(w, ranks) == bpe.merge_word(w, ranks)


def test_toxicity(spark, sf_small):
    rng = random.Random(1)
    bad = "grobnik flurtz".split()
    rows, labels = [], []
    for i in range(500):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randrange(3, 40))]
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    rows += [(600, None, "x"), (601, "", "x"), (None, "grobnik flurtz", "x"), (3, rows[3][1], "x")]
    labels += [(None, 1), (2, None), (999, 1), (3, labels[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, lab).collect()
    assert len(got) == len(rows)
    truth = dict(labels[:500])
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(key.encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in got if not (r.row.text or "")}) == 1
    none = toxicity.score_toxicity(docs, lab.where("false")).collect()
    assert {r.predicted for r in none} == {0} and len(none) == len(rows)
    assert toxicity.score_toxicity(docs.where("false"), lab).count() == 0


def test_held_out_labels_are_never_read(spark):
    docs = documents(spark)
    lab = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    flipped = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 4 == 2 else i % 2)
                                     for i in range(60)], "doc_id long, toxic int")
    a, b = (toxicity.fit(docs, x) for x in (lab, flipped))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def base_places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


def test_license_scan(spark):
    rng = random.Random(3)
    notices = list(license_scan.TEMPLATES)
    rows = []
    for i in range(120):
        w = [rng.choice("the of cc by general public license all rights reserved été under v2".split())
             for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            w[len(w) // 2:len(w) // 2] = rng.choice(notices).split()
        rows.append((i, rng.choice([" ", "-", ", ", "\n"]).join(w).upper() if i % 2 else " ".join(w)))
    planted = ("Permission is hereby granted, free of charge, to any person obtaining a full copy of this software and "
               "associated documentation files (the \"Software\")")
    rows += [(500, planted), (501, None), (502, ""), (None, "CC-BY"), (7, rows[7][1]), (503, "cc by " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as hits", "2 as row")
    got = license_scan.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert sum(r.doc_id == 7 for r in got) == 2
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
        at = {x: base_places(words, p) for p, x in license_scan.PHRASES.items()}
        every = sorted(sum(at.values(), []))
        r = by_id[i]
        assert (r.n_words, r.n_base) == (len(words), len(every))
        assert (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert r.base_labels == ",".join(sorted(x for x in at if at[x]))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1
    for i in range(0, 120, 3):                                  # a whole notice is always found
        words = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(rows[i][1])))
        held = {x for t, x in license_scan.TEMPLATES.items() if t in words}
        assert held and held <= set(by_id[i].labels.split(","))
    assert "mit" in by_id[500].labels and by_id[500].spans
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def brute_neighbours(rows, mod, k):
    seen = {}
    for i, v in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or [])):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            seen.setdefault(i, np.array(v, dtype=float))
    out = {}
    for q in seen:
        if q % mod == 0:
            d = sorted((float(np.sqrt(((v - seen[q]) ** 2).sum())), i) for i, v in seen.items()
                       if i != q and len(v) == len(seen[q]))
            out[q] = d[:k]
    return out


def test_nearest_on_a_small_table(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(1100, None), (1200, [0.0] * 8), (1300, [float("nan")] * 8),
             (1400, [None] * 8), (None, rows[1][1]), (1500, [float("inf")] * 8), (100, rows[100][1]), (1600, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank")
    want = brute_neighbours(rows, 100, 10)
    got = {}
    for r in ann.nearest(df, probe_share=1.0, shard_rows=64, block_rows=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == {q for q in want if want[q]}
    for q in got:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=0, atol=1e-12)
    assert ann.nearest(df.where("false")).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64)) / 8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, shard_rows=2500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    d = np.sqrt(((x[::100, None] - x[None]) ** 2).sum(-1))
    d[np.arange(60), np.arange(60) * 100] = np.inf
    best = np.argsort(d, axis=1)[:, :10]
    recall = np.mean([len(got[100 * i] & set(b.tolist())) / 10 for i, b in enumerate(best)])
    assert recall >= 0.9


def test_blocks():
    page = ("<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><!-- <p>no</p> -->"
            '<nav class="mainMenu"><a href="x>y">Home</a></nav><p>One <b>t</b>wo&amp;&nbsp;three<br>four'
            '<script>var a="</p>";</script><p>five<ul><li>a<li>b</ul><select><option>no</select>'
            "<textarea>no</textarea>1 < 2 &am<div>end &copy; &#233;<p")
    got = html_blocks.blocks(page)
    assert [b.text for b in got] == ["Home", "One two& three", "four", "five", "a", "b", "1 < 2 &am", "end © é"]
    assert got[0].path == ("html", "body", "nav", ".main", ".menu")
    assert got[0].link_chars == 4
    assert html_blocks.blocks("") == [] and html_blocks.blocks("plain") == [html_blocks.Block("plain", (), 0)]
    html_blocks.blocks('<p class="' + "x" * 50_000 + "<" * 5000)   # stays linear on broken markup


def test_training_reads_whole_pages(monkeypatch):
    """Blocks at the end of long pages count in the fit."""
    seen = []
    monkeypatch.setattr(html_extract, "pad", lambda seqs, pad=html_extract.pad: seen.extend(seqs) or pad(seqs))
    page = html_blocks.blocks("".join(f"<p>Words of block {i}.</p>" for i in range(600)))
    x = html_extract.vectors(page)
    y = (np.arange(600) > 590).astype(np.float32)
    labeller = html_extract.fit_labeller([])
    seen.clear()
    labeller.fit([(x, y), (x[:70], y[:70])], epochs=1)
    assert sorted(len(a) for a, _ in seen) == [70, 200, 200, 200]
    assert sum(b.sum() for _, b in seen) == y.sum()
    assert (np.concatenate([a for a, _ in seen if len(a) == 200]) == x).all()


@pytest.mark.parametrize("start", ["<body>", "<body><div>", "<div>", "<p>", "<main><h1>", "", "<br>", "<em>"])
def test_page_without_head_end(start):
    page = f"<html><head><meta charset=utf-8><title>no</title><link rel=x><style>p{{}}</style>\n{start}One<p>Two</html>"
    assert [b.text for b in html_blocks.blocks(page)] == ["One", "Two"]
    assert all("head" not in b.path for b in html_blocks.blocks(page))


@pytest.mark.parametrize("tag", "button video audio object map select svg canvas".split())
def test_dropped_element_without_end(tag):
    def texts(page):
        return [b.text for b in html_blocks.blocks(page)]
    assert texts(f"<div><p>One</p><{tag} x=1>no<p>Two</p><ul><li>Three</ul></div><p>Four") == ["One", "Two", "Three", "Four"]
    assert texts(f"<p>One<{tag}>no</p><p>Two</p>") == ["One", "Two"]
    assert texts(f"<p>One</p><{tag}>no<div>no<p>no</p></div>no</{tag}><p>Two") == ["One", "Two"]
    assert texts(f"<{tag}>no<p>One</p><{tag}>no<div>no</div></{tag}><p>Two") == ["One", "Two"]
    html_blocks.blocks(f"<{tag}><x-a><p></x-a></{tag}>" * 2000 + f"<{tag}><p>" * 2000)


def test_extraction(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    body = ("<html><body><nav><ul><li><a>Menu</a></li></ul></nav><div class='cookie-notice'><p>We use cookies.</p></div>"
            "<article><h1>Title here</h1><p>First &lt;paragraph&gt; of   the text.</p><p>" + "Second one. " * 400 +
            "</p></article><aside class='sidebar'><p>Other stories today.</p></aside><div class='comments'>"
            "<div class='comment'><p>I disagree with all of this.</p></div></div><footer>Imprint</footer></body></html>")
    extra = spark.createDataFrame([(9000, "u", body), (9001, "u", None), (9002, "u", ""), (None, "u", body),
                                   (9000, "u", body)], "page_id long, url string, html string")
    both = pages.unionByName(extra).selectExpr("*", "'x' as text", "1 as n_chars")
    got = html_extract.extract(both).collect()
    assert len(got) == pages.count() + 5
    want = " ".join(("Title here First <paragraph> of the text. " + "Second one. " * 400).split())
    for r in got:
        assert r.n_chars == len(r.text)
        if r.row.html in (None, ""):
            assert r.text == ""
        elif r.row.html == body:
            assert r.text == want
        else:
            part = r.row.html.split("<article>", 1)[1].split("</article>")[0]
            part = re.sub(r"</?b>", "", re.sub(r"<(/?p|br|/?h1)>", " ", part))
            assert r.text == " ".join(__import__("html").unescape(re.sub(r"<[^>]*$", "", part)).split())
    assert html_extract.extract(pages.where("false")).count() == 0


def test_pipeline(spark, sf_small):
    docs = queries.table(spark, sf_small, "documents")
    d = docs
    for name, stage in corpus_pipeline.STAGES:
        before = d
        d = stage(spark, before, sf_small)
        if name != "byte_bpe":
            assert d.columns == before.columns and d.count() > 0
    run = corpus_pipeline.run(spark, sf_small)
    assert run.count() == d.count()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(VOCAB),
                            special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in run.limit(40).collect():
        assert r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline_stages_on_edge_tables(spark, sf_small):
    d = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, sf_small)
        if name != "byte_bpe":
            assert d.columns == documents(spark).columns
    assert d.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), sf_small).count() == 0
