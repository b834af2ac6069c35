"""The classifier against a plain one, on its n-grams, and with long texts."""

import numpy as np
import pytest

from sparkreg.llm import toxicity as T


def plain_ids(text):
    """Distinct hashed character n-grams, one by one."""
    s, out = " " + " ".join(text.lower().split()) + " ", set()
    for n in T.SIZES:
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i:i + n]:
                h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
            out.add(((h ^ n * 0x51ED27) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - T.BITS)
    return sorted(out)


@pytest.mark.parametrize("text", ["", "a", "Some  Words\there", "плохой текст", "漢字かな🙂é", "x" * 50])
def test_ngrams_are_of_characters(text):
    assert T.ngram_ids(text).tolist() == plain_ids(text)


def test_chunks_of_a_long_text_change_nothing(monkeypatch):
    rng = np.random.RandomState(0)
    text = "".join(chr(97 + i) for i in rng.randint(0, 26, 5_000)) + "é" * 9
    whole = T.ngram_ids(text)
    monkeypatch.setattr(T, "_CHUNK", 64)
    assert np.array_equal(T.ngram_ids(text), whole)


def test_score_is_the_weighed_set_of_ngrams(spark):
    rng = np.random.RandomState(1)
    bad, good = ["гадость", "vile", "ugly"], ["alder", "birch", "сад", "larch"]
    rows = [(i, " ".join(rng.choice(bad + good if i % 3 == 0 else good, 12))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "vile " * 400_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(any(b in t for b in bad))) for i, t in rows], "doc_id long, toxic int")
    w, b = T.fit(docs, labels)
    got = T.score_toxicity(docs, labels).collect()
    hit = []
    for r in got:
        z = sum(float(w[i]) for i in plain_ids((r.row.text or "")[:3000])) + b
        if r.doc_id != 901:
            assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-5)
        if r.held_out and r.doc_id < 900:
            hit.append(r.predicted == int(any(x in r.row.text for x in bad)))
    assert np.mean(hit) > 0.95 and {r.doc_id: r.predicted for r in got}[901] == 1


def test_the_fit_is_bounded_in_bytes(spark):
    rows = [(i, "word " * (200_000 if i % 7 == 0 else 40) + ("vile" if i % 2 else "")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    w, _ = T.fit(docs, labels, max_bytes=8_000)
    assert np.any(w)
    w, b = T.fit(docs, labels, max_bytes=10)
    assert not np.any(w) and np.isfinite(b)
