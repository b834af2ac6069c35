"""BPE with word ends against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from edge_tables import documents, empty
from tokenizers import Tokenizer

from sparkreg.llm import queries, word_bpe

VOCAB = public_tokenizers.path(queries.WORD_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCAB)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(3)
    odd = ["a", "b", "The", "ing", " ", "  ", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", "é", "É", "ΑΣ", "Σ", "İ",
           "漢字", "🙂", "\U0001f1e9", "'ll", "'S", "½", "12", "!?", "...", "<|endoftext|>", "<|startoftext|>", "<|endof",
           "ß", "՘", "࢏", "ﬁ", "가", "힣", "Ǆ", "ͅ", "\x00", "ⅷ", "½", "</w>", "Ġ"]
    return ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(400)]


def test_equals_the_library(spark, library):
    docs = documents(spark)
    extra = texts() + ["ab" * 20_000, "x" * 50_000, "Größe " * 5_000, "á" * 3_000, "!" * 9_999]
    more = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    out = word_bpe.encode_decode(docs, VOCAB)
    got = out.select("doc_id", "row.text", "ids", "n_tokens", "decoded").collect()
    assert len(got) == docs.count()
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    for r, d in zip(got, word_bpe.digests(out).collect()):
        assert d.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert word_bpe.encode_decode(empty(spark), VOCAB).count() == 0


def test_a_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(word_bpe, "WORD_KEPT_CHARS", 4)
    enc = word_bpe.Encoder(word_bpe.load_vocabulary(VOCAB))
    for t in texts()[:80]:
        got = enc.encode(t)
        ids = [int.from_bytes(got[i:i + 4], "little") for i in range(0, len(got), 4)]
        assert ids == library.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError, AttributeError, TypeError)):
        word_bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_on_whole_table(spark, sf_small, library):
    got = {r.doc_id: r for r in queries.QUERIES["op11_word_bpe"](spark, sf_small).collect()}
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
