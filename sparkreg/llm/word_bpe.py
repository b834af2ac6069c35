"""BPE encoding and decoding with a vocabulary of words that have ends.

A text is normalised (NFC, white space to one space, lower case), cut into
words by the vocabulary's pattern, and a word's UTF-8 bytes become its first
symbols, the last of them marked as the end of the word.  The symbols form a
doubly linked list.  A priority queue holds the neighbouring pairs that have
a merge, lowest rank first and the leftmost of equals; an entry whose pair
has changed since is stale and skipped.  Decoding concatenates the
vocabulary's strings, one space between two of them.

A task merges each distinct word once.  Documents are not moved; the
vocabulary (one entry a token and a merge, a fixed file named by its path)
is broadcast.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreg.llm.common import as_row, text_or_empty

#: Distinct words that a task remembers before it starts anew, and their
#: longest length in characters.
WORDS_KEPT = 200_000
WORD_KEPT_CHARS = 200
#: A queue entry is rank * 2**32 + place, a pair left * 2**20 + right.
PLACE_BITS, ID_BITS = 32, 20
PLACE_MASK = (1 << PLACE_BITS) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself for visible
    Latin-1 characters, the next one from U+0100 on for the others."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(seen))}
    return [rest.get(b, chr(b)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What a tokenizer file says, as plain values.  Refuses a file whose
    steps are not the ones implemented here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, norm = spec["model"], spec["pre_tokenizer"], spec["normalizer"]
    kinds = ([n["type"] for n in norm.get("normalizers", [])], [p["type"] for p in pre.get("pretokenizers", [])],
             model["type"], spec["decoder"], model["unk_token"], model["dropout"], model["continuing_subword_prefix"])
    if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE", None, None, None, None):
        raise ValueError(f"not a vocabulary of word ends: {kinds}")
    vocab = model["vocab"]
    if max(vocab.values()) >= 1 << ID_BITS:
        raise ValueError("too many tokens")
    end, chars = model["end_of_word_suffix"] or "", byte_symbols()
    ranks, made = {}, []
    for a, b in model["merges"]:
        ranks[vocab[a] << ID_BITS | vocab[b]] = len(made)
        made.append(vocab[a + b])
    pieces = [""] * (max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]]) + 1)
    for s, i in vocab.items():
        pieces[i] = s
    for t in spec["added_tokens"]:
        pieces[t["id"]] = t["content"]
    return {"ranks": ranks, "made": made, "pieces": pieces,
            "inner": [vocab.get(c) for c in chars], "last": [vocab.get(c + end) for c in chars],
            "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
            "pattern": pre["pretokenizers"][0]["pattern"]["Regex"]}


def merge_word(word: str, voc: dict) -> list[int]:
    """Token ids of one normalised word."""
    data = word.encode("utf-8", "surrogatepass")
    inner, ranks, made = voc["inner"], voc["ranks"], voc["made"]
    sym = [inner[b] for b in data[:-1]] + [voc["last"][data[-1]]]
    sym = [s for s in sym if s is not None]          # a byte without a symbol has no token
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        r = ranks.get(sym[i] << ID_BITS | sym[i + 1])
        if r is not None:
            queue.append(r << PLACE_BITS | i)
    heapq.heapify(queue)
    while queue:
        top = heapq.heappop(queue)
        i = top & PLACE_MASK
        new = made[top >> PLACE_BITS]
        j = after[i]
        if sym[i] < 0 or j >= n:                     # merged away, or nothing follows any more
            continue
        now = ranks.get(sym[i] << ID_BITS | sym[j])
        if now is None or made[now] != new:          # the pair has changed since
            continue
        sym[i], sym[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = ranks.get(new << ID_BITS | sym[k])
            if r is not None:
                heapq.heappush(queue, r << PLACE_BITS | i)
        p = before[i]
        if p >= 0:
            r = ranks.get(sym[p] << ID_BITS | new)
            if r is not None:
                heapq.heappush(queue, r << PLACE_BITS | p)
    return [s for s in sym if s >= 0]


class _Words(dict):
    """word -> its packed ids, merged when first asked for."""

    def __init__(self, voc: dict):
        super().__init__()
        self.voc = voc

    def __missing__(self, word: str) -> bytes:
        ids = merge_word(word, self.voc)
        packed = struct.pack(f"<{len(ids)}i", *ids)
        if len(word) <= WORD_KEPT_CHARS:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = packed
        return packed


class Encoder:
    """Text to packed ids.  Added tokens are found in the text as it stands;
    what lies between two of them is normalised and cut by itself."""

    def __init__(self, voc: dict):
        self.words = _Words(voc)
        space = voc["pattern"].replace(r"\s", r"\p{White_Space}")
        self.find, self.spans = regex.compile(space).findall, regex.compile(space).finditer
        self.word_like = regex.compile(r"[\p{L}\p{N}]").match
        self.added = {s: struct.pack("<i", i) for s, i in voc["added"].items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, longest_first))).finditer if longest_first else None

    def encode(self, text: str) -> bytes:
        if self.marks is None or not any(s in text for s in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.marks(text):
            out += [self._plain(text[at:m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            found = self.find(text.lower())
        else:
            # a capital sigma has one small form here, whatever follows it; white space
            # never belongs to a word, so it need not be turned into spaces first
            t = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            # letters newer than Python's Unicode tables count as symbols
            new = [c for c in set(t) if c > "Ԁ" and unicodedata.category(c) == "Cn" and self.word_like(c)]
            if new:
                shown = t.translate({ord(c): "☃" for c in new})
                found = [t[m.start():m.end()] for m in self.spans(shown)]
            else:
                found = self.find(t)
        return b"".join(map(self.words.__getitem__, found))


def _column(spark: SparkSession, path: str):
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, piece = Encoder(shared.value).encode, shared.value["pieces"].__getitem__
        for batch in batches:
            packed = [encode(t) for t in batch.to_pylist()]
            ends = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
            flat = np.frombuffer(b"".join(packed), dtype="<i4")
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            texts = pa.array([" ".join(map(piece, np.frombuffer(p, dtype="<i4").tolist())) for p in packed], pa.string())
            yield pa.StructArray.from_arrays([ids, texts], ["ids", "decoded"])

    return both


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row`` (the input as a struct), doc_id, ids
    (array<int>), n_tokens, decoded (the vocabulary's strings of the ids, a
    space between two).

    A null, empty or blank text has no ids and decodes to the empty string.
    The strings of the added tokens are tokens wherever they stand in a text.
    Rows that repeat a doc_id, and rows with a null one, are encoded each on
    their own; a very long word is merged whole.  Capital letters that are
    newer than Python's Unicode tables (15.1) stay capital.
    """
    both = _column(docs.sparkSession, path)
    out = docs.select(as_row(docs).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                      both(text_or_empty(F.col(f"`{text_col}`"))).alias("x"))
    return out.select("row", "doc_id", "x.ids", F.size("x.ids").cast("long").alias("n_tokens"), "x.decoded")


def decimal_ids(ids: Column) -> Column:
    """The ids in decimal, joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return encoded.select("doc_id", "n_tokens", F.sha2(decimal_ids(F.col("ids")), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
