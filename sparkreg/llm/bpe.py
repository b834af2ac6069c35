"""Byte-level BPE encoding and decoding.

A text is cut into words by the vocabulary's pattern; a word's bytes are the
first pieces, and merges are folded over them in the order of their rank
until none applies.  A task folds each distinct word once and keeps the
result, so a text costs one look-up per word.  Ids travel as little-endian
unsigned 32-bit integers in one binary column; decoding concatenates the
binary pieces of the ids.

The rank table (one entry per token, a fixed file named by its path) is
broadcast; documents are not moved.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreg.llm.common import as_row, text_or_empty

#: Distinct words that a task remembers before it starts anew.
WORDS_KEPT = 300_000
#: Longer words (in bytes) are merged with a heap instead of scans.
LONG_WORD = 96


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_word(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Token ids of one word: always the lowest-ranked pair, the leftmost of
    equals, is merged next."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    get, none = ranks.get, len(ranks) + 1
    cut = list(range(len(word) + 1))                # piece i is word[cut[i]:cut[i + 1]]
    pair = [get(word[i:i + 2], none) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        del cut[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[cut[i]:cut[i + 2]], none)
        if i:
            pair[i - 1] = get(word[cut[i - 1]:cut[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def _merge_long(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """The same merges, with the pairs in a heap ordered by rank and place."""
    n = len(word)
    end = list(range(1, n + 1))                     # where the piece that starts here ends; 0: merged away
    prev = list(range(-1, n - 1))
    heap = []

    def push(a: int):
        b = end[a]
        if b < n:
            r = ranks.get(word[a:end[b]])
            if r is not None:
                heapq.heappush(heap, (r, a, b, end[b]))

    for a in range(n):
        push(a)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or end[b] != c:              # one of the two has changed since
            continue
        end[a], end[b] = c, 0
        if c < n:
            prev[c] = a
        push(a)
        if prev[a] >= 0:
            push(prev[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a:end[a]]])
        a = end[a]
    return out


class _Words(dict):
    """word -> its packed ids, folded when first asked for."""

    def __init__(self, ranks: Mapping[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        ids = merge_word(word.encode("utf-8", "surrogatepass"), self.ranks)
        packed = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return packed


def splitter(pattern: str):
    """The pattern's matches in a text.  White space is Unicode's property,
    which four control characters are not in that Python counts as such."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


class Codec:
    """Column functions of one vocabulary: ``encode`` (text to packed ids),
    ``decode`` (packed ids to bytes), and ``both`` (a struct of the two)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        shared = spark.sparkContext.broadcast(load_ranks(path))

        def encoder():
            find, words = splitter(pattern), _Words(shared.value)
            return lambda t: b"".join(map(words.__getitem__, find(t)))

        def decoder():
            piece = [b""] * (max(shared.value.values()) + 1)
            for b, i in shared.value.items():
                piece[i] = b
            return lambda x: b"".join(map(piece.__getitem__, np.frombuffer(x, dtype="<u4").tolist()))

        @F.pandas_udf("binary")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            one = encoder()
            for batch in batches:
                yield batch.map(one)

        @F.pandas_udf("binary")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            one = decoder()
            for batch in batches:
                yield batch.map(one)

        @F.pandas_udf("ids binary, decoded binary")
        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            there, back = encoder(), decoder()
            for batch in batches:
                ids = batch.map(there)
                yield pd.DataFrame({"ids": ids, "decoded": ids.map(back)})

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, col: Column) -> Column:
        return self._encode(text_or_empty(col))

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)

    def both(self, col: Column) -> Column:
        """Encoded and decoded in the same task, in one exchange with Python."""
        return self._both(text_or_empty(col))


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: ``row`` (the input as a struct), doc_id, ids
    (packed little-endian unsigned 32-bit integers), n_tokens, decoded
    (binary, the UTF-8 bytes of the text again).

    A null or empty text has no ids and decodes to no bytes.  No special
    tokens are recognised or added.  Rows that repeat a doc_id, and rows with
    a null one, are encoded each on their own.
    """
    codec = Codec(docs.sparkSession, path, pattern)
    out = docs.select(as_row(docs).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                      codec.both(F.col(f"`{text_col}`")).alias("x"))
    return out.select("row", "doc_id", "x.ids", (F.octet_length("x.ids") / 4).cast("long").alias("n_tokens"),
                      "x.decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
