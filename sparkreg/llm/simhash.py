"""SimHash near-duplicates with Golay-code fuzzy hashing.

A document's fingerprint is the bitwise majority of the XXH64 values of its
word shingles.  Two fingerprints link at ``max_bits`` = 2 or fewer differing
bits.  The 64 bits are cut into three segments; with two errors at least one
segment is free of them (pigeonhole), so a key holds one segment exactly and
the next one fuzzily: the segment is decoded with the perfect binary Golay
code [23, 12], as it stands and after every single-bit change.  That gives
one to six codeword indices, and words within distance two always share one.
Fingerprints that share a key are joined and verified.

A key that many different fingerprints share is not joined with itself: its
fingerprints are linked through every word one bit away.  Fingerprints that
share such a midpoint are within two bits of each other, and each pair within
two bits shares one, so the star to the smallest of them loses no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreg.llm.common import as_row, connected_components, text_or_empty, write_table

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Keys with more different fingerprints than this link through midpoints.
BUCKET = 32
#: The three segments: (first bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code (fixed value).
GOLAY_POLY = 0b110001110101
_CHUNK = 1 << 16


def _remainder(x: np.ndarray) -> np.ndarray:
    """x mod the generator polynomial, over GF(2), for 23-bit words."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where((x >> bit) & 1, GOLAY_POLY << (bit - 11), 0)
    return x


def _error_table() -> np.ndarray:
    """The error pattern of up to three bits that belongs to each syndrome."""
    one = 1 << np.arange(23)
    i, j, k = np.meshgrid(*[np.arange(23)] * 3, indexing="ij")
    three = (one[i] | one[j] | one[k]).ravel()
    pats = np.unique(np.concatenate([[0], three]))
    table = np.zeros(1 << 11, dtype=np.int64)
    table[_remainder(pats)] = pats
    return table


_ERRORS: list[np.ndarray] = []


def codeword(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    if not _ERRORS:
        _ERRORS.append(_error_table())
    return (x ^ _ERRORS[0][_remainder(x)]) >> 11


def fuzzy_codewords(x: np.ndarray) -> np.ndarray:
    """(n, 24) codeword indices of each word and of its one-bit changes."""
    return np.stack([codeword(x)] + [codeword(x ^ (1 << b)) for b in range(23)], axis=1)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()     # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    lo, hi = (ends - size)[:len(words) - k + 1], ends[k - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for c in range(0, len(lo), _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(lo[c:c + _CHUNK].tolist(), hi[c:c + _CHUNK].tolist())],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > len(lo))
    return sum(1 << int(b) for b in bits)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE,
                 beside: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp) and the columns ``beside``: fp is the fingerprint as a
    signed long."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), fp(text_or_empty(F.col(f"`{text_col}`"))).alias("fp"),
                       *[c.alias(name) for name, c in (beside or {}).items()])


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(key, fp) rows, three to eighteen per fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            u = fp.view(np.uint64)
            part = [((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
            for s in range(3):
                codes = np.sort(fuzzy_codewords(part[(s + 1) % 3]), axis=1)
                new = np.ones(codes.shape, dtype=bool)
                new[:, 1:] = codes[:, 1:] != codes[:, :-1]
                key = (codes | (part[s][:, None] << 12) | (s << 34))[new]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(fp, new.sum(axis=1)))],
                                                 names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v) edges between different fingerprints that keep the components
    of the relation "at most two bits apart"."""
    keys = fuzzy_keys(fps)
    n = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = write_table(keys.join(n, "key"), "simhash-keys")
    a = shared.where(F.col("n") <= bucket).select("key", F.col("fp").alias("u"))
    b = a.withColumnRenamed("u", "v")
    near = a.join(b, "key").where("u < v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    many = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)),
                        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    mids = many.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("mid"))
    low = mids.groupBy("mid").agg(F.min("fp").alias("v"), F.count("*").alias("c")).where("c > 1")
    stars = mids.join(low, "mid").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.select("u", "v").unionByName(stars).distinct()


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, bucket: int) -> DataFrame:
    """(doc_id, fp, t0, t1, component_id, one) for every row: t0 and t1 hash
    the text, and ``one`` is whether the row's id and text are those that its
    component is named by."""
    text = text_or_empty(F.col(f"`{text_col}`"))
    table = write_table(fingerprints(docs, id_col, text_col, shingle, {"t0": F.xxhash64(text), "t1": F.xxhash64(F.lit(1), text)}),
                        "simhash-fp")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "fp", "t0", "t1"))
    reps = write_table(table.groupBy("fp").agg(F.min(named).alias("rep")), "simhash-reps")
    roots = connected_components(links(reps.select("fp"), bucket))
    rooted = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
                 .select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = write_table(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("rep").alias("best"))
    best = rooted.join(ids, "root").select("fp", "best")
    same = [F.col(c) == F.col(f"best.{c}") for c in ("doc_id", "t0", "t1")]
    return table.join(best, "fp").select("doc_id", "fp", "t0", "t1", F.col("best.doc_id").alias("component_id"),
                                         F.coalesce(same[0] & same[1] & same[2], F.lit(False)).alias("one"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links, itself included).

    Words are runs without ASCII white space, with A-Z lower-cased; shingles
    keep their repeats; a text with fewer words than a shingle is one
    shingle.  A null or empty text has fingerprint 0 and links like any
    other.  A null doc_id never names a component: such a row gets the
    smallest id of its component, null if there is none.  Repeated rows and
    equal texts share a fingerprint, so they are never joined pair by pair.
    """
    return _classed(docs, id_col, text_col, shingle, bucket).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one document: that
    with the smallest doc_id, and of different texts under that id the one
    whose fingerprint, then hash, is smallest.

    A row goes by its id and text, not by its id alone: another text under a
    repeated id is judged in its own component.  Rows that repeat both the id
    and the text of the document that stays, stay with it; rows without a
    doc_id, which no component can name, stay.
    """
    gone = _classed(docs, id_col, text_col, shingle, bucket).where("doc_id is not null and not one") \
        .select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "t0", "t1")]).distinct()
    text = text_or_empty(F.col(f"`{text_col}`"))
    rows = docs.select(as_row(docs).alias("row"), F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__a"),
                       F.xxhash64(F.lit(1), text).alias("__b"))
    same = (F.col("__id") == F.col("__doc_id")) & (F.col("__a") == F.col("__t0")) & (F.col("__b") == F.col("__t1"))
    return rows.join(gone, same, "left_anti").select("row.*")
