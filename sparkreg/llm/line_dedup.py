"""Line deduplication by a segment-partition edit join.

Lines within ``edits`` character edits of each other link, and of the lines
that links connect, the first one in the corpus stays.

A line is cut into edits + 1 segments.  Of two lines within that distance the
longer holds at least one segment of the other unchanged, close to where it
was, so a line is indexed under each of its segments together with its length,
and probes the indexes of its own and slightly shorter lengths with the few
substrings that can match there.  Spark joins indexes and probes on the hash
of (length, segment, substring); pairs are verified on the whole lines with a
banded bit-parallel edit distance.

An index entry that many lines share is not joined pair by pair.  At one edit,
its lines are keyed by themselves with one position masked, and with one
character left out: lines equal but for one position are all within one edit
of each other, so a star to the smallest of them keeps them connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.llm.common import connected_components, text_or_empty, write_table

EDITS = 1
#: Shorter lines match only lines that are equal.
MIN_CHARS = 12
#: Index entries with more lines than this are linked through masked lines.
BUCKET = 64
#: What str.strip() takes off.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Bits of the fixed-size filter by which candidate lines are fetched.
FILTER_BITS = 23
NO_ID = (1 << 63) - 1


def segments(size: int, edits: int) -> list[tuple[int, int]]:
    """(first, length) of the edits + 1 segments, the longer ones last."""
    n = edits + 1
    short, longer = size // n, size % n
    out, at = [], 0
    for i in range(n):
        length = short + (i >= n - longer)
        out.append((at, length))
        at += length
    return out


def probes(size: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, first, length) of the substrings of a line
    of ``size`` characters that can equal a segment of an indexed line no
    longer than it.  A segment can only have moved as far as the edits before
    it and those after it allow."""
    out = []
    for length in range(max(edits + 1, size - edits), size + 1):
        shift = size - length
        for i, (at, n) in enumerate(segments(length, edits)):
            after = edits - i
            lo = max(0, at - i, at + shift - after)
            hi = min(size - n, at + i, at + shift + after)
            out += [(length, i, p, n) for p in range(lo, hi + 1)]
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether a and b are at most ``edits`` edits apart.

    Bit o of ``reach[e]`` says that the first j characters of b match the
    first j + o - edits of a with e edits; only that band of 2 * edits + 1
    diagonals is followed.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    band = (1 << (2 * edits + 1)) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + edits)
    reach = [band & ((1 << (e + 1)) - 1) << edits for e in range(edits + 1)]   # e characters of a left out
    for j, c in enumerate(b):
        same = (where.get(c, 0) >> j) & band
        last, before = 0, 0
        for e in range(edits + 1):
            now = reach[e] & same
            if e:
                now |= before | before >> 1 | last << 1 & band
            before, reach[e] = reach[e], now
            last = now
        if not last:
            return False
    return bool(reach[edits] >> (len(a) - len(b) + edits) & 1)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def line_key(line: str) -> int:
    """The hash under which a line travels; Spark's xxhash64 agrees."""
    return _signed(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42))


def edit_keys(docs: DataFrame, text_col: str, edits: int, min_chars: int) -> DataFrame:
    """(key, line, probe) rows of all lines of at least ``min_chars``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, tuple] = {}
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            lines = {s for t in batch.column(0).to_pylist() for x in t.split("\n") if len(s := x.strip()) >= min_chars}
            keys, ids, probe = [], [], []
            for s in lines:
                n = len(s)
                plan = plans.get(n)
                if plan is None:
                    own = [(n, i, at, at + k) for i, (at, k) in enumerate(segments(n, edits))]
                    ask = [(m, i, at, at + k) for m, i, at, k in probes(n, edits)]
                    plan = plans[n] = [(f"{m} {i} ", a, b, False) for m, i, a, b in own] + \
                                      [(f"{m} {i} ", a, b, True) for m, i, a, b in ask]
                me = line_key(s)
                for head, a, b, p in plan:
                    keys.append(digest((head + s[a:b]).encode("utf-8", "surrogatepass"), 7))
                    ids.append(me)
                    probe.append(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.uint64()).view(pa.int64()), pa.array(ids, pa.int64()), pa.array(probe, pa.bool_())],
                names=["key", "line", "probe"])

    return docs.select(text_or_empty(F.col(f"`{text_col}`"))).mapInArrow(run, "key long, line long, probe boolean")


def masked_keys(lines: DataFrame) -> DataFrame:
    """(key, line, star): star keys join lines that differ in one position;
    the other keys join a line with those that hold one character more."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for me, s in zip(batch["line"], batch["text"]):
                rows = [(_signed(xxhash.xxh64_intdigest(s.encode(), 9)), me, False, True)]
                for i in range(len(s)):
                    cut = (s[:i] + s[i + 1:]).encode("utf-8", "surrogatepass")
                    rows.append((_signed(xxhash.xxh64_intdigest(cut + b"\n%d" % i, 8)), me, True, False))
                    if i == 0 or s[i] != s[i - 1]:
                        rows.append((_signed(xxhash.xxh64_intdigest(cut, 9)), me, False, False))
                yield pd.DataFrame(rows, columns=["key", "line", "star", "whole"])

    return lines.select("line", "text").mapInPandas(run, "key long, line long, star boolean, whole boolean")


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, text): the stripped lines of every document."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                    F.posexplode(F.split(text_or_empty(F.col(f"`{text_col}`")), "\n", -1)).alias("line_no", "x"))
    return d.select("doc_id", "line_no", F.btrim("x", F.lit(SPACES)).alias("text"))


def line_links(docs: DataFrame, lines: DataFrame, text_col: str, edits: int, min_chars: int,
               bucket: int) -> DataFrame:
    """(u, v): md5 names of different lines within ``edits`` edits, enough of
    them to connect all that are linked."""
    keys = edit_keys(docs, text_col, edits, min_chars).repartition("key").dropDuplicates(["key", "line", "probe"])
    n = keys.groupBy("key").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.count("*").alias("n"),
                                F.min("probe").alias("all_probes")).where("lo < hi and not all_probes")
    shared = write_table(keys.join(n.select("key", "n"), "key"), "line-keys")
    limit = bucket if edits == 1 else NO_ID
    few = shared.where(F.col("n") <= limit)
    a = few.where("not probe").select("key", F.col("line").alias("a"))
    b = few.where("probe").select("key", F.col("line").alias("b"))
    pairs = a.join(b, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) \
        .distinct()
    pairs = write_table(pairs, "line-pairs")
    many = shared.where(F.col("n") > limit).select("line").distinct()
    wanted = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))) \
        .unionByName(many).distinct()

    # the texts of the wanted lines: a filter of fixed size first, then the join
    bit = F.pmod("line", F.lit(1 << FILTER_BITS))
    word, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    sieve = wanted.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))     # at most 2 ** 17 rows
    named = lines.where(F.char_length("text") >= min_chars).withColumn("line", F.xxhash64("text"))
    named = named.withColumn("word", word).join(F.broadcast(sieve), "word") \
        .where(F.col("bits").bitwiseAND(mask) != 0).select("line", "text")
    # an inner join with the distinct names: a semi join would be moved below the filter
    texts = write_table(named.join(wanted, "line").dropDuplicates(["line", "text"]), "line-texts")

    masked = masked_keys(texts.join(many, "line", "left_semi"))
    low = masked.groupBy("key", "star").agg(F.when(F.col("star"), F.min("line")).otherwise(
        F.min(F.when(F.col("whole"), F.col("line")))).alias("b"))
    stars = masked.join(low, ["key", "star"]).where("line <> b").select(F.col("line").alias("a"), "b")
    pairs = pairs.unionByName(stars).distinct()

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([within(p, q, edits) for p, q in zip(x, y)], dtype=bool)

    left = texts.select(F.col("line").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("line").alias("b"), F.col("text").alias("tb"))
    found = pairs.join(left, "a").join(right, "b").where(near("ta", "tb"))
    return found.select(F.md5(F.col("ta").cast("binary")).alias("u"), F.md5(F.col("tb").cast("binary")).alias("v"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
                min_chars: int = MIN_CHARS, bucket: int = BUCKET) -> DataFrame:
    """One row per line of every document: doc_id, line_no (from 0), keep_doc_id
    and keep_line_no (the first line of its class), kept.

    Lines end at line feeds and are compared without white space around
    them, over all their code points; lines shorter than ``min_chars`` match
    equal ones only, and empty lines are always kept, each for itself.  The
    first line is the one with the smallest (doc_id, line_no); a null doc_id
    comes last.  A null text is one empty line.  A line is named by doc_id
    and number, so of rows that repeat a doc_id the lines with one number are
    kept or dropped by their own texts.
    """
    lines = split_lines(docs, id_col, text_col)
    occ = lines.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("line_no").alias("l"),
                       F.when(F.col("text") != "", F.md5(F.col("text").cast("binary"))).alias("name"))
    occ = write_table(occ, "lines")
    first = occ.where("name is not null").groupBy("name").agg(F.min(F.struct("d", "l")).alias("first"))
    roots = write_table(connected_components(line_links(docs, lines, text_col, edits, min_chars, bucket)),
                        "line-classes")
    merged = roots.join(first.withColumnRenamed("name", "node"), "node")
    merged = merged.join(merged.groupBy("root").agg(F.min("first").alias("keep")), "root").select(
        F.col("node").alias("name"), "keep")
    keep = first.join(merged, "name", "left").select("name", F.coalesce("keep", "first").alias("keep"))
    out = occ.join(keep, "name", "left")
    own = F.coalesce("keep", F.struct("d", "l"))
    ident = lambda c: F.when(c != NO_ID, c)
    return out.select(ident(F.col("d")).alias("doc_id"), F.col("l").alias("line_no"),
                      ident(own["d"]).alias("keep_doc_id"), own["l"].alias("keep_line_no"),
                      ((own["d"] == F.col("d")) & (own["l"] == F.col("l"))).alias("kept"))
