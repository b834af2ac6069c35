"""Toxicity classifier: character n-grams scaled by naive Bayes log-count
ratios, under a linear (logistic) model.

Which n-grams (of characters, 3 to 5 long, hashed) a text holds is a set of
indices.  From the labelled rows come the log-count ratio r of every index,
and a logistic regression on the features x * r.  Fitting reads at most
``max_rows`` labelled rows, those with the smallest hash of their id, as far
as their texts together stay within ``max_bytes``; these bounds are the only
ones.  Scoring is one projection over all documents; the
weights (one float per hash bucket, 1 MB) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.llm.common import as_row, text_or_empty, write_table

BITS = 18
SIZES = (3, 4, 5)
#: Most labelled rows that a fit reads.
MAX_TRAIN_ROWS = 10_000
#: Most bytes of their texts, so that one task holds what it fits on.
MAX_TRAIN_BYTES = 32 << 20
THRESHOLD = 0.3
SMOOTH = 0.5
#: Log-count ratios nearer to zero than this leave the model.
MIN_RATIO = 0.3
L2 = 0.5
ROUNDS = 80
_CHUNK = 1 << 20
_BLOCK = 1000


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 2 by 4; a null id
    counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def ngram_ids(text: str) -> np.ndarray:
    """The distinct hashed n-grams of the lower-cased text, all of it."""
    plain = " " + " ".join(text.lower().split()) + " "
    if plain.isascii():                                    # a byte a character, of the same number
        raw = np.frombuffer(plain.encode(), dtype=np.uint8)
    else:
        raw = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    flags = np.zeros(1 << BITS, dtype=bool)
    for lo in range(0, len(raw), _CHUNK):                  # bounded memory for very long texts
        x = raw[lo:lo + _CHUNK + max(SIZES) - 1].astype(np.uint32)
        h = np.zeros(len(x), dtype=np.uint32)
        for n in range(1, max(SIZES) + 1):
            if len(x) < n:
                break
            h = h[:len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1:]
            if n in SIZES:
                flags[((h ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(flags).astype(np.int32)


def fit_weights(texts: list[str], y: np.ndarray, l2: float = L2, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weight per hash bucket, bias); all zero weights when a class is
    missing, with the smoothed base rate as bias."""
    y = np.asarray(y, dtype=np.float32)
    n, d = len(y), 1 << BITS
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5 + 9.0 * (n == 0))))
    if n == 0 or y.min() == y.max():
        return np.zeros(d, dtype=np.float32), base
    pos, neg = np.zeros(d), np.zeros(d)
    for t, label in zip(texts, y):
        (pos if label else neg)[ngram_ids(t)] += 1
    r = np.where(pos + neg >= 3, np.log((pos + SMOOTH) / (y.sum() + 2 * SMOOTH)) - np.log(
        (neg + SMOOTH) / (n - y.sum() + 2 * SMOOTH)), 0).astype(np.float32)
    r[np.abs(r) < MIN_RATIO] = 0
    blocks = []                                             # some documents at a time: labels, sizes, indices
    for lo in range(0, n, _BLOCK):
        ids = [i[r[i] != 0] for i in map(ngram_ids, texts[lo:lo + _BLOCK])]
        blocks.append((y[lo:lo + _BLOCK], np.array([len(i) for i in ids]), np.concatenate(ids)))
    w, b = np.zeros(d, dtype=np.float32), base
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, rounds + 1):                          # full-batch steps with moment scaling
        rw, g = r * w, np.zeros(d + 1)
        for label, size, ids in blocks:
            doc = np.repeat(np.arange(len(size)), size)
            z = np.bincount(doc, weights=rw[ids], minlength=len(size)) + b
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
            g[:-1] += np.bincount(ids, weights=np.repeat(err, size), minlength=d)
            g[-1] += err.sum()
        g[:-1] = r * g[:-1] + l2 * w
        g /= n
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        step = 0.1 * (1 - t / (rounds + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.98 ** t)) + 1e-7)
        w, b = (w - step[:-1] * (r != 0)).astype(np.float32), b - float(step[-1])
    return (r * w).astype(np.float32), b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS,
        max_bytes: int = MAX_TRAIN_BYTES) -> tuple[np.ndarray, float]:
    """Fit on the labelled rows that are not held out.  Rows with a null id or
    label are no training rows; an id that is labelled or stored twice
    counts once, with its smallest label and text."""
    lab = (labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y"))
           .where("i is not null and y is not null").where(~held_out(F.col("i")))
           .groupBy("i").agg(F.min("y").alias("y")))
    lab = lab.orderBy(F.md5(F.col("i").cast("string").cast("binary")), "i").limit(max_rows)
    lab = write_table(lab, "tox-labels")                    # at most max_rows ids
    text = docs.select(F.col(f"`{id_col}`").alias("i"), text_or_empty(F.col(f"`{text_col}`")).alias("t"))
    train = text.join(F.broadcast(lab), "i").groupBy("i", "y").agg(F.min("t").alias("t")) \
        .where(F.octet_length("t") <= max_bytes)
    in_turn = Window.orderBy(F.md5(F.col("i").cast("string").cast("binary")), "i")       # of at most max_rows rows
    train = train.withColumn("upto", F.sum(F.octet_length("t").cast("long")).over(in_turn)) \
        .where(F.col("upto") <= max_bytes).drop("upto")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"i": [], "t": [], "y": []})]).sort_values("i")
        w, b = fit_weights(rows["t"].tolist(), rows["y"].to_numpy())
        yield pd.DataFrame({"w": [w.tobytes()], "b": [b]})

    got = train.repartition(1).mapInPandas(run, "w binary, b double").collect()
    if not got:
        return fit_weights([], np.zeros(0))
    return np.frombuffer(got[0]["w"], dtype=np.float32), got[0]["b"]


def scorer(spark, weights: np.ndarray, bias: float):
    """A column function: text -> probability of the label."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = shared.value
        z = np.array([float(w[ngram_ids(t)].sum(dtype=np.float64)) for t in texts], dtype=float) + bias
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD, max_rows: int = MAX_TRAIN_ROWS,
                   max_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """One row per input row: ``row`` (the input as a struct), doc_id,
    held_out, score, predicted.

    A null text is scored as the empty one, which gets the bias's
    probability.  A null doc_id is scored like any other and held out by the
    crc32 of the empty text.  Without labelled rows of both classes every
    text gets the base rate.  Repeated rows score alike.
    """
    w, b = fit(docs, labels, id_col, text_col, max_rows=max_rows, max_bytes=max_bytes)
    score = scorer(docs.sparkSession, w, b)
    out = docs.select(as_row(docs).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                      held_out(F.col(f"`{id_col}`")).alias("held_out"),
                      score(text_or_empty(F.col(f"`{text_col}`"))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
