"""Corpus pipeline: toxic documents go, exact copies go, one document of each
group of near-duplicates stays, sources are mixed to target weights, and what
is left is tokenised.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame.  All but the last return the columns of the
documents they got.  ``run`` applies them to the documents table and writes
each stage's result to the shared folder, where the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreg.llm.bpe import digests, encode_decode
from sparkreg.llm.common import prepare, write_table
from sparkreg.llm.exact_dedup import keep_rows
from sparkreg.llm.mixing import emit_copies
from sparkreg.llm.queries import VOCABULARY, table
from sparkreg.llm.simhash import keep_one
from sparkreg.llm.toxicity import score_toxicity

#: Classifier scores and seeded models have no SQL form; tests/llm compares
#: each stage with a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    prepare(spark)
    scored = score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0")
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    prepare(spark)
    return keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest doc_id."""
    prepare(spark)
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    prepare(spark)
    return emit_copies(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    prepare(spark)
    return digests(encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, f"pipeline-{name}")
    return docs
