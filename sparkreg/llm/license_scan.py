"""License scan by diagonal voting.

Every document's words give rolling k-gram hashes, and Spark joins them to
the positions of the same hashes in license templates.  A hit at document
word p and template word t votes for the diagonal p - t.  Votes are summed
per document, template and diagonal; neighbouring diagonals (a word added
or left out) are merged, and a merged span is verified by the share of the
template that it covers and by how densely its words match.  A phrase counts
at each diagonal on which all its k-grams stand.

The template table is small and fixed, so it is broadcast; hits are
aggregated before anything is gathered, and a document's text stays in the
scan that reads it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.llm.common import ascii_lower, text_or_empty, write_table

LICENSE_WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Diagonals at most this far apart belong to one span.
GAP = 2
MIN_COVER = 0.7
MIN_DENSITY = 0.5

#: The phrases every place of which counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of common licenses, as their publishers word them.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "either version 2 of the license or at your option any later version": "gpl-or-later",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this work has been dedicated to the public domain": "public-domain",
}


def template_table(spark, phrases: Mapping[str, str], templates: Mapping[str, str], k: int) -> DataFrame:
    """(gram, tpos, tid, label, base, grams, words): the grams' words with
    their places.  A template shorter than k words is one gram."""
    rows = []
    for tid, (text, label, base) in enumerate([(t, x, True) for t, x in phrases.items()]
                                              + [(t, x, False) for t, x in templates.items()]):
        w = text.split()
        n = min(k, len(w))
        rows += [(w[i:i + n], i, tid, label, base, len(w) - n + 1, len(w)) for i in range(len(w) - n + 1)]
    return spark.createDataFrame(rows, "gram array<string>, tpos int, tid int, label string, base boolean, "
                                       "grams int, words int")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, k: int = K,
                  gap: int = GAP, min_cover: float = MIN_COVER, min_density: float = MIN_DENSITY) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans (array of label, first word, last word,
    cover).

    A null or empty text has no words, no labels (empty strings) and score 0.
    Rows that repeat a doc_id, with the same text or another, are scanned
    each on their own; a null doc_id is scanned like any other.
    """
    spark = docs.sparkSession
    rows = template_table(spark, phrases, templates, k).collect()
    sizes = sorted({len(r["gram"]) for r in rows})
    firsts = sorted({r["gram"][0] for r in rows})
    words = F.regexp_extract_all(ascii_lower(text_or_empty(F.col(f"`{text_col}`"))), F.lit(LICENSE_WORD_RE), F.lit(0))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), words.alias("w"))

    # a k-gram can only meet a template where its first word does
    at = F.filter(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(
        F.array().cast("array<int>")), lambda i: F.get("w", i).isin(firsts))
    grams = F.transform(at, lambda i: F.struct(i.alias("pos"), *[
        F.xxhash64(*[F.get("w", i + j) for j in range(n)]).alias(f"h{n}") for n in sizes]))
    known = {n: [r["h"] for r in spark.createDataFrame(
        [(r["gram"],) for r in rows if len(r["gram"]) == n], "g array<string>").select(
        F.xxhash64(*[F.get("g", j) for j in range(n)]).alias("h")).distinct().collect()] for n in sizes}
    hit = F.filter(grams, lambda s: F.greatest(*[s[f"h{n}"].isin(known[n]) for n in sizes]))
    found = write_table(d.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                                 F.size("w").cast("long").alias("n_words"), hit.alias("hits")), "license-hits")

    places = template_table(spark, phrases, templates, k)
    places = places.withColumn("n", F.size("gram")).withColumn("h", F.coalesce(*[
        F.when(F.col("n") == n, F.xxhash64(*[F.get("gram", F.lit(j)) for j in range(n)])) for n in sizes]))
    hits = found.select("row", F.explode("hits").alias("x")).select(
        "row", F.col("x.pos").alias("pos"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"x.h{n}").alias("h")) for n in sizes])).alias("g")) \
        .select("row", "pos", "g.n", "g.h")
    votes = (hits.join(F.broadcast(places.drop("gram")), ["n", "h"])
             .groupBy("row", "tid", "label", "base", "grams", "words", (F.col("pos") - F.col("tpos")).alias("diag"))
             .agg(F.collect_set("tpos").alias("tset"), F.min("pos").alias("lo"),
                  F.max(F.col("pos") + F.col("n")).alias("hi")))
    votes = write_table(votes, "license-votes")

    base = (votes.where("base").where(F.size("tset") == F.col("grams")).groupBy("row")
            .agg(F.count("*").alias("n_base"), F.min("diag").cast("long").alias("first_word"),
                 F.max("diag").cast("long").alias("last_word"), F.collect_set("label").alias("base_set")))
    by_diag = Window.partitionBy("row", "tid").orderBy("diag")
    runs = (votes.where("not base")
            .withColumn("new", F.coalesce(F.col("diag") - F.lag("diag").over(by_diag) > gap, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("new").over(by_diag)))
    spans = (runs.groupBy("row", "tid", "label", "grams", "words", "run")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("tset")))).alias("hit"),
                  F.min("lo").alias("lo"), F.max("hi").alias("hi"))
             .withColumn("cover", F.col("hit") / F.col("grams"))
             .where(F.col("cover") >= min_cover)
             .where(F.col("cover") * F.col("words") >= min_density * (F.col("hi") - F.col("lo")))
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
                 F.col("lo").cast("long").alias("first"), (F.col("hi") - 1).cast("long").alias("last"),
                 "label", "cover"))).alias("spans")))
    out = found.drop("hits").join(base, "row", "left").join(spans, "row", "left")
    none = F.array().cast("array<string>")
    base_set = F.coalesce("base_set", none)
    more = F.coalesce(F.transform("spans", lambda s: s["label"]), none)
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(
        "spans", lambda s: s["cover"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                      "first_word", "last_word", join(base_set).alias("base_labels"),
                      join(F.concat(base_set, more)).alias("labels"), best.cast("double").alias("score"), "spans")
