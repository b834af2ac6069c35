"""Small tables with the awkward cases: nulls, empty and long texts, ties,
repeated rows, extra columns whose names the operators use inside."""

from __future__ import annotations

import random

WORDS = ("the and of alder birch cedar elm fir hazel larch maple oak pine rowan spruce willow yew été Größe niño "
         "license general public cc by all rights reserved").split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, fp long, t string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize()


def documents(spark, seed: int = 1, n: int = 60):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 60)) for _ in range(n // 3)]
    texts = []
    for _ in range(n):
        t = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            t = t + "\n" + prose(rng, 30)
        elif kind < 0.4:
            t = t.upper()
        elif kind < 0.5:
            t = t[:-1] + "x"
        elif kind < 0.6:
            t = "  \t" + t + "\r\n\n" + rng.choice(base)
        texts.append(t)
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", "b", "b", None, "é"]), len(t), "r", i, i, "t")
            for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None, None, None, None, None), (1001, "", "en", "a", 0, "", 0, 0, ""),
             (1002, " \n\t ", "en", "", 3, "", 0, 0, ""), (1003, "word", "en", "c", 4, "", 0, 0, ""),
             (1004, prose(rng, 20_000), "en", "d", 0, "", 0, 0, ""), (1005, "x" * 3000, "en", "a", 0, "", 0, 0, ""),
             (None, base[0], "en", "a", 0, "", 0, 0, ""), (None, "no id " + prose(rng, 12), "en", "a", 0, "", 0, 0, ""),
             (7, rows[7][1], "en", "b", 0, "r", 7, 7, "t"), (7, rows[7][1], "en", "b", 0, "r", 7, 7, "t"),
             (8, "another text under a repeated id", "en", "b", 0, "r", 7, 7, "t")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
