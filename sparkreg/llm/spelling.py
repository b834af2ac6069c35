"""Spelling variants: words one edit apart, grouped under the most frequent.

Words of one length share a k-d tree over their letter counts
(``letter_tree``).  Its upper splits come from a bounded sample and cut the
length into cells; every word goes to the cell that holds it, and as a query
to every cell of its own length and of the next one that an edit can reach.
A task reads a cell's words, builds the lower tree and searches it, a block
of queries at a time.  A cell whose words cannot be told apart by their
letters is cut by a hash, and its queries go to each piece.

A word has at most some hundred edits a letter, so no group of pairs grows
with the table.  Forms are followed to their roots by pointer jumping: each
form is at least twice as frequent, so a chain is short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.llm.common import ascii_lower, text_or_empty, write_table
from sparkreg.llm.letter_tree import DIMS, Tree, WordIndex, code_points, letter_counts

#: Letters of a word.
LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_CHARS, MIN_COUNT, DAMAGE_ONE_IN = 5, 3, 97
#: A form is at least so many times as frequent as the word.
FORM_TIMES = 2
#: Words a cell holds, and their letters in all; words in the sample that the
#: upper splits are chosen from.
CELL_WORDS, CELL_LETTERS, SAMPLE_WORDS = 4_000, 400_000, 60_000
#: Queries searched for at once, and words routed at once.
QUERY_BLOCK, ROUTED_ROWS = 8_192, 16_384


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, damage_one_in: int | None = DAMAGE_ONE_IN) -> DataFrame:
    """(word, n): the words of at least ``min_chars`` code points that stand
    at least ``min_count`` times in the texts.

    With ``damage_one_in`` a word loses one letter in every document where
    the CRC-32 of its id, a colon and the word is divisible by that number;
    a null id counts as an empty one.
    """
    runs = F.regexp_extract_all(text_or_empty(F.col(f"`{text_col}`")), F.lit(f"{LETTERS}{{{int(min_chars)},}}"), F.lit(0))
    w = (docs.select(text_or_empty(F.col(f"`{id_col}`")).alias("id"), F.explode(runs).alias("w"))
         .select("id", ascii_lower(F.col("w")).alias("w")))
    if damage_one_in:
        w = w.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "w")))
        at = F.pmod("h", F.length("w")).cast("int")
        cut = F.concat(F.col("w").substr(F.lit(1), at), F.col("w").substr(at + 2, F.length("w")))
        w = w.select(F.when(F.pmod("h", F.lit(damage_one_in)) == 0, cut).otherwise(F.col("w")).alias("w"))
    return (w.select(F.col("w").alias("word")).where(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _room(chars: int, cell_words: int) -> int:
    """Words of that length which a cell may hold."""
    return max(1, min(cell_words, CELL_LETTERS // chars))


def _plan(words: DataFrame, cell_words: int, sample_words: int) -> tuple[dict, dict]:
    """({length: upper tree}, {length: number of its first cell}) from a
    bounded sample: words whose hash lies below a bound."""
    sizes = {r["chars"]: r["n"] for r in words.groupBy(F.length("word").alias("chars")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    some = words.select("word")
    if total > sample_words:
        some = some.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(sample_words / total * (1 << 30)))
    by_chars: dict = {}
    for r in some.orderBy(F.xxhash64("word"), "word").limit(2 * sample_words).collect():
        by_chars.setdefault(len(r["word"]), []).append(r["word"])
    trees, first, at = {}, {}, 0
    for chars, drawn in sorted(by_chars.items()):
        leaf = max(1, int(_room(chars, cell_words) * len(drawn) / sizes[chars]))
        tree = Tree(letter_counts(code_points(drawn)), leaf, tight=False)
        tree.points = np.empty((0, DIMS), np.int16)
        for node in tree.nodes:
            node.rows = None
        trees[chars], first[chars], at = tree, at, at + tree.leaves
    return trees, first


class _Router:
    """The cells of a word: the one that holds it, those its edits reach."""

    def __init__(self, trees: dict, first: dict):
        self.trees, self.first = trees, first

    def home(self, chars: int, counts: np.ndarray) -> np.ndarray:
        if chars not in self.trees:                  # a length the sample has not seen is one cell
            return np.full(len(counts), -chars, dtype=np.int64)
        return self.first[chars] + self.trees[chars].leaf_of(counts)

    def of_length(self, chars: int) -> range:
        """The cells of a length."""
        if chars not in self.trees:
            return range(-chars, 1 - chars)
        return range(self.first[chars], self.first[chars] + self.trees[chars].leaves)

    def reached(self, chars: int, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for other, down in ((chars, 1), (chars + 1, 0)):
            if other not in self.trees:
                yield -other, np.arange(len(counts))
                continue
            for node, rows in self.trees[other].reach(counts, 1, down):
                yield self.first[other] + node.leaf, rows


def _batches_of(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in larger batches."""
    waiting, n = [], 0
    for pdf in batches:
        waiting.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(waiting, ignore_index=True)
            waiting, n = [], 0
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def _by_length(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in ``words``, letter counts)."""
    chars = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(chars, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(chars[order])) + 1):
        if len(some):
            yield int(chars[some[0]]), some, letter_counts(code_points(words[some].tolist()))


#: What a routed row is: a word of the cell, a query from the same cell, or
#: one from another cell.
HELD, OWN, GUEST = 0, 1, 2


def _routed(words: DataFrame, cell_words: int, sample_words: int) -> DataFrame:
    """(cell, piece, role, word, n): each word in its cell, as a query in all
    pieces of it, and in those of the other cells that it reaches.  Of two
    cells of one length only the later is searched from the earlier."""
    trees, first = _plan(words, cell_words, sample_words)
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(_Router(trees, first))
    words = words.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(1 << 30)).alias("h"))
    words = words.repartition(max(2 * spark.sparkContext.defaultParallelism, words.count() // ROUTED_ROWS), "h")

    def homes(batches):
        for pdf in _batches_of(batches, ROUTED_ROWS):
            for chars, some, counts in _by_length(pdf["word"].to_numpy()):
                yield pd.DataFrame({"cell": shared.value.home(chars, counts), "most": _room(chars, cell_words)})

    full = (words.select("word").mapInPandas(homes, "cell long, most int").groupBy("cell")
            .agg(F.ceil(F.count("*") / F.max("most")).cast("int").alias("pieces")).where("pieces > 1"))
    pieces = {r["cell"]: r["pieces"] for r in full.collect()}

    def route(batches):
        for pdf in _batches_of(batches, ROUTED_ROWS):
            word, n, h = (pdf[c].to_numpy() for c in ("word", "n", "h"))
            for chars, some, counts in _by_length(word):
                home = shared.value.home(chars, counts)
                many = np.array([pieces.get(c, 1) for c in home.tolist()])
                out = [(home, h[some] % many, HELD, np.arange(len(some)))]
                for cell, rows in shared.value.reached(chars, counts):
                    own = home[rows] == cell
                    later = rows[(home[rows] < cell) & ~own] if cell in shared.value.of_length(chars) else rows
                    for piece in range(pieces.get(cell, 1)):
                        out += [(cell, piece, OWN, rows[own]), (cell, piece, GUEST, later)]
                sizes = [len(rows) for *_, rows in out]
                at = some[np.concatenate([rows for *_, rows in out])]
                cells, parts, roles = (np.concatenate([np.broadcast_to(o[i], k) for o, k in zip(out, sizes)])
                                       for i in range(3))
                for a in range(0, len(at), 4 * ROUTED_ROWS):
                    cut = slice(a, a + 4 * ROUTED_ROWS)
                    yield pd.DataFrame({"cell": cells[cut], "piece": parts[cut], "role": roles[cut],
                                        "word": word[at[cut]], "n": n[at[cut]]})

    return words.mapInPandas(route, "cell long, piece int, role int, word string, n long")


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell, piece and role: a piece's words, then its
    queries."""
    key, held, index, waiting, n_waiting = None, [], None, [], 0

    def answer():
        nonlocal index, waiting, n_waiting
        asked, waiting, n_waiting = waiting, [], 0
        if not asked or not held:
            return
        if index is None:
            held[:] = [pd.concat(held, ignore_index=True)]
            index = WordIndex(held[0]["word"].tolist())
        mine, asked = held[0], pd.concat(asked, ignore_index=True)
        for _, some in asked.groupby(asked["word"].str.len(), sort=False):
            q, t = index.near(some["word"].tolist())
            if not len(q):
                continue
            qw, qn, guest = some["word"].to_numpy()[q], some["n"].to_numpy()[q], some["role"].to_numpy()[q] == GUEST
            tw, tn = mine["word"].to_numpy()[t], mine["n"].to_numpy()[t]
            yield pd.DataFrame({"word": qw, "other": tw, "other_n": tn})
            # words of one cell find each other both ways; a guest's pair is met only here
            yield pd.DataFrame({"word": tw[guest], "other": qw[guest], "other_n": qn[guest]})

    for pdf in batches:
        for (cell, piece), run in pdf.groupby(["cell", "piece"], sort=False):
            if (cell, piece) != key:
                yield from answer()
                key, held, index = (cell, piece), [], None
            words = run["role"] == HELD
            if words.any():
                held.append(run.loc[words, ["word", "n"]])
            if not words.all():
                waiting.append(run.loc[~words, ["word", "n", "role"]])
                n_waiting += len(waiting[-1])
            if n_waiting >= QUERY_BLOCK:
                yield from answer()
    yield from answer()


def near_pairs(words: DataFrame, cell_words: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """(word, other, other_n): every ordered pair of words of the table (word,
    n) that differ by exactly one inserted, deleted or replaced code point."""
    rows = _routed(words, cell_words, sample_words).repartition("cell", "piece").sortWithinPartitions("cell", "piece", "role")
    return rows.mapInPandas(_search, "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form.  Each round doubles the steps
    that a row has taken."""
    hop = write_table(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        to = hop.select(F.col("word").alias("root"), F.col("root").alias("on"))
        far = hop.join(to, "root", "left").select("word", F.coalesce("on", "root").alias("root"),
                                                  F.col("on").isNotNull().alias("moved"))
        far = write_table(far, "spelling-roots")
        hop = far.select("word", "root")
        if far.where("moved").isEmpty():
            return hop


def group_variants(words: DataFrame, times: float = FORM_TIMES, **search) -> DataFrame:
    """One row per word of the table (word, n): form (its near word of largest
    n, the smallest in code-point order of equals, if that n is at least
    ``times`` the word's; else null), root (the last of the forms that follow;
    the word itself without a form), n, n_near, form_n.

    The words are distinct and not null; a table without words gives none.
    ``search`` (cell_words, sample_words) changes the work, not the result.
    """
    near = (near_pairs(words, **search).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("b")))
    most = -F.col("b.rank")
    has = most >= F.lit(times) * F.col("n")
    forms = write_table(
        words.join(near, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(has, F.col("b.other")).alias("form"), F.when(has, most).alias("form_n")), "spelling-forms")
    return (forms.join(_roots(forms), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """``group_variants`` of ``count_words``.  Null and empty texts have no
    words; rows that repeat an id or a text count again."""
    return group_variants(write_table(count_words(docs, **options), "spelling-words"))
