"""Merkle manifest of a table, with a proof for every row.

The rows of a tree are its leaves; runs of two neighbours become their
parent until one node remains, and the roots of all trees likewise give one
root.  Nodes are labelled by level and place, and handled in the order of
their labels: a priority queue delivers the digest of a child to its parent
(time-forward processing), and a second sweep against that order delivers to
every node the siblings on its way to the root.

The queue is external.  A block is the part of a tree between two cut levels,
``HEIGHT`` levels apart; what crosses a cut is a row of a table in the
shared folder, and Spark's shuffle brings the rows to the block they are
addressed to.  What stays inside a block goes through a heap in its task.  A
block has at most 2 ** HEIGHT leaves, so no task's memory grows with a tree,
and ten billion rows take three rounds.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.llm.common import write_table

#: Levels of a block.
HEIGHT = 12
HEX = 64                       # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(col: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, the value."""
    s = col.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest_of(cols: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- one block
LEVEL_BITS, PLACE_MASK = 32, (1 << 32) - 1


def _label(level: int, place: int) -> int:
    return level << LEVEL_BITS | place


def forward(leaves: list[str], levels: int) -> dict[int, str]:
    """Digest by label of all nodes of a block.  The queue holds (label of
    the receiver, label of the sender, digest)."""
    known = {_label(0, i): d for i, d in enumerate(leaves)}
    if not levels:
        return known
    queue = [(_label(1, i >> 1), i, d) for i, d in enumerate(leaves)]        # ascending, hence a heap
    while queue:
        at, _, run = heapq.heappop(queue)
        while queue and queue[0][0] == at:
            run += heapq.heappop(queue)[2]
        known[at] = _sha(run)
        level, place = at >> LEVEL_BITS, at & PLACE_MASK
        if level < levels:
            heapq.heappush(queue, (_label(level + 1, place >> 1), at, known[at]))
    return known


def backward(known: dict[int, str], levels: int, above: str) -> list[str]:
    """The proof of every leaf of a block whose top has the proof ``above``:
    labels fall, and a node sends each child its sibling and its own proof."""
    queue, proofs = [(-_label(levels, 0), above)], {}
    while queue:
        at, proof = heapq.heappop(queue)
        level, place = -at >> LEVEL_BITS, -at & PLACE_MASK
        if level == 0:
            proofs[place] = proof
            continue
        for child in (2 * place, 2 * place + 1):
            if _label(level - 1, child) in known:
                heapq.heappush(queue, (-_label(level - 1, child), known.get(_label(level - 1, child ^ 1), "") + proof))
    return [proofs[i] for i in range(len(proofs))]


def _levels(n: int, height: int) -> int:
    """Levels that a block of a tree with ``n`` nodes at its base climbs."""
    return min(height, (n - 1).bit_length())


def _block(rows: pa.Table, height: int) -> tuple[pa.Table, int, dict[int, str]]:
    rows = rows.sort_by("pos")
    levels = _levels(rows["n"][0].as_py(), height)
    return rows, levels, forward(rows["digest"].to_pylist(), levels)


# ---------------------------------------------------------------- whole trees
def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (tree, ..., digest) with pos, the place in the tree by
    ``order``, and n, the tree's size.  Ranges of the sorted table are counted
    by themselves, so a tree that holds most rows is spread over many tasks;
    rows that tie in everything are told apart by their place in the table."""
    keys = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order], F.col("digest"), F.col("nr")]
    cut = write_table(nodes.withColumn("nr", F.monotonically_increasing_id()).repartitionByRange(*keys)
                      .sortWithinPartitions(*keys).drop("nr")
                      .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()),
                      "merkle-sorted")
    parts = cut.groupBy("tree", "part").agg(F.count("*").alias("k"), F.min("at").alias("from"))
    mine = Window.partitionBy("tree")
    parts = write_table(parts.select("tree", "part", "from", F.sum("k").over(mine).alias("n"), (
        F.sum("k").over(mine.orderBy("part")) - F.col("k")).alias("before")), "merkle-parts")
    return cut.join(parts, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("from")) \
        .drop("part", "at", "from", "before")


def _block_key(height: int) -> Column:
    return F.shiftright("pos", height).alias("block")


def _up(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes (tree, n, pos, digest) at every cut, the roots last."""
    def climb(rows: pa.Table) -> pa.Table:
        rows, levels, known = _block(rows, height)
        n = rows["n"][0].as_py()
        return pa.table({"tree": rows["tree"][:1], "n": pa.array([-(-n >> levels)], pa.int64()),
                         "pos": pa.array([rows["pos"][0].as_py() >> height], pa.int64()),
                         "digest": pa.array([known[_label(levels, 0)]], pa.string())})

    cuts = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = cuts[-1].select("tree", "n", "pos", "digest").groupBy("tree", _block_key(height)).applyInArrow(
            climb, "tree string, n long, pos long, digest string")
        cuts.append(write_table(up, "merkle-nodes"))
        most = -(-most >> _levels(most, height))
    return cuts


def _down(cuts: list[DataFrame], roots: DataFrame, height: int) -> DataFrame:
    """The rows of the lowest cut with the columns of ``roots`` (tree, pos,
    proof, ...), where proof is that of the tree's root, now of the row."""
    names = [c for c in roots.columns if c not in ("tree", "pos", "proof")]

    def deliver(rows: pa.Table, message: pa.Table) -> pa.Table:
        rows, levels, known = _block(rows, height)
        out = rows.append_column("proof", pa.array(backward(known, levels, message["proof"][0].as_py()), pa.string()))
        for c in names:
            out = out.append_column(c, pa.array([message[c][0].as_py()] * len(rows), message.schema.field(c).type))
        return out

    told = roots
    more = [f for f in roots.schema if f.name in names]
    for i in range(len(cuts) - 2, -1, -1):
        base = cuts[i] if i == 0 else cuts[i].select("tree", "n", "pos", "digest")
        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema], "proof string",
                            *[f"`{f.name}` {f.dataType.simpleString()}" for f in more]])
        told = (base.groupBy("tree", _block_key(height)).cogroup(told.groupBy("tree", F.col("pos").alias("block")))
                .applyInArrow(deliver, schema))
        if i:
            told = write_table(told.select("tree", "pos", "proof", *names), "merkle-proofs")
    return told


def manifest(docs: DataFrame, fields: Iterable[str] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang",
             carry: Mapping[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, leaf (the digest of
    ``fields``), pos and n (its place among the n leaves of its tree),
    tree_pos and n_trees, subroot, root, proof (the siblings' digests from the
    leaf to the root, 64 characters each), and the columns ``carry``.

    Leaves ascend by ``id_col``, null ids first; rows that repeat an id are
    ordered by their digests, and equal rows are leaves of their own.  Trees
    are ordered by the bytes of ``tree_col``, null first.  A table without
    rows has no root.
    """
    own = {f"c{i}": c for i, c in enumerate((carry or {}).values())}
    name = F.col(f"`{tree_col}`").cast("string")
    leaves = write_table(docs.select(
        F.when(name.isNull(), "").otherwise(F.concat(F.lit("+"), name)).alias("tree"), name.alias("lang"),
        F.col(f"`{id_col}`").alias("doc_id"), digest_of([F.col(f"`{c}`") for c in fields]).alias("digest"),
        *[c.alias(k) for k, c in own.items()]), "merkle-leaves")
    cuts = _up(write_table(_placed(leaves, ["doc_id"]), "merkle-nodes"), height)
    top = cuts[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    tops = _up(write_table(_placed(top, ["of"]), "merkle-nodes"), height)
    root = tops[-1].select("tree", "pos", F.lit("").alias("proof"), F.col("digest").alias("root"))
    if len(tops) > 1:
        tree = _down(tops, root, height)
    else:                                            # one tree: its root is the root
        tree = tops[0].withColumn("proof", F.lit("")).withColumn("root", F.col("digest"))
    tree = write_table(tree.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest")
                                   .alias("subroot"), "root", F.col("pos").alias("tree_pos"), F.col("n").alias("n_trees")),
                       "merkle-trees")
    if len(cuts) > 1:
        out = _down(cuts, tree, height)
    else:                                            # every tree has one leaf
        out = cuts[0].join(tree.drop("pos"), "tree")
    return out.select("doc_id", "lang", F.col("digest").alias("leaf"), "pos", "n", "tree_pos", "n_trees", "subroot", "root",
                      "proof", *[F.col(k).alias(c) for k, c in zip(own, carry or {})])


# ---------------------------------------------------------------- verification
def fold(digest: str, proof: str, pos: int, n: int, tree_pos: int, n_trees: int) -> str:
    """The root that a leaf's digest and its proof lead to."""
    at = 0
    for i, k in ((pos, n), (tree_pos, n_trees)):
        while k > 1:
            if i ^ 1 < k:
                sibling, at = proof[at:at + HEX], at + HEX
                digest = _sha(sibling + digest if i & 1 else digest + sibling)
            else:
                digest = _sha(digest)
            i, k = i >> 1, k + 1 >> 1
    return digest


def folded_root(leaf: Column | str = "leaf") -> Column:
    """The root by ``fold`` of a digest column, beside a manifest's columns."""
    @F.pandas_udf("string")
    def folded(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([fold(*row) for row in zip(*[c.tolist() for c in columns])], dtype=object)

    return folded(leaf, "proof", "pos", "n", "tree_pos", "n_trees")


def tampered(docs: DataFrame, every: int = 7, id_col: str = "doc_id", field_col: str = "n_chars",
             fields: Iterable[str] = FIELDS) -> Column:
    """The leaf digest of a row whose ``field_col`` grew by one, where
    ``every`` divides the CRC-32 of its id in decimal; else its own.  Null
    ids and null fields are left alone."""
    value = F.col(f"`{field_col}`")
    if docs.schema[field_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        value = value.cast("decimal(20,0)")
    hit = F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(every)) == 0
    changed = digest_of([value + 1 if c == field_col else F.col(f"`{c}`") for c in fields])
    return F.when(F.coalesce(hit, F.lit(False)), changed).otherwise(digest_of([F.col(f"`{c}`") for c in fields]))


def checked(docs: DataFrame, height: int = HEIGHT, **options) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) after
    some rows have been tampered with; the manifest is that of the others."""
    m = manifest(docs, carry={"claimed": tampered(docs, **options)}, height=height)
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                    folded_root("claimed").alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
