"""CSV records of files whose quoted fields hold line breaks, read by many
tasks (S01).

A file is read line by line in splits.  Whether a line starts inside a quoted
field depends on all lines before it, but a line only maps that state to the
state after it, so a split does too: the first pass composes the two outcomes
of every split, a small table gives every split its state, and the second
pass joins lines to records.  A record that crosses splits leaves a fragment
in each; the fragments meet by the split that the record started in.

A quote opens a field only where the field starts, and a doubled quote inside
is a quote; quotes within an unquoted field mean nothing.  All of it is done
on bytes, in which neither UTF-8 nor cp932 hides a quote, comma or line feed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Q, COMMA = b'"', b","
BOM = b"\xef\xbb\xbf"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line."""
    at = 0
    while True:
        if inside:
            q = line.find(Q, at)
            if q < 0:
                return True
            if line[q + 1:q + 2] == Q:
                at = q + 2
                continue
            inside, at = False, line.find(COMMA, q + 1) + 1
            if not at:
                return False
        elif line[at:at + 1] == Q:
            inside, at = True, at + 1
        else:
            at = line.find(COMMA, at) + 1
            if not at:
                return False


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.col("value").cast("binary").alias("line"))


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, state after the split from outside and from inside, and
    whether a line from outside leaves a field open) of the splits read."""
    key, states, open_ = None, [False, True], False

    def row():
        return pa.RecordBatch.from_pydict({"file": [key[0]], "start": pa.array([key[1]], pa.int64()), "after": [states[0]],
                                           "after_inside": [states[1]], "open": [open_]})

    for batch in batches:
        for file, start, line in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, start) != key:
                if key is not None:
                    yield row()
                key, states, open_ = (file, start), [False, True], False
            ends = [ends_inside(line, False), ends_inside(line, True)]
            open_ |= ends[0]
            states = [ends[s] for s in states]
    if key is not None:
        yield row()


def inside_splits(spark: SparkSession, path: str) -> tuple[set, bool]:
    """({(file, start)} of the splits that start inside a quoted field, and
    whether any record spans lines).  Lines without quotes change nothing and
    never reach Python."""
    marked = file_lines(spark, path).where(F.col("line").contains(F.lit(Q)))
    splits = marked.mapInArrow(_outcomes, "file string, start long, after boolean, after_inside boolean, open boolean")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """The marked splits of a file, in order, with the state they start in."""
        rows, state, seen = rows.sort_values("start"), False, []
        for after, after_inside in zip(rows["after"], rows["after_inside"]):
            seen.append(state)
            state = bool(after_inside if state else after)
        return pd.DataFrame({"file": rows["file"], "start": rows["start"], "inside": seen, "next": [*seen[1:], state],
                             "open": rows["open"]})

    got = splits.groupBy("file").applyInPandas(walk, "file string, start long, inside boolean, next boolean, open boolean")
    hot = got.where("inside or next or open").collect()
    return {(r["file"], r["start"]): (r["inside"], r["next"]) for r in hot}, any(r["open"] for r in hot)


def records(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """(file, nr, header, value): one row per record, decoded; ``header`` is
    the first one of a file.  Blank lines between records are left out."""
    marked, _ = inside_splits(spark, path)
    by_file: dict = {}
    for (file, start), (inside, after) in sorted(marked.items()):
        by_file.setdefault(file, []).append((start, inside, after))

    def state_of(file: str, start: int) -> bool:
        """The state a split starts in: that after the last marked one before."""
        state = False
        for s, inside, after in by_file.get(file, ()):
            if s == start:
                return inside
            if s > start:
                break
            state = after
        return state

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records, and fragments: (part 1) what belongs to a record of
        an earlier split, (part 2) the record that is open at the end."""
        key, inside, held, part, out, titled = None, False, [], 0, [], True

        def close(kind):
            nonlocal held, part, titled
            if held:
                value = b"\n".join(held)
                title = not titled and bool(value.rstrip(b"\r"))        # the first record of a file that is not blank
                titled |= title
                out.append((*key, len(out), kind, value, title))
            held, part = [], 0

        def flush():
            cols = list(zip(*out)) or [[]] * 6
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.bool_())],
                names=["file", "start", "nr", "part", "value", "header"])

        number = 0
        for batch in batches:
            for file, start, line in zip(*[c.to_pylist() for c in batch.columns]):
                if (file, start) != key:
                    close(2 if part == 0 else 3)
                    key, inside = (file, start), state_of(file, start)
                    part, titled = 1 if inside else 0, start > 0
                    if start == 0 and line.startswith(BOM):
                        line = line[len(BOM):]
                held.append(line)
                if Q in line:
                    inside = ends_inside(line, inside)
                if not inside:
                    close(part)
            if out:
                done = flush()
                yield done.set_column(2, "nr", pa.array(range(number, number + len(done)), pa.int64()))
                number += len(done)
        close(2 if part == 0 else 3)
        if out:
            done = flush()
            yield done.set_column(2, "nr", pa.array(range(number, number + len(done)), pa.int64()))

    pieces = file_lines(spark, path).mapInArrow(
        join, "file string, start long, nr long, part int, value binary, header boolean")
    whole = pieces.where("part = 0").select("file", "start", "nr", "value", "header")

    def stitch(rows: pd.DataFrame) -> pd.DataFrame:
        """Fragments of a file in order: an open end (2), whole splits inside
        the record (3), and its last lines (1)."""
        out, open_ = [], None
        for r in rows.sort_values(["start", "nr"]).itertuples(index=False):
            if r.part == 2:
                if open_ is not None:
                    out.append(open_)
                open_ = (r.file, r.start, r.nr, r.value, r.header)
            elif open_ is not None:
                open_ = (*open_[:3], open_[3] + b"\n" + r.value, open_[4])
                if r.part == 1:
                    out.append(open_)
                    open_ = None
        if open_ is not None:
            out.append(open_)                        # the file ends inside a quoted field
        return pd.DataFrame(out, columns=["file", "start", "nr", "value", "header"])

    crossing = pieces.where("part > 0").groupBy("file").applyInPandas(
        stitch, "file string, start long, nr long, value binary, header boolean")
    rows = whole.unionByName(crossing)

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v.rstrip(b"\r").decode(charset, "replace"))

    rows = rows.select("file", "start", "nr", "header", decode("value").alias("value"))
    return rows.where("header or value <> ''")
