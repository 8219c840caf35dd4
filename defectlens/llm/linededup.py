"""Repeated line runs by distributed prefix doubling (DataFrame functions only).

Every text is a sequence of lines, cut at ``\\n``; a null text has none, an empty text has one
empty line. Names of runs of 1, 2, 4, ... lines are built by doubling: the name of 2h lines is
the pair of the names of its halves. Suffixes with equal names of level h stand together in the
suffix array, as an interval whose longest common prefix is h or more; only members of an
interval of two or more go on to the next level, so the work shrinks from level to level and
ends when nothing repeats. Names are 64-bit hashes: the order among different intervals is that
of the hash, and only membership and first occurrence are used.

A run repeats if it occurs earlier: in a document of smaller id, or at an earlier line of the
same document (the two may overlap). It is deleted if it has at least ``min_lines`` lines, a
power of two, or is a line of at least ``long_line`` characters. A longer run is the union of
its runs of ``min_lines``, so all its lines go; the first occurrence stays.

Rows equal in doc_id and text are one document and treated alike. Rows of one doc_id with
different texts are different documents, ordered by text hash; a null doc_id is ordered first.
An empty table gives no rows. Other columns are carried by :func:`dedup_lines`, whatever their
names. A line that a third of all rows hold is one name: counts and first positions are summed
before the shuffle, and the join back is an ordinary one, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import join_apart, materialise

_FIRST = -(1 << 63)


def _document(doc_id: Column, text: Column) -> list[Column]:
    """Two join keys, never null, that tell documents apart."""
    return [
        F.coalesce(doc_id.cast("long"), F.lit(_FIRST)).alias("id"),
        F.xxhash64(doc_id.isNull(), text).alias("body"),
    ]


def _first_level(docs: DataFrame, long_line: int) -> DataFrame:
    """(id, body, pos, name, alone) per line; ``alone``: long enough to be a run by itself."""
    lines = docs.select(*_document(F.col("doc_id"), F.col("text")),
                        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select(
        "id", "body", "pos", F.xxhash64("line").alias("name"),
        (F.length("line") >= long_line).alias("alone"),
    ).distinct()


def _repeated(level: DataFrame) -> DataFrame:
    """Members of intervals of two or more, each with ``later``: not the first member."""
    at = F.struct("id", "body", "pos")
    intervals = (
        level.groupBy("name").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("name", "first")
    )
    return join_apart(level, intervals, "name").select(*level.columns, (at != F.col("first")).alias("later"))


def levels(docs: DataFrame, long_line: int) -> list[tuple[int, DataFrame]]:
    """(h, suffixes whose first h lines repeat) for h = 1, 2, 4, ... until nothing repeats."""
    out, h = [], 1
    level = materialise(_repeated(_first_level(docs, long_line)))
    while not level.isEmpty():
        out.append((h, level))
        left = level.select("id", "body", "pos", "name", "alone")
        right = level.select("id", "body", (F.col("pos") - h).alias("pos"), F.col("name").alias("next"))
        pairs = left.join(right, ["id", "body", "pos"])
        level = materialise(_repeated(
            pairs.select("id", "body", "pos", F.xxhash64("name", "next").alias("name"), "alone")))
        h *= 2
    return out


def deleted_lines(docs: DataFrame, min_lines: int, long_line: int) -> DataFrame:
    """id, body, ``lines`` (sorted numbers, from 0, of deleted lines) and ``level``, the longest
    power of two of lines that the document shares with an earlier place."""
    if min_lines & (min_lines - 1) or min_lines < 1:
        raise ValueError("min_lines is a power of two")
    found = None
    for h, members in levels(docs, long_line):
        later = members.where("later").withColumn("level", F.lit(h))
        nothing = F.array().cast("array<int>")
        if h == min_lines:
            cover = F.sequence(F.col("pos"), F.col("pos") + (h - 1))
        else:
            cover = F.when(F.col("alone"), F.array("pos")).otherwise(nothing) if h == 1 else nothing
        part = later.select("id", "body", "level", cover.alias("lines"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "id long, body long, lines array<int>, level int")
    return found.groupBy("id", "body").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"),
        F.max("level").alias("level"))


def _mask(lines: Column) -> Column:
    """A string with 1 at each listed place, as long as the last of them."""
    before = F.slice(F.concat(F.array(F.lit(-1)), lines), F.lit(1), F.size(lines))
    return F.array_join(F.zip_with(
        lines, before, lambda a, b: F.concat(F.repeat(F.lit("0"), a - b - 1), F.lit("1"))), "")


def dedup_lines(docs: DataFrame, min_lines: int = 2, long_line: int = 40) -> DataFrame:
    """The columns of ``docs`` as ``doc``, and n_lines, n_removed, level, kept_text.

    ``kept_text`` is null for a null text, and empty if every line is deleted.
    """
    gone = deleted_lines(docs.select("doc_id", "text"), min_lines, long_line)
    gone = gone.select("id", "body", "level", F.size("lines").alias("n_removed"), _mask(F.col("lines")).alias("mask"))
    rows = docs.select(F.struct("*").alias("doc"), *_document(F.col("doc_id"), F.col("text")))
    split = F.split(F.col("doc.text"), "\n", -1)
    flagged = F.zip_with(split, F.split(F.col("mask"), ""), lambda line, flag: F.struct(
        line.alias("line"), flag.alias("flag")))
    kept = F.array_join(F.transform(
        F.filter(flagged, lambda x: x["line"].isNotNull() & ~x["flag"].eqNullSafe("1")),
        lambda x: x["line"]), "\n")
    return rows.join(gone, ["id", "body"], "left").select(
        "doc",
        F.when(F.col("doc.text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("level", F.lit(0)).cast("long").alias("level"),
        F.when(F.coalesce("n_removed", F.lit(0)) == 0, F.col("doc.text")).otherwise(kept).alias("kept_text"),
    )
