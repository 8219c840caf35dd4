"""Merkle manifest of a table: nested-interval labels over trees of digests.

Every row is a leaf; leaves of one tree are numbered in their order. A node is labelled with the
interval ``[lo, hi)`` of leaf ranks that it covers, so ancestry is containment of intervals and a
node's siblings are its parent's interval less its own: nothing but the labels links nodes.

1. Leaves are numbered per tree (:mod:`order`), so a tree may hold any share of the rows.
2. Levels are handled in buckets of ``height``: the nodes under one node ``height`` levels above
   them share ``lo div span``, are at most ``BLOCK`` and form a block. A block is one row, its
   upper levels are made in one step, and its top is a node of the next bucket of levels: a table
   of n leaves takes log(n) / log(BLOCK) shuffles, of n, n / BLOCK, ... narrow rows.
3. Downwards, a block joins the path of the node that contains it (same tree, same bucket, nested
   interval); the path inside the block comes from interval differences. A row per block moves.
4. The tops of the trees, in the order of their names, are the leaves of one more tree.

A digest is the lowercase hex SHA-256 of its inputs joined; with ``fan_out`` k every k consecutive
nodes, or what is left of them, become their digest, one alone too, until one remains.

Nulls: a null field is ``-``; a null tree name or order key comes first. Equal keys are ordered by
digest, so equal rows are leaves side by side. An empty text is ``0:``. Texts are hashed where they
are read and do not move. An empty table gives no rows. Columns are chosen by name, others ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .order import numbered
from .tables import materialise, ship

#: Most nodes of a block: some 100 kB as a row.
BLOCK = 1024
_PATH = "array<struct<before:string,after:string>>"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it goes into a leaf: ``-`` if null, else byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return digest(F.concat(*[field(f) for f in fields]))


def tree_name(value: Column) -> Column:
    """A name that sorts bytewise, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def folded(leaf: Column, proof: Column) -> Column:
    """The top digest that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda own, step: digest(F.concat(step["before"], own, step["after"])))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, joined in their order."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""))


def _height(fan_out: int) -> int:
    height = 1
    while fan_out ** (height + 1) <= BLOCK:
        height += 1
    return height


def _levels(digests: list[str], fan_out: int, height: int | None) -> list[list[str]]:
    """The digests of each level: ``height`` levels up, or to the top."""
    levels = [digests]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        below = levels[-1]
        levels.append([
            hashlib.sha256("".join(below[i:i + fan_out]).encode()).hexdigest()
            for i in range(0, len(below), fan_out)])
    return levels


class _Blocks(NamedTuple):
    """The shape of one bucket of levels: a node covers ``unit`` leaves, a block ``span``."""

    fan_out: int
    height: int
    unit: int

    @property
    def span(self) -> int:
        return self.unit * self.fan_out ** self.height

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[list[str]]]]:
        """Each block: its batch, its row there and the digests of its levels."""
        for batch in batches:
            members = batch.column("members")
            ends = members.offsets.to_pylist()
            base = ends[0]
            hexes = [d.hex() for d in members.flatten().field("digest").to_pylist()]
            totals = batch.column("total").to_pylist()
            for i in range(batch.num_rows):
                own = hexes[ends[i] - base:ends[i + 1] - base]
                yield batch, i, _levels(own, self.fan_out, None if totals[i] <= self.span else self.height)

    def inner(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes above the members, and a leaf that is alone in its tree."""
        for batch, i, levels in self.rows(batches):
            yield from self._nodes(batch, i, list(enumerate(levels))[1:] or [(0, levels[0])])

    def tops(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The highest node of each block."""
        for batch, i, levels in self.rows(batches):
            yield from self._nodes(batch, i, [(len(levels) - 1, levels[-1])])

    def _nodes(self, batch: pa.RecordBatch, i: int, levels: list[tuple[int, list[str]]]) -> Iterator[pa.RecordBatch]:
        tree, total, lo = (batch.column(c)[i].as_py() for c in ("tree", "total", "lo"))
        for level, digests in levels:
            wide, n = self.unit * self.fan_out ** level, len(digests)
            yield pa.record_batch({
                "tree": pa.array([tree] * n, pa.string()), "total": pa.array([total] * n, pa.int64()),
                "level": pa.array([level] * n, pa.int32()),
                "lo": pa.array([lo + j * wide for j in range(n)], pa.int64()),
                "hi": pa.array([min(total, lo + (j + 1) * wide) for j in range(n)], pa.int64()),
                "digest": pa.array([bytes.fromhex(d) for d in digests], pa.binary())})

    def paths(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each member with the siblings on its way up: first those inside the block."""
        for batch, i, levels in self.rows(batches):
            members = batch.column("members")[i].values
            above = batch.column("above")[i].as_py() or []
            paths = []
            for j in range(len(levels[0])):
                path, own = [], j
                for digests in levels[:-1]:
                    # The parent's interval, in nodes of this level, less the node's own.
                    low = own - own % self.fan_out
                    high = min(low + self.fan_out, len(digests))
                    path.append(("".join(digests[low:own]), "".join(digests[own + 1:high])))
                    own //= self.fan_out
                paths.append([{"before": b, "after": a} for b, a in path] + above)
            n = len(paths)
            yield pa.record_batch({
                "tree": pa.array([batch.column("tree")[i].as_py()] * n, pa.string()),
                "lo": members.field("lo").cast(pa.int64()), "hi": members.field("hi").cast(pa.int64()),
                "digest": members.field("digest").cast(pa.binary()), "payload": members.field("payload"),
                "path": pa.array(paths, pa.list_(_STEP))})


class Forest(NamedTuple):
    """Trees over numbered leaves: per bucket of levels, lowest first, its blocks and their tops."""

    fan_out: int
    blocks: list[DataFrame]
    summits: list[DataFrame]

    def _shape(self, tier: int) -> _Blocks:
        height = _height(self.fan_out)
        return _Blocks(self.fan_out, height, self.fan_out ** (height * tier))

    def _made(self, tier: int, step: Callable) -> DataFrame:
        return self.blocks[tier].select("tree", "total", "lo", "members").mapInArrow(
            step, "tree string, total long, level int, lo long, hi long, digest binary")

    def nodes(self) -> DataFrame:
        """tree, level, lo, hi, digest (hex) of every node above the leaves; a lone leaf is its own top."""
        height = _height(self.fan_out)
        tiers = [
            self._made(t, self._shape(t).inner).withColumn("level", F.col("level") + t * height)
            for t in range(len(self.blocks))]
        return reduce(DataFrame.unionByName, tiers).select(
            "tree", "level", "lo", "hi", F.lower(F.hex("digest")).alias("digest"))

    def tops(self) -> DataFrame:
        """tree and the digest (binary) of its top."""
        return reduce(DataFrame.unionByName, [
            found.where(F.col("total") <= self._shape(t).span) for t, found in enumerate(self.summits)
        ]).select("tree", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """tree, lo, digest, payload and path of each leaf: its siblings up to the tree's top, then ``above``.

        ``above`` has tree and path, a row per tree.
        """
        found = None
        for tier in reversed(range(len(self.blocks))):
            shape, blocks = self._shape(tier), self.blocks[tier]
            whole = F.col("total") <= shape.span
            joined = blocks.where(whole).join(above.select("tree", F.col("path").alias("above")), "tree")
            if found is not None:
                holder = found.select(
                    "tree", F.expr(f"lo div {shape.span}").alias("bucket"), F.col("lo").alias("p_lo"),
                    F.col("hi").alias("p_hi"), F.col("path").alias("above"))
                nested = blocks.where(~whole).join(holder, ["tree", "bucket"]).where("p_lo <= lo AND hi <= p_hi")
                joined = joined.unionByName(nested.select(joined.columns))
            payload = blocks.schema["members"].dataType.elementType["payload"].dataType.simpleString()
            found = joined.select("tree", "total", "members", "above").mapInArrow(
                shape.paths, f"tree string, lo long, hi long, digest binary, payload {payload}, path {_PATH}")
            if tier:
                found = materialise(found)
        return found


def plant(leaves: DataFrame, fan_out: int = 2) -> Forest:
    """A forest over leaves: tree, rank, total, digest (binary) and payload (a struct of sortable fields)."""
    nodes = leaves.select("tree", "total", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "payload")
    largest = leaves.agg(F.max("total")).first()[0] or 0
    forest = Forest(fan_out, [], [])
    while True:
        tier = len(forest.blocks)
        shape = forest._shape(tier)
        forest.blocks.append(materialise(
            nodes.groupBy("tree", F.expr(f"lo div {shape.span}").alias("bucket")).agg(
                F.max("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", "payload"))).alias("members"))))
        forest.summits.append(materialise(forest._made(tier, shape.tops)))
        if largest <= shape.span:
            return forest
        nodes = forest.summits[tier].where(F.col("total") > shape.span).select(
            "tree", "total", "lo", "hi", "digest", F.struct(F.lit(0).alias("none")).alias("payload"))


def prove(rows: DataFrame, tree: str, order: str, leaf: str, payload: list[str], fan_out: int = 2) -> DataFrame:
    """A leaf, subroot, root and proof for every row of a table.

    ``tree`` names the column of the tree a row is in, ``order`` that of its place there, ``leaf``
    its digest (hex). Returns the ``payload`` columns, leaf, subroot, root (hex) and proof: a step
    per level from the leaf to the root, each with the digests of the siblings ``before`` and
    ``after`` the node, joined. :func:`folded` verifies a proof.
    """
    narrow = materialise(rows.select(
        tree_name(F.col(tree)).alias("tree"), F.col(order).alias("place"), F.unhex(leaf).alias("digest"),
        F.struct(*payload).alias("payload")))
    leaves = numbered(narrow, ["tree", "place", "digest"], within="tree")
    trees = plant(leaves, fan_out)
    subroots = materialise(trees.tops())

    tops = numbered(subroots, ["tree"])
    crown = plant(tops.select(
        F.lit("").alias("tree"), "rank", "total", "digest", F.struct(F.col("tree").alias("name")).alias("payload")), fan_out)
    root = materialise(crown.tops())
    none = root.select("tree", F.array().cast(_PATH).alias("path"))
    above = crown.paths(none).join(root.select("tree", F.col("digest").alias("root")), "tree").select(
        F.col("payload.name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    above = materialise(above)

    found = trees.paths(above.select("tree", "path")).join(above.select("tree", "subroot", "root"), "tree")
    return found.select(
        "payload.*", *[F.lower(F.hex(c)).alias(n) for c, n in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))],
        F.col("path").alias("proof"))


ship(__name__)
