"""SimHash near-duplicates: shards of fingerprints, a BK-tree in each, links within a radius.

A fingerprint has bit i set if over half of the XXH64 hashes (seed 42) of a text's word shingles
have it, repeated shingles counted each time; words are lower-cased (A-Z) and shingles are of
``width`` words joined by a space. With fewer words the whole sequence is the one shingle, with
none the fingerprint is zero and links like any other.

1. Fingerprints are made where the texts are read, long texts in pieces, and made distinct.
2. Shards: cut the 64 bits into ``radius + 1`` parts; two fingerprints within the radius agree on
   all bits of one part at least, so each goes to one shard per part, named by those bits. A shard
   of more than ``LIMIT`` is cut again by the same argument, over those bits in which its members
   differ, and so on. More than 1,024 distinct fingerprints differ in 11 bits or more and a cutting
   leaves three quarters of them, so this ends after seven whatever the data; only members of
   crowded shards are copied again.
3. A shard's tree goes where its queries are, the members themselves: as the trees are bounded by
   ``LIMIT`` (8 kB), it is they that are sent, one to the one task that asks it, in place of all
   trees to all tasks, which would grow with the table. In a tree the children of a node are keyed
   by their distance to it; a search at distance d from a node follows the keys d - radius to
   d + radius only. Trees and searches of many shards are handled together as arrays.
4. A shard hands on one link per member to the smallest one it reaches inside the shard: the same
   components as all its links, without its pairs. Components are found by alternating stars.

No link is lost, and no step holds more than some shards. Rows without doc_id take part; a
component's id is its smallest doc_id, null if none has one. Rows of one doc_id are linked by
their texts only. Null and empty texts, and texts of whitespace, have fingerprint zero. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .tables import join_apart, materialise, ship
from .words import as_texts, ranges

#: Most members of a shard's tree; 2 ** (radius + 1) at least.
LIMIT = 1024
SEED = 42
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 18
#: Rows whose trees are built together, and rows that search them together.
CHUNK, SLICE = 1 << 16, 1 << 12
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``PIECE`` bytes, cut at spaces."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + PIECE)
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


def _shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles, piece by piece; ``bytes.lower`` changes A-Z only."""
    words, found = [], False
    for piece in _pieces(text):
        words += piece.lower().split()
        if len(words) >= width:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths)[:len(words) - width + 1]
            found = True
            yield np.array([
                xxhash.xxh64_intdigest(joined[a:b], SEED)
                for a, b in zip(starts.tolist(), ends[width - 1:].tolist())], np.uint64)
            words = words[len(words) - width + 1:]
    if words and not found:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def fingerprint_of(text: bytes, width: int) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(text, width):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_texts(batch.column("text"))
            made = np.array([
                fingerprint_of(data[a:b].tobytes(), width) for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fingerprint": pa.array(made.view(np.int64))})

    ident = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {ident}, fingerprint long")


def parts(mask: int, radius: int) -> list[int]:
    """``mask`` with each of ``radius + 1`` parts of the bits that it leaves, ``radius + 1`` at least."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _sharded(members: DataFrame, radius: int) -> DataFrame:
    """(mask, shard, fingerprint): each member once per part of the bits outside its mask."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = batch.column("mask").to_numpy().view(np.uint64)
            prints = batch.column("fingerprint").to_numpy().view(np.uint64)
            for mask in np.unique(masks):
                own = prints[masks == mask]
                for finer in parts(int(mask), radius):
                    bits = np.full(len(own), finer, np.uint64)
                    yield pa.record_batch({
                        "mask": pa.array(bits.view(np.int64)), "shard": pa.array((own & bits).view(np.int64)),
                        "fingerprint": pa.array(own.view(np.int64))})

    return members.mapInArrow(rows, "mask long, shard long, fingerprint long")


def grow(prints: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of consecutive shards: (edges, child), sorted by edge.

    The first member of a shard is its root. ``edges`` holds parent * 128 + distance, ``child``
    the member at the end of each. All trees grow by one level at a time.
    """
    n = len(prints)
    member = np.setdiff1d(np.arange(n), starts, assume_unique=True)
    parent = starts[np.searchsorted(starts, member, side="right") - 1]
    edges, child = [], []
    while len(member):
        edge = parent * 128 + np.bitwise_count(prints[member] ^ prints[parent])
        order = np.argsort(edge, kind="stable")
        edge, member = edge[order], member[order]
        head = np.empty(len(edge), bool)
        head[0], head[1:] = True, edge[1:] != edge[:-1]
        edges.append(edge[head])
        child.append(member[head])
        parent = member[head][np.cumsum(head) - 1][~head]
        member = member[~head]
    edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
    child = np.concatenate(child) if child else np.zeros(0, np.int64)
    order = np.argsort(edges, kind="stable")
    return edges[order], child[order]


def search(prints: np.ndarray, root: np.ndarray, queries: np.ndarray, edges: np.ndarray, child: np.ndarray,
           radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, member) within the radius, per level of the trees; ``root`` is each query's tree."""
    node = root
    while len(queries):
        distance = np.bitwise_count(prints[queries] ^ prints[node]).astype(np.int64)
        near = (distance <= radius) & (queries != node)
        yield queries[near], node[near]
        low = np.searchsorted(edges, node * 128 + np.maximum(distance - radius, 0))
        high = np.searchsorted(edges, node * 128 + distance + radius, side="right")
        queries = np.repeat(queries, high - low)
        node = child[ranges(low, high - low)]


def _join_up(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``least``, the smallest member each one reaches, after the links (a, b) have been added."""
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = least[least]
            if np.array_equal(further, least):
                break
            least = further
    return least


def shard_links(prints: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For members that reach a smaller place in their shard: its fingerprint and the member's own."""
    n = len(prints)
    edges, child = grow(prints, starts)
    root = starts[np.searchsorted(starts, np.arange(n), side="right") - 1]
    least = np.arange(n)
    for i in range(0, n, SLICE):
        queries = np.arange(i, min(i + SLICE, n))
        for a, b in search(prints, root[queries], queries, edges, child, radius):
            least = _join_up(least, a, b)
    linked = np.flatnonzero(least != np.arange(n))
    return prints[least[linked]], prints[linked]


def _tree_links(shards: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of shards of at most ``LIMIT`` members each, whose rows stand together."""

    def linked(mask, shard, prints):
        new = np.empty(len(mask), bool)
        new[0], new[1:] = True, (mask[1:] != mask[:-1]) | (shard[1:] != shard[:-1])
        u, v = shard_links(prints.view(np.uint64), np.flatnonzero(new), radius)
        return pa.record_batch({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                fresh = batch.slice(at, CHUNK)
                held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, fresh.columns)]
                # The last shard may go on.
                mask, shard, _ = held
                goes_on = (mask == mask[-1]) & (shard == shard[-1])
                done = len(mask) - int(goes_on.sum())
                if done:
                    yield linked(*[h[:done] for h in held])
                    held = [h[done:] for h in held]
        if len(held[0]):
            yield linked(*held)

    together = shards.repartition("mask", "shard").sortWithinPartitions("mask", "shard", "fingerprint")
    return together.select("mask", "shard", "fingerprint").mapInArrow(rows, "u long, v long")


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all those within ``radius`` bits."""
    members = prints.select(F.lit(0).cast("long").alias("mask"), "fingerprint")
    found = None
    while True:
        shards = _sharded(members, radius)
        # Members of two crowded shards may meet again in one shard.
        shards = materialise(shards if found is None else shards.distinct())
        crowded = materialise(
            shards.groupBy("mask", "shard").agg(
                F.count(F.lit(1)).alias("n"),
                F.bit_and("fingerprint").bitwiseXOR(F.bit_or("fingerprint")).alias("differ"))
            .where(F.col("n") > LIMIT).select("mask", "shard", F.bitwise_not("differ").alias("agreed")))
        linked = materialise(_tree_links(shards.join(crowded, ["mask", "shard"], "left_anti"), radius))
        found = linked if found is None else found.unionByName(linked)
        if crowded.isEmpty():
            return found
        members = shards.join(crowded, ["mask", "shard"]).select(F.col("agreed").alias("mask"), "fingerprint")


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (a long) and component_id, the smallest doc_id reachable over links."""
    rows = materialise(fingerprints(docs, width))
    prints = materialise(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    reached = components(links(prints, radius))
    named = materialise(
        prints.join(reached, prints["fingerprint"] == reached["node"], "left")
        .select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")))
    groups = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = join_apart(named.select("fingerprint", "component"), groups, "component").select("fingerprint", "component_id")
    return join_apart(rows, materialise(known), "fingerprint").select("doc_id", "fingerprint", "component_id")


ship(__name__)
