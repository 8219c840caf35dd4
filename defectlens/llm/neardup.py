"""Near-duplicate groups by an LSH forest of MinHash signatures, confirmed on whole sets.

A text's set holds its ``SHINGLE``-word sequences (words with A-Z as a-z); a text of fewer words has
its whole sequence as one, a text without words, or null, has an empty set and is linked with
nothing. Two sets are linked if their intersection has ``PERCENT`` of their union or more.

1. One pass hashes each text to its set's size, a 128-bit name of the set and a signature. Equal
   sets are one class from here on, named by the smallest doc_id, so copies cost a row each.
2. The forest: ``TREES`` orders of the classes by different parts of the signature. Classes that
   agree on the first ``DEPTH`` values of an order form a region; a crowded region is dealt over
   blocks, and every pair of blocks is a region of its own, so that no pair of classes is lost and
   no task grows with the region. In a region, classes are sorted by the next values, so that those
   with the longest common prefix are neighbours; neighbours whose sketches agree in ``LEAST`` of
   all values are candidates, and if a region does not hang together by its neighbours all its
   pairs of sketches are compared. Only a spanning forest of candidates leaves a region.
3. Candidates hang together in families. The texts of a family's classes are hashed again, and its
   links are confirmed on the whole sets by a search through an inverted index, which yields a
   spanning forest of the links. A family beyond ``BLOCK`` sets is dealt over blocks, and every
   pair of blocks is searched, so that no link is lost and no task grows with the family.
4. Components of the links name the groups.

A pair at the limit shares no region with probability (1 - 0.75 ** 4) ** 32, about five in a million,
however many rows there are and however crowded its regions.
A row belongs to the class of its text; classes are named by their smallest doc_id, and different
texts that give the same name (rows of one doc_id) count as one class with the links of each. A
row without doc_id takes no part: its component is null. Only doc_id and text are read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .tables import drop_worker_state, join_apart, materialise, ship
from .words import as_texts, chunks, find_words, mix, ranges, span_hashes, window_hashes

SHINGLE = 5
PERCENT = 75
VALUES = 128
TREES, DEPTH, DEEPER = 32, 4, 2
LEAST = 0.55
CROWDED = 2048
PAIRS = 4096
BLOCK = 1024
SET_CHUNK = 2 << 20


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of each text, one after the other, and where each begins."""
    texts = as_texts(column)
    words = find_words(texts)
    hashes = span_hashes(texts, words.start, words.end, lower=True)
    windows = window_hashes(hashes, shingle)
    sets, sizes = [], np.zeros(len(words.first) - 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if b - a >= shingle:
            own = np.unique(windows[a:b - shingle + 1])
        elif b > a:
            own = mix(window_hashes(hashes[a:b], b - a) + np.uint64(b - a))
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _odd(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(salt)) | np.uint64(1)


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """VALUES 16-bit values for each set that is not empty."""
    filled = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(filled), VALUES), dtype=np.uint16)
    if not len(filled):
        return out
    begin = starts[filled]
    for k, factor in enumerate(_odd(VALUES, 0x9E3779B97F4A7C15)):
        least = np.minimum.reduceat((flat * factor) >> np.uint64(32), begin)
        out[:, k] = least & np.uint64(0xFFFF)
    return out


SKETCHED = "doc_id long, n_shingles long, high long, low long, signature binary, sketch binary"


def sketch(docs: DataFrame) -> DataFrame:
    """Size, name, signature and sketch (the low byte of each value) of each text's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_state()
        for batch in batches:
            for part in chunks(batch, size=SET_CHUNK):
                flat, starts = shingle_sets(part.column("text"))
                sizes = np.diff(starts)
                filled = np.flatnonzero(sizes)
                names = np.zeros((2, len(sizes)), dtype=np.uint64)
                values: list[bytes | None] = [None] * len(sizes)
                marks: list[bytes | None] = [None] * len(sizes)
                if len(filled):
                    names[0, filled] = np.add.reduceat(mix(flat), starts[filled])
                    names[1, filled] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts[filled])
                    signed = signatures(flat, starts)
                    low = signed.astype(np.uint8)
                    for row, i in enumerate(filled.tolist()):
                        values[i], marks[i] = signed[row].tobytes(), low[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(names[0].view(np.int64)),
                     pa.array(names[1].view(np.int64)), pa.array(values, pa.binary()), pa.array(marks, pa.binary())],
                    names=["doc_id", "n_shingles", "high", "low", "signature", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCHED)


def _tree_places() -> np.ndarray:
    """Which values each order sorts by: the first DEPTH are its own, the rest shared."""
    places = np.arange(VALUES).reshape(TREES, VALUES // TREES)[:, :DEPTH]
    deeper = [[(t * DEPTH + DEPTH * (7 * j + 5)) % VALUES + j % DEPTH for j in range(2 * DEEPER)] for t in range(TREES)]
    return np.concatenate([places, np.array(deeper)], axis=1)


def forest(classes: DataFrame) -> DataFrame:
    """node, region (order and first values), near and far (the values that follow) per order."""
    places = _tree_places()

    def packed(values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape[:2], dtype=np.uint64)
        for k in range(values.shape[2]):
            out = out << np.uint64(16) | values[:, :, k].astype(np.uint64)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                signed = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)
                chosen = signed[:, places]
                region = mix(packed(chosen[:, :, :DEPTH]) ^ mix(np.arange(1, TREES + 1, dtype=np.uint64))[None, :])
                columns = [region, packed(chosen[:, :, DEPTH:DEPTH + DEEPER]), packed(chosen[:, :, DEPTH + DEEPER:])]
                node = np.repeat(part.column("node").to_numpy(), TREES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), *[pa.array(c.ravel().view(np.int64)) for c in columns]],
                    names=["node", "region", "near", "far"])

    return classes.select("node", "signature").mapInArrow(run, "node long, region long, near long, far long")


def _regions(trees: DataFrame) -> DataFrame:
    """Members of regions of two or more; of a crowded one, a region for each pair of its blocks."""
    trees = materialise(trees)
    sizes = trees.groupBy("region").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sized = materialise(join_apart(trees, sizes, "region"))
    calm = F.col("members") <= CROWDED
    # Two blocks, about PAIRS members, are compared at a time. There are two blocks at least, so
    # the pairs inside a block are compared with any other one.
    blocks = F.greatest(F.lit(2), F.ceil(F.col("members") / (PAIRS // 2))).cast("int")
    dealt = sized.where(~calm).select(
        "node", "region", "near", "far", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).where("own <> other")
    cells = dealt.select(
        "node", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "near", "far")
    return sized.where(calm).select("node", "region", "near", "far").unionByName(cells)


class Forest:
    """Union-find over the places of one group's members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _agreements(marks: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sketches that agree in ``least`` values or more."""
    n = len(marks)
    found, out = Forest(n), []
    left = n - 1
    for i in range(n - 1):
        for j in (np.flatnonzero((marks[i + 1:] == marks[i]).sum(axis=1) >= least) + i + 1).tolist():
            if found.join(i, j):
                out.append((i, j))
                left -= 1
        if not left:
            break
    return out


def _candidates(members: DataFrame) -> DataFrame:
    """Edges (u, v) between classes of a region, at most one less than it has members.

    Rows come sorted by region and by the values that follow. A region is held as a whole: it has at
    most ``CROWDED`` members, or those of two blocks.
    """
    least = int(np.ceil(LEAST * VALUES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, nodes, marks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, VALUES), np.uint8)

        def edges_of(region: np.ndarray, nodes: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
            near = (region[1:] == region[:-1])
            agree = near & ((marks[1:] == marks[:-1]).sum(axis=1) >= least)
            at = np.flatnonzero(agree)
            us, vs = [nodes[at]], [nodes[at + 1]]
            loose = np.unique(region[1:][near & ~agree])  # not one chain of neighbours
            cuts = np.flatnonzero(np.diff(region)) + 1
            begin, stop = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(region)]])
            odd = np.isin(region[begin], loose) & (stop - begin > 2)
            for a, b in zip(begin[odd].tolist(), stop[odd].tolist()):
                for i, j in _agreements(marks[a:b], least):
                    us.append(nodes[a + i:a + i + 1])
                    vs.append(nodes[a + j:a + j + 1])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))],
                                              names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            region = np.concatenate([region, batch.column("region").to_numpy()])
            nodes = np.concatenate([nodes, batch.column("node").to_numpy()])
            more = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, VALUES)
            marks = np.concatenate([marks, more])
            done = int(np.flatnonzero(region == region[-1])[0])
            if done:
                yield edges_of(region[:done], nodes[:done], marks[:done])
            region, nodes, marks = region[done:], nodes[done:], marks[done:]
        if len(region) > 1:
            yield edges_of(region, nodes, marks)

    ordered = members.repartition("region").sortWithinPartitions("region", "near", "far", "node")
    return ordered.select("region", "node", "sketch").mapInArrow(run, "u long, v long").distinct()


def _links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets.

    A search from set to set over an inverted index: a set that has been reached is compared with
    all that have not, by counting common members. It begins with the set that shares most with the
    others, which leaves few to be compared when copies gather around an original; the index is
    made anew whenever half of its sets have been reached.
    """
    n, out = len(sets), []
    sizes = np.array([len(s) for s in sets])
    values, member = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    shared = np.bincount(member, minlength=len(values))
    weight = np.add.reduceat(shared[member], first[:-1]) / sizes
    open_ = np.ones(n, dtype=bool)

    def index() -> tuple[np.ndarray, np.ndarray, int]:
        rows = np.flatnonzero(open_)
        at = ranges(first[rows], sizes[rows])
        order = np.argsort(member[at], kind="stable")
        owner = np.repeat(rows, sizes[rows])[order]
        return owner, np.searchsorted(member[at][order], np.arange(len(values) + 1)), len(rows)

    owner, begin, indexed = index()
    left = n
    for seed in np.argsort(-weight, kind="stable").tolist():
        if not open_[seed]:
            continue
        open_[seed] = False
        left -= 1
        queue = [seed]
        while queue and left:
            u = queue.pop()
            if 2 * left < indexed:
                owner, begin, indexed = index()
            own = member[first[u]:first[u + 1]]
            touched = owner[ranges(begin[own], begin[own + 1] - begin[own])]
            common = np.bincount(touched[open_[touched]], minlength=n)
            # 100 i >= p (a + b - i), with whole numbers
            reached = np.flatnonzero((100 + percent) * common >= percent * (sizes[u] + sizes))
            reached = reached[open_[reached]]
            for v in reached.tolist():
                out.append((u, v))
            open_[reached] = False
            left -= len(reached)
            queue.extend(reached.tolist())
        if not left:
            break
    return out


def _confirmed(families: DataFrame, docs: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) on whole sets that hold each family (family, node) together."""
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    dealt = families.join(sizes, "family").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # A family of one block is searched once; of more, each pair of blocks once.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = dealt.withColumn("own", own).select("node", "family", "own", other)
    cells = placed.select(
        F.col("node").alias("doc_id"), "family",
        F.least("own", "other").cast("int").alias("low"), F.greatest("own", "other").cast("int").alias("high"))

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_state()
        for batch in batches:
            for part in chunks(batch, size=SET_CHUNK):
                flat, starts = shingle_sets(part.column("text"))
                sets = [flat[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "items"])

    wanted = families.select(F.col("node").alias("doc_id"))
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    sets = named.join(wanted, "doc_id", "left_semi").mapInArrow(hash_sets, "doc_id long, items binary")
    rows = sets.where(F.length("items") > 0).join(cells, "doc_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_state()
        cell, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = _links(sets, percent) if len(sets) > 1 else []
            u = np.array([nodes[i] for i, _ in found], dtype=np.int64)
            v = np.array([nodes[j] for _, j in found], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("family", "low", "high")])
            for key, node, items in zip(keys, batch.column("doc_id").to_pylist(), batch.column("items")):
                if key != cell:
                    if sets:
                        yield links()
                    cell, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.frombuffer(items.as_buffer(), dtype=np.uint64).copy())
        if sets:
            yield links()

    ordered = rows.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", "doc_id")
    return ordered.select("family", "low", "high", "doc_id", "items").mapInArrow(search, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept, for every row."""
    sketched = materialise(sketch(docs))
    named = sketched.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialise(named.groupBy("high", "low").agg(
        F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")))
    members = _regions(forest(classes)).join(classes.select("node", "sketch"), "node")
    families = materialise(components(_candidates(members)).withColumnRenamed("component", "family"))
    groups = components(_confirmed(families, docs, block))
    of_class = classes.select("high", "low", "node").join(groups, "node", "left").select(
        "high", "low", F.coalesce("component", "node").alias("component"))
    return (
        sketched.select("doc_id", "n_shingles", "high", "low").join(of_class, ["high", "low"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    )


ship(__name__)
