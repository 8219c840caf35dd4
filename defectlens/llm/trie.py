"""Prefix trie of conversations, by ternary search trees over range shards.

A conversation is its turns in order; every distinct sequence of first turns is a node of the
trie, the empty sequence its root.

1. Turns are dictionary-encoded: a turn's role and text are hashed (SHA-256) where they are read,
   the distinct digests are numbered in their order, and only numbers go on.
2. Equal sequences are made one, with their count and smallest id. The digest of all ids that end
   at a sequence is streamed over sorted pieces of 4,096 ids at most, joined to texts beforehand:
   the hash of one list is serial by its definition, but no list is held whole.
3. Distinct sequences are numbered in their order (:mod:`order`) and cut into shards of about
   ``SHARD_TURNS`` turns. Each shard becomes a ternary search tree, its sequences inserted median
   first, which balances the trees of sibling turns. Two passes over its nodes without recursion
   add up members, leaves and words.
4. Nodes that a shard shares with its neighbours, prefixes of its first or last sequence, are
   merged afterwards. All sums are over disjoint things: words and leaves of a shared node count
   in the first shard that has it, members in each. A shard knows this from the last sequence
   before it and the first one after it. Nodes are 1 + (turns that differ), never all pairs.

Turns come in the order of ``turn``, null first; equal ones in the order of their digests. A null
role or text is an empty one. Rows without conv_id belong to no conversation and are left out. A
conversation is held as a list of 8-byte numbers, so a task needs memory for its longest one. An
empty table gives no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .order import numbered
from .tables import join_apart, materialise, ship

SHARD_TURNS = 1 << 16
#: Ids of a piece differ in this many low bits.
_PIECE_BITS = 12
_WORD = r"[^\x20\x09-\x0D]+"
_COUNTS = "depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string"


def encode_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, ids and words of each conversation: the numbers of its turns and their words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = materialise(conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", name.alias("name"), F.regexp_count(text, F.lit(_WORD)).alias("n_words")))
    names = materialise(rows.select("name").distinct())
    encoded = join_apart(rows, numbered(names, ["name"]).select("name", "rank"), "name")
    turns = F.sort_array(F.collect_list(F.struct("turn", F.col("rank").alias("id"), "n_words")))
    return encoded.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.col("turns.id").alias("ids"), F.col("turns.n_words").alias("words"))


def with_shared_head(encoded: DataFrame, head_of, taken, most: int) -> DataFrame:
    """Conversations with their first ``taken`` turns replaced by those of ``head_of``.

    Both are columns over conv_id, ``taken`` at most ``most``. If the other conversation has fewer
    turns all of them are taken, and none if there is no such conversation.
    """
    heads = encoded.select(F.col("conv_id").alias("head"), *[
        F.slice(c, 1, most).alias(f"head_{c}") for c in ("ids", "words")])
    own = encoded.withColumn("head", head_of).withColumn("taken", taken.cast("int"))
    joined = own.join(heads, "head", "left")

    def rebuilt(c: str):
        rest = F.slice(c, F.col("taken") + 1, F.greatest(F.size(c), F.lit(1)))
        return F.concat(F.coalesce(F.slice(f"head_{c}", F.lit(1), F.col("taken")), F.slice(c, 1, 0)), rest).alias(c)

    return joined.select("conv_id", rebuilt("ids"), rebuilt("words"))


class TernaryTree:
    """Sequences of numbers: a node per turn, siblings in a search tree, ``eq`` to the next turn."""

    def __init__(self) -> None:
        self.turn: list[int] = []
        self.word: list[int] = []
        self.low: list[int] = []
        self.eq: list[int] = []
        self.high: list[int] = []
        self.end: list[int] = []
        self.top = -1

    def insert(self, ids: Sequence[int], words: Sequence[int], mark: int) -> list[int]:
        """The nodes of the sequence, the last of which ends ``mark``."""
        turn, low, eq, high = self.turn, self.low, self.eq, self.high
        path, parent = [], -1
        for number, n_words in zip(ids, words):
            at, links, place = (self.top if parent < 0 else eq[parent]), None, parent
            while at >= 0 and turn[at] != number:
                links, place = (low if number < turn[at] else high), at
                at = links[at]
            if at < 0:
                at = len(turn)
                turn.append(number)
                self.word.append(n_words)
                low.append(-1)
                eq.append(-1)
                high.append(-1)
                self.end.append(-1)
                if links is not None:
                    links[place] = at
                elif parent < 0:
                    self.top = at
                else:
                    eq[parent] = at
            path.append(at)
            parent = at
        if path:
            self.end[path[-1]] = mark
        return path

    def walk(self) -> tuple[list[int], list[int], list[int]]:
        """Nodes in an order in which prefixes come first, with the prefix and depth of each node."""
        order: list[int] = []
        above, depth = [-1] * len(self.turn), [1] * len(self.turn)
        stack = [self.top] if self.top >= 0 else []
        while stack:
            at = stack.pop()
            order.append(at)
            for sibling in (self.low[at], self.high[at]):
                if sibling >= 0:
                    above[sibling], depth[sibling] = above[at], depth[at]
                    stack.append(sibling)
            if self.eq[at] >= 0:
                above[self.eq[at]], depth[self.eq[at]] = at, depth[at] + 1
                stack.append(self.eq[at])
        return order, above, depth


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle one first, then the middles of both halves, and so on."""
    spans = [(0, n)]
    while spans:
        lo, hi = spans.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            spans += [(mid + 1, hi), (lo, mid)]


def common(a: Sequence[int] | None, b: Sequence[int] | None) -> int:
    """The number of equal first turns; -1 if one is no sequence."""
    if a is None or b is None:
        return -1
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def shard_nodes(shard: int, members: list[dict], before: list[int] | None, after: list[int] | None) -> Iterator[tuple]:
    """Rows of a shard's nodes; ``members`` are its distinct sequences in order.

    Each is (shard, depth, conv_id, n_convs, n_children, n_leaves, saved, ends, up_conv_id, key,
    up_key). ``key`` is set if the node is shared with a neighbour: its figures are then this
    shard's part. ``up_conv_id`` is null if the prefix one turn shorter is shared.
    """
    tree, last = TernaryTree(), len(members) - 1
    first_path = last_path = ()
    for i in medians(len(members)):
        path = tree.insert(members[i]["ids"], members[i]["words"], i)
        first_path = path if i == 0 else first_path
        last_path = path if i == last else last_path
    order, above, depth = tree.walk()

    behind, ahead = common(members[0]["ids"], before), common(members[-1]["ids"], after)
    root = len(tree.turn)  # one more place for the root: index -1
    first_path, last_path = [root, *first_path], [root, *last_path]
    counted_before = set(first_path[:behind + 1])
    shared = counted_before | set(last_path[:ahead + 1])
    goes_on = last_path[ahead] if ahead == len(members[-1]["ids"]) else None

    n, least = [0] * (root + 1), [None] * (root + 1)
    children, leaves, spent, once = ([0] * (root + 1) for _ in range(4))
    above, depth, word = above + [None], depth + [0], tree.word + [0]
    ends = tree.end + [0 if not members[0]["ids"] else -1]
    longer = tree.eq + [tree.top]
    for at in [*reversed(order), root]:
        if ends[at] >= 0:
            member = members[ends[at]]
            n[at] += member["n"]
            least[at] = member["least"] if least[at] is None else min(least[at], member["least"])
        if longer[at] < 0 and at != goes_on:
            leaves[at] += 1
        spent[at] += n[at] * word[at]
        new = at not in counted_before
        once[at] += word[at] if new else 0
        if at != root:
            up = above[at]  # -1 is the root, the last place
            n[up] += n[at]
            least[up] = least[at] if least[up] is None else min(least[up], least[at])
            children[up] += new
            leaves[up] += leaves[at]
            spent[up] += spent[at]
            once[up] += once[at]

    keys = {}
    for path in (first_path, last_path):
        key = b""
        for at in path:
            if at not in shared:
                break
            key = hashlib.blake2b(key + (b"" if at == root else tree.turn[at].to_bytes(8, "little")), digest_size=16).digest()
            keys[at] = key
    for at in [root, *order]:
        up = None if at == root else root if above[at] < 0 else above[at]
        yield (shard, depth[at], least[at], n[at], children[at], leaves[at], spent[at] - once[at],
               members[ends[at]]["ends"] if ends[at] >= 0 else None,
               None if up is None or up in shared else least[up], keys.get(at), keys.get(up))


_ROW = pa.schema([
    ("shard", pa.int64()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
    ("up_conv_id", pa.int64()), ("key", pa.binary()), ("up_key", pa.binary())])
_DDL = f"shard long, {_COUNTS}, up_conv_id long, key binary, up_key binary"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            made = list(shard_nodes(row["shard"], row["members"], row["before"], row["after"]))
            for at in range(0, len(made), 1 << 14):
                columns = zip(*made[at:at + (1 << 14)])
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ROW)], schema=_ROW)


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name and SHA-256 of the texts of each name, joined by commas; a name's texts stand together."""
    name, state, out = None, None, []

    def full() -> pa.RecordBatch:
        names, digests = zip(*out)
        out.clear()
        return pa.record_batch({"name": pa.array(names, pa.binary()), "ends": pa.array(digests, pa.string())})

    for batch in batches:
        for own, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
            if own == name:
                state.update(b"," + text.encode())
                continue
            if state is not None:
                out.append((name, state.hexdigest()))
            name, state = own, hashlib.sha256(text.encode())
        if len(out) >= 1 << 12:
            yield full()
    if state is not None:
        out.append((name, state.hexdigest()))
        yield full()


def _end_digests(sequences: DataFrame) -> DataFrame:
    """name, ends: the digest of the ids of each sequence."""
    ids = F.sort_array(F.collect_list("conv_id"))
    pieces = sequences.groupBy("name", F.shiftright("conv_id", _PIECE_BITS).alias("piece")).agg(
        F.array_join(ids.cast("array<string>"), ",").alias("text"))
    stands = pieces.repartition("name").sortWithinPartitions("name", "piece")
    return stands.select("name", "text").mapInArrow(_stream_digests, "name binary, ends string")


def prefix_trie(encoded: DataFrame) -> DataFrame:
    """The nodes of the trie of encoded conversations (conv_id, ids, words), one row each.

    conv_id is the smallest member, parent_conv_id that of the node one turn shorter (null for the
    root); n_convs members; n_children; n_leaves, the childless nodes in the subtree; saved_tokens,
    the sum over the subtree of (n_convs - 1) times the words of the last turn; ends_sha256, the
    digest of the ids of the conversations that end at the node, ascending and joined by commas.
    """
    name = F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
    sequences = materialise(encoded.withColumn("name", name))
    distinct = sequences.groupBy("name", "ids", "words").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    distinct = materialise(distinct.join(_end_digests(sequences), "name").drop("name"))

    placed = numbered(distinct, ["ids"], weight=F.size("ids") + 1)
    shards = materialise(placed.groupBy(F.expr(f"before div {SHARD_TURNS}").alias("shard")).agg(
        F.min("ids").alias("first"), F.max("ids").alias("last"),
        F.sort_array(F.collect_list(F.struct("rank", "ids", "words", "n", "least", "ends"))).alias("members")))
    edges = numbered(materialise(shards.select("shard", "first", "last")), ["shard"])
    edges = edges.select("shard", "first", "last", "rank")
    known = edges.select("shard", "rank") \
        .join(edges.select((F.col("rank") + 1).alias("rank"), F.col("last").alias("before")), "rank", "left") \
        .join(edges.select((F.col("rank") - 1).alias("rank"), F.col("first").alias("after")), "rank", "left")
    rows = materialise(
        shards.join(known, "shard").select("shard", "members", "before", "after").mapInArrow(_nodes, _DDL))

    parts = rows.where("key IS NOT NULL")
    merged = materialise(parts.groupBy("key").agg(
        F.max("up_key").alias("up_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("ends").alias("ends")))
    least = merged.select("key", F.col("conv_id").alias("least"))
    prefixes = merged.join(least.withColumnRenamed("key", "up_key"), "up_key", "left") \
        .withColumn("up_conv_id", F.col("least"))
    # A shard's own nodes under shared prefixes look these up by shard, so a wide node is no hot key.
    inside = rows.where("key IS NULL")
    held = join_apart(parts.select("shard", "key"), least, "key").select("shard", F.col("key").alias("up_key"), "least")
    hanging = inside.where("up_key IS NOT NULL").join(held, ["shard", "up_key"]).withColumn("up_conv_id", F.col("least"))
    columns = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends", "up_conv_id"]
    every = inside.where("up_key IS NULL").select(columns) \
        .unionByName(hanging.select(columns)).unionByName(prefixes.select(columns))
    return every.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("up_conv_id").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


ship(__name__)
