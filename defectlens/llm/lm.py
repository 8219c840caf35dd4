"""Scores under a bigram model held in Elias-Fano tries, which grows with the corpus.

Tokens are words with A-Z as a-z, and an end after each text. The model is interpolated absolute
discounting: P(w | c) = max(n(c, w) - D, 0) / n(c) + D * kinds(c) / n(c) * P(w), and P(w) alone if c
was never seen as a context; P(w) = (n(w) + 0.5) / (N + 0.5 * (V + 1)) is also the base model. A text
begins with a context of its own. All counts come from all training rows.

1. The texts are cut into blocks of about ``BLOCK_BYTES``. A block keeps the sorted distinct hashes of
   its words, how often each occurs in training rows, and its texts as numbers of its words. Blocks
   are written as a table, so that later steps meet the same blocks.
2. Each block asks for its words' counts: its distinct words go to shards by hash, which add up the
   counts of all blocks and answer. A word that every text holds is one entry per block.
3. Each block asks for its distinct word pairs, by shards of the first word, the context. A shard adds
   up the training counts, builds a trie of its contexts and their successors with quantised shares
   (:mod:`.eliasfano`), looks every pair up within its context and answers with a byte each.
4. Each block meets its answers again and scores its texts.

The trie knows contexts by 64-bit hash and successors by 32 bits of theirs within a context. No step
holds more than the distinct words or pairs of a shard, or one block; only N and V come to the driver.
A null text counts as empty and has one token. A row without doc_id is scored but not learned from.
Equal rows count each. Only doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .eliasfano import Trie, quantised, restored
from .tables import materialise, ship
from .words import as_texts, chunks, find_words, mix, span_hashes

DISCOUNT = 0.75
BLOCK_BYTES = 12 << 20
#: Shards per shuffle partition, so that partitions get about equal numbers of them.
SHARDS_PER_PARTITION = 4
_END, _BEGIN = (int(x) for x in mix(np.array([11, 12], dtype=np.uint64)))


def _pack(array: np.ndarray) -> bytes:
    """Compressed bytes, the bytes of equal place of all values side by side."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


_BLOCK = "block long, doc_ids binary, no_id binary, learn binary, lengths binary, tokens binary, words binary, counts binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """The table of blocks; ``words`` are sorted, and ``tokens`` count them from 0."""
    def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(parts).combine_chunks()
        texts = as_texts(batch.column("text"))
        found = find_words(texts)
        hashes = span_hashes(texts, found.start, found.end, lower=True)
        lengths = np.diff(found.first) + 1
        ends = np.cumsum(lengths) - 1
        stream = np.full(len(hashes) + len(lengths), _END, dtype=np.uint64)
        inner = np.ones(len(stream), dtype=bool)
        inner[ends] = False
        stream[inner] = hashes
        words, tokens = np.unique(stream, return_inverse=True)
        learn = batch.column("learn").to_numpy().astype(bool)
        counts = np.bincount(tokens[np.repeat(learn, lengths)], minlength=len(words))
        ids = batch.column("doc_id")
        columns = [
            _pack(ids.fill_null(0).to_numpy().astype(np.int64)), _pack(np.array(ids.is_null().to_pylist(), np.uint8)),
            _pack(learn.astype(np.uint8)), _pack(lengths.astype(np.uint32)), _pack(tokens.astype(np.uint32)),
            words.tobytes(), _pack(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *[pa.array([c], pa.binary()) for c in columns]],
            names=["block", "doc_ids", "no_id", "learn", "lengths", "tokens", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts, size = [], 0
        for batch in batches:
            for part in chunks(batch, size=BLOCK_BYTES // 4):
                parts.append(part)
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    yield block(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield block(number, parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("learn"))
    return rows.mapInArrow(run, _BLOCK)


def _cut(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards that sorted hashes belong to, by their leading bits, and where each begins."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    used, begin = np.unique(shard, return_index=True)
    return used, np.append(begin, len(hashes))


def _ask_words(blocks: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*[batch.column(c).to_pylist() for c in ("block", "words", "counts")]):
                words, counts = np.frombuffer(words, np.uint64), _unpack(counts, np.int64)
                used, begin = _cut(words, shards)
                parts = list(zip(begin[:-1], begin[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used), pa.array([block] * len(used), pa.int64()),
                     pa.array([words[a:b].tobytes() for a, b in parts], pa.binary()),
                     pa.array([_pack(counts[a:b]) for a, b in parts], pa.binary())],
                    names=["shard", "block", "words", "counts"])

    return blocks.select("block", "words", "counts").mapInArrow(
        run, "shard long, block long, words binary, counts binary")


def _by_shard(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "shard").sortWithinPartitions("shard", "block")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of equal key, which come one after the other."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != current:
                if rows:
                    yield current, rows
                current, rows = row[key], []
            rows.append(row)
    if rows:
        yield current, rows


def _answer_words(asked: DataFrame, partitions: int) -> DataFrame:
    """(block, shard, counts, learned): the sums for each block's words; ``learned`` is set once per
    shard, the number of its words that occur in training rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            words = [np.frombuffer(r["words"], np.uint64) for r in rows]
            distinct, at = np.unique(np.concatenate(words), return_inverse=True)
            sums = np.zeros(len(distinct), dtype=np.int64)
            np.add.at(sums, at, np.concatenate([_unpack(r["counts"], np.int64) for r in rows]))
            cut = np.cumsum([len(w) for w in words])[:-1]
            learned = [int((sums > 0).sum())] + [0] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["block"] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()),
                 pa.array([_pack(sums[p]) for p in np.split(at, cut)], pa.binary()), pa.array(learned, pa.int64())],
                names=["block", "shard", "counts", "learned"])

    return _by_shard(asked, partitions).mapInArrow(run, "block long, shard long, counts binary, learned long")


def _pairs(lengths: np.ndarray, tokens: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts' hashes, sorted, with the beginning among them; the distinct (context, word) pairs
    sorted, as numbers; the pair of each token."""
    place = int(np.searchsorted(words, np.uint64(_BEGIN)))
    contexts = np.insert(words, place, np.uint64(_BEGIN))
    before = np.empty(len(tokens), dtype=np.int64)
    before[1:] = tokens[:-1]
    before += before >= place
    before[np.cumsum(lengths) - lengths] = place
    distinct, pair = np.unique(before << 32 | tokens.astype(np.int64), return_inverse=True)
    return contexts, distinct >> 32, distinct & 0xFFFFFFFF, pair


def _block_arrays(row: dict) -> tuple[np.ndarray, ...]:
    return (_unpack(row["lengths"], np.uint32).astype(np.int64), _unpack(row["tokens"], np.uint32),
            np.frombuffer(row["words"], np.uint64))


def _used(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of a sorted list, and how often each occurs."""
    return np.unique(context, return_counts=True)


def _ask_pairs(blocks: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, tokens, words = _block_arrays(row)
                contexts, context, word, pair = _pairs(lengths, tokens, words)
                learn = np.repeat(_unpack(row["learn"], np.uint8).astype(bool), lengths)
                counts = np.bincount(pair[learn], minlength=len(context)).astype(np.uint32)
                marks = (words[word] >> np.uint64(32)).astype(np.uint32)
                own, kinds = _used(context)
                names = contexts[own]
                used, begin = _cut(names, shards)
                first = np.concatenate([[0], np.cumsum(kinds)])[begin]
                for shard, a, b, x, y in zip(used.tolist(), begin[:-1], begin[1:], first[:-1], first[1:]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int64()), pa.array([row["block"]], pa.int64()),
                         pa.array([names[a:b].tobytes()], pa.binary()),
                         pa.array([_pack(kinds[a:b].astype(np.uint32))], pa.binary()),
                         pa.array([marks[x:y].tobytes()], pa.binary()), pa.array([_pack(counts[x:y])], pa.binary())],
                        names=["shard", "block", "contexts", "kinds", "marks", "counts"])

    return blocks.select("block", "learn", "lengths", "tokens", "words").mapInArrow(
        run, "shard long, block long, contexts binary, kinds binary, marks binary, counts binary")


def build_trie(contexts: list[np.ndarray], kinds: list[np.ndarray], marks: list[np.ndarray],
               counts: list[np.ndarray], discount: float) -> tuple[Trie, np.ndarray, np.ndarray]:
    """The trie of a shard from its blocks' pairs; the contexts asked for, and each pair's number
    (context, mark) among all pairs, for the look-up."""
    names, number = np.unique(np.concatenate(contexts), return_inverse=True)
    keys = np.repeat(number, np.concatenate(kinds)).astype(np.uint64) << np.uint64(32)
    keys |= np.concatenate(marks).astype(np.uint64)
    distinct, at = np.unique(keys, return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct))
    seen = sums > 0
    used, context_of = np.unique(distinct[seen] >> np.uint64(32), return_inverse=True)
    trie = Trie(names[used.astype(np.int64)], context_of,
                (distinct[seen] & np.uint64(0xFFFFFFFF)).astype(np.uint32), sums[seen], discount)
    return trie, names, distinct[at]


def _answer_pairs(asked: DataFrame, partitions: int, discount: float) -> DataFrame:
    """(block, shard, shares, found, backed, known) of each block's pairs and contexts in the shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            contexts = [np.frombuffer(r["contexts"], np.uint64) for r in rows]
            kinds = [_unpack(r["kinds"], np.uint32).astype(np.int64) for r in rows]
            marks = [np.frombuffer(r["marks"], np.uint32) for r in rows]
            trie, names, keys = build_trie(
                contexts, kinds, marks, [_unpack(r["counts"], np.uint32) for r in rows], discount)
            begin = 0
            for row, own, size in zip(rows, contexts, map(len, marks)):
                key = keys[begin:begin + size]
                begin += size
                context_of = np.searchsorted(own, names[(key >> np.uint64(32)).astype(np.int64)])
                found, shares, known, backed = trie.look_up(own, context_of, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                columns = [shares, np.packbits(found), backed, np.packbits(known)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), pa.array([shard], pa.int64()),
                     *[pa.array([_pack(c) if i % 2 == 0 else c.tobytes()], pa.binary()) for i, c in enumerate(columns)]],
                    names=["block", "shard", "shares", "found", "backed", "known"])

    return _by_shard(asked, partitions).mapInArrow(
        run, "block long, shard long, shares binary, found binary, backed binary, known binary")


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(meeting: DataFrame, total: int, learned: int) -> DataFrame:
    """Scores from rows sorted by block, kind (0: the block, 1: word counts, 2: pairs) and shard."""
    def bits(rows: list[dict], name: str, sizes: list[int]) -> np.ndarray:
        return np.concatenate([np.unpackbits(np.frombuffer(r[name], np.uint8), count=n) for r, n in zip(rows, sizes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            block = next(r for r in rows if r["kind"] == 0)
            lengths, tokens, words = _block_arrays(block)
            counts = np.concatenate([_unpack(r["counts"], np.int64) for r in rows if r["kind"] == 1])
            answers = [r for r in rows if r["kind"] == 2]
            shares = [_unpack(r["shares"], np.uint8) for r in answers]
            backed = [_unpack(r["backed"], np.uint8) for r in answers]
            found = bits(answers, "found", [len(s) for s in shares])
            known = bits(answers, "known", [len(b) for b in backed])
            _, context, word, pair = _pairs(lengths, tokens, words)
            base = (counts + 0.5) / (total + 0.5 * (learned + 1))
            _, kinds = _used(context)
            back = np.repeat(np.where(known, restored(np.concatenate(backed)), 1.0), kinds)
            share = np.where(found, restored(np.concatenate(shares)), 0.0)
            log_pair = np.log10(share + back * base[word])
            first = np.cumsum(lengths) - lengths
            missing = _unpack(block["no_id"], np.uint8).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_unpack(block["doc_ids"], np.int64), pa.int64(), mask=missing), pa.array(lengths),
                 pa.array(np.add.reduceat((counts > 0)[tokens].astype(np.int64), first)),
                 pa.array(np.add.reduceat(np.log10(base)[tokens], first)),
                 pa.array(np.add.reduceat(log_pair[pair], first))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return meeting.mapInArrow(run, RESULT)


def score_documents(docs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of (doc_id,
    text, learn); rows with ``learn`` are the training rows."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = SHARDS_PER_PARTITION * partitions
    blocks = materialise(_blocks(docs.withColumn("learn", F.coalesce("learn", F.lit(False)) & F.col("doc_id").isNotNull())))
    word_answers = materialise(_answer_words(_ask_words(blocks, shards), partitions))
    pair_answers = materialise(_answer_pairs(_ask_pairs(blocks, shards), partitions, discount))
    learned = word_answers.agg(F.sum("learned")).first()[0] or 0

    def tokens_learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(_unpack(c, np.int64).sum()) for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], names=["n"])

    total = blocks.select("counts").mapInArrow(tokens_learned, "n long").agg(F.sum("n")).first()[0] or 0
    empty = F.lit(None).cast("binary")
    columns = ["doc_ids", "no_id", "lengths", "tokens", "words", "counts", "shares", "found", "backed", "known"]

    def shaped(rows: DataFrame, kind: int) -> DataFrame:
        shard = F.col("shard") if "shard" in rows.columns else F.lit(0).cast("long").alias("shard")
        return rows.select("block", F.lit(kind).alias("kind"), shard,
                           *[F.col(c) if c in rows.columns else empty.alias(c) for c in columns])

    meeting = shaped(blocks.drop("counts"), 0).unionByName(shaped(word_answers, 1)).unionByName(shaped(pair_answers, 2))
    scored = _score(meeting.repartition("block").sortWithinPartitions("block", "kind", "shard"), total, learned)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


ship(__name__)
