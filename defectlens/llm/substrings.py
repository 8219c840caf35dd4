"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``WINDOW`` consecutive words of one document; it is a copy if its words also start in a
document of smaller id. All documents are reference and text to parse at once:

1. Anchors cut every text at places that depend on its words alone: of each window, the least hash
   of its ``GRAM``-word sequences. An anchor stands for a run of consecutive windows, and equal
   windows have equal anchors. Runs whose anchor no other document has are done: this leaves the
   repeated part of the texts. A word repeated over and over is one run.
2. The reference is indexed in blocks by anchor. Runs of one anchor with equal words throughout are
   one entry, with its smallest document, so the inside of copies, of whole texts too, is settled
   here without looking at words again.
3. Where a factor may begin or end, entries of one anchor differ. There the windows themselves are
   looked up: the phrases of each entry, with the smallest document of each phrase.
4. Each document is parsed greedily from left to right: a factor starts at a window that the
   reference has and goes on as long as the next one is there, so its boundaries are exact to the
   word. A factor has ``WINDOW`` words or more; its words are a duplicate span.

Phrases are compared by 64-bit hash. Words are maximal runs of characters other than space and
0x09-0x0D, unchanged. A null text has no words. Rows without doc_id come last: they are copies of
any document, but not of each other. Equal rows of one doc_id are judged alike, and rows of one doc_id
with different texts are no copies of each other. Only doc_id and text are read; an empty table
gives no rows. An anchor or phrase that a third of all documents hold is one value: smallest
documents are found with partial minima before the shuffle, and the joins back have exchanges of
their own, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import join_apart, materialise, ship
from .words import as_texts, chunks, find_words, mix, ranges, span_hashes, window_hashes

WINDOW = 50
GRAM = 16
_LAST = (1 << 63) - 1


def _least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` entries the place of its least, the leftmost of equal ones.

    Minima of doubling lengths, two of which overlap to cover the width.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, covered = np.arange(len(hashes)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(hashes[b] < hashes[a], b, a)

    while 2 * covered <= width:
        place, covered = better(place[:-covered], place[covered:]), 2 * covered
    return better(place[:n], place[width - covered:width - covered + n])


def anchors(first: np.ndarray, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts with words from ``first[i]`` on, each run of windows of one anchor: the anchor,
    the text, the first window and the number of windows."""
    grams = window_hashes(hashes, gram)
    least = _least_places(grams, window - gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.maximum(np.diff(first) - window + 1, 0))
    starts = ranges(first[:-1], np.maximum(np.diff(first) - window + 1, 0))
    chosen = least[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), dtype=bool)
    anchor = grams[chosen]
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(text) != 0)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(starts)))
    return anchor[begin], text[begin], starts[begin] - first[text[begin]], count


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = as_texts(column)
    words = find_words(texts)
    return words.first, span_hashes(texts, words.start, words.end)


def _named(docs: DataFrame) -> DataFrame:
    """id and text, never null, and name, a hash that tells texts of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), text.alias("text"),
        F.xxhash64(text).alias("name"))


def _runs(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, words, id, name, start, count): every run, ``words`` a hash of all its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                first, hashes = _hashed(part.column("text"))
                anchor, text, start, count = anchors(first, hashes, window, gram)
                # The windows' hashes, each over ``window`` words, tell all words of the run.
                phrases = window_hashes(hashes, window)
                total = np.concatenate([[np.uint64(0)], np.cumsum(phrases, dtype=np.uint64)])
                begin = first[text] + start
                words = mix(total[begin + count] - total[begin] + count.astype(np.uint64))
                ids, names = part.column("id").to_numpy(), part.column("name").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(words.view(np.int64)), pa.array(ids[text]),
                     pa.array(names[text]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["anchor", "words", "id", "name", "start", "count"])

    return texts.select("id", "name", "text").mapInArrow(
        run, "anchor long, words long, id long, name long, start int, count int")


def _phrases(texts: DataFrame, window: int) -> DataFrame:
    """(phrase, id, name, at) of the windows in ``runs`` (array of start and count) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                first, hashes = _hashed(part.column("text"))
                phrases = window_hashes(hashes, window)
                listed = part.column("runs")
                flat = listed.flatten()
                begin, count = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                owner = np.repeat(np.arange(part.num_rows), listed.value_lengths().to_numpy())
                owner, at = np.repeat(owner, count), ranges(begin, count)
                ids, names = part.column("id").to_numpy(), part.column("name").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(phrases[first[owner] + at].view(np.int64)), pa.array(ids[owner]),
                     pa.array(names[owner]), pa.array(at.astype(np.int32))], names=["phrase", "id", "name", "at"])

    return texts.select("id", "name", "text", "runs").mapInArrow(run, "phrase long, id long, name long, at int")


def _per_text(runs: DataFrame) -> DataFrame:
    """The runs of each text as one list: at most one entry per word."""
    return runs.groupBy("id", "name").agg(F.collect_set(F.struct("start", "count")).alias("runs"))


def copied_runs(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, name, start, count): runs of windows that also start in a text of smaller id."""
    every = materialise(_runs(texts, window, gram))
    ends = every.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    shared = ends.where("first < last").select("anchor")
    runs = materialise(join_apart(every, shared, "anchor", "left_semi"))
    entries = runs.groupBy("anchor", "words").agg(F.min("id").alias("least"))
    differing = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1").select("anchor")
    # Joined by the hash of both, so that the exchanges are not those of the grouping.
    both = F.xxhash64("anchor", "words").alias("both")
    pairs = entries.select(both, F.col("anchor").alias("of"), F.col("words").alias("all"), "least")
    known = materialise(runs.withColumn("both", both).join(pairs, "both").where("anchor = of and words = all"))
    whole = known.where("least < id").select("id", "name", "start", "count")
    edges = join_apart(known.where("least = id"), differing, "anchor", "left_semi")
    phrases = materialise(_phrases(texts.join(_per_text(edges), ["id", "name"]), window))
    ends = phrases.groupBy("phrase").agg(F.min("id").alias("least"), F.max("id").alias("last"))
    single = join_apart(phrases, ends.where("least < last").select("phrase", "least"), "phrase").where("least < id")
    return whole.unionByName(single.select("id", "name", F.col("at").alias("start"), F.lit(1).alias("count")))


def _spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The greedy parse: factors from the sorted starts of phrases that the reference has."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    begin = starts[np.concatenate([[0], cut])]  # factors may overlap, as windows do
    end = starts[np.concatenate([cut - 1, [len(starts) - 1]])] + window
    return list(zip(begin.tolist(), end.tolist()))


RESULT = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept_text string"


def dedup_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, the duplicate spans (numbers of words, end exclusive) and the kept words,
    joined by single spaces, of every row."""
    texts = _named(docs)
    copies = _per_text(copied_runs(texts, window, gram))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                spans, counts, kept = [], [], []
                for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist()):
                    words = text.encode().split()  # at ASCII white space: space and 0x09-0x0D
                    counts.append(len(words))
                    own: list[tuple[int, int]] = []
                    if runs:
                        begin = np.array([r["start"] for r in runs])
                        own = _spans(np.unique(ranges(begin, np.array([r["count"] for r in runs]))), window)
                    if own:
                        left, at = [], 0
                        for a, b in own:
                            left += words[at:max(a, at)]
                            at = max(at, b)
                        words = left + words[at:]
                    spans.append([{"start": a, "end": b} for a, b in own])
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, _SPAN_TYPE),
                     pa.array(kept, pa.string())], names=["doc_id", "n_words", "spans", "kept_text"])

    rows = texts.join(copies, ["id", "name"], "left")
    doc_id = F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id")
    return rows.select(doc_id, "text", "runs").mapInArrow(parse, RESULT)


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

ship(__name__)
