"""Passages of test items in training texts: n-gram seeds, then local alignment.

Words are runs of letters and digits (bytes above 0x7F count as letters), A-Z as a-z, so that
signs and spacing do not matter. Every ``GRAM``-word sequence of every item is a seed: nothing about
the corpus decides which are looked for, so a passage that a third of all documents share is found
in each, whichever of its words were changed. A seed is rare if one item only has it, once.

A rare seed found in a text joins the text to the item; a common one, a turn of phrase that several
items have, does so only in company of another seed of the item near it. Around a seed lies the
region that any alignment through it that could count is within; regions that touch are one, and
that is what near means. The Smith-Waterman
alignment of the item's words with the region (match +2, anything else -1) gives the score, divided
by that of a perfect copy: inserted, dropped and exchanged words cost little. A document is
contaminated by an item from ``MIN_SCORE`` on, or if ``LONG_PART`` words of it match in one
alignment that loses at most a fifth of their score. Regions whose words, in whatever order, cannot
give either are not aligned; that bound is never below the score.

Items are sent to the executors in blocks of at most ``BLOCK_WORDS`` words, one pass over the
texts for each block; nothing about documents comes to the driver. A task joins at most some
``PAIRS`` seeds found to items at a time. Items of fewer than ``MIN_WORDS`` words, or null,
contaminate nothing; null and empty texts are never contaminated. Equal documents or items are
reported each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import drop_worker_state, ship
from .words import SIGNS, as_texts, chunks, find_words, owners, ranges, span_hashes, window_hashes

GRAM = 3
MIN_WORDS = 5
MIN_SCORE = 0.5
LONG_PART = 20
BLOCK_WORDS = 1 << 21
PAIRS = 1 << 20
_BLOOM_BITS = 22


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column, and the index of each text's first word."""
    texts = as_texts(column)
    words = find_words(texts, SIGNS)
    return span_hashes(texts, words.start, words.end, lower=True), words.first


class Lookup:
    """Places of given hashes in a sorted list, with a bit table to skip most others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << _BLOOM_BITS, dtype=bool)
        self.bits[keys >> np.uint64(64 - _BLOOM_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are keys, and the key of each of those."""
        maybe = np.flatnonzero(self.bits[hashes >> np.uint64(64 - _BLOOM_BITS)])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == hashes[maybe] if len(self.keys) else np.zeros(0, dtype=bool)
        return maybe[hit], at[hit]


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: score, matched words, start and end in the region.

    A row per word of the region; within it, gaps in the item are a running maximum.
    """
    m = len(item)
    steps = np.arange(m + 1)
    score = np.zeros(m + 1, dtype=np.int64)
    origin, matches = np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
    best = (0, 0, 0, 0)
    for i, word in enumerate(region):
        same = item == word
        diagonal = score[:-1] + np.where(same, 2, -1)
        above = score[1:] - 1
        new = np.zeros(m + 1, dtype=np.int64)
        from_diagonal = diagonal >= above
        new[1:] = np.maximum(np.maximum(diagonal, above), 0)
        fresh = score[:-1] == 0
        new_origin, new_matches = np.full(m + 1, i), np.zeros(m + 1, dtype=np.int64)
        new_origin[1:] = np.where(from_diagonal, np.where(fresh, i, origin[:-1]), origin[1:])
        new_matches[1:] = np.where(from_diagonal, np.where(fresh, 0, matches[:-1]) + same, matches[1:])
        raised = new + steps
        source = np.maximum.accumulate(np.where(raised == np.maximum.accumulate(raised), steps, 0))
        score = np.maximum(raised[source] - steps, 0)
        origin, matches = new_origin[source], new_matches[source]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(matches[top]), int(origin[top]), i + 1)
    return best


def _regions(
    doc: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray, rare: np.ndarray, n: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, item, start and end, those of one document and item that touch as one; n words in all.

    Of these, the ones around a rare seed or around several seeds.
    """
    if not len(doc):
        return doc, item, start, end
    order = np.lexsort((start, item, doc))
    doc, item, start, end, rare = doc[order], item[order], start[order], end[order], rare[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    shift = np.cumsum(new) * (n + 1)  # places of one document and item are above those of the one before
    reach = np.maximum.accumulate(end + shift)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first, len(doc))[1:] - 1
    worth = np.logical_or.reduceat(rare, first) | (last > first)
    first, last = first[worth], last[worth]
    return doc[first], item[first], start[first], (reach - shift)[last]


class Items:
    """One block of items, as arrays."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted seed hashes, the items of each, and its first and last place in the item."""
        grams = [window_hashes(words, GRAM) for words in self.words]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        grams = np.concatenate(grams)
        order = np.lexsort((place, item, grams))
        grams, item, place = grams[order], item[order], place[order]
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (item[1:] != item[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(grams)) - 1
        return grams[first], item[first].astype(np.int32), place[first].astype(np.int32), place[last].astype(np.int32)


class Measure:
    """When an alignment with an item counts, and which parts of a text could have one."""

    def __init__(self, min_score: float, long_part: int):
        self.min_score, self.long_part = min_score, long_part

    def counts(self, size: int, score: int, matched: int) -> bool:
        return score / (2 * size) >= self.min_score or (matched >= self.long_part and score >= 1.6 * matched)

    def margin(self, size: np.ndarray) -> np.ndarray:
        """Most words that an alignment that counts can have beside the item's."""
        return np.ceil(size * max(2 - 2 * self.min_score, 0.4)).astype(np.int64)

    def part(self, vocabulary: np.ndarray, times: np.ndarray, region: np.ndarray) -> tuple[int, int] | None:
        """From the first to the last word of the item in the region, if an alignment could count.

        At most each word of the item is matched as often as both have it, and a word of the
        region gives 2 if the item has it, else takes 1.
        """
        at = np.searchsorted(vocabulary, region)
        at[at == len(vocabulary)] = 0
        known = vocabulary[at] == region
        matched = int(np.minimum(np.bincount(at[known], minlength=len(times)), times).sum())
        size = int(times.sum())
        if matched / size < self.min_score and matched < self.long_part:
            return None
        total = np.zeros(len(region) + 1, dtype=np.int64)
        np.cumsum(np.where(known, 2, -1), out=total[1:])
        score = min(int((total - np.minimum.accumulate(total)).max()), 2 * matched)
        if score / (2 * size) < self.min_score and (matched < self.long_part or score < 1.6 * self.long_part):
            return None
        where = np.flatnonzero(known)
        return int(where[0]), int(where[-1]) + 1


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks, by a hash of the row, of about half of ``BLOCK_WORDS`` words each."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    # A word and its break take two bytes at least.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_WORDS))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        table = part.toArrow().combine_chunks().sort_by([("item_id", "ascending"), ("text", "ascending")])
        ids, words = [], []
        hashes, first = _hashed(table.column("text"))
        for i, item_id in enumerate(table.column("item_id").to_pylist()):
            if first[i + 1] - first[i] >= MIN_WORDS:
                ids.append(item_id)
                words.append(hashes[first[i]:first[i + 1]])
        if ids:
            yield Items(ids, words)


RESULT = "doc_id long, item_id long, score double, matched long, first_word long, end_word long"


def _shares(load: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of items whose load is about ``PAIRS``, or one item of more."""
    piece = np.cumsum(load) // PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(load)]
    yield from zip(cuts, cuts[1:])


def _search(docs: DataFrame, items: Items, min_score: float, long_part: int) -> DataFrame:
    box = docs.sparkSession.sparkContext.broadcast((items.ids, items.words, *items.seeds()))
    measure = Measure(min_score, long_part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_state()
        ids, item_words, grams, seed_item, low, high = box.value
        keys, seed_key, holders = np.unique(grams, return_inverse=True, return_counts=True)
        rare = (holders[seed_key] == 1) & (low == high)
        seed_rank = seed_key * len(ids) + seed_item  # ascending
        lookup = Lookup(keys)
        sizes = np.array([len(words) for words in item_words])
        margins = measure.margin(sizes)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in chunks(batch):
                hashes, first = _hashed(part.column("text"))
                at, key = lookup.find(window_hashes(hashes, GRAM))
                owner = owners(first)
                inside = owner[at] == owner[at + GRAM - 1]
                at, key = at[inside], key[inside]
                found = np.bincount(key, minlength=len(keys))
                load = np.bincount(seed_item, weights=found[seed_key], minlength=len(ids))
                doc_ids = part.column("doc_id")
                best: dict[tuple[int, int], tuple] = {}
                for lowest, end in _shares(load):
                    since = np.searchsorted(seed_rank, key * len(ids) + lowest)
                    repeat = np.searchsorted(seed_rank, key * len(ids) + end) - since
                    seed, place = ranges(since, repeat), np.repeat(at, repeat)
                    doc, item = owner[place], seed_item[seed]
                    regions = _regions(
                        doc, item, np.maximum(place - high[seed] - margins[item], first[doc]),
                        np.minimum(place - low[seed] + sizes[item] + margins[item], first[doc + 1]), rare[seed], len(hashes))
                    for d, k, x, y in zip(*(r.tolist() for r in regions)):
                        if k not in known:
                            known[k] = np.unique(item_words[k], return_counts=True)
                        inner = measure.part(*known[k], hashes[x:y])
                        if inner is None:
                            continue
                        x, y = x + inner[0], x + inner[1]
                        score, matched, a, b = align(item_words[k], hashes[x:y])
                        if measure.counts(len(item_words[k]), score, matched) and (
                                (d, k) not in best or score > best[d, k][0]):
                            best[d, k] = score, matched, x - int(first[d]) + a, x - int(first[d]) + b
                out = [(doc_ids[d].as_py(), ids[k], r[0] / (2 * len(item_words[k])), *r[1:])
                       for (d, k), r in best.items()]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(names, r)) for r in out], schema=schema)

    names = ["doc_id", "item_id", "score", "matched", "first_word", "end_word"]
    schema = pa.schema([(n, pa.float64() if n == "score" else pa.int64()) for n in names])
    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE,
               long_part: int = LONG_PART) -> DataFrame:
    """A row per document and item that contaminates it: score, matched words, place in the text.

    ``first_word`` and ``end_word`` count words as defined above.
    """
    out = None
    for items in _blocks(benchmark):
        part = _search(docs, items, min_score, long_part)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    return out


ship(__name__)
