"""Counts inside one text: its distinct units, the terms in them, and those of a vocabulary.

Each function sees the list of one text a row and hands a list back, so nothing is grouped across
rows, no row is moved and no table of all terms is held. Rows of some thousand units of a batch name
their strings once; the counts are sums over equal numbers, for some thousands of elements at a time
(a longer text by itself). So besides what goes in and out a batch takes the same memory at any length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from .shipping import ship_by_value

ship_by_value(__name__)

_COUNTED = pa.list_(pa.struct([("unit", pa.string()), ("n", pa.int64())]))
_TERMS = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
_KNOWN = pa.struct([("idx", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
_WEIGHTS = pa.struct([("idx", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64()))])

#: Elements that are summed at a time, and units whose terms are cut at a time.
_ELEMENTS, _UNITS = 1 << 19, 1 << 18
#: Characters up to which words are cut side by side.
_LONG = 64


def _pieces(sizes, elements=_ELEMENTS):
    """Places lo to hi of rows that have some ``elements`` together, or one row of more."""
    ends, lo = np.concatenate(([0], np.cumsum(sizes))), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + elements, side="right")) - 1)
        yield lo, hi
        lo = hi


def _sums(rows, codes, n, width):
    """Row, code and sum of ``n`` of each distinct (row, code), by both; and where each is first."""
    keys = rows * max(width, 1) + codes
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    totals = np.add.reduceat(n[order], starts) if len(starts) else n[:0]
    return keys[starts] // max(width, 1), keys[starts] % max(width, 1), totals, order[starts]


def _offsets(rows, n_rows):
    return pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n_rows)))), pa.int32())


def _sizes(lists):
    return np.diff(lists.offsets.to_numpy())


def _slices(lists, elements):
    """The batch in runs of rows of some ``elements``."""
    for lo, hi in _pieces(_sizes(lists), elements):
        yield lists.slice(lo, hi - lo)


def _joined(parts, dtype):
    """The arrays of a list as one, which is emptied on the way: a batch is not held twice."""
    found, at = np.empty(sum(map(len, parts)), dtype), 0
    parts.reverse()
    while parts:
        part = parts.pop()
        found[at:at + len(part)] = part
        at += len(part)
    return pa.array(found)


@arrow_udf(from_arrow_type(_COUNTED))
def counted(lists: pa.Array) -> pa.Array:
    """The distinct elements of each list and their counts, in order of first sight."""
    named, sizes = lists.flatten().dictionary_encode(), _sizes(lists)
    codes, done, at = named.indices.to_numpy().astype(np.int64), [], 0
    for lo, hi in _pieces(sizes):
        rows = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        rows, found, n, first = _sums(
            rows, codes[at:at + len(rows)], np.ones(len(rows), np.int64), len(named.dictionary))
        at += int(sizes[lo:hi].sum())
        order = np.argsort(first)
        units = pa.StructArray.from_arrays(
            [named.dictionary.take(pa.array(found[order])), pa.array(n[order])], fields=list(_COUNTED.value_type))
        done.append(pa.ListArray.from_arrays(_offsets(rows, hi - lo), units).cast(_COUNTED))
    return pa.concat_arrays(done) if done else pa.array([], _COUNTED)


def _cut(words, lengths):
    """Terms of each distinct word: their names, their numbers word by word, and how many a word has."""
    if not lengths:  # a word is its own term
        return words, np.arange(len(words)), np.ones(len(words), np.int64)
    cut = [[w[i:i + k] for k in lengths for i in range(len(w) - k + 1)] for w in words.to_pylist()]
    named = pa.array([t for terms in cut for t in terms], pa.string()).dictionary_encode()
    return named.dictionary, named.indices.to_numpy().astype(np.int64), np.array(list(map(len, cut)), np.int64)


def _places(words, lengths, vocabulary):
    """The places of each distinct word's terms that a vocabulary has, word by word, and how many a word has."""
    if not lengths:
        lengths, found = (), [(np.arange(len(words)), pc.index_in(words, value_set=vocabulary))]
    else:
        sizes = pc.utf8_length(words).to_numpy()
        order = np.argsort(sizes, kind="stable")
        sizes, ordered, found = sizes[order], words.take(pa.array(order)), []
        few = int(np.searchsorted(sizes, _LONG, side="right"))
        for start in range(int(sizes[few - 1]) if few else 0):
            for length in lengths:  # of all words that are long enough at a time
                first = int(np.searchsorted(sizes[:few], start + length))
                cut = pc.utf8_slice_codeunits(ordered.slice(first, few - first), start, start + length)
                found.append((order[first:few], pc.index_in(cut, value_set=vocabulary)))
        for word in order[few:]:
            names, codes, _ = _cut(words.slice(word, 1), lengths)
            found.append((np.full(len(codes), word), pc.index_in(names, value_set=vocabulary).take(pa.array(codes))))
    owners, places = [], []
    for owner, at in found:
        at = pc.fill_null(at, -1).to_numpy()
        owners.append(owner[at >= 0].astype(np.int32))
        places.append(at[at >= 0])
    owner, place = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (owners, places))
    return place[np.argsort(owner, kind="stable")].astype(np.int64), np.bincount(owner, minlength=len(words))


def _term_sums(units, lengths, vocabulary=None):
    """Per piece of rows: how many, and the rows, numbers and counts of their terms; and the names."""
    flat, sizes = units.flatten(), _sizes(units)
    words, n = flat.field("unit").dictionary_encode(), flat.field("n").to_numpy()
    if vocabulary is None:
        names, codes, each = _cut(words.dictionary, lengths)
        width = len(names)
    else:
        names, (codes, each) = vocabulary, _places(words.dictionary, lengths, vocabulary)
        width = len(vocabulary)
    word, starts = words.indices.to_numpy(), np.cumsum(each) - each
    inside, owner = each[word], np.repeat(np.arange(len(sizes)), sizes)
    ends = np.concatenate(([0], np.cumsum(sizes)))

    def sums():
        for lo, hi in _pieces(np.bincount(owner, inside, minlength=len(sizes)).astype(np.int64)):
            part = slice(ends[lo], ends[hi])
            many = inside[part]
            at = np.repeat(starts[word[part]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            yield hi - lo, *_sums(np.repeat(owner[part] - lo, many), codes[at], np.repeat(n[part], many), width)[:3]

    return names, sums()


def term_counter(lengths: Sequence[int] = ()):
    """Counted units to (term, tf): the units themselves, or their substrings of these lengths."""
    @arrow_udf(from_arrow_type(_TERMS))
    def terms(units: pa.Array) -> pa.Array:
        done = []
        for part in _slices(units, _UNITS):
            names, sums = _term_sums(part, lengths)
            done += [
                pa.ListArray.from_arrays(_offsets(rows, n), pa.StructArray.from_arrays(
                    [names.take(pa.array(codes)), pa.array(tf)], fields=list(_TERMS.value_type))).cast(_TERMS)
                for n, rows, codes, tf in sums]
        return pa.concat_arrays(done) if done else pa.array([], _TERMS)

    return terms


def known_counter(vocabulary, lengths: Sequence[int] = ()):
    """Counted units to the places in a vocabulary, ascending, and the counts of the terms that it has.

    ``vocabulary`` is a broadcast list of terms by place."""
    @arrow_udf(from_arrow_type(_KNOWN))
    def known(units: pa.Array) -> pa.Array:
        terms = pa.array(vocabulary.value, pa.string())
        sizes, found, counts = [np.zeros(1, np.int64)], [], []
        for part in _slices(units, _UNITS):
            _, sums = _term_sums(part, lengths, terms)
            for n, rows, places, tf in sums:
                sizes.append(np.bincount(rows, minlength=n))
                found.append(places.astype(np.int32))
                counts.append(tf.astype(np.int32) if tf.max(initial=0) < 1 << 31 else tf)
        offsets = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, _joined(found, np.int32)),
             pa.ListArray.from_arrays(offsets, _joined(counts, np.int64))], names=["idx", "tf"]).cast(_KNOWN)

    return known


def weigher(inverse):
    """Places and counts to places and weights (1 + ln tf) * idf, of unit length.

    ``inverse`` is a broadcast pair of arrays by place: the new place, below 0 for none, and the idf."""
    @arrow_udf(from_arrow_type(_WEIGHTS))
    def weights(counts: pa.Array) -> pa.Array:
        places, idf = inverse.value
        lists, uses, sizes = counts.field("idx"), counts.field("tf"), [np.zeros(1, np.int64)]
        n = int((places[lists.flatten().to_numpy()] >= 0).sum())
        found, weight, at = np.empty(n, np.int32), np.empty(n), 0
        for lo, hi in _pieces(_sizes(lists)):
            part = lists.slice(lo, hi - lo)
            rows, old = np.repeat(np.arange(hi - lo), _sizes(part)), part.flatten().to_numpy()
            tf = uses.slice(lo, hi - lo).flatten().to_numpy()
            kept = places[old] >= 0
            rows, old, tf = rows[kept], old[kept], tf[kept]
            raw = (1 + np.log(tf)) * idf[old]
            length = np.sqrt(np.bincount(rows, raw * raw, minlength=hi - lo))
            found[at:at + len(old)], weight[at:at + len(old)] = places[old], raw / length[rows]
            at += len(old)
            sizes.append(np.bincount(rows, minlength=hi - lo))
        offsets = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(found)),
             pa.ListArray.from_arrays(offsets, pa.array(weight))], names=["idx", "weight"]).cast(_WEIGHTS)

    return weights
