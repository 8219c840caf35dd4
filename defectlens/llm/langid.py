"""Language identification by cross-parsing against labelled text.

For each language a bounded amount of labelled text is joined into a reference, and a suffix
automaton of it is built. A text is parsed greedily against a reference: a phrase is the longest
match that starts where the last one ended, found by following the automaton until it has no
transition. Text of the same language needs fewer, longer phrases. The number of phrases times the
bits of a position in the reference, per character, is the cross entropy that is compared, so that
references of different lengths count alike; the smallest wins, the first name on a tie.

Letters are compared in lower case, any run of other characters is one space, and letters that no
reference has are one more symbol. Texts are read whole; they are parsed in pieces of ``PIECE``
symbols, each beginning a new phrase, so that many pieces move through the automaton in step.

A null text, or one without a letter, is ``und`` with score 0. If nothing can be learned all are.
Equal rows get equal results; an empty table gives none. Only doc_id and text are read to predict;
doc_id, text and lang to learn.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .tables import ship, worker_state
from .words import chunks

UNKNOWN = "und"
PIECE = 256
#: Labelled text per language: this many excerpts of this many characters, by hash order.
EXCERPTS, EXCERPT_CHARS = 64, 400
#: Symbols 0 to 2 are the space, a letter of no reference, and the filler after a piece's end.
_SPACE, _OTHER, _FILL, _LETTERS = 0, 1, 2, 3
CHUNK = 2 << 20


def learn(labelled: DataFrame, excerpts: int = EXCERPTS, chars: int = EXCERPT_CHARS) -> dict[str, str]:
    """The reference of each language from (doc_id, text, lang) rows.

    The sample is bounded by ``excerpts * chars`` characters per language: rows are thinned by a
    hash of their id to some four times ``excerpts`` before they are ranked, so that no task ranks
    all rows of a frequent language, and the smallest hashes are taken. The driver gets a count
    and a reference per language.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    order = F.xxhash64("doc_id", F.lit("excerpt"))
    share = F.pmod(order, F.lit(1 << 40)) / float(1 << 40)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()
    if not counts:
        return {}
    of = F.create_map(*[F.lit(x) for row in counts for x in row])
    thin = rows.where(share * of[F.col("lang")] < 4 * excerpts + 64)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(share, "doc_id", "text"))
    taken = thin.withColumn("rank", rank).where(F.col("rank") <= excerpts).select(
        "lang", "rank", F.substring("text", 1, chars).alias("text"))
    out: dict[str, str] = {}
    for row in sorted(taken.collect(), key=lambda r: (r["lang"], r["rank"])):
        out[row["lang"]] = out.get(row["lang"], "") + row["text"] + "\n"
    return out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the automaton of all factors; state 0 is the empty one."""
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in after[p]:
            after[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = after[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(after)
                after.append(after[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(symbol) == q:
                    after[p][symbol] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return after


class Parser:
    """The automata of all references as tables: next state and phrases begun anew."""

    def __init__(self, references: dict[str, str]):
        self.names = sorted(references)
        letters = sorted({c for text in references.values() for c in text.lower() if c.isalpha()})
        self.symbol = np.zeros(0x110000, dtype=np.uint8 if len(letters) < 250 else np.uint16)
        for point in range(0x110000):
            if chr(point).isalpha():
                self.symbol[point] = _OTHER
        for i, c in enumerate(letters):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    self.symbol[ord(form)] = _LETTERS + i
        self.width = _LETTERS + len(letters)
        self.tables, self.bits = [], []
        for name in self.names:
            symbols = self.symbols(references[name])[0].tolist()
            self.tables.append(self._table(suffix_automaton(symbols)))
            self.bits.append(math.log2(max(len(symbols), 2)))

    def _table(self, after: list[dict[int, int]]) -> np.ndarray:
        """Entry state * width + symbol is next state * 4 + phrases that end or stand alone."""
        table = np.full((len(after), self.width), -1, dtype=np.int64)
        for state, arcs in enumerate(after):
            for symbol, target in arcs.items():
                table[state, symbol] = target
        root = table[0].copy()
        restart = np.where(root >= 0, root * 4, 1)  # the symbol opens a phrase, or is one
        missing = table < 0
        out = np.where(missing, restart[None, :] + 1, table * 4)
        out[0] = restart
        out[:, _FILL] = np.arange(len(after)) * 4
        return out.astype(np.int32).ravel()

    def symbols(self, *texts: str) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the texts one after the other, and where each text begins."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.symbol[points]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        first = np.zeros(len(symbols) + 1, dtype=bool)
        first[starts] = True
        keep = symbols != _SPACE
        keep[1:] |= (symbols[:-1] != _SPACE)
        keep |= first[:-1]
        kept = np.concatenate([[0], np.cumsum(keep)])
        return symbols[keep], kept[starts]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol by text and language, and which texts have a letter."""
        symbols, starts = self.symbols(*texts)
        lengths = np.diff(starts)
        pieces = -(-lengths // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[owner] + nth * PIECE
        size = np.minimum(PIECE, starts[owner + 1] - begin)
        order = np.argsort(-size, kind="stable")  # a step then moves a shrinking head of them
        begin, size, owner = begin[order], size[order], owner[order]
        moving = np.searchsorted(-size, -np.arange(1, PIECE + 1), side="right")
        phrases = np.zeros((len(self.names), len(owner)), dtype=np.int32)
        for k, table in enumerate(self.tables):
            state = np.zeros(len(owner), dtype=np.int32)
            count = phrases[k]
            for step in range(PIECE):
                n = moving[step]
                if not n:
                    break
                index = state[:n] * np.int32(self.width)
                index += symbols[begin[:n] + step]
                to = table[index]
                count[:n] += to & 3
                state[:n] = to >> 2
            count += state > 0
        out = np.zeros((len(texts), len(self.names)))
        for k, bits in enumerate(self.bits):
            out[:, k] = np.bincount(owner, weights=phrases[k], minlength=len(texts)) * bits
        lettered = np.concatenate([[0], np.cumsum(symbols != _SPACE)])
        return out / np.maximum(lengths, 1)[:, None], lettered[starts[1:]] > lettered[starts[:-1]]


RESULT = "doc_id long, lang_pred string, score double, bits double"


def identify(docs: DataFrame, references: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score (how far the runner-up is behind, 0 to 1) and bits per symbol.

    One pass without a shuffle; what is sent to the executors is the bounded references.
    """
    box, key = docs.sparkSession.sparkContext.broadcast(references), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = worker_state("langid", key, lambda: Parser(box.value))
        for batch in batches:
            for part in chunks(batch, size=CHUNK):
                texts = [t or "" for t in part.column("text").to_pylist()]
                names, scores, bits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if parser.names:
                    entropy, lettered = parser.entropies(texts)
                    best = entropy.argmin(axis=1)
                    least = entropy.min(axis=1)
                    behind = np.partition(entropy, 1, axis=1)[:, 1] if len(parser.names) > 1 else np.inf
                    scores = np.where(lettered, 1 - least / np.maximum(behind, 1e-300), 0.0)
                    bits = np.where(lettered, least, 0.0)
                    names = [parser.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()),
                     pa.array(np.clip(scores, 0, 1), pa.float64()), pa.array(bits, pa.float64())],
                    names=["doc_id", "lang_pred", "score", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


ship(__name__)
