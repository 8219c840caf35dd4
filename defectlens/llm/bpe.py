"""Byte-pair encoding by an automaton over tokens, and decoding by its arc labels.

The automaton reads tokens. It begins with one state and an arc for every single-byte token; each
merge, in order of rank, adds its gadget: the state reached by the left half loses its arc for the
right half, the merged token gets a state that copies the right half's, and every state with an
arc for the left half gets one for the merged token. What it accepts in the end are exactly the
correct tokenisations: there is one for each byte string, and whether a token may follow another
depends on those two alone. A state therefore is the last token, and its arcs are a row of a table
of token pairs. The table of all pairs would have the vocabulary's square as its size, so the
gadgets are kept as they were applied (``left``, ``right``, ``born``, ``lost``) and an arc is worked
out when first asked for, then read from the table.

A word is encoded by following arcs from the start, the longest vocabulary token that the next bytes
spell first, a shorter one if the table has no arc or its way ends. A prefix has one tokenisation,
so a place that was left is never tried again: the work is linear in the word for a bounded
token length, and nothing depends on a merge queue.

Texts are cut into words by the byte-level pattern of the vocabulary, special strings first. A
null text has no tokens and decodes to an empty text. Equal rows are encoded alike; other columns
are not read. Words are encoded once per worker while they fit into a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tables import ship, worker_state
from .words import chunks

#: Fixed value: the word pattern of byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 500_000
CACHE_WORD_CHARS = 64
PAIR_CACHE = 2_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return letters


def plane_pattern() -> re.Pattern:
    """The word pattern for texts of the basic plane, its classes spelled out: the standard library
    looks up a class of such characters in one step. They are taken from the same engine as the
    general pattern, so that both cut alike."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def spelled(name: str) -> str:
        runs = (m.span() for m in regex.finditer(f"{name}+", plane))
        return "".join(f"\\u{ord(plane[a]):04x}-\\u{ord(plane[b - 1]):04x}" for a, b in runs)

    classes = {name: spelled(f"\\{name}") for name in ("p{L}", "p{N}", "s")}
    pattern = WORD_PATTERN.replace("[^\\s\\p{L}\\p{N}]", "[^" + "".join(classes.values()) + "]")
    pattern = pattern.replace("\\S", f"[^{classes['s']}]")
    for name, members in classes.items():
        pattern = pattern.replace(f"\\{name}", f"[{members}]")
    return re.compile(pattern)


_BEYOND_PLANE = re.compile("[\U00010000-\U0010ffff]")


class Words(dict):
    """Token ids, four bytes each, of words met before; a new word is encoded and kept if it is
    short and there is room, for which all others are let go."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word.encode()), dtype="<u4").tobytes()
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """Labels and merges, small enough to send to every executor: bounded by the file's size."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int]):
        letters = byte_letters()
        plain = {t: i for t, i in tokens.items() if t not in specials}
        self.labels = {i: bytes(letters[c] for c in t) for t, i in plain.items()}
        self.special = dict(specials)
        self.labels |= {i: t.encode() for t, i in specials.items()}
        self.merges = [(plain[a], plain[b], plain[a + b]) for a, b in merges]
        self.single = [plain[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level file of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return Vocabulary(spec["model"]["vocab"], pairs, specials)


class Automaton:
    def __init__(self, vocabulary: Vocabulary):
        self.labels = vocabulary.labels
        self.special = vocabulary.special
        size = max(self.labels) + 1
        self.left, self.right = [-1] * size, [-1] * size
        self.born = [0] * size
        self.lost: dict[tuple[int, int], int] = {}
        for step, (a, b, ab) in enumerate(vocabulary.merges, 1):
            self._add_gadget(step, a, b, ab)
        self.arcs: dict[int, bool] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, label in self.labels.items():
            if token not in self.special.values() and self._reachable(token):
                self._spell(label, token)
        names = sorted(self.special, key=len, reverse=True)
        self.words, self.plane_words = regex.compile(WORD_PATTERN), plane_pattern()
        self.label_of = [self.labels.get(i, b"") for i in range(size)]
        self.marks = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.known = Words(self._word)

    def _add_gadget(self, step: int, a: int, b: int, ab: int) -> None:
        self.lost.setdefault((a, b), step)
        if not self.born[ab] and self.left[ab] < 0:
            self.left[ab], self.right[ab], self.born[ab] = a, b, step

    def _reachable(self, token: int) -> bool:
        """Is the token the tokenisation of its own label? Its halves must have had an arc."""
        return self.left[token] < 0 or self._had_arc(self.left[token], self.right[token], self.born[token] - 1)

    def _had_arc(self, s: int, t: int, step: int) -> bool:
        """Was there an arc from the state of s for t after this many gadgets?"""
        while True:
            if self.lost.get((s, t), step + 1) <= step:
                return False
            if self.born[s] == 0 and self.born[t] == 0:
                return True
            if self.born[t] > self.born[s]:  # t came last: wherever its left half had an arc
                if self.left[t] == self.right[t] == s:  # of three halves, the first two merge
                    return False
                step, t = self.born[t] - 1, self.left[t]
            elif self.born[s] > self.born[t]:  # s came last: a copy of its right half's state
                step, s = self.born[s] - 1, self.right[s]
            else:  # one token after itself: at its gadget the copy got what its left half allows
                step, s, t = self.born[s] - 1, self.right[s], self.left[t]

    def follows(self, s: int, t: int) -> bool:
        key = s << 32 | t
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= PAIR_CACHE:
                self.arcs.clear()
            found = self.arcs[key] = self._had_arc(s, t, 1 << 60)
        return found

    def _spell(self, label: bytes, token: int) -> None:
        node = 0
        for byte in label:
            after = self.trie[node].get(byte)
            if after is None:
                after = self.trie[node][byte] = len(self.trie)
                self.trie.append({})
                self.token_at.append(-1)
            node = after
        self.token_at[node] = token

    def _spelled(self, data: bytes, start: int) -> list[tuple[int, int]]:
        """End and token of each vocabulary token that the bytes from ``start`` on spell."""
        trie, token_at, found, node = self.trie, self.token_at, [], 0
        for end in range(start, len(data)):
            node = trie[node].get(data[end])
            if node is None:
                break
            if token_at[node] >= 0:
                found.append((end + 1, token_at[node]))
        return found

    def _word(self, data: bytes) -> list[int]:
        arcs, follows, n = self.arcs, self.follows, len(data)
        tokens, ends, dead, state = [], [0], set(), -1
        open_ = [self._spelled(data, 0)]
        while True:
            options = open_[-1]
            while options:
                end, token = options.pop()
                if end in dead:
                    continue
                allowed = state < 0 or arcs.get(state << 32 | token)
                if allowed is None:
                    allowed = follows(state, token)
                if allowed:
                    break
            else:  # no way on: this place is not on the path
                dead.add(ends.pop())
                open_.pop()
                tokens.pop()
                state = tokens[-1] if tokens else -1
                continue
            tokens.append(token)
            if end == n:
                return tokens
            ends.append(end)
            open_.append(self._spelled(data, end))
            state = token

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts, start = [], 0
        if self.marks is not None:
            for mark in self.marks.finditer(text):
                parts.append(self._plain(text[start:mark.start()]))
                parts.append(np.array([self.special[mark[0]]], dtype="<u4").tobytes())
                start = mark.end()
        parts.append(self._plain(text[start:] if start else text))
        return b"".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def _plain(self, text: str) -> bytes:
        words = self.words if _BEYOND_PLANE.search(text) else self.plane_words
        return b"".join(map(self.known.__getitem__, words.findall(text)))

    def decode(self, ids) -> str:
        """The labels of the arcs, in order; bytes that are not UTF-8 become the replacement sign."""
        return b"".join(map(self.label_of.__getitem__, ids)).decode("utf-8", errors="replace")


def _automaton(key: str, vocabulary: Vocabulary) -> Automaton:
    """Built once per worker process, with the words it has seen."""
    return worker_state("bpe", key, lambda: Automaton(vocabulary))


RESULT = "doc_id long, n_tokens long, ids binary, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256 of each row.

    One pass without a shuffle: an Arrow batch is encoded, decoded from the ids and dropped.
    """
    vocabulary = load_vocabulary(vocabulary_path)
    box, key = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, box.value)
        for batch in batches:
            for part in chunks(batch):
                counts, ids, digests = [], [], []
                for text in part.column("text").to_pylist():
                    coded = automaton.encode_bytes(text)
                    counts.append(len(coded) // 4)
                    ids.append(coded)
                    decoded = automaton.decode(np.frombuffer(coded, dtype="<u4").tolist())
                    digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(digests, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def decode_documents(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and the text that ``ids`` spell; null ids give an empty text."""
    vocabulary = load_vocabulary(vocabulary_path)
    box, key = encoded.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, box.value)
        for batch in batches:
            texts = [automaton.decode(np.frombuffer(x or b"", dtype="<u4").tolist())
                     for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


ship(__name__)
