"""Monotone sequences by Elias and Fano, and a bigram trie on them, in a memory-mapped file.

A sequence of n values below u keeps the low bits of each as they are, in whole bytes, and the high
bits in unary: a one per value, a zero per step of the high part. A directory of the ones before
each 64-bit word finds the k-th one or zero. All look-ups are done for many places at once.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .tables import ship


class Sequence:
    """A non-decreasing sequence of unsigned 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        top = int(values[-1]) if n else 0
        wanted = max(0, (top // max(n, 1)).bit_length() - 1)
        self.low_bytes = min(7, -(-wanted // 8)) if wanted else 0
        self.shift = np.uint64(8 * self.low_bytes)
        self.n = n
        self.low = np.ascontiguousarray(
            values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :self.low_bytes]) if n else np.zeros((0, 0), np.uint8)
        high = (values >> self.shift).astype(np.int64)
        size = (int(high[-1]) if n else 0) + n + 1
        bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        self.high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.top = int(high[-1]) if n else -1

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones}

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th (from 0) one or zero."""
        before = self.ones if one else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, k, side="right") - 1
        rest = k - before[word]
        out = np.empty(len(k), dtype=np.int64)
        for a in range(0, len(k), 1 << 14):  # 64 bytes for each
            part = slice(a, a + (1 << 14))
            bits = np.unpackbits(self.high[word[part]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            seen = np.cumsum(bits if one else 1 - bits, axis=1, dtype=np.uint8)
            out[part] = word[part] * 64 + (seen <= rest[part, None]).sum(axis=1)
        return out

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(self.low_bytes):
            out |= self.low[at, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at, True) - at).astype(np.uint64)
        return high << self.shift | self._low(at)

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in [begin, end) whose value is x or more; ``end`` if there is none.

        The high part bounds the places by two zeros; within these, halving on the low bytes.
        """
        high = (x >> self.shift).astype(np.int64)
        inside = high <= self.top
        high = np.minimum(high, max(self.top, 0))
        from_ = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        to = np.minimum(self._select(high, False) - high, self.n)
        a = np.where(inside, np.maximum(from_, begin), end)
        b = np.where(inside, np.clip(to, a, end), end)
        low = x & ((np.uint64(1) << self.shift) - np.uint64(1))
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return np.minimum(a, end)
            middle = (a[open_] + b[open_]) // 2
            below = self._low(middle) < low[open_]
            a[open_[below]] = middle[below] + 1
            b[open_[~below]] = middle[~below]


#: Probabilities are kept as one byte: steps of log10 from 0 down.
STEP = 14.0 / 255


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 255).astype(np.uint8)


def restored(codes: np.ndarray) -> np.ndarray:
    """The probabilities of the codes."""
    return 10.0 ** (-STEP * codes.astype(np.float64))


class Trie:
    """Contexts, each with its sorted successors and their discounted shares.

    Level 1: the contexts' 64-bit hashes, the byte of the backed-off share, and monotone pointers to
    level 2. Level 2: the successors' 32-bit marks, relative to their context by its number in the
    upper half, and a byte of the share each. The levels lie in a file without a name that is mapped
    into memory and gone when the trie is.
    """

    def __init__(self, contexts: np.ndarray, context_of: np.ndarray, marks: np.ndarray, counts: np.ndarray,
                 discount: float):
        """Pairs sorted by (context, mark) with counts above 0; contexts sorted, each with a pair."""
        total = np.bincount(context_of, weights=counts, minlength=len(contexts))
        kinds = np.bincount(context_of, minlength=len(contexts))
        self.pointers = Sequence(np.concatenate([[0], np.cumsum(kinds)]).astype(np.uint64))
        self.successors = Sequence(context_of.astype(np.uint64) << np.uint64(32) | marks.astype(np.uint64))
        shares = quantised(np.log10((counts - discount) / total[context_of])) if len(counts) else np.zeros(0, np.uint8)
        backed = quantised(np.log10(discount * kinds / total)) if len(contexts) else np.zeros(0, np.uint8)
        self._map({"contexts": contexts, "shares": shares, "backed": backed})

    def _map(self, own: dict[str, np.ndarray]) -> None:
        parts = [(self, k, v) for k, v in own.items()]
        parts += [(s, k, v) for s in (self.pointers, self.successors) for k, v in s.arrays().items()]
        with tempfile.TemporaryFile() as file:
            places = []
            for _, _, array in parts:
                file.write(b"\0" * (-file.tell() % 8))
                places.append(file.tell())
                file.write(np.ascontiguousarray(array).tobytes())
            file.write(b"\0" * 8)
            file.flush()
            whole = np.memmap(file, dtype=np.uint8, mode="r")
        for (owner, name, array), at in zip(parts, places):
            view = whole[at:at + array.nbytes].view(array.dtype).reshape(array.shape)
            setattr(owner, name, view)

    def look_up(self, contexts: np.ndarray, context_of: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
        """For pairs of the given contexts: found and share of each pair; known and backed of each context."""
        n = len(self.contexts)
        none = np.zeros(len(contexts), dtype=bool)
        if not n or not len(contexts):
            return np.zeros(len(marks), dtype=bool), np.zeros(len(marks), np.uint8), none, none.astype(np.uint8)
        number = np.minimum(np.searchsorted(self.contexts, contexts), n - 1)
        known = self.contexts[number] == contexts
        begin, end = self.pointers.get(number).astype(np.int64), self.pointers.get(number + 1).astype(np.int64)
        end = np.where(known, end, begin)
        x = number[context_of].astype(np.uint64) << np.uint64(32) | marks.astype(np.uint64)
        at = self.successors.successor(x, begin[context_of], end[context_of])
        inside = np.flatnonzero(at < end[context_of])
        found = np.zeros(len(marks), dtype=bool)
        found[inside] = self.successors.get(at[inside]) == x[inside]
        shares = np.zeros(len(marks), np.uint8)
        shares[found] = self.shares[at[found]]
        return found, shares, known, np.where(known, self.backed[number], 0).astype(np.uint8)


ship(__name__)
