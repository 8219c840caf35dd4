import collections
import math
import re
import zlib

import numpy as np
import pytest

from defectlens.llm import eliasfano as E, lm
from defectlens.llm.queries import registered


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "</s>"]


def plain(rows, discount=lm.DISCOUNT):
    """(doc_id, n_tokens, n_known, train_tokens, base, score) by dictionaries, with the same quantisation."""
    words, pairs = collections.Counter(), collections.Counter()
    for doc_id, text, learn in rows:
        if learn and doc_id is not None:
            own = tokens(text)
            words.update(own)
            pairs.update(zip(["<s>", *own], own))
    total, kinds, contexts = sum(words.values()), collections.Counter(), collections.Counter()
    for (c, _), n in pairs.items():
        kinds[c] += 1
        contexts[c] += n

    def code(p):
        return float(E.restored(E.quantised(np.array([math.log10(p)])))[0])

    out = []
    for doc_id, text, _ in rows:
        own, base, score = tokens(text), 0.0, 0.0
        for c, w in zip(["<s>", *own], own):
            p = (words[w] + 0.5) / (total + 0.5 * (len(words) + 1))
            base += math.log10(p)
            if contexts[c]:
                n = pairs[c, w]
                p = (code((n - discount) / contexts[c]) if n else 0) + code(discount * kinds[c] / contexts[c]) * p
            score += math.log10(p)
        out.append((doc_id, len(own), sum(words[w] > 0 for w in own), total, base, score))
    return out


def compare(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


COLUMNS = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_against_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4000)
    draw = np.random.default_rng(5)
    vocabulary = [f"W{k}" if k % 3 else f"w{k}é" for k in range(300)]
    rows = [(i, " ".join(vocabulary[k] for k in np.minimum(draw.zipf(1.4, draw.integers(0, 60)), 299)), bool(i % 4))
            for i in range(400)]
    rows += [(500, None, True), (501, "", False), (None, "w3 w3 w3", True), (502, "never seen here", False),
             (503, "the pair " * 500, True), (503, "the pair " * 500, True), (504, "x " * 20_000, False), (505, "a", None)]
    docs = spark.createDataFrame([(*r, b"") for r in rows], "doc_id long, text string, learn boolean, words binary")
    compare(lm.score_documents(docs.repartition(4)).select(COLUMNS).collect(), plain(rows))


def test_nothing_learned_and_no_rows(spark):
    rows = [(1, "a b", False), (2, None, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    compare(lm.score_documents(docs).select(COLUMNS).collect(), plain(rows))
    assert lm.score_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (1, 1 << 50), (100, 100), (1000, 1 << 40), (5000, 300), (3000, 1 << 62)])
def test_sequences(n, top):
    draw = np.random.default_rng(n)
    values = np.sort(draw.integers(0, top, n).astype(np.uint64))
    sequence = E.Sequence(values)
    assert (sequence.get(np.arange(n)) == values).all()
    if n:
        x = np.concatenate([values, draw.integers(0, top, 500).astype(np.uint64), np.array([0, top], np.uint64)])
        begin = draw.integers(0, n, len(x))
        end = np.minimum(n, begin + draw.integers(0, n, len(x)))
        want = [min(max(int(np.searchsorted(values, y)), b), e) for y, b, e in zip(x, begin, end)]
        assert sequence.successor(x, begin, end).tolist() == want


def test_query(spark, sf_dir):
    rows = [(r[0], r[1], zlib.crc32(str(r[0]).encode()) % 5 != 1)
            for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = registered()["op8_lm_scores"](spark, sf_dir).collect()
    compare([[r[c] for c in COLUMNS] for r in got], plain(rows))
    learned = {i: x for i, _, x in rows}
    assert all(r["held_out"] != learned[r["doc_id"]] for r in got)
    held = [(r["score"], r["base_score"]) for r in got if r["held_out"]]
    assert sum(s for s, _ in held) > sum(b for _, b in held)  # context helps on texts not learned from
