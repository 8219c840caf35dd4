import random
import re

import numpy as np
import pytest

from defectlens.llm import substrings as S


def plain(rows, window):
    """Kept words of each row, by every window of every text."""
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    ids = [(1 << 63) - 1 if i is None else i for i, _ in cut]
    least = {}
    for i, (_, words) in zip(ids, cut):
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, (doc_id, words) in zip(ids, cut):
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((doc_id, len(words), " ".join(w for k, w in enumerate(words) if k not in gone), len(gone)))
    return out


def texts(seed, vocabulary, n):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(vocabulary)}é"
    passages = [[word() for _ in range(draw.randrange(5, 40))] for _ in range(4)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randrange(0, 5)):
            words += draw.choice(passages) if draw.random() < 0.6 else [word() for _ in range(draw.randrange(1, 25))]
        if words and draw.random() < 0.3:
            words[draw.randrange(len(words))] = word()
        rows.append((draw.randrange(3 * n) if seed % 2 else i, draw.choice([" ", "\n", "\t "]).join(words)))
    rows += [rows[3], (10**6, rows[4][1]), (10**6 + 1, "x " * 300), (10**6 + 2, "x " * 200), (10**6 + 3, "x y " * 100)]
    return rows


@pytest.mark.parametrize("seed, vocabulary, window, gram", [(0, 1000, 10, 4), (1, 3, 12, 5), (2, 2, 8, 3), (3, 50, 6, 6)])
def test_against_every_window(spark, seed, vocabulary, window, gram):
    rows = texts(seed, vocabulary, 120)
    docs = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, runs binary").repartition(5)
    got = sorted((r["doc_id"], r["n_words"], r["kept_text"], sum_of(r["spans"]))
                 for r in S.dedup_passages(docs, window, gram).collect())
    assert got == sorted(plain(rows, window))


def sum_of(spans):
    return len({k for s in spans for k in range(s["start"], s["end"])})


def test_odd_rows(spark):
    body = " ".join(f"v{k}" for k in range(70))
    rows = [(1, None), (2, ""), (3, " \n"), (None, body), (None, body + " end"), (4, body), (5, f"a {body} b"),
            (9, " ".join(f"u{k}" for k in range(60_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["kept_text"], [tuple(s) for s in r["spans"]])
           for r in S.dedup_passages(docs).collect()}
    assert got.pop((9, 60_000))[1] == []
    assert got == {
        (1, 0): ("", []), (2, 0): ("", []), (3, 0): ("", []), (4, 70): (body, []),
        (5, 72): ("a b", [(1, 71)]), (None, 70): ("", [(0, 70)]), (None, 71): ("end", [(0, 70)])}
    assert S.dedup_passages(docs.limit(0)).count() == 0


def test_least_places():
    draw = np.random.default_rng(0)
    for width in (1, 2, 3, 7, 8, 35):
        values = draw.integers(0, 20, 200).astype(np.uint64)
        want = [k + int(np.argmin(values[k:k + width])) for k in range(200 - width + 1)]
        assert S._least_places(values, width).tolist() == want
