import random
import re

import numpy as np
import pytest

from defectlens.llm import decontamination as D
from defectlens.llm.queries import registered


def plain_score(item, text):
    """Smith-Waterman by its recurrence."""
    best, row = 0, [0] * (len(item) + 1)
    for word in text:
        last, row = row, [0]
        for j, own in enumerate(item):
            row.append(max(0, last[j] + (2 if own == word else -1), last[j + 1] - 1, row[j] - 1))
        best = max(best, *row)
    return best


def test_alignment_against_the_recurrence():
    draw = random.Random(3)
    for _ in range(300):
        item = np.array([draw.randrange(6) for _ in range(draw.randrange(1, 12))], dtype=np.uint64)
        text = np.array([draw.randrange(6) for _ in range(draw.randrange(0, 20))], dtype=np.uint64)
        score, matched, start, end = D.align(item, text)
        assert score == plain_score(item.tolist(), text.tolist())
        assert score <= 2 * matched and 0 <= start <= end <= len(text)
        # The stated part of the text gives the score by itself.
        assert plain_score(item.tolist(), text[start:end].tolist()) == score


def sentence(draw, n, size=400):
    return [f"w{draw.randrange(size)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(7)
    items = [sentence(draw, n) for n in (12, 20, 40, 60)]
    rows, want = [], set()

    def add(words, leaks=()):
        rows.append((len(rows), " ".join(words), "other"))
        want.update((len(rows) - 1, k) for k in leaks)

    for _ in range(40):
        add(sentence(draw, draw.randrange(0, 200)))
    for k, item in enumerate(items):
        add(sentence(draw, 50) + item + sentence(draw, 30), [k])
        add([w.upper() + "," for w in item], [k])
        edited = [w if draw.random() > 0.1 else "changed" for w in item if draw.random() > 0.05]
        add(sentence(draw, 20) + edited + sentence(draw, 20), [k] if k else [])  # of 12 words too few stay
        add(item[:len(item) // 5])
    add(items[0] + sentence(draw, 10) + items[2] + items[0], [0, 2])
    add(items[3][5:30] + sentence(draw, 20), [3])  # a long part
    add(sentence(draw, 40_000) + items[1] + sentence(draw, 100), [1])
    rows += [(900, None, "x"), (901, "", "x"), (902, "...", "x"), (None, " ".join(items[0]), "x")]
    rows += [(910, " ".join(items[0]), "x")] * 3
    want |= {(None, 0), (910, 0)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(
        [(k, " ".join(w)) for k, w in enumerate(items)] + [(7, None), (8, ""), (9, "of the")],
        "item_id long, text string")
    return docs, bench, want, rows, items


def test_planted_cases(tables):
    docs, bench, want, _, _ = tables
    got = [(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()]
    assert set(got) == want
    assert got.count((910, 0)) == 3


def test_scores_against_all_pairs(tables):
    docs, bench, _, rows, items = tables
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.find_leaks(docs, bench).collect()}
    for doc_id, text, _ in rows:
        words = re.findall("[a-z0-9]+", (text or "").lower())
        if len(words) > 1000:
            continue
        for k, item in enumerate(items):
            score = plain_score(item, words) / (2 * len(item))
            if score >= D.MIN_SCORE:
                assert got[doc_id, k] == pytest.approx(score)


@pytest.fixture(scope="module")
def hot(spark):
    """One item of twelve words, a third of all documents with a copy that has one or two words changed."""
    draw = random.Random(11)
    item = sentence(draw, 12)
    rows, want = [], {}
    for d in range(300):
        words = sentence(draw, 8)
        if d % 3 == 0:
            copy = list(item)
            for k in range(1 + d % 2):
                copy[(d // 3 + 5 * k) % 12] = f"new{d}"
            words = words[:4] + copy + words[4:]
        rows.append((d, " ".join(words)))
        score = plain_score(item, words) / 24
        if score >= D.MIN_SCORE:
            want[d] = score
    assert set(want) >= set(range(0, 300, 3))
    return (spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
            spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"), want)


def test_edited_copies_in_a_third_of_all_documents(hot):
    docs, bench, want = hot
    got = {r["doc_id"]: r["score"] for r in D.find_leaks(docs, bench).collect()}
    assert got == pytest.approx(want)


def test_pairs_in_shares_give_the_same(hot, tables, monkeypatch):
    monkeypatch.setattr(D, "PAIRS", 3)
    docs, bench, want = hot
    assert {r["doc_id"]: r["score"] for r in D.find_leaks(docs, bench).collect()} == pytest.approx(want)
    docs, bench, want, _, _ = tables
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()} == want


def test_texts_without_a_seed(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "a b c d e f")], "item_id long, text string")
    assert D.find_leaks(docs.repartition(1), bench).count() == 0


def test_only_parts_that_cannot_count_are_left_out():
    draw, measure = random.Random(5), D.Measure(D.MIN_SCORE, 6)
    left_out = 0
    for _ in range(2000):
        item = np.array([draw.randrange(12) for _ in range(draw.randrange(5, 16))], dtype=np.uint64)
        region = np.array([draw.randrange(20) for _ in range(draw.randrange(3, 30))], dtype=np.uint64)
        score, matched, start, end = D.align(item, region)
        part = measure.part(*np.unique(item, return_counts=True), region)
        if part is None:
            left_out += 1
            assert not measure.counts(len(item), score, matched)
        else:
            assert score == D.align(item, region[part[0]:part[1]])[0]
    assert left_out > 200


def test_blocks_give_the_same(tables, monkeypatch):
    docs, bench, want, _, _ = tables
    monkeypatch.setattr(D, "BLOCK_WORDS", 150)
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()} == want


def test_empty_tables(tables):
    docs, bench, *_ = tables
    assert D.find_leaks(docs.limit(0), bench).count() == 0
    assert D.find_leaks(docs, bench.limit(0)).count() == 0


def test_query_finds_whole_copies(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = {r["item_id"]: flat(r["text"]) for r in read("benchmark")}
    want = {(r["doc_id"], k) for r in read("documents") for k, t in items.items() if t in flat(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in registered()["op2_benchmark_leaks"](spark, sf_dir).collect()}
    assert want and want <= got


def test_whole_table_against_all_pairs(spark, sf_dir):
    """Every pair of document and item that aligns well enough is found, and no other."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    cut = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower())
    items = {r["item_id"]: cut(r["text"]) for r in read("benchmark")}
    items = {k: w for k, w in items.items() if len(w) >= D.MIN_WORDS}
    number = {w: i for i, w in enumerate({w for words in items.values() for w in words})}
    wide = max(map(len, items.values()))
    grid = np.array([[number[w] for w in words] + [-2] * (wide - len(words)) for words in items.values()])
    steps, sizes = np.arange(wide + 1), np.array([len(w) for w in items.values()])
    want, possible = set(), set()
    for r in read("documents"):
        score, best = np.zeros((len(items), wide + 1), int), np.zeros(len(items), int)
        for word in cut(r["text"]):
            new = np.zeros_like(score)
            same = grid == number.get(word, -1)
            new[:, 1:] = np.maximum(np.maximum(score[:, :-1] + np.where(same, 2, -1), score[:, 1:] - 1), 0)
            score = np.maximum.accumulate(new + steps, axis=1) - steps
            best = np.maximum(best, score.max(axis=1))
        for k, whole, long_part in zip(items, best >= D.MIN_SCORE * 2 * sizes, best >= 1.6 * D.LONG_PART):
            want |= {(r["doc_id"], k)} if whole else set()
            possible |= {(r["doc_id"], k)} if whole or long_part else set()
    got = {(r["doc_id"], r["item_id"]) for r in registered()["op2_benchmark_leaks"](spark, sf_dir).collect()}
    assert want and want <= got <= possible


def test_a_common_seed_needs_company(spark):
    """A turn of phrase of several items opens no alignment by itself; a rare seed does."""
    doc = np.zeros(3, int), np.array([0, 0, 1]), np.array([0, 50, 4]), np.array([9, 60, 20])
    for rare, want in (([0, 0, 0], []), ([0, 1, 0], [(0, 50)]), ([0, 0, 1], [(1, 4)])):
        _, item, start, _ = D._regions(*doc, np.array(rare, bool), 100)
        assert list(zip(item.tolist(), start.tolist())) == want
    _, item, start, end = D._regions(np.zeros(2, int), np.zeros(2, int), np.array([3, 8]), np.array([9, 20]), np.zeros(2, bool), 100)
    assert (item.tolist(), start.tolist(), end.tolist()) == ([0], [3], [20])
