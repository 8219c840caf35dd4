import itertools
import random
import re

import numpy as np
import pytest

from defectlens.llm import graph, neardup as N
from defectlens.llm.queries import registered


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def plain_groups(texts):
    """doc_id -> smallest doc_id reachable, all pairs compared through shared shingles."""
    sets = {d: shingles(t) for d, t in texts.items()}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def check(got, texts):
    want = plain_groups(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    word = lambda: f"w{draw.randrange(3000)}"
    out = [None, "", " \n ", "One", "one", "a b c", "A B  C", "a b c d", "a b c d e", "a b c d e f"]
    passage = [word() for _ in range(40)]
    for _ in range(60):  # share a passage, but are different
        out.append(" ".join([word() for _ in range(60)] + passage + [word() for _ in range(20)]))
    for size in (30, 100, 400):
        base = [word() for _ in range(size)]
        out += [" ".join(base)] * 5
        for _ in range(60):  # copies around an original, many at the limit
            copy = list(base)
            for _ in range(draw.randrange(1, max(2, size // 25))):
                copy[draw.randrange(size)] = word()
            out.append(" ".join(copy))
    out.append(" ".join(word() for _ in range(30_000)))
    order = list(range(len(out)))
    draw.shuffle(order)
    return {7 * i + 3: out[k] for i, k in enumerate(order)}


def test_against_all_pairs(spark, texts):
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, node string")
    check(N.near_duplicates(docs.repartition(3)).collect(), texts)


def test_families_in_blocks(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(N.near_duplicates(docs, block=20).collect(), texts)


def test_crowded_regions(spark, texts, monkeypatch):
    monkeypatch.setattr(N, "CROWDED", 30)
    monkeypatch.setattr(N, "PAIRS", 16)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(N.near_duplicates(docs).collect(), texts)


def test_all_pairs_of_a_crowded_region_meet(spark, monkeypatch):
    monkeypatch.setattr(N, "CROWDED", 10)
    monkeypatch.setattr(N, "PAIRS", 8)
    rows = [(i, 1, i, i) for i in range(60)] + [(i, 2, i, 0) for i in range(7)] + [(99, 3, 0, 0)]
    members = N._regions(spark.createDataFrame(rows, "node long, region long, near long, far long")).collect()
    regions = {}
    for r in members:
        regions.setdefault(r["region"], set()).add(r["node"])
    met = {p for nodes in regions.values() for p in itertools.combinations(sorted(nodes), 2)}
    assert met == set(itertools.combinations(range(60), 2))
    assert max(map(len, regions.values())) < 30 and 99 not in set.union(*regions.values())


def test_rows_without_id_repeated_rows_and_no_rows(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text)], "doc_id long, text string")
    got = sorted(N.near_duplicates(docs).collect(), key=lambda r: r["doc_id"] or 0)
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in got] == [
        (None, None, None), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(draw.randrange(1000, 1400), draw.randrange(1000, 1400)) for _ in range(250)]
    edges += [(3, k) for k in range(4, 90)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_links_match_all_pairs():
    draw = np.random.default_rng(1)
    for _ in range(30):
        base = draw.choice(1 << 40, 40, replace=False).astype(np.uint64)
        sets = [np.unique(np.where(draw.random(40) < draw.choice([0.05, 0.12, 0.3]),
                                   draw.integers(1 << 50, 1 << 51, 40).astype(np.uint64), base)) for _ in range(25)]
        found = N.Forest(len(sets))
        for i, j in N._links(sets, 75):
            assert found.join(i, j)
        want = N.Forest(len(sets))
        for i, j in itertools.combinations(range(len(sets)), 2):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                want.join(i, j)
        assert [found.root(i) for i in range(25)] == [want.root(i) for i in range(25)]


def test_query_against_all_pairs(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    check(registered()["op3_near_duplicates"](spark, sf_dir).collect(), texts)
