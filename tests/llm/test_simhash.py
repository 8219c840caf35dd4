import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from defectlens.llm import simhash as S
from defectlens.llm.queries import registered

DOCS = "doc_id long, text string, lang string, fingerprint string, u long, component_id long"


def plain_print(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    """Component number of each print, all pairs compared."""
    values = np.array(prints, np.uint64)
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[:i]) <= radius).tolist():
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [root(i) for i in range(len(prints))]


def check(got, docs):
    """Rows (doc_id, fingerprint, component_id) are those of (doc_id, text) pairs."""
    prints = [plain_print(text) for _, text in docs]
    groups, least = plain_groups(prints), {}
    for (ident, _), g in zip(docs, groups):
        if ident is not None:
            least[g] = min(ident, least.get(g, ident))
    want = sorted(repr((d, f"{p:016x}", least.get(g))) for (d, _), p, g in zip(docs, prints, groups))
    assert sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == want


def near(value, flips, draw):
    for b in draw.sample(range(64), flips):
        value ^= 1 << b
    return value


def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(registered()["op13_simhash_groups"](spark, sf_dir).collect(), docs)


def test_odd_rows(spark, tmp_path):
    draw = random.Random(13)
    word = lambda: f"w{draw.randrange(500)}"
    base = [word() for _ in range(300)]
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one two"), (None, "ONE Two"), (None, None), (None, "alone x y"),
            (6, "ß é x y z"), (6, "other text of the same id"), (7, "a b c")]
    for i in range(40):
        copy = list(base)
        for _ in range(i % 4):
            copy[draw.randrange(300)] = word()
        docs.append((100 + i, " ".join(copy)))
    docs += [(8, "tail of a piece " * 60_000), (9, "x" * 2_000_000 + " end"), (9, "x" * 2_000_000 + " end")]
    rows = [(d, t, None, "clash", 5, 6) for d, t in docs]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    check(registered()["op13_simhash_groups"](spark, str(tmp_path)).collect(), docs)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert registered()["op13_simhash_groups"](spark, str(tmp_path)).collect() == []


def test_pieces_do_not_change_a_fingerprint(spark, monkeypatch):
    draw = random.Random(1)
    text = " ".join(f"w{draw.randrange(90)}" for _ in range(400))
    want = plain_print(text)
    for piece in (1, 7, 100, 1 << 18):
        monkeypatch.setattr(S, "PIECE", piece)
        assert S.fingerprint_of(text.encode(), 3) == want
    one = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert S.fingerprint_of(b"A b\nc", 3) == one & (1 << 64) - 1


def test_parts_cover_the_free_bits():
    for mask in (0, 0xFFFF, 0xF0F0F0F0F0F0F0F0, (1 << 63) - 1):
        found = [p & ~mask for p in S.parts(mask, 3)]
        assert sum(found) == ~mask & (1 << 64) - 1
        assert all(a & b == 0 for a, b in itertools.combinations(found, 2))


@pytest.mark.parametrize("limit", [1024, 8])
def test_links_connect_the_same_groups(spark, limit, monkeypatch):
    """Chains, dense clusters and a third of all prints in one crowded shard."""
    monkeypatch.setattr(S, "LIMIT", limit)
    draw = random.Random(limit)
    prints = {draw.getrandbits(64) for _ in range(300)}
    for _ in range(20):
        at = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 12)):
            at = near(at, draw.randrange(1, 5), draw)
            prints.add(at)
    prints |= {(0xABCD << 48) | draw.getrandbits(20) for _ in range(200)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    made = S.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long")).collect()
    place = {p: i for i, p in enumerate(signed)}
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in made:
        a, b = sorted((root(place[u]), root(place[v])))
        up[b] = a
    assert [root(i) for i in range(len(prints))] == plain_groups(prints)


def test_trees_are_keyed_by_distance():
    draw = random.Random(2)
    prints = np.array([draw.getrandbits(64) for _ in range(400)], np.uint64)
    starts = np.array([0, 1, 150])
    edges, child = S.grow(prints, starts)
    parent, distance = edges // 128, edges % 128
    assert sorted([*child.tolist(), 0, 1, 150]) == list(range(400)) and len(set(edges.tolist())) == len(edges)
    assert (np.bitwise_count(prints[parent] ^ prints[child]) == distance).all()
