import hashlib
import random
import re
import zlib

import pytest

from defectlens.llm import trie as T
from defectlens.llm.queries import registered

TURNS = "conv_id long, turn long, role string, text string, n long, ids string, key string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def plain_trie(sequences):
    """Node rows of {conv_id: [(role, text), ...]}."""
    members, ends = {}, {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
        ends.setdefault(tuple(turns), []).append(conv)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for prefix in sorted(members, key=len, reverse=True):
        if prefix:
            children[prefix[:-1]] += 1
            saved[prefix] += (len(members[prefix]) - 1) * words(prefix[-1][1])
            saved[prefix[:-1]] += saved[prefix]
        leaves[prefix] = leaves[prefix] or 1
        if prefix:
            leaves[prefix[:-1]] += leaves[prefix]
    return sorted((
        min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), children[p], leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p in members)


def rebuilt(rows):
    turns = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + turns[c][h:]
    return out


def given(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in frame.select(names).collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(12)
    out = []
    for conv in range(260):
        for turn in range(draw.randrange(0, 7)):
            text = draw.choice(["", "a", "a b", "b  c\td", None, "ß é"])
            out.append((conv, turn if turn else None, draw.choice(["user", None]), text, None, "x", "y"))
    out += [(c, t, "u", "same words here", None, None, None) for c in range(1000, 1400) for t in range(5)]
    out += [(None, 1, "u", "no one's", None, None, None)] * 5 + [(2001, None, None, None, None, None, None)]
    out += [(3000, t, "u", f"w{t} " * 30, 1, "", "") for t in range(700)]
    out += [(3019, t, "u", f"w{t} " * 30, 1, "", "") for t in range(690)]
    return out + [(4003, 1, "u", "long " * 400_000, 1, "", "")]


@pytest.mark.parametrize("turns, piece_bits", [(1 << 16, 12), (40, 3), (1, 12)])
def test_query_against_plain_trie(spark, rows, tmp_path, turns, piece_bits, monkeypatch):
    monkeypatch.setattr(T, "SHARD_TURNS", turns)
    monkeypatch.setattr(T, "_PIECE_BITS", piece_bits)
    folder = str(tmp_path / "data")
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    got = given(registered()["op12_conversation_trie"](spark, folder))
    assert got == sorted(plain_trie(rebuilt(rows)))


def test_no_conversations(spark, tmp_path):
    for name, rows in (("empty", []), ("nulls", [(None,) * 7] * 3)):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, TURNS).write.parquet(f"{folder}/conversations.parquet")
        assert given(registered()["op12_conversation_trie"](spark, folder)) == []


def test_only_turnless(spark):
    encoded = spark.createDataFrame([(7, [], []), (4, [], [])], "conv_id long, ids array<long>, words array<int>")
    empty = hashlib.sha256(b"4,7").hexdigest()
    assert given(T.prefix_trie(encoded)) == [(4, 0, None, 2, 0, 1, 0, empty)]


def test_equal_turn_numbers_and_repeated_rows(spark):
    rows = [(1, 5, "u", "b"), (1, 5, "u", "a"), (1, 5, "u", "a"), (2, 1, "u", "a")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["ids"] for r in T.encode_turns(docs).collect()}
    a = got[2][0]
    assert sorted(got[1]) == sorted([a, a, 1 - a]) and got[1] == sorted(got[1])


def test_medians_balance_the_tree():
    tree = T.TernaryTree()
    for i in T.medians(1023):
        tree.insert([i], [1], i)
    deepest, stack = 0, [(tree.top, 1)]
    while stack:
        at, depth = stack.pop()
        deepest = max(deepest, depth)
        stack += [(x, depth + 1) for x in (tree.low[at], tree.high[at]) if x >= 0]
    assert deepest == 10 and sorted(T.medians(57)) == list(range(57))
