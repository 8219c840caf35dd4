import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from defectlens.llm import merkle as M
from defectlens.llm.order import numbered
from defectlens.llm.queries import registered

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*fields):
    return H("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_proofs(digests, fan_out):
    """(top, siblings per leaf and level) of one tree, built level by level."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H("".join(below[i:i + fan_out])) for i in range(0, len(below), fan_out)])
    proofs = []
    for i in range(len(digests)):
        proof = []
        for level in levels[:-1]:
            run = range(i - i % fan_out, min(i - i % fan_out + fan_out, len(level)))
            proof.append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
            i //= fan_out
        proofs.append(proof)
    return levels[-1][0], proofs


def plain_manifest(rows, fan_out):
    """Sorted (doc_id, leaf, subroot, root, proof) of rows (doc_id, lang, leaf)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    made = {n: plain_proofs([r[2] for r in trees[n]], fan_out) for n in names}
    root, crown = plain_proofs([made[n][0] for n in names], fan_out)
    return sorted(
        (repr(r[0]), r[2], made[n][0], root, p + crown[i])
        for i, n in enumerate(names) for r, p in zip(trees[n], made[n][1]))


def given(frame):
    return sorted(
        (repr(r["doc_id"]), r["leaf"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["proof"]])
        for r in frame.collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    out = [(i, "x" * draw.randrange(9), draw.choice(["en", "é", "zz", None]), "s", i, "clash") for i in range(300)]
    out += [(None, None, None, None, None, None)] * 3 + [(5, "again", "en", "s", 5, None)] * 40
    out += [(7, "", "", None, None, ""), (-3, "late", "lone", "s", 1, None), (900, "ß" * 3_000_000, "en", "s", 3, None)]
    return out


@pytest.mark.parametrize("fan_out, block", [(2, 1024), (2, 8), (3, 9), (5, 4)])
def test_proofs_against_plain_trees(spark, rows, fan_out, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", block)
    docs = spark.createDataFrame(rows, DOCS)
    leaves = docs.select("doc_id", "lang", M.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
                         .alias("leaf"))
    got = given(M.prove(leaves, "lang", "doc_id", "leaf", ["doc_id"], fan_out))
    plain = [(d, lang, plain_leaf(d, source, lang, n, text)) for d, text, lang, source, n, _ in rows]
    assert got == plain_manifest(plain, fan_out)


def test_fold_and_digest_of_a_proof(spark):
    frame = spark.createDataFrame([("aa", [("", "bb"), ("", ""), ("cc", "")])], f"leaf string, proof {M._PATH}")
    row = frame.select(M.folded(F.col("leaf"), F.col("proof")), M.proof_digest(F.col("proof"))).first()
    assert row[0] == H("cc" + H(H("aabb"))) and row[1] == H("bbcc")


def test_intervals_nest_and_add_up(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    leaves = spark.range(101).select(
        F.lit("t").alias("tree"), F.lit(101).cast("long").alias("total"), F.col("id").alias("rank"),
        F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.struct("id").alias("payload"))
    nodes = {(r["level"], r["lo"], r["hi"]) for r in M.plant(leaves).nodes().collect()}
    want = {(k, lo, min(lo + 2 ** k, 101)) for k in range(1, 8) for lo in range(0, 101, 2 ** k)}
    assert nodes == want


def test_only_what_was_tampered_fails(spark, sf_dir):
    got = registered()["op11_merkle_manifest"](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in got:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)


def test_empty_and_null_tables(spark, tmp_path):
    for name, rows in (("empty", []), ("nulls", [(None, None, None, None, None, None)] * 2)):
        spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = registered()["op11_merkle_manifest"](spark, str(tmp_path / name)).collect()
        assert len(got) == len(rows) and all(r["verified"] for r in got)
    leaf = plain_leaf(None, None, None, None, None)
    assert {(r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got} == {
        (leaf, H(leaf + leaf), H(leaf + leaf), H(leaf))}


def test_places_within_groups(spark):
    draw = random.Random(3)
    rows = [(draw.choice("abc"), draw.randrange(50), draw.randrange(1, 9)) for _ in range(500)]
    got = numbered(spark.createDataFrame(rows, "g string, k int, w int"), ["g", "k"], "g", F.col("w")).collect()
    for g in "abc":
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and [r["k"] for r in own] == sorted(r["k"] for r in own)
        assert [r["before"] for r in own] == [sum(x["w"] for x in own[:i]) for i in range(len(own))]
        assert {r["total"] for r in own} == {len(own)}
