import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from defectlens.llm import bpe
from defectlens.llm.queries import VOCABULARY, registered

PATH = public_tokenizers.path(VOCABULARY)
PIECES = [
    "a", "aa", " ", "  ", "\n", "\t", "é", "漢", "😀", "1", "22", "'s", "'LL", "!", "!!!", "_", "<|endoftext|>",
    "<|endof", "\r\n", "\xa0", "​", "é", "the", "ing", "ABC", "²", "\x00", "\x1c", "\x85", "﻿",
]
TEXTS = ["", "\n", "a" * 30_000, "=" * 5_000, " " * 5_000, "x<|endoftext|>y", "hello hello  world"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton(bpe.load_vocabulary(PATH))


def test_against_the_library(library, automaton):
    draw = random.Random(11)
    texts = TEXTS + ["".join(draw.choices(PIECES, k=draw.randrange(1, 14))) for _ in range(3000)]
    texts += ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0x250), draw.randrange(0x2000, 0xD7FF)]))
                      for _ in range(draw.randrange(1, 30))) for _ in range(2000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == ids
        assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_equal_halves_merge_from_the_left():
    tokens = {chr(c): i for i, c in enumerate([*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100),
                                               *range(0x100, 0x144)])}
    tokens |= {"aa": 300, "aaa": 301}
    a = bpe.Automaton(bpe.Vocabulary(tokens, [("a", "a"), ("aa", "a")], {}))
    want = {1: [tokens["a"]], 2: [300], 3: [301], 4: [300, 300], 5: [300, 301]}
    assert {n: a.encode("a" * n) for n in want} == want


def test_cut_bytes_decode_to_the_replacement_sign(library, automaton):
    ids = automaton.encode("漢字")
    assert automaton.decode(ids[:1]) == library.decode(ids[:1], skip_special_tokens=False)


def test_tables(spark, library):
    rows = [(i, t, b"ids") for i, t in enumerate([None, *TEXTS, TEXTS[-1]])] + [(None, "a b", b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    encoded = bpe.encode_documents(docs, PATH)
    got = {r["doc_id"]: r for r in encoded.collect()}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids"] == struct.pack(f"<{len(ids)}I", *ids)
    back = {r[0]: r[1] for r in bpe.decode_documents(encoded, PATH).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = registered()["op1_bpe_codes"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
