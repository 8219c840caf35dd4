import math

import numpy as np
import pytest

from defectlens.llm import langid
from defectlens.llm.queries import registered

REFERENCES = {"aa": "abra cadabra, abracadabra", "bb": "simsala bim sala bim"}


def plain(text):
    out, space = "", False
    for c in text.lower():
        if c.isalpha():
            out, space = out + c, False
        elif not space:
            out, space = out + " ", True
    return out


def phrases(text, reference):
    """Longest matches one after the other, beginning anew every PIECE characters."""
    count = 0
    for start in range(0, len(text), langid.PIECE):
        piece = text[start:start + langid.PIECE]
        at = 0
        while at < len(piece):
            end = at + 1
            while end < len(piece) and piece[at:end + 1] in reference:
                end += 1
            count, at = count + 1, end
    return count


@pytest.mark.parametrize("text", [
    "abracadabra", "xyz abra", "sim  sala,bim", "a", "a1b2", "abra " * 200 + "bim" * 100, "ABRA zzz", "q" * 700,
])
def test_phrases(text):
    parser = langid.Parser(REFERENCES)
    entropy, lettered = parser.entropies(["", text, "..."])
    assert lettered.tolist() == [False, True, False]
    body = plain(text)
    for k, name in enumerate(parser.names):
        reference = plain(REFERENCES[name])
        want = phrases(body, reference) * math.log2(len(reference)) / len(body)
        assert entropy[1, k] == pytest.approx(want)


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "1234 !?", "x"), (4, "abra cadabra", None), (4, "abra cadabra", None),
            (None, "simsala bim", "x"), (6, "abra " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in langid.identify(docs, REFERENCES).collect())
    assert [g[:2] for g in got] == [(0, "bb"), (1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "aa"), (6, "aa")]
    assert all(0 <= g[2] <= 1 for g in got)
    assert langid.identify(docs.limit(0), REFERENCES).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}


def test_learning_is_bounded_and_skips_missing_labels(spark):
    rows = [(i, "word " * 100, "aa") for i in range(200)] + [(500, "other", None), (501, None, "bb"), (502, "12", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    references = langid.learn(docs, excerpts=3, chars=10)
    assert list(references) == ["aa"] and len(references["aa"]) == 3 * 11
    assert langid.learn(docs.limit(0)) == {}


def test_held_out_accuracy(spark, sf_dir):
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = registered()["op6_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(labels)
    assert np.mean([r["lang_pred"] == labels[r["doc_id"]] for r in rows if r["held_out"]]) > 0.95
