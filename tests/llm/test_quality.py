import re

import pytest

from defectlens.llm import quality as Q
from defectlens.llm.queries import registered


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 30, "x y " * 40 + "end",
    "same\nsame\n \n \nsame \nother", "#*$ %&| <> \x0b\x0c 😀 é", "a b c d e f g h i " * 3, "word " * 20_000,
    " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(30, 40)) + " tail",
    "trailing space \n\n", "\x85\xa0 nbsp is a word",
]


def test_counts(spark):
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = {r["doc_id"]: r for r in Q.measured(docs).collect()}
    for i, text in enumerate(TEXTS):
        want = counts(text)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_thresholds_follow_the_group(spark):
    plain = " ".join(f"plain{i}" for i in range(30))
    marked = " ".join(f"#{i}#" for i in range(30))
    rows = [(i, plain, "en", "a") for i in range(20)] + [(100, marked, "en", "a")]
    rows += [(200 + i, marked, "xx", "b") for i in range(20)]  # a language in which signs are usual
    rows += [(300, plain, None, None), (300, plain, None, None), (None, plain, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Q.judge(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if not r["kept"]} == {100}
    assert Q.judge(docs.limit(0)).count() == 0


def test_sketches_merge(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(20 + i)), "en", f"s{i % 3}") for i in range(60)]
    rates = Q.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    order = ["lang", "source", "rate", "step"]
    halves = Q.sketches(rates.where("doc_id < 30")).unionByName(Q.sketches(rates.where("doc_id >= 30")))
    merged = halves.groupBy(order).sum("n").orderBy(order).collect()
    assert list(map(tuple, merged)) == list(map(tuple, Q.sketches(rates).select(*order, "n").orderBy(order).collect()))


def test_clean_documents_are_kept(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    rows = registered()["op7_quality_rules"](spark, sf_dir).join(labels, "doc_id").where("not base_failed")
    assert rows.count() > 20 and rows.where("not kept").count() == 0
