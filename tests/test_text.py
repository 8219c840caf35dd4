"""Text functions and TF-IDF against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from defectlens.functions import counting, text as T
from defectlens.operators import textvectors as V

SAMPLES = [
    "def add(a, b):\n    return a + b\n",
    "Über café naïve 9abc _x1 99 a9\r\nzweite   Zeile\x0bdritte\u2028vierte\u00a0\n\n \t\n",
    "",
    "x",
    "x = 1\nx = x + 1  # TODO todo HACKS fixme\n" * 3,
    "日本語 のテキスト abc_def\u3000ghi",
]


def column(spark, expr, values=SAMPLES):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_normalise_name(spark):
    names = [
        "codellama--CodeLlama-7b-Instruct-hf", "deepseek-ai--deepseek-coder-33b-instruct",
        "Claude_3_Opus_20240229", "a--b--c-hf", "V v.1",
    ]
    assert column(spark, T.normalise_name, names) == [
        "codellama7binstruct", "deepseekcoder33binstruct", "claude3opus", "bc", "v1",
    ]


def test_line_functions(spark):
    assert column(spark, T.line_count) == [s.count("\n") + 1 for s in SAMPLES]
    visible = [len([line for line in s.splitlines() if line.strip()]) for s in SAMPLES]
    assert column(spark, T.nonblank_lines) == visible
    assert column(spark, T.is_very_short) == [int(v <= 5) for v in visible]


def test_markers_and_identifiers(spark):
    found = [len(re.findall(r"\b(TODO|FIXME|HACK|XXX)\b", s, re.IGNORECASE)) for s in SAMPLES]
    assert column(spark, T.marker_hits) == found
    assert column(spark, T.identifiers) == [re.findall(r"[A-Za-z_][A-Za-z0-9_]*", s) for s in SAMPLES]


def python_words(text):
    tokens = re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text.lower())
    return Counter(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])


def python_chars(text):
    counts = Counter()
    for word in text.lower().split():
        padded = f" {word} "
        for n in (2, 3, 4):
            counts.update(padded[i:i + n] for i in range(len(padded) - n + 1))
    return counts


COUNTERS = {"word": python_words, "char": python_chars}


@pytest.mark.parametrize("kind", ["word", "char"])
def test_term_counts(spark, kind):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "id int, t string")
    units = V.UNITS[kind](df, "id", "t")
    got = {(r["id"], r["term"]): r["tf"] for r in V.term_counts(units, "id", kind).collect()}
    want = {(i, term): n for i, s in enumerate(SAMPLES) for term, n in COUNTERS[kind](s).items()}
    assert got == want


@pytest.mark.parametrize("kind", ["word", "char"])
@pytest.mark.parametrize("limit", [5, 1000])
def test_tfidf(spark, kind, limit):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "id int, t string")
    units = V.UNITS[kind](df, "id", "t")
    fitted = V.fit_tfidf(units, "id", kind, F.lit(len(SAMPLES)), limit)
    weights = V.with_term(V.tfidf_weights(units, "id", kind, fitted, limit), fitted, limit)
    got = {(r["id"], r["term"]): r["weight"] for r in weights.collect()}

    counts = [COUNTERS[kind](s) for s in SAMPLES]
    totals = sum(counts, Counter())
    vocab = sorted(totals, key=lambda t: (-totals[t], t))[:limit]
    idf = {t: math.log((1 + len(SAMPLES)) / (1 + sum(t in c for c in counts))) + 1 for t in vocab}
    want = {}
    for i, c in enumerate(counts):
        raw = {t: (1 + math.log(c[t])) * idf[t] for t in vocab if c[t]}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        want.update({(i, t): w / norm for t, w in raw.items()})
    assert got == pytest.approx(want)


def test_assembled_row_lines_up(spark):
    static = spark.createDataFrame([(1, 2.0, None), (2, 0.0, 3.0)], "sample_id int, a double, b double")
    block = spark.createDataFrame([(1, 0, 0.5), (1, 2, 0.25)], "sample_id int, idx int, weight double")
    rows = V.as_vectors(V.assemble(static, ["a", "b"], [block, block], [3, 3])).orderBy("sample_id").collect()
    assert rows[0]["features"].toArray().tolist() == [2.0, 0.0, 0.5, 0.0, 0.25, 0.5, 0.0, 0.25]
    assert rows[1]["features"].toArray().tolist() == [0.0, 3.0, 0, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("kind", ["word", "char"])
def test_fitting_and_weighing_at_once(spark, kind):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "id int, t string")
    units = V.UNITS[kind](df, "id", "t")
    some = F.col("id") % 2 == 0
    n = sum(i % 2 == 0 for i in range(len(SAMPLES)))
    fitted, weights = V.fit_and_weigh(units, "id", kind, F.lit(n), 50, some)
    alone = V.fit_tfidf(units.where(some), "id", kind, F.lit(n), 50)
    order = ["term", "idx", "df", "idf"]
    assert sorted(fitted.select(order).collect()) == sorted(alone.select(order).collect())
    apart = V.tfidf_weights(units, "id", kind, alone, 50)
    got = {(r["id"], r["idx"]): r["weight"] for r in weights.collect()}
    assert got == pytest.approx({(r["id"], r["idx"]): r["weight"] for r in apart.collect()})


@pytest.mark.parametrize("kind", ["word", "char"])
def test_terms_are_counted_inside_their_document(spark, kind):
    """No grouping by document and term: a document is one row of units, and repeated ids add up."""
    rows = [(1, SAMPLES[0]), (2, SAMPLES[1]), (2, SAMPLES[0]), (None, "a b a"), (None, "b")]
    df = spark.createDataFrame(rows, "id int, t string")
    units = V.UNITS[kind](df, "id", "t")
    assert units.count() == 3
    want = {}
    for i, s in rows:
        want[i] = want.get(i, Counter()) + COUNTERS[kind](s)
    got = {}
    for r in V.term_counts(units, "id", kind).collect():
        got.setdefault(r["id"], Counter())[r["term"]] = r["tf"]
    assert got == want
    single = V.term_counts(V.UNITS[kind](df.where("id = 1"), "id", "t"), "id", kind)
    assert "Aggregate" not in single._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    from defectlens.functions import counting
    monkeypatch.setattr(counting, "_ELEMENTS", 7)
    df = spark.createDataFrame(list(enumerate(SAMPLES * 3)), "id int, t string")
    for kind, counter in COUNTERS.items():
        got = V.term_counts(V.UNITS[kind](df, "id", "t"), "id", kind).collect()
        assert {(r["id"], r["term"]): r["tf"] for r in got} == {
            (i, term): n for i, s in enumerate(SAMPLES * 3) for term, n in counter(s).items()}


def test_texts_are_dealt_by_bytes_and_cut_once(spark, monkeypatch):
    """A part holds some PART_BYTES of text, however much there is, and no filter cuts the texts again."""
    monkeypatch.setattr(V, "PART_BYTES", 100)
    rows = [(i, f"w{i % 7} {SAMPLES[i % 6]}") for i in range(40)]
    docs = spark.createDataFrame(rows, "i int, t string")
    size = sum(len(t.encode()) for _, t in rows)
    units = V.word_units(docs, "i", "t")
    assert units.rdd.getNumPartitions() == -(-size // 100)
    assert V.word_units(docs.limit(0), "i", "t").count() == 0
    plan = V.unit_rows(units)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    want = Counter()
    for _, text in rows:
        words = re.findall("[A-Za-z_][A-Za-z0-9_]*", text.lower())
        want.update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    got = V.unit_rows(units).groupBy("unit").agg(F.sum("n")).collect()
    assert {r[0]: r[1] for r in got} == want


@pytest.mark.parametrize("lengths", [(), (2, 3, 4)])
def test_counting_holds_a_slice_of_a_batch(monkeypatch, lengths):
    """However long a batch is, only some units of it are cut and only some entries are weighed at a time."""
    rng = np.random.default_rng(2)
    words = [" ab ", " straße ", " x ", " " + "abc" * 40 + " ", " 日本語テキスト ", " abab "] + [f" w{i} " for i in range(9)]
    docs = [[(words[w], int(rng.integers(1, 5))) for w in rng.choice(len(words), rng.integers(0, 6), replace=False)] for _ in range(60)]
    units = pa.array([[{"unit": u, "n": n} for u, n in doc] for doc in docs], counting._COUNTED)
    terms = lambda w: [w] if not lengths else [w[i:i + k] for k in lengths for i in range(len(w) - k + 1)]
    vocabulary = sorted({t for w in words[:12] for t in terms(w)} - {"ab", " x "})
    want = []
    for doc in docs:
        tf = Counter()
        for unit, n in doc:
            for term in terms(unit):
                tf[term] += n
        want.append(sorted((vocabulary.index(t), n) for t, n in tf.items() if t in vocabulary))
    cut, sizes = counting._term_sums, []
    monkeypatch.setattr(counting, "_UNITS", 7)
    monkeypatch.setattr(counting, "_ELEMENTS", 5)
    monkeypatch.setattr(counting, "_term_sums", lambda units, *more: sizes.append((len(units), len(units.flatten()))) or cut(units, *more))
    box = lambda value: type("Shared", (), {"value": value})()
    found = counting.known_counter(box(vocabulary), lengths).func(units)
    assert found.type == counting._KNOWN and len(sizes) > 20 and all(n <= 7 or rows == 1 for rows, n in sizes)
    assert [list(zip(r["idx"], r["tf"])) for r in found.to_pylist()] == want
    listed = counting.term_counter(lengths).func(units).to_pylist()
    assert [sorted((t["term"], t["tf"]) for t in doc if t["term"] in vocabulary) for doc in listed] == [
        sorted((vocabulary[i], n) for i, n in doc) for doc in want]

    idf, places = rng.random(len(vocabulary)) + 1, np.where(np.arange(len(vocabulary)) % 3 == 0, -1, np.arange(len(vocabulary)))
    weights = counting.weigher(box((places, idf))).func(found).to_pylist()
    for doc, got in zip(want, weights):
        raw = [(places[i], (1 + np.log(n)) * idf[i]) for i, n in doc if places[i] >= 0]
        norm = np.sqrt(sum(w * w for _, w in raw))
        assert got["idx"] == [i for i, _ in raw] and got["weight"] == pytest.approx([w / norm for _, w in raw])
