"""Each stage against a plain version on its own input, and all of them over odd tables."""

import hashlib
import re
import weakref

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from defectlens.llm.tables import drop_worker_state, worker_state
from test_decontamination import plain_score
from test_neardup import plain_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The input of each stage, and the result."""
    docs = P.documents(spark, sf_dir)
    out = [docs]
    for _, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in P.STAGES] == [
        "language id", "line dedup", "near-duplicates", "decontamination", "byte-pair codes"]


def test_language_stage_keeps_every_text_of_a_learned_language(stages):
    before, after = stages[0], stages[1]
    assert after.columns == before.columns
    kept = {r["doc_id"] for r in rows_of(after)}
    gone = [r for r in rows_of(before) if r["doc_id"] not in kept]
    assert all(not any(c.isalpha() for c in r["text"] or "") for r in gone)


def test_line_stage(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    lines = [(r["doc_id"], k, line) for r in before for k, line in enumerate((r["text"] or "").split("\n"))]
    place = {(d, k): line for d, k, line in lines}
    seen, gone = {}, set()
    for size in (1, 2):
        for d, k, line in sorted(lines):
            run = tuple(place.get((d, k + j)) for j in range(size))
            if None in run:
                continue
            if run in seen and (size == 2 or len(line) >= 40):
                gone.update((d, k + j) for j in range(size))
            seen.setdefault(run, (d, k))
    want = {r["doc_id"]: "\n".join(line for k, line in enumerate((r["text"] or "").split("\n"))
                                   if (r["doc_id"], k) not in gone) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    assert len(after) == len(before) and gone


def test_near_duplicate_stage(stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])
    groups = plain_groups({r["doc_id"]: r["text"] for r in before})
    assert {r["doc_id"] for r in after} == {d for d, (_, root) in groups.items() if d == root}


def test_decontamination_stage(spark, sf_dir, stages):
    flat = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    items = [flat(r["text"]) for r in rows_of(P.benchmark(spark, sf_dir))][:6]
    kept = {r["doc_id"] for r in rows_of(stages[4])}
    for r in rows_of(stages[3]):
        words = flat(r["text"])
        if len(words) > 400:
            continue
        worst = max(plain_score(item, words) / (2 * len(item)) for item in items)
        if worst >= 0.5:
            assert r["doc_id"] not in kept
    # A document that shares no rare words with any item stays.
    gone = {r["doc_id"]: set(flat(r["text"])) for r in rows_of(stages[3]) if r["doc_id"] not in kept}
    every = [set(flat(r["text"])) for r in rows_of(P.benchmark(spark, sf_dir))]
    assert all(any(len(item & words) >= 0.5 * len(item) for item in every) for words in gone.values())


def test_code_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    texts = {r["doc_id"]: r["text"] for r in rows_of(stages[4])}
    codes = rows_of(stages[5])
    assert len(codes) == len(texts)
    for r in codes:
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    key = lambda r: (r["doc_id"], r["n_tokens"], r["decoded_sha256"])
    assert sorted(map(key, rows_of(P.run(spark, sf_dir)))) == sorted(map(key, rows_of(stages[5])))


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, None, None, None), (None, "one two three four five", "en", "s", 3), (2, "", "en", None, 0),
     (3, "one two three four five", "en", "s", 1), (3, "one two three four five", "en", "s", 1), (4, "12 34", "en", "s", 5)],
])
def test_odd_tables(spark, sf_dir, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS + ", node string")
    for name, stage in P.STAGES[:-1]:
        result = P.materialise(stage(spark, docs, sf_dir))
        assert result.columns == docs.columns, name
        docs = result
    left = sorted((r["doc_id"] or 0, r["text"]) for r in rows_of(docs))
    assert [d for d, _ in left] == ([0, 3, 3] if rows else [])
    assert P.STAGES[-1][1](spark, docs, sf_dir).count() == len(left)


def test_rows_are_judged_by_their_own_text(spark, sf_dir):
    """Null and repeated ids: the copy and the text without a letter go, the clean rows stay."""
    item = P.benchmark(spark, sf_dir).first()["text"]
    clean = "one two three four five"
    rows = [(None, item), (None, clean), (None, "12 34"), (None, None), (5, item), (5, clean), (5, "12 34"), (6, clean)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], COLUMNS)
    left = lambda frame: sorted((r["doc_id"] or 0, r["text"] or "") for r in rows_of(frame))
    assert left(P.language_id(spark, docs, sf_dir)) == sorted(
        [(0, item), (0, clean), (5, item), (5, clean), (6, clean)])
    assert left(P.decontaminated(spark, docs, sf_dir)) == sorted(
        [(0, clean), (0, "12 34"), (0, ""), (5, clean), (5, "12 34"), (6, clean)])


def test_workers_keep_one_state():
    """A worker that goes from stage to stage holds the automata of one, or none."""
    class State:
        pass

    kept = weakref.ref(worker_state("a", "1", State))
    assert worker_state("a", "1", State) is kept()
    other = weakref.ref(worker_state("b", "1", State))
    assert kept() is None and other() is not None
    again = weakref.ref(worker_state("a", "1", State))
    assert other() is None
    drop_worker_state()
    assert again() is None
