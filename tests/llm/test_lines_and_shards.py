import pytest

from defectlens.llm import linededup as L, sharding as S

LONG = "a line that is long enough to be a run by itself"


def plain(rows, min_lines, long_line):
    """Kept text per (doc_id, text), by looking at every window; rows in order of id."""
    documents = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), {}
    cut = [(d, d[1].split("\n") if d[1] is not None else []) for d in documents]
    for size in {1, min_lines}:
        seen = set()
        for d, lines in cut:
            for k in range(len(lines) - size + 1):
                run = tuple(lines[k:k + size])
                if run in seen and (size == min_lines or len(run[0]) >= long_line):
                    gone.setdefault(d, set()).update(range(k, k + size))
                seen.add(run)
    return {d: None if d[1] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone.get(d, ())) for d, lines in cut}


ROWS = [
    (1, "a\nb\nc"), (2, "x\na\nb\nc\ny"), (3, "b\nc"), (4, "c\nb"), (5, f"{LONG}\nz"), (6, f"q\n{LONG}"), (7, "k\nk\nk\nk"),
    (8, None), (9, ""), (10, ""), (11, "\n\n\n"), (12, "\n".join(str(i % 50) for i in range(5000))), (13, "single"),
    (14, "single"), (None, "a\nb\nc"), (15, "a\nb\nc"), (15, "a\nb\nc"), (16, f"{LONG}\n{LONG}"),
]


@pytest.mark.parametrize("min_lines", [1, 2, 4])
def test_line_runs(spark, min_lines):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, level string").repartition(4)
    got = [(r["doc"]["doc_id"], r["doc"]["text"], r["kept_text"], r["n_lines"], r["n_removed"])
           for r in L.dedup_lines(docs, min_lines).collect()]
    assert len(got) == len(ROWS)
    want = plain(ROWS, min_lines, 40)
    for doc_id, text, kept, n, removed in got:
        assert kept == want[doc_id, text], (doc_id, text)
        assert n == (0 if text is None else text.count("\n") + 1)
        assert removed == (0 if text is None else n - (kept.count("\n") + 1 if kept or removed < n else 0))


def test_longest_level(spark):
    body = "\n".join(f"row {i}" for i in range(37))
    docs = spark.createDataFrame([(1, body), (2, "first\n" + body), (3, "row 5\nrow 6\nnew")], "doc_id long, text string")
    assert {r["doc"]["doc_id"]: r["level"] for r in L.dedup_lines(docs).collect()} == {1: 0, 2: 32, 3: 2}
    assert L.dedup_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.dedup_lines(docs, min_lines=3)


def test_shards_fit_or_cannot_be_split(spark):
    rows = [(i, "x" * (i % 90), "n") for i in range(800)] + [(None, None, "n"), (5000, "y" * 3000, "n")]
    rows += [(6000, "z" * 40, "n")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string").repartition(5)
    got = S.extendible_shards(docs, 1000).toPandas()
    assert len(got) == len(rows)
    assert got["n_bytes"].sum() == sum(len(t or "") for _, t, _ in rows)
    by_shard = got.groupby("shard")
    assert (by_shard["n_bytes"].sum() == by_shard["shard_bytes"].first()).all()
    large = by_shard.filter(lambda g: g["n_bytes"].sum() > 1000)
    assert set(large["doc_id"]) == {5000, 6000} and not large["fits"].any()
    assert got[~got["doc_id"].isin([5000, 6000])]["fits"].all()
    names = set(got["shard"])
    assert all(got["shard"].str.len() == got["depth"])
    # No shard's bits begin another's, and two halves together would not have fitted.
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    sizes = by_shard["n_bytes"].sum()
    for name in names:
        parent = name[:-1]
        assert sum(v for k, v in sizes.items() if k.startswith(parent)) > 1000


def test_one_shard_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in S.extendible_shards(docs, 10).collect()} == {(1, 1, "", 0, 1, True), (2, 0, "", 0, 1, True)}
    assert S.extendible_shards(docs.limit(0), 10).count() == 0


def test_shard_folders(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 30, i % 3) for i in range(50)], "doc_id long, text string, shard int")
    S.write_shards(docs, str(tmp_path / "out"), 400)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard_name").distinct().count() > 3
    assert back.groupBy("shard_name").agg({"text": "count"}).toPandas()["count(text)"].max() * 30 <= 400
