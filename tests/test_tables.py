"""Sources, sinks, matching, splits and profiles."""

import json

import pytest
from pyspark.sql import functions as F

from defectlens import schema
from defectlens.operators import matching, profiling, relational, splits
from defectlens.sources import readers, writers


@pytest.fixture
def raw_files(tmp_path):
    """Two splits, an alias, a fuzzy match, an unmatched model and unlabelled tasks."""
    with open(tmp_path / "tasks.jsonl", "w") as fh:
        for task in [
            {"task_id": "T/0", "instruct_prompt": "old", "libs": "['os']"},
            {"task_id": "T/1", "instruct_prompt": "do one", "libs": "[]", "entry_point": "f"},
            {"task_id": "T/0", "instruct_prompt": "do zero", "libs": "['re']"},
        ]:
            fh.write(json.dumps(task) + "\n")
    files = {
        "complete/gemini-1.5-pro--bigcodebench-complete--vllm.jsonl": [("T/0", "a = 1\nb = 'x,\"y\"'"), ("T/9", "c")],
        "complete/org--Some-Model-hf--bigcodebench-complete.jsonl": [("T/0", "d"), ("T/1", None), ("T/2", "e")],
        "complete/who--Knows--bigcodebench-complete.jsonl": [("T/0", "z")],
        "instruct/org--Some-Model-hf--bigcodebench-instruct.jsonl": [("T/1", "g")],
    }
    for name, rows in files.items():
        path = tmp_path / "samples" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        lines = [{"task_id": t, **({"solution": s} if s is not None else {})} for t, s in rows]
        path.write_text("".join(json.dumps(r) + "\n" for r in lines))
    evals = tmp_path / "evals"
    evals.mkdir()
    for name, labels in {
        "Gemini_1.5_Pro_API_0514--complete": {"T/0": 1},
        "Some_Model--complete": {"T/0": 0, "T/1": 1},
        "Some_Model--instruct": {"T/1": 0},
    }.items():
        (evals / f"{name}_eval_results.json").write_text(json.dumps(labels))
    return tmp_path


def test_collect_samples(spark, raw_files):
    rows = readers.collect_samples(
        spark, str(raw_files / "tasks.jsonl"), str(raw_files / "samples"), str(raw_files / "evals")
    ).select(*schema.SAMPLES.names).collect()
    got = {(r["model_name"], r["split"], r["task_id"]): r for r in rows}
    assert len(rows) == len(got) == 4
    pro = got["Gemini_1.5_Pro_API_0514", "complete", "T/0"]
    assert (pro["label"], pro["instruct_prompt"], pro["libs"], pro["complete_prompt"]) == (1, "do zero", "['re']", "")
    assert pro["solution"] == "a = 1\nb = 'x,\"y\"'"
    assert got["Some_Model", "complete", "T/1"]["solution"] == ""
    assert got["Some_Model", "instruct", "T/1"]["label"] == 0


def test_skipped_models(spark, raw_files):
    codes = relational.union_all(*[readers.read_code_files(spark, str(raw_files / "samples"), s) for s in readers.SPLITS])
    evals = relational.union_all(*[readers.read_eval_maps(spark, str(raw_files / "evals"), s) for s in readers.SPLITS])
    aliases = relational.mapping_table(spark, schema.MODEL_ALIASES, "sample_model", "eval_model")
    assert [tuple(r) for r in matching.skipped_models(codes, evals, aliases).collect()] == [("complete", "who--Knows")]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_samples_survive_a_round_trip(spark, tmp_path, fmt):
    rows = [
        ("t1", "m", "complete", '  a = "x, y"\r\n\n# done \n', 1, "c", "p", "[]", "f"),
        ("t2", "m", "complete", "", 0, None, "", "NA", "f"),
    ]
    df = spark.createDataFrame(rows, schema.SAMPLES)
    path = str(tmp_path / "out")
    writers.write_table(df, path, fmt)
    back = readers.read_table(spark, path, fmt, schema.SAMPLES)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    prepared = readers.read_samples(spark, path, fmt, max_rows=1)
    assert prepared.count() == 1
    assert {"generated_code", "prompt"} <= set(prepared.columns)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="instruct_prompt"):
        readers.prepare_samples(spark.createDataFrame([("t", 1)], "task_id string, label int"))


def test_fold_partitions_are_pruned(spark, tmp_path, sf_dir):
    df = spark.range(100).select(F.col("id").cast("string").alias("task_id"), F.lit(1).alias("label"))
    path = str(tmp_path / "splits")
    writers.write_table(splits.group_split(df), path, partition_by=["fold"])
    back = spark.read.parquet(path)
    assert {r["fold"]: r["count"] for r in back.groupBy("fold").count().collect()} == {"train": 70, "val": 15, "test": 15}
    plan = back.where("fold = 'val'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan


def test_split_is_complete_and_disjoint(spark):
    rows = [(i, f"t{i % 41}" if i % 50 else None, i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, task_id string, label int")
    split = splits.group_split(df).cache()
    assert split.count() == df.where("task_id is not null").count()
    assert split.groupBy("task_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    tasks = {r["fold"]: r["n_tasks"] for r in splits.split_summary(split).collect()}
    assert tasks == {"train": int(41 * 0.70), "val": int(41 * 0.15), "test": 41 - int(41 * 0.70) - int(41 * 0.15)}
    assert {r["n_shared"] for r in splits.split_overlap(split).collect()} == {0}
    again = splits.group_split(df)
    assert again.exceptAll(split).count() == 0


def test_split_guards(spark):
    df = spark.createDataFrame([("a",)], "task_id string")
    with pytest.raises(ValueError):
        splits.group_split(df, ratios=(0.5, 0.2, 0.2))
    with pytest.raises(ValueError):
        splits.group_split(df, group="nope")


def test_group_folds_are_balanced(spark):
    rows = [(f"t{t}", int((t * 7 + s) % 10 < t % 10)) for t in range(100) for s in range(10)]
    df = spark.createDataFrame(rows, "task_id string, label int")
    folds = splits.stratified_group_folds(df)
    sizes = {r["foldCol"]: r["count"] for r in folds.groupBy("foldCol").count().collect()}
    assert sizes == {i: 20 for i in range(5)}
    rates = [r["r"] for r in df.join(folds, "task_id").groupBy("foldCol").agg(F.avg("label").alias("r")).collect()]
    assert max(rates) - min(rates) < 0.06


def test_leaderboard_and_nulls(spark):
    rows = [(f"m{i}", None if i == 3 else f"t{j}", int(j < i)) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(rows, "model_name string, task_id string, label int")
    board = profiling.leaderboard(df, 2).collect()
    assert [(r["model_name"], r["place"]) for r in board] == [
        ("m11", "top"), ("m10", "top"), ("m0", "bottom"), ("m1", "bottom"),
    ]
    nulls = {r["column_name"]: r["n_null"] for r in profiling.null_profile(df).collect()}
    assert nulls == {"model_name": 0, "task_id": 12, "label": 0}


def test_failure_overlap(spark):
    # Tasks 0 and 1 defeat both best models, task 0 the two worst as well.
    solved = {"a": "234", "b": "234", "c": "1", "d": "1"}
    rows = [(m, f"t{t}", int(str(t) in s)) for m, s in solved.items() for t in range(5)]
    df = spark.createDataFrame(rows, "model_name string, task_id string, label int")
    (row,) = profiling.failure_overlap(df, 2).collect()
    assert tuple(row) == (2, 1, 0.5)


def test_sample_n_is_stable(spark):
    df = spark.range(1000)
    first = {r["id"] for r in relational.sample_n(df, 50, "id").collect()}
    again = {r["id"] for r in relational.sample_n(df.repartition(7), 50, "id").collect()}
    assert first == again and len(first) == 50
    assert relational.sample_n(df, 5000, "id").count() == 1000


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, None, "x")], "ast_if_count int, ast_for_count int, generated_code string")
    assert relational.code_column(df) == "generated_code"
    assert relational.available(df, ["nope", "ast_if_count"]) == ["ast_if_count"]
    assert relational.columns_by_prefix(df, ["ast_", "align_"]) == {"ast_": ["ast_if_count", "ast_for_count"], "align_": []}
    assert relational.with_defaults(df, {"ast_for_count": 0, "gone": 1}).first()["ast_for_count"] == 0


def test_fixed_tables(spark):
    families = relational.family_table(spark, schema.MODEL_FAMILIES)
    assert families.count() == families.select("model_name").distinct().count() == 41
    assert len(schema.FEATURE_COLUMNS) == 18
    assert len(schema.MODEL_ALIASES) == 20
    assert {f: len(m) for f, m in schema.MODEL_FAMILIES.items()} == {
        "GPT": 4, "Claude": 4, "Llama": 10, "DeepSeek": 12, "Mistral": 5, "Qwen": 6,
    }


@pytest.mark.parametrize("text", ['{"t1": 1, "t2": ', '{"t1": "yes"}', "[1]"])
def test_broken_eval_map_fails_the_read(spark, tmp_path, text):
    (tmp_path / "good--complete_eval_results.json").write_text('{"t1": 1}')
    (tmp_path / "bad--complete_eval_results.json").write_text(text)
    with pytest.raises(Exception):
        readers.read_eval_maps(spark, str(tmp_path), "complete").collect()


@pytest.mark.parametrize("line", ['{"task_id": "t1", "solution": "x', "no object"])
def test_broken_line_fails_the_read(spark, tmp_path, line):
    folder = tmp_path / "complete"
    folder.mkdir()
    (folder / "m--bigcodebench.jsonl").write_text('{"task_id": "t0", "solution": "y"}\n' + line + "\n")
    with pytest.raises(Exception):
        readers.read_code_files(spark, str(tmp_path), "complete").collect()


def test_rejects_are_kept_beside_what_can_be_read(spark, raw_files):
    """Cut lines, mistyped fields, foreign objects, broken maps and results; the rest is read."""
    evals, codes = raw_files / "evals", raw_files / "samples" / "complete" / "org--Some-Model-hf--bigcodebench-complete.jsonl"
    bad = ['{"task_id": "T/0", "solution": "x', "no object", "[1, 2]", '{"solution": "y"}']
    codes.write_text(bad[0] + "\n\n" + codes.read_text() + "\n".join(bad[1:]) + "\n")
    (evals / "Some_Model--instruct_eval_results.json").write_text('{"T/1": 0, "T/2": "maybe", "T/3": 1.5, "T/4": null}')
    (evals / "Cut--complete_eval_results.json").write_text('{"T/1": 0, "T/2": ')
    with open(raw_files / "tasks.jsonl", "a") as fh:
        fh.write('{"libs": "[]"}\n{"task_id":\n')
    raw = readers.RawSamples(spark, str(raw_files / "tasks.jsonl"), str(raw_files / "samples"), str(evals))
    strict = 4  # as many rows as the sound files give
    assert raw.samples().count() == strict
    found = raw.rejects.collect()
    assert sorted(r["raw"] for r in found if r["kind"] == "code") == sorted(bad)
    assert sorted((r["reason"], r["raw"]) for r in found if r["kind"] == "eval") == [
        ("no map", '{"T/1": 0, "T/2": '), ("no whole number", "T/2: maybe"), ("no whole number", "T/3: 1.5")]
    assert sorted(r["raw"] for r in found if r["kind"] == "task") == ['{"libs": "[]"}', '{"task_id":']
    counts = {(r["kind"], r["reason"]): r["n"] for r in raw.reject_counts().collect()}
    assert counts["code", "no program"] == 4 and counts["eval", "no map"] == 1
    assert {r["file"] for r in found if r["kind"] == "code"} == {codes.name}


def test_raw_files_round_trip(spark, tmp_path):
    rows = [("complete", "org--A b", "T/0", "x\n'\"ß"), ("complete", "org--A b", "T/1", ""), ("instruct", "c=d", "T/0", "y")]
    codes = spark.createDataFrame(rows, "split string, sample_model string, task_id string, solution string")
    writers.write_code_files(codes.repartition(2), str(tmp_path / "samples"))
    read = relational.union_all(*[readers.read_code_files(spark, str(tmp_path / "samples"), s) for s in readers.SPLITS])
    assert {(r["split"], r["task_id"], r["solution"]) for r in read.collect()} == {(s, t, x) for s, _, t, x in rows}
    assert {r["sample_model"] for r in read.collect()} == {"org--A b", "c=d"}
    results = codes.select("split", F.col("sample_model").alias("eval_model"), "task_id", F.lit(1).alias("status"))
    writers.write_eval_maps(results, str(tmp_path / "evals"))
    back = relational.union_all(*[readers.read_eval_maps(spark, str(tmp_path / "evals"), s) for s in readers.SPLITS])
    assert sorted(back.collect()) == sorted(results.select(back.columns).collect())
