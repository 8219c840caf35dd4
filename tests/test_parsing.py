"""Code features against hand-worked values."""

import warnings

import pyarrow as pa
import pytest

from defectlens.functions import parsing
from defectlens.functions.parsing import describe
from defectlens.operators.codefeatures import extract_features, feature_table

PROMPT = "Count the words of a file and return the counts as a table."
DEMOS = [
    "import os\nimport pandas as pd\ndef count(path):\n    if not os.path.exists(path):\n        return None\n"
    "    try:\n        words = open(path).read().split()\n    except OSError:\n        words = []\n"
    "    return pd.Series(words).value_counts()",
    "def count(path):\n    return 0",
    "# FIXME\ndef count(path):\n    pass",
    "from os import path\ndef count(file):\n    total = 0\n    while file:\n        total += 1\n    return total",
]
EXPECTED = {
    "meta_parse_error": [0, 0, 0, 0],
    "classical_loc": [10, 2, 2, 6],
    "classical_cyclomatic_complexity": [3, 1, 1, 2],
    "classical_max_nesting_depth": [2, 0, 0, 1],
    "ast_if_count": [1, 0, 0, 0],
    "ast_try_count": [1, 0, 0, 0],
    "ast_except_count": [1, 0, 0, 0],
    "ast_while_count": [0, 0, 0, 1],
    "ast_return_count": [2, 1, 0, 1],
    "ast_import_count": [2, 0, 0, 1],
    "ast_has_error_handling": [1, 0, 0, 0],
    "align_lib_coverage": [1.0, 0.0, 0.0, 0.5],
    "align_missing_libs": [0, 2, 2, 1],
    "align_length_ratio": [3.9322, 0.4915, 0.5593, 1.7288],
    "smell_hardcoded_return_funcs": [0, 1, 0, 0],
    "smell_placeholder_hits": [0, 0, 2, 0],
    "smell_is_very_short": [0, 1, 1, 0],
}


def features(spark, codes, prompt=PROMPT, libs="['pandas', 'requests']"):
    rows = [(i, code, prompt, libs) for i, code in enumerate(codes)]
    df = spark.createDataFrame(rows, "sample_id long, solution string, instruct_prompt string, libs string")
    return [r.asDict() for r in extract_features(df).orderBy("sample_id").collect()]


def test_demo_programs(spark):
    got = features(spark, DEMOS, libs="['pandas', 'os']")
    for name, values in EXPECTED.items():
        assert [row[name] for row in got] == pytest.approx(values), name


def test_null_and_empty_text_parse_as_empty_programs(spark):
    for row in features(spark, [None, "", "   \n"]):
        assert row["meta_parse_error"] == 0
        assert row["classical_loc"] == 0
        assert row["classical_cyclomatic_complexity"] == 0
        assert row["smell_is_very_short"] == 1


def test_syntax_error_keeps_text_features(spark):
    (row,) = features(spark, ["def f(:\n    # TODO\n\n    return 1"])
    assert row["meta_parse_error"] == 1
    assert row["classical_loc"] == 3
    assert row["classical_cyclomatic_complexity"] == 0
    assert row["ast_return_count"] == 0
    assert row["smell_placeholder_hits"] == 1
    assert row["align_lib_coverage"] == 0.0


def test_indented_snippet_parses_but_has_no_complexity(spark):
    (row,) = features(spark, ["    if x:\n        y = 1\n"])
    assert (row["meta_parse_error"], row["ast_if_count"]) == (0, 1)
    assert row["classical_cyclomatic_complexity"] == 0


def test_elif_chain_nests(spark):
    code = "if a:\n    pass\nelif b:\n    pass\nelif c:\n    pass\n"
    (row,) = features(spark, [code])
    assert row["ast_if_count"] == 3
    assert row["classical_max_nesting_depth"] == 3
    assert row["smell_placeholder_hits"] == 3
    assert row["classical_cyclomatic_complexity"] == 1


@pytest.mark.parametrize("code, hits", [
    ("def f():\n    ...\n", 1),
    ("def f():\n    raise NotImplementedError('x')\n", 1),
    ("def f():\n    raise NotImplementedError\n", 0),
    ("def f():\n    raise errors.NotImplementedError()\n", 0),
    ("x = 1  # todo: Fixme later, HACKY\n", 2),
    ("s = 'XXX'\n", 1),
])
def test_placeholders(spark, code, hits):
    assert features(spark, [code])[0]["smell_placeholder_hits"] == hits


@pytest.mark.parametrize("code, funcs", [
    ("def f():\n    return\n", 0),
    ("def f():\n    'doc'\n    return 1\n", 1),
    ("async def f():\n    return None\n", 1),
    ("def f():\n    x = 1\n    return 2\n", 0),
    ("def f():\n    return -1\n", 0),
])
def test_hardcoded_returns(spark, code, funcs):
    assert features(spark, [code])[0]["smell_hardcoded_return_funcs"] == funcs


def test_async_loops_and_with_are_told_apart(spark):
    code = "async def f():\n    async for a in b:\n        async with c:\n            for d in e:\n                pass\n"
    (row,) = features(spark, [code])
    assert row["ast_for_count"] == 1
    assert row["classical_max_nesting_depth"] == 1
    assert row["classical_cyclomatic_complexity"] == 3


@pytest.mark.parametrize("code, libs, coverage, missing", [
    ("import os.path, sys\n", "['os', 'sys']", 1.0, 0),
    ("from . import x\nfrom .pkg import y\n", "['pkg', 'x']", 0.5, 1),
    ("import numpy as np\n", "[]", 1.0, 0),
    ("import numpy as np\n", "oops", 1.0, 0),
    ("import numpy as np\n", "('numpy', 'os')", 1.0, 0),
    ("import a\n", "['a', 'b', 'c']", 0.3333, 2),
    ("import a\n", "['a', 'a', ]", 1.0, 0),
])
def test_libraries(spark, code, libs, coverage, missing):
    (row,) = features(spark, [code], libs=libs)
    assert (row["align_lib_coverage"], row["align_missing_libs"]) == (coverage, missing)


@pytest.mark.parametrize("code, lines", [
    ('def f():\n    """one\n    two\n    """\n    return 1\n', 2),
    ("x = (1,\n  # inside\n  2)\n# outside\n", 3),
    ("'''a'''  # trailing\n", 1),
    ("s = '''\n# text\n\nend'''\n", 3),
    ("a = 1 \\\n    + 2\n", 2),
])
def test_source_lines(code, lines):
    assert describe(code)["source_lines"] == lines


@pytest.mark.parametrize("code, total", [
    ("x = 1 if a else 2\n", 1),
    ("def f():\n    return [i for i in a if i if j]\n", 4),
    ("def f():\n    assert a or b\n", 2),
    ("def f():\n    for i in a:\n        pass\n    else:\n        pass\n", 3),
    ("def f():\n    if a and b or c:\n        pass\n", 4),
    ("def f():\n    def g():\n        if a:\n            pass\n    return g\n", 1),
    ("class A:\n    def f(self):\n        pass\n", 3),
    ("class A:\n    def f(self):\n        pass\n    def g(self):\n        pass\n", 4),
    ("class A:\n    x = 1\n", 1),
    ("class A:\n    class B:\n        def f(self):\n            if a:\n                pass\n", 1),
    ("@d(1 if a else 2)\ndef f(x=1 if b else 3):\n    pass\n", 1),
    ("def f(x):\n    match x:\n        case 1:\n            pass\n        case [a, b]:\n            pass\n        case _:\n            pass\n", 3),
    ("def f(x):\n    match x:\n        case 1 as y:\n            pass\n        case None:\n            pass\n", 3),
    ("if a:\n    def f():\n        try:\n            g()\n        except A:\n            pass\n        except B:\n            pass\n        else:\n            pass\n", 4),
])
def test_complexity(spark, code, total):
    assert features(spark, [code])[0]["classical_cyclomatic_complexity"] == total


def test_deep_program_does_not_fail():
    deep = "x = " + "(" * 5000 + ")" * 5000
    assert describe(deep)["nodes"] is None
    nested = "".join("  " * i + "if a:\n" for i in range(80)) + "  " * 80 + "pass\n"
    assert max(n["depth"] for n in describe(nested)["nodes"]) == 80


def test_relative_length_uses_task_median(spark):
    rows = [(1, "a", "x=1\n" * 2), (2, "a", "x=1\n" * 4), (3, "a", "x=1\n" * 9), (4, "b", ""), (5, None, "x=1\n")]
    df = spark.createDataFrame(rows, "sample_id long, task_id string, solution string")
    got = {r["sample_id"]: r["smell_relative_length"] for r in feature_table(df).collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 2.25, 4: 0.0, 5: None}


def test_a_batch_silences_warnings_once(monkeypatch):
    """Filters are set once per batch of programs, not per program, and no program warns."""
    entered, silent = [], parsing._silent
    monkeypatch.setattr(parsing, "_silent", lambda: entered.append(1) or silent())
    codes = pa.array(["x = 1 is 1\n", None, "def f(:", "y = '\\d'\n"])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        rows = parsing.parse_code.func(codes).to_pylist()
    assert len(entered) == 1
    assert [row and row["raw_ok"] for row in rows] == [True, None, False, True]
    assert rows == pa.array([describe(code) for code in codes.to_pylist()], type=parsing._PARSE_TYPE).to_pylist()
