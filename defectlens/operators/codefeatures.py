"""The 18 static features of a program, as native expressions over parsed nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import parse_code
from ..functions.text import (
    is_very_short, length_ratio, lib_coverage, marker_hits, missing_libs, nonblank_lines,
    parse_libs, text_or_empty,
)
from ..session import materialise
from .ordering import exact_quantiles
from .relational import available

PARSED = "_parsed"
FUNCTION_KINDS = ("FunctionDef", "AsyncFunctionDef")

KEY_COLUMNS = (
    "sample_id", "task_id", "model_name", "split", "fold", "label", "entry_point", "libs",
)


def with_nodes(df: DataFrame, code: str) -> DataFrame:
    """Parse each program once; null text counts as an empty program."""
    return df.withColumn(PARSED, parse_code(text_or_empty(F.col(code))))


def _nodes() -> Column:
    return F.col(f"{PARSED}.nodes")


def _count(keep) -> Column:
    return F.when(_nodes().isNull(), 0).otherwise(F.size(F.filter(_nodes(), keep)))


def count_kind(*kinds: str) -> Column:
    return _count(lambda n: n["kind"].isin(*kinds))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def placeholder_nodes() -> Column:
    """Nodes that stand for missing work: pass, a bare ellipsis, raising "not implemented" by call."""
    return _count(lambda n: (
        (n["kind"] == "Pass")
        | ((n["kind"] == "Expr") & (n["head"] == "Constant") & (n["name"] == "ellipsis"))
        | ((n["kind"] == "Raise") & (n["head"] == "Call") & (n["name"] == "NotImplementedError"))
    ))


def constant_functions() -> Column:
    """Functions whose body, bare expressions aside, is one return of a constant."""
    def alone(r: Column) -> Column:
        beside = F.filter(_nodes(), lambda n: (
            (n["parent"] == r["parent"]) & (n["role"] == "body") & (n["kind"] != "Expr")))
        owner = F.get(_nodes(), r["parent"])
        return owner["kind"].isin(*FUNCTION_KINDS) & (F.size(beside) == 1)

    return _count(lambda n: (
        (n["kind"] == "Return") & (n["head"] == "Constant") & (n["role"] == "body") & (n["parent"] >= 0) & alone(n)))


def imported_libs() -> Column:
    """First parts of the imported names, each once, in order of first sight."""
    named = F.flatten(F.transform(_nodes(), lambda n: F.coalesce(n["modules"], _none("string"))))
    return F.coalesce(F.array_distinct(F.transform(named, lambda m: F.split_part(m, F.lit("."), F.lit(1)))), _none("string"))


def nesting_depth() -> Column:
    return F.coalesce(F.array_max(F.transform(_nodes(), lambda n: n["depth"])), F.lit(0))


def source_lines(code: Column) -> Column:
    return F.coalesce(F.col(f"{PARSED}.source_lines"), nonblank_lines(code))


def _decisions(n: Column) -> Column:
    """Decision points that a node adds to the definition whose body holds it."""
    def more(k: int) -> Column:
        return (F.get(n["sizes"], F.lit(k)) > 0).cast("int")

    return (
        F.when(n["kind"].isin("If", "IfExp", "Assert"), 1)
        .when(n["kind"].isin("For", "AsyncFor", "While"), 1 + more(1))  # body, else
        .when(n["kind"] == "Try", F.get(n["sizes"], F.lit(1)) + more(2))  # body, handlers, else
        .when(n["kind"] == "BoolOp", F.get(n["sizes"], F.lit(0)) - 1)
        .when(n["kind"] == "comprehension", 1 + F.get(n["sizes"], F.lit(0)))
        .when((n["kind"] == "match_case") & ~F.coalesce(n["name"] == "any", F.lit(False)), 1)
        .otherwise(0)
    )


def complexity(code: Column) -> Column:
    """Sum over functions, methods and classes; 1 without any, 0 if blank or unparsable.

    A function or method counts one and its decisions; a class, its own and its methods' over the
    number of methods, and one if there are several. Only top-level definitions and methods of
    top-level classes count, not what is defined inside these.
    """
    nodes = _nodes()
    is_function = lambda n: n["kind"].isin(*FUNCTION_KINDS)
    counted = F.filter(
        F.transform(nodes, lambda n, i: F.struct(i.alias("at"), n["scope"].alias("scope"), n["kind"].alias("kind"))),
        lambda d: F.when(d["scope"] == -1, is_function(d) | (d["kind"] == "ClassDef")).otherwise(
            is_function(d) & (d["scope"] >= 0) & (F.get(nodes, d["scope"])["kind"] == "ClassDef")
            & (F.get(nodes, d["scope"])["scope"] == -1)))
    points = F.filter(
        F.transform(nodes, lambda n: F.struct(n["scope"].alias("scope"), _decisions(n).alias("points"))),
        lambda p: (p["points"] > 0) & (p["scope"] >= 0))

    def own(d: Column) -> Column:
        return F.aggregate(points, F.lit(1), lambda total, p: total + F.when(p["scope"] == d["at"], p["points"]).otherwise(0))

    sized = F.transform(counted, lambda d: F.struct(d["at"], d["scope"], d["kind"], own(d).alias("points")))

    def block(d: Column) -> Column:
        methods = F.filter(sized, lambda m: is_function(m) & (m["scope"] == d["at"]))
        total = F.aggregate(methods, d["points"], lambda acc, m: acc + m["points"])
        several = F.size(methods)
        return F.when((d["kind"] != "ClassDef") | (several == 0), d["points"]).otherwise(
            F.floor(total / several).cast("int") + (several > 1).cast("int"))

    total = F.aggregate(F.transform(sized, block), F.lit(0), lambda acc, c: acc + c)
    usable = F.col(f"{PARSED}.raw_ok") & (nonblank_lines(code) > 0)
    return F.when(~usable, 0).when(F.size(counted) == 0, 1).otherwise(total)


def feature_columns(code: str, prompt: str, libs: str) -> dict[str, Column]:
    """Name -> expression for every feature that needs only the row itself."""
    text = text_or_empty(F.col(code))
    required, imported = parse_libs(F.col(libs)), imported_libs()
    tries = count_kind("Try")
    placeholders = placeholder_nodes() + marker_hits(text)
    return {
        "meta_parse_error": _nodes().isNull().cast("int"),
        "classical_loc": source_lines(text),
        "classical_cyclomatic_complexity": complexity(text),
        "classical_max_nesting_depth": nesting_depth(),
        "ast_if_count": count_kind("If"),
        "ast_for_count": count_kind("For"),
        "ast_while_count": count_kind("While"),
        "ast_try_count": tries,
        "ast_except_count": count_kind("ExceptHandler"),
        "ast_return_count": count_kind("Return"),
        "ast_import_count": count_kind("Import", "ImportFrom"),
        "ast_has_error_handling": (tries > 0).cast("int"),
        "align_lib_coverage": lib_coverage(required, imported),
        "align_missing_libs": missing_libs(required, imported),
        "align_length_ratio": length_ratio(F.col(code), F.col(prompt)),
        "smell_hardcoded_return_funcs": constant_functions(),
        "smell_placeholder_hits": placeholders,
        "smell_is_very_short": is_very_short(text),
    }


def extract_features(
    df: DataFrame, code: str = "solution", prompt: str = "instruct_prompt", libs: str = "libs"
) -> DataFrame:
    """Add the parse flag and the row-local features. One Arrow pass, no shuffle."""
    missing = {c: F.lit(None).cast("string") for c in (code, prompt, libs) if c not in df.columns}
    full = df.withColumns(missing) if missing else df
    parsed = with_nodes(full, code)
    return parsed.select(
        *[F.col(c) for c in df.columns],
        *[expr.alias(name) for name, expr in feature_columns(code, prompt, libs).items()],
    )


def relative_length(
    df: DataFrame, loc: str = "classical_loc", keys: Sequence[str] = ("task_id",)
) -> DataFrame:
    """Add ``smell_relative_length`` = loc / max(median loc of the same keys, 1).

    Medians come from counts of equal values, so a task with a third of all rows is no
    single group. They are written first: with their size known, the planner need not
    shuffle the rows by task. A row without a key has no median and gets null.
    """
    keys = list(keys)
    halves = exact_quantiles(df, loc, [0.5], keys)
    medians = materialise(halves.select(*keys, F.greatest("quantile", F.lit(1.0)).alias("_median")))
    return df.join(medians, keys, "left").select(
        *df.columns, F.round(F.col(loc) / F.col("_median"), 4).alias("smell_relative_length")
    )


def feature_table(
    df: DataFrame, median_keys: Sequence[str] = ("task_id",), **columns: str
) -> DataFrame:
    """Keys and all features of a sample table, without the texts.

    The narrow table is checkpointed before the per-task median joins back to it:
    otherwise both sides of that join would parse every program again.
    ``median_keys`` is the task, plus the fold when several folds share one table.
    """
    extracted = extract_features(df, **columns)
    added = [c for c in extracted.columns if c not in df.columns]
    narrow = extracted.select(*available(df, KEY_COLUMNS), *added)
    return relative_length(materialise(narrow), keys=median_keys)


def feature_report(features: DataFrame) -> DataFrame:
    """Row, parse-error and pass rates and the number of columns per feature family."""
    families = ("meta_", "classical_", "ast_", "align_", "smell_")
    widths = {f: sum(c.startswith(f) for c in features.columns) for f in families}
    return features.agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("meta_parse_error"), 6).alias("parse_error_rate"),
        F.round(F.avg("label"), 6).alias("pass_rate"),
        *[F.lit(n).alias(f"n_{f.rstrip('_')}") for f, n in widths.items()],
    )
