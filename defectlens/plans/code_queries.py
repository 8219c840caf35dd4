"""Structure features of programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lib_coverage, missing_libs, parse_libs, text_or_empty
from ..operators import codefeatures, profiling
from .registry import query
from .views import CODE_FEATURES, FULL_CODE_FEATURES, code_samples

ROW_FEATURES = [
    "meta_parse_error", "classical_loc", "classical_cyclomatic_complexity", "classical_max_nesting_depth",
    "ast_if_count", "ast_for_count", "ast_while_count", "ast_try_count", "ast_except_count",
    "ast_return_count", "ast_import_count", "ast_has_error_handling", "align_lib_coverage",
    "align_missing_libs", "align_length_ratio", "smell_hardcoded_return_funcs",
    "smell_placeholder_hits", "smell_is_very_short",
]


_KIND_COUNTS = {
    "If": "ifs + deep", "For": "fors + deep", "While": "whiles + deep", "Try": "tries", "ExceptHandler": "tries",
    "FunctionDef": "1 + const + later + cls", "ClassDef": "cls", "Return": "1 + const", "Import": "i1 + i2",
    "ImportFrom": "i3", "Pass": "skip", "Raise": "later", "Expr": "doc + cls", "BoolOp": "deep",
    "Assign": "ifs + fors + whiles + 2 * tries + deep",
}


@query("code_nodes", f"""WITH {CODE_FEATURES}, kinds AS (
{' UNION ALL '.join(f"SELECT sample_id, '{kind}' AS kind, ok * ({n}) AS n FROM need" for kind, n in _KIND_COUNTS.items())})
SELECT sample_id, kind, n::BIGINT AS n FROM kinds WHERE n > 0""")
def code_nodes(spark, sf_dir):
    parsed = codefeatures.with_nodes(code_samples(spark, sf_dir).select("sample_id", "solution"), "solution")
    kinds = parsed.select("sample_id", F.explode(f"{codefeatures.PARSED}.nodes.kind").alias("kind"))
    return kinds.groupBy("sample_id", "kind").agg(F.count("*").alias("n"))


@query("code_features", f"""WITH {CODE_FEATURES}
SELECT sample_id, {', '.join(ROW_FEATURES)} FROM code_features""")
def code_features(spark, sf_dir):
    return codefeatures.extract_features(code_samples(spark, sf_dir)).select("sample_id", *ROW_FEATURES)


@query("lib_alignment", f"""WITH {CODE_FEATURES}
SELECT sample_id, CASE WHEN ok = 1 THEN concat_ws('|', CASE WHEN i1 = 1 THEN 'os' END, CASE WHEN i2 = 1 THEN 'pandas' END,
         CASE WHEN i3 = 1 THEN 'requests' END) ELSE '' END AS imported,
       CASE WHEN required = 0 THEN 1.0::DOUBLE ELSE round(found::DOUBLE / required, 4) END AS align_lib_coverage,
       required - found AS align_missing_libs
FROM need""")
def lib_alignment(spark, sf_dir):
    parsed = codefeatures.with_nodes(code_samples(spark, sf_dir).select("sample_id", "solution", "libs"), "solution")
    required, imported = parse_libs(F.col("libs")), codefeatures.imported_libs()
    return parsed.select(
        "sample_id", F.concat_ws("|", F.sort_array(imported)).alias("imported"),
        lib_coverage(required, imported).alias("align_lib_coverage"),
        missing_libs(required, imported).alias("align_missing_libs"),
    )


@query("relative_length", f"""WITH {FULL_CODE_FEATURES}
SELECT sample_id, task_id, classical_loc, smell_relative_length FROM full_features""")
def relative_length(spark, sf_dir):
    return codefeatures.feature_table(code_samples(spark, sf_dir)).select(
        "sample_id", "task_id", "classical_loc", "smell_relative_length"
    )


@query("code_features_agg", f"""WITH {FULL_CODE_FEATURES}
SELECT count(*) AS n_rows, round(avg(meta_parse_error), 6) AS parse_error_rate, round(avg(label), 6) AS pass_rate,
       1 AS n_meta, 3 AS n_classical, 8 AS n_ast, 3 AS n_align, 4 AS n_smell
FROM full_features""")
def code_features_agg(spark, sf_dir):
    return codefeatures.feature_report(codefeatures.feature_table(code_samples(spark, sf_dir)))




@query("code_feature_correlation", f"""WITH {CODE_FEATURES}, c AS (
{' UNION ALL '.join(f"SELECT '{c}' AS feature, round(corr({c}, label), 6) AS correlation FROM code_features" for c in ROW_FEATURES)})
SELECT * FROM c ORDER BY abs(correlation) DESC, feature LIMIT 10""")
def code_feature_correlation(spark, sf_dir):
    features = codefeatures.extract_features(code_samples(spark, sf_dir))
    return profiling.correlations(features, ROW_FEATURES, "label", k=10)
