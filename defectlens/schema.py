"""Table schemas, feature names and the fixed lookup values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

TASKS = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("complete_prompt", T.StringType()),
    T.StructField("instruct_prompt", T.StringType()),
    T.StructField("libs", T.StringType()),
    T.StructField("entry_point", T.StringType()),
])

CODE_LINES = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("solution", T.StringType()),
])

SAMPLES = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("solution", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("complete_prompt", T.StringType()),
    T.StructField("instruct_prompt", T.StringType()),
    T.StructField("libs", T.StringType()),
    T.StructField("entry_point", T.StringType()),
])

REQUIRED_SAMPLE_COLUMNS = ("task_id", "model_name", "solution", "label", "instruct_prompt")

# Feature column -> display label.
FEATURE_LABELS = {
    "classical_loc": "Lines of code",
    "classical_cyclomatic_complexity": "Cyclomatic complexity",
    "classical_max_nesting_depth": "Max nesting depth",
    "ast_if_count": "If-statement count",
    "ast_for_count": "For-loop count",
    "ast_while_count": "While-loop count",
    "ast_try_count": "Try-block count",
    "ast_except_count": "Except-handler count",
    "ast_return_count": "Return count",
    "ast_import_count": "Import count",
    "ast_has_error_handling": "Has error handling",
    "align_lib_coverage": "Library coverage",
    "align_missing_libs": "Missing libraries",
    "align_length_ratio": "Code/prompt length ratio",
    "smell_hardcoded_return_funcs": "Hardcoded returns",
    "smell_placeholder_hits": "Placeholder patterns",
    "smell_is_very_short": "Very short solution",
    "smell_relative_length": "Relative length",
}

FEATURE_COLUMNS = list(FEATURE_LABELS)

# Sample-file model id -> evaluation model name, for the names
# that normalisation alone does not match.
MODEL_ALIASES = {
    "codellama--CodeLlama-7b-Instruct-hf": "CodeLlama_7B_Instruct",
    "codellama--CodeLlama-13b-Instruct-hf": "CodeLlama_13B_Instruct",
    "codellama--CodeLlama-34b-Instruct-hf": "CodeLlama_34B_Instruct",
    "codellama--CodeLlama-70b-Instruct-hf": "CodeLlama_70B_Instruct",
    "mistralai--Mixtral-8x22B-Instruct-v0.1": "Mixtral_8x22B_Instruct",
    "mistralai--Mistral-7B-Instruct-v0.3": "Mistral_7B_Instruct_v0.3",
    "gemini-1.5-flash": "Gemini_1.5_Flash_API_0514",
    "gemini-1.5-pro": "Gemini_1.5_Pro_API_0514",
    "google--codegemma-7b-it": "CodeGemma_7B_Instruct",
    "google--gemma-2-9b-it": "Gemma_2_9B_Instruct",
    "meta-llama--Meta-Llama-3-8B-Instruct": "Llama_3_8B_Instruct",
    "meta-llama--Meta-Llama-3-70B-Instruct": "Llama_3_70B_Instruct",
    "meta-llama--Meta-Llama-3.1-8B-Instruct": "Llama_3_8B_Instruct",
    "meta-llama--Meta-Llama-3.1-70B-Instruct": "Llama_3_70B_Instruct",
    "bigcode--starcoder2-15b-instruct-v0.1": "StarCoder2_15B_Instruct_v0.1",
    "CohereForAI--c4ai-command-r-plus": "Command_R_plus",
    "ibm-granite--granite-3b-code-instruct": "Granite_Code_3B_Instruct",
    "ibm-granite--granite-8b-code-instruct": "Granite_Code_8B_Instruct",
    "ibm-granite--granite-20b-code-instruct": "Granite_Code_20B_Instruct",
    "ibm-granite--granite-34b-code-instruct": "Granite_Code_34B_Instruct",
}

# Model family -> evaluation model names.
MODEL_FAMILIES = {
    "GPT": [
        "GPT_3.5_Turbo_0125", "GPT_4_0613",
        "GPT_4_Turbo_2024_04_09", "GPT_4o_2024_05_13",
    ],
    "Claude": [
        "Claude_3_Haiku_20240307", "Claude_3_Sonnet_20240229",
        "Claude_3_Opus_20240229", "Claude_3.5_Sonnet_20240620",
    ],
    "Llama": [
        "Llama_3_70B_Instruct", "Llama_3_8B_Instruct",
        "CodeLlama_7B_Instruct", "CodeLlama_13B_Instruct",
        "CodeLlama_34B_Instruct", "CodeLlama_70B_Instruct",
        "Hermes_2_Theta_Llama_3_70B",
        "ReflectionCoder_CL_7B", "ReflectionCoder_CL_34B",
        "WaveCoder_Ultra_6.7B",
    ],
    "DeepSeek": [
        "DeepSeek_Coder_1.3B_Instruct", "DeepSeek_Coder_6.7B_Instruct",
        "DeepSeek_Coder_33B_Instruct", "DeepSeek_Coder_V2_Instruct",
        "DeepSeek_Coder_V2_Lite_Instruct", "DeepSeek_V2_Chat",
        "Magicoder_S_DS_6.7B",
        "OpenCodeInterpreter_DS_1.3B", "OpenCodeInterpreter_DS_6.7B",
        "ReflectionCoder_DS_6.7B", "ReflectionCoder_DS_33B",
        "AutoCoder_S_6.7B",
    ],
    "Mistral": [
        "Mistral_7B_Instruct_v0.3", "Mistral_Small_2402",
        "Mistral_Large_2402", "Mixtral_8x22B_Instruct",
        "Codestral_22B_v0.1",
    ],
    "Qwen": [
        "Qwen1.5_32B_Chat", "Qwen1.5_72B_Chat", "Qwen1.5_110B_Chat",
        "Qwen2_72B_Chat", "CodeQwen1.5_7B_Chat",
        "AutoCoder_QW_7B",
    ],
}
