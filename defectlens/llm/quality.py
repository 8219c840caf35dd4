"""Quality rules with thresholds that follow the data (DataFrame functions only).

Each text gets counts (words, symbols, repeated lines, repeated 8-word windows) and four rates
in whole steps of their unit. Per language and source a quantile sketch of every rate is kept:
the number of documents at each step. Such sketches merge by adding counts, exactly and in any
order, so partial sums go before the shuffle, a source with a third of all rows costs no more
than another, and sketches of sources merge into those of their language. A sketch has at most
``STEPS + 1`` entries.

The threshold of a rate is its upper quartile plus ``spread`` times the distance of the
quartiles plus ``slack``, the larger of the one of the (language, source) and the one of the
language, so that a small or odd source is not judged by itself alone. The thresholds are joined
back to the documents, which are kept if no rate is above its threshold and the fixed base rules
hold. A missing language or source is a group of its own. An empty or null text has no words
and fails the base rules. Equal rows are counted and judged each. Columns other than doc_id, text,
lang and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import materialise

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
STEPS = 1000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rate -> slack, in steps: thousandths, and tenths of a character for the mean word. Wide enough
#: that ordinary texts of a group in which a rate hardly varies are kept.
SLACK = {"symbol_rate": 40, "dup_line_rate": 400, "repeat_rate": 300, "mean_word": 30}
SPREAD = 6


def _window_hashes(words: Column) -> Column:
    """The hash of each window; null if there are fewer than two.

    A text whose hashes are all different, the rule, is done after one pass over a set; the
    others sort (hash, place) pairs, so that no step is quadratic in the length of the text.
    """
    last = F.size(words) - WINDOW + 1
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(last >= 2, hashes)


def _covered(hashes: Column) -> Column:
    """Covered places, from the window hashes in order of place."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ahead = F.concat(F.slice(placed, F.lit(2), F.size(placed)), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    behind = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(placed, F.lit(1), F.size(placed) - 1))
    trios = F.arrays_zip(placed.alias("own"), ahead.alias("next"), behind.alias("last"))
    double = F.filter(trios, lambda t: (t["own"]["h"] == t["next"]["h"]) | (t["own"]["h"] == t["last"]["h"]))
    return F.array_sort(F.transform(double, lambda t: t["own"]["i"]))


def _covered_words(places: Column) -> Column:
    """Size of the union of the windows at these sorted places."""
    after = F.concat(F.slice(places, F.lit(2), F.size(places)), F.array(F.lit(1 << 30)))
    return F.aggregate(
        F.zip_with(places, after, lambda a, b: F.least(b - a, F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda total, n: total + n)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the rates of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACES, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    cut = docs.select("doc_id", "lang", "source", text.alias("text"), words.alias("words"), lines.alias("lines"))
    counted = cut.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _window_hashes(F.col("words")).alias("hashes"),
    )
    places = F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), _covered(F.col("hashes")))
    placed = counted.withColumn("places", places).drop("hashes")
    counted = placed.withColumn(
        "n_repeat_words", F.when(F.col("places").isNull(), F.lit(0)).otherwise(_covered_words(F.col("places")))
        .cast("long")).drop("places")
    return counted.select(
        "*",
        F.expr(f"least(({STEPS} * n_symbols) div greatest(word_chars, 1), {STEPS})").alias("symbol_rate"),
        F.expr(f"({STEPS} * n_dup_lines) div greatest(n_lines, 1)").alias("dup_line_rate"),
        F.expr(f"({STEPS} * n_repeat_words) div greatest(n_words, 1)").alias("repeat_rate"),
        F.expr(f"least((10 * word_chars) div greatest(n_words, 1), {STEPS})").alias("mean_word"),
        ((F.col("n_words") < MIN_WORDS)
         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def sketches(rates: DataFrame) -> DataFrame:
    """(lang, source, rate, step, n): the mergeable sketch of each rate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("step")) for r in SLACK]))
    return (
        rates.select("lang", "source", pairs.alias("p"))
        .groupBy("lang", "source", F.col("p.rate").alias("rate"), F.col("p.step").alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _fences(sketch: DataFrame, *group: str) -> DataFrame:
    """The threshold of each rate of each group, one column per rate."""
    whole = Window.partitionBy(*group, "rate")
    running = sketch.select(
        *group, "rate", "step", F.sum("n").over(whole.orderBy("step")).alias("upto"),
        F.sum("n").over(whole).alias("all"))
    quartiles = running.groupBy(*group, "rate").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("step"))).alias("low"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("step"))).alias("high"))
    slack = F.create_map(*[F.lit(x) for pair in SLACK.items() for x in pair])
    fence = F.col("high") + SPREAD * (F.col("high") - F.col("low")) + slack[F.col("rate")]
    wide = quartiles.withColumn("fence", fence).groupBy(*group)
    return wide.agg(*[F.max(F.when(F.col("rate") == r, F.col("fence"))).alias(f"max_{r}") for r in SLACK])


def thresholds(rates: DataFrame) -> DataFrame:
    """lang, source and ``max_<rate>`` for each rate."""
    fine = sketches(rates)
    coarse = fine.groupBy("lang", "rate", "step").agg(F.sum("n").alias("n"))
    own = _fences(fine, "lang", "source")
    shared = _fences(coarse, "lang").withColumnRenamed("lang", "of")
    for r in SLACK:
        shared = shared.withColumnRenamed(f"max_{r}", f"all_{r}")
    return own.join(shared, F.col("lang").eqNullSafe(F.col("of"))).select(
        "lang", "source", *[F.greatest(f"max_{r}", f"all_{r}").alias(f"max_{r}") for r in SLACK])


def judge(docs: DataFrame) -> DataFrame:
    """The measured rows with base_failed and kept."""
    rates = materialise(measured(docs))
    limits = materialise(thresholds(rates)).select(
        F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[f"max_{r}" for r in SLACK])
    within = F.lit(True)
    for r in SLACK:
        within = within & (F.col(r) <= F.col(f"max_{r}"))
    joined = rates.join(
        limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop("of_lang", "of_source")
