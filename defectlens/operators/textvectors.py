"""Word and character TF-IDF over program texts.

A text is first reduced to a list of units with counts: its word terms, or its padded words, from
which the character terms are cut. Units are made once per document; vocabularies and weights of
any subset of documents then work on these lists. Terms are counted inside their document
(:mod:`..functions.counting`): nothing is grouped by document and term, and what moves are texts
at most once and counts per distinct unit. The vocabulary has at most ``max_features`` rows by
construction, which is what makes it safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import counting
from ..functions.text import identifiers, text_or_empty
from ..session import materialise

MAX_FEATURES = 10_000
WORD_SIZES = (1, 2)
CHAR_SIZES = (2, 4)

#: Bytes of text that a task cuts into units, some: what it holds while it counts them does not grow with the table.
PART_BYTES = 8 << 20

# The vocabulary is broadcast, so it may have this many rows at most.
_BROADCAST_TERMS = 100_000


def with_pairs(tokens: Column) -> Column:
    """``tokens`` and their adjacent pairs."""
    following = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), following,
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, pairs)


def padded_words(text: Column) -> Column:
    """Blank-separated words of the lower-cased text, each with a space at both ends."""
    words = F.split(F.lower(text_or_empty(text)), r"(?U)[\s\x1c-\x1f]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def cut_words(words: DataFrame, *keep: str) -> DataFrame:
    """(keep, term): all substrings of the padded words in ``unit`` with 2 to 4 characters.

    One row per start position, then one per length: both steps are compiled generators,
    which array lambdas are not.
    """
    shortest, longest = CHAR_SIZES
    word, length = F.col("unit"), F.length("unit")
    starts = words.select(
        *keep, "unit", F.explode(F.sequence(F.lit(1), length - (shortest - 1))).alias("_at")
    )
    at = F.col("_at")
    cuts = [
        F.when(at + n - 1 <= length, F.substring(word, at, F.lit(n)))
        for n in range(shortest, longest + 1)
    ]
    return starts.select(*keep, F.explode(F.array(*cuts)).alias("term")).where(F.col("term").isNotNull())


def _word_list(text: Column) -> Column:
    # Tokens are bound once: the token search would run again at every mention.
    found = F.array(identifiers(F.lower(text_or_empty(text))))
    return counting.counted(F.get(F.transform(found, with_pairs), F.lit(0)))


def _padded_list(text: Column) -> Column:
    return counting.counted(padded_words(text))


#: Units of one text with their counts, as an array of (unit, n). A repeated word is cut into its
#: substrings once, not once per use.
UNIT_LISTS = {"word": _word_list, "char": _padded_list}

#: Lengths of the substrings that are the terms of a unit; none: the unit itself.
_CUTS = {"word": (), "char": tuple(range(CHAR_SIZES[0], CHAR_SIZES[1] + 1))}


def _per_document(df: DataFrame, ident: str, units: Column, *carry: str) -> DataFrame:
    """A row per document: the lists of an id that has several rows are added up. Only the units of
    such ids are grouped; one look at the ids tells whether there are any."""
    listed = lambda part: part.select(ident, *carry, units.alias("units"))
    repeated = df.groupBy(F.col(ident).alias("_again")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_again")
    if repeated.isEmpty():
        return listed(df)
    again = F.col(ident).eqNullSafe(F.col("_again"))
    rows = unit_rows(listed(df.join(repeated, again, "left_semi")), ident, *carry)
    sums = rows.groupBy(ident, *carry, "unit").agg(F.sum("n").alias("n"))
    gathered = sums.groupBy(ident, *carry).agg(F.sort_array(F.collect_list(F.struct("unit", "n"))).alias("units"))
    return listed(df.join(repeated, again, "left_anti")).unionByName(gathered)


def _dealt(df: DataFrame, ident: str, text: str) -> DataFrame:
    n_bytes = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(1, -(-n_bytes // PART_BYTES)), ident)


def _units(kind: str):
    def units(df: DataFrame, ident: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
        """(id, units): the counted units of each document. ``carry`` names columns of the document
        to keep, so that later filters need no join. Texts are dealt out by id, some ``PART_BYTES`` a
        part, as few files may hold them all; nothing else moves."""
        return _per_document(_dealt(df.select(ident, *carry, text), ident, text), ident, UNIT_LISTS[kind](F.col(text)), *carry)

    return units


word_units, char_units = _units("word"), _units("char")
UNITS = {"word": word_units, "char": char_units}


def unit_rows(units: DataFrame, *keep: str) -> DataFrame:
    """(keep, unit, n), a row per unit.

    A plain explode implies a filter on the list, for which every text would be cut once more before
    it is dealt out; an outer one implies none."""
    return units.select(*keep, F.explode_outer("units").alias("_u")).where("_u IS NOT NULL").select(*keep, "_u.unit", "_u.n")


def cut_terms(units: DataFrame, kind: str, *keep: str) -> DataFrame:
    if kind == "word":
        return units.select(*keep, F.col("unit").alias("term"), "n")
    return cut_words(units, *keep, "n")


def term_counts(units: DataFrame, ident: str, kind: str) -> DataFrame:
    """(id, term, tf)."""
    terms = counting.term_counter(_CUTS[kind])(F.col("units"))
    return units.select(ident, F.explode(terms).alias("_t")).select(ident, "_t.term", "_t.tf")


def vocabulary(units: DataFrame, kind: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, total, idx): the most frequent terms, ties by term, numbered by term order.

    Units are counted over the corpus before they are cut, so there is never a row per
    document and character term. The window sees ``max_features`` rows at most.
    """
    corpus = unit_rows(units).groupBy("unit").agg(F.sum("n").alias("n"))
    totals = cut_terms(corpus, kind).groupBy("term").agg(F.sum("n").alias("total"))
    return number_terms(top_terms(totals, max_features))


def top_terms(totals: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The most frequent terms of (term, total), ties by term; those of no use are none."""
    return totals.where("total > 0").orderBy(F.desc("total"), "term").limit(max_features)


def number_terms(vocab: DataFrame) -> DataFrame:
    """A vocabulary with ``idx``, by term order."""
    by_term = Window.partitionBy(F.lit(0)).orderBy("term")
    return vocab.withColumn("idx", F.row_number().over(by_term) - 1)


def bounded(table: DataFrame, rows: int) -> DataFrame:
    if rows > _BROADCAST_TERMS:
        raise ValueError(f"a vocabulary may have {_BROADCAST_TERMS} terms, not {rows}")
    return F.broadcast(table)


def by_place(vocab: DataFrame, max_features: int, *columns: str, place: str = "idx") -> list[list]:
    """Columns of a vocabulary as lists in order of place. It is bounded, so it may pass the driver."""
    named = dict.fromkeys([place, *columns])
    rows = sorted(bounded(vocab.select(*named), max_features).collect(), key=lambda r: r[place])
    return [[r[c] for r in rows] for c in columns]


def known_counts(kind: str, terms: Sequence[str], units: str | Column = "units") -> Column:
    """The counts of a document's terms that are in a vocabulary, by place: (idx, tf), two lists."""
    shared = SparkContext.getOrCreate().broadcast(list(terms))
    return counting.known_counter(shared, _CUTS[kind])(F.col(units) if isinstance(units, str) else units)


def weighed(counts: str | Column, idf: Sequence[float], places: Sequence[int] | None = None) -> Column:
    """(idx, weight), two lists, from :func:`known_counts`: (1 + ln tf) * idf, of unit length.

    ``places`` gives the places counted by another vocabulary their place in this one, or -1; it
    keeps their order."""
    moved = np.arange(len(idf)) if places is None else np.asarray(places, dtype=np.int64)
    shared = SparkContext.getOrCreate().broadcast((moved, np.asarray(idf, dtype=float)))
    return counting.weigher(shared)(F.col(counts) if isinstance(counts, str) else counts)


def document_frequency(counts: DataFrame, *keep: str, column: str = "counts") -> DataFrame:
    """(keep, idx, df): in how many documents the term of each place is."""
    places = counts.select(*keep, F.explode(f"{column}.idx").alias("idx"))
    return places.groupBy(*keep, "idx").agg(F.count("*").alias("df"))


def weight_rows(lists: DataFrame, ident: str, column: str = "weights") -> DataFrame:
    """(id, idx, weight), a row per entry."""
    entries = F.explode(F.arrays_zip(F.col(f"{column}.idx"), F.col(f"{column}.weight"))).alias("_e")
    return lists.select(ident, entries).select(ident, "_e.idx", "_e.weight")


def inverse_frequency(n_documents: Column, df: Column) -> Column:
    return F.log((1 + n_documents) / (1 + df)) + 1


def _with_idf(frequency: DataFrame, n_documents: Column) -> DataFrame:
    return frequency.withColumn("idf", inverse_frequency(n_documents, F.col("df")))


def fit_tfidf(
    units: DataFrame, ident: str, kind: str, n_documents: Column, max_features: int = MAX_FEATURES
) -> DataFrame:
    """The fitted vectoriser as a table: term, idx, df, idf. Save it like any table."""
    if kind == "word":
        # A word term is a unit: corpus and document counts come from the same aggregate.
        totals = unit_rows(units).groupBy(F.col("unit").alias("term")).agg(
            F.sum("n").alias("total"), F.count("*").alias("df")
        )
        top = totals.orderBy(F.desc("total"), "term").limit(max_features)
        by_term = Window.partitionBy(F.lit(0)).orderBy("term")
        counted = top.select("term", (F.row_number().over(by_term) - 1).alias("idx"), "df")
    else:
        vocab = materialise(vocabulary(units, kind, max_features))
        terms, = by_place(vocab, max_features, "term")
        counts = units.select(known_counts(kind, terms).alias("counts"))
        counted = bounded(vocab.select("term", "idx"), max_features).join(
            document_frequency(counts), "idx").select("term", "idx", "df")
    return _with_idf(counted, n_documents)


def tfidf_weights(
    units: DataFrame, ident: str, kind: str, fitted: DataFrame, max_features: int = MAX_FEATURES
) -> DataFrame:
    """(id, idx, weight) under a fitted vectoriser: (1 + ln tf) * idf, of unit length per document."""
    return weight_rows(units.select(ident, listed_weights(kind, fitted, max_features).alias("weights")), ident)


def listed_weights(kind: str, fitted: DataFrame, max_features: int = MAX_FEATURES, units: str | Column = "units") -> Column:
    """The weights of a document's units under a fitted vectoriser: (idx, weight), two lists."""
    terms, idf, places = by_place(fitted, max_features, "term", "idf", "idx")
    return weighed(known_counts(kind, terms, units), idf, places)


@dataclass
class Fitted:
    """The vectorisers of some kinds of units, by kind, and the rows with their weights.

    ``rows`` has the documents' other columns, and by the name of each kind (idx, weight) as two lists.
    """

    ident: str
    vectorisers: dict[str, DataFrame]
    rows: DataFrame

    def items(self):
        """Per kind the vectoriser, and the weights as (id, idx, weight)."""
        return [(kind, (fitted, weight_rows(self.rows, self.ident, kind))) for kind, fitted in self.vectorisers.items()]

    @property
    def widths(self) -> dict[str, int]:
        return {kind: fitted.count() for kind, fitted in self.vectorisers.items()}


def fit_documents(
    documents: DataFrame, ident: str, kinds: Sequence[str], n_documents: Column, max_features: int = MAX_FEATURES,
    train: Column | None = None,
) -> Fitted:
    """Vectorisers for several kinds of units, and the weights of all documents under them.

    ``documents`` has a column of counted units by the name of each kind; ``train`` tells the
    documents to fit on by the other columns. Terms are cut, looked up and counted once, in a
    written table of places and counts by document: frequencies and weights both follow from it,
    row by row, and the blocks of a document never part.
    """
    flag = F.lit(True) if train is None else train
    others = [c for c in documents.columns if c not in kinds]
    vocabularies = {kind: materialise(vocabulary(
        documents.where(flag).select(F.col(f"`{kind}`").alias("units")), kind, max_features)).select("term", "idx") for kind in kinds}
    counts = materialise(documents.select(*others, *[
        known_counts(kind, by_place(vocabularies[kind], max_features, "term")[0], kind).alias(kind) for kind in kinds]))
    vectorisers, weights = {}, []
    for kind in kinds:
        frequency = document_frequency(counts.where(flag), column=kind)
        fitted = materialise(_with_idf(bounded(vocabularies[kind], max_features).join(frequency, "idx"), n_documents).select(
            "term", "idx", "df", "idf"))
        vectorisers[kind] = fitted
        idf, = by_place(fitted, max_features, "idf")
        weights.append(weighed(kind, idf).alias(kind))
    return Fitted(ident, vectorisers, counts.select(*others, *weights))


def fit_and_weigh(
    units: DataFrame, ident: str, kind: str, n_documents: Column, max_features: int = MAX_FEATURES,
    train: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The fitted vectoriser, and the weights of all documents under it, (id, idx, weight).

    ``train`` tells the units to fit on, by columns that ride along with them.
    """
    found = fit_documents(units.withColumnRenamed("units", kind), ident, [kind], n_documents, max_features, train)
    return dict(found.items())[kind]


def with_term(weights: DataFrame, fitted: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """Weights with the term of each position."""
    return weights.join(bounded(fitted.select("idx", "term"), max_features), "idx")


def assemble(
    static: DataFrame, features: list[str], blocks: list[DataFrame], widths: list[int],
    ident: str = "sample_id", out: str = "features",
) -> DataFrame:
    """One sparse vector per row: static features first, then each block of (id, idx, weight)
    shifted behind the ones before it. Rows without any block term keep their static part.

    The vector is the struct that the vector type is stored as; :func:`as_vectors` reads it.
    """
    joined = static
    for number, block in enumerate(blocks):
        # Bounded by the vocabulary, never by the text length.
        entries = F.sort_array(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "weight")))
        listed = block.groupBy(ident).agg(entries.alias("_e")).select(
            ident, F.struct(F.col("_e.idx").alias("idx"), F.col("_e.weight").alias("weight")).alias(f"_e{number}"))
        joined = joined.join(listed, ident, "left")
    names = [f"_e{number}" for number in range(len(blocks))]
    return assemble_lists(joined, features, dict(zip(names, widths)), out)


def assemble_lists(rows: DataFrame, features: list[str], widths: dict[str, int], out: str = "features") -> DataFrame:
    """The same from blocks that lie in the rows, as (idx, weight) lists by the column names of ``widths``."""
    fixed = F.filter(
        F.array(*[
            F.struct(F.lit(i).alias("i"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("w"))
            for i, f in enumerate(features)
        ]),
        lambda e: e["w"] != 0,
    )
    start, indices, values = len(features), [F.col("_fixed.i")], [F.col("_fixed.w")]
    for block, width in widths.items():
        shift = F.lit(start)
        places = F.transform(F.col(f"{block}.idx"), lambda i: i + shift)  # noqa: B023, called at once
        indices.append(F.coalesce(places, F.array().cast("array<int>")))
        values.append(F.coalesce(F.col(f"{block}.weight"), F.array().cast("array<double>")))
        start += width
    return rows.withColumn("_fixed", fixed).select(
        *[c for c in rows.columns if c not in widths],
        F.struct(
            F.lit(0).cast("tinyint").alias("type"), F.lit(start).cast("int").alias("size"),
            F.concat(*indices).alias("indices"), F.concat(*values).alias("values"),
        ).alias(out),
    )


def as_vectors(assembled: DataFrame, column: str = "features") -> DataFrame:
    """Write the rows and read the struct column as vectors; no row passes through Python."""
    schema = T.StructType([
        T.StructField(f.name, VectorUDT(), f.nullable) if f.name == column else f for f in assembled.schema
    ])
    return materialise(assembled, schema)
