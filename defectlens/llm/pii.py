"""Personal data in texts: patterns propose, checksums confirm, context decides (native).

Every kind has one pattern, found leftmost and without overlaps, and a rule that confirms or
drops a find; a dropped find is not tried again at another place. Base kinds: email, ip (parts
up to 255), card (13 to 19 digits, Luhn), phone (a plus sign and 9 to 15 digits). Added by the
method: iban (mod-97), and numbers of 7 to 14 digits that are no proof by themselves and are
scored: ``NUMBER_SCORE`` plus ``CONTEXT_SCORE`` if a word such as "tel" or "passport" stands
within ``CONTEXT_CHARS`` characters before, reported from ``REPORT_FROM`` on and only outside
other spans. Base spans never depend on context.

Places are code points, the end is exclusive. They come from the texts between the finds:
patterns have no outside condition that could tell one equal string from another, so splitting
by a pattern and listing its finds give the same cuts. Patterns are possessive where that changes
nothing, and start only where a longer find could not have started before, so that time grows in
proportion to the text. A pattern runs only over texts that hold its rarest needed character.

A null text counts as empty; equal rows are searched each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
    "iban": "\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b",
    "number": "[0-9](?:[ ./-]?[0-9]){6,13}+",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
BASE = ("email", "ip", "card", "phone")
CONTEXT = "(?i)\\b(?:tel|phone|mobile|call|fax|ssn|passport|account|konto|iban|telefon|tél|teléfono)\\b"
CONTEXT_CHARS = 40
NUMBER_SCORE, CONTEXT_SCORE, REPORT_FROM = 40, 40, 60
#: Finds whose places are added up together.
PART = 128
_SPANS = "array<struct<start:int,end:int,found:string>>"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, less 9 above 9; the sum ends in 0."""
    size = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), size), F.lit(0),
        lambda sum_, i: sum_ + F.when(
            (size - i) % 2 == 1,
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                         F.substring(digits, i, F.lit(1)).cast("int") + 1),
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def _mod97(found: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(found, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(moved)), F.lit(0),
        lambda r, i: F.when(
            F.substring(moved, i, F.lit(1)).between("0", "9"),
            (r * 10 + F.substring(moved, i, F.lit(1)).cast("int")) % 97,
        ).otherwise((r * 100 + F.ascii(F.substring(moved, i, F.lit(1))) - 55) % 97),
    )
    return rest == 1


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # A part of more than nine digits is above 255 unless zeros lead; they are cut first.
        return F.forall(F.split(found, "\\."), lambda p: F.coalesce(
            F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        size = F.length(_digits(found))
        return F.when(size.between(13, 19), _luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(found, " ", "")).between(15, 34) & _mod97(found)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(gaps: Column, finds: Column) -> Column:
    """Places of finds between gaps, in parts of ``PART`` finds so that no array grows find by find."""
    def walked(steps: Column, start: Column) -> Column:
        return F.aggregate(
            steps, F.struct(start.alias("at"), F.array().cast(_SPANS).alias("spans")),
            lambda done, x: F.struct(
                (done["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(done["spans"], F.array(F.struct(
                    (done["at"] + x["gap"]).alias("start"), (done["at"] + x["gap"] + x["size"]).alias("end"),
                    x["found"].alias("found")))).alias("spans")),
            lambda done: done["spans"])

    def parted(steps: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / PART).cast("int"))
        own = F.transform(parts, lambda k: F.slice(steps, k * PART + 1, PART))
        sizes = F.transform(own, lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
        starts = F.aggregate(
            sizes, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
        return F.flatten(F.zip_with(own, F.slice(starts, 1, F.size(own)), walked))

    steps = F.zip_with(F.slice(gaps, 1, F.size(finds)), finds, lambda gap, found: F.struct(
        F.length(gap).alias("gap"), F.length(found).alias("size"), found.alias("found")))
    return F.when(F.size(finds) == 0, F.array().cast(_SPANS)).otherwise(_let(steps, parted))


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, found>> of the confirmed finds of one kind; null if none is possible."""
    pattern = PATTERNS[kind]
    placed = _let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda finds: _placed(F.split(text, pattern, -1), finds))
    possible = text.contains(NEEDS[kind]) if kind in NEEDS else F.col("has_digit")
    return F.when(possible, F.filter(placed, lambda s: _confirmed(kind, s["found"])))


def _meets(spans: Column, n: Column) -> Column:
    """Whether one of the spans of a kind, which are apart and in order, overlaps ``n``: the last one
    that starts before its end does, or none. It is found by halves."""
    steps = F.transform(
        F.sequence(F.floor(F.log2(F.size(spans) + 1)).cast("int"), F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))

    def onward(at: Column, step: Column) -> Column:
        reached = (at + step <= F.size(spans)) & (F.get(spans, at + step - 1)["start"] < n["end"])
        return F.when(reached, at + step).otherwise(at)

    last = F.aggregate(steps, F.lit(0), onward)
    return F.coalesce(F.get(spans, last - 1)["end"] > n["start"], F.lit(False))


def _contexts(text: Column) -> Column:
    """Whether a word of ``CONTEXT`` is near, for each number in turn. A number has seven characters at
    least, so what stands before it is within the gap and a few gaps and numbers before that."""
    pattern, back = PATTERNS["number"], -(-CONTEXT_CHARS // 7)

    def near(finds: Column, gaps: Column, i: Column) -> Column:
        first = F.greatest(i - back, F.lit(1))
        earlier = F.zip_with(F.slice(gaps, first, i - first), F.slice(finds, first, i - first), lambda g, f: F.concat(g, f))
        before = F.concat(F.array_join(earlier, ""), F.get(gaps, i - 1))
        return F.right(before, F.lit(CONTEXT_CHARS)).rlike(CONTEXT)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda finds: _let(
        F.split(text, pattern, -1), lambda gaps: F.when(F.size(finds) > 0, F.transform(
            F.sequence(F.lit(1), F.size(finds)), lambda i: near(finds, gaps, i)))))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and, for each kind, ``<kind>s``: array of (start, end, found)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("has_digit", F.col("text").rlike("[0-9]"))
    nothing = F.array().cast(_SPANS)
    spans = rows.select("doc_id", "text", _contexts(F.col("text")).alias("near"), *[
        F.coalesce(_spans(F.col("text"), k), nothing).alias(f"{k}s") for k in PATTERNS])

    def apart(n: Column) -> Column:
        return ~reduce(or_, [_meets(F.col(f"{k}s"), n) for k in PATTERNS if k != "number"])

    def score(near: Column) -> Column:
        return F.lit(NUMBER_SCORE) + F.when(near, CONTEXT_SCORE).otherwise(0)

    judged = F.zip_with("numbers", "near", lambda n, near: F.struct(n.alias("n"), score(near).alias("score")))
    kept = F.filter(judged, lambda x: (x["score"] >= REPORT_FROM) & apart(x["n"]))
    return spans.withColumn("numbers", F.coalesce(F.transform(kept, lambda x: x["n"]), nothing)).drop("near")


def digest(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets.

    Spans are cut from the left; one that overlaps an earlier one goes with it.
    """
    found = find_spans(docs)

    def named(kind: str) -> Column:
        return F.transform(F.col(f"{kind}s"), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    marked = F.array_sort(F.concat(*[named(k) for k in PATTERNS]))
    folded = F.aggregate(
        marked, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda done, s: F.when(s["start"] < done["at"], F.struct(
            F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))).otherwise(F.struct(
                s["end"].alias("at"),
                F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"]),
                         F.lit("["), s["kind"], F.lit("]")).alias("out"))),
        lambda done: F.concat(done["out"], F.substr(F.col("text"), done["at"] + 1)))
    return found.select("doc_id", folded.alias("text"))
