"""Quality rules: base counts, and divergence from the references of a language.

Everything is DataFrame expressions. Rows are documents (``doc_id``, ``text``, ``lang``);
other columns are ignored by ``measure`` and kept by ``keep``. A NULL text
has no words and fails the base rule, as does an empty one. A NULL language
is compared with the reference of all NULL languages together. Texts of any length are read whole. Rows are judged on
their own, repeated rows alike. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged
from .common import SPACE

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8  # a window is a power of two
SYMBOLS = "#*$%&|<>"

#: Common words of a language: the most frequent ones up to this length.
COMMON_WORDS, COMMON_LENGTH = 16, 6
#: Largest Jensen-Shannon distance (base 2) from the reference, for either histogram.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.33
#: Shorter texts are not compared: their histograms are too rough.
MIN_CLASS_CHARS, MIN_COMPARED_WORDS = 200, 40
#: Below so many words chance alone moves the word histogram: the bound is then this one times the root of ``STEADY_WORDS / words``.
STEADY_WORDS, SHORT_WORD_DISTANCE = 100, 0.36

# Character classes after lower-case letters and blanks, each taken out of what the classes before it left.
_CLASSES = (r"\p{Lu}", r"[.,;:'\"()?\-]", r"\p{Nd}", r"\p{L}")
# What ``SPACE`` stands for.
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Words of a text; an empty array for NULL, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return bound(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACE}]+")))


def is_short(word: Column) -> Column:
    return F.length(word).between(1, COMMON_LENGTH)


def short_words(words: Column) -> Column:
    """Of the words of a text those of at most ``COMMON_LENGTH`` code points in lower case."""
    return F.filter(F.split(F.lower(F.array_join(words, " ")), " "), is_short)


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("bigint")


def class_counts(text: Column, word_chars: Column | None = None) -> Column:
    """Characters of each class, and all others last; see ``_classes``."""
    return bound(_classes(text, word_chars), lambda c: c["counts"])


def _classes(text: Column, word_chars: Column | None = None) -> Column:
    """``counts``: lower-case letters, blanks, ``_CLASSES`` and all others; ``rest``: the text of those others.

    Matches cost more than characters. Where ``word_chars`` is known, so are the blanks, and
    letters and blanks are taken out together.
    """

    def taken(rest: Column, what: str, use: Callable[[Column, Column], Column]) -> Column:
        less = F.regexp_replace(rest, f"{what}+", "")
        return bound(less, lambda less: use(less, (F.length(rest) - F.length(less)).cast("bigint")))

    def count(rest: Column, classes: tuple[str, ...], found: tuple[Column, ...]) -> Column:
        if not classes:
            return F.struct(F.array(*found, F.length(rest).cast("bigint")).alias("counts"), rest.alias("rest"))
        return taken(rest, classes[0], lambda less, n: count(less, classes[1:], (*found, n)))

    def first(whole: Column) -> Column:
        if word_chars is None:
            return count(whole, (r"\p{Ll}", r"\s", *_CLASSES), ())
        blanks = F.length(whole).cast("bigint") - word_chars
        return taken(whole, r"[\p{Ll}\s]", lambda less, n: count(less, _CLASSES, (n - blanks, blanks)))

    return bound(F.coalesce(text, F.lit("")), first)


def _doubled(marks: Column, span: int) -> Column:
    """From hashes of all windows of ``span`` words those of twice the length; the last ones are of shorter windows."""
    later = lambda m: F.slice(m, span + 1, F.greatest(F.size(m) - span, F.lit(0)))
    return bound(marks, lambda m: F.zip_with(m, later(m), lambda a, b: F.xxhash64(a, b)))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text."""
    zero = F.lit(0).cast("bigint")

    def covered(marks: Column) -> Column:
        """Windows sorted by hash: equal neighbours are repeated; then the union of their spans."""
        # sort_array and not array_sort, which would call a lambda for every comparison.
        ordered = F.sort_array(F.transform(marks, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
        places = bound(ordered, lambda o: F.sort_array(F.transform(
            F.filter(o, lambda w, i: (F.get(o, i - 1)["h"] == w["h"]) | (F.get(o, i + 1)["h"] == w["h"])),
            lambda w: w["at"],
        )))
        return bound(places, lambda p: F.aggregate(
            F.transform(p, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - at, F.lit(window)))),
            zero, lambda total, span: total + span,
        ))

    def unless_distinct(marks: Column, span: int, value: Callable[[Column], Column]) -> Column:
        """Zero, if no window of ``span`` words occurs twice."""
        whole = F.slice(marks, 1, F.greatest(F.size(marks) - (span - 1), F.lit(0)))
        return bound(whole, lambda m: F.when(F.size(F.array_distinct(m)) == F.size(m), zero).otherwise(value(m)))

    marks, span = F.transform(words, lambda w: F.xxhash64(w)), 1
    while 2 * span < window:
        marks, span = _doubled(marks, span), 2 * span
    if span < window:
        # Few texts repeat half a window; only theirs are hashed to the end.
        value = bound(marks, lambda half: unless_distinct(half, span, lambda _: bound(
            _doubled(half, span), lambda full: unless_distinct(full, 2 * span, covered))))
    else:
        value = bound(marks, lambda full: unless_distinct(full, span, covered))
    return F.when(F.size(words) <= window, zero).otherwise(value)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    return bound(lines, lambda own: (F.size(own) - F.size(F.array_distinct(own))).cast("bigint"))


def references(docs: DataFrame) -> DataFrame:
    """Per language (NULL as ''): common words, and histograms of classes and of short words.

    Counts cover all documents. They are summed before the shuffle, so a
    language with most of the rows costs each task one row per word.
    """
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    counts = docs.select(lang, F.posexplode(class_counts(F.col("text"))).alias("class", "chars"))
    classes = counts.groupBy("lang", "class").agg(F.sum("chars").alias("chars"))
    classes = classes.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class", "chars"))), lambda c: c["chars"]).alias("ref_classes")
    )
    words = docs.select(lang, F.explode(words_of(F.lower("text"))).alias("word")).where(is_short(F.col("word")))
    totals = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    # The window asks for nothing but ranks, so every task sends only its own first words of a language.
    common = totals.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= COMMON_WORDS).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("word", "n"))).alias("own")
    )
    every = totals.groupBy("lang").agg(F.sum("n").alias("all"))
    return classes.join(common, "lang", "left").join(every, "lang", "left").select(
        "lang",
        "ref_classes",
        F.coalesce(F.col("own.word"), F.array().cast("array<string>")).alias("common"),
        F.coalesce(F.col("own.n"), F.array().cast("array<bigint>")).alias("ref_words"),
        F.coalesce("all", F.lit(0).cast("bigint")).alias("all_words"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, c: a + c)
    return bound(F.greatest(total, F.lit(1.0)), lambda t: F.transform(counts, lambda c: c / t))


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms."""

    def half(own: Column, other: Column) -> Column:
        return F.when(own > 0, own * F.log2(2 * own / (own + other))).otherwise(0.0)

    terms = F.zip_with(_shares(counts), _shares(reference), lambda p, q: (half(p, q) + half(q, p)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _histogram(short: Column) -> Column:
    """How often each common word occurs, and all other short words."""
    hits = F.transform("common", lambda c: (F.size(short) - F.size(F.array_remove(short, c))).cast("bigint"))
    return bound(hits, lambda h: F.concat(
        h, F.array(F.size(short) - F.aggregate(h, F.lit(0).cast("bigint"), lambda a, n: a + n))
    ))


def measures(text: Column) -> Column:
    """The base counts, and the histograms of classes and short words, of one text; reads the reference's columns."""

    def rest(words: Column) -> Column:
        return bound(word_chars(words), lambda chars: F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            chars.alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
            bound(short_words(words), _histogram).alias("word_hist"),
            _classes(text, chars).alias("classes"),
        ))

    return bound(words_of(text), rest)


def measure(docs: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """``doc_id``, the base counts, both distances (NULL where a guard holds) and the verdict."""
    reference = staged(references(docs), "references") if reference is None else reference
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").join(reference, "lang", "left")
    return rows.select("doc_id", *_verdict())


def _verdict() -> list[Column]:
    text = F.col("text")
    judged = bound(measures(text), lambda m: bound(
        F.struct(
            m["n_words"].alias("n_words"),
            m["word_chars"].alias("word_chars"),
            # No class but that of all others holds a symbol.
            F.length(F.regexp_replace(m["classes"]["rest"], "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            repeated_lines(text).alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
            F.when(F.length(text) >= MIN_CLASS_CHARS, _distance(m["classes"]["counts"], F.col("ref_classes"))).alias("class_distance"),
            F.when(
                (m["n_words"] >= MIN_COMPARED_WORDS) & (F.size("common") > 0),
                _distance(m["word_hist"], F.concat("ref_words", F.array(
                    F.col("all_words") - F.aggregate("ref_words", F.lit(0).cast("bigint"), lambda a, n: a + n)))),
            ).alias("word_distance"),
        ),
        lambda v: v.withField(
            "base_failed", (v["n_words"] < MIN_WORDS) | (100 * v["n_repeat_words"] > MAX_REPEATED_PERCENT * v["n_words"])
        ),
    ))
    return [F.inline(F.array(judged))]


def with_verdict(measured: DataFrame) -> DataFrame:
    """Adds ``kept``. A distance equal to its bound is kept."""
    short = F.lit(SHORT_WORD_DISTANCE) * F.sqrt(F.lit(float(STEADY_WORDS)) / F.greatest("n_words", F.lit(1)))
    most = F.when(F.col("n_words") >= STEADY_WORDS, F.lit(MAX_WORD_DISTANCE)).otherwise(short)
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (
        F.coalesce("word_distance", F.lit(0.0)) > most
    )
    return measured.withColumn("kept", ~F.col("base_failed") & ~far)


def judge(docs: DataFrame) -> DataFrame:
    return with_verdict(measure(docs))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns."""
    reference = staged(references(docs), "references")
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows = docs.select(row, F.coalesce("lang", F.lit("")).alias("lang"), "text").join(reference, "lang", "left")
    return with_verdict(rows.select("row", *_verdict())).where("kept").select("row.*")
