"""Quality rules: base counts, then divergence from language references; DataFrame operations only.

Each document gives two histograms: characters by class, and words by common word (with one bin for all others). The
references are the sums of these histograms over all documents of a language that pass the base rules and the length
guards. A document is kept if the Jensen-Shannon distance (base 2, 0 to 1) of each histogram to its language's
reference stays within a limit; a histogram of too few characters or words is not compared.

Defined cases: a null text has no words and fails the base rules; a null language is a language of its own; a language
without any reference keeps what passes the base rules; repeated rows get equal results; an empty table gives no rows.
Columns that are not named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, words_of

# Frequent words of four languages.
COMMON_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "with",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "ein", "eine", "auf",
    "le", "de", "la", "et", "les", "des", "un", "une", "du", "est", "pour", "que",
    "el", "los", "las", "y", "en", "por", "con", "para", "se", "su", "al", "lo",
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MIN_CHARS, MIN_COMMON = 50, 200, 100
#: Clean labelled documents stay below both with 99.9 % (sf0.1); lists, capitals and symbol noise lie above one.
CHAR_LIMIT, WORD_LIMIT = 0.25, 0.25


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three words that occur twice or more in the array.

    Windows are compared by a 64-bit hash. Only texts with a repeat are sorted: (hash, place) pairs whose neighbour has
    the same hash give the places, and each place covers up to three words until the next one.
    """
    n = F.size(words)
    code = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, code)


def _covered(codes: Column) -> Column:
    pairs = F.sort_array(F.transform(codes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(codes)) < F.size(codes), pairs)


def _places(pairs: Column) -> Column:
    same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
    twice = F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _spread(places: Column) -> Column:
    widths = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
    return F.coalesce(F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def measure(documents: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, lang``, the base counts, and the histograms ``chars`` and ``common`` (arrays of longs)."""
    d = documents.select(F.col(doc).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.select("doc_id", "lang", "t", words_of(F.col("t")).alias("w"), F.regexp_replace("t", "[a-z]+", "").alias("rest"), F.split("t", "\n").alias("lines"))
    d = d.select(
        "doc_id", "lang", "t", "w", "rest",
        F.filter("lines", lambda x: x.rlike(SPACE.replace("[", "[^"))).alias("full"),
        repeated_words(F.col("w")).alias("codes"),
        F.filter(F.transform("w", lambda x: F.lower(x)), lambda x: x.isin(*COMMON_WORDS)).alias("hits"),
    )
    size = lambda c: F.char_length(c).cast("long")
    without = lambda pattern: size(F.col("rest")) - size(F.regexp_replace("rest", pattern, ""))
    classes = {"upper": "[A-Z]+", "digit": "[0-9]+", "space": f"{SPACE}+", "symbol": "[#*$%&|<>]+", "stop": "[.,;:!?'\"()\\-]+", "wide": "[^\\x00-\\x7F]+"}
    d = d.select("doc_id", "lang", "w", "full", "hits", _covered(F.col("codes")).alias("pairs"), size(F.col("t")).alias("n"), size(F.col("rest")).alias("r"), *[without(p).alias(k) for k, p in classes.items()])
    d = d.withColumn("places", _places(F.col("pairs")))
    n_words = F.size("w").cast("long")
    seen = reduce(lambda a, b: a + b, [F.col(k) for k in classes])
    of = lambda word: F.size(F.filter("hits", lambda x: x == word)).cast("long")
    return d.select(
        "doc_id", "lang",
        n_words.alias("n_words"),
        (F.col("n") - F.col("space")).alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        _spread(F.col("places")).alias("n_repeat_words"),
        F.array(F.col("n") - F.col("r"), *[F.col(k) for k in classes], F.col("r") - seen).alias("chars"),
        F.concat(F.transform(F.array(*[F.lit(w) for w in COMMON_WORDS]), of), F.array(n_words - F.size("hits"))).alias("common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts, base 2; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def distance(s: Column) -> Column:
        def both(x: Column, y: Column) -> Column:
            a, b = x / s["tp"], y / s["tq"]
            return term(a, (a + b) / 2) + term(b, (a + b) / 2)

        return F.when((s["tp"] > 0) & (s["tq"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(s["p"], s["q"], both)) / 2)))

    # the totals are bound to a variable, so they are summed once and not for every bin
    sums = F.struct(p.alias("p"), q.alias("q"), total(p).alias("tp"), total(q).alias("tq"))
    return F.element_at(F.transform(F.array(sums), distance), 1)


def references(measured: DataFrame) -> DataFrame:
    """``lang, ref_chars, ref_common``: summed histograms of the documents that pass the base rules and the guards."""
    good = measured.where(~F.col("base_failed") & (F.col("word_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_COMMON))
    total = lambda c, n: F.array(*[F.sum(F.get(F.col(c), F.lit(i))) for i in range(n)])
    return good.groupBy("lang").agg(total("chars", 8).alias("ref_chars"), total("common", len(COMMON_WORDS) + 1).alias("ref_common"))


def apply_rules(
    documents: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    char_limit: float = CHAR_LIMIT,
    word_limit: float = WORD_LIMIT,
) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed, kept, char_distance, word_distance``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = materialize(measure(documents, doc, text, lang).withColumn("base_failed", failed), "qr-measured")
    refs = materialize(references(measured).withColumnRenamed("lang", "l2"), "qr-references")
    d = measured.join(refs, F.col("lang").eqNullSafe(F.col("l2")), "left")
    d = d.withColumn("char_distance", F.when(F.col("word_chars") >= MIN_CHARS, js_distance(F.col("chars"), F.col("ref_chars"))))
    d = d.withColumn("word_distance", F.when(F.col("n_words") >= MIN_COMMON, js_distance(F.col("common"), F.col("ref_common"))))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= char_limit) & (F.coalesce("word_distance", F.lit(0.0)) <= word_limit)
    return d.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & near).alias("kept"), "char_distance", "word_distance")
