"""Quality rules: counts per document, then the Jensen-Shannon distance of its character
classes and common words from those of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stage

# The twenty most common words of four languages.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it as was with be by on not he are this".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}
CLASSES = ("letters", "digits", "symbols", "other", "space")
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Distances beyond which a document is unlike its language, and the words (for the
#: second, also common words expected) it needs before the distance says anything.
MAX_CLASS, MAX_WORDS, MIN_WORDS = 0.3, 0.5, 50
#: Common words by themselves: the part of its language's share of them below which a text lacks
#: them, the distance inside the list beyond which they are another language's, and the hits
#: expected, or found, before each says anything.
MIN_SHARE, MAX_INSIDE, MIN_EXPECTED, MIN_FOUND = 0.25, 0.5, 10, 30


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def with_repeats(df: DataFrame, words: str, width: int = WINDOW) -> DataFrame:
    """Add ``n_repeat_words``: words inside windows of ``width`` words that the text holds
    twice or more.  Windows are compared by 64-bit hashes.  Each array gets a projection
    of its own, since a lambda would compute an inlined one again for every element."""
    n = F.size(words)
    d = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    starts = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_w", F.transform(starts, lambda i: F.xxhash64(*[F.col("_h")[i + k] for k in range(width)])))
    repeated = F.size(F.array_distinct("_w")) < F.size("_w")
    pairs = F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(repeated, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    last = F.size("_s") - 1
    twin = F.filter("_s", lambda p, j: (p["h"] == F.get("_s", j - 1)["h"]) | ((j < last) & (p["h"] == F.get("_s", j + 1)["h"])))
    at = F.sort_array(F.transform(twin, lambda p: p["i"]))
    end = lambda i: (i + width).cast("int")
    covered = F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct(end(i).alias("end"), (a["n"] + end(i) - F.greatest(a["end"], i)).cast("int").alias("n")))
    return d.withColumn("n_repeat_words", covered["n"].cast("long")).drop("_h", "_w", "_s")


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Counts of each document: words, characters by class, common words of its language."""
    lang = F.when(F.col(lang_col).isin(*COMMON), F.col(lang_col)).otherwise("other")
    d = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("words", words_of(F.col("t")))
    d = with_repeats(d, "words")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines).withColumn("joined", F.array_join("words", ""))
    d = d.withColumn("rest", F.regexp_replace("joined", r"\p{L}+", ""))
    lists = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for v in COMMON.values() for w in v})
    common = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(*every))
    d = d.withColumn("common", common).withColumn("list", F.coalesce(lists[F.col("lang")], F.array().cast("array<string>")))
    count = lambda c: F.length(c).cast("long")
    d = d.select(
        "id", "lang", "n_repeat_words", "common", "list",
        F.size("words").cast("long").alias("n_words"),
        count("joined").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (count("t") - count("joined")).alias("space"),
        (count("joined") - count("rest")).alias("letters"),
        count(F.regexp_replace("rest", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        count(F.regexp_replace("rest", r"\P{N}+", "")).alias("digits"),
    )
    d = d.withColumn("hits", F.transform("list", lambda w: F.size(F.filter("common", lambda x: x == w)).cast("long")))
    other = F.col("word_chars") - F.col("letters") - F.col("digits") - F.col("n_symbols")
    return d.withColumn("chars", F.array("letters", "digits", "n_symbols", other, "space")).drop("common", "list", "space", "letters", "digits")


def references(found: DataFrame) -> DataFrame:
    """Class and common-word counts of each language over all documents: one row per
    language of COMMON and one for the others, so always small enough to broadcast."""
    n = max(map(len, COMMON.values()))
    total = found.groupBy("lang").agg(
        F.array(*[F.sum(F.col("chars")[i]) for i in range(len(CLASSES))]).alias("ref_chars"),
        F.array(*[F.coalesce(F.sum(F.get("hits", F.lit(i))), F.lit(0)) for i in range(n)]).alias("ref_hits"),
        F.sum("n_words").alias("ref_words"),
    )
    return total.withColumnRenamed("lang", "_lang")


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)).cast("double"))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two share arrays: 0 to 1."""
    part = lambda x, y: F.when(x > 0, x * F.log2(F.lit(2.0) * x / (x + y))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def quality_rules(docs: DataFrame, max_class: float = MAX_CLASS, max_words: float = MAX_WORDS, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", by_share: bool = True) -> DataFrame:
    """One row per input row with its counts, distances, ``base_failed`` and ``kept``.

    ``by_share`` also drops texts that lack their language's common words or use those of
    another language (MIN_SHARE, MAX_INSIDE), which ``max_words`` cannot see: common words
    are so small a part of a text that one without any is near its language by all words.

    A null text has no words (and so fails the base rules); a null or unlisted language is
    compared with all such documents by character classes only; a text under ``min_words``
    words is judged by the base rules alone.  Repeated rows and ids each get their row; an
    empty table gives an empty table; other columns are not read.
    """
    found = stage(features(docs, id_col, text_col, lang_col))
    d = found.join(F.broadcast(references(found)), found["lang"] == F.col("_lang"), "left")
    sum_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    with_rest = lambda hits, n: F.concat(hits, F.array(n - sum_of(hits)))
    d = d.withColumn("class_distance", js_distance(shares(F.col("chars"), sum_of(F.col("chars"))), shares(F.col("ref_chars"), sum_of(F.col("ref_chars")))))
    own, ref = with_rest(F.col("hits"), F.col("n_words")), with_rest(F.slice("ref_hits", 1, F.size("hits")), F.col("ref_words"))
    d = d.withColumn("word_distance", F.when(F.size("hits") > 0, js_distance(shares(own, F.col("n_words")), shares(ref, F.col("ref_words")))).otherwise(0.0))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    unlike = (F.col("n_words") >= min_words) & ((F.col("class_distance") > max_class) | (F.col("word_distance") > max_words))
    if by_share:
        hits, ref_hits = sum_of(F.col("hits")), sum_of(F.slice("ref_hits", 1, F.size("hits")))
        expected = F.col("n_words") * ref_hits / F.greatest("ref_words", F.lit(1))
        inside = js_distance(shares(F.col("hits"), hits), shares(F.slice("ref_hits", 1, F.size("hits")), ref_hits))
        lacking = (expected >= MIN_EXPECTED) & (hits < MIN_SHARE * expected)
        strange = (hits >= MIN_FOUND) & (inside > MAX_INSIDE)
        unlike = unlike | ((F.size("hits") > 0) & (F.col("n_words") >= min_words) & (lacking | strange))
    d = d.withColumn("base_failed", failed).withColumn("kept", ~failed & ~unlike)
    return d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
