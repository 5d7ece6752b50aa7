"""Operator 4: quality rules and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words and pairs of neighbouring words are hashed into a fixed number of buckets.  Two multinomials are counted over all
texts: one over every document (raw) and one over the documents a trusted table names (target).  A document's score is
the mean over its n-grams of log(target / raw); it is kept if it passes the base rules and the score reaches the
threshold.  The model is ``buckets`` numbers, a bound that does not depend on the data, and is used as an array literal.

Defined results: a null or empty text has no words, score 0 and fails the base rules; a trusted id that is null or
repeated counts once or not at all; without trusted documents every score is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.arrays import let
from lexiforge.llm.store import thin_out
from lexiforge.llm.words import WORD_PATTERN

BUCKETS = 16384
SMOOTHING = 1.0
#: Mean log ratio (nats an n-gram) below which a document is less like the trusted texts than the raw corpus is.
THRESHOLD = -0.15
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words covered by k-word windows that occur twice or more in the array: windows are sorted by hash, equal
    neighbours give the positions, and the union of the covered ranges is summed.  n log n in the length."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, k)).alias("h"), i.alias("i")))

    def twice(s):
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])

    def covered(p):
        gaps = F.transform(p, lambda a, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - a, F.lit(k))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, g: t + g)

    return let(F.sort_array(let(F.sort_array(windows), twice)), covered)


def base_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, words (the array), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD_PATTERN)))
    n = F.size("words").cast("long")
    d = d.select(
        "doc_id", "words", n.alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def gram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words and of the pairs of neighbouring words, in text order."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pair = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda w, i: F.pmod(F.xxhash64(F.get(words, i), w), F.lit(buckets)).cast("int"))
    return F.concat(one, pair)


def fit(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
        smoothing: float = SMOOTHING) -> list[float]:
    """log(target / raw) for each bucket.  ``trusted``: a frame with ``doc_id``, the documents of the target."""
    ids = trusted.select(F.col("doc_id").alias("t_id")).where("t_id is not null").distinct()
    d = docs.select(F.col(doc_id).alias("d_id"), F.col(text).alias("text")).where("text is not null")
    # Only the trusted texts travel, by exchange at every size; all others are counted where they are read.
    of_target = thin_out(d, "d_id", ids).join(ids.hint("merge"), F.col("d_id") == F.col("t_id"))

    def counted(texts: DataFrame) -> list[int]:
        grams = texts.select(F.explode(let(words_of(F.col("text")), lambda w: gram_buckets(w, buckets))).alias("bucket"))
        out = [0] * buckets
        for r in grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
            out[r["bucket"]] = r["n"]
        return out

    raw, target = counted(d), counted(of_target)
    n_raw, n_target = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    if not any(target):
        return [0.0] * buckets
    return [math.log((t + smoothing) / n_target) - math.log((r + smoothing) / n_raw) for r, t in zip(raw, target)]


def score(words: Column, model: list[float]) -> Column:
    """Mean log ratio over the n-grams of a text; 0 without words."""
    table = F.split(F.lit(" ".join(map(repr, model))), " ").cast("array<double>")
    total = let(gram_buckets(words, len(model)),
                lambda g: F.aggregate(g, F.lit(0.0), lambda t, b: t + F.get(table, b)))
    return F.coalesce(total / F.nullif(2 * F.size(words) - 1, F.lit(-1)), F.lit(0.0))


def apply(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
          threshold: float = THRESHOLD, smoothing: float = SMOOTHING) -> DataFrame:
    """One row per document: doc_id, the base columns, base_failed, llr, kept."""
    model = fit(docs, trusted, doc_id, text, buckets, smoothing)
    d = base_rules(docs, doc_id, text)
    d = d.withColumn("llr", score(F.col("words"), model)).drop("words")
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
