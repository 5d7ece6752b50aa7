"""Operator 2: toxicity by maximum-scoring segments of token log-odds.

Learning.  A token has the features word and word start (its first 4 to 8 bytes), lower-cased.  For each feature the number
of toxic and of clean labelled texts that hold it gives a log-odds ratio with a Dirichlet prior (a share of the feature's
own total, so rare features shrink to 0), and the ratio over its standard deviation is its significance.  The significance
and a fixed minimum count decide which features enter, however large the corpus.  Counts of toxic and clean texts are joined in
Spark, a bit table of fixed size thins out the clean side first, and only the features that enter reach the driver, which
writes them to the shared folder as sorted arrays that the workers map.  Texts that occur several times are counted once.

Scoring.  A token scores the log-odds of its strongest feature, any other token the (negative) drift.  One linear scan of
a text finds all maximal scoring segments.  A segment of score S in a text of n tokens has the expected number of equals
n * exp(-lambda * S) among clean texts, where lambda solves E[exp(lambda * score)] = 1 for clean tokens; segments below
``significance`` are the passages.  The best segment's extreme value, the sum over all maximal segments and the number of tokens
(0 for a text without a segment) are mapped to a probability by logistic regression on the learning rows, each scored as if the lexicon had been learned without
it (its own count is taken out of the features' odds), so that the weights fit what unseen texts give.

Defined results: null and empty texts have no segment and get the probability of a text without one; labels that are
null, or whose id is, are not used; several labels of an id count as toxic if half of them are; if the learning rows hold
one class only, every probability is that class's share.  Rows that repeat an id are scored each by its text.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiforge.llm import words as W
from lexiforge.llm.store import keep, shared_folder, thin_out

FOLDS = 5
STARTS = (4, 5, 6, 7, 8)
#: Toxic learning texts that a feature must be found in.
MIN_COUNT = 3
PRIOR_SHARE = 0.05
MIN_Z = 3.0
DRIFT = -0.05
SIGNIFICANCE = 0.01

#: Bits of the table that thins out the features of clean texts (8 MB).
LOG2_BITS = 26

#: Characters of text whose features are sorted at once.
COUNT_BYTES = 1_000_000

#: Bytes that are no part of a word here: all of ASCII but letters and digits.
_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


@dataclass
class Lexicon:
    """Sorted feature hashes with their log-odds; scale: lambda of the extreme-value distribution."""

    features: np.ndarray
    odds: np.ndarray
    #: For a toxic and for a clean learning text: the odds without that text's own count.
    without_toxic: np.ndarray | None = None
    without_clean: np.ndarray | None = None
    scale: float = 1.0
    folder: str | None = None

    def shared(self, spark: SparkSession):
        """A function that gives the lexicon in a task: mapped from the shared folder, or broadcast when that is no mounted folder."""
        if len(self.features) and not self.folder:
            try:
                self.folder = shared_folder(spark, "toxicity-lexicon")
            except ValueError:
                pass
            else:
                os.makedirs(self.folder)
                self.features.astype(np.uint64).tofile(f"{self.folder}/features")
                np.concatenate([self.odds, self.without_toxic, self.without_clean]).astype(np.float64).tofile(f"{self.folder}/odds")
        if not self.folder:
            held = spark.sparkContext.broadcast(self)
            return lambda: held.value
        folder, scale = self.folder, self.scale


        def mapped() -> "Lexicon":
            odds = np.memmap(f"{folder}/odds", np.float64, "r").reshape(3, -1)
            return Lexicon(np.memmap(f"{folder}/features", np.uint64, "r"), *odds, scale=scale, folder=folder)

        return mapped


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def split(texts: list[str | None]) -> W.Words:
    return W.split([t.lower() if t else t for t in texts], separator=_OUTSIDE)


def features(w: W.Words) -> list[np.ndarray]:
    """For each feature kind the feature of every word (0: the word is too short for it)."""
    length, head = w.ends - w.starts, w.head()
    out = [w.hashes()]
    for k in STARTS:
        start = W.mix((head & W._LOW_BYTES[k]) ^ np.uint64(0xA5A5_0000_0000_0000 + k))
        out.append(np.where(length > k, start, np.uint64(0)))
    return out


def _present(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (feature, text) pairs of a chunk: features in order, and their texts' numbers."""
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    feature = np.concatenate(features(w))
    text = np.tile(text, len(STARTS) + 1)
    real = feature != 0
    feature, text = feature[real], text[real]
    order = np.lexsort((text, feature))
    feature, text = feature[order], text[order]
    new = np.concatenate([[True], (feature[1:] != feature[:-1]) | (text[1:] != text[:-1])])[:len(feature)]
    return feature[new], text[new]


def _count_features(bits=None):
    """Texts -> (feature, number of texts).  bits: a broadcast bit table of the features to count.  Feature 0 has the number of words."""

    def task(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in W.chunks(texts, COUNT_BYTES):
                w = split(texts[a:b])
                feature, _ = _present(w)
                if bits is not None:
                    at = feature & np.uint64((1 << LOG2_BITS) - 1)
                    feature = feature[(bits.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                feature, n = np.unique(feature, return_counts=True)
                feature, n = np.append(feature, np.uint64(0)), np.append(n, w.first[-1])
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(n.astype(np.int64))], names=["feature", "n"])

    return task


def _totals(texts: DataFrame, bits=None) -> DataFrame:
    return texts.select("text").mapInArrow(_count_features(bits), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _bit_table(found: DataFrame) -> np.ndarray:
    """One bit for each value of the low bits of a feature: set for every feature in ``found``, and for few others."""
    at = F.expr(f"shiftright(feature & {(1 << LOG2_BITS) - 1}L, 6)").alias("at")
    bits = F.bit_or(F.expr("shiftleft(1L, cast(feature & 63L as int))")).alias("bits")
    rows = found.groupBy(at).agg(bits).toArrow()
    table = np.zeros(1 << (LOG2_BITS - 6), np.uint64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def learning_rows(docs: DataFrame, labels: DataFrame, folds: int, held_out: int | None) -> DataFrame:
    """(doc_id, digest, toxic): a labelled text of each distinct text outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.avg("toxic").alias("rate"))
    d = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("digest"))
    if held_out is not None:
        d = d.where(fold(F.col("doc_id"), folds) != held_out)
    rows = d.join(known, F.col("doc_id") == F.col("l_id"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), (F.avg("rate") >= 0.5).alias("toxic"))


def learn(docs: DataFrame, rows: DataFrame) -> Lexicon:
    """docs: (doc_id, text); rows: from ``learning_rows``."""
    rows = rows.select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), "toxic")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return Lexicon(np.zeros(0, np.uint64), *[np.zeros(0)] * 3)
    d = docs.select("doc_id", "text")

    def texts(which: Column) -> DataFrame:
        own = rows.where(which)
        few = thin_out(d, "doc_id", own.select("r_id")).withColumn("digest", F.xxhash64("text"))
        return few.join(own.hint("merge"), (F.col("doc_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")))

    toxic = keep(_totals(texts(F.col("toxic"))).where((F.col("n") >= MIN_COUNT) & (F.col("feature") != 0)))
    clean = keep(_totals(texts(~F.col("toxic")), docs.sparkSession.sparkContext.broadcast(_bit_table(toxic))))
    n_words = clean.where("feature = 0").agg(F.sum("n")).first()[0] or 0
    both = toxic.join(clean.select(F.col("feature").alias("c_feature"), F.col("n").alias("c_n")), F.col("feature") == F.col("c_feature"), "left")
    both = both.select("feature", F.col("n").cast("double").alias("y1"), F.coalesce(F.col("c_n"), F.lit(0)).cast("double").alias("y0"))
    chosen = both.select("feature", "y1", "y0", _evidence(F.col("y1"), F.col("y0"), n1, n0).alias("odds")).where("odds > 0")
    y1, y0 = F.col("y1"), F.col("y0")
    less = F.when(y1 > MIN_COUNT, _evidence(y1 - 1, y0, n1 - 1, n0)).otherwise(0.0)
    found = chosen.select("feature", "odds", (y0 + PRIOR_SHARE * (y1 + y0)).alias("clean"), less.alias("without_toxic"),
                          F.when(y0 > 0, _evidence(y1, y0 - 1, n1, n0 - 1)).otherwise(F.col("odds")).alias("without_clean")).toArrow()
    order = np.argsort(f := found.column("feature").to_numpy().view(np.uint64))
    odds, share, *without = (found.column(c).to_numpy()[order] for c in ("odds", "clean", "without_toxic", "without_clean"))
    return Lexicon(f[order], odds, *without, scale=extreme_scale(odds, share / max(n_words, 1)))


def _evidence(y1: Column, y0: Column, n1: int, n0: int) -> Column:
    """Log-odds of a feature in y1 of n1 toxic and y0 of n0 clean texts, under a Dirichlet prior; 0 where they are not significant."""
    alpha, total = PRIOR_SHARE * (y1 + y0), PRIOR_SHARE * (n1 + n0)
    rest = lambda n, y: F.greatest(n + total - y - alpha, F.lit(0.5))
    odds = F.log((y1 + alpha) / rest(F.lit(n1), y1)) - F.log((y0 + alpha) / rest(F.lit(n0), y0))
    return F.when((odds / F.sqrt(1 / (y1 + alpha) + 1 / (y0 + alpha)) >= MIN_Z) & (odds > 1), odds).otherwise(0.0)


def extreme_scale(odds: np.ndarray, share: np.ndarray) -> float:
    """lambda > 0 with sum(share * exp(lambda * odds)) + (1 - sum(share)) * exp(lambda * DRIFT) = 1, by bisection."""
    share = share / max(1.0, 2 * share.sum())
    rest = 1 - share.sum()
    excess = lambda x: float(np.sum(share * np.exp(np.minimum(x * odds, 700)))) + rest * math.exp(x * DRIFT) - 1
    low, high = 0.0, 1.0
    while excess(high) <= 0 and high < 1024:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(low, 1e-3)


def token_scores(w: W.Words, lexicon: Lexicon, odds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the words with a lexicon feature, their scores): the lexicon's odds, or ``odds`` in their place."""
    odds = lexicon.odds if odds is None else odds
    if not len(lexicon.features) or not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0)
    best = np.zeros(len(w.starts))
    for feature in features(w):
        at = np.minimum(np.searchsorted(lexicon.features, feature), len(lexicon.features) - 1)
        hit = np.flatnonzero(lexicon.features[at] == feature)
        best[hit] = np.maximum(best[hit], odds[at[hit]])
    at = np.flatnonzero(best)
    return at, best[at]


def maximal_segments(at: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past last, score) of a sequence that scores ``drift`` but for the given
    positions: the linear-time scan that keeps a list of candidate segments with their left and right partial sums."""
    held: list[tuple[int, int, float, float, int]] = []  # first, past last, sum before, sum up to the end, nearest earlier with a smaller sum before
    total, last = 0.0, 0
    for p, s in zip(at, scores):
        total += drift * (p - last)
        first, end, left, right = p, p + 1, total, total + s
        total, last = right, p + 1
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]  # those between have no smaller sum
            if j < 0 or held[j][3] >= right:
                held.append((first, end, left, right, j))
                break
            first, left = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, right - left) for a, b, left, right, _ in held]


def _measured(w: W.Words, lexicon: Lexicon, odds: np.ndarray | None = None) -> list[tuple]:
    """(words, best segment, extreme, total, passages) of each text; total: of all maximal segments."""
    at, score = token_scores(w, lexicon, odds)
    bounds, out = np.searchsorted(at, w.first), []
    for d, n in enumerate(w.counts.tolist()):
        i, j = bounds[d:d + 2]
        if i == j:
            out.append((n, None, 0.0, 0.0, []))
            continue
        found = maximal_segments((at[i:j] - w.first[d]).tolist(), score[i:j].tolist())
        found = [dict(zip(("start", "end", "score"), s)) for s in found]
        best = max(found, key=lambda s: s["score"])
        out.append((n, best, max(0.0, lexicon.scale * best["score"] - math.log(n)), sum(s["score"] for s in found),
                    [s for s in found if n * math.exp(-min(lexicon.scale * s["score"], 700)) <= SIGNIFICANCE]))
    return out


def left_out(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, digest, toxic, n, extreme, total), two rows for each text: as if the lexicon had been learned without it, were it
    toxic or clean.  Calibration on these expects what unseen texts give."""
    shared = lexicon.shared(docs.sparkSession)

    def task(batches):
        lexicon = shared()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in W.chunks(texts):
                w = split(texts[a:b])
                for toxic, odds in ((True, lexicon.without_toxic), (False, lexicon.without_clean)):
                    n, _, extreme, total, _ = zip(*_measured(w, lexicon, odds))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(a, b - a), batch.column("digest").slice(a, b - a), pa.array([toxic] * (b - a)),
                         pa.array(n, pa.int64()), pa.array(extreme, pa.float64()), pa.array(total, pa.float64())],
                        names=["doc_id", "digest", "toxic", "n", "extreme", "total"])

    d = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    return d.mapInArrow(task, "doc_id long, digest long, toxic boolean, n long, extreme double, total double")


def segments(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """(row, n, best, extreme, total, passages) for every row of ``docs``; row: a struct of its columns.
    start and end of a passage count words (letters, digits and other non-ASCII characters) of the text."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    shared = lexicon.shared(docs.sparkSession)

    def task(batches):
        lexicon = shared()
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in W.chunks(texts):
                out += _measured(split(texts[a:b]), lexicon)
            n, best, extreme, total, passages = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(best, _PASSAGES.value_type), pa.array(extreme, pa.float64()),
                 pa.array(total, pa.float64()), pa.array(passages, _PASSAGES)],
                names=["row", "n", "best", "extreme", "total", "passages"])

    schema = d.select("row").schema
    more = StructType.fromDDL("n long, best struct<start:int,end:int,score:double>, extreme double, total double, passages array<struct<start:int,end:int,score:double>>")
    for field in more:
        schema = schema.add(field)
    return d.mapInArrow(task, schema)


def _inputs() -> list[Column]:
    return [F.col("extreme"), F.log1p(F.greatest(F.col("total"), F.lit(0.0))), F.when(F.col("total") > 0, F.log1p(F.col("n").cast("double"))).otherwise(0.0)]


def calibrate(scored: DataFrame) -> list[float]:
    """Weights of the inputs and the intercept, from rows with ``toxic``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = scored.select(array_to_vector(F.array(*_inputs())).alias("features"), F.col("toxic").cast("double").alias("label"))
    share = rows.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        p = min(max(share or 0.0, 1e-6), 1 - 1e-6)
        return [0.0, 0.0, 0.0, math.log(p / (1 - p))]
    m = LogisticRegression(maxIter=50, regParam=1e-3).fit(rows)
    return [*(float(x) for x in m.coefficients), float(m.intercept)]


def probability(weights: list[float]) -> Column:
    z = F.lit(weights[-1])
    for w, x in zip(weights, _inputs()):
        z = z + w * x
    return 1 / (1 + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int | None = 0) -> tuple[Lexicon, list[float]]:
    """docs: (doc_id, text, ...); labels: (doc_id, toxic, ...).  Rows of the held-out fold are not learned from."""
    d = docs.select("doc_id", "text")
    rows = keep(learning_rows(d, labels, folds, held_out))
    lexicon = learn(d, rows)
    own = rows.select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("toxic").alias("r_toxic"))
    known = left_out(thin_out(d, "doc_id", own), lexicon).join(
        own, (F.col("doc_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")) & (F.col("toxic") == F.col("r_toxic")))
    return lexicon, calibrate(keep(known.select("n", "extreme", "total", "toxic")))


def score(docs: DataFrame, model: tuple[Lexicon, list[float]], text: str = "text") -> DataFrame:
    """(row, score, n, passages) for every row of ``docs``; a toxic document without a significant passage has its best one."""
    lexicon, weights = model
    out = segments(docs, lexicon, text).select("row", probability(weights).alias("score"), "n", "passages", "best")
    only = (F.size("passages") == 0) & (F.col("score") >= 0.5) & F.col("best").isNotNull()
    return out.select("row", "score", "n", F.when(only, F.array("best")).otherwise(F.col("passages")).alias("passages"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, passages."""
    d = docs.select("doc_id", "text")
    out = score(d, train(d, labels, folds, held_out))
    return out.select("row.doc_id", (fold(F.col("row.doc_id"), folds) == held_out).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
