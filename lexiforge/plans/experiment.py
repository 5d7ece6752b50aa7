"""Augmentation gain experiment on Spark ML.

Split first (L3), so augmented variants stay on the side of their source;
training subsets are nested, stratified low-resource tiers (L5) of the training
part; the test part is never augmented and its words are not learned.  Features
are term frequencies over the training subset's vocabulary with IDF (M1) and the classifier is a multinomial
logistic regression (M2).  Accuracy and cross-entropy come from the probability
vectors (A5, A6).

Mixup needs soft labels.  The loss of a mixed row, lam * CE(y0) + (1 - lam) *
CE(y1), is that of two rows with the mixed features, labelled y0 and y1 and
weighing lam and 1 - lam, so it is a row weight of the classifier (A7, E10).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.draws import hash64
from lexiforge.operators import metrics
from lexiforge.operators.batching import split_train_dev_test, stratified_tiers
from lexiforge.operators.mixup import mixup_pairs
from lexiforge.session import cut_lineage

KEYS = ["doc_id", "sent_no", "chunk_no"]
# Smallest probability whose logarithm is taken.
SMALLEST_P = 1e-12
# Training rows of a task: a fit of a small subset is many passes of few rows.
ROWS_PER_TASK = 10_000

#: (label, tokens) rows of a training subset from its units, the originals included.
Augmenter = Callable[[DataFrame], DataFrame]


def featurise(num_features: int = 1 << 18) -> list:
    """M1 stages: tokens -> tf -> tf-idf, label -> index.  The vocabulary is
    the rows', at most the ``num_features`` most frequent words; rows without
    a single word cannot be fitted."""
    return [StringIndexer(inputCol="label", outputCol="target_d", handleInvalid="keep"),
            CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=num_features),
            IDF(inputCol="tf", outputCol="features")]


def _target():
    # A new expression leaves the indexer's class list behind, which has a class for unseen labels: the classes are those
    # of the rows, whatever the rows have gone through.
    return (F.col("target_d") + 0.0).alias("target_d")


def weighted_rows(train: DataFrame, features: PipelineModel) -> DataFrame:
    """(features, target_d, weight) of (label, tokens) rows, each weighing 1."""
    return features.transform(train).select("features", _target(), F.lit(1.0).alias("weight"))


@F.udf(returnType=VectorUDT())
def _mixed(x0, x1, lam):
    values = {int(i): lam * float(v) for i, v in zip(x0.indices, x0.values)}
    for i, v in zip(x1.indices, x1.values):
        values[int(i)] = values.get(int(i), 0.0) + (1.0 - lam) * float(v)
    return SparseVector(x0.size, values)


def mixed_rows(train: DataFrame, features: PipelineModel, epochs: int = 5, batch_size: int = 20, rate: float = 0.5,
               alpha: float = 1.0, seed: int = 2020) -> DataFrame:
    """Sentence mixup (E10) as weighted rows: (features, target_d, weight).

    An epoch puts the rows into batches in a new order and mixes ``rate`` of
    each with its last rows; the originals stay.  Of ``epochs`` epochs a row
    counts as one, so originals weigh 1 in all and both rows of a mixed pair
    together 1 / epochs.  A batch too small to mix gives no mixed row."""
    rows = features.transform(train).select(*KEYS, "features", _target())
    parts = [rows.select("features", "target_d", F.lit(1.0).alias("weight"))]
    for epoch in range(epochs):
        order = hash64(F.lit(seed), F.lit(f"mixup_order_{epoch}"), *[F.col(k) for k in KEYS])
        drawn = rows.select(F.concat_ws(":", F.lpad(order.cast("string"), 20, "0"), *KEYS).alias("vec_id"),
                            F.col("target_d").alias("label"), F.col("features").alias("embedding"))
        pairs = (mixup_pairs(drawn, batch_size, rate, alpha, seed=seed + epoch)
                 .withColumn("features", _mixed("x0", "x1", "lam")))
        soft = F.explode(F.array(F.struct(F.col("label0").alias("target_d"), F.col("lam").alias("w")),
                                 F.struct(F.col("label1").alias("target_d"), (1 - F.col("lam")).alias("w"))))
        parts.append(pairs.select("features", soft.alias("_s"))
                     .select("features", "_s.target_d", (F.col("_s.w") / epochs).alias("weight")))
    return reduce(DataFrame.unionByName, parts)


def fit_eval(rows: DataFrame, features: PipelineModel, test: DataFrame, max_iter: int = 30) -> DataFrame:
    """M2 on weighted rows: (n, correct, accuracy, loss) of ``test`` (label, tokens).

    A test label that training has not seen is counted as wrong."""
    lr = LogisticRegression(featuresCol="features", labelCol="target_d", weightCol="weight", maxIter=max_iter,
                            regParam=0.01)
    # The probabilities alone are read: without the other two columns a row's vectors are made once.
    model = lr.fit(rows).setRawPredictionCol("").setPredictionCol("")
    pred = model.transform(features.transform(test))
    logits = F.transform(vector_to_array("probability"), lambda p: F.log(F.greatest(p, F.lit(SMALLEST_P))))
    target = F.col("target_d").cast("int")
    # The class of unseen labels comes last and the model has none for it.
    scored = pred.select(logits.alias("_l"), target.alias("target"))
    unseen = F.greatest(F.col("target") + 1 - F.size("_l"), F.lit(0))
    padded = F.concat("_l", F.array_repeat(F.log(F.lit(SMALLEST_P)), unseen))
    return metrics.accuracy(scored.select(padded.alias("logits"), "target"))


def train_eval(train: DataFrame, test: DataFrame, max_iter: int = 30) -> DataFrame:
    """M2: fit on ``train`` (label, tokens), evaluate on ``test``:
    (n, correct, accuracy, loss)."""
    features = Pipeline(stages=featurise()).fit(train)
    return fit_eval(weighted_rows(train, features), features, test, max_iter)


def gain_table(units: DataFrame, methods: dict[str, Augmenter], sizes=(100, 500, 2000, 5000), mixup: bool = True,
               seed: int = 2020, num_features: int = 1 << 18, tokens: Column | None = None) -> DataFrame:
    """M3 + A13: (size, method, n_train, n, accuracy, loss, base_accuracy, gain).

    Methods are 'none' (the base), the given augmenters and, with ``mixup``,
    'mixup'.  ``n_train`` counts the rows that the classifier sees (mixed pairs
    as two).  A size beyond the training part takes all of it.  ``tokens`` makes
    the tokens of units that come without: of the test part and of the subsets."""
    units = units if tokens is None else units.drop("tokens")
    with_tokens = lambda df: df if tokens is None else df.withColumn("tokens", tokens)
    # Whole documents go to one side, so that no sentence of a test document is trained on.
    split = split_train_dev_test(units, ["doc_id"], train=0.9, dev=0.0, seed=seed)
    test = cut_lineage(with_tokens(split.where(F.col("split") == "test")).select("label", "tokens"))
    # The subsets hold as many rows as the largest size, whatever the input.
    subsets = cut_lineage(with_tokens(stratified_tiers(split.where(F.col("split") == "train").drop("split"), KEYS, sizes=sizes, seed=seed))
                          .drop("label_rank", "position"))
    results = []
    for size in sorted(sizes):
        train = subsets.where(F.col("tier") <= size).drop("tier")
        plain = train.select("label", "tokens")
        features = Pipeline(stages=featurise(num_features)).fit(plain)
        seen = {"none": (weighted_rows(plain, features), features)}
        for name, method in methods.items():
            rows = cut_lineage(method(train))
            own = Pipeline(stages=featurise(num_features)).fit(rows)
            seen[name] = (weighted_rows(rows, own), own)
        if mixup:
            seen["mixup"] = (cut_lineage(mixed_rows(train, features, seed=seed)), features)
        for name, (rows, fitted) in seen.items():
            n_train = rows.count()
            gathered = rows.coalesce(1 + n_train // ROWS_PER_TASK)
            results.append(fit_eval(gathered, fitted, test).select(
                F.lit(size).alias("size"), F.lit(name).alias("method"), F.lit(n_train).cast("bigint").alias("n_train"), "*"))
    # One row for each size and method: written once, as each use would score the test part again.
    table = cut_lineage(reduce(DataFrame.unionByName, results).drop("correct"))
    base = table.where("method = 'none'").select("size", F.col("accuracy").alias("base_accuracy"))
    return table.join(base, "size").withColumn("gain", F.col("accuracy") - F.col("base_accuracy"))
