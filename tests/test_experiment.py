"""Features, weighted classifier, soft labels and the gain table."""

import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from lexiforge.functions.text import normalise_tokens
from lexiforge.plans import experiment
from lexiforge.sources.corpus import document_sentences, document_units
from tests.conftest import SF_SMALL

ROWS = [(1, 0, 0, "x", ["a", "b", "a"]), (2, 0, 0, "x", ["a", "c"]), (3, 0, 0, "y", ["d", "e"]),
        (4, 0, 0, "y", ["d", "b"]), (5, 0, 0, "z", ["f"])]
SCHEMA = "doc_id long, sent_no long, chunk_no long, label string, tokens array<string>"


FEATURES = 1 << 12


def _features(train):
    return Pipeline(stages=experiment.featurise(FEATURES)).fit(train)


def test_features_are_tf_idf(spark):
    train = spark.createDataFrame(ROWS, SCHEMA)
    fitted = _features(train)
    got = {r.doc_id: r.features for r in fitted.transform(train).collect()}
    index = fitted.stages[1].vocabulary.index
    for doc_id, _, _, _, tokens in ROWS:
        for t in set(tokens):
            df = sum(t in row[4] for row in ROWS)
            assert got[doc_id][index(t)] == pytest.approx(tokens.count(t) * math.log((len(ROWS) + 1) / (df + 1)))
        assert got[doc_id].numNonzeros() == len(set(tokens))


def test_weights_are_soft_labels(spark):
    # Rows with the same words differ by their labels alone: their probabilities are the shares of the weights.
    train = spark.createDataFrame([("x", ["w"]), ("y", ["w"])], "label string, tokens array<string>")
    fitted = _features(train)
    rows = experiment.weighted_rows(train, fitted).withColumn("weight", F.when(F.col("target_d") == 0, 0.7).otherwise(0.3))
    out = experiment.fit_eval(rows, fitted, train).first()
    assert (out.n, out.correct) == (2, 1)
    assert out.loss == pytest.approx(-(math.log(0.7) + math.log(0.3)) / 2, abs=1e-3)


def test_unseen_test_label_is_wrong_and_tells_nothing_of_training(spark):
    train = spark.createDataFrame(ROWS, SCHEMA)
    test = spark.createDataFrame([("x", ["a", "a"]), ("new", ["a"]), ("y", [])], "label string, tokens array<string>")
    out = experiment.train_eval(train, test).first()
    assert out.n == 3 and 1 <= out.correct <= 2
    assert out.loss >= -math.log(experiment.SMALLEST_P) / 3


def test_mixed_rows_are_the_pairs_and_their_soft_labels(spark):
    train = spark.createDataFrame(ROWS, SCHEMA)
    fitted = _features(train)
    plain = [(r.features, r.target_d) for r in experiment.weighted_rows(train, fitted).collect()]
    rows = experiment.mixed_rows(train, fitted, epochs=3, batch_size=20, rate=0.4).collect()
    # 5 rows a batch: 2 pairs in each of 3 epochs, two rows a pair
    assert len(rows) == 5 + 3 * 2 * 2
    assert sum(r.weight for r in rows) == pytest.approx(5 + 3 * 2 / 3)
    pairs = {}
    for r in rows[5:]:
        pairs.setdefault(tuple(r.features.toArray().nonzero()[0]) + tuple(r.features.values), []).append(r)
    for pair in pairs.values():
        share = {}
        for r in pair:
            share[r.target_d] = share.get(r.target_d, 0.0) + r.weight
        assert sum(share.values()) == pytest.approx(len(pair) / 2 / 3)
        lam = pair[0].weight * 3
        assert any(y0 == pair[0].target_d and _near(pair[0].features, x0, x1, lam) for x0, y0 in plain for x1, _ in plain)


def _near(mixed: SparseVector, x0, x1, lam):
    want = {int(i): lam * x0[int(i)] + (1 - lam) * x1[int(i)] for i in {*x0.indices, *x1.indices}}
    return set(map(int, mixed.indices)) == set(want) and all(abs(mixed[i] - v) < 1e-9 for i, v in want.items())


def test_gain_table(spark):
    seen = []

    def twice(train):
        seen.append({r.doc_id for r in train.select("doc_id").collect()})
        return train.select("label", "tokens").unionByName(train.select("label", "tokens"))

    units = document_units(spark, SF_SMALL)
    rows = {(r["size"], r["method"]): r for r in experiment.gain_table(units, {"twice": twice}, sizes=(60, 300), num_features=FEATURES).collect()}
    assert set(rows) == {(s, m) for s in (60, 300) for m in ("none", "twice", "mixup")}
    n_docs = units.select("doc_id").distinct().count()
    assert len(seen[0] | seen[1]) < n_docs and seen[0] <= seen[1]
    for (size, method), r in rows.items():
        base = rows[size, "none"]
        assert r.n == base.n and r.gain == pytest.approx(r.accuracy - base.accuracy)
        # 3 and 15 batches of 20, five epochs, 10 pairs a batch, two rows a pair
        assert r.n_train == {"none": size, "twice": 2 * size, "mixup": size + size // 20 * 5 * 10 * 2}[method]
    assert rows[300, "none"].accuracy > 0.4


def test_sentences_are_the_units_before_their_tokens(spark, tmp_path):
    texts = [(1, "One two. ... Three!\n  \nfour-5?", "en"), (2, None, "fr"), (3, "", None), (4, "é ü. _ _ . 7", "de"), (4, "中文 x", "zh"),
             (None, "no id. İstanbul", "tr")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(document_units(spark, str(tmp_path)).collect(), key=str)
    sentences = document_sentences(spark, str(tmp_path))
    got = sentences.withColumn("tokens", normalise_tokens("sentence")).drop("sentence")
    assert want and sorted(got.collect(), key=str) == want


def test_gain_table_makes_tokens_of_the_rows_it_picks(spark):
    sizes = {"sizes": (60,), "mixup": False, "num_features": FEATURES}
    want = experiment.gain_table(document_units(spark, SF_SMALL), {}, **sizes).first()
    got = experiment.gain_table(document_sentences(spark, SF_SMALL), {}, tokens=normalise_tokens("sentence"), **sizes).first()
    assert (got.n_train, got.n, got.accuracy) == (want.n_train, want.n, want.accuracy)
    assert got.loss == pytest.approx(want.loss)
