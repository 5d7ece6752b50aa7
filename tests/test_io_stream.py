"""File round trips (S1-S12) and the streaming twin."""

import os
import tempfile

from pyspark.sql import functions as F

from lexiforge.functions.text import clean_generated, clean_text, cut_at_eos, normalise_label
from lexiforge.sources import files
from lexiforge.streaming.augment_stream import augment_stream, document_stream, run_to_table
from lexiforge.operators import eda
from lexiforge.sources.corpus import document_units
from tests.conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="lexiforge-test-")


def test_csv_round_trip(spark):
    d = _tmp()
    df = spark.createDataFrame([("pos", 'a "quoted", text'), ("neg", "b")], "label string, text string")
    path = files.write_labelled_csv(df, d, "eda", "/x/auto_100.csv")
    assert os.path.basename(path) == "eda_auto_100.csv"
    back = files.read_labelled_csv(spark, path)
    assert sorted(back.collect()) == sorted(df.collect())


def test_tagged_min_fields_and_vocab(spark):
    d = _tmp()
    with open(os.path.join(d, "all_train"), "w") as f:
        f.write("root\tconfirm\ta b c\to o o\n\nroot\tdeny\tx y\nbad\tline\n")
    t = files.read_tagged(spark, os.path.join(d, "all_train"), 3)
    assert [r.label for r in t.orderBy("line_no").collect()] == ["confirm", "deny"]
    assert files.read_tagged(spark, os.path.join(d, "all_train"), 4).count() == 1
    with open(os.path.join(d, "vocab"), "w") as f:
        f.write("<_PAD>\n<_EOS>\n\n  x  \ny\nz\n")
    v = files.read_vocab(spark, os.path.join(d, "vocab"), limit=3)
    assert [(r.id, r.token) for r in v.orderBy("id").collect()] == [(0, "<_PAD>"), (1, "<_EOS>"), (2, "x")]
    with open(os.path.join(d, "freq"), "w") as f:
        f.write("x 3\ny 1\nq 5\nbroken\n")
    fr = files.read_char_freq(spark, os.path.join(d, "freq"), files.read_vocab(spark, os.path.join(d, "vocab")))
    got = {r.token: r.prob for r in fr.collect()}
    assert got == {"x": 0.75, "y": 0.25}
    with open(os.path.join(d, "vec"), "w") as f:
        f.write("x 0.5 1.5\ny -1 2\n")
    vec = {r.word: r.vector for r in files.read_word_vectors(spark, os.path.join(d, "vec")).collect()}
    assert vec == {"x": [0.5, 1.5], "y": [-1.0, 2.0]}


def test_scalar_text_functions(spark):
    df = spark.createDataFrame([("aab<_UNK>bca", "My Other Label", "Hi, there!")], "g string, l string, t string")
    r = df.select(clean_generated(F.col("g")).alias("a"), clean_generated(F.col("g"), True).alias("b"),
                  normalise_label(F.col("l")).alias("c"), clean_text(F.col("t")).alias("d"),
                  cut_at_eos(F.array(F.lit(5), F.lit(1), F.lit(7))).alias("e"),
                  cut_at_eos(F.array(F.lit(5), F.lit(7)), compat=True).alias("f")).first()
    assert r.a == "abca" and r.b == "bca"
    assert r.c == "other"
    assert r.d == "Hi  there "
    assert r.e == [5] and r.f == [5]


def test_stream_equals_batch(spark):
    d = _tmp()
    src = os.path.join(d, "in", "documents.parquet")
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(50).write.parquet(src)
    q = run_to_table(augment_stream(document_stream(spark, src)), "aug_stream_test", os.path.join(d, "ck"))
    q.processAllAvailable()
    q.stop()
    streamed = spark.sql("SELECT * FROM aug_stream_test")
    units = document_units(spark, os.path.join(d, "in"))
    batch = eda.single_technique(units, "rd", 3, 0.1)
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_tsv_keeps_quotes_and_later_tabs(spark):
    d = _tmp()
    with open(os.path.join(d, "a.tsv"), "w") as f:
        f.write('neu\t"open quote\npos\ta\tb "c"\n\nlonely\n')
    got = {(r.label, r.text) for r in files.read_labelled_tsv(spark, os.path.join(d, "a.tsv")).collect()}
    assert got == {("neu", '"open quote'), ("pos", 'a\tb "c"'), ("lonely", None)}


def test_stop_words_result_tables_encoded_and_vocab_files(spark):
    d = _tmp()
    with open(os.path.join(d, "stop"), "w") as f:
        f.write(" the \n\nof\nthe\n")
    assert sorted(r.word for r in files.read_stop_words(spark, os.path.join(d, "stop")).collect()) == ["of", "the"]
    rows = spark.createDataFrame([("o", "a", "greedy", "x"), ("o", "b", "beam", "y")], "org string, aug string, method string, label string")
    for _ in range(2):
        files.write_result_table(rows, os.path.join(d, "four"))
    assert spark.read.option("header", True).csv(os.path.join(d, "four")).count() == 4
    two = rows.select("label", F.col("aug").alias("text"))
    for _ in range(2):
        files.write_result_table(two, os.path.join(d, "two"), four_columns=False)
    assert spark.read.option("header", True).csv(os.path.join(d, "two")).count() == 2
    enc = spark.createDataFrame([(0, [2, 5, 1]), (1, [2, 1])], "id long, utter array<int>")
    files.write_encoded(enc, os.path.join(d, "enc"), "train")
    assert {r.split for r in spark.read.parquet(os.path.join(d, "enc")).collect()} == {"train"}
    files.write_vocab(spark.createDataFrame([(5, "b", 2), (6, "a", 2), (7, "c", 9)], "id long, token string, cnt long"), os.path.join(d, "vocab"))
    assert [r.value for r in spark.read.text(os.path.join(d, "vocab")).collect()] == ["c\t9", "a\t2", "b\t2"]
