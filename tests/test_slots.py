"""Slot tags, slot vocabulary and multi-hot vectors."""

from pyspark.sql import functions as F

from lexiforge.functions.text import shape_tags
from lexiforge.operators import vocab

SCHEMA = "doc_id long, sent_no long, chunk_no long, label string, tokens array<string>, slot_tags array<string>"
ROWS = [(1, 0, 0, "Ask", ["a", "b"], ["B-city", "i-city", "b-day"]), (2, 0, 0, "ask", ["b", "zz"], ["b-city", "b-city"]),
        (3, 0, 0, "tell", ["a"], None), (4, 0, 0, "new", [], ["o"]), (5, 0, 0, None, None, ["b-rare"])]


def test_multi_hot_vectors(spark):
    units = spark.createDataFrame(ROWS, SCHEMA)
    words = spark.createDataFrame([(5, "a", 2), (6, "b", 2)], "id long, token string, cnt long")
    labels = spark.createDataFrame([(1, "ask", 2), (2, "tell", 1)], "id long, label string, cnt long")
    slots = vocab.build_slot_vocab(units)
    assert [(r.id, r.slot, r.cnt) for r in slots.orderBy("id").collect()] == [(0, "city", 2), (1, "day", 1), (2, "rare", 1)]
    known = slots.where("slot <> 'rare'")
    got = {r.doc_id: (r.intent, r.utt, r.slots) for r in vocab.preprocess_slots(units, words, labels, known).collect()}
    assert got == {1: (1, [5, 6, 1], [1, 1]), 2: (1, [6, 3, 1], [1, 0]), 3: (2, [5, 1], [0, 0]),
                   4: (-1, [1], [0, 0]), 5: (-1, [1], [0, 0])}
    none = vocab.preprocess_slots(units, words, labels, slots.where("false"))
    assert {tuple(r.slots) for r in none.collect()} == {()}
    assert vocab.preprocess_slots(units.where("false"), words, labels, slots).count() == 0


def test_slots_leave_the_other_columns_as_they_are(spark):
    units = spark.createDataFrame(ROWS[:4], SCHEMA)
    words, labels = vocab.build_vocab(units), vocab.build_label_vocab(units)
    plain = vocab.preprocess(units, words, labels)
    with_slots = vocab.preprocess_slots(units, words, labels, vocab.build_slot_vocab(units)).select(*plain.columns)
    assert sorted(with_slots.collect()) == sorted(plain.collect())


def test_shape_tags(spark):
    df = spark.createDataFrame([(["call", "0", "171", "a", "b2", "x9", "7"],), ([],)], "tokens array<string>")
    got = [r.t for r in df.select(shape_tags(F.col("tokens")).alias("t")).collect()]
    assert got == [["o", "b-number", "i-number", "b-initial", "b-code", "i-code", "b-number"], []]
