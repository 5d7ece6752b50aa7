"""Encoding cuts long sentences as the reference does and says so."""

from lexiforge.operators import vocab


def test_cut_sentences_are_marked(spark):
    units = spark.createDataFrame([(1, 0, 0, "en", ["a"] * 98), (2, 0, 0, "en", ["b"] * 99), (3, 0, 0, "en", ["a", "b"] * 100)],
                                  "doc_id long, sent_no int, chunk_no int, label string, tokens array<string>")
    got = vocab.encode_units(units, vocab.build_vocab(units), vocab.build_label_vocab(units)).collect()
    assert {r.doc_id: (r.len, r.full_len, len(r.utter)) for r in got} == {1: (100, 100, 100), 2: (100, 101, 100), 3: (100, 202, 100)}
