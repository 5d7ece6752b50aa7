"""ids are decoded by blocks of rows."""

from lexiforge.operators import vocab


def test_ids_become_tokens_in_their_order(spark):
    enc = spark.createDataFrame([(1, [2, 7, 7, 5, 1]), (2, [99, 6]), (3, [99]), (4, []), (5, None), (6, [5, 5])], "id long, utter array<int>")
    voc = spark.createDataFrame([(1, "<_EOS>", 0), (2, "<_GO>", 0), (5, "a", 3), (6, "b b", 2), (7, "c", 1)], "id long, token string, cnt long")
    out = vocab.decode_ids(enc, voc)
    assert {r.id: r.text for r in out.collect()} == {1: "<_GO> c c a <_EOS>", 2: "b b", 6: "a a"}
    assert {r.id: r.text for r in vocab.decode_ids(enc, voc, drop_reserved=True).collect()} == {1: "c c a", 2: "b b", 6: "a a"}


def test_rows_equal_in_their_keys_are_one_text(spark):
    enc = spark.createDataFrame([(1, [7, 5]), (1, [5, 6, 7]), (None, [5])], "id long, utter array<int>")
    voc = spark.createDataFrame([(5, "z", 3), (6, "b", 2), (7, "c", 1)], "id long, token string, cnt long")
    assert {r.id: r.text for r in vocab.decode_ids(enc, voc).collect()} == {1: "c z b z c", None: "z"}


def test_no_row_per_token_is_joined(spark):
    enc = spark.createDataFrame([(1, [5, 6])], "id long, utter array<int>")
    voc = spark.createDataFrame([(5, "a", 3)], "id long, token string, cnt long")
    plan = vocab.decode_ids(enc, voc)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "posexplode" not in plan
