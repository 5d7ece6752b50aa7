"""Units, look-ups and drawn tokens: work that grows with the input and no faster."""

from pyspark.sql import functions as F

from lexiforge.functions.draws import uniform
from lexiforge.functions.lookup import look_up
from lexiforge.operators import lexicon, metrics, noise, pivot, vocab
from lexiforge.sources.corpus import split_units


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_normalised_once(spark):
    docs = spark.createDataFrame([(1, "One two. Three!", "en"), (2, None, "en"), (3, " ... ", "de")], "doc_id bigint, text string, lang string")
    units = split_units(docs, "doc_id", "text", "lang")
    assert plan(units).count("regexp_replace") == 1
    assert [(r.doc_id, r.sent_no, r.unit_key, r.tokens) for r in units.orderBy("doc_id", "sent_no").collect()] == [
        (1, 0, "1:0:0", ["one", "two"]), (1, 1, "1:1:0", ["three"])]
    pieces = split_units(docs, "doc_id", "text", "lang", max_tokens=1).orderBy("sent_no", "chunk_no").collect()
    assert [(r.sent_no, r.chunk_no, r.tokens) for r in pieces] == [(0, 0, ["one"]), (0, 1, ["two"]), (1, 0, ["three"])]


def test_look_up_keeps_places_nulls_and_repeated_keys(spark):
    units = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["x", None]), (5, ["b"]), (5, ["a", "c"])],
                                  "doc_id bigint, tokens array<string>")
    table = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "word string, value int")
    plain = sorted((r.doc_id, r.tokens_found) for r in look_up(units, {"tokens": table}).where("doc_id not in (3, 5)").collect())
    assert plain == [(1, [10, 20, 10]), (2, []), (4, [None, None])]
    joined = {r.doc_id: r for r in look_up(units, {"tokens": table}, merge=["doc_id"], missing=3).collect()}
    assert joined[5].tokens_found == [10, 20, 30] and joined[5].tokens == ["a", "b", "c"]
    assert joined[4].tokens_found == [3, 3] and len(joined) == 5


def test_look_ups_have_no_row_per_token(spark):
    units = split_units(spark.createDataFrame([(1, "a b. c a", "en")], "doc_id bigint, text string, lang string"), "doc_id", "text", "lang")
    voc = spark.createDataFrame([(5, "a", 2), (6, "b", 1)], "id bigint, token string, cnt bigint")
    labels = spark.createDataFrame([(1, "en", 1)], "id bigint, label string, cnt bigint")
    lex = spark.createDataFrame([("a", "z", 1.0, 1)], "word string, synonym string, score double, rank int")
    stops = spark.createDataFrame([("b",)], "word string")
    para = spark.createDataFrame([("en", "de", "a", "q", 1.0)], "src_lang string, pivot_lang string, src string, best string, p double")
    frames = {"preprocess": vocab.preprocess(units, voc, labels), "lexicon": lexicon.attach_lexicon(units, lex, stops),
              "pivot": pivot.pivot_paraphrase(units, para)}
    for name, df in frames.items():
        assert "FlatMapCoGroupsInArrow" in plan(df), name
    assert sorted(tuple(r.utt) for r in frames["preprocess"].collect()) == [(3, 5, 1), (5, 6, 1)]
    assert {r.sent_no: (r.syn_map, r.stops) for r in frames["lexicon"].collect()} == {0: ({"a": ["z"]}, ["b"]), 1: ({"a": ["z"]}, [])}
    assert sorted(r.text for r in frames["pivot"].where(F.col("pivot_lang") == "de").collect()) == ["c q", "q b"]


def test_buckets_follow_the_table(spark):
    n = 20_000
    probs = spark.range(n).select(F.col("id").alias("token_id"), F.lit(1).cast("bigint").alias("cnt"),
                                  (F.col("id") + 1).alias("cum_cnt"), F.lit(n).cast("bigint").alias("total_cnt"))
    table = noise.bucketed_table(probs)
    assert table.count() <= 2 * n and table.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 2
    draws = spark.createDataFrame([(0.0, n), (0.5, n), (1 - 1e-9, n)], "u2 double, total bigint")
    assert sorted(r.new_tid for r in noise.draw_tokens(draws, probs).collect()) == [0, n // 2, n - 1]


def test_corpus_is_counted_in_one_pass(spark):
    """F32: units, tokens, words and labels, nulls among them, from one reading of the units."""
    units = spark.createDataFrame([("x", ["a", "b", "a", None]), (None, ["b"]), ("x", []), ("y", None)], "label string, tokens array<string>")
    stats = metrics.corpus_stats(units)
    assert plan(stats).count("LogicalRDD") == 1
    assert {r.metric: r.value for r in stats.collect()} == {"n_units": 4, "n_tokens": 5, "vocab_size": 3, "n_labels": 3}
    assert {r.metric: r.value for r in metrics.corpus_stats(units.where("false")).collect()} == {
        "n_units": 0, "n_tokens": None, "vocab_size": 0, "n_labels": 0}


def test_a_draw_is_made_once(spark):
    """of the draws' two products with 48271 neither is repeated; the value is that of plain integers."""
    df = spark.createDataFrame([(123456789012345678, 5), (None, 1), (7, None)], "h bigint, i int")
    drawn = df.select(uniform(F.col("h"), F.col("i")).alias("u"))
    assert plan(drawn).count("48271") == 2
    h, m = 123456789012345678, 2147483647
    x = (h + 6 * 48271) % m
    y = (x * x % m * 69621 + h) % m
    assert [r.u for r in drawn.collect()] == [(y * y % m + (y * 48271 + x) % m / float(m)) / float(m), None, None]


def test_distinct_words_are_made_where_the_block_is(spark):
    """lists of distinct words beside the tokens do not travel."""
    from lexiforge.operators.vectors import unit_vectors

    units = spark.createDataFrame([(1, 0, ["b", "a", "b", "c"]), (1, 1, ["c", None, "c", None]), (2, 0, None), (3, 0, [])], "doc_id long, sent_no long, tokens array<string>")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "word string, value int")
    for piece in (None, 1):
        out = look_up(units, {"_w": table}, piece=piece, distinct={"_w": "tokens"})
        assert {(r.doc_id, r.sent_no): (r["_w"], r["_w_found"]) for r in out.collect()} == {
            (1, 0): (["b", "a", "c"], [2, 1, None]), (1, 1): (["c", None], [None, None]), (2, 0): (None, None), (3, 0): ([], [])}
    lex = spark.createDataFrame([("a", "z", 1.0, 1)], "word string, synonym string, score double, rank int")
    stops = spark.createDataFrame([("b",)], "word string")
    vecs = spark.createDataFrame([("a", [1.0])], "word string, vector array<double>")
    keyed = units.withColumn("unit_key", F.concat_ws(":", "doc_id", "sent_no"))
    for df in (lexicon.attach_lexicon(keyed, lex, stops), unit_vectors(keyed, vecs, 1)):
        assert "AS _words#" not in plan(df)
