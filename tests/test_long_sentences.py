"""The token edits on whole sentences, however long."""

from pyspark.sql import functions as F

from lexiforge.operators import eda, lexicon
from lexiforge.sources.corpus import split_units

PRIME, MUL_A, MUL_B = 2147483647, 48271, 69621


def _pick(h, i, n):
    x = (h + (i + 1) * MUL_A) % PRIME
    y = ((x * x) % PRIME * MUL_B + h) % PRIME
    low = (y * MUL_A + x) % PRIME
    return int((((y * y) % PRIME) + low / PRIME) / PRIME * n)


def _swapped(tokens, n, h):
    tokens = list(tokens)
    for s in range(n):
        i, *js = [_pick(h, s * 4 + t, len(tokens)) for t in range(4)]
        j = next((j for j in js if j != i), i)
        tokens[i], tokens[j] = tokens[j], tokens[i]
    return tokens


def test_swaps_equal_a_serial_loop(spark):
    """One token, repeated tokens, one swap, many swaps over the same places, 5,000 tokens."""
    rows = [(1, ["w"], 1), (2, ["a", "b"], 1), (3, ["a", "b", "a"], 50), (4, [f"w{i}" for i in range(10)], 200),
            (5, [f"w{i}" for i in range(5000)], 500), (7, ["a", "b", "c"], 1), (6, [f"w{i % 7}" for i in range(300)], 30)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, n int")
    df = df.withColumn("h", eda.hash64(F.lit(1), F.col("id")))
    out = df.select("*", eda.random_swap(F.col("tokens"), F.col("n"), F.col("h")).alias("out")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.out == _swapped(r.tokens, r.n, r.h), r.id


def test_a_long_sentence_is_one_unit_with_all_its_variants(spark):
    text = " ".join(f"w{i % 900}" for i in range(5000)) + ". short one"
    docs = spark.createDataFrame([(1, text, "en")], "doc_id bigint, text string, lang string")
    units = split_units(docs, "doc_id", "text", "lang")
    assert [(r.sent_no, r.chunk_no, len(r.tokens)) for r in units.orderBy("sent_no").collect()] == [(0, 0, 5000), (1, 0, 2)]
    ready = lexicon.attach_lexicon(units, lexicon.context_synonyms(units), lexicon.frequent_words(units, 5))
    out = eda.eda(ready, num_aug=9).collect()
    assert sorted((r.sent_no, r.aug_no) for r in out) == [(s, a) for s in (0, 1) for a in range(10)]
    assert all(r.text for r in out)


def test_look_up_keeps_rows_tokens_and_extra_columns(spark):
    units = spark.createDataFrame([("a", ["x", "y", "x"], 1), ("b", ["z"], None), ("c", [], 2)],
                                  "unit_key string, tokens array<string>, extra int")
    lex = spark.createDataFrame([("x", "y", 2.0, 1), ("x", "z", 1.0, 2)], "word string, synonym string, score double, rank int")
    stops = spark.createDataFrame([("z",), ("z",)], "word string")
    got = {r.unit_key: r for r in lexicon.attach_lexicon(units, lex, stops).collect()}
    assert sorted(got) == ["a", "b"]
    assert (got["a"].tokens, got["a"].syn_map, got["a"].stops, got["a"].extra) == (["x", "y", "x"], {"x": ["y", "z"]}, [], 1)
    assert (got["b"].tokens, got["b"].syn_map, got["b"].stops, got["b"].extra) == (["z"], {}, ["z"], None)
