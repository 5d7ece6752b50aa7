"""From a labelled file to a labelled file, with word and Chinese tokenisers."""

import csv
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiforge.functions.text import char_tokens, cjk_tokens
from lexiforge.plans.augment import augment_file, labelled_units
from lexiforge.sources import files

CHINESE = [("晴", "明天北京会下雨吗?"), ("雨", "今天的气温是25度,适合出门"), ("雨", "后天去上海OK吗")]


def _csv(path, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["label", "text"])
        w.writerows(rows)
    return str(path)


def _read(spark, path):
    return [(r.label, r.text) for r in files.read_labelled_csv(spark, path).collect()]


def test_cjk_tokens(spark):
    df = spark.createDataFrame([("今天25度,OK吗? a-b",), ("",), (None,), ("?!",)], "t string")
    assert [r.x for r in df.select(cjk_tokens(F.col("t")).alias("x")).collect()] == [
        ["今", "天", "25", "度", "OK", "吗", "a", "b"], [], None, []]


def test_chinese_file_gives_ten_rows_a_text(spark, tmp_path):
    """Nine variants and the text itself, labels carried over, the same rows again on the next run."""
    src = _csv(tmp_path / "weather.csv", CHINESE)
    lex = spark.createDataFrame([("天", "日", 1.0, 1), ("雨", "雪", 1.0, 1)], "word string, synonym string, score double, rank int")
    stops = spark.createDataFrame([("的",), ("吗",)], "word string")
    kw = dict(tokenizer=cjk_tokens, joiner="", num_aug=9, lexicon_df=lex, stop_words=stops)
    path = augment_file(spark, "eda", src, str(tmp_path / "out"), **kw)
    assert os.path.basename(path) == "eda_weather.csv"
    got = _read(spark, path)
    assert Counter(label for label, _ in got) == {"晴": 10, "雨": 20}
    assert {("晴", "明天北京会下雨吗"), ("雨", "今天的气温是25度适合出门"), ("雨", "后天去上海OK吗")} <= set(got)
    assert got == _read(spark, augment_file(spark, "eda", src, str(tmp_path / "again"), **kw))
    known = set("".join(t for _, t in CHINESE)) | set("日雪")
    assert all(text and set(text) <= known for _, text in got)


def test_pivot_file_takes_its_language(spark, tmp_path):
    src = _csv(tmp_path / "a.csv", [("pos", "good film"), ("neg", "bad"), ("", "good")])
    fwd = spark.createDataFrame([("en", "fr", "good", "bon", 1.0)], "src_lang string, pivot_lang string, src string, dst string, p double")
    back = spark.createDataFrame([("fr", "en", "bon", "fine", 0.6), ("fr", "en", "bon", "good", 0.4)],
                                 "pivot_lang string, src_lang string, src string, dst string, p double")
    got = _read(spark, augment_file(spark, "pivot", src, str(tmp_path / "o"), translations=(fwd, back), language="en"))
    assert Counter(got) == {("pos", "good film"): 1, ("pos", "fine film"): 1, ("neg", "bad"): 1, (None, "good"): 1, (None, "fine"): 1}


def test_generated_file_adds_new_texts_only(spark, tmp_path):
    rows = [("x", "a b c"), ("x", "a b c"), ("x", "d b c"), ("x", "a b d")]
    got = Counter(_read(spark, augment_file(spark, "generate", _csv(tmp_path / "g.csv", rows), str(tmp_path / "o"))))
    assert got[("x", "a b c")] == 2 and all(got[r] >= 1 for r in rows)
    texts = {t for _, t in rows}
    assert all(n == 1 or t in texts for (_, t), n in got.items())


def test_rows_without_tokens_and_empty_files(spark, tmp_path):
    df = spark.createDataFrame([("x", None), ("x", ""), ("x", "!"), (None, "a b"), (None, "a b")], "label string, text string")
    units = labelled_units(df).collect()
    assert [(r.label, r.tokens) for r in units] == [(None, ["a", "b"])] * 2 and len({r.unit_key for r in units}) == 2
    assert labelled_units(df, char_tokens).count() == 3
    for method in ("eda", "generate"):
        assert _read(spark, augment_file(spark, method, _csv(tmp_path / "e.csv", []), str(tmp_path / "o"))) == []
    with pytest.raises(ValueError):
        augment_file(spark, "none", _csv(tmp_path / "e.csv", []), str(tmp_path / "o"))
