"""The pipeline on a small corpus with planted cases, stage by stage against brute force."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiforge.llm import mixing
from tests.llm.conftest import SCHEMA, make_rows, words_of
from tests.llm.test_text_operators import LAST, _classes, _layout_ok, _repeats


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows): the awkward rows, and 40 texts with a word that only toxic texts have."""
    rows = make_rows()
    rows += [(1000 + i, f"plain w{i} words w{i * 3} here villainous w{i + 7} and w{i * 5} villainous", "en", "s1", 1) for i in range(40)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 0, 1) for i in range(55)] + [(1000 + i, 1, 1) for i in range(25)] + [(None, 1, 1), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages(spark, corpus):
    d, rows = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, key = docs.columns, lambda i: LAST if i is None else i

    clean = corpus_pipeline.drop_toxic(spark, docs, d).cache()
    kept = [tuple(r) for r in clean.collect()]
    assert clean.columns == columns
    assert Counter(map(str, kept)) == Counter(str(r) for r in rows if "villainous" not in (r[1] or ""))

    single = corpus_pipeline.drop_near_duplicates(spark, clean, d).cache()
    assert single.columns == columns
    left = [tuple(r) for r in single.collect()]
    assert {key(r[0]) for r in left} == {c for _, c, _ in _classes(kept)}

    cut = corpus_pipeline.cut_repeats(spark, single, d).cache()
    assert cut.columns == columns
    want = Counter((k[0], k[3]) for k in _repeats(left, 50).elements())
    assert Counter((r.doc_id, " ".join(words_of(r.text))) for r in cut.collect()) == want

    mixed = corpus_pipeline.mix_sources(spark, cut, d).cache()
    assert mixed.columns == columns
    size, target = Counter(), {r.source: r.target for r in mixing.mix(cut).collect()}
    longest = defaultdict(int)
    for r in cut.collect():
        longest[r.source] = max(longest[r.source], len(words_of(r.text)))
    for r in mixed.collect():
        size[r.source] += len(words_of(r.text))
    assert all(abs(size[s] - t) <= longest[s] / 2 + 1e-6 for s, t in target.items())

    pieces = corpus_pipeline.pack_sequences(spark, mixed, d).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())
    _layout_ok(pieces, 2048)


def test_run_is_the_stages(spark, corpus):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    # several copies of a piece may change places
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, d)
    assert Counter(map(str, got.select(columns).collect())) == Counter(map(str, docs.select(columns).collect()))


def test_an_empty_corpus(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []


def test_planted_cases_are_caught(spark):
    """No text of the result's first four stages repeats, and labelled clean documents that have no copy stay."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, out, d)
    texts = [r.text for r in out.collect()]
    assert len(set(texts)) == len(texts)
    clean = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 0").collect()}
    counts = Counter(re.sub(r"\s+", " ", r.text) for r in docs.collect())
    alone = {r.doc_id for r in docs.collect() if counts[re.sub(r"\s+", " ", r.text)] == 1} & clean
    stay = {r.doc_id for r in out.select("doc_id").collect()}
    assert len(alone - stay) <= 0.1 * len(alone) and out.where(F.col("text").isNull()).count() == 0
