"""A training corpus from ``documents``: toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut, sources are mixed to target weights, and the result is packed into sequences.

A stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of ``documents``; the last returns
the pieces of the packed sequences.  ``run`` writes each stage's result as Parquet to the shared folder and reads it again.

Defined results: an empty table goes through all stages; null texts count as empty; documents whose words are all cut stay as
empty texts; a document that the mix takes several times has as many rows; extra columns, whatever their names, come through the first
four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import jaccard, mixing, packing, substrings, toxicity
from lexiforge.llm.store import shared_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below one half."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a Jaccard similarity of 0.8 or more."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    out, old = substrings.remove_repeats(docs), F.col("row").getField
    now = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long"))}
    changed = lambda c: now[c] if c == "text" else F.coalesce(now[c], old(c)) if c in now else old(c)
    return out.select(*[changed(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_table(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Scores, tokenizer ids and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
