"""The queries of the numbered operators and of the pipeline: each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lexiforge.llm import (
    fim, jaccard, licences, mixing, ngram_lm, packing, quality, sharding, spelling, substrings, token_files, topk, toxicity,
)
from lexiforge.llm.store import shared_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark, sf_dir):
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace("kept", r"[\x20\x09-\x0D]+", " "))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op4_quality(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.apply(table(spark, sf_dir, "documents"), trusted)


def op5_jaccard_join(spark, sf_dir):
    out = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    null_as_largest = lambda c: F.when(F.col(c) < jaccard.LAST, F.col(c))
    return out.select(null_as_largest("id").alias("doc_id"), null_as_largest("class_id").alias("class_id"), "n_links")


def op6_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.place(docs, F.col("doc_id"), F.col("text")).select("doc_id", "slot", "shard", "shard_name")


def op8_lm_scoring(spark, sf_dir):
    return ngram_lm.fit_and_score(table(spark, sf_dir, "documents"), order=ngram_lm.ORDER)


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_spelling(spark, sf_dir):
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_fim(spark, sf_dir):
    out = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = fim.restored(F.col("output"), F.col("form"))
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(text, 256).alias("restored_sha256"))


def op13_token_files(spark, sf_dir):
    folder = token_files.write(table(spark, sf_dir, "documents"), shared_table(spark, "token-files"))
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_topk": op6_topk,
    "op7_sharding": op7_sharding,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_packing": op9_packing,
    "op10_licences": op10_licences,
    "op11_spelling": op11_spelling,
    "op12_fim": op12_fim,
    "op13_token_files": op13_token_files,
    "pipeline": corpus_pipeline.run,
}
