"""File sources and sinks.

Schemas are fixed by position (label first, text second) and never inferred.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions.ids import dense_index
from lexiforge.session import cut_lineage

LABELLED_SCHEMA = "label string, text string"


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header line, RFC quotes: (label, text)."""
    return (spark.read.schema(LABELLED_SCHEMA).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def read_labelled_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, no header, no quoting: (label, text); the text is all after the first tab."""
    line = F.col("value")
    return spark.read.text(path).where(F.length(line) > 0).select(
        F.substring_index(line, "\t", 1).alias("label"),
        F.when(F.instr(line, "\t") > 0, F.expr("substring(value, instr(value, '\t') + 1)")).alias("text"))


def numbered_lines(spark: SparkSession, path: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(file, line_no, id, value) of the lines of one or many text files,
    each file read by as many tasks as it has splits.

    ``line_no`` counts a file's lines from 0, ``id`` all files' lines in path
    order; ``keep`` (a condition on the line) is applied before counting.  A
    line's number is its place in its split plus the lines in the splits
    before; the window runs over one row per split."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    if keep is not None:
        lines = lines.where(keep(F.col("value")))
    # A split's lines have consecutive numbers in their task; written once, as both uses must see the same.
    placed = cut_lineage(lines.withColumn("_at", F.monotonically_increasing_id()))
    splits = placed.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    splits = splits.withColumn("_file_off", F.min("_off").over(Window.partitionBy("file")))
    at = F.col("_at") - F.col("_first") + F.col("_off")
    return placed.join(splits, ["file", "_block"]).select(
        "file", (at - F.col("_file_off")).alias("line_no"), at.alias("id"), "value")


def read_tagged(spark: SparkSession, path: str, min_fields: int = 3) -> DataFrame:
    """S3: tagged utterances ``domain<TAB>label<TAB>tokens[<TAB>slots...]``;
    blank lines and rows with fewer than ``min_fields`` fields are dropped.
    ``file``, ``line_no`` and ``id`` keep the input order (U3)."""
    lines = numbered_lines(spark, path)
    parts = lines.where(F.trim("value") != "").select("file", "line_no", "id", F.split("value", "\t").alias("f"))
    return parts.where(F.size("f") >= min_fields).select(
        "file", "line_no", "id", F.col("f")[0].alias("domain"), F.col("f")[1].alias("label"),
        F.col("f")[2].alias("text"), F.when(F.size("f") >= 4, F.col("f")[3]).alias("slots"))


def read_stop_words(spark: SparkSession, path: str, list_name: str = "default") -> DataFrame:
    """S4."""
    from lexiforge.operators.lexicon import read_stop_words as _r
    return _r(spark, path, list_name)


def read_vocab(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Non-blank stripped lines, id = line order, optional first-N."""
    out = numbered_lines(spark, path, lambda line: F.trim(line) != "").select("id", F.trim("value").alias("token"))
    return out.where(F.col("id") < limit) if limit is not None else out


def read_char_freq(spark: SparkSession, path: str, vocab: DataFrame) -> DataFrame:
    """``char count`` lines with two fields whose char is in the
    vocabulary; probabilities over the kept counts (D8)."""
    rows = (spark.read.text(path)
            .select(F.split(F.trim("value"), "\\s+").alias("f"))
            .where((F.size("f") == 2) & (F.col("f")[0] != ""))
            .select(F.col("f")[0].alias("token"), F.col("f")[1].cast("bigint").alias("cnt")))
    kept = rows.join(vocab.select("token", F.col("id").alias("token_id")), "token")
    ranked = dense_index(kept, [F.asc("token_id"), F.asc("token")], id_col="_r", value_col="cnt")
    return ranked.select("token_id", "token", "cnt", (F.col("cnt") / F.col("total_cnt")).alias("prob"),
                         (F.col("cum_cnt") / F.col("total_cnt")).alias("cum_prob"), "cum_cnt", "total_cnt")


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word v1 v2 ...``: split at the first space, the rest floats."""
    line = F.trim("value")
    first = F.instr(line, " ")
    return (spark.read.text(path).where(F.instr(F.trim("value"), " ") > 0)
            .select(F.substring(line, 1, first - 1).alias("word"),
                    F.split(F.trim(F.expr("substring(trim(value), instr(trim(value), ' ') + 1)")), "\\s+")
                    .cast("array<float>").alias("vector")))


def augmented_name(method: str, input_path: str) -> str:
    """Output file name ``<method>_<input basename>``."""
    return f"{method}_{os.path.basename(input_path.rstrip('/'))}"


def write_labelled_csv(df: DataFrame, out_dir: str, method: str, input_path: str) -> str:
    """Header ``label,text``; one folder named after method and input."""
    path = os.path.join(out_dir, augmented_name(method, input_path))
    df.select("label", "text").write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)
    return path


def write_result_table(df: DataFrame, path: str, four_columns: bool = True) -> None:
    """The 4-column (org, aug, method, label) table is appended, the
    2-column (label, text) table overwritten.  (No byte-order mark.)"""
    if four_columns:
        df.select("org", "aug", "method", "label").write.mode("append").option("header", True).option("escape", "\"").csv(path)
    else:
        df.select("label", "text").write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def write_encoded(df: DataFrame, path: str, split: str | None = None) -> None:
    """Encoded examples, one output per input split: the column ``split``, or all rows as the given split."""
    df = df if split is None else df.withColumn("split", F.lit(split))
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def tagged_rows(df: DataFrame, label_col: str = "label", text_col: str = "text") -> DataFrame:
    """(domain 'root', label, the text's characters separated by spaces)."""
    chars = F.filter(F.split(F.col(text_col), ""), lambda c: c != F.lit(""))
    return df.select(F.lit("root").alias("domain"), F.col(label_col).alias("label"),
                     F.array_join(chars, " ").alias("text"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """``token<TAB>count``, most common first (ties by token)."""
    (vocab.orderBy(F.desc("cnt"), "token")
     .select(F.concat_ws("\t", "token", F.col("cnt").cast("string")).alias("value"))
     .write.mode("overwrite").text(path))
