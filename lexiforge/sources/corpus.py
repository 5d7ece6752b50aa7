"""Labelled text units from the driver tables.

The unit is a whole sentence.  A caller may ask for pieces of at most
``max_tokens`` consecutive tokens instead (all pieces are kept); no registered
query does, as a cut shows false starts and ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import LETTER_CLASS, SENTENCE_MARKS, normalise_tokens
from lexiforge.session import spread

# A piece of so many tokens is the whole sentence.
WHOLE = 1 << 30


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_units(df: DataFrame, key_col: str, text_col: str, label_col: str,
                max_tokens: int = WHOLE, char_class: str = LETTER_CLASS) -> DataFrame:
    """(key, text, label) -> (doc_id, sent_no, chunk_no, unit_key, label, tokens).

    Narrow (no shuffle): explode sentences already normalised, then pieces.
    The normalised tokens leave the generator as a column: a filter or a second
    generator over the expression would evaluate it anew.  The outer form is
    not given such filters by the optimiser."""
    sents = F.transform(F.split(F.col(text_col), SENTENCE_MARKS), lambda s: normalise_tokens(s, char_class))
    units = (df.select(F.col(key_col).alias("doc_id"), F.col(label_col).alias("label"),
                       F.posexplode_outer(sents).alias("sent_no", "tokens"))
             .where(F.size("tokens") > 0))
    chunk_no = F.lit(0)
    if max_tokens < WHOLE:
        n_pieces = F.ceil(F.size("tokens") / F.lit(max_tokens)).cast("int")
        units = units.select("doc_id", "label", "sent_no", F.posexplode_outer(F.transform(
            F.sequence(F.lit(0), n_pieces - 1), lambda k: F.slice("tokens", k * max_tokens + 1, max_tokens))).alias("chunk_no", "tokens"))
        chunk_no = F.col("chunk_no")
    return units.select(
        "doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), chunk_no.cast("bigint").alias("chunk_no"),
        F.concat_ws(":", "doc_id", "sent_no", chunk_no).alias("unit_key"), "label", "tokens")


def document_sentences(spark: SparkSession, sf_dir: str, label_col: str = "lang") -> DataFrame:
    """The rows of ``document_units`` with their ``sentence`` as it stands in the text: ``normalise_tokens`` of it are the tokens.
    A step that picks rows need not make the tokens of all."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", label_col), "doc_id")
    # A sentence has a token if it has a character of the class that the cleaner keeps.
    return (docs.select("doc_id", F.col(label_col).alias("label"),
                        F.posexplode_outer(F.split("text", SENTENCE_MARKS)).alias("sent_no", "sentence"))
            .where(F.col("sentence").rlike(LETTER_CLASS.replace("^", "", 1)))
            .select("doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), F.lit(0).cast("bigint").alias("chunk_no"),
                    F.concat_ws(":", "doc_id", "sent_no", F.lit(0)).alias("unit_key"), "label", "sentence"))


def document_units(spark: SparkSession, sf_dir: str, max_tokens: int = WHOLE,
                   label_col: str = "lang") -> DataFrame:
    """Units of the ``documents`` table, label = language."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", label_col), "doc_id")
    return split_units(docs, "doc_id", "text", label_col, max_tokens)


# ---------------------------------------------------------------------------
# SQL twin (DuckDB) of ``split_units`` for the oracles.
# ---------------------------------------------------------------------------

def sql_units(table: str = "documents", key: str = "doc_id", text: str = "text", label: str = "lang",
              max_tokens: int = WHOLE) -> str:
    return f"""
    (WITH _d AS (
        SELECT {key} AS doc_id, {label} AS label, string_split_regex({text}, '[.!?\\n]') AS sents FROM {table}),
     _s AS (
        SELECT doc_id, label, t.i AS sent_no,
               list_filter(string_split_regex(lower(regexp_replace(sents[t.i + 1], '[^\\p{{L}}0-9]', ' ', 'g')), '\\s'),
                           lambda w: w <> '') AS all_tokens
        FROM _d, unnest(range(len(sents))) AS t(i)),
     _p AS (
        SELECT doc_id, label, sent_no, all_tokens, c.k AS chunk_no
        FROM _s, unnest(range(CAST(ceil(len(all_tokens) / {max_tokens}) AS BIGINT))) AS c(k)
        WHERE len(all_tokens) > 0)
     SELECT doc_id, sent_no, chunk_no,
            concat_ws(':', doc_id, sent_no, chunk_no) AS unit_key, label,
            all_tokens[chunk_no * {max_tokens} + 1 : chunk_no * {max_tokens} + {max_tokens}] AS tokens
     FROM _p)"""
