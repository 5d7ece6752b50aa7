"""Vocabularies, encoding and decoding.

Token counts are aggregated with a map-side combine, so frequent tokens shrink
before the shuffle.  Look-ups (token -> id) join each block's distinct words
with the vocabulary (``functions/lookup.py``), not a row per token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.ids import dense_index
from lexiforge.functions.lookup import look_up
from lexiforge.functions.text import EOS_ID, GO_ID, RESERVED_LABELS, RESERVED_TOKENS, UNK_ID, normalise_label, slot_names
from lexiforge.session import cut_lineage


def token_counts(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """A1: (token, cnt)."""
    return (df.select(F.explode(tokens_col).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("cnt")))


def build_vocab(df: DataFrame, tokens_col: str = "tokens", reserved=RESERVED_TOKENS,
                limit: int | None = None) -> DataFrame:
    """A2 + W4: (id, token, cnt): reserved entries first (cnt 0), then tokens by
    count descending, ties by token.  ``limit`` keeps the first ids (S5)."""
    counts = token_counts(df, tokens_col).where(~F.col("token").isin(list(reserved)))
    ranked = dense_index(counts, [F.desc("cnt"), F.asc("token")], start=len(reserved))
    spark = df.sparkSession
    res = spark.createDataFrame([(i, t, 0) for i, t in enumerate(reserved)], "id bigint, token string, cnt bigint")
    vocab = res.unionByName(ranked.select("id", "token", "cnt"))
    return vocab.where(F.col("id") < limit) if limit is not None else vocab


def build_label_vocab(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A3: (id, label, cnt) over normalised labels, <_UNK> first."""
    counts = (df.select(normalise_label(F.col(label_col)).alias("label"))
              .where(F.col("label").isNotNull())
              .groupBy("label").agg(F.count(F.lit(1)).alias("cnt")))
    ranked = dense_index(counts, [F.desc("cnt"), F.asc("label")], start=len(RESERVED_LABELS))
    spark = df.sparkSession
    res = spark.createDataFrame([(i, t, 0) for i, t in enumerate(RESERVED_LABELS)], "id bigint, label string, cnt bigint")
    return res.unionByName(ranked.select("id", "label", "cnt"))


def token_probs(vocab: DataFrame) -> DataFrame:
    """A4 (+ D8): (token_id, token, cnt, prob, cum_prob) over entries with a
    count, in id order; the running sum is computed per partition plus offsets."""
    counted = vocab.where(F.col("cnt") > 0).withColumnRenamed("id", "token_id")
    ranked = dense_index(counted, [F.asc("token_id")], id_col="_rank", value_col="cnt")
    return ranked.select("token_id", "token", "cnt",
                         (F.col("cnt") / F.col("total_cnt")).alias("prob"),
                         (F.col("cum_cnt") / F.col("total_cnt")).alias("cum_prob"),
                         "cum_cnt", "total_cnt")


def _token_ids(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.col("token").alias("word"), F.col("id").cast("int").alias("value"))


def _no_null(array) -> Column:
    """Without null elements; a null array is empty."""
    return F.coalesce(F.array_compact(array), F.array().cast("array<string>"))


def encode_units(units: DataFrame, vocab: DataFrame, label_vocab: DataFrame, max_len: int = 100,
                 unknown_label_id: int = 0) -> DataFrame:
    """J1 + J3 + P7 + S10: (id, intent, len, full_len, utter array<int>, keys...).

    ``id`` is a running id in key order (U3).  Unknown tokens map to <_UNK>,
    unknown labels to ``unknown_label_id`` (0 = <_UNK>, -1 in preprocessing).
    At most ``max_len`` ids with <_GO> and <_EOS>, which are set around the
    looked-up ids and so are no hot keys of the join.  Longer sentences are cut
    there, as the reference does (its max_utter_len): ``full_len`` is the length
    without the cut, so rows with full_len > len are the cut ones."""
    keys = ["doc_id", "sent_no", "chunk_no"]
    cut = units.where(F.size("tokens") > 0).select(
        *keys, normalise_label(F.col("label")).alias("label"), (F.size("tokens") + 2).alias("full_len"),
        F.slice("tokens", 1, max_len - 2).alias("tokens"))
    rebuilt = (look_up(cut, {"tokens": _token_ids(vocab)}, merge=[*keys, "label", "full_len"], missing=UNK_ID)
               .select(*keys, "label", "full_len", F.concat(F.array(F.lit(GO_ID)), F.col("tokens_found"),
                                                            F.array(F.lit(EOS_ID))).alias("utter")))
    labelled = rebuilt.join(label_vocab.select("label", F.col("id").alias("lid")), "label", "left")
    numbered = dense_index(labelled, [F.asc(k) for k in keys], id_col="id")
    return numbered.select("id", *keys,
                           F.coalesce("lid", F.lit(unknown_label_id)).cast("int").alias("intent"),
                           F.size("utter").alias("len"), "full_len", "utter")


def decode_ids(encoded: DataFrame, vocab: DataFrame, ids_col: str = "utter", sep: str = " ",
               drop_reserved: bool = False) -> DataFrame:
    """J2 + P9: ids -> text; ids without an entry are dropped, and rows without any.  The distinct ids of a block of rows are
    looked up (``functions/lookup.py``), no row per token travels."""
    keys = [c for c in encoded.columns if c != ids_col]
    kind = encoded.schema[ids_col].dataType.elementType
    v = vocab.where(F.col("id") >= len(RESERVED_TOKENS)) if drop_reserved else vocab
    known = v.where(F.col("token").isNotNull()).select(F.col("id").cast(kind).alias("word"), F.col("token").alias("value"))
    found = look_up(encoded.select(*keys, ids_col), {ids_col: known}, keys[0], keys)
    tokens = F.array_compact(f"{ids_col}_found")
    return found.where(F.size(tokens) > 0).select(*keys, F.array_join(tokens, sep).alias("text"))


def inspect_encoded(encoded: DataFrame, vocab: DataFrame, n: int = 5) -> DataFrame:
    """The first n+1 records (by id) decoded back to tokens."""
    head = encoded.where(F.col("id") <= n).select("id", "intent", "len", "utter")
    return decode_ids(head, vocab)


def preprocess(units: DataFrame, vocab: DataFrame, label_vocab: DataFrame) -> DataFrame:
    """Lower-cased label with 'other' folding, intent -1 when unknown,
    tokens -> ids with <_UNK>, <_EOS> appended."""
    keys = ["doc_id", "sent_no", "chunk_no"]
    rows = units.select(*keys, normalise_label(F.col("label")).alias("label"), _no_null("tokens").alias("tokens"))
    rebuilt = (look_up(rows, {"tokens": _token_ids(vocab)}, merge=[*keys, "label"], missing=UNK_ID)
               .select(*keys, "label", F.concat("tokens_found", F.array(F.lit(EOS_ID))).alias("utt")))
    return (rebuilt.join(label_vocab.select("label", F.col("id").alias("lid")), "label", "left")
            .select(*keys, F.coalesce("lid", F.lit(-1)).cast("int").alias("intent"), "utt"))


def build_slot_vocab(units: DataFrame, tags_col: str = "slot_tags") -> DataFrame:
    """(id, slot, cnt): slot names by the number of rows that hold them, ties by
    name, ids from 0."""
    # The outer form: the optimiser gives it no filter that would make the names twice.
    counts = (units.select(F.explode_outer(slot_names(F.transform(tags_col, F.lower))).alias("slot")).where(F.col("slot").isNotNull())
              .groupBy("slot").agg(F.count(F.lit(1)).alias("cnt")))
    return dense_index(counts, [F.desc("cnt"), F.asc("slot")], id_col="id").select("id", "slot", "cnt")


def preprocess_slots(units: DataFrame, vocab: DataFrame, label_vocab: DataFrame, slot_vocab: DataFrame,
                     tags_col: str = "slot_tags") -> DataFrame:
    """P12 with P11: ``preprocess`` of units that carry slot tags, with ``slots``,
    a 0/1 vector over the slot vocabulary.

    Slot names are looked up with the tokens, in one cogroup.  Names that are not in the vocabulary are left out; rows without
    tags (null too) have zeros only; an empty vocabulary gives empty vectors."""
    keys = ["doc_id", "sent_no", "chunk_no"]
    # Written once: its size is the length of every vector.
    slot_vocab = cut_lineage(slot_vocab)
    n_slots = (slot_vocab.agg(F.max("id")).first()[0] if not slot_vocab.isEmpty() else -1) + 1
    names = _no_null(slot_names(F.transform(tags_col, F.lower)))
    rows = units.select(*keys, normalise_label(F.col("label")).alias("label"), _no_null("tokens").alias("tokens"), names.alias("names"))
    slot_ids = slot_vocab.select(F.col("slot").alias("word"), F.col("id").cast("int").alias("value"))
    rebuilt = (look_up(rows, {"tokens": _token_ids(vocab), "names": slot_ids}, merge=[*keys, "label"])
               .select(*keys, "label", F.concat(F.transform("tokens_found", lambda i: F.coalesce(i, F.lit(UNK_ID))),
                                                F.array(F.lit(EOS_ID))).alias("utt"), F.col("names_found").alias("_s")))
    places = F.sequence(F.lit(0), F.lit(n_slots - 1)) if n_slots else F.array().cast("array<int>")
    hot = F.transform(places, lambda k: F.coalesce(F.array_contains("_s", k), F.lit(False)).cast("int"))
    return (rebuilt.join(label_vocab.select("label", F.col("id").alias("lid")), "label", "left")
            .select(*keys, F.coalesce("lid", F.lit(-1)).cast("int").alias("intent"), "utt", hot.alias("slots")))
