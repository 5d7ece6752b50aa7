"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each query reads the given tables in full; names follow the operator ids of
the blueprint.  The DuckDB twins live in ``oracles/duckdb_sql.py``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import eda, lexicon
from lexiforge.session import cut_lineage
from lexiforge.sources.corpus import document_sentences, document_units


def _lexicon_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Units feed three branches (stop words, synonyms, look-up): written once to the shared folder (released with the
    # frame) instead of re-reading and re-splitting the texts.
    units = cut_lineage(document_units(spark, sf_dir))
    stops = lexicon.frequent_words(units, 50)
    lex = lexicon.context_synonyms(units)
    return lexicon.attach_lexicon(units, lex, stops)


def q_units(spark, sf_dir):
    u = document_units(spark, sf_dir)
    return u.select("doc_id", "sent_no", "chunk_no", "label", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("text"))


def q_stop_words(spark, sf_dir):
    return lexicon.frequent_words(document_units(spark, sf_dir), 50)


def q_synonyms(spark, sf_dir):
    lex = lexicon.context_synonyms(document_units(spark, sf_dir))
    return lex.select("word", "synonym", "score", F.col("rank").cast("bigint").alias("rank"))


def _technique(tech: str, needs_lexicon: bool):
    def q(spark, sf_dir):
        units = _lexicon_units(spark, sf_dir) if needs_lexicon else document_units(spark, sf_dir)
        out = eda.single_technique(units, tech, n_variants=3, alpha=0.1)
        return out.select("doc_id", "sent_no", "chunk_no", "label",
                          F.col("variant").cast("bigint").alias("variant"), "text")
    return q


def q_eda(spark, sf_dir):
    out = eda.eda(_lexicon_units(spark, sf_dir), num_aug=9)
    return out.select("doc_id", "sent_no", "chunk_no", "label", F.col("aug_no").cast("bigint").alias("aug_no"),
                      "method", "text")


QUERIES = {
    "p3_units": q_units,
    "j6_stop_words": q_stop_words,
    "e13_synonyms": q_synonyms,
    "e1_synonym_replace": _technique("sr", True),
    "e2_random_insert": _technique("ri", True),
    "e3_random_swap": _technique("rs", False),
    "e4_random_delete": _technique("rd", False),
    "e5_eda": q_eda,
}


# --- vocabulary and encoding -------------------------------------------------
from lexiforge.functions.text import char_tokens, normalise_tokens  # noqa: E402
from lexiforge.operators import vocab as vocab_ops  # noqa: E402
from lexiforge.sources.corpus import read_table  # noqa: E402


def q_content_words(spark, sf_dir):
    """Word counts without the stop words, by an anti-join."""
    units = document_units(spark, sf_dir)
    return lexicon.drop_stop_words(vocab_ops.token_counts(units), lexicon.frequent_words(units, 50), "token")


def q_token_freq(spark, sf_dir):
    return vocab_ops.token_counts(document_units(spark, sf_dir))


def q_char_freq(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return vocab_ops.token_counts(conv.select(char_tokens(F.col("text")).alias("tokens")))


def q_vocab(spark, sf_dir):
    return vocab_ops.build_vocab(document_units(spark, sf_dir))


def q_label_vocab(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return vocab_ops.build_label_vocab(conv, "role")


def q_token_probs(spark, sf_dir):
    probs = vocab_ops.token_probs(vocab_ops.build_vocab(document_units(spark, sf_dir)))
    return probs.select("token_id", "token", "cnt", "prob", "cum_prob")


def _encoded(spark, sf_dir):
    units = document_units(spark, sf_dir)
    voc = vocab_ops.build_vocab(units)
    return vocab_ops.encode_units(units, voc, vocab_ops.build_label_vocab(units)), voc


def q_encode(spark, sf_dir):
    enc, _ = _encoded(spark, sf_dir)
    return enc.select("id", "doc_id", "sent_no", "chunk_no", "intent", "len",
                      F.array_join("utter", " ").alias("utter"))


def q_decode(spark, sf_dir):
    enc, voc = _encoded(spark, sf_dir)
    return vocab_ops.decode_ids(enc.select("id", "utter"), voc)


def q_inspect(spark, sf_dir):
    enc, voc = _encoded(spark, sf_dir)
    return vocab_ops.inspect_encoded(enc, voc, 5)


QUERIES.update({
    "j6_content_words": q_content_words,
    "a1_token_freq": q_token_freq,
    "a1_char_freq": q_char_freq,
    "a2_vocab": q_vocab,
    "a3_label_vocab": q_label_vocab,
    "a4_token_probs": q_token_probs,
    "j1_encode": q_encode,
    "j2_decode": q_decode,
    "s13_inspect": q_inspect,
})


# --- noise, batching, sampling -------------------------------------------------
from lexiforge.operators import batching, latent, metrics, mixup, noise  # noqa: E402


def _enc_probs(spark, sf_dir):
    units = document_units(spark, sf_dir)
    voc = vocab_ops.build_vocab(units)
    enc = vocab_ops.encode_units(units, voc, vocab_ops.build_label_vocab(units))
    return enc, vocab_ops.token_probs(voc)


def _ids_text(df, col="utter"):
    return F.array_join(col, " ").alias(col)


def q_noise(spark, sf_dir):
    enc, probs = _enc_probs(spark, sf_dir)
    out = noise.noise_tokens(enc, probs, rate=0.1)
    return out.select("id", "intent", "len", _ids_text("utter"))


def q_random_ood(spark, sf_dir):
    enc, probs = _enc_probs(spark, sf_dir)
    out = noise.random_ood(enc.select("id"), probs, max_len=20)
    return out.select("id", "intent", "len", _ids_text("utter"))


def q_padded_batches(spark, sf_dir):
    enc, _ = _encoded(spark, sf_dir)
    out = batching.padded_batches(enc, 16)
    return out.select("batch_id", "id", "len", "batch_len", _ids_text("utter"))


def q_length_batches(spark, sf_dir):
    enc, _ = _encoded(spark, sf_dir)
    out = batching.length_sorted_batches(enc, 20)
    return out.select("batch_id", "id", "len", "batch_len", _ids_text("utter"))


def q_shuffle(spark, sf_dir):
    return batching.shuffle_places(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["doc_id"])


def q_repeat(spark, sf_dir):
    return batching.repeat_epochs(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), 3)


def q_split(spark, sf_dir):
    return batching.split_train_dev_test(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["doc_id"])


def q_leading(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return batching.leading_fraction(conv, "conv_id", "turn", 0.5)


def q_tiers(spark, sf_dir):
    units = document_units(spark, sf_dir).select("doc_id", "sent_no", "chunk_no", "label")
    return batching.low_resource_tiers(units, ["doc_id", "sent_no", "chunk_no"]).select(
        "doc_id", "sent_no", "chunk_no", "label", "draw_rank", "tier")


# --- vectors: mixup, metrics, Gaussians ---------------------------------------

def _embeddings(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def _r6(c):
    return F.transform(c, lambda x: F.round(x, 6))


def q_sentence_mixup(spark, sf_dir):
    pairs = mixup.mixup_pairs(_embeddings(spark, sf_dir), batch_size=20, rate=0.5, alpha=1.0)
    out = mixup.sentence_mixup(pairs)
    return out.select("batch_id", F.col("i").cast("bigint").alias("i"), "key0", "key1", F.round("lam", 6).alias("lam"),
                      "label0", "label1", F.posexplode("mixed").alias("dim", "value")).select(
        "batch_id", "i", "key0", "key1", "lam", "label0", "label1", F.col("dim").cast("bigint").alias("dim"),
        F.round("value", 6).alias("value"))


def _beta_mixup(rate: float, alpha: float):
    def q(spark, sf_dir):
        pairs = mixup.mixup_pairs(_embeddings(spark, sf_dir), batch_size=20, rate=rate, alpha=alpha)
        return pairs.select("batch_id", F.col("i").cast("bigint").alias("i"), "key0", "key1",
                            F.round("lam", 6).alias("lam"))
    return q


def _logits(df):
    """The first 10 components of an embedding read as class scores."""
    return df.select("vec_id", F.slice("embedding", 1, 10).cast("array<double>").alias("logits"),
                     F.col("label").alias("target"))


def q_accuracy(spark, sf_dir):
    m = metrics.accuracy(_logits(_embeddings(spark, sf_dir)))
    return m.select("n", "correct", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))


def q_mixup_loss(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    pairs = mixup.sentence_mixup(mixup.mixup_pairs(emb, batch_size=20, rate=0.5, alpha=1.0))
    mixed = pairs.select(F.slice("mixed", 1, 10).cast("array<double>").alias("logits"), "lam", "label0", "label1")
    out = mixup.mixup_loss(_logits(emb), mixed)
    return out.select("n_clean", "n_mixed", *[F.round(c, 6).alias(c) for c in ("clean_loss", "mix_loss", "total_loss")])


def q_label_gaussians(spark, sf_dir):
    g = latent.label_gaussians(_embeddings(spark, sf_dir))
    return g.select("label", F.col("dim").cast("bigint").alias("dim"), F.round("mu", 6).alias("mu"),
                    F.round("logvar", 6).alias("logvar"), "n")


def q_kl(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    kl = latent.kl_to_pooled(latent.label_gaussians(emb), latent.pooled_gaussian(emb))
    return kl.select("label", F.round("kl", 5).alias("kl"))


def q_latent(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    z = latent.sample_latent(emb, latent.label_gaussians(emb))
    return z.select("key", "label", F.posexplode("z").alias("dim", "z")).select(
        "key", "label", F.col("dim").cast("bigint").alias("dim"), F.round("z", 4).alias("z"))


def q_corpus_stats(spark, sf_dir):
    return metrics.corpus_stats(document_units(spark, sf_dir))


def q_growth(spark, sf_dir):
    aug = eda.eda(_lexicon_units(spark, sf_dir), num_aug=9)
    return metrics.growth_report(aug)


QUERIES.update({
    "e7_noise_tokens": q_noise,
    "e8_random_ood": q_random_ood,
    "w2_padded_batches": q_padded_batches,
    "w3_length_sorted_batches": q_length_batches,
    "l1_seeded_shuffle": q_shuffle,
    "l2_repeat_epochs": q_repeat,
    "l3_train_dev_test": q_split,
    "l4_leading_fraction": q_leading,
    "l5_low_resource_tiers": q_tiers,
    "e10_sentence_mixup": q_sentence_mixup,
    "e9_beta_draw": _beta_mixup(0.3, 2.0),
    "e9_beta_draw_04": _beta_mixup(0.5, 0.4),
    "e9_beta_draw_15": _beta_mixup(0.5, 1.5),
    "a5_accuracy": q_accuracy,
    "a7_mixup_loss": q_mixup_loss,
    "a14_label_gaussians": q_label_gaussians,
    "a15_kl_divergence": q_kl,
    "e15_latent_sample": q_latent,
    "a10_corpus_stats": q_corpus_stats,
    "a12_growth_report": q_growth,
})


# --- generation and collection ---------------------------------------------------
from lexiforge.operators import collect, ngram  # noqa: E402




def q_transitions(spark, sf_dir):
    t = ngram.fit_transitions(document_units(spark, sf_dir))
    return t.select("label", "prev", "next", "cnt", "total", F.round("p", 9).alias("p"))


def q_greedy(spark, sf_dir):
    units = document_units(spark, sf_dir)
    dec = ngram.greedy(ngram.fit_transitions(units), ngram.starts(units))
    return dec.select("label", "start", F.array_join("seq", " ").alias("seq"), "finished")


def q_beam(spark, sf_dir):
    units = document_units(spark, sf_dir)
    dec = ngram.beam(ngram.fit_transitions(units), ngram.starts(units), beam_width=5)
    return dec.select("label", "start", F.col("rank").cast("bigint").alias("rank"),
                      F.array_join("seq", " ").alias("seq"), "score", "finished")


def q_beam_topk(spark, sf_dir):
    units = document_units(spark, sf_dir)
    trans = ngram.topk_filtered(ngram.fit_transitions(units), 5)
    dec = ngram.beam(trans, ngram.starts(units), beam_width=5)
    return dec.select("label", "start", F.col("rank").cast("bigint").alias("rank"),
                      F.array_join("seq", " ").alias("seq"), "score", "finished")


def q_score_texts(spark, sf_dir):
    units = document_units(spark, sf_dir)
    s = ngram.score_texts(units, ngram.fit_transitions(units))
    return s.select("doc_id", "sent_no", "chunk_no", "label", F.round("nll", 6).alias("nll"), "n_tok")


def q_perplexity(spark, sf_dir):
    units = batching.split_train_dev_test(document_units(spark, sf_dir), ["doc_id"])
    p = ngram.perplexity(units.where("split <> 'train'"), ngram.fit_transitions(units.where("split = 'train'")))
    return p.select("n_utt", "n_tok", *[F.round(c, 6).alias(c) for c in ("token_nll", "ppl", "utt_nll")])


def q_collect(spark, sf_dir):
    units = cut_lineage(document_units(spark, sf_dir))
    trans = ngram.fit_transitions(units)
    st = ngram.starts(units)
    greedy_rows = ngram.generated_rows(units, ngram.greedy(trans, st), "greedy", once=True)
    cands = greedy_rows.select("org", "aug", "method", "label")
    origs = units.select(F.array_join("tokens", " ").alias("org"))
    return collect.collect_generated(cands, origs)


def _all_candidates(spark, sf_dir):
    """(candidates of all three decoders, every hypothesis of a beam, once a source; originals)."""
    units = cut_lineage(document_units(spark, sf_dir))
    trans = cut_lineage(ngram.fit_transitions(units))
    st = cut_lineage(ngram.starts(units))
    decoded = {"greedy": ngram.greedy(trans, st), "beam": ngram.beam(trans, st, beam_width=5),
               "beam_topK": ngram.beam(ngram.topk_filtered(trans, 5), st, beam_width=5)}
    cands = [ngram.generated_rows(units, d, m, once=True).select("org", "aug", "method", "label", "n_rows") for m, d in decoded.items()]
    return reduce(DataFrame.unionByName, cands), units.select(F.array_join("tokens", " ").alias("org"))


def q_collect_all_methods(spark, sf_dir):
    return collect.collect_generated(*_all_candidates(spark, sf_dir))


def q_labelled_texts(spark, sf_dir):
    return collect.labelled_texts(*_all_candidates(spark, sf_dir))


QUERIES.update({
    "g1_fit_transitions": q_transitions,
    "g2a_generate_greedy": q_greedy,
    "g2b_generate_beam": q_beam,
    "g2c_generate_beam_topk": q_beam_topk,
    "g3_score_text": q_score_texts,
    "a8_perplexity": q_perplexity,
    "e12_collect_generated": q_collect,
    "e12_collect_all_methods": q_collect_all_methods,
    "e12_labelled_texts": q_labelled_texts,
})


# --- pivot paraphrase ------------------------------------------------------------
from lexiforge.operators import pivot  # noqa: E402
from lexiforge.plans import rank_alignment  # noqa: E402


def q_paraphrase_table(spark, sf_dir):
    fwd, back = rank_alignment.rank_tables(document_units(spark, sf_dir))
    t = pivot.paraphrase_table(fwd, back)
    return t.select("src_lang", "pivot_lang", "src", "best", F.round("p", 9).alias("p"))


def q_pivot_paraphrase(spark, sf_dir):
    units = document_units(spark, sf_dir)
    fwd, back = rank_alignment.rank_tables(units)
    return pivot.pivot_paraphrase(units, pivot.paraphrase_table(fwd, back))


QUERIES.update({
    "j8_paraphrase_table": q_paraphrase_table,
    "e6_pivot_paraphrase": q_pivot_paraphrase,
})


# --- sources, experiment -----------------------------------------------------------
from lexiforge.plans import augment as augment_plan  # noqa: E402
from lexiforge.plans import experiment  # noqa: E402
from lexiforge.sources import files  # noqa: E402


def q_tagged_rows(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return files.tagged_rows(conv.select("conv_id", "turn", F.col("role").alias("label"), "text")
                             .select("label", "text"))


def _eda_train(train):
    stops = lexicon.frequent_words(train, 50)
    lex = lexicon.context_synonyms(train)
    aug = eda.eda(lexicon.attach_lexicon(train, lex, stops), num_aug=4)
    return aug.select("label", F.split("text", " ").alias("tokens"))


def _generated_train(train):
    """The subset and what its own transitions decode from each first token."""
    out = augment_plan.augment(cut_lineage(train), "generate")
    return out.select("label", F.split("text", " ").alias("tokens"))


def q_gain(spark, sf_dir):
    methods = {"eda": _eda_train, "generate": _generated_train}
    return experiment.gain_table(document_sentences(spark, sf_dir), methods, sizes=(100, 500, 2000, 5000),
                                 tokens=normalise_tokens("sentence"))


QUERIES.update({
    "s11_tagged_rows": q_tagged_rows,
    "m3_gain_experiment": q_gain,
})


# --- preprocessing, union of methods ------------------------------------------------
def q_preprocess(spark, sf_dir):
    units = document_units(spark, sf_dir)
    voc = vocab_ops.build_vocab(units)
    out = vocab_ops.preprocess(units, voc, vocab_ops.build_label_vocab(units))
    return out.select("doc_id", "sent_no", "chunk_no", "intent", F.array_join("utt", " ").alias("utt"))


def q_union_methods(spark, sf_dir):
    units = cut_lineage(document_units(spark, sf_dir))
    return augment_plan.union_methods(units, ("eda", "pivot"), num_aug=9, translations=rank_alignment.rank_tables(units))


QUERIES.update({
    "p12_preprocess": q_preprocess,
    "u2_union_methods": q_union_methods,
})


# --- word vectors ---------------------------------------------------------------------
from lexiforge.operators import vectors  # noqa: E402

VECTOR_DIM = 32


def _scaled(values):
    """Vector components in ten thousandths, as text."""
    return F.array_join(F.transform(values, lambda x: F.floor(x * 10000 + 0.5)), " ")


def _with_vectors(spark, sf_dir):
    units = document_units(spark, sf_dir)
    return units, vectors.random_index_vectors(units, VECTOR_DIM)


def q_word_vectors(spark, sf_dir):
    _, vecs = _with_vectors(spark, sf_dir)
    return vecs.select("word", "links", _scaled(F.col("vector")).alias("vector"))


def q_unit_vectors(spark, sf_dir):
    out = vectors.unit_vectors(*_with_vectors(spark, sf_dir), VECTOR_DIM)
    return out.select("doc_id", "sent_no", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                      F.col("n_covered").cast("bigint").alias("n_covered"),
                      _scaled(vectors.mean_vector(F.col("matrix"), VECTOR_DIM)).alias("mean"))


def q_word_mixup(spark, sf_dir):
    """Sentences as [length, dimension] rows, mixed in batches of 20."""
    out = vectors.mix_sentences(*_with_vectors(spark, sf_dir), VECTOR_DIM)
    return out.select("batch_id", F.col("i").cast("bigint").alias("i"), "key0", "key1", F.round("lam", 6).alias("lam"),
                      "label0", "label1", F.posexplode("mixed").alias("pos", "_m")).select(
        "batch_id", "i", "key0", "key1", "lam", "label0", "label1", F.col("pos").cast("bigint").alias("pos"),
        _scaled(F.col("_m")).alias("mixed"))


def q_vector_coverage(spark, sf_dir):
    return vectors.vector_coverage(*_with_vectors(spark, sf_dir))


QUERIES.update({
    "e13b_word_vectors": q_word_vectors,
    "j5_unit_vectors": q_unit_vectors,
    "e11_word_mixup": q_word_mixup,
    "a10_vector_coverage": q_vector_coverage,
})


# --- stratified tiers ------------------------------------------------------------------
def q_stratified_tiers(spark, sf_dir):
    units = document_units(spark, sf_dir).select("doc_id", "sent_no", "label", F.array_join("tokens", " ").alias("text"))
    out = batching.stratified_tiers(units, ["doc_id", "sent_no"])
    return out.select("doc_id", "sent_no", "label", "text", F.col("label_rank").cast("bigint").alias("label_rank"),
                      "position", F.col("tier").cast("bigint").alias("tier"))


QUERIES["l5_stratified_tiers"] = q_stratified_tiers


# --- slots --------------------------------------------------------------------------------
from lexiforge.functions.text import shape_tags  # noqa: E402


def q_preprocess_slots(spark, sf_dir):
    """P12 with P11: slots are tags of the tokens' shapes."""
    units = document_units(spark, sf_dir).withColumn("slot_tags", shape_tags("tokens"))
    out = vocab_ops.preprocess_slots(units, vocab_ops.build_vocab(units), vocab_ops.build_label_vocab(units),
                                     vocab_ops.build_slot_vocab(units))
    return out.select("doc_id", "sent_no", "chunk_no", "intent", F.array_join("utt", " ").alias("utt"),
                      F.array_join("slots", " ").alias("slots"))


QUERIES["p12_preprocess_slots"] = q_preprocess_slots


# --- streams ------------------------------------------------------------------------------
import uuid  # noqa: E402

from lexiforge.session import ensure_checkpoint_dir  # noqa: E402
from lexiforge.streaming import augment_stream as streams  # noqa: E402


def _streamed(spark, sf_dir, augment) -> str:
    """Streams the documents through ``augment`` into a new folder of the shared folder; returns its path."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    # A pattern, as a stream's plain path must be a folder and the table may be one file.
    docs = streams.document_stream(spark, f"{sf_dir}/documents.parque[t]")
    streams.run_to_parquet(docs, augment, f"{base}/rows", f"{base}/progress").awaitTermination()
    return base


def q_stream_eda(spark, sf_dir):
    """E5 on a stream; lexicon and stop words are static tables."""
    units = cut_lineage(document_units(spark, sf_dir))
    lex, stops = cut_lineage(lexicon.context_synonyms(units)), cut_lineage(lexicon.frequent_words(units, 50))
    base = _streamed(spark, sf_dir, lambda u: eda.eda(lexicon.attach_lexicon(u, lex, stops), num_aug=9))
    return spark.read.parquet(f"{base}/rows").select(
        "doc_id", "sent_no", "chunk_no", "label", F.col("aug_no").cast("bigint").alias("aug_no"), "method", "text")


def q_stream_texts(spark, sf_dir):
    """X1 + A11: the distinct texts that E4 makes of the stream, by state."""
    base = _streamed(spark, sf_dir, lambda u: eda.single_technique(u, "rd", 3, 0.1))
    once = streams.distinct_stream(spark, f"{base}/rows")
    (once.writeStream.format("parquet").option("path", f"{base}/once").option("checkpointLocation", f"{base}/progress-once")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("label string, text string").parquet(f"{base}/once")


QUERIES.update({
    "x1_stream_eda": q_stream_eda,
    "x1_stream_texts": q_stream_texts,
})
