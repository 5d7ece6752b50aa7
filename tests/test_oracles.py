"""Registered queries against their DuckDB twins on the smallest tables."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

FAST = ["p3_units", "j6_stop_words", "e13_synonyms", "e1_synonym_replace", "e2_random_insert",
        "e3_random_swap", "e4_random_delete", "e5_eda", "a2_vocab", "j1_encode", "e7_noise_tokens",
        "e8_random_ood", "w2_padded_batches", "l3_train_dev_test", "l5_low_resource_tiers",
        "e10_sentence_mixup", "a5_accuracy", "a7_mixup_loss", "a15_kl_divergence", "g1_fit_transitions",
        "g2a_generate_greedy", "g2b_generate_beam", "g2c_generate_beam_topk", "a8_perplexity", "j6_content_words",
        "l1_seeded_shuffle", "e12_collect_generated", "e6_pivot_paraphrase", "e13b_word_vectors", "j5_unit_vectors", "e11_word_mixup",
        "a10_vector_coverage", "l4_leading_fraction", "l5_stratified_tiers"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def _rows(cols, rows):
    return Counter(tuple(_norm(r[c]) for c in cols) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = _rows(cols, [r.asDict() for r in sdf.collect()])
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    drows = _rows(cols, [dict(zip(rel.columns, r)) for r in rel.fetchall()])
    assert srows == drows


def test_every_query_has_a_callable_and_all_but_the_experiment_have_sql():
    from lexiforge.plans.queries import QUERIES

    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and set(QUERIES) <= set(qs)
    assert set(QUERIES) - set(sql) == {"m3_gain_experiment"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["doc_id", "sent_no", "chunk_no", "label", "aug_no", "method", "text"]
