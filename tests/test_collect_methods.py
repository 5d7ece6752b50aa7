"""The collector on all three decoders, in both forms, on a small hand-made table."""

from collections import Counter

import pytest

import __spark_entry__ as entry

TEXTS = ["a b c d. a b c e. b c d. c d. a c d e. b d", "a b d. a e e. q r. r q. q r", "b c e. c e d. a d", None, ""]


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """name -> (columns, rows of the query, rows of its twin)."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("collect"))
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    out = {}
    for name in ("e12_collect_all_methods", "e12_labelled_texts"):
        sdf, rel = entry.queries()[name](spark, folder), con.sql(entry.oracle_sql()[name])
        assert sorted(rel.columns) == sorted(sdf.columns)
        out[name] = sdf.columns, [tuple(r) for r in sdf.collect()], rel.select(*sdf.columns).fetchall()
    return out


@pytest.mark.parametrize("name", ["e12_collect_all_methods", "e12_labelled_texts"])
def test_collector_matches_duckdb(results, name):
    _, got, want = results[name]
    assert got and Counter(got) == Counter(want)


def test_all_methods_are_collected_once_and_in_their_order(results):
    columns, got, _ = results["e12_collect_all_methods"]
    assert columns == ["label", "text", "method", "org", "aug"]
    assert {"greedy", "beam"} <= {r[2] for r in got} and max(Counter(r[4] for r in got).values()) == 1
    columns, every, _ = results["e12_labelled_texts"]
    assert columns == ["label", "text"] and len(every) > len(got) and {r[1] for r in every} == {r[1] for r in got}
