"""Small tables with the awkward rows that every operator must take."""

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use for their own work.
CLASHES = "size long, row string, score double, key string, id long, words string, first boolean, n long, digest string"


def words_of(text):
    return WORD.findall(text or "")


def _prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


def make_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, near copies, shared passages, ties."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    base = " ".join(f"b{i} x{i * i}" for i in range(90))
    near = base.replace("b40 ", "changed ")
    texts = [_prose(rng, rng.randint(1, 300)) for _ in range(60)]
    texts += [base] * 4 + [near, near + " tail", base + " end of it"]
    texts += [f"{_prose(rng, 30)}\n{passage}\t{_prose(rng, 25)}" for _ in range(5)]
    texts += [passage, " ".join(["again"] * 500), "", " \n\t ", None, None, "one", "two words", "É ü\x0bß\x1cz  nbsp", "a b c d e", "a b c d e"]
    texts += [_prose(rng, 6000, 90000)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s3", 9), (None, base, "de", "s1", 1), (None, None, None, None, None), (500, base, "en", "s1", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def wide(spark, rows):
    """The same rows with extra columns whose names clash."""
    extra = (7, "r", 0.5, "k", 3, "w", True, 9, "d")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{SCHEMA}, {CLASHES}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
