"""Operator 11: spelling variants, grouped under the form that is written most.

Words that differ by one inserted, deleted or replaced code point are near.  They are found through an index of variable-length
grams:

1. Gram dictionary.  Words are taken with a mark before and after.  Grams of two and three code points are counted over all words;
   one in more than ``EXTEND`` places is too frequent to select and is not kept as it is but extended by the next code point, up
   to ``MAX_GRAM``.  The dictionary is one bit for each possible gram: 2^21 + 2^14 bits whatever the corpus.
2. Decomposition.  At each place a word has the shortest gram that is not extended.  A gram depends on its own code points only,
   so an edit changes just the grams that cover it, and the others are found again in the other word, moved by one at most.
3. Affected grams.  Any set of a word's grams has a bound: the most of them that one edit touches.  Of bound + 1 grams at least
   one is left, so only that many lists must be merged.  Two grams without a common code point have the bound 1; each word takes
   the two such grams with the shortest lists, one before the other: if the edit touches the first or stands before it, the second is
   left.  List lengths come from a table of counts of fixed size.  Lists are told apart by length of the word and place of the gram;
   words are entered only in lists that someone merges.
4. Verification by the edit distance itself, in the condition of the join, so that no unverified pair is ever a row.

A list for which words times entries exceed ``HOT_PAIRS`` is not merged pair by pair: its words go on by what is left when one code
point is masked (or taken out, for a partner that is longer), and words that agree in that are near; such groups are bounded by
the alphabet.
Of words longer than ``LONG`` only the grams near both ends are indexed, which leaves the bound argument as it is.

Defined results: null and empty texts have no words; a null document id is hashed as ``null``; repeated rows count each time;
an empty table gives no rows; other columns of ``docs`` are not read, whatever their names; ties go to the smaller word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.store import keep
from lexiforge.llm.words import mix

#: Runs of letters; all of them are one byte in Latin-1.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT = 5, 3
#: One of so many (document, run) pairs loses a code point.
DROP_ONE_IN = 97
MIN_GRAM, MAX_GRAM = 2, 4
EXTEND = 300
HOT_PAIRS = 4_000_000
LONG, EDGE = 40, 16
#: Logarithm of the number of counts that estimate list lengths.
LIST_BITS = 21
#: Distinct words that a task counts before it hands them on.
FLUSH_WORDS = 400_000

_FIRST, _LAST = 91, 92
_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = np.arange(1, 27)
_CODE[0xC0:0x100] = np.arange(27, 91)


# -- words ------------------------------------------------------------------------------------------------------------

def runs_of(doc_id: int | None, text: bytes) -> Counter:
    """Lower-cased runs of a text with their counts, one code point taken out of those that the hash picks."""
    seed = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text.lower().decode())).items():  # bytes.lower() knows A-Z only
        h = zlib.crc32(run.encode(), seed)
        if h % DROP_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of every word of enough code points and occurrences."""

    def task(batches):
        total: dict[str, int] = {}

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                for w, n in runs_of(i, t.as_py() or b"").items():
                    if len(w) >= min_length:
                        total[w] = total.get(w, 0) + n
                if len(total) >= FLUSH_WORDS:
                    yield counted()
                    total.clear()
        yield counted()

    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- grams ------------------------------------------------------------------------------------------------------------

def coded(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (positions in ``words``, one row of codes for each with the marks)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        letters = np.frombuffer("".join(words[k] for k in at).encode("latin-1"), np.uint8).reshape(len(at), n)
        codes = np.empty((len(at), n + 2), np.uint32)
        codes[:, 0], codes[:, -1], codes[:, 1:-1] = _FIRST, _LAST, _CODE[letters]
        out[int(n)] = at, codes
    return out


def _gram(codes: np.ndarray, q: int) -> np.ndarray:
    """Grams of q codes at each place, seven bits a code."""
    g, width = np.zeros((len(codes), codes.shape[1] - q + 1), np.uint32), codes.shape[1] - q + 1
    for k in range(q):
        g = g << np.uint32(7) | codes[:, k:k + width]
    return g


def longest_gram(group: int) -> int:
    """The most code points of a gram where words of ``group`` code points meet: an edit must leave a gram on one of its sides."""
    return min(MAX_GRAM, (group + 1) // 2)


def decompose(codes: np.ndarray, frequent: dict[int, np.ndarray], group: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, hashes) of the gram at each place but the last mark, for words of one length."""
    rows, places = len(codes), codes.shape[1] - 1
    q = np.full((rows, places), MIN_GRAM, np.int64)
    gram = _gram(codes, MIN_GRAM).astype(np.uint64)
    for n in range(MIN_GRAM + 1, longest_gram(group) + 1):
        if codes.shape[1] < n:
            break
        longer, width = _gram(codes, n).astype(np.uint64), codes.shape[1] - n + 1
        grow = np.zeros((rows, places), bool)
        grow[:, :width] = (q[:, :width] == n - 1) & frequent[n - 1][gram[:, :width].astype(np.int64) * (q[:, :width] == n - 1)]
        q[grow] = n
        gram[:, :width] = np.where(grow[:, :width], longer, gram[:, :width])
    return q, mix(gram << np.uint64(8) | q.astype(np.uint64))


def list_keys(group: int, longer: int, places: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The list of words of ``group + longer`` code points with a gram at a place, among partners of ``group`` code points."""
    at = (np.uint64(group) << np.uint64(33)) + (np.uint64(longer) << np.uint64(32)) + places.astype(np.uint64)
    return mix(grams + mix(at + np.uint64(1)))


def _near_ends(places: np.ndarray, length: int, group: int, edge: int) -> np.ndarray:
    return (places < edge) | (places > length - edge) if group > LONG else np.ones(places.shape, bool)


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - LIST_BITS)).astype(np.int64)


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8))


def postings(words: list[str], frequent: dict[int, np.ndarray], min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position, list, 1 if the list is for shorter partners) of every indexed gram."""
    out = [_NONE]
    for n, (at, codes) in coded(words).items():
        places = np.arange(n + 1)
        for longer in (0, 1):
            if n - longer >= min_length:
                _, grams = decompose(codes, frequent, n - longer)
                own = places[_near_ends(places, n, n - longer, EDGE + 1)]
                keys = list_keys(n - longer, longer, own[None], grams[:, own])
                out.append((np.repeat(at, len(own)), keys.reshape(-1), np.full(keys.size, longer, np.int8)))
    return tuple(np.concatenate(c) for c in zip(*out))


def cheapest_two(q: np.ndarray, first_cost: np.ndarray, second_cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of two grams, the first ending before the second begins, of the least cost together."""
    rows, places = q.shape
    at = np.arange(places)
    ends = np.full((rows, places + 2), np.iinfo(np.int64).max)
    np.minimum.at(ends, (np.arange(rows)[:, None], at + q), first_cost << 32 | at)
    first = np.minimum.accumulate(ends, axis=1)[:, :places]
    second = np.minimum.accumulate((second_cost << 32 | at)[:, ::-1], axis=1)[:, ::-1]
    best = np.argmin((first >> 32) + (second >> 32), axis=1)[:, None]
    place = lambda x: (np.take_along_axis(x, best, 1)[:, 0] & (1 << 32) - 1)
    return place(first), place(second)


def probes(words: list[str], frequent: dict[int, np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position, list, 1 if partners are longer) of the two lists that must be merged for each word and partner length."""
    out, never = [_NONE], np.int64(1 << 30)
    for n, (at, codes) in coded(words).items():
        q, grams = decompose(codes, frequent, n)
        places, r = np.arange(n + 1), np.arange(len(at))
        used = np.broadcast_to(_near_ends(places, n, n, EDGE), q.shape)
        for longer in (0, 1):
            # a longer partner has the second gram one place further on
            keys = list_keys(n, longer, places[None], grams), list_keys(n, longer, places[None] + longer, grams)
            one, two = cheapest_two(q, *(np.where(used, np.minimum(sizes[_bucket(k)], never), never) for k in keys))
            out += [(at, keys[0][r, one], np.full(len(at), longer, np.int8)), (at, keys[1][r, two], np.full(len(at), longer, np.int8))]
    return tuple(np.concatenate(c) for c in zip(*out))


# -- Spark ------------------------------------------------------------------------------------------------------------

def frequent_grams(words: DataFrame, extend: int = EXTEND) -> dict[int, np.ndarray]:
    """For each gram length below ``MAX_GRAM`` a table over all possible grams: whether it is extended."""
    lengths = range(MIN_GRAM, MAX_GRAM)

    def task(batches):
        total = {q: np.zeros(1 << 7 * q, np.int64) for q in lengths}
        for batch in batches:
            for _, codes in coded(batch.column(0).to_pylist()).values():
                for q in lengths:
                    g, n = np.unique(_gram(codes, q), return_counts=True)
                    total[q][g] += n
        for q in lengths:
            g = np.flatnonzero(total[q])
            yield pa.RecordBatch.from_arrays([pa.array(g + (q << 32)), pa.array(total[q][g])], names=["gram", "n"])

    counts = words.select("word").mapInArrow(task, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > extend)
    # one number for 63 grams: at most 33,290 + 261 rows for all possible grams of 93 codes in seven bits
    packed = counts.select(F.floor(F.col("gram") / 63).alias("at"), F.expr("shiftleft(1L, cast(gram % 63 as int))").alias("bit"))
    out = {q: np.zeros(1 << 7 * q, bool) for q in lengths}
    for r in packed.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        for k in range(63):
            if r["bits"] >> k & 1:
                gram = r["at"] * 63 + k
                out[gram >> 32][gram & (1 << 32) - 1] = True
    return out


def _listed(words: DataFrame, find, pairs=None) -> DataFrame:
    """(key, longer, word, n, hot): the lists that ``find`` names for each word, and whether too many pairs meet there.
    ``pairs``: for each bucket of lists how many pairs meet; lists without any are left out."""

    def task(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 10_000):
                part = batch.slice(k, 10_000)
                at, keys, longer = find(part.column(0).to_pylist())
                met = pairs.value[_bucket(keys)] if pairs else np.ones(len(keys))
                at, keys, longer, met = at[met > 0], keys[met > 0], longer[met > 0], met[met > 0]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(longer), part.column(0).take(pa.array(at)),
                                                  part.column(1).take(pa.array(at)), pa.array(met > 1)], names=["key", "longer", "word", "n", "hot"])

    return words.select("word", "n").mapInArrow(task, "key long, longer byte, word string, n long, hot boolean")


def _entries(lists: DataFrame) -> np.ndarray:
    """Entries in each of the 2^LIST_BITS buckets of lists."""
    found = lists.groupBy(F.shiftrightunsigned("key", 64 - LIST_BITS).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(1 << LIST_BITS, np.int64)  # a row a bucket at most, whatever the number of words
    out[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return out


def _masked(df: DataFrame, of_index: bool) -> DataFrame:
    """Entries of long lists by what is left of the word: a code point masked for partners of the same length, taken out of the
    longer word for partners that are one shorter."""
    cut = lambda i, mark: F.concat(F.substring("word", F.lit(1), i - 1), F.lit(mark), F.expr("substring(word, i + 1)"))
    each = df.withColumn("i", F.explode(F.when((F.col("longer") == 0) | F.lit(of_index), F.sequence(F.lit(1), F.length("word"))).otherwise(F.array(F.lit(1)))))
    i = F.col("i")
    rest = F.when(F.col("longer") == 0, cut(i, "*")).when(F.lit(of_index), cut(i, "")).otherwise(F.col("word"))
    return each.withColumn("rest", rest).drop("i").distinct()


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH, extend: int = EXTEND, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words of (word, n) at an edit distance of one, once, the shorter or smaller word first."""
    sc = words.sparkSession.sparkContext
    # broadcasts of fixed size: a byte a possible gram, a number a bucket
    frequent = sc.broadcast(frequent_grams(words, extend))
    entered = lambda w: postings(w, frequent.value, min_length)
    sizes = _entries(_listed(words, entered))
    shared_sizes = sc.broadcast(sizes.astype(np.int32))
    asked = lambda w: probes(w, frequent.value, shared_sizes.value)
    met = sizes * _entries(_listed(words, asked))
    pairs = sc.broadcast(np.where(met > hot_pairs, 2, met > 0).astype(np.int8))
    x, y = _listed(words, asked, pairs), _listed(words, entered, pairs)
    # words of one length ask for each other, so only the smaller one's question counts
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.longer") == F.col("y.longer")) & (
        (F.col("x.longer") == 1) | (F.col("x.word") < F.col("y.word"))) & (F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1)
    pair = [F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n")]
    found = x.where("not hot").alias("x").join(y.where("not hot").alias("y"), near).select(*pair)
    if (met > hot_pairs).any():
        masked = [_masked(x.where("hot"), False), _masked(y.where("hot"), True)]
        found = found.unionByName(masked[0].alias("x").join(masked[1].alias("y"), near & (F.col("x.rest") == F.col("y.rest"))).select(*pair))
    return found.distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last by joining each pointer with its own, so that rounds grow
    with the logarithm of the longest chain.  A form is written at least twice as often as its word, so there are no circles."""
    at = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.alias("a").join(at.select(F.col("word").alias("w"), F.col("root").alias("further")), F.col("root") == F.col("w"), "left")
        step = keep(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.drop("moved")
        at = step.drop("moved")


def variants(words: DataFrame, min_length: int = MIN_LENGTH, extend: int = EXTEND, hot_pairs: int = HOT_PAIRS, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of (word, n).  form: the near word with the largest n, if that is at least
    ``ratio`` times the word's own, else null; root: the last word that forms lead to."""
    words = keep(words.select("word", "n"))
    pairs = near_pairs(words, min_length, extend, hot_pairs)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                              F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = pairs.select(sides.alias("s")).select("s.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    out = words.join(best, "word", "left")
    form_n = -F.col("best.minus")
    is_form = F.coalesce(form_n >= ratio * F.col("n"), F.lit(False))
    out = keep(out.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                          F.when(is_form, form_n).alias("form_n")))
    roots = follow(out.where("form is not null"))
    out = out.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
