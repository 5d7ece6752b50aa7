import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import jaccard, licences, ngram_lm, packing, substrings, toxicity
from lexiforge.llm import words as W
from tests.llm.conftest import words_of

LAST = 2**63 - 1


def test_words_and_hashes(rows):
    texts = [r[1] for r in rows]
    w = W.split(texts)
    found, where = defaultdict(set), {}
    for d, t in enumerate(texts):
        own = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.first[d]:w.first[d + 1]], w.ends[w.first[d]:w.first[d + 1]])]
        assert own == words_of(t)
    for h, a, b in zip(w.hashes().tolist(), w.starts, w.ends):
        x = w.data[a:b].tobytes()
        found[h].add(x)
        assert where.setdefault(x, h) == h
    assert all(len(x) == 1 for x in found.values())
    assert list(W.chunks(["a" * 5, None, "b" * 50, "c"], 10)) == [(0, 2), (2, 3), (3, 4)]


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    for n in (1, 2, 5, 43, 200):
        assert substrings.sliding_min(x, n).tolist() == [min(x[i:i + n]) for i in range(len(x) - n + 1)]


def _repeats(rows, window):
    low, out = {}, Counter()
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            low[x] = min(low.get(x, LAST), LAST if i is None else i)
    for i, t, *_ in rows:
        w, gone = words_of(t), set()
        for k in range(len(w) - window + 1):
            if low[tuple(w[k:k + window])] < (LAST if i is None else i):
                gone.update(range(k, k + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, len(w), len(gone), kept] += 1
    return out


@pytest.mark.parametrize("window,gram,hot", [(50, 8, 2000), (50, 8, 2), (12, 5, 0), (5, 5, 3)])
def test_repeats_are_removed(docs, rows, window, gram, hot):
    got = Counter((r.row.doc_id, r.n_words, r.n_removed, " ".join(words_of(r.kept)))
                  for r in substrings.remove_repeats(docs, window=window, gram=gram, hot=hot).collect())
    want = _repeats(rows, window)
    assert got == want and any(k[2] for k in want)


def test_repeats_keep_columns_and_white_space(wide, empty, rows):
    out = substrings.remove_repeats(wide).collect()
    assert set(out[0].row.asDict()) == set(wide.columns) - {"text"}
    kept = Counter((r.row.doc_id, r.kept) for r in out if not r.n_removed)
    assert all(k in {(r[0], r[1] or "") for r in rows} for k in kept)
    assert substrings.remove_repeats(empty).collect() == []


def _sets(rows, n=5):
    out = []
    for r in rows:
        w = words_of(r[1])
        out.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def _classes(rows):
    """doc -> (class, links), all pairs compared."""
    sets, n = _sets(rows), len(rows)
    key = [LAST if r[0] is None else r[0] for r in rows]
    link = [[i != j and bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    head = defaultdict(lambda: LAST)
    for i in range(n):
        head[root[i]] = min(head[root[i]], key[i])
    return Counter((key[i], head[root[i]], sum(link[i])) for i in range(n))


@pytest.mark.parametrize("small,block", [(64, 256), (2, 2)])
def test_jaccard_join_finds_all_links(docs, rows, small, block):
    got = Counter((r.id, r.class_id, r.n_links) for r in jaccard.near_duplicates(docs, small=small, block=block).collect())
    assert got == _classes(rows)


def test_one_document_of_each_class_stays(wide, empty, rows):
    out = jaccard.one_of_each(wide)
    assert out.columns == wide.columns
    key = lambda i: LAST if i is None else i
    heads = {c for _, c, _ in _classes(rows)}
    got = Counter(key(r.doc_id) for r in out.collect())
    assert set(got) == heads and max(got[i] for i in heads - {LAST, 3}) == 1
    assert jaccard.one_of_each(empty).collect() == []


def test_jaccard_threshold_is_exact():
    a = np.arange(10, dtype=np.uint64)
    assert jaccard.similar_pairs([a, a[:8], a[:7]]).tolist() == [[False, True, False], [True, False, True], [False, True, False]]


def test_recall_on_pairs_at_the_threshold(spark):
    """200 pairs of sets with similarity just over 0.8, among texts that share a passage with all others."""
    rng, rows = np.random.default_rng(3), []
    shared = " ".join(f"c{i}" for i in range(30))
    for k in range(200):
        words = [f"{k}_{i}" for i in range(230)]
        other = list(words)
        for at in rng.choice(np.arange(20, 225, 6), 4, replace=False):
            other[at] = "z"
        rows += [(2 * k, " ".join(words) + " " + shared), (2 * k + 1, " ".join(other) + " " + shared)]
    sets = _sets(rows)
    linked = {k for k in range(200) if 5 * len(sets[2 * k] & sets[2 * k + 1]) >= 4 * len(sets[2 * k] | sets[2 * k + 1])}
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links > 0").select("class_id").distinct().collect()
    assert len(linked) > 150 and {r.class_id // 2 for r in got} == linked


def test_runs_miss_a_pair_at_the_threshold_once_in_ten_thousand():
    assert (1 - 0.8**jaccard.DEPTH) ** jaccard.runs_for() <= 1e-4


def _tokens(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [*words_of(low), None]


def _kneser_ney(train):
    """p(w | v) with plain dictionaries; "<s>" starts, None ends a text."""
    pairs, single = Counter(), Counter()
    for t in train:
        single.update(t)
        pairs.update(zip(["<s>", *t], t))
    kinds, follow, total = Counter(w for _, w in pairs), defaultdict(Counter), Counter()
    for (v, w), c in pairs.items():
        total[v] += c
        follow[v][min(c, 3)] += 1
    d2, d1 = (ngram_lm.discounts(np.array([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)])) for x in (pairs, kinds))
    size = len(single)
    cut = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0.0
    spare = sum(d1[min(c, 3) - 1] for c in kinds.values())

    def p(w, v):
        lower = (cut(kinds[w], d1) + spare / (size + 1)) / len(pairs)
        return (cut(pairs[v, w], d2) + sum(d2[k - 1] * n for k, n in follow[v].items()) * lower) / total[v] if total[v] else lower

    return single, p


def test_language_model_scores(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BUCKET_CHARS", 3000)
    train = [_tokens(r[1]) for r in rows if ngram_lm.crc_fold(r[0]) != 1]
    single, p = _kneser_ney(train)
    n, v = sum(single.values()), len(single)
    assert sum(p(w, "w1") for w in single) + p("never seen", "w1") == pytest.approx(1, abs=1e-9)
    want = defaultdict(list)
    for r in rows:
        t = _tokens(r[1])
        base = sum(math.log10((single[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want[r[0]].append((len(t), sum(single[w] > 0 for w in t), base, sum(math.log10(p(w, h)) for h, w in zip(["<s>", *t], t))))
    got = ngram_lm.fit_and_score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (ngram_lm.crc_fold(r.doc_id) == 1) and r.train_tokens == n
        assert any((r.n_tokens, r.n_known) == x[:2] and r.base_score == pytest.approx(x[2]) and r.score == pytest.approx(x[3]) for x in want[r.doc_id])


def _kneser_ney_of(train, order):
    """p(w | v), v a tuple of order - 1 words, with plain dictionaries."""
    counts = {order: Counter(tuple(["<s>"] * (order - 1) + t)[i:i + order] for t in train for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: ngram_lm.discounts(np.array([sum(c == i for c in x.values()) for i in (1, 2, 3, 4)])) for k, x in counts.items()}
    total, follow = defaultdict(int), defaultdict(lambda: [0, 0, 0])
    for x in counts.values():
        for g, c in x.items():
            total[g[:-1]] += c
            follow[g[:-1]][min(c, 3) - 1] += 1

    def p(w, v, k=order):
        if not k:
            return 1 / (len(counts[1]) + 1)
        lower = p(w, v[1:], k - 1)
        if not total.get(v):
            return lower
        c = counts[k][(*v, w)]
        return (max(c - (d[k][min(c, 3) - 1] if c else 0), 0) + sum(a * b for a, b in zip(d[k], follow[v])) * lower) / total[v]

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_of_any_order(docs, rows, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "BUCKET_CHARS", 6000)
    train = [_tokens(r[1]) for r in rows if ngram_lm.crc_fold(r[0]) != 1]
    p, words = _kneser_ney_of(train, order), {w for t in train for w in t}
    history = ("w1", "w2", "w1")[-(order - 1):]
    assert sum(p(w, history) for w in words) + p("never seen", history) == pytest.approx(1, abs=1e-9)
    want = defaultdict(list)
    for r in rows:
        t = _tokens(r[1])
        padded = ["<s>"] * (order - 1) + t
        want[r[0]].append((len(t), sum(math.log10(p(w, tuple(padded[i:i + order - 1]))) for i, w in enumerate(t))))
    got = ngram_lm.fit_and_score(docs, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        assert any(r.n_tokens == n and r.score == pytest.approx(x) and r.perplexity == pytest.approx(10 ** (-x / n)) for n, x in want[r.doc_id])


def test_texts_shuffled_but_for_their_pairs_score_lower(spark, tmp_path):
    import __spark_entry__ as entry

    fluent = [f"a{i} m{j} b{i}" for i in range(4) for j in range(4)] * 8  # b follows from a; m alone says nothing of it
    mixed = [f"a{i} m{j} b{(i + 1) % 4}" for i in range(4) for j in range(4)]
    rows = [(5 * n, t) for n, t in enumerate(fluent)] + [(10_000 + n, t) for n, t in enumerate(mixed)]
    rows = [(i, t) for i, t in rows if i < 10_000 or ngram_lm.crc_fold(i) == 1]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op8_lm_scoring"](spark, str(tmp_path)).collect()
    odd, even = [r.score for r in got if r.doc_id >= 10_000], [r.score for r in got if r.doc_id < 10_000]
    assert odd and max(odd) < min(even) - 0.5


def test_language_model_without_training_texts(docs, empty, wide):
    assert ngram_lm.fit_and_score(empty).collect() == []
    none = ngram_lm.fit_and_score(docs.where("doc_id = 1")) if ngram_lm.crc_fold(1) == 1 else ngram_lm.score(docs, ngram_lm.fit(empty))
    assert all(r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in none.collect())
    assert ngram_lm.fit_and_score(wide).count() == wide.count()


def _layout_ok(pieces, size):
    by = defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= size
    return len(by)


@pytest.mark.parametrize("size", [2048, 64])
def test_packing_round_trip(docs, wide, rows, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    want, total = Counter(), 0
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total, start, piece, n = total + len(ids), 0, 0, len(ids) % size or size
        while start < len(ids):
            want[r[0], piece, start, n, zlib.crc32(ids[start:start + n].tobytes())] += 1
            start, piece, n = start + n, piece + 1, size
    got = packing.pack(docs, size=size).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert _layout_ok(got, size) <= math.ceil(total / size) * 1.05 + 2
    assert packing.pack(wide, size=size).count() == len(got)


def test_packing_of_nothing(empty):
    assert packing.pack(empty).collect() == []


def test_tokenizer_pieces_give_the_same_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    encoder = packing.Encoder(packing.default_tokenizer())
    for x in ["", " ", "   a", "a  \n\n b'll we've 12x !!  ", "\t\tÉté çà  日本語 <|endoftext|> x  y", "a" * 5000, "'s 's's", "ﬁ́ é 🙂🙂 "]:
        assert encoder.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_added_tokens_in_texts_are_read_like_the_tokenizer_does(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    end = "<|endoftext|>"
    texts = [f"hello {end} world", end, f"{end}{end}", f"a  {end}  b", f"x \n{end}\n\n y  ", f"<|endof{end}text|>", "<|endoftext |> <|endoftext", f"'{end}s it's",
             f" {end} ", "plain text  here"]
    encoder = packing.Encoder.of(packing.default_tokenizer())
    rng = np.random.default_rng(0)
    for _ in range(300):
        texts.append("".join(rng.choice(["a", " ", "\n", "'s", end, "9", "\u00e9", "<|", "endoftext", "|>", "!"], 12)))
    for x in texts:
        assert encoder.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert np.frombuffer(encoder.encode(texts[0]), "<u4").tolist() == [31373, 220, 50256, 995]
    want = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], dtype="<u4") for i, x in enumerate(texts)}
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


@pytest.mark.parametrize("seed", range(4))
def test_layouts_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 2049), 300, replace=False), rng.integers(1, 40, 300))}
    layouts, used = packing.plan(histogram), Counter()
    for lengths, times in layouts:
        assert sum(lengths) <= 2048 and times > 0
        for x in lengths:
            used[x] += times
    assert used == histogram
    plain = packing.Layouts(2048)
    for x in sorted(histogram, reverse=True):
        plain.best_fit(x, histogram[x])
    assert sum(t for _, t in layouts) <= 1.02 * sum(t for _, t in plain.all())


def test_least_squares_matches_the_optimality_conditions():
    rng = np.random.default_rng(0)
    a, b = rng.random((20, 40)), rng.random(20)
    x = packing.nnls(a, b)
    gradient = a.T @ (b - a @ x)
    assert x.min() >= 0 and gradient.max() < 1e-6 and np.abs(gradient[x > 0]).max() < 1e-6


def _segments(scores):
    """Maximal scoring segments by their definition: recursively the best subarray, then left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
    _, a, b = best
    return [*_segments(scores[:a]), (a, b), *[(x + b, y + b) for x, y in _segments(scores[b:])]]


@pytest.mark.parametrize("seed", range(20))
def test_maximal_segments(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 25))
    at = np.flatnonzero(rng.random(n) < 0.35)
    odds = rng.random(len(at)) * 3 + 0.01
    scores = np.full(n, -0.77)
    scores[at] = odds
    got = toxicity.maximal_segments(at.tolist(), odds.tolist(), -0.77)
    assert [(a, b) for a, b, _ in got] == _segments(scores.tolist())
    assert all(s == pytest.approx(scores[a:b].sum()) for a, b, s in got)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score", "passages").collect()
    toxic = [r for r in out if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in out if not r.toxic) <= 0.01 * len(out)
    assert all(0 <= r.score <= 1 for r in out) and all(r.passages for r in toxic if r.predicted)


def test_toxicity_takes_awkward_rows(docs, wide, empty, spark, rows):
    labels = spark.createDataFrame([(i, int(i < 5), None) for i in range(40)] + [(None, 1, None), (7, None, None), (8, 1, 0), (8, 0, 0)],
                                   "doc_id long, toxic int, quality int")
    for d in (docs, wide):
        got = toxicity.classify(d, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert toxicity.classify(empty, labels).collect() == []
    assert {round(r.score, 5) for r in toxicity.classify(docs, labels.where("doc_id < 0")).collect()} == {0.0}


def test_rare_toxic_words_are_learned_whatever_the_number_of_toxic_texts(spark):
    """12,000 toxic texts: a word of 23 of them is below a share of 0.002 and significant."""
    toxic = [(i, f"vile w{i % 97} v{i % 89}" + (" zorkish" if i % 540 == 0 else "")) for i in range(12_000)]
    clean = [(i, f"w{i % 97} v{i % 89} calm") for i in range(12_000, 24_000)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    docs = docs.withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("n"), F.col("doc_id"))))  # no two texts alike
    labels = spark.createDataFrame([(i, int(i < 12_000), None) for i in range(24_000)], "doc_id long, toxic int, quality int")
    lexicon, _ = toxicity.train(docs, labels, held_out=None)
    known = lambda word: bool(np.isin(toxicity.split([word]).hashes(), lexicon.features)[0])
    assert known("vile") and known("zorkish") and not known("calm") and not known("w1")
    assert (np.diff(lexicon.features.astype(object)) > 0).all() and len(lexicon.features) == len(lexicon.odds)


def test_licences_are_found(spark, empty):
    mit = licences.TEMPLATES["mit"].split()
    changed = [*mit[:20], "really", *mit[20:60], *mit[62:]]
    apache = licences.TEMPLATES["apache-2.0-line"]
    rows = [(1, "x " * 40 + " ".join(changed) + " y" * 30), (2, f"before\n{apache.upper()}\nafter {apache}"), (3, " ".join(mit[:30])), (4, ""), (5, None),
            (None, licences.TEMPLATES["mit-line"]), (2, "License Apache the under Licensed"), (7, "a b c " * 50_000 + apache)]
    d = spark.createDataFrame([(*r, "z", 0.1) for r in rows], "doc_id long, text string, licence string, coverage double")
    got = sorted(((r.doc_id or 0, r.licence, r.matched_words, r.first_word, r.end_word) for r in licences.scan(d).collect()), key=str)
    n = len(W.split([licences.TEMPLATES["mit"].lower()], separator=licences._OUTSIDE).starts)
    a = len(W.split([apache], separator=licences._OUTSIDE).starts)
    found = {(x[0], x[1]): x[2:] for x in got}
    assert {(x[0], x[1]) for x in got} == {(0, "mit-line"), (1, "mit"), (2, "apache-2.0-line"), (7, "apache-2.0-line")}
    assert found[1, "mit"] == (n - 2, 40, 40 + n - 2 + 1) and [x[2:] for x in got if x[0] == 2] == [(a, 1, 1 + a), (a, 2 + a, 2 + 2 * a)]
    assert found[7, "apache-2.0-line"] == (a, 150_000, 150_000 + a)
    assert licences.scan(empty).collect() == []


def _found(text):
    index = licences.Index(licences.TEMPLATES)
    return [(index.names[t], n, a, b) for t, n, a, b in licences.scan_words(licences._split([text]).hashes(), index)]


@pytest.mark.parametrize("between", [0, 1, 3, 6, 12, 13])
def test_licences_that_repeat_are_all_found(between):
    line, filler = licences.TEMPLATES["mit-line"], " ".join(f"f{i}" for i in range(between))
    step = 5 + between
    assert _found(f"{line} {filler} " * 12) == [("mit-line", 5, step * i, step * i + 5) for i in range(12)]
    # every other notice lacks its last word
    text = f"{line} {filler} {line.replace(' License.', '')} {filler} " * 6
    starts = [x for i in range(6) for x in (i * (2 * step - 1), i * (2 * step - 1) + step)]
    assert _found(text) == [("mit-line", 5 - i % 2, x, x + 5 - i % 2) for i, x in enumerate(starts)]
    other = licences.TEMPLATES["cc-by-nc-4.0-line"]
    assert [x[0] for x in _found(f"{line} {other} {filler} " * 5)] == ["mit-line", "cc-by-nc-4.0-line"] * 5


def test_licences_of_many_diagonals_keep_their_coverage():
    mit = licences.TEMPLATES["mit"].split()
    extra = [f"e{i}" for i in range(14)]
    text = ["permission", "is", "hereby", "x", *mit[:30], *extra[:10], *mit[30:60], *extra[10:], *mit[60:]]
    n = len(licences._split([licences.TEMPLATES["mit"]]).starts)
    assert _found(" ".join(text)) == [("mit", n, 4, 4 + n + 14)]
    assert _found(" ".join([*mit, *mit])) == [("mit", n, 0, n), ("mit", n, n, 2 * n)]


def _common(a, b, diagonal, band):
    best = {}
    for i in range(len(a), -1, -1):
        for j in range(len(b), -1, -1):
            take = best.get((i + 1, j + 1), 0) + 1 if i < len(a) and j < len(b) and a[i] == b[j] and abs(j - i - diagonal) <= band else 0
            best[i, j] = max(take, best.get((i + 1, j), 0), best.get((i, j + 1), 0))
    return best[0, 0]


@pytest.mark.parametrize("seed", range(10))
def test_banded_alignment(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, 25).astype(np.uint64), rng.integers(0, 6, 60).astype(np.uint64)
    for diagonal in (-3, 0, 17, 50):
        assert licences.align(a, b, diagonal, 4)[0] == _common(a.tolist(), b.tolist(), diagonal, 4)



def test_words_of_plain_text_do_not_go_through_the_whole_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    rng = np.random.default_rng(3)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "é", "日", "'s", "'", "7", "½", "!", "\x00", "_"]
    texts = ["".join(rng.choice(parts, 15)) for _ in range(2000)]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    encoder = packing.Encoder(packing.default_tokenizer())
    monkeypatch.setattr(encoder, "tokenizer", None)
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 50)
    assert [encoder.encode(x) for x in texts] == want


@pytest.mark.parametrize("level", [1, 2, 3])
def test_packed_grams_are_small_and_whole(level):
    import pyarrow as pa

    rng = np.random.default_rng(level)
    vocabulary = rng.integers(0, 2**64, 2000, np.uint64)
    words = list(vocabulary[rng.integers(0, 2000, (level, 50_000))])
    counts = np.stack([np.ones(50_000, np.int64), rng.integers(0, 2, 50_000) * 2**40])
    rows = ngram_lm._gram_rows(words, counts, 4)
    got = [ngram_lm._unpacked(pa.Table.from_batches([ngram_lm._batch([r])]), level, 2) for r in rows]
    want = Counter()
    for *w, a, b in zip(*(x.tolist() for x in words), *counts.tolist()):
        want[(*w, 0)] += a
        want[(*w, 1)] += b
    found = {(*w, k): c for w_, c_ in got for *w, a, b in zip(*(x.tolist() for x in w_), *c_.tolist()) for k, c in ((0, a), (1, b))}
    assert found == dict(want)
    ones = ngram_lm._gram_rows(words, counts[:1], 4)
    assert sum(len(x) for r in ones for x in r if isinstance(x, bytes)) < (3 * level + 1) * sum(r[1] for r in ones) + 8 * 4 * 2000
    assert [x.itemsize for x in (ngram_lm._narrow(np.array([255, 1]), 9**9), ngram_lm._narrow(np.array([2**40]), 2**32 - 1))] == [1, 4]


def test_a_kept_step_leaves_no_shuffle_files(spark):
    import time

    from lexiforge.llm.store import END_SHUFFLES, keep

    before = spark.conf.get(END_SHUFFLES, None)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    old = shuffles()
    kept = keep(spark.range(1000).repartition(7, "id"))
    for _ in range(50):
        if shuffles() <= old:
            break
        time.sleep(0.1)
    assert shuffles() <= old and kept.count() == 1000
    assert spark.conf.get(END_SHUFFLES, None) == before


def test_few_links_are_joined_by_few_tasks(spark, monkeypatch):
    from lexiforge.llm import components as C

    kept = []
    monkeypatch.setattr(C, "keep", lambda df, keep=C.keep: kept.append(keep(df)) or kept[-1])
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("40", "false")):
            spark.conf.set(n, v)
        got = C.components(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (60, 40), (7, None)], "u long, v long"))
        assert {r.id: r.root for r in got.collect()} == {**{i: 0 for i in range(21)}, 40: 40, 50: 40, 60: 40}
        assert len(kept) > 2 and all(df.rdd.getNumPartitions() <= 8 for df in kept[1:])
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_windows_of_a_common_passage_are_made_once(docs):
    steps = [substrings.remove_repeats(docs, hot=hot)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for hot in (2, 10**9)]
    assert steps[0] == steps[1] > 0
