import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import fim, spelling, token_files

# -- spelling variants ------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += len(run) >= 5
    return {w: n for w, n in out.items() if n >= 3}


def grouped(words):
    out = []
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return Counter(out)


def variant_texts():
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 11))) for _ in range(25)] + ["x" * 45, "ab" * 30, "ÀÉÿ×÷Zz"]
    words = []
    for b in bases:
        words += [b] * 40
        for _ in range(6):
            i, c = rng.randrange(len(b)), rng.choice("abé")
            words += [rng.choice([b[:i] + c + b[i:], b[:i] + b[i + 1:], b[:i] + c + b[i + 1:]])] * rng.randint(1, 19)
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40:i * 40 + 40]).title()) for i in range(len(words) // 40 + 1)]
    return rows + [(3, rows[3][1]), (None, rows[1][1]), (900, None), (901, ""), (902, "long " * 20_000), (903, "1234 _-")]


@pytest.mark.parametrize("extend,hot_pairs", [(300, 4_000_000), (3, 30), (0, 0)])
def test_spelling_variants(spark, extend, hot_pairs):
    rows = variant_texts()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, word string, n long, key long").repartition(4)
    words = spelling.word_counts(docs)
    want = counted(rows)
    assert {r.word: r.n for r in words.collect()} == want and any(len(w) > spelling.LONG for w in want)
    got = Counter(map(tuple, spelling.variants(words, extend=extend, hot_pairs=hot_pairs).collect()))
    assert got == grouped(want) and any(k[1] and k[2] != k[1] for k in got)


def test_spelling_near_pairs_of_dense_words(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(400)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = Counter(tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p))
    for options in ({}, {"extend": 5, "hot_pairs": 50}):
        assert Counter(tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df, **options).collect()) == want


def test_spelling_of_no_words(spark, empty):
    assert spelling.variants(spelling.word_counts(empty)).collect() == []


def test_two_grams_share_no_code_point():
    rng = np.random.default_rng(1)
    q = rng.integers(2, 4, (50, 7))
    q[:, -1] = 2
    cost = rng.integers(0, 100, (2, 50, 7))
    one, two = spelling.cheapest_two(q, cost[0], cost[1])
    for r in range(50):
        options = {(i, j): cost[0][r, i] + cost[1][r, j] for i in range(7) for j in range(7) if i + q[r, i] <= j}
        assert (one[r], two[r]) in options and options[one[r], two[r]] == min(options.values())


# -- fill in the middle -----------------------------------------------------------------------------------------------


def by_hand(i, text):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fim.MARKERS):
        return i, n, "plain", None, None, text
    if h4 % 100 < 50:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows(rows):
    rng = random.Random(2)
    alphabet = ["a", "b", "é", "\n", "\n", "<", "P>", "<S", ">", "𝄞", " ", "\r"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    shared = "".join(rng.choice(alphabet[:5]) for _ in range(6000))
    texts += [f"{t}{shared}{t}" for t in texts[:20]] + ["\n", "\n\n", "<P>", "x" * 50_000, "é\n" * 30_000, "y" * 1030 + "<M>" + "z" * 3000]
    return [(r[0], r[1]) for r in rows] + [(2000 + k, t) for k, t in enumerate(texts)]


def test_fill_in_the_middle(spark, rows, empty):
    rows = fim_rows(rows)
    docs = spark.createDataFrame([(*r, 1, "f", "o", 2) for r in rows], "doc_id long, text string, n long, form string, output string, row int").repartition(3)
    out = fim.transform(docs)
    got = out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("restored"), "row")
    got = got.collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(by_hand(*r) for r in rows)
    assert Counter((r.doc_id, r.restored) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and got[0].row.asDict() | {"doc_id": 0} == {"doc_id": 0, "n": 1, "form": "f", "output": "o", "row": 2}
    assert fim.transform(empty).collect() == []


def test_rate_and_markers_are_parameters(spark):
    docs = spark.createDataFrame([(i, f"a {i}\nb\n<P>") for i in range(400)], "doc_id long, text string")
    out = fim.transform(docs, rate=30, spm_rate=100, markers=("[p]", "[s]", "[m]")).collect()
    forms = Counter(r.form for r in out)
    assert set(forms) == {"plain", "spm"} and 80 < forms["spm"] < 160
    assert all(r.output.startswith("[s]") for r in out if r.form == "spm")


def test_chunks_and_summaries():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 60_000).astype(np.uint8)
    text[5000:25_000] = 97
    cuts = fim.borders(text, np.array([0, 30_000]), mean=64, largest=500)
    assert cuts[0] == 0 and 30_000 in cuts and np.diff(np.append(cuts, len(text))).max() <= 500
    # the same passage elsewhere has the same borders inside
    moved = np.concatenate([rng.integers(97, 100, 333).astype(np.uint8), text[30_000:]])
    inside = {int(c) - 30_000 for c in cuts if c > 31_000}
    assert inside <= {int(c) - 333 for c in fim.borders(moved, np.array([0]), mean=64, largest=500)} | set(range(1000))
    memo = fim.Memo(limit=500)
    for t in ("a<P>b", "é<", "P", ">\n", "", "<M", "><S"):
        for u in ("x<P>", "S>", "P>é\n", "", "<"):
            a, b = t.encode(), u.encode()
            assert memo.join(memo.look(a), memo.look(b)) == memo.look(a + b)
    assert len(memo.young) == 0 and memo.summary(b"abc") == memo.look(b"abc") == memo.summary(b"abc")


# -- token files ------------------------------------------------------------------------------------------------------


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("segment_ids", [1 << 20, 700])
def test_token_files(spark, rows, empty, tmp_path, segment_ids):
    extra = [(700, "<|endoftext|>a<|STARTOFTEXT|> don't WE'LL 'S12", "", "", 1), (-5, "first", "", "", 1), (2**63 - 1, "last", "", "", 1), (-2**63, "İΣς K", "", "", 1)]
    rows = rows + extra
    docs = spark.createDataFrame([(*r, 1, b"x", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, start long, ids binary, digest long")
    folder = token_files.write(docs.repartition(6), str(tmp_path / "files"), segment_ids=segment_ids)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    ids = dict(zip([r[1] for r in rows], encoded([r[1] for r in rows])))
    key = lambda i: (i is None, i or 0)
    assert [key(r.doc_id) for r in got] == sorted(key(r[0]) for r in rows)
    found = [list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) for r in got]
    assert Counter((r.doc_id, tuple(x)) for r, x in zip(got, found)) == Counter((r[0], tuple(ids[r[1]])) for r in rows)
    assert [r.n_tokens for r in got] == [len(x) for x in found] and [r.start for r in got] == [0, *itertools.accumulate(len(x) for x in found)][:-1]
    flat = [x for y in found for x in y]
    for start, n in ((0, 5), (690, 2000), (len(flat) - 3, 100), (17, 0)):
        parts = sorted(token_files.read_ids(spark, folder, start, n).collect(), key=lambda r: r.start)
        assert [x for p in parts for x in struct.unpack(f"<{len(p.ids) // 4}I", p.ids)] == flat[start:start + n]
    files = sorted((tmp_path / "files").glob("*.tok"))
    assert sum(s[3] for f in files for s in token_files.footer(f.read_bytes())) == len(flat)
    assert not list((tmp_path / "files").glob("_*-part*")) and token_files.read(spark, token_files.write(empty, str(tmp_path / "none"))).collect() == []


@pytest.mark.parametrize("high", [0, 1, 50_000, 2**40, 2**64 - 1])
def test_columns_of_blocks(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        x = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
        x[rng.random(n) < 0.95] //= np.uint64(1000)  # the few large ones go to the exception lists
        data = token_files.encode_column(x)
        assert (token_files.decode_column(data) == x).all() and (token_files.decode_column(data, 3, 1030) == x[3:1030]).all()
        if n == 5000 and high > 1000:
            assert len(data) < 8 * n and len(data) < len(token_files.encode_column(x, percentile=100)) + 64


def test_encoder_is_the_tokenizer():
    import public_tokenizers

    rng = random.Random(2)
    alphabet = list("\"'sStTdDmMlL'!.,<|>7") * 8 + [chr(c) for c in range(0x250)] + list("\u0300\u0301\u0331İΣςẞ\u2028\u3000") + ["<|endoftext|>", " ", "\n"] * 20
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    encoder = token_files.Encoder(token_files.default_tokenizer())
    assert encoder.by_word and encoder.rule
    for t, ids in zip(texts, encoded(texts)):
        assert encoder.encode(t.encode()) == np.array(ids[:-1], "<u4").tobytes()
    other = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))  # its words take the space before them
    assert not other.by_word and other.encode(b"a  b") == np.array(other.tokenizer.encode("a  b").ids, "<u4").tobytes()


def test_words_of_latin_letters_do_not_go_through_the_whole_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.default_tokenizer())
    rng = np.random.default_rng(4)
    letters = ["a", "Z", "'s", "7", "!", "<|", *map(chr, range(0xC0, 0x100))]
    words = [chr(x) for x in range(0xC0, 0x100)] + ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(3000)]
    want = [np.array(whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    encoder = token_files.Encoder(token_files.default_tokenizer())
    monkeypatch.setattr(encoder, "tokenizer", None)
    assert [encoder.encode(w.encode()) for w in words] == want
    assert encoder.encode(" ".join(words).encode()) == b"".join(want)
