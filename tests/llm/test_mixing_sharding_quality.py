import math
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lexiforge.llm import mixing, quality, sharding
from tests.llm.conftest import words_of


def _targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:  # reshare until none is above its cap
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        out.update({s: cap * sizes[s] for s in over} if over else share)
        open_ -= over or open_
    return out


def test_mix_meets_targets_by_epochs_and_a_prefix(docs, rows):
    got = mixing.mix(docs, bucket_rows=4).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words_of(r[1]))
    targets = _targets(size)
    by = defaultdict(list)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3 and r.copies in (r.epochs, r.epochs + 1)
        by[r.source].append(r)
    for source, own in by.items():
        longest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - targets[source]) <= longest / 2 + 1e-6
        chosen = [r.key for r in own if r.chosen]
        assert not chosen or all(r.chosen or r.key >= max(chosen) for r in own)


def test_mix_reruns_agree_and_buckets_do_not_matter(docs):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(mixing.mix(docs, bucket_rows=3)) == key(mixing.mix(docs.repartition(2), bucket_rows=10_000))


def test_mixed_rows_are_the_copies(docs, wide):
    copies = Counter({(r.doc_id, r.size): 0 for r in mixing.mix(docs).collect()})
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r.size] += r.copies
    out = mixing.mixed(wide)
    assert out.columns == wide.columns
    assert Counter((r.doc_id, len(words_of(r.text))) for r in out.collect()) == +copies


def test_mix_caps_a_small_source(spark):
    rows = [(i, "w " * (2 if i else 1), "a" if i == 0 else "b") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    small = [r for r in got if r.source == "a"]
    assert [(r.target, r.taken) for r in small] == [(3.0, 3)]
    assert got[1].target == pytest.approx(99 - 3)


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


def _fill(shards, size):
    """Turn by turn, the plain way."""
    import hashlib

    prefer = []
    for s in shards:
        h = hashlib.md5(s.encode()).hexdigest()
        start, step = int(h[:15], 16) % size, int(h[15:30], 16) % (size - 1) + 1
        prefer.append([(start + k * step) % size for k in range(size)])
    owner, turn = {}, 0
    while len(owner) < size:
        i = turn % len(shards)
        owner[next(s for s in prefer[i] if s not in owner)] = i
        turn += 1
    return [owner[s] for s in range(size)]


def test_lookup_table_is_filled_in_turns():
    names = [f"n{i}" for i in range(7)]
    assert sharding.fill_table(names, 101) == _fill(names, 101)
    counts = Counter(sharding.fill_table([f"shard-{i}" for i in range(64)]))
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move_when_a_shard_goes():
    names = [f"n{i}" for i in range(20)]
    a, b = sharding.fill_table(names, 5003), sharding.fill_table(names[:-1], 5003)
    moved = sum(x != y for x, y in zip(a, b) if x != 19)
    assert moved < 0.1 * 5003


@pytest.mark.parametrize("shards,size", [([], 7), (["a", "a"], 7), (["a"], 8), ([str(i) for i in range(8)], 7)])
def test_lookup_table_refuses_bad_input(shards, size):
    with pytest.raises(ValueError):
        sharding.fill_table(shards, size)


def test_place_keeps_rows_and_equal_keys_together(wide, empty, rows):
    out = sharding.place(wide, F.col("doc_id"), F.col("text"), shards=5, size=101, prefix="to_").collect()
    assert len(out) == len(rows)
    table, by = sharding.fill_table([f"shard-{i:05d}" for i in range(5)], 101), defaultdict(set)
    for r in out:
        by[r.doc_id, r.text].add(r.to_shard)
        assert r.to_shard == table[r.to_slot] and r.to_shard_name == f"shard-{r.to_shard:05d}"
    assert all(len(x) == 1 for x in by.values())
    assert sharding.place(empty, F.col("doc_id")).collect() == []
    with pytest.raises(ValueError):
        sharding.place(out and wide.withColumn("slot", F.lit(1)), F.col("doc_id"))


def _rules(text):
    w = words_of(text)
    spans = defaultdict(list)
    for i in range(len(w) - 4):
        spans[tuple(w[i:i + 5])].append(i)
    covered = {j for own in spans.values() if len(own) > 1 for i in own for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_rules(docs, rows, spark):
    more = spark.createDataFrame([(900, "x y\nx y\n\n \nx y # $$ <b>\nz" + " a b c d e f" * 3, None, None, 1)], docs.schema)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.base_rules(docs.unionByName(more)).collect())
    want = Counter()
    for r in [*rows, tuple(more.first())]:
        n, *rest = _rules(r[1])
        want[r[0], n, *rest, n < 10 or 100 * rest[-1] > 20 * n] += 1
    assert got == want


def _buckets(w, n):
    h = lambda s, seed: xxhash.xxh64(s.encode(), seed=seed).intdigest()
    return [h(a, 42) for a in w] + [h(b, h(a, 42)) for a, b in zip(w, w[1:])]


def test_log_likelihood_ratio(docs, rows, spark):
    n, trusted = 64, [i for i in range(0, 60, 3)] + [None, 3, 3, 10**6]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    raw, target = Counter(), Counter()
    for r in rows:
        own = Counter(signed(x) % n for x in _buckets(words_of(r[1]), n))
        raw += own
        if r[0] in set(trusted) - {None}:
            target += own
    ratio = [math.log((target[b] + 1) / (sum(target.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n)) for b in range(n)]
    got = quality.apply(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), buckets=n, threshold=-0.01).collect()
    want = {}
    for r in rows:
        own = [signed(x) % n for x in _buckets(words_of(r[1]), n)]
        want.setdefault(r[0], set()).add(round(sum(ratio[b] for b in own) / len(own) if own else 0.0, 9))
    for r in got:
        assert round(r.llr, 9) in want[r.doc_id]
        assert r.kept == (not r.base_failed and r.llr >= -0.01)
    assert 0 < sum(r.kept for r in got) < len(got)


def test_quality_without_trusted_rows(docs, empty):
    nobody = empty.select("doc_id")
    assert {r.llr for r in quality.apply(docs, nobody).collect()} == {0.0}
    assert quality.apply(empty, nobody).collect() == []


def test_clean_labelled_texts_are_kept(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = quality.apply(spark.read.parquet(f"{d}/documents.parquet"), labels.where("quality = 1")).join(labels, "doc_id").cache()
    good = out.where("quality = 1 and not base_failed")
    assert good.where("not kept").count() <= 0.01 * good.count()
    assert out.where("quality = 0 and kept").count() <= 0.1 * out.where("quality = 0").count()


