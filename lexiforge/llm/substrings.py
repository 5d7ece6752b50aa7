"""Operator 3: removal of repeated passages by super-k-mers.

A window is ``WINDOW`` consecutive words of one text.  A word is removed if a window that covers it also starts in a text
with a smaller id.  Consecutive windows that share a minimiser (the smallest hash of ``GRAM`` consecutive words in them) travel
together as one packed string, a super-k-mer, to the bucket of that minimiser, where equal windows meet.

1. Each text sends its minimisers (no words yet).  A minimiser that one text only has cannot be in a repeated window, so
   only super-k-mers of shared minimisers are packed.  This is exact and leaves most of a corpus at home.
2. Copies of a text are represented by the one with the smallest id: every window of another copy is repeated.
3. In its bucket, a super-k-mer is taken apart into windows; sorted by minimiser, one group of strings is held at a time.
4. A minimiser with more than ``HOT`` super-k-mers (a passage that a large share of all texts holds) is not gathered: its
   windows are counted apart, by a 128-bit digest, with partial aggregation before the exchange.

Defined results: a null text has no words; texts of fewer than ``WINDOW`` words are left alone; a null id is larger than any
other; rows with equal ids do not repeat each other; kept words are joined by one space, and a text from which nothing
is removed keeps its own white space in ``kept``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm import words as W
from lexiforge.llm.store import keep

WINDOW = 50
GRAM = 8
HOT = 2000
LAST = 2**63 - 1


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[:len(g) - (width - size)], g[width - size:]) if width > size else g


def super_kmers(w: W.Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, minimiser) of the super-k-mers of consecutive texts."""
    none = np.zeros(0, np.int64)
    if len(w.starts) < window:
        return none, none, none, none
    smallest = sliding_min(W.grams(w.hashes(), gram), window - gram + 1).view(np.int64)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    at = np.flatnonzero(text[:len(smallest)] == text[window - 1:])
    if not len(at):
        return none, none, none, none
    m, text = smallest[at], text[at]
    new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (text[1:] != text[:-1])]))
    return text[new], at[new] - w.first[text[new]], np.diff(np.append(new, len(at))), m[new]


def _find(window: int, gram: int):
    def task(batches):
        for batch in batches:
            texts, ids, digests = batch.column(2).to_pylist(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in W.chunks(texts):
                text, first, n, minimiser = super_kmers(W.split(texts[a:b]), window, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][text]), pa.array(digests[a:b][text]), pa.array(minimiser), pa.array(first.astype(np.int32)),
                     pa.array(n.astype(np.int32))], names=["id", "digest", "minimiser", "first", "n"])

    return task


def _pack(window: int, hot: bool):
    """(id, digest, text, spans) -> packed super-k-mers, or the digests of their windows."""

    def task(batches):
        for batch in batches:
            ids, digests, texts, spans = (batch.column(c).to_pylist() for c in ("id", "digest", "text", "spans"))
            rows: list[tuple] = []
            for i, digest, text, own in zip(ids, digests, texts, spans):
                w = W.split([text])
                data = w.data
                for s in own:
                    first, n = s["first"], s["n"]
                    x = w.starts[first:first + n + window - 1]
                    y = w.ends[first:first + n + window - 1]
                    raw = data[x[0]:y[-1]].tobytes()
                    packed = b" ".join(raw[p:q] for p, q in zip((x - x[0]).tolist(), (y - x[0]).tolist()))
                    if not hot:
                        rows.append((i, digest, s["minimiser"], first, packed))
                        continue
                    off = [0, *accumulate((y - x + 1).tolist())]
                    for k in range(n):
                        h = hashlib.md5(packed[off[k]:off[k + window] - 1]).digest()
                        rows.append((i, digest, int.from_bytes(h[:8], "little", signed=True), first + k, h[8:]))
                if len(rows) >= 20_000:
                    yield _packed_batch(rows)
                    rows = []
            if rows:
                yield _packed_batch(rows)

    return task


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", "digest", "key", "first", "packed"])


def key_groups(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of one key after the other, from batches sorted by key."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        for k, *row in zip(keys, *(batch.column(c).to_pylist() for c in columns)):
            if k != last and held:
                yield held
                held = []
            last = k
            held.append(tuple(row))
    if held:
        yield held


def repeated_windows(group: list[tuple], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(id, digest, first, packed) of one minimiser -> (id, digest, first window, number) of the repeated windows."""
    smallest: dict[bytes, int] = {}
    for i, _, _, packed in group:
        if i < smallest.get(packed, LAST + 1):
            smallest[packed] = i
    out = []
    if len(smallest) == 1:
        packed, low = next(iter(smallest.items()))
        n = packed.count(b" ") + 2 - window
        return [(i, digest, first, n) for i, digest, first, _ in group if i > low]
    windows: dict[bytes, int] = {}
    parts: dict[bytes, list[bytes]] = {}
    for packed, low in smallest.items():
        off = [0, *accumulate(len(x) + 1 for x in packed.split(b" "))]
        parts[packed] = own = [packed[off[k]:off[k + window] - 1] for k in range(len(off) - window)]
        for x in own:
            if low < windows.get(x, LAST + 1):
                windows[x] = low
    for i, digest, first, packed in group:
        start = None
        for k, x in enumerate(parts[packed]):
            if windows[x] < i:
                start = k if start is None else start
            elif start is not None:
                out.append((i, digest, first + start, k - start))
                start = None
        if start is not None:
            out.append((i, digest, first + start, len(parts[packed]) - start))
    return out


def _match(window: int):
    def task(batches):
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                              names=["id", "digest", "first", "n"])

        for group in key_groups(batches, "key", ["id", "digest", "first", "packed"]):
            rows += repeated_windows(group, window) if len(group) > 1 else []
            if len(rows) >= 20_000:
                yield batch()
                rows = []
        if rows:
            yield batch()

    return task


def _clean(window: int):
    """(row, text, kept first, ranges) -> row, n_words, n_removed, kept.  first: the row is the first of its copies."""

    def task(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, first, ranges in zip(batch.column("text").to_pylist(), batch.column("first").to_pylist(), batch.column("ranges").to_pylist()):
                w = W.split([text])
                n = len(w.starts)
                gone = np.zeros(n + 1, np.int64)
                if not first and n >= window:
                    gone[0] = 1
                for r in ranges or []:
                    gone[r["first"]] += 1
                    gone[r["first"] + r["n"] - 1 + window] -= 1
                stay = np.cumsum(gone)[:n] == 0
                removed = n - int(stay.sum())
                n_words.append(n)
                n_removed.append(removed)
                if removed:
                    raw = w.data.tobytes()
                    text = b" ".join(raw[p:q] for p, q in zip(w.starts[stay].tolist(), w.ends[stay].tolist())).decode("utf-8", "surrogatepass")
                kept.append(text or "")
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])

    return task


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                   hot: int = HOT) -> DataFrame:
    """(row, n_words, n_removed, kept) for every row of ``docs``; row: a struct of its columns but the text."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                    F.struct(*others).alias("row"))
    d = d.withColumn("digest", F.xxhash64("text"))
    plain = d.select("id", "digest", "text")
    copies = d.select("id", "digest", F.xxhash64(F.lit(7), "text").alias("digest_2")).groupBy("digest", "digest_2").agg(F.min("id").alias("id"))
    firsts = keep(copies.select("id", "digest").distinct())
    found = plain.mapInArrow(_find(window, gram), "id long, digest long, minimiser long, first int, n int")
    found = keep(found.join(firsts, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest", "first"]))
    shared = found.groupBy("minimiser").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("times")) \
        .where("low < high").select("minimiser", (F.col("times") > hot).alias("is_hot"))
    spans = keep(found.join(shared, "minimiser").groupBy("id", "digest", "is_hot").agg(F.collect_list(F.struct("minimiser", "first", "n")).alias("spans")))

    def packed(is_hot: bool) -> DataFrame:
        own = plain.join(spans.where(F.col("is_hot") == is_hot).drop("is_hot"), ["id", "digest"])
        return own.mapInArrow(_pack(window, is_hot), "id long, digest long, key long, first int, packed binary")

    usual = packed(False).repartition("key").sortWithinPartitions("key").mapInArrow(_match(window), "id long, digest long, first int, n int")
    ranges = usual
    if not spans.where("is_hot").isEmpty():
        windows = keep(packed(True))  # read twice
        low = windows.groupBy("key", "packed").agg(F.min("id").alias("low"))
        common = windows.join(low, ["key", "packed"]).where("low < id").select("id", "digest", "first", F.lit(1).alias("n"))
        ranges = usual.unionByName(common)
    gone = ranges.groupBy("id", "digest").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))
    known = firsts.withColumn("first", F.lit(True)).join(gone, ["id", "digest"], "left")
    out = d.join(known, ["id", "digest"], "left").select("row", "text", F.coalesce("first", F.lit(False)).alias("first"), "ranges")
    schema = out.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return out.mapInArrow(_clean(window), schema)
