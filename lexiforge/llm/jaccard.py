"""Operator 5: n-gram Jaccard join by chosen paths.

A text is the set of its ``GRAM``-word shingles (a shorter text is one shingle).  Texts with equal sets are a class; classes are
joined.  A class's set is embedded into ``SKETCH`` MinHash coordinates.  A run starts with all classes in one node; a node draws
coordinates (each with probability 1 / (threshold * SKETCH), one at least) and its members go to the child nodes named by
the values there, so similar sets stay together and others part.  Nodes of up to ``SMALL`` members are compared by
sketch, all with all; a larger node compares its members with one of them, its pivot, lets go those that resemble it, and
splits again.  Runs repeat until a pair at the threshold is missed with probability ``1 - RECALL`` at most.

The sketch only proposes: it links sets whose agreement is within five standard errors of the threshold.  The proposed
links' components are then compared exactly, all with all, on the texts' shingles in blocks of ``BLOCK`` texts, so a pair that
the runs missed still counts if its component was found.  Groups give links' numbers and a spanning forest, never all pairs.

Defined results: a text without words is linked to nothing; a null text has no words; rows that repeat an id are documents of
their own, with the class of their text; a null id is larger than any other and, alone in a class, leaves class_id null.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm import words as W
from lexiforge.llm.components import components
from lexiforge.llm.store import gathered, keep, thin_out
from lexiforge.llm.substrings import key_groups

GRAM = 5
THRESHOLD = Fraction(4, 5)
SKETCH = 64
RECALL = 0.9999
#: Levels for which the number of runs is reckoned; a pair survives each with at least the threshold's probability.
DEPTH = 3
SMALL = 1024
BLOCK = 1024
#: Shingles in a block, on average at most.
BLOCK_SHINGLES = 2_000_000
LAST = 2**63 - 1


def runs_for(recall: float = RECALL, threshold: Fraction = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is missed with probability 1 - recall at most."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - float(threshold) ** depth)))


def shingles(w: W.Words, gram: int = GRAM) -> list[np.ndarray]:
    """The set of each text: sorted distinct shingle hashes."""
    h = w.hashes()
    g = W.grams(h, gram)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= gram:
            out.append(np.unique(g[a:b - gram + 1]))
        else:
            out.append(W.grams(h[a:b], b - a) if b > a else g[:0])
    return out


def _multipliers(n: int) -> np.ndarray:
    return W.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketches(sets: list[np.ndarray], size: int = SKETCH) -> np.ndarray:
    """MinHash values (32 bits each) of non-empty sets, one row a set."""
    out = np.zeros((len(sets), size), np.uint32)
    if not sets:
        return out
    values = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    for k, a in enumerate(_multipliers(size)):
        least = np.minimum.reduceat(values * a, first)
        out[:, k] = (W.mix(least) >> np.uint64(32)).astype(np.uint32)
    return out


def _describe(gram: int, size: int):
    """(id, digest, text) -> id, digest, set_1, set_2 (hashes of the set), n (its size), sketch."""

    def task(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in W.chunks(texts):
                sets = shingles(W.split(texts[a:b]), gram)
                some = [s for s in sets if len(s)]
                sketch = iter(sketches(some, size))
                one, two, n, packed = [], [], [], []
                for s in sets:
                    n.append(len(s))
                    one.append(int(np.add.reduce(W.mix(s)).view(np.int64)) if len(s) else 0)
                    two.append(int(np.add.reduce(W.mix(s * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)) if len(s) else 0)
                    packed.append(next(sketch).tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                     pa.array(n, pa.int32()), pa.array(packed, pa.binary())], names=["id", "digest", "set_1", "set_2", "n", "sketch"])

    return task


def chosen(node: np.ndarray, size: int, threshold: float) -> np.ndarray:
    """Which coordinates each node draws: rows nodes, columns coordinates."""
    draw = W.mix(node[:, None] ^ W.mix(np.arange(1, size + 1, dtype=np.uint64))[None, :])
    out = draw < np.uint64(min(2.0**64 - 2**11, 2.0**64 / (threshold * size)))
    out[np.arange(len(node)), np.argmin(draw, axis=1)] = True
    return out


def _children(node: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, child node) for members with their nodes and sketches."""
    member, at = np.nonzero(chosen(node, sketch.shape[1], threshold))
    value = sketch[member, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32))
    return member, W.mix(W.mix(node[member]) + value * np.uint64(0xD6E8FEB86659FD93))


def _split(threshold: float, size: int, runs: int | None):
    """(node, cid, sketch) -> (node, cid) of the next level; with ``runs``, (cid, sketch) from the roots of all runs."""

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cid = batch.column("cid").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, size)
            if runs is None:
                nodes = [batch.column("node").to_numpy().view(np.uint64)]
            else:
                nodes = [np.full(len(cid), x) for x in W.mix(np.arange(1, runs + 1, dtype=np.uint64))]
            for node in nodes:
                member, child = _children(node, sketch, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(cid[member])], names=["node", "cid"])

    return task


def forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric matrix of links."""
    left, out = np.ones(len(similar), bool), []
    for root in range(len(similar)):
        if not left[root]:
            continue
        left[root] = False
        edge = [root]
        while edge:
            a = edge.pop()
            new = np.flatnonzero(similar[a] & left)
            left[new] = False
            out += [(a, int(b)) for b in new]
            edge += new.tolist()
    return out


def _propose(size: int, agree: int):
    """(node, cid, sketch), sorted by node -> links between similar members."""

    def task(batches):
        rows: list[tuple[int, int]] = []
        for group in key_groups(batches, "node", ["cid", "sketch"]):
            if len(group) > 1:
                sketch = np.frombuffer(b"".join(s for _, s in group), np.uint32).reshape(-1, size)
                similar = np.concatenate([(part[:, None, :] == sketch[None, :, :]).sum(axis=2) >= agree
                                          for part in np.array_split(sketch, len(sketch) // 32 + 1)])
                rows += [(group[a][0], group[b][0]) for a, b in forest(similar)]
            if len(rows) >= 50_000:
                yield _links(rows)
                rows = []
        yield _links(rows)

    return task


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _agreement(size: int):
    def task(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, size) for c in ("sketch", "pivot_sketch"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "cid", "pivot")), pa.array((a == b).sum(axis=1), pa.int32())],
                                             names=["node", "cid", "pivot", "agree"])

    return task


def proposed_links(classes: DataFrame, threshold: Fraction = THRESHOLD, recall: float = RECALL, size: int = SKETCH,
                   small: int = SMALL) -> DataFrame:
    """classes: (cid, sketch).  (u, v): links between classes whose sketches agree, a forest for each node."""
    t = float(threshold)
    agree = max(1, math.floor(size * t - 5 * math.sqrt(size * t * (1 - t))))
    rows = keep(classes.mapInArrow(_split(t, size, runs_for(recall, threshold)), "node long, cid long").distinct())
    out, n, n_classes = None, rows.count(), classes.count()
    while True:
        rows = gathered(rows, n)
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("cid").alias("pivot")).where("members > 1")
        # Sketches travel at every level: only those of classes that share a node with another still do.
        rows = keep(gathered(rows.join(sizes.select("node"), "node"), n))
        classes = keep(gathered(classes.join(rows.select("cid").distinct(), "cid", "left_semi"), n_classes))
        few = gathered(rows.join(sizes.where(F.col("members") <= small).select("node"), "node").join(classes, "cid"), n)
        found = gathered(few.select("node", "cid", "sketch").repartition("node"), n).sortWithinPartitions("node")
        found = found.mapInArrow(_propose(size, agree), "u long, v long")
        many = rows.join(sizes.where(F.col("members") > small).select("node", "pivot"), "node")
        many = keep(gathered(many, n))
        out = found if out is None else out.unionByName(found)
        n = many.count()
        if not n:
            return out
        classes = keep(gathered(classes.join(many.select("cid").distinct(), "cid", "left_semi"), n_classes))
        pivots = classes.select(F.col("cid").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
        compared = gathered(many.join(classes, "cid").join(pivots, "pivot").select("node", "cid", "pivot", "sketch", "pivot_sketch"), n)
        compared = keep(compared.mapInArrow(_agreement(size), "node long, cid long, pivot long, agree int"))
        out = out.unionByName(compared.where((F.col("agree") >= agree) & (F.col("cid") != F.col("pivot"))).select(F.col("cid").alias("u"), F.col("pivot").alias("v")))
        rest = gathered(compared.where(F.col("agree") < agree).select("node", "cid").join(classes, "cid").select("node", "cid", "sketch"), n)
        rows = keep(rest.mapInArrow(_split(t, size, None), "node long, cid long").distinct())
        n = rows.count()


def similar_pairs(sets: list[np.ndarray], threshold: Fraction = THRESHOLD) -> np.ndarray:
    """Matrix of the pairs of sets with at least that Jaccard similarity, in whole numbers."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.zeros(0), np.zeros(0, int))
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    take = shared[at]
    at, owner = column[at[take]], owner[take]
    common = np.zeros((n, n), np.int64)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for first in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(at, [first, first + 4096])
        part = np.zeros((n, 4096), np.float32)
        part[owner[a:b], at[a:b] - first] = 1
        common += (part @ part.T).astype(np.int64)
    p, q = threshold.numerator, threshold.denominator
    similar = common * (p + q) >= p * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(similar, False)
    return similar


def _verify(threshold: Fraction, gram: int):
    """(key, cid, docs, side, cross, text), sorted by key -> (u, v, docs): u is linked to v (a forest of a group's links), or, with
    v null, to so many documents of the group."""

    def task(batches):
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], names=["u", "v", "docs"])

        for group in key_groups(batches, "key", ["cid", "docs", "side", "cross", "text"]):
            group = list({g[0]: g for g in group}.values())
            if len(group) > 1:
                cid, docs, side, cross, texts = zip(*group)
                similar = similar_pairs(shingles(W.split(list(texts)), gram), threshold)
                side = np.array(side)
                if cross[0]:
                    similar &= side[:, None] != side[None, :]
                linked = similar @ np.array(docs, np.int64)
                rows += [(cid[i], None, int(linked[i])) for i in np.flatnonzero(linked)]
                rows += [(cid[a], cid[b], 0) for a, b in forest(similar)]
            if len(rows) >= 50_000:
                yield batch()
                rows = []
        yield batch()

    return task


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: Fraction = THRESHOLD,
                    recall: float = RECALL, size: int = SKETCH, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per document: id (null as the largest long), digest (of the text), class_id (smallest id of the documents
    that chains of links reach), n_links (documents of at least that similarity), first (it stands for its class)."""
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select("id", F.xxhash64("text").alias("digest"), "text")
    described = keep(d.mapInArrow(_describe(gram, size), "id long, digest long, set_1 long, set_2 long, n int, sketch binary"))
    # A class is known by the first hash of its set; the second and the size guard against a collision.
    cid = F.xxhash64("set_1", "set_2", "n")
    classes = described.where("n > 0").groupBy(cid.alias("cid")).agg(
        F.min(F.struct("id", "digest")).alias("first"), F.count(F.lit(1)).alias("docs"), F.min("sketch").alias("sketch"), F.max("n").alias("n"))
    classes = keep(classes)
    links = proposed_links(classes.select("cid", "sketch"), threshold, recall, size, small)
    parts = keep(components(links).join(classes.select(F.col("cid").alias("id"), "first", "docs", "n"), "id"))
    # a task holds the texts of two blocks: few enough to compare, and of a bounded number of shingles
    blocks = parts.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = parts.join(blocks, "root").withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select(F.col("id").alias("cid"), "docs", "side", F.col("first.id").alias("id"), F.col("first.digest").alias("digest"),
                     (F.col("side") != F.col("other")).alias("cross"), F.concat_ws(":", "root", F.least("side", "other"), F.greatest("side", "other")).alias("key"))
    texts = own.join(thin_out(d, "id", parts.select("first.id")), ["id", "digest"]).select("key", "cid", "docs", "side", "cross", "text")
    verified = keep(texts.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(threshold, gram), "u long, v long, docs long"))
    counts = verified.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("docs").alias("linked"))
    roots = components(verified.where("v is not null").select("u", "v")).select(F.col("id").alias("cid"), "root")
    known = classes.select("cid", "first", "docs").join(roots, "cid", "left").join(counts, "cid", "left")
    known = known.withColumn("root", F.coalesce("root", "cid"))
    heads = known.groupBy("root").agg(F.min("first").alias("head"))
    known = known.join(heads, "root").select(F.col("cid").alias("k_cid"), "head", (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = described.select("id", "digest", F.when(F.col("n") > 0, cid).alias("cid")).join(known, F.col("cid") == F.col("k_cid"), "left")
    head = F.coalesce("head", F.struct("id", "digest"))
    return out.select("id", "digest", head["id"].alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      (head == F.struct("id", "digest")).alias("first"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id."""
    firsts = near_duplicates(docs, doc_id, text, **options).where("first").select("id", "digest").distinct()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                    F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    return d.join(firsts, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
