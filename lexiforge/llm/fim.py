"""Operator 12: fill-in-the-middle transformation of documents at line ends.

Content-defined chunk memoization.  A rolling hash over the last ``WINDOW`` bytes cuts texts into chunks, so that passages that
texts share fall into the same chunks wherever they stand.  What matters of a chunk is a small summary: code points, line ends,
whether it holds a marker, and its first and last bytes, with which a marker across a border is seen.  A worker remembers
summaries by content (a chunk found by its hash counts only if its bytes agree) and adds them up along each text: the sums give
the number of lines and the chunk that holds each cut; only the chunks with a cut are looked at inside.

A text of n lines (``[^\\n]*\\n|[^\\n]+``) is cut after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) lines into
prefix, middle and suffix; h1 to h4 are numbers from a hash of the seed and the document id alone, so any run gives the same.

Defined results: a null text is an empty text; empty texts, texts that hold a marker and texts that the rate leaves out stay
plain; a null document id is hashed as ``null``; rows that repeat an id are cut by the same numbers; an empty table gives no rows;
the other columns come back in ``row``, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.words import chunks as text_ranges
from lexiforge.llm.words import mix

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
RATE, SPM_RATE = 100, 50
#: Bytes that decide a chunk border, mean and largest size of a chunk.
WINDOW = 16
MEAN_CHUNK, MAX_CHUNK = 1024, 16_384
#: Bytes of chunks in each of the two generations that a worker remembers.
CACHE_BYTES = 24_000_000

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


class Summary(NamedTuple):
    """A run of bytes: code points, line ends, whether a marker is inside, and the bytes at its borders."""

    chars: int
    lines: int
    marked: bool
    head: bytes
    tail: bytes


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of the ``WINDOW`` bytes that end there: each step doubles the bytes that a value covers."""
    h, reach = _GEAR[data], 1
    while reach < WINDOW:
        h[reach:] += h[:-reach].copy() << np.uint32(reach)
        reach *= 2
    return h


def borders(data: np.ndarray, starts: np.ndarray, mean: int = MEAN_CHUNK, largest: int = MAX_CHUNK) -> np.ndarray:
    """Where chunks begin in joined texts; every text begins a chunk."""
    hit = np.flatnonzero(rolling(data) & np.uint32((mean - 1) << 16) == 0) + 1
    own = starts[np.searchsorted(starts, hit - 1, side="right") - 1]
    cuts = np.union1d(hit[(hit - own >= WINDOW) & (hit < len(data))], starts)
    gaps = np.diff(np.append(cuts, len(data)))
    extra = [np.arange(c + largest, c + g, largest) for c, g in zip(cuts[gaps > largest], gaps[gaps > largest])]
    return np.union1d(cuts, np.concatenate(extra)) if extra else cuts


class Memo:
    """Summaries of chunks by content, in two generations."""

    def __init__(self, markers: tuple[str, ...] = MARKERS, limit: int = CACHE_BYTES):
        self.markers = [m.encode() for m in markers]
        self.edge = max(map(len, self.markers)) - 1
        self.limit, self.size = limit, 0
        self.young: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}

    def summary(self, chunk: bytes) -> Summary:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk) or self.look(chunk)
            if self.size + len(chunk) > self.limit:
                self.young, self.old, self.size = {}, self.young, 0
            self.young[chunk] = found
            self.size += len(chunk)
        return found

    def look(self, chunk: bytes) -> Summary:
        b = np.frombuffer(chunk, np.int8)
        return Summary(int(np.count_nonzero(b >= -64)), chunk.count(b"\n"), any(m in chunk for m in self.markers),
                       chunk[:self.edge], chunk[-self.edge:])

    def join(self, a: Summary, b: Summary) -> Summary:
        """The summary of two runs in a row."""
        seam = a.tail + b.head
        marked = a.marked or b.marked or any(m in seam for m in self.markers)
        return Summary(a.chars + b.chars, a.lines + b.lines, marked, (a.head + b.head)[:self.edge] if len(a.head) < self.edge else a.head,
                       (a.tail + b.tail)[-self.edge:])


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]


def _after_line(chunk: bytes, k: int) -> int:
    """Where the text goes on after the k-th line end of a chunk (from 1)."""
    return int(np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10)[k - 1]) + 1


def split_points(text: bytes, cuts: list[int], memo: Memo, lines: tuple[int, int]) -> list[tuple[int, int]]:
    """(bytes, code points) before each number of lines of a text that is cut into chunks at ``cuts``."""
    ends = [*cuts[1:], len(text)]
    own = [memo.summary(text[a:b]) for a, b in zip(cuts, ends)]
    upto = np.cumsum([s.lines for s in own])
    out = []
    for k in lines:
        c = int(np.searchsorted(upto, k))  # the chunk that holds the k-th line end
        if k == 0:
            out.append((0, 0))
        elif c == len(own):
            out.append((len(text), sum(s.chars for s in own)))
        else:
            at = _after_line(text[cuts[c]:ends[c]], k - int(upto[c] - own[c].lines))
            inside = np.frombuffer(text, np.int8, at, cuts[c])
            out.append((cuts[c] + at, sum(s.chars for s in own[:c]) + int(np.count_nonzero(inside >= -64))))
    return out


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
              markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) for every row; row: a struct of the columns but the text.

    form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).  Of 100 documents about ``rate`` are rearranged,
    of these about ``spm_rate`` per cent as spm.  ``markers``: for prefix, suffix and middle."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.struct(*others).alias("row"))
    p, s, m = (x.encode() for x in markers)

    def task(batches):
        memo = Memo(markers)
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            for first, last in text_ranges(texts):
                rows = list(_transformed(ids[first:last], texts[first:last], memo, seed, rate, spm_rate, (p, s, m)))
                n, form, before, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, last - first), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    names=["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = d.select("row").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return d.mapInArrow(task, schema)


def _transformed(ids, texts, memo, seed, rate, spm_rate, markers):
    p, s, m = markers
    starts = np.cumsum([0] + [len(t) for t in texts])
    filled = starts[:-1][np.diff(starts) > 0]
    cuts = borders(np.frombuffer(b"".join(texts), np.uint8), filled) if len(filled) else np.zeros(0, np.int64)
    at = np.searchsorted(cuts, starts)
    for k, (i, t) in enumerate(zip(ids, texts)):
        if not t:
            yield 0, "plain", None, None, t
            continue
        own = (cuts[at[k]:at[k + 1]] - starts[k]).tolist()
        whole = None
        for a, b in zip(own, [*own[1:], len(t)]):
            x = memo.summary(t[a:b])
            whole = x if whole is None else memo.join(whole, x)
        n = whole.lines + (not t.endswith(b"\n"))
        h1, h2, h3, h4 = draws(i, seed)
        if whole.marked or h3 % 100 >= rate:
            yield n, "plain", None, None, t
            continue
        one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
        (a, before), (b, upto) = split_points(t, own, memo, (one, two))
        if h4 % 100 < spm_rate:
            yield n, "spm", before, upto - before, b"".join((s, t[b:], p, t[:a], m, t[a:b]))
        else:
            yield n, "psm", before, upto - before, b"".join((p, t[:a], s, t[b:], m, t[a:b]))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text, from the output and its form alone.  A text that is not plain holds no marker, so the three markers of its
    output part it."""
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in markers), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
