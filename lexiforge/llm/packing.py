"""Operator 9: best-fit packing of tokenised documents into sequences of a fixed length.

Pattern packing by non-negative least squares.  Documents are tokenised in Spark tasks and cut into pieces of at most
``size`` tokens.  The histogram of piece lengths (at most ``size`` numbers) is all that reaches the driver: lengths are
grouped into bins, patterns of one to three bins that fill a sequence are enumerated, repeat counts are fitted to the
binned histogram by non-negative least squares and rounded (the last piece of a pattern is the longest that still fits),
and what is left is packed by best fit, lengths descending, first into the space the patterns leave.  The outcome is a list of layouts (lengths in order, times used); the pieces of
one length are numbered in Spark and find their sequence and offset by that number.

Defined results: a null text is an empty text, and an empty text is a piece of one token (the end token); rows that
repeat an id are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.store import keep

SIZE = 2048
END_ID = 0
#: Token lengths in a bin of the fit; patterns have at most three bins.
BIN = 8
#: Share of the fitted repeats that is laid out; the rest stays for best fit, which needs short pieces for its gaps.
FITTED = 0.9
#: Words and pieces in each of the two generations whose ids a worker remembers.
CACHE_ENTRIES = 250_000
#: Rows of one length are numbered in groups of about this many.
GROUP_ROWS = 1024
#: Fixed value: the splitting rule of the byte-level tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spelling(path: str) -> dict[int, str] | None:
    """Byte -> character of the byte-level family, if the tokenizer file does no more to a piece than spell its bytes so and merge
    them; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or spec.get("normalizer"):
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    return byte_characters()


def byte_characters() -> dict[int, str]:
    """The byte-level family's character for each byte: visible ones stand for themselves, the others follow U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.  The tokenizer merges inside the pieces of its splitting rule
    only, and no piece goes on from a visible character to white space; so the ids of a text are those of its words with the space
    before them and of the white space between, which repeat a great deal and are remembered: when the young
    generation is full it becomes the old one, and words that are still in use move over.  The file's added tokens cut a
    text before the rule does; each is a piece of its own, with its own id if ``added``, else spelt like any text."""

    def __init__(self, path: str, added: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        own = list(self.tokenizer.get_added_tokens_decoder().values()) if added else []
        if any(t.single_word or t.lstrip or t.rstrip or (t.normalized and self.tokenizer.normalizer) for t in own):
            raise ValueError(f"{path}: added tokens that take in or look at the text around them are not supported")
        # cut first: what follows the text before an added token must not change that text's pieces
        names = sorted((regex.escape(t.content) for t in own), key=len, reverse=True)
        self.between = regex.compile(f"({'|'.join(names)})").split if names else lambda text: [text]
        self.rule = regex.compile(PATTERN).findall
        # the rule's own white space, for the faster cut into words
        space = re.escape("".join(regex.findall(r"\s", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000)])))))
        self.words = re.compile(f" ?[^{space}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.spelling, self.model = _spelling(path), self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> "Encoder":
        """The worker's encoder for a file, which reads the file's added tokens as the tokenizer does unless told otherwise."""
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path, added=True)
        return _ENCODERS[path]

    def pieces(self, text: str) -> list[str]:
        parts = self.between(text)
        if len(parts) == 1:
            return self.rule(text)
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.rule(part))]

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, spelled: str) -> bytes:
        found = self.model.tokenize(spelled)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _piece(self, piece: str) -> bytes:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                if self.spelling is None:
                    ids = self._whole(piece)
                else:
                    ids = self._merged(piece.encode().decode("latin-1").translate(self.spelling))
            self.young[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """The ids of a word that the young generation does not know."""
        ids = self.old.get(word)
        if ids is None:
            if self.spelling and word.isascii() and word.lstrip(" ").isalpha():  # one piece, whose letters stand for themselves
                ids = self._merged(word.replace(" ", self.spelling[0x20]))
            else:
                parts = self.rule(word)
                ids = b"".join(map(self._piece, parts)) if len(parts) > 1 else self._piece(word)
        self.young[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        words = self.words(text)
        ids = list(map(self.young.get, words))
        if None in ids:
            if len(self.young) > CACHE_ENTRIES:
                self.young, self.old = {}, self.young
            known = self.young.get
            ids = [known(w) or self._word(w) if x is None else x for w, x in zip(words, ids)]
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        parts = self.between(text)
        if len(parts) == 1:
            return self._plain(text)
        return b"".join([self._whole(part) if k % 2 else self._plain(part) for k, part in enumerate(parts)])


def cut(n: int, size: int = SIZE) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of a document of n tokens: full pieces, and the first one takes what is over."""
    start, piece, length = 0, 0, n % size or size
    while start < n:
        yield piece, start, length
        start, piece, length = start + length, piece + 1, size


def tokenised(docs: DataFrame, path: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, doc_id, piece, start, length, ids_crc32): the pieces of every document."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    end = np.array([END_ID], dtype="<u4").tobytes()

    def task(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder.of(path)
        gc.disable()  # nothing here refers to itself, and looking for it takes a twelfth of the time
        try:
            for batch in batches:
                ids, pieces, starts, lengths, crcs = [], [], [], [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    data = encoder.encode(t.as_py() or "") + end
                    for piece, start, length in cut(len(data) // 4, size):
                        ids.append(i)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(length)
                        crcs.append(zlib.crc32(data[4 * start:4 * (start + length)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int32()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            gc.enable()

    return d.mapInArrow(task, "doc_id long, piece int, start long, length int, ids_crc32 long")


def patterns(bins: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of bins that add up to ``bins``: one, two or three documents."""
    a, b = np.meshgrid(np.arange(1, bins + 1), np.arange(0, bins + 1), indexing="ij")
    c = bins - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 that minimises |matrix x - target|, by active sets."""
    n = matrix.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds or 3 * matrix.shape[0]):
        gradient = matrix.T @ (target - matrix @ x)
        gradient[active] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(matrix[:, at], target, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            x[at[x[at] <= 1e-12]] = 0
            active = x > 0
            if not active.any():
                return x
    return x


class Layouts:
    """Sequences in the making, by their lengths so far: tuple of lengths -> how many."""

    def __init__(self, size: int):
        self.size = size
        self.by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        room = self.by_room[self.size - sum(lengths)]
        room[lengths] = room.get(lengths, 0) + times

    def best_fit(self, length: int, n: int) -> None:
        """n pieces of a length, each into the fullest sequence that takes it, else into a new one."""
        while n:
            room = min((r for r, held in self.by_room.items() if r >= length and held), default=None)
            if room is None:
                per = self.size // length
                if n >= per:
                    self.add((length,) * per, n // per)
                if n % per:
                    self.add((length,) * (n % per), 1)
                return
            lengths = next(iter(self.by_room[room]))
            have = self.by_room[room].pop(lengths)
            per = min(room // length, n)
            times = min(have, n // per)
            if have > times:
                self.by_room[room][lengths] = have - times
            self.add(lengths + (length,) * per, times)
            n -= per * times

    def all(self) -> list[tuple[tuple[int, ...], int]]:
        return [(lengths, times) for room in sorted(self.by_room) for lengths, times in self.by_room[room].items()]


def plan(histogram: dict[int, int], size: int = SIZE, width: int = BIN) -> list[tuple[tuple[int, ...], int]]:
    """Layouts (lengths, times) that use every piece of the histogram once."""
    left, out = dict(histogram), Layouts(size)
    if n := left.pop(size, 0):
        out.add((size,), n)
    bins = size // width
    by_bin: dict[int, list[int]] = defaultdict(list)
    for length in sorted(left, reverse=True):
        by_bin[-(-length // width)].append(length)
    b = np.zeros(bins + 1)
    for k, lengths in by_bin.items():
        b[k] = sum(left[x] for x in lengths)
    if b.sum() and bins >= 3:
        rows = patterns(bins)
        rows = rows[np.all((b[rows] > 0) | (rows == 0), axis=1)]
        matrix = np.zeros((bins + 1, len(rows)))
        for k in range(3):
            np.add.at(matrix, (rows[:, k], np.arange(len(rows))), 1.0)
        matrix = matrix[1:]
        weight = np.arange(1, bins + 1) / bins  # long pieces that are left over cost more than short ones
        x = FITTED * nnls(matrix * weight[:, None], b[1:] * weight) if len(rows) else np.zeros(0)
        for j in np.argsort(-x, kind="stable"):
            times, used = int(round(float(x[j]))), [int(k) for k in rows[j] if k]
            while times:
                # the longest lengths left of the pattern's bins, and for the last the longest that still fits
                lengths: list[int] = []
                free = lambda v: left.get(v, 0) > lengths.count(v)  # noqa: B023, E731
                for k in used[:-1]:
                    lengths += [v for v in by_bin[k] if free(v)][:1]
                room = size - sum(lengths)
                lengths += [v for v in range(room, max(0, room - 2 * width), -1) if free(v)][:1]
                if len(lengths) < len(used):
                    break
                take = min(times, *(left[v] // lengths.count(v) for v in lengths))
                for v in lengths:
                    left[v] -= take
                out.add(tuple(lengths), take)
                times -= take
    for length in sorted((x for x in left if left[x]), reverse=True):
        out.best_fit(length, left[length])
    return out.all()


def slots(layouts: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> runs (first number, first sequence, offset, how many) in the order of the numbers: pieces
    first .. first + how many - 1 of a length go to one sequence each, from the first sequence on."""
    runs, used, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, times in layouts:
        offset = 0
        for length in lengths:
            runs[length].append((used[length], sequence, offset, times))
            used[length] += times
            offset += length
        sequence += times
    return runs


def numbered(pieces: DataFrame) -> DataFrame:
    """Adds ``number``: 0, 1, 2 ... among the pieces of one length.  A length's pieces fall into groups by a hash of the
    document, so that a length that a third of all rows share is numbered by many tasks."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.select(F.col("length").alias("g_length"), F.ceil(F.col("n") / GROUP_ROWS).cast("long").alias("groups"))
    p = pieces.join(F.broadcast(groups), F.col("length") == F.col("g_length")).drop("g_length")  # a row a length at most
    p = p.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.col("groups")))
    upto = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = p.groupBy("length", "g").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("length").alias("o_length"), F.col("g").alias("o_g"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "piece", "row")) - 1
    p = p.withColumn("place", place).join(offsets, (F.col("length") == F.col("o_length")) & (F.col("g") == F.col("o_g")))
    return p.withColumn("number", F.col("before") + F.col("place")).drop("groups", "g", "before", "place", "o_length", "o_g")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, doc_id: str = "doc_id", text: str = "text",
         width: int = BIN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = tokenised(docs, tokenizer or default_tokenizer(), size, doc_id, text)
    pieces = keep(pieces.withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = slots(plan(histogram, size, width))
    table = {length: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for length, rows in runs.items()}
    shared = spark.sparkContext.broadcast(table)  # bounded: lengths and layouts, not pieces

    def task(batches):
        runs = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, first_sequence, run_offset, _ = runs[int(length[at[0]])]
                k = np.searchsorted(first, number[at], side="right") - 1
                sequence[at] = first_sequence[k] + number[at] - first[k]
                offset[at] = run_offset[k]
            keep_columns = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays(
                [*keep_columns, pa.array(length.astype(np.int64)), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered(pieces).drop("row").mapInArrow(
        task, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
