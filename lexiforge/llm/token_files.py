"""Operator 13: token ids of a corpus in binary files of patched frame-of-reference blocks.

``write`` sorts the documents by id, encodes them in Spark tasks and lets each task write one file; ``read`` gives the
documents back, and ``read_ids`` any run of ids of the whole corpus, from only the blocks that hold it.

A column of whole numbers is stored in blocks of ``BLOCK`` numbers.  A block subtracts its minimum and packs the differences
at the width that ``percentile`` per cent of them fit; what a larger one has above that width goes to the block's exception
list (positions and high bits).  A column starts with the places of its blocks, so any number is found by reading one block.

File: ``MAGIC``, segments, footer.  A segment holds about ``SEGMENT_IDS`` ids of whole documents: (documents, documents without
an id, ids, first document id), then three columns with their byte lengths: steps between document ids, ids per document, ids.
The footer has (offset, bytes, documents, ids) of each segment, then its own offset and ``MAGIC``.
The folder's ``manifest`` is a Parquet table with one row per file; as Spark commits it at the end, it names whole files only.  A
task that runs again writes the same bytes under the same name (files appear by renaming), so lost executors do no harm.
Folders may be mounted or in any store that ``pyarrow.fs`` opens; whoever names the folder removes it.

Defined results: a null or empty text has the end id only; documents without an id come last; rows that repeat an id follow
each other, ordered by a hash of their texts (equal rows in any order); an empty table gives a manifest without files.
Other columns of ``docs`` are not read, whatever their names.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm.packing import byte_characters

MAGIC = b"LXTOK001"
BLOCK = 1024
SEGMENT_IDS = 1 << 20
PERCENTILE = 90
END_ID = 2
#: Words in each of the two generations whose ids a worker remembers, and the longest that is.
CACHE_WORDS = 300_000
CACHE_BYTES = 64
#: Bytes of ids in a batch that a reading task hands on.
BATCH_BYTES = 4_000_000
#: The most reading tasks; beyond, a task reads several segments.
MAX_TASKS = 20_000

_PRINTABLE = re.compile(rb"[!-~]+").fullmatch
#: The same with the letters U+00C0 to U+00FF, which NFC and NFKC leave as they are.
_LATIN = re.compile(rb"(?:[!-~]|\xC3[\x80-\xBF])+").fullmatch
_SPELLING = byte_characters()
_BLOCK_HEAD = struct.Struct("<QBBH")  # minimum, width, width of high bits, exceptions
_SEGMENT_HEAD = struct.Struct("<qqqq")
_ENTRY = struct.Struct("<qqqq")
_END = struct.Struct("<q8s")
_HEAD_BYTES = _SEGMENT_HEAD.size

MANIFEST = "shard int, file string, n_docs long, n_ids long, segments array<struct<offset:long,bytes:long,n_docs:long,n_ids:long>>"


# -- columns of blocks ------------------------------------------------------------------------------------------------

def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    if x.size and int(x.max()) < len(_SHORT):
        return _SHORT[x.astype(np.int64)]
    if not x.size or int(x.max()) < 1 << 53:  # exact in doubles
        return np.frexp(x.astype(np.float64))[1].astype(np.uint8)
    high = x >> np.uint64(32)
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((x & np.uint64(2**32 - 1)).astype(np.float64))[1]).astype(np.uint8)


_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row of numbers below 2^width as a row of bytes."""
    size = 2 if width <= 16 else 4 if width <= 32 else 8
    octets = np.ascontiguousarray(rows.astype(f"<u{size}")).view(np.uint8)
    planes = np.unpackbits(octets, axis=1, bitorder="little").reshape(*rows.shape, 8 * size)
    return np.packbits(planes[:, :, :width].reshape(len(rows), -1), axis=1, bitorder="little")


def _numbers(data: np.ndarray, width: int, n: int) -> np.ndarray:
    """The inverse of ``_bits`` for rows of n numbers."""
    planes = np.unpackbits(data, axis=1, count=n * width, bitorder="little").reshape(len(data), n, width)
    size = 2 if width <= 16 else 4 if width <= 32 else 8
    padded = np.zeros((len(data), n, 8 * size), np.uint8)
    padded[:, :, :width] = planes
    return np.packbits(padded.reshape(len(data), -1), axis=1, bitorder="little").view(f"<u{size}").astype(np.uint64)


def encode_column(values: np.ndarray, percentile: int = PERCENTILE, block: int = BLOCK) -> bytes:
    """Number of values, places of the blocks, blocks.  Values: whole numbers from 0 to 2^64 - 1."""
    values = np.asarray(values, dtype=np.uint64)
    n, blocks = len(values), -(-len(values) // block)
    if not n:
        return struct.pack("<Q", 0)
    rows = np.concatenate([values, np.full(blocks * block - n, values[-1])]).reshape(blocks, block)
    low = rows.min(axis=1)
    rows = rows - low[:, None]
    need = _widths(rows)
    at = min(block - 1, block * percentile // 100)
    width = np.partition(need, at, axis=1)[:, at]
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        body = _bits(rows[own] & np.uint64((1 << int(w)) - 1), int(w)) if w else np.zeros((len(own), 0), np.uint8)
        for k, b in zip(own, body):
            out = np.flatnonzero(need[k] > w)
            high = rows[k, out] >> np.uint64(w)
            high_width = int(need[k].max()) - int(w) if len(out) else 0
            tail = out.astype("<u2").tobytes() + (_bits(high[None], high_width).tobytes() if len(out) else b"")
            packed[k] = _BLOCK_HEAD.pack(int(low[k]), int(w), high_width, len(out)) + b.tobytes() + tail
    places = np.cumsum([0] + [len(b) for b in packed]).astype("<u8")
    return struct.pack("<Q", n) + places.tobytes() + b"".join(packed)


def _places(data: memoryview, block: int) -> tuple[int, np.ndarray, int]:
    """(values, places of the blocks, where blocks begin) of a column that starts at ``data``."""
    n = struct.unpack_from("<Q", data)[0]
    blocks = -(-n // block)
    return n, np.frombuffer(data, "<u8", blocks + 1 if n else 0, 8), 8 + 8 * (blocks + 1 if n else 0)


def decode_blocks(parts: list[memoryview], block: int = BLOCK) -> np.ndarray:
    """The numbers of some whole blocks."""
    rows = np.zeros((len(parts), block), np.uint64)
    heads = [_BLOCK_HEAD.unpack_from(p) for p in parts]
    by_width: dict[int, list[int]] = {}
    for k, h in enumerate(heads):
        by_width.setdefault(h[1], []).append(k)
    for w, own in by_width.items():
        size = -(-block * w // 8)
        if w:
            rows[own] = _numbers(np.stack([np.frombuffer(parts[k], np.uint8, size, _BLOCK_HEAD.size) for k in own]), w, block)
        for k in own:
            low, _, high_width, exceptions = heads[k]
            if exceptions:
                at = np.frombuffer(parts[k], "<u2", exceptions, _BLOCK_HEAD.size + size)
                high = np.frombuffer(parts[k], np.uint8, -(-exceptions * high_width // 8), _BLOCK_HEAD.size + size + 2 * exceptions)
                rows[k, at] |= _numbers(high[None], high_width, exceptions)[0] << np.uint64(w)
            rows[k] += np.uint64(low)
    return rows.reshape(-1)


def decode_column(data: memoryview, first: int = 0, last: int | None = None, block: int = BLOCK) -> np.ndarray:
    """Values ``first`` to ``last`` (not included) of a column; only their blocks are unpacked."""
    data = memoryview(data)
    n, places, begin = _places(data, block)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint64)
    a, b = first // block, -(-last // block)
    parts = [data[begin + int(places[k]):begin + int(places[k + 1])] for k in range(a, b)]
    return decode_blocks(parts, block)[first - a * block:last - a * block]


# -- segments and files -----------------------------------------------------------------------------------------------

def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    known = np.array([i for i in doc_ids if i is not None], dtype=np.int64)
    steps = np.diff(known.view(np.uint64)) if len(known) else np.zeros(0, np.uint64)
    columns = [encode_column(c, percentile) for c in (steps, np.array(lengths, np.uint64), ids)]
    head = _SEGMENT_HEAD.pack(len(doc_ids), len(doc_ids) - len(known), len(ids), int(known[0]) if len(known) else 0)
    return head + b"".join(struct.pack("<Q", len(c)) + c for c in columns)


def _columns(data: memoryview) -> list[memoryview]:
    out, at = [], _SEGMENT_HEAD.size
    for _ in range(3):
        size = struct.unpack_from("<Q", data, at)[0]
        out.append(data[at + 8:at + 8 + size])
        at += 8 + size
    return out


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids per document, ids as little-endian 32-bit numbers)"""
    view = memoryview(data)
    n_docs, n_null, _, first = _SEGMENT_HEAD.unpack_from(view)
    steps, lengths, ids = _columns(view)
    known: list[int | None] = []
    if n_docs > n_null:
        start = np.array([first], np.int64).view(np.uint64)
        known = np.cumsum(np.concatenate([start, decode_column(steps)]), dtype=np.uint64).view(np.int64).tolist()
    return known + [None] * n_null, decode_column(lengths).astype(np.int64), decode_column(ids).astype("<u4")


def open_store(folder: str):
    """(file system, path) of a folder name as Spark takes it."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


class Writer:
    """One file in the making; it gets its name when it is whole."""

    def __init__(self, folder: str, name: str, percentile: int):
        self.store, path = open_store(folder)
        self.store.create_dir(path, recursive=True)
        self.name, self.path, self.percentile = name, f"{path}/{name}", percentile
        self.draft = f"{path}/_{uuid.uuid4().hex}-{name}"
        self.out, self.at, self.segments = None, 0, []

    def put(self, data: bytes) -> None:
        if self.out is None:
            self.out = self.store.open_output_stream(self.draft)
        self.out.write(data)
        self.at += len(data)

    def segment(self, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        if not self.at:
            self.put(MAGIC)
        data, offset = encode_segment(doc_ids, lengths, ids, self.percentile), self.at
        self.put(data)
        self.segments.append((offset, len(data), len(doc_ids), len(ids)))

    def close(self) -> None:
        foot = self.at
        self.put(b"".join(_ENTRY.pack(*s) for s in self.segments) + _END.pack(foot, MAGIC))
        self.out.close()
        self.store.move(self.draft, self.path)


def footer(data: bytes) -> list[tuple[int, int, int, int]]:
    """The segments of a whole file: (offset, bytes, documents, ids)."""
    at, magic = _END.unpack_from(data, len(data) - _END.size)
    if magic != MAGIC or data[:len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    return list(_ENTRY.iter_unpack(data[at:len(data) - _END.size]))


# -- encoding ---------------------------------------------------------------------------------------------------------

def steps(spec: dict, name: str, parts: str) -> list[dict]:
    """The steps of a tokenizer file's normalising or splitting, nested sequences unfolded."""
    step = spec.get(name)
    unfold = lambda x: [z for y in x[parts] for z in unfold(y)] if x["type"] == "Sequence" else [x]
    return unfold(step) if step else []


def words_stand_alone(spec: dict) -> bool:
    """Whether a tokenizer file treats each run between white space alone: its first splitting step drops white space and
    no normalising step joins characters over it."""
    one_space = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if any(s["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents") and s != one_space for s in steps(spec, "normalizer", "normalizers")):
        return False
    first = (steps(spec, "pre_tokenizer", "pretokenizers") or [{"type": ""}])[0]
    own = first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]:
        own = not any(c.isspace() for m in _rule(first).findall(" \t\n\x0b\x0c\r a b\n c 1 . \n\n") for c in m)  # matches are words
    return own and not any(t[f] for t in spec.get("added_tokens", []) for f in ("single_word", "lstrip", "rstrip"))


def _rule(step: dict):
    import regex

    return regex.compile(step["pattern"].get("Regex") or regex.escape(step["pattern"]["String"]))


def plain_rule(spec: dict):
    """The splitting rule for words of printable ASCII, if the file's steps do no more to those than lower their case, split them
    by one pattern and spell bytes as characters (which leaves printable ASCII as it is); else None."""
    split = steps(spec, "pre_tokenizer", "pretokenizers")
    normal = [s["type"] for s in steps(spec, "normalizer", "normalizers")]
    if [s["type"] for s in split] != ["Split", "ByteLevel"] or not words_stand_alone(spec) or "Lowercase" not in normal:
        return None
    if split[1]["use_regex"] or split[1]["add_prefix_space"] or spec["model"]["type"] != "BPE":
        return None
    return _rule(split[0])


class Encoder:
    """Ids of texts, as the tokenizer gives them without special tokens of its own.  Where the file allows it, texts are cut at
    ASCII white space and the ids of words are remembered in two generations; else whole texts are encoded.  Words of printable
    ASCII (and of the letters U+00C0 to U+00FF, if the file's steps but compose and lower those) go straight to the tokenizer's model,
    piece by piece of the file's splitting rule, all others through the whole tokenizer."""

    _known: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = words_stand_alone(spec)
        self.rule = plain_rule(spec)
        normal = {s["type"] for s in steps(spec, "normalizer", "normalizers")}
        self.is_plain = _LATIN if normal <= {"NFC", "NFKC", "Lowercase", "Replace"} else _PRINTABLE
        added = b"|".join(re.escape(t["content"].encode()) for t in spec.get("added_tokens", []))
        # else a word of letters holds none
        self.added_letters = any(t["content"].encode().isalpha() for t in spec.get("added_tokens", []))
        self.holds_added = re.compile(added or rb"(?!)", re.IGNORECASE).search
        # letters alone are one piece of the rule (a piece is a word of its own, so words and pieces share what is remembered)
        self.one_piece = self.rule is not None and all(self.rule.findall(x) == [x] for x in ("a", "word", "st", "llvemred"))
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _piece(self, piece: bytes) -> bytes:
        ids = self.young.get(piece) or self.old.get(piece)
        if ids is None:
            found = self.model.tokenize(piece.decode() if piece.isascii() else piece.decode("latin-1").translate(_SPELLING))
            ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
            if len(piece) <= CACHE_BYTES and (piece.isalpha() and not self.added_letters or not self.holds_added(piece)):
                self.young[piece] = ids
        return ids

    def _plain(self, word: bytes) -> bytes:
        if word.isalpha() and self.one_piece:
            return self._piece(word.lower())
        return b"".join([self._piece(p.encode()) for p in self.rule.findall(word.decode().lower())])

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that the young generation does not know; those too long to remember are only returned."""
        if len(self.young) + len(words) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        out, other = {}, []
        for w in words:
            ids = self.old.get(w)
            if ids is None and self.rule and (w.isalpha() and not self.added_letters or (w.isalpha() or self.is_plain(w)) and not self.holds_added(w)):
                ids = self._plain(w)
            if ids is None:
                other.append(w)
            else:
                out[w] = ids
        out.update(zip(other, self._whole([w.decode() for w in other])))
        self.young.update((w, ids) for w, ids in out.items() if len(w) <= CACHE_BYTES)
        return out

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a UTF-8 text."""
        if not self.by_word:
            return b"".join(self._whole([text.decode()]))
        words = text.split()
        ids = list(map(self.young.get, words))
        if None in ids:
            new = self._learn({w for w, x in zip(words, ids) if x is None})
            ids = [new[w] if x is None else x for w, x in zip(words, ids)]
        return b"".join(ids)


# -- Spark ------------------------------------------------------------------------------------------------------------

def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _chunks(batches: Iterator[pa.RecordBatch], limit: int = 2_000_000) -> Iterator[tuple[list, list]]:
    """(document ids, texts as bytes) of a few megabytes."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        begin = size = 0
        for k, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()):
            if k > begin and size + n > limit:
                yield ids[begin:k], texts.slice(begin, k - begin).to_pylist()
                begin, size = k, 0
            size += n
        if begin < len(ids):
            yield ids[begin:], texts.slice(begin).to_pylist()


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, percentile: int = PERCENTILE,
          segment_ids: int = SEGMENT_IDS, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes the ids of every text and ``end_id`` after each, in ascending order of document ids, to a new folder."""
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()

    def task(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, shard = Encoder.of(path), TaskContext.get().partitionId()
        file = Writer(folder, f"part-{shard:06d}.tok", percentile)
        doc_ids, lengths, parts, n = [], [], [], 0

        def flush():
            file.segment(doc_ids, lengths, np.frombuffer(b"".join(parts), "<u4"))

        gc.disable()  # nothing here refers to itself
        try:
            for ids, texts in _chunks(batches):
                for i, t in zip(ids, texts):
                    data = encoder.encode(t or b"")
                    doc_ids.append(i)
                    lengths.append(len(data) // 4 + 1)
                    parts += [data, end]
                    n += lengths[-1]
                    if n >= segment_ids:
                        flush()
                        doc_ids, lengths, parts, n = [], [], [], 0
        finally:
            gc.enable()
        if doc_ids:
            flush()
        if not file.segments:
            return
        file.close()
        s = pa.array([[dict(zip(("offset", "bytes", "n_docs", "n_ids"), x)) for x in file.segments]],
                     pa.list_(pa.struct([(c, pa.int64()) for c in ("offset", "bytes", "n_docs", "n_ids")])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([file.name]), pa.array([sum(x[2] for x in file.segments)], pa.int64()),
             pa.array([sum(x[3] for x in file.segments)], pa.int64()), s], names=["shard", "file", "n_docs", "n_ids", "segments"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # equal rows are told apart, so that no range of the sort must take them all
    d = d.withColumn("digest", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = d.orderBy(F.col("doc_id").asc_nulls_last(), "digest", "row").select("doc_id", "text")
    ordered.mapInArrow(task, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, bytes, n_docs, n_ids, start): every segment, with the number of ids of the corpus before it."""
    files = spark.read.parquet(f"{folder}/manifest")
    # one row per file: as many as the writing job had tasks
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    s = files.select("shard", "file", "before", F.posexplode("segments").alias("k", "s"))
    own = Window.partitionBy("shard").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("file", "s.*", (F.col("before") + F.coalesce(F.sum("s.n_ids").over(own), F.lit(0))).alias("start"))


def _fetch(folder: str, file: str, offset: int, size: int) -> bytes:
    store, path = open_store(folder)
    with store.open_input_file(f"{path}/{file}") as f:
        return f.read_at(size, offset)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                      names=["doc_id", "start", "n_tokens", "ids"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids: little-endian unsigned 32-bit numbers."""

    def task(batches):
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for s in batch.to_pylist():
                doc_ids, lengths, ids = decode_segment(_fetch(folder, s["file"], s["offset"], s["bytes"]))
                at = 0
                for i, n in zip(doc_ids, lengths.tolist()):
                    rows.append((i, s["start"] + at, n, ids[at:at + n].tobytes()))
                    at, size = at + n, size + 4 * n
                    if size >= BATCH_BYTES or len(rows) >= 10_000:
                        yield _rows(rows)
                        rows, size = [], 0
        if rows:
            yield _rows(rows)

    places = segments(spark, folder).select("file", "offset", "bytes", "start")
    n = spark.read.parquet(f"{folder}/manifest").agg(F.sum(F.size("segments")).alias("n")).first()["n"] or 1
    # few bytes name much work: the number of tasks is given, so that Spark does not put them all into one
    return places.repartition(min(n, MAX_TASKS), "file", "offset").mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")


def read_ids(spark: SparkSession, folder: str, start: int, n: int) -> DataFrame:
    """(start, ids): the ids ``start`` to ``start + n`` of the corpus in runs of at most a segment, read from their blocks alone."""

    def task(batches):
        for batch in batches:
            for s in batch.to_pylist():
                a, b = max(0, start - s["start"]), min(s["n_ids"], start + n - s["start"])
                at = s["offset"] + _HEAD_BYTES
                for _ in range(2):  # the columns of steps and lengths are passed over
                    at += 8 + struct.unpack("<Q", _fetch(folder, s["file"], at, 8))[0]
                at += 8
                blocks = -(-s["n_ids"] // BLOCK)
                first, last = a // BLOCK, -(-b // BLOCK)
                places = np.frombuffer(_fetch(folder, s["file"], at + 8 + 8 * first, 8 * (last - first + 1)), "<u8").astype(np.int64)
                data = memoryview(_fetch(folder, s["file"], at + 8 + 8 * (blocks + 1) + int(places[0]), int(places[-1] - places[0])))
                ids = decode_blocks([data[x - places[0]:y - places[0]] for x, y in zip(places, places[1:])])
                ids = ids[a - first * BLOCK:b - first * BLOCK].astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([s["start"] + a], pa.int64()), pa.array([ids.tobytes()], pa.binary())], names=["start", "ids"])

    own = segments(spark, folder).where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start))
    return own.select("file", "offset", "n_ids", "start").mapInArrow(task, "start long, ids binary")
