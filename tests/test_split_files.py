"""Files read by many tasks: line numbers equal to a serial read."""

import os

from pyspark.sql import functions as F

from lexiforge.sources import files

SMALL_SPLITS = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "1"}


def _write(folder, name, lines, last=""):
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write("\n".join(lines) + last)


def test_numbers_equal_a_serial_read(spark, tmp_path):
    """Blank lines, a line longer than several splits, a carriage return, an empty file, no line break at the end."""
    texts = {"a.txt": [f"line {i}" if i % 7 else "" for i in range(400)] + ["x" * 3000, "one\rtwo", "end"],
             "b.txt": [], "c.txt": [f"é{i}" for i in range(100)]}
    for name, lines in texts.items():
        _write(tmp_path, name, lines)
    for k, v in SMALL_SPLITS.items():
        spark.conf.set(k, v)
    try:
        parts = spark.read.option("lineSep", "\n").text(str(tmp_path / "a.txt")).rdd.getNumPartitions()
        got = files.numbered_lines(spark, str(tmp_path)).orderBy("id").collect()
        vocab = files.read_vocab(spark, str(tmp_path / "a.txt")).orderBy("id").collect()
        few = files.read_vocab(spark, str(tmp_path / "a.txt"), limit=5).count()
    finally:
        for k in SMALL_SPLITS:
            spark.conf.unset(k)
    assert parts > 8
    serial = [(name, i, line) for name in sorted(texts) for i, line in enumerate(texts[name])]
    assert [(os.path.basename(r.file), r.line_no, r.value) for r in got] == serial
    assert [r.id for r in got] == list(range(len(serial)))
    assert [(r.id, r.token) for r in vocab] == list(enumerate(x for x in texts["a.txt"] if x))
    assert few == 5


def test_tagged_rows_of_many_files_and_many_splits(spark, tmp_path):
    rows = [f"root\tl{i % 3}\tt{i}\to o" if i % 5 else ("bad\tline" if i % 2 else "  ") for i in range(300)]
    _write(tmp_path, "f1", rows[:150], "\n")
    _write(tmp_path, "f2", rows[150:], "\n")
    for k, v in SMALL_SPLITS.items():
        spark.conf.set(k, v)
    try:
        got = files.read_tagged(spark, str(tmp_path)).orderBy("id").collect()
        none = files.read_tagged(spark, str(tmp_path), 5).count()
    finally:
        for k in SMALL_SPLITS:
            spark.conf.unset(k)
    kept = [(i, r.split("\t")) for i, r in enumerate(rows) if r.count("\t") == 3]
    assert [(r.id, r.label, r.text, r.slots) for r in got] == [(i, f[1], f[2], f[3]) for i, f in kept]
    assert none == 0
    assert {os.path.basename(r.file): r.line_no for r in got}["f1"] == max(i for i, _ in kept if i < 150)
