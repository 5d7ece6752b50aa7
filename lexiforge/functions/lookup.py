"""Look-up of every token of a unit in a table of words, without a row per token.

Units are dealt into blocks by a hash of their document.  Only a block's
distinct words meet the table; what they find comes back to the block's units
in one cogroup, where Arrow sets each token's value in its place.  So the
shuffles move the texts once and each word once a block, not the row keys once
a token.  A block is one group of the cogroup; their number follows
``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

BLOCKS_PER_PARTITION = 4


def block_of(key: str, partitions: int) -> Column:
    """A number that depends on ``key`` only.  Blocks lie within the hash partitions of ``key``, so rows dealt out by it
    (``spread``) give each block's words from one task."""
    return F.pmod(F.hash(key), F.lit(partitions)) * BLOCKS_PER_PARTITION + F.pmod(
        F.xxhash64(key), F.lit(BLOCKS_PER_PARTITION)).cast("int")


def look_up(units: DataFrame, tables: dict[str, DataFrame], block_key: str = "doc_id", merge: list[str] | None = None,
            missing: int | None = None, piece: int | None = None, distinct: dict[str, str] | None = None) -> DataFrame:
    """The columns of ``units`` and, for each array column named in ``tables``, ``<column>_found``: the values of its
    elements in their order, null (or ``missing``) where the table (word, value) has none.  All tables' values have one
    type, and so have their words, that of the elements; a word stands once in its table.

    ``merge`` names key columns, ``block_key`` among them: rows equal in them become one row, its arrays joined in
    order of (position, value).

    ``distinct`` names columns of ``tables`` that ``units`` has not: each holds the distinct elements, in order, of the column that
    it is given, and is made where the block is, so that it does not travel.

    ``piece``, for large values: a block's rows leave in batches of about so many elements, so that a task holds the block's rows
    and the values of its distinct words, not a value for each element."""
    partitions = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = units.withColumn("_block", block_of(block_key, partitions))
    columns, distinct = list(tables), distinct or {}

    def words(kind: int, column: str) -> Column:
        column = distinct.get(column, column)
        elements = F.coalesce(F.array_distinct(column), F.array().cast(units.schema[column].dataType))
        return F.transform(elements, lambda w: F.struct(F.lit(kind).alias("_kind"), w.alias("_word")))
    # The outer form: the optimiser gives it no filter that would make the words twice.
    needed = (blocks.select("_block", F.explode_outer(F.concat(*[words(k, c) for k, c in enumerate(columns)])).alias("_e"))
              .select("_block", "_e._kind", "_e._word").where(F.col("_word").isNotNull()).distinct())
    known = None
    for k, c in enumerate(columns):
        t = tables[c].select(F.lit(k).alias("_kind"), F.col("word").alias("_word"), F.col("value").alias("_value"))
        known = t if known is None else known.unionByName(t)
    found = needed.join(known, ["_kind", "_word"]).select(F.col("_block").alias("_at"), "_kind", "_word", "_value")
    value = found.schema["_value"].dataType
    made = [StructField(c, ArrayType(units.schema[of].dataType.elementType)) for c, of in distinct.items()]
    schema = StructType([*units.schema.fields, *made, *[StructField(f"{c}_found", ArrayType(value)) for c in columns]])

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        return _placed(_with_distinct(left.drop_columns("_block"), distinct), right, columns, merge, missing)
    if piece is None:
        return blocks.groupBy("_block").cogroup(found.groupBy("_at")).applyInArrow(placed, schema)

    names = units.columns

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch may hold rows of both kinds; those of the table have a kind.
        both = pa.Table.from_batches(batches)
        left = both.filter(pc.is_null(both["_kind"])).select(names)
        right = both.filter(pc.is_valid(both["_kind"])).select(["_kind", "_word", "_value"])
        del both
        for part in _pieces(left, [distinct.get(c, c) for c in columns], merge, piece):
            yield from _placed(_with_distinct(part, distinct), right, columns, merge, missing).to_batches()
    either = blocks.unionByName(found.withColumnRenamed("_at", "_block"), allowMissingColumns=True)
    return either.groupBy("_block").applyInArrow(pieces, schema)


def _pieces(rows: pa.Table, columns: list[str], merge: list[str] | None, size: int) -> Iterator[pa.Table]:
    """``rows`` in parts of about ``size`` elements, rows equal in the key columns ``merge`` in one part."""
    if not rows.num_rows:
        return
    groups = [[i] for i in range(rows.num_rows)]
    if merge:
        groups = (rows.select(merge).append_column("_i", pa.array(range(rows.num_rows), pa.int64()))
                  .group_by(merge).aggregate([("_i", "list")])["_i_list"].to_pylist())
    lengths = [0] * rows.num_rows
    for c in columns:
        lengths = [a + (b or 0) for a, b in zip(lengths, pc.list_value_length(rows[c]).to_pylist(), strict=True)]
    part, held = [], 0
    for same in groups:
        part += same
        held += sum(lengths[i] for i in same)
        if held >= size:
            yield rows.take(part)
            part, held = [], 0
    if part:
        yield rows.take(part)


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def _with_distinct(rows: pa.Table, distinct: dict[str, str]) -> pa.Table:
    for name, of in distinct.items():
        lists = _one(rows[of])
        elements = lists.flatten()
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = elements.dictionary_encode("encode")
        row = np.repeat(np.arange(len(n)), n)
        _, first = np.unique(row * max(1, len(known.dictionary)) + known.indices.to_numpy(), return_index=True)
        first.sort()
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(n)))]).astype(np.int32)
        rows = rows.append_column(name, pa.ListArray.from_arrays(
            pa.array(offsets), elements.take(pa.array(first)), mask=lists.is_null() if lists.null_count else None))
    return rows


def _placed(left: pa.Table, right: pa.Table, columns: list[str], merge: list[str] | None, missing: int | None) -> pa.Table:
    for k, c in enumerate(columns):
        own = right.filter(pc.equal(right["_kind"], k))
        lists = _one(left[c])
        values = _one(own["_value"]).take(pc.index_in(lists.flatten(), value_set=_one(own["_word"]), skip_nulls=True))
        if missing is not None:
            values = values.fill_null(missing)
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0))
        offsets = pa.concat_arrays([pa.array([0], ends.type), ends])
        placed = pa.ListArray.from_arrays(offsets, values, mask=lists.is_null() if lists.null_count else None)
        left = left.append_column(f"{c}_found", placed)
    return _merged(left, columns, merge) if merge else left


def _merged(rows: pa.Table, columns: list[str], keys: list[str]) -> pa.Table:
    groups = (rows.select(keys).append_column("_i", pa.array(range(rows.num_rows), pa.int64()))
              .group_by(keys).aggregate([("_i", "list")])["_i_list"])
    if len(groups) == rows.num_rows:
        return rows
    firsts, joined = [], {c: [] for c in columns}
    for same in groups.to_pylist():
        firsts.append(same[0])
        for c in columns:
            pairs = [(at, value, word) for i in same for at, (value, word) in enumerate(zip(
                rows[f"{c}_found"][i].as_py() or [], rows[c][i].as_py() or [], strict=True))]
            if len(same) > 1:
                pairs.sort(key=lambda p: (p[0], p[1] is not None, p[1]))
            joined[c].append(pairs)
    out = rows.take(firsts)
    for c, lists in joined.items():
        for name, part in ((c, 2), (f"{c}_found", 1)):
            out = out.set_column(out.column_names.index(name), name, pa.array(
                [[p[part] for p in x] for x in lists], rows.schema.field(name).type))
    return out
