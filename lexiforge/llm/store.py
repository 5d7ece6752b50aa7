"""The shared folder that a cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.session import ensure_checkpoint_dir, shared_folder  # noqa: F401


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage (Spark 4.1; others pass it over).
END_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame) -> DataFrame:
    """A copy of ``df`` in the shared folder: computed once, its lineage cut, safe when an executor is lost.

    The shuffle files of this step go with its end, so a chain of kept steps holds those of one step; other queries of the
    session keep the setting they had."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(END_SHUFFLES, None)
    spark.conf.set(END_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame of its own, which has the setting
    finally:
        if before is None:
            spark.conf.unset(END_SHUFFLES)
        else:
            spark.conf.set(END_SHUFFLES, before)


#: Rows for which a task is worth starting, and the fewest tasks that a step is gathered into.
ROWS_PER_TASK = 50_000
LEAST_TASKS = 8


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in no more partitions than they are worth: a step of a long chain then starts few tasks and
    writes few files, whatever the number of shuffle partitions.  No row moves, and large frames stay as they are."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // ROWS_PER_TASK)))


def shared_table(spark: SparkSession, prefix: str) -> str:
    """A new path for a written table below the shared folder, whatever store that is in."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def thin_out(df: DataFrame, name: str, ids: DataFrame, log2_bits: int = 23) -> DataFrame:
    """The rows of ``df`` whose column ``name`` is in ``ids`` (its first column), and few others; a join on the ids then decides.
    There is one bit for each hash value, as a table of at most 2^log2_bits / 64 rows (131,072, about 2 MB) that is broadcast.
    With more ids than bits it lets more through, and no row that joins is ever lost.  Columns of ``df`` may not begin with _bit."""
    hashed = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(1 << log2_bits))
    own = ids.select(hashed(F.col(ids.columns[0])).alias("_bit"))
    words = own.groupBy(F.shiftright("_bit", 6).alias("_bit_at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_bit_set"))
    out = df.withColumn("_bit", hashed(F.col(name)))
    out = out.join(F.broadcast(words), F.shiftright("_bit", 6) == F.col("_bit_at"))
    return out.where(F.getbit("_bit_set", F.col("_bit").bitwiseAND(F.lit(63)).cast("int")) == 1).select(df.columns)
