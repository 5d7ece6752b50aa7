"""Operator 1: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / weight, where u is drawn from a hash of its id and weight is its quality.  Within
a source the documents are ordered by key and their sizes are prefix-summed; the target buys complete epochs of the
source first, and what is left over is filled in key order (the boundary document is in if that brings the sum closer).

The order inside a source is never one task: the key range of a source is cut into buckets of about ``bucket_rows``
documents, the bucket sums (one row per bucket) give offsets, and only the rows of one bucket meet in a window.

Defined results: a null text has size 0; a null source is a source of its own and comes last; documents of size 0 are
in every epoch and carry no words; rows that repeat an id are documents of their own; without words all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.store import keep
from lexiforge.llm.words import WORD_PATTERN

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BUCKET_ROWS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of a text's characters that are neither symbols nor digits nor upper case, 0.05 at least."""
    odd = F.length(text) - F.length(F.translate(text, "0123456789#*$%&|<>!ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.greatest(F.lit(0.05), F.coalesce(1 - odd / F.greatest(F.length(text), F.lit(1)), F.lit(0.05)))


def uniform_key(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5 over the parts."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sampling_key(doc_id: Column, size: Column, weight: Column, seed: int) -> Column:
    return -F.log(uniform_key(F.lit(seed), doc_id, size)) / weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``target``.  Sources by code point, null last, take the weights in turn
    and share the sum of all sizes; a target stops at ``max_epochs`` times its source and the excess goes to the others
    by weight.  The fixed point is a level: target = min(max_epochs * size, level * weight), found over the sources in
    order of cap / weight.  The table has one row per configured source; it is small by its nature."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", F.greatest(left, F.lit(0.0)) / free)
    s = s.withColumn("uncapped", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.first(F.when(F.col("uncapped"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("w")), F.col("cap")))
    return s.select("source", "source_size", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        max_epochs: int = MAX_EPOCHS, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs (complete ones), chosen (in the
    fraction), copies (times it is taken), taken (= copies * size), key.  Other columns of ``docs`` are not carried."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                       quality_weight(F.col(text)).alias("quality"))
    rows = keep(rows.withColumn("key", sampling_key(F.col("doc_id"), F.col("size"), F.col("quality"), seed)))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"),
                                         F.avg("quality").alias("pace"))
    targets = source_targets(sources.select("source", "source_size"), weights, max_epochs)
    targets = targets.withColumnRenamed("source", "t_source").drop("source_size")
    plan = sources.join(targets, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    plan = plan.select(
        F.col("source").alias("p_source"), "source_size", "target", "pace",
        F.ceil(F.col("n") / bucket_rows).cast("long").alias("buckets"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"))
    plan = keep(plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    # 1 - exp(-key * mean quality) is monotone in the key and spreads the keys of a source over (0, 1).
    placed = (rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
              .withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * F.col("pace"))) * F.col("buckets")).cast("long")))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"),
                          F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy(
        "key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("prefix", F.sum("size").over(within)).join(
        offsets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    half = F.col("offset") + F.col("prefix") - F.col("size") / 2
    out = out.withColumn("chosen", F.col("epochs") < max_epochs).withColumn("chosen", F.col("chosen") & (half <= F.col("budget")))
    copies = F.col("epochs") + F.col("chosen").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "chosen", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"), "key")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
          max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it.  What a source takes beyond its complete epochs is
    a prefix of its order, so the last place taken (one row a source) decides, and texts are not shuffled."""
    taken = mix(docs, doc_id, text, source, weights, max_epochs, seed)
    place = lambda i, size, key: F.struct(key.alias("key"), i.isNull().alias("no_id"), i.alias("id"), size.alias("size"))
    ends = taken.groupBy("source").agg(
        F.max("epochs").alias("epochs"), F.max(F.when(F.col("chosen"), place(F.col("doc_id"), F.col("size"), F.col("key")))).alias("end"))
    ends = keep(ends.withColumnRenamed("source", "e_source"))
    size = n_words(F.col(text))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"),
                    place(F.col(doc_id), size, sampling_key(F.col(doc_id), size, quality_weight(F.col(text)), seed)).alias("place"))
    d = d.join(ends, F.col("source").eqNullSafe(F.col("e_source")))
    copies = F.col("epochs") + F.coalesce(F.col("place") <= F.col("end"), F.lit(False)).cast("long")
    return d.withColumn("copies", copies).where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
