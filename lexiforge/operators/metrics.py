"""Evaluation metrics and reports.

All are aggregations; the per-row parts are array expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators.mixup import cross_entropy


def argmax(logits) -> F.Column:
    """0-based index of the first maximum."""
    return F.array_position(logits, F.array_max(logits)) - 1


def accuracy(preds: DataFrame, logits_col: str = "logits", target_col: str = "target") -> DataFrame:
    """A5 + A6: n, correct, accuracy and mean cross-entropy."""
    ok = (argmax(F.col(logits_col)) == F.col(target_col)).cast("int")
    ce = cross_entropy(F.col(logits_col), F.col(target_col))
    return preds.select(ok.alias("ok"), ce.alias("ce")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ok").alias("correct"),
        F.avg("ok").alias("accuracy"), F.avg("ce").alias("loss"))


def corpus_stats(units: DataFrame) -> DataFrame:
    """A10: (metric, value) rows: units, tokens, vocabulary size, labels.  Units and their tokens are counted in one pass."""
    label, token = units.schema["label"].dataType, units.schema["tokens"].dataType.elementType

    def entry(is_unit: bool, of_label, of_token, size):
        return F.struct(F.lit(is_unit).alias("is_unit"), of_label.cast(label).alias("label"), of_token.cast(token).alias("token"),
                        size.cast("bigint").alias("size"))
    none = F.lit(None)
    words = F.transform("tokens", lambda t: entry(False, none, t, none))
    unit = F.array(entry(True, F.col("label"), none, F.size("tokens")))
    entries = units.select(F.explode(F.when(F.col("tokens").isNull(), unit).otherwise(F.concat(unit, words))).alias("e")).select("e.*")
    counted = entries.groupBy("is_unit", "label", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    is_unit = F.col("is_unit")
    stats = counted.agg(F.coalesce(F.sum(F.when(is_unit, F.col("n"))), F.lit(0)).alias("n_units"), F.sum("size").alias("n_tokens"),
                        F.count_if(~is_unit).alias("vocab_size"), F.count_if(is_unit).alias("n_labels"))
    return stats.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("value"))
                                            for m in stats.columns])).alias("m")).select("m.metric", "m.value")


def growth_report(augmented: DataFrame) -> DataFrame:
    """Rows per label and method, with rollup totals."""
    return (augmented.rollup("label", "method").agg(F.count(F.lit(1)).alias("n_rows")))


def checkpoint_history(history: DataFrame, patience: int = 5) -> DataFrame:
    """Running best (min loss) and a decay flag when the loss exceeds the
    max of the previous ``patience`` checks; per run, ordered by step."""
    w = Window.partitionBy("run").orderBy("step")
    prev = w.rowsBetween(-patience, -1)
    return (history
            .withColumn("best_loss", F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("prev_max", F.max("loss").over(prev))
            .withColumn("decay", F.coalesce(F.col("loss") > F.col("prev_max"), F.lit(False))))
