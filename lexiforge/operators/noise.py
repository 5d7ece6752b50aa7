"""Out-of-domain rows: token noise on real rows (E7) and random rows.

Tokens are drawn from a frequency table (token_id, cum_prob).  Finding the
token for a draw u is a range look-up (first cum_prob >= u); it is done as an
equi-join on a bucket of the running count plus a range test.  A bucket is as
wide as the table's mean count, so there are as many buckets as entries, an
entry is listed under each bucket that it touches (at most twice as many rows
as entries) and a bucket holds at most its width of them: the join's work
grows with the draws, however many words the table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.draws import hash64, pick, uniform
from lexiforge.functions.text import EOS_ID


def bucketed_table(probs: DataFrame) -> DataFrame:
    """(token_id, cnt, cum_cnt, total_cnt) -> (bucket, lo, hi, token_id):
    integer interval [lo, hi) of the running count; exact, no float bounds."""
    lo = probs.select("token_id", (F.col("cum_cnt") - F.col("cnt")).alias("lo"), F.col("cum_cnt").alias("hi"),
                      bucket_width(probs).alias("_width"))
    first, last = F.expr("lo div _width"), F.expr("(hi - 1) div _width")
    return lo.select("token_id", "lo", "hi", F.explode(F.sequence(first, last)).alias("bucket"))


def bucket_width(probs: DataFrame) -> Column:
    """The mean count of an entry, rounded up: a scalar subquery."""
    return probs.agg(F.ceil(F.max("total_cnt") / F.count(F.lit(1))).cast("bigint")).scalar()


def draw_tokens(draws: DataFrame, probs: DataFrame, u_col: str = "u2", out_col: str = "new_tid") -> DataFrame:
    """Adds ``out_col``: the token whose interval holds r = floor(u * total).
    ``draws`` has ``total``.  Equi-join on the bucket of r, then the range test."""
    r = F.floor(F.col(u_col) * F.col("total")).cast("bigint")
    d = draws.withColumn("_r", r).withColumn("_width", bucket_width(probs)).withColumn("_b", F.expr("_r div _width"))
    t = bucketed_table(probs).select(F.col("bucket").alias("_tb"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                                     F.col("token_id").alias(out_col))
    cond = (d["_b"] == t["_tb"]) & (d["_r"] >= t["_lo"]) & (d["_r"] < t["_hi"])
    return d.join(t, cond).drop("_b", "_r", "_width", "_tb", "_lo", "_hi", "total")


def with_total(draws: DataFrame, probs: DataFrame) -> DataFrame:
    """Adds the table's total count: a scalar subquery, no action while the plan is built."""
    return draws.withColumn("total", probs.agg(F.max("total_cnt")).scalar())


def noise_tokens(encoded: DataFrame, probs: DataFrame, rate: float = 0.1, seed: int = 530) -> DataFrame:
    """Every position < len-1 is replaced with probability ``rate`` by a
    drawn token; the last position (EOS) and the label are unchanged."""
    h = hash64(F.lit(seed), F.lit("noise"), F.col("id"))
    at = F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda i: (i < F.col("len") - 1) & (uniform(F.col("_h"), i * 2) < rate))
    ex = encoded.select("id", "len", h.alias("_h")).select("id", "_h", F.explode(at).alias("pos"))
    ex = ex.select("id", "pos", uniform(F.col("_h"), F.col("pos") * 2 + 1).alias("u2"))
    drawn = draw_tokens(with_total(ex, probs), probs)
    # Only the replaced positions travel; they are patched into the rows.
    new = drawn.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "new_tid"))).alias("_m"))
    changed = F.transform("utter", lambda t, i: F.coalesce(F.try_element_at("_m", i), t).cast("int"))
    return encoded.select("id", "intent", "len", "utter").join(new, "id", "left").select("id", "intent", "len", changed.alias("utter"))


def random_ood(seeds: DataFrame, probs: DataFrame, max_len: int = 20, seed: int = 530) -> DataFrame:
    """One random row per row of ``seeds`` (column ``id``): length uniform
    in [1, max_len), tokens before the last drawn from the table, EOS last,
    label -1."""
    h = hash64(F.lit(seed), F.lit("ood"), F.col("id"))
    rows = seeds.select("id", h.alias("_h"))
    rows = rows.select("id", "_h", (pick(F.col("_h"), 0, max_len - 1) + 1).alias("len"))
    ex = rows.where("len > 1").select("id", "_h", F.explode(F.sequence(F.lit(0), F.col("len") - 2)).alias("pos"))
    ex = ex.select("id", "pos", uniform(F.col("_h"), F.col("pos") + 1).alias("u2"))
    drawn = draw_tokens(with_total(ex, probs), probs)
    body = drawn.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "new_tid"))).alias("_u"))
    tokens = F.coalesce(F.transform("_u", lambda s: s["new_tid"].cast("int")), F.array().cast("array<int>"))
    return rows.join(body, "id", "left").select("id", F.lit(-1).alias("intent"), "len", F.concat(tokens, F.array(F.lit(EOS_ID))).alias("utter"))
