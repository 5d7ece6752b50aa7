"""Label-conditioned Gaussians over vectors.

The data form of the conditional prior: per label and dimension a mean and a
log-variance, aggregated with a map-side combine (hot labels shrink before
the shuffle).  New vectors are drawn as z = mu + exp(logvar/2) * eps with eps
from Box-Muller on two counter-based draws.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.draws import hash64, uniform

LOGVAR_FLOOR = 1e-12


def label_gaussians(vectors: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(label, dim, mu, logvar, n)."""
    ex = vectors.select(F.col(label_col).alias("label"), F.posexplode(vec_col).alias("dim", "x"))
    return (ex.groupBy("label", "dim")
            .agg(F.avg("x").alias("mu"),
                 F.log(F.greatest(F.var_pop("x"), F.lit(LOGVAR_FLOOR))).alias("logvar"),
                 F.count(F.lit(1)).alias("n")))


def pooled_gaussian(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(dim, mu, logvar) over all rows."""
    ex = vectors.select(F.posexplode(vec_col).alias("dim", "x"))
    return ex.groupBy("dim").agg(F.avg("x").alias("mu0"),
                                 F.log(F.greatest(F.var_pop("x"), F.lit(LOGVAR_FLOOR))).alias("logvar0"))


def kl_to_pooled(gauss: DataFrame, pooled: DataFrame) -> DataFrame:
    """KL(N(mu, var) || N(mu0, var0)) summed over dimensions per label:
    1/2 sum(exp(lv - lv0) + (mu - mu0)^2 / exp(lv0) - 1 - (lv - lv0)).
    Joined on the dimension (one row per dimension on the pooled side)."""
    j = gauss.join(pooled, "dim")
    term = (F.exp(F.col("logvar") - F.col("logvar0"))
            + (F.col("mu") - F.col("mu0")) ** 2 / F.exp(F.col("logvar0"))
            - 1 - (F.col("logvar") - F.col("logvar0")))
    return j.groupBy("label").agg((0.5 * F.sum(term)).alias("kl"))


def sample_latent(seeds: DataFrame, gauss: DataFrame, key: str = "vec_id", label_col: str = "label",
                  seed: int = 2020) -> DataFrame:
    """One new vector per seed row, drawn from its label's Gaussian.
    The per-label parameters are regrouped into arrays (one row per label)
    and joined on the label; AQE broadcasts them (one row per class)."""
    params = (gauss.groupBy("label")
              .agg(F.sort_array(F.collect_list(F.struct("dim", "mu", "logvar"))).alias("p")))
    rows = seeds.select(F.col(key).alias("key"), F.col(label_col).alias("label"),
                        hash64(F.lit(seed), F.lit("latent"), F.col(key)).alias("_h"))
    j = rows.join(params, "label")
    h = F.col("_h")

    def z(p, d):
        u1 = 1.0 - uniform(h, d * 2)
        u2 = uniform(h, d * 2 + 1)
        eps = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
        return p["mu"] + F.exp(p["logvar"] / 2.0) * eps
    return j.select("key", "label", F.transform("p", z).alias("z"))
