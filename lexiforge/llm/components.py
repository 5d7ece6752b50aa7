"""Connected components of links between ids, in Spark (large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.store import gathered, keep


def _state(links: DataFrame):
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, root) for every id that a link names; root: the smallest id of its component.

    A round replaces each id's larger neighbours' links by links to its smallest neighbour (large star), then the same for the
    smaller neighbours (small star), until nothing changes.  Rounds grow with the logarithm of a component's diameter; the
    number of links never grows.  A round's links are kept in the shared folder, in as few files as they are worth.  Null ids take
    no part."""
    links = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), F.col(u).alias("a"), F.col(v).alias("b"))
    links = keep(links.where("a is not null and b is not null and a <> b").select("u", "v").distinct())
    state = _state(links)
    few = lambda df, rows=state[0]: gathered(df, rows)
    links = few(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = few(large.join(least, "u"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(few(least.select("u", F.col("m").alias("v"))))
        links = keep(few(small.distinct()))
        state, before = _state(links), state
        if state == before:
            break
    roots = links.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("id"), "root").unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
