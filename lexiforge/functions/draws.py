"""Counter-based random draws.

Every random decision is a pure function of (seed, operator, row key, variant,
step, position).  Results therefore do not depend on partitioning, task
retries or executor loss, and the same numbers can be computed in plain SQL.

* ``hash64(parts)``: first 15 hex digits of md5 over the '|'-joined parts,
  an integer in [0, 2^60).
* ``uniform(h, i)``: a cheap per-position uniform in [0, 1) derived from one
  hash and a position, so a token list needs one md5 and not one per token.  It
  joins two draws modulo 2^31 - 1, about 53 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.functions.arrays import let

# Fixed values of the per-position mixer (must be equal in every engine).
MIX_PRIME = 2147483647
MIX_MUL_A = 48271
MIX_MUL_B = 69621
HASH_RANGE = 1 << 60


def _col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.lit(x)
    return F.lit(x)


def hash64(*parts) -> Column:
    """Integer draw in [0, 2^60) from md5 of the joined parts."""
    joined = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    return hash64(*parts) / F.lit(float(HASH_RANGE))


def uniform(h: Column, i) -> Column:
    """Uniform in [0,1) for position ``i`` (0-based) under row hash ``h``.  Inside lambdas Spark shares no sub-expressions:
    bound by ``let``, each of the two draws is made once, not seven and three times."""
    i = _col(i).cast("bigint")

    def joined(x, y):
        low = (y * MIX_MUL_A + x) % MIX_PRIME
        return (((y * y) % MIX_PRIME) + low / F.lit(float(MIX_PRIME))) / F.lit(float(MIX_PRIME))
    return let((h + (i + 1) * MIX_MUL_A) % MIX_PRIME, lambda x: let(
        ((x * x) % MIX_PRIME * MIX_MUL_B + h) % MIX_PRIME, lambda y: joined(x, y)))


def pick(h: Column, i, n) -> Column:
    """Integer in [0, n) for position ``i`` under row hash ``h``."""
    return F.floor(uniform(h, i) * _col(n)).cast("int")


# ---------------------------------------------------------------------------
# SQL twins (DuckDB dialect) used by the oracles and documentation.
# ---------------------------------------------------------------------------

def sql_hash64(*parts: str) -> str:
    joined = "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"('0x' || substr(md5({joined}), 1, 15))::BIGINT"


def sql_uniform(h: str, i: str) -> str:
    x = f"(({h}) + (({i}) + 1)::BIGINT * {MIX_MUL_A}) % {MIX_PRIME}"
    y = f"((({x}) * ({x})) % {MIX_PRIME} * {MIX_MUL_B} + ({h})) % {MIX_PRIME}"
    low = f"(({y}) * {MIX_MUL_A} + ({x})) % {MIX_PRIME}"
    return f"((((({y}) * ({y})) % {MIX_PRIME}) + ({low}) / {float(MIX_PRIME)}) / {float(MIX_PRIME)})"


def sql_pick(h: str, i: str, n: str) -> str:
    return f"CAST(floor({sql_uniform(h, i)} * ({n})) AS INTEGER)"
