"""Array helpers for higher-order expressions.

Spark evaluates every sub-expression used inside a lambda once per element
(no common-subexpression sharing in lambdas).  ``let`` evaluates a value once
per row and hands it to the body as a lambda variable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def map_get(m: Column, key: Column, default: Column | None = None) -> Column:
    """Value for ``key`` or ``default`` (no error for a missing key)."""
    got = F.when(F.map_contains_key(m, key), F.element_at(m, key))
    return got if default is None else got.otherwise(default)
