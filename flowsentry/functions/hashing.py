"""Deterministic hash order.

Every "random" choice in the pipeline (samples, splits, folds, landmarks,
tree samples) is an order on ``md5('<seed>:' || row_id)`` with ``row_id`` as the
tie-break. The same expression exists in DuckDB, so the chosen rows can be
checked against SQL, and the choice does not depend on partitioning.
``row_id`` must be built from integers, dates and strings only: the text form
of a double differs between engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_COL = "h"
BUCKET_DIGITS = 3  # first hex digits of the hash -> 4096 buckets


def hash_order(seed: int = 42, key: str = "row_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def hash_order_sql(seed: int = 42, key: str = "row_id") -> str:
    return f"md5(concat('{seed}:', {key}))"


def with_hash(df, seed: int = 42, key: str = "row_id", out: str = HASH_COL):
    return df.withColumn(out, hash_order(seed, key))


def hash_bucket(h: str = HASH_COL, digits: int = BUCKET_DIGITS) -> Column:
    return F.substring(F.col(h), 1, digits)


def hash_unit(*cols) -> Column:
    """A value in [0, 1) from xxhash64 of the given columns (JVM side)."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFF))
            .cast("double") / F.lit(float(0x800000000000)))
