"""Sampling and splitting (P1-P9) on the deterministic hash order.

Sizes and per-class allocations follow the reference's rules exactly;
the generator is replaced by ``md5('<seed>:' || row_id)`` order, so every
operator picks the same rows on any partitioning and in SQL.

Only class counts reach the driver (one row per class). Rows are never
collected: selection is a broadcast lookup on hash buckets plus a ranked
window over the few boundary buckets (``functions.ranks``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.hashing import HASH_COL, with_hash
from flowsentry.functions.ranks import (approximate_mode, assign_segments, bucket_counts,
                                        bucketed_rank, select_quota, split_quota, totals)


def _hashed_counts(df: DataFrame, by: str, seed: int, key: str):
    """Hash column + (class, bucket) counts; class sizes are their sums, so
    one aggregate pass serves both the quotas and the selection."""
    x = with_hash(df, seed, key)
    bc = bucket_counts(x, [by])
    return x, bc, _single(totals(bc))


def _single(counts: dict) -> dict:
    return {k[0]: v for k, v in counts.items()}


def _tuple(d: dict) -> dict:
    return {(k,): v for k, v in d.items()}


def random_fraction(df: DataFrame, frac: float, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Plain sample of round(frac * n) rows (pandas ``sample(frac=...)`` size)."""
    n = df.count()
    return random_rows(df, int(round(frac * n)), seed, key)


def random_rows(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """N rows without replacement (all rows when n >= count)."""
    x = with_hash(df, seed, key)
    return select_quota(x, [], {(): n}, key=key).drop(HASH_COL)


def stratified_sample(df: DataFrame, label: str = "label", frac: float = 0.2,
                      seed: int = 42, key: str = "row_id") -> DataFrame:
    """Stratified fraction sample of size ceil(frac * n) on ``label``.

    Falls back to P2 when stratification is impossible (a class with fewer
    than two rows, or fewer sample/remaining rows than classes).
    """
    x, bc, counts = _hashed_counts(df, label, seed, key)
    n, k = sum(counts.values()), len(counts)
    n_test = math.ceil(frac * n)
    if not counts or min(counts.values()) < 2 or n_test < k or n - n_test < k:
        return random_fraction(df, frac, seed, key)
    quotas = split_quota(counts, frac)
    return select_quota(x, [label], _tuple(quotas), key=key, counts=bc).drop(HASH_COL)


def split_sizes(counts: dict, test_size: float = 0.15, val_size: float = 0.15) -> tuple[dict, dict]:
    """Per-class test and val sizes of the two-step stratified split."""
    test_q = split_quota(counts, test_size)
    rest = {c: counts[c] - test_q[c] for c in counts}
    rel = val_size / round(1.0 - test_size, 12)
    val_q = split_quota(rest, rel)
    return test_q, val_q


def stratified_split(df: DataFrame, y: str = "y", test_size: float = 0.15,
                     val_size: float = 0.15, seed: int = 42, key: str = "row_id",
                     out: str = "split") -> DataFrame:
    """70/15/15 split; test first, then val from the rest, both stratified.

    Within each class the hash order gives test = ranks 1..t,
    val = t+1..t+v, train = the rest.
    """
    x, bc, counts = _hashed_counts(df, y, seed, key)
    test_q, val_q = split_sizes(counts, test_size, val_size)
    cuts = {(c,): [test_q[c], test_q[c] + val_q[c]] for c in counts}
    x = assign_segments(x, [y], cuts, key=key, out="_seg", counts=bc)
    name = F.when(F.col("_seg") == 0, "test").when(F.col("_seg") == 1, "val").otherwise("train")
    return x.withColumn(out, name).drop("_seg", HASH_COL)


def subsample_quotas(counts: dict, n: int) -> dict:
    """P4 allocation: n_anom = int(n * ratio), n_norm = n - n_anom, capped."""
    total = sum(counts.values())
    a = counts.get(1, 0)
    ratio = a / total if total else 0.0
    n_anom = int(n * ratio)
    n_norm = n - n_anom
    return {0: min(n_norm, counts.get(0, 0)), 1: min(n_anom, a)}


def stratified_subsample(df: DataFrame, n: int | None, y: str = "y", seed: int = 42,
                         key: str = "row_id") -> DataFrame:
    """N rows keeping the anomaly ratio; n None or >= count -> all rows."""
    x, bc, counts = _hashed_counts(df, y, seed, key)
    if n is None or n >= sum(counts.values()):
        return df
    q = subsample_quotas(counts, n)
    return select_quota(x, [y], _tuple(q), key=key, counts=bc).drop(HASH_COL)


def class_subsample(df: DataFrame, n: int, y: str = "y", cls: int = 0,
                    seed: int = 42, key: str = "row_id") -> DataFrame:
    """P5: up to n rows of one class (the reference keeps <= 15,000 normals)."""
    return random_rows(df.where(F.col(y) == cls), n, seed, key)


def balanced_flag(df: DataFrame, y: str = "y", seed: int = 42, key: str = "row_id",
                  out: str = "in_balanced", strict: bool = True) -> DataFrame:
    """P7 as a column: all anomalies plus as many hash-first normals.

    Raises when anomalies outnumber normals (the reference fails there too).
    """
    x, bc, counts = _hashed_counts(df, y, seed, key)
    a, nn = counts.get(1, 0), counts.get(0, 0)
    if strict and a > nn:
        raise ValueError(f"balanced subset impossible: {a} anomalies > {nn} normals")
    x = assign_segments(x, [y], {(0,): [a], (1,): [a]}, key=key, out="_seg", counts=bc)
    return x.withColumn(out, (F.col("_seg") == 0).cast("int")).drop("_seg", HASH_COL)


def balanced_subset(df: DataFrame, y: str = "y", seed: int = 42, key: str = "row_id") -> DataFrame:
    """The balanced 50/50 subset as rows."""
    return balanced_flag(df, y, seed, key).where(F.col("in_balanced") == 1).drop("in_balanced")


def kfold_assign(df: DataFrame, k: int = 3, y: str = "y", seed: int = 42,
                 key: str = "row_id", out: str = "fold") -> DataFrame:
    """Stratified k-fold id in 0..k-1.

    With classes sorted and laid end to end, position p goes to fold p % k
    (the reference's per-fold/per-class counts); inside a class the hash
    order replaces the shuffle: fold = (class_offset + rank - 1) % k.
    """
    x, bc, counts = _hashed_counts(df, y, seed, key)
    off, run = {}, 0
    for c in sorted(counts):
        off[c] = run
        run += counts[c]
    offset = None
    for c, o in off.items():
        offset = (F.when(F.col(y) == c, F.lit(o)) if offset is None
                  else offset.when(F.col(y) == c, F.lit(o)))
    offset = offset.otherwise(F.lit(0)) if offset is not None else F.lit(0)
    x = bucketed_rank(x, [y], key=key, out="_rank", counts=bc)
    return (x.withColumn(out, ((offset + F.col("_rank") - 1) % k).cast("int"))
             .drop("_rank", HASH_COL))


def hash_sorted(df: DataFrame, seed: int = 42, key: str = "row_id") -> DataFrame:
    """A shuffled order, only for consumers that need one."""
    return with_hash(df, seed, key).orderBy(HASH_COL, key).drop(HASH_COL)


__all__ = ["random_fraction", "random_rows", "stratified_sample", "stratified_split",
           "split_sizes", "subsample_quotas", "stratified_subsample", "class_subsample",
           "balanced_flag", "balanced_subset", "kfold_assign", "hash_sorted",
           "approximate_mode"]
