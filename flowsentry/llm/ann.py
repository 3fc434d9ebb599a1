"""Nearest neighbours by a block matrix join.

Candidates are dealt into blocks by a hash of a row number written beforehand,
queries by one of id and vector: rows that repeat an id, or whole rows, go to
different blocks like any others. Every cell (query block x
candidate block) multiplies int8 tiles; the quantisation residuals bound the
error of each product, so a candidate whose upper bound is below the k-th
largest lower bound cannot be among the k nearest. The pairs that survive are
recomputed in double precision on the original vectors and merged by heaps,
first over the tiles of a cell, then over the cells of a query. The result is
exact (recall 1), whatever the data.

A stated query set meets all rows block by block: each candidate is sent to
the query blocks and each query to the candidate blocks, never to single
rows. A cell's memory is bounded by the two block sizes.

Defined results: vectors that are null, empty, all zero, or hold null, NaN or
infinite components take no part, nor do rows without an id; only vectors of
equal length meet; rows with the query's own id are no candidates; ties go to
the smaller id; rows that repeat an id are candidates each, and a repeated query counts once.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowsentry.llm.common import materialise

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
TILE = 512


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, vec as array<double>."""
    vec = F.col("vec")
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("id"),
                      F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & ok)
            .where(F.exists("vec", lambda x: x != 0.0)))


def _quantise(x: np.ndarray):
    """int8 codes (as float32 for BLAS), scales, norms of code and residual."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(np.float64).tiny
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    approx = codes * scale[:, None]
    return (codes.astype(np.float32 if x.shape[1] <= 1000 else np.float64), scale,
            np.linalg.norm(approx, axis=1), np.linalg.norm(x - approx, axis=1),
            np.linalg.norm(x, axis=1))


def _cell(q_ids, q, c_ids, c, k):
    """The k nearest candidates of every query of a cell, as (row, id, score)."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    codes_c, scale_c, _, resid_c, norm_c = _quantise(c)
    out = []
    for lo in range(0, len(q), TILE):
        x = q[lo:lo + TILE]
        codes_q, scale_q, norm_q, resid_q, _ = _quantise(x)
        heaps = [[] for _ in range(len(x))]  # of (score, -id): the worst first
        floor = np.full(len(x), -np.inf)     # nothing below it can enter the heap
        for at in range(0, len(c), 4 * TILE):
            s = slice(at, at + 4 * TILE)
            mid = (codes_q @ codes_c[s].T).astype(np.float64) * scale_q[:, None] * scale_c[s]
            err = norm_q[:, None] * resid_c[s] + resid_q[:, None] * norm_c[s]
            err += 1e-9 * (1e-30 + np.abs(mid) + err)
            own = c_ids[s][None, :] == q_ids[lo:lo + TILE, None]
            low = np.where(own, -np.inf, mid - err)
            if low.shape[1] > k:
                floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
            for r, cand in zip(*_by_row((mid + err >= floor[:, None]) & ~own), strict=True):
                # summed component by component: the order of the plain definition
                exact = np.cumsum(c[at + cand] * x[r], axis=1)[:, -1]
                heap = heaps[r]
                for score, i in zip(exact.tolist(), c_ids[at + cand].tolist(), strict=True):
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -i))
                    elif (score, -i) > heap[0]:
                        heapq.heapreplace(heap, (score, -i))
                if len(heap) == k:
                    floor[r] = max(floor[r], heap[0][0])
        out.extend((lo + r, -i, score) for r, heap in enumerate(heaps) for score, i in heap)
    return out


def _by_row(mask):
    rows, cols = np.nonzero(mask)
    at = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[at].tolist(), np.split(cols, at[1:]) if len(at) else []


def deal(df: DataFrame, key: list[str], own: str, own_n: int, other: str, other_n: int) -> DataFrame:
    """Each row in its block ``own``, by the hash of ``key``, once for every block ``other``."""
    return df.select("id", "vec", F.size("vec").alias("dim"),
                     F.pmod(F.xxhash64(*key), F.lit(own_n)).alias(own),
                     F.explode(F.expr(f"sequence(0L, {other_n - 1}L)")).alias(other))


def numbered(vectors: DataFrame) -> DataFrame:
    """Written with ``row``, a number of its own for every row."""
    return materialise(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id",
            vec_col: str = "embedding", k: int = 20, query_block: int = QUERY_BLOCK,
            candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products."""
    cand = numbered(valid_vectors(vectors, id_col, vec_col))
    query = valid_vectors(queries, id_col, vec_col).dropDuplicates(["id", "vec"])
    n_cols = max(1, -(-cand.count() // candidate_block))
    n_rows = max(1, -(-query.count() // query_block))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            found = _cell(q["id"].to_numpy(), np.stack(q["vec"].to_numpy()),
                          c["id"].to_numpy(), np.stack(c["vec"].to_numpy()), k)
        ids = q["id"].to_numpy()
        return pd.DataFrame({"query_id": [int(ids[r]) for r, _, _ in found],
                             "vec_id": [i for _, i, _ in found],
                             "score": [s for _, _, s in found]})

    keys = ["dim", "r", "c"]
    parts = (deal(query, ["id", "vec"], "r", n_rows, "c", n_cols).groupBy(*keys)
             .cogroup(deal(cand, ["row"], "c", n_cols, "r", n_rows).groupBy(*keys))
             .applyInPandas(cell, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
