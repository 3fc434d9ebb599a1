"""Ensemble of two detectors on the same rows.

Both detectors add columns to the same row, so combining them is a
projection, not a positional join. Score ranges are one global aggregate,
broadcast as a one-row constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensemble(df: DataFrame, a: tuple[str, str], b: tuple[str, str], eps: float = 1e-8,
             score_out: str = "score", pred_out: str = "pred") -> DataFrame:
    """pred = pred_a OR pred_b; score = minmax(score_a) + minmax(score_b).

    ``a`` and ``b`` are (score column, pred column) pairs.
    """
    (sa, pa), (sb, pb) = a, b
    mm = df.agg(F.min(sa).alias("_mna"), F.max(sa).alias("_mxa"),
                F.min(sb).alias("_mnb"), F.max(sb).alias("_mxb"))
    na = (F.col(sa) - F.col("_mna")) / (F.col("_mxa") - F.col("_mna") + F.lit(eps))
    nb = (F.col(sb) - F.col("_mnb")) / (F.col("_mxb") - F.col("_mnb") + F.lit(eps))
    return (df.crossJoin(F.broadcast(mm))
              .withColumn(pred_out, F.greatest(F.col(pa), F.col(pb)).cast("int"))
              .withColumn(score_out, na + nb)
              .drop("_mna", "_mxa", "_mnb", "_mxb"))
