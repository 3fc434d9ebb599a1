"""Flow-table fixtures derived from the driver tables.

* LI -- ``lineitem`` as flows: five numeric features, six-class ``label``
  (returnflag || linestatus), ``y = 1`` iff label = 'RF'.
* EV -- ``events`` with planted dirt (+Inf, NaN, NULL) in ``rate``;
  ``y = 1`` iff event_type = 'error'.
* EM -- ``embeddings``: 64 float features ``e0..e63``; ``y = 1`` iff label in (0, 1).

Each builder has an SQL twin (DuckDB dialect) used by the oracle queries.
``row_id`` is built from integers/dates only, so hashes agree across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
EM_DIM = 64
EM_FEATURES = [f"e{i}" for i in range(EM_DIM)]


_KEPT: dict = {}


def once(spark: SparkSession, sf_dir: str, name: str, build):
    """``build()``, once per application and data folder: several queries report on the
    same fitted models."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def li_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    row_id = F.concat_ws("-", *[F.col(c).cast("string") for c in
                                ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                         F.col("l_shipdate").cast("date").cast("string"))
    label = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    return li.select(row_id.alias("row_id"), label.alias("label"),
                     F.when(label == "RF", 1).otherwise(0).alias("y"),
                     *[F.col(c) for c in LI_FEATURES])


LI_SQL = """SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
       CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
       CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS row_id,
       concat(l_returnflag, l_linestatus) AS label,
       CASE WHEN concat(l_returnflag, l_linestatus) = 'RF' THEN 1 ELSE 0 END AS y,
       l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber
FROM lineitem"""


def ev_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    rate = (F.when(eid % 97 == 0, F.lit(float("inf")))
             .when(eid % 89 == 0, F.lit(float("nan")))
             .when(eid % 83 == 0, F.lit(None).cast("double"))
             .otherwise(F.col("value")))
    return ev.select(eid.cast("string").alias("row_id"), eid, "user_id", "event_type",
                     F.col("value"), rate.alias("rate"),
                     F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"))


EV_SQL = """SELECT CAST(event_id AS VARCHAR) AS row_id, event_id, user_id, event_type, value,
       CASE WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE)
            WHEN event_id % 89 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN event_id % 83 = 0 THEN NULL ELSE value END AS rate,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y
FROM events"""


def em_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = table(spark, sf_dir, "embeddings")
    return em.select(F.col("vec_id").cast("string").alias("row_id"), "vec_id",
                     F.when(F.col("label").isin(0, 1), 1).otherwise(0).alias("y"),
                     *[F.col("embedding")[i].cast("double").alias(f"e{i}")
                       for i in range(EM_DIM)])


EM_SQL = ("SELECT CAST(vec_id AS VARCHAR) AS row_id, vec_id, "
          "CASE WHEN label IN (0, 1) THEN 1 ELSE 0 END AS y, "
          + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(EM_DIM))
          + " FROM embeddings")
