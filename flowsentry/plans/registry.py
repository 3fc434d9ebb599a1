"""Registered queries (Spark) and their SQL twins (DuckDB) per operator.

Every query reads the driver tables through the fixtures in
``plans.fixtures`` and runs over the whole table. Keys follow SURVEY §7.4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowsentry.operators import sampling as P
from flowsentry.plans import sqlgen as G
from flowsentry.plans.fixtures import LI_SQL, li_flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _h(key: str = "row_id", seed: int = 42) -> str:
    return f"md5(concat('{seed}:', {key}))"


# ----------------------------------------------------------------- P1-P9

@query("stratified_sample", f"""WITH li AS ({LI_SQL}),
cnt AS (SELECT label, count(*) AS n FROM li GROUP BY label),
{G.split_quota_ctes('cnt', 'label', 0.2, 'quota')},
r AS (SELECT row_id, label, y, row_number() OVER (PARTITION BY label
      ORDER BY {_h()}, row_id) AS rn FROM li)
SELECT row_id, label, y FROM r JOIN quota USING (label) WHERE rn <= q""")
def q_stratified_sample(spark, sf_dir):
    return P.stratified_sample(li_flows(spark, sf_dir), "label", 0.2).select("row_id", "label", "y")


@query("random_sample", f"""WITH li AS ({LI_SQL}),
r AS (SELECT row_id, y, row_number() OVER (ORDER BY {_h()}, row_id) AS rn FROM li)
SELECT row_id, y FROM r WHERE rn <= 5000""")
def q_random_sample(spark, sf_dir):
    return P.random_rows(li_flows(spark, sf_dir), 5000).select("row_id", "y")


@query("stratified_split", f"""WITH li AS ({LI_SQL}),
{G.split_ctes('li')}
SELECT row_id, y, split FROM splitted""")
def q_stratified_split(spark, sf_dir):
    return P.stratified_split(li_flows(spark, sf_dir)).select("row_id", "y", "split")


@query("stratified_subsample", f"""WITH li AS ({LI_SQL}),
c AS (SELECT count(*) AS total, sum(y) AS a FROM li),
q AS (SELECT CAST(floor(15000 * (CAST(a AS DOUBLE) / total)) AS BIGINT) AS n_anom, total, a FROM c),
quota AS (SELECT 1 AS y, least(n_anom, a) AS q FROM q
          UNION ALL SELECT 0 AS y, least(15000 - n_anom, total - a) AS q FROM q),
r AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {_h()}, row_id) AS rn FROM li)
SELECT row_id, y FROM r JOIN quota USING (y) WHERE rn <= q""")
def q_stratified_subsample(spark, sf_dir):
    return P.stratified_subsample(li_flows(spark, sf_dir), 15000).select("row_id", "y")


@query("class_subsample", f"""WITH li AS ({LI_SQL}),
r AS (SELECT row_id, y, row_number() OVER (ORDER BY {_h()}, row_id) AS rn FROM li WHERE y = 0)
SELECT row_id, y FROM r WHERE rn <= 15000""")
def q_class_subsample(spark, sf_dir):
    return P.class_subsample(li_flows(spark, sf_dir), 15000).select("row_id", "y")


@query("balanced_subset", f"""WITH li AS ({LI_SQL}),
{G.balanced_ctes('li')}
SELECT row_id, y FROM bal WHERE in_balanced = 1""")
def q_balanced_subset(spark, sf_dir):
    return P.balanced_subset(li_flows(spark, sf_dir)).select("row_id", "y")


@query("kfold_assign", f"""WITH li AS ({LI_SQL}),
{G.kfold_ctes('li', 3)}
SELECT row_id, y, fold FROM folded""")
def q_kfold_assign(spark, sf_dir):
    return P.kfold_assign(li_flows(spark, sf_dir), 3).select("row_id", "y", "fold")


@query("hash_sorted", f"""WITH li AS ({LI_SQL}) SELECT row_id, y FROM li""")
def q_hash_sorted(spark, sf_dir):
    """The rows in their shuffled (hash) order."""
    return P.hash_sorted(li_flows(spark, sf_dir)).select("row_id", "y")


# the remaining query modules register themselves on import
from flowsentry.plans import q_core  # noqa: E402,F401
from flowsentry.plans import q_metrics  # noqa: E402,F401
from flowsentry.plans import q_detectors  # noqa: E402,F401
from flowsentry.plans import q_tuning  # noqa: E402,F401
