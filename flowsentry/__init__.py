"""flowsentry: tabular anomaly detection as Spark DataFrame jobs.

Layout
------
* ``sources``    -- CSV/Parquet scans, split sinks, result tables, upsert.
* ``functions``  -- column helpers: hash order, bucketed ranks, exact
                    quantiles, zero-safe division, rounding.
* ``operators``  -- cleaning, feature selection, sampling/splitting,
                    statistics, profiling, metrics, detectors, ensemble.
* ``plans``      -- fixtures over the driver tables, tuning, experiments and
                    the query registry used by ``__spark_entry__``.
* ``streaming``  -- intentionally empty (the pipeline is batch-only).
"""

from flowsentry.session import get_spark, shared_dir  # noqa: F401

__all__ = ["get_spark", "shared_dir"]
