"""Headline timings of the pipeline stages on the LI flow table.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each stage is materialised with a ``noop`` write or a small collect, so the
time is the full job, not plan building.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from flowsentry.operators import cleaning as C  # noqa: E402
from flowsentry.operators import metrics as M  # noqa: E402
from flowsentry.operators import sampling as P  # noqa: E402
from flowsentry.operators.detectors import autoencoder as AE  # noqa: E402
from flowsentry.operators.detectors import iforest as IF  # noqa: E402
from flowsentry.operators.detectors import lof as LOF  # noqa: E402
from flowsentry.operators.detectors import ocsvm as OC  # noqa: E402
from flowsentry.plans.experiment import preprocess  # noqa: E402
from flowsentry.plans.fixtures import LI_FEATURES, li_flows  # noqa: E402
from flowsentry.session import get_spark  # noqa: E402


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    li = li_flows(spark, sf_dir)
    timed("clean", lambda: noop(C.clean(li)))
    timed("stratified_sample", lambda: noop(P.stratified_sample(li, "label", 0.2)))

    def prep():
        z, _ = preprocess(li, LI_FEATURES, partitions=cpus)
        z = z.cache()
        noop(z)
        return z
    z = timed("split_scale", prep)
    train, test = z.where("split = 'train'"), z.where("split = 'test'")
    timed("kfold_assign", lambda: noop(P.kfold_assign(train, 3)))

    forest = timed("iforest_fit", lambda: IF.fit_iforest(train, LI_FEATURES, 100, max_features=0.75,
                                                          contamination=0.2))
    test_b = P.balanced_flag(test).cache()
    noop(test_b)

    def score_forest():
        scored = forest.transform(test_b, ("row_id", "y", "in_balanced")).cache()
        noop(scored)
        return scored
    scored = timed("iforest_score", score_forest)
    timed("evaluate", lambda: M.evaluate(M.scenario_rows(scored.withColumn("model", F.lit("IF"))),
                                         ["model", "scenario"]).collect())

    ref = P.class_subsample(train, 15_000).cache()
    sub = P.stratified_subsample(train, 15_000).cache()
    noop(ref), noop(sub)
    lof = timed("lof_fit", lambda: LOF.fit_lof(ref, LI_FEATURES, 60, 0.25))
    timed("lof_score", lambda: noop(lof.transform(test)))
    svm = timed("ocsvm_fit", lambda: OC.fit_ocsvm(sub, LI_FEATURES, "rbf", "auto", 0.25))
    timed("ocsvm_score", lambda: noop(svm.transform(test)))
    ae = timed("autoencoder_fit", lambda: AE.fit_autoencoder(
        train.where("y = 0"), z.where("split = 'val' AND y = 0"), LI_FEATURES))
    timed("autoencoder_score", lambda: noop(ae.reconstruction_error(test)))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "pipeline_total", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
