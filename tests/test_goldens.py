"""Goldens derived from the reference's published tables (FIXTURES.md §4-5)."""

import math

import pytest

from flowsentry.functions.ranks import approximate_mode, split_quota
from flowsentry.operators.detectors.autoencoder import early_stop_epochs
from flowsentry.operators.sampling import split_sizes, subsample_quotas

# fixed values: confusion counts (tp, fp, fn, tn) and the published
# precision, recall, F1, balanced accuracy on the original test set
GOLDEN = [
    ("Isolation Forest", 7436, 9654, 9261, 58486,
     0.43510825043885315, 0.44534946397556446, 0.44016929588303194, 0.6518352837928894),
    ("One-Class SVM", 6444, 10550, 10253, 57590,
     0.37919265623161114, 0.385937593579685, 0.3825353952094031, 0.6155546494461384),
    ("Local Outlier Factor", 11150, 14091, 5547, 54049,
     0.4417416108712016, 0.667784631969815, 0.531737326529639, 0.7304948989024302),
    ("Autoencoder", 9144, 8083, 7553, 60057,
     0.5307946827654264, 0.5476432892136311, 0.5390873717721967, 0.7145099334239567),
    ("Second Autoencoder", 13044, 4086, 3653, 64054,
     0.7614711033274956, 0.7812181829071091, 0.7712182576048718, 0.8606267022548459),
    ("Ensemble Autoencoder", 16213, 12123, 484, 56017,
     0.5721696781479391, 0.9710127567826555, 0.7200497413008239, 0.8965498183678466),
]


def test_metrics_from_golden_counts(spark):
    from flowsentry.operators.metrics import with_rates
    df = spark.createDataFrame([(m, tp, fp, fn, tn) for m, tp, fp, fn, tn, *_ in GOLDEN],
                               "model string, tp long, fp long, fn long, tn long")
    got = {r["model"]: r for r in with_rates(df).collect()}
    for m, *_, p, r, f1, bal in GOLDEN:
        assert got[m]["precision"] == pytest.approx(p, abs=1e-15)
        assert got[m]["recall"] == pytest.approx(r, abs=1e-15)
        assert got[m]["f1"] == pytest.approx(f1, abs=1e-15)
        assert got[m]["balanced_accuracy"] == pytest.approx(bal, abs=1e-15)


def test_ensemble_laws_on_golden_counts():
    ae, ae2, ens = GOLDEN[3], GOLDEN[4], GOLDEN[5]
    assert max(ae[1], ae2[1]) <= ens[1] <= ae[1] + ae2[1]
    assert max(ae[2], ae2[2]) <= ens[2] <= ae[2] + ae2[2]


def test_split_sizes_565576():
    # 565,576 sampled rows -> 395,902 / 84,837 / 84,837
    for anomalies in range(111_310, 111_316):
        counts = {0: 565_576 - anomalies, 1: anomalies}
        test_q, val_q = split_sizes(counts)
        assert sum(test_q.values()) == 84_837
        assert sum(val_q.values()) == 84_837
        assert 565_576 - 2 * 84_837 == 395_902
        assert test_q == {0: 68_140, 1: 16_697}


def test_subsample_15k_at_published_prior():
    # int(15000 * 0.1968) anomalies
    n = 100_000
    counts = {1: 19_680, 0: n - 19_680}
    q = subsample_quotas(counts, 15_000)
    assert q == {1: 2952, 0: 12048}


def test_approximate_mode_sums_and_ties():
    q = approximate_mode({"a": 1, "b": 1, "c": 1}, 2)
    assert q == {"a": 1, "b": 1, "c": 0}          # equal remainders: class order
    q = split_quota({"x": 10, "y": 10}, 0.15)      # ceil(3.0000000000000004) = 4
    assert sum(q.values()) == math.ceil(0.15 * 20)


def test_early_stopping_rule():
    # best at epoch 20, then five epochs without improvement -> stop at 25
    vals = [1.0 - 0.01 * e for e in range(1, 21)] + [0.9] * 10
    assert early_stop_epochs(vals) == (25, 20)
    # improvements smaller than min_delta do not count
    plateau = [1.0, 0.9] + [0.9 - 1e-7 * i for i in range(1, 10)]
    assert early_stop_epochs(plateau) == (7, 2)


@pytest.mark.parametrize("mean_range,std_range,ok", [(0.004956, 0.034097, False), (0.001, 0.002, True)])
def test_fold_scaling_verdict(spark, mean_range, std_range, ok):
    from flowsentry.operators.features import fold_scaling_verdict
    rows = [(1, 0.0, 1.0, 0.1, 1.0), (2, mean_range, 1.0 + std_range, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "fold int, global_mean_of_means double, "
                                     "global_mean_of_stds double, max_abs_mean double, max_abs_std double")
    assert fold_scaling_verdict(df).first()["negligible"] is ok
