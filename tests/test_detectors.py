"""Detector semantics: hand-checked trees, brute-force LOF, gradients, planted outliers."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import metrics as M
from flowsentry.operators.detectors import autoencoder as AE
from flowsentry.operators.detectors import iforest as IF
from flowsentry.operators.detectors import knn as K
from flowsentry.operators.detectors import lof as LOF
from flowsentry.operators.detectors import ocsvm as OC


def planted(spark, n=1200, d=8, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 1, size=(n // 2, d))
    b = rng.normal(4, 1, size=(n // 2, d))
    out = rng.uniform(-12, 16, size=(n // 20, d))
    X = np.vstack([a, b, out])
    y = np.r_[np.zeros(n), np.ones(len(out))].astype(int)
    cols = [f"f{i}" for i in range(d)]
    rows = [(f"r{i:05d}", int(y[i]), *map(float, X[i])) for i in range(len(X))]
    return spark.createDataFrame(rows, ["row_id", "y", *cols]), cols


def auc_of(scored):
    return M.auc(scored.withColumn("model", F.lit("m"))).first()["auc"]


def test_average_path_length():
    c = IF.average_path_length([0, 1, 2, 256])
    assert c[0] == 0 and c[1] == 0 and c[2] == 1
    assert c[3] == pytest.approx(2 * (np.log(255) + 0.5772156649015329) - 2 * 255 / 256)


def test_iforest_hand_tree(spark):
    # root splits feature 0 at 0.5: left leaf of size 1 (depth 1), right leaf size 255
    nodes = [(0, 0, 0, 0.5, 1, 2, 256, 0), (0, 1, -1, 0.0, -1, -1, 1, 1),
             (0, 2, -1, 0.0, -1, -1, 255, 1)]
    import pandas as pd
    nd = pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    m = IF.IForestModel(["x"], 1, 256, IF.AUTO_OFFSET, nd)
    df = spark.createDataFrame([("a", 0, 0.0), ("b", 0, 1.0)], "row_id string, y int, x double")
    got = {r["row_id"]: r["score_samples"] for r in m.transform(df).collect()}
    c256 = IF.average_path_length([256])[0]
    assert got["a"] == pytest.approx(-2 ** (-1.0 / c256))
    assert got["b"] == pytest.approx(-2 ** (-(1.0 + IF.average_path_length([255])[0]) / c256))


def test_iforest_planted_and_contamination(spark):
    df, cols = planted(spark)
    m = IF.fit_iforest(df, cols, n_trees=50, contamination=0.1)
    s = m.transform(df)
    assert auc_of(s) > 0.9
    share = s.agg(F.avg("pred")).first()[0]
    assert abs(share - 0.1) < 0.01


@pytest.mark.parametrize("part_rows,bundle_rows,offset", [(2048, 100_000, 1e8), (100, 200, 0.0), (25, 60, 0.0)])
def test_knn_exact_with_ties(spark, monkeypatch, part_rows, bundle_rows, offset):
    monkeypatch.setattr(K, "PART_ROWS", part_rows)
    monkeypatch.setattr(K, "BUNDLE_ROWS", bundle_rows)
    rng = np.random.default_rng(5)
    X = np.vstack([np.repeat(rng.integers(0, 4, size=(20, 3)), 15, axis=0), rng.normal(size=(100, 3)).round(2)]) + offset
    ids = [f"r{i:04d}" for i in rng.permutation(len(X))]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in zip(ids, X, strict=True)], "row_id string, a double, b double, c double")
    got = {}
    for r in K.knn_join(df, df, ["a", "b", "c"], 7, exclude_self=True).collect():
        got.setdefault(r.q_id, {})[r["rank"]] = (r.o_id, r.dist)
    for i, x in zip(ids, X, strict=True):
        d = np.sqrt(((X - x) ** 2).sum(axis=1))
        want = sorted((round(dist, 9), o) for dist, o in zip(d, ids, strict=True) if o != i)[:7]
        assert [got[i][k][0] for k in range(1, 8)] == [o for _, o in want]
        assert np.allclose([got[i][k][1] for k in range(1, 8)], [w for w, _ in want], atol=1e-6)


def test_knn_meets_few_of_all_pairs(spark, monkeypatch):
    """Clustered rows: cells out of reach are not sent."""
    monkeypatch.setattr(K, "PART_ROWS", 100)
    rng = np.random.default_rng(2)
    X = rng.normal(size=(40, 3))[rng.integers(0, 40, 4000)] * 20 + rng.normal(size=(4000, 3))
    df = spark.createDataFrame([(f"r{i:05d}", *map(float, x)) for i, x in enumerate(X)], "row_id string, a double, b double, c double")
    index = K.KnnIndex(df, ["a", "b", "c"])
    assert len(index.cells.pivots) == 190
    assert index.search(index.table, 10, exclude_self=True).count() == 40_000
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/flowsentry/knn"
    newest = lambda name: spark.read.parquet(sorted(glob.glob(f"{folder}-{name}-*/data"), key=os.path.getmtime)[-1])
    queries = {r.grp: r["count"] for r in newest("bounds").groupBy("grp").count().collect()}
    assert sum(r.n * queries[r.grp] for r in newest("plan").collect()) < 0.25 * 4000 ** 2


def test_knn_small_sides(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "row_id string, x double")
    assert K.knn_join(df, df.limit(0), ["x"], 3).count() == 0
    assert K.knn_join(df.limit(0), df, ["x"], 3).count() == 0
    assert K.knn_join(df, df, ["x"], 3, exclude_self=True).count() == 2


def test_lof_line_by_hand(spark):
    # ten points on a line and one far point, k = 3
    xs = [float(i) for i in range(10)] + [30.0]
    df = spark.createDataFrame([(f"p{i:02d}", 0, x) for i, x in enumerate(xs)], "row_id string, y int, x double")
    m = LOF.fit_lof(df, ["x"], k=3, contamination="auto")
    X = np.array(xs)[:, None]
    D = np.abs(X - X.T)
    np.fill_diagonal(D, np.inf)
    nn = np.argsort(D, axis=1, kind="stable")[:, :3]
    kd = np.take_along_axis(D, nn, 1)[:, -1]
    lrd = 1 / (np.maximum(kd[nn], np.take_along_axis(D, nn, 1)).mean(1) + 1e-10)
    lof = lrd[nn].mean(1) / lrd
    got = {r["row_id"]: r["lof"] for r in m.table.collect()}
    for i in range(len(xs)):
        assert got[f"p{i:02d}"] == pytest.approx(lof[i], rel=1e-9)
    assert max(got, key=got.get) == "p10"


def test_lof_planted(spark):
    df, cols = planted(spark)
    m = LOF.fit_lof(df.where("y = 0"), cols, k=20, contamination=0.1)
    assert auc_of(m.transform(df)) > 0.9


def test_autoencoder_gradient():
    rng = np.random.default_rng(3)
    X = rng.normal(size=(7, 5))
    th = AE.init_params(5, 1)
    _, g = AE.loss_and_grad(th, X)
    eps = 1e-6
    for i in rng.choice(len(th), 25, replace=False):
        e = np.zeros_like(th)
        e[i] = eps
        num = (AE.loss_and_grad(th + e, X)[0] - AE.loss_and_grad(th - e, X)[0]) / (2 * eps)
        assert g[i] == pytest.approx(num, abs=1e-8)


def test_autoencoder_planted(spark):
    df, cols = planted(spark, n=800)
    from flowsentry.operators import sampling as P
    z = P.stratified_split(df)
    m = AE.fit_autoencoder(z.where("split = 'train' AND y = 0"), z.where("split = 'val' AND y = 0"),
                           cols, max_epochs=15)
    assert len(m.history) >= 1
    s = m.reconstruction_error(df).withColumn("score", F.col("mse")).withColumn("pred", F.lit(0))
    assert auc_of(s) > 0.9


def test_ocsvm_nu_share_and_planted(spark):
    df, cols = planted(spark, n=800)
    m = OC.fit_ocsvm(df, cols, "rbf", "scale", nu=0.2, landmarks=64)
    s = m.transform(df)
    share = s.agg(F.avg("pred")).first()[0]
    assert abs(share - 0.2) < 0.01
    assert auc_of(s) > 0.9


def test_ensemble_or_and_minmax(spark):
    from flowsentry.operators.ensemble import ensemble
    df = spark.createDataFrame([("a", 1.0, 0, 5.0, 1), ("b", 3.0, 1, 1.0, 0), ("c", 2.0, 0, 3.0, 0)],
                               "row_id string, s1 double, p1 int, s2 double, p2 int")
    got = {r["row_id"]: (r["pred"], r["score"]) for r in ensemble(df, ("s1", "p1"), ("s2", "p2")).collect()}
    assert got["a"][0] == 1 and got["b"][0] == 1 and got["c"][0] == 0
    assert got["c"][1] == pytest.approx(0.5 / (1 + 1e-8 / 2) + 0.5 / (1 + 1e-8 / 4), rel=1e-6)


def test_autoencoder_same_on_any_layout(spark):
    df, cols = planted(spark, n=300)
    from flowsentry.operators import sampling as P
    z = P.stratified_split(df)
    tr, va = z.where("split = 'train' AND y = 0"), z.where("split = 'val' AND y = 0")
    runs = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(AE.fit_autoencoder(tr.repartition(n), va.repartition(n), cols, max_epochs=3, shards=13, group=2).history)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert runs[0] == runs[1] == runs[2]


def test_autoencoder_groups_of_shards_stay_together(spark):
    df, cols = planted(spark, n=300)
    laid = AE.sharded(df.where("y = 0"), df.where("y = 1"), cols, 13, 2).persist()
    rows = laid.select(F.spark_partition_id().alias("p"), "shard", "role", F.length("x").alias("n")).collect()
    laid.unpersist()
    assert sum(r.n for r in rows) == df.count() * len(cols) * 8
    assert {r.p for r in rows} == set(range(7))  # every task has work
    for p in range(7):
        own = [(r.shard, r.role) for r in rows if r.p == p]
        assert own == sorted(own) and {s // 2 for s, _ in own} == {p}


def test_autoencoder_validation_belongs_to_its_epoch(spark):
    """An epoch's validation loss is that of the weights after it, and the best weights are kept."""
    df, cols = planted(spark, n=200)
    tr, va = df.where("y = 0"), df.where("y = 1")
    m = AE.fit_autoencoder(tr, va, cols, max_epochs=4, shards=4, min_delta=-1.0)  # every epoch is the best
    X = va.select(*cols).toPandas().to_numpy(float)
    assert m.best_epoch == 4 and len(m.history) == 4
    assert m.history[-1][2] == pytest.approx(AE.row_mse(m.theta, X).mean())


def test_early_stops_of_many_histories(spark):
    rows = [(s, e, v) for s, vs in {"a": [3.0, 2.0, 2.0, 2.0, 1.0], "b": [1.0, 0.5, 0.4], "c": [float("nan")] * 4}.items()
            for e, v in enumerate(vs, 1)]
    df = spark.createDataFrame(rows, "name string, epoch int, loss double").repartition(3)
    got = {r.name: (r.stop_epoch, r.best_epoch) for r in AE.early_stops(df, "name", "epoch", "loss", 2).collect()}
    assert got == {"a": (4, 2), "b": (3, 3), "c": (2, 0)}


def test_autoencoder_minibatches_and_empty():
    got = list(AE._minibatches((np.arange(n, dtype=float)[:, None] for n in (0, 5, 1, 9)), 4))
    assert [len(x) for x in got] == [4, 4, 4, 3]
    assert np.concatenate(got)[:, 0].tolist() == [*range(5), 0.0, *range(9)]
    th = AE.init_params(1)
    assert AE.adam_steps(th, th * 0, th * 0, 0, iter([]))[4:] == (0, 0.0)


def test_iforest_needs_rows(spark):
    with pytest.raises(ValueError):
        IF.fit_iforest(spark.createDataFrame([], "row_id string, x double"), ["x"])


def test_ocsvm_objective_nears_the_exact_optimum(spark):
    """The solution on all rows as landmarks against the dual, solved by projected steps."""
    df, cols = planted(spark, n=120, d=3)
    nu, gamma = 0.2, 1 / 3
    pdf = df.orderBy("row_id").toPandas()
    X = pdf[cols].to_numpy(float)
    n = len(X)
    K_ = OC.kernel(X, X, "rbf", gamma)
    a = np.full(n, 1 / n)
    top = 1 / (nu * n)
    step = 1 / np.linalg.eigvalsh(K_).max()
    for _ in range(4000):  # projection on {0 <= a <= top, sum a = 1} by bisection
        z = a - step * (K_ @ a)
        lo, hi = z.min() - 1, z.max() + 1
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(z - mid, 0, top).sum() > 1 else (lo, mid)
        a = np.clip(z - lo, 0, top)
    exact = -0.5 * a @ K_ @ a
    gaps = []
    for m in (8, 128):
        model = OC.fit_ocsvm(df, cols, "rbf", gamma, nu, landmarks=m)
        phi = OC.kernel(X, model.L, "rbf", gamma) @ model.P
        gaps.append(OC.objective(model.w, model.rho, phi, nu) - exact)
    assert gaps[1] > -1e-6 and gaps[1] < 0.01 * abs(exact)


def test_ocsvm_folds_do_not_leak(spark):
    df, cols = planted(spark, n=200, d=3)
    folded = df.withColumn("fold", F.pmod(F.crc32("row_id"), F.lit(2)).cast("int"))
    both = OC.fit_ocsvm_many(folded, cols, "rbf", "scale", (0.2,), "fold", (0, 1), landmarks=32)
    alone = OC.fit_ocsvm(folded.where("fold != 0"), cols, "rbf", "scale", 0.2, landmarks=32)
    assert both[0.2, 0].gamma == pytest.approx(alone.gamma) and np.allclose(both[0.2, 0].L, alone.L)
    assert np.allclose(both[0.2, 0].w, alone.w) and both[0.2, 0].rho == pytest.approx(alone.rho)
