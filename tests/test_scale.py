"""What grows with the table, the cluster or the grid, and what must not (findings of round 3)."""

import glob
import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import sampling as P
from flowsentry.operators.detectors import autoencoder as AE
from flowsentry.operators.detectors import iforest as IF
from flowsentry.operators.detectors import knn as K
from flowsentry.operators.detectors import lof as LOF
from flowsentry.operators.detectors import ocsvm as OC
from flowsentry.plans import tuning as TU


def rows_of(spark, n, d=3, seed=0):
    X = np.random.default_rng(seed).normal(size=(n, d)).round(3)
    cols = [f"c{j}" for j in range(d)]
    return spark.createDataFrame([(f"r{i:05d}", int(i % 7 == 0), i % 3, *map(float, x)) for i, x in enumerate(X)],
                                 "row_id string, y int, fold int, " + ", ".join(f"{c} double" for c in cols)), cols


@pytest.fixture
def collected(spark, monkeypatch):
    """Rows of every collect()."""
    kind, seen = type(spark.range(1)), []
    plain = kind.collect

    def spy(self):
        got = plain(self)
        seen.append((self.columns, len(got)))
        return got

    monkeypatch.setattr(kind, "collect", spy)
    return seen


def test_a_grid_is_one_task(spark):
    grid = TU.param_grid(spark, TU.OCSVM_GRID)
    assert grid.rdd.getNumPartitions() == 1
    assert grid.count() == 20


def test_fold_metrics_are_read_not_made_again(spark):
    df, cols = rows_of(spark, 120)
    _, fm, _ = TU.tune_lof(df, cols, grid={"n_neighbors": [3, 5]})
    assert fm.count() == 6
    assert fm.inputFiles() and all("fold-metrics" in f for f in fm.inputFiles())


def test_lof_cv_of_a_grid_equals_that_of_each_k(spark):
    """Repeated rows and one id in two folds too."""
    df, cols = rows_of(spark, 60)
    df = df.unionByName(df.where("row_id < 'r00010'")).unionByName(df.where("row_id = 'r00020'").withColumn("fold", F.lit(0)))
    plain = lambda parts: [sorted((r["k"], r["f"], r["row_id"], round(r[3] if len(r) == 4 else r[4], 9)) for r in p.collect()) for p in parts]
    together = plain(TU.lof_cv_scores(df, cols, [2, 5]))
    apart = [plain(TU.lof_cv_scores(df, cols, [k])) for k in (2, 5)]
    # the lists of 5 neighbours hold those of 2
    assert together == [sorted(a + b) for a, b in zip(*apart, strict=True)]


def test_svm_rounds_send_a_vector_a_model(spark, collected):
    df, cols = rows_of(spark, 200)
    OC.fit_ocsvm_many(df.repartition(12), cols, "rbf", "auto", (0.1, 0.2), "fold", (0, 1), landmarks=8)
    sums = [n for columns, n in collected if columns == ["model", "part", "x"]]
    assert sums and max(sums) <= 4
    f = np.random.default_rng(1).normal(size=(5, 4))
    assert len(OC._row_sums(f, np.ones(4), 0.1, np.zeros(4), 0.0, 0.5)) == len(OC.STEPS) + 3 + 2 * 4 + 4 * 5 // 2


def test_autoencoder_epochs_send_few_vectors(spark, collected):
    df, cols = rows_of(spark, 600)
    m = AE.fit_autoencoder(df.where("fold > 0"), df.where("fold = 0"), cols, max_epochs=1)
    assert len(m.history) == 1
    assert max(n for columns, n in collected if "vectors" in columns) <= AE.SHARDS // AE.GROUP // 16


def test_knn_groups_follow_the_cores(spark, monkeypatch):
    """References travel to as many parts as the cores can use, however many rows there are."""
    monkeypatch.setattr(K, "PART_ROWS", 10)
    df, cols = rows_of(spark, 3000)
    index = K.KnnIndex(df, cols)
    assert index.search(index.table, 5, exclude_self=True).count() == 15_000
    folders = glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/flowsentry/knn-query-groups-*/data")
    parts = spark.read.parquet(sorted(folders, key=os.path.getmtime)[-1]).agg(F.sum("parts")).first()[0]
    assert parts <= 2 * 4 * spark.sparkContext.defaultParallelism


def test_knn_part_holds_its_nearest_alone(monkeypatch):
    rng = np.random.default_rng(3)
    Q, R = rng.normal(size=(50, 4)), rng.normal(size=(40_000, 4))
    part = K.Part(4, 3, False)
    blobs = lambda X: [x.tobytes() for x in X]
    part.ask(pd.DataFrame({"_v": blobs(Q), "_n": np.arange(50), "_kh": np.arange(50), "bound": np.inf}))
    pivots, radii = np.zeros((1, 4)), {0: 100.0}
    for lo in range(0, len(R), 5000):
        rows = pd.DataFrame({"_v": blobs(R[lo:lo + 5000]), "_n": np.arange(lo, lo + 5000), "_kh": -1 - np.arange(lo, lo + 5000), "_cell": 0})
        part.meet(rows, pivots, radii)
        assert part.size <= part.most
    got = part.result().sort_values(["q", "rank"])
    want = np.argsort(((Q[:, None] - R[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :3]
    assert (got["o"].to_numpy().reshape(50, 3) == want).all()


def test_knn_references_travel_in_bundles(spark, monkeypatch):
    """A row a cell, not one a reference, goes to the parts; the rows are the same."""
    df, cols = rows_of(spark, 900)
    index = K.KnnIndex(df, cols)
    whole = index.search(index.table, 5, exclude_self=True)
    assert any("knn-bundles" in f for f in whole.inputFiles()) and not any("knn-rows" in f for f in whole.inputFiles())
    want, table = sorted(whole.collect()), sorted((r["_n"], r["_kh"], r["_cell"], bytes(r["_v"])) for r in index.table.collect())
    bundles = index.bundles().collect()
    assert len(bundles) < 300
    got = [(int(n), int(kh), b["_cell"], v) for b in bundles for n, kh, v in zip(
        np.frombuffer(b["_ns"], np.int64), np.frombuffer(b["_khs"], np.int64),
        [bytes(b["_v"])[i:i + 8 * len(cols)] for i in range(0, len(b["_v"]), 8 * len(cols))], strict=True)]
    assert sorted(got) == table
    monkeypatch.setattr(K, "BUNDLE_ROWS", 2)
    monkeypatch.setattr(K, "BUNDLES", 1)
    index._bundles = None
    assert sorted(index.search(index.table, 5, exclude_self=True).collect()) == want and index.bundles().count() > len(bundles)


def test_forest_walk_keeps_few_rows_at_once():
    rng = np.random.default_rng(4)
    X = rng.normal(size=(20_000, 3))
    X[7, 1] = np.nan
    nodes = [(t, *n) for t in range(60) for n in IF.build_tree(rng.normal(size=(64, 3)), ["a", "b", "c"], np.arange(3), 6, 1, t)]
    m = IF.IForestModel(["a", "b", "c"], 60, 64, IF.AUTO_OFFSET, pd.DataFrame(
        nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]))
    trees = m.arrays()
    tracemalloc.start()
    got = IF.leaf_heights(trees, X)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * got.nbytes
    by_place = {(n[0], n[1]): n for n in nodes}
    for i in (0, 7, 513, 19_999):
        for t in range(60):
            n = by_place[t, 0]
            while n[2] >= 0:
                n = by_place[t, n[4] if X[i, n[2]] <= n[3] else n[5]]
            assert got[i, t] == n[7] + IF.average_path_length([n[6]])[0]


def test_fold_scaling_reads_the_split_it_wrote(spark, tmp_path):
    from flowsentry.plans import q_core
    from flowsentry.plans.fixtures import LI_FEATURES
    spark.range(400).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(id % 7 AS INT) AS l_linenumber", "CAST(id % 50 AS DOUBLE) AS l_quantity",
        "CAST(id AS DOUBLE) AS l_extendedprice", "id % 11 / 100 AS l_discount", "id % 9 / 100 AS l_tax",
        "IF(id % 5 = 0, 'R', 'N') AS l_returnflag", "'F' AS l_linestatus", "DATE'2000-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/flowsentry/split-*"))
    got = q_core.q_fold_scaling(spark, str(tmp_path)).collect()
    new = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/flowsentry/split-*")) - before
    assert len(got) == 3 and len(new) == 1
    assert {"row_id", "split", *LI_FEATURES} <= set(spark.read.parquet(f"{new.pop()}/data").columns)


def test_pairs_are_compared_in_tiles_that_fit_a_cache():
    rng = np.random.default_rng(3)
    R = rng.normal(size=(2_048, 5)).round(1)
    Q, bound = R[:1_500], rng.uniform(0.0, 0.6, 1_500)
    bound[:3] = [np.inf, 0.0, np.nan]
    ids = np.arange(len(R)) // 2  # some rows share an id
    tracemalloc.start()
    row, ref, dist = K.within(Q, R, bound, ids[:1_500], ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6
    far = np.sqrt(((Q[:, None] - R[None]) ** 2).sum(axis=2))
    want = (far <= bound[:, None]) & (ids[:1_500, None] != ids[None])
    assert sorted(zip(row.tolist(), ref.tolist(), strict=True)) == [tuple(x) for x in np.argwhere(want).tolist()]
    assert np.allclose(dist, far[row, ref])


def broadcasts(df):
    """What is below every broadcast of the plan, as text."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    for i, x in enumerate(lines):
        if x.lstrip(" :+-*").startswith("BroadcastExchange"):
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i + 1:end]))
    return out


def test_tables_of_rows_are_not_broadcast(spark):
    """However small: what passes through the driver is of cells and groups."""
    df, cols = rows_of(spark, 300)
    df = TU.materialise(df, "rows")
    index = K.KnnIndex(df, cols)
    q = index.laid_out(df)
    found = index.search(q, 4)
    assert not [x for x in broadcasts(found) if "_v" in x]
    found = TU.materialise(found, "found").withColumnsRenamed({"q": "q_id", "o": "o_id"})
    assert not broadcasts(LOF.lof_tables(found))
    model = LOF.fit_lof(df, cols, 4)
    assert not [x for x in broadcasts(model.transform(df)) if "_key" in x or "lrd" in x or "_v" in x]


def test_an_epoch_sends_one_row(spark, collected):
    df, cols = rows_of(spark, 400)
    AE.fit_autoencoder(df.where("fold > 0"), df.where("fold = 0"), cols, max_epochs=2)
    assert {n for columns, n in collected if "vectors" in columns} == {1}


def test_volumes_are_scored_after_all_fits(spark, monkeypatch):
    """Scoring is side by side, not between the fits, whose times would hold it up."""
    df, cols = rows_of(spark, 120)
    steps, fit, side = [], TU.fit_timed, TU.concurrently
    monkeypatch.setattr(TU, "fit_timed", lambda *a: steps.append("fit") or fit(*a))
    monkeypatch.setattr(TU, "concurrently", lambda s, *jobs: steps.append(len(jobs)) or side(s, *jobs))
    one = {"LOF": {"k": 3, "contamination": 0.2}}
    got = TU.volume_sensitivity(df.where("fold > 0"), df.where("fold = 0"), cols, (("a", 40), ("b", None)), one).collect()
    assert steps == ["fit", "fit", 2] and [r["Status"] for r in got] == ["OK", "OK"]


def test_tuning_finds_neighbours_once(spark, monkeypatch):
    """The contamination sweep is over scores of the grid: no second search, the same result."""
    df, cols = rows_of(spark, 150)
    df = TU.materialise(P.kfold_assign(df.drop("fold"), 2), "folds")
    searches, sweeps, join, side, sweep = [], [], TU.knn_join, TU.concurrently, TU.lof_threshold_sweep
    monkeypatch.setattr(TU, "knn_join", lambda *a, **b: searches.append(1) or join(*a, **b))
    monkeypatch.setattr(TU, "lof_threshold_sweep", lambda *a, **b: sweeps.append(TU.materialise(sweep(*a, **b), "sweep")) or sweeps[-1])
    # of the three tuners only that of LOF
    monkeypatch.setattr(TU, "concurrently", lambda s, *jobs: [{}, {}, jobs[2]()] if len(jobs) == 3 else side(s, *jobs))
    got = TU.tuned_params(df, cols, 2, lof_grid={"n_neighbors": [3, 6]})["LOF"]
    assert len(searches) == 2  # a fold block each
    alone = sorted(sweep(df, cols, got["k"], 2).collect())
    assert got["k"] in (3, 6) and len(alone) == 5 and sorted(sweeps[0].collect()) == alone
