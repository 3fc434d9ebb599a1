"""Tuning and experiments.

* Grids are typed DataFrames built by ``crossJoin`` of one-column frames
  (candidate order = sorted keys, last key fastest).
* CV never refits what does not change: the LOF neighbour lists are found
  once per fold block at the largest k and every k of the grid is a
  ``rank <= k`` filter; isolation forests are grown once per
  (max_features, fold) at the largest size and smaller forests score with
  their first trees; one-class SVMs train all (nu, fold) models in shared
  passes; the contamination sweep scores each fold once and reads all
  thresholds as percentiles of those scores.
* Fold metrics are one grouped aggregate keyed by (candidate, fold).
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.functions.ranks import exact_quantiles, join_large
from flowsentry.operators import metrics as M
from flowsentry.operators import sampling as P
from flowsentry.operators.detectors import iforest as IF
from flowsentry.operators.detectors import lof as LOF
from flowsentry.operators.detectors import ocsvm as OC
from flowsentry.operators.detectors.knn import knn_join
from flowsentry.session import concurrently, materialise

# fixed values: the grids, the sweep and the result columns
IF_GRID = {"n_estimators": [50, 100, 200], "max_features": [0.5, 0.75, 1.0], "random_state": [42]}
OCSVM_GRID = {"kernel": ["rbf", "poly"], "nu": [0.05, 0.10, 0.15, 0.20, 0.25], "gamma": ["scale", "auto"]}
LOF_GRID = {"n_neighbors": [5, 10, 20, 40, 60], "novelty": [True], "n_jobs": [-1]}
CONTAMINATION_SWEEP = [0.05, 0.10, 0.15, 0.20, 0.25]
METRIC_COLS = ["mean_f1", "std_f1", "mean_recall", "std_recall", "mean_precision",
               "std_precision", "mean_auc"]


def param_grid(spark, grid: dict) -> DataFrame:
    """Candidate table; candidate_id follows the reference's iteration order."""
    keys = sorted(grid)
    frames = []
    for k in keys:
        vals = grid[k]
        if isinstance(vals[0], bool):
            t = T.BooleanType()
        elif isinstance(vals[0], int):
            t = T.IntegerType()
        elif isinstance(vals[0], float):
            t = T.DoubleType()
        else:
            t = T.StringType()
        frames.append(spark.createDataFrame([(i, v) for i, v in enumerate(vals)],
                                            T.StructType([T.StructField(f"_o_{k}", T.IntegerType()),
                                                          T.StructField(k, t)])).coalesce(1))  # a task in all, not a product of them
    g = reduce(lambda a, b: a.crossJoin(b), frames)
    w = Window.orderBy(*[f"_o_{k}" for k in keys])  # grid-sized, a handful of rows
    return g.withColumn("candidate_id", F.row_number().over(w)).drop(*[f"_o_{k}" for k in keys])


# -------------------------------------------------------------- fold metrics

def fold_metrics(scored: DataFrame, by=("candidate_id", "fold")) -> DataFrame:
    """Per (candidate, fold): F1, recall, precision and AUC (flipped below 0.5)."""
    by = list(by)
    r = M.with_rates(M.confusion(scored, by)).select(*by, "f1", "recall", "precision")
    a = M.auc(scored, by)
    a = a.withColumn("auc", F.when(F.col("auc") < 0.5, 1 - F.col("auc")).otherwise(F.col("auc")))
    return r.join(a, by, "left")


def _written_metrics(scored: DataFrame) -> DataFrame:
    """``fold_metrics``, written: a row a candidate and fold, and what reads it (means, ranks,
    pivots, quantiles) would go through the scores again each time."""
    return materialise(fold_metrics(scored), "fold-metrics")


def aggregate_folds(fm: DataFrame, by=("candidate_id",)) -> DataFrame:
    """Mean and population std over folds, NaN-ignoring mean AUC."""
    return fm.groupBy(*by).agg(
        F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"),
        F.avg("recall").alias("mean_recall"), F.stddev_pop("recall").alias("std_recall"),
        F.avg("precision").alias("mean_precision"), F.stddev_pop("precision").alias("std_precision"),
        F.avg(F.when(~F.isnan("auc"), F.col("auc"))).alias("mean_auc"))


def rank_candidates(res: DataFrame) -> DataFrame:
    """Order by mean F1 descending, candidate id breaks ties."""
    w = Window.orderBy(F.desc("mean_f1"), F.asc("candidate_id"))  # one row per candidate
    return res.withColumn("rank", F.row_number().over(w))


# -------------------------------------------------------------- LOF CV

def lof_fold_neighbours(df: DataFrame, features: list[str], k_max: int, k_folds: int,
                        fold: str = "fold", key: str = "row_id") -> DataFrame:
    """(f, q_id, o_id, dist, rank): neighbours of every row among the rows of
    all folds except f (self excluded), up to k_max, from one kNN per fold block."""
    blocks = concurrently(df.sparkSession, *(lambda g=g: knn_join(
        df, df.where(F.col(fold) == g), features, k_max, exclude_self=True, q_key=key, r_key=key).withColumn("blk", F.lit(g))
        for g in range(k_folds)))
    cand = reduce(lambda a, b: a.unionByName(b), blocks)
    # each candidate serves every target fold but its own block (k_folds - 1 copies), made after the rows have met
    per_f = cand.repartition("q_id").withColumn("f", F.explode(F.array(*[F.lit(f) for f in range(k_folds)])))
    per_f = per_f.where(F.col("blk") != F.col("f"))
    w = Window.partitionBy("f", "q_id").orderBy("dist", "o_id")
    return (per_f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k_max)
                 .select("f", "q_id", "o_id", "dist", "rank"))


def lof_cv_scores(df: DataFrame, features: list[str], ks, k_folds: int = 3,
                  fold: str = "fold", key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Scored query rows (k, f, row_id, y, score_samples) and training-row
    LOF values (k, f, row_id, lof) for every k of the grid.

    A neighbour is one row for all k: it takes part in those that its rank reaches, so that every
    step is one join and one aggregate with a column for each k."""
    ks = [int(k) for k in ks]
    each = lambda name, of: [of(k).alias(f"{name}{k}") for k in ks]
    within_k = lambda k, value: F.when(F.col("rank") <= k, value)
    nbr = lof_fold_neighbours(df, features, max(ks), k_folds, fold, key)
    role = df.select(F.col(key).alias("q_id"), F.col(fold).alias("own"), "y")
    nb = materialise(join_large(nbr, role, "q_id"), "lof-cv-neighbours")  # read three times
    kdo = (nb.where(F.col("own") != F.col("f")).groupBy("f", F.col("q_id").alias("o_id"))
             .agg(*each("kd", lambda k: F.max(within_k(k, F.col("dist"))))))
    lrd = join_large(nb, kdo, ["f", "o_id"]).groupBy("f", "q_id", "own", "y").agg(*each("lrd", lambda k: 1.0 / (
        F.avg(within_k(k, F.greatest(f"kd{k}", "dist"))) + F.lit(1e-10))))
    lrd = materialise(lrd, "lof-cv-densities")
    lrd_ref = lrd.where(F.col("own") != F.col("f")).select(
        "f", F.col("q_id").alias("o_id"), *each("lrd_o", lambda k: F.col(f"lrd{k}")))
    mean_o = join_large(nb.select("f", "q_id", "o_id", "rank"), lrd_ref, ["f", "o_id"]).groupBy("f", "q_id").agg(
        *each("mlo", lambda k: F.avg(within_k(k, F.col(f"lrd_o{k}")))))
    lofs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(f"mlo{k}") / F.col(f"lrd{k}")).alias("lof")) for k in ks)))
    full = join_large(lrd, mean_o, ["f", "q_id"]).select("f", "q_id", "own", "y", lofs.alias("_l")).select("f", "q_id", "own", "y", "_l.*")
    full = materialise(full.where(F.col("lof").isNotNull()), "lof-cv")
    queries = full.where(F.col("own") == F.col("f")).select(
        "k", "f", F.col("q_id").alias(key), "y", (-F.col("lof")).alias("score_samples"))
    train = full.where(F.col("own") != F.col("f")).select("k", "f", F.col("q_id").alias(key), "lof")
    return queries, train


def tune_lof(df: DataFrame, features: list[str], k_folds: int = 3, grid=None,
             scores: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T2+T3 for LOF on a folded table. Returns (ranked results, fold metrics, scores).
    ``scores``: what ``lof_cv_scores`` gave for the grid, if that is there already."""
    ks = (grid or LOF_GRID)["n_neighbors"]
    q, train = scores or lof_cv_scores(df, features, ks, k_folds)
    dec = F.col("score_samples") - F.lit(LOF.AUTO_OFFSET)
    scored = q.withColumn("pred", (dec < 0).cast("int")).withColumn("score", -dec)
    cand = param_grid(df.sparkSession, grid or LOF_GRID).withColumnRenamed("n_neighbors", "k")
    scored = scored.join(F.broadcast(cand.select("k", "candidate_id")), "k").withColumnRenamed("f", "fold")
    fm = _written_metrics(scored)
    res = aggregate_folds(fm).join(cand, "candidate_id").withColumnRenamed("k", "n_neighbors")
    return rank_candidates(res), fm.join(cand.select("candidate_id", "k"), "candidate_id"), train


def lof_threshold_sweep(df: DataFrame, features: list[str], k: int, k_folds: int = 3,
                        sweep=CONTAMINATION_SWEEP, scores: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """T4: (contamination, mean_f1) at a fixed k; each fold scored once, the
    offsets are percentiles of the training rows' -LOF. ``scores``: what ``lof_cv_scores``
    gave for a grid with this k, if that is there already."""
    q, train = (x.where(F.col("k") == k) for x in scores or lof_cv_scores(df, features, [k], k_folds))
    return _f1_of_sweep(q, train.select("f", (-F.col("lof")).alias("v")), sweep)


def sweep_best(sweep: DataFrame) -> DataFrame:
    """T4: highest mean F1; the first (smallest) contamination wins ties."""
    w = Window.orderBy(F.desc("mean_f1"), F.asc("contamination"))
    return sweep.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# -------------------------------------------------------------- IF / OC-SVM CV

def tune_iforest(df: DataFrame, features: list[str], k_folds: int = 3, grid=None,
                 fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """T2+T3 for the isolation forest ("auto" threshold inside CV)."""
    grid = grid or IF_GRID
    spark = df.sparkSession
    sizes = sorted(grid["n_estimators"])
    models = [(mf, f) for mf in grid["max_features"] for f in range(k_folds)]
    fitted = concurrently(spark, *(lambda mf=mf, f=f: IF.fit_iforest(
        df.where(F.col(fold) != f), features, n_trees=max(sizes), max_features=mf, contamination="auto") for mf, f in models))
    scored = IF.score_forests(df, [(i, f, m) for i, ((_, f), m) in enumerate(zip(models, fitted, strict=True))], sizes, fold)
    cand = param_grid(spark, grid)
    names = spark.createDataFrame([(i, mf, f) for i, (mf, f) in enumerate(models)], "forest int, max_features double, fold int")
    names = names.join(cand.select("candidate_id", "max_features", F.col("n_estimators").alias("trees")), "max_features")
    d = F.col("score_samples") - IF.AUTO_OFFSET
    scored = scored.join(F.broadcast(names), ["forest", "trees"]).select(  # a row a candidate and fold
        "candidate_id", "fold", "row_id", "y", (d < 0).cast("int").alias("pred"), (-d).alias("score"))
    fm = _written_metrics(materialise(scored, "forest-cv-scores"))
    return rank_candidates(aggregate_folds(fm).join(cand, "candidate_id")), fm


def _fold_forests(df, features, k_folds, fold, n_trees, max_features=1.0):
    """(forest = fold, held, row_id, y, score_samples): every fold's forest on all rows, one walk."""
    fitted = concurrently(df.sparkSession, *(lambda f=f: IF.fit_iforest(
        df.where(F.col(fold) != f), features, n_trees, max_features=max_features, contamination="auto") for f in range(k_folds)))
    return materialise(IF.score_forests(df, [(f, f, m) for f, m in enumerate(fitted)], None, fold, train=True), "fold-forest-scores")


def _f1_of_sweep(queries: DataFrame, train: DataFrame, sweep) -> DataFrame:
    """(contamination, mean_f1) from scored query rows (f, y, score_samples) and training
    values (f, v): the offsets are percentiles of the training values of the fold."""
    off = exact_quantiles(train, "v", list(sweep), by=["f"])
    off = off.select("f", F.col("p").alias("contamination"), F.col("q").alias("offset"))
    s = queries.join(F.broadcast(off), "f").withColumn(  # folds x sweep rows
        "pred", (F.col("score_samples") < F.col("offset")).cast("int"))
    r = M.with_rates(M.confusion(s, ["contamination", "f"]))
    return r.groupBy("contamination").agg(F.avg("f1").alias("mean_f1"))


def if_threshold_sweep(df: DataFrame, features: list[str], n_estimators: int = 100, max_features: float = 1.0,
                       k_folds: int = 3, sweep=CONTAMINATION_SWEEP, fold: str = "fold") -> DataFrame:
    """T4 for the isolation forest: each fold is fitted and scored once."""
    scores = _fold_forests(df, features, k_folds, fold, n_estimators, max_features).withColumnRenamed("forest", "f")
    return _f1_of_sweep(scores.where("held").select("f", "y", "score_samples"),
                        scores.where("NOT held").select("f", F.col("score_samples").alias("v")), sweep)


def tune_ocsvm(df: DataFrame, features: list[str], k_folds: int = 3, grid=None, fold: str = "fold",
               landmarks: int = 128) -> tuple[DataFrame, DataFrame]:
    """T2+T3 for the one-class SVM: per (kernel, gamma) all (nu, fold) models
    train in the same rounds."""
    grid = grid or OCSVM_GRID
    spark = df.sparkSession
    cand = param_grid(spark, grid).collect()
    kinds = [(kern, gam) for kern in grid["kernel"] for gam in grid["gamma"]]
    fitted = dict(zip(kinds, concurrently(spark, *(lambda kern=kern, gam=gam: OC.fit_ocsvm_many(
        df, features, kern, gam, tuple(grid["nu"]), fold, tuple(range(k_folds)), landmarks) for kern, gam in kinds)), strict=True))
    models = [(c["candidate_id"], f, fitted[c["kernel"], c["gamma"]][c["nu"], f]) for c in cand for f in range(k_folds)]
    fm = _written_metrics(materialise(OC.score_models(df, models, fold), "svm-cv-scores"))
    res = aggregate_folds(fm).join(param_grid(spark, grid), "candidate_id")
    return rank_candidates(res), fm


def metric_pivot(results: DataFrame, row: str, col: str, value: str = "f1") -> DataFrame:
    """F16: mean of ``value`` with ``row`` values as rows and ``col`` values as columns."""
    return results.groupBy(row).pivot(col).agg(F.avg(value))


def panel_pivot(results: DataFrame, panel: str, row: str, col: str, value: str = "mean_f1") -> DataFrame:
    """F16: one ``row`` x ``col`` matrix for each value of ``panel``, with the smallest and
    the largest value over all panels, for a shared colour scale."""
    span = results.agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))
    return results.groupBy(panel, row).pivot(col).agg(F.avg(value)).crossJoin(F.broadcast(span))  # one row


def group_mean(res: DataFrame, key: str, value: str = "mean_f1") -> DataFrame:
    """F15."""
    return res.groupBy(key).agg(F.avg(value).alias(value))


# -------------------------------------------------------------- experiments

# fixed values: the default parameters of the three classical models
BASELINE = {"Isolation Forest": {"n_estimators": 100, "contamination": 0.20, "max_features": 1.0},
            "One-Class SVM": {"kind": "rbf", "gamma": "auto", "nu": 0.20},
            "LOF": {"k": 20, "contamination": 0.20}}


def tuned_params(df: DataFrame, features: list[str], k_folds: int = 3, if_grid=None, ocsvm_grid=None,
                 lof_grid=None, fold: str = "fold") -> dict:
    """The tuners as a unit. Best structure of each grid by cross-validation, then
    the best contamination at that structure where the model has one."""
    def forest():
        res, _ = tune_iforest(df, features, k_folds, if_grid, fold)
        best = best_params(res, ["n_estimators", "max_features"])
        best["contamination"] = sweep_best(if_threshold_sweep(
            df, features, best["n_estimators"], best["max_features"], k_folds, fold=fold)).first()["contamination"]
        return best

    def svm():
        best = best_params(tune_ocsvm(df, features, k_folds, ocsvm_grid, fold)[0], ["kernel", "gamma", "nu"])
        return {"kind": best["kernel"], "gamma": best["gamma"], "nu": best["nu"]}

    def lof():
        # the sweep is over scores of the grid: its neighbours, all pairs of rows where nothing can be ruled out, are found once
        scores = lof_cv_scores(df, features, (lof_grid or LOF_GRID)["n_neighbors"], k_folds)
        k = best_params(tune_lof(df, features, k_folds, lof_grid, scores)[0], ["n_neighbors"])["n_neighbors"]
        return {"k": k, "contamination": sweep_best(lof_threshold_sweep(df, features, k, k_folds, scores=scores)).first()["contamination"]}

    return dict(zip(BASELINE, concurrently(df.sparkSession, forest, svm, lof), strict=True))


def fit_timed(name: str, params: dict, train: DataFrame, features: list[str]):
    """Fit one classical detector; returns (model, fit seconds)."""
    t0 = time.time()
    if name == "Isolation Forest":
        m = IF.fit_iforest(train, features, params["n_estimators"], max_features=params["max_features"],
                           contamination=params["contamination"])
    elif name == "One-Class SVM":
        m = OC.fit_ocsvm(train, features, params["kind"], params["gamma"], params["nu"])
    else:
        m = LOF.fit_lof(train, features, params["k"], params["contamination"])
    return m, time.time() - t0


def fit_and_score(name: str, params: dict, train: DataFrame, test: DataFrame, features: list[str]):
    """Fit one classical detector and score ``test``; returns (scored, fit seconds)."""
    m, secs = fit_timed(name, params, train, features)
    return m.transform(test, keep=("row_id", "y")), secs


def _on_test(runs: list) -> dict:
    """{name: (F1, recall, precision, AUC)} of (name, scored) pairs, from one evaluation."""
    parts = [s.select("row_id", "y", "score", "pred").withColumn("run", F.lit(name)) for name, s in runs]
    scored = materialise(reduce(lambda a, b: a.unionByName(b), parts), "scored-runs")
    return {e["run"]: (e["f1"], e["recall"], e["precision"], e["auc"]) for e in M.evaluate(scored, by=["run"]).collect()}


def baseline_vs_best(train: DataFrame, test: DataFrame, features: list[str], tuned: dict) -> DataFrame:
    """Default vs tuned parameters on the test split, one row per model, both fitted
    on the whole training sample."""
    spark = train.sparkSession
    runs = [(f"{what} {name}", name, params[name]) for what, params in (("Baseline", BASELINE), ("Tuned", tuned)) for name in BASELINE]
    scored = concurrently(spark, *(lambda name=name, p=p: fit_and_score(name, p, train, test, features)[0] for _, name, p in runs))
    got = _on_test([(run, s) for (run, _, _), s in zip(runs, scored, strict=True)])
    rows = [(name, *got[f"Baseline {name}"][:3], *got[f"Tuned {name}"][:3]) for name in BASELINE]
    cols = [f"`{w} {m}` double" for w in ("Baseline", "Tuned") for m in ("F1", "Recall", "Precision")]
    return spark.createDataFrame(rows, "Model string, " + ", ".join(cols))


# fixed values: the training volumes
SCENARIOS = (("A — 15k (tuning subsample)", 15_000), ("B — 80k (medium)", 80_000), ("C — Full", None))


def volume_sensitivity(train: DataFrame, test: DataFrame, features: list[str], scenarios=SCENARIOS,
                       params: dict | None = None) -> DataFrame:
    """Models at several training volumes with fit time; no volume is skipped. A
    fit that the data make impossible (no rows) is a row with its reason. Fits run one
    after the other, so that their times mean something; then the test rows are scored side by
    side and evaluated together."""
    params = params or BASELINE
    runs, models = [], []
    for scen, n in scenarios:
        sub = materialise(P.stratified_subsample(train, n), "volume")
        actual = sub.count()
        for name in params:
            try:
                m, secs = fit_timed(name, params[name], sub, features)
                models.append((f"{scen}/{name}", m))
                runs.append((scen, actual, name, "OK", round(secs, 2)))
            except ValueError as e:
                runs.append((scen, actual, name, f"FAILED: {e}"[:200], None))
    scored = concurrently(train.sparkSession, *(lambda m=m: m.transform(test, keep=("row_id", "y")) for _, m in models))
    got = _on_test([(run, s) for (run, _), s in zip(models, scored, strict=True)]) if models else {}
    rows = [(*r[:4], *got.get(f"{r[0]}/{r[2]}", (None,) * 4), r[4]) for r in runs]
    return train.sparkSession.createDataFrame(
        rows, "Scenario string, `Training Rows` long, Model string, Status string, F1 double, "
              "Recall double, Precision double, `AUC-ROC` double, `Train Time (s)` double")


def cross_validate(df: DataFrame, features: list[str], k: int = 5, n_trees: int = 50,
                   contamination: float = 0.2) -> DataFrame:
    """Stand-alone stratified k-fold of one isolation forest; per-fold F1
    and AUC plus mean/std rows."""
    folded = materialise(P.kfold_assign(df, k), "folds")
    scores = _fold_forests(folded, features, k, "fold", n_trees)
    off = exact_quantiles(scores.where("NOT held"), "score_samples", [contamination], by=["forest"])
    d = F.col("score_samples") - F.col("q")
    scored = scores.where("held").join(F.broadcast(off.select("forest", "q")), "forest").select(  # a row a fold
        F.col("forest").alias("fold"), "row_id", "y", (d < 0).cast("int").alias("pred"), (-d).alias("score"))
    fm = fold_metrics(scored, by=["fold"]).select((F.col("fold") + 1).alias("fold"), "f1", "auc")
    summ = fm.agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"),
                  F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))
    return fm.crossJoin(summ)


def cv_boxes(fold_rows: DataFrame, model_col: str = "model", value: str = "f1") -> DataFrame:
    """Box statistics of per-fold scores per model."""
    from flowsentry.operators.profile import box_stats
    return box_stats(fold_rows.select(model_col, value), [value], cls=model_col)


def best_params(ranked: DataFrame, params: list[str]) -> dict:
    """T5: parameters of the rank-1 candidate, typed (no metric columns)."""
    row = ranked.where(F.col("rank") == 1).select(*params).first()
    return {p: row[p] for p in params if row[p] is not None}
