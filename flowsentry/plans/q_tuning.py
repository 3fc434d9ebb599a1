"""Registered queries: tuning and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.functions.scalar import r6
from flowsentry.operators import sampling as P
from flowsentry.plans import sqlgen as G
from flowsentry.plans import tuning as TU
from flowsentry.plans.experiment import preprocess
from flowsentry.plans.fixtures import EM_FEATURES, EM_SQL, LI_FEATURES, LI_SQL, em_flows, li_flows, once
from flowsentry.plans.q_metrics import auc_sql, conf_sql, F1, PREC, REC
from flowsentry.plans.registry import query


def _r(c: str, places: int = 6) -> str:
    return f"round({c}, {places}) + 0.0"


VEC = "[" + ", ".join(EM_FEATURES) + "]"


def em_folded(spark, sf_dir):
    return P.kfold_assign(em_flows(spark, sf_dir), 3).cache()


def _lof_grid(spark, sf_dir):
    return once(spark, sf_dir, "lof grid", lambda: TU.tune_lof(em_folded(spark, sf_dir), EM_FEATURES))


def _if_grid(spark, sf_dir):
    return once(spark, sf_dir, "forest grid", lambda: TU.tune_iforest(em_folded(spark, sf_dir), EM_FEATURES))


def _svm_grid(spark, sf_dir):
    return once(spark, sf_dir, "svm grid", lambda: TU.tune_ocsvm(em_folded(spark, sf_dir), EM_FEATURES))


def _lof_cv_sql(ks=(5, 10, 20, 40, 60)) -> str:
    kv = ", ".join(f"({k})" for k in ks)
    return f"""em AS ({EM_SQL}), {G.kfold_ctes('em', 3)},
pts AS (SELECT row_id, y, fold, {VEC} AS v FROM folded),
pairs AS (SELECT a.row_id AS q_id, b.row_id AS o_id, b.fold AS blk, list_distance(a.v, b.v) AS dist
          FROM pts a, pts b WHERE a.row_id <> b.row_id),
ff AS (SELECT CAST(range AS INTEGER) AS f FROM range(3)),
pf AS (SELECT ff.f, p.* FROM pairs p, ff WHERE p.blk <> ff.f),
rk AS (SELECT *, row_number() OVER (PARTITION BY f, q_id ORDER BY dist, o_id) AS rank FROM pf),
nbr AS (SELECT * FROM rk WHERE rank <= {max(ks)}),
kk AS (SELECT * FROM (VALUES {kv}) t(k)),
nb AS (SELECT nbr.*, kk.k, pts.fold AS own, pts.y FROM nbr JOIN kk ON nbr.rank <= kk.k
       JOIN pts ON pts.row_id = nbr.q_id),
kd AS (SELECT k, f, q_id, max(dist) AS kdist FROM nb WHERE own <> f GROUP BY k, f, q_id),
lrd AS (SELECT nb.k, nb.f, nb.q_id, any_value(nb.own) AS own, any_value(nb.y) AS y,
        1.0 / (avg(greatest(kd.kdist, nb.dist)) + 1e-10) AS lrd
        FROM nb JOIN kd ON kd.k = nb.k AND kd.f = nb.f AND kd.q_id = nb.o_id GROUP BY nb.k, nb.f, nb.q_id),
mo AS (SELECT nb.k, nb.f, nb.q_id, avg(l.lrd) AS mlo FROM nb
       JOIN lrd l ON l.k = nb.k AND l.f = nb.f AND l.q_id = nb.o_id WHERE l.own <> l.f
       GROUP BY nb.k, nb.f, nb.q_id),
lofs AS (SELECT lrd.*, mo.mlo / lrd.lrd AS lof FROM lrd JOIN mo USING (k, f, q_id)),
qs AS (SELECT k, f, q_id AS row_id, y, -lof AS ss FROM lofs WHERE own = f)"""


def _cv_tables_sql() -> str:
    return f"""{_lof_cv_sql()},
scored AS (SELECT k, f AS fold, row_id, y, CAST(ss + 1.5 < 0 AS INTEGER) AS pred, -(ss + 1.5) AS score FROM qs),
conf AS ({conf_sql('scored', 'k, fold')}),
{auc_sql('scored', 'k, fold')},
fm AS (SELECT c.k, c.fold, {F1} AS f1, {REC} AS recall, {PREC} AS precision,
         CASE WHEN a.auc < 0.5 THEN 1 - a.auc ELSE a.auc END AS auc
       FROM conf c LEFT JOIN auc a USING (k, fold)),
res AS (SELECT k, avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1, avg(recall) AS mean_recall,
          stddev_pop(recall) AS std_recall, avg(precision) AS mean_precision,
          stddev_pop(precision) AS std_precision,
          avg(CASE WHEN NOT isnan(auc) THEN auc END) AS mean_auc FROM fm GROUP BY k),
cand AS (SELECT k, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS candidate_id FROM kk)"""


@query("cv_rank", f"""WITH {_cv_tables_sql()}
SELECT candidate_id, k AS n_neighbors, {', '.join(_r(c) + ' AS ' + c for c in TU.METRIC_COLS)},
       CAST(row_number() OVER (ORDER BY mean_f1 DESC, candidate_id) AS INTEGER) AS rank
FROM res JOIN cand USING (k)""")
def q_cv_rank(spark, sf_dir):
    """T2+T3: LOF grid (k 5..60) by 3-fold stratified CV, ranked by mean F1."""
    res, _, _ = _lof_grid(spark, sf_dir)
    return res.select("candidate_id", "n_neighbors", *[r6(c).alias(c) for c in TU.METRIC_COLS],
                      F.col("rank").cast("int").alias("rank"))


@query("metric_pivot", f"""WITH {_cv_tables_sql()}
SELECT k AS n_neighbors, {_r('avg(f1) FILTER (WHERE fold = 0)')} AS "0",
       {_r('avg(f1) FILTER (WHERE fold = 1)')} AS "1", {_r('avg(f1) FILTER (WHERE fold = 2)')} AS "2"
FROM fm GROUP BY k""")
def q_metric_pivot(spark, sf_dir):
    """F16: fold F1 pivoted to n_neighbors x fold."""
    _, fm, _ = _lof_grid(spark, sf_dir)
    p = TU.metric_pivot(fm.withColumnRenamed("k", "n_neighbors"), "n_neighbors", "fold", "f1")
    return p.select("n_neighbors", *[r6(c).alias(c) for c in ("0", "1", "2")])


@query("group_mean", f"""WITH {_cv_tables_sql()}
SELECT k AS n_neighbors, {_r('avg(mean_f1)')} AS mean_f1 FROM res GROUP BY k""")
def q_group_mean(spark, sf_dir):
    """mean F1 by n_neighbors."""
    res, _, _ = _lof_grid(spark, sf_dir)
    g = TU.group_mean(res, "n_neighbors")
    return g.select("n_neighbors", r6("mean_f1").alias("mean_f1"))


def _sweep_sql() -> str:
    return f"""{_lof_cv_sql((60,))},
off AS ({' UNION ALL '.join(f"SELECT f, CAST({c!r} AS DOUBLE) AS contamination, quantile_cont(-lof, {c!r}) AS off_v FROM lofs WHERE own <> f GROUP BY f" for c in TU.CONTAMINATION_SWEEP)}),
sp AS (SELECT o.contamination, q.f, q.y, CAST(q.ss < o.off_v AS INTEGER) AS pred
       FROM qs q JOIN off o ON o.f = q.f),
conf AS ({conf_sql('sp', 'contamination, f')}),
sw AS (SELECT contamination, avg({F1}) AS mean_f1 FROM conf GROUP BY contamination)"""


@query("threshold_sweep", f"""WITH {_sweep_sql()}
SELECT {_r('contamination')} AS contamination, {_r('mean_f1')} AS mean_f1 FROM sw""")
def q_threshold_sweep(spark, sf_dir):
    """T4: contamination sweep for LOF at k=60, folds scored once."""
    s = TU.lof_threshold_sweep(em_folded(spark, sf_dir), EM_FEATURES, 60)
    return s.select(r6("contamination").alias("contamination"), r6("mean_f1").alias("mean_f1"))


@query("sweep_best", f"""WITH {_sweep_sql()}
SELECT {_r('contamination')} AS contamination, {_r('mean_f1')} AS mean_f1 FROM sw
ORDER BY mean_f1 DESC, contamination LIMIT 1""")
def q_sweep_best(spark, sf_dir):
    """T4/T5: best contamination (first wins ties)."""
    s = TU.sweep_best(TU.lof_threshold_sweep(em_folded(spark, sf_dir), EM_FEATURES, 60))
    return s.select(r6("contamination").alias("contamination"), r6("mean_f1").alias("mean_f1"))


@query("volume_rows", f"""WITH li AS ({LI_SQL}), {G.split_ctes('li')},
tr AS (SELECT * FROM splitted WHERE split = 'train'),
c AS (SELECT count(*) AS cnt, sum(y) AS a FROM tr),
sc AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {'NULL' if n is None else n})" for s, n in TU.SCENARIOS)}) t(scenario, n))
SELECT scenario AS "Scenario", CAST(CASE WHEN n IS NULL OR n >= cnt THEN cnt
    ELSE least(CAST(floor(n * (CAST(a AS DOUBLE) / cnt)) AS BIGINT), a)
       + least(n - CAST(floor(n * (CAST(a AS DOUBLE) / cnt)) AS BIGINT), cnt - a) END AS BIGINT) AS "Training Rows"
FROM sc, c""")
def q_volume_rows(spark, sf_dir):
    """The training rows of each volume scenario on the LI train split."""
    tr = P.stratified_split(li_flows(spark, sf_dir)).where("split = 'train'").cache()
    rows = [(name, P.stratified_subsample(tr, n).count()) for name, n in TU.SCENARIOS]
    return spark.createDataFrame(rows, "Scenario string, `Training Rows` long")


def _if_cv_sql() -> str:
    """The forest grid on EM: one forest of 200 trees for each (max_features, fold); smaller
    ones are its first trees."""
    sizes, shares = TU.IF_GRID["n_estimators"], TU.IF_GRID["max_features"]
    ctes = [f"em AS ({EM_SQL}), {G.kfold_ctes('em', 3)}",
            "ff AS (SELECT CAST(range AS INTEGER) AS f FROM range(3))",
            "trf AS (SELECT ff.f AS fo, folded.* FROM folded, ff WHERE fold <> ff.f)",
            "tef AS (SELECT fold AS fo, * FROM folded)"]
    scored, cand = [], []
    for i, mf in enumerate(shares):
        n_feat = max(1, int(mf * len(EM_FEATURES)))
        ctes.append(G.iforest_nodes_ctes("trf", EM_FEATURES, max(sizes), out=f"n{i}", by="fo", n_feat=n_feat))
        ctes.append(G.iforest_score_ctes("tef", EM_FEATURES, "fo, row_id, y", max(sizes), nodes=f"n{i}", out=f"i{i}", by="fo"))
        for j, size in enumerate(sizes):
            c = i * len(sizes) + j + 1
            where = f" FILTER (tree < {size})"
            scored.append(f"SELECT {c} AS candidate_id, fo AS fold, row_id, y, {G.iforest_ss(256, where)} AS ss "
                          f"FROM i{i}_h GROUP BY fo, row_id, y")
            cand.append(f"({c}, CAST({mf} AS DOUBLE), {size})")
    return ",\n".join(ctes) + f""",
scored AS (SELECT candidate_id, fold, y, CAST(ss + 0.5 < 0 AS INTEGER) AS pred, -(ss + 0.5) AS score
  FROM ({' UNION ALL '.join(scored)})),
conf AS ({conf_sql('scored', 'candidate_id, fold')}),
{auc_sql('scored', 'candidate_id, fold')},
fm AS (SELECT c.candidate_id, c.fold, {F1} AS f1, {REC} AS recall, {PREC} AS precision,
  CASE WHEN a.auc < 0.5 THEN 1 - a.auc ELSE a.auc END AS auc FROM conf c LEFT JOIN auc a USING (candidate_id, fold)),
res AS (SELECT candidate_id, avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1, avg(recall) AS mean_recall,
  stddev_pop(recall) AS std_recall, avg(precision) AS mean_precision, stddev_pop(precision) AS std_precision,
  avg(auc) AS mean_auc FROM fm GROUP BY candidate_id),
cand AS (SELECT * FROM (VALUES {', '.join(cand)}) t(candidate_id, max_features, n_estimators))"""


@query("if_cv", f"""WITH {_if_cv_sql()}
SELECT candidate_id, max_features, n_estimators, {', '.join(_r(c) + ' AS ' + c for c in TU.METRIC_COLS)}
FROM res JOIN cand USING (candidate_id)""")
def q_if_cv(spark, sf_dir):
    """T2+T3 for the isolation-forest grid (9 candidates x 3 folds)."""
    res, _ = _if_grid(spark, sf_dir)
    return res.select("candidate_id", "max_features", "n_estimators", *[r6(c).alias(c) for c in TU.METRIC_COLS])


@query("if_pivot", f"""WITH {_if_cv_sql()}
SELECT max_features, {', '.join(_r(f'avg(mean_f1) FILTER (n_estimators = {n})') + f' AS "{n}"' for n in TU.IF_GRID["n_estimators"])}
FROM res JOIN cand USING (candidate_id) GROUP BY max_features""")
def q_if_pivot(spark, sf_dir):
    """F16: mean F1 of the forest grid, max_features x n_estimators."""
    res, _ = _if_grid(spark, sf_dir)
    p = TU.metric_pivot(res, "max_features", "n_estimators", "mean_f1")
    return p.select("max_features", *[r6(str(n)).alias(str(n)) for n in TU.IF_GRID["n_estimators"]])


def _li_folds_sql(k: int, trees: int) -> str:
    return f"""li AS ({LI_SQL}), {G.kfold_ctes('li', k)},
ff AS (SELECT CAST(range AS INTEGER) AS f FROM range({k})),
trf AS (SELECT ff.f AS fo, folded.* FROM folded, ff WHERE fold <> ff.f),
tef AS (SELECT fold AS fo, * FROM folded),
{G.iforest_nodes_ctes('trf', LI_FEATURES, trees, by='fo')},
{G.iforest_score_ctes('trf', LI_FEATURES, 'fo, row_id', trees, out='fit', by='fo')},
{G.iforest_score_ctes('tef', LI_FEATURES, 'fo, row_id, y', trees, by='fo')}"""


@query("if_threshold_sweep", f"""WITH {_li_folds_sql(3, 100)},
off AS ({' UNION ALL '.join(f"SELECT fo, CAST({c!r} AS DOUBLE) AS contamination, quantile_cont(ss, {c!r}) AS off_v FROM fit GROUP BY fo" for c in TU.CONTAMINATION_SWEEP)}),
sp AS (SELECT o.contamination, i.fo, i.y, CAST(i.ss < o.off_v AS INTEGER) AS pred FROM ifs i JOIN off o USING (fo)),
conf AS ({conf_sql('sp', 'contamination, fo')})
SELECT contamination, {_r(f'avg({F1})')} AS mean_f1 FROM conf GROUP BY contamination""")
def q_if_threshold_sweep(spark, sf_dir):
    """T4: contamination sweep of a 100-tree forest by 3-fold CV on LI."""
    folded = P.kfold_assign(li_flows(spark, sf_dir), 3).cache()
    return TU.if_threshold_sweep(folded, LI_FEATURES).select("contamination", r6("mean_f1").alias("mean_f1"))


@query("cross_validation", f"""WITH {_li_folds_sql(5, 50)},
off AS (SELECT fo, quantile_cont(ss, 0.2) AS off_v FROM fit GROUP BY fo),
sp AS (SELECT i.fo, i.y, CAST(i.ss - o.off_v < 0 AS INTEGER) AS pred, -(i.ss - o.off_v) AS score FROM ifs i JOIN off o USING (fo)),
conf AS ({conf_sql('sp', 'fo')}),
{auc_sql('sp', 'fo')},
fm AS (SELECT c.fo + 1 AS fold, {F1} AS f1, CASE WHEN a.auc < 0.5 THEN 1 - a.auc ELSE a.auc END AS auc
  FROM conf c LEFT JOIN auc a USING (fo)),
su AS (SELECT avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1, avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc FROM fm)
SELECT CAST(fold AS INTEGER) AS fold, {', '.join(_r(c) + ' AS ' + c for c in ('f1', 'auc', 'mean_f1', 'std_f1', 'mean_auc', 'std_auc'))} FROM fm, su""")
def q_cross_validation(spark, sf_dir):
    """Stand-alone 5-fold CV of a 50-tree forest on LI, contamination 0.2."""
    out = TU.cross_validate(li_flows(spark, sf_dir), LI_FEATURES, 5, 50)
    return out.select("fold", *[r6(c).alias(c) for c in ("f1", "auc", "mean_f1", "std_f1", "mean_auc", "std_auc")])


# ----------------------------------------------------------- rows-only

@query("ocsvm_cv")
def q_ocsvm_cv(spark, sf_dir):
    """T2+T3+T6 for the one-class SVM grid (20 candidates x 3 folds, shared passes)."""
    return _svm_grid(spark, sf_dir)[0]


@query("ocsvm_panels")
def q_ocsvm_panels(spark, sf_dir):
    """F16: mean F1 of the one-class SVM grid, nu x gamma for each kernel, with the span
    that all panels share."""
    return TU.panel_pivot(_svm_grid(spark, sf_dir)[0], "kernel", "nu", "gamma")


def _em_split(spark, sf_dir):
    em = P.stratified_split(em_flows(spark, sf_dir)).cache()
    return em.where("split = 'train'").cache(), em.where("split = 'test'").cache()


@query("baseline_vs_best")
def q_baseline_vs_best(spark, sf_dir):
    """T6+T7: default vs tuned parameters of the three classical models, tuned by
    cross-validation on the train split."""
    tr, te = _em_split(spark, sf_dir)
    tuned = TU.tuned_params(P.kfold_assign(tr, 3).cache(), EM_FEATURES)
    return TU.baseline_vs_best(tr, te, EM_FEATURES, tuned)


@query("volume_sensitivity")
def q_volume_sensitivity(spark, sf_dir):
    """Models at 15k, 80k and all LI training rows, with fit times."""
    z, _ = preprocess(li_flows(spark, sf_dir), LI_FEATURES, partitions=spark.sparkContext.defaultParallelism)
    z = z.cache()
    return TU.volume_sensitivity(z.where("split = 'train'"), z.where("split = 'test'"), LI_FEATURES)


@query("cv_boxes", f"""WITH lof AS (WITH {_cv_tables_sql()} SELECT f1 FROM fm), forest AS (WITH {_if_cv_sql()} SELECT f1 FROM fm),
x AS (SELECT 'LOF' AS cls, f1 AS v FROM lof UNION ALL SELECT 'Isolation Forest', f1 FROM forest),
q AS (SELECT cls, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY cls)
SELECT q.cls, 'f1' AS feature, {_r('any_value(q1)')} AS q1, {_r('any_value(median)')} AS median, {_r('any_value(q3)')} AS q3,
  {_r('min(v) FILTER (v >= q1 - 1.5 * (q3 - q1))')} AS whisker_lo, {_r('max(v) FILTER (v <= q3 + 1.5 * (q3 - q1))')} AS whisker_hi,
  CAST(count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers, count(*) AS n
FROM x JOIN q ON x.cls = q.cls GROUP BY q.cls""")
def q_cv_boxes(spark, sf_dir):
    """Per-model box statistics of fold F1 (LOF grid and IF grid)."""
    _, fm_lof, _ = _lof_grid(spark, sf_dir)
    _, fm_if = _if_grid(spark, sf_dir)
    rows = (fm_lof.select(F.lit("LOF").alias("model"), "f1")
            .unionByName(fm_if.select(F.lit("Isolation Forest").alias("model"), "f1")))
    return TU.cv_boxes(rows).select("cls", "feature", *(r6(c).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")),
                                    "n_outliers", "n")


# ----------------------------------------------------------- experiments

@query("full_experiment")
def q_full_experiment(spark, sf_dir):
    """Six models on the scaled EM split, evaluated on both scenarios."""
    from flowsentry.plans.experiment import em_experiment
    return em_experiment(spark, sf_dir)["evaluation"]


_TEST_COUNTS = f"""WITH em AS ({EM_SQL}), {G.split_ctes('em')},
t AS (SELECT CAST(count(*) FILTER (y = 1) AS BIGINT) AS n_anomaly, CAST(count(*) FILTER (y = 0) AS BIGINT) AS n_normal
  FROM splitted WHERE split = 'test')"""


@query("experiment_classes", f"""{_TEST_COUNTS}
SELECT model, n_anomaly, n_normal FROM t, (VALUES ('Isolation Forest'), ('One-Class SVM'), ('Local Outlier Factor'),
  ('Autoencoder'), ('Second Autoencoder'), ('Ensemble Autoencoder')) m(model)""")
def q_experiment_classes(spark, sf_dir):
    """Test rows of each class that every model was evaluated on."""
    from flowsentry.plans.experiment import em_experiment
    pc = em_experiment(spark, sf_dir)["per_class"]
    return pc.select("model", (F.col("tp") + F.col("fn")).alias("n_anomaly"), (F.col("tn") + F.col("fp")).alias("n_normal"))


@query("experiment_per_class")
def q_experiment_per_class(spark, sf_dir):
    """Recall and precision of both classes per model."""
    from flowsentry.plans.experiment import em_experiment
    return em_experiment(spark, sf_dir)["per_class"].select(
        "model", "recall_normal", "recall_anomaly", "precision_normal", "precision_anomaly")


@query("experiment_balanced")
def q_experiment_balanced(spark, sf_dir):
    """The summary table of the balanced scenario."""
    from flowsentry.plans.experiment import em_experiment
    return em_experiment(spark, sf_dir)["summary_balanced"]


@query("loss_curves")
def q_loss_curves(spark, sf_dir):
    """Loss histories of both autoencoders as one table."""
    from flowsentry.plans.experiment import em_experiment
    return em_experiment(spark, sf_dir)["loss_curves"]


@query("best_performers")
def q_best_performers(spark, sf_dir):
    """Best model per (scenario, metric) of the full experiment."""
    from flowsentry.plans.experiment import best_performers, em_experiment
    return best_performers(em_experiment(spark, sf_dir)["evaluation"])


@query("cv_best", f"""WITH {_cv_tables_sql()},
r AS (SELECT k, mean_f1, row_number() OVER (ORDER BY mean_f1 DESC, candidate_id) AS rk
      FROM res JOIN cand USING (k))
SELECT k AS n_neighbors, {_r('mean_f1')} AS mean_f1 FROM r WHERE rk = 1""")
def q_cv_best(spark, sf_dir):
    """T5: the best LOF structure from the ranked CV table."""
    res, _, _ = _lof_grid(spark, sf_dir)
    best = TU.best_params(res, ["n_neighbors", "mean_f1"])
    return res.where(F.col("n_neighbors") == best["n_neighbors"]).select(
        "n_neighbors", r6("mean_f1").alias("mean_f1"))
