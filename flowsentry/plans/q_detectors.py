"""Registered queries: detectors (kNN/LOF with brute-force SQL twins; isolation
forest, one-class SVM and autoencoders checked by rows and by tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.functions.scalar import r6
from flowsentry.operators import sampling as P
from flowsentry.operators.detectors import iforest as IF
from flowsentry.operators.detectors import lof as LOF
from flowsentry.operators.detectors.knn import knn_join
from flowsentry.plans import sqlgen as G
from flowsentry.plans.fixtures import EM_FEATURES, EM_SQL, LI_FEATURES, LI_SQL, em_flows, li_flows, once
from flowsentry.plans.registry import query


def _r(c: str, places: int = 6) -> str:
    return f"round({c}, {places}) + 0.0"


VEC = "[" + ", ".join(EM_FEATURES) + "]"

EM_SPLIT = f"""em AS ({EM_SQL}), {G.split_ctes('em')},
ref AS (SELECT row_id, {VEC} AS v FROM splitted WHERE split = 'train' AND y = 0),
qry AS (SELECT row_id, y, {VEC} AS v FROM splitted WHERE split = 'test')"""


def em_split(spark, sf_dir):
    em = P.stratified_split(em_flows(spark, sf_dir))
    ref = em.where("split = 'train' AND y = 0")
    qry = em.where("split = 'test'")
    return ref, qry


@query("knn_join", f"""WITH {EM_SPLIT},
p AS (SELECT q.row_id AS q_id, r.row_id AS o_id, list_distance(q.v, r.v) AS dist FROM qry q, ref r),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, o_id) AS rank FROM p)
SELECT q_id, o_id, {_r('dist')} AS dist, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")
def q_knn_join(spark, sf_dir):
    """Exact 5-NN of the test rows among the train normals."""
    ref, qry = em_split(spark, sf_dir)
    nb = knn_join(qry, ref, EM_FEATURES, 5)
    return nb.select("q_id", "o_id", r6("dist").alias("dist"), "rank")


@query("knn_join_ties", f"""WITH li AS ({LI_SQL}), {G.split_ctes('li')},
pts AS (SELECT row_id, split, [1e8 + CAST(l_quantity AS DOUBLE), CAST(l_linenumber AS DOUBLE), 100.0 * l_tax] AS v FROM splitted),
ref AS (SELECT row_id, v FROM pts WHERE split = 'val'),
qry AS (SELECT v, min(row_id) AS q_id FROM pts WHERE split = 'test' GROUP BY v),
grp AS (SELECT v, count(*) AS n FROM ref GROUP BY v),
d AS (SELECT q.q_id, g.v, g.n, list_distance(q.v, g.v) AS dist FROM qry q, grp g),
c AS (SELECT *, sum(n) OVER (PARTITION BY q_id ORDER BY dist RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM d),
m AS (SELECT q_id, min(dist) FILTER (before + n >= 5) AS far FROM c GROUP BY q_id),
k AS (SELECT d.q_id, r.row_id AS o_id, d.dist, row_number() OVER (PARTITION BY d.q_id ORDER BY d.dist, r.row_id) AS rank
  FROM d JOIN m ON d.q_id = m.q_id AND d.dist <= m.far JOIN ref r ON r.v = d.v)
SELECT q_id, o_id, {_r('dist')} AS dist, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")
def q_knn_join_ties(spark, sf_dir):
    """J3 on LI with many equal points and a large offset: 5-NN of the different test
    points among the validation rows, ties by key."""
    li = P.stratified_split(li_flows(spark, sf_dir)).select(
        "row_id", "split", (F.lit(1e8) + F.col("l_quantity")).alias("a"),
        F.col("l_linenumber").cast("double").alias("b"), (F.lit(100.0) * F.col("l_tax")).alias("c")).cache()
    qry = li.where("split = 'test'").groupBy("a", "b", "c").agg(F.min("row_id").alias("row_id"))
    nb = knn_join(qry, li.where("split = 'val'"), ["a", "b", "c"], 5)
    return nb.select("q_id", "o_id", r6("dist").alias("dist"), "rank")


LOF_FIT_SQL = f"""{EM_SPLIT},
rr AS (SELECT a.row_id AS r_id, b.row_id AS o_id, list_distance(a.v, b.v) AS dist
       FROM ref a, ref b WHERE a.row_id <> b.row_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY dist, o_id) AS rank FROM rr),
nb AS (SELECT * FROM rk WHERE rank <= 20),
kd AS (SELECT r_id, max(dist) AS kdist FROM nb GROUP BY r_id),
lrd AS (SELECT nb.r_id, 1.0 / (avg(greatest(kd.kdist, nb.dist)) + 1e-10) AS lrd
        FROM nb JOIN kd ON kd.r_id = nb.o_id GROUP BY nb.r_id),
lof AS (SELECT nb.r_id, avg(l2.lrd) / any_value(l1.lrd) AS lof FROM nb
        JOIN lrd l2 ON l2.r_id = nb.o_id JOIN lrd l1 ON l1.r_id = nb.r_id GROUP BY nb.r_id)"""


@query("lof_fit", f"""WITH {LOF_FIT_SQL}
SELECT r_id AS row_id, {_r('kdist')} AS kdist, {_r('lrd')} AS lrd, {_r('lof')} AS lof
FROM kd JOIN lrd USING (r_id) JOIN lof USING (r_id)""")
def q_lof_fit(spark, sf_dir):
    """K-distance, lrd and training LOF (k=20) of the train normals."""
    ref, _ = em_split(spark, sf_dir)
    m = LOF.fit_lof(ref, EM_FEATURES, k=20, contamination=0.2)
    return m.table.select("row_id", *[r6(c).alias(c) for c in ("kdist", "lrd", "lof")])


@query("lof_score", f"""WITH {LOF_FIT_SQL},
qp AS (SELECT q.row_id AS q_id, r.row_id AS o_id, list_distance(q.v, r.v) AS dist FROM qry q, ref r),
qk AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, o_id) AS rank FROM qp),
qn AS (SELECT * FROM qk WHERE rank <= 20),
ql AS (SELECT qn.q_id, 1.0 / (avg(greatest(kd.kdist, qn.dist)) + 1e-10) AS lrd_q, avg(l.lrd) AS mlo
       FROM qn JOIN kd ON kd.r_id = qn.o_id JOIN lrd l ON l.r_id = qn.o_id GROUP BY qn.q_id),
off AS (SELECT quantile_cont(-lof, 0.2) AS off_v FROM lof),
s AS (SELECT q_id, -mlo / lrd_q - off_v AS decision FROM ql, off)
SELECT q.row_id, q.y, {_r('-decision')} AS score, CAST(decision < 0 AS INTEGER) AS pred
FROM s JOIN qry q ON q.row_id = s.q_id""")
def q_lof_score(spark, sf_dir):
    """Novelty scores of the test rows, contamination 0.2."""
    ref, qry = em_split(spark, sf_dir)
    m = LOF.fit_lof(ref, EM_FEATURES, k=20, contamination=0.2)
    s = m.transform(qry, keep=("row_id", "y"))
    return s.select("row_id", "y", r6("score").alias("score"), "pred")


LI_SPLIT = f"""li AS ({LI_SQL}), {G.split_ctes('li')},
tr AS (SELECT * FROM splitted WHERE split = 'train')"""
LI_FOREST = f"""{LI_SPLIT},
{G.iforest_nodes_ctes('tr', LI_FEATURES, 100)}"""


def _li_train(spark, sf_dir):
    return P.stratified_split(li_flows(spark, sf_dir)).cache()


@query("iforest_nodes", f"""WITH {LI_FOREST}
SELECT tree, CAST(node AS INTEGER) AS node, CAST(f AS INTEGER) AS feature, {_r('thr')} AS threshold,
  CAST(CASE WHEN f < 0 THEN -1 ELSE 2 * node + 1 END AS INTEGER) AS "left",
  CAST(CASE WHEN f < 0 THEN -1 ELSE 2 * node + 2 END AS INTEGER) AS "right",
  CAST(n AS INTEGER) AS size, CAST(depth AS INTEGER) AS depth FROM nodes""")
def q_iforest_nodes(spark, sf_dir):
    """Node table of a 100-tree forest fitted on the LI train split."""
    li = _li_train(spark, sf_dir)
    m = IF.fit_iforest(li.where("split = 'train'"), LI_FEATURES, n_trees=100,
                       contamination="auto")
    return spark.createDataFrame(m.nodes, IF.NODE_SCHEMA).withColumn("threshold", r6("threshold"))


@query("iforest_score", f"""WITH {LI_FOREST},
{G.iforest_score_ctes('tr', LI_FEATURES, 'row_id', 100, out='fit')},
o AS (SELECT quantile_cont(ss, 0.2) AS off_v FROM fit),
te AS (SELECT * FROM splitted WHERE split = 'test'),
{G.iforest_score_ctes('te', LI_FEATURES, 'row_id, y', 100)}
SELECT row_id, y, {_r('ss')} AS score_samples, {_r('ss - off_v')} AS decision, {_r('-(ss - off_v)')} AS score,
  CAST(ss - off_v < 0 AS INTEGER) AS pred FROM ifs, o""")
def q_iforest_score(spark, sf_dir):
    """Decision, score and prediction of the LI test rows."""
    li = _li_train(spark, sf_dir)
    m = IF.fit_iforest(li.where("split = 'train'"), LI_FEATURES, n_trees=100, contamination=0.2)
    s = m.transform(li.where("split = 'test'"), keep=("row_id", "y"))
    return s.select("row_id", "y", *[r6(c).alias(c) for c in ("score_samples", "decision", "score")], "pred")


@query("contamination_flag", f"""WITH {LI_FOREST},
{G.iforest_score_ctes('tr', LI_FEATURES, 'row_id', 100, out='fit')},
o AS (SELECT quantile_cont(ss, 0.2) AS off_v FROM fit)
SELECT count(*) AS n, CAST(count(*) FILTER (ss < off_v) AS BIGINT) AS n_flagged,
  {_r('CAST(count(*) FILTER (ss < off_v) AS DOUBLE) / count(*)')} AS flag_share FROM fit, o""")
def q_contamination_flag(spark, sf_dir):
    """D3: flagged share of the training rows at contamination 0.2 (LI, IF)."""
    train = _li_train(spark, sf_dir).where("split = 'train'")
    m = IF.fit_iforest(train, LI_FEATURES, n_trees=100, contamination=0.2)
    s = m.transform(train, keep=("row_id",))
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("pred").cast("long").alias("n_flagged"),
                 r6(F.avg("pred")).alias("flag_share"))


# ------------------------------------------------------- OC-SVM, autoencoders

from flowsentry.functions.ranks import exact_quantile_values  # noqa: E402
from flowsentry.operators.detectors import autoencoder as AE  # noqa: E402
from flowsentry.operators.detectors import ocsvm as OC  # noqa: E402


@query("ocsvm_score")
def q_ocsvm_score(spark, sf_dir):
    """Rbf one-class SVM (nu 0.2, gamma auto) fitted on the EM train split."""
    em = P.stratified_split(em_flows(spark, sf_dir))
    m = OC.fit_ocsvm(em.where("split = 'train'"), EM_FEATURES, "rbf", "auto", 0.2)
    return m.transform(em.where("split = 'test'"), keep=("row_id", "y"))


def _ae(spark, sf_dir, cls: int):
    em = P.stratified_split(em_flows(spark, sf_dir))
    tr = em.where(f"split = 'train' AND y = {cls}")
    va = em.where(f"split = 'val' AND y = {cls}")
    return em, once(spark, sf_dir, f"autoencoder {cls}", lambda: AE.fit_autoencoder(tr, va, EM_FEATURES))


@query("autoencoder_score")
def q_autoencoder_score(spark, sf_dir):
    """AE on normals; flag test rows whose error exceeds P80 of val errors."""
    em, m = _ae(spark, sf_dir, 0)
    val = m.reconstruction_error(em.where("split = 'val'"))
    t = exact_quantile_values(val, "mse", [0.8])[(0.8,)]
    s = m.reconstruction_error(em.where("split = 'test'"))
    return s.withColumn("score", F.col("mse")).withColumn("pred", (F.col("mse") > t).cast("int"))


@query("autoencoder_anomaly_score")
def q_autoencoder_anomaly_score(spark, sf_dir):
    """AE on anomalies; low error = anomaly (mse < P20 of val), score -mse."""
    em, m = _ae(spark, sf_dir, 1)
    val = m.reconstruction_error(em.where("split = 'val'"))
    t = exact_quantile_values(val, "mse", [0.2])[(0.2,)]
    s = m.reconstruction_error(em.where("split = 'test'"))
    return s.withColumn("score", -F.col("mse")).withColumn("pred", (F.col("mse") < t).cast("int"))


@query("loss_history")
def q_loss_history(spark, sf_dir):
    """Per-epoch train and validation loss of the normal AE."""
    _, m = _ae(spark, sf_dir, 0)
    return m.history_df(spark)


RECON = [f"round({c}, 1) AS r_{c}" for c in EM_FEATURES]


@query("reconstruction_mse", f"""WITH em AS ({EM_SQL}), x AS (SELECT row_id, {VEC} AS v,
  [{', '.join(f'round({c}, 1)' for c in EM_FEATURES)}] AS r FROM em)
SELECT row_id, {_r('list_distance(v, r) ** 2 / 64')} AS mse FROM x""")
def q_reconstruction_mse(spark, sf_dir):
    """Mean squared error of given reconstructions (the features to one decimal)."""
    em = em_flows(spark, sf_dir).selectExpr("row_id", *EM_FEATURES, *RECON)
    return AE.reconstruction_mse(em, EM_FEATURES, [f"r_{c}" for c in EM_FEATURES]).select("row_id", r6("mse").alias("mse"))


# ------------------------------------------- closed forms with given parameters

def _folded(spark, sf_dir):
    return P.kfold_assign(em_flows(spark, sf_dir), 3)


@query("ocsvm_gamma", f"""WITH em AS ({EM_SQL}), {G.kfold_ctes('em', 3)},
t AS (SELECT f.range AS fold, unnest({VEC}) AS x FROM folded, range(3) f WHERE fold <> f.range)
SELECT CAST(fold AS INTEGER) AS fold, {_r('1.0 / 64')} AS gamma_auto, {_r('1.0 / (64 * var_pop(x))')} AS gamma_scale
FROM t GROUP BY fold""")
def q_ocsvm_gamma(spark, sf_dir):
    """Both gammas of every fold's training rows."""
    folded = _folded(spark, sf_dir)
    rows = [(f, *(OC.resolve_gamma(g, folded.where(F.col("fold") != f), EM_FEATURES) for g in ("auto", "scale"))) for f in range(3)]
    return spark.createDataFrame(rows, "fold int, gamma_auto double, gamma_scale double").select(
        "fold", r6("gamma_auto").alias("gamma_auto"), r6("gamma_scale").alias("gamma_scale"))


# fixed values: weights and offset of a given model on four landmarks
GIVEN_W, GIVEN_RHO = (0.4, 0.3, 0.2, 0.1), 0.05
_GIVEN = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(GIVEN_W))


def _given_sql(kernel: str) -> str:
    return f"""SELECT a.row_id, a.y, sum(CASE l.vec_id {_GIVEN} END * {kernel}) - {GIVEN_RHO} AS d
  FROM x a, x l WHERE l.vec_id < 4 GROUP BY a.row_id, a.y"""


@query("ocsvm_score_given", f"""WITH em AS ({EM_SQL}), x AS (SELECT row_id, vec_id, y, {VEC} AS v FROM em),
r AS ({_given_sql('exp(-(list_distance(a.v, l.v) ** 2) / 64)')}), p AS ({_given_sql('(list_inner_product(a.v, l.v) / 64) ** 3')})
SELECT r.row_id, r.y, {_r('r.d')} AS rbf, CAST(r.d < 0 AS INTEGER) AS rbf_pred, {_r('p.d')} AS poly, CAST(p.d < 0 AS INTEGER) AS poly_pred
FROM r JOIN p USING (row_id)""")
def q_ocsvm_score_given(spark, sf_dir):
    """Decisions of a model whose landmarks, weights and rho are given, both kernels."""
    import numpy as np
    em = em_flows(spark, sf_dir)
    marks = em.where("vec_id < 4").select("vec_id", *EM_FEATURES).toPandas()  # four rows
    L, w = marks[EM_FEATURES].to_numpy(float), np.array([GIVEN_W[int(i)] for i in marks["vec_id"]])
    out = None
    for kind in ("rbf", "poly"):
        m = OC.OCSVMModel(EM_FEATURES, kind, 1 / 64, 0.2, L, np.eye(len(L)), w, GIVEN_RHO)
        s = m.transform(em, keep=("row_id", "y")).select("row_id", "y", r6("decision").alias(kind), F.col("pred").alias(f"{kind}_pred"))
        out = s if out is None else out.join(s.drop("y"), "row_id")
    return out


@query("ocsvm_flags", f"""WITH em AS ({EM_SQL}), {G.kfold_ctes('em', 3)},
t AS (SELECT CAST(f.range AS INTEGER) AS fold, count(*) AS n FROM folded, range(3) f WHERE fold <> f.range GROUP BY f.range)
SELECT nu, fold, n AS n_train, CAST(ceil(nu * (n - 1)) AS BIGINT) AS n_flagged
FROM t, (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.15), (0.2)) v(nu)""")
def q_ocsvm_flags(spark, sf_dir):
    """Training rows that the models of every nu and fold flag: all below the nu-quantile
    of their margins (rbf, gamma scale)."""
    folded = _folded(spark, sf_dir).cache()
    nus = (0.05, 0.1, 0.15, 0.2)
    models = OC.fit_ocsvm_many(folded, EM_FEATURES, "rbf", "scale", nus, "fold", (0, 1, 2))
    s = OC.score_models(folded, [(i, f, models[nu, f]) for i, nu in enumerate(nus) for f in range(3)], train=True)
    nu = F.element_at(F.array(*(F.lit(x) for x in nus)), F.col("candidate_id") + 1)
    return s.groupBy(nu.alias("nu"), "fold").agg(F.count(F.lit(1)).alias("n_train"), F.sum("pred").cast("long").alias("n_flagged"))


# fixed values: the given network, the same rule for every layer
def _weight(layer, i, j):
    return ((7 * i + 3 * j + 5 * layer) % 11 - 5) / 20


def _bias(layer, i):
    return ((i + layer) % 5 - 2) / 10


AE_INPUT = {"a": "l_quantity / 50", "b": "l_extendedprice / 100000", "c": "l_discount", "d": "l_tax", "e": "l_linenumber / 7"}


def _given_theta():
    import numpy as np
    dims, parts = AE.layer_dims(len(AE_INPUT)), []
    for n, (n_in, n_out) in enumerate(zip(dims, dims[1:], strict=False)):
        parts += [[_weight(n, i, j) for i in range(n_out) for j in range(n_in)], [_bias(n, i) for i in range(n_out)]]
    return np.concatenate(parts)


def _forward_sql() -> str:
    dims = AE.layer_dims(len(AE_INPUT))
    ctes = [f"x AS (SELECT row_id, split, [{', '.join(f'CAST({e} AS DOUBLE)' for e in AE_INPUT.values())}] AS v FROM splitted)",
            "a0 AS (SELECT row_id, split, v, v AS h FROM x)"]
    for n, (n_in, n_out) in enumerate(zip(dims, dims[1:], strict=False)):
        rows = ", ".join("[" + ", ".join(str(float(x)) for x in [*(_weight(n, i, j) for j in range(n_in)), _bias(n, i)]) + "]"
                         for i in range(n_out))
        z = "list_inner_product(list_append(h, 1.0), w)"
        z = z if n == len(dims) - 2 else f"greatest({z}, 0.0)"
        ctes.append(f"a{n + 1} AS (SELECT row_id, split, v, list_transform(CAST([{rows}] AS DOUBLE[][]), lambda w: {z}) AS h FROM a{n})")
    ctes.append(f"m AS (SELECT row_id, split, list_distance(v, h) ** 2 / {len(AE_INPUT)} AS mse FROM a{len(dims) - 1})")
    return ",\n".join(ctes)


AE_GIVEN = f"li AS ({LI_SQL}), {G.split_ctes('li')},\n{_forward_sql()}"


def _given_errors(spark, sf_dir):
    li = P.stratified_split(li_flows(spark, sf_dir)).selectExpr("row_id", "split", *(f"{e} AS {c}" for c, e in AE_INPUT.items()))
    return AE.AEModel(list(AE_INPUT), _given_theta()).reconstruction_error(li, keep=("row_id", "split"))


@query("autoencoder_forward", f"WITH {AE_GIVEN}\nSELECT row_id, {_r('mse')} AS mse FROM m WHERE split = 'test'")
def q_autoencoder_forward(spark, sf_dir):
    """The forward pass of a network with given weights, as the error of the test rows."""
    return _given_errors(spark, sf_dir).where("split = 'test'").select("row_id", r6("mse").alias("mse"))


@query("epoch_loss", f"WITH {AE_GIVEN}\nSELECT split, count(*) AS n, {_r('avg(mse)')} AS loss FROM m GROUP BY split")
def q_epoch_loss(spark, sf_dir):
    """The loss of the given network on each split."""
    return _given_errors(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("mse")).alias("loss"))


@query("anomaly_rule", f"""WITH {AE_GIVEN},
t AS (SELECT quantile_cont(mse, 0.8) AS hi, quantile_cont(mse, 0.2) AS lo FROM m WHERE split = 'val')
SELECT row_id, CAST(mse > hi AS INTEGER) AS pred_normal, {_r('mse')} AS score_normal,
  CAST(mse < lo AS INTEGER) AS pred_anomaly, {_r('-mse')} AS score_anomaly FROM m, t WHERE split = 'test'""")
def q_anomaly_rule(spark, sf_dir):
    """Both decision rules on given errors: above P80 of the validation errors, and, for
    the network of the anomalies, below P20 with the error's negative as score."""
    e = _given_errors(spark, sf_dir)
    t = exact_quantile_values(e.where("split = 'val'"), "mse", [0.8, 0.2])
    return e.where("split = 'test'").select(
        "row_id", (F.col("mse") > t[(0.8,)]).cast("int").alias("pred_normal"), r6("mse").alias("score_normal"),
        (F.col("mse") < t[(0.2,)]).cast("int").alias("pred_anomaly"), r6(-F.col("mse")).alias("score_anomaly"))


@query("early_stops", """WITH RECURSIVE v AS (SELECT event_type AS series, event_id % 60 AS minute, round(avg(value), 4) AS loss
  FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
l AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY minute) AS epoch, loss FROM v),
s AS (SELECT DISTINCT series, CAST(0 AS BIGINT) AS epoch, CAST('Infinity' AS DOUBLE) AS best, CAST(0 AS BIGINT) AS best_epoch FROM l
  UNION ALL SELECT s.series, l.epoch, CASE WHEN l.loss < best - 0.000001 THEN l.loss ELSE best END,
    CASE WHEN l.loss < best - 0.000001 THEN l.epoch ELSE best_epoch END
  FROM s JOIN l ON l.series = s.series AND l.epoch = s.epoch + 1 WHERE s.epoch - s.best_epoch < 5)
SELECT series, CAST(max(epoch) AS INTEGER) AS stop_epoch, CAST(max(best_epoch) AS INTEGER) AS best_epoch FROM s GROUP BY series""")
def q_early_stops(spark, sf_dir):
    """The stopping rule on a loss table (the mean value of each event type, minute by minute)."""
    from flowsentry.plans.fixtures import table
    loss = (table(spark, sf_dir, "events").where("event_type IS NOT NULL AND value IS NOT NULL")
            .groupBy(F.col("event_type").alias("series"), (F.col("event_id") % 60).alias("epoch"))
            .agg(F.round(F.avg("value"), 4).alias("loss")))
    return AE.early_stops(loss, "series", "epoch", "loss")


@query("early_stop_history")
def q_early_stop_history(spark, sf_dir):
    """An autoencoder on the LI normals that stops early (learning rate 0.01, min_delta
    0.02); its history is written and read back."""
    from flowsentry.plans.experiment import preprocess
    from flowsentry.session import scratch_path
    from flowsentry.sources.files import read_flow_csv, write_table
    z, _ = preprocess(li_flows(spark, sf_dir), LI_FEATURES)
    m = AE.fit_autoencoder(z.where("split = 'train' AND y = 0"), z.where("split = 'val' AND y = 0"), LI_FEATURES,
                           min_delta=0.02, lr=1e-2)
    path = scratch_path(spark, "loss-history")
    write_table(m.history_df(spark), path, "csv")
    return read_flow_csv(spark, path).orderBy("Epoch")
