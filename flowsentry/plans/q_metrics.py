"""Registered queries: evaluation metrics, thresholds and the ensemble (EV fixture).

EV carries three "models" whose scores are columns of the events table:
``value`` (pred value > 245), ``neg_value`` (pred value < 100) and
``user_mod`` (score user_id % 13, no pred -> default score > 0.5).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.functions.scalar import r6
from flowsentry.operators import ensemble as EN
from flowsentry.operators import features as FE
from flowsentry.operators import metrics as M
from flowsentry.operators import sampling as P
from flowsentry.plans import sqlgen as G
from flowsentry.plans.fixtures import EV_SQL, ev_flows
from flowsentry.plans.registry import query
from flowsentry.sources import files as S


def _r(c: str, places: int = 6) -> str:
    return f"round({c}, {places}) + 0.0"


def ev_scored(spark, sf_dir):
    ev = P.balanced_flag(ev_flows(spark, sf_dir))
    v, u = F.col("value"), (F.col("user_id") % 13).cast("double")
    models = F.array(
        F.struct(F.lit("value").alias("model"), F.lit(1).alias("model_order"),
                 v.alias("score"), (v > 245).cast("int").alias("pred")),
        F.struct(F.lit("neg_value").alias("model"), F.lit(2).alias("model_order"),
                 (-v).alias("score"), (v < 100).cast("int").alias("pred")),
        F.struct(F.lit("user_mod").alias("model"), F.lit(3).alias("model_order"),
                 u.alias("score"), F.lit(None).cast("int").alias("pred")))
    s = ev.select("row_id", "y", "in_balanced", F.explode(models).alias("m")).select(
        "row_id", "y", "in_balanced", "m.*")
    return s.withColumn("pred", M.default_prediction("score", "pred"))


SCORED = f"""ev AS ({EV_SQL}),
{G.balanced_ctes('ev')},
scored AS (
  SELECT 'value' AS model, 1 AS model_order, row_id, y, in_balanced, value AS score,
         CAST(value > 245 AS INTEGER) AS pred FROM bal
  UNION ALL SELECT 'neg_value', 2, row_id, y, in_balanced, -value, CAST(value < 100 AS INTEGER) FROM bal
  UNION ALL SELECT 'user_mod', 3, row_id, y, in_balanced, CAST(user_id % 13 AS DOUBLE),
         CAST(CAST(user_id % 13 AS DOUBLE) > 0.5 AS INTEGER) FROM bal),
scen AS (SELECT *, 'original' AS scenario FROM scored
         UNION ALL SELECT *, 'balanced' AS scenario FROM scored WHERE in_balanced = 1)"""


def conf_sql(src: str, by: str) -> str:
    return f"""SELECT {by}, CAST(count(*) FILTER (WHERE y = 1 AND pred = 1) AS BIGINT) AS tp,
  CAST(count(*) FILTER (WHERE y = 0 AND pred = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE y = 1 AND pred = 0) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE y = 0 AND pred = 0) AS BIGINT) AS tn FROM {src} GROUP BY {by}"""


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


PREC, REC, F1 = _div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("2 * tp", "2 * tp + fp + fn")
BAL = """CASE WHEN tp + fn > 0 AND tn + fp > 0
      THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2
      WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn)
      WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END"""


def auc_sql(src: str, by: str, out: str = "auc") -> str:
    return f"""{out}_g AS (SELECT {by}, score, CAST(sum(y) AS BIGINT) AS pos,
        CAST(sum(1 - y) AS BIGINT) AS neg FROM {src} GROUP BY {by}, score),
{out}_c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cneg FROM {out}_g),
{out} AS (SELECT {by}, sum(CAST(pos AS DOUBLE) * (CAST(cneg AS DOUBLE) + CAST(neg AS DOUBLE) / 2.0))
        / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS auc
        FROM {out}_c GROUP BY {by})"""


EVAL_SQL = f"""{SCORED},
conf AS ({conf_sql('scen', 'model, scenario')}),
{auc_sql('scen', 'model, scenario')},
ev_all AS (SELECT c.model, c.scenario, {PREC} AS precision, {REC} AS recall, {F1} AS f1,
        {BAL} AS balanced_accuracy, a.auc FROM conf c LEFT JOIN auc a USING (model, scenario)),
lng AS (SELECT model, scenario, 'Precision' AS metric, precision AS value FROM ev_all
  UNION ALL SELECT model, scenario, 'Recall', recall FROM ev_all
  UNION ALL SELECT model, scenario, 'F1-Score', f1 FROM ev_all
  UNION ALL SELECT model, scenario, 'Balanced_Accuracy', balanced_accuracy FROM ev_all
  UNION ALL SELECT model, scenario, 'AUC-ROC', auc FROM ev_all)"""


def _eval(spark, sf_dir):
    s = M.scenario_rows(ev_scored(spark, sf_dir))
    return M.evaluate(s, ["model", "scenario"])


def _long(spark, sf_dir):
    orders = {"value": 1, "neg_value": 2, "user_mod": 3}
    om = F.create_map(*[x for k, v in orders.items() for x in (F.lit(k), F.lit(v))])
    return M.metrics_long(_eval(spark, sf_dir)).withColumn("model_order", om[F.col("model")])


@query("confusion", f"WITH {SCORED} {conf_sql('scored', 'model')}")
def q_confusion(spark, sf_dir):
    """E1."""
    return M.confusion(ev_scored(spark, sf_dir))


@query("prf_scores", f"""WITH {SCORED}, c AS ({conf_sql('scored', 'model')})
SELECT model, {_r(PREC)} AS precision, {_r(REC)} AS recall, {_r(F1)} AS f1 FROM c""")
def q_prf_scores(spark, sf_dir):
    """E2."""
    r = M.with_rates(M.confusion(ev_scored(spark, sf_dir)))
    return r.select("model", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("balanced_accuracy", f"""WITH {SCORED}, c AS ({conf_sql('scored', 'model')})
SELECT model, {_r(BAL)} AS balanced_accuracy FROM c""")
def q_balanced_accuracy(spark, sf_dir):
    """E3."""
    r = M.with_rates(M.confusion(ev_scored(spark, sf_dir)))
    return r.select("model", r6("balanced_accuracy").alias("balanced_accuracy"))


@query("per_class", f"""WITH {SCORED}, c AS ({conf_sql('scored', 'model')})
SELECT model, {_r(_div('tn', 'tn + fp'))} AS recall_normal, {_r(REC)} AS recall_anomaly,
       {_r(_div('tn', 'tn + fn'))} AS precision_normal, {_r(PREC)} AS precision_anomaly FROM c""")
def q_per_class(spark, sf_dir):
    """E7."""
    r = M.with_rates(M.confusion(ev_scored(spark, sf_dir)))
    return r.select("model", *[r6(c).alias(c) for c in
                               ("recall_normal", "recall_anomaly", "precision_normal",
                                "precision_anomaly")])


@query("classification_report", f"""WITH {SCORED}, c AS ({conf_sql('scored', 'model')}),
k AS (SELECT model, tp, fp, fn, tn, tp + fp + fn + tn AS n,
        {_div('tn', 'tn + fn')} AS pn, {_div('tn', 'tn + fp')} AS rn, {_div('2 * tn', '2 * tn + fn + fp')} AS fnn,
        {PREC} AS pa, {REC} AS ra, {F1} AS fa, tp + fn AS sa, tn + fp AS sn FROM c),
r AS (SELECT model, 'Normal' AS class, pn AS precision, rn AS recall, fnn AS f1, sn AS support FROM k
  UNION ALL SELECT model, 'Anomaly', pa, ra, fa, sa FROM k
  UNION ALL SELECT model, 'accuracy', NULL, NULL, {_div('tp + tn', 'n')}, n FROM k
  UNION ALL SELECT model, 'macro avg', (pn + pa) / 2, (rn + ra) / 2, (fnn + fa) / 2, n FROM k
  UNION ALL SELECT model, 'weighted avg', {_div('pn * sn + pa * sa', 'n')}, {_div('rn * sn + ra * sa', 'n')},
        {_div('fnn * sn + fa * sa', 'n')}, n FROM k)
SELECT model, class, {_r('precision')} AS precision, {_r('recall')} AS recall, {_r('f1')} AS f1,
       CAST(support AS BIGINT) AS support FROM r""")
def q_classification_report(spark, sf_dir):
    """E8."""
    r = M.classification_report(M.confusion(ev_scored(spark, sf_dir)))
    return r.select("model", "class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")],
                    "support")


@query("default_prediction", f"""WITH {SCORED}
SELECT model, CAST(sum(pred) AS BIGINT) AS n_flagged FROM scored GROUP BY model""")
def q_default_prediction(spark, sf_dir):
    """Missing predictions default to score > 0.5."""
    return ev_scored(spark, sf_dir).groupBy("model").agg(
        F.sum("pred").cast("long").alias("n_flagged"))


@query("auc_roc", f"""WITH {SCORED}, {auc_sql('scored', 'model')}
SELECT model, {_r('auc')} AS auc FROM auc""")
def q_auc_roc(spark, sf_dir):
    """Exact AUC with ties."""
    return M.auc(ev_scored(spark, sf_dir)).select("model", r6("auc").alias("auc"))


@query("auc_guard", f"""WITH {SCORED}, {auc_sql('scored', 'model')}
SELECT model, {_r('auc')} AS auc, auc < 0.5 AS flipped, {_r('greatest(auc, 1 - auc)')} AS auc_guarded FROM auc""")
def q_auc_guard(spark, sf_dir):
    """E5: 1 - AUC when below 0.5."""
    a = M.auc_guard(M.auc(ev_scored(spark, sf_dir)))
    return a.select("model", r6("auc").alias("auc"), "flipped", r6("auc_guarded").alias("auc_guarded"))


@query("roc_area", f"""WITH {SCORED}, {auc_sql('scored', 'model')}
SELECT model, {_r('auc')} AS area FROM auc""")
def q_roc_area(spark, sf_dir):
    """Area under the ROC curve by trapezoids, per model."""
    return M.roc_area(ev_scored(spark, sf_dir)).select("model", r6("area").alias("area"))


@query("roc_curve", f"""WITH {SCORED},
g AS (SELECT model, score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
      FROM scored GROUP BY model, score),
c AS (SELECT model, score, pos, neg,
        sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cpos,
        sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cneg,
        lead(pos) OVER (PARTITION BY model ORDER BY score DESC) AS npos,
        lead(neg) OVER (PARTITION BY model ORDER BY score DESC) AS nneg,
        row_number() OVER (PARTITION BY model ORDER BY score DESC) AS k FROM g),
t AS (SELECT model, sum(pos) AS P, sum(neg) AS N FROM g GROUP BY model)
SELECT model, CAST('inf' AS DOUBLE) AS threshold, {_r('0.0 / nullif(N, 0)')} AS fpr,
       {_r('0.0 / nullif(P, 0)')} AS tpr FROM t
UNION ALL
SELECT c.model, {_r('c.score')}, {_r('CAST(cneg AS DOUBLE) / nullif(N, 0)')},
       {_r('CAST(cpos AS DOUBLE) / nullif(P, 0)')}
FROM c JOIN t USING (model) WHERE k = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg""")
def q_roc_curve(spark, sf_dir):
    """ROC points with collinear points dropped."""
    r = M.roc_curve(ev_scored(spark, sf_dir))
    return r.select("model", F.when(F.col("threshold") == float("inf"), F.col("threshold"))
                    .otherwise(r6("threshold")).alias("threshold"),
                    r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("score_histogram", f"""WITH {SCORED},
st AS (SELECT model, y, min(score) AS mn, max(score) AS mx FROM scored GROUP BY model, y),
st2 AS (SELECT model, y, CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END AS lo,
        CASE WHEN mx = mn THEN mx + 0.5 ELSE mx END AS hi FROM st),
b AS (SELECT s.model, s.y, least(CAST(floor((s.score - lo) * (CAST(50 AS DOUBLE) / (hi - lo))) AS INTEGER), 49) AS bin
      FROM scored s JOIN st2 USING (model, y)),
cnt AS (SELECT model, y, bin, count(*) AS n FROM b GROUP BY model, y, bin),
grid AS (SELECT model, y, lo, hi, CAST(unnest(range(0, 50)) AS INTEGER) AS bin FROM st2)
SELECT g.model, g.y, g.bin, {_r('lo + bin * ((hi - lo) / 50)')} AS bin_lo,
       {_r('lo + (bin + 1) * ((hi - lo) / 50)')} AS bin_hi, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt USING (model, y, bin)""")
def q_score_histogram(spark, sf_dir):
    """50 equal-width bins per class over its own range."""
    h = M.score_histogram(ev_scored(spark, sf_dir))
    return h.select("model", "y", F.col("bin").cast("int").alias("bin"),
                    r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "n")


@query("eval_scenarios", f"""WITH {EVAL_SQL}
SELECT model, scenario, {_r('precision')} AS precision, {_r('recall')} AS recall, {_r('f1')} AS f1,
       {_r('balanced_accuracy')} AS balanced_accuracy, {_r('auc')} AS auc FROM ev_all""")
def q_eval_scenarios(spark, sf_dir):
    """Original and balanced scenario per model in one plan."""
    e = _eval(spark, sf_dir)
    return e.select("model", "scenario", *[r6(c).alias(c) for c in
                                           ("precision", "recall", "f1", "balanced_accuracy", "auc")])


@query("summary_table", f"""WITH {EVAL_SQL}
SELECT model AS "Model", {_r('precision')} AS "Precision", {_r('recall')} AS "Recall",
       {_r('f1')} AS "F1-Score", {_r('balanced_accuracy')} AS "Balanced_Accuracy",
       {_r('auc')} AS "AUC-ROC" FROM ev_all WHERE scenario = 'original'""")
def q_summary_table(spark, sf_dir):
    """One row per model for the original scenario."""
    t = M.summary_table(_eval(spark, sf_dir), "original")
    return t.select("Model", *[r6(c).alias(c) for c in t.columns if c != "Model"])


@query("best_model", f"""WITH {EVAL_SQL},
o AS (SELECT l.*, CASE model WHEN 'value' THEN 1 WHEN 'neg_value' THEN 2 ELSE 3 END AS model_order
      FROM lng l WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY scenario, metric ORDER BY value DESC, model_order) AS rk FROM o)
SELECT scenario, metric, model AS best_model, {_r('value')} AS value FROM r WHERE rk = 1""")
def q_best_model(spark, sf_dir):
    """Best model per (scenario, metric); first in table order on ties."""
    b = M.best_model(_long(spark, sf_dir))
    return b.select("scenario", "metric", "best_model", r6("value").alias("value"))


@query("comparison_bands", f"""WITH {EVAL_SQL}
SELECT model, scenario, metric, {_r('value')} AS value,
       CASE WHEN value < 0.5 THEN 'low' WHEN value < 0.65 THEN 'mid' ELSE 'high' END AS band
FROM lng WHERE value IS NOT NULL""")
def q_comparison_bands(spark, sf_dir):
    """Metric series with chart bands, NULLs skipped."""
    b = M.comparison_bands(_long(spark, sf_dir))
    return b.select("model", "scenario", "metric", r6("value").alias("value"), "band")


@query("model_summary", f"""WITH {SCORED}, c AS ({conf_sql('scored', 'model')}),
{auc_sql('scored', 'model')}
SELECT c.model, {_r(F1)} AS "F1-Score", {_r('a.auc')} AS "AUC-ROC" FROM c LEFT JOIN auc a USING (model)""")
def q_model_summary(spark, sf_dir):
    """One-line evaluation per model."""
    s = M.model_summary(ev_scored(spark, sf_dir))
    return s.select("model", r6("F1-Score").alias("F1-Score"), r6("AUC-ROC").alias("AUC-ROC"))


@query("upsert_results", f"""WITH {EVAL_SQL},
old AS (SELECT model AS "Model", f1, auc FROM ev_all WHERE scenario = 'original'),
new AS (SELECT model AS "Model", f1, auc FROM ev_all WHERE scenario = 'balanced' AND model <> 'value')
SELECT "Model", {_r('f1')} AS f1, {_r('auc')} AS auc FROM (
  SELECT * FROM old WHERE "Model" NOT IN (SELECT "Model" FROM new) UNION ALL SELECT * FROM new)""")
def q_upsert_results(spark, sf_dir):
    """Replace the rows of re-run models in a comparison table."""
    e = _eval(spark, sf_dir)
    old = e.where("scenario = 'original'").select(F.col("model").alias("Model"), "f1", "auc")
    new = e.where("scenario = 'balanced' AND model <> 'value'").select(
        F.col("model").alias("Model"), "f1", "auc")
    u = S.upsert(old, new, "Model")
    return u.select("Model", r6("f1").alias("f1"), r6("auc").alias("auc"))


# ------------------------------------------- min-max and ensemble (EV)

@query("minmax_scores", f"""WITH ev AS ({EV_SQL}),
m AS (SELECT min(value) AS mn, max(value) AS mx, min(-value) AS mn2, max(-value) AS mx2 FROM ev)
SELECT row_id, {_r('(value - mn) / (mx - mn + 1e-8)')} AS s1_norm,
       {_r('(-value - mn2) / (mx2 - mn2 + 1e-8)')} AS s2_norm FROM ev, m""")
def q_minmax_scores(spark, sf_dir):
    """Min-max normalisation with +1e-8 in the denominator."""
    ev = ev_flows(spark, sf_dir).select("row_id", F.col("value").alias("s1"),
                                        (-F.col("value")).alias("s2"))
    n = FE.minmax_normalize(FE.minmax_normalize(ev, "s1", "s1_norm"), "s2", "s2_norm")
    return n.select("row_id", r6("s1_norm").alias("s1_norm"), r6("s2_norm").alias("s2_norm"))


@query("ensemble_or_sum", f"""WITH ev AS ({EV_SQL}),
s AS (SELECT row_id, value AS sa, CAST(user_id % 13 AS DOUBLE) AS sb,
        CAST(value > 245 AS INTEGER) AS pa, CAST(user_id % 13 > 9 AS INTEGER) AS pb FROM ev),
m AS (SELECT min(sa) AS mna, max(sa) AS mxa, min(sb) AS mnb, max(sb) AS mxb FROM s)
SELECT row_id, greatest(pa, pb) AS pred,
       {_r('(sa - mna) / (mxa - mna + 1e-8) + (sb - mnb) / (mxb - mnb + 1e-8)')} AS score FROM s, m""")
def q_ensemble_or_sum(spark, sf_dir):
    """OR of predictions, sum of min-max normalised scores."""
    ev = ev_flows(spark, sf_dir).select(
        "row_id", F.col("value").alias("sa"), (F.col("user_id") % 13).cast("double").alias("sb"),
        (F.col("value") > 245).cast("int").alias("pa"),
        (F.col("user_id") % 13 > 9).cast("int").alias("pb"))
    e = EN.ensemble(ev, ("sa", "pa"), ("sb", "pb"))
    return e.select("row_id", "pred", r6("score").alias("score"))


@query("dense_metric_grid", f"""WITH {EVAL_SQL},
src AS (SELECT model, scenario, f1 FROM ev_all WHERE model <> 'user_mod' OR scenario = 'original'),
g AS (SELECT m.model, s.scenario FROM (SELECT DISTINCT model FROM src) m, (SELECT DISTINCT scenario FROM src) s)
SELECT g.model, g.scenario, {_r('coalesce(src.f1, 0.0)')} AS f1
FROM g LEFT JOIN src USING (model, scenario)""")
def q_dense_metric_grid(spark, sf_dir):
    """Model x scenario F1 grid with a missing cell read as 0."""
    e = _eval(spark, sf_dir)
    g = M.dense_grid(e, "model", "scenario", "f1", where="model <> 'user_mod' OR scenario = 'original'")
    return g.select("model", "scenario", r6("f1").alias("f1"))
