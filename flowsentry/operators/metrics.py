"""Evaluation (E1-E16, C10-C12) over a scored table.

Input is long: one row per (model, row_id) with ``y``, ``score`` (higher =
more anomalous) and ``pred``. Every metric is a grouped aggregate keyed by
``by`` (e.g. model, scenario); AUC and the ROC curve use value-ordered
cumulative sums split into ranges (``functions.ranks``), not one sorted task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.ranks import _by_list, cumulative_by_value
from flowsentry.functions.scalar import safe_div
from flowsentry.session import materialise

METRICS = ["Precision", "Recall", "F1-Score", "Balanced_Accuracy", "AUC-ROC"]


# ------------------------------------------------------------ C10-C12

def pred_from_decision(decision: str = "decision"):
    """A detector's decision < 0 means outlier -> 1, else 0."""
    return (F.col(decision) < 0).cast("int")


def score_from_decision(decision: str = "decision"):
    """C11: flip the sign so that higher = more anomalous."""
    return -F.col(decision)


def default_prediction(score: str = "score", pred: str = "pred"):
    """``pred`` if given, else score > 0.5."""
    return F.coalesce(F.col(pred).cast("int"), (F.col(score) > 0.5).cast("int"))


# ------------------------------------------------------------ E1-E3, E7

def confusion(df: DataFrame, by=("model",), y: str = "y", pred: str = "pred") -> DataFrame:
    """Tn, fp, fn, tp per group (always four numbers)."""
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*_by_list(by)).agg(
        F.count_if(yy & pp).cast("long").alias("tp"),
        F.count_if(~yy & pp).cast("long").alias("fp"),
        F.count_if(yy & ~pp).cast("long").alias("fn"),
        F.count_if(~yy & ~pp).cast("long").alias("tn"))


def with_rates(conf: DataFrame) -> DataFrame:
    """E2, E3, E7 from the counts; 0 on a zero denominator.

    Balanced accuracy averages the recalls of the classes present.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rec_a = F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    rec_n = F.try_divide(tn.cast("double"), (tn + fp).cast("double"))
    bal = F.when(rec_a.isNotNull() & rec_n.isNotNull(), (rec_a + rec_n) / 2) \
           .otherwise(F.coalesce(rec_a, rec_n))
    return conf.select(
        "*",
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        bal.alias("balanced_accuracy"),
        safe_div(tn, tn + fp).alias("recall_normal"),
        safe_div(tp, tp + fn).alias("recall_anomaly"),
        safe_div(tn, tn + fn).alias("precision_normal"),
        safe_div(tp, tp + fp).alias("precision_anomaly"))


def classification_report(conf: DataFrame, by=("model",)) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted avg."""
    by = _by_list(by)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    pa, ra, fa = safe_div(tp, tp + fp), safe_div(tp, tp + fn), safe_div(2 * tp, 2 * tp + fp + fn)
    pn, rn, fnn = safe_div(tn, tn + fn), safe_div(tn, tn + fp), safe_div(2 * tn, 2 * tn + fn + fp)
    sa, sn = tp + fn, tn + fp
    rows = [
        ("Normal", pn, rn, fnn, sn),
        ("Anomaly", pa, ra, fa, sa),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"),
         safe_div(tp + tn, n), n),
        ("macro avg", (pn + pa) / 2, (rn + ra) / 2, (fnn + fa) / 2, n),
        ("weighted avg", safe_div(pn * sn + pa * sa, n), safe_div(rn * sn + ra * sa, n),
         safe_div(fnn * sn + fa * sa, n), n),
    ]
    arr = F.array(*[F.struct(F.lit(k).alias("class"), p.cast("double").alias("precision"),
                             r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                             s.cast("long").alias("support")) for k, p, r, f, s in rows])
    return conf.select(*by, F.explode(arr).alias("_r")).select(*by, "_r.*")


# ------------------------------------------------------------ E4-E6

def score_counts(df: DataFrame, by, y: str = "y", score: str = "score") -> DataFrame:
    """(group, score) -> positives, negatives: the input of AUC and ROC."""
    return df.groupBy(*_by_list(by), score).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum((1 - F.col(y)).cast("long")).alias("neg"))


def auc(df: DataFrame, by=("model",), y: str = "y", score: str = "score",
        ranges: int | None = None) -> DataFrame:
    """Exact ROC AUC with ties: sum pos * (neg below + neg tied / 2) / (P * N).

    NULL when a class is missing in the group.
    """
    by = _by_list(by)
    return _auc_of_counts(score_counts(df, by, y, score), by, score, ranges)


def _auc_of_counts(g: DataFrame, by: list[str], score: str, ranges: int | None) -> DataFrame:
    c = cumulative_by_value(g, by, score, ["neg"], ranges=ranges, inclusive=False)
    term = F.col("pos").cast("double") * (F.col("cum_neg").cast("double")
                                          + F.col("neg").cast("double") / 2.0)
    a = c.groupBy(*by).agg(F.sum(term).alias("_u"), F.sum("pos").alias("_p"),
                           F.sum("neg").alias("_n"))
    return a.select(*by, F.try_divide(F.col("_u"), F.col("_p").cast("double")
                                      * F.col("_n").cast("double")).alias("auc"))


def auc_guard(auc_df: DataFrame, col: str = "auc") -> DataFrame:
    """E5: report 1 - AUC when below 0.5, with a flag."""
    return auc_df.withColumn("flipped", F.col(col) < 0.5) \
                 .withColumn("auc_guarded", F.greatest(F.col(col), 1 - F.col(col)))


def roc_curve(df: DataFrame, by=("model",), y: str = "y", score: str = "score",
              drop_intermediate: bool = True, ranges: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, descending, plus the
    (inf, 0, 0) start. Collinear interior points are dropped like the
    reference's default: point i stays unless the next distinct score adds
    exactly the same (pos, neg) counts as score i did.
    """
    by = _by_list(by)
    g = score_counts(df, by, y, score)
    c = cumulative_by_value(g, by, score, ["pos", "neg"], descending=True, ranges=ranges, keep_range=drop_intermediate)
    tot = g.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    c = c.join(tot, on=by, how="inner") if by else c.crossJoin(F.broadcast(tot))  # without groups: one row
    if drop_intermediate:
        # the next (lower) score's counts: inside a range by lead; after its last row comes the
        # first row of the next range, carried over in a table of one row a range
        counts = F.struct("pos", "neg")
        w = Window.partitionBy(*by, "_rg").orderBy(F.col(score).desc())
        heads = c.groupBy(*by, "_rg").agg(F.max_by(counts, score).alias("_head"))
        heads = heads.select(*by, "_rg", F.lead("_head").over(Window.partitionBy(*by).orderBy("_rg")).alias("_after"))
        c = c.withColumn("_next", F.lead(counts).over(w)).join(heads, [*by, "_rg"]).withColumn(
            "_next", F.coalesce("_next", "_after"))
        first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
        keep = (first | F.col("_next").isNull()
                | (F.col("_next.pos") != F.col("pos")) | (F.col("_next.neg") != F.col("neg")))
        c = c.where(keep)
    pts = c.select(*by, F.col(score).cast("double").alias("threshold"),
                   F.try_divide(F.col("cum_neg").cast("double"), F.col("_N").cast("double")).alias("fpr"),
                   F.try_divide(F.col("cum_pos").cast("double"), F.col("_P").cast("double")).alias("tpr"))
    start = tot.select(*by, F.lit(float("inf")).alias("threshold"),
                       F.try_divide(F.lit(0.0), F.col("_N").cast("double")).alias("fpr"),
                       F.try_divide(F.lit(0.0), F.col("_P").cast("double")).alias("tpr"))
    return start.unionByName(pts)


def roc_area(df: DataFrame, by=("model",), y: str = "y", score: str = "score",
             ranges: int | None = None) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule over its points (equals E4). The
    step of a distinct score needs its own counts and the running ones alone, so it is
    range-split like the curve; points that the curve leaves out are collinear."""
    by = _by_list(by)
    c = cumulative_by_value(score_counts(df, by, y, score), by, score, ["pos"], descending=True, ranges=ranges)
    step = F.col("neg").cast("double") * (2 * F.col("cum_pos") - F.col("pos")).cast("double") / 2.0
    a = c.groupBy(*by).agg(F.sum(step).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return a.select(*by, F.try_divide(F.col("_u"), F.col("_p").cast("double") * F.col("_n").cast("double")).alias("area"))


# ------------------------------------------------------------ E9

def score_histogram(df: DataFrame, by=("model",), y: str = "y", score: str = "score",
                    bins: int = 50) -> DataFrame:
    """Equal-width histogram per class over that class's own range.

    All ``bins`` bins are emitted (empty ones with 0); the maximum falls in
    the last bin; a constant class puts everything in the middle bin.
    """
    by = _by_list(by) + [y]
    st = df.groupBy(*by).agg(F.min(score).alias("_mn"), F.max(score).alias("_mx"))
    lo = F.when(F.col("_mx") == F.col("_mn"), F.col("_mn") - 0.5).otherwise(F.col("_mn"))
    hi = F.when(F.col("_mx") == F.col("_mn"), F.col("_mx") + 0.5).otherwise(F.col("_mx"))
    st = st.select(*by, lo.alias("_lo"), hi.alias("_hi"))
    j = df.select(*by, score).join(st, by)
    b = F.least(F.floor((F.col(score) - F.col("_lo")) * (F.lit(float(bins)) / (F.col("_hi") - F.col("_lo"))))
                .cast("int"), F.lit(bins - 1))
    cnt = j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = st.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (grid.join(cnt, on=by + ["bin"], how="left")
                .select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
                        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


# ------------------------------------------------------------ E10-E16

def scenario_rows(scored: DataFrame, flag: str = "in_balanced") -> DataFrame:
    """E10/E11 fan-out: every row is in 'original'; flagged rows also in 'balanced'."""
    sc = F.when(F.col(flag) == 1, F.array(F.lit("original"), F.lit("balanced"))) \
          .otherwise(F.array(F.lit("original")))
    return scored.withColumn("scenario", F.explode(sc))


def evaluate(scored: DataFrame, by=("model",), y: str = "y", score: str | None = "score",
             pred: str = "pred", ranges: int | None = None) -> DataFrame:
    """Precision, recall, F1, balanced accuracy and AUC per group.

    AUC is NULL when there are no scores (``score=None``) or a class is missing.
    """
    by = _by_list(by)
    if score is None:
        return with_rates(confusion(scored, by, y, pred)).withColumn("auc", F.lit(None).cast("double"))
    # one table of counts feeds everything: the scored rows are read once
    one = F.col(y) == 1
    t = scored.groupBy(*by, F.col(score).alias("_s"), (F.col(pred) == 1).alias("_f")).agg(
        F.count_if(one).cast("long").alias("pos"), F.count_if(~one).cast("long").alias("neg"))
    t = materialise(t, "score-counts")
    of = lambda flag, n: F.coalesce(F.sum(F.when(F.col("_f") == flag, F.col(n))), F.lit(0)).cast("long")
    r = with_rates(t.groupBy(*by).agg(of(True, "pos").alias("tp"), of(True, "neg").alias("fp"),
                                      of(False, "pos").alias("fn"), of(False, "neg").alias("tn")))
    a = _auc_of_counts(t.where(F.col("_s").isNotNull()).groupBy(*by, F.col("_s").alias(score)).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), by, score, ranges)
    return r.join(a, on=by, how="left") if by else r.crossJoin(a)


def metrics_long(ev: DataFrame, by=("model", "scenario")) -> DataFrame:
    """Evaluation rows -> (group..., metric, value) with the reference's names."""
    by = _by_list(by)
    pairs = [("Precision", "precision"), ("Recall", "recall"), ("F1-Score", "f1"),
             ("Balanced_Accuracy", "balanced_accuracy"), ("AUC-ROC", "auc")]
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"))
                    for m, c in pairs])
    return ev.select(*by, F.explode(arr).alias("_m")).select(*by, "_m.*")


def summary_table(ev: DataFrame, scenario: str) -> DataFrame:
    """One row per model for a scenario, metrics as columns."""
    return (ev.where(F.col("scenario") == scenario)
              .select(F.col("model").alias("Model"),
                      F.col("precision").alias("Precision"), F.col("recall").alias("Recall"),
                      F.col("f1").alias("F1-Score"),
                      F.col("balanced_accuracy").alias("Balanced_Accuracy"),
                      F.col("auc").alias("AUC-ROC")))


def best_model(long: DataFrame, order: str = "model_order") -> DataFrame:
    """Model with the highest value per (scenario, metric); the first
    model in table order wins ties; NULL values never win."""
    w = Window.partitionBy("scenario", "metric").orderBy(F.desc("value"), F.asc(order))
    return (long.where(F.col("value").isNotNull())
                .withColumn("_r", F.row_number().over(w)).where("_r = 1")
                .select("scenario", "metric", F.col("model").alias("best_model"), "value"))


def comparison_bands(long: DataFrame) -> DataFrame:
    """Non-null metric values with the chart's band (<0.5, <0.65, else)."""
    v = F.col("value")
    return long.where(v.isNotNull()).withColumn(
        "band", F.when(v < 0.5, "low").when(v < 0.65, "mid").otherwise("high"))


def model_summary(scored: DataFrame, by=("model",), y: str = "y", score: str | None = "score",
                  pred: str = "pred") -> DataFrame:
    """One line per model: F1 and AUC (NULL without scores)."""
    ev = evaluate(scored, by, y, score, pred)
    return ev.select(*_by_list(by), F.col("f1").alias("F1-Score"), F.col("auc").alias("AUC-ROC"))


def dense_grid(long: DataFrame, row: str, col: str, value: str, where=None) -> DataFrame:
    """Every (row, col) pair of the distinct values present; a missing
    cell reads 0 (the chart's lookup). Both key lists are small (models,
    scenarios), so the cross product is bounded by them."""
    src = long if where is None else long.where(where)
    rows = src.select(row).distinct()
    cols = src.select(col).distinct()
    grid = rows.crossJoin(F.broadcast(cols))
    return (grid.join(src.select(row, col, value), [row, col], "left")
                .select(row, col, F.coalesce(F.col(value), F.lit(0.0)).alias(value)))
