"""End-to-end plans: preprocessing (entry 1), the flagship slice and the full
six-model experiment (T13, T14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions.ranks import exact_quantile_values, join_large
from flowsentry.operators import cleaning as C
from flowsentry.operators import ensemble as EN
from flowsentry.operators import features as FE
from flowsentry.operators import metrics as M
from flowsentry.operators import sampling as P
from flowsentry.operators.detectors import autoencoder as AE
from flowsentry.operators.detectors import iforest as IF
from flowsentry.operators.detectors import lof as LOF
from flowsentry.operators.detectors import ocsvm as OC
from flowsentry.plans.fixtures import EM_FEATURES, LI_FEATURES, em_flows, li_flows, once
from flowsentry.session import concurrently, materialise

MODEL_ORDER = ["Isolation Forest", "One-Class SVM", "Local Outlier Factor", "Autoencoder",
               "Second Autoencoder", "Ensemble Autoencoder"]


def preprocess(df: DataFrame, features: list[str] | None = None, y: str = "y", label: str | None = None,
               sample_frac: float | None = None, seed: int = 42, fit_scope: str = "train",
               partitions: int | None = None) -> tuple[DataFrame, FE.ScalerModel]:
    """Entry 1: clean -> (stratified sample) -> 70/15/15 split -> feature selection -> scale.

    Without ``features``, they are the numeric columns that vary: in the train
    split, or in the whole sample with ``fit_scope="all"`` (as the reference
    does, which lets the test rows decide). Returns one table (row_id, y,
    split, scaled features), in ``partitions`` parts by row_id if given, and
    the fitted scaler. Write it with ``sources.files.write_splits``.
    """
    x = C.clean(df)
    if sample_frac is not None:
        x = P.stratified_sample(x, label or y, sample_frac, seed)
    x = P.stratified_split(x, y, seed=seed)
    if features is None:
        other = {"row_id", y, "split", label}
        scope = x if fit_scope == "all" else x.where("split = 'train'")
        numeric, _ = C.select_features(scope.select(*[c for c in x.columns if c not in other]))
        features = list(numeric.columns)
    z, scaler = FE.standardize(x.select("row_id", y, "split", *features), features)
    return (z.repartition(partitions, "row_id") if partitions else z), scaler


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: LI -> clean -> split -> scale -> isolation forest ->
    contamination threshold -> evaluation on the original and balanced test set."""
    z, _ = preprocess(li_flows(spark, sf_dir), LI_FEATURES, partitions=spark.sparkContext.defaultParallelism)
    z = z.cache()
    m = IF.fit_iforest(z.where("split = 'train'"), LI_FEATURES, n_trees=100, contamination=0.2)
    test = P.balanced_flag(z.where("split = 'test'"))
    s = m.transform(test, keep=("row_id", "y", "in_balanced")).withColumn("model", F.lit("Isolation Forest"))
    return M.evaluate(M.scenario_rows(s.cache()), ["model", "scenario"])


def run_experiment(z: DataFrame, features: list[str], ae_epochs: int = 100,
                   ocsvm_rows: int | None = None, lof_rows: int | None = None) -> dict:
    """Six detectors on a scaled split table -> scored long table,
    evaluation per (model, scenario), summary tables, loss curves.

    LOF trains on the normal rows. ``ocsvm_rows`` and ``lof_rows`` ask for
    training samples of that size; all rows are used without.
    """
    spark = z.sparkSession
    train, val = z.where("split = 'train'"), z.where("split = 'val'")
    test = P.balanced_flag(z.where("split = 'test'")).cache()
    keep = ("row_id", "y", "in_balanced")
    normal, anomal = train.where("y = 0"), train.where("y = 1")

    def svm():
        rows = train if ocsvm_rows is None else P.stratified_subsample(train, ocsvm_rows)
        return OC.fit_ocsvm(rows, features, "rbf", "auto", 0.2)

    def lof():
        return LOF.fit_lof(normal if lof_rows is None else P.random_rows(normal, lof_rows), features, 20, 0.2)

    def autoencoder(y, share):
        """Trained on class ``y``; its threshold is a percentile of the validation rows' errors."""
        m = AE.fit_autoencoder(normal if y == 0 else anomal, val.where(F.col("y") == y), features, max_epochs=ae_epochs)
        return m, exact_quantile_values(m.reconstruction_error(val), "mse", [share])[(share,)]

    m_if, m_oc, m_lof, (ae1, t1), (ae2, t2) = concurrently(
        spark, lambda: IF.fit_iforest(train, features, 100, contamination=0.2), svm, lof,
        lambda: autoencoder(0, 0.8), lambda: autoencoder(1, 0.2))
    scored = [m.transform(test, keep).select(*keep, "score", "pred").withColumn("model", F.lit(name))
              for name, m in zip(MODEL_ORDER, (m_if, m_oc, m_lof), strict=False)]
    e1 = ae1.reconstruction_error(test, keep).withColumn("s1", F.col("mse")) \
            .withColumn("p1", (F.col("mse") > t1).cast("int"))
    e2 = ae2.reconstruction_error(test, ("row_id",)).withColumn("s2", -F.col("mse")) \
            .withColumn("p2", (F.col("mse") < t2).cast("int")).drop("mse")
    both = join_large(e1.drop("mse"), e2, "row_id")  # same test rows, one row each
    scored.append(both.select(*keep, F.col("s1").alias("score"), F.col("p1").alias("pred"))
                  .withColumn("model", F.lit(MODEL_ORDER[3])))
    scored.append(both.select(*keep, F.col("s2").alias("score"), F.col("p2").alias("pred"))
                  .withColumn("model", F.lit(MODEL_ORDER[4])))
    ens = EN.ensemble(both, ("s1", "p1"), ("s2", "p2"))
    scored.append(ens.select(*keep, "score", "pred").withColumn("model", F.lit(MODEL_ORDER[5])))

    cols = ["model", "row_id", "y", "in_balanced", "score", "pred"]
    long = materialise(reduce(lambda a, b: a.unionByName(b), [s.select(*cols) for s in scored]), "experiment-scores")
    ev = M.evaluate(M.scenario_rows(long), ["model", "scenario"])
    per_class = M.with_rates(M.confusion(long, ["model"]))
    losses = (ae1.history_df(spark).withColumn("model", F.lit(MODEL_ORDER[3]))
              .unionByName(ae2.history_df(spark).withColumn("model", F.lit(MODEL_ORDER[4]))))
    return {"scored": long, "evaluation": ev, "per_class": per_class, "loss_curves": losses,
            "summary_original": M.summary_table(ev, "original"),
            "summary_balanced": M.summary_table(ev, "balanced")}


def best_performers(ev: DataFrame) -> DataFrame:
    """E14 over the experiment's evaluation (table order = MODEL_ORDER)."""
    om = F.create_map(*[x for i, m in enumerate(MODEL_ORDER) for x in (F.lit(m), F.lit(i))])
    return M.best_model(M.metrics_long(ev).withColumn("model_order", om[F.col("model")]))


def em_experiment(spark: SparkSession, sf_dir: str) -> dict:
    """The six models on EM."""
    return once(spark, sf_dir, "experiment", lambda: run_experiment(
        preprocess(em_flows(spark, sf_dir), EM_FEATURES)[0].cache(), EM_FEATURES))
