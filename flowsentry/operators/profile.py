"""Profiling tables behind the reference's charts.

All outputs are long tables; every statistic is one grouped aggregate over
the data, never a driver-side loop over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.scalar import is_numeric
from flowsentry.operators.cleaning import column_variances
from flowsentry.session import materialise


def top_variance_features(df: DataFrame, features: list[str], k: int = 15) -> DataFrame:
    """the k highest-variance features; ties keep column order."""
    v = column_variances(df, features)
    return v.orderBy(F.desc("variance"), F.asc("ordinal")).limit(k)


def correlation_lower(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of each pair below the diagonal, one aggregate."""
    pairs = [(i, j) for i in range(len(features)) for j in range(len(features)) if i > j]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_i string, feature_j string, corr double")
    wide = df.agg(*[F.corr(F.col(features[i]).cast("double"), F.col(features[j]).cast("double"))
                    .alias(f"c{i}_{j}") for i, j in pairs])
    stack = ", ".join(f"'{features[i]}', '{features[j]}', `c{i}_{j}`" for i, j in pairs)
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) as (feature_i, feature_j, corr)")


BOX_PROBS = (0.25, 0.5, 0.75)
SKETCH = 10_000  # accuracy of the sketches: ranks are right to a share of 1 / SKETCH


def box_stats(df: DataFrame, features: list[str], cls: str = "y") -> DataFrame:
    """per class and feature: quartiles, 1.5*IQR whiskers, outlier count. NULL and NaN are
    left out.

    Quartiles are exact (linear interpolation). A first aggregate over the wide table keeps
    a sketch for each class and feature, whose values a little below and above a
    quartile bracket it; a second counts what lies below each bracket; of the rows themselves
    only values inside a bracket are taken apart, about 6 in ``SKETCH``. The fences make a
    last aggregate. Nothing is persisted and no row is copied for each of its features.
    """
    clean = df.select(F.col(cls).alias("cls"), *(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f"v{i}")
                                                for i, f in enumerate(features)))
    each = range(len(features))
    share = [x for p in BOX_PROBS for x in (max(0.0, p - 2 / SKETCH), min(1.0, p + 2 / SKETCH))]
    sketch = clean.groupBy("cls").agg(*(F.count(f"v{i}").alias(f"n{i}") for i in each), *(
        F.percentile_approx(f"v{i}", share, SKETCH).alias(f"s{i}") for i in each))
    # a row a class: counts and brackets, the features one after the other
    sketch = materialise(sketch, "box-sketches").withColumnRenamed("cls", "_c")
    known = clean.join(F.broadcast(sketch), F.col("cls").eqNullSafe(F.col("_c"))).drop("_c")  # as many rows as classes
    slots = [(i, j) for i in each for j in range(len(BOX_PROBS))]
    lo, hi = (lambda i, j: F.col(f"s{i}")[2 * j]), (lambda i, j: F.col(f"s{i}")[2 * j + 1])
    # what lies below a bracket, and the values next to it (few rows: a quartile may need them)
    edges = F.array(*(F.struct(F.lit(i).alias("f"), F.lit(j).alias("q"), F.first(f"n{i}").alias("n"),
                               F.count_if(F.col(f"v{i}") < lo(i, j)).alias("below"),
                               F.max(F.when(F.col(f"v{i}") < lo(i, j), F.col(f"v{i}"))).alias("prev"),
                               F.min(F.when(F.col(f"v{i}") > hi(i, j), F.col(f"v{i}"))).alias("next")) for i, j in slots))
    below = known.groupBy("cls").agg(edges.alias("e")).select("cls", F.explode("e").alias("x")).select("cls", "x.*")
    inside = F.filter(F.array(*(F.when((F.col(f"v{i}") >= lo(i, j)) & (F.col(f"v{i}") <= hi(i, j)), F.struct(
        F.lit(i).alias("f"), F.lit(j).alias("q"), F.col(f"v{i}").alias("v"))) for i, j in slots)), lambda x: x.isNotNull())
    values = known.select("cls", F.explode(inside).alias("x")).groupBy("cls", "x.f", "x.q", "x.v").agg(F.count(F.lit(1)).alias("m"))
    values = values.withColumnRenamed("cls", "_c").withColumnsRenamed({"f": "_f", "q": "_q"})
    same = F.col("cls").eqNullSafe(F.col("_c")) & (F.col("f") == F.col("_f")) & (F.col("q") == F.col("_q"))
    w = Window.partitionBy("cls", "f", "q").orderBy("v")  # the different values of a bracket
    got = values.join(F.broadcast(below), same).withColumn("upto", F.col("below") + F.sum("m").over(w))  # class x feature x quartile
    place = F.element_at(F.array(*(F.lit(p) for p in BOX_PROBS)), F.col("q") + 1) * (F.col("n") - 1)
    at = lambda k: F.when(F.first(k) < F.first("below"), F.first("prev")).otherwise(
        F.coalesce(F.min(F.when(F.col("upto") > k, F.col("v"))), F.first("next")))
    got = got.withColumn("k", F.floor(place)).withColumn("part", place - F.col("k")).groupBy("cls", "f", "q").agg(
        at(F.col("k")).alias("a"), at(F.least(F.col("k") + 1, F.col("n") - 1)).alias("b"), F.first("part").alias("part"))
    quart = F.max(F.when(F.col("q") == 0, F.col("x"))), F.max(F.when(F.col("q") == 1, F.col("x"))), F.max(F.when(F.col("q") == 2, F.col("x")))
    qw = got.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).groupBy("cls", "f").agg(
        *(e.alias(n) for e, n in zip(quart, ("q1", "median", "q3"), strict=True)))
    qw = materialise(qw.withColumn("iqr", F.col("q3") - F.col("q1")), "box-quartiles")
    fences = qw.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct(
        (F.col("q1") - 1.5 * F.col("iqr")).alias("lo"), (F.col("q3") + 1.5 * F.col("iqr")).alias("hi"))))).alias("fence"))
    fenced = clean.join(F.broadcast(fences.withColumnRenamed("cls", "_c")), F.col("cls").eqNullSafe(F.col("_c")))
    fence = lambda i, side: F.col("fence")[F.lit(i)][side]
    ends = fenced.groupBy("cls").agg(*(F.struct(
        F.lit(i).alias("f"), F.min(F.when(F.col(f"v{i}") >= fence(i, "lo"), F.col(f"v{i}"))).alias("whisker_lo"),
        F.max(F.when(F.col(f"v{i}") <= fence(i, "hi"), F.col(f"v{i}"))).alias("whisker_hi"),
        F.count_if((F.col(f"v{i}") < fence(i, "lo")) | (F.col(f"v{i}") > fence(i, "hi"))).alias("n_outliers"),
        F.count(f"v{i}").alias("n")).alias(f"e{i}") for i in each))
    ends = ends.select(F.col("cls").alias("_c"), F.explode(F.array(*(f"e{i}" for i in each))).alias("e")).select("_c", "e.*")
    ends = ends.withColumnRenamed("f", "_f")
    names = F.array(*(F.lit(f) for f in features))
    return qw.join(ends, F.col("cls").eqNullSafe(F.col("_c")) & (F.col("f") == F.col("_f"))).select(
        "cls", F.element_at(names, F.col("f") + 1).alias("feature"), "q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi", "n_outliers", "n")


def class_distribution(df: DataFrame, split: str = "split", y: str = "y") -> DataFrame:
    """F8: rows per (split, class)."""
    return df.groupBy(split, y).agg(F.count(F.lit(1)).alias("n"))


def split_proportions(df: DataFrame, split: str = "split") -> DataFrame:
    """rows and percent of total per split."""
    c = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("_t"))
    return (c.crossJoin(F.broadcast(tot))
             .withColumn("pct", F.col("n") * 100.0 / F.col("_t")).drop("_t"))


def class_prior(df: DataFrame, y: str = "y") -> DataFrame:
    """class counts and the anomaly prior in percent."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).cast("long").alias("n_normal"),
                  F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("n_anomaly"),
                  (F.avg(F.col(y).cast("double")) * 100.0).alias("prior_pct"))


def feature_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """name, kind, count, NULLs, min, max per column in one aggregate."""
    cols = cols or df.columns
    kinds = {f.name: ("numeric" if is_numeric(f.dataType) else "other") for f in df.schema.fields}
    aggs = []
    for c in cols:
        aggs += [F.count(F.col(c)).alias(f"n:{c}"), F.count_if(F.col(c).isNull()).alias(f"z:{c}")]
        if kinds[c] == "numeric":
            aggs += [F.min(F.col(c).cast("double")).alias(f"lo:{c}"),
                     F.max(F.col(c).cast("double")).alias(f"hi:{c}")]
        else:
            aggs += [F.lit(None).cast("double").alias(f"lo:{c}"),
                     F.lit(None).cast("double").alias(f"hi:{c}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', '{kinds[c]}', `n:{c}`, `z:{c}`, `lo:{c}`, `hi:{c}`" for c in cols)
    return wide.selectExpr(
        f"stack({len(cols)}, {stack}) as (feature, kind, n, n_null, min_value, max_value)")
