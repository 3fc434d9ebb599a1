"""Registered queries: sources, cleaning, selection, statistics, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.functions.ranks import exact_quantile_values
from flowsentry.functions.scalar import r6
from flowsentry.operators import cleaning as C
from flowsentry.operators import features as FE
from flowsentry.operators import profile as PR
from flowsentry.operators import sampling as P
from flowsentry.plans import sqlgen as G
from flowsentry.plans.fixtures import (EM_FEATURES, EM_SQL, EV_SQL, LI_FEATURES, LI_SQL,
                                       em_flows, ev_flows, li_flows, table)
from flowsentry.plans.registry import query
from flowsentry.session import materialise, scratch_path
from flowsentry.sources import files as S


def _r(c: str, places: int = 6) -> str:
    return f"round({c}, {places}) + 0.0"


LI_COLS = "row_id, label, y, " + ", ".join(LI_FEATURES)


# ------------------------------------------------------------- sources

@query("csv_scan_roundtrip", f"""WITH li AS ({LI_SQL})
SELECT {LI_COLS}, CASE WHEN y = 1 THEN 1 ELSE NULL END AS extra FROM li""")
def q_csv_scan_roundtrip(spark, sf_dir):
    """Two CSV files with padded headers, different column order and an
    extra column, read back by header group and unioned by name."""
    li = li_flows(spark, sf_dir)
    base = scratch_path(spark, "csv")
    cols = ["row_id", "label", "y"] + LI_FEATURES
    a = li.where("y = 0").select(*cols)
    b = li.where("y = 1").select(*reversed(cols)).withColumn("extra", F.lit(1))
    a.toDF(*[f"  {c} " for c in a.columns]).write.option("header", "true").csv(f"{base}/part_a")
    b.toDF(*[f" {c}" for c in b.columns]).write.option("header", "true").csv(f"{base}/part_b")
    return S.read_flow_csv(spark, base).select(*cols, "extra")


@query("padded_labels", f"""WITH li AS ({LI_SQL})
SELECT row_id, CASE WHEN y = 1 THEN concat(' ', label, ' ') ELSE label END AS label, l_quantity FROM li""")
def q_padded_labels(spark, sf_dir):
    """Blanks around label values survive the CSV scan, those around numbers don't matter."""
    li = li_flows(spark, sf_dir)
    path = scratch_path(spark, "padded")
    label = F.when(F.col("y") == 1, F.concat(F.lit(" "), "label", F.lit(" "))).otherwise(F.col("label"))
    number = F.concat(F.lit("  "), F.col("l_quantity").cast("string"), F.lit(" "))
    (li.select("row_id", label.alias(" label "), number.alias(" l_quantity"))
     .write.option("header", "true").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").csv(path))
    return S.read_flow_csv(spark, path)


@query("result_sink_roundtrip", f"""WITH ev AS ({EV_SQL})
SELECT event_type, count(*) AS n, {_r('avg(value)')} AS mean_value, 'csv' AS sink FROM ev GROUP BY event_type
UNION ALL SELECT event_type, count(*), {_r('avg(value)')}, 'parquet' FROM ev GROUP BY event_type""")
def q_result_sink_roundtrip(spark, sf_dir):
    """A result table written by both sinks and read back."""
    res = ev_flows(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value"))
    base = scratch_path(spark, "results")
    S.write_table(res, f"{base}/csv", "csv")
    S.write_table(res, f"{base}/parquet")
    a = S.read_flow_csv(spark, f"{base}/csv", schema=res.schema)
    b = spark.read.parquet(f"{base}/parquet")
    return a.withColumn("sink", F.lit("csv")).unionByName(b.withColumn("sink", F.lit("parquet")))


@query("sample_fallback", f"""WITH li AS ({LI_SQL}),
r AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat('42:', row_id)), row_id) AS rn, count(*) OVER () AS n FROM li)
SELECT row_id FROM r WHERE rn <= CAST(round_even(0.2 * n, 0) AS BIGINT)""")
def q_sample_fallback(spark, sf_dir):
    """A class with a single row can't be stratified; a plain sample is drawn."""
    li = li_flows(spark, sf_dir)
    only = li.agg(F.min("row_id")).first()[0]
    one = li.withColumn("label", F.when(F.col("row_id") == only, "single").otherwise(F.col("label")))
    return P.stratified_sample(one, "label", 0.2).select("row_id")


@query("split_roundtrip", f"""WITH li AS ({LI_SQL}),
{G.split_ctes('li')}
SELECT row_id, y, split, {', '.join(LI_FEATURES)} FROM splitted WHERE split = 'test'""")
def q_split_roundtrip(spark, sf_dir):
    """S4+S5: write one split table partitioned by split, read 'test' back."""
    li = P.stratified_split(li_flows(spark, sf_dir))
    path = scratch_path(spark, "splits")
    S.write_splits(li.select("row_id", "y", "split", *LI_FEATURES), path)
    return S.read_split(spark, path, "test")


@query("labelled_join", f"""WITH li AS ({LI_SQL}) SELECT row_id, y, {', '.join(LI_FEATURES)} FROM li""")
def q_labelled_join(spark, sf_dir):
    """Features and labels stored apart, joined back on row_id."""
    li = li_flows(spark, sf_dir)
    base = scratch_path(spark, "xy")
    li.select("row_id", *LI_FEATURES).write.parquet(f"{base}/X")
    li.select("row_id", F.col("y").alias("Is_Anomaly")).write.parquet(f"{base}/y")
    x = spark.read.parquet(f"{base}/X")
    y = S.label_column(spark.read.parquet(f"{base}/y"), key="row_id")
    return x.join(y, "row_id").select("row_id", F.col("Is_Anomaly").alias("y"), *LI_FEATURES)


@query("union_by_name", """SELECT 'supplier' AS source, s_suppkey AS key, s_name AS name,
       s_nationkey AS nationkey, s_acctbal AS acctbal, NULL::VARCHAR AS mktsegment FROM supplier
UNION ALL SELECT 'customer', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_union_by_name(spark, sf_dir):
    """S3: two sources with different columns aligned by name."""
    s = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("source"), F.col("s_suppkey").alias("key"),
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("acctbal"))
    c = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("mktsegment"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"),
        F.col("c_custkey").alias("key"), F.lit("customer").alias("source"))
    return S.union_by_name([s, c])


# ------------------------------------------------------------ cleaning

@query("clean_flows", f"""WITH ev AS ({EV_SQL})
SELECT * FROM ev WHERE rate IS NOT NULL AND NOT isnan(rate) AND NOT isinf(rate)
  AND row_id IS NOT NULL AND event_id IS NOT NULL AND user_id IS NOT NULL
  AND event_type IS NOT NULL AND value IS NOT NULL AND y IS NOT NULL""")
def q_clean_flows(spark, sf_dir):
    """C1+C2: Inf -> NaN -> dropped, like every NULL."""
    return C.clean(ev_flows(spark, sf_dir))


_EV_COLS = ["row_id", "event_id", "user_id", "event_type", "value", "rate", "y"]
_EV_BAD = {c: (f"{c} IS NULL OR isnan({c}) OR isinf({c})" if c in ("value", "rate")
               else f"{c} IS NULL") for c in _EV_COLS}


@query("clean_report", f"""WITH ev AS ({EV_SQL}),
a AS (SELECT count(*) AS rows_in,
        count(*) FILTER (WHERE {' OR '.join('(' + e + ')' for e in _EV_BAD.values())}) AS rows_dropped,
        {', '.join(f'count(*) FILTER (WHERE {e}) AS "bad:{c}"' for c, e in _EV_BAD.items())}
      FROM ev)
SELECT metric, CAST(value AS BIGINT) AS value FROM (
  SELECT 'rows_in' AS metric, rows_in AS value FROM a
  UNION ALL SELECT 'rows_out', rows_in - rows_dropped FROM a
  UNION ALL SELECT 'rows_dropped', rows_dropped FROM a
  {' '.join(f"UNION ALL SELECT 'bad:{c}', " + chr(34) + f"bad:{c}" + chr(34) + " FROM a" for c in _EV_COLS)})""")
def q_clean_report(spark, sf_dir):
    """Counts before/after and per column, one pass."""
    return C.clean_report(ev_flows(spark, sf_dir).select(*_EV_COLS))


@query("label_encode", f"""WITH li AS ({LI_SQL})
SELECT row_id, label, CASE WHEN label = 'NO' THEN 0 ELSE 1 END AS is_anomaly FROM li""")
def q_label_encode(spark, sf_dir):
    """C4: exactly the normal label -> 0, anything else -> 1."""
    return C.encode_label(li_flows(spark, sf_dir), "label", normal="NO", out="is_anomaly") \
            .select("row_id", "label", "is_anomaly")


@query("class_filter", f"""WITH li AS ({LI_SQL}) SELECT row_id, label FROM li WHERE y = 1""")
def q_class_filter(spark, sf_dir):
    """Anomalies only."""
    return C.class_filter(li_flows(spark, sf_dir), 1).select("row_id", "label")


_VAR_COLS = LI_FEATURES + ["const_d", "const_i"]


@query("zero_variance_columns", f"""WITH li AS ({LI_SQL}),
x AS (SELECT *, CAST(1.5 AS DOUBLE) AS const_d, 7 AS const_i FROM li),
v AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, var_samp(CAST({c} AS DOUBLE)) AS variance FROM x" for c in _VAR_COLS)})
SELECT feature, {_r('variance', 2)} AS variance, variance = 0 AS is_constant FROM v""")
def q_zero_variance_columns(spark, sf_dir):
    """Sample variance per numeric column; exactly 0 -> constant."""
    x = li_flows(spark, sf_dir).withColumn("const_d", F.lit(1.5)).withColumn("const_i", F.lit(7))
    v = C.column_variances(x, _VAR_COLS)
    return v.select("feature", r6("variance", 2).alias("variance"),
                    (F.col("variance") == 0).alias("is_constant"))


@query("feature_select", f"""WITH li AS ({LI_SQL})
SELECT row_id, y, {', '.join(LI_FEATURES)} FROM li""")
def q_feature_select(spark, sf_dir):
    """C5+C6+C7: drop the label text, constant and non-numeric columns."""
    x = (li_flows(spark, sf_dir).withColumn("const_d", F.lit(1.5))
         .withColumn("const_i", F.lit(7)).withColumn("note", F.lit("x")))
    out, _ = C.select_features(x, keep=("row_id", "y"), drop=("label",))
    return out


# ------------------------------------------------------ standardisation

def _li_std_sql(extra: str = "") -> str:
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                      for c in LI_FEATURES)
    z = ", ".join(f"(CAST(s.{c} AS DOUBLE) - st.m_{c}) / (CASE WHEN st.s_{c} = 0 THEN 1 ELSE st.s_{c} END) AS {c}"
                  for c in LI_FEATURES)
    return f"""li AS ({LI_SQL}),
{G.split_ctes('li')},
st AS (SELECT {stats} FROM splitted WHERE split = 'train'),
std AS (SELECT s.row_id, s.y, s.split, {z} FROM splitted s, st){extra}"""


@query("standardize", f"""WITH {_li_std_sql()}
SELECT row_id, split, {', '.join(_r(c) + ' AS ' + c for c in LI_FEATURES)} FROM std""")
def q_standardize(spark, sf_dir):
    """mean / population std fitted on train, applied to all splits."""
    li = P.stratified_split(li_flows(spark, sf_dir))
    z, _ = FE.standardize(li, LI_FEATURES)
    return z.select("row_id", "split", *[r6(c).alias(c) for c in LI_FEATURES])


def _fold_scaling_sql() -> str:
    per = []
    for f in range(3):
        per.append(f"SELECT {f + 1} AS fold, " + ", ".join(
            f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LI_FEATURES)
            + f" FROM folded WHERE fold <> {f}")
    n = len(LI_FEATURES)
    mean_of_means = "(" + " + ".join(f"m_{c}" for c in LI_FEATURES) + f") / {n}"
    mean_of_stds = "(" + " + ".join(f"s_{c}" for c in LI_FEATURES) + f") / {n}"
    max_abs = "greatest(" + ", ".join(f"abs(m_{c})" for c in LI_FEATURES) + ")"
    max_std = "greatest(" + ", ".join(f"s_{c}" for c in LI_FEATURES) + ")"
    return f"""WITH {_li_std_sql()},
tr AS (SELECT * FROM std WHERE split = 'train'),
{G.kfold_ctes('tr', 3)},
per AS ({' UNION ALL '.join(per)})
SELECT fold, {_r(mean_of_means)} AS global_mean_of_means, {_r(mean_of_stds)} AS global_mean_of_stds,
       {_r(max_abs)} AS max_abs_mean, {_r(max_std)} AS max_abs_std FROM per"""


@query("fold_scaling", _fold_scaling_sql())
def q_fold_scaling(spark, sf_dir):
    """per training fold scaler statistics of the standardised train split."""
    # read three times, and the filter on split would take the row's hash apart into its every comparison
    li = materialise(P.stratified_split(li_flows(spark, sf_dir)).select("row_id", "y", "split", *LI_FEATURES), "split")
    z, _ = FE.standardize(li, LI_FEATURES)
    folded = P.kfold_assign(z.where("split = 'train'"), 3)
    st = FE.fold_scaling(folded, LI_FEATURES)
    return st.select("fold", *[r6(c).alias(c) for c in st.columns if c != "fold"])


@query("fold_scaling_verdict", f"""WITH st_ AS ({_fold_scaling_sql()})
SELECT {_r('max(global_mean_of_means) - min(global_mean_of_means)')} AS mean_range,
  {_r('max(global_mean_of_stds) - min(global_mean_of_stds)')} AS std_range,
  max(global_mean_of_means) - min(global_mean_of_means) < 0.01
  AND max(global_mean_of_stds) - min(global_mean_of_stds) < 0.01 AS negligible FROM st_""")
def q_fold_scaling_verdict(spark, sf_dir):
    """whether scaling per fold differs from scaling once by a negligible amount."""
    v = FE.fold_scaling_verdict(q_fold_scaling(spark, sf_dir))
    return v.select(r6("mean_range").alias("mean_range"), r6("std_range").alias("std_range"), "negligible")


# ------------------------------------------------------------ profiling

_EM_VAR_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS ordinal, var_samp({c}) AS variance FROM em"
    for i, c in enumerate(EM_FEATURES))


@query("feature_variance_topk", f"""WITH em AS ({EM_SQL}), v AS ({_EM_VAR_SQL})
SELECT feature, ordinal, {_r('variance')} AS variance FROM v
ORDER BY variance DESC, ordinal LIMIT 15""")
def q_feature_variance_topk(spark, sf_dir):
    """the 15 highest-variance features (a top-k report)."""
    t = PR.top_variance_features(em_flows(spark, sf_dir), EM_FEATURES, 15)
    return t.select("feature", F.col("ordinal").cast("int").alias("ordinal"),
                    r6("variance").alias("variance"))


@query("correlation_lower", f"""WITH em AS ({EM_SQL}), v AS ({_EM_VAR_SQL}),
top AS (SELECT feature, ordinal, row_number() OVER (ORDER BY variance DESC, ordinal) AS k FROM v),
t4 AS (SELECT * FROM top WHERE k <= 15),
lng AS (UNPIVOT em ON {', '.join(EM_FEATURES)} INTO NAME feature VALUE v),
l4 AS (SELECT lng.row_id, lng.feature, lng.v, t4.k FROM lng JOIN t4 USING (feature))
SELECT a.feature AS feature_i, b.feature AS feature_j, {_r('corr(a.v, b.v)')} AS corr
FROM l4 a JOIN l4 b ON a.row_id = b.row_id AND a.k > b.k GROUP BY a.feature, b.feature""")
def q_correlation_lower(spark, sf_dir):
    """correlation of the top-15 variance features, strict lower triangle."""
    em = em_flows(spark, sf_dir)
    top = [r["feature"] for r in PR.top_variance_features(em, EM_FEATURES, 15).collect()]
    c = PR.correlation_lower(em, top)
    return c.select("feature_i", "feature_j", r6("corr").alias("corr"))


_BOX_FEATS = LI_FEATURES


def _box_sql() -> str:
    lng = " UNION ALL ".join(f"SELECT y AS cls, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM li"
                             for c in _BOX_FEATS)
    return f"""WITH li AS ({LI_SQL}), lng AS ({lng}),
q AS (SELECT cls, feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
        quantile_cont(v, 0.75) AS q3 FROM lng GROUP BY cls, feature),
qi AS (SELECT *, q3 - q1 AS iqr FROM q),
w AS (SELECT l.cls, l.feature,
        min(CASE WHEN v >= q1 - 1.5 * iqr THEN v END) AS whisker_lo,
        max(CASE WHEN v <= q3 + 1.5 * iqr THEN v END) AS whisker_hi,
        CAST(count(*) FILTER (WHERE v < q1 - 1.5 * iqr OR v > q3 + 1.5 * iqr) AS BIGINT) AS n_outliers,
        CAST(count(*) AS BIGINT) AS n
      FROM lng l JOIN qi USING (cls, feature) GROUP BY l.cls, l.feature)
SELECT cls, feature, {_r('q1')} AS q1, {_r('median')} AS median, {_r('q3')} AS q3, {_r('iqr')} AS iqr,
       {_r('whisker_lo')} AS whisker_lo, {_r('whisker_hi')} AS whisker_hi, n_outliers, n
FROM qi JOIN w USING (cls, feature)"""


@query("box_stats", _box_sql())
def q_box_stats(spark, sf_dir):
    """quartiles, whiskers and outliers per class and feature."""
    b = PR.box_stats(li_flows(spark, sf_dir), _BOX_FEATS, "y")
    return b.select("cls", "feature", *[r6(c).alias(c) for c in
                                        ("q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi")],
                    F.col("n_outliers").cast("long").alias("n_outliers"),
                    F.col("n").cast("long").alias("n"))


@query("class_distribution", f"""WITH li AS ({LI_SQL}), {G.split_ctes('li')}
SELECT split, y, CAST(count(*) AS BIGINT) AS n FROM splitted GROUP BY split, y""")
def q_class_distribution(spark, sf_dir):
    """F8: rows per (split, class)."""
    return PR.class_distribution(P.stratified_split(li_flows(spark, sf_dir)))


@query("split_proportions", f"""WITH li AS ({LI_SQL}), {G.split_ctes('li')}
SELECT split, CAST(count(*) AS BIGINT) AS n,
       {_r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM splitted GROUP BY split""")
def q_split_proportions(spark, sf_dir):
    """split sizes and percent of total."""
    s = PR.split_proportions(P.stratified_split(li_flows(spark, sf_dir)))
    return s.select("split", F.col("n").cast("long").alias("n"), r6("pct").alias("pct"))


@query("class_prior", f"""WITH li AS ({LI_SQL})
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(1 - y) AS BIGINT) AS n_normal,
       CAST(sum(y) AS BIGINT) AS n_anomaly, {_r('avg(CAST(y AS DOUBLE)) * 100.0')} AS prior_pct FROM li""")
def q_class_prior(spark, sf_dir):
    """class counts and anomaly prior."""
    c = PR.class_prior(li_flows(spark, sf_dir))
    return c.select(F.col("n").cast("long").alias("n"), "n_normal", "n_anomaly",
                    r6("prior_pct").alias("prior_pct"))


def _profile_sql() -> str:
    cols = ["row_id", "label", "y"] + LI_FEATURES
    parts = []
    for c in cols:
        num = c not in ("row_id", "label")
        lo = f"min(CAST({c} AS DOUBLE))" if num else "CAST(NULL AS DOUBLE)"
        hi = f"max(CAST({c} AS DOUBLE))" if num else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS feature, '{'numeric' if num else 'other'}' AS kind, "
                     f"CAST(count({c}) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null, "
                     f"{_r(lo)} AS min_value, {_r(hi)} AS max_value FROM li")
    return f"WITH li AS ({LI_SQL}) " + " UNION ALL ".join(parts)


@query("feature_profile", _profile_sql())
def q_feature_profile(spark, sf_dir):
    """per-column type kind, counts, min and max."""
    p = PR.feature_profile(li_flows(spark, sf_dir))
    return p.select("feature", "kind", F.col("n").cast("long").alias("n"),
                    F.col("n_null").cast("long").alias("n_null"),
                    r6("min_value").alias("min_value"), r6("max_value").alias("max_value"))


# ---------------------------------------------------- thresholds (EV)

@query("percentile_threshold", f"""WITH ev AS ({EV_SQL}), {G.split_ctes('ev')},
t AS (SELECT quantile_cont(value, 0.2) AS p20, quantile_cont(value, 0.8) AS p80
      FROM splitted WHERE split = 'val')
SELECT {_r('p20')} AS p20, {_r('p80')} AS p80,
       CAST(count(*) FILTER (WHERE value > p80) AS BIGINT) AS n_above_p80,
       CAST(count(*) FILTER (WHERE value < p20) AS BIGINT) AS n_below_p20
FROM splitted, t WHERE split = 'test' GROUP BY p20, p80""")
def q_percentile_threshold(spark, sf_dir):
    """P80 / P20 of the validation scores, applied to test (strict)."""
    ev = P.stratified_split(ev_flows(spark, sf_dir))
    q = exact_quantile_values(ev.where("split = 'val'"), "value", [0.2, 0.8])
    p20, p80 = q[(0.2,)], q[(0.8,)]
    t = ev.where("split = 'test'")
    return t.agg(r6(F.lit(p20)).alias("p20"), r6(F.lit(p80)).alias("p80"),
                 F.count_if(F.col("value") > p80).cast("long").alias("n_above_p80"),
                 F.count_if(F.col("value") < p20).cast("long").alias("n_below_p20"))
