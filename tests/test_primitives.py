"""Rank/quantile primitives, sources and partition invariance."""

import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowsentry.functions import ranks as R
from flowsentry.functions.hashing import with_hash
from flowsentry.operators import cleaning as C
from flowsentry.operators import sampling as P
from flowsentry.plans.fixtures import li_flows


def test_bucketed_rank_equals_plain_window(spark):
    li = with_hash(li_flows(spark, SF_SMALL))
    a = R.bucketed_rank(li, ["label"], out="r1", digits=2)
    w = Window.partitionBy("label").orderBy("h", "row_id")
    b = li.withColumn("r2", F.row_number().over(w))
    j = a.join(b.select("row_id", "r2"), "row_id")
    assert j.where("r1 <> r2").count() == 0
    assert j.count() == li.count()


def test_assign_segments_matches_rank(spark):
    li = with_hash(li_flows(spark, SF_SMALL))
    cuts = {("RF",): [100, 300], ("NO",): [5, 6]}
    seg = R.assign_segments(li, ["label"], cuts, digits=2)
    w = Window.partitionBy("label").orderBy("h", "row_id")
    ref = li.withColumn("rk", F.row_number().over(w))
    j = seg.join(ref.select("row_id", "rk"), "row_id").collect()
    for r in j:
        c = cuts.get((r["label"],), [])
        assert r["segment"] == sum(1 for x in c if x < r["rk"])


def test_exact_quantiles_refinement_path(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 2.5)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    monkeypatch.setattr(R, "REFINE_DIRECT_ROWS", 50)
    got = R.exact_quantile_values(df, "v", [0.1, 0.5, 0.8, 0.95])
    for p in (0.1, 0.5, 0.8, 0.95):
        assert got[(p,)] == pytest.approx(float(np.percentile(vals, 100 * p)), abs=1e-12)


def test_exact_quantiles_of_groups_together(spark, monkeypatch):
    monkeypatch.setattr(R, "REFINE_DIRECT_ROWS", 20)
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=900), "b": np.full(40, 3.0), None: rng.integers(0, 5, 300).astype(float), "c": np.array([7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("d", None)], "g string, v double")
    got = R.exact_quantile_values(df, "v", [0.0, 0.25, 0.9, 1.0], by=["g"])
    assert set(got) == {(g, p) for g in groups for p in (0.0, 0.25, 0.9, 1.0)}
    for (g, p), q in got.items():
        assert q == pytest.approx(float(np.percentile(groups[g], 100 * p)), abs=1e-12)


def test_cut_keys_refine_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(R, "REFINE_DIRECT_ROWS", 5)
    li = with_hash(li_flows(spark, SF_SMALL), 42)
    n = li.count()
    order = sorted((r.h, r.row_id) for r in li.select("h", "row_id").collect())
    for digits in (0, 1):
        got = R.cut_keys(li, [], {(): [0, 1, n // 3, n, n + 5]}, digits=digits)[()]
        assert got == [("", ""), order[0], order[n // 3 - 1], order[-1], ("~", "")]


@pytest.mark.parametrize("direct", [5, 50_000])
@pytest.mark.parametrize("equal", [True, False])
def test_quotas_are_exact_with_a_repeated_key(spark, monkeypatch, direct, equal):
    monkeypatch.setattr(R, "REFINE_DIRECT_ROWS", direct)
    rows = [(f"r{i}", i % 2, float(i)) for i in range(200)] + [("hot", 0, 0.5 if equal else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id string, y int, x double").repartition(5)
    at = sorted(r.h for r in with_hash(df).collect()).index(with_hash(df).where("row_id = 'hot'").first().h)
    cuts = [at, at + 10, at + 60, at + 120]
    got = R.assign_segments(with_hash(df), [], {(): cuts}).collect()
    sizes = [sum(r.segment == i for r in got) for i in range(5)]
    assert sizes == [at, 10, 50, 60, 300 - cuts[-1]]
    assert sorted((r.row_id, r.y, r.x) for r in got) == sorted(rows)
    assert sorted((r.h, r.segment) for r in got) == [(h, sum(c < i + 1 for c in cuts)) for i, h in enumerate(sorted(r.h for r in got))]
    assert P.random_rows(df, at + 30).count() == at + 30


def test_sampling_is_one_narrow_pass(spark):
    li = li_flows(spark, SF_SMALL)
    for df in (P.stratified_sample(li, "label", 0.2), P.stratified_split(li), P.balanced_flag(li)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Window" not in plan and "Join" not in plan and "Exchange" not in plan


def test_cumulative_by_value_ranges_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(round(s, 1)), int(rng.integers(0, 5)))
            for g, s in zip(rng.integers(0, 2, 2000), rng.normal(size=2000))]
    df = spark.createDataFrame(rows, "g int, s double, w int").groupBy("g", "s").agg(F.sum("w").alias("w"))
    one = R.cumulative_by_value(df, ["g"], "s", ["w"], ranges=1).select("g", "s", F.col("cum_w").alias("a"))
    many = R.cumulative_by_value(df, ["g"], "s", ["w"], ranges=16).select("g", "s", F.col("cum_w").alias("b"))
    assert one.join(many, ["g", "s"]).where("a <> b").count() == 0


def test_sampling_partition_invariance(spark):
    li = li_flows(spark, SF_SMALL)
    outs = []
    for n in (1, 4, 16):
        s = P.stratified_split(li.repartition(n)).select("row_id", "split")
        outs.append(sorted(map(tuple, s.collect())))
    assert outs[0] == outs[1] == outs[2]
    f = [sorted(map(tuple, P.kfold_assign(li.repartition(n), 3).select("row_id", "fold").collect()))
         for n in (1, 7)]
    assert f[0] == f[1]


def test_kfold_sizes(spark):
    li = li_flows(spark, SF_SMALL)
    k = P.kfold_assign(li, 3)
    per = {(r["y"], r["fold"]): r["n"] for r in k.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    for cls in (0, 1):
        sizes = [per.get((cls, f), 0) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_balanced_subset_raises_when_short(spark):
    df = spark.createDataFrame([(str(i), 1 if i < 6 else 0) for i in range(10)], "row_id string, y int")
    with pytest.raises(ValueError):
        P.balanced_subset(df)


def test_stratified_sample_fallback(spark):
    df = spark.createDataFrame([(str(i), "a" if i else "solo") for i in range(50)], "row_id string, label string")
    s = P.stratified_sample(df, "label", 0.2)
    assert s.count() == 10  # round(0.2 * 50), plain sample


def test_dirty_csv_scan(spark, tmp_path):
    from flowsentry.sources.files import read_flow_csv, upsert
    d = tmp_path / "csv"
    d.mkdir()
    (d / "a.csv").write_text(" Flow Bytes/s , Label ,Dst Port\n1.5,BENIGN,80\nInfinity,DoS,443\ninf,BENIGN,22\n")
    (d / "b.csv").write_text("Dst Port, Label,Flow Bytes/s,Extra\n53,BENIGN,NaN,1\n8080,PortScan,-Infinity,2\n25,BENIGN,,3\n")
    df = read_flow_csv(spark, str(d))
    assert set(df.columns) == {"Flow Bytes/s", "Label", "Dst Port", "Extra"}
    assert df.count() == 6
    clean = C.clean(df.drop("Extra"))
    assert sorted(r["Dst Port"] for r in clean.collect()) == [80]
    rep = {r["metric"]: r["value"] for r in C.clean_report(df.drop("Extra")).collect()}
    assert rep["rows_dropped"] == 5 and rep["bad:Flow Bytes/s"] == 5
    enc = C.encode_label(clean, "Label")
    assert enc.first()["y"] == 0
    old = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "Model string, f1 double")
    new = spark.createDataFrame([("B", 3.0), ("C", 4.0)], "Model string, f1 double")
    assert sorted(map(tuple, upsert(old, new).collect())) == [("A", 1.0), ("B", 3.0), ("C", 4.0)]


def test_zero_variance_and_numeric(spark):
    df = spark.createDataFrame([(1.0, 7, "x", float(i)) for i in range(5)],
                               "c double, k int, s string, v double")
    assert set(C.zero_variance_columns(df)) == {"c", "k"}
    _, feats = C.select_features(df, keep=())
    assert feats == ["v"]


def test_param_grid_order(spark):
    from flowsentry.plans.tuning import IF_GRID, param_grid
    g = param_grid(spark, IF_GRID).orderBy("candidate_id").collect()
    assert len(g) == 9
    assert [(r["max_features"], r["n_estimators"]) for r in g[:3]] == [(0.5, 50), (0.5, 100), (0.5, 200)]


def test_bucketed_rank_with_deep_buckets(spark, monkeypatch):
    """Small buckets give the same ranks from longer prefixes, and no window holds many rows."""
    from flowsentry.functions import ranks
    df = spark.range(3000).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 3).cast("int").alias("y"))
    df = df.withColumn(ranks.HASH_COL, F.md5(F.concat(F.lit("42:"), "row_id")))
    plain = sorted(map(tuple, ranks.bucketed_rank(df, ["y"], digits=1).select("row_id", "rank").collect()))
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 5)
    deep = sorted(map(tuple, ranks.bucketed_rank(df, ["y"], digits=1).select("row_id", "rank").collect()))
    assert deep == plain


def test_concurrent_jobs(spark):
    from flowsentry.session import concurrently
    assert concurrently(spark, *(lambda n=n: spark.range(n).count() for n in (3, 5, 7))) == [3, 5, 7]
    with pytest.raises(ZeroDivisionError):
        concurrently(spark, lambda: 1 / 0, lambda: spark.range(2).count())


def test_box_stats_of_small_groups(spark):
    """Quartiles between two values of any group size, with ties, nulls and NaN."""
    from flowsentry.operators.profile import box_stats
    rng = np.random.default_rng(0)
    rows = [(n, float(v), float(rng.normal())) for n in range(1, 30) for v in rng.integers(0, 9, n)]
    rows += [(5, None, float("nan")), (None, 1.0, 2.0), (None, 3.0, 2.5)]
    df = spark.createDataFrame(rows, "y int, a double, b double").repartition(4)
    got = box_stats(df, ["a", "b"], "y").collect()
    assert len(got) == 2 * 30
    for r in got:
        x = np.array([t[1 if r.feature == "a" else 2] for t in rows if t[0] == r.cls], float)
        x = x[~np.isnan(x)]
        q = np.percentile(x, [25, 50, 75])
        lo, hi = q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])
        assert np.allclose([r.q1, r.median, r.q3], q) and r.n == len(x)
        assert (r.whisker_lo, r.whisker_hi) == (x[x >= lo].min(), x[x <= hi].max())
        assert r.n_outliers == ((x < lo) | (x > hi)).sum()
