from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import comparison, contracts, grouping, metrics, splits, summaries, windows


def months(n, start="2016-01-01"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="MS")]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    hot = [("hot", float(v)) for v in rng.lognormal(3, 2, 700).round(2)]
    rest = [(f"k{i % 7}", float(v)) for i, v in enumerate(rng.normal(0, 1, 300))]
    return spark.createDataFrame(hot + rest + [("one", 4.0), ("none", None)], "k string, v double").repartition(6)


def test_with_bucket_is_a_short_search(spark):
    """The bucket is the number of edges below the value, and no step refers to more than one edge."""
    values = [None, float("nan"), -1e9, 1e9, *[float(i * i) for i in range(500)]]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for buckets in (2, 10, 64):
        got = grouping.with_bucket(frame, "v", buckets)
        shares = [i / buckets for i in range(1, buckets)]
        edges = frame.agg(F.percentile_approx("v", F.array(*map(F.lit, shares)), F.lit(1000))).first()[0]
        for r in got.collect():
            passed = 0 if r.v is None else len(edges) if r.v != r.v else sum(e < r.v for e in edges)
            assert r["bucket__"] == passed
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert max(line.count("try_element_at") + line.count("element_at(") + line.count("edges__") for line in plan.splitlines()) < 10


def test_exact_quantiles(skewed):
    got = {r.k: r for r in grouping.exact_quantiles(skewed, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}).collect()}
    for k, part in skewed.toPandas().dropna().groupby("k"):
        want = np.quantile(part.v, [0.1, 0.5, 0.99])
        np.testing.assert_allclose([got[k].a, got[k].m, got[k].z], want, rtol=1e-12)
    assert "none" not in got


def test_running_totals(skewed):
    counted = skewed.where("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = grouping.running_totals(counted, ["k"], "v", ["n"]).toPandas().sort_values(["k", "v"])
    want = got.groupby("k").n.cumsum()
    assert (got.n__upto == want).all() and len(got) == counted.count()


def test_profile_cells(spark):
    rows = [("a", "x", "m1", 1.0), ("a", "y", "m2", 3.0), ("a", "y", None, None), ("a", "x", "m1", 2.0), ("b", " ", None, None)]
    df = spark.createDataFrame(rows, "k string, name string, market string, v double")
    cells = grouping.partial_cells(df, ["k", "name", "market"], ["v"])
    got = {r.k: r for r in grouping.profile_cells(cells, ["k"], {"mean": "v"}, "n", {"name": "name"}, {"markets": "market"}).collect()}
    assert (got["a"].mean, got["a"].n, got["a"].name, got["a"].markets) == (2.0, 4, "x", 2)
    assert (got["b"].mean, got["b"].n, got["b"].name, got["b"].markets) == (None, 1, "", 0)
    assert grouping.most_common(df, ["k"], "name", "top").orderBy("k").collect()[0].top == "x"


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    rows = []
    for e in range(3):
        for i, d in enumerate(months(20)):
            if i == 7 and e == 1:
                continue
            rows.append(("p", f"e{e}", d, None if i == 5 else float(rng.normal(10, 2))))
    return spark.createDataFrame(rows, "product_key string, provincia_key string, fecha date, y double")


def test_lags_and_rolling_match_pandas(series):
    spec = windows.entity_window()
    got = series.withColumns(windows.target_lag_columns(spec, "y")).toPandas().sort_values(["provincia_key", "fecha"]).reset_index(drop=True)
    by = got.groupby("provincia_key").y
    for k in (1, 2, 3, 6, 12):
        pd.testing.assert_series_equal(got[f"target_lag_{k}"], by.shift(k), check_names=False)
    for k in (3, 6):
        rolled = by.transform(lambda s: s.shift(1).rolling(k).mean())
        pd.testing.assert_series_equal(got[f"target_rolling_mean_{k}"], rolled, check_names=False)
        rolled = by.transform(lambda s: s.shift(1).rolling(k).std())
        pd.testing.assert_series_equal(got[f"target_rolling_std_{k}"], rolled, check_names=False)


def test_no_look_ahead(series):
    spec = windows.entity_window()
    cut = date(2017, 1, 1)
    changed = series.withColumn("y", F.when(F.col("fecha") >= cut, F.lit(999.0)).otherwise(F.col("y")))
    key = ["provincia_key", "fecha"]
    a = series.withColumns(windows.target_lag_columns(spec, "y")).where(F.col("fecha") <= cut).drop("y").toPandas().sort_values(key)
    b = changed.withColumns(windows.target_lag_columns(spec, "y")).where(F.col("fecha") <= cut).drop("y").toPandas().sort_values(key)
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


def test_fills_and_last_rows(series):
    spec = windows.entity_window()
    filled = series.withColumns({"f": windows.forward_fill(F.col("y"), spec), "b": windows.fill_both_ways(F.col("y"), spec)})
    got = filled.toPandas().sort_values(["provincia_key", "fecha"])
    assert got.f.notna().all() and got.b.notna().all()
    last = windows.last_row(series, windows.ENTITY).collect()
    assert len(last) == 3 and {r.fecha for r in last} == {date(2017, 8, 1)}


def test_best_row_ids_ranks_and_leaders(spark):
    df = spark.createDataFrame([("g", "a", None, 1.0), ("g", "b", 2.0, 5.0), ("g", "c", 2.0, 4.0), ("h", "d", None, 1.0)], "g string, n string, s double, t double")
    assert {r.g: r.n for r in windows.best_row(df, ["g"], ["s", "t", "n"]).collect()} == {"g": "c", "h": "d"}
    ids = windows.dense_ids(df, ["g"], "n", "id").collect()
    assert {(r.g, r.n): r.id for r in ids} == {("g", "a"): 0, ("g", "b"): 1, ("g", "c"): 2, ("h", "d"): 0}
    lead = windows.leading_values(df, ["g"], "n", [F.desc("t")], 2, "top").collect()
    assert {r.g: r.top for r in lead} == {"g": "b | c", "h": "d"}
    importances = spark.createDataFrame([("p", "base", 0, "x", 0.2), ("p", "base", 1, "y", 0.5), ("p", "base", 2, "z", 0.5)],
                                        "product_id string, feature_set string, position int, feature string, importance double")
    ranked = comparison.importance_table(importances).collect()
    assert {r.feature: r.importance_rank for r in ranked} == {"y": 1, "z": 2, "x": 3}


def test_sequence_windows(series):
    got = windows.sequence_windows(series.where("y is not null"), ["y"], 4).toPandas()
    assert len(got) == 3 * 19 - 1 - 3 * 3 and got.window.map(len).eq(4).all()
    legacy = windows.sequence_windows(series.where("y is not null"), ["y"], 4, include_current=False).toPandas()
    assert len(legacy) == len(got) - 3


def holdout_index(n):
    return max(1, min(int(n * (1 - 0.2)), n - 1))


def test_holdout(spark):
    sizes = {"a": 1, "b": 2, "c": 5, "d": 10, "e": 33}
    rows = [("p", k, d) for k, n in sizes.items() for d in months(n)]
    df = spark.createDataFrame(rows, "product_key string, provincia_key string, fecha date")
    cutoffs = {r.provincia_key: r.cutoff for r in splits.holdout_cutoffs(df).collect()}
    for k, n in sizes.items():
        i = holdout_index(n)
        assert cutoffs[k] == (months(n)[i] if i < n else None), k
    one_pass = splits.holdout(df)
    joined = splits.apply_cutoffs(df, splits.holdout_cutoffs(df))
    key = ["provincia_key", "fecha", "split"]
    assert sorted(map(tuple, one_pass.select(*key).collect())) == sorted(map(tuple, joined.select(*key).collect()))
    assert splits.split_violations(one_pass).count() == 0 and splits.check_split(one_pass) is one_pass
    with pytest.raises(ValueError):
        splits.check_split(df.withColumn("split", F.when(F.col("fecha") > "2016-02-01", "train").otherwise("test")))
    nested = splits.nested_split(df.where("provincia_key = 'e'")).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in nested} == {"fit": 20, "validation": 6, "test": 7}


@pytest.mark.parametrize("n", [7, 13, 23, 24, 50])
def test_expanding_folds(spark, n):
    df = spark.createDataFrame([("p", d) for d in months(n)], "product_key string, fecha date")
    w = 3
    while w > 2 and min(len(c) for c in np.array_split(np.arange(n), w + 1)[1:]) < 6:
        w -= 1
    chunks = np.array_split(np.array(months(n)), w + 1)
    got = splits.fold_bounds(df).orderBy("fold").collect()
    assert [(r.train_end, r.val_start, r.val_end) for r in got] == [(chunks[i][-1], chunks[i + 1][0], chunks[i + 1][-1]) for i in range(w)]
    assigned = splits.assign_folds(df, splits.fold_bounds(df))
    assert assigned.count() == n - len(chunks[0]) and assigned.where("fecha <= train_end").count() == 0
    assert splits.last_fold(splits.fold_bounds(df)).collect()[0].fold == w


def test_month_spine(series):
    got = splits.month_spine(series, ["y"]).toPandas().sort_values(["provincia_key", "fecha"])
    assert got.groupby("provincia_key").size().tolist() == [20, 20, 20] and got.y.notna().all()
    raw = series.toPandas()
    gap = got[(got.provincia_key == "e1") & ~got.observed]
    before = raw[(raw.provincia_key == "e1") & (raw.fecha == date(2016, 7, 1))].y.iloc[0]
    assert gap.fecha.tolist() == [date(2016, 8, 1)] and gap.y.tolist() == [before]


PREDICTED = "product_id string, model_name string, feature_set string, producto string, provincia string, fecha date, y_true double, y_pred double"


def predicted(spark, rows):
    return spark.createDataFrame(rows, PREDICTED)


def test_metrics(spark):
    rng = np.random.default_rng(1)
    rows = [("p", "m", "full", "P", e, d, float(rng.normal(3, 1)), float(rng.normal(3, 1))) for e in "ab" for d in months(8)]
    df = predicted(spark, rows)
    pdf = df.toPandas().sort_values(["fecha", "provincia"])
    got = metrics.regression_metrics(df, metrics.SERIES, row_order=["fecha", "provincia"]).collect()[0]
    e = pdf.y_true - pdf.y_pred
    assert got.mae == pytest.approx(e.abs().mean()) and got.rmse == pytest.approx((e**2).mean() ** 0.5)
    assert got.mape == pytest.approx((e / pdf.y_true).abs().mean() * 100)
    assert got.r2 == pytest.approx(1 - (e**2).sum() / ((pdf.y_true - pdf.y_true.mean()) ** 2).sum())
    agree = np.sign(np.diff(pdf.y_true)) == np.sign(np.diff(pdf.y_pred))
    assert got.directional_accuracy == pytest.approx(agree.mean()) and got.n_test == 16
    per_entity = metrics.regression_metrics(df, metrics.SERIES).collect()[0].directional_accuracy
    parts = [np.sign(np.diff(p.y_true)) == np.sign(np.diff(p.y_pred)) for _, p in pdf.groupby("provincia")]
    assert per_entity == pytest.approx(np.concatenate(parts).mean())


def test_metric_edges(spark):
    d = months(3)
    rows = [("one", "m", "full", "P", "a", d[0], 1.0, 2.0)]
    rows += [("const", "m", "full", "P", "a", x, 2.0, 2.0) for x in d] + [("const2", "m", "full", "P", "a", x, 2.0, 3.0) for x in d]
    rows += [("zero", "m", "full", "P", "a", x, 0.0, 1.0) for x in d]
    got = {r.product_id: r for r in metrics.regression_metrics(predicted(spark, rows), metrics.SERIES).collect()}
    assert got["one"].r2 is None and got["one"].directional_accuracy is None
    assert got["const"].r2 == 1.0 and got["const2"].r2 == 0.0 and got["zero"].mape is None
    flags = metrics.entity_metrics(predicted(spark, rows)).collect()
    assert all(r.exploratorio for r in flags)


def test_candidate_scores(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0), (2, float("inf")), (3, 1.0), (3, None)], "c int, rmse double")
    got = {r.c: r.validation_rmse_mean for r in metrics.candidate_score(df, ["c"]).collect()}
    assert got == {1: 3.0, 2: None, 3: None}


def test_common_window(spark):
    d = months(4)
    rows = [("p", m, "full", "P", "a", x, 1.0, 1.5) for m, keep in (("a", d), ("b", d[1:]), ("c", d[:3])) for x in keep]
    rows += [("q", "a", "full", "Q", "a", x, 1.0, 2.0) for x in d]
    df = predicted(spark, rows)
    keys = comparison.common_keys(df).collect()
    assert sorted(r.fecha for r in keys) == d[1:3] and {r.product_id for r in keys} == {"p"}
    manifest = {r.product_id: r for r in comparison.common_window_manifest(df).collect()}
    assert manifest["p"].dropped_rows_by_model == {"a": 2, "b": 1, "c": 1} and manifest["p"].common_test_rows == 2
    assert manifest["q"].warning and manifest["q"].common_test_rows == 0 and manifest["q"].models_available == ["a"]
    assert comparison.common_window_comparison(df).count() == 3


def test_best_and_ablation(spark):
    columns = "product_id string, model_name string, feature_set string, rmse double, mae double, mape double, operational_rmse_mean double"
    df = spark.createDataFrame([
        ("p", "a", "full", 1.0, 1.0, 1.0, None), ("p", "b", "full", 2.0, 1.0, 1.0, 0.5), ("p", "c", "base", 0.1, 0.1, 0.1, 0.1),
        ("q", "a", "full", 2.0, 1.0, 1.0, None), ("q", "b", "full", 1.0, 1.0, 1.0, None), ("q", "b", "base", 4.0, 2.0, 1.0, None),
    ], columns)
    best = {r.product_id: (r.model_name, r.selection_metric) for r in comparison.best_models(df).collect()}
    assert best == {"p": ("b", "operational_rmse_mean"), "q": ("b", "rmse")}
    gains = {(r.product_id, r.model_name): r for r in comparison.ablation_summary(df).collect()}
    assert gains["q", "b"].delta_rmse_full_vs_base == 3.0 and gains["q", "b"].pct_improvement_full_vs_base == 75.0
    assert gains["p", "a"].rmse_base is None
    status = comparison.run_status(df.sparkSession, [("p", "a", "full", "ok", "")])
    assert status.collect()[0].status == "ok"


def test_profile_and_correlation(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200), "s": rng.choice(list("xyz"), 200)})
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    got = {r.column: r for r in summaries.frame_profile(df).collect()}
    for c in "ab":
        want = pdf[c].describe()
        assert (got[c]["count"], got[c].q25, got[c].q50, got[c].std) == pytest.approx((want["count"], want["25%"], want["50%"], want["std"]))
    assert got["s"].top == sorted(pdf.s.value_counts().items(), key=lambda x: (-x[1], x[0]))[0][0] and got["s"].unique == 3
    matrix = {(r.a, r.b): r["corr"] for r in summaries.correlation_matrix(df, ["a", "b"]).collect()}
    assert matrix["a", "b"] == pytest.approx(pdf.corr(numeric_only=True).loc["a", "b"]) and matrix["b", "a"] == matrix["a", "b"]
    assert {r.column: r.nulls for r in summaries.null_counts(df).collect()}["b"] == pdf.b.isna().sum()


def test_contract(spark):
    df = spark.createDataFrame([(date(2020, 1, 1), "a", 0, 1.0, "t", None)],
                               "fecha date, provincia string, provincia_id int, target_precio_mercado_usdkg double, s string, x double")
    assert contracts.validate_dataset(df, ["provincia_id"]) is df
    for features, message in ((["nope"], "nope"), (["s"], "numeric"), (["x"], "missing values")):
        with pytest.raises(ValueError, match=message):
            contracts.validate_dataset(df, features)
