import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import ordered as O
from tessera.operators import clean as C, features as X


def test_cleaning_rules(spark):
    rows = [(1, 10, 1.0, None, 1.0, "a"), (1, 10, 1.0, None, 1.0, "a"), (2, 11, 2.0, None, 2.0, "b"),
            (3, 12, 3.0, None, None, "c")]
    df = spark.createDataFrame(rows, "`Unnamed: 0` int, user_id int, width double, "
                                     "all_null double, x double, cat string")
    out = C.clean(df)
    assert out.df.columns == ["x", "cat"]
    assert sorted(map(tuple, out.df.collect())) == [(1.0, "a"), (2.0, "b")]
    assert out.deleted == ["Unnamed: 0", "all_null", "user_id", "width"]
    assert C.clean(df, "clustering").df.count() == 3
    assert "width" in C.clean(df, id_match="token").df.columns
    assert "user_id" in C.clean(df, target="user_id").df.columns
    report = C.cleaning_report(out).first()
    assert (report["cols_deleted_n"], report["rows_deleted_n"], report["final_features_n"]) == (4, 2, 3)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert C.drop_null_rows(df).count() == 1
    assert C.drop_empty(df.where("x is null or isnan(x)")).columns == []


def test_row_key_counts_copies_and_ignores_partitioning(spark, monkeypatch):
    monkeypatch.setattr(C, "COPIES_PER_TASK", 7)
    df = spark.createDataFrame([(i % 3, "v") for i in range(100)] + [(9, "w")], "a int, b string")
    one = sorted(r[0] for r in C.with_row_key(df).select("_rid").collect())
    two = sorted(r[0] for r in C.with_row_key(df.repartition(5, "b")).select("_rid").collect())
    assert one == two and len(set(one)) == 101


def test_separate(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.separate(df, "b", "regression")[0].columns == ["a"]
    assert C.separate(df, None, "clustering")[1] is None
    with pytest.raises(ValueError):
        C.separate(df, None, "regression")


@pytest.mark.parametrize("limit", [1_000_000, 50])
def test_exact_quantiles(spark, limit):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.exponential(5, 500)])
    g = rng.integers(0, 2, len(x))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": g}))
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in O.exact_quantiles(df, ["x"], probs, ["g"],
                                                             limit).collect()}
    for k in (0, 1):
        assert np.allclose(got[k], np.quantile(x[g == k], probs), atol=1e-9)


@pytest.mark.parametrize("kind", ["double", "string"])
def test_prefix_sums_in_ranges(spark, monkeypatch, kind):
    monkeypatch.setattr(O, "SMALL_ROWS", 10)
    df = spark.range(500).select(
        (F.col("id").cast("double") if kind == "double" else F.lpad(F.col("id").cast("string"), 5, "0"))
        .alias("o"), F.col("id").alias("v"))
    out = O.with_prefix_sums(df, "o", {"before": "v"}, buckets=8)
    for r in out.collect():
        assert r["before"] == r["v"] * (r["v"] - 1) // 2


def test_prefix_sums_by_group(spark, monkeypatch):
    monkeypatch.setattr(O, "SMALL_ROWS", 10)
    df = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("o"),
                                 F.lit(1).alias("v"))
    out = O.with_prefix_sums(df, "o", {"before": "v"}, by=["g"], buckets=4)
    assert all(r["before"] == int(r["o"]) // 2 for r in out.collect())


def test_split_has_exact_counts_and_is_stable(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 3500, "hot").when(
        F.col("id") < 4990, "cold").otherwise("rare").alias("s"))
    one = X.stratified_split(df, "s", ["id"])
    two = X.stratified_split(df.repartition(7), "s", ["id"])
    a = {r["id"] for r in one.where("is_test").collect()}
    assert a == {r["id"] for r in two.where("is_test").collect()}
    counts = {r["s"]: r["count"] for r in one.where("is_test").groupBy("s").count().collect()}
    assert sum(counts.values()) == 1250 and counts == X.allocate_test_rows(
        {"hot": 3500, "cold": 1490, "rare": 10}, 0.25)
    other = {r["id"] for r in X.stratified_split(df, "s", ["id"], seed=1).where("is_test").collect()}
    assert a != other


def test_ordinal_codes(spark):
    fit = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    codes = X.category_map(fit, ["c"])
    new = spark.createDataFrame([("b",), ("zz",), (None,)], "c string")
    assert [r["c"] for r in X.encode_ordinal(new, ["c"], codes).collect()] == [1.0, -1.0, 2.0]
    assert X.category_map_export(codes).first()["mapping"] == {"a": 0, "b": 1, "missing": 2}


@pytest.mark.parametrize("literal,broadcast", [(200, 200_000), (0, 200_000), (0, 1)])
def test_all_ways_to_encode_agree(spark, monkeypatch, literal, broadcast):
    monkeypatch.setattr(X, "LITERAL_VALUES", literal)
    monkeypatch.setattr(X, "BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame([(i, f"v{i % 7}", f"w{i % 3}") for i in range(50)],
                               "i int, a string, b string")
    out = X.encode_ordinal(df, ["a", "b"], X.category_map(df, ["a", "b"])).orderBy("i").collect()
    assert [(r["a"], r["b"]) for r in out] == [(float(i % 7), float(i % 3)) for i in range(50)]


def test_category_map_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(X, "SMALL_ROWS", 5)
    df = spark.createDataFrame([(f"v{i:03d}",) for i in range(40)] * 2, "c string")
    got = {r["value"]: r["code"] for r in X.category_map(df, ["c"]).collect()}
    assert got == {f"v{i:03d}": i for i in range(40)}


def test_one_hot_unknown_is_zero(spark):
    codes = X.category_map(spark.createDataFrame([("A",), ("N",)], "f string"), ["f"])
    out, names = X.one_hot(spark.createDataFrame([("R",), ("A",)], "f string"), ["f"], codes)
    assert names == ["f=A", "f=N"]
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 0), (1, 0)]


def test_hash_slots_share_values(spark):
    out = X.hash_slots(spark.createDataFrame([("x", "x")], "a string, b string"), ["a", "b"],
                       signed=False).first()["hashed"]
    assert len(out) == 128 and max(out) == 2.0 and sum(out) == 2.0


def test_skew_gate(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "y double")
    assert X.corrected_skew(df, "y").first()["skew"] == pytest.approx(2.232396, abs=1e-6)
    out, how = X.log_target(df.withColumnRenamed("y", "t"), "t")
    assert how == "log1p" and out.agg(F.max("y")).first()[0] == pytest.approx(math.log1p(100))
    low = spark.createDataFrame([(float(v),) for v in (-5, 2, 3, 4, 100)], "t double")
    assert X.log_target(low, "t")[1] is None


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 5, 6, 7, 8, 9, 10)], "y double")
    edges = X.quantile_edges(df, "y", 4)
    assert edges == [1, 5.5, 7.75, 10]
    bins = [r[0] for r in df.select(X.quantile_bin("y", edges)).collect()]
    assert bins == [0, 0, 0, 0, 0, 1, 1, 2, 2, 2]


def test_polynomial_names_and_base():
    names = [n for _, _, n in X.polynomial_names(["a", "b"])]
    assert names == ["a", "b", "a^2", "a b", "b^2"]
    assert X.base_names(names) == ["a", "b"]


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 12)) @ rng.normal(size=(12, 60))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)],
                               "i int, v array<double>")
    svd = X.fit_svd(df, "v", 5)
    assert np.allclose(svd.values, np.linalg.svd(m, compute_uv=False)[:5])
    reduced, _ = X.compress_if_wide(df, "v", "clustering")
    assert len(reduced.first()["features"]) == 50
    assert X.compress_if_wide(df, "v", "regression")[1] is None


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    got = {r["y"]: r["weight"] for r in X.class_weights(df, "y").collect()}
    assert got == {0: 8 / 12, 1: 2.0}
    assert X.imbalance(df, "y").first()["is_imbalanced"]


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "t string")
    assert [r[0] for r in df.select(X.to_number("t")).collect()] == [1.5, None, None, None]
    assert [r[0] for r in df.select(X.to_number("t", 0.0)).collect()] == [1.5, 0.0, 0.0, 0.0]


def test_target_codes_follow_the_type(spark):
    df = spark.createDataFrame([(10,), (9,), (100,)], "t int")
    got = {r["value"]: r["label"] for r in X.target_codes(df, "t").collect()}
    assert got == {9: 0, 10: 1, 100: 2}


def test_row_key_spreads_the_copies_of_one_row(spark, monkeypatch):
    from tessera.operators import clean
    monkeypatch.setattr(clean, "COPIES_PER_TASK", 10)
    keyed = clean.with_row_key(spark.range(1000).selectExpr("1 AS a", "'x' AS b"))
    tasks = [len(part) for part in keyed.rdd.glom().collect()]
    assert sum(tasks) == 1000 and max(tasks) <= 200
    assert keyed.select(clean.ROW_KEY).distinct().count() == 1000
