import numpy as np
import pandas as pd
import pytest

from tessera.functions import metrics as M, ordered as O
from tessera.operators import assoc as A


def counts_table(spark, counts):
    rows = [(f"r{i}", f"c{j}") for i, row in enumerate(counts) for j, n in enumerate(row)
            for _ in range(n)]
    return spark.createDataFrame(rows, "x string, y string")


@pytest.mark.parametrize("counts,v", [([[10, 20], [30, 40]], 0.066815),
                                      ([[10, 20], [30, 40], [5, 5]], 0.102869)])
@pytest.mark.parametrize("pre", [True, False])
def test_cramers_v(spark, counts, v, pre):
    got = A.cramers_v(counts_table(spark, counts), ["x", "y"], pre).first()["value"]
    assert got == pytest.approx(v, abs=1e-6)


def test_correlation_ratio(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 10.0), ("b", 11.0),
                                ("b", 12.0)], "g string, y double")
    assert A.correlation_ratio(df, ["g"], ["y"]).first()["value"] == pytest.approx(0.983935, abs=1e-6)


def test_null_is_a_category(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), ("b", 2.0)], "g string, y double")
    assert A.correlation_ratio(df, ["g"], ["y"]).first()["value"] == pytest.approx(1.0, abs=1e-6)


def test_mixed_matrix_properties(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "c": rng.choice(list("xyz"), 300),
                        "d": rng.choice(list("pq"), 300), "flat": 1.0})
    pdf["b"] = pdf["a"] * 2 + rng.normal(size=300)
    m = A.mixed_matrix(spark.createDataFrame(pdf))
    got = {(r["col_i"], r["col_j"]): r["value"] for r in m.collect()}
    assert len(got) == 25
    assert all(got[i, j] == got[j, i] and -1 <= v <= 1 + 1e-9 for (i, j), v in got.items())
    assert all(got[c, c] == 1.0 for c in pdf.columns)
    assert got["a", "b"] == pytest.approx(np.corrcoef(pdf["a"], pdf["b"])[0, 1])
    assert got["a", "flat"] == 0.0
    wide = A.wide_matrix(m, list(pdf.columns)).orderBy("position").collect()
    assert [r["label"] for r in wide] == list(pdf.columns)
    assert wide[0]["values"][4] == pytest.approx(got["a", "b"])


def test_wide_pearson_equals_pairwise(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(100, 5)), columns=list("abcde")))
    one = {(r[0], r[1]): r[3] for r in A.pearson(df, list("abcde")).collect()}
    monkeypatch.setattr(A, "PAIR_AGGREGATES", 3)
    monkeypatch.setattr(A, "GRAM_PAIRS", 3)
    two = {(r[0], r[1]): r[3] for r in A.pearson(df, list("abcde"), complete=True).collect()}
    three = {(r[0], r[1]): r[3] for r in A.pearson(df, list("abcde")).collect()}
    assert one.keys() == two.keys() == three.keys()
    assert all(one[k] == pytest.approx(two[k]) == pytest.approx(three[k]) for k in one)


def test_auc(spark):
    df = spark.createDataFrame([(0, .1), (0, .4), (1, .35), (1, .8)], "y int, s double")
    assert M.auc_binary(df, "y", "s").first()[0] == pytest.approx(0.75)


def test_auc_with_ties_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "SMALL_ROWS", 3)
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 30, 400) / 30
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    assert M.auc_binary(df, "y", "s").first()[0] == pytest.approx(want)


def test_f1_confusion_and_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    assert M.accuracy(df, "y", "p").first()[0] == 0.5
    assert M.f1_macro(df, "y", "p").first()[0] == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    cells = {(r["y"], r["p"]): r["n"] for r in M.confusion(df, "y", "p").collect()}
    assert len(cells) == 9 and cells[2, 1] == 1 and cells[2, 2] == 0
    rows = {r["y"]: r["counts"] for r in M.confusion_matrix(M.confusion(df, "y", "p")).collect()}
    assert rows[0] == [1, 1, 0]


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert (r["mae"], r["mse"]) == (pytest.approx(0.5), pytest.approx(1.25 / 3))
    assert r["r2"] == pytest.approx(1 - 1.25 / (14 / 3))


def test_normalise_runs(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (3.0, None, 2.0)], "a double, gap double, c double")
    rows = M.normalise_runs(df, ["a", "gap", "c"]).collect()
    assert sorted((r["a_norm"], r["gap_norm"], r["c_norm"]) for r in rows) == [
        (0.0, 1.0, 1.0), (1.0, 1.0, 1.0)]


def test_main_metric():
    assert M.main_metric("regression", 0, False) == "r2"
    assert M.main_metric("classification", 2, True) == "f1"
    assert M.main_metric("classification", 3, True) == "f1_macro"
    assert M.main_metric("classification", 3, False) == "accuracy"
