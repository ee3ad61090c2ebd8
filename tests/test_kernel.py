import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.operators import kernel as N, supervised as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 2))
    out = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "number": np.sin(2 * x[:, 0]) + 0.1 * x[:, 1],
                        "ring": (x**2).sum(1).round(6)})
    out["label"] = np.digitize(out.ring, [0.7, 2.0]).astype(float)
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(out)).repartition(3)


def test_support_vectors_store_no_kernel_features(rows, monkeypatch):
    made = []
    real = N.written
    monkeypatch.setattr(N, "written", lambda df, name: made.append(df.columns) or real(df, name))
    for classes, data in ((3, rows), (2, rows.withColumn("label", (F.col("label") > 0).cast("double")))):
        model = S.estimator("SVC", "classification", {"C": 10.0}, n=600.0, width=2,
                            classes=classes).fit(data)
        out = model.transform(data)
        assert "kernel_features" not in out.columns
        hit = out.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        assert hit > 0.9
        assert len(out.first()["rawPrediction"]) == classes
    assert made == [["x", "y", "w"]] * 2


def test_huber_regression_is_at_the_minimum(rows):
    data = rows.withColumn("label", F.col("number"))
    model = N.KernelLinear(gamma=0.5, size=32, reg=1e-3).fit(data)
    pdf = data.toPandas()
    x = np.stack([v.toArray() for v in pdf.features])
    z = N.cosines(x, *N.projection(2, 0.5, 32, 42))
    w, b = np.array(model.getOrDefault("weights")), model.getOrDefault("offsets")[0]
    mean, sd, y = z.mean(0), z.std(0, ddof=1), pdf.label.to_numpy()
    start = np.r_[w * sd, b + w @ mean]

    def value(p, scale):
        r = np.abs(y - (z - mean) / sd @ p[:-1] - p[-1])
        return np.where(r <= 1.35 * scale, scale + r * r / scale,
                        scale + 2.7 * r - scale * 1.35**2).mean() / 2 + 1e-3 / 2 * p[:-1] @ p[:-1]
    scales = np.linspace(0.01, 1.0, 2000)
    at = scales[np.argmin([value(start, s) for s in scales])]
    rng = np.random.default_rng(0)
    assert all(value(start, at) <= value(start + 0.05 * rng.normal(size=33), at) for _ in range(50))
    whole = S.estimator("SVR", "regression", {"C": 10.0}, n=600.0, width=2,
                        label_sd=float(y.std())).fit(data).transform(data)
    assert whole.agg(F.corr("label", "prediction")).first()[0] > 0.95


def test_large_partitions_are_spread_and_small_ones_stay(spark):
    data = spark.range(0, 1000, numPartitions=2)
    parts = S.spread(data, 1000, most=100).rdd.glom().map(len).collect()
    assert sum(parts) == 1000 and len(parts) == 10 and max(parts) <= 120
    assert S.spread(data, 1000, most=500) is data


def test_passes_read_packed_rows_and_cosines_are_exact(rows, monkeypatch):
    kept = []
    real = N.written
    monkeypatch.setattr(N, "written", lambda df, name: kept.append(real(df, name)) or kept[-1])
    N.KernelLinear(gamma=0.5, size=16, classes=2, reg=1e-3, most=1).fit(
        rows.withColumn("label", (F.col("label") > 0).cast("double")))
    assert dict(kept[0].dtypes) == {"x": "binary", "y": "binary", "w": "binary"}
    assert kept[0].count() <= 3 and sum(len(r["y"]) for r in kept[0].collect()) == 8 * 600
    # One partition: its sums come back as they are.
    N.KernelLinear(gamma=0.5, size=16, classes=3, reg=1e-3, most=1).fit(rows.coalesce(1))
    rng = np.random.default_rng(1)
    for far, size in ((1, 64), (1e4, 7), (0, 512)):
        x, (w, b) = rng.normal(0, far, (900, 3)), N.projection(3, 0.3, size, 1)
        assert np.abs(N.cosines(x, w, b) - np.cos(x @ w + b) * np.sqrt(2 / size)).max() < 1e-14 * max(far, 1)
