import numpy as np
import pandas as pd
import pytest

from tessera.operators import blocks, cluster as K, kth, line as N, linkage as L


def points(spark, x, ids=None):
    return spark.createDataFrame(pd.DataFrame({
        "id": np.arange(len(x)) if ids is None else ids, "vec": [[float(v)] for v in x]})).repartition(3)


def refuse(*args, **kwargs):
    raise AssertionError("pairs were formed")


@pytest.mark.parametrize("chunk", [16, 1 << 18])
def test_kth_distance_on_a_line_forms_no_pairs(spark, monkeypatch, chunk):
    rng = np.random.default_rng(1)
    x = np.r_[np.full(80, 5.0), rng.normal(0, 1, 60), rng.normal(9, 0.1, 100)]
    gaps = np.sort(np.abs(x[:, None] - x[None]), axis=1)
    monkeypatch.setattr(kth, "block_join", refuse)
    for k in (1, 60, len(x) - 1):
        for got in (kth.kth_distance(points(spark, x), k), N.kth_on_line(points(spark, x), k, chunk)):
            assert np.allclose(got.toPandas().set_index("id").dist.sort_index(), gaps[:, k])


def test_nearest_on_a_line_forms_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.r_[np.full(40, 5.0), rng.integers(0, 30, 120), rng.normal(9, 0.1, 60), [1e9, 2e9, 1e-9, -0.0, 0.0]]
    ids = rng.permutation(len(x)) * 3
    p = points(spark, x, ids)
    want = {}
    for i, a in zip(ids, x):
        d = sorted((float(np.sqrt((a - b) ** 2)), int(j)) for j, b in zip(ids, x) if j != i)
        want[int(i)] = [(n, w) for w, n in d]
    def got(k, **more):
        out = {}
        for r in blocks.nearest(p, p, k, skip_self=True, block=50, **more).orderBy("id", "place").collect():
            out.setdefault(r.id, []).append((r.nbr, r.dist))
            assert r.place == len(out[r.id])
        return out
    rows, rest = N.nearest_on_line(p, 5, 16)
    assert rest is None or rest.count() < 4
    monkeypatch.setattr(blocks.Index, "of", refuse)
    for k in (1, 5):
        if N.nearest_on_line(p, k)[1] is None:
            assert got(k) == {i: w[:k] for i, w in want.items()}
    mine = {}
    for r in rows.orderBy("id", "place").collect():
        mine.setdefault(r.id, []).append((r.nbr, r.dist))
    assert all(want[i][:5] == w for i, w in mine.items()) and len(mine) >= len(x) - 3
    tight = points(spark, np.r_[1.0, np.arange(40) * 1e-30])
    monkeypatch.undo()
    rows, rest = N.nearest_on_line(tight, 2)
    assert [r.id for r in rest.collect()] == [0]
    assert [r.nbr for r in blocks.nearest(tight, tight, 2, skip_self=True, block=20).where(
        "id = 0").orderBy("place").collect()] == [1, 2]
    twice = points(spark, np.array([1.0, 2.0]), np.array([7, 7]))
    assert N.nearest_on_line(twice, 1) is None


def test_single_linkage_on_a_line_forms_no_pairs(spark, monkeypatch):
    x = np.array([0, 0, 1, 5, 6, 6, 20, 21, 3.5])
    p = points(spark, x, np.arange(len(x))[::-1])
    whole = L.linkage_clusters(p.selectExpr("id", "array(vec[0], 0D) AS vec"), 3).toPandas()
    monkeypatch.setattr(blocks.Index, "of", refuse)
    got = L.linkage_clusters(p, 3).toPandas()
    assert got.sort_values("id").to_numpy().tolist() == whole.sort_values("id").to_numpy().tolist()
    assert got.component.nunique() == 3
    assert K.single_linkage(p, 1).labels.toPandas().cluster.eq(0).all()


def test_points_off_the_line_go_the_general_way(spark):
    plane = spark.createDataFrame([(0, [1.0, 2.0])], "id long, vec array<double>")
    gap = spark.createDataFrame([(0, [1.0]), (1, None)], "id long, vec array<double>")
    keyless = spark.createDataFrame([(None, [1.0])], "id long, vec array<double>")
    assert not any(N.on_line(p) for p in (plane, gap, keyless))
    copies = points(spark, np.array([1.0, 1.0, 1.0, 4.0]))
    assert L.linkage_clusters(copies, 3).toPandas().component.nunique() == 3
