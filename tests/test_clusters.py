import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as B, cluster as K, graph as G, quality as Q


def table(spark, x, cluster=None, ids=None):
    pdf = pd.DataFrame({"id": ids if ids is not None else np.arange(len(x)),
                        "vec": [list(map(float, r)) for r in x]})
    if cluster is not None:
        pdf["cluster"] = np.asarray(cluster, dtype="int32")
    return spark.createDataFrame(pdf)


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.fixture(scope="module")
def cloud():
    """A third of the points are copies of one point; the rest are three blobs."""
    rng = np.random.default_rng(0)
    blobs = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    return np.concatenate([blobs, np.full((90, 2), 2.0)])


FOUR = [[0, 0], [0, 1], [10, 0], [10, 1]]


@pytest.mark.parametrize("block", [2048, 16])
@pytest.mark.parametrize("text_ids", [False, True])
def test_nearest_equals_brute_force(spark, cloud, block, text_ids):
    ids = [f"p{i:04d}" for i in range(len(cloud))] if text_ids else None
    p = table(spark, cloud, ids=ids).repartition(3)
    d = distances(cloud)
    np.fill_diagonal(d, np.inf)
    got = B.nearest(p, p, 4, skip_self=True, block=block).toPandas()
    assert len(got) == 4 * len(cloud)
    order = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :4]
    name = (lambda i: f"p{i:04d}") if text_ids else int
    want = {(name(i), name(j)) for i in range(len(cloud)) for j in order[i]}
    assert {(r.id, r.nbr) for r in got.itertuples()} == want


@pytest.mark.parametrize("block", [2048, 16])
def test_nearest_of_other_table(spark, cloud, block):
    q = np.array([[0.1, 0.1], [9.0, 9.0], [2.0, 2.0]])
    got = B.nearest(table(spark, q), table(spark, cloud), 3, block=block).toPandas()
    for i in range(3):
        want = np.sort(np.sqrt(((cloud - q[i]) ** 2).sum(1)))[:3]
        assert np.allclose(got[got.id == i].sort_values("place").dist, want)


@pytest.mark.parametrize("block", [2048, 16])
def test_radius_counts_and_components(spark, cloud, block):
    p, d = table(spark, cloud), distances(cloud)
    counts = B.neighbour_counts(p, 0.4, block).toPandas().set_index("id").n
    assert (counts.sort_index().to_numpy() == (d <= 0.4).sum(1)).all()
    links = B.radius_links(p, 0.4, block=block)
    comp = G.connected_components(p, links).toPandas().set_index("id").component
    label = np.arange(len(cloud))
    while True:
        new = np.array([label[d[i] <= 0.4].min() for i in range(len(cloud))])
        if (new == label).all():
            break
        label = new
    assert (comp.sort_index().to_numpy() == label).all()


@pytest.fixture
def small_trees(monkeypatch):
    """Two levels for a few hundred points."""
    from tessera.operators import pivots
    monkeypatch.setattr(pivots, "TOPS", 5)


def test_two_levels_of_pivots(spark, cloud, small_trees):
    from tessera.operators import pivots
    p = table(spark, cloud).repartition(3)
    tree = pivots.build(p, len(cloud), 8)
    assert len(tree.tops) <= 5 < len(tree)
    placed = tree.place(p).toPandas()
    assert np.allclose(placed.r, np.sqrt(((cloud[placed.id] - tree.pivots[placed.leaf]) ** 2).sum(1)))
    d = distances(cloud)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :4]
    for block in (8, 40):
        got = B.nearest(p, p, 4, skip_self=True, block=block).toPandas()
        assert {(r.id, r.nbr) for r in got.itertuples()} == {
            (i, j) for i in range(len(cloud)) for j in order[i]}
        counts = B.neighbour_counts(p, 0.4, block).toPandas().set_index("id").n
        assert (counts.sort_index().to_numpy() == (d <= 0.4).sum(1) + 1).all()
    far = table(spark, [[50.0, 50.0], [2.0, 2.0]])
    got = B.nearest(far, p, 200, block=8).toPandas()
    for i, q in enumerate(([50.0, 50.0], [2.0, 2.0])):
        want = np.sort(np.sqrt(((cloud - q) ** 2).sum(1)))[:200]
        assert np.allclose(np.sort(got[got.id == i].dist), want)


def test_copies_stay_bounded(spark, monkeypatch):
    """Leaves keep their size and rows few copies when there are more leaves than first cells."""
    from tessera.operators import pivots
    monkeypatch.setattr(pivots, "TOPS", 16)
    rng = np.random.default_rng(8)
    copies, kept = [], B.Index.copies
    monkeypatch.setattr(B.Index, "copies", lambda *a: seen.append(kept(*a)) or seen[-1])
    for n in (4_000, 32_000):
        seen = []
        p = table(spark, rng.normal(size=(n, 2)))
        B.nearest(p, p, 5, skip_self=True, block=64)
        index = B.Index.of(p, n, 64)
        assert index.n.max() < 12 * 64 and len(index.tree) > n / 64 / 3
        copies.append(seen[0].count() / n)
    assert max(copies) < 3 and copies[1] < 1.3 * copies[0]


def test_radius_links_stay_within_groups(spark):
    p = table(spark, [[0, 0], [0, 0.1], [0, 0.2]], [0, 1, 0])
    comp = {r["id"]: r["component"] for r in G.connected_components(
        p, B.radius_links(p, 0.5, by="cluster")).collect()}
    assert comp == {0: 0, 1: 1, 2: 0}


def test_components_of_large_graphs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    v = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 140), 999]], "id long")
    e = spark.createDataFrame(edges, "u long, v long")
    found = {tuple(r) for r in G.connected_components(v, e).collect()}
    assert found == {(i, 0 if i <= 40 else 100 if i < 140 else 999)
                     for i in [*range(41), *range(100, 140), 999]}


def test_spanning_forest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    d = distances(x)
    e = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(40) for j in range(i)
                               if i // 30 == j // 30], "u long, v long, w double")
    v = spark.range(40)
    found = G.spanning_forest(v, e).toPandas()
    root, weight = list(range(40)), 0.0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for w, i, j in sorted((w, i, j) for i, j, w in map(tuple, e.collect())):
        if find(i) != find(j):
            root[find(i)] = find(j)
            weight += w
    assert len(found) == 38
    assert found.w.sum() == pytest.approx(weight)


def tree_weight(d):
    """Weight of a minimum spanning tree, by Kruskal."""
    root, total = list(range(len(d))), 0.0

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for w, i, j in sorted((d[i, j], i, j) for i in range(len(d)) for j in range(i)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += w
    return total


@pytest.mark.parametrize("case", ["cloud", "grid", "text"])
def test_spanning_tree_and_linkage(spark, cloud, small_trees, case):
    from tessera.operators import linkage as L
    x, ids, rng = cloud, None, np.random.default_rng(2)
    if case == "grid":                              # nothing but ties
        x = np.array([[i, j] for i in range(9) for j in range(7)], dtype=float)
    if case == "text":
        x = rng.normal(size=(90, 3))
        ids = [f"p{i:04d}" for i in rng.permutation(len(x))]
    p = table(spark, x, ids=ids).repartition(3)
    block = 2048 if case == "text" else 9
    tree = L.spanning_tree(p, block).toPandas()
    assert len(tree) == len(x) - 1
    assert tree.w.sum() == pytest.approx(tree_weight(distances(x)))
    if case == "cloud":
        got = L.linkage_clusters(p, 4, block).toPandas().set_index("id").component.sort_index()
        d, cut = distances(x), sorted(tree.w)[-3]
        label = np.arange(len(x))
        while True:
            new = np.array([label[d[i] < cut].min() for i in range(len(x))])
            if (new == label).all():
                break
            label = new
        assert (got.to_numpy() == label).all() and len(set(label)) == 4


def test_kth_distance(spark, cloud):
    """Every rank, with a third of the points equal, in one block and in many."""
    from tessera.operators.kth import kth_distance
    d = distances(cloud)
    np.fill_diagonal(d, np.inf)
    d.sort(axis=1)
    for k, block in ((89, 150), (200, 2048)):
        got = kth_distance(table(spark, cloud), k, block).toPandas().set_index("id").dist.sort_index()
        assert np.allclose(got, d[:, k - 1], rtol=1e-9, atol=1e-12)


def test_closest_points_tile_by_tile(monkeypatch):
    """As by sorting all distances, with ties, bounds and a point left out; few pairs are measured
    exactly."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 4, (150, 5)).astype(float), rng.integers(0, 4, (700, 5)).astype(float)
    b[:150] = a
    measured, real = [], B._exact
    monkeypatch.setattr(B, "_exact", lambda a, b, i, j: measured.append(len(i)) or real(a, b, i, j))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    for tile, k, far, own in (((16, 32), 7, np.inf, -1), ((64, 1024), 7, 2.0, 0), ((16, 32), 800, np.inf, 0)):
        monkeypatch.setattr(B, "SUM_TILE", tile)
        self_ = np.arange(150) if own == 0 else np.full(150, -1)
        left = d.copy()
        left[np.flatnonzero(self_ >= 0), self_[self_ >= 0]] = np.inf
        left[left > far] = np.inf
        want = [(i, j, left[i, j]) for i in range(150) for j in np.argsort(left[i], kind="stable")[:k]
                if left[i, j] < np.inf]
        i, j, dist = B.closest(a, b, k, np.full(150, far), self_)
        assert list(zip(i, j)) == [w[:2] for w in want] and np.allclose(dist, [w[2] for w in want])
    x, measured[:] = rng.normal(0, 1, (64, 24)), []
    i, j, dist = B.closest(x, rng.normal(0, 1, (4096, 24)), 5, np.full(64, np.inf), np.full(64, -1))
    assert len(i) == 320 and sum(measured) < 64 * 4096 / 50


def test_kth_distance_from_sampled_brackets(spark, monkeypatch):
    """Two passes over all pairs where the sample's brackets hold; exact where they all miss."""
    from tessera.operators import kth
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (1500, 6)), np.repeat(rng.normal(3, 1, (1, 6)), 250, axis=0)])
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    d.sort(axis=1)
    passes, real = [], kth.block_join
    monkeypatch.setattr(kth, "block_join", lambda *a, **k: passes.append(1) or real(*a, **k))
    for k, sure, most in ((520, 5.0, 2), (40, 5.0, 4), (520, -1.0, 6)):
        monkeypatch.setattr(kth, "SURE", sure)
        passes.clear()
        got = kth.kth_distance(table(spark, x), k).toPandas().set_index("id").dist.sort_index()
        assert len(got) == len(x) and np.allclose(got, d[:, k - 1], rtol=1e-9, atol=1e-12)
        assert len(passes) <= most, passes


def test_modes(spark, monkeypatch):
    """Modes as by plain mean shift, from every grid corner; the same with crowded cells cut up."""
    from tessera.operators import shift as S
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.5, (60, 2)) for c in ((0, 0), (6, 0), (0, 7))]
                       + [np.full((80, 2), 3.0)])
    width = 1.2
    seeds = np.unique(np.round(x / width), axis=0) * width
    ends = []
    for s in seeds:
        for _ in range(300):
            near = x[((x - s) ** 2).sum(1) <= width * width]
            if not len(near):
                break
            before, s = s, near.mean(0)
            if ((s - before) ** 2).sum() <= (S.DONE * width) ** 2:
                break
        if len(near):
            ends.append((-len(near), tuple(s)))
    modes = []
    for n, s in sorted(ends):
        if all(sum((a - b) ** 2 for a, b in zip(s, m)) > width * width for m in modes):
            modes.append(s)
    monkeypatch.setattr(S, "BLOCK_ROWS", 25)
    got, info = S.find_modes(table(spark, x), width, 300)
    assert info["converged"] and info["modes"] == len(modes) >= 4
    for r in got.collect():
        assert min(sum((a - b) ** 2 for a, b in zip(r["vec"], m)) for m in modes) < .1
    _, info = S.find_modes(table(spark, x), width, 1)
    assert not info["converged"] and info["rounds"] == 1


@pytest.mark.parametrize("block", [2048, 9])
def test_extremes_of_groups(spark, cloud, small_trees, block):
    from tessera.operators import linkage as L
    c = np.repeat([0, 1, 2, 3, 7], [60, 50, 70, 89, 1])
    d = distances(cloud)
    got = {r["g"]: r for r in L.group_extremes(table(spark, cloud, c), "cluster", block).collect()}
    assert set(got) == set(c.tolist())
    for g in got:
        assert got[g]["intra"] == pytest.approx(d[np.ix_(c == g, c == g)].max())
        assert got[g]["inter"] == pytest.approx(d[np.ix_(c == g, c != g)].min())
    alone = L.group_extremes(table(spark, cloud, c * 0), "cluster", block).first()
    assert alone["inter"] is None and alone["intra"] == pytest.approx(d.max())


def silhouette_of(x, c):
    d = distances(x)
    s = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        s.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(s)


def test_four_point_values(spark):
    p = table(spark, FOUR, [0, 0, 1, 1])
    m = Q.moments(p)
    assert Q.silhouette(p, "euclidean").first()[0] == pytest.approx(0.900249, abs=1e-6)
    assert Q.calinski_harabasz(m) == pytest.approx(200)
    assert Q.davies_bouldin(p, m) == pytest.approx(0.1)
    assert Q.separation(m, Q.view_range(p)) == 1.0


def test_silhouette_in_blocks(spark, cloud):
    c = np.repeat([0, 1, 2, 3, 4], [60, 60, 60, 89, 1])
    p = table(spark, cloud, c)
    want = silhouette_of(cloud, c)
    assert Q.silhouette(p).first()[0] == pytest.approx(want)
    sums = B.distance_sums(p, "cluster", block=32)
    assert sums.agg(F.sum("total")).first()[0] == pytest.approx(distances(cloud).sum())
    assert Q.silhouette(p).first()["method"] == "euclidean"
    assert Q.silhouette(p, "squared").first()["method"] == "squared"


def test_adjusted_rand(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2])), "a int, b int")
    assert Q.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(0.242424, abs=1e-6)
    again = df.withColumn("b", 7 - F.col("a"))
    assert Q.adjusted_rand(again, "a", "b").first()[0] == 1.0


def test_unified_score_bounds(spark, cloud):
    good = np.repeat([0, 1, 2, 3], [60, 60, 60, 90])
    rng = np.random.default_rng(1)
    scores = []
    for c in (good, rng.integers(0, 4, len(cloud))):
        p = table(spark, cloud, c)
        shared = Q.unified_score(p, Q.View.of(p), 0.8).first()["unified_score"]
        alone = Q.unified_score(p, None, 0.8).first()["unified_score"]
        assert shared == pytest.approx(alone) and 0 <= shared <= 1
        scores.append(shared)
    assert scores[0] > scores[1]
    noisy = np.where(np.arange(len(cloud)) < 150, -1, good)
    assert Q.unified_score(table(spark, cloud, noisy)).first()["unified_score"] == 0.0


def test_dbscan_finds_blobs(spark, cloud):
    lab = K.dbscan(table(spark, cloud), 0.6, 5).labels.toPandas().set_index("id").cluster.sort_index()
    assert set(lab[180:]) == {0}
    for a in (0, 60, 120):
        assert len(set(lab[a:a + 60]) - {-1}) == 1
    assert set(lab) - {-1} == {0, 1, 2, 3}


def test_single_linkage_and_mean_shift(spark, cloud):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.2, (30, 2)) for c in ((0, 0), (5, 5))])
    for fit in (K.single_linkage(table(spark, x), 2), K.mean_shift(table(spark, x), 1.5)):
        lab = fit.labels.toPandas().set_index("id").cluster.sort_index()
        assert len(set(lab[:30])) == 1 and len(set(lab[30:])) == 1 and lab[0] != lab[40]


@pytest.mark.parametrize("name,params", [
    ("KMeans", {"n_clusters": 2}), ("BisectingKMeans", {"n_clusters": 2}),
    ("GaussianMixture", {"n_components": 2, "covariance_type": "full"}),
    ("GaussianMixture", {"n_components": 2, "covariance_type": "diag"}),
    ("Birch", {"threshold": 0.5, "n_clusters": 2})])
def test_centroid_models_separate_blobs(spark, name, params):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 5))])
    p = table(spark, x)
    lab = K.fit(name, p, params).labels.toPandas().set_index("id").cluster.sort_index()
    assert len(set(lab[:40])) == 1 and len(set(lab[40:])) == 1 and lab[0] != lab[50]


def test_stability_and_gap(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 5))])
    p = table(spark, x)
    assert Q.stability(p, lambda s: K.kmeans(s, 2).labels, runs=3) == pytest.approx(1.0)
    assert Q.gap_statistic(p, 2, refs=2) > 0.5


def test_starts_of_all_sets_in_one_pass(spark):
    """Each start ends where plain k-means from the same centres does."""
    rng = np.random.default_rng(4)
    sets = [rng.normal(size=(80, 3)), rng.uniform(size=(80, 3)) * 4]
    begin = np.stack([np.stack([x[rng.choice(80, 4, replace=False)] for _ in range(3)]) for x in sets])
    rows = [(r, [float(c) for c in v]) for r, x in enumerate(sets) for v in x]
    got = Q.inertias(spark.createDataFrame(rows, "part int, vec array<double>"), begin, tol=1e-9)
    for r, x in enumerate(sets):
        for s in range(3):
            c = begin[r, s].copy()
            for _ in range(100):
                near = ((x[:, None] - c[None]) ** 2).sum(-1)
                at = near.argmin(1)
                c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(4)])
            assert got[r, s] == pytest.approx(near.min(1).sum())


def test_gap_of_wide_tables(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, (60, 55)) for c in (0, 3)])
    p = table(spark, x)
    assert Q.gap_statistic(p, 2, refs=2, inits=3) > Q.gap_statistic(
        table(spark, rng.uniform(size=(120, 55))), 2, refs=2, inits=3)


def test_reduced_space_and_view(spark):
    rng = np.random.default_rng(3)
    p = table(spark, rng.normal(size=(50, 6)))
    assert len(K.reduced(p)[0].first()["vec"]) == 5
    assert len(K.view_2d(p).first()["vec"]) == 2


def test_statistics(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 2.0), (1, 5.0)], "cluster int, x double")
    r = {x["cluster"]: x for x in Q.cluster_statistics(df, ["x"]).collect()}
    assert (r[0]["median"], r[0]["mode"], r[0]["count"]) == (2.0, 2.0, 3)
    assert r[0]["var"] == pytest.approx(1 / 3) and r[1]["std"] is None


def test_unpruned_distances_meet_in_few_large_chunks(spark, monkeypatch):
    """In many dimensions no leaf is ruled out: rows travel to some chunks, not to every leaf."""
    from tessera.operators import kth
    from tessera.operators.pivots import Tree
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 24))
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    pairs = []
    real = B._meet
    monkeypatch.setattr(B, "_meet", lambda q, r, chunks, *rest: pairs.extend(
        chunks.selectExpr("n_a * n_b AS n").toPandas().n) or real(q, r, chunks, *rest))
    monkeypatch.setattr(Tree, "replicas", lambda *a, **k: pytest.fail("copies for every leaf"))
    got = B.nearest(table(spark, x), table(spark, x), 3, skip_self=True, block=8).toPandas()
    want = np.sort(d, axis=1)[:, :3]
    assert np.allclose(got.sort_values(["id", "place"]).dist.to_numpy().reshape(-1, 3), want)
    assert max(pairs) <= B.SIDES**2
    got = kth.kth_distance(table(spark, x), 90, block=8).toPandas().set_index("id").dist.sort_index()
    assert np.allclose(got, np.sort(d, axis=1)[:, 89])
    assert max(pairs) <= B.SIDES**2


@pytest.mark.parametrize("block", [2048, 16])
def test_distance_sums_meet_each_two_chunks_once(spark, cloud, block):
    cluster = np.arange(len(cloud)) % 5
    sums = B.distance_sums(table(spark, cloud, cluster).repartition(3), "cluster", block)
    got = sums.toPandas().set_index(["id", "other"])["total"]
    want = distances(cloud) @ np.eye(5)[cluster]
    assert len(got) == want.size
    assert all(abs(got[i, c] - want[i, c]) < 1e-9 for i in range(len(cloud)) for c in range(5))
    # Every two chunks meet in one task, not in both orders, and tasks are not merged by bytes.
    sides = -(-len(cloud) // B._wide(len(cloud), block))
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    dealt = [x for x in plan.splitlines() if "RepartitionByExpression" in x]
    assert len(dealt) == 2 and all(x.endswith(f"], {sides * (sides + 1)}") for x in dealt)


def test_heavy_leaves_are_dealt_into_tasks(spark, monkeypatch):
    """Few rows make much work: the groups of a join don't end in the tasks that their bytes call for."""
    from pyspark import TaskContext

    from tessera.operators import linkage as L

    x = np.random.default_rng(3).normal(size=(2000, 2))
    p = table(spark, x)
    monkeypatch.setattr(B, "PAIRS_A_TASK", 1 << 11, raising=False)

    def kernel(l, r):
        return pd.DataFrame({"part": [TaskContext.get().partitionId()]})

    found = B.block_join(p, p, kernel, "part int", radius=0.1, block=64)
    assert found.distinct().count() >= 16
    tables, keep = {}, L.written

    def written(df, name="stage"):
        tables[name] = out = keep(df, name)
        return out

    monkeypatch.setattr(L, "written", written)
    assert L.spanning_tree(p, block=64).count() == len(x) - 1
    assert tables["settled"].select(F.input_file_name()).distinct().count() >= 16
