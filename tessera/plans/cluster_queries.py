"""Queries for distances, graphs, clusterers and cluster quality, over embeddings and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import blocks as B, graph as G, quality as Q
from tessera.plans.catalog import query, table


def labelled(spark, d):
    """All embeddings with their label as the cluster."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").alias("cluster"))


def plane(spark, d):
    """First two dimensions of all embeddings; the label is the cluster, label 9 is noise."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("vec"),
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster"))


E_SQL = """e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label AS cluster
    FROM embeddings)"""
P_SQL = """e AS (SELECT vec_id AS id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)] AS vec,
    CASE WHEN label = 9 THEN -1 ELSE label END AS cluster FROM embeddings),
  g AS (SELECT * FROM e WHERE cluster <> -1)"""
PAIRS = """d AS (SELECT a.id, b.id AS nbr, a.cluster AS ca, b.cluster AS cb,
    LIST_DISTANCE(a.vec, b.vec) AS dist FROM e a, e b WHERE a.id <> b.id)"""
G_PAIRS = """d AS (SELECT a.id, b.id AS nbr, a.cluster AS ca, b.cluster AS cb,
    LIST_DISTANCE(a.vec, b.vec) AS dist FROM g a, g b WHERE a.id <> b.id)"""
RANKED = """r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY dist, nbr) AS place FROM d)"""


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("g1_nearest_neighbours", f"""WITH {E_SQL}, {PAIRS}, {RANKED}
  SELECT id, nbr, ROUND(dist, 6) AS dist, CAST(place AS INT) AS place FROM r WHERE place <= 5""")
def g1(spark, d):
    p = labelled(spark, d)
    return r6(B.nearest(p, p, 5, skip_self=True), "dist").select("id", "nbr", "dist", "place")


RADIUS = 0.05


@query("g2_radius_components", f"""WITH RECURSIVE {P_SQL}, link AS (
    SELECT a.id AS u, b.id AS v FROM e a, e b WHERE LIST_DISTANCE(a.vec, b.vec) <= {RADIUS}),
  reach(id, c) AS (SELECT id, id FROM e UNION SELECT link.v, reach.c FROM reach JOIN link ON link.u = reach.id)
  SELECT id, MIN(c) AS component FROM reach GROUP BY id""")
def g2(spark, d):
    p = plane(spark, d)
    return G.connected_components(p, B.radius_links(p, RADIUS))


@query("q1_noise_ratio", f"""WITH {P_SQL}
  SELECT ROUND(AVG(CAST(cluster = -1 AS INT)), 6) AS noise_ratio FROM e""")
def q1(spark, d):
    return r6(Q.noise_ratio(plane(spark, d)), "noise_ratio")


def _sil(dist):
    return f"""m AS (SELECT id, ca, cb, SUM({dist}) AS s, COUNT(*) AS n FROM d GROUP BY 1, 2, 3),
  ab AS (SELECT id, MAX(CASE WHEN ca = cb THEN s / n END) AS a,
         MIN(CASE WHEN ca <> cb THEN s / n END) AS b FROM m GROUP BY id)
  SELECT ROUND(AVG((b - a) / GREATEST(a, b)), 6) AS silhouette FROM ab"""


@query("q1_penalised_silhouette", f"""WITH {P_SQL}, {G_PAIRS}, {_sil('dist').replace(
    "ROUND(AVG((b - a) / GREATEST(a, b)), 6)",
    "ROUND(AVG((b - a) / GREATEST(a, b)) * (1 - (SELECT AVG(CAST(cluster = -1 AS INT)) FROM e)), 6)")}""")
def q1_penalised(spark, d):
    return r6(Q.penalised_silhouette(plane(spark, d)), "silhouette").select("silhouette")


@query("q2_silhouette", f"WITH {P_SQL}, {G_PAIRS}, {_sil('dist')}")
def q2(spark, d):
    return r6(Q.silhouette(plane(spark, d), "euclidean"), "silhouette").select("silhouette")


@query("q2_silhouette_squared", f"WITH {P_SQL}, {G_PAIRS}, {_sil('dist * dist')}")
def q2_squared(spark, d):
    return r6(Q.silhouette(plane(spark, d), "squared"), "silhouette").select("silhouette")


MOM = """x AS (SELECT id, cluster, UNNEST(vec) AS v, UNNEST(RANGE(1, LEN(vec) + 1)) AS i FROM g),
  c AS (SELECT cluster, i, AVG(v) AS m, VAR_POP(v) * COUNT(*) AS ss, COUNT(*) AS n FROM x GROUP BY 1, 2),
  a AS (SELECT i, AVG(v) AS m FROM x GROUP BY 1)"""


@query("q3_calinski_harabasz", f"""WITH {P_SQL}, {MOM},
  t AS (SELECT SUM(n * (c.m - a.m) * (c.m - a.m)) AS b, SUM(ss) AS w,
               COUNT(DISTINCT cluster) AS k, (SELECT COUNT(*) FROM g) AS n FROM c JOIN a USING (i))
  SELECT ROUND((b / (k - 1)) / (w / (n - k)), 6) AS ch FROM t""")
def q3(spark, d):
    value = Q.calinski_harabasz(Q.moments(plane(spark, d)))
    return r6(spark.createDataFrame([(value,)], "ch double"), "ch")


DBI = """cen AS (SELECT cluster, LIST(m ORDER BY i) AS mv FROM c GROUP BY 1),
  s AS (SELECT g.cluster, AVG(LIST_DISTANCE(vec, mv)) AS s FROM g JOIN cen USING (cluster) GROUP BY 1),
  r AS (SELECT p.cluster, MAX((p.s + q.s) / LIST_DISTANCE(pc.mv, qc.mv)) AS r
        FROM s p, s q, cen pc, cen qc WHERE p.cluster <> q.cluster AND pc.cluster = p.cluster
          AND qc.cluster = q.cluster GROUP BY 1)"""


@query("q4_davies_bouldin", f"WITH {P_SQL}, {MOM}, {DBI} SELECT ROUND(AVG(r), 6) AS dbi FROM r")
def q4(spark, d):
    p = plane(spark, d)
    return r6(spark.createDataFrame([(Q.davies_bouldin(p, Q.moments(p)),)], "dbi double"), "dbi")


PURITY = """SELECT AVG(CAST(ca = cb AS INT)) AS purity FROM r WHERE place <= 7"""


@query("q5_neighbour_purity", f"""WITH {P_SQL}, {G_PAIRS}, {RANKED}
  SELECT ROUND(purity, 6) AS purity FROM ({PURITY})""")
def q5(spark, d):
    return r6(Q.purity(plane(spark, d)), "purity")


CONN = """lim AS (SELECT 3 * QUANTILE_CONT(dist, 0.5) AS r FROM r WHERE place = 1),
  link AS (SELECT id AS u, nbr AS v FROM d, lim WHERE ca = cb AND dist <= lim.r),
  reach(id, c) AS (SELECT id, id FROM g UNION SELECT link.v, reach.c FROM reach JOIN link ON link.u = reach.id),
  comp AS (SELECT id, MIN(c) AS c FROM reach GROUP BY id),
  sz AS (SELECT cluster, c, COUNT(*) AS n FROM comp JOIN g USING (id) GROUP BY 1, 2),
  pen AS (SELECT cluster, SUM(n) AS size, SUM(CAST(n >= GREATEST(3, CEIL(0.05 * tot)) AS INT)) AS major
          FROM (SELECT *, SUM(n) OVER (PARTITION BY cluster) AS tot FROM sz) GROUP BY 1)"""
CONN_VALUE = "AVG(CASE WHEN size < 3 OR major <= 1 THEN 1.0 ELSE POWER(0.85, major - 1) END)"


@query("q6_connectivity", f"""WITH RECURSIVE {P_SQL}, {G_PAIRS}, {RANKED}, {CONN}
  SELECT ROUND({CONN_VALUE}, 6) AS connectivity FROM pen""")
def q6(spark, d):
    return r6(Q.connectivity(plane(spark, d)), "connectivity")


SEP = """len AS (SELECT SQRT(SUM(POWER(QUANTILE_CONT(v, 0.95) - QUANTILE_CONT(v, 0.05), 2))) AS l FROM (
    SELECT i, v FROM (SELECT UNNEST(vec) AS v, UNNEST(RANGE(1, LEN(vec) + 1)) AS i FROM e)) GROUP BY i)"""
SEP = """rng AS (SELECT i, QUANTILE_CONT(v, 0.95) - QUANTILE_CONT(v, 0.05) AS w FROM (
    SELECT UNNEST(vec) AS v, UNNEST(RANGE(1, LEN(vec) + 1)) AS i FROM e) GROUP BY i),
  len AS (SELECT SQRT(SUM(w * w)) AS l FROM rng),
  sep AS (SELECT LEAST(1.0, 2 * AVG(LIST_DISTANCE(p.mv, q.mv)) / MAX(l)) AS separation
          FROM cen p, cen q, len WHERE p.cluster < q.cluster)"""


@query("q7_centroid_separation", f"""WITH {P_SQL}, {MOM},
  cen AS (SELECT cluster, LIST(m ORDER BY i) AS mv FROM c GROUP BY 1), {SEP}
  SELECT ROUND(separation, 6) AS separation FROM sep""")
def q7(spark, d):
    p = plane(spark, d)
    return r6(spark.createDataFrame([(Q.separation(Q.moments(p), Q.view_range(p)),)],
                                    "separation double"), "separation")


ARI = """t AS (SELECT a, b, COUNT(*) AS n FROM l GROUP BY 1, 2),
  s AS (SELECT (SELECT SUM(n * (n - 1) / 2.0) FROM t) AS sab,
    (SELECT SUM(n * (n - 1) / 2.0) FROM (SELECT SUM(n) AS n FROM t GROUP BY a)) AS sa,
    (SELECT SUM(n * (n - 1) / 2.0) FROM (SELECT SUM(n) AS n FROM t GROUP BY b)) AS sb,
    (SELECT SUM(n) * (SUM(n) - 1) / 2.0 FROM t) AS tot)
  SELECT ROUND((sab - sa * sb / tot) / ((sa + sb) / 2 - sa * sb / tot), 6) AS ari FROM s"""


@query("q10_adjusted_rand", f"""WITH l AS (SELECT label AS a, CASE WHEN embedding[1] > 0.05 THEN 2
    WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS b FROM embeddings), {ARI}""")
def q10(spark, d):
    x = F.col("embedding")[0]
    lab = table(spark, d, "embeddings").select("label", F.when(x > F.lit(0.05), 2).when(
        x > 0, 1).otherwise(0).alias("b"))
    return r6(Q.adjusted_rand(lab, "label", "b"), "ari")


STATS_SQL = """SELECT l_returnflag AS cluster, '{c}' AS "column", ROUND(AVG({c}), 6) AS mean,
  QUANTILE_CONT({c}, 0.5) AS median, (SELECT {c} FROM lineitem b WHERE b.l_returnflag = a.l_returnflag
    GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS mode, MIN({c}) AS min, MAX({c}) AS max,
  ROUND(STDDEV({c}), 6) AS std, ROUND(VARIANCE({c}), 6) AS var, COUNT({c}) AS count
  FROM lineitem a GROUP BY l_returnflag"""
STATS_SQL = """SELECT a.*, b.mode FROM (SELECT l_returnflag AS cluster, '{c}' AS "column",
  ROUND(AVG({c}), 6) AS mean, ROUND(QUANTILE_CONT({c}, 0.5), 6) AS median, MIN({c}) AS min,
  MAX({c}) AS max, ROUND(STDDEV({c}), 6) AS std, ROUND(VARIANCE({c}), 6) AS var,
  COUNT({c}) AS count FROM lineitem GROUP BY 1) a JOIN (
  SELECT l_returnflag, {c} AS mode FROM (SELECT l_returnflag, {c}, ROW_NUMBER() OVER (
    PARTITION BY l_returnflag ORDER BY COUNT(*) DESC, {c}) AS rn FROM lineitem GROUP BY 1, 2)
  WHERE rn = 1) b ON a.cluster = b.l_returnflag"""


@query("q14_cluster_statistics", " UNION ALL ".join(
    STATS_SQL.format(c=c) for c in ("l_quantity", "l_discount")))
def q14(spark, d):
    li = table(spark, d, "lineitem").withColumn("cluster", F.col("l_returnflag"))
    return r6(Q.cluster_statistics(li, ["l_quantity", "l_discount"]), "mean", "median", "std",
              "var")


@query("q15_plot_table", f"""WITH {P_SQL}, n AS (SELECT cluster, AVG(vec[1]) AS cx, AVG(vec[2]) AS cy
  FROM e GROUP BY 1) SELECT 'cluster_' || cluster AS cluster_name, vec[1] AS x, vec[2] AS y,
  ROUND(cx, 6) AS cx, ROUND(cy, 6) AS cy FROM e JOIN n USING (cluster)""")
def q15(spark, d):
    p = plane(spark, d)
    c = Q.centroids(p).select("cluster_name", F.round(F.col("centroid")[0], 6).alias("cx"),
                              F.round(F.col("centroid")[1], 6).alias("cy"))
    return Q.plot_table(p).join(c, "cluster_name")


BAL = """cnt AS (SELECT cluster, COUNT(*) AS n FROM g GROUP BY 1),
  rat AS (SELECT MAX(n) * 1.0 / SUM(n) AS hi, MIN(n) * 1.0 / SUM(n) AS lo, COUNT(*) AS k,
    (SELECT AVG(CAST(cluster = -1 AS INT)) FROM e) AS noise FROM cnt)"""
SIL_RAW = """m AS (SELECT id, ca, cb, SUM(dist) AS s, COUNT(*) AS n FROM d GROUP BY 1, 2, 3),
  ab AS (SELECT id, MAX(CASE WHEN ca = cb THEN s / n END) AS a,
         MIN(CASE WHEN ca <> cb THEN s / n END) AS b FROM m GROUP BY id),
  sil AS (SELECT AVG((b - a) / GREATEST(a, b)) AS sil FROM ab)"""
PENALTIES = """CASE WHEN hi <= 0.9 THEN 1.0 ELSE GREATEST(0.5, 1 - 1.5 * (hi - 0.9)) END AS balance,
  CASE WHEN lo >= 0.01 THEN 1.0 ELSE GREATEST(0.75, lo / 0.01) END AS micro,
  CASE WHEN k = 2 THEN 0.95 WHEN k BETWEEN 3 AND 7 THEN 1.0 ELSE EXP(-0.02 * GREATEST(0, k - 7)) END AS kp,
  1 - noise AS np, CASE WHEN sil > 0.1 THEN 1.0 ELSE GREATEST(0.01, sil) / 0.1 END AS sp"""


@query("q11_penalties", f"""WITH {P_SQL}, {G_PAIRS}, {BAL}, {SIL_RAW},
  v AS (SELECT {PENALTIES} FROM rat, sil)
  SELECT ROUND(balance, 6) AS m_balance_penalty, ROUND(micro, 6) AS m_micro_penalty,
    ROUND(kp, 6) AS m_k_penalty, ROUND(np, 6) AS m_noise_penalty, ROUND(sp, 6) AS m_separation_penalty
  FROM v""")
def q11(spark, d):
    cols = ["m_balance_penalty", "m_micro_penalty", "m_k_penalty", "m_noise_penalty",
            "m_separation_penalty"]
    return r6(Q.unified_score(plane(spark, d), method="euclidean"), *cols).select(*cols)


@query("q12_unified_score", f"""WITH RECURSIVE {P_SQL}, {G_PAIRS}, {RANKED}, {CONN}, {BAL}, {SIL_RAW},
  {MOM}, {DBI.replace('r AS (', 'rr AS (')}, {SEP},
  ch AS (SELECT (SUM(n * (c.m - a.m) * (c.m - a.m)) / (COUNT(DISTINCT cluster) - 1)) /
      (SUM(ss) / ((SELECT COUNT(*) FROM g) - COUNT(DISTINCT cluster))) AS ch FROM c JOIN a USING (i)),
  v AS (SELECT {PENALTIES}, sil, (SELECT purity FROM ({PURITY})) AS pu, (SELECT ch FROM ch) AS ch,
      (SELECT AVG(r) FROM rr) AS dbi, (SELECT separation FROM sep) AS sep,
      (SELECT {CONN_VALUE} FROM pen) AS con, 0.5 AS stab, TANH(0.9 / 3) AS gp FROM rat, sil),
  b AS (SELECT *, (0.25 * GREATEST(0, sil) + 0.15 / (1 + dbi) + 0.15 * pu
      + 0.15 * LN(1 + ch) / (LN(1 + ch) + 2) + 0.15 * sep + 0.10 * stab + 0.05 * gp) / 1.0 AS base FROM v)
  SELECT ROUND(LEAST(1, GREATEST(0, LEAST(1, base * 1.2) * balance * micro * kp * np * sp * pu * con)), 6)
    AS unified_score, ROUND(pu, 6) AS purity, ROUND(con, 6) AS connectivity FROM b""")
def q12(spark, d):
    p = plane(spark, d)
    out = Q.unified_score(p, stability_value=0.5, gap=0.9, method="euclidean")
    return r6(out, "unified_score", "purity", "connectivity").select(
        "unified_score", "purity", "connectivity")


@query("q12_unified_score_shared_view")
def q12_view(spark, d):
    """All embeddings, no noise: neighbours come from the shared table."""
    p = labelled(spark, d).withColumn("vec", F.slice("vec", 1, 2))
    return Q.unified_score(p, Q.View.of(p), method="euclidean")


@query("q16_posthoc_score", f"""WITH {P_SQL}, {G_PAIRS}, {SIL_RAW}, {MOM},
  cen AS (SELECT cluster, LIST(m ORDER BY i) AS mv FROM c GROUP BY 1),
  near AS (SELECT id, g.cluster AS own, ARG_MIN(cen.cluster, LIST_DISTANCE(vec, mv)) AS best
           FROM g, cen GROUP BY 1, 2),
  bad AS (SELECT AVG(CAST(own <> best AS INT)) AS bad FROM near),
  ext AS (SELECT ca, MAX(CASE WHEN ca = cb THEN dist END) AS intra,
          MIN(CASE WHEN ca <> cb THEN dist END) AS inter FROM d GROUP BY 1),
  mp AS (SELECT COALESCE(AVG(LEAST(1.0, intra / inter)), 0) AS mp FROM ext WHERE inter > 1e-6),
  ov AS (SELECT LEAST(1, GREATEST(0, 1 - (0.5 * bad + 0.5 * mp))) AS ov FROM bad, mp),
  ch AS (SELECT LN(1 + (SUM(n * (c.m - a.m) * (c.m - a.m)) / (COUNT(DISTINCT cluster) - 1)) /
      (SUM(ss) / ((SELECT COUNT(*) FROM g) - COUNT(DISTINCT cluster)))) AS lc FROM c JOIN a USING (i)),
  sp AS (SELECT TANH(AVG(LIST_DISTANCE(p.mv, q.mv))) AS cs FROM cen p, cen q WHERE p.cluster < q.cluster),
  nz AS (SELECT AVG(CAST(cluster = -1 AS INT)) AS nz FROM e)
  SELECT ROUND(ov, 6) AS overlap_score, ROUND(cs, 6) AS centroid_sep,
    ROUND((0.15 * sil + 0.1 * lc / (lc + 5) + 0.5 * 50 + 0.05 * TANH(0.9 / 3) + 0.15 * ov + 0.05 * cs)
      * (1 - 0.25 * nz) * CASE WHEN sil > 0.2 THEN 1 ELSE sil / 0.2 END * ov, 6) AS score
  FROM sil, ov, ch, sp, nz""")
def q16(spark, d):
    s = Q.posthoc_score(plane(spark, d), stability_value=0.5, gap=0.9)
    out = spark.createDataFrame([(s["overlap_score"], s["centroid_sep"], s["score"])],
                                "overlap_score double, centroid_sep double, score double")
    return r6(out, *out.columns)


# ---------------------------------------------------------------- clusterers

from pyspark.ml.functions import vector_to_array  # noqa: E402

from tessera.operators import cluster as K, shift as S  # noqa: E402


def pts(p):
    return p.select("id", "vec")


def sizes(fit):
    return fit.labels.groupBy("cluster").agg(F.count("*").alias("n"))


@query("k1_reduced_space")
def k1(spark, d):
    space, _ = K.reduced(pts(labelled(spark, d)))
    return space.select("id", F.size("vec").alias("width"),
                        F.round(F.abs(F.col("vec")[0]), 6).alias("first"))


@query("k2_view")
def k2(spark, d):
    return K.view_2d(pts(labelled(spark, d)))


@query("k3_kmeans")
def k3(spark, d):
    return sizes(K.kmeans(pts(labelled(spark, d)), 5))


@query("k3_lloyd_step", f"""WITH {P_SQL}, a AS (SELECT id, vec, CASE
    WHEN LIST_DISTANCE(vec, [-0.1, 0.0]) <= LIST_DISTANCE(vec, [0.1, 0.05]) THEN 0 ELSE 1 END AS c FROM e)
  SELECT CAST(c AS INT) AS cluster, COUNT(*) AS n, ROUND(AVG(vec[1]), 6) AS x, ROUND(AVG(vec[2]), 6) AS y
  FROM a GROUP BY 1""")
def k3_step(spark, d):
    import numpy as np
    out = K.lloyd_step(pts(plane(spark, d)), np.array([[-0.1, 0.0], [0.1, 0.05]]))
    return out.select("cluster", "n", F.round(F.col("centre")[0], 6).alias("x"),
                      F.round(F.col("centre")[1], 6).alias("y"))


@query("k4_bisecting_kmeans")
def k4(spark, d):
    return sizes(K.bisecting_kmeans(pts(labelled(spark, d)), 5))


@query("k5_gaussian_mixture_full")
def k5(spark, d):
    return sizes(K.gaussian_mixture(pts(plane(spark, d)), 3))


@query("k5_gaussian_mixture_diagonal")
def k5_diag(spark, d):
    return sizes(K.gaussian_mixture(pts(plane(spark, d)), 3, "diag"))


@query("k6_core_counts", f"""WITH {P_SQL} SELECT a.id, COUNT(*) AS n FROM e a, e b
  WHERE LIST_DISTANCE(a.vec, b.vec) <= {RADIUS} GROUP BY 1""")
def k6_counts(spark, d):
    return B.neighbour_counts(pts(plane(spark, d)), RADIUS)


@query("k6_dbscan", f"""WITH RECURSIVE {P_SQL}, link AS (
    SELECT a.id AS u, b.id AS v FROM e a, e b WHERE LIST_DISTANCE(a.vec, b.vec) <= {RADIUS}),
  core AS (SELECT u AS id FROM link GROUP BY 1 HAVING COUNT(*) >= 8),
  cl AS (SELECT u, v FROM link WHERE u IN (FROM core) AND v IN (FROM core)),
  reach(id, c) AS (SELECT id, id FROM core UNION SELECT cl.v, reach.c FROM reach JOIN cl ON cl.u = reach.id),
  comp AS (SELECT id, MIN(c) AS root FROM reach GROUP BY id),
  border AS (SELECT v AS id, MIN(root) AS root FROM link JOIN comp ON comp.id = u
             WHERE v NOT IN (FROM core) GROUP BY 1)
  SELECT e.id, root FROM e LEFT JOIN (FROM comp UNION ALL FROM border) USING (id)""")
def k6(spark, d):
    return K.core_components(pts(plane(spark, d)), RADIUS, 8)


@query("k7_mean_shift_step", f"""WITH {P_SQL}, s AS (
    SELECT DISTINCT ROUND(vec[1] / 0.1) * 0.1 AS sx, ROUND(vec[2] / 0.1) * 0.1 AS sy FROM e)
  SELECT ROUND(sx, 6) AS sx, ROUND(sy, 6) AS sy, COUNT(*) AS n, ROUND(AVG(vec[1]), 6) AS mx,
         ROUND(AVG(vec[2]), 6) AS my FROM s, e WHERE LIST_DISTANCE(vec, [sx, sy]) <= 0.1 GROUP BY 1, 2""")
def k7_step(spark, d):
    p = pts(plane(spark, d))
    seeds = S.bin_seeds(p, 0.1)
    step = S.Grid(p, 0.1).step(seeds).join(seeds, "id")
    return r6(step.select(F.col("vec")[0].alias("sx"), F.col("vec")[1].alias("sy"), "n",
                          F.col("mean")[0].alias("mx"), F.col("mean")[1].alias("my")),
              "sx", "sy", "mx", "my")


@query("k7_mean_shift")
def k7(spark, d):
    return sizes(K.mean_shift(pts(plane(spark, d)), 0.15))


@query("k8_micro_clusters", f"""WITH {P_SQL} SELECT CAST(FLOOR(vec[1] / 0.05) AS BIGINT) AS cx,
  CAST(FLOOR(vec[2] / 0.05) AS BIGINT) AS cy, COUNT(*) AS n, ROUND(AVG(vec[1]), 6) AS mx,
  ROUND(AVG(vec[2]), 6) AS my FROM e GROUP BY 1, 2""")
def k8_micro(spark, d):
    m = K.micro_clusters(pts(plane(spark, d)), 0.05).withColumn("m", vector_to_array("mean"))
    return m.select(F.col("cell")[0].alias("cx"), F.col("cell")[1].alias("cy"), "n",
                    F.round(F.col("m")[0], 6).alias("mx"), F.round(F.col("m")[1], 6).alias("my"))


@query("k8_two_stage")
def k8(spark, d):
    return sizes(K.two_stage(pts(labelled(spark, d)), 0.5, 4))


def _tree_sql(rounds=9, doublings=9):
    """Borůvka rounds over all pairs: table ``mst`` (w, u, v), ties by the ends."""
    steps = ["""d AS MATERIALIZED (SELECT a.id AS u, b.id AS v, LIST_DISTANCE(a.vec, b.vec) AS w
        FROM e a JOIN e b ON a.id < b.id), l0 AS (SELECT id, id AS c FROM e)"""]
    for r in range(rounds):
        steps.append(f"""x{r} AS (SELECT a.c AS a, b.c AS b, w, u, v FROM d JOIN l{r} a ON a.id = u
            JOIN l{r} b ON b.id = v WHERE a.c <> b.c),
          b{r} AS MATERIALIZED (SELECT c, MIN(ROW(w, u, v, o)) AS s FROM (SELECT a AS c, b AS o, w, u, v FROM x{r}
            UNION ALL SELECT b, a, w, u, v FROM x{r}) GROUP BY c),
          p{r}_0 AS MATERIALIZED (SELECT a.c, CASE WHEN b.s[4] = a.c AND a.c < a.s[4] THEN a.c ELSE a.s[4] END AS r
            FROM b{r} a JOIN b{r} b ON b.c = a.s[4])""")
        steps += [f"""p{r}_{i + 1} AS MATERIALIZED (SELECT a.c, b.r FROM p{r}_{i} a JOIN p{r}_{i} b ON b.c = a.r)"""
                  for i in range(doublings)]
        steps.append(f"""l{r + 1} AS MATERIALIZED (SELECT id, COALESCE(r, l.c) AS c
            FROM l{r} l LEFT JOIN p{r}_{doublings} p ON p.c = l.c)""")
    steps.append("mst AS MATERIALIZED (" + " UNION ".join(
        f"SELECT s[1] AS w, s[2] AS u, s[3] AS v FROM b{r}" for r in range(rounds)) + ")")
    return ", ".join(steps)


NUMBERED = """SELECT id, CAST(code AS INT) AS cluster FROM part JOIN (SELECT c, ROW_NUMBER() OVER (
    ORDER BY COUNT(*) DESC, MIN(id)) - 1 AS code FROM part GROUP BY c) USING (c)"""


@query("k9_single_linkage", f"""WITH RECURSIVE {P_SQL}, {_tree_sql()},
  kept AS (SELECT u, v FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY w DESC, u DESC, v DESC) AS i FROM mst)
    WHERE i > 3),
  link AS (FROM kept UNION ALL SELECT v, u FROM kept),
  reach(id, c) AS (SELECT id, id FROM e UNION SELECT link.v, reach.c FROM reach JOIN link ON link.u = reach.id),
  part AS (SELECT id, MIN(c) AS c FROM reach GROUP BY id) {NUMBERED}""")
def k9(spark, d):
    return K.single_linkage(pts(plane(spark, d)), 4).labels


def prices(spark, d):
    """All orders on a line."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(
        F.col("o_totalprice").cast("double")).alias("vec"))


@query("k9_single_linkage_orders", f"""WITH g AS (SELECT o_orderkey AS id, o_totalprice AS x,
    o_totalprice - LAG(o_totalprice) OVER (ORDER BY o_totalprice) AS w FROM orders),
  cut AS (SELECT x FROM g WHERE w > 0 ORDER BY w DESC LIMIT 7),
  part AS (SELECT id, (SELECT COUNT(*) FROM cut WHERE cut.x <= g.x) AS c FROM g) {NUMBERED}""")
def k9_orders(spark, d):
    return K.single_linkage(prices(spark, d), 8).labels


@query("g1_nearest_orders", """WITH s AS (SELECT o_orderkey AS id, o_totalprice AS x,
    ROW_NUMBER() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders),
  d AS (SELECT a.id, b.id AS nbr, ABS(a.x - b.x) AS dist FROM s a JOIN s b
    ON b.i BETWEEN a.i - 20 AND a.i + 20 AND b.i <> a.i)
  SELECT id, nbr, ROUND(dist, 6) AS dist, CAST(place AS INT) AS place FROM (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY id ORDER BY dist, nbr) AS place FROM d) WHERE place <= 5""")
def g1_orders(spark, d):
    p = prices(spark, d)
    return r6(B.nearest(p, p, 5, skip_self=True), "dist").select("id", "nbr", "dist", "place")


@query("k11_bandwidth_events", """WITH s AS (SELECT value AS x, ROW_NUMBER() OVER (ORDER BY value) AS i,
    (SELECT CAST(FLOOR(0.3 * COUNT(*)) AS INT) - 1 FROM events) AS k FROM events),
  r AS (SELECT a.i, MIN(GREATEST(a.x - lo.x, hi.x - a.x)) AS dist FROM s a
    JOIN s lo ON lo.i BETWEEN a.i - a.k AND a.i JOIN s hi ON hi.i = lo.i + a.k GROUP BY a.i)
  SELECT ROUND(AVG(dist), 6) AS bandwidth FROM r""")
def k11_events(spark, d):
    p = table(spark, d, "events").select(F.col("event_id").alias("id"),
                                         F.array(F.col("value").cast("double")).alias("vec"))
    return r6(K.estimate_bandwidth(p), "bandwidth")


@query("k10_eps_estimate", f"""WITH {E_SQL}, {PAIRS}, {RANKED},
  k AS (SELECT GREATEST(10, CAST(FLOOR(4 * LN(COUNT(*))) AS INT)) - 1 AS k FROM e)
  SELECT ROUND(QUANTILE_CONT(dist, 0.9), 6) AS eps FROM r, k WHERE place = k""")
def k10(spark, d):
    return r6(K.estimate_eps(pts(labelled(spark, d))), "eps")


@query("k11_bandwidth_estimate", f"""WITH {E_SQL}, {PAIRS}, {RANKED},
  k AS (SELECT CAST(FLOOR(0.3 * COUNT(*)) AS INT) - 1 AS k FROM e)
  SELECT ROUND(AVG(dist), 6) AS bandwidth FROM r, k WHERE place = k""")
def k11(spark, d):
    return r6(K.estimate_bandwidth(pts(labelled(spark, d))), "bandwidth")


@query("k12_k_curve")
def k12(spark, d):
    from tessera.plans.cluster_flow import k_curve
    p = pts(labelled(spark, d))
    return k_curve(p, p, "KMeans", {"n_clusters": 2}, range(2, K.k_limit(p.count()) + 1))


@query("q8_gap")
def q8(spark, d):
    p = pts(plane(spark, d))
    return spark.createDataFrame([(Q.gap_statistic(p, 3),)], "gap double")


@query("q9_stability")
def q9(spark, d):
    p = pts(plane(spark, d))
    value = Q.stability(p, lambda s: K.kmeans(s, 3).labels)
    return spark.createDataFrame([(value,)], "stability double")
