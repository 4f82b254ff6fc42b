"""Queries over ordination and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.operators import blocks, cluster, ordination
from assaygrid.operators.compare import corr_distance, corr_matrix, pair_distance
from assaygrid.plans.bind import CELLS, DENSE, R, SAMPLES, Catalog, assay, part_features, rnd, spectrum, vectors
from assaygrid.plans.compare import FILLED, LOGS, PAIRED
from assaygrid.plans.impute import SIL

catalog = Catalog()
add = catalog.add


@add(
    "ord_prep_cells",
    f"""WITH {CELLS}, {SAMPLES}, {DENSE}, l AS (SELECT feature_id, sample_id, log10(coalesce(value, 0) + 1) AS x FROM dense),
z AS (SELECT *, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 1e-12 THEN stddev_pop(x) OVER w ELSE 1e-8 END AS z FROM l WINDOW w AS (PARTITION BY feature_id))
SELECT feature_id, sample_id, {R('(z - avg(z) OVER s) / stddev_pop(z) OVER s')} AS value FROM z WINDOW s AS (PARTITION BY sample_id)""",
)
def prep_cells(spark, sf):
    return ordination.prep_cells(assay(spark, sf), z_sample=True).withColumn("value", rnd(F.col("value")))


@add(
    "ord_sample_pca_invariants",
    f"""WITH {CELLS}, l AS (SELECT feature_id, sample_id, log10(value) AS x FROM cells), m AS (SELECT sample_id, avg(x) AS m FROM l GROUP BY 1),
c AS (SELECT feature_id, sample_id, x - m AS x FROM l JOIN m USING (sample_id)), n AS (SELECT count(DISTINCT feature_id) - 1 AS n FROM cells),
cov AS (SELECT a.sample_id AS a, b.sample_id AS b, sum(a.x * b.x) / (SELECT n FROM n) AS v FROM c a JOIN c b USING (feature_id) GROUP BY 1, 2)
SELECT count(DISTINCT a) AS n, {R('sum(v) FILTER (WHERE a = b)')} AS total, {R('sum(v * v)')} AS total_sq FROM cov""",
)
def sample_pca_invariants(spark, sf):
    a = assay(spark, sf)
    logs = a.with_cells(a.cells.withColumn("value", F.log10("value")))
    variance = ordination.sample_pca(logs, a.n_samples).variance
    e = F.col("eigenvalue")
    return variance.agg(F.count("*").alias("n"), rnd(F.sum(e)).alias("total"), rnd(F.sum(e * e)).alias("total_sq"))


SAMPLE_COV = f"""WITH RECURSIVE {CELLS}, l AS (SELECT feature_id, sample_id, log10(value) AS x FROM cells), m AS (SELECT sample_id, avg(x) AS m FROM l GROUP BY 1),
c AS (SELECT feature_id, sample_id, x - m AS x FROM l JOIN m USING (sample_id)), n AS (SELECT count(DISTINCT feature_id) - 1 AS n FROM cells),
place AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS i FROM m),
cov AS (SELECT p.i, q.i AS j, sum(a.x * b.x) / (SELECT n FROM n) AS v FROM c a JOIN c b USING (feature_id) JOIN place p ON p.sample_id = a.sample_id JOIN place q ON q.sample_id = b.sample_id GROUP BY 1, 2)"""


def _entry(k: int, of: str) -> str:
    return R(f"max({of}) FILTER (WHERE c = {k})") + f" AS pc{k}"


@add(
    "ord_sample_pca",
    f"""{SAMPLE_COV}, {spectrum("cov", "3")}
SELECT sample_id, {', '.join(_entry(k, 'vec[i] * sqrt(value)') for k in (1, 2, 3))} FROM found, place GROUP BY sample_id""",
)
def sample_pca(spark, sf):
    a = assay(spark, sf)
    scores = ordination.sample_pca(a.with_cells(a.cells.withColumn("value", F.log10("value"))), 3).scores
    return scores.select("sample_id", *[rnd(F.col(f"pc{k}")).alias(f"pc{k}") for k in (1, 2, 3)])


def _shares(variance):
    return variance.select("component", *[(rnd(F.col(c)) + 0.0).alias(c) for c in ("eigenvalue", "share_extracted", "share_total")])


@add(
    "ord_sample_scree",
    f"""{SAMPLE_COV}, {spectrum("cov", "3")}
SELECT c AS component, {R('value')} AS eigenvalue, {R('value / sum(value) OVER ()')} AS share_extracted, {R('value / (SELECT sum(v) FROM cov WHERE i = j)')} AS share_total FROM found""",
)
def sample_scree(spark, sf):
    a = assay(spark, sf)
    return _shares(ordination.sample_pca(a.with_cells(a.cells.withColumn("value", F.log10("value"))), 3).variance)


DIM_COV = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), size AS (SELECT max(len(v)) AS d FROM e),
cov AS MATERIALIZED (SELECT i, j, covar_samp(v[i], v[j]) AS v FROM e, size, range(1, d + 1) a(i), range(1, d + 1) b(j) GROUP BY 1, 2),
{spectrum("cov", "3", 22)}"""


@add(
    "ord_scree",
    f"""{DIM_COV} SELECT c AS component, {R('value')} AS eigenvalue, {R('value / sum(value) OVER ()')} AS share_extracted, {R('value / (SELECT sum(v) FROM cov WHERE i = j)')} AS share_total FROM found""",
)
def scree(spark, sf):
    return _shares(ordination.pca(vectors(spark, sf), 3)[2])


@add(
    "ord_pca_scores",
    f"""{DIM_COV}, mean AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(v[i]) AS m FROM e, size, range(1, d + 1) a(i) GROUP BY 1)),
s AS (SELECT vec_id, c, list_dot_product(v, vec) - list_dot_product(m, vec) AS s FROM e, found, mean)
SELECT vec_id AS item_id, {', '.join(_entry(k, 's') for k in (1, 2, 3))} FROM s GROUP BY 1""",
)
def pca_scores(spark, sf):
    out = ordination.pca(vectors(spark, sf), 3)[0]
    return out.select("item_id", *[(rnd(F.col(f"pc{k}")) + 0.0).alias(f"pc{k}") for k in (1, 2, 3)])


@add(
    "ord_top_loadings",
    f"""{DIM_COV}, l AS (SELECT c, (i - 1)::INT AS dim, vec[i] AS x FROM found, size, range(1, d + 1) a(i))
SELECT dim, {', '.join(_entry(k, 'x') for k in (1, 2, 3))}, {R('max(abs(x))')} AS size FROM l GROUP BY dim ORDER BY max(abs(x)) DESC, dim LIMIT 10""",
)
def top_loadings(spark, sf):
    out = ordination.top_loadings(ordination.pca(vectors(spark, sf), 3)[1], 10)
    return out.select("dim", *[(rnd(F.col(c)) + 0.0).alias(c) for c in ("pc1", "pc2", "pc3", "size")])


@add(
    "ord_ellipses",
    f"""WITH e AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
g AS (SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM e GROUP BY 1 HAVING count(*) >= 3),
q AS (SELECT *, sqrt(((a - c) / 2) ** 2 + b * b) AS r FROM g)
SELECT label, n, {R('cx')} AS cx, {R('cy')} AS cy, {R('sqrt(5.991464547107979 * ((a + c) / 2 + r))')} AS major, {R('sqrt(5.991464547107979 * ((a + c) / 2 - r))')} AS minor,
{R('0.5 * atan2(2 * b, a - c)')} AS angle FROM q""",
)
def ellipses(spark, sf):
    v = vectors(spark, sf).select("label", F.col("vec")[0].alias("pc1"), F.col("vec")[1].alias("pc2"))
    out = ordination.ellipses(v, "label")
    return out.select("label", "n", *[rnd(F.col(c)).alias(c) for c in ("cx", "cy", "major", "minor", "angle")])


# the doubly centred matrix of distances d(a, b, distance), and its whole spectrum
CENTRED = f"""ends AS (SELECT a AS name FROM d UNION SELECT b FROM d), place AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM ends),
sq AS (SELECT p.i, q.i AS j, coalesce(max(distance) ** 2, 0) AS w FROM place p CROSS JOIN place q LEFT JOIN d ON (d.a = p.name AND d.b = q.name) OR (d.a = q.name AND d.b = p.name) GROUP BY 1, 2),
cov AS MATERIALIZED (SELECT i, j, -0.5 * (w - avg(w) OVER (PARTITION BY i) - avg(w) OVER (PARTITION BY j) + avg(w) OVER ()) AS v FROM sq),
{spectrum("cov", "n - 1")}, ranked AS (SELECT *, row_number() OVER (ORDER BY value DESC) AS k FROM found)"""
INERTIA = f"""SELECT k::INT AS component, {R('greatest(value, 0)')} AS eigenvalue, {R('value / sum(value) OVER ()')} AS share_extracted, {R('value / (SELECT sum(value) FROM found WHERE value > 0)')} AS share_total FROM ranked WHERE k <= 3
UNION ALL SELECT 0, {R('least(min(value), 0)')}, 0.0, {R('coalesce(-sum(value) FILTER (WHERE value < 0), 0) / sum(abs(value))')} FROM found"""


@add("ord_pcoa", f"WITH RECURSIVE {CELLS}, {LOGS}, {PAIRED}, d AS MATERIALIZED (SELECT a, b, sqrt(2 * (1 - corr(x, y))) AS distance FROM p GROUP BY a, b), {CENTRED} {INERTIA}")
def pcoa(spark, sf):
    d = corr_distance(corr_matrix(assay(spark, sf)), "sqrt")
    return _shares(ordination.pcoa(d, 3).variance)


def _filled_distance(spark, sf, metric):
    a = assay(spark, sf)
    return pair_distance(a.with_cells(a.cells.withColumn("value", F.log10(1 + F.col("value")))), metric)


FILLED_D = {"bray_curtis": "sum(abs(x - y)) / sum(x + y)", "cosine": "1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y))", "manhattan": "sum(abs(x - y))"}


def _centred(metric: str) -> str:
    return f"{FILLED.replace('WITH', 'WITH RECURSIVE', 1)}, d AS MATERIALIZED (SELECT a, b, {FILLED_D[metric]} AS distance FROM p GROUP BY a, b), {CENTRED}"


@add("ord_pcoa_bray_curtis", f"{_centred('bray_curtis')} {INERTIA}")
def pcoa_bray_curtis(spark, sf):
    return _shares(ordination.pcoa(_filled_distance(spark, sf, "bray_curtis"), 3).variance)


@add("ord_pcoa_manhattan", f"{_centred('manhattan')} {INERTIA.replace(', 6) + 0)', ', 4) + 0)')}")
def pcoa_manhattan(spark, sf):
    out = ordination.pcoa(_filled_distance(spark, sf, "manhattan"), 3).variance
    return out.select("component", *[(rnd(F.col(c), 4) + 0.0).alias(c) for c in ("eigenvalue", "share_extracted", "share_total")])


@add(
    "ord_pcoa_cosine_scores",
    f"""{_centred('cosine')} SELECT name AS sample_id, {', '.join(_entry(k, f'vec[i] * sqrt(value)').replace('c =', 'k =') for k in (1, 2, 3))} FROM ranked, place WHERE k <= 3 GROUP BY name""",
)
def pcoa_cosine_scores(spark, sf):
    out = ordination.pcoa(_filled_distance(spark, sf, "cosine"), 3).scores
    return out.select("sample_id", *[(rnd(F.col(f"pc{k}")) + 0.0).alias(f"pc{k}") for k in (1, 2, 3)])


@add(
    "ord_knn_graph",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS item_id, b.vec_id AS neighbor, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT item_id, neighbor, {R('d')} AS distance, row_number() OVER (PARTITION BY item_id ORDER BY d, neighbor)::INT AS rank FROM p QUALIFY rank <= 5""",
)
def knn_graph(spark, sf):
    return ordination.knn_graph(vectors(spark, sf), 5).withColumn("distance", rnd(F.col("distance")))


BISECTED = """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS MATERIALIZED (SELECT a.vec_id AS i, list(list_distance(a.v, b.v) ** 2 ORDER BY b.vec_id) AS sq FROM e a, e b GROUP BY 1), goal AS (SELECT ln(least(20.0, count(*) - 1)) AS goal FROM e),
bis AS (SELECT i, 1e-10::DOUBLE AS low, 1e4::DOUBLE AS high, NULL::DOUBLE AS sigma, NULL::DOUBLE AS total, 0 AS step, false AS done FROM d
  UNION ALL SELECT i, CASE WHEN h < goal THEN mid ELSE low END, CASE WHEN h < goal THEN high ELSE mid END, mid, s, step + 1, abs(h - goal) < 1e-3
  FROM (SELECT *, (s2 / (2 * mid * mid) + (s - 1) * ln(s)) / s AS h FROM (SELECT i, low, high, mid, step, list_sum(w) AS s, list_sum(list_transform(w, lambda x, k: x * sq[k])) AS s2
    FROM (SELECT i, low, high, mid, step, sq, list_transform(sq, lambda x: exp(-x / (2 * mid * mid))) AS w FROM (SELECT *, (low + high) / 2 AS mid FROM bis JOIN d USING (i) WHERE NOT done AND step < 50)))), goal),
widths AS MATERIALIZED (SELECT i, arg_max(sigma, step) AS sigma, arg_max(total, step) AS total FROM bis GROUP BY 1)"""


@add(
    "ord_affinities",
    f"""{BISECTED}, one AS (SELECT a.vec_id AS i, b.vec_id AS j, exp(-(list_distance(a.v, b.v) ** 2) / (2 * sigma * sigma)) / total AS p FROM e a JOIN widths ON i = a.vec_id JOIN e b ON a.vec_id <> b.vec_id),
kept AS (SELECT * FROM one WHERE p > 1e-20), two_way AS (SELECT i, j, sum(p) AS p FROM (SELECT i, j, p FROM kept UNION ALL SELECT j, i, p FROM kept) GROUP BY 1, 2)
SELECT i AS item_id, count(*) AS n, {R('sum(p) / (2 * (SELECT count(*) FROM e))', 8)} AS p FROM two_way GROUP BY 1""",
)
def affinities(spark, sf):
    out = ordination.affinities(vectors(spark, sf), 20.0, packed=True)
    sizes = F.sum(F.size("p").cast("bigint")).alias("n")
    return out.groupBy("item_id").agg(sizes, F.round(F.sum("mass"), 8).alias("p"))


@add("ord_bandwidths", f"{BISECTED} SELECT i AS item_id, {R('sigma')} AS sigma, {R('total')} AS total FROM widths")
def bandwidths(spark, sf):
    return ordination.bandwidths(vectors(spark, sf), 20.0).select("item_id", rnd(F.col("sigma")).alias("sigma"), rnd(F.col("total")).alias("total"))


@add("ord_knn_pruning")
def knn_pruning(spark, sf):
    found = ordination.knn_search(vectors(spark, sf), 5)
    return found.neighbors.agg(F.count("*").alias("neighbors")).withColumns({"block_pairs": F.lit(found.pairs), "computed": F.lit(found.computed)})


@add("cluster_silhouette", f"{SIL} SELECT item_id, label, {R('coalesce(CASE WHEN a IS NOT NULL THEN (b - a) / greatest(a, b) END, 0)')} AS silhouette FROM s")
def silhouette(spark, sf):
    return blocks.silhouette(vectors(spark, sf)).select("item_id", "label", rnd(F.col("silhouette")).alias("silhouette"))


@add("cluster_kmeans")
def kmeans(spark, sf):
    clustered, _ = cluster.kmeans(vectors(spark, sf), 10, n_init=3)
    return clustered.groupBy("cluster").agg(F.count("*").alias("size"))


@add("cluster_assignments")
def assignments(spark, sf):
    clustered, _ = cluster.kmeans(vectors(spark, sf), 10, n_init=2)
    return cluster.assignments(clustered)


@add("cluster_k_sweep")
def k_sweep(spark, sf):
    return cluster.k_sweep(vectors(spark, sf), 2, 5, n_init=1)


SWEEP = "s AS (SELECT p_size AS k, sum(p_retailprice) / p_size AS inertia, avg(p_retailprice) AS silhouette FROM part WHERE p_size >= 2 GROUP BY 1)"


def _sweep(spark, sf):
    f = part_features(spark, sf).filter("size >= 2").groupBy(F.col("size").alias("k"))
    return f.agg((F.sum("price") / F.col("size")).alias("inertia"), F.avg("price").alias("silhouette"))


@add(
    "cluster_elbow",
    f"""WITH {SWEEP}, e AS (SELECT min(k) AS k0, max(k) AS k1, arg_min(inertia, k) AS i0, arg_max(inertia, k) AS i1 FROM s)
SELECT k FROM s, e ORDER BY round(abs((k - k0) / (k1 - k0) + (inertia - i1) / (i0 - i1) - 1) / sqrt(2), 12) DESC, k LIMIT 1""",
)
def elbow(spark, sf):
    return cluster.elbow(_sweep(spark, sf))


@add("cluster_choose_k", f"WITH {SWEEP} SELECT k FROM s ORDER BY silhouette DESC, k LIMIT 1")
def choose_k(spark, sf):
    return cluster.choose_k(_sweep(spark, sf))


@add("cluster_bisecting")
def bisecting(spark, sf):
    return cluster.bisecting(vectors(spark, sf), 8)


@add("cluster_som")
def som(spark, sf):
    v = vectors(spark, sf)
    code = cluster.som(v, 5, 5, epochs=8)
    return cluster.som_units(cluster.som_match(v, code), code, 5, 5)


@add("cluster_som_quality")
def som_quality(spark, sf):
    v = vectors(spark, sf)
    code = cluster.som(v, 4, 4, epochs=5, topology="rect", kernel="bubble", init="random")
    return cluster.som_quality(cluster.som_match(v, code), 4, 4, "rect")


@add("cluster_som_groups")
def som_groups(spark, sf):
    code = cluster.som(vectors(spark, sf), 4, 4, epochs=4)
    return cluster.som_clusters(spark, code, 3)


@add(
    "cluster_threshold",
    """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_distance(a.v, b.v) <= 0.95),
reach(item_id, other) AS (SELECT vec_id, vec_id FROM e UNION SELECT item_id, b FROM reach JOIN p ON a = other)
SELECT item_id, min(other) AS label FROM reach GROUP BY 1""",
)
def threshold(spark, sf):
    return cluster.threshold_clusters(vectors(spark, sf), 0.95)


@add("cluster_levels")
def levels(spark, sf):
    out = cluster.level_labels(vectors(spark, sf), 5)
    return out.groupBy("level").agg(F.count_distinct("cluster").alias("clusters"), F.count("*").alias("items"))


@add(
    "cluster_row_views",
    f"""WITH {CELLS}, {SAMPLES}, s AS (SELECT feature_id, sum(value * value) / (SELECT count(*) FROM samples) - (sum(value) / (SELECT count(*) FROM samples)) ** 2 AS variance, sum(abs(value)) AS abs_sum FROM cells GROUP BY 1),
r AS (SELECT 'variance' AS kind, feature_id, row_number() OVER (ORDER BY variance DESC, feature_id) AS rank, variance AS score FROM s UNION ALL
  SELECT 'abs_sum', feature_id, row_number() OVER (ORDER BY abs_sum DESC, feature_id), abs_sum FROM s)
SELECT kind, feature_id, rank::INT AS rank, list_min(list_filter([500, 250, 100, 50, 20, 10], lambda v: v >= rank))::INT AS view, {R('score / 1e6', 3)} AS score FROM r WHERE rank <= 500""",
)
def row_views(spark, sf):
    out = cluster.row_views(assay(spark, sf))
    return out.withColumn("score", rnd(F.col("score") / 1e6, 3))


@add(
    "cluster_top_variance",
    f"""WITH {CELLS}, {SAMPLES}, s AS (SELECT feature_id, sum(value * value) / (SELECT count(*) FROM samples) - (sum(value) / (SELECT count(*) FROM samples)) ** 2 AS v FROM cells GROUP BY 1)
SELECT * FROM cells WHERE feature_id IN (SELECT feature_id FROM s ORDER BY v DESC, feature_id LIMIT 200)""",
)
def top_variance(spark, sf):
    return cluster.top_variance(assay(spark, sf), 200).cells
